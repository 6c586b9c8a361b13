"""Repeated windows of 50 words, by super-k-mer partitioning.

A window's minimiser is the least hash among its runs of SEED words. Consecutive windows with the same minimiser
form a super-k-mer: one packed string. Equal windows have equal minimisers, so a window repeats only among the
super-k-mers of its minimiser:

1. Each document lists its super-k-mers: place, minimiser and a digest of the string (128 bits of BLAKE2b of its bytes).
2. Equal strings are combined before they are dealt out; of each, the first document (least doc_id) is its
   representative. In all later documents every window of that string is a repeat.
3. Minimisers with one string, or in one document, need no more. For the others, each distinct string travels once,
   packed, to its minimiser's bucket. There words become exact ranks, ranks are doubled up to 50 words,
   and a sort by (rank, doc_id) shows the first document of every window.
4. A minimiser with more than HOT distinct strings (a phrase in many contexts) is split into its windows, which are
   combined by the SHA-256 of their words before they are dealt out, so no bucket holds a hot phrase.
5. Windows that start in an earlier document mark their words; marked words go.

Defined results: a null or empty text has no words; a document under 50 words loses none; a null doc_id counts as
larger than any; rows with the same doc_id don't mark each other, and rows equal in doc_id and text are
treated alike; repeats within one document stay; very long texts are cut to super-k-mers like any other, a batch of its own each;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load
from fairlead.llm.words import buffers, ngrams, pieces, sliding_min, split

WINDOW = 50
SEED = 8
LONGEST = 512
HOT = 20_000
CHUNK_WORDS = 1 << 20
LAST = np.iinfo(np.int64).max
RUN = "struct<start:int,n:int,minimiser:bigint,k1:bigint,k2:bigint>"


def superkmers(texts: pa.Array, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """doc (row of texts), start (word), n (windows), minimiser of every super-k-mer, its first word and the one after its last among all words; and the words of each text."""
    words = split(*buffers(texts))
    count = np.diff(words.doc_at)
    least = sliding_min(ngrams(words.hashes(), seed), window - seed + 1)
    valid = np.repeat(words.doc_at[1:], count) - np.arange(len(words.start)) >= window
    at = np.flatnonzero(valid)
    least = least[at]
    cut = np.ones(len(at), bool)
    cut[1:] = (least[1:] != least[:-1]) | (np.diff(at) > 1)
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(at)))
    more = (length - 1) // LONGEST + 1  # very long runs are cut
    part = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    first = np.repeat(first, more) + part * LONGEST
    length = np.minimum(LONGEST, np.repeat(length, more) - part * LONGEST)
    start = at[first]
    doc = words.doc_of()[start]
    place = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])  # of each word, with one space after each
    end = start + length + window - 1
    return doc, start - words.doc_at[doc], length, least[first].view(np.int64), place[start], place[end] - 1, count


def digests(forms: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The two halves of a 128-bit BLAKE2b of each string's bytes; forms: each text's words joined by one space."""
    flat = memoryview(b"".join([x + b" " for x in forms if x]))
    raw = b"".join([blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        doc, start, n, least, first, last, count = superkmers(batch["text"])
        forms = [b" ".join(x.encode().split()) for x in batch["text"].to_pylist()]
        k = digests(forms, first, last)
        runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["start", "n", "minimiser", "k1", "k2"])
        offsets = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        whole = [sha256(x).hexdigest() for x in forms]
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["row_key"], pa.array(count.astype(np.int64)), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["doc", "row_key", "n_words", "whole", "runs"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings of the listed super-k-mers; those of hot minimisers as single windows (j from 0)."""
    names = ["minimiser", "k1", "k2", "doc", "j", "packed"]
    for batch in pieces(batches, "text"):
        out = []
        for doc, text, runs in zip(*(batch[c].to_pylist() for c in ("doc", "text", "runs")), strict=True):
            words = text.encode().split()
            for r in runs:
                if r["hot"]:
                    out += [(r["minimiser"], r["k1"], r["k2"], doc, j, b" ".join(words[r["start"] + j : r["start"] + j + WINDOW])) for j in range(r["n"])]
                else:
                    out.append((r["minimiser"], r["k1"], r["k2"], doc, -1, b" ".join(words[r["start"] : r["start"] + r["n"] + WINDOW - 1])))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def earlier_windows(packed: pa.Array, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) pairs whose words also stand in a row of a smaller doc: exact ranks, doubled, then sorted."""
    lists = pc.split_pattern(packed.cast(pa.large_binary()).cast(pa.large_string()), " ")
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rank = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, span = len(rank), 1

    def joined(shift: int) -> np.ndarray:
        return pd.factorize(rank[: len(rank) - shift] * (n + 1) + rank[shift:])[0].astype(np.int64)

    while span * 2 <= window:
        rank, span = joined(span), span * 2
    if span < window:
        rank = joined(window - span)
    row = np.repeat(np.arange(len(length)), length)[: len(rank)]
    at = np.arange(len(rank)) - np.repeat(np.cumsum(length) - length, length)[: len(rank)]
    valid = at <= length[row] - window
    rank, row, at = rank[valid], row[valid], at[valid]
    order = np.lexsort((doc[row], rank))
    head = np.ones(len(order), bool)
    head[1:] = np.diff(rank[order]) != 0
    first = doc[row[order]][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    found = order[first < doc[row[order]]]
    return row[found], at[found]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole minimisers at a time (the partition is sorted by them), about CHUNK_WORDS words together."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        row, at = earlier_windows(table["packed"].combine_chunks(), table["doc"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(table["k1"].to_numpy()[row]), pa.array(table["k2"].to_numpy()[row]), pa.array(at.astype(np.int32))], names=["k1", "k2", "j"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        size += table.nbytes
        if size > CHUNK_WORDS * 6:
            every = pa.concat_tables(held)
            key = every["minimiser"].to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if (np.diff(key) >= 0).all() else 0
            if whole:
                yield solve(every.slice(0, whole))
                held = [every.slice(whole)]
                size = held[0].nbytes
    if held:
        yield solve(pa.concat_tables(held))


def _cut(keep: bool):
    """Words that no mark covers: how many go, the digest of the rest, and its text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            removed, kept = [], []
            for text, marks in zip(batch["text"].to_pylist(), batch["marks"].to_pylist(), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [m["start"] for m in marks], 1)
                np.add.at(edge, [m["end"] for m in marks], -1)
                stays = np.cumsum(edge)[:-1] == 0
                removed.append(int((~stays).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            texts = pa.array([x.decode() if keep else None for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["row_key"], pa.array(removed, pa.int64()), pa.array([sha256(x).hexdigest() for x in kept], pa.string()), texts], names=["doc", "row_key", "n_removed", "digest", "kept"])

    return run


def repeats(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts by (doc, row_key), their super-k-mers, and (doc, row_key, marks) of the documents that lose words."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text", F.lit(1)).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    listed = scratch.keep(texts.mapInArrow(_list, f"doc long, row_key long, n_words long, whole string, runs array<{RUN}>"), "listed")
    runs = listed.selectExpr("doc", "row_key", "inline(runs)")
    strings = runs.groupBy("minimiser", "k1", "k2").agg(F.min(F.struct("doc", "row_key", "start", "n")).alias("first"), F.max("doc").alias("last"))
    strings = scratch.keep(strings, "strings")
    shared = strings.groupBy("minimiser").agg(F.min("first.doc").alias("a"), F.max("last").alias("b"), F.count("*").alias("kinds")).where("a < b AND kinds > 1")
    chosen = strings.join(shared, "minimiser").selectExpr("first.doc AS doc", "first.row_key AS row_key", f"struct(first.start, first.n, minimiser, k1, k2, kinds > {HOT} AS hot) AS run")
    chosen = scratch.keep(chosen.groupBy("doc", "row_key").agg(F.collect_list("run").alias("runs")), "chosen")
    packed = texts.join(chosen, ["doc", "row_key"]).select("doc", "text", "runs").mapInArrow(_strings, "minimiser long, k1 long, k2 long, doc long, j int, packed binary")
    packed = scratch.keep(packed, "packed")
    dealt = packed.where("j < 0").repartition("minimiser").sortWithinPartitions("minimiser")
    plain = dealt.select("minimiser", "k1", "k2", "doc", "packed").mapInArrow(_buckets, "k1 long, k2 long, j int")
    hot = packed.where("j >= 0").selectExpr("k1", "k2", "doc", "j", "unhex(sha2(packed, 256)) AS w")
    least = hot.groupBy("w").agg(F.min("doc").alias("least"))
    hot = hot.join(least, "w").where("least < doc").select("k1", "k2", "j")
    windows = scratch.keep(plain.unionByName(hot).groupBy("k1", "k2").agg(F.collect_set("j").alias("js")), "windows")
    scratch.free("packed", "chosen")
    later = strings.where("last > first.doc").selectExpr("k1", "k2", "first.doc AS least").join(windows, ["k1", "k2"], "full_outer")
    marked = runs.join(later, ["k1", "k2"]).selectExpr(
        "doc", "row_key", "start", "n",
        f"CASE WHEN doc > least THEN array(struct(start, start + n + {WINDOW - 1} AS end)) ELSE transform(js, j -> struct(start + j AS start, start + j + {WINDOW} AS end)) END AS marks",
    ).where("marks IS NOT NULL")
    marks = scratch.keep(marked.groupBy("doc", "row_key").agg(F.flatten(F.collect_set("marks")).alias("marks")), "marks")
    scratch.free("windows", "strings")
    return texts, listed, marks


def substring_dedup(spark: SparkSession, docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (null: the text is whole) for each row of docs."""
    scratch = Scratch(spark)
    texts, listed, marks = repeats(spark, docs, scratch)
    cut = texts.join(marks, ["doc", "row_key"]).mapInArrow(_cut(keep), "doc long, row_key long, n_removed long, digest string, kept string").dropDuplicates(["doc", "row_key"])
    rows = listed.select("doc", "row_key", "n_words", "whole").join(cut, ["doc", "row_key"], "left")
    return rows.select(F.expr(f"nullif(doc, {LAST}L)").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("digest", "whole").alias("kept_sha256"), *["kept"] * keep)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, load(spark, sf_dir, "documents"), keep=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, w, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT r, doc_id, p, md5(array_to_string(list_slice(w, p + 1, p + 50), ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY 1),
g AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM h JOIN m USING (h) WHERE m.least < h.doc_id),
e AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
k AS (SELECT e.r, string_agg(w[e.i + 1], ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e LEFT JOIN g ON e.r = g.r AND e.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
