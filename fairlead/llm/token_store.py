"""Token ids in a directly addressable binary format.

Encoding: texts (null: empty) are encoded with the tokenizers library, no special tokens added, and END is
appended to each document. The byte-level pre-tokenizer never looks back, so a text may be cut wherever one of its
matches surely ends: before white space after a character that isn't, after a lone line feed, and where two of the ASCII
classes letter, digit and sign meet (but for the apostrophe). Each distinct piece is encoded once by each worker
and looked up after that. Strings of the tokenizer's own special tokens are never cut.

Format: a Parquet table, uncompressed and without dictionaries, with a row for each page of PAGE ids of a part (a range of
doc_ids; null first; equal doc_ids in order of their texts' checksum, then of their text). A page holds, for each level of
CHUNK bits, an array of chunks, a bitmap that says which entries continue on the next level, and the rank directory of that
bitmap (ones before each BLOCK bits). Entry i of a level is found at position rank(i) of the next, so `access` reads any token
with a few array reads and no block decoding. Token p of a part stands in page p // PAGE at p % PAGE: `fetch` finds a
document's place in the pages' small columns and reads the one page it needs, by filters that reach the Parquet scan.
All arrays are little-endian. A document may span any number of pages. A table of parts has the tokens before each part.

Defined results: an empty text has one token, END; repeated rows are stored as often as they come; an empty table
gives an empty store; other columns, whatever their names, are ignored; very long texts are encoded whole, by one task.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import load, shared_dir, ship
from fairlead.llm.words import buffers, pieces, release

END = 2
CHUNK = 8
BLOCK = 512
PAGE = 1 << 13
CACHE_BYTES = 20 << 20
BATCH = 3 << 20
GROUP = 20
LETTER, DIGIT, SIGN, WHITE, HIGH, APOSTROPHE = range(1, 7)
CLASS = np.zeros(256, np.uint8)  # 0: control characters
CLASS[0x21:0x7F] = SIGN
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[0x27] = APOSTROPHE
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASS[0x80:] = HIGH


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each place is white space outside of ASCII."""
    a, b, c = (data[np.maximum(at - i, 0)] for i in range(3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
    return two | general | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)


def cuts(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which a match of the pre-tokenizer surely ends."""
    out = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return out
    kind = CLASS[data]
    left, right = kind[:-1], kind[1:]
    end = (right == WHITE) & (left != WHITE) & (left != 0)
    high = np.flatnonzero(end & (left == HIGH))
    end[high[white(data, high)]] = False
    feed = np.flatnonzero(end[:-1] & (data[1:-1] == 0x0A)) + 1
    end |= (left != right) & (left - 1 < 3) & (right - 1 < 3)
    after = kind[feed + 1]
    end[feed[(after >= LETTER) & (after <= SIGN)]] = True
    out[1:-1] = end
    return out


class Encoder:
    """Ids of many texts at once, with a cache of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already; threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) + ")")
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.large_binary())
        self.at, self.ids, self.used = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def prune(self) -> None:
        """Keeps the pieces that were asked for again since the last time, if they are at most half of the cache."""
        if self.names.nbytes + self.ids.nbytes + self.at.nbytes <= CACHE_BYTES:
            return
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > len(self.used):
            return self.clear()
        size = np.diff(self.at)[keep]
        at = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(self.at[keep] - at[:-1], size) + np.arange(at[-1])]
        self.names, self.at, self.used = self.names.take(pa.array(keep)), at, np.zeros(len(keep), bool)
        release()

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        """Ids of each piece. Pieces without line feeds are joined by them: each is a match, and token, of its own, or that is seen by their number."""
        out: list[list[int]] = [[]] * len(texts)
        joined = [i for i, x in enumerate(texts) if "\n" not in x]
        groups = [joined[i : i + GROUP] for i in range(0, len(joined), GROUP)]
        single = [i for i, x in enumerate(texts) if "\n" in x]
        for lo in range(0, len(groups), 100):
            some = groups[lo : lo + 100]
            for group, coded in zip(some, self.tokenizer.encode_batch_fast(["\n".join([texts[i] for i in g]) for g in some], add_special_tokens=False), strict=True):
                ids, last = coded.ids, 0
                if ids.count(self.feed) != len(group) - 1:
                    single += group
                    continue
                for i in group[:-1]:
                    to = ids.index(self.feed, last)
                    out[i], last = ids[last:to], to + 1
                out[group[-1]] = ids[last:]
        for i in single:
            out[i] = self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids
        return out

    def rows(self, found: pa.Array) -> np.ndarray:
        """The cache's row of each piece."""
        got = pc.index_in(found, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[got[got >= 0]] = True
        new = np.flatnonzero(got < 0)
        if len(new):
            names = found.take(pa.array(new))
            ids = self.encode_each([x.decode() for x in names.to_pylist()])
            got[new] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, names])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.array([t for x in ids for t in x], np.uint32)])
            self.used = np.append(self.used, np.zeros(len(new), bool))
        return got

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and where each text begins (and the end)."""
        self.prune()
        texts = texts.cast(pa.large_string()).fill_null("")
        doc = np.arange(len(texts) + 1)  # the first part of each text
        whole = None
        if pc.any(pc.match_substring_regex(texts, self.special.pattern)).as_py():  # as parts: the special tokens and what is between
            parts = [self.special.split(x) for x in texts.to_pylist()]
            doc = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            whole = np.flatnonzero([i % 2 for x in parts for i in range(len(x))])
            texts = pa.array([y for x in parts for y in x], pa.large_string())
        data, at = buffers(texts)
        cut = cuts(data)
        if whole is not None:
            for lo, hi in zip(at[whole].tolist(), at[whole + 1].tolist(), strict=True):
                cut[lo:hi] = False
        cut[at] = True
        cut[-1] = False
        begin = np.flatnonzero(cut)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)])
        coded = found.dictionary_encode()
        row = self.rows(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        size = np.diff(self.at)[row]
        to = np.concatenate([[0], np.cumsum(size)])
        edge = to[np.searchsorted(begin, at[doc])]  # tokens before each text
        out = np.full(to[-1] + len(doc) - 1, END, np.uint32)
        free = np.ones(len(out), bool)
        ends = edge[1:] + np.arange(len(doc) - 1)
        free[ends] = False
        out[free] = self.ids[np.repeat(self.at[row] - to[:-1], size) + np.arange(to[-1])]
        return out, np.concatenate([[0], ends + 1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Chunks, continuation bitmap and rank directory of each level."""
    levels, values = [], ids.astype(np.uint32)
    while True:
        more = values >= 1 << CHUNK
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        rank = np.cumsum(ones) - ones
        levels.append({"chunks": (values & (1 << CHUNK) - 1).astype(np.uint8).tobytes(), "bitmap": bits.tobytes(), "rank": rank.astype("<u4").tobytes()})
        values = values[more] >> CHUNK
        if not len(values):
            return levels


def access(levels: list[dict[str, bytes]], i: int) -> int:
    """The token at i: on each level one chunk, one bit and one rank."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][i] << depth * CHUNK
        if not level["bitmap"][i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        bits = int.from_bytes(level["bitmap"][block * BLOCK // 8 : i // 8 + 1], "little") & (1 << i - block * BLOCK) - 1
        i = int.from_bytes(level["rank"][4 * block : 4 * block + 4], "little") + bits.bit_count()
    return value


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    values = np.zeros(0, np.uint32)
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["bitmap"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
        chunks[more] |= values << CHUNK
        values = chunks
    return values


LEVEL = pa.list_(pa.struct([("chunks", pa.binary()), ("bitmap", pa.binary()), ("rank", pa.binary())]))
DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("number", pa.int64()), ("at", pa.int32()), ("before", pa.int64()), ("n", pa.int64())]))
# docs: those that have ids in the page: their number in the part, the place in the page, and how many ids the document has before that and in the page
STORE = "part int, page long, first long, last long, docs array<struct<doc_id:long,number:long,at:int,before:long,n:long>>, levels array<struct<chunks:binary,bitmap:binary,rank:binary>>"


def _merged(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes: the more text, the fewer distinct pieces for each word of it."""
    held, size = [], 0
    for batch in pieces(batches, "text", most):
        held.append(batch)
        size += len(buffers(batch["text"])[0])
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pages(path: str):
    """Encodes a partition of texts, which come in order, and cuts the ids to pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, page = TaskContext.get().partitionId(), 0, 0
        rest, docs = np.zeros(0, np.uint32), []  # what the last page hasn't got yet

        def out(ids: np.ndarray, docs: list[dict]) -> pa.RecordBatch:
            known = [d["doc_id"] for d in docs if d["doc_id"] is not None]
            columns = [pa.array([part], pa.int32()), pa.array([page]), pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()), pa.array([docs], DOCS), pa.array([encode_levels(ids)], LEVEL)]
            return pa.RecordBatch.from_arrays(columns, names=["part", "page", "first", "last", "docs", "levels"])

        for batch in _merged(batches):
            ids, at = encoder(path).batch(batch["text"])
            begin = at + len(rest)
            ids = np.concatenate([rest, ids])
            lo, here = 0, docs  # lo: first id of the page in ids
            for doc, a, b in zip(batch["doc_id"].to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                start = a
                while a < b:
                    to = min(b, lo + PAGE)
                    here.append({"doc_id": doc, "number": number, "at": a - lo, "before": a - start, "n": to - a})
                    a = to
                    if a == lo + PAGE:
                        yield out(ids[lo:a], here)
                        page, lo, here = page + 1, a, []
                number += 1
            rest, docs = ids[lo:].copy(), here
        if len(rest):
            yield out(rest, docs)
        release()

    return run


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokens: str | None = None) -> None:
    """Writes docs(doc_id, text) to path/pages and path/parts."""
    ship(spark)
    order = F.asc_nulls_first("doc_id")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(order).sortWithinPartitions(order, F.crc32(F.col("text").cast("binary")), "text")
    out = ordered.mapInArrow(_pages(tokens or tokenizer_path()), STORE).write
    out.options(**{"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size": str(1 << 16), "parquet.page.row.count.limit": "16"}).parquet(f"{path}/pages")
    sizes = spark.read.parquet(f"{path}/pages").selectExpr("part", f"page * {PAGE} + docs[size(docs) - 1].at + docs[size(docs) - 1].n AS n").groupBy("part").agg(F.max("n").alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in sizes])]).astype(np.int64)
    spark.createDataFrame([(r.part, int(b)) for r, b in zip(sizes, before[:-1], strict=True)], "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def crc_shift(crc: int, zeros: int) -> int:
    """The register of a crc32 after so many zero bytes."""
    for k in range(zeros.bit_length()):
        if zeros >> k & 1:
            crc = apply(POWERS[k], crc)
    return crc


def apply(columns: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


def _crc_powers() -> list[list[int]]:
    """The linear maps of 1, 2, 4, ... zero bytes on the register of a crc32, as columns."""
    one = [1 << i for i in range(32)]
    bit = [0xEDB88320, *one[:31]]
    for _ in range(3):
        bit = [apply(bit, x) for x in bit]
    out = [bit]
    while len(out) < 48:
        out.append([apply(out[-1], x) for x in out[-1]])
    return out


POWERS = _crc_powers()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids in each page: how many, and their checksum."""
    names = ["part", "page", "number", "doc_id", "at", "before", "n", "crc"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids = memoryview(decode_levels(row["levels"]).astype("<u4").tobytes())
            out += [(row["part"], row["page"], d["number"], d["doc_id"], d["at"], d["before"], d["n"], zlib.crc32(ids[4 * d["at"] : 4 * (d["at"] + d["n"])])) for d in row["docs"]]
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "part" else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of documents from those of their parts, in order."""
    for batch in batches:
        crcs = []
        for row in batch["crcs"].to_pylist():
            crc = row[0]["crc"]
            for more in row[1:]:
                crc = crc_shift(crc, 4 * more["n"]) ^ more["crc"]
            crcs.append(crc)
        yield batch.drop_columns(["crcs"]).append_column("ids_crc32", pa.array(crcs, pa.int64()))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone. Only a few numbers for each document and page travel."""
    pages = spark.read.schema(STORE).parquet(f"{path}/pages").select("part", "page", "docs", "levels")
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    found = pages.mapInArrow(_read, "part int, page long, number long, doc_id long, at long, before long, n long, crc long")
    docs = found.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.min(F.col("page") * PAGE + F.col("at")).alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("crcs"))
    docs = docs.join(parts, "part").selectExpr("doc_id", "before + start AS start", "n_tokens", "crcs")
    return docs.mapInArrow(_whole, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_id: int | None, i: int) -> int | None:
    """Id i of a document of the store (of several with the same doc_id, the first); null if it has none. Reads the small columns
    of the pages that may hold the document, then one page."""
    pages = spark.read.schema(STORE).parquet(f"{path}/pages")
    near = pages.where(F.col("first").isNull() | (F.size(F.filter("docs", lambda d: d.doc_id.isNull())) > 0) if doc_id is None else (F.col("first") <= doc_id) & (F.col("last") >= doc_id))
    places = near.select("part", "page", F.explode("docs").alias("d")).where(F.col("d.doc_id").eqNullSafe(F.lit(doc_id).cast("long")))
    places = places.where(f"d.before <= {int(i)} AND d.before + d.n > {int(i)}").orderBy("part", "d.number").limit(1)
    if i < 0 or not (place := places.selectExpr("part", "page", f"d.at + {int(i)} - d.before AS at").first()):
        return None
    row = pages.where(f"part = {place.part} AND page = {place.page}").select("levels").first()
    return access([{k: bytes(x[k]) for k in ("chunks", "bitmap", "rank")} for x in row.levels], place.at)


def token_store(spark: SparkSession, docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """Writes docs to a store in the shared folder and reads it back."""
    path = f"{shared_dir(spark)}/fairlead/tokens-{uuid.uuid4().hex}"
    write_store(spark, docs, path, tokens)
    return read_store(spark, path)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(spark, load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store(spark, docs)
