"""N-gram Jaccard join by chosen paths.

A document's set holds its runs of five words (`[^\\x20\\x09-\\x0D]+`, unchanged; a shorter text has one run, all
of its words). Two documents are linked if their sets' Jaccard similarity is at least SIMILARITY. Equal sets
are combined first, before any shuffle of them, so copies are never listed in pairs.

Chosen paths: each set is embedded by TOKENS minwise values, tokens whose agreement is the similarity. At a root a
few tokens are sampled, 1 / SIMILARITY of them on average (at least one, so rather more), by a hash of the node; below it one,
so that a group of near copies, which agree in nearly all tokens, isn't multiplied at each level. Sets that share the value of
a sampled token go on to the same child. A child of up to SMALL sets is compared pair by pair on its tokens; a
larger one is split again, up to DEPTH times. What is still together then agrees in every sampled token, and is
handed on whole. The recursion is run again, with other samples, until RECALL of pairs at the threshold have met even where
every node is split DEPTH times; that is measured on simulated pairs (runs()), and pairs in smaller nodes meet more often.

Verification is exact on 52-bit hashes of shingles: connected candidates form clusters, each set travels once to its
cluster, and the similarity of all pairs in it is computed from the shingles, so every link within a cluster is found and
counted, and none that falls short of the threshold. A cluster of more than BLOCK sets or BLOCK_SHINGLES shingles is compared in
blocks, each pair of blocks its own task: a cluster of n blocks ships n copies of its shingles.

Result: one row per document with its class (the least doc_id among the documents connected by links) and the
number of documents that it is linked to. Defined results: null and empty texts have the empty set and are linked
to each other only; a null doc_id counts as larger than any; rows that are equal count as separate documents;
very long texts are sets like any other (one of over LARGE shingles is compared by itself); an empty table gives no rows; other
columns, whatever their names, are kept by the stage and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load
from fairlead.llm.words import U, buffers, mix, mix1, ngrams, pieces, release, split
from fairlead.operators.components import components, roots_of

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
TOKENS = 64
MOST_RUNS = 100
DEPTH = 4
SMALL = 1000
BLOCK = 500  # sets of a block at most
BLOCK_SHINGLES = 1 << 18  # and about so many shingles
LARGE = 1 << 17  # shingles of a set that is compared by itself
WIDTH = 2048
LEAST_TOKENS = 38  # of 64 equal: 4 standard deviations below the 51 expected at a similarity of 0.8
ROWS = 4096
LAST = np.iinfo(np.int64).max
FACTORS = np.array([mix1(1000 + i) | 1 for i in range(TOKENS)], U)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles (52-bit hashes, ascending), and where each text begins. At most ROWS texts."""
    words = split(*buffers(texts))
    count = np.diff(words.doc_at)
    h, of = words.hashes(), words.doc_of()
    runs = ngrams(h, SHINGLE)
    inside = of[: len(runs)] == of[len(h) - len(runs) :]
    values, row = [runs[inside]], [of[: len(runs)][inside]]
    for n in range(1, SHINGLE):
        row.append(np.flatnonzero(count == n))
        values.append(ngrams(h, n)[words.doc_at[row[-1]]])
    both = np.unique(np.concatenate(row).astype(U) << U(52) | np.concatenate(values) >> U(12))
    return both & U((1 << 52) - 1), np.searchsorted(both >> U(52), np.arange(len(texts) + 1))


def minima(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """TOKENS minwise values of each text; zeros for an empty set."""
    out = np.zeros((len(at) - 1, TOKENS), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        mixed, term = mix(values), np.empty(len(values), U)
        for i, factor in enumerate(FACTORS):
            np.multiply(mixed, factor, out=term)
            out[full, i] = np.minimum.reduceat(term, at[full]) >> U(32)
    return out


def digests(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for seed in (3, 4):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ U(mix1(seed))), dtype=U)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U)).view(np.int64))
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut_rows(batches):
        values, at = shingles(batch["text"])
        one, two = digests(values, at)
        raw = minima(values, at).astype("<u4")
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["row_key"], pa.array(one), pa.array(two), pa.array(np.diff(at)), pa.array([x.tobytes() for x in raw], pa.binary())], names=["doc", "row_key", "node", "other", "n", "tokens"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text to its shingles; the other columns go on."""
    for batch in _cut_rows(batches):
        values, at = shingles(batch["text"])
        raw = [values[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield batch.set_column(batch.schema.get_field_index("text"), "shingles", pa.array(raw, pa.binary()))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def sampled(path: int) -> list[int]:
    """The tokens that a root samples: each with a chance of 1 / (SIMILARITY * TOKENS), at least one."""
    draws = mix(np.arange(TOKENS, dtype=U) ^ U(mix1(path)))
    chosen = np.flatnonzero(draws < U(int(2**64 / (SIMILARITY * TOKENS))))
    return chosen.tolist() or [int(draws.argmin())]


def child(path: np.ndarray | int, token: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(values.astype(U) + mix((np.asarray(token, U) + U(1)) * U(0x9E3779B97F4A7C15) + np.asarray(path, U)))


def roots(run: int, tokens: np.ndarray) -> list[np.ndarray]:
    """The children that each row of tokens goes to from the root of a run, for each token sampled there."""
    path = mix1(run + 77)
    return [child(path, t, tokens[:, t]) for t in sampled(path)]


def children(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The child that each row of tokens goes to from its node."""
    t = mix(np.arange(TOKENS, dtype=U) ^ mix(path)[:, None]).argmin(axis=1)
    return child(path, t, tokens[np.arange(len(t)), t])


@lru_cache
def runs(recall: float = RECALL, pairs: int = 2000) -> int:
    """How many runs it takes until so many of simulated pairs at the threshold have met where every node is split DEPTH times below the roots."""
    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 32, (pairs, TOKENS), dtype=np.uint32)
    two = np.where(rng.random(one.shape) < SIMILARITY, one, rng.integers(0, 1 << 32, one.shape, dtype=np.uint32))
    met = np.zeros(pairs, bool)
    for run in range(MOST_RUNS):
        for left, right in zip(roots(run, one), roots(run, two), strict=True):
            for _ in range(DEPTH):
                left, right = np.where(left == right, children(left, one), 0), np.where(left == right, children(right, two), 1)
            met |= left == right
        if met.mean() >= recall:
            return run + 1
    raise ValueError(f"{MOST_RUNS} runs reach a recall of {met.mean()}; the target is {recall}")


def _roots(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = matrix(batch["tokens"])
            for n in range(count):
                for path in roots(n, tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch["node"]], names=["path", "node"])

    return run


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path = children(batch["path"].to_numpy().view(U), matrix(batch["tokens"]))
        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch["node"]], names=["path", "node"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole keys of a partition sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        values = table[key].to_numpy()
        edge = np.flatnonzero(values[1:] != values[:-1]) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True):
            if held and held[0][key][0].as_py() != values[lo]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links in small nodes, as each set's link to the least that it is connected with."""
    a, b = [], []
    for group in _groups(batches, "path"):
        node = group["node"].to_numpy()
        tokens = matrix(group["tokens"].combine_chunks())
        found = [(np.full(len(hit), i), hit) for i in range(len(node) - 1) if len(hit := i + 1 + np.flatnonzero((tokens[i + 1 :] == tokens[i]).sum(axis=1) >= LEAST_TOKENS))]
        if found:
            root = roots_of(len(node), np.stack([np.concatenate(x) for x in zip(*found, strict=True)]))
            own = np.flatnonzero(root != np.arange(len(node)))
            a.append(node[own])
            b.append(node[root[own]])
        if len(a) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def common(sets: list[np.ndarray], cut: int = 0) -> np.ndarray:
    """Sizes of the intersections of the sets from cut on with those before it; all with all at 0. Frequent shingles by a matrix
    product, WIDTH at a time, rare ones pair by pair. Of pairs with a set over LARGE, those whose sizes rule a link out count 0."""
    size = np.array([len(x) for x in sets])
    first, second = slice(0, cut or len(sets)), slice(cut, len(sets))
    inter = np.zeros((len(sets), len(sets)), np.float32 if size.max() < 1 << 24 else np.float64)
    usual = np.flatnonzero(size <= LARGE)
    if len(usual) > 1:
        row = np.repeat(usual, size[usual])
        _, column, seen = np.unique(np.concatenate([sets[i] for i in usual.tolist()]), return_inverse=True, return_counts=True)
        often = 1 if len(usual) <= 64 else 16
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        times = seen[column]
        frequent = times > often
        place = np.cumsum(seen > often) - 1
        far, near = place[column[frequent]], row[frequent]
        edges = np.searchsorted(far, np.arange(0, far[-1] + 1 + WIDTH if len(far) else 1, WIDTH))
        for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            x = np.zeros((len(sets), WIDTH), np.float32)
            x[near[lo:hi], far[lo:hi] - k * WIDTH] = 1
            inter[first, second] += x[first] @ x[second].T
        for n in range(2, often + 1):
            rows = row[times == n].reshape(-1, n)
            for i in range(n):
                for j in range(i):
                    np.add.at(inter, (rows[:, i], rows[:, j]), 1)
                    np.add.at(inter, (rows[:, j], rows[:, i]), 1)
    for i in np.flatnonzero(size > LARGE).tolist():
        for j in np.flatnonzero((size <= size[i] + 1) & (size >= SIMILARITY * size[i] - 1)).tolist():
            at = np.searchsorted(sets[i], sets[j])
            inter[i, j] = inter[j, i] = (sets[i][np.minimum(at, size[i] - 1)] == sets[j]).sum()
    inter[np.arange(len(sets)), np.arange(len(sets))] = size
    return inter


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the sets of each task: documents linked, and the least set connected. A task compares all, or one block with another."""
    out: list[list[np.ndarray]] = []

    def flush():
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "links", "root"])

    for n, group in enumerate(_groups(batches, "task")):
        node, copies, block = (group[c].to_numpy() for c in ("node", "copies", "block"))
        other = block != block[0]
        order = np.argsort(other, kind="stable")  # one block, then the other
        node, copies, cut = node[order], copies[order], int((~other).sum()) if other.any() else 0
        column = group["shingles"].combine_chunks().take(pa.array(order))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in column]
        inter = common(sets, cut)
        size = np.array([len(x) for x in sets], inter.dtype)
        linked = inter >= SIMILARITY * (size[:, None] + size - inter) - 1e-3  # sizes are whole numbers
        if cut:
            linked[cut:] = linked[:cut, :cut] = False
            linked |= linked.T
        linked[np.arange(len(node)), np.arange(len(node))] = False
        pairs = np.stack(np.nonzero(np.triu(linked)))
        root = roots_of(len(node), pairs)
        out.append([node, linked @ copies, node[root]])
        if len(out) >= 1000:
            yield flush()
            out = []
        if len(node) > 64 and n % 8 == 0:
            release()
    if out:
        yield flush()
    release()


def candidates(spark: SparkSession, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) between sets(node, tokens) that may be similar."""
    rows = sets.select("node", "tokens").mapInArrow(_roots(runs()), "path long, node long")
    found = None
    for depth in range(DEPTH + 1):
        rows = scratch.keep(rows, f"paths{depth}")
        together = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
        rows = scratch.keep(rows.join(together, "path"), f"nodes{depth}")
        scratch.free(f"paths{depth}")
        small = rows.where(f"n <= {SMALL}").join(sets.select("node", "tokens"), "node").select("path", "node", "tokens")
        links = small.repartition("path").sortWithinPartitions("path", "node").mapInArrow(_compare, "a long, b long")
        found = links if found is None else found.unionByName(links)
        rows = rows.where(f"n > {SMALL}")
        if rows.isEmpty():
            return found
        if depth == DEPTH:
            return found.unionByName(rows.selectExpr("node AS a", "least AS b"))
        rows = rows.select("path", "node").join(sets.select("node", "tokens"), "node").select("path", "node", "tokens").mapInArrow(_children, "path long, node long").distinct()


def classes_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc (doc_id, LAST for null), row_key, class (of the same two, the least of the class) and n_links for each row of docs."""
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text", F.lit(1)).alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(texts.mapInArrow(_embed, "doc long, row_key long, node long, other long, n long, tokens binary"), "rows")
    sets = rows.groupBy("node", "other", "n").agg(F.min(F.struct("doc", "row_key", "tokens")).alias("first"), F.count("*").alias("copies"))
    sets = scratch.keep(sets.selectExpr("node", "other", "n", "copies", "first.doc AS doc", "first.row_key AS row_key", "first.tokens AS tokens"), "sets")
    clusters = components(spark, candidates(spark, sets.where("n > 0"), scratch))
    clusters = scratch.keep(clusters, "clusters")
    sizes = clusters.join(sets.select("node", "n"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sizes = sizes.selectExpr("component", f"cast(ceil(greatest(size / {BLOCK}, total / {BLOCK_SHINGLES})) AS int) AS blocks")
    placed = clusters.join(sizes, "component").join(sets.select("node", "doc", "row_key", "copies"), "node")
    placed = placed.selectExpr("node", "doc", "row_key", "copies", "component", "blocks", "cast(pmod(xxhash64(node), blocks) AS int) AS block")
    held = texts.join(placed, ["doc", "row_key"]).dropDuplicates(["doc", "row_key"])  # dealt out by these already
    shingled = held.select("node", "text", "copies", "component", "blocks", "block").mapInArrow(_sets, "node long, shingles binary, copies long, component long, blocks int, block int")
    task = "explode(transform(sequence(0, blocks - 1), x -> xxhash64(component, least(x, block), greatest(x, block)))) AS task"
    dealt = shingled.selectExpr("node", "shingles", "copies", "block", task).repartition("task").sortWithinPartitions("task", "node")
    verified = scratch.keep(dealt.mapInArrow(_verify, "node long, links long, root long"), "verified")
    classes = components(spark, verified.selectExpr("node AS a", "root AS b"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(links, "node").join(sets.selectExpr("node", "struct(doc, row_key) AS first"), "node")
    least = known.groupBy("component").agg(F.min("first").alias("class"))
    known = known.join(least, "component").select("node", "links", "class")
    groups = sets.selectExpr("node", "other", "n", "copies", "struct(doc, row_key) AS first").join(known, "node", "left")
    groups = groups.select("node", "other", "n", F.coalesce("class", "first").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc", "row_key", "node", "other", "n").join(groups, ["node", "other", "n"]).select("doc", "row_key", "class", "n_links")


def jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept for each row of docs."""
    return classes_of(spark, docs).selectExpr(f"nullif(doc, {LAST}L) AS doc_id", f"nullif(class.doc, {LAST}L) AS class_id", "n_links", "struct(doc, row_key) = class AS kept")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the least doc_id; of rows equal in doc_id and text, one."""
    kept = classes_of(spark, docs).where("struct(doc, row_key) = class").select("doc", "row_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text", F.lit(1)).alias("row_key"))
    return rows.join(kept, ["doc", "row_key"]).dropDuplicates(["doc", "row_key"]).select("row.*")
