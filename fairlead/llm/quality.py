"""Quality by importance resampling: target against raw generative models of hashed n-grams, and Gumbel top-k.

A text's n-grams are GRAM consecutive bytes of its shape (letters, capitals, digits and punctuation by class, so
that the model reads layout in any language) and its pairs of neighbouring words, where two equal words are one
n-gram of their own. Both are hashed to BUCKETS buckets. The raw model counts every document; the target
model counts documents labelled good, from a sample of at most LABELLED labels. A document's importance
weight is the ratio of its probabilities under the two; its logarithm is a sum over the n-grams.

k is the number of documents whose log weight reaches a cut, set on labelled documents that the target model hasn't
seen (half of the sample, by hash) where it best parts good from bad. The k largest log weights plus seeded Gumbel
noise are kept, which samples k documents without replacement in proportion to their weights. The k-th key
is found by counting in ever finer ranges; the driver sees BUCKETS counts, the sample of labels and at most
FEW keys.

Each partition sends at most BUCKETS counts, so the shuffle grows with the partitions read, by 1.5 MB each at most.

Defined results: a null or empty text has log weight 0; without good or without bad labels all documents are
kept; rows with equal doc_id get the same noise, and rows tied with the k-th key are all kept; null doc_ids
are unlabelled and share their noise; very long texts are weighed whole; an empty table gives no rows; other columns, whatever
their names, are kept by the stage and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.functions.tables import Scratch, load
from fairlead.llm.words import U, buffers, mix, pieces, split, unused

BUCKETS = 1 << 16
GRAM = 4
LABELLED = 20_000
FEW = 10_000
GOOD_COUNTS = 4  # losing a good document weighs as much as letting this many bad ones pass
SEED = 99
SHAPE = np.full(256, ord("a"), np.uint8)
SHAPE[:0x80] = np.arange(0x80)
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the row of texts of each."""
    data, at = buffers(texts)
    words, n = split(data, at), max(0, len(data) - GRAM + 1)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    shape = SHAPE[data].astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    for i in range(GRAM):
        gram |= shape[i : i + n] << np.uint32(8 * i)
    gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(16)
    inside = row[:n] == row[len(data) - n :]
    h, of = words.hashes(), words.doc_of().astype(np.int32)
    pair = (mix(h[:-1] ^ (h[1:] * U(3))) >> U(48)).astype(np.uint32)
    pair[h[:-1] == h[1:]] = 1
    together = of[:-1] == of[1:]
    return np.concatenate([gram[inside], pair[together]]).astype(np.int64), np.concatenate([row[:n][inside], of[:-1][together]])


class Model:
    """Log ratio of each bucket, and the cut."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        fit = target.sum() > 0
        self.ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if fit else np.zeros(BUCKETS)

    def weigh(self, texts: pa.Array) -> np.ndarray:
        bucket, row = features(texts)
        return np.round(np.bincount(row, self.ratio[bucket], minlength=len(texts)), 9)


def best_cut(good: list[float], bad: list[float]) -> float:
    """Where good and bad part best: least sum of the error rates, good weighted by GOOD_COUNTS, in the middle of the widest such gap."""
    if not good or not bad:
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    width = np.concatenate([[0], np.diff(at)])
    lost = GOOD_COUNTS * np.searchsorted(np.sort(good), edges) / len(good) + 1 - np.searchsorted(np.sort(bad), edges) / len(bad)
    least = np.flatnonzero(lost <= lost.min() + 1e-12)
    return float(edges[least[np.argmax(width[least])]])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[int, int]]:
    """The model, and the labels held out."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = chosen.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(LABELLED).collect()
    seen = spark.sparkContext.broadcast(np.array(sorted(r.doc_id for r in sample[::2] if r.quality == 1), np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches, "text"):
            bucket, row = features(batch["text"])
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = np.isin(batch["doc_id"].to_numpy(zero_copy_only=False), seen.value)
            target += np.bincount(bucket[own[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in texts.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return Model(raw, target), {r.doc_id: r.quality for r in sample[1::2]}


WEIGHT = "fairlead_log_weight"


def weighed(spark: SparkSession, docs: DataFrame, model: Model, name: str = WEIGHT) -> DataFrame:
    """docs with a column name of log weights."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch.append_column(name, pa.array(held.value.weigh(batch["text"])))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def key(name: str = WEIGHT) -> Column:
    """The log weight plus Gumbel noise that depends on doc_id alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED + 1)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(name) - F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int, few: int = FEW, bins: int = 1000) -> float:
    """The k-th largest value, by counts in ever finer ranges."""
    if k <= 0:
        return np.inf
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return -np.inf
    above = 0
    while True:
        part = df.where(F.col(column).between(low, high))
        if n <= few or low == high:
            values = sorted((r[0] for r in part.select(column).collect()), reverse=True) if low < high else [low] * n
            return values[k - above - 1]
        width = (high - low) / bins
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counts = {r.bin: r for r in part.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b].n >= k:
                low, high, n = counts[b].low, counts[b].high, counts[b].n
                break
            above += counts[b].n


def select(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model, float]:
    """doc_id, log_weight, kept for each row of docs; the model and the least key kept."""
    model, held_out = fit(spark, docs, labels)
    rows = Scratch(spark).keep(weighed(spark, docs.select("doc_id", "text"), model).select("doc_id", F.col(WEIGHT).alias("log_weight"), key().alias("key")), "weights")
    known = spark.createDataFrame([(int(i), int(q)) for i, q in held_out.items()], "id long, quality int")
    found = rows.join(known, rows["doc_id"] == known["id"]).select("log_weight", "quality").collect()
    cut = best_cut([r[0] for r in found if r[1] == 1], [r[0] for r in found if r[1] == 0])
    least = kth_largest(rows, "key", rows.where(F.col("log_weight") >= cut).count())
    return rows.select("doc_id", "log_weight", (F.col("key") >= least).alias("kept")), model, least


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))[0]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps. They are weighed again, not joined, so that texts aren't shuffled."""
    _, model, least = select(spark, docs, load(spark, sf_dir, "labels"))
    name = unused(docs.columns, WEIGHT)
    return weighed(spark, docs, model, name).where(key(name) >= least).drop(name)
