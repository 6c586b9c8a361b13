"""Exact deduplication with a partitioned cuckoo-filter index.

Texts are equal when they are the same after every run of `[\\x20\\x09-\\x0D]` becomes one space; null counts
as empty. A text's content address is the SHA-256 of that form, and the index holds addresses, dealt to
partitions by value. Each partition has a cuckoo filter (16-bit fingerprints, two candidate buckets of four
slots); beside every slot lies the full address, so a fingerprint hit is verified against the bucket's content,
entries can be deleted, and an overflow rebuilds a filter of twice the size from the stored addresses.

Equal rows are combined by (address, salt) before they are dealt out, so a group with a third of all rows sends
a few rows; the join that brings the result back to the rows is one that Spark can split by skew.

Defined results: an empty table gives no rows; a null doc_id counts as larger than any other, and if a group has
only such rows its keep_id is null; rows that share both text and doc_id stay or go together; very long texts count by their digest
like any other; other columns are ignored, whatever their names. A partition's index lies in one worker, at about 70 bytes an
address: a partition of the shuffle should hold no more than a few million distinct texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load
from fairlead.llm.words import U, mix

SPACES = r"[\x20\x09-\x0D]+"
SLOTS = 4


class CuckooIndex:
    """A set of 32-byte addresses: insert, find and delete take many at once."""

    def __init__(self, expected: int = 1024, kicks: int = 200, seed: int = 7):
        self.kicks, self.rng = kicks, np.random.default_rng(seed)
        self.content = np.zeros((max(16, expected), 4), U)
        self.live = np.zeros(len(self.content), bool)
        self.used = 0
        self._clear(max(4, int(expected / (SLOTS * 0.85))))

    def _clear(self, buckets: int) -> None:
        self.buckets = 1 << (buckets - 1).bit_length()
        self.prints = np.zeros((self.buckets, SLOTS), np.uint16)
        self.entry = np.full((self.buckets, SLOTS), -1, np.int64)

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket."""
        prints = ((keys[:, 1] >> U(48)) | U(1)).astype(np.uint16)
        return prints, (keys[:, 2] & U(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(U)) & U(self.buckets - 1)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of keys, bucket and slot of every verified hit."""
        prints, one = self._place(keys)
        two = self._other(one, prints)
        found = []
        for bucket, rows in ((one, np.arange(len(keys))), (two, np.flatnonzero(two != one))):
            row, slot = np.nonzero(self.prints[bucket[rows]] == prints[rows, None])
            row = rows[row]
            same = (self.content[self.entry[bucket[row], slot]] == keys[row]).all(axis=1)
            found.append((row[same], bucket[row[same]], slot[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        row, bucket, slot = self._slots(keys)
        out[row] = self.entry[bucket, slot]
        return out

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Removes live keys; True for those that were there."""
        row, bucket, slot = self._slots(keys)
        self.live[self.entry[bucket, slot]] = False
        self.prints[bucket, slot], self.entry[bucket, slot] = 0, -1
        out = np.zeros(len(keys), bool)
        out[row] = True
        return out

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds distinct keys that aren't there yet; their entries."""
        new = np.arange(self.used, self.used + len(keys))
        while len(self.content) < self.used + len(keys):
            self.content = np.concatenate([self.content, np.zeros_like(self.content)])
            self.live = np.concatenate([self.live, np.zeros_like(self.live)])
        self.content[new], self.live[new] = keys, True
        self.used += len(keys)
        size = self.buckets
        while self.live.sum() > 0.9 * size * SLOTS:
            size *= 2
        if size > self.buckets or not self._settle(new):
            self._rebuild(size)
        return new

    def _rebuild(self, size: int) -> None:
        """Resizing: every live address is put into a new filter, larger until all fit."""
        self._clear(size)
        while not self._settle(np.flatnonzero(self.live)):
            self._clear(self.buckets * 2)

    def _settle(self, entries: np.ndarray) -> bool:
        prints, bucket = self._place(self.content[entries])
        for kick in range(self.kicks):
            for _ in range(2):  # either bucket, while it has free slots
                order = np.argsort(bucket, kind="stable")
                entries, prints, bucket = entries[order], prints[order], bucket[order]
                rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
                free = self.prints[bucket] == 0
                fits = rank < free.sum(axis=1)
                slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
                self.prints[bucket[fits], slot], self.entry[bucket[fits], slot] = prints[fits], entries[fits]
                entries, prints, bucket = entries[~fits], prints[~fits], bucket[~fits]
                if not len(entries):
                    return True
                bucket = self._other(bucket, prints)
            first = np.flatnonzero(np.r_[True, np.diff(np.sort(bucket)) > 0])  # one kick for each full bucket
            row = np.argsort(bucket, kind="stable")[first]
            slot = self.rng.integers(0, SLOTS, len(row))
            at = bucket[row]
            out_print, out_entry = self.prints[at, slot].copy(), self.entry[at, slot].copy()
            self.prints[at, slot], self.entry[at, slot] = prints[row], entries[row]
            prints[row], entries[row] = out_print, out_entry
            bucket[row] = self._other(at, out_print)
            gone = out_entry < 0
            entries, prints, bucket = (np.delete(x, row[gone]) for x in (entries, prints, bucket))
            if not len(entries):
                return True
        return False


def addresses(column: pa.Array) -> np.ndarray:
    """32-byte binaries as rows of four 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(U).reshape(-1, 4)


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, keep, size = CuckooIndex(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.iinfo(np.int64).max
    schema = None
    for batch in batches:
        schema = batch.schema
        keys = addresses(batch["address"])
        ids = batch["keep_id"].fill_null(most).to_numpy(zero_copy_only=False)
        sizes = batch["group_size"].to_numpy(zero_copy_only=False)
        distinct, row = np.unique(keys, axis=0, return_inverse=True)
        at = index.find(distinct)
        missing = at < 0
        at[missing] = index.insert(distinct[missing])
        keep = np.concatenate([keep, np.full(index.used - len(keep), most)])
        size = np.concatenate([size, np.zeros(index.used - len(size), np.int64)])
        np.minimum.at(keep, at[row.ravel()], ids)
        np.add.at(size, at[row.ravel()], sizes)
    for lo in range(0, index.used, 1 << 16):
        part = slice(lo, min(index.used, lo + (1 << 16)))
        raw = index.content[part].astype(">u8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(keep[part], mask=keep[part] == most), pa.array(size[part])],
            schema=pa.schema([("address", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())]),
        )


def exact_dedup(spark: SparkSession, docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    form = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(form, 256)).alias("address"))
    rows = Scratch(spark).keep(rows, "addresses")
    combined = rows.groupBy("address", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    dealt = combined.select("address", "keep_id", "group_size").repartition("address")
    groups = dealt.mapInArrow(_index_partition, "address binary, keep_id long, group_size long")
    return rows.join(groups, "address").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("address")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
