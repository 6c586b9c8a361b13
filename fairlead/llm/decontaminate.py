"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification.

Texts and items are read as words: runs of ASCII letters and digits (lower-cased) and non-ASCII characters. An item
of n words leaks into a document if some run of the document's words is within floor(n * (1 - SIMILARITY)) word
edits of it.

Candidates: a CGK random walk reads a word sequence through two coins per step and word (stay or go on), so that
sequences a few edits apart agree in most coordinates of the walk. The walk from every word of a document is
made at once, one vector operation for each step. Each band samples COORDINATES steps of the walk; a document's
window and an item's that agree in all of a band's coordinates are a candidate. Windows are item-sized: as long as
the item's class, the largest power of two of words that it holds. An item is hashed at every eighth of a window that it has
room for (one of over 2 * LARGEST words in windows of LARGEST, as each word of a document walks as far as the longest
window). Walks are repeated until the recall of random edits at the limit, measured on the
items themselves (200 of a large block), reaches RECALL; if MOST_WALKS don't reach it, that is an error. Candidates are then
verified by exact edit distance against the surrounding words (told by 64-bit hashes), so the answer has no false positives.

The items are broadcast in blocks of at most BLOCK items and BLOCK_BYTES of text (or one longer item), one pass over the
documents for each, so the broadcast is bounded whatever the benchmark's size, and documents are never shuffled.

Defined results: null or empty texts are clean; items without words match nothing; an item with a null id is
searched like any other, and a document that holds it isn't clean and has a null, last, among its ids; null doc_ids are
kept as they are; repeated rows and items are treated alike, one row for each document row; an empty documents table gives
no rows, an empty benchmark leaves all clean; very long texts are searched whole; other columns are kept by the stage, whatever
their names, and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import load, ship
from fairlead.llm.words import U, buffers, mix, mix1, pieces, split, unused

SIMILARITY = 0.8
RECALL = 0.95
COORDINATES = 4
BANDS = 8
MOST_WALKS = 24  # bounds the index; a block that needs more is an error
LARGEST = 64
BLOCK = 20_000
BLOCK_BYTES = 4 << 20
FOUND = "fairlead_item_ids"
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word of all texts, and where each text begins (and the end)."""
    data, at = buffers(texts)
    words = split(LOWER[data], at, ~ALNUM)
    return words.hashes() | U(1), words.doc_at  # 0 is padding


def length_class(n: int) -> int:
    return min(LARGEST, 1 << max(0, n.bit_length() - 1))


def steps(size: int) -> int:
    return size + size // 2 + 1


def bands(walk: int, size: int) -> list[list[tuple[int, int]]]:
    """(step, factor) of each sampled coordinate of each band."""
    rng = np.random.default_rng([walk, size])
    n = steps(size)
    return [[(int(j), mix1((walk << 40) + (size << 20) + (b << 10) + k) | 1) for k, j in enumerate(np.sort(rng.choice(n, min(COORDINATES, n), replace=False)))] for b in range(BANDS)]


def walk_keys(padded: np.ndarray, at: np.ndarray, walk: int, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, band, 32-bit key of each start in at): padded has steps(max(sizes)) zeros after each text."""
    seen = (mix(padded ^ U(mix1(walk + 1))) >> U(32)).astype(np.uint32)
    plan = {size: bands(walk, size) for size in sizes}
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    for size, every in plan.items():
        for b, coordinates in enumerate(every):
            for j, factor in coordinates:
                wanted.setdefault(j, []).append((size, b, factor & 0xFFFFFFFF))
    keys = {(size, b): np.full(len(at), mix1(size * 64 + b) & 0xFFFFFFFF, np.uint32) for size in sizes for b in range(BANDS)}
    pos, here, term, bit = at.copy(), np.empty(len(at), np.uint32), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
    for j in range(max(wanted) + 1):
        np.take(seen, pos, out=here, mode="clip")  # in range; clip spares a copy
        for size, b, factor in wanted.get(j, ()):
            np.multiply(here, np.uint32(factor), out=term)
            keys[size, b] += term
        np.right_shift(here, np.uint32(j & 31), out=term)
        np.bitwise_and(term, np.uint32(1), out=term)
        bit[:] = term
        pos += bit
    for (size, b), key in keys.items():
        key *= np.uint32(0x9E3779B1)
        yield size, b, key


def pad(h: np.ndarray, at: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with room zeros after each text, and the place of each word."""
    place = np.arange(len(h)) + np.repeat(np.arange(len(at) - 1), np.diff(at)) * room
    out = np.zeros(len(h) + (len(at) - 1) * room + 1, U)
    out[place] = h
    return out, place


def edits(item: np.ndarray, words: np.ndarray, limit: int) -> int:
    """Least edits that turn the item into some run of words; limit + 1 if there are more. A vector operation for each row of the table."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, x in enumerate(item, 1):
        row[1:] = np.minimum(row[:-1] + (words != x), row[1:] + 1)
        row[0] = i
        row = np.minimum.accumulate(row - at) + at  # words added one after another
        if row.min() > limit:
            return limit + 1
    return int(row.min())


def blocks(rows: Iterator, block: int) -> Iterator[list]:
    """Rows (id, text) in blocks of at most so many, and BLOCK_BYTES of text unless a row has more."""
    held, size = [], 0
    for row in rows:
        n = len((row[1] or "").encode())
        if held and (len(held) == block or size + n > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


class Items:
    """Hash tables of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], recall: float = RECALL):
        h, at = codes(pa.array(texts, pa.large_string()))
        self.ids, self.words = list(range(len(ids))), [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.limit = [int(len(w) * (1 - SIMILARITY) + 1e-9) for w in self.words]
        self.parts = [(i, o, size) for i, w in enumerate(self.words) if len(w) for size in [length_class(len(w))] for o in range(0, len(w) - size + 1, max(1, size // 8))]
        self.part_item, self.part_offset = (np.array([x[k] for x in self.parts], np.int64) for k in (0, 1))
        self.sizes = sorted({size for *_, size in self.parts})
        edited = self._edited(np.random.default_rng(11))
        for walks in range(1, MOST_WALKS + 1):
            self._index(walks)
            found = self.search(np.concatenate([w for _, w in edited]), np.cumsum([0] + [len(w) for _, w in edited])) if edited else {}
            caught = sum(i in found.get(d, ()) for d, (i, _) in enumerate(edited))
            if caught >= recall * len(edited):
                break
        else:
            raise ValueError(f"{MOST_WALKS} walks find {caught} of {len(edited)} edited items; the target is {recall}")
        self.ids = ids  # until here the items' numbers, so that equal ids don't stand for each other

    def _index(self, walks: int) -> None:
        """Sorted keys of all parts and the part of each, and a bitmap of the keys' upper bits."""
        self.walks, found, part = walks, [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if self.parts:
            room = steps(self.sizes[-1])
            padded, _ = pad(np.concatenate(self.words), np.cumsum([0] + [len(w) for w in self.words]), room)
            begin = np.cumsum([0] + [len(w) + room for w in self.words])
        for size in self.sizes:
            own = np.array([k for k, (*_, s) in enumerate(self.parts) if s == size])
            at = np.array([begin[self.parts[k][0]] + self.parts[k][1] for k in own], np.int64)
            for walk in range(walks):
                for _, _, key in walk_keys(padded, at, walk, [size]):
                    found.append(key)
                    part.append(own)
        found, part = np.concatenate(found), np.concatenate(part)
        order = np.argsort(found, kind="stable")
        self.keys, self.part = found[order], part[order]
        self.shift = np.uint32(32 - min(24, max(20, len(found).bit_length() + 4)))
        self.near = np.zeros(1 << 32 - int(self.shift), bool)
        self.near[self.keys >> self.shift] = True

    def _edited(self, rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
        """Items with as many random edits as the limit allows: all of a small benchmark, 200 of a large one."""
        out = []
        for i in rng.permutation(len(self.words))[:200].tolist():
            w = list(self.words[i])
            for _ in range(self.limit[i]):
                at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))  # replaced, added or taken out
                w[at : at + (kind != 1)] = [U(int(rng.integers(1, 1 << 62)))] if kind != 2 else []
            if w:
                out.append((i, np.array(w, U)))
        return out

    def search(self, h: np.ndarray, at: np.ndarray) -> dict[int, set[int]]:
        """Texts (by number) with the items (by id) that leak into them."""
        out: dict[int, set[int]] = {}
        if not len(h) or not self.parts:
            return out
        padded, place = pad(h, at, steps(self.sizes[-1]))
        starts, parts = [], []
        for walk in range(self.walks):
            for _, _, key in walk_keys(padded, place, walk, self.sizes):
                maybe = np.flatnonzero(np.take(self.near, key >> self.shift))
                lo, hi = np.searchsorted(self.keys, key[maybe]), np.searchsorted(self.keys, key[maybe], "right")
                n = hi - lo
                starts.append(np.repeat(maybe, n))
                parts.append(self.part[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        start, part = np.concatenate(starts), np.concatenate(parts)
        item, offset = self.part_item[part], self.part_offset[part]
        pairs = np.unique(np.stack([item, start - offset]), axis=1)  # where the item would begin
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        edge = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1))
        doc_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i, begins = int(pairs[0, lo]), pairs[1, lo:hi]
            words, limit = self.words[i], self.limit[i]
            reach = begins[:, None] + np.arange(-limit, len(words) + limit)
            known = np.sort(words)
            around = h[np.clip(reach, 0, len(h) - 1)]
            common = known[np.minimum(np.searchsorted(known, around), len(known) - 1)] == around
            for begin in begins[common.sum(axis=1) >= len(words) - limit].tolist():  # fewer can't be within the limit
                for d in {int(doc_of[min(max(x, 0), len(h) - 1)]) for x in (begin, begin + len(words) // 2, begin + len(words) - 1)}:
                    if self.ids[i] in out.get(d, ()):
                        continue
                    first, last = max(int(at[d]), begin - limit), min(int(at[d + 1]), begin + len(words) + limit)
                    if last - first < len(words) - limit:
                        continue
                    near = h[first:last]
                    if np.array_equal(h[begin : begin + len(words)], words) and int(at[d]) <= begin and begin + len(words) <= int(at[d + 1]) or edits(words, near, limit) <= limit:
                        out.setdefault(d, set()).add(self.ids[i])
        return out


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, name: str = FOUND) -> DataFrame:
    """docs with a column name of the sorted ids of the items that leak into each."""
    ship(spark)
    out = docs.withColumn(name, F.expr("cast(array() AS array<bigint>)"))
    rows = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    for items in blocks(rows, block):
        held = spark.sparkContext.broadcast(Items([r[0] for r in items], [r[1] for r in items]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", 1 << 20):
                found = held.value.search(*codes(batch["text"]))
                ids = [sorted({*old, *found.get(d, ())}, key=lambda i: (i is None, i or 0)) for d, old in enumerate(batch[name].to_pylist())]
                yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(ids, pa.list_(pa.int64())))

        out = out.mapInArrow(run, out.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark, load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", f"size({FOUND}) = 0 AS kept", f"cast(size({FOUND}) AS bigint) AS n_items", f"{FOUND} AS item_ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item leaks."""
    name = unused(docs.columns, FOUND)
    return leaks(spark, docs, load(spark, sf_dir, "benchmark"), name=name).where(F.size(name) == 0).drop(name)
