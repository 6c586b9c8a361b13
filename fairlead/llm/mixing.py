"""Mixing sources to target weights by budget fitting on counts of exact lengths.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+` (null: 0). Sources in order of code point, null
last, weigh 5, 2, 1, repeating. They share SHARE times all sizes by weight; no target exceeds twice the source's
size, and what is cut off is shared again by weight until none is above.

A source's target is met by whole copies of it, as often as they fit, and a remaining budget. The remaining
budget is fitted on the source's counts of documents by size: first the same part of every count, then single
sizes in seeded order until DP_WORDS or fewer are left, and then a bounded-knapsack dynamic programme over bitsets comes as
near to the rest as the documents left can (DP_WORDS bounds its memory, not the rest's share: as long as documents of up to
the rest's size are left, the error is under the least of them). Of each size's documents, those with the least seeded
hashes are taken. They are counted in 4,096 ranges of the hash; only the documents of the one range in which a
size's number runs out are ranked, so no task ranks a hot group.

The driver sees one row per source and broadcasts them as the recipe: at most MOST_SOURCES, more are an error (weights go by the
sources' order, so hosts or users make no sense as sources). A source's counts, one row per size, are fitted by one task.

Defined results: documents without words have size 0 and take 0 (as a pipeline stage they stay once); a null
source is a source; rows with equal doc_id, source and size are interchangeable in the query, and told apart by their text in
the stage, which takes exactly as many rows as the fit says; null doc_ids are hashed like a value of their own; very long
texts are sizes like any other; an empty table gives no rows; reruns agree, as choices depend on values alone. Other columns,
whatever their names, are kept by the stage and ignored otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load
from fairlead.llm.words import mix1

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
DP_WORDS = 1 << 15
RANGES = 4096
MOST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Each source's target."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    left, unmet, out = share * sum(sizes.values()), set(names), {}
    while unmet:
        unit = left / sum(weight[x] for x in unmet)
        over = {x for x in unmet if unit * weight[x] > most * sizes[x]}
        if not over:
            return out | {x: unit * weight[x] for x in unmet}
        out |= {x: float(most * sizes[x]) for x in over}
        left -= sum(most * sizes[x] for x in over)
        unmet -= over
    return out


def fit(counts: dict[int, int], budget: int, seed: int, dp_words: int = DP_WORDS) -> dict[int, int]:
    """How many documents of each size to take, so that their sizes sum to the budget or as near as can be found."""
    total = sum(n * c for n, c in counts.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    take = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in take.items())
    order = sorted(counts, key=lambda n: mix1(n ^ seed))
    for n in order:
        if left <= dp_words:
            break
        more = min(counts[n] - take[n], (left - dp_words) // n + 1, left // n)
        take[n] += more
        left -= n * more
    limit = 2 * left  # what overshoots by more is worse than nothing
    reach, steps, mask = 1, [], (1 << limit + 1) - 1
    for n in order:
        spare, k = min(counts[n] - take[n], limit // n), 1
        while spare > 0 and not reach >> left & 1:
            k = min(k, spare)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            spare, k = spare - k, k * 2
    below = (reach & (1 << left + 1) - 1).bit_length() - 1
    above = reach >> left
    above = left + (above & -above).bit_length() - 1 if above else limit + 1
    at = below if left - below <= above - left else above
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return take


def _keys(seed: int) -> list[Column]:
    """A row's source, size, hash and range of the hash."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return [src.alias("src"), size.alias("size"), h.alias("h"), F.pmod(h, F.lit(RANGES)).alias("range")]


def fitted(spark: SparkSession, rows: DataFrame, scratch: Scratch, seed: int, weights: tuple[float, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """For rows(src, size, range): the recipe (src, source_size, target, full copies), and of each size taken the range in which
    the number runs out and how many of it are taken."""
    sizes = {r.src: r.n for r in rows.groupBy("src").agg(F.sum("size").alias("n")).collect()}
    goal = {("null" if k is None else f"={k}"): v for k, v in targets({None if k == "null" else k[1:]: v for k, v in sizes.items()}, weights, share).items()}
    recipe = [(k, n, goal[k], min(int(goal[k] // n), MOST) if n else 0) for k, n in sizes.items()]
    if len(recipe) > MOST_SOURCES:
        raise ValueError(f"{len(recipe)} sources; a recipe has at most {MOST_SOURCES}")
    recipe = F.broadcast(spark.createDataFrame(recipe, "src string, source_size long, target double, full long"))
    budgets = recipe.selectExpr("src", "cast(round(target - full * source_size) AS long) AS budget")

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(part["size"].tolist(), part["n"].tolist(), strict=True))
        take = fit(counts, int(part["budget"].iloc[0]), seed)
        return pd.DataFrame({"src": part["src"].iloc[0], "size": list(take), "take": list(take.values())})

    ranges = scratch.keep(rows.where("size > 0").groupBy("src", "size", "range").agg(F.count("*").alias("n")), "ranges")
    counts = ranges.groupBy("src", "size").agg(F.sum("n").alias("n"))
    take = counts.join(budgets, "src").groupBy("src").applyInPandas(chosen, "src string, size long, take long").where("take > 0")
    before = F.sum("n").over(Window.partitionBy("src", "size").orderBy("range")) - F.col("n")
    cut = ranges.withColumn("before", before).join(take, ["src", "size"]).where("before < take AND before + n >= take")
    return recipe, scratch.keep(cut.select("src", "size", F.col("range").alias("last"), (F.col("take") - F.col("before")).alias("most")), "cut")


def taken(rows: DataFrame, recipe: DataFrame, cut: DataFrame, order: list[Column]) -> DataFrame:
    """rows(src, size, range, ...) with source_size, target and copies."""
    both = rows.join(cut, ["src", "size"], "left").join(recipe, "src")  # the recipe is broadcast, so no source's rows meet in one task
    clear = both.where("last IS NULL OR range <> last").withColumn("copies", F.expr("full + IF(range < last, 1, 0)"))
    rank = F.row_number().over(Window.partitionBy("src", "size").orderBy(*order))
    ranked = both.where("range = last").withColumn("rank", rank).withColumn("copies", F.expr("full + IF(rank <= most, 1, 0)")).drop("rank")
    return clear.unionByName(ranked)


def mix_sources(spark: SparkSession, docs: DataFrame, seed: int = 2024, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    scratch = Scratch(spark)
    rows = scratch.keep(docs.select("doc_id", *_keys(seed)), "sizes")
    recipe, cut = fitted(spark, rows, scratch, seed, weights, share)
    return taken(rows, recipe, cut, ["h", "doc_id"]).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = 2024) -> DataFrame:
    """docs as often as the mix takes them; documents without words once."""
    scratch = Scratch(spark)
    recipe, cut = fitted(spark, docs.select(*_keys(seed)).drop("h"), scratch, seed, WEIGHTS, SHARE)
    rows = docs.select(F.struct("*").alias("row"), *_keys(seed))
    mixed = taken(rows, recipe, cut, [F.col("h"), F.col("row.doc_id"), F.xxhash64("row.text")]).withColumn("copies", F.expr("IF(size = 0, 1L, copies)"))
    return mixed.select("row", F.expr("explode(IF(copies > 0, sequence(1L, copies), array()))")).select("row.*")
