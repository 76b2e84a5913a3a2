"""Operator 5: mixing sources to target weights.

One aggregation gives the words of each source. Targets follow by water filling
in closed form, and each document is emitted floor(rate) times plus one copy
drawn with probability equal to the fraction. The draw is a hash of the document
and a seed; each source takes, of ``SEEDS`` seeds, the one whose total comes
nearest to its target, which a second aggregation over ids and sizes finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import fresh
from spanforge.storage import materialize

WEIGHTS = (5, 2, 1)
SEEDS = 16
#: Sources up to which the table of sources is broadcast.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of words between white space; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).cast("long")


def _name(docs: DataFrame) -> Column:
    """What a document is drawn by: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))


def _draw(name: Column, seed: Column) -> Column:
    """A number in [0, 1) from the document and the seed alone: reruns agree."""
    digest = F.md5(F.concat_ws(":", seed.cast("string"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _total(rate: Column, size: Column, u: Column) -> Column:
    return size * (F.floor(rate) + (u < rate - F.floor(rate)).cast("long"))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The sources in code-point order, null last, weigh ``weights`` in turn and
    share ``share`` times all words. No target exceeds ``most`` times its
    source's words; what is above is shared anew by weight, so that in the end
    each target is min(most * size, level * weight) for one common level. The
    sources are few: their table alone, never the documents, is ordered in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    s = by_source.select("source", "source_size", w.alias("w"))
    s = s.withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = F.coalesce(F.sum("cap").over(upto), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - below) / weight
    # the level rises while sources are full and falls after the first that isn't
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    return s.select("source", F.col("source_size").cast("long"), target.alias("target"))


def _planned(docs: DataFrame, name: str, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """``docs`` with a column of that name: struct(size, source_size, target, copies, taken)."""
    narrow = docs.select(_name(docs).alias("name"), "source", size_of(F.col("text")).alias("size"))
    goal = targets(narrow, share, most, weights)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = materialize(goal, "mixing-targets")
    few = goal.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)
    goal = goal.select(F.col("source").alias("of"), "target", "rate", "source_size")
    tried = narrow.join(hint(goal), F.col("source").eqNullSafe(F.col("of")))
    tried = tried.groupBy("source").agg(
        F.first("target").alias("aim"), *[F.sum(_total(F.col("rate"), F.col("size"), _draw(F.col("name"), F.lit(k)))).alias(f"t{k}") for k in range(SEEDS)]
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("aim")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    seeds = materialize(tried.select("source", best.alias("seed")), "mixing-seeds")
    goal = goal.join(seeds, F.col("source").eqNullSafe(F.col("of")))
    goal = goal.select(F.struct("of", "target", "rate", "source_size", "seed").alias(name))
    g = F.col(name)
    out = docs.join(hint(goal), docs["source"].eqNullSafe(g["of"]))
    size = size_of(F.col("text"))
    copies = F.floor(g["rate"]) + (_draw(_name(docs), g["seed"]) < g["rate"] - F.floor(g["rate"])).cast("long")
    out = out.withColumn(name, F.struct(size.alias("size"), g["source_size"].alias("source_size"), g["target"].alias("target"), copies.alias("copies")))
    copies = F.when(g["size"] > 0, g["copies"]).otherwise(F.lit(0)).cast("long")
    return out.withColumn(name, F.struct(g["size"].alias("size"), g["source_size"].alias("source_size"), g["target"].alias("target"), copies.alias("copies"), (g["size"] * copies).alias("taken")))


def plan_mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document; with ``carry`` all its columns first.

    Defined cases: a null or empty text has size 0 and is never taken; a null
    source is a source of its own; rows that repeat, or share an id, are drawn
    alike, and rows without an id by their texts. A source without words has
    target 0. With ``carry`` columns named like a result are replaced by it. An
    empty table gives no rows.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*own) if carry else docs.select("doc_id", "source", "text")
    (name,) = fresh(docs, "plan")
    out = _planned(docs, name, share, most, weights)
    return out.select(*(docs.columns if carry else ["doc_id"]), *[F.col(name)[c].alias(c) for c in own])


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixture itself: each document as often as ``plan_mix`` takes it, with its own columns.

    Defined cases are those of ``plan_mix``. All columns keep their values,
    whatever their names. An empty table gives no rows.
    """
    name, copy = fresh(docs, "plan", "copy")
    planned = _planned(docs, name, share, most, weights).filter(F.col(name)["copies"] > 0)
    return planned.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))).select(*docs.columns)
