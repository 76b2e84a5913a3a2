"""Operator 11: a Merkle manifest of a dataset, by slot pivots.

Every row is a leaf. The leaves of a group stand in order, and every ``FANOUT``
consecutive nodes have one parent. A level is made by conditional aggregates
that spread the children of each parent over one column for each slot: all
columns concatenated hash to the parent, all but a child's own are its siblings.

1. Places: rows are dealt by ranges of (group, order), sorted within each range
   and numbered; the rows of a group in earlier ranges are added from a table of
   runs. A group with a third of all rows is spread like any other.
2. Rise: one aggregation for each level, whose rows are at most ``FANOUT`` times
   fewer. The roots of the groups are the leaves of one more tree, up to the root.
3. Descend: siblings travel down from the root, joined to parents only. The
   leaves' own level is opened last, so that no proof of a leaf is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import ascii_lower, fold
from spanforge.storage import broadcast_small, materialize

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows have a partition number above these bits of ``monotonically_increasing_id``.
PART_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos and n: the place (from 0) in the rows of their ``g`` by ``order``, and how many these are.

    Rows equal in everything are dealt by a seeded number, so that they don't
    meet in one range. What is broadcast has a row for each range and each
    group, behind a check of its size.
    """
    dealt = rows.withColumn("tie", F.rand(11)).repartitionByRange("g", *order, "tie").sortWithinPartitions("g", *order, "tie").drop("tie")
    dealt = materialize(dealt.withColumn("mid", F.monotonically_increasing_id()), f"manifest-{name}")
    dealt = dealt.withColumn("part", F.shiftright("mid", PART_BITS))
    runs = dealt.groupBy("g", "part").agg(F.min("mid").alias("first"), F.count("*").alias("m"))
    own = Window.partitionBy("g")  # a row for each range that has some of the group
    runs = runs.select("g", "part", "first", (F.sum("m").over(own.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(own).alias("n"))
    runs = materialize(runs, f"manifest-{name}-runs")
    out = dealt.join(broadcast_small(runs), ["g", "part"])
    return out.withColumn("pos", F.col("mid") - F.col("first") + F.col("before")).drop("mid", "part", "first", "before")


def rise(nodes: DataFrame, name: str, fanout: int = FANOUT) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (g, pos, n, cell) to (levels, done), where cell is a struct that has a ``digest``.

    levels: for each level the table of its parents, (g, n, up, digest, c0, c1,
    ...): place, digest and children. done: for each level the nodes that are
    alone in their group, (g, cell), which are the groups' roots; at the last
    level all are.
    """
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    levels, done = [], [nodes.filter("n = 1").select("g", "cell")]
    while most > 1:
        spread = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == k, F.col("cell"))).alias(f"c{k}") for k in range(fanout)]
        parents = nodes.filter("n > 1").groupBy("g", "n", F.expr(f"pos div {fanout}").alias("up")).agg(*spread)
        parents = materialize(parents.withColumn("digest", digest(*[F.col(f"c{k}.digest") for k in range(fanout)])), f"manifest-{name}")
        levels.append(parents)
        nodes = parents.select("g", F.col("up").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.struct("digest").alias("cell"))
        most = -(-most // fanout)
        done.append(nodes.filter("n = 1").select("g", "cell"))
    return levels, done


def descend(levels: list[DataFrame], done: list[DataFrame], tops: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """(cell, steps, and the other columns of ``tops``) of every leaf, from (g, steps, ...) of every group's root.

    A step is (before, after): the digests of the other children of a parent,
    to the left and to the right; steps go from the leaf upwards.
    """
    held = [c for c in tops.columns if c not in ("g", "steps")]
    paths = None
    for at in range(len(levels), -1, -1):
        # groups that end at this level: one row each
        here = done[at].join(tops, "g").select("g", F.lit(0).cast("long").alias("pos"), "cell", "steps", *held)
        if paths is not None:
            columns = [F.col(f"c{k}.digest") for k in range(fanout)]
            slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("cell"), F.concat_ws("", F.lit(""), *columns[:k]).alias("before"), F.concat_ws("", F.lit(""), *columns[k + 1 :]).alias("after")) for k in range(fanout)])
            below = levels[at].join(paths.withColumnRenamed("pos", "up"), ["g", "up"])
            below = below.select("g", "up", "steps", *held, F.explode(slots).alias("s")).filter("s.cell is not null")
            steps = F.concat(F.array(F.struct("s.before", "s.after")), F.col("steps"))
            here = here.unionByName(below.select("g", (F.col("up") * fanout + F.col("s.slot")).alias("pos"), "s.cell", steps.alias("steps"), *held))
        if at:
            paths = materialize(here.drop("cell"), f"manifest-{name}-paths")
        else:
            paths = here
    return paths.drop("g", "pos")


def fold_up(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda now, s: digest(s["before"], now, s["after"]))


def manifest(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, proof_sha256, folded_root, verified): one row for each row of ``docs``.

    leaf is the digest of ``fields``; of the rows of each source, in the order
    of doc_id, subroot is the tree's root, and of the subroots in the order of
    the sources root is. steps prove the leaf: ``fold_up(leaf, steps)`` is the
    root, and proof_sha256 the digest of what they hold. folded_root is what
    they give for the leaf of the row with ``altered`` as its text, and verified
    tells whether that is the root.

    Defined cases: a null field is ``-``, so that null and empty texts differ.
    Null ids come first in their source, rows that share an id follow each other
    by leaf, and repeated rows are leaves each; the null source is a source of
    its own and the first. A lone leaf is its source's subroot, a lone subroot
    the root. A null in ``altered`` is a null text. Other columns aren't read.
    An empty table gives no rows.
    """
    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))  # keeps null first
    of = {c: field(F.col(c)) for c in fields}
    leaf = digest(*of.values())
    changed = leaf if altered is None else digest(*(of | {"text": field(altered)}).values())
    rows = docs.select(source.alias("g"), "doc_id", leaf.alias("digest"), changed.alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
    leaves = ranked(rows, ["doc_id", "digest"], "leaves")
    leaves = leaves.select("g", "pos", "n", F.struct("digest", "doc_id", "changed").alias("cell"))
    levels, done = rise(leaves, "levels", fanout)
    subroots = done[0].select("g", F.col("cell.digest").alias("digest"))
    for d in done[1:]:
        subroots = subroots.unionByName(d.select("g", F.col("cell.digest").alias("digest")))
    tops = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest"), ["source"], "subroots")
    top_levels, top_done = rise(tops.select("g", "pos", "n", F.struct("digest", "source").alias("cell")), "top", fanout)
    root = top_done[-1].select("g", F.col("cell.digest").alias("root"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    tops = descend(top_levels, top_done, root.select("g", none.alias("steps"), "root"), "top", fanout)
    tops = materialize(tops.select(F.col("cell.source").alias("g"), F.col("cell.digest").alias("subroot"), "root", "steps"), "manifest-tops")
    out = descend(levels, done, tops, "leaves", fanout)
    leaf, now = F.col("cell.digest"), F.coalesce("cell.changed", "cell.digest")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = out.select("cell.doc_id", leaf.alias("leaf"), "subroot", "root", "steps", proof.alias("proof_sha256"), fold_up(now, F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column, text: Column, every: int = 5) -> Column:
    """The text with A-Z lower-cased where the crc32 of the id as text is divisible by ``every``."""
    return F.when(fold(doc_id, every) == 0, ascii_lower(text)).otherwise(text)
