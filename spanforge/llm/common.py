"""Helpers that the corpus operators share: lower case, folds, samples, removal by key."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.storage import materialize

#: Rows of a table of keys up to which it is broadcast: some tens of bytes each.
BROADCAST_KEYS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Texts in one batch that goes to Python: some are long, and a task holds a batch in several forms.
ROWS_PER_BATCH = 1000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, once its session sends texts to Python in batches of ``ROWS_PER_BATCH`` rows at most."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > ROWS_PER_BATCH or int(conf.get(key)) <= 0:
        conf.set(key, ROWS_PER_BATCH)
    return docs


def without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """``docs`` without the rows that have a match in a written table of keys.

    Up to ``BROADCAST_KEYS`` keys go to the documents; beyond, both are shuffled.
    """
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change É)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def crc_fold(doc_id, k: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % k


#: Labelled rows of each class that a sample has at least, where there are so many.
LEAST_OF_CLASS = 20


def within_budget(found: list[tuple[int, int, int, int]], chars: int) -> set[int]:
    """Which of (hash, id, class, characters) a sample of ``chars`` characters takes: their ids.

    Texts are taken in order of hash, and one that doesn't fit is passed over.
    Before that each class gets its first ``LEAST_OF_CLASS`` that fit its part of
    half of the budget, or else its shortest text, whatever its length.
    """
    taken: set[int] = set()
    left, classes = chars, {y for _, _, y, _ in found}
    for c in sorted(classes):
        own, part, first = sorted(r for r in found if r[2] == c), chars // (2 * len(classes)), 0
        for _, doc_id, _, n in own:
            if n <= part and first < LEAST_OF_CLASS:
                taken.add(doc_id)
                part, left, first = part - n, left - n, first + 1
        if not first:
            _, doc_id, _, n = min(own, key=lambda r: (r[3], r))
            taken.add(doc_id)
            left -= n
    for _, doc_id, _, n in sorted(found):
        if doc_id not in taken and n <= left:
            taken.add(doc_id)
            left -= n
    return taken


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, k: int, held: int, rows: int, chars: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled rows outside the held-out fold.

    The sample is the first ``rows`` labelled ids of ``docs`` by hash whose fold,
    crc32 of the id modulo ``k``, is not ``held``, and the first
    ``LEAST_OF_CLASS`` of each class; of these it has the whole texts that fit
    ``chars`` characters together (``within_budget``). Both bounds are what
    reaches the driver. Null ids and labels are no labels; of rows that share an
    id the least text and the larger label count.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), k) != held))
    ids = ids.select("doc_id", F.col(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    ids = ids.groupBy("h", "doc_id").agg(F.max("y").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi").select("h", "doc_id", "y")
    ids = materialize(ids, "labelled")
    first = [ids.orderBy("h", "doc_id").limit(rows)]
    for r in ids.select("y").distinct().collect():  # a label has few values
        first.append(ids.filter(F.col("y") == r["y"]).orderBy("h", "doc_id").limit(LEAST_OF_CLASS))
    ids = materialize(reduce(DataFrame.unionByName, first).distinct(), "labelled-first")
    # not many more than `rows` narrow rows, so that they can be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = materialize(texts.groupBy("h", "doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "sample")
    found = [tuple(r) for r in texts.select("h", "doc_id", "y", F.length("text").alias("n")).collect()]
    if not found:
        return []
    taken = docs.sparkSession.createDataFrame([(x,) for x in sorted(within_budget(found, chars))], texts.select("doc_id").schema)
    chosen = texts.join(F.broadcast(taken), "doc_id", "left_semi")
    return [(r["text"], r["y"]) for r in chosen.orderBy("h", "doc_id").select("text", "y").collect()]
