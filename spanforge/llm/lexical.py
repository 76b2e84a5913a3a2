"""Operator 13: ranked lexical search with MaxScore bounds of term pairs.

1. Documents are read once into rows of (numbers of the terms that items use,
   their occurrences), and statistics are summed over all of them.
2. The index is cut into shards of documents. In a shard, documents stand by
   length in blocks of ``BLOCK``. A term has its postings with their impacts. A
   pair of terms has its intersection list: the blocks in which documents hold
   both, each with the highest joint impact.
3. An item's terms are paired, neighbours by weight. The most that a pair adds to
   a document of a block is its joint maximum there, or the larger of the two
   terms' own where that is more or no document holds both: never more than the
   two maxima together, which is what MaxScore over single terms would assume.
   Blocks are opened from the highest bound downwards, and once the ``k``-th
   score exceeds what is left, the rest is skipped.
4. A few shards are searched first. Their ``k``-th scores bound each item's result
   from below, so that the others return only what can be in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanforge.llm.common import in_small_batches
from spanforge.llm.decontaminate import words
from spanforge.storage import materialize

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Terms of all items up to which every task gets them; beyond, terms are joined by a shuffle.
VOCABULARY = 1_000_000
#: Documents and postings of a shard, about; documents of a block; items searched together.
DOCS, POSTINGS, BLOCK, ITEMS = 16_384, 3_000_000, 128, 2000


def terms_of(items: DataFrame) -> DataFrame:
    """(item, item_id, w): the different terms of each different item, numbered."""
    rows = items.select("item_id", F.array_distinct(words(F.col("text"))).alias("w")).distinct()
    return materialize(rows.withColumn("item", F.monotonically_increasing_id()), "lexical-items")


def counted(docs: DataFrame, vocabulary: DataFrame, few: bool) -> DataFrame:
    """(row, doc_id, n, terms, tf) of each document: its terms, and the occurrences of those in (t, term)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if few:
        number = {r["term"].encode(): r["t"] for r in vocabulary.collect()}

        @F.pandas_udf("struct<n:long,terms:array<long>,tf:array<int>>")
        def count(text: pd.Series) -> pd.DataFrame:
            out = []
            for t in text:
                found = TERM.findall((t or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z only
                tf = {number[w]: c for w, c in Counter(found).items() if w in number}
                out.append((len(found), list(tf), list(tf.values())))
            return pd.DataFrame(out, columns=["n", "terms", "tf"])

        return in_small_batches(rows).withColumn("c", count("text")).select("row", "doc_id", "c.n", "c.terms", "c.tf")
    # one flow, so that every row is numbered once; a document without terms keeps a row
    met = rows.select("row", "doc_id", words(F.col("text")).alias("w")).select("row", "doc_id", F.size("w").cast("long").alias("n"), F.explode_outer("w").alias("term"))
    met = met.groupBy("row", "doc_id", "n", "term").agg(F.count("*").cast("int").alias("tf")).join(vocabulary, "term", "left")
    found = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "tf"))))
    met = met.groupBy("row", "doc_id", "n").agg(found.alias("f"))
    return met.select("row", "doc_id", "n", F.col("f.t").alias("terms"), F.col("f.tf").alias("tf"))


def weight(n: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def paired(terms: DataFrame) -> DataFrame:
    """(item, a, b, wa, wb) for neighbours by weight of each item, a < b, or b is -1 for one that is left over; from (item, t, w)."""
    order = F.array_sort(F.collect_list(F.struct("w", "t")))
    pairs = terms.groupBy("item").agg(order.alias("o")).select("item", F.explode(F.sequence(F.lit(0), F.size("o") - 1, F.lit(2))).alias("i"), "o")
    x, y = F.get("o", F.col("i")), F.get("o", F.col("i") + 1)
    pairs = pairs.select("item", x.alias("x"), F.coalesce(y, F.struct(x["w"].alias("w"), F.lit(-1).cast("long").alias("t"))).alias("y"))
    swap = F.col("y.t").between(0, F.col("x.t"))
    a, b = (F.when(swap, F.col(p)).otherwise(F.col(q)) for p, q in (("y", "x"), ("x", "y")))
    return pairs.select("item", a["t"].alias("a"), b["t"].alias("b"), a["w"].alias("wa"), b["w"].alias("wb"))


def _index(counts: DataFrame, pairs: DataFrame, n: int, total: int, docs: int, postings: int) -> tuple[DataFrame, int]:
    """(shard, a, b, at, impact, ids, orders) and the number of shards: of each its documents (a is -1), the postings (b is -1), and the pairs' lists."""
    held = counts.agg(F.count("*"), F.sum(F.size("terms"))).first()
    shards = max(1, math.ceil(held[0] / docs), math.ceil((held[1] or 0) / postings))
    kind = counts.schema["doc_id"].dataType

    def build(group: pa.Table, used: pa.Table) -> pa.Table:
        if not group.num_rows:
            return empty
        group = group.combine_chunks()
        a, b, wa, wb = (np.asarray(used[c], np.int64) for c in ("a", "b", "wa", "wb"))
        known, first = np.unique(np.append(a, b), return_index=True)  # -1, if there, matches no posting
        weights = np.append(wa, wb)[first]
        lengths, ids = np.asarray(group["n"], np.int64), group["doc_id"]
        order = np.lexsort((np.asarray(group["row"], np.int64), lengths))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = 50 + (50 * lengths * n) // total
        lists = group["terms"].combine_chunks()
        per = np.asarray(lists.value_lengths(), np.int64)
        t, tf = (np.asarray(group[c].combine_chunks().flatten(), np.int64) for c in ("terms", "tf"))
        at, m = np.repeat(place, per), np.repeat(m, per)
        i = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
        t, tf, at, m, i = (x[known[i] == t] for x in (t, tf, at, m, i)) if len(known) else (x[:0] for x in (t, tf, at, m, i))
        impact = weights[i] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        keep = impact > 0
        t, at, impact = t[keep], at[keep], impact[keep]
        s = np.lexsort((at, t))
        t, at, impact = t[s], at[s], impact[s]
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(t))
        where = {int(t[i]): (at[i:j], impact[i:j]) for i, j in zip(starts, ends, strict=True)}
        out = [(x, -1, p, q) for x, (p, q) in where.items()]
        scratch = np.zeros(len(order), np.int64)
        for a, b in zip(a.tolist(), b.tolist(), strict=True):
            if a in where and b in where:
                (pa_, qa), (pb, qb) = where[a], where[b]
                scratch[pa_] = qa
                there = scratch[pb]
                scratch[pa_] = 0
                met = there > 0
                if met.any():
                    block = pb[met] // BLOCK
                    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                    out.append((a, b, block[first], np.maximum.reduceat((there + qb)[met], first)))
        listed = ids.to_pylist()
        ranked = sorted(range(len(listed)), key=lambda i: (listed[i] is None, listed[i] if listed[i] is not None else 0))
        rank = np.empty(len(listed), np.int64)
        rank[ranked] = np.arange(len(ranked))
        k = len(out)
        flat = lambda i: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r[i]) for r in out] + [0])].astype(np.int32)), pa.array(np.concatenate([r[i] for r in out] or [np.zeros(0)]).astype(np.int64)))
        shard = group["shard"][0].as_py()
        id_type = group.schema.field("doc_id").type
        return pa.table({
            "shard": pa.array([shard] * (k + 1), pa.int32()),
            "a": pa.array([r[0] for r in out] + [-1], pa.int64()),
            "b": pa.array([r[1] for r in out] + [-1], pa.int64()),
            "at": flat(2),
            "impact": flat(3),
            "ids": pa.array([None] * k + [[listed[i] for i in order]], pa.list_(id_type)),
            "orders": pa.array([None] * k + [rank[order].tolist()], pa.list_(pa.int64())),
        })

    dealt = counts.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(shards)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    used = pairs.select("a", "b", "wa", "wb").distinct().select(every, "*")
    schema = f"shard int, a long, b long, at array<long>, impact array<long>, ids array<{kind.simpleString()}>, orders array<long>"
    empty = to_arrow_schema(counts.sparkSession.createDataFrame([], schema).schema).empty_table()
    built = dealt.groupBy("shard").cogroup(used.groupBy("shard")).applyInArrow(build, schema)
    return materialize(built, "lexical-index"), shards


class Shard:
    """One shard's postings by block, and the bounds of its pairs."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        a, b = np.asarray(rows["a"], np.int64), np.asarray(rows["b"], np.int64)
        head = int(np.flatnonzero(a < 0)[0])
        self.ids = rows["ids"][head].as_py()
        self.orders = np.asarray(rows["orders"][head].values, np.int64)
        self.blocks = -(-len(self.ids) // BLOCK)
        at, impact = rows["at"].combine_chunks(), rows["impact"].combine_chunks()
        offsets = np.asarray(at.offsets, np.int64)
        at, impact = np.asarray(at.values, np.int64), np.asarray(impact.values, np.int64)
        self.lists = {(int(x), int(y)): (at[i:j], impact[i:j]) for x, y, i, j in zip(a, b, offsets[:-1], offsets[1:], strict=True) if x >= 0}
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each block's postings begin, the highest impact of each block)."""
        if t not in self.opened:
            at, impact = self.lists[t, -1]
            pointers, most = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK), np.zeros(self.blocks, np.int64)
            full = np.flatnonzero(pointers[1:] > pointers[:-1])
            most[full] = np.maximum.reduceat(impact, pointers[full])
            self.opened[t] = pointers, most
        return self.opened[t]

    def bound(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """The most that any document of each block can score."""
        out = np.zeros(self.blocks, np.int64)
        for a, b in pairs:
            most = np.zeros(self.blocks, np.int64)
            for t in (a, b):
                if (t, -1) in self.lists:
                    np.maximum(most, self.term(t)[1], out=most)
            if (a, b) in self.lists and b >= 0:
                block, joint = self.lists[a, b]
                most[block] = np.maximum(most[block], joint)
            out += most
        return out

    def scores(self, terms: list[int], blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those of the blocks that hold any of the terms."""
        acc = np.zeros(len(blocks) * BLOCK, np.int64)
        for t in terms:
            pointers, _ = self.term(t)
            at, impact = self.lists[t, -1]
            per = pointers[blocks + 1] - pointers[blocks]
            total = int(per.sum())
            if total:
                i = np.arange(total) + np.repeat(pointers[blocks] - (np.cumsum(per) - per), per)
                acc[np.repeat(np.arange(len(blocks)) * BLOCK, per) + at[i] % BLOCK] += impact[i]
        found = np.flatnonzero(acc)
        return blocks[found // BLOCK] * BLOCK + found % BLOCK, acc[found]

    def search(self, pairs: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, blocks opened): the ``k`` highest scores that are not below ``least``."""
        terms = [t for p in pairs for t in p if (t, -1) in self.lists]
        bound = self.bound(pairs)
        order = np.argsort(-bound, kind="stable")
        docs, scores, opened, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(1, -(-2 * k // BLOCK))
        least = max(least, 1)
        while opened < len(order) and bound[order[opened]] >= least:
            now = order[opened : opened + size]
            now = np.sort(now[bound[now] >= least])
            more, their = self.scores(terms, now)
            docs, scores = np.append(docs, more[their >= least]), np.append(scores, their[their >= least])
            if len(docs) > k:
                s = np.lexsort((self.orders[docs], -scores))[:k]
                docs, scores = docs[s], scores[s]
            if len(docs) == k:
                least = max(least, int(scores.min()))
            opened += len(now)
            size *= 2
        return docs, scores, opened


def _search(index: DataFrame, shards: range, items: DataFrame, chunks: int, k: int, kind: str) -> DataFrame:
    """(item, doc_id, score, opened, blocks) of those shards, for (chunk, item, pairs, least)."""

    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": [], "opened": [], "blocks": []}
        if group.num_rows and asked.num_rows:
            shard = Shard(group)
            for item, pairs, least in zip(asked["item"].to_pylist(), asked["pairs"].to_pylist(), asked["least"].to_pylist(), strict=True):
                docs, scores, opened = shard.search([(p["a"], p["b"]) for p in pairs], k, least)
                out["item"] += [item] * len(docs)
                out["doc_id"] += [shard.ids[d] for d in docs]
                out["score"] += scores.tolist()
                out["opened"] += [opened] * len(docs)
                out["blocks"] += [shard.blocks] * len(docs)
        types = (pa.int64(), group.schema.field("ids").type.value_type, pa.int64(), pa.int32(), pa.int32())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    # the stated items, in chunks, against every shard
    asked = items.withColumn("shard", F.explode(F.sequence(F.lit(shards.start), F.lit(shards.stop - 1))))
    given = index.filter(F.col("shard").between(shards.start, shards.stop - 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    by = ("shard", "chunk")
    return given.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, f"item long, doc_id {kind}, score long, opened int, blocks int")


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_docs: int = DOCS, shard_postings: int = POSTINGS, chunk: int = ITEMS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of highest score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, of which only
    A-Z are lower-cased. Scores are whole numbers, and the result is exact:
    bounds only tell which blocks of documents need no look. Ties go to the
    smaller doc_id, a null one last.

    Defined cases: a null or empty text has no terms, is in no result and isn't
    counted. Each row is a document of its own, so repeated rows are found and
    counted each. Items that repeat an id and a text count once; items that share
    an id but not a text are ranked apart, under the one id. A term that nearly
    all documents hold weighs 0 and finds nothing. An item without terms, and an
    empty table on either side, gives no rows. Other columns aren't read.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    asked = terms_of(items)
    terms = asked.select(F.explode("w").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
    terms = materialize(terms, "lexical-terms")
    counts = materialize(counted(docs, terms, terms.count() <= vocabulary), "lexical-counts")
    of_all = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.sum("n").alias("L")).first()
    n, total = of_all["N"], of_all["L"] or 0
    df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weights = materialize(df.select("t", weight(F.lit(n), F.col("df")).alias("w")).filter("w > 0"), "lexical-weights")
    of_item = asked.select("item", F.explode("w").alias("term")).join(terms, "term").join(weights, "t")
    pairs = materialize(paired(of_item.select("item", "t", "w")), "lexical-pairs")
    schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {kind}, score long"
    if pairs.isEmpty():
        return spark.createDataFrame([], schema)
    index, shards = _index(counts, pairs, n, total, shard_docs, shard_postings)
    chunks = max(1, math.ceil(asked.count() / chunk))
    asking = pairs.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    asking = materialize(asking.withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int")).withColumn("least", F.lit(0).cast("long")), "lexical-asking")
    first = math.isqrt(shards)
    best = lambda t: t.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
    early = materialize(best(_search(index, range(first), asking, chunks, k, kind)), "lexical-early")
    if first < shards:
        least = early.filter(F.col("rank") == k).select("item", F.col("score").alias("known"))
        rest = asking.join(least, "item", "left").withColumn("least", F.coalesce("known", "least")).drop("known")
        early = early.unionByName(_search(index, range(first, shards), rest, chunks, k, kind), allowMissingColumns=True)
    found = best(early.drop("rank"))
    return found.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
