"""Operator 12: exact search for the highest inner products, as a Voronoi kNN join.

1. Of equal vectors only the ``k + 1`` smallest ids can be in a result, and equal
   queries are solved once. Both are told before anything is compared.
2. About the square root of their number, by hash, are pivots; each vector
   belongs to the cell of the nearest one.
3. Bounds: a query meets its pivots and one block of its own cell, whose scores
   bound its result from below. A cell's summary is the least such bound of its
   queries and their largest distance from the pivot. As
   ``q . x <= p . x + |q - p| |x|``, it tells of each vector whether any query of
   the cell can need it.
4. Cells of queries are joined into groups, and a vector is sent to those groups
   alone of which a cell needs it. Groups are cut into blocks of bounded size,
   solved as products of matrices; each block returns ``k + 1`` rows of a query
   at most, and none below its bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.storage import materialize

#: Pivots at most: what the driver holds and every task gets.
MAX_PIVOTS = 16_384
#: Queries of a group and vectors of a block, about.
QUERIES, ROWS = 4096, 16_384
#: Numbers of a matrix of products that a task holds at once, about.
TABLE = 1 << 21
#: Stands for a null id, which comes after all others.
NO_ID = 2**63 - 1


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, v): the floor of ``scale`` times each component, of the vectors without null, NaN or infinite ones."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return embeddings.filter(x.isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as whole numbers; what is missing up to ``width`` is 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    values = np.asarray(lists.flatten(), np.int64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact; one that does not fit 64 bits is an error."""
    largest = [max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) for x in (a, b)]
    most = a.shape[1] * largest[0] * largest[1]
    if most < 2**53:  # whole numbers of so many bits are exact as doubles, in any order of summing
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2**63 else (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row that are not below its ``least``; ties go to lower columns."""
    n = scores.shape[1]
    floor = least if n <= k else np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
    rows, columns = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(len(scores)))
    first = np.arange(len(rows)) - starts[rows] < k
    return rows[first], columns[first]


def _solve(queries: DataFrame, data: DataFrame, keys: list[str], width: int, k: int) -> DataFrame:
    """(q, score, id): of each block of (keys, q, v, least) and (keys, id, v), the ``k`` best of each query."""

    def block(asked: pa.Table, given: pa.Table) -> pa.Table:
        a, x, ids = matrix(asked["v"], width), matrix(given["v"], width), np.asarray(given["id"], np.int64)
        least, names = np.asarray(asked["least"], np.int64), np.asarray(asked["q"], np.int64)
        order = np.argsort(ids, kind="stable")
        x, ids, out = x[order], ids[order], []
        step = max(1, TABLE // max(1, len(x)))
        for at in range(0, len(a) if len(x) else 0, step):
            s = products(a[at : at + step], x)
            rows, columns = best(s, least[at : at + step], k)
            out.append((names[at + rows], s[rows, columns], ids[columns]))
        q, score, i = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(score, pa.int64()), "id": pa.array(i, pa.int64())})

    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(block, "q long, score long, id long")


def _cells(rows: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """``rows`` with cell, far and least: the nearest pivot, the distance from it, and the k-th highest product with pivots."""
    width, p = pivots.shape[1], pivots.astype(np.float64)
    step = max(1, TABLE // len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, far, least = [], [], []
            for at in range(0, b.num_rows, step):
                x = matrix(b.column("v").slice(at, step), width)
                y, s = x.astype(np.float64), products(x, pivots)
                d = (y * y).sum(1)[:, None] + (p * p).sum(1)[None] - 2.0 * s
                cells.append(d.argmin(1))
                far.append(np.sqrt(((y - p[cells[-1]]) ** 2).sum(1)))
                least.append(np.partition(s, len(p) - k, axis=1)[:, len(p) - k] if len(p) >= k else np.full(len(x), -(2**63)))
            new = (pa.array(np.concatenate(c), t) for c, t in ((cells, pa.int32()), (far, pa.float64()), (least, pa.int64()))) if cells else (pa.array([], t) for t in (pa.int32(), pa.float64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "cell", "far", "least"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, cell int, far double, least long")


def _needed(data: DataFrame, pivots: np.ndarray, cells: list[tuple[int, float, int]], group: dict[int, int]) -> DataFrame:
    """``data`` with groups: those of which a cell of queries (cell, far, least) can need the vector."""
    order = sorted(cells, key=lambda c: group[c[0]])
    at = np.array([c for c, _, _ in order])
    p, far, least = pivots[at], np.array([f for _, f, _ in order]), np.array([float(t) for _, _, t in order])
    named = np.array([group[c] for c, _, _ in order])
    starts = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    names, width, norms = named[starts], pivots.shape[1], np.sqrt((p.astype(np.float64) ** 2).sum(1))
    step = max(1, TABLE // len(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, found = [0], []
            for start in range(0, b.num_rows, step):
                x = matrix(b.column("v").slice(start, step), width)
                size = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
                slack = 1e-9 * size * (norms + far)[None] + 1.0  # for what doubles round off
                can = x.astype(np.float64) @ p.astype(np.float64).T + far[None] * size + slack - least[None]
                rows, columns = np.nonzero(np.maximum.reduceat(can, starts, axis=1) >= 0)
                found.append(names[columns])
                offsets += (offsets[-1] + np.cumsum(np.bincount(rows, minlength=len(x)))).tolist()
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "groups"])

    schema = ", ".join(f"{n} {t}" for n, t in data.dtypes)
    return data.mapInArrow(run, f"{schema}, groups array<int>")


def _grouped(pivots: np.ndarray, cells: list[tuple[int, int]], size: int) -> dict[int, int]:
    """Cells (cell, number of queries) dealt to as many groups as make ``size`` queries each, by the nearest of so many cells."""
    n = max(1, math.ceil(sum(m for _, m in cells) / size))
    heads = [c for c, _ in sorted(cells, key=lambda c: (-c[1], c[0]))[:n]]
    p = pivots.astype(np.float64)
    h = p[heads]
    return {c: int(((h - p[c]) ** 2).sum(1).argmin()) for c, _ in cells}


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` other rows of highest product.

    The product is that of the vectors' whole numbers (``integer_vectors``);
    ties go to the smaller vec_id. The result is exact.

    Defined cases: vectors that are null, or hold null, NaN or infinite
    components, take no part. Where vectors differ in length, what is missing
    counts as 0, so an empty vector has score 0 with all. A row is not its own
    result, but a row that repeats it is, under the same vec_id; rows that share
    an id ask and are found each. A null vec_id asks nothing and is found after
    the ids of its score. A product beyond 64 bits is an error. With fewer than
    ``k`` others all are returned. Other columns aren't read. An empty table
    gives no rows.
    """
    spark, most = embeddings.sparkSession, k + 1
    v = integer_vectors(embeddings, scale).withColumn("h", F.xxhash64("v"))
    # of equal vectors the first k + 1: Spark limits each group before it is shuffled, and again after
    number = F.row_number().over(Window.partitionBy("h", "v").orderBy(F.col("id").asc_nulls_last()))
    data = v.withColumn("rn", number).filter(F.col("rn") <= most).select("h", "rn", F.coalesce("id", F.lit(NO_ID)).alias("id"), "v")
    data = materialize(data, "knn-data")
    asks = v.filter(F.col("id") % every == 0)
    asked = materialize(asks.select("h", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "knn-queries")
    shape = data.agg(F.max(F.size("v")).alias("width"), F.sum(F.when(F.col("rn") == 1, 1)).alias("n")).first()
    n_asked = asked.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_asked:
        return spark.createDataFrame([], schema)
    width, n = shape["width"], shape["n"]
    first = data.filter("rn = 1").orderBy("h", "v").limit(min(MAX_PIVOTS, math.isqrt(n - 1) + 1)).select("v").collect()
    pivots = matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), width)

    data = materialize(_cells(data.select("h", "id", "v"), pivots, most).drop("far", "least"), "knn-cells")
    asked = materialize(_cells(asked, pivots, most), "knn-asked")
    # a lower bound from one block of the query's own cell; the tables of cells have a row for each pivot at most
    blocks = F.broadcast(data.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("blocks")))
    dealt = lambda t, by: t.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(1), by), "blocks"))
    own = _solve(dealt(asked, "q").select("cell", "block", "q", "v", "least"), dealt(data, "id").select("cell", "block", "id", "v"), ["cell", "block"], width, most)
    own = own.groupBy("q").agg(F.count("*").alias("m"), F.min("score").alias("own")).filter(F.col("m") >= most)
    asked = asked.join(own, "q", "left").withColumn("least", F.greatest("least", "own")).drop("m", "own")
    asked = materialize(asked, "knn-bounds")

    cells = [tuple(r) for r in asked.groupBy("cell").agg(F.max("far"), F.min("least"), F.count("*")).collect()]
    group = _grouped(pivots, [(c, m) for c, _, _, m in cells], queries)
    needed = materialize(_needed(data.drop("cell"), pivots, [c[:3] for c in cells], group), "knn-needed")
    parts: dict[int, int] = {}
    for c, _, _, m in cells:
        parts[group[c]] = parts.get(group[c], 0) + m
    counts = {r["g"]: r["count"] for r in needed.select(F.explode("groups").alias("g")).groupBy("g").count().collect()}
    shape = spark.createDataFrame([(g, math.ceil(m / queries), math.ceil(counts[g] / rows)) for g, m in parts.items()], "g int, parts int, blocks int")
    of_cell = spark.createDataFrame(sorted(group.items()), "cell int, g int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = asked.join(F.broadcast(of_cell), "cell").join(F.broadcast(shape), "g")
    a = a.withColumn("part", F.pmod(F.xxhash64(F.lit(2), "q"), "parts").cast("int")).withColumn("block", upto("blocks"))
    d = needed.withColumn("g", F.explode("groups")).join(F.broadcast(shape), "g")
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "h", "id"), "blocks").cast("int")).withColumn("part", upto("parts"))
    keys = ["g", "part", "block"]
    found = _solve(a.select(*keys, "q", "v", "least"), d.select(*keys, "id", "v"), keys, width, most)
    number = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    found = found.withColumn("rn", number).filter(F.col("rn") <= most).groupBy("q")
    found = found.agg(F.sort_array(F.collect_list(F.struct("rn", "score", "id"))).alias("found"))
    found = materialize(found.select("q", F.transform("found", lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id"))).alias("found")), "knn-found")
    # each row that asks drops itself once
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    named = asked.join(found, "q").select("h", "v", "found")
    out = asks.join(named, ["h", "v"]).select(F.col("id").alias("query_id"), "found", F.array_position("found", F.struct(norm.alias("score"), F.col("id"))).alias("self"))
    others = F.slice(F.filter("found", lambda _, i: i + 1 != F.col("self")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.nullif(F.col("e.id"), F.lit(NO_ID)).alias("vec_id"), F.col("e.score").alias("score"))
