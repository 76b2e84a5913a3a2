"""Operator 4: SimHash near-duplicates by tiled exact comparison.

1. Every text gets its 64-bit fingerprint; equal fingerprints collapse to one row.
2. The bits are cut into ``radius + k`` blocks. Fingerprints that differ in at
   most ``radius`` bits agree on at least k blocks, so every link is inside a
   group of rows that share k blocks: the comparison loses none. As many bits of
   each block count as make groups of about ``GROUP`` rows, whatever the number
   of rows, so that the work grows in proportion to them.
3. A group is cut into tiles by population count, larger ones further by hash.
   Pairs of tiles whose population counts differ by more than the radius are
   skipped; the others are compared exactly with numpy exclusive-or and bit
   counts. A tile pair returns a spanning forest of its links, not all pairs.
4. The forest edges are joined into components by alternating large-star and
   small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import fresh, in_small_batches, without
from spanforge.storage import broadcast_small, materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints that share the bits of a group, on average; and those of a group that aren't cut into tiles.
GROUP, TILE = 4096, 512


def text_fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned number; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < width else list(map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts in pieces
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``docs`` with fp: the bits of the text's fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, width) for t in text], np.uint64).view(np.int64))

    return in_small_batches(docs).withColumn("fp", prints("text"))


def _masks(radius: int, rows: int, group: int) -> list[int]:
    """Choices of bits: fingerprints within the radius agree on one choice at least, random ones of ``rows`` in groups of about ``group``."""
    need = max(0, math.ceil(math.log2(max(rows, 1) / group)))
    if not need:
        return [0]
    k = next(k for k in range(1, 65) if k * (64 // (radius + k)) >= need or k == 8)
    width = 64 // (radius + k)
    bits = min(width, -(-need // k))
    block = [((1 << bits) - 1) << (width * i) for i in range(radius + k)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[i] for i in some)) for some in combinations(range(radius + k), k)]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of two tiles: (fp, its tree's least fp)."""
    nodes = np.unique(np.concatenate([a, b]))
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    for at in range(0, len(a), 256):
        near = np.bitwise_count(ua[at : at + 256, None] ^ ub[None, :]) <= radius
        rows, cols = np.nonzero(near)
        if not len(rows):
            continue
        for i, j in np.unique(np.stack([left[at + rows], right[cols]]), axis=1).T if len(rows) < 64 else _thinned(left[at + rows], right[cols]):
            if (x := root(i)) != (y := root(j)):
                parent[max(x, y)] = min(x, y)
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[np.array([root(i) for i in moved.tolist()], np.int64)]


def _thinned(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs with the same components as (i, j), of which there are about as many as nodes.

    Each node is linked to its least partner on either side; what that joins is
    contracted, and this repeats until nothing changes.
    """
    n = int(max(i.max(), j.max())) + 1
    label = np.arange(n)
    while True:
        x, y = label[i], label[j]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[label]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], axis=1)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(a, b), b < a: edges that join exactly what chains of links join, from a table of distinct fp."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius, fps.count(), group)])).alias("k", "v"))
    # groups of one have no links; the count is summed before the shuffle
    groups = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups, "simhash-groups")
    members = keyed.join(broadcast_small(groups), ["k", "v"])
    big = F.col("n") > tile
    members = members.withColumn("pc", F.when(big, F.bit_count("fp")).otherwise(F.lit(-1)))
    parts = F.ceil(F.col("n") / (8 * tile)).cast("int")  # the counts of a group's rows differ, so they cut it too
    members = members.withColumn("s", F.when(big, F.pmod(F.xxhash64("fp"), parts)).otherwise(F.lit(0)))
    tiles = members.groupBy("k", "v", "pc", "s").agg(F.collect_list("fp").alias("fps"), F.max("n").alias("n"))
    tiles = materialize(tiles, "simhash-tiles")
    own = tiles.select(F.col("fps").alias("a"), F.col("fps").alias("b"))
    large = tiles.filter(F.col("pc") >= 0)
    # a tile meets the later tiles of its group with the same count and all with one of the next counts
    reach = large.withColumn("to", F.explode(F.array(*[F.col("pc") + i for i in range(radius + 1)])))
    other = large.select("k", "v", F.col("pc").alias("to"), F.col("s").alias("s2"), F.col("fps").alias("b"))
    across = reach.join(other, ["k", "v", "to"]).filter((F.col("pc") < F.col("to")) | (F.col("s") < F.col("s2")))
    pairs = own.unionByName(across.select(F.col("fps").alias("a"), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [tile_links(np.asarray(a, np.int64), np.asarray(b, np.int64), radius) for a, b in zip(batch["a"], batch["b"], strict=True)]
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    return pairs.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn: each joins all neighbours of a node
    that are above it, or not above it, to the least of them. The number of
    rounds grows with the logarithm of the component size.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        least = materialize(least, "simhash-least")
        near = both.join(least, "a")
        if large:
            out = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return materialize(out.filter("a > b").distinct(), "simhash-edges")

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "simhash-edges")
    sign = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = sign(e)
    for _ in range(rounds):
        if not before["n"]:
            break
        e = star(star(e, large=True), large=False)
        now = sign(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id, root): one row for each document.

    Words are split at ASCII white space after A-Z are lower-cased; shingles of
    ``width`` words (the whole sequence where there are fewer) are hashed by
    XXH64 with seed 42. Fingerprints link at ``radius`` or fewer differing bits,
    and component_id is the smallest doc_id that chains of links reach; root
    names the component by one of its fingerprints.

    Defined cases: null and empty texts have fingerprint zero and link like any
    other. Repeated rows each come out. A row with a null doc_id takes part in
    chains; its component_id is the smallest id that is not null, or null if the
    component has none. No other column is read. An empty table gives no rows.
    """
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    out = _grouped(docs, width, radius)
    return out.select("doc_id", hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("root"))


def _grouped(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of each document; th is its text's xxhash64."""
    prints = materialize(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", F.xxhash64("text").alias("th"), "fp"), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    of_print = materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash-of-print")
    return prints.join(of_print, "fp")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each root of (doc_id, th, root), where th is the text's xxhash64.

    The row with the smallest doc_id that is not null stays, and of texts that
    share it the one with the least hash; rows that repeat it are reduced to one.
    """
    rows = materialize(groups.groupBy("doc_id", "th", "root").agg(F.count("*").alias("n")), "one-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    stay = materialize(rows.groupBy("root").agg(F.min(order).alias("s")).select("s.doc_id", "s.th"), "one-stay")
    # texts stay where they are: only the keys of what goes are moved
    of_id, of_text = fresh(docs, "of_id", "of_text")
    key = lambda t: t.select(F.col("doc_id").alias(of_id), F.col("th").alias(of_text))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_text))
    s = key(stay)
    kept = rows["doc_id"].eqNullSafe(s[of_id]) & (rows["th"] == s[of_text])
    gone = materialize(key(rows.join(s, kept, "left_anti")), "one-gone")
    again = materialize(key(rows.filter("n > 1").join(s, kept, "left_semi")), "one-again")
    out = without(docs, gone, same)
    if not again.isEmpty():
        repeated = out.join(again, same).dropDuplicates([of_id, of_text]).select(*docs.columns)
        out = without(out, again, same).unionByName(repeated)
    return out


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest doc_id.

    Documents are told by id and text, so of rows that share an id but not a
    text each counts in its own group. Rows that repeat both are reduced to one.
    Where all of a group have a null doc_id, one of them stays.
    """
    return one_of_each(docs, _grouped(docs, width, radius).select("doc_id", "th", "root"))
