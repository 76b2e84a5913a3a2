"""Near copies by shingle similarity: every pair of texts at ``SIMILAR`` or more, verified on the sets.

1. Every text becomes the set of its hashed shingles of five words; equal sets
   collapse to one row.
2. All sets are put into one order, common shingles last. Two sets of similarity
   t or more have one of the first ``n - ceil(t n) + 1`` shingles in common
   (prefix filter), so sets meet by those and no pair is lost. What is common is
   told from a sample of the sets; that changes the speed alone.
3. SimHash: every set gets a fingerprint of 64 bits, and tiles of fingerprints
   are compared exactly (``simhash.links``). What is within the radius is
   verified and joined. These are the closest copies; copies of similarity 0.8
   can be farther apart than any radius that tiles can search, so:
4. Sets that meet and aren't joined are compared with one of them, the centre;
   what that joins is joined. This is repeated with other centres while many
   pairs are left, so that large groups of copies fall together over few
   comparisons. Then all pairs that meet and aren't joined yet are compared. A
   pair is compared only if sizes and places in the order allow the similarity.
5. The parities of a set tell of which classes of shingles it has an odd number;
   long sets have more classes. Pairs whose parities differ in more bits than
   near copies have members that differ are no near copies. The others are
   verified by the intersection of their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import BROADCAST_KEYS, in_small_batches
from spanforge.llm.simhash import components, links, one_of_each
from spanforge.storage import materialize

WIDTH = 5
#: The similarity from which texts are near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: One of so many sets tells what is common; at most so many shingles are told.
SAMPLED, COMMON = 16, 300_000
#: Classes of parities of short and of the longest sets; between them a set has two or more for each of its shingles.
BITS, MOST_BITS = 1024, 4096
#: Rounds of centres at most, and the pairs for each set in open meetings from which another round is made, if the last one joined a tenth of what it compared.
CENTRES, MANY = 5, 4
#: What a meeting has of each set: its name, its size, the shingle's place in it, and what has been joined to it.
MEMBER = ("k", "n", "i", "root")
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; the whole sequence is one where there are fewer words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def _name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 5)).view(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """For each class of shingles, whether the set has an odd number of them: ``BITS`` classes to ``MOST_BITS``, a power of two."""
    bits = min(max(BITS, 1 << max(2 * len(s) - 1, 0).bit_length()), MOST_BITS)
    odd = (np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Parities as of so many words: classes that fall into one add up."""
    return np.bitwise_xor.reduce(words.reshape(-1, length), axis=0)


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of hashed shingles, as a signed number; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):  # long texts in pieces
        ones += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def prefix(s: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of the set in the common order, one of which any near copy has among its own first."""
    n = len(s)
    a, b = SIMILAR
    most = n - -(-a * n // b) + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, ranks[at], 0)))]
    return s[:most]


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, its count) of a sample, sorted by shingle: at most ``COMMON`` of the most frequent."""

    @F.pandas_udf("array<long>")
    def sets(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width) for t in text])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counts = in_small_batches(some).select(F.explode(sets("text")).alias("p")).groupBy("p").agg(F.count("*").alias("c")).filter("c > 2")
    counts = materialize(counts, "shingle-common")
    total, least = 0, 3
    for r in counts.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        total += r["n"]
        if total > COMMON:
            least = r["c"] + 1
            break
    found = counts.filter(F.col("c") >= least).toPandas().sort_values("p")
    return found["p"].to_numpy(np.int64), found["c"].to_numpy(np.int64)


def alike(n: Column, m: Column, both: Column) -> Column:
    """Whether sets of n and m members with so many in common are near copies."""
    a, b = SIMILAR
    return (a + b) * both >= a * (n + m)


def _near(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) that parities allow: bits that differ are at most as many as members that differ."""
    a, b = SIMILAR
    side = lambda x: own.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    words = F.least(F.size("bitsa"), F.size("bitsb"))

    def fold(c: str) -> Column:
        piece = lambda j: F.slice(c, j * words + 1, words)
        rest = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(c) / words).cast("int") - 1))
        return F.when(F.size(c) == words, F.col(c)).otherwise(F.aggregate(rest, piece(F.lit(0)), lambda t, j: xor(t, piece(j))))

    p = pairs.join(side("a"), "a").join(side("b"), "b")
    off = F.aggregate(F.transform(xor(fold("bitsa"), fold("bitsb")), F.bit_count), F.lit(0), lambda t, x: t + x)
    return p.filter((a + b) * off <= (b - a) * (F.col("na") + F.col("nb"))).select("a", "b")


def _may(n, m, i, j):
    """Whether sizes, and places of a first common shingle, allow the similarity."""
    a, b = SIMILAR
    return (a + b) * np.minimum(n - i, m - j) >= a * (n + m)


def _meetings(posts: DataFrame) -> DataFrame:
    """(p, m: MEMBER): the sets that share a first shingle; shingles that the same sets share are one meeting.

    Near copies share many first shingles, and would be a pair of each. A meeting
    has the least place of each set in any of its shingles, so it allows
    what one of them does. Two whose numbers p collide are one meeting of the sets of both.
    """
    m = posts.groupBy("p").agg(F.collect_list(F.struct(*MEMBER)).alias("m")).filter(F.size("m") > 1)
    m = m.select(F.xxhash64(F.array_sort(F.transform("m", lambda x: x["k"]))).alias("p"), F.explode("m").alias("x"))
    m = m.groupBy("p", "x.k").agg(F.min("x.n").alias("n"), F.min("x.i").alias("i"), F.min("x.root").alias("root"))
    return m.groupBy("p").agg(F.collect_list(F.struct(*MEMBER)).alias("m"))


def _stars(meet: DataFrame, seed: int) -> DataFrame:
    """(a, b): each member of a meeting with one of them, which is the same in most meetings of a group; not those of one root."""
    a, b = SIMILAR
    by_hash = F.array_min(F.transform("m", lambda x: F.struct(F.xxhash64(x["k"], F.lit(seed)).alias("h"), x.alias("x"))))["x"]
    by_other = F.array_max(F.transform("m", lambda x: F.struct(F.xxhash64(x["k"], F.lit(seed)).alias("h"), x.alias("x"))))["x"]
    e = meet.withColumn("c", F.when(F.col("p") % 2 == 0, by_hash).otherwise(by_other)).select("c", F.explode("m").alias("x")).filter("x.root <> c.root")
    room = F.least(F.col("x.n") - F.col("x.i"), F.col("c.n") - F.col("c.i"))
    e = e.filter((a + b) * room >= a * (F.col("x.n") + F.col("c.n")))
    return e.select(F.greatest("x.k", "c.k").alias("a"), F.least("x.k", "c.k").alias("b")).distinct()


def _open(meet: DataFrame, joined: DataFrame) -> DataFrame:
    """The meetings of several roots, with the roots as they now are: (p, m: MEMBER)."""
    each = meet.select("p", F.explode("m").alias("x")).select("p", "x.k", "x.n", "x.i")
    rooted = each.join(joined, each["k"] == joined["node"], "left").withColumn("root", F.coalesce("root", "k"))
    rooted = rooted.groupBy("p").agg(F.collect_list(F.struct(*MEMBER)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return materialize(rooted.filter("r0 < r1").select("p", "m"), "shingle-open")


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of a meeting whose members aren't joined yet and that sizes, places and parities allow, a member at a time."""
    a, b = SIMILAR
    found: list[np.ndarray] = []
    held = 0

    def out() -> pd.DataFrame:
        pairs = np.unique(np.concatenate(found), axis=0)  # pairs meet often
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    for batch in batches:
        for *row, bits in zip(*(batch[c] for c in (*MEMBER, "bits")), strict=True):
            k, n, i, r = (np.asarray(x, np.int64) for x in row)
            bits = [np.asarray(x, np.int64).view(np.uint64) for x in bits]  # of negative numbers numpy counts other bits
            size = np.array([len(x) for x in bits])
            level = {}  # of each length: the parities that are as long or longer, and where each member's are
            for length in np.unique(size).tolist():
                longer = np.flatnonzero(size >= length)
                where = np.full(len(k), -1)
                where[longer] = np.arange(len(longer))
                level[length] = np.stack([folded(bits[x], length) for x in longer]), where
            for x in range(1, len(k)):
                ok = np.flatnonzero((r[:x] != r[x]) & _may(n[:x], n[x], i[:x], i[x]))
                shorter = np.minimum(size[ok], size[x])
                for length in np.unique(shorter).tolist():
                    y = ok[shorter == length]
                    words, where = level[length]
                    off = np.bitwise_count(words[where[y]] ^ words[where[x]]).sum(axis=1, dtype=np.int64)
                    y = y[(a + b) * off <= (b - a) * (n[y] + n[x])]
                    if len(y):
                        found.append(np.stack([np.maximum(k[y], k[x]), np.minimum(k[y], k[x])], axis=1))
                        held += len(y)
                if held > 100_000:
                    yield out()
                    found, held = [], 0
    if found:
        yield out()


def _close(own: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints tiles find within the radius, of each two that chains of them join at least a chain."""
    prints = materialize(own.groupBy("fp").agg(F.min("k").alias("rep")), "shingle-fingerprints")
    equal = own.join(prints, "fp").select(F.col("k").alias("x"), F.col("rep").alias("y"))
    side = lambda c, x: prints.select(F.col("fp").alias(c), F.col("rep").alias(x))
    near = links(prints.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return equal.unionByName(near).filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, root): one row for each document; those that chains of near copies join have one root.

    th is the text's xxhash64. Similarity is that of the sets of shingles, members
    in common over members of either. Texts without words are copies of each
    other; null ids take part. No column but doc_id and text is read.
    """
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(_common(docs, width))  # at most COMMON pairs of numbers

    @F.pandas_udf("struct<k:long,n:int,fp:long,bits:array<long>,first:array<long>>")
    def prints(text: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, width) for t in text]
        return pd.DataFrame({"k": [_name(s) for s in sets], "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "bits": [parities(s) for s in sets], "first": [prefix(s, *order.value) for s in sets]})

    @F.pandas_udf("array<long>")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width) for t in text])

    d = in_small_batches(docs.select("doc_id", "text")).withColumn("th", F.xxhash64("text"))
    seen = materialize(d.withColumn("p", prints("text")).select("doc_id", "th", "p.*"), "shingle-prints")
    # the text that stands for a set is one that has it; of its copies only one posts the set
    own = materialize(seen.groupBy("k").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "shingle-sets")
    posts = seen.join(own.select("k", "th"), ["k", "th"]).dropDuplicates(["k"])
    posts = posts.select("k", "n", F.col("k").alias("root"), F.posexplode("first").alias("i", "p"))
    meet = materialize(_meetings(posts), "shingle-meetings")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are near copies; sets are made again from the texts, of these pairs alone."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(own, "k")
        wanted = materialize(named.select("k", F.col("th").alias("__th")), "shingle-wanted")
        keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        sets = d.join(keys, F.col("th") == F.col("__th")).dropDuplicates(["k"]).select("k", whole("text").alias("s"))
        sets = materialize(sets, "shingle-whole")
        p = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        return materialize(p.filter(alike(F.size("sa").cast("long"), F.size("sb").cast("long"), both)).select("a", "b"), "shingle-links")

    compared = materialize(_close(own), "shingle-close")
    linked = verified(materialize(_near(compared, own), "shingle-pairs"))
    joined = materialize(components(linked), "shingle-joined")
    meet = _open(meet, joined)
    for seed in range(CENTRES):
        stars = materialize(_stars(meet, seed).join(compared, ["a", "b"], "left_anti"), "shingle-stars")
        found = verified(materialize(_near(stars, own), "shingle-pairs"))
        linked, compared = linked.unionByName(found), compared.unionByName(stars)
        joined = materialize(components(linked), "shingle-joined")
        meet = _open(meet, joined)
        left = meet.agg(F.sum(F.size("m").cast("long")).alias("n"), F.sum(F.size("m").cast("long") * (F.size("m") - 1) / 2).alias("pairs")).first()
        if (left["pairs"] or 0) <= MANY * (left["n"] or 0) or 10 * found.count() < stars.count():
            break
    # only the sets of meetings that are still open bring their parities
    each = meet.select("p", F.explode("m").alias("x")).select("p", "x.*").join(own.select("k", "bits"), "k")
    rest = each.groupBy("p").agg(F.collect_list(F.struct(*MEMBER, "bits")).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in (*MEMBER, "bits")])
    rest = rest.mapInPandas(_across, "a long, b long").distinct().join(compared, ["a", "b"], "left_anti")
    more = verified(materialize(rest, "shingle-pairs"))
    if not more.isEmpty():
        joined = materialize(components(linked.unionByName(more)), "shingle-joined")
    out = seen.join(joined, seen["k"] == joined["node"], "left")
    return out.select("doc_id", "th", F.coalesce("root", "k").alias("root"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id, and of its texts one."""
    return one_of_each(docs, groups(docs, width))
