"""Operator 3: document fingerprints by a Merkle tree over paragraphs and sections.

Leaves are pieces of paragraphs, cut where a word's own checksum says so,
whatever the text's length, so that an edit moves no cut far from it. A
paragraph's node hashes its leaves, a section's node its paragraphs, the root its
sections and the whole text. The fingerprint is the root followed by each
section's node, and in it each paragraph's node and digests of its leaves: equal
roots mean equal texts, and comparing two fingerprints from the top shows the
branches that differ.

Pieces of a few words tell little of short texts. A text of up to ``FINE``
characters has one more level below, every ``GRAM`` characters that follow each
other. Two texts that both have it are compared by it, others by their pieces,
which all have.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import in_small_batches

#: A blank line ends a section.
SECTION = re.compile(r"\n[ \t\r\x0b\f]*\n")
#: A leaf ends after a word whose checksum is 0 modulo the first, or of this many words.
MEAN_WORDS, MOST_WORDS = 3, 8
FINE, GRAM = 400, 4
ROOT_HEX, NODE_HEX, LEAF_HEX = 32, 16, 8
#: Multipliers of the hashes of the finer level: odd numbers of 64 bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(1, GRAM + 1)], np.uint64)


def _digest(parts: list[bytes], tag: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=tag).digest()


def tree(text: str) -> list[list[list[bytes]]]:
    """Digests of the leaves by section and paragraph."""
    out = []
    for section in SECTION.split(text):
        paragraphs = []
        for paragraph in section.split("\n"):
            leaves, own = [], []
            for w in paragraph.encode("utf-8", "surrogatepass").split(b" "):
                own.append(w)
                if zlib.crc32(w) % MEAN_WORDS == 0 or len(own) == MOST_WORDS:
                    leaves.append(xxhash.xxh64_digest(b" ".join(own)))
                    own = []
            if own:
                leaves.append(xxhash.xxh64_digest(b" ".join(own)))
            paragraphs.append(leaves)
        out.append(paragraphs)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h ^ (h >> np.uint64(32))) * MIX


def _fine(text: str) -> str:
    """The finer level of a short text: digests of the ``GRAM`` characters that end with each."""
    if len(text) > FINE:
        return ""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.r_[np.zeros(GRAM - 1, np.uint64), code.astype(np.uint64) + np.uint64(1)]
    h = sum(c[i : i + len(code)] * POWERS[i] for i in range(GRAM)) if len(code) else c[:0]
    return ";" + _mixed(h).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : LEAF_HEX // 2].tobytes().hex()


def fingerprint(text: str | None) -> str:
    """``root:sections``: parted by "/", each ``node=paragraphs``, parted by ".", each ``node-leaves``; ";" and the finer level may follow.

    Nodes have ``NODE_HEX`` digits and leaves ``LEAF_HEX`` each. The root also
    hashes the whole text, so that texts are equal if their roots are.
    """
    text = text or ""
    nodes, out = [], []
    for s in tree(text):
        own = [_digest(p, b"paragraph") for p in s]
        nodes.append(_digest(own, b"section"))
        paragraphs = (f"{d.hex()[:NODE_HEX]}-{''.join(x.hex()[:LEAF_HEX] for x in p)}" for d, p in zip(own, s, strict=True))
        out.append(f"{nodes[-1].hex()[:NODE_HEX]}={'.'.join(paragraphs)}")
    whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    return _digest([*nodes, whole], b"root").hex()[:ROOT_HEX] + ":" + "/".join(out) + _fine(text)


def _sections(print_: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(node, its paragraphs as (node, leaves)) of each section."""
    sections = (s.split("=") for s in print_[ROOT_HEX + 1 :].partition(";")[0].split("/"))
    return [(node, [(p[:NODE_HEX], p[NODE_HEX + 1 :]) for p in below.split(".")]) for node, below in sections]


def _leaves(print_: str, fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, how often), by leaf, of the finer level or of the pieces."""
    digits = print_.partition(";")[2] if fine else "".join(p for _, s in _sections(print_) for _, p in s)
    x = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, LEAF_HEX // 2).astype(np.int64)
    return np.unique(x @ (256 ** np.arange(LEAF_HEX // 2)), return_counts=True)


def likeness(a: str, b: str) -> float:
    """1 if the roots are equal, else the leaves in common over the leaves of the larger one, below 1."""
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        return 1.0
    fine = ";" in a and ";" in b
    (x, n), (y, m) = _leaves(a, fine), _leaves(b, fine)
    most = max(n.sum(), m.sum())
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = np.minimum(n, m[at])[y[at] == x].sum()
    return min(float(common / most), 0.999999)


def _in_order(places: list[int]) -> set[int]:
    """Indexes of a longest rising part of a list of different numbers."""
    tails: list[int] = []
    last, before = [], {}
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
        last[k : k + 1] = [i]
        before[i] = last[k - 1] if k else None
    out, i = set(), last[-1] if last else None
    while i is not None:
        out.add(i)
        i = before[i]
    return out


def _matched(mine: list[str], other: list[str]) -> list[tuple[int, int]]:
    """(place in mine, place in other) of equal nodes, the first with the first."""
    there: dict[str, list[int]] = defaultdict(list)
    for j, node in enumerate(other):
        there[node].append(j)
    left = {node: iter(places) for node, places in there.items()}
    found = ((i, next(left[node], None)) for i, node in enumerate(mine) if node in left)
    return [(i, j) for i, j in found if j is not None]


def changes(a: str, b: str) -> list[tuple[str, int, int]]:
    """(kind, section, paragraph) of what makes ``b`` of ``a``, from the root down.

    Equal roots end it. Sections with equal nodes are matched and not descended
    into; paragraphs of the others are matched by their nodes. What ``a`` has
    alone is "deleted", what ``b`` has alone "inserted" (its place there), and
    what is matched out of order "moved"; for a whole section the paragraph is -1.
    Where only blank lines differ, there is one ("spacing", -1, -1).
    """
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        return []
    x, y = _sections(a), _sections(b)
    same = _matched([node for node, _ in x], [node for node, _ in y])
    stay = _in_order([j for _, j in same])
    out = [("moved", i, -1) for k, (i, _) in enumerate(same) if k not in stay]
    whole_x, whole_y = {i for i, _ in same}, {j for _, j in same}
    rest_x = [(i, n, p) for i, (_, s) in enumerate(x) if i not in whole_x for n, (p, _) in enumerate(s)]
    rest_y = [(j, n, p) for j, (_, s) in enumerate(y) if j not in whole_y for n, (p, _) in enumerate(s)]
    pairs = _matched([p for _, _, p in rest_x], [p for _, _, p in rest_y])
    stay = _in_order([j for _, j in pairs])
    out += [("moved", *rest_x[i][:2]) for k, (i, _) in enumerate(pairs) if k not in stay]
    met_x, met_y = {i for i, _ in pairs}, {j for _, j in pairs}
    out += [("deleted", *r[:2]) for i, r in enumerate(rest_x) if i not in met_x]
    out += [("inserted", *r[:2]) for j, r in enumerate(rest_y) if j not in met_y]
    return out or [("spacing", -1, -1)]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_deleted, n_inserted, n_moved).

    Documents are dealt by ranges of doc_id, whose bounds are ids, and read in
    descending order; the row of each bound is dealt to the preceding range as
    well, so that every row finds the next document in its own task and each
    text is shuffled once. Ids are of any type that has an order: whole numbers,
    text, decimals, dates.

    Defined cases: a null text is empty; empty texts have one fingerprint. Null
    ids come last. Rows with equal ids follow each other by text. After the
    last row comes the first; a lone row is followed by itself. No other column
    is read. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = in_small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_deleted int, n_inserted int, n_moved int"
    # the largest id of each of n ranges: ids alone are moved, and a row for each range is collected
    ids = d.select("doc_id").filter(F.col("doc_id").isNotNull()).repartitionByRange(n, "doc_id")
    bounds = sorted({r["x"] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("x")).collect()})
    # range k: ids up to bounds[k] and above bounds[k - 1]; null ids are in range 0, after all others
    last = len(bounds) - 1

    @F.pandas_udf("array<struct<part:int,halo:boolean>>")
    def deal(doc_id: pd.Series) -> pd.Series:
        out = []
        for x in doc_id.tolist():
            k = bisect_left(bounds, x)
            own = [{"part": k, "halo": False}]
            if bounds[k] == x:
                own.append({"part": 0 if k == last else k + 1, "halo": True})
            out.append(own)
        return pd.Series(out)

    none = F.lit(None).cast(kind)
    if bounds:
        lowest = F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("halo")))
        to = F.explode(F.when(F.col("doc_id").isNull(), lowest).otherwise(deal(F.coalesce("doc_id", F.lit(bounds[0]).cast(kind)))))
        dealt = d.withColumn("to", to).select("doc_id", "text", "to.part", "to.halo")
    else:  # null ids only, if any: one range, which follows itself
        dealt = d.select(none.alias("doc_id"), "text", F.lit(0).alias("part"), F.lit(False).alias("halo"))

    def flush(row: tuple, following: tuple) -> tuple:
        doc_id, text, own = row
        new = edited(text, following[1])
        other = fingerprint(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        n = Counter(kind for kind, _, _ in changes(own, other))
        return doc_id, len(text), sha, own, other, likeness(own, other), likeness(own, following[2]), n["deleted"], n["inserted"], n["moved"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        part, row, head, done, wrap = None, None, None, [], False
        for b in batches:
            for doc_id, text, at, halo in zip(b["id"], b["text"], b["part"], b["halo"], strict=True):
                if at != part:
                    if row is not None:
                        done.append(flush(row, head))  # no halo: the only range, which follows itself
                    part, row, head = at, None, None
                    wrap = False
                now = (doc_id, text, fingerprint(text))
                if halo and wrap:
                    continue  # of rows that share the bound's id, the first is next
                if row is not None:
                    done.append(flush(row, now))
                row, wrap = (None, True) if halo else (now, False)
                if not halo and head is None:
                    head = now
            yield pd.DataFrame(done, columns=names)
            done = []
        if row is not None:
            yield pd.DataFrame([flush(row, head)], columns=names)

    dealt = dealt.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")
    dealt = dealt.select(F.col("doc_id").cast("string").alias("id"), "text", "part", "halo")
    out = dealt.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
