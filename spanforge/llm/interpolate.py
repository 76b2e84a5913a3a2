"""Operator 9: language-model scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood bigram, the maximum-likelihood unigram and
a uniform floor. The weights depend on how often h was seen, in buckets, and are
learned by expectation-maximisation on held-out counts: each training token is
predicted from counts that leave that token out.

How it runs. Documents are packed once into blocks of about ``BLOCK`` tokens:
a table of the block's distinct words as 64-bit hashes and a number for each
token. Each block sends its distinct words and bigrams with their training
counts to the partition that owns each hash; the partition adds them up over all
blocks and answers every block in the order asked. So an n-gram moves once for
each block that has it, not once for each token, a frequent one is no hot key,
and no table of counts is ever broadcast. Blocks and answers are bucketed alike,
so that they meet without moving the blocks again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import crc_fold, in_small_batches
from spanforge.storage import materialize, shared_dir

FOLDS, HELD = 10, 0
BLOCK = 1_000_000
#: Tokens for each owner of hashes, and bytes of text for each bucket: both grow in number with the corpus, not in size.
OWNED, BUCKET_BYTES = 2_000_000, 16 << 20
END = 0x9E3779B97F4A7C15
#: Context buckets: how often the context was seen in training: never, once, twice, then by powers of two.
BUCKETS = 24
#: Cells of the histograms on which EM runs: log10 of a probability ratio in steps of 1/CELLS_PER.
CELLS, CELLS_PER = 120, 8


def tokens(text: str | None) -> list[int]:
    """Hashes of the words, then of the end; A-Z are lower-cased, ASCII white space parts words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = list(map(xxhash.xxh64_intdigest, w))
    out.append(END)
    return out


def bigrams(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash for each token of the token and the one before it; the end stands before a text's first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = END
    with np.errstate(over="ignore"):
        x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _bytes(a: np.ndarray, dtype: str) -> bytes:
    return a.astype(dtype).tobytes()


def planes(a: np.ndarray) -> bytes:
    """64-bit numbers by byte position: the positions that are 0 throughout compress to nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def ascending(h: np.ndarray) -> bytes:
    """Sorted hashes as steps between their upper 56 bits."""
    return planes(np.diff(h >> np.uint64(8), prepend=np.uint64(0)))


def from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw), dtype=np.uint64)


def pack(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of whole documents: ids, training flags, lengths, distinct words, and the words' numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, train, lengths, parts, held = [], [], [], [], 0

        def flush() -> pd.DataFrame:
            words, numbers = np.unique(np.concatenate(parts), return_inverse=True)
            row = {"block": uuid.uuid4().int >> 65, "ids": list(ids), "train": bytes(train), "lengths": _bytes(np.array(lengths), "<i8"), "words": _bytes(words, "<u8"), "numbers": _bytes(numbers, "<u4")}
            return pd.DataFrame([row])

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                t = np.array(tokens(text), np.uint64)
                ids.append(doc_id)
                train.append(doc_id is None or crc_fold(doc_id, FOLDS) != HELD)
                lengths.append(len(t))
                parts.append(t)
                held += len(t)
                if held >= block:
                    yield flush()
                    ids, train, lengths, parts, held = [], [], [], [], 0
        if parts:
            yield flush()

    return in_small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "block long, ids array<string>, train binary, lengths binary, words binary, numbers binary")


class Block:
    """One packed row: arrays over its tokens, and its distinct bigrams."""

    def __init__(self, row) -> None:
        self.ids = row["ids"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.words = np.frombuffer(row["words"], "<u8")
        self.numbers = np.frombuffer(row["numbers"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.token_train = np.repeat(self.train, self.lengths)
        self.pairs, self.pair_of = np.unique(bigrams(self.words[self.numbers], self.starts), return_inverse=True)

    def training(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.token_train], minlength=n)


def _owner(h: np.ndarray, owners: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)


def asked(blocks: DataFrame, owners: int) -> DataFrame:
    """(owner, block, kind, hashes, counts): the distinct words (0) and bigrams (1) of each block, by owner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                b, out = Block(row), []
                for kind, h, of in ((0, b.words, b.numbers), (1, b.pairs, b.pair_of)):
                    own, n = _owner(h, owners), b.training(of, len(h))
                    order = np.argsort(own, kind="stable")
                    cuts = np.searchsorted(own[order], np.arange(owners + 1))
                    for k in np.flatnonzero(np.diff(cuts)).tolist():  # a block writes to the owners of its hashes only
                        at = order[cuts[k] : cuts[k + 1]]
                        out.append((k, row["block"], kind, ascending(h[at]), planes(n[at])))
                yield pd.DataFrame(out, columns=["owner", "block", "kind", "hashes", "counts"])

    return blocks.mapInPandas(run, "owner long, block long, kind int, hashes binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """(owner, block, kind, counts, n_known): the training counts over all blocks, in the order asked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in group.groupby("kind"):
            h = [from_ascending(x) for x in rows["hashes"]]
            n = np.concatenate([from_planes(x) for x in rows["counts"]]).astype(np.float64)
            known, of = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(of, n, len(known)).astype(np.int64)
            ends = np.cumsum([len(x) for x in h])
            for i, (block, end, x) in enumerate(zip(rows["block"], ends, h, strict=True)):
                # the distinct words seen in training are counted once, on the owner's first row
                out.append((rows["owner"].iloc[0], block, int(kind), planes(total[of[end - len(x) : end]]), int((total > 0).sum()) if i == 0 else 0))
        return pd.DataFrame(out, columns=["owner", "block", "kind", "counts", "n_known"])

    return questions.groupBy("owner").applyInPandas(run, "owner long, block long, kind int, counts binary, n_known long")


def _counts(b: Block, answers: pd.DataFrame, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of the block's words and bigrams, from the owners' answers."""
    found = {(r["kind"], r["owner"]): r["counts"] for r in answers.to_dict("records")}
    out = []
    for kind, h in ((0, b.words), (1, b.pairs)):
        own = _owner(h, owners)
        order = np.argsort(own, kind="stable")
        total = np.zeros(len(h), np.int64)
        total[order] = np.concatenate([from_planes(found[kind, k]) for k in np.unique(own).tolist()])
        out.append(total)
    return out[0], out[1]


def _per_token(b: Block, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training counts of each token's context, bigram and word. A context is a token: the end stands before each text."""
    end = int(np.searchsorted(b.words, np.uint64(END)))
    before = np.empty_like(b.numbers)
    before[1:] = b.numbers[:-1]
    before[b.starts] = end
    return words[before], pairs[b.pair_of], words[b.numbers]


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket up to each power of two, the rest in the last."""
    return np.where(context > 0, np.minimum(1 + np.ceil(np.log2(np.maximum(context, 1))).astype(np.int64), BUCKETS - 1), 0)


def _cell(ratio: np.ndarray) -> np.ndarray:
    """Cell of a ratio: 0 for zero, else log10 in steps, from 1e-4 up."""
    with np.errstate(divide="ignore"):
        k = np.floor((np.log10(ratio) + 4) * CELLS_PER)
    return np.where(ratio > 0, np.clip(k, 0, CELLS - 2) + 1, 0).astype(np.int64)


def _ratio(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 10 ** ((cell - 0.5) / CELLS_PER - 4), 0.0)


def learn_weights(histogram: dict[tuple[int, int, int], int], rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, floor) for each bucket, by EM.

    The histogram counts left-out tokens by bucket and by the cells of their
    bigram's and unigram's probabilities over the floor's.
    """
    lam = np.full((BUCKETS, 3), 1 / 3)
    for k in range(BUCKETS):
        rows = [(a, b, n) for (q, a, b), n in histogram.items() if q == k]
        if not rows:
            lam[k] = (0.0, 0.5, 0.5) if k == 0 else lam[k - 1]
            continue
        a, b, n = (np.array(x, float) for x in zip(*rows, strict=True))
        p = np.stack([_ratio(a), _ratio(b), np.ones_like(a)], axis=1)
        for _ in range(rounds):
            share = p * lam[k]
            got = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 0.01
            lam[k] = got / got.sum()
    return lam


def score(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each document.

    Documents with crc32(doc_id) mod 10 = 0 teach nothing; all are scored. The
    result is a written table; the bucketed tables behind it lie in the shared
    folder and are dropped from the catalog whatever happens. base_score is the
    smoothed unigram score, score the log10 probability under the interpolated
    model.

    Defined cases: a null text is empty and has its end as its only token.
    Repeated rows count as often as they come. A null id is a training document.
    Where nothing is learned the floor alone scores. No column but doc_id and
    text is read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tag = uuid.uuid4().hex[:12]
    try:
        return _scored(docs, block, tag)
    finally:
        for name in ("blocks", "answers"):
            spark.sql(f"DROP TABLE IF EXISTS lm_{name}_{tag}")


def _scored(docs: DataFrame, block: int, tag: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.StringType())] + [T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])
    typed = lambda df: df.withColumn("doc_id", F.col("doc_id").cast(kind))
    buckets = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BUCKET_BYTES)

    def bucketed(df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(spark)}/lm-{name}-{tag}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(f"lm_{name}_{tag}")
        return spark.table(f"lm_{name}_{tag}")

    blocks = bucketed(pack(docs, block), "blocks")
    size = blocks.agg(F.count("*").alias("n"), F.sum(F.octet_length("numbers")).alias("b")).first()
    if not size["n"]:
        return typed(spark.createDataFrame([], schema))
    owners = max(8, -(-(size["b"] // 4) // OWNED))
    answers = bucketed(answered(asked(blocks, owners)).repartition(buckets, "block"), "answers")
    distinct = answers.filter("kind = 0").agg(F.sum("n_known")).first()[0]

    def training(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [int((np.frombuffer(x, "<i8") * np.frombuffer(t, np.uint8)).sum()) for x, t in zip(b["lengths"], b["train"], strict=True)]})

    total = blocks.select("lengths", "train").mapInPandas(training, "n long").agg(F.sum("n")).first()[0]
    floor = 1.0 / (distinct + 1)

    def left_out(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        seen: dict[tuple[int, int, int], int] = {}
        for row in rows.to_dict("records"):
            b = Block(row)
            c, cw, w = (x[b.token_train] for x in _per_token(b, *_counts(b, replies, owners)))
            c, cw, w = c - 1, cw - 1, w - 1
            cells = (bucket(c) * CELLS + _cell(np.maximum(cw, 0) / np.maximum(c, 1) / floor)) * CELLS + _cell(w / max(total - 1, 1) / floor)
            for cell, n in zip(*np.unique(cells, return_counts=True), strict=True):
                key = int(cell) // CELLS // CELLS, int(cell) // CELLS % CELLS, int(cell) % CELLS
                seen[key] = seen.get(key, 0) + int(n)
        return pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["bucket", "a", "b", "n"]).astype("int64")

    together = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    cells = together.applyInPandas(left_out, "bucket long, a long, b long, n long").groupBy("bucket", "a", "b").agg(F.sum("n").alias("n"))
    # at most BUCKETS * CELLS * CELLS rows reach the driver
    lam = learn_weights({(r["bucket"], r["a"], r["b"]): r["n"] for r in cells.collect()})

    def scored(_, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            b = Block(row)
            c, cw, w = _per_token(b, *_counts(b, replies, owners))
            base = np.log10((w + 0.1) / (total + 0.1 * (distinct + 1)))
            k = lam[bucket(c)]
            p = k[:, 0] * cw / np.maximum(c, 1) + k[:, 1] * w / max(total, 1) + k[:, 2] * floor
            add = lambda x, b=b: np.add.reduceat(x, b.starts)
            out.append(pd.DataFrame({"doc_id": list(b.ids), "held_out": ~b.train, "n_tokens": b.lengths, "n_known": add((w > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))}))
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema})

    return materialize(typed(together.applyInPandas(scored, schema)), "lm-scores")
