"""Operator 1: benchmark decontamination, with DataFrame functions alone.

The benchmark's word windows (13 consecutive words; the whole item where it is
shorter) form a hashed set. It is broadcast behind a check of its row count and
probed by every window of every document inside one code-generated stage; a
match of hashes is then verified word by word. Only verified hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import ascii_lower, fresh, without
from spanforge.storage import materialize

#: What separates words once A-Z are lower-cased; the second also leaves A-Z in words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_AND_REST = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Rows of the window table up to which it is broadcast: at most 13 words and its items each.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def benchmark_windows(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """(h, len, gram, items): each distinct window, its hash, and the ids of the items with it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(width)))
    grams = items.select("item", "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("pos"))
    grams = grams.select("item", "len", F.expr("slice(w, pos, len)").alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("h"), "len", "gram", "items")


def _hits(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(id, th, spans, items) of the documents with at least one verified window."""
    windows = benchmark_windows(benchmark, width)
    lengths = [r["len"] for r in windows.select("len").distinct().collect()]  # at most `width` values
    small = windows.count() <= BROADCAST_ROWS
    d = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    d = d.filter(F.size("w") >= min(lengths, default=1))
    d = d.select("id", "th", "w", F.explode_outer(F.expr("sequence(1, size(w))")).alias("pos"))
    if len(lengths) != 1:
        d = d.withColumn("n", F.explode_outer(F.array(*[F.lit(x) for x in lengths])) if lengths else F.lit(width))
    else:
        d = d.withColumn("n", F.lit(lengths[0]))
    # from here on a row has its window alone, not all words of its document
    d = d.filter(F.expr("pos + n - 1 <= size(w)")).select("id", "th", "pos", "n", F.expr("slice(w, pos, n)").alias("g"))
    d = d.withColumn("h", F.xxhash64("g"))
    found = d.join(F.broadcast(windows) if small else windows, (d["h"] == windows["h"]) & (F.col("g") == F.col("gram")))
    found = found.select("id", "th", F.struct("pos", F.col("n").cast("int").alias("n")).alias("span"), "items")
    return found.groupBy("id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """Judge every document: its columns and n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of a benchmark window is hit; a document is
    contaminated if it has hits and share * n_hit >= n_words.

    Defined cases: a null or empty text has no words and is clean. Each row is
    judged on its own text, so repeated rows and rows that share an id (null
    too) keep their own results, one row out for each row in. An item without
    words has no windows; one with a null item_id still marks words but isn't
    counted in n_items; repeated items count once. An empty benchmark leaves all
    clean. Other columns are carried through, and none of them is read: a
    document column that has the name of a result is replaced by the result.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    hits = _hits(docs, benchmark, width)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["pos"] + s["n"] - 1).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["pos"] + s["n"] - 1 - F.greatest(a["upto"], s["pos"] - 1))).alias("n"),
        ),
    )["n"]
    names = F.sort_array(F.array_distinct(F.flatten("items")))
    base = docs.drop(*own)
    of_id, of_text, found, th = fresh(base, "of_id", "of_text", "found", "th")
    found_ = F.struct(covered.alias("hit"), names.alias("items"), F.col("spans"))
    hits = hits.select(F.col("id").alias(of_id), F.col("th").alias(of_text), found_.alias(found))
    n = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), BREAKS_ANY_CASE), "")).cast("long")
    base = base.withColumns({"n_words": n, th: F.xxhash64("text")})
    out = base.join(hits, base["doc_id"].eqNullSafe(hits[of_id]) & (F.col(th) == hits[of_text]), "left")
    n_hit = F.coalesce(F.col(found)["hit"], F.lit(0).cast("long"))
    items = F.coalesce(F.col(found)["items"], F.array().cast("array<string>"))
    out = out.withColumns({
        "n_hit": n_hit,
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words")),
        "spans": F.col(found)["spans"],
    })
    return out.drop(of_id, of_text, found, th)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = 13, share: int = 20) -> DataFrame:
    """``documents`` without contaminated documents, or without the hit words (``mode="spans"``).

    In mode "spans" every hit word goes, with what separates it from the next
    word; documents stay, and texts without hits are left untouched.

    Defined cases: those of ``contamination``; in either mode all columns stay as
    they are, whatever their names. Null ids and rows that repeat are judged by their
    own texts. An empty table gives no rows.
    """
    if mode == "documents":  # texts stay where they are: only the keys of what goes are moved
        of_id, of_text = fresh(docs, "of_id", "of_text")
        narrow = docs.select("doc_id", "text", F.xxhash64("text").alias(of_text))
        judged = contamination(narrow, benchmark, width, share).filter("contaminated")
        gone = materialize(judged.select(F.col("doc_id").alias(of_id), of_text).distinct(), "contaminated")
        same = docs["doc_id"].eqNullSafe(F.col(of_id)) & (F.xxhash64(docs["text"]) == F.col(of_text))
        return without(docs, gone, same)
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: documents or spans")
    # under other names, so that columns called like a result keep their values
    names = {c: x for c, x in zip(docs.columns, fresh(docs, *(f"column{i}" for i in range(len(docs.columns)))), strict=True)}
    judged = docs.withColumnsRenamed({c: x for c, x in names.items() if c not in ("doc_id", "text")})
    judged = contamination(judged, benchmark, width, share)
    lead = F.regexp_extract("text", BREAKS_ANY_CASE.replace("[", "^[", 1), 0)
    parts = F.regexp_extract_all("text", F.lit(WORD_AND_REST), F.lit(0))
    kept = F.filter(parts, lambda _, i: ~F.exists("spans", lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["n"])))
    cut = F.when(F.col("n_hit") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(F.col("text"))
    judged = judged.withColumn("text", cut)
    return judged.select(*[F.col(c if c in ("doc_id", "text") else names[c]).alias(c) for c in docs.columns])
