"""Parsing the names of scheduler steps (G1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: total tokens (detailed form only), contexts and their inner text, generations and theirs
SHAPE = r"^execute_(?:(\d+)_)?context_(\d+)\(([^)]*)\)_generation_(\d+)\((.*)\)$"
INNER = r"^sq(\d+)(?:sk(\d+))?"


def step_batch(name: Column) -> Column:
    """struct(total_tokens, n_ctx, n_gen, ctx_tokens, ctx_kv, gen_tokens, gen_kv), or null where the name has neither form.

    ``execute_context_1(4)_generation_1(1)`` has bare token counts;
    ``execute_512_context_1(sq512sk...)_generation_0(sq0sk...)`` has tokens after
    sq and, where given, kv after sk. Without a total, or with 0, it is their sum.
    """
    got = lambda p, i, c: F.nullif(F.regexp_extract(c, p, i), F.lit("")).try_cast("long")

    def inner(i: int) -> tuple[Column, Column]:
        text = F.regexp_extract(name, SHAPE, i)
        bare = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
        return F.coalesce(got(INNER, 1, text), bare), got(INNER, 2, text)

    (ct, ck), (gt, gk) = inner(3), inner(5)
    total = F.coalesce(F.nullif(got(SHAPE, 1, name), F.lit(0)), ct + gt)
    ok = name.rlike(SHAPE) & ct.isNotNull() & gt.isNotNull()
    parts = {"total_tokens": total, "n_ctx": got(SHAPE, 2, name), "n_gen": got(SHAPE, 4, name), "ctx_tokens": ct, "ctx_kv": ck, "gen_tokens": gt, "gen_kv": gk}
    return F.when(ok, F.struct(*[c.alias(k) for k, c in parts.items()]))
