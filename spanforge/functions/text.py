"""Column expressions over names, paths, labels and args (K1-K7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_of_label(label: Column) -> Column:
    """The N of "Rank N " at the start of a track's label, else null."""
    return F.nullif(F.regexp_extract(label, r"^\s*Rank (\d+) ", 1), F.lit("")).cast("int")


def coordinate(path: Column, name: str) -> Column:
    """The number after ``name`` in the file's name, where no letter or digit stands before it."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.nullif(F.regexp_extract(file, rf"(?:^|[^0-9A-Za-z]){name}(\d+)", 1), F.lit("")).cast("int")


def mesh_text(rank: Column, world: Column, path: Column) -> Column:
    """"rank 3/32 · tp3 pp0 dp0 ep3": the coordinates among the file name's parts; dcp only if it isn't 0."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    part = lambda n: F.nullif(F.regexp_extract(file, rf"(?:^|[_.]){n}(\d+)(?:[_.]|$)", 1), F.lit(""))
    parts = [F.concat(F.lit(n), part(n)) for n in ("tp", "pp", "dp", "ep")]
    mesh = F.concat_ws(" ", *parts, F.when(part("dcp") != "0", F.concat(F.lit("dcp"), part("dcp"))))
    r, w = rank.cast("string"), world.cast("string")
    head = (
        F.when((rank >= 0) & (world > 0), F.concat(F.lit("rank "), r, F.lit("/"), w))
        .when(rank >= 0, F.concat(F.lit("rank "), r))
        .when(world > 0, F.concat(w, F.lit(" ranks")))
    )
    return F.concat_ws(" · ", head, F.nullif(mesh, F.lit("")))


def kernel_base_name(name: Column) -> Column:
    """The identifier to look for: without "void ", template and parameter lists, and namespaces."""
    s = F.regexp_replace(F.trim(name), r"^void ", "")
    s = F.regexp_extract(s, r"^([^<(]*)", 1)
    return F.trim(F.regexp_extract(s, r"(?:.*::)?(.*)$", 1))


def kernel_family(name: Column) -> Column:
    """"torch", "external", "generic" or "other"."""
    n = F.trim(name)
    # fixed values: prefixes of names whose source is in torch, CUB or CUTLASS
    prefixes = ("aten::", "c10::", "c10d::", "void at::", "void c10::", "at::native::", "(anonymous namespace)::at::", "cub::", "cutlass")
    torch = F.lit(False)
    for p in prefixes:
        torch = torch | n.startswith(p)
    return F.when(torch, "torch").when(n.startswith("fmhaSm") & n.contains("Kernel_"), "external").when(n.isin("Kernel", "kernel"), "generic").otherwise("other")


def occupancy_limit(args: Column) -> Column:
    """The first limiting factor that the args name: (limit, suspect).

    Suspect are limits by shared memory where the block's shared memory is above 48 KiB.
    """
    limit = F.nullif(F.regexp_extract(args, r'"limitingFactors"\s*:\s*"([^"]*)"', 1), F.lit(""))
    shared = F.regexp_extract(args, r'"shared memory"\s*:\s*(\d+)', 1).cast("long")
    return F.struct(limit.alias("limit"), (F.contains(limit, F.lit("SMEM")) & (F.coalesce(shared, F.lit(0)) > 49152)).alias("suspect"))


def build_ref(version: Column) -> Column:
    """What a version string says about its build: struct(kind, value, dist), or null.

    "commit" for a ``+g<hex>`` suffix of 7 digits or more; "dev" for a distance
    ``.devN`` from the tag ``value``, stamped or not; "tag" for a plain release.
    """
    commit = F.regexp_extract(version, r"\+g([0-9a-fA-F]{7,})$", 1)
    plain = F.regexp_extract(version, r"^([^+]*)", 1)
    base = F.regexp_extract(plain, r"^(.+)\.dev(\d+)$", 1)
    dist = F.nullif(F.regexp_extract(plain, r"^(.+)\.dev(\d+)$", 2), F.lit("")).cast("int")
    v = F.trim(version)
    tag = v.rlike(r"^[0-9]") & v.contains(".") & ~v.contains("+") & ~v.contains(".dev")
    kind = F.when(commit != "", "commit").when(base != "", "dev").when(tag, "tag")
    value = F.when(commit != "", commit).when(base != "", base).when(tag, F.concat(F.lit("v"), v))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "dev", dist).alias("dist")))


def matches_build(ref: Column, describe: Column) -> Column:
    """Whether a repository's describe string is of the build."""
    far = F.concat(F.lit("-"), ref["dist"].cast("string"), F.lit("-g"))
    return F.when(ref["kind"] == "dev", F.contains(describe, far)).otherwise(F.contains(describe, ref["value"]))


def duration_text(ns: Column) -> Column:
    """0, or a number with ns, us, ms or s: whole nanoseconds, else one to three decimals."""
    n = ns.cast("double")
    return (
        F.when(ns == 0, "0")
        .when(F.abs(ns) < 1000, F.format_string("%dns", ns))
        .when(F.abs(ns) < 1_000_000, F.format_string("%.1fus", n / 1e3))
        .when(F.abs(ns) < 1_000_000_000, F.format_string("%.2fms", n / 1e6))
        .otherwise(F.format_string("%.3fs", n / 1e9))
    )
