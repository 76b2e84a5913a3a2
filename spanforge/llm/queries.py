"""The registered query of each corpus operator, over its whole table, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import decontaminate, interpolate, knn, lexical, licences, manifest, merkle, mixing, pii, quality, simhash, toolcalls, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.scan(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate.score(table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*toolcalls.calls_of(table(spark, sf_dir, "conversations")))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = manifest.manifest(docs, manifest.tampered(docs["doc_id"], docs["text"]))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_products(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    found = (op1_decontamination, op2_toxicity, op3_merkle_fingerprints, op4_simhash, op5_mixing, op6_pii, op7_quality, op8_licences, op9_interpolation, op10_tool_calls, op11_manifest, op12_topk_products, op13_lexical_search)
    return {f.__name__: f for f in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), '{U}', '{L}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".replace("{U}", UPPER).replace("{L}", LOWER)

OP1 = f"""WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {SPLIT} AS w FROM benchmark
), ip AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM iw WHERE len(w) > 0
), ig AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM ip
), lens AS (SELECT DISTINCT n FROM ig
), dw AS (SELECT doc_id, {SPLIT} AS w FROM documents
), dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw
), dg AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dp, lens WHERE p + n - 1 <= len(w)
), hit AS (SELECT DISTINCT doc_id, p, n, item FROM dg JOIN ig USING (n, g)
), pos AS (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)
), nh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM pos GROUP BY doc_id
), ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id"""

DRAW = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
COPIES = "CAST(floor(rate) AS BIGINT) + CASE WHEN {draw} < rate - floor(rate) THEN 1 ELSE 0 END"
OP5 = f"""WITH sz AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sz GROUP BY source
), wt AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM src
), lv AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS lvl
  FROM wt WINDOW f AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM (SELECT *, least(cap::DOUBLE, max(lvl) OVER () * w) AS target FROM lv)
), seeds AS (SELECT unnest(range({mixing.SEEDS})) AS k
), tried AS (
  SELECT g.source, k, abs(sum(size * ({COPIES.format(draw=DRAW.format(k="k"))})) - max(target)) AS off FROM sz JOIN goal g ON sz.source IS NOT DISTINCT FROM g.source CROSS JOIN seeds GROUP BY g.source, k
), best AS (SELECT source, arg_min(k, struct_pack(a := off, b := k)) AS seed FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * ({COPIES.format(draw=DRAW.format(k="seed"))}) ELSE 0 END AS BIGINT) AS taken
FROM sz JOIN goal g ON sz.source IS NOT DISTINCT FROM g.source JOIN best b ON sz.source IS NOT DISTINCT FROM b.source"""


def _plain(text: str) -> str:
    quoted = lambda p: p.replace("\\n", "\n").replace("'", "''")
    t = f"translate({text}, '{UPPER}', '{LOWER}')"
    for a, b in licences.SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({t}, '{quoted(licences.COPYRIGHT)}', '\\1', 'g'), '{licences.MARKS}', ' ', 'g')"


def _one_line(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"


PARTS = f"list_filter(list_transform(string_split_regex({{p}}, '{licences.PARTING.replace(chr(92) + 'n', chr(10))}'), lambda x: {_one_line('x')}), lambda x: x <> '')"
VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licences.entries())
LONG = ", ".join(f"('{d}', '{n}')" for n, d in licences.DIGESTS)
OP8 = f"""WITH texts AS (SELECT licence, {_plain("text")} AS p FROM (VALUES {VALUES}) v(licence, text)
), known AS (SELECT sha256({_one_line("p")}) AS digest, min(licence) AS licence FROM texts GROUP BY 1 UNION ALL SELECT * FROM (VALUES {LONG}) v(digest, licence)
), sizes AS (SELECT DISTINCT len({PARTS.format(p="p")}) AS k FROM texts
), d AS (SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, {_plain("coalesce(text, '')")} AS p FROM documents
), ln AS (SELECT doc_id, sha256(trim(unnest(string_split(p, chr(10))))) AS digest FROM d
), pa AS (SELECT doc_id, {PARTS.format(p="p")} AS w FROM d
), ru AS (SELECT doc_id, sha256(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS digest FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pa, sizes WHERE len(w) >= k)
), lf AS (SELECT doc_id, count(*) AS n FROM ln JOIN known USING (digest) GROUP BY doc_id
), rf AS (SELECT doc_id, count(*) AS n FROM ru JOIN known USING (digest) GROUP BY doc_id
), nm AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM (SELECT * FROM ln UNION ALL SELECT * FROM ru) JOIN known USING (digest) GROUP BY doc_id
), w AS (SELECT doc_id, n_lines, sha256({_one_line("p")}) AS text_sha256 FROM d)
SELECT w.doc_id, n_lines, text_sha256, k.licence, coalesce(lf.n, 0) AS n_licence_lines, coalesce(rf.n, 0) AS n_licence_blocks, coalesce(licences, '') AS licences
FROM w LEFT JOIN known k ON k.digest = text_sha256 LEFT JOIN lf ON lf.doc_id = w.doc_id LEFT JOIN rf ON rf.doc_id = w.doc_id LEFT JOIN nm ON nm.doc_id = w.doc_id"""

IDENT = "md5(CAST(conv_id AS VARCHAR) || ':' || CAST({t} AS VARCHAR))"
OP10 = f"""WITH RECURSIVE calls AS (
  SELECT conv_id, turn, {IDENT.format(t="turn")} AS call_id, text, length(text) AS n, CASE WHEN turn >= 2 THEN {IDENT.format(t="turn - 2")} END AS after FROM conversations WHERE role = 'user'
), res AS (SELECT conv_id, turn AS result_turn, {IDENT.format(t="turn - 1")} AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), dep AS (
  SELECT conv_id, call_id, 0::BIGINT AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL SELECT c.conv_id, c.call_id, dep.depth + 1 FROM calls c JOIN dep ON c.conv_id = dep.conv_id AND c.after = dep.call_id
), c2 AS (
  SELECT calls.*, depth, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'measure' END AS name,
    CASE n % 3 WHEN 0 THEN '{{"limit":' || (n % 10) || ',"query":' || to_json(text) || '}}' WHEN 1 THEN '{{"exact":' || (n % 2 = 0) || ',"key":' || to_json(text) || '}}'
      ELSE '{{"text":' || to_json(text) || ',"unit":"' || CASE WHEN n % 2 = 0 THEN 'words' ELSE 'characters' END || '"}}' END AS args,
    CASE WHEN n % 3 = 0 THEN concat_ws('; ', CASE WHEN n % 10 < 1 THEN '$.limit: below minimum' END, CASE WHEN n % 10 > 8 THEN '$.limit: above maximum' END, CASE WHEN n < 20 THEN '$.query: too short' END) ELSE '' END AS faults
  FROM calls JOIN dep USING (conv_id, call_id))
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, name, depth, result_turn,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN faults <> '' THEN 'bad arguments' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status, coalesce(faults, '') AS faults,
  '{{' || CASE WHEN after IS NOT NULL THEN '"after":"' || after || '",' ELSE '' END || CASE WHEN c.call_id IS NOT NULL THEN '"arguments":' || args || ',' ELSE '' END || '"id":"' || coalesce(c.call_id, r.call_id) || '"'
    || CASE WHEN c.call_id IS NOT NULL THEN ',"name":"' || name || '"' ELSE '' END || CASE WHEN r.call_id IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}}' AS json
FROM c2 c FULL JOIN res r ON c.conv_id = r.conv_id AND c.call_id = r.call_id"""


# crc32 of the id's digits, a bit at a time: a byte is mixed in, then eight -1 shift
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
FIELD = "coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
LEAF = " || ".join(FIELD.format(c=c) for c in manifest.FIELDS)
LEVELS = 8  # of 16 children: more than the test tables need


def _risen(name: str) -> str:
    """Nodes of each level above ``name`` 0, (g, pos, n, d), where groups of one node stay as they are."""
    return ", ".join(
        f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d FROM {name}{k} GROUP BY g, pos // 16, n)" for k in range(LEVELS)
    )


def _folded(name: str, rows: str) -> str:
    """Of (id, g, pos, now, held) one level up for each level of ``name``: what the siblings make of it, and the siblings."""
    parts, last = [], rows
    for k in range(LEVELS):
        parts.append(f"""{rows}{k} AS (SELECT f.id, f.g, f.pos // 16 AS pos, CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.pos = f.pos THEN f.now ELSE l.d END, '' ORDER BY l.pos)) ELSE any_value(f.now) END AS now,
  any_value(f.held) || coalesce(string_agg(l.d, '' ORDER BY l.pos) FILTER (l.pos <> f.pos), '') AS held FROM {last} f JOIN {name}{k} l ON l.g = f.g AND l.pos // 16 = f.pos // 16 GROUP BY f.id, f.g, f.pos)""")
        last = f"{rows}{k}"
    return ", ".join(parts)


OP11 = f"""WITH rows AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS g, sha256({LEAF}) AS d,
  CASE WHEN {CRC} % 5 = 0 THEN sha256({LEAF.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256({LEAF}) END AS t FROM documents
), nd0 AS (SELECT id, doc_id, g, d, t, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows
), {_risen("nd")}, tp0 AS (SELECT '' AS g, g AS source, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nd{LEVELS}
), {_risen("tp")}, fl AS (SELECT id, g, pos, t AS now, '' AS held FROM nd0
), {_folded("nd", "fl")}, ft AS (SELECT f.id, '' AS g, tp0.pos, f.now, f.held FROM fl{LEVELS - 1} f JOIN tp0 ON tp0.source = f.g
), {_folded("tp", "ft")}
SELECT doc_id, nd0.d AS leaf, tp0.d AS subroot, root.d AS root, sha256(held) AS proof_sha256, now AS folded_root, now = root.d AS verified
FROM nd0 JOIN tp0 ON tp0.source = nd0.g JOIN ft{LEVELS - 1} f ON f.id = nd0.id, tp{LEVELS} root"""

OP12 = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5"""

OP13 = f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {SPLIT} AS w FROM documents
), st AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM dw
), tf AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM dw) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), it AS (SELECT DISTINCT item_id, unnest({SPLIT}) AS term FROM benchmark
), sc AS (
  SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM it JOIN df USING (term) JOIN tf USING (term), st GROUP BY item_id, r, doc_id
), rk AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """The others hash by XXH64, read code-point spans of patterns, or train: SQL can't follow, and brute force tests them."""
    return {"op1_decontamination": OP1, "op5_mixing": OP5, "op8_licences": OP8, "op10_tool_calls": OP10, "op11_manifest": OP11, "op12_topk_products": OP12, "op13_lexical_search": OP13}
