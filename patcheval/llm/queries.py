"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patcheval.llm import (
    decontaminate, exact_dedup, license_scan, merkle, pii, quality, secret_scan, simhash, token_file, token_lengths, toxicity, vector_codes,
)
from patcheval.llm.common import table
from patcheval.llm.pieces import encode_and_decode


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file_report(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(table(spark, sf_dir, "documents"), key="registered query")


def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.limit_table(token_lengths.length_histogram(table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_leaf())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_license_scan, op3_sentencepiece, op4_token_files, op5_exact_dedup, op6_simhash, op7_secret_scan, op8_pii,
        op9_token_lengths, op10_decontaminate, op11_quality, op12_merkle, op13_vector_codes,
    )
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_sql() -> str:
    t = license_scan.THRESHOLD
    known = [(n, i, license_scan.template_bigrams(text)) for n, (i, text) in enumerate(license_scan.TEMPLATES)]
    grams = ", ".join(f"({n}, {_sql_text(i)}, {q}, {_sql_text(g)}, {len(b)}, {q in set(license_scan.anchors(b, t))})" for n, i, b in known for q, g in enumerate(b))
    laid = ", ".join(f"({n}, {s}, {m})" for n, _, b in known for s, m in license_scan.layouts(len(b), t))
    return f"""
WITH template AS (SELECT * FROM (VALUES {grams}) v(t, license_id, q, g, n, anchor)), layout AS (SELECT * FROM (VALUES {laid}) v(t, s, m)),
parts AS (SELECT t, license_id, n, g, count(*) AS k FROM template GROUP BY ALL),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
words AS (SELECT r, len(w) - 1 AS nb, generate_subscripts(w, 1) - 1 AS p, unnest(w) AS x FROM texts),
grams AS (SELECT r, nb, p, concat(x, ' ', lead(x) OVER (PARTITION BY r ORDER BY p)) AS g FROM words QUALIFY p < nb),
windows AS (SELECT DISTINCT r, t, n, license_id, greatest(p - q + s, 0) AS a, least(p - q + s + m, nb) AS b FROM grams JOIN template USING (g) JOIN layout USING (t) WHERE anchor),
fitting AS (SELECT * FROM windows WHERE b - a >= CASE WHEN n < {license_scan.SHORT} THEN n ELSE n * {t} / (2 - {t}) - 1e-9 END),
counted AS (SELECT f.r, f.t, f.n, f.license_id, a, b, grams.g, count(*) AS k FROM fitting f JOIN grams ON grams.r = f.r AND p >= a AND p < b GROUP BY ALL),
found AS (SELECT r, c.license_id, round(2 * sum(least(c.k, parts.k)) / (any_value(c.n) + b - a), 6) AS dice FROM counted c JOIN parts USING (t, g) GROUP BY r, t, c.license_id, a, b),
best AS (SELECT r, arg_min(license_id, struct_pack(d := -dice, i := license_id)) AS license_id, max(dice) AS dice,
  string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids FROM found WHERE dice >= {t} GROUP BY r)
SELECT doc_id, license_id, dice, coalesce(license_ids, '') AS license_ids FROM texts LEFT JOIN best USING (r)"""


def _merkle_sql() -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # a character, then eight shifts for its bits
    steps = "flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ord(substring(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"
    level = "SELECT lvl + 1, g, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM {0} WHERE n > 1 GROUP BY lvl, g, pos // 16, n"
    siblings = "SELECT a.lvl, a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {0} a JOIN {0} b ON a.lvl = b.lvl AND a.g = b.g AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.lvl, a.g, a.pos"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} ELSE {leaf("text")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM d),
nodes(lvl, g, pos, h, n) AS (SELECT 0, g, pos, leaf, count(*) OVER (PARTITION BY g) FROM leaves UNION ALL {level.format("nodes")}),
subroots AS (SELECT g, max(h) FILTER (n = 1) AS subroot, max(lvl) AS height FROM nodes GROUP BY g),
tops(lvl, g, pos, h, n) AS (SELECT 0, 0, g, subroot, count(*) OVER () FROM subroots UNION ALL {level.format("tops")}),
root AS (SELECT max(h) FILTER (n = 1) AS root FROM tops),
low AS ({siblings.format("nodes")}), high AS ({siblings.format("tops")}),
path AS (SELECT k, lvl AS step, l, r FROM leaves JOIN low ON low.g = leaves.g AND low.pos = leaves.pos // (16 ** low.lvl)::BIGINT
  UNION ALL SELECT k, height + lvl, l, r FROM leaves JOIN subroots USING (g) JOIN high ON high.pos = leaves.g // (16 ** high.lvl)::BIGINT),
proof AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY step)) AS p FROM path GROUP BY k),
fold(k, step, node) AS (SELECT k, 0, other FROM leaves UNION ALL SELECT fold.k, fold.step + 1, sha256(l || node || r) FROM fold JOIN path ON path.k = fold.k AND path.step = fold.step),
ends AS (SELECT k, arg_max(node, step) AS folded_root FROM fold GROUP BY k)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (g) JOIN ends USING (k) LEFT JOIN proof USING (k), root"""


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    steps = []
    near = "SELECT k, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT k, x.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM x JOIN book{r} b ON x.p = b.p) GROUP BY k, p, v"
    for r in range(rounds):
        steps.append(f"near{r} AS ({near.format(r=r)})")
        mean = "SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e"
        steps.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN ({mean.format(r=r)}) m ON b.p = m.p AND b.e = m.e)")
    return f"""
WITH kept AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT k, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
starts AS (SELECT k, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}),
book0 AS (SELECT p, e, v AS c FROM x JOIN starts USING (k)),
{", ".join(steps)}, last AS ({near.format(r=rounds)}),
codes AS (SELECT k, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY k),
books AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (k), books"""


SQL = {
    "op2_license_scan": _license_sql(),
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (SELECT s, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)""",
    "op10_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + n - 1], ' ') AS s, n FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
kinds AS (SELECT DISTINCT n FROM win),
seen AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, kinds WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM seen JOIN win USING (s, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_merkle": _merkle_sql(),
    "op13_vector_codes": _codes_sql(),
}
