"""Notebook corpora, rule cascades over texts, and file-shaped sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.functions import text
from modelwarden.operators import notebooks as nb
from modelwarden.plans.catalog import query
from modelwarden.plans.views import CELLS_SQL, cells, table, with_ctes
from modelwarden.session import work_dir
from modelwarden.sources import files


def _rx(p: str) -> str:
    return p.replace("'", "''")


def _any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{_rx(p)}')" for p in patterns) + ")"


_VALID = ", ".join(f"'{s}'" for s in nb.SECTIONS)
_TAG = r"(?m)^\s*#\s*mlops:\s*(\S+)"
_CLASS_CASES = " ".join(f"WHEN {_any('s', ps)} THEN '{name}'" for name, _, ps in nb.SECTION_RULES)
_CONF_CASES = " ".join(f"WHEN {_any('s', ps)} THEN {conf}" for _, conf, ps in nb.SECTION_RULES)
_IMP = r"len(regexp_extract_all(s, '(?m)^[ \t]*(import |from \S+ import )')) * 2 > len(string_split(s, chr(10)))"
_SECTIONS_SQL = CELLS_SQL + rf""",
code AS (SELECT *, trim(source, ' ' || chr(10) || chr(9) || chr(13)) AS s, lower(regexp_extract(source, '{_TAG}', 1)) AS tag FROM cells WHERE cell_type = 'code'),
man AS (SELECT notebook, arg_min(source, index) AS src FROM code WHERE regexp_matches(source, '(?m)^\s*#\s*mlops:\s*manifest') GROUP BY 1),
sizes AS (SELECT notebook, count(*) AS n FROM cells GROUP BY 1),
ent AS (SELECT notebook, unnest(regexp_extract_all(src, '(?m)^\s*#\s*cell\s+(\d+)(?:\s*-\s*(\d+))?\s*:\s*(\S+)', 1)) AS a,
          unnest(regexp_extract_all(src, '(?m)^\s*#\s*cell\s+(\d+)(?:\s*-\s*(\d+))?\s*:\s*(\S+)', 2)) AS b,
          lower(unnest(regexp_extract_all(src, '(?m)^\s*#\s*cell\s+(\d+)(?:\s*-\s*(\d+))?\s*:\s*(\S+)', 3))) AS section FROM man),
rng AS (SELECT notebook, section, CAST(a AS BIGINT) AS lo, CASE WHEN coalesce(b, '') = '' THEN CAST(a AS BIGINT) ELSE CAST(b AS BIGINT) END AS hi FROM ent WHERE section IN ({_VALID})),
m AS (SELECT code.notebook, code.index, rng.section, 1.0::DOUBLE AS confidence, source FROM code JOIN rng ON code.notebook = rng.notebook AND code.index BETWEEN lo AND hi AND lo < (SELECT n FROM sizes WHERE sizes.notebook = rng.notebook)),
t AS (SELECT notebook, index, tag AS section, 1.0::DOUBLE AS confidence, source FROM code WHERE tag IN ({_VALID})),
i AS (SELECT notebook, index, CASE WHEN {_IMP} THEN 'imports' {_CLASS_CASES} ELSE 'unknown' END AS section,
        CAST(CASE WHEN {_IMP} THEN 0.95 {_CONF_CASES} ELSE 0.0 END AS DOUBLE) AS confidence, source FROM code WHERE s <> ''),
modes AS (SELECT DISTINCT notebook, CASE WHEN notebook IN (SELECT notebook FROM m) THEN 'manifest' WHEN notebook IN (SELECT notebook FROM t) THEN 'blueprint' ELSE 'inferred' END AS mode FROM cells),
sec AS (SELECT 'manifest' AS mode, * FROM m UNION ALL SELECT 'blueprint', * FROM t UNION ALL SELECT 'inferred', * FROM i WHERE section <> 'unknown'),
sections AS (SELECT sec.* FROM sec JOIN modes ON sec.notebook = modes.notebook AND sec.mode = modes.mode)"""


@query("notebook_tags", with_ctes(_SECTIONS_SQL) + "SELECT notebook, index, section, confidence FROM t")
def notebook_tags(spark, sf):
    return nb.tagged_cells(cells(spark, sf)).select("notebook", "index", "section", "confidence")


@query("notebook_manifest", with_ctes(_SECTIONS_SQL) + "SELECT notebook, index, section, confidence FROM m")
def notebook_manifest(spark, sf):
    return nb.manifest_cells(cells(spark, sf)).select("notebook", "index", "section", "confidence")


@query("notebook_inferred", with_ctes(_SECTIONS_SQL) + "SELECT notebook, index, section, confidence FROM i WHERE section <> 'unknown'")
def notebook_inferred(spark, sf):
    return nb.inferred_cells(cells(spark, sf)).select("notebook", "index", "section", "confidence")


@query("notebook_sections", with_ctes(_SECTIONS_SQL) + "SELECT notebook, mode, index, section, confidence FROM sections")
def notebook_sections(spark, sf):
    return nb.section_cells(cells(spark, sf)).select("notebook", "mode", "index", "section", "confidence")


@query("section_confidence", with_ctes(_SECTIONS_SQL, """
a AS (SELECT notebook, mode, section, count(*) AS n_cells, avg(confidence) AS c FROM sections GROUP BY 1, 2, 3)""") + """
SELECT notebook, mode, section, n_cells, round(c, 9) AS avg_confidence, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.8 THEN 'medium' ELSE 'low' END AS level FROM a""")
def section_confidence(spark, sf):
    out = nb.section_confidence(nb.section_cells(cells(spark, sf)))
    return out.withColumn("avg_confidence", F.round("avg_confidence", 9))


_METRICS = ", ".join(f"CASE WHEN bool_or({_any('source', [p])}) THEN '{n}' END" for n, p in nb.METRIC_PATTERNS.items())
_MODELS = " ".join(f"WHEN bool_or({_any('source', [p])}) THEN '{n}'" for n, p in nb.MODEL_PATTERNS.items())


@query("notebook_structures", with_ctes(_SECTIONS_SQL, f"""
f AS (SELECT notebook, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM sections GROUP BY 1),
u AS (SELECT notebook, concat_ws(',', {_METRICS}) AS metrics, CASE {_MODELS} ELSE 'unknown' END AS model_type FROM code GROUP BY 1)""") + """
SELECT modes.notebook, mode, coalesce(sections, '') AS sections,
  concat_ws(',', CASE WHEN NOT contains(',' || coalesce(sections, '') || ',', ',training,') THEN 'training' END,
    CASE WHEN NOT contains(',' || coalesce(sections, '') || ',', ',metrics,') THEN 'metrics' END) AS missing_sections,
  coalesce(metrics, '') AS metrics, coalesce(model_type, 'unknown') AS model_type
FROM modes LEFT JOIN f USING (notebook) LEFT JOIN u USING (notebook)""")
def notebook_structures(spark, sf):
    out = nb.structures(cells(spark, sf))
    for c in ("sections", "missing_sections", "metrics"):
        out = out.withColumn(c, F.array_join(c, ","))
    return out


@query("notebook_warnings", with_ctes(_SECTIONS_SQL, """
has AS (SELECT modes.notebook, modes.mode, coalesce(bool_or(section = 'training'), false) AS tr, coalesce(bool_or(section = 'metrics'), false) AS me
        FROM modes LEFT JOIN sections ON modes.notebook = sections.notebook GROUP BY 1, 2)""") + """
SELECT notebook, 'Missing required sections: ' || concat_ws(', ', CASE WHEN NOT tr THEN 'training' END, CASE WHEN NOT me THEN 'metrics' END) AS warning FROM has WHERE mode <> 'inferred' AND NOT (tr AND me)
UNION ALL SELECT notebook, 'No # mlops: tags found. Structure inferred from code patterns.' FROM has WHERE mode = 'inferred'
UNION ALL SELECT notebook, '  Could not detect training logic - add # mlops: training tag' FROM has WHERE mode = 'inferred' AND NOT tr
UNION ALL SELECT notebook, '  Could not detect metrics - add # mlops: metrics tag' FROM has WHERE mode = 'inferred' AND NOT me""")
def notebook_warnings(spark, sf):
    return nb.mode_warnings(nb.structures(cells(spark, sf)))


@query("section_warnings", with_ctes(_SECTIONS_SQL, """
a AS (SELECT notebook, section, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS ids, avg(confidence) AS c FROM sections WHERE mode = 'inferred' GROUP BY 1, 2)""") + """
SELECT notebook, section, CAST(0 AS BIGINT) AS page, '  ' || section || ': cells ' || ids || ' (confidence: ' || CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.8 THEN 'medium' ELSE 'low' END || ')' AS warning FROM a""")
def section_warnings(spark, sf):
    return nb.section_warnings(nb.section_cells(cells(spark, sf)))


@query("section_code", with_ctes(_SECTIONS_SQL) + """
SELECT notebook, section, CAST(0 AS BIGINT) AS page, string_agg(source, chr(10) || chr(10) ORDER BY index) AS code FROM sections GROUP BY 1, 2""")
def section_code(spark, sf):
    return nb.section_code(nb.section_cells(cells(spark, sf)))


_LINES_SQL = """
raw AS (SELECT notebook, trim(unnest(string_split(source, chr(10)))) AS line FROM cells WHERE cell_type = 'code'),
imp AS (SELECT DISTINCT notebook, line FROM raw WHERE (line LIKE 'import %' OR line LIKE 'from %') AND NOT (line LIKE '%IPython%' OR line LIKE '%display%' OR line LIKE '%widgets%' OR line LIKE '%matplotlib%'))"""


@query("import_lines", with_ctes(CELLS_SQL, _LINES_SQL) + "SELECT notebook, line FROM imp")
def import_lines(spark, sf):
    return nb.import_lines(cells(spark, sf))


_PKG_CASE = "CASE root " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nb.PACKAGES.items()) + " ELSE root END"
_STD = ", ".join(f"'{m}'" for m in nb.STDLIB)


@query("requirements", with_ctes(CELLS_SQL, _LINES_SQL, """
r AS (SELECT notebook, split_part(regexp_extract(line, '^(?:from|import)\\s+(\\S+)', 1), '.', 1) AS root FROM imp)""") + f"""
SELECT DISTINCT notebook, {_PKG_CASE} AS package FROM r WHERE root <> '' AND root NOT IN ({_STD})""")
def requirements(spark, sf):
    return nb.requirements(cells(spark, sf))


TEXT_RULES = [
    ("contact", 0.9, [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?\d{3}[- ]\d{3}[- ]\d{4}"]),
    ("license", 0.85, [r"[Ll]icen[sc]e", r"[Cc]opyright"]),
    ("link", 0.8, [r"https?://"]),
    ("number", 0.6, [r"\d{4,}"]),
]
_TEXT_CASE = " ".join(f"WHEN {_any('text', ps)} THEN '{n}'" for n, _, ps in TEXT_RULES)
_TEXT_CONF = " ".join(f"WHEN {_any('text', ps)} THEN {c}" for _, c, ps in TEXT_RULES)


@query("rule_cascade", f"""
SELECT doc_id, CASE {_TEXT_CASE} ELSE 'unknown' END AS label, CAST(CASE {_TEXT_CONF} ELSE 0.0 END AS DOUBLE) AS confidence FROM documents""")
def rule_cascade(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", nb.rule_cascade(F.col("text"), TEXT_RULES).alias("r")).select("doc_id", "r.label", "r.confidence")


@query("page_cascade", """
SELECT page_id, CASE WHEN regexp_matches(html, '<table') THEN 'table' WHEN regexp_matches(html, '<pre') THEN 'code' WHEN regexp_matches(html, '<script') THEN 'script' ELSE 'unknown' END AS label FROM pages""")
def page_cascade(spark, sf):
    rules = [("table", 0.9, ["<table"]), ("code", 0.9, ["<pre"]), ("script", 0.5, ["<script"])]
    return table(spark, sf, "pages").select("page_id", nb.rule_cascade(F.col("html"), rules)["label"].alias("label"))


# --- files and messages ---------------------------------------------------------------------------
_EXTS = [".csv", ".parquet", ".json", ".jsonl", ".txt", ".tar.gz", ".csv.bak"]
_EXT_SQL = "list_extract([" + ", ".join(f"'{e}'" for e in _EXTS) + f"], CAST(page_id % {len(_EXTS)} AS INTEGER) + 1)"


def _uploads(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("page_id") % len(_EXTS)).cast("int") + 1)
    return table(spark, sf, "pages").select(
        F.lit("bkt").alias("bucket"), F.concat(F.lit("in/v1.2/page_"), F.col("page_id").cast("string"), ext).alias("name"),
        F.lit(None).cast("string").alias("contentType"), F.length("html").cast("bigint").alias("size"))


@query("file_arrivals", f"""
SELECT 'page_' || CAST(page_id AS VARCHAR) AS dataset_name, 'gs://bkt/in/v1.2/page_' || CAST(page_id AS VARCHAR) || {_EXT_SQL} AS dataset_uri, '' AS content_type,
  CAST(length(html) AS BIGINT) AS size_bytes, 'gcs_upload' AS trigger FROM pages WHERE page_id % {len(_EXTS)} < 4""")
def file_arrivals(spark, sf):
    return files.arrivals(_uploads(spark, sf))


_ART = [".pkl", ".joblib", ".pt", ".onnx", ".h5", ".json", ".log", ""]
_ART_SQL = "list_extract([" + ", ".join(f"'{e}'" for e in _ART) + f"], CAST(p_partkey % {len(_ART)} AS INTEGER) + 1)"


@query("artifact_inventory", f"""
SELECT artifact_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes, min(key) AS first_key FROM (
  SELECT CASE WHEN p_partkey % 8 < 5 THEN 'model' WHEN p_partkey % 8 = 5 THEN 'metrics' ELSE 'logs' END AS artifact_type, p_size,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 's3://other/' END || 'job' || CAST(p_partkey % 7 AS VARCHAR) || '/p' || CAST(p_partkey AS VARCHAR) || {_ART_SQL} AS key FROM part) GROUP BY 1""")
def artifact_inventory(spark, sf):
    ext = F.element_at(F.array(*[F.lit(e) for e in _ART]), (F.col("p_partkey") % len(_ART)).cast("int") + 1)
    root = F.when(F.col("p_partkey") % 3 == 0, "s3://out/").otherwise("s3://other/")
    listing = table(spark, sf, "part").select(
        F.concat(root, F.lit("job"), (F.col("p_partkey") % 7).cast("string"), F.lit("/p"), F.col("p_partkey").cast("string"), ext).alias("path"),
        F.col("p_size").cast("bigint").alias("size_bytes"))
    out = files.artifacts(listing, "s3://out/")
    return out.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.min("key").alias("first_key"))


@query("message_decode", """
SELECT event_id, event_type AS dataset_name, CAST(user_id AS BIGINT) AS size_bytes, 'push' AS trigger FROM events""")
def message_decode(spark, sf):
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("dataset_name"), F.col("user_id").alias("size_bytes"), F.lit("push").alias("trigger")))
    messages = e.select("event_id", F.base64(body.cast("binary")).alias("data"))
    return files.decode_messages(messages).select("event_id", "dataset_name", "size_bytes", "trigger")


@query("notebook_files", """
SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS notebook, 0 AS index, CASE WHEN role = 'system' THEN 'markdown' ELSE 'code' END AS cell_type, text AS source, role AS tags FROM conversations
UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 1, 'code', 'end', '' FROM conversations""")
def notebook_files(spark, sf):
    """One JSON document per turn, its lines as source lines, then parsed back to cells."""
    c = table(spark, sf, "conversations")
    parts = F.split("text", "\n", -1)
    lines = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    cell = F.struct(F.when(F.col("role") == "system", "markdown").otherwise("code").alias("cell_type"), lines.alias("source"),
                    F.struct(F.array("role").alias("tags")).alias("metadata"))
    second = F.lit('{"source": "end"}')
    docs = c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("path"),
        F.concat(F.lit('{"nbformat": 4, "cells": ['), F.to_json(cell), F.lit(", "), second, F.lit("]}")).alias("content"))
    return files.notebook_cells(docs).withColumn("tags", F.array_join("tags", ","))


@query("metric_files", """
SELECT 'm' || CAST(s_nationkey AS VARCHAR) AS model, metric, round(avg(v), 6) AS mean_value FROM (
  SELECT s_nationkey, 'f1' AS metric, s_acctbal / 10000 AS v FROM supplier UNION ALL SELECT s_nationkey, 'n', s_suppkey FROM supplier) GROUP BY 1, 2""")
def metric_files(spark, sf):
    """Metrics are written as JSON text files and read back as maps."""
    path = work_dir(spark, "metrics")
    s = table(spark, sf, "supplier")
    s.select(F.to_json(F.struct(
        F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("model"), (F.col("s_acctbal") / 10000).alias("f1"),
        F.col("s_suppkey").cast("double").alias("n"))).alias("value")).write.text(path)
    docs = spark.read.text(path)
    long = docs.select(F.get_json_object("value", "$.model").alias("model"),
                       F.explode(F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: k != "model")).alias("metric", "v"))
    return long.groupBy("model", "metric").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean_value"))


@query("metric_artifacts", """
SELECT CAST(s_nationkey AS BIGINT) AS model, 'metrics' AS artifact_type, CAST(count(*) AS DOUBLE) AS n, CAST(sum(s_suppkey) AS DOUBLE) AS total,
  CAST(length('{"n":' || CAST(count(*) AS VARCHAR) || ',"total":' || CAST(sum(s_suppkey) AS VARCHAR) || '}') + 1 AS BIGINT) AS size_bytes FROM supplier GROUP BY s_nationkey""")
def metric_artifacts(spark, sf):
    """A metrics file per model on disk, listed as artifacts and read back as maps."""
    path = work_dir(spark, "models")
    per = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("total"))
    per.write.partitionBy("model").json(path)
    model = F.regexp_extract("path", r"model=(\d+)", 1).cast("bigint").alias("model")
    listed = files.artifacts(files.listing(spark, path, "*.json")).select(model, "artifact_type", "size_bytes")
    read = files.metric_files(spark, path, "*.json").select(model, F.col("metrics")["n"].alias("n"), F.col("metrics")["total"].alias("total"))
    return listed.join(read, "model")


@query("path_functions", """
SELECT page_id, split_part(split_part(url, '/', 3), '/', 1) AS bucket, regexp_extract(url, '^[A-Za-z0-9+.-]+://[^/]+/(.*)$', 1) AS key, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages""")
def path_functions(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.uri_bucket(u).alias("bucket"), text.uri_key(u).alias("key"), text.basename(u).alias("base"))


