"""Dependency manifests as tables: `lockfiles(project, path, content)` in, `(project, ord, ecosystem, name, version)` out."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import normalize_name

DEPENDENCY = ("project", "ecosystem", "name", "version")
LARGEST = 5 * 1024 * 1024
INCLUDE_DEPTH = 3
#: Python manifests in the order in which the first that exists is taken.
PRECEDENCE = ("uv.lock", "poetry.lock", "Pipfile.lock", "requirements.txt")


def npm_lock(lockfiles: DataFrame) -> DataFrame:
    """Exact versions of a lockfile's flat map of installed packages; the root and odd entries are left out."""
    body = F.from_json("content", "struct<packages:map<string,string>>")["packages"]
    rows = lockfiles.where(F.col("path").endswith("package-lock.json")).select("project", F.explode(body).alias("place", "raw"))
    info = F.from_json("raw", "struct<name:string,version:string>")
    by_place = F.nullif(F.regexp_extract("place", r"(?s)^.*node_modules/(.+)$", 1), F.lit(""))
    named = rows.where((F.col("place") != "") & F.ltrim("raw").startswith("{")).select("project", F.coalesce(F.nullif(info["name"], F.lit("")), by_place).alias("name"), info["version"].alias("version"))
    return named.where("name is not null and version is not null").select("project", F.lit("npm").alias("ecosystem"), "name", "version").distinct()


def package_ranges(manifests: DataFrame) -> DataFrame:
    """Declared ranges of package.json; a development dependency of the same name wins."""
    fields = F.from_json("content", "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    own = manifests.where(F.element_at(F.split("path", "/"), -1) == "package.json")
    every = None
    for rank, part in enumerate(("dependencies", "devDependencies")):
        rows = own.select("project", F.lit(rank).alias("rank"), F.explode(fields[part]).alias("name", "version"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("project", "name").agg(F.max_by("version", "rank").alias("version")).select("project", F.lit("npm").alias("ecosystem"), "name", "version")


def npm_dependencies(files: DataFrame) -> DataFrame:
    """Of the lockfile, or of package.json for projects whose lockfile names no packages."""
    locked = npm_lock(files)
    return locked.unionByName(package_ranges(files).join(locked.select("project").distinct(), "project", "left_anti"))


def lifecycle_scripts(meta: DataFrame) -> DataFrame:
    """Install steps of package.json whose value is a text; numbers and lists are no commands."""
    v = F.try_parse_json("package_json")
    steps = []
    for step in ("preinstall", "install", "postinstall"):
        x = F.try_variant_get(v, f"$.scripts.{step}", "variant")
        steps.append(F.when(F.schema_of_variant(x) == "STRING", F.struct(F.lit(step).alias("step"), F.try_variant_get(v, f"$.scripts.{step}", "string").alias("command"))))
    return meta.select("ecosystem", "package", "version", F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("ecosystem", "package", "version", "s.step", "s.command")


def _toml_packages(content: str, kind: str) -> list[tuple[str, str]]:
    """(name, version) of the packages of a TOML lockfile that come from a registry."""
    try:
        entries = tomllib.loads(content).get("package", [])
    except tomllib.TOMLDecodeError:
        return []
    out = []
    for e in entries if isinstance(entries, list) else ():
        source = e.get("source") if isinstance(e, dict) else None
        registry = isinstance(source, dict) and "registry" in source if kind == "uv.lock" else source is None or isinstance(source, dict) and source.get("type") in ("legacy", "pypi")
        if isinstance(e, dict) and registry and isinstance(e.get("name"), str) and isinstance(e.get("version"), str):
            out.append((e["name"], e["version"]))
    return out


def toml_lock(lockfiles: DataFrame, kind: str) -> DataFrame:
    """uv.lock or poetry.lock; TOML has no reader in Spark, so this much is Python."""
    read = F.udf(lambda c: _toml_packages(c, kind), "array<struct<name:string,version:string>>", useArrow=True)
    rows = lockfiles.where((F.element_at(F.split("path", "/"), -1) == kind) & (F.octet_length("content") <= LARGEST))
    return rows.select("project", F.explode(read("content")).alias("p")).select("project", F.lit("pypi").alias("ecosystem"), normalize_name("p.name").alias("name"), F.col("p.version").alias("version")).distinct()


def pipfile_lock(lockfiles: DataFrame) -> DataFrame:
    """Pinned packages of both sections."""
    body = F.from_json("content", "struct<default:map<string,struct<version:string>>,develop:map<string,struct<version:string>>>")
    own = lockfiles.where((F.element_at(F.split("path", "/"), -1) == "Pipfile.lock") & (F.octet_length("content") <= LARGEST))
    rows = own.select("project", F.explode(body["default"]).alias("name", "e")).unionByName(own.select("project", F.explode(body["develop"]).alias("name", "e")))
    return rows.where(F.col("e.version").startswith("==")).select("project", F.lit("pypi").alias("ecosystem"), normalize_name("name").alias("name"), F.regexp_replace("e.version", "^==", "").alias("version")).distinct()


def requirement_lines(files: DataFrame) -> DataFrame:
    """Logical lines of requirements files: continuations joined, comments and white space removed."""
    joined = F.regexp_replace("content", r"\\\r?\n", " ")
    rows = files.where(F.octet_length("content") <= LARGEST).select("project", "path", F.explode(F.split(joined, r"\r?\n")).alias("raw"))
    return rows.select("project", "path", F.trim(F.regexp_replace("raw", r"(^|\s)#.*$", "")).alias("spec")).where("spec <> ''")


def requirements(files: DataFrame) -> DataFrame:
    """Pins, ranges and unpinned names of requirements files, with files they include from their own folder, three deep."""
    named = files.where(F.element_at(F.split("path", "/"), -1).rlike(r"^requirements.*\.txt$"))
    folder = lambda c: F.regexp_extract(c, r"^(.*/)?[^/]*$", 1)
    top = named.where(F.element_at(F.split("path", "/"), -1) == "requirements.txt")
    top = top.unionByName(named.join(top.select("project").distinct(), "project", "left_anti"))
    lines = requirement_lines(top)
    level = lines
    for _ in range(INCLUDE_DEPTH):
        wanted = F.regexp_extract("spec", r"^(?:-r|--requirement)[\s=]*(\S+)", 1)
        names = level.where((wanted != "") & ~wanted.rlike(r"(^|/)\.\.(/|$)|^/")).select("project", F.concat(folder(F.col("path")), F.regexp_replace(wanted, r"^(?:\./)+", "")).alias("path")).distinct()
        level = requirement_lines(files.join(names, ["project", "path"], "left_semi"))
        lines = lines.unionByName(level)
    spec = F.trim(F.regexp_replace(F.regexp_replace("spec", r"\s--hash[=\s].*$", ""), ";.*$", ""))
    rows = lines.select("project", spec.alias("spec")).where((F.col("spec") != "") & ~F.col("spec").rlike(r"^-|^\.{0,2}/|^\.|://|^git\+|@\s*(?:git|https?|file)"))
    tight = F.regexp_replace("spec", " ", "")
    name = F.regexp_extract(tight, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    after = F.regexp_replace(tight, r"^[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?", "")
    pin = F.regexp_extract(after, r"^={2,3}([^,*]+)$", 1)
    return rows.where(name != "").select("project", F.lit("pypi").alias("ecosystem"), normalize_name(name).alias("name"), F.when(pin != "", pin).when(after == "", "unpinned").otherwise(after).alias("version")).distinct()


def python_dependencies(files: DataFrame) -> DataFrame:
    """Of the first manifest in PRECEDENCE that a project has."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name.rlike(r"^requirements.*\.txt$"), len(PRECEDENCE) - 1).otherwise(F.array_position(F.array(*map(F.lit, PRECEDENCE)), name) - 1)
    best = files.select("project", rank.alias("rank")).where("rank >= 0").groupBy("project").agg(F.min("rank").alias("rank"))
    out = None
    for k, reader in enumerate((lambda f: toml_lock(f, "uv.lock"), lambda f: toml_lock(f, "poetry.lock"), pipfile_lock, requirements)):
        rows = reader(files.join(best.where(F.col("rank") == k).select("project"), "project", "left_semi"))
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve(files: DataFrame) -> DataFrame:
    """All dependencies: npm before Python, each sorted by name and version."""
    both = npm_dependencies(files).unionByName(python_dependencies(files))
    place = Window.partitionBy("project").orderBy("ecosystem", "name", "version")
    return both.withColumn("ord", (F.row_number().over(place) - 1).cast("int"))


def oversized(files: DataFrame) -> DataFrame:
    """(project, path, error): manifests above the size limit, which no reader takes; a project that has one is not resolved."""
    name = F.element_at(F.split("path", "/"), -1)
    read = name.isin("package.json", *fixed.MANIFESTS) | name.rlike(r"^requirements.*\.txt$")
    return files.where(read & (F.octet_length("content") > LARGEST)).select("project", "path", F.concat("path", F.lit(" is larger than 5 MiB")).alias("error"))


def has_python_manifest(files: DataFrame) -> DataFrame:
    """Projects with a manifest of the Python registry."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.isin(*PRECEDENCE) | name.rlike(r"^requirements.*\.txt$")).select("project").distinct()


def manifest_uri(files: DataFrame) -> DataFrame:
    """(project, uri): the manifest that results without a file of their own are attached to."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*map(F.lit, fixed.MANIFESTS)), name)
    found = files.groupBy("project").agg(F.min_by(name, F.when(rank > 0, rank)).alias("uri"))
    return found.select("project", F.coalesce("uri", F.lit(fixed.MANIFESTS[0])).alias("uri"))


def read_policy(content: str, today=None) -> list[tuple]:
    """Ignore rules (ord, package, version, reason, expires, ecosystem) of a policy file; a clear error for anything odd."""
    import datetime

    try:
        entries = json.loads(content)
    except ValueError as e:
        raise ValueError(f"the policy is not JSON: {e}") from None
    if not isinstance(entries, list):
        raise ValueError("the policy must be a list of rules")
    out = []
    for k, e in enumerate(entries):
        if not isinstance(e, dict):
            raise ValueError(f"rule {k} is not an object")
        unknown = set(e) - {"package", "version", "reason", "expires", "ecosystem"}
        if unknown:
            raise ValueError(f"rule {k} has unknown fields: {', '.join(sorted(unknown))}")
        for f in ("package", "reason"):
            if not isinstance(e.get(f), str) or not e[f].strip():
                raise ValueError(f"rule {k} needs a {f}")
        if e.get("version") is not None and not isinstance(e["version"], str):
            raise ValueError(f"rule {k}: version must be text")
        if e.get("ecosystem") not in (None, "npm", "pypi"):
            raise ValueError(f"rule {k}: ecosystem must be npm or pypi")
        expires = None
        if e.get("expires") is not None:
            try:
                expires = datetime.date.fromisoformat(e["expires"])
            except (TypeError, ValueError):
                raise ValueError(f"rule {k}: expires must be a date") from None
        out.append((k, e["package"], e.get("version"), e["reason"], expires, e.get("ecosystem")))
    return out


POLICY = "ord int, package string, version string, reason string, expires date, ecosystem string"


def verify_integrity(artifacts: DataFrame) -> DataFrame:
    """`intact` for artifacts (content, integrity, shasum): the first known digest of the integrity text, else the SHA-1; none accepts."""
    from assayer.functions.text import unbroken_base64

    known = F.filter(F.split(F.trim(F.coalesce("integrity", F.lit(""))), r"\s+"), lambda x: x.rlike("^sha(?:512|384|256)-"))
    entry = F.get(known, F.lit(0))
    digest = lambda n: unbroken_base64(F.unhex(F.sha2("content", n)))
    expected = F.regexp_replace(F.substring(entry, 8, 1 << 20), r"\?.*$", "")
    by_entry = F.when(entry.startswith("sha512"), digest(512) == expected).when(entry.startswith("sha384"), digest(384) == expected).otherwise(digest(256) == expected)
    return artifacts.withColumn("intact", F.when(entry.isNotNull(), by_entry).when(F.col("shasum").isNotNull(), F.sha1("content") == F.lower("shasum")).otherwise(F.lit(True)))


def pick_artifacts(urls: DataFrame) -> DataFrame:
    """One source release and one wheel of each release: a pure wheel, else a Linux one, else the first. `yanked` if any file is."""
    key = ["ecosystem", "package", "version"]
    wheel = F.col("packagetype") == "bdist_wheel"
    rank = F.when(F.col("filename").endswith("-none-any.whl"), 0).when(F.col("filename").rlike("manylinux.*x86_64"), 1).otherwise(2)
    return urls.groupBy(*key).agg(
        F.min_by("filename", F.when(F.col("packagetype") == "sdist", F.col("ord"))).alias("sdist"),
        F.min_by("filename", F.when(wheel, F.struct(rank, F.col("ord")))).alias("wheel"),
        F.coalesce(F.bool_or("yanked"), F.lit(False)).alias("yanked"))


def age_days(published: Column, now: Column) -> Column:
    """Whole days since an ISO 8601 time; null if it is none."""
    at = F.try_to_timestamp(F.regexp_replace(published, "Z$", "+00:00"))
    return F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 86400).cast("int")
