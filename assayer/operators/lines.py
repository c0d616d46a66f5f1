"""Line rules over JavaScript source: one scan, one row per line, all rules in one projection.

Input `source_files(ecosystem, package, version, path, text)` with an optional `parsed` flag: where a syntax tree decided
about calls, the eval and command rules stay silent.  A file that matches no rule at all is dropped before it is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import dossier_key, excerpt, first_group, is_packed, matches, piece, severity_rank, signal_id

KEY = ("ecosystem", "package", "version", "path")

#: category -> (severity, what it means)
MEANING = {
    "eval-computed-arg": ("high", "code is run from an argument that is computed"),
    "command-exec-computed-arg": ("high", "a command is run from an argument that is computed"),
    "known-exfil-channel": ("high", "a channel that stolen data is known to leave through: web hook, paste service, bare address or hidden service"),
    "npm-self-publish-behavior": ("high", "publishes packages or touches the registry token, as self-spreading packages do"),
    "named-credential-env-read": ("high", "reads an environment variable that is named like a secret"),
    "bulk-env-enumeration": ("high", "enumerates the whole environment"),
    "packed-string-blob": ("medium", "a long string of high entropy, possibly a packed payload"),
    "sensitive-data-network-cooccurrence": ("high", "reads sensitive data and can reach the network in one file"),
    "ci-sandbox-evasion": ("high", "asks whether a build machine runs it and can reach the network in one file"),
}


def source_lines(files: DataFrame, ends: str = fixed.LINE_ENDS) -> DataFrame:
    """One row per line, numbered from 1; a last empty line is no line."""
    parts = F.split("text", ends, -1)
    lines = files.withColumn("_lines", parts).select(*[c for c in files.columns if c != "text"], F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", "line"))
    return lines.where(~((F.col("_pos") == F.col("_n") - 1) & (F.col("line") == ""))).withColumn("line_no", (F.col("_pos") + 1).cast("int")).drop("_n", "_pos")


def computed(pattern: str, argument: int = 2) -> Column:
    """The first match's argument does not start as a literal; no argument counts as computed."""
    return matches("line", pattern) & ~first_group("line", pattern, argument).rlike(fixed.LITERAL_START)


def _command() -> Column:
    """A computed command, unless it is a method named exec in a file that never imports child_process."""
    whole = r"^(.*?\b(?:child_process\.)?)(exec|execSync|spawn|spawnSync|execFile|execFileSync)\s*\(\s*(.*)"
    method = (first_group("line", whole, 2) == "exec") & F.regexp_replace(first_group("line", whole, 1), r"(?U)\s+$", "").endswith(".")
    return computed(fixed.COMMAND_CALL) & ~(method & ~F.col("imports_child_process"))


def line_rules(least_entropy: float = fixed.ENTROPY_LEAST) -> dict[str, Column]:
    blob = first_group("line", fixed.PACKED_STRING, 1)
    by_line = ~F.col("parsed")
    return {
        "eval-computed-arg": by_line & computed(fixed.EVAL_CALL),
        "command-exec-computed-arg": by_line & _command(),
        "known-exfil-channel": matches("line", fixed.EXFIL_CHANNEL, True),
        "npm-self-publish-behavior": matches("line", fixed.SELF_PUBLISH, True) | matches("line", fixed.NPMRC_TOKEN, True),
        "named-credential-env-read": matches("line", fixed.NAMED_CREDENTIAL),
        "bulk-env-enumeration": matches("line", fixed.BULK_ENVIRONMENT),
        "packed-string-blob": matches("line", fixed.PACKED_STRING) & is_packed(blob, least_entropy),
    }


FACTS = {"sensitive": fixed.SENSITIVE_READ, "network": fixed.NETWORK, "ci": fixed.CI_CHECK}


def _any_rule() -> Column:
    text = F.col("text")
    cased = "|".join(f"(?:{p})" for p in (fixed.EVAL_CALL, fixed.COMMAND_CALL, fixed.NAMED_CREDENTIAL, fixed.BULK_ENVIRONMENT, fixed.SENSITIVE_READ, fixed.NETWORK, fixed.CI_CHECK))
    free = "|".join(f"(?:{p})" for p in (fixed.EXFIL_CHANNEL, fixed.SELF_PUBLISH, fixed.NPMRC_TOKEN))
    low = F.lower(text)
    # what a match holds in any case; the patterns run on the few texts that hold one
    likely = F.lit(False)
    for word in fixed.RULE_WORDS:
        likely = likely | low.contains(word)
    return (likely & (matches(text, cased) | matches(text, free, True))) | matches(text, fixed.PACKED_STRING)


def hits(files: DataFrame) -> DataFrame:
    """(key, line_no, line, rule): every rule and fact that a line meets, from a single scan."""
    if "parsed" not in files.columns:
        files = files.withColumn("parsed", F.lit(False))
    lines = source_lines(files.where(_any_rule()).withColumn("imports_child_process", matches("text", fixed.CHILD_PROCESS_IMPORT)))
    every = {**line_rules(), **{f"fact:{k}": matches("line", p) for k, p in FACTS.items()}}
    met = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in every.items())), lambda x: x.isNotNull())
    return lines.select(*KEY, "line_no", "line", F.explode(met).alias("rule"))


def line_signals(found: DataFrame) -> DataFrame:
    """Signals with one piece of evidence for each line and rule."""
    rows = found.where(~F.col("rule").startswith("fact:"))
    blob = F.concat(F.substring(first_group("line", fixed.PACKED_STRING, 1), 1, fixed.BLOB_SHOWN), F.lit("..."))
    shown = F.when(F.col("rule") == "packed-string-blob", blob).otherwise(excerpt("line"))
    return _signals(rows, F.concat("path", F.lit(":"), F.col("line_no").cast("string")), F.array(piece(shown, F.col("path"), F.col("line_no"))))


def cooccurrence(found: DataFrame) -> DataFrame:
    """Files whose first sensitive read, or first build-machine check, meets a network call: one aggregation."""
    first = lambda k: F.min(F.when(F.col("rule") == f"fact:{k}", F.struct("line_no", "line")))
    files = found.where(F.col("rule").startswith("fact:")).groupBy(*KEY).agg(*(first(k).alias(k) for k in FACTS)).where("network is not null")
    ev = lambda k: piece(excerpt(F.col(f"{k}.line")), F.col("path"), F.col(f"{k}.line_no"))
    pairs = F.array(F.when(F.col("sensitive").isNotNull(), F.struct(F.lit("sensitive-data-network-cooccurrence").alias("rule"), F.array(ev("sensitive"), ev("network")).alias("evidence"))),
                    F.when(F.col("ci").isNotNull(), F.struct(F.lit("ci-sandbox-evasion").alias("rule"), F.array(ev("ci"), ev("network")).alias("evidence"))))
    rows = files.select(*KEY, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("p")).select(*KEY, "p.rule", "p.evidence")
    return _signals(rows, F.col("path"), F.col("evidence"))


def _signals(rows: DataFrame, discriminator: Column, evidence: Column) -> DataFrame:
    names = F.create_map(*(x for k, (s, d) in MEANING.items() for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(d).alias("description")))))
    meant = F.element_at(names, F.col("rule"))
    return rows.select("ecosystem", "package", "version", signal_id(F.lit("recon"), F.col("rule"), discriminator).alias("id"), F.lit("recon").alias("source"), F.col("rule").alias("category"), meant["severity"].alias("severity"), severity_rank(meant["severity"]).alias("sev_rank"), meant["description"].alias("description"), evidence.alias("evidence"))


def rule_table(spark) -> DataFrame:
    """(category, severity, meaning) of the line rules."""
    return spark.createDataFrame([(k, s, d) for k, (s, d) in MEANING.items()], "category string, severity string, meaning string")


def scan_javascript(files: DataFrame) -> DataFrame:
    """All line signals and co-occurrences of source files."""
    found = hits(files)
    return line_signals(found).unionByName(cooccurrence(found))


def lifecycle_signals(scripts: DataFrame) -> DataFrame:
    """Install scripts (ecosystem, package, version, step, command) that feed a download or a decoded text to a shell."""
    bad = scripts.where(matches("command", fixed.SHELL_ABUSE.replace(".*", "[^\\n]*"), True))
    ev = F.array(piece(F.col("command"), F.lit("package.json"), detail=F.col("step")))
    return bad.select("ecosystem", "package", "version", signal_id(F.lit("recon"), F.lit("lifecycle-script-abuse"), F.concat("package", F.lit(":"), "step")).alias("id"), F.lit("recon").alias("source"), F.lit("lifecycle-script-abuse").alias("category"), F.lit("high").alias("severity"), F.lit(2).alias("sev_rank"), F.concat(F.lit("`"), "step", F.lit("` runs a download or a decoded text in a shell")).alias("description"), ev.alias("evidence"))


def is_scanned_path(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, fixed.JS_SKIPPED))) & name.rlike(r"(?s)^.+\.(?:js|cjs|mjs)$")


def javascript_files(files: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Files to scan: by name, place and size; and, whatever their name, those that package.json names as commands."""
    chosen = files.where(is_scanned_path(F.col("path")) & (F.col("size_bytes") <= fixed.JS_BYTES))
    if bins is None:
        return chosen
    keys = ["ecosystem", "package", "version", "path"]
    named = files.join(bins.select(*keys).distinct(), keys, "left_semi").join(chosen.select(*keys), keys, "left_anti")
    return chosen.unionByName(named)


def bin_paths(meta: DataFrame) -> DataFrame:
    """Paths in package.json's bin, a text or an object of texts, that stay inside the package."""
    raw = F.get_json_object("package_json", "$.bin")
    as_map = F.from_json(raw, "map<string,string>")
    entries = F.when(F.substring(F.ltrim(raw), 1, 1) == "{", F.map_values(as_map)).when(raw.isNotNull(), F.array(raw))
    out = meta.select("ecosystem", "package", "version", F.explode(entries).alias("entry")).where("entry is not null")
    clean = F.regexp_replace(F.regexp_replace("entry", r"/\.(?=/|$)", ""), r"^(?:\./)+", "")
    return out.select("ecosystem", "package", "version", clean.alias("path")).where(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|^$"))


def coverage_gaps(files: DataFrame, meta: DataFrame) -> DataFrame:
    """What was not read: files above the size limit, and bundled dependencies."""
    keys = ["ecosystem", "package", "version"]
    large = files.where(is_scanned_path(F.col("path")) & (F.col("size_bytes") > fixed.JS_BYTES)).groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    n = F.size("paths")
    shown = F.concat(F.array_join(F.slice("paths", 1, 5), ", "), F.when(n > 5, F.concat(F.lit(" (+"), (n - 5).cast("string"), F.lit(" more)"))).otherwise(""))
    over = large.select(*keys, F.lit("oversized").alias("what"), F.concat(n.cast("string"), F.lit(" source file(s) over 2 MB were not scanned")).alias("description"), shown.alias("excerpt"))
    nested = files.where(F.array_contains(F.split("path", "/"), "node_modules") & F.col("path").endswith(".js")).select(*keys).distinct().withColumn("nested", F.lit(True))
    listed = F.coalesce(F.get_json_object("package_json", "$.bundledDependencies"), F.get_json_object("package_json", "$.bundleDependencies"))
    held = meta.select(*keys, F.when(~listed.isin("[]", "false", "{}", '""', "0"), listed).alias("listed")).join(nested, keys, "full").where("listed is not null or nested")
    bundled = held.select(*keys, F.lit("bundled").alias("what"), F.lit("bundled dependencies were not scanned").alias("description"), F.coalesce("listed", F.lit("node_modules/")).alias("excerpt"))
    both = over.unionByName(bundled)
    return both.select(*keys, signal_id(F.lit("recon"), F.lit("scan-coverage-gap"), F.col("what")).alias("id"), F.lit("recon").alias("source"), F.lit("scan-coverage-gap").alias("category"), F.lit("low").alias("severity"), F.lit(0).alias("sev_rank"), "description", F.array(piece(F.col("excerpt"), detail=F.col("what"))).alias("evidence"))


def code_context(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Numbered lines around each place of evidence: an equi-join on the file, not a range join; at most CONTEXTS a package."""
    from pyspark.sql import Window

    keys = ["ecosystem", "package", "version"]
    places = evidence.where("file is not null and line > 0").groupBy(*keys, "file", "line").agg(F.min("ord").alias("ord"))
    places = places.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "file", "line"))).where(F.col("rank") <= fixed.CONTEXTS).drop("rank")
    around = places.withColumn("line_no", F.explode(F.sequence(F.greatest(F.col("line") - fixed.CONTEXT_LINES, F.lit(1)), F.col("line") + fixed.CONTEXT_LINES)))
    lines = source_lines(files.withColumnRenamed("path", "file")).select(*keys, "file", "line_no", F.col("line").alias("code"))
    shown = F.concat(F.lpad(F.col("line_no").cast("string"), 5, " "), F.when(F.col("line_no") == F.col("line"), ">").otherwise(" "), F.lit("| "), F.substring("code", 1, fixed.CONTEXT_CHARS))
    return around.join(lines, [*keys, "file", "line_no"]).groupBy(*keys, "file", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("shown")))), lambda x: x["shown"]), "\n").alias("context"))


__all__ = ["bin_paths", "code_context", "cooccurrence", "coverage_gaps", "dossier_key", "hits", "javascript_files", "lifecycle_signals", "line_signals", "scan_javascript", "source_lines"]
