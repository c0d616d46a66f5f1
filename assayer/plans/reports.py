"""Reports over dossiers, signals and evidence: JSON, CSV, SARIF, Markdown, terminal and a brief for a reviewer.

Tables stay flat until here; nesting is one aggregation for each package.  Texts of packages are untrusted and are cleaned.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import dossier_key, escape_markdown, formula_guard, sanitize

KEY = ["ecosystem", "package", "version"]


def evidence_rows(signals: DataFrame) -> DataFrame:
    """One row per piece of evidence, with its place in the signal."""
    return signals.select(*[c for c in signals.columns if c != "evidence"], F.posexplode("evidence").alias("ev_index", "e")).select("*", "e.*").drop("e")


def csv_rows(judged: DataFrame, signals: DataFrame) -> DataFrame:
    """The 14 report columns: a row for each piece of evidence, one empty row for packages without signals."""
    ev = evidence_rows(signals).select(*KEY, "severity", "source", "category", "description", "file", F.col("line").cast("string").alias("line"), F.col("excerpt").alias("evidence"), "detail")
    rows = judged.select(*KEY, "verdict", F.when(F.coalesce(F.col("ignored"), F.lit(False)), "yes").otherwise("no").alias("ignored"), "scan_error").join(ev, KEY, "left")
    # cells that the engine itself words need no guard
    own = ("ecosystem", "verdict", "ignored", "severity", "source", "category")
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in own or c == "line" else formula_guard(c).alias(c) for c in fixed.CSV_COLUMNS))


def sarif_results(judged: DataFrame, signals: DataFrame, uri: str = fixed.MANIFESTS[0]) -> DataFrame:
    """One result per piece of evidence, and one for each package that was not scanned and is not ignored."""
    levels = F.create_map(*(x for k, (lv, _) in fixed.SARIF_LEVELS.items() for x in (F.lit(k), F.lit(lv))))
    key = dossier_key(*KEY)
    package = F.concat("package", F.lit("@"), "version")
    rows = judged.select(*KEY, "verdict", "ignored", "ignore_reason").join(evidence_rows(signals), KEY)
    found = rows.select(*KEY, F.col("category").alias("rule_id"), levels[F.col("severity")].alias("level"), sanitize(F.concat(package, F.lit(": "), "description", F.lit(". Evidence: "), "excerpt")).alias("message"),
                        F.when(F.col("file").isNotNull(), F.concat("ecosystem", F.lit("/"), package, F.lit("/"), "file")).otherwise(uri).alias("uri"), F.greatest(F.coalesce(F.when(F.col("file").isNotNull(), F.col("line")), F.lit(1)), F.lit(1)).alias("start_line"),
                        F.concat_ws(":", key, "id", F.col("ev_index").cast("string")).alias("fingerprint"), "source", "verdict", F.when(F.col("ignored"), sanitize(F.coalesce("ignore_reason", F.lit("")))).alias("suppression"))
    gaps = judged.where("scan_error is not null and not coalesce(ignored, false)").select(*KEY, F.lit("unscanned-package").alias("rule_id"), F.lit("note").alias("level"), sanitize(F.concat(package, F.lit(" was not scanned: "), "scan_error")).alias("message"), F.lit(uri).alias("uri"), F.lit(1).alias("start_line"), F.concat(key, F.lit(":unscanned")).alias("fingerprint"), F.lit(None).cast("string").alias("source"), F.lit("unscanned").alias("verdict"), F.lit(None).cast("string").alias("suppression"))
    return found.unionByName(gaps)


def sarif(judged: DataFrame, signals: DataFrame, name: str = "assayer") -> DataFrame:
    """The whole SARIF document as one JSON text (a report for readers, of the size of its findings)."""
    from assayer.operators.verdict import worst_by_category

    results = sarif_results(judged, signals)
    one = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
                   F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
                   F.struct(F.col("fingerprint").alias("signal/v1")).alias("partialFingerprints"),
                   F.when(F.col("suppression").isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), F.col("suppression").alias("justification")))).alias("suppressions"),
                   F.struct("source", "verdict").alias("properties"))
    listed = results.agg(F.array_sort(F.collect_list(F.struct("ecosystem", "package", "version", "fingerprint", one.alias("r")))).alias("x")).select(F.transform("x", lambda x: x["r"]).alias("results"))
    gap = judged.where("scan_error is not null and not coalesce(ignored, false)").limit(1).select(F.lit("unscanned-package").alias("category"), F.lit("low").alias("severity"), F.lit("note").alias("level"), F.lit(fixed.SARIF_UNSCANNED).alias("security_severity"))
    ruled = worst_by_category(signals).unionByName(gap).agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("id"), F.struct("level").alias("defaultConfiguration"), F.struct(F.col("security_severity").alias("security-severity")).alias("properties")))).alias("rules"))
    return listed.crossJoin(ruled).select(F.to_json(F.struct(F.lit(fixed.SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit(name).alias("name"), "rules").alias("driver")).alias("tool"), "results")).alias("runs"))).alias("sarif"))


def json_dossiers(judged: DataFrame, signals: DataFrame) -> DataFrame:
    """(key, json): each dossier with its nested signals."""
    nested = signals.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("category", "id", "source", "severity", "description", "evidence"))).alias("signals"))
    rows = judged.join(nested, KEY, "left")
    body = F.struct("package", "version", "ecosystem", "verdict", F.coalesce("signals", F.array().cast(nested.schema["signals"].dataType)).alias("signals"), F.col("scan_error"), F.coalesce("ignored", F.lit(False)).alias("ignored"), "ignore_reason", *(F.col(c) for c in ("detonated", "decision_reason", "detonation_summary") if c in judged.columns))
    return rows.select(*KEY, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def json_report(judged: DataFrame, signals: DataFrame) -> DataFrame:
    whole = json_dossiers(judged, signals).agg(F.count("*").alias("package_count"), F.array_sort(F.collect_list(F.struct(*KEY, "json"))).alias("d"))
    return whole.select(F.concat(F.lit('{"schema_version":1,"package_count":'), F.col("package_count").cast("string"), F.lit(',"dossiers":['), F.array_join(F.transform("d", lambda x: x["json"]), ","), F.lit("]}")).alias("report"))


def markdown_lines(judged: DataFrame, signals: DataFrame) -> DataFrame:
    """(section, ord, line) of the Markdown report; readers join the lines in order."""
    package = F.concat("package", F.lit("@"), "version")
    live = ~F.coalesce(F.col("ignored"), F.lit(False))
    rank = F.array_position(F.array(F.lit("malicious"), F.lit("suspicious"), F.lit("unscanned"), F.lit("clean")), F.col("verdict"))
    notable = judged.where(live & (F.col("verdict") != "clean")).select(F.lit(1).alias("section"), F.concat(rank.cast("string"), F.lit(" "), package).alias("place"), F.concat(F.lit("## "), escape_markdown(package), F.lit(" — "), "verdict").alias("line"))
    found = judged.where(live).select(*KEY, "verdict").join(signals, KEY).select(F.lit(1).alias("section"), F.concat(rank.cast("string"), F.lit(" "), package, F.lit(" "), "id").alias("place"), F.concat(F.lit("- **"), "severity", F.lit("** "), "category", F.lit(": "), escape_markdown("description")).alias("line"))
    ignored = judged.where(~live).select(F.lit(2).alias("section"), package.alias("place"), F.concat(F.lit("- ignored: "), escape_markdown(package), F.lit(" ("), escape_markdown(F.coalesce("ignore_reason", F.lit(""))), F.lit(")")).alias("line"))
    clean = judged.where(live & (F.col("verdict") == "clean")).select(F.lit(3).alias("section"), package.alias("place"), F.concat(F.lit("- clean: "), escape_markdown(package)).alias("line"))
    head = judged.agg(F.concat(F.lit("# Packages: "), F.count("*").cast("string"), F.lit(", malicious "), F.count_if(live & (F.col("verdict") == "malicious")).cast("string"), F.lit(", suspicious "), F.count_if(live & (F.col("verdict") == "suspicious")).cast("string"), F.lit(", not scanned "), F.count_if(live & (F.col("verdict") == "unscanned")).cast("string")).alias("line")).select(F.lit(0).alias("section"), F.lit("").alias("place"), "line")
    return head.unionByName(notable).unionByName(found).unionByName(ignored).unionByName(clean)


def terminal_summary(judged: DataFrame) -> DataFrame:
    """Counts for the summary view and the overall verdict."""
    from assayer.operators.verdict import gate

    live = ~F.coalesce(F.col("ignored"), F.lit(False))
    counts = judged.agg(*(F.count_if(live & (F.col("verdict") == v)).alias(v) for v in ("malicious", "suspicious", "unscanned", "clean")), F.count_if(~live).alias("ignored"))
    return counts.crossJoin(gate(judged).select("overall", "exit_code"))


def review_brief(judged: DataFrame, signals: DataFrame, contexts: DataFrame | None = None, token: str | None = None, records: DataFrame | None = None) -> DataFrame:
    """(key, brief): the packages worth a review, fenced as untrusted text by a random token.

    Packages that are not ignored and are not clean, or have signals or a recorded run; one package alone is always shown.
    What was not scanned says so, and what has no signals says that too.  Source contexts stand in for excerpts.
    """
    token = token or secrets.token_hex(8)
    fence = lambda body: F.concat(F.lit(f"<untrusted {token}>\n"), body, F.lit(f"\n</untrusted {token}>"))
    pieces = signals.select(*KEY, "id", F.posexplode("evidence").alias("n", "e"), F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "category", F.lit(" ("), "source", F.lit("): "), sanitize("description")).alias("what"))
    where = F.when(F.col("e.line").isNotNull(), F.concat(F.col("e.file"), F.lit(":"), F.col("e.line").cast("string"))).otherwise(F.coalesce("e.file", "e.detail", F.lit("-")))
    rows = pieces.select(*KEY, "id", "n", F.col("e.file").alias("file"), F.col("e.line").alias("line"), F.concat("what", F.lit(" at "), sanitize(where)).alias("head"), sanitize("e.excerpt").alias("shown"))
    if contexts is not None:
        rows = rows.join(contexts, [*KEY, "file", "line"], "left").withColumn("shown", F.coalesce(sanitize("context"), "shown"))
    found = rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "n", F.concat_ws("\n", "head", fence(F.col("shown"))).alias("body")))), lambda x: x["body"]), "\n").alias("found"))
    out = judged.join(found, KEY, "left")
    if records is None:
        out = out.withColumn("ran", F.lit(None).cast("string"))
    else:
        out = out.join(records.select(*KEY, F.to_json(F.struct(*(c for c in records.columns if c not in (*KEY, "run_id", "limits")))).alias("ran")).groupBy(*KEY).agg(F.min("ran").alias("ran")), KEY, "left")
    alone = judged.agg((F.count("*") == 1).alias("alone"))
    worth = ~F.coalesce(F.col("ignored"), F.lit(False)) & (F.col("alone") | (F.col("verdict") != "clean") | F.col("found").isNotNull() | F.col("ran").isNotNull())
    parts = F.concat_ws("\n", F.concat(F.lit("verdict: "), F.upper("verdict")), F.when(F.col("scan_error").isNotNull(), F.concat(F.lit("NOT SCANNED: "), sanitize("scan_error"))), F.when(F.col("ran").isNotNull(), fence(sanitize("ran"))), F.coalesce("found", F.lit("no findings")))
    return out.crossJoin(alone).where(worth).select(*KEY, parts.alias("brief"))


def run_section(records: DataFrame) -> DataFrame:
    """(run_id, ord, line): what the reports show of each run, a line for each fact that there is."""
    listed = lambda c, n=1 << 20: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, n), ", "))
    hosts = F.array_sort(F.array_union(F.coalesce("plain_unexpected", F.array().cast("array<string>")), F.coalesce("https_unexpected", F.array().cast("array<string>"))))
    status = F.concat(F.lit("exit code "), F.coalesce(F.col("exit_code").cast("string"), F.lit("none")), F.when(F.col("timed_out"), ", timed out").otherwise(""), F.lit(", "), F.col("seconds").cast("string"), F.lit(" s"))
    facts = [("scripts", F.when(F.length("scripts") > 0, F.col("scripts"))), ("status", status), ("requests", F.format_string("%d plain, %d inspected", F.coalesce("plain_http_requests", F.lit(0).cast("long")), F.coalesce("https_requests_inspected", F.lit(0).cast("long")))), ("unexpected hosts", F.when(F.size(hosts) > 0, F.array_join(hosts, ", "))),
             ("refused", listed("blocked")), ("canaries leaked", listed("leaked")), ("processes", listed("processes", 6)), ("direct connections", listed("direct_connects")), ("files of interest", listed("files_of_interest")), ("stdout", F.nullif("stdout_tail", F.lit(""))), ("stderr", F.nullif("stderr_tail", F.lit("")))]
    cases = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("ord"), F.concat(F.lit(f"- {name}: "), escape_markdown(c)).alias("line"))) for k, (name, c) in enumerate(facts)))
    return records.select("run_id", F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("f")).select("run_id", "f.ord", "f.line")


def detonated_count(judged: DataFrame) -> DataFrame:
    """How many packages ran, of how many."""
    return judged.agg(F.count_if(F.coalesce(F.col("detonated"), F.lit(False))).alias("detonated"), F.count("*").alias("packages"))


def artifact_labels(files: DataFrame) -> DataFrame:
    """(key, labels): which artifacts of a release were read, as reports name them."""
    return files.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("label")), " and ").alias("labels"))


def run_command(mode: str = "npm", limit: int = 30) -> str:
    """What the sandbox runs, as text for reports; nothing here runs it."""
    return f"npm install (lifecycle scripts), at most {limit} s" if mode == "npm" else f"pip install and a first import, at most {limit} s"
