"""Verdicts, gates and decisions: conditional aggregates over signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed

KEY = ["ecosystem", "package", "version"]


def verdicts(dossiers: DataFrame, signals: DataFrame) -> DataFrame:
    """One verdict for each dossier; one that was not scanned is never clean, one without signals survives the join."""
    strong = F.col("severity").isin(*fixed.STRONG)
    seen = signals.groupBy(*KEY).agg(
        F.bool_or(F.col("severity") == "critical").alias("critical"),
        F.bool_or(strong & (F.col("source") == "recon")).alias("static"),
        F.bool_or(F.col("source") == "detonation").alias("run"),
        F.count_if(strong & (F.col("source") == "analyst")).alias("analysts"),
        F.bool_or(F.col("severity") != "low").alias("any_real"),
        F.count("*").alias("n_signals"),
    )
    verdict = (F.when(F.col("scan_error").isNotNull(), "unscanned")
               .when(F.col("critical") | (F.col("static") & F.col("run")) | (F.col("analysts") >= 2), "malicious")
               .when(F.col("any_real"), "suspicious").otherwise("clean"))
    return dossiers.join(seen, KEY, "left").select(*dossiers.columns, verdict.alias("verdict"), F.coalesce("n_signals", F.lit(0).cast("long")).alias("n_signals"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


def gate(judged: DataFrame, fail_on: str = "malicious") -> DataFrame:
    """One row: overall verdict, packages not scanned, exit code. Findings come before gaps; ignored packages don't count."""
    active = F.col("verdict").isNotNull() & ~F.coalesce(F.col("ignored"), F.lit(False))
    is_ = lambda v: F.coalesce(F.bool_or(active & (F.col("verdict") == v)), F.lit(False))
    row = judged.agg(is_("malicious").alias("m"), is_("suspicious").alias("s"), is_("unscanned").alias("u"), F.count_if(active & (F.col("verdict") == "unscanned")).alias("n_unscanned"), F.count_if(active).alias("n_active"))
    findings = {"malicious": F.col("m"), "suspicious": F.col("m") | F.col("s"), "none": F.lit(False)}[fail_on]
    overall = F.when(F.col("m"), "malicious").when(F.col("s"), "suspicious").when(F.col("u"), "unscanned").otherwise("clean")
    return row.select(overall.alias("overall"), "n_active", "n_unscanned", F.when(findings, 1).when(F.col("u"), 2).otherwise(0).alias("exit_code"))


def detonation_decisions(reputation: DataFrame, signals: DataFrame, age: int = fixed.AGE_LEAST_DAYS, downloads: int = fixed.DOWNLOADS_LEAST) -> DataFrame:
    """Whether a release is to be run, and why; what is unknown is run."""
    strong = signals.where(F.col("severity").isin(*fixed.STRONG) & (F.col("source") == "recon")).groupBy(*KEY).agg(F.count("*").alias("n_strong"))
    a, d, n = F.col("age_days"), F.col("downloads_last_month"), F.coalesce(F.col("n_strong"), F.lit(0).cast("long"))
    unknown = a.isNull() | d.isNull()
    run = (n > 0) | unknown | (a < age) | (d < downloads)
    reason = (F.when(n > 0, F.format_string("%d high or critical static signal(s)", n)).when(unknown, "reputation is unknown")
              .when(a < age, F.format_string(f"published %d day(s) ago, below {age}", a)).when(d < downloads, F.format_string(f"%d downloads a month, below {downloads}", d))
              .otherwise(F.format_string("established: %d days old, %d downloads a month", a, d)))
    return reputation.join(strong, KEY, "left").select(*KEY, run.alias("should_detonate"), reason.alias("reason"))


def detonation_policy(mode: str) -> str:
    """Run policy of a mode: static never, detonate-only only, full always, auto by decision."""
    return {"static": "never", "detonate-only": "only", "full": "always", "auto": "smart"}[mode]


def require_observation(dossiers: DataFrame, mode: str) -> DataFrame:
    """In detonate-only mode a release that nothing ran is not scanned, so it can't be clean."""
    if mode != "detonate-only":
        return dossiers
    return dossiers.withColumn("scan_error", F.when(F.col("scan_error").isNull() & ~F.coalesce(F.col("detonated"), F.lit(False)), "nothing was run and static rules were skipped").otherwise(F.col("scan_error")))


def dedupe_last_wins(signals: DataFrame, key: list[str], ident: str = "id", order: str = "ord") -> DataFrame:
    """One row for each id: the place of its first, the values of its last."""
    values = [c for c in signals.columns if c not in (*key, ident, order)]
    return signals.groupBy(*key, ident).agg(F.max_by(F.struct(*values), order).alias("v"), F.min(order).alias(order)).select(*key, ident, order, *(F.col(f"v.{c}").alias(c) for c in values))


def first_n(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key, as a budget allows."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def analyst_signals(asked: DataFrame, answers: DataFrame, budget: int = fixed.ANALYST_ASKS) -> DataFrame:
    """Second opinions on packed strings, within a package's budget: asked(key, file, line, ord, persona) with recorded answers."""
    from assayer.functions.text import piece, severity_rank, signal_id

    within = first_n(asked, KEY, ["ord", "persona"], budget)
    told = within.join(answers, [*KEY, "file", "line", "persona"]).where("ok and malicious")
    severity = F.when(F.col("confidence") >= fixed.ANALYST_STRONG, "high").otherwise("medium")
    return told.select(*KEY, signal_id(F.lit("analyst"), F.lit("obfuscated-intent"), F.concat_ws(":", "file", F.col("line").cast("string"), "persona")).alias("id"), F.lit("analyst").alias("source"), F.lit("obfuscated-intent").alias("category"), severity.alias("severity"), severity_rank(severity).alias("sev_rank"), F.concat(F.lit("["), "persona", F.lit("] "), "rationale").alias("description"), F.array(piece(F.col("excerpt"), F.col("file"), F.col("line"), F.concat(F.lit("confidence="), F.col("confidence").cast("string")))).alias("evidence"))


def worst_by_category(signals: DataFrame) -> DataFrame:
    """Worst severity of each category, with its report level and rank."""
    levels = F.create_map(*(x for k, (lv, r) in fixed.SARIF_LEVELS.items() for x in (F.lit(k), F.struct(F.lit(lv).alias("level"), F.lit(r).alias("rank")))))
    worst = signals.groupBy("category").agg(F.max("sev_rank").alias("worst"))
    named = F.element_at(F.array(*map(F.lit, fixed.SEVERITIES)), F.col("worst") + 1)
    return worst.select("category", named.alias("severity"), F.element_at(levels, named)["level"].alias("level"), F.element_at(levels, named)["rank"].alias("security_severity"))


def missing_releases(missing: DataFrame, presence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Why releases that the registry does not have are missing: (dossier errors, signals). An unknown presence stays unknown."""
    from assayer.functions.text import piece, severity_rank, signal_id

    known = missing.join(presence, KEY, "left")
    takedown = (F.col("ecosystem") == "npm") & F.coalesce(F.col("security_holding"), F.lit(False)) & ~F.coalesce(F.col("version_exists"), F.lit(False))
    unclaimed = ~takedown & (F.col("name_exists") == F.lit(False))
    error = (F.when(takedown, F.lit(None)).when(unclaimed, F.concat(F.lit("no package is named "), "package"))
             .when(F.col("name_exists"), F.concat(F.lit("version "), "version", F.lit(" is not on the registry"))).otherwise("the release could not be fetched"))
    category = F.when(takedown, "npm-security-takedown").when(unclaimed, "unclaimed-package-name")
    severity = F.when(takedown, "critical").otherwise("high")
    found = known.where(category.isNotNull()).select(*KEY, signal_id(F.lit("recon"), category, F.when(takedown, F.concat("package", F.lit("@"), "version")).otherwise(F.col("package"))).alias("id"), F.lit("recon").alias("source"), category.alias("category"), severity.alias("severity"), severity_rank(severity).alias("sev_rank"), F.when(takedown, "the registry removed the package as malicious").otherwise("nobody has claimed the name: anyone can publish under it").alias("description"), F.array(piece(F.concat("package", F.lit("@"), "version"), detail=category)).alias("evidence"))
    return known.select(*KEY, error.alias("scan_error")), found
