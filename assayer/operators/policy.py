"""Ignore rules and the result cache: first-match, anti and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import fixed

KEY = ["ecosystem", "package", "version"]


def active_rules(rules: DataFrame, today: Column) -> DataFrame:
    """Rules still in force; a rule holds on its last day."""
    return rules.where(F.col("expires").isNull() | (F.col("expires") >= today))


def expired_rules(rules: DataFrame, today: Column) -> DataFrame:
    return rules.where(F.col("expires") < today)


def first_matches(dossiers: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, ord, reason) of the first rule that matches each dossier: equal package, equal or open version and ecosystem."""
    r = rules.select(F.col("package"), F.col("version").alias("r_version"), F.col("ecosystem").alias("r_ecosystem"), "reason", "ord")
    met = dossiers.select(*KEY).distinct().join(r, "package").where((F.col("r_version").isNull() | (F.col("r_version") == F.col("version"))) & (F.col("r_ecosystem").isNull() | (F.col("r_ecosystem") == F.col("ecosystem"))))
    return met.groupBy(*KEY).agg(F.min(F.struct("ord", "reason")).alias("first")).select(*KEY, "first.ord", "first.reason")


def apply_rules(dossiers: DataFrame, rules: DataFrame, today: Column) -> DataFrame:
    """Dossiers with `ignored` and `ignore_reason`; nothing is dropped."""
    found = first_matches(dossiers, active_rules(rules, today)).select(*KEY, F.col("reason").alias("ignore_reason"))
    return dossiers.drop("ignored", "ignore_reason").join(found, KEY, "left").withColumn("ignored", F.col("ignore_reason").isNotNull())


def unused_rules(dossiers: DataFrame, rules: DataFrame, today: Column) -> DataFrame:
    """Active rules that decide nothing; one that an earlier rule hides is unused too."""
    live = active_rules(rules, today)
    return live.join(first_matches(dossiers, live).select("ord").distinct(), "ord", "left_anti")


def latest_fresh(cache: DataFrame, scope: str, now: Column, days: int = fixed.CACHE_DAYS) -> DataFrame:
    """Newest entry of each dossier that is young enough."""
    live = cache.where((F.col("scope") == scope) & (F.col("stored_at") >= now - F.lit(days * 86400)) & (F.col("stored_at") <= now))
    return live.groupBy(*KEY).agg(F.max("stored_at").alias("stored_at"), F.max_by("dossier", "stored_at").alias("dossier"))


def delta(dependencies: DataFrame, fresh: DataFrame) -> DataFrame:
    """Dependencies without a fresh result."""
    return dependencies.join(fresh.select(*KEY), KEY, "left_anti")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Cache with new entries; releases that were not scanned are never stored, the newest entry of a key stays."""
    both = cache.unionByName(entries.where("scan_error is null").select(*cache.columns))
    newest = Window.partitionBy("scope", *KEY).orderBy(F.desc("stored_at"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def catalogue_fingerprint() -> str:
    """Changes with every rule, so that results of other rules are not reused."""
    import hashlib

    return hashlib.sha256(repr(sorted((k, v) for k, v in vars(fixed).items() if k.isupper() and not isinstance(v, frozenset)) + sorted((k, sorted(v)) for k, v in vars(fixed).items() if isinstance(v, frozenset))).encode()).hexdigest()[:16]


def cache_scope(mode: str, analyst: bool) -> str:
    return f"{catalogue_fingerprint()}-{mode}-{'analyst' if analyst else 'rules'}"
