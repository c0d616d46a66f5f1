"""The whole scan as one plan: dependencies and evidence in, judged dossiers and signals out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import is_exact, piece, signal_id
from assayer.operators import detonation, js_code, lines, policy, python_code, typosquat, verdict
from assayer.plans.shared import settle
from assayer.sources import manifests

KEY = ["ecosystem", "package", "version"]


def static_signals(files: DataFrame, meta: DataFrame, releases: DataFrame, reputation: DataFrame) -> DataFrame:
    """Signals of all static rules."""
    npm = files.where("ecosystem = 'npm'")
    scripts = manifests.lifecycle_scripts(meta)
    out = lines.lifecycle_signals(scripts)
    for more in (js_code.scan_with_trees(lines.javascript_files(npm, lines.bin_paths(meta))), lines.coverage_gaps(npm, meta), python_code.python_signals(files.where("ecosystem = 'pypi'")), typosquat.typosquat_signals(releases, "npm"), typosquat.typosquat_signals(releases, "pypi")):
        out = out.unionByName(more)
    return typosquat.drop_established(out, reputation)


def dossiers(dependencies: DataFrame, fetched: DataFrame, presence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dossiers with scan_error, signals of missing releases). A range is no release; what could not be fetched is explained."""
    rows = dependencies.select("ecosystem", F.col("name").alias("package"), "version").distinct()
    exact = rows.withColumn("exact", F.coalesce(is_exact("version", "ecosystem"), F.lit(False)))
    here = fetched.select(*KEY).distinct().withColumn("here", F.lit(True))
    known = exact.join(here, KEY, "left")
    errors, found = verdict.missing_releases(known.where("exact and here is null").select(*KEY), presence)
    ranged = known.where("not exact").select(*KEY, F.lit("not an exact version").alias("scan_error"))
    good = known.where("exact and here").select(*KEY, F.lit(None).cast("string").alias("scan_error"))
    return good.unionByName(errors).unionByName(ranged).withColumn("detonated", F.lit(False)), found


def yanked_signals(releases: DataFrame) -> DataFrame:
    """Releases (with yanked) that were withdrawn from the Python registry."""
    shown = F.concat("package", F.lit("=="), "version")
    return releases.where("ecosystem = 'pypi' AND coalesce(yanked, false)").select(
        *KEY, signal_id(F.lit("recon"), F.lit("yanked-release"), shown).alias("id"), F.lit("recon").alias("source"), F.lit("yanked-release").alias("category"), F.lit("low").alias("severity"), F.lit(0).alias("sev_rank"),
        F.lit("the release was withdrawn by its maintainers or the registry").alias("description"), F.array(piece(shown, detail=F.lit("yanked"))).alias("evidence")).dropDuplicates([*KEY])


def scan(project_files: DataFrame, files: DataFrame, meta: DataFrame, reputation: DataFrame, presence: DataFrame, rules: DataFrame, today: Column, mode: str = "auto",
         observed: dict[str, DataFrame] | None = None, opinions: tuple[DataFrame, DataFrame] | None = None, releases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged dossiers, signals) of the dependencies of projects.

    observed: recorded runs (`runs`, `capture`, `canaries`, `lines`, `states`), whose signals join the static ones, so that a
    package which both look at and run badly is judged by both.  opinions: (asked, answers) of second readers.  releases: with
    `yanked`.  In detonate-only mode static rules are left out and a release that nothing ran is not scanned.
    """
    held, missing = dossiers(manifests.resolve(project_files), files, presence)
    unread = manifests.oversized(project_files).groupBy("project").agg(F.min("error").alias("scan_error"))
    held = held.unionByName(unread.select(F.lit("project").alias("ecosystem"), F.col("project").alias("package"), F.lit("").alias("version"), "scan_error", F.lit(False).alias("detonated")))
    signals = missing
    if mode != "detonate-only":
        signals = signals.unionByName(static_signals(files, meta, held, reputation))
        if releases is not None:
            signals = signals.unionByName(yanked_signals(releases))
        if opinions is not None:
            signals = signals.unionByName(verdict.analyst_signals(*opinions))
    signals = settle(signals, "recon")
    decided = verdict.detonation_decisions(reputation, signals)
    held = held.drop("detonated").join(decided.select(*KEY, F.col("reason").alias("decision_reason"), "should_detonate"), KEY, "left")
    if observed is not None and mode != "static":
        ran = observed["runs"].select(*KEY).distinct().withColumn("detonated", F.lit(True))
        held = held.join(ran, KEY, "left").withColumn("detonated", F.coalesce("detonated", F.lit(False)))
        found = detonation.capture_signals(observed["capture"], observed["canaries"]).unionByName(detonation.trace_signals(observed["lines"], observed["states"]))
        signals = signals.unionByName(settle(detonation.release_signals(found, observed["runs"]), "detonation"))
    else:
        held = held.withColumn("detonated", F.lit(False))
    held = settle(held, "dossiers")
    signals = signals.join(held.select(*KEY), KEY, "left_semi")
    held = verdict.require_observation(held, mode)
    return verdict.verdicts(policy.apply_rules(held, rules, today), signals), signals
