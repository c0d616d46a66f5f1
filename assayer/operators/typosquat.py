"""Names that imitate popular ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import osa_distance, piece, signal_id


def popular_table(spark, ecosystem: str) -> DataFrame:
    names = fixed.POPULAR_PYPI if ecosystem == "pypi" else fixed.POPULAR_NPM
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "popular string, ord int")


#: Popular names that are broadcast at most; beyond that both sides are dealt by key.
BROADCAST_NAMES = 50_000


def _without_one(c: Column) -> Column:
    """The texts that are left when one character is taken out."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def _keys(c: Column, deletions: Column) -> Column:
    """Texts with at most that many characters taken out: names within that distance share one, swapped neighbours included."""
    one = F.when(F.length(c) > 0, _without_one(c)).otherwise(F.array().cast("array<string>"))
    two = F.flatten(F.transform(F.array_distinct(one), lambda x: F.when(F.length(x) > 0, _without_one(x)).otherwise(F.array().cast("array<string>"))))
    every = F.concat(F.array(c), one, F.when(deletions > 1, two).otherwise(F.array().cast("array<string>")))
    return F.transform(F.array_distinct(every), lambda x: F.concat(F.lit("near:"), x))


def targets(names: DataFrame, popular: DataFrame, near: list[str] | None = None, name_col: str = "name") -> DataFrame:
    """(name, target): the first popular name, in list order, that a name imitates.

    Candidates are an equi-join on keys: deletion neighbours, the name without separators, the name without its suffix; the
    exact distance then runs on those alone.  The list is broadcast while it is small, which is counted first.
    """
    probes = names.select(F.col(name_col).alias("name"), F.lower(F.col(name_col)).alias("low")).distinct()
    known = popular.select(F.col("popular").alias("low"))
    if near:
        known = known.unionByName(popular.sparkSession.createDataFrame([(n,) for n in near], "low string"))
    small = popular.count() <= BROADCAST_NAMES
    hint = F.broadcast if small else (lambda df: df)
    probes = probes.join(hint(known.distinct()), "low", "left_anti")
    bare = lambda c: F.regexp_replace(c, r"[.\-_]", "")
    cut = F.regexp_replace("low", r"[.\-_]?js$", "")
    limit = F.when(F.length("popular") <= fixed.SHORT_NAME, 1).otherwise(2)
    # a name longer than the short ones by its limit alone can meet a popular one of two deletions
    depth = F.when(F.length("low") > fixed.SHORT_NAME - 2, 2).otherwise(1)
    tried = probes.select("name", "low", F.explode(F.concat(_keys(F.col("low"), depth), F.array(F.concat(F.lit("bare:"), bare("low"))), F.when(cut != F.col("low"), F.array(F.concat(F.lit("cut:"), cut))).otherwise(F.array().cast("array<string>")))).alias("key"))
    listed = popular.select("popular", "ord", limit.alias("limit"), F.explode(F.concat(_keys(F.col("popular"), limit), F.array(F.concat(F.lit("bare:"), bare("popular")), F.concat(F.lit("cut:"), F.col("popular"))))).alias("key"))
    met = tried.join(hint(listed), "key").where(~F.col("key").startswith("near:") | (osa_distance("low", "popular") <= F.col("limit")))
    return met.groupBy("name").agg(F.min_by("popular", "ord").alias("target"))


def typosquat_signals(releases: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """Signals for releases (ecosystem, package, version) of one registry."""
    own = releases.where(F.col("ecosystem") == ecosystem)
    near = fixed.NEAR_PYPI if ecosystem == "pypi" else fixed.NEAR_NPM
    found = targets(own, popular_table(releases.sparkSession, ecosystem), near, "package")
    rows = own.join(found, own["package"] == found["name"]).drop("name")
    ev = F.array(piece(F.col("package"), detail=F.concat(F.lit("looks like "), "target")))
    return rows.select("ecosystem", "package", "version", signal_id(F.lit("recon"), F.lit("typosquat-candidate"), F.col("package")).alias("id"), F.lit("recon").alias("source"), F.lit("typosquat-candidate").alias("category"), F.lit("medium").alias("severity"), F.lit(1).alias("sev_rank"), F.concat(F.lit("the name is close to '"), "target", F.lit("'")).alias("description"), ev.alias("evidence"))


def drop_established(signals: DataFrame, reputation: DataFrame) -> DataFrame:
    """Without the look-alike signal of packages that are much downloaded themselves; unknown downloads keep it."""
    key = ["ecosystem", "package", "version"]
    known = reputation.select(*key, "downloads_last_month")
    established = (F.col("category") == "typosquat-candidate") & (F.coalesce(F.col("downloads_last_month"), F.lit(0)) >= fixed.ESTABLISHED_DOWNLOADS)
    return signals.join(known, key, "left").where(~established).select(*signals.columns)
