"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

Fixed masks pick token positions out of a span and ignore the others, so that a substituted token under an ignored
position leaves the hash as it was.  The hashes of all test items are joined with those at every position of the training
texts; each hit aligns an item with a text, and the aligned tokens are compared: a text is contaminated where a stretch of
WINDOW aligned tokens (or the whole item, if shorter) agrees in at least SIMILARITY of them.

The masks find every such stretch.  A window of WINDOW tokens holds a free place for one of MASKS whichever two tokens are
substituted; an item of n < WINDOW tokens that tolerates m substitutions has m + 1 masks of its own, which take every
(m + 1)-th token, so that one of them meets no substituted token.  Items of fewer than five tokens tolerate none.

Few seeds, and few rows with hits, are broadcast (both are counted first); beyond that the joins are by shuffle.  While the
rows with hits are few, no text is shuffled.

Defined cases: null text is the empty text; tokens are lower-cased runs of letters and digits; items without tokens match
nothing; very long texts are searched at every position; a row is its id and its text, so rows that share an id, or have
none, are decided each by its own text; rows that repeat both share the verdict; empty tables give no hits; extra columns are
ignored, and kept by `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import keep

#: Offsets that a mask keeps, in spans of at most SPAN tokens.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 2, 5, 6))
SPAN = 8
WINDOW, SIMILARITY = 13, 0.8
#: Seeds that are broadcast at most: 16 bytes of key and value each and as much again for the table; and rows with hits.
BROADCAST_SEEDS, BROADCAST_ROWS = 500_000, 1_000_000
#: Columns that rows carry while they are searched.
ID, HASH = "_leak_doc_id", "_leak_text_hash"


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def tolerated(n: int) -> int:
    """Substitutions that a stretch of n tokens may hold."""
    return n - math.ceil(n * SIMILARITY - 1e-9)


def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks of an item of n < WINDOW tokens."""
    return tuple(tuple(range(k, n, tolerated(n) + 1)) for k in range(tolerated(n) + 1))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _seed(number: int, mask: tuple[int, ...], at: Column) -> Column:
    return F.xxhash64(F.lit(number), *(F.get("h", at + F.lit(o)) for o in mask))


def _positions(df: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """A row for each place and numbered mask that lies inside the tokens, with its seed; other columns of df stay."""
    least = min(max(m) + 1 for _, m in masks)
    placed = df.where(F.size("h") >= least).select("*", F.explode(F.sequence(F.lit(0), F.size("h") - F.lit(least))).alias("at"))
    cells = [F.when(F.col("at") + F.lit(max(m)) < F.size("h"), _seed(k, m, F.col("at"))) for k, m in masks]
    rest = [c for c in placed.columns if c != "h"]
    seeded = placed.select(*rest, *(c.alias(f"seed{i}") for i, c in enumerate(cells)))
    stacked = ", ".join(f"seed{i}" for i in range(len(cells)))
    return seeded.selectExpr(*rest, f"stack({len(cells)}, {stacked}) as seed").where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, matched, compared): best aligned stretch of each contaminated row and item."""
    none = docs.sparkSession.createDataFrame([], "doc_id string, text_hash long, item_id string, matched int, compared int")
    none = none.select(F.col("doc_id").cast(docs.schema[id_col].dataType), "text_hash", F.col("item_id").cast(benchmark.schema[item_col].dataType), "matched", "compared")
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("item_tokens")).where(F.size("item_tokens") > 0).distinct()
    items = items.withColumn("h", F.transform("item_tokens", lambda w: F.xxhash64(w)))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("h"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW numbers
    if not sizes:
        return none
    # masks of each size of items; an item is looked up with those of its own size
    groups = {n: [(n * WINDOW + k, m) for k, m in enumerate(short_masks(n) if n < WINDOW else MASKS)] for n in sizes}
    seeds = None
    for n, masks in groups.items():
        own = _positions(items.where(F.least(F.size("h"), F.lit(WINDOW)) == n).select("item_id", "h"), masks)
        own = own.where(F.col("at") == 0) if n < WINDOW else own
        seeds = own if seeds is None else seeds.unionByName(own)
    seeds = seeds.select("seed", "item_id", F.col("at").alias("item_at"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(text_col).alias("text_hash"), tokens(F.col(text_col)).alias("tokens"))
    places = _positions(rows.select("doc_id", "text_hash", F.transform("tokens", lambda w: F.xxhash64(w)).alias("h")), [m for masks in groups.values() for m in masks])
    hits = places.join(F.broadcast(seeds) if seeds.count() <= BROADCAST_SEEDS else seeds.hint("merge"), "seed")
    # a place to look at for each row, item and diagonal; texts come back for those alone
    looks = keep(hits.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "looks")
    met = looks.select(F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col("text_hash") == F.col(HASH))
    texts = rows.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    looks = looks.join(items.select("item_id", "item_tokens"), "item_id").withColumnsRenamed({"doc_id": ID, "text_hash": HASH})
    pairs = texts.join(looks, same)
    # the item's tokens against those of the text on the same diagonal
    diagonal = F.col("diagonal")
    first = F.greatest(diagonal, F.lit(0))
    skip = F.greatest(-diagonal, F.lit(0))
    agree = F.zip_with(F.slice("tokens", first + 1, F.size("item_tokens") - skip), F.slice("item_tokens", skip + 1, F.size("item_tokens")), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    aligned = pairs.select("doc_id", "text_hash", "item_id", F.size("item_tokens").alias("item_size"), agree.alias("agree"))
    length = F.least(F.lit(WINDOW), F.col("item_size"))
    starts = F.when(F.size("agree") >= length, F.sequence(F.lit(1), F.size("agree") - length + 1)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("agree", s, length), F.lit(0), lambda a, b: a + b)))
    found = aligned.select("doc_id", "text_hash", "item_id", length.alias("compared"), F.coalesce(best, F.lit(0)).alias("matched"))
    return found.where(F.col("matched") >= F.ceil(F.col("compared") * F.lit(SIMILARITY) - F.lit(1e-9))).groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, contaminated, n_items, first_item (smallest item id) and best share of agreeing tokens."""
    found = keep(contaminated(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max(F.col("matched") / F.col("compared")).alias("share")), "leaks")
    found = found.withColumnsRenamed({"doc_id": ID, "text_hash": HASH})
    rows = docs.select("doc_id", _text_hash("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col("text_hash") == F.col(HASH))
    joined = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, same, "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "first_item", F.coalesce("share", F.lit(0.0)).alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no passage with the benchmark."""
    leaks = keep(contaminated(docs, benchmark).select(F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH)).distinct(), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & (_text_hash("text") == F.col(HASH))
    return docs.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks, same, "left_anti")
