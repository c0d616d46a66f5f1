"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled quality 1, a bounded sample) and one of all raw
text, give every document a log importance weight: the log ratio of its n-grams, as of a text of LENGTH of them (its mean
times LENGTH), which is the sampler's temperature.  Whole sums would grow with the text and leave nothing to chance; at
LENGTH documents of the target's kind lie within a few units of each other, so the noise decides among them.  Weights plus
Gumbel noise rank the documents and the k best are the sample, drawn without replacement in proportion to the weights.  k is
a share of the documents: `share`, or else the share of good ones in a bounded sample of labels plus its standard error.

n-grams are words, pairs of words and triples of shapes (capitals, lower case, digits, signs, a word said again), which
carry what makes junk look like junk in any language.

Defined cases: null text is the empty text, which has no n-grams, the least weight and is never selected; very long texts
are weighed whole; rows that repeat id and text share their fate; rows without an id have the noise of the id "None"; ties
in the key are selected together; without labels of both kinds all documents with n-grams are selected; an empty table gives
no rows; extra columns are kept by `select_documents`, whatever their names, and ignored by `weigh`.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import keep, texts, tidy

#: Labelled documents that the target model counts, and labels that the share of good ones is taken from, at most.
TARGET_ROWS, LABEL_ROWS = 20_000, 20_000
WORD_CELLS, PAIR_CELLS, SHAPES = 4096, 8192, 8
CELLS = WORD_CELLS + PAIR_CELLS + SHAPES**3
LENGTH, SEED, EMPTY = 8.0, 7, -1.0e6
TOKENS_KEPT = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_AGAIN = 7
#: Columns that rows carry while they are ranked.
WEIGHT, KEY = "_importance_log_weight", "_importance_gumbel_key"


class Tokens(dict):
    """Hash and shape of each token, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > TOKENS_KEPT:
            self.clear()
        shape = (0 if token.islower() else 1 if token[0].isupper() and token[1:].islower() else 2 if token.isupper() and len(token) > 1 else 3 if token.isdigit() else 1 if token.isupper() else 4) if token[0].isalnum() or token[0] == "_" else 5 if len(token) == 1 else 6
        self[token] = v = crc32(token.casefold().encode("utf-8", "replace")) << 3 | shape
        return v


_TOKENS = Tokens()


def cells(text: str) -> np.ndarray:
    """Cells of all n-grams of a text."""
    found = _TOKEN.findall(text)
    n = len(found)
    v = np.fromiter(map(_TOKENS.__getitem__, found), np.int64, n)
    w, s = v >> 3, v & 7
    if n > 1:
        s[1:][w[1:] == w[:-1]] = _AGAIN
    pairs = (w[:-1] * 0x9E3779B1 ^ w[1:] * 0x85EBCA6B) if n > 1 else w[:0]
    triples = s[:-2] * SHAPES * SHAPES + s[1:-1] * SHAPES + s[2:] if n > 2 else w[:0]
    return np.concatenate([w % WORD_CELLS, WORD_CELLS + (pairs >> 7) % PAIR_CELLS, WORD_CELLS + PAIR_CELLS + triples])


def _count(target: frozenset):
    def run(batches):
        import pyarrow as pa

        raw, own, rows = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.bincount(cells(text.as_py()), minlength=CELLS)
                raw += c
                if doc in target:
                    own += c
                rows += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(raw), pa.array(own)], ["cell", "raw", "target"])
    return run


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability, each kind of n-gram on its own; zero without a target."""
    out = np.zeros(CELLS)
    for a, b in ((0, WORD_CELLS), (WORD_CELLS, WORD_CELLS + PAIR_CELLS), (WORD_CELLS + PAIR_CELLS, CELLS)):
        if target[a:b].sum():
            t, r = target[a:b] + 1.0, raw[a:b] + 1.0
            out[a:b] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def weight(text: str, ratios: np.ndarray) -> float:
    c = cells(text)
    return float(ratios[c].mean() * LENGTH) if len(c) else EMPTY


def gumbel(doc) -> float:
    """Standard Gumbel noise that depends on the id alone."""
    from xxhash import xxh64_intdigest

    u = (xxh64_intdigest(str(doc).encode(), SEED) + 0.5) / 2.0**64
    return float(-np.log(-np.log(min(max(u, 1e-18), 1 - 1e-16))))


def fit(rows: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios of all cells: raw counts over every document, target counts over a bounded sample of labelled ones."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).collect()
    sums = rows.mapInArrow(tidy(_count(frozenset(r[0] for r in ids))), "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw"), F.sum("target")).collect()  # CELLS rows
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    for cell, r, t in sums:
        raw[cell], target[cell] = r, t
    return log_ratios(raw, target)


def _weigh(ratios: np.ndarray):
    """Rows with two more columns at their end: log weight and Gumbel key."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            w = [round(weight(t.as_py() or "", ratios), 9) for t in b.column("text")]
            key = [round(x + gumbel(i), 9) for x, i in zip(w, ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64()), pa.array(key, pa.float64())], [*b.schema.names, WEIGHT, KEY])
    return run


def good_share(labels: DataFrame) -> float:
    """Share of good documents in a bounded sample of labels plus its standard error; 1 where one kind is missing."""
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_ROWS)
    n, good = sample.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    if not n or good in (0, n):
        return 1.0
    return min(1.0, good / n + (good / n * (1 - good / n) / n) ** 0.5)


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, rounds: int = 8) -> float:
    """Exact k-th largest value, by counts in ever narrower ranges; the driver sees at most `bins` counts or values."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    left = k
    for _ in range(rounds):
        inside = rows.where(F.col(column).between(lo, hi))
        if lo == hi:
            return lo
        counts = sorted(inside.groupBy(F.least(F.width_bucket(column, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["lo"])
        for r in counts:
            if left <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo


def _with_keys(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField(WEIGHT, T.DoubleType()), T.StructField(KEY, T.DoubleType())])


def cut_of(weighed: DataFrame, share: float) -> float:
    """The key of the last row that is selected."""
    able = weighed.where(F.col(WEIGHT) > EMPTY)
    k = int(np.ceil(able.count() * share))
    return kth_largest(able, KEY, k) if k else float("inf")


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of every row of docs."""
    rows = texts(docs, id_col, text_col)
    ratios = fit(rows, labels)
    weighed = keep(rows.mapInArrow(tidy(_weigh(ratios)), _with_keys(rows)).drop("text"), "weights")
    cut = cut_of(weighed, good_share(labels) if share is None else share)
    return weighed.select("doc_id", F.col(WEIGHT).alias("log_weight"), F.col(KEY).alias("gumbel_key"), ((F.col(KEY) >= F.lit(cut)) & (F.col(WEIGHT) > EMPTY)).alias("selected"))


def select_documents(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The selected rows of docs, all columns; rows are written with their keys once, so texts are weighed once and never shuffled."""
    weighed = keep(docs.mapInArrow(tidy(_weigh(fit(texts(docs), labels))), _with_keys(docs)), "weighed")
    cut = cut_of(weighed, good_share(labels) if share is None else share)
    return weighed.where((F.col(KEY) >= F.lit(cut)) & (F.col(WEIGHT) > EMPTY)).drop(WEIGHT, KEY)
