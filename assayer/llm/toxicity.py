"""Toxicity by compression distance.

Two zstandard dictionaries are filled, one from toxic and one from ordinary text.  Every window of WINDOW words of a text is
compressed with each; a window is toxic where the toxic dictionary makes it shorter than the ordinary one does by a
calibrated number of bytes.  A document's statistic is its number of toxic windows over the root of its number of windows
(so that chance hits of long texts weigh less), and its score is that statistic against a calibrated threshold: THRESHOLD at
the threshold itself, less below, more above.

The ordinary dictionary holds the most frequent words of ordinary text; the toxic one the words of toxic text that ordinary
text lacks and that recur between different neighbours, so that copies of one passage don't count as recurrence.  How often
they must recur, the bytes and the document's threshold are calibrated on rows that filled neither dictionary: SHARE of the
fitting rows fill, the rest calibrate.  zstandard's own trainer picks segments by raw frequency, which toxic and ordinary
text share (README gives the figures of both).

Fitting reads at most TOXIC_ROWS and ORDINARY_ROWS labelled documents, whole, whose crc32(doc_id as text) mod 4 is not 2.

Defined cases: null text is the empty text; a text without words scores 0; a text of fewer than WINDOW words is one window;
very long texts are compressed window by window, SLICE words at a time; repeated rows score alike; ids that are null are
scored and not held out; without labels of both kinds every score is 0; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import texts, tidy

TOXIC_ROWS, ORDINARY_ROWS = 2400, 5200
FOLDS, HELD_OUT = 4, 2
ORDINARY_BYTES, TOXIC_BYTES = 100_000, 50_000
WINDOW, LEVEL, SLICE = 3, 3, 50_000
#: Share of the fitting rows that fill the dictionaries.
SHARE = 0.6
#: Different neighbours, on either side, of a word that is to recur: the choices that calibration has.
CONTEXTS = (3, 6, 12)
#: Bytes by which the toxic dictionary must win: the choices that calibration has.
MARGINS = np.arange(-4, 13)
#: What a false alarm costs calibration, against a miss.
ALARM = 1.0
THRESHOLD = 0.3
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8"))


def windows_of(words: list[bytes]):
    """Windows of WINDOW words, a slice at a time."""
    for s in range(0, max(len(words) - WINDOW, 0) + 1, SLICE):
        part = words[s:s + SLICE + WINDOW - 1]
        yield [b" %b " % b" ".join(part[i:i + WINDOW]) for i in range(max(len(part) - WINDOW, 0) + 1)]


def _fill(words, size: int) -> bytes:
    """A raw dictionary of the first words that fit; the first stand last, where references are cheapest."""
    out, n = [], 0
    for w in words:
        n += len(w) + 2
        if n > size:
            break
        out.append(b" %b " % w)
    return b"".join(reversed(out))


class Model:
    """Both dictionaries, the margin of a window and the threshold of a document; compressors are made where they are used."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic, self.margin, self.threshold = ordinary, toxic, 0, 1.0
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def lengths(self, windows: list[bytes], kind: int) -> np.ndarray:
        """Compressed lengths under the ordinary (0) or the toxic (1) dictionary."""
        if self._made is None:
            import zstandard

            self._made = []
            for raw in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return np.fromiter(map(len, map(self._made[kind], windows)), np.int64, len(windows))

    def gains(self, text: str) -> np.ndarray:
        """Of every window, by how many bytes the toxic dictionary wins."""
        words = words_of(text)
        if not words:
            return np.zeros(0, np.int64)
        return np.concatenate([self.lengths(w, 0) - self.lengths(w, 1) for w in windows_of(words)])

    def score(self, text: str) -> float:
        gains = self.gains(text)
        return scaled(statistic(int((gains >= self.margin).sum()), len(gains)), self.threshold)


def statistic(hits, windows):
    return hits / np.sqrt(windows + 20)


def scaled(value: float, threshold: float) -> float:
    """THRESHOLD at the threshold, rising from 0 to 1."""
    share = value / threshold
    return float(THRESHOLD * share if share < 1 else 1 - (1 - THRESHOLD) / share)


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Fill dictionaries from the first SHARE of the texts for each number of contexts; the rest choose among them and set the thresholds."""
    if not toxic or not ordinary:
        return None
    cut, even = max(1, int(len(ordinary) * SHARE)), max(1, int(len(toxic) * SHARE))
    common: Counter = Counter()
    for t in ordinary[:cut]:
        common.update(words_of(t))
    frequent = _fill((w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))), ORDINARY_BYTES)
    before: dict[bytes, set] = {}
    after: dict[bytes, set] = {}
    for t in toxic[:even]:
        w = [b"", *words_of(t), b""]
        for i in range(1, len(w) - 1):
            if w[i] not in common:
                before.setdefault(w[i], set()).add(w[i - 1])
                after.setdefault(w[i], set()).add(w[i + 1])
    recur = {w: min(len(b), len(after[w])) for w, b in before.items()}
    order = sorted(recur, key=lambda w: (-recur[w], w))
    groups = [ordinary[cut:] or ordinary, toxic[even:] or toxic]
    best, chosen, plain = None, None, {}
    for contexts in CONTEXTS:
        model = Model(frequent, _fill((w for w in order if recur[w] >= contexts), TOXIC_BYTES))
        rows = []
        for texts_of in groups:
            rows.append([])
            for t in texts_of:
                windows = [w for part in windows_of(words_of(t)) for w in part if w != b"  "]
                if t not in plain:  # the ordinary dictionary is the same for all
                    plain[t] = model.lengths(windows, 0)
                gain = plain[t] - model.lengths(windows, 1)
                rows[-1].append((np.histogram(gain, [*MARGINS, np.inf])[0][::-1].cumsum()[::-1], len(gain)))
        for k, margin in enumerate(MARGINS):
            calm, harsh = (np.sort([statistic(hits[k], n) for hits, n in group]) for group in rows)
            for threshold in np.unique(harsh[harsh > 0]):
                worth = (harsh >= threshold).mean() - ALARM * (calm >= threshold).mean()
                if best is None or worth > best:
                    best, chosen = worth, model
                    model.margin, model.threshold = int(margin), float(threshold)
    return chosen


def _remainder(column):
    return F.crc32(F.encode(column.cast("string"), "UTF-8")) % FOLDS


def labelled_texts(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Toxic and ordinary texts of the fitting rows, a bounded number of each, in the order of a hash of their ids."""
    own = labels.where(F.col("doc_id").isNotNull() & (_remainder(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isNotNull()).select("doc_id", "toxic").distinct()
    out = []
    for kind, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        ids = own.where(F.col("toxic") == kind).select("doc_id", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(n)
        rows = docs.join(F.broadcast(ids), "doc_id").select("rank", "text").orderBy("rank").limit(n).collect()  # at most n rows
        out.append([r["text"] for r in rows])
    return out[0], out[1]


def _score(model: Model | None):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            s = [round(model.score(t.as_py()), 6) if model else 0.0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    rows = texts(docs, id_col, text_col)
    model = fit(*labelled_texts(rows, labels))
    scored = rows.mapInArrow(tidy(_score(model)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
