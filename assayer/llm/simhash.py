"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of the perfect Hamming code [63, 57] (covering radius 1), applied to the low 63 bits of a
fingerprint; the top bit is free, so an anchor owns both of its values.  Two fingerprints that differ in at most 2 bits
have a midpoint within 1 bit of both, and the midpoint's anchor lies within radius 1 of it.  Each fingerprint is
therefore replicated to the 32 anchors its radius-1 ball decodes to (covering radius plus half the threshold, taken from
both sides, which covers the same pairs as the full threshold from one side with 32 instead of 683 replicas).  Equal
fingerprints are one row before they are replicated, so an anchor holds at most 2 * (1 + 63 + C(63, 2)) = 4,034 rows
whatever the size of the corpus; inside an anchor pairs are compared exactly and only a star to the smallest member of
each local component leaves it.

Defined cases: null text is the empty text; a text without words has fingerprint zero and is linked like any other; one
or two words form one shingle; very long texts are hashed whole; null ids are ids like any other, but never the smallest
unless a component has no other; repeated rows stay separate rows with the same component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import keep, texts, tidy

SEED = 42
SHINGLE = 3
MAX_BITS = 2
ANCHOR_BITS = 63
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        h = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = len(words) - SHINGLE + 1
        starts = [0, *(ends[:n - 1] + 1).tolist()]
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())), np.uint64, n)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes; byte lanes add up to 255 rows at a time without overflow."""
    n = len(h)
    rows = -(-n // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:n] = h
    padded = padded.reshape(rows, 255)
    out = 0
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
        for j in range(8):
            if 2 * int(counts[j]) > n:
                out |= 1 << (8 * j + k)
    return out


def _fingerprints(batches):
    import pyarrow as pa

    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py() or "") for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor that the radius-1 ball of a fingerprint decodes to."""
    fp = fp.astype(np.uint64)
    x = fp & np.uint64((1 << ANCHOR_BITS) - 1)
    syndrome = np.zeros(len(x), np.int64)
    for i in range(ANCHOR_BITS):
        syndrome ^= np.where((x >> np.uint64(i)) & np.uint64(1), i + 1, 0)
    rows, out = [], []
    at = np.arange(len(x))
    for i in range(ANCHOR_BITS + 1):  # flip no bit (i = 0) or bit i - 1, then decode
        flipped = x ^ (np.uint64(1) << np.uint64(i - 1)) if i else x
        rest = syndrome ^ i
        home = np.where(rest > 0, flipped ^ (np.uint64(1) << np.maximum(rest - 1, 0).astype(np.uint64)), flipped)
        new = (rest <= i) if i else np.ones(len(x), bool)  # bits i - 1 and rest - 1 give the same anchor twice
        new &= ~((syndrome == 0) & (i > 0)) & ~((rest == 0) & (i > 0))
        rows.append(at[new])
        out.append(home[new])
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches):
    import pyarrow as pa

    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for s in range(0, len(fp), 20_000):
            part = fp[s:s + 20_000]
            rows, home = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(home.view(np.int64)), pa.array(part[rows])], ["anchor", "fp"])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def stars(anchor: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest fingerprint of its component inside one anchor)."""
    order = np.lexsort((fp, anchor))
    anchor, fp = anchor[order], fp[order]
    n = len(fp)
    label = np.arange(n)
    a, b = [], []
    lag, live = 1, np.arange(n - 1)
    while len(live):
        live = live[live + lag < n]
        live = live[anchor[live] == anchor[live + lag]]
        near = live[popcount(fp[live].view(np.uint64) ^ fp[live + lag].view(np.uint64)) <= max_bits]
        a.append(near)
        b.append(near + lag)
        lag += 1
    if not a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    while True:  # smallest label over the links of each local component
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(n))
    return fp[leaf], fp[label[leaf]]


def _links(anchor: np.ndarray, fp: np.ndarray, max_bits: int):
    import pyarrow as pa

    u, v = stars(anchor, fp, max_bits)
    pairs = np.unique(np.stack([u, v], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])


def _compare(max_bits):
    """Links inside each anchor, of rows sorted by anchor: a batch at a time, with the rows of its last anchor carried into the next."""
    def run(batches):
        none = np.zeros(0, np.int64)
        held = [none, none]
        for b in batches:
            anchor, fp = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns))
            done = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            held = [anchor[done:], fp[done:]]
            if done:
                yield _links(anchor[:done], fp[:done], max_bits)
        if len(held[0]):
            yield _links(*held, max_bits)
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected component, by alternating large and small stars.

    Each round is two aggregations with map-side combine; its edges are written to the shared folder.  It ends when a
    round changes nothing, which takes a number of rounds logarithmic in the longest path.
    """
    def signature(df):
        r = df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u % 1000003 as decimal(38,0)))"), F.expr("sum(cast(v % 1000003 as decimal(38,0)))")).first()
        return tuple(r)

    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        after = signature(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def fingerprint_classes(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): smallest fingerprint that each one is linked with, directly or through others."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors' radius serves thresholds of 0 to 2 bits")
    members = keep(fingerprints.select("fp").distinct(), "members")
    cells = members.mapInArrow(_replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    roots = components(cells.mapInArrow(_compare(max_bits), "u long, v long"))
    return members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; max_bits is 0, 1 or 2."""
    rows = keep(texts(docs, id_col, text_col).mapInArrow(tidy(_fingerprints), "doc_id long, fp long"), "fingerprints")
    placed = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(fingerprint_classes(rows, max_bits), "fp")
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Column that rows carry while one of each group is chosen.
ROW = "_simhash_row"


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of docs for each group of linked fingerprints: the one with the smallest id (rows without one come last), then the smallest text.

    Rows are written once with a number of their own, so rows that share an id, or have none, are told apart; of rows that are
    equal in id and text one stays.
    """
    rows = keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    # Python sees a row's number and text and returns its number and fingerprint; all else stays with Spark
    marks = keep(rows.select(F.col(ROW).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(_fingerprints), "doc_id long, fp long").withColumnRenamed("doc_id", ROW), "marks")
    short = rows.select(ROW, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_simhash_text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_simhash_text", ROW)).alias("first")
    of_fp = short.join(marks, ROW).groupBy("fp").agg(first)
    stay = of_fp.join(fingerprint_classes(marks, max_bits), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return rows.join(stay, ROW, "left_semi").select(*docs.columns)
