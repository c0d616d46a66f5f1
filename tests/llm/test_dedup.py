import hashlib
import random

import numpy as np
import pytest

from assayer.llm import simhash, suffix_dedup


def brute_spans(rows, length=50):
    texts = [(i if i is not None else -(1 << 63), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_spans_equal_brute_force(docs, small_docs, monkeypatch):
    assert result(suffix_dedup.removed_spans(docs)) == brute_spans(small_docs)


def test_many_shards_and_hot_anchors(spark, small_docs, monkeypatch):
    r = random.Random(2)
    phrase = "a very frequent phrase of thirty-odd bytes "
    rows = small_docs + [(200 + i, f"{r.random()} {phrase}{r.random()} and {phrase}{r.choice('xyz')} tail of some length {i % 3}") for i in range(60)] + [(None, phrase * 3)]
    for name, value in (("SHARD", 2000), ("HOT_HERE", 4), ("HOT", 8), ("FLUSH", 200), ("BLOCK", 3000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffix_dedup.removed_spans(df)) == brute_spans(rows)


def test_rows_without_an_id_come_first(spark):
    a, b = "first passage " * 8, "second passage, which is longer " * 5
    rows = [(None, a), (None, a), (None, b + a), (7, b), (-5, a), (None, None)]
    got = [(x["doc_id"], x["kept"]) for x in suffix_dedup.removed_spans(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()]
    assert len(got) == 6 and (7, "") in got and (-5, "") in got and (None, "") in got
    lone = [t for i, t in got if i is None and t]
    assert b + a in lone and lone.count(a) in (0, 2) or lone.count(a) == 2 and b in "".join(lone)


def test_kept_text_and_carried_columns(docs):
    out = suffix_dedup.removed_spans(docs, with_text=True, carry=("lang", "shard"))
    r = {x["doc_id"]: x for x in out.collect()}
    assert r[101]["kept"] == "" and r[101]["lang"] == "en" and r[101]["shard"] == "x"
    assert r[104]["n_bytes"] == 0 and r[104]["kept"] == ""


def test_no_rows(empty):
    assert suffix_dedup.removed_spans(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0


def test_interval_expansion_is_the_common_prefix():
    r = np.random.default_rng(1)
    sizes = np.array([int(x) for x in r.integers(1, 90, 30)])
    raw = r.integers(97, 100, int(sizes.sum())).astype(np.uint8)
    at = np.cumsum(sizes) - sizes
    raw[at[3]:at[3] + min(sizes[3], sizes[4])] = raw[at[4]:at[4] + min(sizes[3], sizes[4])]
    for length in (1, 3, 6):
        got = suffix_dedup.repeated_windows(raw, sizes, length)
        strings = {}
        for s, n in zip(at, sizes):
            for p in range(n):
                g = got[s + p]
                if p + length > n:
                    assert g == -1
                else:
                    assert strings.setdefault(bytes(raw[s + p:s + p + length]), g) == g
        assert len(set(strings.values())) == len(strings)


def test_part_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, -5, 10**12, -(1 << 63)]
    got = [x[0] for x in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(13).cast("long"))).collect()]
    assert suffix_dedup.part_of(np.array(ids), 13).tolist() == got


def brute_fp(text):
    import re

    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs, small_docs):
    fps = [brute_fp(t) for _, t in small_docs]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    smallest = {}
    for i in range(len(fps)):
        smallest[find(i)] = min(smallest.get(find(i), 1 << 62), small_docs[i][0])
    want = sorted((small_docs[i][0], format(fps[i], "016x"), smallest[find(i)]) for i in range(len(fps)))
    assert sorted(map(tuple, simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_links_do_not_depend_on_batches(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(4)
    base = r.integers(-(1 << 62), 1 << 62, 12)
    fp = np.unique(np.concatenate([base ^ (np.int64(1) << np.int64(k)) for k in range(0, 40, 3)]))
    row, anchor = simhash.anchors(fp.view(np.uint64))
    order = np.argsort(anchor.view(np.int64), kind="stable")
    a, f = anchor.view(np.int64)[order], fp[row][order]
    parts = lambda n: [pa.RecordBatch.from_arrays([pa.array(a[s:s + n]), pa.array(f[s:s + n])], ["anchor", "fp"]) for s in range(0, len(a), n)]
    links = lambda n: {(x["u"], x["v"]) for b in simhash._compare(2)(iter(parts(n))) for x in b.to_pylist()}
    assert links(7) == links(len(a)) and len(links(7)) > 10 and not list(simhash._compare(2)(iter([])))


def test_chains_are_followed(spark):
    """A chain of links two bits long each is one component."""
    fps = [0]
    for k in range(20):
        fps.append(fps[-1] ^ (3 << (2 * k)))
    edges = spark.createDataFrame([(a, b) for a, b in zip(fps, fps[1:])], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(got.values()) == {0} and len(got) == 20


def test_anchors_cover_every_pair():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**64, 60, dtype=np.uint64)
    for bits in (0, 1, 2):
        y = x.copy()
        for k in range(bits):
            y ^= np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64)
        rows = [{}, {}]
        for k, v in enumerate((x, y)):
            row, anchor = simhash.anchors(v)
            for a, b in zip(row, anchor):
                rows[k].setdefault(int(a), set()).add(int(b))
        assert all(rows[0][i] & rows[1][i] for i in range(60))
        assert max(map(len, rows[0].values())) <= 32


@pytest.mark.parametrize("bits", [-1, 3])
def test_threshold_is_checked(docs, bits):
    with pytest.raises(ValueError):
        simhash.simhash_components(docs, max_bits=bits)


def test_pieces_stand_together_and_side_by_side_ranges_are_one(monkeypatch):
    rng = np.random.default_rng(4)
    anchor, content = rng.integers(0, 30, 2000).astype(np.uint64), rng.integers(0, 4, 2000).astype(np.uint64)  # equal upper halves of the hashes
    for extra in (content, content << np.uint64(60)):
        order = suffix_dedup._together(anchor, extra)
        first, size = suffix_dedup._groups(anchor[order], extra[order])
        assert len(first) == len(set(zip(anchor.tolist(), extra.tolist()))) and size.sum() == 2000 and sorted(order.tolist()) == list(range(2000))
    text = bytes(rng.integers(97, 123, 3000, np.uint8)).decode()
    import pyarrow as pa

    rows = pa.table({"shard": [0, 0], "doc_id": [1, 2], "text": [text, text]})
    told = pa.Table.from_batches(list(suffix_dedup._send_hashes(1, 1, 50)(rows.select(["doc_id", "text"]).to_batches())))
    replies = [t for k in (0, 1) if (t := told.filter(pa.compute.equal(told.column("kind"), k))).num_rows]
    replies = pa.concat_tables([suffix_dedup._reply(1)((pa.scalar(k),), t) for k, t in enumerate(replies)])
    sent = suffix_dedup._send_pieces(1, 1, 1, 50)((pa.scalar(0),), rows, replies)
    ranges = [suffix_dedup._unpack(r["blob"], "<i8", "<i8", "<i8") for r in sent.to_pylist() if r["kind"] == 2]
    assert sum(len(own) for own, _, _ in ranges) == 1  # the whole copy, not one range a piece
    assert [(int(p[0]), int(n[0])) for _, p, n in ranges if len(p)] == [(0, 3000 - 49)]
