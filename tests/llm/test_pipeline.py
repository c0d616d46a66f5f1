import random

import corpus_pipeline as cp
from assayer.llm import packing, quality
from assayer.llm.queries import tokenizer_path

from .test_dedup import brute_fp, brute_spans
from .test_text import brute_leaks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, stay_id int, leak_id int, gumbel_key int, component_id int"


def table(spark, rows):
    """Documents with extra columns that have names the stages use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", -1, "k", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def odd_rows():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("river stone cloud paper green seven lamp house under over maker".split()) + r.choice(["", "s", "ly"]) for _ in range(n))
    rows = [(i, say(r.randint(8, 60))) for i in range(30)]
    rows += [(None, say(25)), (None, say(31)), (None, rows[4][1]), (None, None), (5, say(20)), (5, rows[5][1]), (40, rows[2][1]), (41, rows[2][1]), (42, ""), (43, None), (44, "   "), (45, say(3000))]
    return rows


def sizes_follow(df):
    return all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_quality_equals_brute_force(spark, sf):
    from collections import Counter

    import numpy as np

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), (10**6, ""), (3, "repeated id here")]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    raw, target = Counter(), Counter()
    for i, t in docs:
        c = Counter(quality.cells(t or "").tolist())
        raw.update(c)
        if good.get(i) == 1:
            target.update(c)
    kinds = [range(0, quality.WORD_CELLS), range(quality.WORD_CELLS, quality.WORD_CELLS + quality.PAIR_CELLS), range(quality.WORD_CELLS + quality.PAIR_CELLS, quality.CELLS)]
    ratio = {}
    for kind in kinds:
        n, m = (sum(x[c] + 1 for c in kind) for x in (raw, target))
        ratio |= {c: np.log((target[c] + 1) / m) - np.log((raw[c] + 1) / n) for c in kind}
    keys = []
    for i, t in docs:
        found = quality.cells(t or "").tolist()
        keys.append(quality.LENGTH * sum(ratio[c] for c in found) / len(found) + quality.gumbel(i) if found else None)
    share = sum(good.values()) / len(good)
    share += (share * (1 - share) / len(good)) ** 0.5
    able = sorted((k for k in keys if k is not None), reverse=True)
    cut = able[int(np.ceil(len(able) * share)) - 1]
    got = cp.quality(spark, table(spark, docs), sf)
    assert pairs(got) == sorted([d for d, k in zip(docs, keys) if k is not None and k >= cut - 1e-6], key=str)
    assert got.columns == table(spark, docs).columns


def test_near_duplicates_equal_brute_force(spark, sf):
    rows = odd_rows()
    root = list(range(len(rows)))
    fps = [brute_fp(t) for _, t in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(root[k], []).append((i is None, i or 0, t))
    got = cp.near_duplicates(spark, table(spark, rows), sf)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == table(spark, rows).columns and len(kept) == len(groups)
    for members in groups.values():
        least = min(m[:2] for m in members)
        assert sum((i is None, i or 0, t) in members and (i is None, i or 0) == least for i, t in kept) == 1


def test_repeated_passages_equal_brute_force(spark, sf):
    rows = [x for x in odd_rows() if x[0] is not None]
    got = cp.repeated_passages(spark, table(spark, rows), sf)
    assert got.columns == table(spark, rows).columns and sizes_follow(got)
    assert sorted(len(r["text"].encode()) for r in got.collect()) == sorted(n - gone for n, gone, _, _ in brute_spans(rows))
    assert all(r["kept"] == "k" and r["lang"] == "en" for r in got.collect())


def test_decontamination_equals_brute_force(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:8]
    rows = odd_rows() + [(100 + k, f"before it {t} after it") for k, (_, t) in enumerate(items)] + [(None, items[0][1]), (None, "a clean text"), (100, "also clean")]
    leaks = {k for k, _ in brute_leaks([(k, t) for k, (_, t) in enumerate(rows)], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    got = cp.decontamination(spark, table(spark, rows), sf)
    assert got.columns == table(spark, rows).columns and len(leaks) >= 9
    assert pairs(got) == sorted((x for k, x in enumerate(rows) if k not in leaks), key=str)


def test_stages_take_no_rows(spark, sf):
    for _, stage in cp.STAGES:
        assert stage(spark, table(spark, []), sf).count() == 0


def test_whole_run_equals_its_stages(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.keep(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    rows = docs.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    # what is left: no long passage twice, no passage of the benchmark
    assert not any(gone for _, gone, _, _ in brute_spans([(r["doc_id"], r["text"]) for r in rows]))
    assert not brute_leaks([(r["doc_id"], r["text"]) for r in rows[:40]], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:10])
    e = packing.Encoder(tokenizer_path())
    pieces = cp.run(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in rows}
    assert sum(p["length"] for p in pieces) == sum(len(e(r["text"])) + 1 for r in rows)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
