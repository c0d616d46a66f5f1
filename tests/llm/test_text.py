import itertools
import random
import re
import zlib

import pytest

from assayer.llm import decontaminate, html_text, licenses, packing, quality, toxicity

PATH = None


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- packing ----

def test_encoder_equals_tokenizer(vocabulary, small_docs):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    r = random.Random(1)
    odd = ["Áb  x <|endoftext|>y don't I'LL 12½ ΑΣ İ \x1cq", "", " \n\r\t ", "a\x0bb", "Ünïcödé—test…", "ﬁ ½²3", "😀ok 漢字カナ", *("".join(chr(r.choice([*range(32, 1000), 0x3042, 0x1F600])) for _ in range(60)) for _ in range(60))]
    words = ["".join(r.choice(["th", "er", "lo", "wei", "é", "ion", "x", "qu", "a"]) for _ in range(r.randint(1, 7))) for _ in range(3000)]
    for text in (*odd, *(x or "" for _, x in small_docs), " ".join(words)):
        assert e(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(docs, small_docs, vocabulary):
    e = packing.Encoder(vocabulary)
    capacity = 64
    rows = packing.pack(docs, vocabulary, capacity).collect()
    want = []
    for i, t in small_docs:
        ids = [*e(t or "").tolist(), 1]
        want += [(i, k, s, len(ids[s:s + capacity]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s:s + capacity]))) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // capacity) + 1


def _optimal(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_instances(seed):
    r = random.Random(seed)
    lengths = [r.randint(5, 60) for _ in range(11)]
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.complete_bins(counts, 100)
    used = {}
    for filling, times in plan:
        assert sum(filling) <= 100
        for n in filling:
            used[n] = used.get(n, 0) + times
    assert used == counts
    assert sum(t for _, t in plan) == _optimal(lengths, 100)


@pytest.mark.parametrize("seed", range(8))
def test_every_undominated_filling_is_enumerated(seed):
    r = random.Random(seed)
    counts = {n: r.randint(1, 3) for n in r.sample(range(3, 40), 7)}
    state, largest = packing.Fillings(counts, 60), max(counts)
    got = list(state.around(largest, 60))
    stock = {n: c - (n == largest) for n, c in counts.items()}
    want = set()
    for picks in itertools.product(*(range(c + 1) for c in stock.values())):
        rest = [n for n, k in zip(stock, picks) for _ in range(k)]
        waste = 60 - largest - sum(rest)
        outside = [n for n, k in zip(stock, picks) if stock[n] > k]
        if waste >= 0 and not any(n <= waste for n in outside) and not any(m < n <= m + waste for m in rest for n in outside):
            want.add((largest, *sorted(rest, reverse=True)))
    if stock.get(60 - largest):
        want = {(largest, 60 - largest)}
    assert len(got) == len(set(got)) and set(got) == want
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_lower_bound_and_gain_over_best_fit():
    assert packing.lower_bound({60: 3, 30: 1}, 100) == 3 and packing.lower_bound({}, 100) == 0
    counts = {48: 2, 35: 2, 17: 4}  # best-fit fills 48 + 48 first
    assert sum(t for _, t in packing.best_fit(counts, 100)) == 3 and packing.lower_bound(counts, 100) == 3
    r = random.Random(1)
    counts = {}
    for _ in range(5000):
        n = r.randint(1, 400)
        counts[n] = counts.get(n, 0) + 1
    assert sum(t for _, t in packing.complete_bins(counts, 400)) <= sum(t for _, t in packing.best_fit(counts, 400))


def test_packing_of_nothing(empty, vocabulary):
    assert packing.pack(empty, vocabulary).count() == 0


# ---- licences ----

def test_licence_places(spark, docs, small_docs):
    texts = ["Licensed under CC BY-NC 4.0.", "cc by cc\nby CC", "...all rights reserved", "All Rights Reserved", "this work is licensed under the GNU General Public License, version 3.", "general public", "the licence of Apache", "Licensed under the Apache License, Version 2.0.", "", None, "x" * 10000, "é all rights reserved all rights reserved"]
    rows = [*enumerate(texts), *((100 + i, t) for i, (_, t) in enumerate(small_docs))]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None), ",".join(sorted({p[1] for p in places}))), t
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    assert got[7]["labels"] == "apache-2.0" and got[4]["labels"] == "gpl,gpl-3.0" and got[0]["labels"] == "cc-by,cc-by-nc-4.0" and got[6]["labels"] == ""


def test_licences_need_agreeing_postings(spark):
    texts = ["we like the apache license and its friends", "in this story all rights reserved seats were taken", "a mozilla public license exists, and a lesser general public license",
             "permission is hereby granted to sing", "licensed here and now; the apache license", "Licensed under the Apache License", "Copyright: all rights reserved",
             "we say: Permission is hereby granted, free of charge, to any person obtaining a copy", "x " * 40 + "subject to the terms of the Mozilla Public License, version 2.0", " ".join(sorted({w for _, _, n in licenses.NOTICES for w in n.split()})) + " licensed under cc by nc"]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(rows).collect()}
    assert [got[i] for i in range(len(texts))] == ["", "reserved", "gpl", "", "", "apache-2.0", "proprietary,reserved", "mit", "mpl-2.0", "cc-by,cc-by-nc-4.0"]


def test_labels_equal_brute_force(spark):
    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        labels = {label for p, label in licenses.PHRASES.items() if any(words[k:k + len(p.split())] == p.split() for k in range(len(words)))}
        for label, key, notice in licenses.NOTICES:
            n, k = notice.split(), key.split()
            at = next(i for i in range(len(n)) if n[i:i + len(k)] == k)
            rare = [i for i, w in enumerate(n) if w not in licenses.COMMON]
            for s in range(-len(n), len(words)):
                there = lambda i: 0 <= s + i < len(words) and words[s + i] == n[i]
                agree = [i for i in rare if there(i)]
                outside = [i for i in rare if not at <= i < at + len(k)]
                if all(there(at + i) for i in range(len(k))) and len(agree) >= licenses.AGREE and (not outside or set(outside) & set(agree)):
                    labels.add(label)
        return ",".join(sorted(labels))

    r = random.Random(6)
    vocabulary = sorted({w for _, _, n in licenses.NOTICES for w in n.split()})
    texts = [n for _, _, n in licenses.NOTICES] + [" ".join(n for _, _, n in licenses.NOTICES)]
    for _ in range(150):
        w = " ".join(r.choice(licenses.NOTICES)[2] for _ in range(r.randint(1, 3))).split()
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(w))
            w[k:k + r.choice([0, 1, 1])] = [r.choice(vocabulary)]
        a = r.randrange(len(w))
        texts.append(" ".join(w[a:a + r.randint(3, 60)]) + r.choice([".", "", ", and so on"]))
    got = {x["doc_id"]: x["labels"] for x in licenses.scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len({x for v in got.values() for x in v.split(",")}) > 12


def test_licences_of_nothing(empty):
    assert licenses.scan(empty).count() == 0


# ---- decontamination ----

def test_leaks_with_substitutions(spark, empty):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(90, None), (91, "..."), (92, " ".join(word() for _ in range(6)))]
    swap = lambda text, step: " ".join(word() if i % step == step - 1 else w for i, w in enumerate(text.split()))
    pad = lambda: " ".join(word() for _ in range(40))
    docs = [(1, f"{pad()} {items[0][1].upper()}, {pad()}", True), (2, f"{pad()} {swap(items[1][1], 7)} {pad()}", True), (3, pad(), False), (4, f"{pad()} {swap(items[2][1], 2)}", False), (5, None, False), (6, "", False),
            (7, " ".join(items[3][1].split()[:14]), True), (8, " ".join(items[3][1].split()[:6]), False), (9, f"x {items[8][1]} y", True), (10, items[0][1], True), (10, items[0][1], True), (None, items[0][1], True), (None, pad(), False), (10, pad(), False)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").selectExpr("*", "1 as at", "2 as seed", "'h' as h", "7 as leak_id", "8 as text_hash", "9 as _leak")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(x["doc_id"], x["contaminated"]) for x in decontaminate.decontamination_report(d, b).collect()]
    assert sorted(got, key=str) == sorted(((i, c) for i, _, c in docs), key=str)
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(map(str, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(str((i, t)) for i, t, c in docs if not c)
    assert decontaminate.decontamination_report(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontamination_report(empty, b).count() == 0


def brute_leaks(docs, items):
    """(doc, item) where a window of 13 aligned tokens, or the whole item, agrees in 80 %."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for d, text in docs:
        a = split(text)
        for k, item in items:
            b = split(item)
            n = min(13, len(b))
            for i in range(len(b) - n + 1):
                if n and any(5 * sum(x == y for x, y in zip(a[p:p + n], b[i:i + n])) >= 4 * n for p in range(len(a) - n + 1)):
                    out.add((d, k))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(12)
    vocabulary = [a + b for a in "bcdfgh" for b in "aeiou"]
    items = [(n * 100 + k, " ".join(r.choice(vocabulary) for _ in range(n))) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20) for k in range(3 if n > 3 else 1)]
    docs = []
    for i, (_, t) in enumerate(items * 4):
        w = t.split()
        for k in r.sample(range(len(w)), min(len(w), r.randint(0, 4))):
            w[k] = "zz" + w[k]
        docs.append((i, " ".join([r.choice(vocabulary) for _ in range(9)] + w + [r.choice(vocabulary) for _ in range(5)])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == brute_leaks(docs, items)


def test_masks_are_complete():
    for n in range(1, 14):
        masks = decontaminate.short_masks(n) if n < 13 else decontaminate.MASKS
        for bad in itertools.combinations(range(n), decontaminate.tolerated(n)):
            assert any(not {at + o for o in m} & set(bad) for m in masks for at in (range(n - max(m)) if n == 13 else [0])), (n, bad)


def test_shuffled_join_gives_the_same(spark, sf, monkeypatch):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(d, b).collect())) == want


# ---- classifiers ----

def test_toxicity_on_held_out_rows(spark):
    root = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = toxicity.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(1 for r in got if r["toxic"] and r["predicted"])
    false = sum(1 for r in got if not r["toxic"] and r["predicted"])
    toxic = sum(r["toxic"] for r in got)
    assert hit / toxic > 0.7 and false / (len(got) - toxic) < 0.08
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_classifiers_on_odd_rows(docs, empty, spark, small_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for df, n in ((docs, len(small_docs)), (empty, 0)):
        t = toxicity.classify(df, labels).collect()
        q = quality.weigh(df, labels).collect()
        assert len(t) == len(q) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in t)
    none = labels.limit(0)
    assert all(r["score"] == 0 for r in toxicity.classify(docs, none).collect())
    q = {r["doc_id"]: r["selected"] for r in quality.weigh(docs, none).collect()}
    assert not q[103] and not q[104] and q[0]


def test_quality_separates(spark, sf):
    root = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = quality.weigh(d, labels).join(labels, "doc_id").collect()
    good, bad = [r["selected"] for r in got if r["quality"]], [r["selected"] for r in got if not r["quality"]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.2
    chosen = quality.select_documents(d, labels)
    assert chosen.columns == d.columns and chosen.count() == quality.weigh(d, labels).where("selected").count()


def test_kth_largest(spark):
    r = random.Random(9)
    values = [r.random() for _ in range(500)] + [0.5] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 260, 550):
        assert quality.kth_largest(df, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]


# ---- pages ----

def test_extraction(spark):
    article = "<article><h1>A &amp; B</h1><p>one\n two<p>three<br>four<nav>menu</nav></article>"
    same = [(i, f"https://h.example/{i}", f"<body><p>We use small cookies on this site to serve you</p><p>story {i} has its own words</p><div class='side-bar ad'>buy</div></body>") for i in range(8)]
    rows = [(100, "https://x.example/a", f"<html><head><title>t</title><script>var a='</p>';</script></head><body><header>h</header>{article}<footer>f</footer>"), (101, None, None), (102, "odd", ""), (103, "https://x.example/b", "plain &lt;b&gt; text"), (103, "https://x.example/b", "plain &lt;b&gt; text"),
            (104, "https://x.example/c", "<div id=comments><p>reader</p></div><form>f</form><main><p>kept</p></main>")]
    df = spark.createDataFrame(same + rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as part", "'z' as main")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[100]["text"] == "A & B\none two\nthree four" and got[100]["n_chars"] == len(got[100]["text"])
    assert got[101]["text"] == got[102]["text"] == "" and got[103]["text"] == "plain <b> text" and got[104]["text"] == "kept"
    assert [got[i]["text"] for i in range(8)] == [f"story {i} has its own words" for i in range(8)]
    assert html_text.extract(df.limit(0)).count() == 0 and html_text.extract(df).count() == len(same + rows)


def test_hinted_blocks_of_an_article_are_the_hosts_to_decide(spark):
    share = "<div class='share-bar'>Tell all of your friends about this page right now please</div>"
    page = lambda i: f"<article><p>story {i} starts with words {i}</p>{share}<section class='search-study'>how people search in town {i}</section><div class='share-prices'>prices of day {i}</div><div class='ad'>buy {i}</div><p>the end of story {i}</p></article>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(7)] + [(50 + i, f"https://few.example/{i}", page(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(7):
        assert got[i] == f"story {i} starts with words {i}\nhow people search in town {i}\nprices of day {i}\nthe end of story {i}"
    assert all("Tell all of your friends" in got[50 + i] for i in range(3))


def test_hostile_pages_take_linear_time():
    import time

    n = 1 << 20
    for page in ("<a " * (n // 3), "<a \">\" " * (n // 8), "<p class='" * (n // 10), "<div>" * (n // 5), "<div>" * 20_000 + "</p></ul>" * 40_000, "<!--" * (n // 4), "<" * n, "<script>" * (n // 8), "<a '" * 9 + "x>" * (n // 2)):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 5, page[:20]
    assert html_text.blocks("<p>1 < 2 and <b>3 > 2</b><p title='a>b'>x<y")[0] == ["1 < 2 and 3 > 2", "x<y"]


def test_repeated_tokens_equal_brute_force():
    import numpy as np

    r = random.Random(8)
    pages = [[r.randint(0, 2) for _ in range(r.randint(0, 25))] for _ in range(12)]
    tokens, owner = np.array([t for p in pages for t in p]), np.array([k for k, p in enumerate(pages) for _ in p])
    for depth, least in ((2, 3), (4, 3), (3, 8)):
        seen = {}
        for k, p in enumerate(pages):
            for i in range(len(p) - depth + 1):
                seen.setdefault(tuple(p[i:i + depth]), set()).add(k)
        want = []
        for p in pages:
            m = [False] * len(p)
            for i in range(len(p) - depth + 1):
                if len(seen[tuple(p[i:i + depth])]) >= least:
                    m[i:i + depth] = [True] * depth
            want += m
        assert html_text.repeated_tokens(tokens, owner, depth, least).tolist() == want


def test_copies_of_a_page_keep_their_text():
    assert html_text.boilerplate_blocks([["the same long story told on every copied page", "and how it ends for all of them today"]] * 9) == [[False, False]] * 9


def test_repeated_runs_go_and_unique_runs_stay():
    notice = "this site is run by the harbour club and all its many friends"
    pages = [[f"story {i} has words of its own", f"seen on day {i} : {notice} , counter {i * 7}", f"end {i}"] for i in range(9)]
    assert html_text.kept_text(pages) == [[p[0], f"seen on day {i} {i * 7}", p[2]] for i, p in enumerate(pages)]
    assert html_text.kept_text(pages[:4]) == pages[:4]


def test_parts_of_a_host_decide_as_the_whole(spark, monkeypatch):
    notice, short = "this site is run by the harbour club and all its many friends", "Contact us now"
    page = lambda i: f"<p>story {i} has words of its own</p>" + (f"<p>on day {i} {notice}</p><p>more {i}</p>" if i % 10 == 0 else "") + (f"<div>{short}</div><p>last {i}</p>" if i % 8 == 0 else "")
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(80)] + [(900 + i, f"https://k.example/{i}", page(i)) for i in range(3)], "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.extract(df).collect()))
    assert dict((r[0], r[2]) for r in want)[40] == "story 40 has words of its own\non day 40\nmore 40\nlast 40"
    monkeypatch.setattr(html_text, "PART_PAGES", 10)
    assert sorted(map(tuple, html_text.extract(df).collect())) == want


@pytest.mark.parametrize("part", [500, 3])
def test_the_array_decides_about_articles_too(spark, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART_PAGES", part)
    notice, shared, title = "this site is run by the harbour club and all its friends", "a passage that many articles quote word for word in full", "how one long title stands in the sidebars of all pages"
    page = lambda i: f"<article><p>story {i} begins</p><p>day {i} : {notice} , {i * 7}</p><p>{shared}</p>" + (f"<h1>{title}</h1>" if i == 3 else "") + f"<p>end {i}</p></article><aside>see {i}<p>{title}</p>more {i}</aside><footer>page {i} {notice} c {i}</footer>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(9)] + [(50 + i, f"https://few.example/{i}", page(i)) for i in range(4)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        want = "\n".join([f"story {i} begins", f"day {i} : , {i * 7}", shared, *([title] if i == 3 else []), f"end {i}"])
        assert got[i] == (want, len(want))
    assert all(notice in got[50 + i][0] for i in range(4)) and len(got) == 13
