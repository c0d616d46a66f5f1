import hashlib
import struct
import zlib

import numpy as np
import pytest

from assayer.llm import warc, webp


class Out:
    """Bits from the least significant on, and canonical prefix codes, to write streams that use what the encoder does not."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def code(self, lengths):
        """Write code lengths plainly; return each symbol's bits, first bit first."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(used[0], 8)
            return {used[0]: []}
        self.put(0, 1)
        present = sorted(set(lengths))
        own = {n: 0 for n in range(19)}
        size = max(1, (len(present) - 1).bit_length())
        for n in range(16):
            if len([k for k in own if own[k]]) < 1 << size and (n in present or len(present) < 1 << size and n not in present and sum(own.values()) // size + len([p for p in present if not own[p]]) < 1 << size):
                own[n] = size
        self.put(19 - 4, 4)
        for k in webp.LENGTH_ORDER:
            self.put(own.get(k, 0), 3)
        self.put(0, 1)
        names = self.canonical([own[k] for k in range(19)])
        for n in lengths:
            self.bits += names[n]
        return self.canonical(lengths)

    @staticmethod
    def canonical(lengths):
        code, last, out = 0, 0, {}
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            out[s] = [int(x) for x in format(code, f"0{n}b")]
            code += 1
        return out

    def file(self):
        raw = bytes([0x2F]) + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        pad = b"\0" * (len(raw) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(raw) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(raw)) + raw + pad


def lengths_for(symbols, size):
    used = sorted(set(symbols))
    n = max(1, (len(used) - 1).bit_length())
    spare = [s for s in range(size) if s not in used]
    used += spare[:(1 << n) - len(used)]
    return [n if s in set(used) else 0 for s in range(size)]


def prefix_value(v):
    """Symbol, extra bits and their number of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def image(out, argb, cache_bits=0, refs=(), top=False):
    """Pixels; refs: {place: (length, distance code)}; with a cache, a pixel that it holds is written as its index."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    refs, tokens, at, cache = dict(refs), [], 0, {}
    slot = lambda c: (0x1E35A7BD * int(c) & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(argb):
        if at in refs:
            n, d = refs[at]
            tokens.append(("ref", prefix_value(n), prefix_value(d)))
            seen = argb[at:at + n]
            at += n
        elif cache_bits and cache.get(slot(argb[at])) == argb[at]:
            tokens.append(("cache", slot(argb[at])))
            seen = [argb[at]]
            at += 1
        else:
            tokens.append(("pixel", int(argb[at])))
            seen = [argb[at]]
            at += 1
        for c in seen if cache_bits else ():
            cache[slot(c)] = c
    green = [t[1] >> 8 & 255 if t[0] == "pixel" else 280 + t[1] if t[0] == "cache" else 256 + t[1][0] for t in tokens]
    names = [out.code(lengths_for(green, 280 + (1 << cache_bits if cache_bits else 0)))]
    for shift in (16, 0, 24):
        names.append(out.code(lengths_for([t[1] >> shift & 255 for t in tokens if t[0] == "pixel"] or [0], 256)))
    names.append(out.code(lengths_for([t[2][0] for t in tokens if t[0] == "ref"] or [0], 40)))
    for t, g in zip(tokens, green):
        out.bits += names[0][g]
        if t[0] == "pixel":
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                out.bits += names[k][t[1] >> shift & 255]
        elif t[0] == "ref":
            out.put(t[1][1], t[1][2])
            out.bits += names[4][t[2][0]]
            out.put(t[2][1], t[2][2])


def start(width, height):
    out = Out()
    out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    return out


def pixels(argb, width):
    return np.array(argb, ">u4").view(np.uint8).reshape(-1, width, 4)


def test_back_references_and_colour_cache():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**32, 8)
    argb = [int(base[k]) for k in r.integers(0, 8, 64)]
    argb[20:30] = argb[10:20]  # ten pixels on: distance 10
    argb[40:56] = argb[32:48] if False else [argb[39]] * 16  # a run: distance 1
    for cache in (0, 4):
        out = start(8, 8)
        out.put(0, 1)
        image(out, argb, cache, {20: (10, 10 + 120), 40: (16, 2)}, top=True)
        assert (webp.decode(out.file()) == pixels(argb, 8)).all()


def test_near_distances():
    argb = list(range(0xFF000000, 0xFF000000 + 32)) + [0] * 16
    argb[32:40] = argb[24:32]  # the row above: code 1
    argb[40:48] = argb[40 - 9:48 - 9]  # up and left: x = 1, y = 1, code 3
    out = start(8, 6)
    out.put(0, 1)
    image(out, argb, 0, {32: (8, 1), 40: (8, 3)}, top=True)
    assert (webp.decode(out.file()) == pixels(argb, 8)).all()


def test_subtract_green_and_palette():
    r = np.random.default_rng(2)
    p = r.integers(0, 256, (4, 8, 4)).astype(np.uint8)
    q = p.copy()
    q[..., 1] -= p[..., 2]
    q[..., 3] -= p[..., 2]
    out = start(8, 4)
    out.put(1, 1), out.put(webp.SUBTRACT_GREEN, 2), out.put(0, 1)
    image(out, q.reshape(-1, 4).copy().view(">u4").reshape(-1).tolist(), top=True)
    assert (webp.decode(out.file()) == p).all()
    for n in (2, 3, 11, 40):
        palette = r.integers(0, 2**32, n)
        index = r.integers(0, n, (5, 13))
        each = 1 if n <= 2 else 2 if n <= 4 else 4 if n <= 16 else 8
        per = 8 // each
        across = -(-13 // per)
        packed = [sum(int(index[y, x]) << (each * (x % per)) for x in range(c * per, min(13, (c + 1) * per))) << 8 | 0xFF000000 for y in range(5) for c in range(across)]
        colours = np.array(palette, ">u4").view(np.uint8).reshape(-1, 4)
        deltas = np.diff(colours.astype(np.int64), axis=0, prepend=np.zeros((1, 4), np.int64)).astype(np.uint8)
        out = start(13, 5)
        out.put(1, 1), out.put(webp.PALETTE, 2), out.put(n - 1, 8)
        image(out, deltas.copy().view(">u4").reshape(-1).tolist())
        out.put(0, 1)
        image(out, packed, top=True)
        assert (webp.decode(out.file()) == colours[index]).all()


def predict(mode, p, y, x, width):
    left, top, corner = (p[y, x - 1] if x else None), p[y - 1, x] if y else None, p[y - 1, x - 1] if x and y else None
    if not x and not y:
        return np.array([255, 0, 0, 0])
    if not y:
        return left
    if not x:
        return top
    right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
    avg = lambda a, b: (a + b) // 2
    clip = lambda v: np.clip(v, 0, 255)
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 13:
        a = avg(left, top)
        return clip(a + np.trunc((a - corner) / 2).astype(int))
    return {0: lambda: np.array([255, 0, 0, 0]), 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: avg(avg(left, right), top), 6: lambda: avg(left, corner), 7: lambda: avg(left, top), 8: lambda: avg(corner, top), 9: lambda: avg(top, right), 10: lambda: avg(avg(left, corner), avg(top, right)), 12: lambda: clip(left + top - corner)}[mode]()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    r = np.random.default_rng(mode)
    p = r.integers(0, 256, (6, 7, 4)).astype(int)
    rest = np.array([[(p[y, x] - predict(mode, p, y, x, 7)) % 256 for x in range(7)] for y in range(6)]).astype(np.uint8)
    out = start(7, 6)
    out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(0, 3)
    image(out, [0xFF000000 | mode << 8] * 4)
    out.put(0, 1)
    image(out, rest.reshape(-1, 4).copy().view(">u4").reshape(-1).tolist(), top=True)
    assert (webp.decode(out.file()) == p).all()


def test_cross_colour():
    r = np.random.default_rng(5)
    p = r.integers(0, 256, (4, 4, 4)).astype(int)
    rb, gb, gr = 37, 200, 91
    s = lambda v: v - 256 if v > 127 else v
    q = p.copy()
    for y in range(4):
        for x in range(4):
            _, red, green, blue = (int(v) for v in p[y, x])
            q[y, x, 1] = (red - (s(gr) * s(green) >> 5)) % 256
            q[y, x, 3] = (blue - (s(gb) * s(green) >> 5) - (s(rb) * s(red) >> 5)) % 256
    out = start(4, 4)
    out.put(1, 1), out.put(webp.CROSS_COLOUR, 2), out.put(0, 3)
    image(out, [0xFF000000 | rb << 16 | gb << 8 | gr])
    out.put(0, 1)
    image(out, q.astype(np.uint8).reshape(-1, 4).copy().view(">u4").reshape(-1).tolist(), top=True)
    assert (webp.decode(out.file()) == p).all()


@pytest.mark.parametrize("raw", [b"", b"RIFF", webp.encode(b"a" * 64)[:30], b"RIFF" + webp.encode(bytes(range(64)))[4:28] + b"\xff" * 4])
def test_broken_files_are_refused(raw):
    with pytest.raises((ValueError, struct.error)):
        webp.decode(raw)


def test_round_trip_of_documents(docs, small_docs, empty):
    got = sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in webp.read_features(webp.store(docs)).collect()))
    want = []
    for i, t in small_docs:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    by_text = {}
    for r in webp.read_features(webp.store(docs)).collect():
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert webp.read_features(webp.store(empty)).count() == 0


@pytest.mark.parametrize("size", [64, 128, 4096, 64 * 1021, 64 * 16381])
def test_sizes(size):
    raw = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    assert webp.decode(webp.encode(raw)).tobytes() == raw


@pytest.mark.parametrize("size", [64 * 16411, 64 * 2 * 16411, 64 * 65537])
def test_sizes_that_fill_no_rows(size):
    raw = np.random.default_rng(size).integers(0, 256, 4096).astype(np.uint8).tobytes() * (size // 4096) + b"z" * (size % 4096)
    assert webp.decode(webp.encode(raw)).tobytes()[:size] == raw


def test_one_very_long_text(spark):
    text = "ab c" * (16 * 16411) + "x"
    rows = spark.createDataFrame([(1, "short"), (2, text[:-2])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in webp.read_features(webp.store(rows)).collect()}
    raw = text[:-2].encode()
    raw += b"\0" * (-len(raw) % 64)
    assert len(raw) == 64 * 16411 and got[1]["n_bytes"] == 5
    assert (got[2]["n_bytes"], got[2]["payload_bytes"], got[2]["payload_sha256"]) == (len(text) - 2, len(raw), hashlib.sha256(raw).hexdigest())


# ---- archives ----

def test_fixity_finds_planted_faults(spark):
    rows = [(i, f"https://h/{i}", f"<p>page {i}</p>" * (i % 40)) for i in range(600)] + [(None, None, None), (5, "https://h/5", "<p>page 5</p>" * 5), (9, "https://h/9", "other bytes")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as archive", "2 as place", "'x' as hash", "3 as n", "4 as copies")
    got = warc.fixity(pages, warc.damaged(pages)).collect()
    assert len(got) == 602 and sum(r["copies"] for r in got) == 603
    for r in got:
        i = r["page_id"]
        want = "missing" if i is not None and i % 499 == 3 else "changed" if i is not None and i % 101 == 7 and i % 40 else "intact"
        assert r["status"] == want, i
    assert warc.fixity(pages.limit(0), pages.limit(0)).count() == 0


def test_offsets_of_ids_that_hold_many_records(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2, 300]), "u", "x" * r.randint(0, 400) + str(r.randint(0, 150))) for _ in range(900)]
    got = warc.index(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == len(set(rows))
    at, number = {}, {}
    for x in sorted(got, key=lambda x: (x["archive"], x["page_id"] or 0, x["record_sha256"])):
        assert x["record_offset"] == at.get(x["archive"], 0) and x["number"] == number.get(x["page_id"], 0) + 1
        at[x["archive"]], number[x["page_id"]] = x["record_offset"] + x["record_length"], x["number"]


def test_roots_of_trees_of_any_height(spark):
    import hashlib

    leaves = [(0, k * 70_000, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(700)]
    table = spark.createDataFrame(leaves, "archive long, record_offset long, record_sha256 string")
    level, levels = {k: h for _, k, h in leaves}, warc.height(table)
    for k in range(levels):
        up = {}
        for place, h in sorted(level.items()):
            up.setdefault(place // (warc.RANGE if k == 0 else warc.FAN), []).append(f"{place}:{h}")
        level = {p: hashlib.sha256("|".join(v).encode()).hexdigest() for p, v in up.items()}
    assert levels > 3 and [(r["place"], r["hash"]) for r in warc.tree(table, levels)[-1].collect()] == list(level.items()) and len(level) == 1


def test_only_mismatching_branches(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('https://h/', id) as url", "repeat('x', 2000) as html")
    own = warc.index(warc.records(pages))
    assert warc.audit(own, own).count() == 0
    other = own.selectExpr("archive", "record_offset", "if(page_id = 77, 'bad', record_sha256) as record_sha256")
    assert [r["status"] for r in warc.audit(own, other).collect()] == ["changed"]
    extra = other.unionByName(spark.createDataFrame([(0, 10**6, "h")], "archive long, record_offset long, record_sha256 string"))
    assert sorted(r["status"] for r in warc.audit(own, extra).collect()) == ["changed", "extra"]


def test_records_are_archives(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "https://h/é", "<p>ü</p>"), (2, "https://h/2", "")], "page_id long, url string, html string")
    raw = [r[0] for r in pages.orderBy("page_id").select(F.encode(warc.record_bytes(F.col("url"), F.col("html"), F.col("page_id")), "UTF-8")).collect()]
    got = warc.parse(b"".join(map(bytes, raw)))
    assert [(g[2]["WARC-Target-URI"], g[3].decode()) for g in got] == [("https://h/é", "<p>ü</p>"), ("https://h/2", "")] and [g[0] for g in got] == [0, len(raw[0])]
