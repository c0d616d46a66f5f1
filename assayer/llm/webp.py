"""Lossless WebP for media columns: a decoder of the whole bit stream, and an encoder for byte payloads.

The decoder reads prefix codes (simple and code-length coded, with meta prefix codes), back-references, the colour cache,
and inverts the predictor, cross-colour, subtract-green and palette transforms.  Pixels come back as an array of
(height, width, 4) samples in the order alpha, red, green, blue.

The encoder stores a payload as pixels of four 8-bit samples.  References to runs seen before and the colour cache are
used where they stand for enough pixels; prefix codes by frequency then carry them, beside codes of one length.  A palette
or another transform is used where it pays.  Images with one group of codes are decoded by array operations, those with
meta prefix codes symbol by symbol.

Layout facts of the format (RFC 9649) are marked as fixed values.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import texts

#: Fixed values of the format: order of the code-length code lengths, and the (x, y) offsets of the near distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
SIGNATURE, GREEN_CODES, CHANNEL_CODES, DISTANCE_CODES = 0x2F, 256 + 24, 256, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
_NEAR = np.array(NEAR, np.int64)
#: Bytes of a stream that are looked up at a time.
SLICE = 1 << 16
#: Longest code that the encoder gives; pixels of a match at least, and of one reference at most; reach of a reference.
LONGEST, MATCH, MOST, REACH = 12, 8, 4096, (1 << 20) - 120
#: Pixels that the choice of transforms looks at.
SAMPLE = 512
#: Share of the pixels that the colour cache, or references, must stand for to pay for their codes.
CACHE_SHARE, REFERENCE_SHARE = 0.15, 0.05
#: Pixels of a row that the encoder writes, and the largest side of an image.
WIDTH, MAX_SIDE = 1024, 16384


class Bits:
    """Reader of numbers from the least significant bit on; bits past the end are zero, as the format allows none."""

    BLOCK = 384

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8
        self.base, self.block = 0, b""

    def peek(self, n: int) -> int:
        k = self.at - self.base
        if not 0 <= k < len(self.block):
            k = self.fill()
        return self.block[k] & ((1 << n) - 1)

    def fill(self) -> int:
        """The 24 bits from each bit of a block on; place of the next bit in it."""
        first = self.at >> 3
        raw = self.data[first:first + self.BLOCK + 3]
        self.base, self.block = first * 8, memoryview(windows_of(np.frombuffer(raw + b"\0" * (self.BLOCK + 3 - len(raw)), np.uint8)))
        return self.at - self.base

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v


_SHIFTS = np.arange(8, dtype=np.uint32)


def windows_of(raw: np.ndarray) -> np.ndarray:
    """The 24 bits that start at each bit of all bytes but the last three."""
    raw = np.ascontiguousarray(raw)
    word = np.ndarray((len(raw) - 3,), "<u4", raw.data, 0, (1,))
    return ((word[:, None] >> _SHIFTS) & np.uint32(0xFFFFFF)).reshape(-1)


class Prefix:
    """A prefix code: table of all its longest-code bit patterns, built when a symbol is first read by it."""

    def __init__(self, lengths):
        self.lengths = np.asarray(lengths, np.uint8)
        self.used = np.flatnonzero(self.lengths)
        self.only = int(self.used[0]) if len(self.used) == 1 else 0 if not len(self.used) else None
        self.bits, self.codes, self.table = 0, None, None
        self.equal = 0 if self.only is not None else None
        if self.only is None:
            n = self.lengths[self.used].astype(np.int64)
            self.bits = int(n.max())
            if int((1 << (self.bits - n)).sum()) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
            order = np.argsort(n, kind="stable")
            self.equal = self.bits if int(n.min()) == self.bits else None
            #: Of each bit pattern, the symbol times 16 plus the bits of its code.
            self.codes = np.repeat(self.used[order] << 4 | n[order], 1 << (self.bits - n[order]))[_turned(self.bits)]
            self.table = self.codes.tolist() if self.bits < 8 else memoryview(self.codes)

    def lookup(self, window: np.ndarray) -> np.ndarray:
        """Symbol times 16 plus the number of bits of the code that each window of bits starts with."""
        if self.only is not None:
            return np.full(len(window), self.only << 4)
        return self.codes.take(window & ((1 << self.bits) - 1))

    def flat(self) -> np.ndarray | None:
        """Symbol of each bit pattern, if all codes have one length."""
        if self.only is not None:
            return np.array([self.only], np.uint32)
        if (self.lengths[self.used] != self.bits).any():
            return None
        return self.used.astype(np.uint32)[_turned(self.bits)]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        c = self.table[bits.peek(self.bits)]
        bits.at += c & 15
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return c >> 4


_TURNED: dict[int, np.ndarray] = {}


def _turned(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse."""
    if n not in _TURNED:
        code = np.arange(1 << n, dtype=np.uint16)
        turned = np.zeros(1 << n, np.uint16)
        for i in range(n):
            turned |= ((code >> np.uint16(i)) & 1) << np.uint16(n - 1 - i)
        _TURNED[n] = turned
    return _TURNED[n]


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        named = [bits.read(8 if bits.read(1) else 1)] + [bits.read(8) for _ in range(two)]
        if max(named) >= size:
            raise ValueError("a prefix code names no symbol")
        for k in named:
            lengths[k] = 1
        return Prefix(lengths)
    order = [0] * 19
    for k in range(4 + bits.read(4)):
        order[LENGTH_ORDER[k]] = bits.read(3)
    code = _known(bytes(order))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise ValueError("more code lengths than symbols")
    if code.bits == 1 and left == size and code.used[-1] < 16:  # one bit for each symbol
        first, last = bits.at >> 3, (bits.at + size + 7) >> 3
        if bits.at + size > bits.end:
            raise ValueError("the stream ends early")
        one = np.unpackbits(np.frombuffer(bits.data, np.uint8, last - first, first), bitorder="little")[bits.at & 7:][:size]
        bits.at += size
        return Prefix(code.used[one])
    at, previous = 0, 8
    table = code.table
    mask = (1 << code.bits) - 1
    while at < size and left:
        left -= 1
        k = bits.at - bits.base
        if not 0 <= k < len(bits.block):
            k = bits.fill()
        w = bits.block[k]
        if table is None:
            n = code.only
        else:
            c = table[w & mask]
            n, used = c >> 4, c & 15
            bits.at += used
            w >>= used
        if n < 16:
            lengths[at] = n
            at += 1
            previous = n or previous
            continue
        if n == 16:
            repeat, used = 3 + (w & 3), 2
        elif n == 17:
            repeat, used = 3 + (w & 7), 3
        else:
            repeat, used = 11 + (w & 127), 7
        bits.at += used
        if at + repeat > size:
            raise ValueError("code lengths run past the symbols")
        if n == 16:
            lengths[at:at + repeat] = [previous] * repeat
        at += repeat
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return Prefix(lengths)


@functools.lru_cache(64)
def _known(lengths: bytes) -> Prefix:
    """The code of these lengths; most images name theirs by the same few codes of lengths."""
    return Prefix(list(lengths))


def _extra(bits: Bits, symbol: int) -> int:
    """Value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = (width + (1 << meta_bits) - 1) >> meta_bits
        down = (height + (1 << meta_bits) - 1) >> meta_bits
        meta = ((_read_image(bits, across, down, False) >> 8) & 0xFFFF).reshape(down, across)
        groups = int(meta.max()) + 1
    codes = [[_read_prefix(bits, n) for n in (GREEN_CODES + (1 << cache_bits if cache_bits else 0), CHANNEL_CODES, CHANNEL_CODES, CHANNEL_CODES, DISTANCE_CODES)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits:
        flat = _read_flat(bits, codes[0], total)
        if flat is not None:
            return flat
    if groups == 1:
        return _read_tokens(bits, codes[0], width, total, cache_bits)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift, cached, at = 32 - cache_bits, 0, 0
    green, red, blue, alpha, distance = codes[0]
    while at < total:
        if meta is not None:
            green, red, blue, alpha, distance = codes[int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < GREEN_CODES:
            n = _extra(bits, s - 256)
            d = _extra(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(n):
                out[at + k] = out[at + k - d]
            at += n
        else:
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - GREEN_CODES]
            at += 1
    return np.array(out, np.uint32)


def _read_flat(bits: Bits, codes: list[Prefix], total: int) -> np.ndarray | None:
    """All pixels at once, where the four literal codes each have one length and green codes no references."""
    symbols = [c.flat() for c in codes[:4]]
    if any(t is None for t in symbols) or symbols[0].max() > 255:
        return None
    widths = [c.bits for c in codes[:4]]
    per = sum(widths)
    if not per:
        raw = np.zeros((total, 0), np.uint8)
    else:
        first, last = bits.at >> 3, (bits.at + per * total + 7) >> 3
        if bits.at + per * total > bits.end:
            raise ValueError("the stream ends early")
        raw = np.unpackbits(np.frombuffer(bits.data, np.uint8, last - first, first), bitorder="little")[bits.at & 7:][:per * total].reshape(total, per)
        bits.at += per * total
    argb, at = np.zeros(total, np.uint32), 0
    for n, table, shift in zip(widths, symbols, (8, 16, 0, 24)):
        index = np.packbits(raw[:, at:at + n], axis=1, bitorder="little")[:, 0] if n else np.zeros(total, np.uint8)
        at += n
        argb |= table[index] << np.uint32(shift)
    return argb


def _extras(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of extra bits of length or distance symbols, and the value that they are added to."""
    symbol = symbol.astype(np.int64)
    n = np.clip(symbol - 2, 0, 36) >> 1
    return np.where(symbol < 4, 0, n), np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + 1)


def _roots(parent: np.ndarray) -> np.ndarray:
    """The last ancestor of each place, where a place without one is its own."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def _read_tokens(bits: Bits, codes: list[Prefix], width: int, total: int, cache_bits: int) -> np.ndarray:
    """Pixels of one group of codes.

    What would start at each bit is looked up for all bits at once, so that following the stream is one step for each token;
    copies and cache entries are then pointers to earlier pixels, which are followed to literals by doubling.
    """
    green, red, blue, alpha, distance = codes
    raw = np.frombuffer(bits.data, np.uint8, len(bits.data) - (bits.at >> 3), bits.at >> 3)
    pieces, done, size, at = [], 0, 0, bits.at & 7
    while done < total:  # a slice of the stream at a time
        part = np.concatenate([raw[size:size + SLICE], np.zeros(16, np.uint8)]) if size + SLICE >= len(raw) else raw[size:size + SLICE + 16]
        window = windows_of(part[:min(SLICE, len(part) - 16) + 3])
        n_bits = len(window)
        look = np.zeros(n_bits + 96, np.int64)
        look[:n_bits] = window
        window = look[:n_bits]
        found = green.lookup(window)
        g_symbol, here = found >> 4, (found & 15) + np.arange(n_bits)
        after, values = here, []
        equal = [c.equal for c in (red, blue, alpha)]
        if None not in equal:  # codes of one length: only what the path meets is looked up
            after = here + sum(equal)
        for code in (red, blue, alpha) if None in equal else ():
            c = code.lookup(look.take(after)) if code.only is None else code.only << 4
            values.append(c)
            after = after + (c & 15)
        copy = np.flatnonzero((g_symbol >= 256) & (g_symbol < GREEN_CODES))
        goes = np.where(g_symbol < 256, after, here)  # where the next token starts
        if len(copy):
            n, base = _extras(g_symbol[copy] - 256)
            p = here[copy]
            length = base + (look[p] & ((1 << n) - 1))
            c = distance.lookup(look[p + n])
            p = p + n + (c & 15)
            n, base = _extras(c >> 4)
            # distances have up to 18 extra bits, which a window of 24 holds
            back = base + (look[p] & ((1 << n) - 1))
            goes[copy] = p + n
            taken, far = np.ones(n_bits, np.int64), np.zeros(n_bits, np.int64)
            taken[copy], far[copy] = length, back
        last = size + SLICE >= len(raw)
        stop = n_bits if last else n_bits - 96
        path, left, k, goes = [], total - done, at, memoryview(goes)
        if len(copy):
            wide = memoryview(taken)
            while left > 0 and k < stop:
                path.append(k)
                left -= wide[k]
                k = goes[k]
        else:
            add = path.append
            while left > 0 and k < stop:
                add(k)
                left -= 1
                k = goes[k]
        if not path and last:
            raise ValueError("the stream ends early")
        path = np.array(path, np.int64)
        kind = g_symbol[path]
        length, far_back = (taken[path], far[path]) if len(copy) else (np.ones(len(path), np.int64), np.zeros(len(path), np.int64))
        if None not in equal:
            offset = here[path] + np.cumsum([[0], *([e] for e in equal[:2])], axis=0)
            values = [c.codes.take(look.take(o) & ((1 << c.bits) - 1)) if c.only is None else np.full(len(path), c.only << 4) for c, o in zip((red, blue, alpha), offset)]
            path = slice(None)
        r, b, a = ((v[path].astype(np.uint32) if isinstance(v, np.ndarray) else np.uint32(v)) >> np.uint32(4) for v in values)
        argb = a << np.uint32(24) | r << np.uint32(16) | (kind & 0xFF).astype(np.uint32) << np.uint32(8) | b
        pieces.append((kind, argb, length, far_back))
        done = total - left
        size, at = size + (k >> 3), k & 7
        if done < total and last:
            raise ValueError("the stream ends early")
    bits.at = ((len(bits.data) - len(raw)) + size) * 8 + at
    if bits.at > bits.end or done > total:
        raise ValueError("the stream ends early" if bits.at > bits.end else "a back-reference leaves the image")
    kind, argb, length, far = (np.concatenate(x) for x in zip(*pieces))
    if (kind < 256).all():
        return argb
    is_copy = (kind >= 256) & (kind < GREEN_CODES)
    count = np.where(is_copy, length, 1)
    token = np.repeat(np.arange(len(kind)), count)
    place = np.arange(total)
    parent = place.copy()
    copied = is_copy[token]
    near = (far[token] <= 120) & copied
    back = far[token] - 120
    if near.any():
        x, y = _NEAR[far[token][near] - 1].T
        back[near] = np.maximum(1, x + y * width)
    parent[copied] = (place - back)[copied]
    if (parent < 0).any():
        raise ValueError("a back-reference leaves the image")
    pixel = argb[token]
    cached = kind[token] >= GREEN_CODES
    if not cached.any():
        return pixel[_roots(parent)]
    # the cache cell of each pixel: a literal's own, a cache entry's number, a copy's source's
    source = _roots(parent)
    cell = np.where(cached, kind[token] - GREEN_CODES, ((np.uint64(CACHE_FACTOR) * pixel.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits))[source]
    order = np.argsort(cell, kind="stable")
    before = np.full(total, -1, np.int64)
    same = cell[order][1:] == cell[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    empty = cached & (before < 0)  # a cell that nothing was put in is transparent black
    parent = np.where(cached & ~empty, before, parent)
    pixel = np.where(empty, np.uint32(0), pixel)
    return pixel[_roots(parent)]


def _channels(argb: np.ndarray) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    toward_left = np.abs(top - corner).sum()
    toward_top = np.abs(left - corner).sum()
    return left if toward_left < toward_top else top


def _half(mean, corner):
    return np.clip(mean + ((mean - corner) / 2).astype(np.int32), 0, 255)


def _undo_predictor(p: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = p.shape
    p[0, 0, 0] = (p[0, 0, 0] + 255) & 255
    if (modes == 1).all():  # left neighbours, and above along the first column
        p[:, 0] = np.cumsum(p[:, 0], axis=0)
        return np.cumsum(p, axis=1) & 255
    p[0] = np.cumsum(p[0], axis=0) & 255
    if (modes == 2).all():  # neighbours above
        return np.cumsum(p, axis=0) & 255
    for y in range(1, height):
        p[y, 0] = (p[y, 0] + p[y - 1, 0]) & 255
        above, row = p[y - 1], p[y]
        for x in range(1, width):
            left, top, corner = row[x - 1], above[x], above[x - 1]
            right = above[x + 1] if x + 1 < width else row[0]
            mode = int(modes[y >> size_bits, x >> size_bits])
            if mode == 1:
                q = left
            elif mode == 2:
                q = top
            elif mode == 3:
                q = right
            elif mode == 4:
                q = corner
            elif mode == 5:
                q = _average(_average(left, right), top)
            elif mode == 6:
                q = _average(left, corner)
            elif mode == 7:
                q = _average(left, top)
            elif mode == 8:
                q = _average(corner, top)
            elif mode == 9:
                q = _average(top, right)
            elif mode == 10:
                q = _average(_average(left, corner), _average(top, right))
            elif mode == 11:
                q = _select(left, top, corner)
            elif mode == 12:
                q = np.clip(left + top - corner, 0, 255)
            elif mode == 13:
                q = _half(_average(left, top), corner)
            else:
                q = np.array([255, 0, 0, 0])
            row[x] = (row[x] + q) & 255
    return p


def _undo_cross_colour(p: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height, width, _ = p.shape
    e = elements[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    signed = lambda v: ((v & 0xFF).astype(np.int32) ^ 0x80) - 0x80
    red_blue, green_blue, green_red = signed(e >> 16), signed(e >> 8), signed(e)
    green = signed(p[..., 2])
    red = (p[..., 1] + ((green_red * green) >> 5)) & 255
    blue = p[..., 3] + ((green_blue * green) >> 5) + ((red_blue * signed(red)) >> 5)
    p[..., 1], p[..., 3] = red, blue & 255
    return p


def decode(file: bytes) -> np.ndarray:
    """Samples (height, width, 4), in the order alpha, red, green, blue, of a lossless WebP file."""
    if len(file) < 25 or file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21:20 + struct.unpack("<I", file[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    todo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            across, down = (coded + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits
            todo.append((kind, size_bits, _read_image(bits, across, down, False).reshape(down, across), coded))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, pack, palette, coded))
            coded = (coded + (1 << pack) - 1) >> pack
        else:
            todo.append((kind, 0, None, coded))
    argb = _read_image(bits, coded, height, True)
    if not todo:
        return argb.astype(">u4").view(np.uint8).reshape(height, coded, 4)
    p = _channels(argb).reshape(height, coded, 4)
    for kind, n, data, across in reversed(todo):
        if kind == PREDICTOR:
            p = _undo_predictor(p, (data >> 8) & 0xFF, n)
        elif kind == CROSS_COLOUR:
            p = _undo_cross_colour(p, data, n)
        elif kind == SUBTRACT_GREEN:
            p[..., 1] = (p[..., 1] + p[..., 2]) & 255
            p[..., 3] = (p[..., 3] + p[..., 2]) & 255
        else:
            index = p[..., 2]
            if n:
                each, mask = 8 >> n, (1 << (8 >> n)) - 1
                x = np.arange(across)
                index = (index[:, x >> n] >> ((x & ((1 << n) - 1)) * each)) & mask
            full = np.zeros((256, 4), np.int32)  # indices past the palette are transparent black
            full[:len(data)] = data
            p = full[index]
    return p.astype(np.uint8)


class Writer:
    """Bits from the least significant on."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def flat_code(out: Writer, used: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Write a code with one length for all symbols in use (their number is filled up to a power of two); each symbol's bits, and their number."""
    if len(used) == 1:
        out.put(0b1 | (int(used[0]) > 1) << 2, 3)
        out.put(int(used[0]), 8 if used[0] > 1 else 1)
        return np.zeros(256, np.int64), 0
    n = int(len(used) - 1).bit_length()
    if len(used) < 1 << n:
        free = np.ones(256, bool)
        free[used] = False
        used = np.sort(np.concatenate([used, np.flatnonzero(free)[:(1 << n) - len(used)]]))
    # code lengths 0 and n alone, one bit each
    out.put(0, 1)
    k = LENGTH_ORDER.index(n)
    out.put(max(k, 3) + 1 - 4, 4)
    for i in range(max(k, 3) + 1):
        out.put(LENGTH_ORDER[i] in (0, n), 3)
    out.put(0, 1)
    lengths = np.zeros(size, np.uint8)
    lengths[used] = 1
    out.put(int.from_bytes(np.packbits(lengths, bitorder="little").tobytes(), "little"), size)
    pattern = np.zeros(256, np.int64)
    pattern[used] = _turned(n)
    return pattern, n


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code of at most LONGEST bits: rounded-up information, then shortened from the most frequent symbol on."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    bits = math.log2(sum(weight)) - 1e-9
    n = [min(LONGEST, max(1, math.ceil(bits - math.log2(w)))) for w in weight]
    order = sorted(range(len(n)), key=weight.__getitem__, reverse=True)
    slack = (1 << LONGEST) - sum([1 << (LONGEST - k) for k in n])
    while slack < 0:  # rare symbols were cut to LONGEST: the least frequent of the others give way
        k = next(k for k in reversed(order) if n[k] < LONGEST)
        slack += 1 << (LONGEST - n[k] - 1)
        n[k] += 1
    while slack:
        for k in order:
            gain = 1 << (LONGEST - n[k])
            if gain <= slack and n[k] > 1:
                slack -= gain
                n[k] -= 1
                if not slack:
                    break
    out[used] = n
    return out


#: Code lengths 0 to 12 and the three kinds of runs all have codes of four bits.
_LENGTH_CODES = {s: int(format(k, "04b")[::-1], 2) for k, s in enumerate([*range(LONGEST + 1), 16, 17, 18])}


def put_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for symbols with these counts; each symbol's bits and their number."""
    used = np.flatnonzero(counts)
    pattern, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        only = int(used[0]) if len(used) else 0
        out.put(0b1 | (only > 1) << 2, 3)
        out.put(only, 8 if only > 1 else 1)
        return pattern, size
    if len(used) == 1:  # one symbol that the short form cannot name: a second one completes the code
        counts = counts.copy()
        counts[0] = 1
        used = np.flatnonzero(counts)
    size = code_lengths(counts)
    out.put(0, 1)
    out.put(19 - 4, 4)
    for s in LENGTH_ORDER:
        out.put(4 if s in _LENGTH_CODES else 0, 3)
    out.put(0, 1)
    names = [_LENGTH_CODES[n] for n in range(LONGEST + 1)]
    last, value, bits = 0, 0, 0
    for s, n in zip(used.tolist(), size[used].tolist()):
        zeros, z = _ZEROS[s - last]
        value |= (zeros | names[n] << z) << bits
        bits += z + 4
        last = s + 1
    zeros, z = _ZEROS[len(counts) - last]
    out.put(value | zeros << bits, bits + z)
    # canonical codes, first bit first
    order = used[np.argsort(size[used], kind="stable")]
    step = 1 << (LONGEST - size[order])
    pattern[order] = _turned(LONGEST)[np.cumsum(step) - step]
    return pattern, size


def _zeros(n: int) -> tuple[int, int]:
    """Code of a run of n lengths 0, and its bits."""
    value = bits = 0
    while n:
        run, code, used = (min(n, 138), _LENGTH_CODES[18] | (min(n, 138) - 11) << 4, 11) if n >= 11 else (n, _LENGTH_CODES[17] | (n - 3) << 4, 7) if n >= 3 else (1, _LENGTH_CODES[0], 4)
        value |= code << bits
        bits, n = bits + used, n - run
    return value, bits


_ZEROS = [_zeros(n) for n in range(GREEN_CODES + 1024 + 1)]


def _symbols(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances."""
    v = value - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 0)
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), n


def matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, pixels, distance) of runs that an earlier place has too, from left to right."""
    n = len(argb) - MATCH + 1
    if n < 2:
        return []
    h = argb.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(MATCH):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    found, at = [], 0
    ahead = np.flatnonzero(before >= 0)
    k = 0
    while k < len(ahead):
        i = int(ahead[k])
        d = i - int(before[i])
        run = 0
        if i >= at and d <= REACH:
            step = 64
            while i + run < len(argb):  # how far both go on alike
                a, b = argb[i + run:i + run + step], argb[i + run - d:i + run - d + step]
                differ = np.flatnonzero(a != b[:len(a)]) if len(b) >= len(a) else np.flatnonzero(a[:len(b)] != b)
                if len(differ):
                    run += int(differ[0])
                    break
                run += min(len(a), len(b))
                step *= 2
        if run >= MATCH:
            found += [(i + s, min(MOST, run - s), d) for s in range(0, run, MOST)]
            at = i + run
            k = int(np.searchsorted(ahead, at))
        else:
            k += 1
    return found


def put_image(out: Writer, argb: np.ndarray, top: bool) -> list[np.ndarray]:
    """Write the codes of an image; values and widths, in their order, of what follows them."""
    n = len(argb)
    runs = matches(argb)
    if sum(m for _, m, _ in runs) < REFERENCE_SHARE * n:
        runs = []
    literal = np.ones(n, bool)
    for i, m, _ in runs:
        literal[i:i + m] = False
    place = np.flatnonzero(literal)
    own = argb[place]
    # a pixel that the cache holds costs one symbol; the cache is used where enough of them are
    cache_bits = min(10, max(1, n.bit_length() - 3))
    green = ((own >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    cell = ((np.uint64(CACHE_FACTOR) * argb.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - cache_bits)
    order = np.argsort(cell, kind="stable")
    again = (cell[order][1:] == cell[order][:-1]) & (argb[order][1:] == argb[order][:-1])
    known = np.zeros(n, bool)
    known[order[1:][again]] = True
    hit = known[place]
    if hit.sum() >= CACHE_SHARE * n:
        green = np.where(hit, GREEN_CODES + cell[place], green)
    else:
        cache_bits, hit = 0, np.zeros(len(own), bool)
    missed = own[~hit].view(np.uint8).reshape(-1, 4)
    counts, rest = np.bincount(green, minlength=GREEN_CODES + (1 << cache_bits if cache_bits else 0)), [np.bincount(missed[:, c], minlength=CHANNEL_CODES) for c in (2, 0, 3)]
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if top:
        out.put(0, 1)  # one group of codes
    start, length, back = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    codes = []
    if runs:
        l_symbol, l_extra, l_bits = _symbols(length)
        d_symbol, d_extra, d_bits = _symbols(back + 120)
        counts = counts + np.bincount(256 + l_symbol, minlength=len(counts))
    codes.append(put_code(out, counts) if runs or cache_bits else flat_code(out, np.flatnonzero(counts), GREEN_CODES))
    codes += [flat_code(out, np.flatnonzero(c) if c.any() else np.zeros(1, np.int64), CHANNEL_CODES) for c in rest]
    codes.append(put_code(out, np.bincount(d_symbol, minlength=DISTANCE_CODES) if runs else np.zeros(DISTANCE_CODES, np.int64)))
    # five fields for each token: literal channels, or length and distance with their extra bits
    value, size = np.zeros((len(place) + len(start), 5), np.int64), np.zeros((len(place) + len(start), 5), np.int64)
    mine = np.arange(len(place)) + np.searchsorted(start, place)
    theirs = np.arange(len(start)) + np.searchsorted(place, start)
    value[mine, 0], size[mine, 0] = codes[0][0][green], codes[0][1][green] if runs or cache_bits else codes[0][1]
    plain = mine[~hit] if cache_bits else mine
    for f, c in ((1, 2), (2, 0), (3, 3)):
        channel = missed[:, c]
        value[plain, f], size[plain, f] = codes[f][0][channel], codes[f][1]
    if runs:
        value[theirs, 0], size[theirs, 0] = codes[0][0][256 + l_symbol], codes[0][1][256 + l_symbol]
        value[theirs, 1], size[theirs, 1] = l_extra, l_bits
        value[theirs, 2], size[theirs, 2] = codes[4][0][d_symbol], codes[4][1][d_symbol]
        value[theirs, 3], size[theirs, 3] = d_extra, d_bits
    return [value.reshape(-1), size.reshape(-1)]


def _stream(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of fields of up to 32 bits."""
    keep_ = size > 0
    value, size = value[keep_], size[keep_]
    end = np.cumsum(size)
    bits = int(end[-1]) if len(end) else 0
    start = end - size
    # each field goes into the 64-bit word it starts in, and what is left of it into the next
    words = np.zeros(bits // 64 + 2, np.uint64)
    word, shift, v = start >> 6, (start & 63).astype(np.uint64), value.astype(np.uint64)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
    if len(word):
        words[word[first]] |= np.bitwise_or.reduceat(v << shift, first)
        over = np.flatnonzero((start & 63) + size > 64)
        words[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:bits]


def _transformed(p: np.ndarray, width: int):
    """(name, samples) of an image under each transform, each with samples of its own."""
    yield None, p
    q = p.copy()
    q[:, 1] -= q[:, 2]
    q[:, 3] -= q[:, 2]
    yield SUBTRACT_GREEN, q
    q = p.copy()
    signed = p.view(np.int8).astype(np.int32)
    q[:, 1] -= ((32 * signed[:, 2]) >> 5).astype(np.uint8)
    q[:, 3] -= ((32 * signed[:, 1]) >> 5).astype(np.uint8)
    yield CROSS_COLOUR, q
    q = p.reshape(-1, width, 4).copy()
    q[:, 1:] -= p.reshape(-1, width, 4)[:, :-1]
    q[1:, 0] -= p.reshape(-1, width, 4)[:-1, 0]
    q[0, 0, :1] -= 255
    yield PREDICTOR, q.reshape(-1, 4)


def encode(payload: bytes) -> bytes:
    """A lossless WebP file of whole rows; payload is a positive multiple of 64 bytes, in the order alpha, red, green, blue.

    Where no width divides the pixels, zeros fill the last row up; the payload is then the first bytes of what comes back.
    A palette is used where it shortens pixels; of the other transforms the one under which a sample of the samples carries
    the least information.  Runs seen before become references, and pixels that the colour cache holds its entries.
    """
    if not payload or len(payload) % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    pixels = len(payload) // 4
    width = next((w for w in range(min(WIDTH, pixels), 15, -16) if pixels % w == 0 and pixels // w <= MAX_SIDE), None)
    width = width or next((w for w in range(MAX_SIDE, 15, -16) if pixels % w == 0 and pixels // w <= MAX_SIDE), None)
    if width is None:
        width = max(WIDTH, -(-pixels // (MAX_SIDE * 16)) * 16)
        if width > MAX_SIDE:
            raise ValueError("the payload is larger than the largest image")
        pixels = -(-pixels // width) * width
        payload += b"\0" * (pixels * 4 - len(payload))
    p = np.frombuffer(payload, np.uint8).reshape(pixels, 4)
    argb = p.view(">u4").reshape(-1).astype(np.uint32)
    out, fields = Writer(), []
    out.put(width - 1, 14)
    out.put(pixels // width - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    colours = np.unique(argb[:SAMPLE])
    if len(colours) <= min(256, len(argb[:SAMPLE]) // 2) and pixels > SAMPLE:
        colours = np.unique(argb)
    if len(colours) <= min(256, pixels // 2):
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        steps = colours.astype(">u4").view(np.uint8).reshape(-1, 4).copy()
        steps[1:] -= colours[:-1].astype(">u4").view(np.uint8).reshape(-1, 4)
        fields.append((out, put_image(out, steps.view(">u4").reshape(-1).astype(np.uint32), False)))
        index = np.searchsorted(colours, argb).reshape(-1, width)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        across = -(-width >> pack) if not pack else (width + (1 << pack) - 1) >> pack
        wide = np.zeros((len(index), across << pack), np.int64)
        wide[:, :width] = index
        shifts = np.arange(1 << pack) * (8 >> pack)
        argb = ((wide.reshape(len(index), across, 1 << pack) << shifts).sum(axis=2).reshape(-1) << 8 | 0xFF000000).astype(np.uint32)
    else:
        sample = p[:max(width, min(SAMPLE, pixels) // width * width)]
        names, forms = zip(*_transformed(sample, width))
        groups = np.stack(forms).astype(np.int64) + (np.arange(len(forms) * 4) << 8).reshape(len(forms), 1, 4)
        counts = np.bincount(groups.reshape(-1), minlength=len(forms) << 10).reshape(len(forms), -1)
        # what the channels carry, and about what naming their symbols takes; all forms have equally many samples
        name = names[int(np.argmin((6 * (counts > 0) - counts * np.log2(np.maximum(counts, 1))).sum(axis=1)))]
        if name is not None:
            out.put(1 | name << 1, 3)
            if name != SUBTRACT_GREEN:
                out.put(7, 3)  # tiles of the largest size, all alike: left neighbours, or green to red and red to blue
                across, down = (width + 511) >> 9, (pixels // width + 511) >> 9
                fields.append((out, put_image(out, np.full(across * down, 0xFF000100 if name == PREDICTOR else 0xFF200020, np.uint32), False)))
            q = dict(_transformed(p, width))[name]
            argb = np.ascontiguousarray(q).view(">u4").reshape(-1).astype(np.uint32)
    # what follows the codes of a small image stands before what comes next
    parts = []
    for _, (value, size) in fields:
        parts.append(np.unpackbits(np.frombuffer(out.value.to_bytes((out.n + 7) // 8, "little"), np.uint8), bitorder="little")[:out.n])
        parts.append(_stream(value, size))
        out = Writer()
    out.put(0, 1)  # no more transforms
    value, size = put_image(out, argb, True)
    parts.append(np.unpackbits(np.frombuffer(out.value.to_bytes((out.n + 7) // 8, "little"), np.uint8), bitorder="little")[:out.n])
    parts.append(_stream(value, size))
    stream = np.packbits(np.concatenate(parts), bitorder="little").tobytes()
    chunk = bytes([SIGNATURE]) + stream
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with zeros to a positive multiple of 64, and the number before."""
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (payload_size(len(raw)) - len(raw)), len(raw)


def payload_size(n_bytes: int) -> int:
    """Bytes of the payload of a text of n_bytes."""
    return max(64, -(-n_bytes // 64) * 64)


def feature(samples: np.ndarray) -> str:
    """Difference hash of the samples' mean over 64 equal stretches, and their mean, as hex."""
    flat = samples.reshape(-1).astype(np.int64)
    means = np.add.reduceat(flat, np.arange(64) * len(flat) // 64) // np.diff(np.append(np.arange(64) * len(flat) // 64, len(flat)))
    bits = np.packbits(np.roll(means, -1) > means).tobytes()
    return bits.hex() + format(int(flat.mean()), "02x")


def _store(batches):
    import pyarrow as pa

    for b in batches:
        media, sizes = [], []
        for text in b.column(1):
            payload, n = payload_of(text.as_py())
            media.append(encode(payload))
            sizes.append(n)
        if media:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches):
    import pyarrow as pa

    for b in batches:
        rows = []
        for m, n in zip(b.column("media"), b.column("n_bytes").to_pylist()):
            file = m.as_py()
            samples = decode(file).reshape(-1)[:payload_size(n)]  # without what fills the last row up
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples)))
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a lossless WebP file.

    Null text is the empty text, stored as 64 zero bytes; repeated rows and equal texts give equal files; an empty table
    gives no rows; extra columns are ignored.
    """
    return texts(docs, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read_features(media: DataFrame) -> DataFrame:
    """Decode stored files: sizes, digests and feature of the samples that come back."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
