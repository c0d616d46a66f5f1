"""Best-fit packing of token sequences by bin completion, branch and bound.

Pieces have whole lengths of at most `capacity`, so an instance is a histogram with at most `capacity` entries whatever
the number of pieces.  The search works on that histogram: around the largest piece left it enumerates every undominated
filling of the rest of the bin, least waste first, led by the sums that the lengths left can make; it prunes by the waste
that the best packing known so far still allows, and starts from a best-fit packing as the incumbent.  A filling is applied
as often as the histogram allows, then less often, so a plan has at most a few fillings for each length and its size does
not follow the corpus.  One state is changed and restored along the path.  The search ends when a lower bound is met or
all branches are closed, which proves the plan, or at NODES and STEPS, which bound the driver's time and leave the best
plan found.  Pieces are then numbered inside their length in parallel (counts of each salt, prefix sums, row numbers
inside a salt) and look their place up in the plan.

Defined cases: null text is the empty text, which still has its end token; longer documents alone are cut, into pieces of
`capacity` tokens and a rest, however long they are; repeated rows are packed each on its own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import keep, texts, tidy

CAPACITY = 4096
END_ID = 1
#: Chunks of text that a generation of a worker's memory holds.
CHUNKS = 250_000
#: The search is exact where it ends by itself (the lower bound is met, or every branch is closed); these end it before: nodes
#: opened, and steps of the enumeration over all nodes.  A dive takes at most one node for each length.
NODES, STEPS = 16 * CAPACITY, 1 << 21
#: Levels of the search tree that share a count of reachable sums.
RENEW = 32
#: Pieces numbered by one task.
SALT_ROWS = 5_000

_WORKERS: dict[str, tuple] = {}


#: Fixed values of the vocabulary file: its pattern of words, and the mark at the end of a word's last symbol.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class Encoder:
    """Ids of whole texts under a vocabulary file of pairs with word ends, as its own tokenizer gives them.

    The rules never cross a blank, tab or line end, so the ids of a text are those of its chunks in turn.  A worker
    remembers chunks in two generations of bounded size; new chunks of letters and signs go through a byte-pair merge
    over the same vocabulary, all others (control characters, odd blanks, unnormalised text, special tokens) through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_letters()
        ranks = {}
        for token, i in vocabulary.items():
            ends = token.endswith(WORD_END)
            ranks[bytes(byte[c] for c in (token[:-len(WORD_END)] if ends else token)) + b"\xff" * ends] = i
        self.merge = CoreBPE(ranks, {}, "x").encode_single_piece  # 0xff stands in no UTF-8 text
        self.words = regex.compile(WORD_PATTERN).findall
        self.known, self.older = {"": b""}, {}

    def chunk(self, c: str) -> bytes:
        ids = self.older.get(c)
        if ids is not None:
            return ids
        low = c.lower()
        if c.isascii() and low.isalpha():
            ids = self.merge(low.encode() + b"\xff")
        elif c.isprintable() and "<|" not in c and "\u03a3" not in c and unicodedata.is_normalized("NFC", c):
            ids = self.merge(low.encode() + b"\xff") if low.isalpha() else [i for w in self.words(low) for i in self.merge(w.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(c, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if len(ids) > 3 else b"".join(i.to_bytes(4, "little") for i in ids)

    def __call__(self, text: str) -> np.ndarray:
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4")
        except KeyError:
            pass
        if len(known) > CHUNKS:
            self.older, self.known = known, {"": b""}
            known = self.known
        for c in set(chunks).difference(known):
            known[c] = self.chunk(c)
        return np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    if path not in _WORKERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKERS[path] = Encoder(path)
    return _WORKERS[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches):
        import pyarrow as pa

        encode = encoder(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens of every document."""
    return texts(docs, id_col, text_col).mapInArrow(tidy(_cut(tokenizer_path, capacity)), _PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times): around the largest length left, each time the longest that still fits."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    plan = []
    while order:
        room, filling = capacity, []
        for n in order:
            if n > room:
                continue
            take = min(left[n], room // n)
            filling += [n] * take
            room -= n * take
            if not room:
                break
        plan.append(_apply(left, tuple(filling)))
        order = [n for n in order if left[n]]
    return plan


def _apply(left: dict[int, int], filling: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    need: dict[int, int] = {}
    for n in filling:
        need[n] = need.get(n, 0) + 1
    times = min(left[n] // k for n, k in need.items())
    for n, k in need.items():
        left[n] -= k * times
    return filling, times


class Fillings:
    """Lengths still to be placed, and the undominated fillings around the largest of them, least waste first.

    `reach[i]` has a bit for every sum that lengths[i:] can make.  It is built from what was left at some node above and
    shared by the nodes below, so it may hold sums that can no longer be made, never too few: it prunes and decides nothing.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.steps = capacity, dict(counts), 0
        self.present = sum(1 << n for n, c in counts.items() if c)  # a bit for every length left
        self.views: list[tuple[int, list[int], list[int], list[int]]] = []
        self.view(0)

    def view(self, depth: int) -> None:
        """Count the reachable sums anew, for nodes from this depth on."""
        lengths = sorted((n for n, c in self.left.items() if c), reverse=True)
        mask, sums, reach = (1 << (self.capacity + 1)) - 1, 1, [1]
        for n in reversed(lengths):
            copies, step = min(self.left[n], self.capacity // n), 1
            while copies:
                step = min(step, copies)
                sums |= (sums << (n * step)) & mask
                copies, step = copies - step, 2 * step
            reach.append(sums)
        # place of the first length that is no longer than each number
        below = (len(lengths) - np.searchsorted(np.array(lengths[::-1], np.int64), np.arange(self.capacity + 1), side="right")).tolist()
        self.views.append((depth, lengths, reach[::-1], below))

    def change(self, filling: tuple[int, ...], times: int, depth: int) -> None:
        """Take the lengths of a filling out (times > 0) or put them back, which leads to a node of this depth."""
        left = self.left
        for n in filling:
            left[n] -= times
        for n in set(filling):
            self.present = self.present | 1 << n if left[n] else self.present & ~(1 << n)
        while self.views[-1][0] > depth:
            self.views.pop()
        if depth - self.views[-1][0] >= RENEW:
            self.view(depth)

    def largest(self) -> int:
        """The largest length left, 0 where nothing is."""
        return max(self.present.bit_length() - 1, 0)

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """A length left outside could be added, or take the place of a smaller one, without overflow; the largest stays."""
        outside, near = self.present, (1 << waste) - 1
        for n in set(filling):
            if self.left[n] == filling.count(n):
                outside &= ~(1 << n)
        return bool(outside >> 1 & near) or any(outside >> (m + 1) & near for m in set(filling[1:]))

    def around(self, largest: int, most_waste: int):
        """Every undominated filling with at most that waste; one piece that fits the gap exactly dominates all others."""
        gap = self.capacity - largest
        if gap and self.left.get(gap, 0) > (gap == largest):
            yield (largest, gap)
            return
        for waste in range(min(most_waste, gap) + 1):
            for rest in self.with_sum(largest, gap - waste):
                filling = (largest, *rest)
                if not waste or not self.dominated(filling, waste):
                    yield filling

    def with_sum(self, largest: int, total: int):
        """All choices of the lengths left that add up to total, longest lengths first."""
        _, lengths, reach, below = self.views[-1]
        left = self.left
        stack = [(below[largest], total, ())]
        while stack:
            at, room, chosen = stack.pop()
            self.steps += 1
            if not room:
                yield chosen
                continue
            at = max(at, below[room])
            if not reach[at] >> room & 1 or at == len(lengths):
                continue
            n = lengths[at]
            stack.append((at + 1, room, chosen))
            most = min(left[n] - (n == largest), room // n)
            for k in range(1, most + 1):  # the most copies end on top of the stack
                if reach[at + 1] >> (room - k * n) & 1:
                    stack.append((at + 1, room - k * n, chosen + (n,) * k))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and for every size k by the pieces that cannot share a bin with one of k."""
    size = np.array(sorted(counts), np.int64)
    if not len(size):
        return 0
    n = np.array([counts[s] for s in size.tolist()], np.int64)
    number, volume = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * size))
    half = np.searchsorted(size, capacity // 2, side="right")
    best = -(-int(volume[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        wide = max(int(np.searchsorted(size, capacity - k, side="right")), int(half))  # from here on pieces longer than capacity - k
        alone, middle = int(number[-1] - number[wide]), int(number[wide] - number[half])
        from_k = int(np.searchsorted(size, k))
        small = int(volume[half] - volume[min(from_k, half)])
        room = middle * capacity - int(volume[wide] - volume[half])
        best = max(best, alone + middle + max(0, -(-(small - room) // capacity)))
    return best


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Plan of (filling, times) for a histogram of lengths, with as few bins as the search finds."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(n * c for n, c in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_bins = sum(t for _, t in best)
    if best_bins == bound:
        return best
    state, path, bins, waste, opened = Fillings(counts, capacity), [], 0, 0, 1

    def choices():
        """(filling, times, waste) around the largest length: each filling as often as it goes, then less often."""
        largest = state.largest()
        allowed = (best_bins - 1) * capacity - total - waste  # more waste than this cannot beat the incumbent
        fewer = 0
        while largest:
            more = False
            for f in state.around(largest, allowed):
                lost = capacity - sum(f)
                times = min(state.left[n] // f.count(n) for n in set(f))
                times = (min(times, allowed // lost) if lost else times) - fewer
                if times > 0:
                    more |= times > 1
                    yield f, times, lost * times
            if not more:
                return
            fewer += 1

    open_nodes = [choices()]
    while open_nodes and best_bins > bound and opened < nodes and state.steps < steps:
        step = next(open_nodes[-1], None)
        if step is not None:
            filling, times, lost = step
            path.append(step)
            state.change(filling, times, len(path))
            bins, waste, opened = bins + times, waste + lost, opened + 1
            if state.largest():
                open_nodes.append(choices())
                continue
            if bins < best_bins:
                best, best_bins = [(f, t) for f, t, _ in path], bins
        else:  # nothing left around this length: back to the node above
            open_nodes.pop()
        if path:
            filling, times, lost = path.pop()
            state.change(filling, -times, len(path))
            bins, waste = bins - times, waste - lost
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per length, in order of its pieces' numbers: first number, first sequence, and place in the sequence."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        at = 0
        for n in filling:
            rows.append((n, taken.get(n, 0), sequence, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        sequence += times
    table = np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)
    return dict(zip(("length", "number", "sequence", "offset"), table.T.copy()))


def _place(plan: dict[str, np.ndarray]):
    """Sequence and offset of numbered pieces; the plan has a bounded number of rows."""
    def run(batches):
        import pyarrow as pa

        key = plan["length"] << np.int64(44) | plan["number"]
        for b in batches:
            length, number = b.column("length").to_numpy(zero_copy_only=False), b.column("number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << np.int64(44) | number, side="right") - 1
            sequence = plan["sequence"][at] + number - plan["number"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(plan["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset."""
    from pyspark.sql import Window

    pieces = keep(pieces_of(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    n = pieces.count()
    salts = max(1, -(-n // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = keep(salted.groupBy("length", "salt").count(), "lengths")
    # at most `capacity` rows reach the driver
    histogram = {r[0]: r[1] for r in by_salt.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = slots(complete_bins(histogram, capacity))
    before = by_salt.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = salted.withColumn("r", F.row_number().over(inside)).join(before, ["length", "salt"]).withColumn("number", (F.col("before") + F.col("r") - 1).cast("long"))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(_place(plan), _PIECES + ", sequence_id long, offset long")
