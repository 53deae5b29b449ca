"""Best-fit packing with exact complements.

Pieces of one length are interchangeable, so the plan is made over the histogram of lengths, which
has at most ``capacity`` rows however large the corpus is. The planner indexes the single, pair and
triple sums of the available lengths; for each length, longest first, it consumes single pieces, then
pairs, then triples that fill its gap exactly, under the counts still available, and packs what is
left by best fit, longest first. Where that takes more sequences than the tokens need, combinations
of the most and shortest pieces are given back to the best fit, more of them in each of a few tries. The plan is
a list of patterns (lengths side by side, repeated so many times); each pattern's slot takes a range
of ranks of its length. Tasks then turn a piece's rank among the pieces of its length into a place.

Texts are tokenized once; only a piece's length and the checksum of its ids are kept.

Defined cases: a null or empty text is one piece that holds the end id alone. Rows that repeat a
``doc_id``, or have none, are packed each. Texts of any length are cut into pieces of ``capacity``
tokens, the first of which may be shorter. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm import common

CAPACITY = 2048
END_ID = 0
#: A run without white space of so many characters goes to the vocabulary file's own library, which is slower but never quadratic.
LONG_RUN = 5000
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a byte-level BPE file of ``tokenizers``.

    They are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Where the file's merges
    rank as its ids do, they come from the same table through tiktoken, which is about four times as
    fast; long unbroken runs, texts with the string of an added token (which is a token then), and
    files that rank otherwise go through ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self._added = [t["content"] for t in json.loads(open(path, encoding="utf-8").read()).get("added_tokens") or []]
        self._fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made):
            return None
        of = _byte_chars()
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}
        special = {t for t in vocab if t.startswith("<|")}
        for t in special:
            ranks.pop(t.encode(), None)
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self._fast is None or any(t in text for t in self._added) or len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN or len(text) > LONG_RUN and max(map(len, _SPACES.findall(text)), default=0) > LONG_RUN:
            ids = self._slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


_SPACES = re.compile(r"\s{100,}")
_TOKENIZERS: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteBpe(path)
    return _TOKENIZERS[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), END_ID.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)  # pieces so far, by length
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(tok.encode(text or "") + end)
                n = len(ids) // 4
                start, length = 0, n % capacity or capacity
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


Pattern = tuple[tuple[int, ...], int]
#: Shares of the combinations of three pieces and more that are given back to the best fit, one after the other, where the plan is not as short as can be.
GIVEN_BACK = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 1)


class SumIndex:
    """Single, pair and triple sums of the lengths available; ``left`` is read as it is now."""

    def __init__(self, left: np.ndarray) -> None:
        self.left = left
        have = np.flatnonzero(left)
        i, j = np.triu_indices(len(have))
        low, total = have[i], have[i] + have[j]
        order = np.flatnonzero(total < len(left))
        order = order[np.lexsort((low[order], total[order]))]
        self._low, self._at = low[order], np.searchsorted(total[order], np.arange(len(left) + 1))
        self._have = have
        # Bit s says whether some combination has the sum s.
        twos = sum(1 << s for s in range(len(left)) if self._at[s] < self._at[s + 1])
        self._threes = 0
        for x in have.tolist():
            self._threes |= twos << x

    def single(self, gap: int) -> list[tuple[int, ...]]:
        return [(gap,)] if self.left[gap] else []

    def pairs(self, gap: int) -> list[tuple[int, ...]]:
        """Pairs that sum to ``gap``, the most unequal first."""
        low = self._low[self._at[gap] : self._at[gap + 1]]
        low = low[(self.left[low] > 0) & (self.left[gap - low] > 0)]
        return [(gap - x, x) for x in low.tolist()]

    def triples(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Triples that sum to ``gap``, by their largest piece."""
        if self._threes >> gap & 1:
            for x in self._have[: np.searchsorted(self._have, gap - 1)][::-1].tolist():
                if self.left[x] and 3 * x >= gap:
                    for y, z in self.pairs(gap - x):
                        if y <= x:
                            yield x, y, z


def exact_combinations(left: np.ndarray) -> list[Pattern]:
    """Patterns without a gap, of up to four pieces; they are taken off ``left``."""
    capacity = len(left) - 1
    out: list[Pattern] = []
    index = SumIndex(left)

    def take(lengths: tuple[int, ...]) -> None:
        """Use this combination as often as the counts allow."""
        need = Counter(lengths)
        k = min(int(left[x]) // n for x, n in need.items())
        if k > 0:
            for x, n in need.items():
                left[x] -= k * n
            out.append((lengths, k))

    take((capacity,))
    for more in (index.single, index.pairs, index.triples):
        for first in range(capacity - 1, 0, -1):
            if left[first]:
                for rest in more(capacity - first):
                    if not left[first]:
                        break
                    take((first, *rest))
    return out


def best_fit(left: np.ndarray) -> list[Pattern]:
    """Best fit of all that ``left`` counts, longest first, equal bins together."""
    capacity = len(left) - 1
    left = left.copy()
    bins: dict[int, list[Pattern]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], k: int) -> None:
        if not bins[gap]:
            at = bisect_left(gaps, gap)
            if at == len(gaps) or gaps[at] != gap:
                gaps.insert(at, gap)
        bins[gap].append((pattern, k))

    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no bin has room: open new ones
                fit = capacity // length
                k, over = divmod(int(left[length]), fit)
                if k:
                    put(capacity - fit * length, (length,) * fit, k)
                if over:
                    put(capacity - over * length, (length,) * over, 1)
                left[length] = 0
                break
            gap = gaps[at]
            pattern, k = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            fit = min(gap // length, int(left[length]))
            use = min(k, int(left[length]) // fit)
            if use < k:
                put(gap, pattern, k - use)
            put(gap - fit * length, pattern + (length,) * fit, use)
            left[length] -= use * fit
    return [x for kept in bins.values() for x in kept]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (lengths side by side, times) that use each length as often as ``counts`` says."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    least = -(-int(left @ np.arange(capacity + 1)) // capacity)
    exact = exact_combinations(left)
    number = lambda patterns: sum(k for _, k in patterns)
    best = exact + best_fit(left)
    pairs, more = ([x for x in exact if (len(x[0]) > 2) == many] for many in (False, True))
    more.sort(key=lambda x: (-len(x[0]), x[0][0]))
    for share in GIVEN_BACK:
        if number(best) <= least:
            break
        back, rest, kept = math.ceil(number(more) * share), left.copy(), []
        for lengths, k in more:
            use = min(k, back)
            back -= use
            for x in lengths:
                rest[x] += use
            if use < k:
                kept.append((lengths, k - use))
        best = min(best, pairs + kept + best_fit(rest), key=number)
    return best


def _slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with the sequence of the first and the place in it; sorted."""
    upto: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, k in patterns:
        at = 0
        for length in lengths:
            rows.append((length, upto[length], sequence, at))
            upto[length] += k
            at += length
        sequence += k
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def _place(slots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(slots["sequence"][at] + rank - slots["rank"][at]), pa.array(slots["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    common.ship(docs.sparkSession)
    pieces = common.settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(tokenizer_path, capacity), _PIECES), "pack-pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = _slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
