"""SentencePiece encoding and decoding with N-best segmentation.

A text's piece lattice has an edge wherever a piece of the vocabulary matches. Forward Viterbi gives
the best score of every prefix; a backward A* search from the end then takes those scores as its
heuristic, which is exact, so hypotheses leave the agenda in the order of their total score and the
search expands little more than the N best paths.

No piece continues across the start of a run of word marks, so the lattice falls into units (a run
of marks and the characters up to the next), and the N best paths of a text are made of the N best
of its units. In the first backward steps of the search each unit gives its best path and how much
the second costs; a path among the N best of a text can differ from the best one only in the N - 1
units where that is least, so only these are searched for their own N best, and an agenda over
choices merges them. Units repeat, so the answers of short ones stay in a memo of bounded bytes.

Scores are those of the model file, whatever they were made for. Those of a BPE file are the ranks of
its merges, so its best path here is the path of the best sum of ranks, not the merges' own result;
only of a unigram file it is the model's own encoding.

Text is taken as the model file says: no normalisation, a word mark in front, white space kept.
Characters without a piece are byte pieces, as one edge, a penalty below the worst piece.

Defined cases: a null or empty text has one segmentation, without pieces, of score 0. Texts with
fewer than N segmentations give all of them. Equal scores are ordered by the search alone, which
does not depend on partitioning. A mark character in the text decodes to a space, as in the format
itself; ``round_trip`` compares with that in mind. Rows that repeat a ``doc_id``, or have none, are
encoded each. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common

N_BEST = 4
#: Bytes that a worker's memo of units may take, by a generous count of each entry.
MEMO_BYTES = 320 << 20
#: Longer units are not remembered.
MEMO_CHARS = 100
#: How far an unknown character is below the worst ordinary piece.
PENALTY = 10.0
#: Pieces at or below this score are reserved and don't set the worst.
RESERVED = -1e8
MARK = "▁"

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = float("inf")


class PieceLattice:
    """N-best encoder and decoder over the pieces of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._root: dict = {}
        self._bytes = [0] * 256
        self._text: list[bytes] = []
        self._longest = 1
        worst = 0.0
        for i in range(sp.get_piece_size()):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
                self._text.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i):
                self._text.append(b"")
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} goes on across a word mark")
            self._text.append(piece.replace(MARK, " ").encode())
            self._longest = max(self._longest, len(piece))
            node = self._root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (score, i.to_bytes(4, "little"))
            if score > RESERVED:
                worst = min(worst, score)
        self._unknown = worst - PENALTY
        self._first = {c: self._frozen({"": self._byte_edge(c)} | node) for c, node in self._root.items()}.get
        self._memo: dict[str, tuple[float, bytes, float]] = {}
        self._paths: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self._held = [0, 0]  # bytes in either

    def _byte_edge(self, c: str) -> tuple[float, bytes]:
        """Score and ids of a character without a piece."""
        return self._unknown, b"".join([self._bytes[b].to_bytes(4, "little") for b in c.encode("utf-8", "surrogatepass")])

    def _frozen(self, node: dict) -> tuple:
        """A node of the trie as :meth:`_learn` walks it: the way to the next nodes, score and ids of the piece that ends there (None where none does)."""
        score, ids = node.get("", (0.0, None))
        return {c: self._frozen(x) for c, x in node.items() if c}.get, score, ids

    def _forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, float, bytes]]]]:
        """Best score of each prefix, and the edges (start, score, ids) into each position."""
        n = len(unit)
        best = [-_NONE] * (n + 1)
        best[0] = 0.0
        into: list[list] = [[] for _ in range(n + 1)]
        root = self._root
        for i in range(n):
            node, j, here = root, i, best[i]
            first = root.get(unit[i])
            if first is None or "" not in first:
                into[i + 1].append((i, *self._byte_edge(unit[i])))
                if here + self._unknown > best[i + 1]:
                    best[i + 1] = here + self._unknown
            for c in unit[i : i + self._longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is not None:
                    score, ids = piece
                    into[j].append((i, score, ids))
                    if here + score > best[j]:
                        best[j] = here + score
        return best, into

    def _learn(self, unit: str) -> tuple[float, bytes, float]:
        """Best score, its ids, and what the second path costs: the first backward steps of the search.

        They need no more of the edges into a position than the best (of equal ones the first) and the score of the next.
        """
        n, first, longest = len(unit), self._first, self._longest
        best = [-_NONE] * (n + 1)
        best[0] = 0.0
        other = [-_NONE] * (n + 1)
        start, edge = [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            get, j, here = first, i, best[i]
            for c in unit[i : i + longest]:
                node = get(c)
                if node is None:
                    break
                j += 1
                get, score, ids = node
                if ids is not None:
                    f = here + score
                    if f > best[j]:
                        other[j] = best[j]
                        best[j] = f
                        start[j] = i
                        edge[j] = node
                    elif f > other[j]:
                        other[j] = f
            if j == i:
                node = (None, *self._byte_edge(unit[i]))
                j += 1
                f = here + node[1]
                if f > best[j]:
                    other[j], best[j], start[j], edge[j] = best[j], f, i, node
                elif f > other[j]:
                    other[j] = f
        j, rest, path, second = n, 0.0, [], -_NONE
        while j:
            f = other[j] + rest
            if f > second:
                second = f
            _, score, ids = edge[j]
            path.append(ids)
            rest += score
            j = start[j]
        path.reverse()
        return best[n], b"".join(path), best[n] - second

    def unit_paths(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best paths of a unit: backward A* with the forward scores as heuristic."""
        best, into = self._forward(unit)
        tie = count(0, -1)  # of equal hypotheses the newest goes first, so the search goes deep
        agenda = [(-best[-1], 0, len(unit), 0.0, None)]
        out: list[tuple[float, bytes]] = []
        while agenda and len(out) < n:
            _, _, j, g, path = heapq.heappop(agenda)
            if j == 0:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                out.append((g, b"".join(ids)))
                continue
            for i, score, ids in reversed(into[j]):
                heapq.heappush(agenda, (-(g + score + best[i]), next(tie), i, g + score, (ids, path)))
        return out

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations: score and ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return [(0.0, b"")]
        units = _UNIT.findall(MARK + text.replace(" ", MARK))
        memo = self._memo
        known = list(map(memo.get, units))
        if None in known:
            for k, got in enumerate(known):
                if got is None:
                    u = units[k]
                    got = memo.get(u)  # it may have come earlier in the text
                    if got is None:
                        got = self._learn(u)
                        if len(u) <= MEMO_CHARS:
                            self._remember(0, memo, u, got, 350 + 4 * len(u) + len(got[1]))
                    known[k] = got
        scores, ids, costs = zip(*known, strict=True)
        total = sum(scores)
        out = [(total, b"".join(ids))]
        if n == 1:
            return out
        at, left = [], list(costs)
        while len(at) < n - 1 and (least := min(left)) < _NONE:  # of equal ones the first
            at.append(left.index(least))
            left[at[-1]] = _NONE
        choices = [self._unit_paths_memo(units[a], n) for a in at]
        loss = [[c[0][0] - s for s, _ in c] for c in choices]
        # Choices as tuples of ranks; each is reached once, from the one with its last change one less.
        agenda = [(loss[k][1], tuple(int(x == k) for x in range(len(at))), k) for k in range(len(at)) if len(loss[k]) > 1]
        heapq.heapify(agenda)
        while agenda and len(out) < n:
            cost, ranks, k = heapq.heappop(agenda)
            swapped = list(ids)
            for a, r, c in zip(at, ranks, choices, strict=True):
                if r:
                    swapped[a] = c[r][1]
            out.append((total - cost, b"".join(swapped)))
            for m in range(k, len(at)):
                r = ranks[m] + 1
                if r < len(loss[m]) and (m > k or r > 1):
                    new = ranks[:m] + (r,) + ranks[m + 1 :]
                    heapq.heappush(agenda, (sum(loss[x][new[x]] for x in range(len(at))), new, m))
        return out

    def _unit_paths_memo(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        got = self._paths.get((unit, n))
        if got is None:
            got = self.unit_paths(unit, n)
            if len(unit) <= MEMO_CHARS:
                self._remember(1, self._paths, (unit, n), got, 400 + 4 * len(unit) + sum(150 + len(ids) for _, ids in got))
        return got

    def _remember(self, which: int, memo: dict, key, value, size: int) -> None:
        if self._held[which] + size > MEMO_BYTES // (1 if which == 0 else 4):
            memo.clear()
            self._held[which] = 0
        memo[key] = value
        self._held[which] += size

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.nbest(text, 1)[0][1], "<u4").tolist()

    def decode(self, ids: bytes | list[int]) -> str:
        """The text of a segmentation: pieces side by side, marks as spaces, without the one in front."""
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        text = self._text
        return b"".join([text[i] for i in numbers]).decode("utf-8", "replace")[1:]


_LATTICES: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    if path not in _LATTICES:
        _LATTICES[path] = PieceLattice(path)
    return _LATTICES[path]


_OUT = "doc_id long, n_best int, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, round_trip boolean"


def _encode(path: str, n: int, keep_ids: bool):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for b in batches:
            scores, pieces, crcs, good, ids = [], [], [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                found = model.nbest(text, n)
                scores.append([s for s, _ in found])
                pieces.append([len(i) // 4 for _, i in found])
                crcs.append([zlib.crc32(i) for _, i in found])
                good.append(model.decode(found[0][1]) == text.replace(MARK, " "))
                if keep_ids:
                    ids.append([np.frombuffer(i, "<u4").astype(np.int32).tolist() for _, i in found])
            columns = [b.column(0), pa.array([len(s) for s in scores], pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array(pieces, pa.list_(pa.int64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(good, pa.bool_())]
            names = ["doc_id", "n_best", "scores", "n_pieces", "ids_crc32", "round_trip"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.list_(pa.int32()))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = gc.isenabled()
        gc.disable()  # the memo grows by tuples that no cycle holds, and each collection would go through them
        try:
            yield from encoded(batches)
        finally:
            if on:
                gc.enable()

    return run


def segment(docs: DataFrame, model_path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: scores, lengths and checksums of the N best, and whether the best decodes to the text; with ``keep_ids`` the ids too."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(model_path, n, keep_ids), _OUT + ", ids array<array<int>>" * keep_ids)
