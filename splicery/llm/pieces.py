"""SentencePiece encoding and decoding: the N best segmentations of each whole text over the piece lattice.

A lattice position is a code point; an edge is a piece, worth its score in the vocabulary file; a code point
that is no piece goes to byte pieces at the smallest score less 10 for each character. The forward pass
(Viterbi) gives the best score of every prefix; A* then searches backward from the end, with those scores as
its heuristic. They are exact, so segmentations leave the agenda in falling order of score.

No piece holds a space after another character. The lattice of a text is therefore a chain of the lattices
of its words, and the search is split the same way: the forward pass runs once for each distinct word in
numpy, many words at a time, and tells how far the word's second best is behind. Among N - 1 alternatives of a
text only its N - 1 words with the closest second best can take part; those words get their own A*, and a
heap over their lists gives the text's N best.

Defined results: null and empty texts have no pieces, one segmentation, score 0. A text's own U+2581 goes to
byte pieces, so that decoding gives every text back. Equal scores are ordered by the segmentation found first.
Repeated rows are alike; an empty table gives no rows; other columns pass through, an input column named like
an output column is replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicery.llm.common import carried
from splicery.llm.words import mixed

SPACE = "▁"
_OWN = "\ud800"  # stands for a text's own U+2581
N_BEST = 4
#: Words known to a task before it starts anew.
KEPT = 60_000
#: And their code points.
KEPT_CHARS = 1 << 22
#: Words of one forward pass.
STEP = 8_000
#: Longer words, and words behind several spaces, take the plain forward pass.
PLAIN = 64
PENALTY = 10.0
_BASE = 0x2545F4914F6CDD1D


class Pieces:
    """The lattice of a SentencePiece vocabulary file."""

    def __init__(self, path: str, n_best: int = N_BEST):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): (i, float(model.get_score(i))) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space after another character")
        usual = [s for _, s in self.score.values() if s > -1e8]
        self.unknown = (min(usual) if usual else 0.0) - PENALTY
        self.longest = max(map(len, self.score), default=1)
        self.out = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in normal} | {i: bytes([b]) for b, i in self.byte.items()}
        self.n_best = n_best
        self._matches = ahocorasick.Automaton()
        for piece, (_, s) in self.score.items():
            self._matches.add_word(piece, (len(piece), s))
        if self.score:
            self._matches.make_automaton()
        self._tables()
        self.clear()

    # -- one word at a time ------------------------------------------------------------------

    def edges(self, word: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the edges that end at `end`."""
        found = []
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            if got := self.score.get(word[start:end]):
                found.append((start, (got[0],), got[1]))
        if not found or found[0][0] != end - 1:
            found.append((end - 1, self.bytes_of(word[end - 1]), self.unknown))
        return found

    def bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in (SPACE if char == _OWN else char).encode())

    def forward(self, word: str) -> list[float]:
        # One pass of an automaton finds the pieces that end at each place.
        none = float("-inf")
        best, single = [none] * (len(word) + 1), bytearray(len(word) + 1)
        best[0], done = 0.0, 0
        for at, (n, s) in self._matches.iter(word) if self.score else ():
            while done < at:  # a code point that is no piece itself
                done += 1
                if not single[done]:
                    best[done] = max(best[done], best[done - 1] + self.unknown)
            end = at + 1
            single[end] |= n == 1
            best[end] = max(best[end], best[end - n] + s)
        while done < len(word):
            done += 1
            if not single[done]:
                best[done] = max(best[done], best[done - 1] + self.unknown)
        return best

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), by backward A*."""
        best, found, made = self.forward(word), [], 0
        agenda = [(-best[-1], 0, len(word), 0.0, None)]
        while agenda and len(found) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, ids, s in self.edges(word, at):
                made += 1
                heapq.heappush(agenda, (-(best[start] + behind + s), made, start, behind + s, (ids, path)))
        return found

    # -- many words at a time ----------------------------------------------------------------

    def _tables(self) -> None:
        """Two hash tables of the pieces, by the upper bits of their hash."""
        self._up = np.cumprod(np.full(1 << 20, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
        self._down = np.cumprod(np.full(1 << 20, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)
        names = list(self.score)
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in names])
        h = self._hashes(codes, ends - [len(x) for x in names], ends)
        self._slots, rest = [], np.arange(len(h))
        for shift in (46, 28, 10):
            key, value = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32)
            slot = ((h[rest] >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype(np.int64)
            key[slot], value[slot] = h[rest], rest
            self._slots.append((shift, key, value))
            rest = rest[value[slot] != rest]
        if len(rest):
            raise ValueError("pieces do not fit the tables")
        self._id = np.array([self.score[x][0] for x in names], np.int64)
        self._value = np.array([self.score[x][1] for x in names])

    def _hashes(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self._up[: len(codes)], out=total[1:])
        return mixed((total[end] - total[start]) * self._down[start])

    def _many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, number of ids, best score and second best score of each word (a space before it)."""
        codes = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) + 1 for w in words])
        end = np.cumsum(size)
        begin = end - size
        left = np.repeat(end, size) - np.arange(len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self._up[: len(codes)], out=total[1:])
        worth, piece = [], []
        for n in range(1, min(self.longest, int(size.max())) + 1):
            at = np.flatnonzero(left >= n)
            h = mixed((total[at + n] - total[at]) * self._down[at])
            hit = np.full(len(at), -1, np.int32)
            for shift, key, value in self._slots:
                slot = ((h >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype(np.int64)
                hit = np.where((key[slot] == h) & (hit < 0), value[slot], hit)
            v, p = np.full(len(codes), -np.inf), np.zeros(len(codes), np.int64)
            got = hit >= 0
            v[at[got]], p[at[got]] = self._value[hit[got]], self._id[hit[got]]
            if n == 1:
                none = at[~got]
                v[none] = self.unknown
                small = codes[none] < 128
                p[none[small]] = np.array([self.byte[b] for b in range(128)])[codes[none[small]]]
                p[none[~small]] = -codes[none[~small]].astype(np.int64)
            worth.append(v)
            piece.append(p)
        # best and second best score of each prefix, word by word in step; slot begin + k + word number is prefix k.
        base = begin + np.arange(len(words))
        first, second = np.full(len(codes) + len(words), -np.inf), np.full(len(codes) + len(words), -np.inf)
        step = np.zeros(len(codes) + len(words), np.int64)
        first[base] = 0.0
        for k in range(1, int(size.max()) + 1):
            own = np.flatnonzero(size >= k)
            a, b, c = np.full(len(own), -np.inf), np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            for n in range(1, min(k, len(worth)) + 1):
                v = worth[n - 1][begin[own] + k - n]
                x, y = first[base[own] + k - n] + v, second[base[own] + k - n] + v
                better = x > a
                b = np.maximum(np.maximum(b, y), np.where(better, a, x))
                a, c = np.where(better, x, a), np.where(better, n, c)
            first[base[own] + k], second[base[own] + k], step[base[own] + k] = a, b, c
        # Back along the best path, all words at once.
        at, own, rows, ids, order = size.copy(), np.arange(len(words)), [], [], []
        table = np.stack(piece)
        turn = 0
        while len(own):
            n = step[base[own] + at[own]]
            at[own] -= n
            rows.append(own)
            ids.append(table[n - 1, begin[own] + at[own]])
            order.append(np.full(len(own), -turn))
            own, turn = own[at[own] > 0], turn + 1
        rows, ids, order = np.concatenate(rows), np.concatenate(ids), np.concatenate(order)
        sort = np.lexsort((order, rows))
        rows, ids = rows[sort], ids[sort]
        counts = np.bincount(rows, minlength=len(words))
        if (ids < 0).any():
            each = [(x,) if x >= 0 else self.bytes_of(chr(-x)) for x in ids.tolist()]
            counts = np.bincount(rows, weights=[len(e) for e in each], minlength=len(words)).astype(np.int64)
            ids = np.fromiter(chain.from_iterable(each), np.int64)
        return ids, counts, first[base + size], second[base + size]

    # -- texts -------------------------------------------------------------------------------

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.lists: dict[str, list] = {}
        self.chars = 0
        self.ids, self.start, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0
        self.best, self.gap = np.zeros(1 << 12), np.zeros(1 << 12)

    def lattice_of(self, key: str) -> str:
        return key if key.startswith(SPACE) else SPACE + key

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if len(w) < PLAIN and not w.startswith(SPACE)]
        for i in range(0, len(plain), STEP):
            some = plain[i : i + STEP]
            self._add(some, *self._many(some))
        for w in set(new).difference(plain):
            (top, ids), *more = self.search(self.lattice_of(w), 2)
            self._add([w], np.array(ids), np.array([len(ids)]), np.array([top]), np.array([more[0][0] if more else -np.inf]))

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray, best: np.ndarray, second: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(words)
        grown = lambda a, size: np.concatenate((a, np.zeros(max(len(a), size), a.dtype))) if size > len(a) else a
        self.ids = grown(self.ids, self.used + len(ids))
        self.start, self.best, self.gap = grown(self.start, m + 1), grown(self.best, m), grown(self.gap, m)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : m + 1] = self.used + np.cumsum(counts)
        self.best[n:m], self.gap[n:m] = best, best - second
        self.used += len(ids)
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(n, m), strict=True))

    @staticmethod
    def words_of(text: str) -> list[str]:
        """A text's words; one behind several spaces comes with all of them, as U+2581."""
        if not text:
            return []
        parts = text.replace(SPACE, _OWN).split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            spaces += 1
            if p:
                out.append(p if spaces == 1 else SPACE * spaces + p)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]]:
        """For each text the ids of its best segmentation, and (score, changes) of its N best; a change is (word number, ids)."""
        if len(self.known) > KEPT or self.chars > KEPT_CHARS:
            self.clear()
        if len(self.lists) > KEPT // 8:
            self.lists = {}
        parts = [self.words_of(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        k = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            lost = [flat[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(lost)))
            k[missing] = np.fromiter(map(self.known.__getitem__, lost), np.int64, len(lost))
        out, to = [], 0
        for p in parts:
            own = k[to : to + len(p)]
            to += len(p)
            if not p:
                out.append((np.zeros(0, np.int32), [(0.0, [])]))
                continue
            at, n = self.start[own], self.start[own + 1] - self.start[own]
            ends = np.cumsum(n)
            ids = self.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1])]
            out.append((ids, self._ranked(p, own)))
        return out

    def _ranked(self, words: list[str], own: np.ndarray) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        top, m = float(self.best[own].sum()), self.n_best - 1
        if not m:
            return [(top, [])]
        gap = self.gap[own]
        near = np.argpartition(gap, m)[:m] if len(gap) > m else np.arange(len(gap))
        near = near[np.lexsort((near, gap[near]))]
        lists = []
        for i in near.tolist():
            if gap[i] < np.inf:
                if (got := self.lists.get(words[i])) is None:
                    got = self.lists[words[i]] = self.search(self.lattice_of(words[i]), self.n_best)
                lists.append((i, got))
        out, seen, heap = [], set(), [(0.0, (0,) * len(lists))]
        while heap and len(out) < self.n_best:
            loss, picks = heapq.heappop(heap)
            out.append((top - loss, [(i, got[j][1]) for (i, got), j in zip(lists, picks, strict=True) if j]))
            for x, (_, got) in enumerate(lists):
                if picks[x] + 1 < len(got):
                    more = (*picks[:x], picks[x] + 1, *picks[x + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (loss + got[picks[x]][0] - got[picks[x] + 1][0], more))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the first space is the one that encoding puts before each text."""
        return b"".join(map(self.out.__getitem__, ids))[1:].decode("utf-8")


_ready: dict[tuple[str, int], Pieces] = {}


def pieces(path: str, n_best: int = N_BEST) -> Pieces:
    if (path, n_best) not in _ready:
        _ready[path, n_best] = Pieces(path, n_best)
    return _ready[path, n_best]


def encode_pieces(docs: DataFrame, model: str, n_best: int = N_BEST, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs with n_pieces, ids_crc32 (of the ids as little-endian uint32), best_score, n_best, last_score (of the n-th), round_trip,
    and, with keep_ids, `pieces` (ids of the best) and `others`: score and changed words of each further segmentation."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = pieces(model, n_best)
        try:
            for column in columns:
                at = 0
                while at < len(column):
                    texts, size = [], 0
                    while at + len(texts) < len(column) and size < 1 << 18:
                        texts.append(column[at + len(texts)].as_py() or "")
                        size += len(texts[-1])
                    at += len(texts)
                    yield encoded(lattice, texts)  # a few hundred kB of text at a time, so that results of a batch do not pile up
        finally:  # a worker outlives its task; the words known do not
            lattice.clear()
            pa.default_memory_pool().release_unused()

    def encoded(lattice: Pieces, texts: list[str]) -> pa.Array:
        cols = [[] for _ in made]
        for t, (ids, ranked) in zip(texts, lattice.encode(texts), strict=True):
            others = [{"score": s, "changes": [{"word": i, "pieces": list(x)} for i, x in changes]} for s, changes in ranked[1:]] if keep_ids else None
            row = (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ranked[0][0], len(ranked), ranked[-1][0], lattice.decode(ids.tolist()) == t, ids, others)
            for c, x in zip(cols, row, strict=False):
                c.append(x)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], made)

    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct({"score": pa.float64(), "changes": pa.list_(pa.struct({"word": pa.int32(), "pieces": pa.list_(pa.int32())}))}))]
    names = ["n_pieces", "ids_crc32", "best_score", "n_best", "last_score", "round_trip", "pieces", "others"]
    kinds = ["long", "long", "double", "long", "double", "boolean", "array<int>", "array<struct<score:double,changes:array<struct<word:int,pieces:array<int>>>>>"]
    made = names if keep_ids else names[:6]
    ddl = ", ".join(f"{n} {k}" for n, k in zip(made, kinds, strict=False))
    found = docs.withColumn("_x_pieces", F.arrow_udf(run, ddl)(F.col(text)))
    return found.select(*carried(docs, *made), *[F.col(f"_x_pieces.{n}").alias(n) for n in made])
