"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary of a SentencePiece BPE model defines a lattice over a text: a path is a sequence of pieces, and two adjacent
pieces weigh 0 if merging their characters gives back just these two, else minus infinity. The BPE encoding is the one path of
weight 0 (an encoding is right exactly if every adjacent pair is), so encoding is a max-plus shortest-path problem.

Giant texts are cut into chunks at any character. The state at a cut is the piece that covers the character before it. Each
chunk yields its transfer matrix between the states of its two cuts; matrices are combined associatively (groups of chunks, then
groups of a text), which fixes the state at every cut; then every chunk is traced back by itself between its two states.
Inside a chunk, no piece reaches over the start of a word, so words are encoded once each and remembered.
"""

from __future__ import annotations

import functools
import pickle
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import Recent, bytes_of, claim, cut, holds, ship_package, slices

SPACE = "▁"
CHUNK = 1 << 16
FAN_IN = 256
UNKNOWN = -1
PREFIX = -3
#: A path's ends count as states too.
EDGE = (0, 0, -2)
State = tuple[int, int, int]
Matrix = dict[State, dict[State, float]]


class Slots:
    """Numbers from 0 by whole-number keys from 0, asked for in whole arrays; open addressing in 2^bits slots."""

    def __init__(self, bits: int) -> None:
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        at = self._home(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.values[at], np.int32(-1))
        left = np.flatnonzero(~hit & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet; there must be room."""
        self.n += len(keys)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = free & (self.keys[at] == keys)
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & self.mask


class Merges:
    """How each piece comes out of merging, step by step, and whether two pieces that stand side by side stay apart.

    A state is the leftmost and the rightmost symbol of a piece between two merges. Side by side, the better next merge goes first
    and the left one among equals, so the pair stays apart exactly if the merge across never goes first.
    """

    LAST = np.int32(2**31 - 1)

    def __init__(self, lattice: Lattice, histories: dict[int, list[tuple[float, str, str]]]) -> None:
        symbols = dict(lattice.ids)
        for p in lattice.ids:
            for c in p:
                symbols.setdefault(c, len(lattice.pieces) + len(symbols))
        best_first = np.unique(-np.array(lattice.scores))
        ranks = np.searchsorted(best_first, -np.array(lattice.scores)).tolist()
        self.first = np.zeros(len(lattice.pieces), np.int64)
        left: list[int] = []
        right: list[int] = []
        losses: list[float] = []
        for k, steps in histories.items():
            p = lattice.pieces[k]
            self.first[k] = len(left)
            left += [symbols[p[0]], *[symbols[x] for _, x, _ in steps]]
            right += [symbols[p[-1]], *[symbols[y] for _, _, y in steps]]
            losses += [*[-w for w, _, _ in steps], np.inf]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.following = np.where(np.isinf(losses), self.LAST, np.searchsorted(best_first, losses).astype(np.int32))
        joins = {symbols[p[:e]] << 21 | symbols[p[e:]]: ranks[k] for p, k in lattice.ids.items() for e in range(1, len(p)) if p[:e] in symbols and p[e:] in symbols}
        self.joins = Slots(max(1, 2 * len(joins)).bit_length() + 1)
        self.joins.put(np.fromiter(joins.keys(), np.int64, len(joins)), np.fromiter(joins.values(), np.int32, len(joins)))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = self.first[a], self.first[b]
        ok = np.ones(len(a), bool)
        asked = np.arange(len(a))
        while len(asked):
            across = self.joins.find(self.right[i] << 21 | self.left[j])
            x, y = self.following[i], self.following[j]
            bad = (across >= 0) & (across < x) & (across <= y)
            ok[asked[bad]] = False
            more = ~bad & (np.minimum(x, y) < self.LAST)
            on_left = x <= y
            i, j, asked = (i + on_left)[more], (j + ~on_left)[more], asked[more]
        return ok


class Lattice:
    """Pieces of a model, their compatibility, and shortest paths between states."""

    #: Bytes that remembered words and ends of words may take, and how many pairs of pieces are remembered: one by one, and as 2^bits slots.
    WORD_BYTES, TAIL_BYTES, PAIRS, PAIR_BITS = 48 << 20, 2 << 20, 200_000, 20
    #: Stretches up to so many characters are solved together, so many characters at once.
    SHORT, TOGETHER = 128, 1 << 17

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [sp.get_score(i) for i in range(len(sp))]
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces reach over the start of a word")
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.words = Recent(lambda w: self.word(SPACE + w), self.WORD_BYTES)
        self.tails = Recent(self.word, self.TAIL_BYTES)
        #: Every beginning of a piece: the piece's id, or PREFIX if it is none or can never come out of merging.
        self.table: dict[str, int] = {}
        histories: dict[int, list[tuple[float, str, str]]] = {}
        for p, k in self.ids.items():
            for e in range(1, len(p)):
                self.table.setdefault(p[:e], PREFIX)
            steps: list[tuple[float, str, str]] = []
            if self.merged(p, steps) == [p]:
                self.table[p] = k
                histories[k] = steps
            else:
                self.table.setdefault(p, PREFIX)
        self.merges = Merges(self, histories)
        self.known_pairs = Slots(self.PAIR_BITS)
        # the same beginnings as numbered nodes, from 0 for the empty one
        nodes = {t: n for n, t in enumerate(self.table, 1)}
        nodes[""] = 0
        self.node_piece = np.array([PREFIX, *self.table.values()], np.int32)
        children = {nodes[t[:-1]] << 21 | ord(t[-1]): n for t, n in nodes.items() if t}
        self.children = Slots(max(1, 2 * len(children)).bit_length() + 1)
        self.children.put(np.fromiter(children.keys(), np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children)))
        # characters that are in no piece but their own: nothing reaches over them
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        lone = [c for c in map(chr, range(128)) if c not in joined]
        self.lone = re.compile(f"([{re.escape(''.join(lone))}])") if lone else None
        # marks that no piece has after a letter or digit: a word splits before them
        after = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if p[i].isalnum()}
        breaks = [c for c in map(chr, range(128)) if not c.isalnum() and c != "_" and c not in after]
        self.tail = re.compile(f"({SPACE}*[^\\W_]+)([{re.escape(''.join(breaks))}].*)", re.DOTALL) if breaks else re.compile("(?!)()()")

    def merged(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """Characters merged pairwise, the best-scored piece first, leftmost among equals. Only for pieces and pairs of pieces.

        steps gets, for each merge, its score and the first and last symbol after it.
        """
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.ids.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]
            if steps is not None:
                steps.append((best, s[0], s[-1]))

    def weight(self, a: int, b: int) -> bool:
        """Whether the pair weighs 0. A character without a piece merges with nothing."""
        if a < 0 or b < 0:
            return True
        row = self.pairs.get(a)
        if row is None:
            row = self.pairs[a] = {}
        got = row.get(b)
        if got is None:
            p, q = self.pieces[a], self.pieces[b]
            got = row[b] = self.merged(p + q) == [p, q]
            self.n_pairs += 1
            if self.n_pairs > self.PAIRS:
                self.pairs, self.n_pairs = {a: {b: got}}, 1
        return got

    def _reach(self, text: str, begin: int, end: int, before: int | None) -> tuple[list[int], list[int]]:
        """By place from begin (0) to end: start (-1: not reachable) and piece of the last piece of the path of weight 0 to it."""
        size = end - begin
        starts, found = [-1] * (size + 1), [0] * (size + 1)
        table, pairs, weight = self.table.get, self.pairs, self.weight
        for at in range(size):
            if at == 0:
                prev = UNKNOWN if before is None else before
            elif starts[at] >= 0:
                prev = found[at]
            else:
                continue
            row = pairs.get(prev) if prev >= 0 else None
            s = begin + at
            for e in range(s + 1, end + 1):
                k = table(text[s:e])
                if k is None:
                    if e == s + 1 and starts[at + 1] < 0:
                        starts[at + 1], found[at + 1] = at, UNKNOWN
                    break
                if k >= 0 and starts[e - begin] < 0:
                    if prev < 0:
                        ok = True
                    else:
                        ok = row.get(k) if row is not None else None
                        if ok is None:
                            ok = weight(prev, k)
                            row = self.pairs.get(prev)
                    if ok:
                        starts[e - begin], found[e - begin] = at, k
        return starts, found

    def forward(self, text: str, begin: int, end: int, before: int | None) -> dict[int, tuple[int, int]]:
        """For each reachable place from begin to end: (start, piece) of the last piece of the path of weight 0 to it.

        before: the piece that ends at begin, None at a text's start or at the start of a word.
        """
        starts, found = self._reach(text, begin, end, before)
        return {begin + e: (begin + starts[e], found[e]) for e in range(1, end - begin + 1) if starts[e] >= 0}

    def _plain(self, w: str) -> bytes:
        """Ids of a stretch that nothing divides."""
        starts, found = self._reach(w, 0, len(w), None)
        out: list[int] = []
        e = len(w)
        while e > 0:
            s = starts[e]
            if found[e] >= 0:
                out.append(found[e])
            else:
                out += [self.byte_ids[b] for b in reversed(w[s:e].encode())]
            e = s
        out.reverse()
        return array("i", out).tobytes()

    def spelled(self, text: str, path: Iterable[tuple[int, int, int]]) -> bytes:
        out: list[int] = []
        for s, e, k in path:
            if k >= 0:
                out.append(k)
            else:
                out += [self.byte_ids[b] for b in text[s:e].encode()]
        return struct.pack(f"<{len(out)}i", *out)

    def trace(self, text: str, last: dict[int, tuple[int, int]], begin: int, end: int) -> list[State]:
        path, e = [], end
        while e > begin:
            s, k = last[e]
            path.append((s, e, k))
            e = s
        return path[::-1]

    def stretches(self, w: str) -> list[str]:
        """What a word (with its word-start marks, or without any at a text's beginning) divides into; no piece reaches from one to the next."""
        if w.lstrip(SPACE).isalpha():
            return [w]
        if self.lone is not None and self.lone.search(w) is not None:
            return [x for k, p in enumerate(self.lone.split(w)) if p for x in ([p] if k % 2 else self.stretches(p))]
        m = self.tail.fullmatch(w)
        return [w] if m is None else [m[1], m[2]]

    def word(self, w: str) -> bytes:
        """Ids of one word."""
        return b"".join([self.tails[p] if p != w and p[0] != SPACE else self._plain(p) for p in self.stretches(w)]) if w else b""

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of pieces weigh 0, remembered up to half of the slots."""
        keys = a.astype(np.int64) << 21 | b
        got = self.known_pairs.find(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            ok = self.merges.apart(fresh >> 21, fresh & (1 << 21) - 1)
            got[new] = ok[back]
            if self.known_pairs.n + len(fresh) > 1 << self.PAIR_BITS - 1:
                self.known_pairs = Slots(self.PAIR_BITS)
            if len(fresh) <= 1 << self.PAIR_BITS - 1:
                self.known_pairs.put(fresh, ok.astype(np.int32))
        return got > 0

    def _plain_together(self, words: list[str]) -> list[bytes]:
        """_plain of each of many short stretches: the scan takes one place of all stretches at a time."""
        if not words:
            return []
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(words)), sizes)
        stop = ends[of]
        at = np.arange(len(chars))
        start, node, size = at, np.zeros(len(at), np.int64), 0
        starts, stops, pieces = [], [], []
        while len(start):
            node = self.children.find(node << 21 | chars[start + size]).astype(np.int64)
            if size == 0:
                alone = start[node < 0]
                starts.append(alone)
                stops.append(alone + 1)
                pieces.append(np.full(len(alone), UNKNOWN, np.int32))
            start, node, size = start[node >= 0], node[node >= 0], size + 1
            k = self.node_piece[node]
            starts.append(start[k >= 0])
            stops.append(start[k >= 0] + size)
            pieces.append(k[k >= 0])
            inside = start + size < stop[start]
            start, node = start[inside], node[inside]
        edge_start, edge_stop, edge_piece = np.concatenate(starts), np.concatenate(stops), np.concatenate(pieces)
        depth = (edge_start - (ends - sizes)[of[edge_start]]).astype(np.int16)
        order = np.argsort(depth, kind="stable")
        edge_start, edge_stop, edge_piece = edge_start[order], edge_stop[order], edge_piece[order]
        bounds = np.searchsorted(depth[order], np.arange(int(sizes.max()) + 1))
        # a word of n characters has n + 1 places: place = character + word
        came, found = np.full(len(chars) + len(words), -1, np.int64), np.full(len(chars) + len(words), UNKNOWN, np.int32)
        begin = ends - sizes + np.arange(len(words))
        came[begin] = begin
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            shift = of[edge_start[lo:hi]]
            s, e, k = edge_start[lo:hi] + shift, edge_stop[lo:hi] + shift, edge_piece[lo:hi]
            reached = came[s] >= 0
            s, e, k = s[reached], e[reached], k[reached]
            prev = found[s]
            ok = (prev < 0) | (k < 0)
            ask = np.flatnonzero(~ok)
            ok[ask] = self._apart(prev[ask], k[ask])
            came[e[ok]], found[e[ok]] = s[ok], k[ok]
        place = ends + np.arange(len(words))
        left = np.flatnonzero(sizes > 0)
        taken_word, taken_piece = [], []
        while len(left):
            e = place[left]
            if (came[e] < 0).any():
                raise ValueError("no path leads to a place that one was traced to")
            taken_word.append(left)
            taken_piece.append(found[e])
            place[left] = came[e]
            left = left[place[left] > begin[left]]
        who, ids = np.concatenate(taken_word[::-1]), np.concatenate(taken_piece[::-1])
        by_word = np.argsort(who, kind="stable")
        who, ids = who[by_word], ids[by_word]
        spelled = np.zeros(len(words), bool)
        spelled[who[ids < 0]] = True
        data = ids.astype("<i4").tobytes()
        cuts = (4 * np.searchsorted(who, np.arange(len(words) + 1))).tolist()
        return [self._plain(w) if own else data[a:b] for w, own, a, b in zip(words, spelled.tolist(), cuts, cuts[1:], strict=False)]

    def _solved(self, keys: set[str]) -> dict[str, bytes]:
        """Ids by key: a word after one mark is its own key, one after several goes with all its marks."""
        known = self.words.held_of(keys)
        simple: list[str] = []
        divided: dict[str, list[str]] = {}
        for key in keys:
            if key not in known:
                if key.isalpha():
                    simple.append(key)
                else:
                    divided[key] = self.stretches(key if key[:1] == SPACE else SPACE + key)
        known.update(zip(simple, self._each([SPACE + w for w in simple]), strict=True))
        # a stretch after one mark may be a word of its own
        parts = {p for ps in divided.values() for p in ps}
        bodies = {p[1:] for p in parts if p[0] == SPACE and p[1:2] != SPACE}
        asked = {SPACE + w: got for w in bodies if (got := known.get(w)) is not None} | {SPACE + w: got for w, got in self.words.held_of(bodies).items()} | self.tails.held_of(parts)
        todo = [p for p in parts if p not in asked]
        new = dict(zip(todo, self._each(todo), strict=True))
        self.tails.keep_all({p: got for p, got in new.items() if p[0] != SPACE and len(p) <= 16})
        asked |= new
        known.update((key, asked[ps[0]] if len(ps) == 1 else b"".join([asked[p] for p in ps])) for key, ps in divided.items())
        self.words.keep_all({key: known[key] for key in [*simple, *divided] if len(key) <= 64 and key[:1] != SPACE})
        return known

    def _each(self, stretches: list[str]) -> list[bytes]:
        """_plain of each: short ones together, so many characters at once, and long ones one by one."""
        out: list[bytes] = []
        todo, held = [], 0
        for p in stretches:
            held += len(p)
            if len(p) > self.SHORT or held > self.TOGETHER:
                out += self._plain_together(todo)
                todo, held = [], len(p)
            if len(p) > self.SHORT:
                out.append(self._plain(p))
                held = 0
            else:
                todo.append(p)
        return out + self._plain_together(todo)

    def run(self, text: str) -> bytes:
        """Ids of a stretch that begins with a mark at a word start (or is a text's beginning) and ends at a word start."""
        head, *parts = text.split(SPACE)
        keys = _keys(parts)
        return (self.word(head) if head else b"") + b"".join(map(self._solved(set(keys)).__getitem__, keys))

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as run(normalise(text)) gives them; words of all of them are solved together."""
        split = [_keys((t.replace(SPACE, " ") if SPACE in t else t).split(" ")) if t else [] for t in texts]
        known = self._solved(set().union(*split))
        return [b"".join(map(known.__getitem__, keys)) for keys in split]

    # --- chunks: text holds up to `longest` characters of context on both sides; a and b are its cuts ---

    def states(self, text: str, cut_at: int) -> list[State]:
        """Pieces that may cover the character before a cut, as (start, end, piece) relative to the cut."""
        found = []
        for s in range(max(0, cut_at - self.longest), cut_at):
            for e in range(s + 1, min(len(text), s + self.longest) + 1):
                k = self.table.get(text[s:e])
                if k is None:
                    if e - s == 1 and e == cut_at:
                        found.append((s - cut_at, e - cut_at, UNKNOWN))
                    break
                if k >= 0 and e >= cut_at:
                    found.append((s - cut_at, e - cut_at, k))
        return found

    @staticmethod
    def _starts(text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last word start in [lo, hi)."""
        inner = list(_word_starts(text, lo, hi))
        return (inner[0], inner[-1]) if inner else None

    def _columns(self, last: dict[int, tuple[int, int]], b: int, end: int) -> list[State]:
        return [(last[e][0] - b, e - b, last[e][1]) for e in range(b, min(end, b + self.longest - 1) + 1) if e in last and last[e][0] < b]

    def transfer(self, text: str, a: int, b: int, first: bool, last_chunk: bool) -> Matrix:
        rows = [EDGE] if first else self.states(text, a)
        end = b if last_chunk else min(len(text), b + self.longest - 1)
        finish = (lambda last: [EDGE] if b in last else []) if last_chunk else (lambda last: self._columns(last, b, end))
        inner = self._starts(text, a + self.longest + 1, b)
        out: Matrix = {}
        if inner is None:
            for r in rows:
                last = self.forward(text, a + r[1], end, None if r == EDGE else r[2])
                out[r] = dict.fromkeys(finish(last), 0.0)
            return out
        q, q2 = inner
        columns = dict.fromkeys(finish(self.forward(text, q2, end, None)), 0.0)
        for r in rows:
            if a + r[1] == q or q in self.forward(text, a + r[1], q, None if r == EDGE else r[2]):
                out[r] = columns
        return out

    def between(self, text: str, a: int, b: int, left: State, right: State) -> bytes:
        """Ids of the pieces after the left state's, up to and with the right state's."""
        begin = a + left[1]
        before = None if left == EDGE else left[2]
        stop = b if right == EDGE else b + right[1]
        inner = self._starts(text, a + self.longest + 1, b)
        if inner is None:
            return self.spelled(text, self.trace(text, self.forward(text, begin, stop, before), begin, stop))
        q, q2 = inner
        head = self.spelled(text, self.trace(text, self.forward(text, begin, q, before), begin, q))
        tail = self.spelled(text, self.trace(text, self.forward(text, q2, stop, None), q2, stop))
        return head + (self.run(text[q:q2]) if q2 > q else b"") + tail


def _word_starts(text: str, lo: int, hi: int) -> Iterator[int]:
    """The first and the last place in [lo, hi) where a mark follows anything but a mark."""
    lo = max(lo, 1)
    i = text.find(SPACE, lo, hi)
    while i >= 0 and text[i - 1] == SPACE:
        i = text.find(SPACE, i + 1, hi)
    if i < 0:
        return
    yield i
    j = text.rfind(SPACE, i + 1, hi)
    while j > i and text[j - 1] == SPACE:
        j = text.rfind(SPACE, i + 1, j)
    if j > i:
        yield j


def _keys(parts: list[str]) -> list[str]:
    """What stands after each of a stretch's marks, as keys of words: after several marks, all of them are part of the key."""
    if "" not in parts:
        return parts
    keys, marks = [], 0
    for p in parts:
        marks += 1
        if p:
            keys.append(p if marks == 1 else SPACE * marks + p)
            marks = 0
    if marks:
        keys.append(SPACE * marks)
    return keys


def multiply(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product; pairs that are missing weigh minus infinity."""
    out: Matrix = {}
    for r, row in x.items():
        best: dict[State, float] = {}
        for m, w in row.items():
            for c, v in y.get(m, {}).items():
                if w + v > best.get(c, -np.inf):
                    best[c] = w + v
        if best:
            out[r] = best
    return out


def cut_states(matrices: list[Matrix], left: State, right: State) -> list[State]:
    """The states at all cuts of a chain of matrices on the best path from left to right, both included."""
    reach: list[dict[State, float]] = [{left: 0.0}]
    for m in matrices:
        nxt: dict[State, float] = {}
        for s, w in reach[-1].items():
            for c, v in m.get(s, {}).items():
                if w + v > nxt.get(c, -np.inf):
                    nxt[c] = w + v
        reach.append(nxt)
    path = [right]
    for k in range(len(matrices) - 1, -1, -1):
        s = max((s for s in reach[k] if path[-1] in matrices[k].get(s, {})), key=lambda s: reach[k][s] + matrices[k][s][path[-1]])
        path.append(s)
    return path[::-1]


def normalise(text: str | None) -> str:
    """What a model without character rules makes of a text: word-start marks for spaces, one more in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def piece_bytes(sp) -> list[bytes]:
    """What each id of a SentencePiece vocabulary spells."""
    out = []
    for i in range(len(sp)):
        p = sp.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode())
    return out


class Spelling:
    """What each id spells, as one byte buffer."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts that runs of ids spell; run i is ids[offsets[i] : offsets[i + 1]]. Bytes that are no UTF-8 give replacement characters."""
        size = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = self.data[np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[offsets]
        # the mark in front of a text is not part of it
        marked = np.flatnonzero(np.diff(at))
        marked = marked[raw[at[marked]] == 32]
        keep = np.ones(len(raw), bool)
        keep[at[marked]] = False
        gone = np.zeros(len(at), np.int64)
        gone[marked + 1] = 1
        raw, at = raw[keep], at - np.cumsum(gone)
        data = raw.tobytes()
        full = np.flatnonzero(np.diff(at))
        try:
            data.decode()
            if ((raw[at[full]] & 0xC0) == 0x80).any():
                raise ValueError("a character goes from one text into the next")
        except ValueError:
            return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.string())
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


@functools.lru_cache(maxsize=2)
def _spelling(model: bytes) -> Spelling:
    import sentencepiece

    return Spelling(piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=model)))


def _same_texts(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Whether texts are equal byte by byte; NULL counts as empty."""
    (a, i), (b, j) = bytes_of(x), bytes_of(y)
    if np.array_equal(i, j) and np.array_equal(a, b):
        return np.ones(len(x), bool)
    return np.array([np.array_equal(a[k:m], b[n:o]) for k, m, n, o in zip(i, i[1:], j, j[1:], strict=False)], bool)


_LATTICES: dict[int, Lattice] = {}
holds("pieces", _LATTICES.clear)


def _lattice(model: bytes) -> Lattice:
    """The model's lattice with its cache; asked for once a task."""
    claim("pieces")
    key = zlib.crc32(model)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(model)
    return _LATTICES[key]


# --- operators -------------------------------------------------------------

_BATCH = 1 << 20


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each list begins (n + 1 places); a NULL list is an empty one."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _int_lists(values: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) // 4 for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), "<i4")))


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids (array<int>) of every row of docs.

    NULL and empty texts have no ids. Repeated rows are repeated, a NULL id is kept. Texts of more than `chunk` characters go
    through chunks of that many. Other columns are not read.
    """
    return _encoded(docs, model, id_col, text_col, chunk, False)


def _encoded(docs: DataFrame, model: bytes, id_col: str, text_col: str, chunk: int, back: bool) -> DataFrame:
    """doc_id, ids; with `back` also the text that the ids spell and whether it is the row's own."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    giant = F.length("text") >= chunk
    schema = "doc_id bigint, ids array<int>" + ", text string, restored boolean" * back
    names = ["doc_id", "ids", *["text", "restored"] * back]

    def finished(doc_id: pa.Array, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
        if not back:
            return pa.RecordBatch.from_arrays([doc_id, ids], names=names)
        spelled = _spelling(sent.value).texts(*_flat(ids))
        return pa.RecordBatch.from_arrays([doc_id, ids, spelled, pa.array(_same_texts(spelled, text))], names=names)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(sent.value)
        for batch in slices(batches, "text", _BATCH):
            yield finished(batch.column(0), _int_lists(lattice.whole(batch.column(1).to_pylist())), batch.column(1))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            yield finished(*batch.columns)

    short = base.where(~giant).mapInArrow(small, schema)
    long_rows = cut(base.where(giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    if not long_rows.limit(1).count():
        return short
    return short.unionAll(_encode_giant(spark, long_rows, sent, chunk).select("doc_id", "ids", "text").mapInArrow(large, schema))


def _encode_giant(spark: SparkSession, rows: DataFrame, sent, chunk: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _lattice(sent.value).longest + 1
        for batch in slices(batches, "text", 1):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = normalise(text)
                cuts = [*range(0, max(1, len(t) - reach), chunk), len(t)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lo = max(0, a - reach)
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "part": pa.array([k], pa.int32()), "parts": pa.array([len(cuts) - 1], pa.int32()), "a": pa.array([a - lo], pa.int32()), "b": pa.array([b - lo], pa.int32()), "piece": pa.array([t[lo : b + reach]])})

    parts = cut(rows.mapInArrow(split, "row bigint, part int, parts int, a int, b int, piece string").repartition("row", "part"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(sent.value)
        for batch in batches:
            made = [pickle.dumps(lattice.transfer(t, a, b, k == 0, k == n - 1)) for k, n, a, b, t in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.binary())], names=["row", "part", "parts", "m"])

    local = cut(parts.mapInArrow(matrices, "row bigint, part int, parts int, m binary").withColumn("grp", F.floor(F.col("part") / FAN_IN).cast("int")))

    def product(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        m = pickle.loads(p["m"].iloc[0])
        for other in p["m"].iloc[1:]:
            m = multiply(m, pickle.loads(other))
        return pd.DataFrame({"row": [p["row"].iloc[0]], "grp": [p["grp"].iloc[0]], "m": [pickle.dumps(m)]})

    # at most FAN_IN chunks a group, and at most 2^31 / chunk / FAN_IN groups a text
    grouped = local.groupBy("row", "grp").applyInPandas(product, "row bigint, grp int, m binary")

    def outer(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("grp")
        s = cut_states([pickle.loads(m) for m in p["m"]], EDGE, EDGE)
        return pd.DataFrame({"row": p["row"], "grp": p["grp"], "ends": [pickle.dumps(x) for x in zip(s, s[1:], strict=False)]})

    ends = grouped.groupBy("row").applyInPandas(outer, "row bigint, grp int, ends binary")

    def inner(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        left, right = pickle.loads(p["ends"].iloc[0])
        s = cut_states([pickle.loads(m) for m in p["m"]], left, right)
        return pd.DataFrame({"row": p["row"], "part": p["part"], "ends": [pickle.dumps(x) for x in zip(s, s[1:], strict=False)]})

    states = local.join(ends, ["row", "grp"]).groupBy("row", "grp").applyInPandas(inner, "row bigint, part int, ends binary")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(sent.value)
        for batch in batches:
            a, b, t, s = (batch.column(i).to_pylist() for i in range(2, 6))
            ids = [lattice.between(t, a, b, *pickle.loads(s)) for a, b, t, s in zip(a, b, t, s, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _int_lists(ids)], names=["row", "part", "ids"])

    traced = parts.join(states, ["row", "part"]).select("row", "part", "a", "b", "piece", "ends").mapInArrow(backtrace, "row bigint, part int, ids array<int>")
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.join(whole, "row").select("row", "doc_id", "text", "ids")


def decode_pieces(encoded: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with the column out_col, the text that its ids spell; a column of that name gives way. NULL ids give NULL."""
    ship_package(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    other = encoded.select([c for c in encoded.columns if c != out_col])
    names = [*other.columns, out_col]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _spelling(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                column = part.column(at)
                texts = spelling.texts(*_flat(column))
                if column.null_count:
                    texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return other.mapInArrow(run, other.select("*", F.lit(None).cast("string").alias(out_col)).schema)


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, text (what the ids decode to), restored (whether that is the row's own text; a NULL text counts as an empty one) of every row of docs.

    A text with a word-start mark of its own is not restored: the mark decodes to a space. Each text is encoded and its ids
    decoded in one step, so that neither texts nor ids travel in between.
    """
    return _encoded(docs, model, id_col, text_col, chunk, True)
