"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all text windows.

A set holds the items' words as one byte buffer, and sorted 64-bit hashes of their windows, each with the place of its first word
and the items that hold it. Every text window is looked up (first in a bitmap of hash prefixes, then by binary search), and each
hit is verified against the item's own bytes. Executors pack the sets, each of at most MOST_BYTES. A benchmark that surely fits
into one set is broadcast; of a larger one the sets are files in the shared folder, which every task reads one after another
over the texts it holds, so that texts are read once and all hits of a text are known before anything is decided.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType

from strata.llm.common import ALNUM, LOWER, bytes_of, claim, new_shared_path, open_fs, ship_package, slices, window_hashes, word_hashes, word_spans

WINDOW = 10
#: Bytes of one set.
MOST_BYTES = 64 << 20
#: Bytes that a set takes at most for a byte of item text: itself, and 36 for each word, of which two bytes hold one at most.
BYTES_A_BYTE = 1 + 36 // 2
#: Bytes of text that a task holds while it goes through several sets.
HELD_BYTES = 32 << 20
_VERIFIED = 4 << 20

DIGEST_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _equal_runs(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from i on and those from j on have equal bytes. a, b: (data, word starts, word ends)."""
    out = np.zeros(len(i), bool)
    step = np.arange(k)
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16), None] + step, j[lo : lo + (1 << 16), None] + step
        n = a[2][x].astype(np.int64) - a[1][x]
        same = np.flatnonzero((n == b[2][y].astype(np.int64) - b[1][y]).all(1))
        weight = np.cumsum(n[same].sum(1))
        at = 0
        while at < len(same):
            to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + _VERIFIED, "right")))
            rows = same[at:to]
            m = n[rows].ravel()
            begin = np.cumsum(m) - m
            inner = np.arange(int(m.sum())) - np.repeat(begin, m)
            differ = a[0][np.repeat(a[1][x[rows]].ravel(), m) + inner] != b[0][np.repeat(b[1][y[rows]].ravel(), m) + inner]
            out[lo + rows] = np.add.reduceat(differ, begin[::k]) == 0
            at = to
    return out


class WindowSet:
    """Windows of some items by length, as flat arrays."""

    BITS = 20

    def __init__(self, ids: np.ndarray, column: pa.Array, window: int) -> None:
        raw, offsets = bytes_of(column)
        self.data = LOWER[raw]
        starts, ends, first = word_spans(self.data, offsets, ALNUM)
        words = word_hashes(self.data, starts, ends)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        counts = np.diff(first)
        self.lengths: dict[int, tuple[np.ndarray, ...]] = {}
        for k in np.unique(np.minimum(counts, window)).tolist():
            if not k:
                continue
            whole = window_hashes(words, k)
            if k < window:
                docs = np.flatnonzero(counts == k)
                at = first[docs]
            else:
                at = np.arange(len(whole))
                docs = np.searchsorted(first, at, "right") - 1
                inside = at + k <= first[docs + 1]
                at, docs = at[inside], docs[inside]
            order = np.lexsort((ids[docs], whole[at]))
            at, docs = at[order], docs[order]
            h = whole[at]
            new = np.ones(len(at), bool)
            new[1:] = h[1:] != h[:-1]
            again = np.flatnonzero(~new)
            new[again] = ~_equal_runs(self.words, at[again], self.words, at[again - 1], k)
            group = np.cumsum(new) - 1
            item = ids[docs]
            once = np.ones(len(at), bool)
            once[1:] = new[1:] | (item[1:] != item[:-1])
            head = np.flatnonzero(new)
            self.lengths[k] = (h[head], at[head].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(group[once], minlength=len(head))))).astype(np.int32), item[once])

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.data, self.starts, self.ends

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.words, *(x for t in self.lengths.values() for x in t)))

    def bitmaps(self) -> dict[int, np.ndarray]:
        out = {}
        for k, (h, *_) in self.lengths.items():
            out[k] = np.zeros(1 << self.BITS, bool)
            out[k][(h >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        return out


class Hits:
    """Verified windows in some texts; grows from set to set."""

    def __init__(self, column: pa.Array) -> None:
        raw, self.offsets = bytes_of(column)
        self.data = LOWER[raw]
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets, ALNUM)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.items: dict[int, set[int]] = {}

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def add(self, windows: WindowSet, bitmaps: dict[int, np.ndarray]) -> None:
        for k, (known, at, item_first, items) in windows.lengths.items():
            h = window_hashes(self.hashes, k)
            maybe = np.flatnonzero(bitmaps[k][(h >> np.uint64(64 - WindowSet.BITS)).astype(np.int64)])
            lo = np.searchsorted(known, h[maybe], "left")
            n = np.searchsorted(known, h[maybe], "right") - lo
            docs = np.searchsorted(self.first[1:], maybe, "right")
            n[maybe + k > self.first[docs + 1]] = 0
            # one entry nearly always; more only where different words share a hash
            i, docs = np.repeat(maybe, n), np.repeat(docs, n)
            j = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            right = _equal_runs((self.data, self.starts, self.ends), i, windows.words, at[j], k)
            i, j, docs = i[right], j[right], docs[right]
            if not len(i):
                continue
            self.runs.append((i, i + k))
            pairs = np.unique(np.stack((docs, j)), axis=1)
            for d, e in pairs.T.tolist():
                self.items.setdefault(d, set()).update(items[item_first[e] : item_first[e + 1]].tolist())

    def united(self) -> dict[int, np.ndarray]:
        """[start, end) pairs of the united hit words, in the text's own words, by text."""
        if not self.runs:
            return {}
        begin, end = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        doc = np.searchsorted(self.first[1:], begin, "right")
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(begin)) - 1
        doc = doc[head]
        pairs = np.stack((begin[head], end[tail]), 1) - self.first[doc][:, None]
        cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return {int(doc[a]): pairs[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(doc)), strict=True)}


def _pack(most: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]:
    """Sets of at most `most` bytes from batches of (item, text); a longer item is cut into overlapping runs of words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        room = max(1, most // BYTES_A_BYTE)

        def made() -> bytes:
            return pickle.dumps(WindowSet(np.array(ids, np.int64), pa.array(texts, pa.large_binary()), window), protocol=5)

        for batch in slices(batches, "text"):
            raw, offsets = bytes_of(batch.column(1))
            for item, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                parts = [raw[a:b]]
                if b - a > room:
                    starts, ends, _ = word_spans(LOWER[parts[0]], np.array([0, b - a]), ALNUM)
                    parts, k = [], 0
                    while k < len(starts):
                        to = max(min(k + window, len(starts)), int(np.searchsorted(ends, starts[k] + room, "right")))
                        parts.append(raw[a + starts[k] : a + ends[to - 1]])
                        k = len(starts) if to == len(starts) else to - window + 1
                for part in parts:
                    if texts and size + len(part) + 8 > room:
                        yield made()
                        ids.clear()
                        texts.clear()
                        size = 0
                    ids.append(item)
                    texts.append(part.tobytes())
                    size += len(part) + 8
        if texts:
            yield made()

    return pack


Sets = Callable[[], Iterator[tuple[WindowSet, dict[int, np.ndarray]]]]


def _sets(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> tuple[Sets, bool]:
    """A function that gives all sets, one after another, in a task; whether there are several."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    pack = _pack(most, window)
    if total * BYTES_A_BYTE <= most:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(pack(batches)), pa.binary())], names=["windows"])

        # what comes to the driver and is broadcast is at most `most` bytes, as the sum above proves
        row = items.repartition(1).mapInArrow(one, "windows binary").first()
        packed = row[0] if row else pickle.dumps(WindowSet(np.zeros(0, np.int64), pa.array([], pa.binary()), window))
        sent = spark.sparkContext.broadcast(bytes(packed))

        def single() -> Iterator[tuple[WindowSet, dict[int, np.ndarray]]]:
            windows = pickle.loads(sent.value)
            yield windows, windows.bitmaps()

        return single, False

    folder = new_shared_path(spark, "windows")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, plain = open_fs(folder)
        files.create_dir(plain, recursive=True)
        names = []
        for windows in pack(batches):
            name = f"{uuid.uuid4().hex}.windows"
            with files.open_output_stream(f"{plain}/{name}") as out:
                out.write(windows)
            names.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    spread = items.repartition(-(-total * BYTES_A_BYTE // most), F.xxhash64("item", "text"))
    paths = [r[0] for r in spread.mapInArrow(write, "path string").collect()]  # a path for each set; files of lost tasks are not named

    def each() -> Iterator[tuple[WindowSet, dict[int, np.ndarray]]]:
        for path in paths:
            files, plain = open_fs(path)
            with files.open_input_stream(plain) as f:
                windows = pickle.loads(f.read())
            yield windows, windows.bitmaps()

    return each, True


def _scanned(batches: Iterator[pa.RecordBatch], at: int, sets: Sets, several: bool) -> Iterator[tuple[pa.RecordBatch, Hits]]:
    """Batches cut to size with all hits in their column numbered `at`."""
    claim("decontamination")
    kept = None if several else list(sets())
    held: list[tuple[pa.RecordBatch, Hits]] = []
    size = 0

    def done() -> Iterator[tuple[pa.RecordBatch, Hits]]:
        for windows, bitmaps in kept or sets():
            for _, hits in held:
                hits.add(windows, bitmaps)
        yield from held
        held.clear()

    # slices goes by a column's name, and names may clash
    numbered = (pa.RecordBatch.from_arrays(b.columns, names=[f"c{i}" for i in range(b.num_columns)]) for b in batches)
    for part in slices(numbered, f"c{at}"):
        hits = Hits(part.column(at))
        held.append((part, hits))
        size += len(hits.data) + 1
        if not several or size >= HELD_BYTES:
            yield from done()
            size = 0
    if held:
        yield from done()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word counts as hit if it stands inside any occurrence of any item window. Rows of the benchmark without an id or
    without words hold no windows; repeated items count once by id. A NULL text has no words. Without any hit, n_items is 0
    and items_sha256 is that of the empty string. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    sets, several = _sets(docs, benchmark, item_col, item_text_col, window, most_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _scanned(batches, 1, sets, several):
            n = batch.num_rows
            n_hit, n_items, shas = np.zeros(n, np.int64), np.zeros(n, np.int64), [_EMPTY] * n
            for d, runs in hits.united().items():
                ids = hits.items[d]
                n_hit[d], n_items[d], shas[d] = (runs[:, 1] - runs[:, 0]).sum(), len(ids), _sha(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits.n_words), pa.array(n_hit), pa.array(n_items), pa.array(shas), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digest, DIGEST_SCHEMA)


def _sha(ids: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length_col: str | None = "n_chars", most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs without benchmark passages, with the same columns.

    Hit words are cut out with what stands between them; a document of which more than drop_share of the words are hit goes
    whole. Clean documents pass unchanged, as do NULL and empty texts. length_col names the column of the text's length in
    characters, which follows a cut text; docs without it, or with one of that name that is no integer, keep all other columns as
    they are. However many sets a benchmark takes, all hits of a text are united before it is cut or dropped.
    """
    ship_package(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names and isinstance(docs.schema[length_col].dataType, ShortType | IntegerType | LongType) else None
    sets, several = _sets(docs, benchmark, item_col, item_text_col, window, most_bytes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _scanned(batches, at, sets, several):
            found = hits.united()
            if not found:
                yield pa.RecordBatch.from_arrays(batch.columns, names=names)
                continue
            columns = list(batch.columns)
            keep, new = np.ones(batch.num_rows, bool), columns[at].to_pylist()
            lengths = columns[length_at].to_pylist() if length_at is not None else None
            for d, runs in found.items():
                if (runs[:, 1] - runs[:, 0]).sum() > drop_share * hits.n_words[d]:
                    keep[d] = False
                    continue
                raw, base = new[d].encode(), int(hits.offsets[d])
                cuts = np.stack((hits.starts[hits.first[d] + runs[:, 0]], hits.ends[hits.first[d] + runs[:, 1] - 1]), 1) - base
                inner = [0, *cuts.ravel().tolist(), len(raw)]
                new[d] = b"".join(raw[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True)).decode()
                if lengths is not None:
                    lengths[d] = len(new[d])
            columns[at] = pa.array(new, columns[at].type)
            if lengths is not None:
                columns[length_at] = pa.array(lengths, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
