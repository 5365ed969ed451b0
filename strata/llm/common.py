"""What the corpus operators share: session helpers, byte-level word scanning, hashing, binary classifiers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# --- session ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only where neither is set and all executors live in this process, as in tests, a temporary folder serves; elsewhere that is
    an error, as a machine's own folder is lost with it and hidden from the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            root = f"file://{tempfile.mkdtemp(prefix='strata-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor costs no recomputation upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_path(spark: SparkSession, prefix: str) -> str:
    return f"{shared_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, through the file system that Spark itself uses for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


#: Bytes of one Arrow batch between Spark and Python; Spark's own bound of 64 MB counts several times in each executor.
ARROW_BYTES = 4 << 20
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so that Python workers can import it.

    Also bounds the session's Arrow batches by bytes, unless the session has a bound of its own.
    """
    if spark.conf.get(_ARROW_KEY) == "67108864b":
        spark.conf.set(_ARROW_KEY, ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(prefix="strata-ship-"), "strata_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


# --- caches of Python workers ----------------------------------------------

_FORGET: dict[str, Callable[[], None]] = {}
_HOLDER = [""]


def holds(owner: str, forget: Callable[[], None]) -> None:
    """Register how an operator's cache, which outlives its tasks, is emptied."""
    _FORGET[owner] = forget


def claim(owner: str) -> None:
    """Begin a task of one operator in this worker: caches that others left are emptied and freed memory goes back to the system,
    so that stages do not add up."""
    if _HOLDER[0] != owner:
        for name, forget in _FORGET.items():
            if name != owner:
                forget()
        _HOLDER[0] = owner
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system; allocators keep it otherwise, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


class Recent(dict):
    """A cache of bounded bytes: values by key, found when first asked for.

    It has two generations: when the young one holds half of most_bytes it becomes the old one, from which keys that are asked for
    again come back; the rest is lost with the next change.
    """

    ENTRY = 100  # of the dictionary itself

    def __init__(self, find: Callable, most_bytes: int) -> None:
        super().__init__()
        self.find, self.room, self.held, self.old = find, most_bytes // 2, 0, {}

    def __missing__(self, key):
        got = self.old.get(key)
        return self.keep(key, self.find(key) if got is None else got)

    def keep(self, key, got):
        self.held += sys.getsizeof(key) + sys.getsizeof(got) + self.ENTRY
        if self.held > self.room:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = got
        return got

    def held_of(self, keys: set) -> dict:
        """What is held of keys; values come back from the old generation."""
        found = {k: got for k in keys if (got := self.get(k)) is not None}
        back = {k: got for k in keys if k not in found and (got := self.old.get(k)) is not None} if self.old else {}
        self.keep_all(back)
        return found | back

    def keep_all(self, found: dict) -> None:
        size = sum(map(sys.getsizeof, found)) + sum(map(sys.getsizeof, found.values())) + self.ENTRY * len(found)
        if self.held + size <= self.room:
            self.held += size
            self.update(found)
            return
        for key, got in found.items():
            self.keep(key, got)


# --- columns ---------------------------------------------------------------


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 4; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(4)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(id_col) == 2, F.lit(False))


def may_train(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold_of(id_col) != 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most max_rows labelled training rows (_id, text, label): the ids with the smallest hashes, one text of each.

    The bound is the only limit, on ids and on rows: of an id with several rows the text with the smallest hash stands for
    it. What is broadcast is the sampled (id, label) list, never more than max_rows rows.
    """
    picked = (
        labels.where(may_train(id_col) & F.col(label_col).isin(0, 1))
        .groupBy(id_col)
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.col(id_col)), F.col(id_col))
        .limit(max_rows)
        .select(F.col(id_col).alias("_id"), "label")
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


# --- Arrow batches ---------------------------------------------------------


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a NULL has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (large or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most `rows` rows and a column about `most` bytes; a longer single value stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = bytes_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True
#: `[^\x20\x09-\x0D]`
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in a buffer, and for each text the index of its first word (n + 1 values)."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = word[data]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    after[offsets[1:] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 18


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([U64(1)], np.full(_SPAN, _BASE, U64))), dtype=U64)
        down = np.cumprod(np.concatenate(([U64(1)], np.full(_SPAN, inverse, U64))), dtype=U64)
    return up, down, mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their places, from running polynomial sums over bounded spans of bytes."""
    up, down, table = _powers()
    out = np.empty(len(starts), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = int(np.searchsorted(ends, base + _SPAN, "right"))
            if to <= at:  # one word longer than a span: fold its spans
                h, n = U64(0), int(ends[at] - base)
                for k in range(0, n, _SPAN):
                    part = table[data[base + k : min(base + k + _SPAN, ends[at])]]
                    h = mix((h * U64(31) + (part * up[: len(part)]).sum(dtype=U64))[None] if np.ndim(h) else np.array([h * U64(31) + (part * up[: len(part)]).sum(dtype=U64)], U64))[0]
                out[at] = h
                at += 1
                continue
            part = table[data[base : ends[to - 1]]]
            run = np.empty(len(part) + 1, U64)
            run[0] = 0
            np.cumsum(part * up[: len(part)], dtype=U64, out=run[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (run[e] - run[s]) * down[s]
            at = to
    return mix(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; result i begins at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for j in range(k):
            h = h * U64(0xFF51AFD7ED558CCD) + words[j : j + n]
    return mix(h)


# --- models ----------------------------------------------------------------


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised features; returns weights on raw features, intercept last."""
    if len(y) == 0:
        return np.zeros(x.shape[1] + 1)
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * (w - np.r_[np.zeros(len(w) - 1), w[-1]]))
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / sd
    return np.r_[raw, w[-1] - raw @ mean]


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
