"""Exact top-k search with a bit-sliced index.

Vectors are quantised to integers. A block of rows is stored as bitmaps, one for each attribute and bit. A query's scores of
a whole block are added up with bitmap arithmetic: every nonzero signed digit of every query component adds an attribute's
slices at a weight, and carry-save adders (five bitmap operations for three bitmaps) reduce each weight's bitmaps to one. The
sum's slices are then walked from the most significant downward to select the best rows; rows that tie at the boundary are
resolved exactly by id. Blocks are independent and built once; a window over k rows from each block gives the final ranks.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import claim, cut, new_shared_path, open_fs, ship_package

K = 5
SCALE = 256
BLOCK = 1 << 15
#: Queries in one file: with 1024 components of 8 bytes at most 32 MB.
QUERY_BLOCK = 4096
STEP = 50


class BitSlicedBlock:
    """Slices of one block of rows, which must be sorted by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.rows, self.x = ids, rows, x
        n, self.dims = x.shape
        self.words = -(-n // 64)
        self.low = x.min(0) if n else np.zeros(self.dims, np.int64)
        u = x - self.low
        self.bits = max(1, int(u.max(initial=0)).bit_length())
        self.top = (1 << self.bits) - 1
        padded = np.zeros((self.words * 64, self.dims), np.int64)
        padded[:n] = u
        self.slices = np.empty((2, self.dims, self.bits, self.words), np.uint64)
        for b in range(self.bits):
            packed = np.packbits(((padded >> b) & 1).astype(bool), axis=0, bitorder="little").T
            self.slices[0, :, b] = np.ascontiguousarray(packed).view(np.uint64)
        self.slices[1] = ~self.slices[0]
        self.valid = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    @staticmethod
    def digits(w: int) -> list[tuple[int, int]]:
        """Nonadjacent signed binary digits: (place, 0 for +1 or 1 for -1)."""
        out, place = [], 0
        while w:
            if w & 1:
                d = 2 - (w & 3)
                out.append((place, 0 if d == 1 else 1))
                w -= d
            w >>= 1
            place += 1
        return out

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the rows' scores (shifted by a constant), least significant first."""
        signs, dims, places = [], [], []
        for d, w in enumerate(query.tolist()):
            for place, sign in self.digits(w):
                signs.append(sign)
                dims.append(d)
                places.append(place)
        places = np.array(places, np.int64)
        picked = self.slices[np.array(signs, np.int64), np.array(dims, np.int64)] if len(signs) else np.zeros((0, self.bits, self.words), np.uint64)
        at_weight: list[list[np.ndarray]] = [[] for _ in range((int(places.max()) if len(places) else 0) + self.bits)]
        for b in range(self.bits):
            for place in np.unique(places):
                at_weight[place + b].append(picked[places == place, b])
        out = []
        weight = 0
        while weight < len(at_weight):
            m = np.concatenate(at_weight[weight]) if at_weight[weight] else np.zeros((0, self.words), np.uint64)
            carries = []
            while len(m) > 1:
                if len(m) == 2:
                    carries.append((m[0] & m[1])[None])
                    m = (m[0] ^ m[1])[None]
                    break
                t = len(m) // 3
                a, b, c = m[:t], m[t : 2 * t], m[2 * t : 3 * t]
                x = a ^ b
                carries.append((a & b) | (x & c))
                m = np.concatenate((x ^ c, m[3 * t :]))
            if carries:
                if weight + 1 == len(at_weight):
                    at_weight.append([])
                at_weight[weight + 1] += carries
            out.append(m[0] if len(m) else np.zeros(self.words, np.uint64))
            at_weight[weight] = []
            weight += 1
        return out

    def top_rows(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Places of the k best rows (all, if fewer), ties to smaller places; the row numbered `own` takes no part."""
        sure = np.zeros(self.words, np.uint64)
        open_ = self.valid.copy()
        mine = np.flatnonzero(self.rows == own)
        for i in mine:
            open_[i >> 6] &= ~np.uint64(1 << (int(i) & 63))
        if int(np.bitwise_count(open_).sum()) > k:
            for s in reversed(self.scores(query)):
                got = sure | (open_ & s)
                n = int(np.bitwise_count(got).sum())
                if n > k:
                    open_ = open_ & s
                else:
                    sure = got
                    open_ = open_ & ~s
                    if n == k:
                        open_ = np.zeros_like(open_)
                        break
        best = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
        return np.concatenate((best, ties[: max(0, k - len(best))]))


def quantised(column: pa.ListArray) -> tuple[list[np.ndarray], int]:
    """floor(256 x) of each vector, x as double, and the largest size of a component; exact integers of any length beyond 2^62."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    most = float(np.abs(values).max(initial=0.0)) * SCALE
    if most < 2.0**62:
        flat = np.floor(values * SCALE).astype(np.int64)
    else:
        flat = np.array([math.floor(Fraction(v) * SCALE) for v in values.tolist()], object)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], max(map(abs, flat.tolist()), default=0) if flat.dtype == object else int(np.abs(flat).max(initial=0))


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with 0."""
    kind = object if any(v.dtype == object for v in vectors) else np.int64
    out = np.zeros((len(vectors), dims), kind)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _plain_top(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best rows with integers of any length, for components beyond the slices' 64 bits."""
    scores = [sum(a * b for a, b in zip(v, query, strict=True)) for v in x.astype(object).tolist()]
    best = sorted((i for i in range(len(ids)) if rows[i] != own), key=lambda i: (-scores[i], i))[:k]
    return np.array(best, np.int64), np.array([max(-(1 << 63), min((1 << 63) - 1, scores[i])) for i in best], np.int64)


def top_k(vectors: DataFrame, k: int = K, step: int = STEP, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by step, its k best other rows.

    Components become floor(256 x); the score is their integer inner product, shorter vectors counting as padded with 0; ties
    go to the smaller id. Rows with a NULL id, and vectors that are NULL or hold NULL or non-finite components, take no part.
    Rows are told apart by row, not by id: of repeated rows each is the others' candidate, and repeated query rows give
    repeated ranks. Finite components of any size count exactly; among the k best of a block a score beyond 64 bits is given, and
    compared with other blocks', as the nearest value inside them. Other columns are not read. Executors write the queries
    in files of at most query_block to the shared folder; a task builds each of its blocks once and takes all files past it.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
    table = cut(usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x")))
    dims = table.agg(F.max(F.size("x"))).first()[0] or 0
    folder = new_shared_path(spark, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, plain = open_fs(folder)
        files.create_dir(plain, recursive=True)
        names = []
        for batch in batches:
            for lo in range(0, batch.num_rows, query_block):
                part = batch.slice(lo, query_block)
                w, _ = quantised(part.column(2))
                name = f"{uuid.uuid4().hex}.queries"
                with files.open_output_stream(f"{plain}/{name}") as out:
                    out.write(pickle.dumps((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(w, dims)), protocol=5))
                names.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    few = table.where(F.col("id") % step == 0)
    spread = max(1, -(-few.count() // query_block))
    paths = sorted(r[0] for r in few.repartition(spread, "row").mapInArrow(write, "path string").collect())  # a path for each block of queries

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("top k")
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            r, i = t.column("row").to_numpy(), t.column("id").to_numpy()
            order = np.lexsort((r, i))
            parts = [quantised(c) for c in t.column("x").chunks]
            m = _matrix([v for p in parts for v in p[0]], dims)[order]
            most = max(p[1] for p in parts)
            index = BitSlicedBlock(i[order], r[order], m) if most < 1 << 61 else None
            widest = np.abs(m).max(0).astype(np.float64)
            for path in paths:
                files, plain = open_fs(path)
                with files.open_input_stream(plain) as f:
                    rows, ids, q = pickle.loads(f.read())
                out = []
                for own, query_id, w in zip(rows.tolist(), ids.tolist(), q, strict=True):
                    if index is not None and w.dtype != object and widest @ np.abs(w) < 2.0**61:
                        best = index.top_rows(w, own, k)
                        score = index.x[best] @ w
                    else:  # sums may leave 64 bits
                        best, score = _plain_top(i[order], r[order], m, w.tolist(), own, k)
                    out.append((np.full(len(best), own), np.full(len(best), query_id), i[order][best], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - size)
                held.append(part)
                at += part.num_rows
                size += part.num_rows
                if size == block:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    found = table.mapInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
