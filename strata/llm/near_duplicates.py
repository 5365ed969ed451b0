"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct word shingles. Two sets link when 100 x intersection >= similarity x union.

Order all shingles: rare ones first, by hash, then frequent ones, by hash. Two sets of that similarity share a shingle in the
first n - ceil(similarity x n) + 1 of either, so rare shingles of such prefixes are indexed one by one. Where a prefix runs into
frequent shingles, those are dealt into classes by hash and the prefix is extended until, over the classes, the members beyond the
first of each make up what is missing: two linked sets then share two shingles of one class, so pairs of a class are
indexed instead of single frequent shingles. Class counts follow the set's size, which keeps pairs linear in it.

Large buckets are never expanded to all their pairs: each bucket is first compared with one pivot (the member with the
fewest rare shingles), links are closed to components, and only members of different components are compared further. What is
left of a large bucket is compared block by block against sketches, which hand on only pairs that may link; texts that share much
boilerplate and do not link cost comparisons there, but no candidates. Equal sets are one node throughout. What is broadcast are bitmaps of bounded size; a false bit only costs work, never a link.

Passes over the texts recompute shingles instead of storing them: sets (n, node), shingle counts, prefixes, and the sets
of candidate nodes for verification.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import LOWER, NONSPACE, bytes_of, claim, cut, mix, ship_package, slices, window_hashes, word_hashes, word_spans

SHINGLE = 4
SIMILARITY = 85
#: Share of the hash space in which shingles are counted; prefixes of most sets lie inside it.
COUNTED = 3 << 60
BUCKETS = 256
#: Distinct nodes, modulo 64, from which a shingle counts as frequent.
FREQUENT_BITS = 4
SMALL_BUCKET = 32
#: Members of a block of a large bucket.
BLOCK = 1024
LEAST_BITMAP, MOST_BITMAP = 1 << 16, 1 << 26
STAR_ROUNDS = 1
#: Links that one task may unite; more go through distributed rounds.
FEW_LINKS = 500_000
_TEXT = 2 << 20
U = np.uint64


# --- sets ------------------------------------------------------------------


def doc_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's first (n + 1 values)."""
    raw, offsets = bytes_of(column)
    data = LOWER[raw]
    starts, ends, first = word_spans(data, offsets, NONSPACE)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    whole = window_hashes(words, k)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(size)))
    s = np.empty(at[-1], U)
    inside = np.zeros(len(words) + 1, bool)
    inside[: len(whole)] = True
    full = np.flatnonzero(counts >= k)
    for j in range(1, k):
        inside[first[full + 1] - j] = False
    place = np.repeat(np.arange(len(counts)), counts)
    good = np.flatnonzero(inside[: len(words)] & (counts[place] >= k)) if len(words) else np.zeros(0, np.int64)
    spot = at[place[good]] + good - first[place[good]] if len(good) else good
    s[spot] = whole[good]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        c = int(counts[d])
        s[at[d]] = mix(window_hashes(words[first[d] : first[d + 1]], c) + U(c))[0]
    for d in full:
        s[at[d] : at[d + 1]].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[at[:-1][size > 0]] = True
    distinct = np.concatenate(([0], np.cumsum(keep)))
    return s[keep], distinct[at]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        run = np.concatenate(([U(0)], np.cumsum(values, dtype=U)))
    with np.errstate(over="ignore"):
        return run[offsets[1:]] - run[offsets[:-1]]


def nodes_of(s: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    with np.errstate(over="ignore"):
        a, b = _sums(mix(s + U(0x1234567 + seed)), offsets), _sums(mix(s ^ U(0x9ABCDEF012345678 + seed)), offsets)
    return mix(a).view(np.int64), mix(b).view(np.int64)


def sketches(s: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """How many shingles of each set fall into each of BUCKETS parts of the hash space, 255 for more.

    The sum over parts of the smaller count bounds an intersection from above.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * BUCKETS + (s & U(BUCKETS - 1)).astype(np.int64), minlength=n * BUCKETS)
    data = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * BUCKETS, BUCKETS, dtype=np.int32)), pa.py_buffer(data)])


def sketches_allow(x: np.ndarray, y: np.ndarray, nx: np.ndarray | int, ny: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sets with these sketches (one or many against many) may link."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    full = ((x == 255) & (y == 255)).any(1)
    return full | (100 * most >= similarity * (nx + ny - most))


def needed_overlap(n: np.ndarray | int, similarity: int):
    return -(-similarity * n // 100)


# --- bitmaps ---------------------------------------------------------------


class Bitmap:
    """A fixed-size set of hashes with false positives."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def of(df: DataFrame, column: str, size: int) -> Bitmap:
        """The hashes in a column of df; size: about how many. Bits are united by Spark, so that at most bits / 64 rows come back."""
        bits = LEAST_BITMAP
        while bits < min(8 * size, MOST_BITMAP):
            bits *= 2
        spot = F.pmod(F.col(column), F.lit(bits))
        rows = df.select(F.floor(spot / 64).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int")).alias("m")).groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
        words = np.zeros(bits // 64, np.int64)
        words[rows.column("i").to_numpy()] = rows.column("m").to_numpy()
        return Bitmap(bits, words.view(U))

    def has(self, h: np.ndarray) -> np.ndarray:
        spot = h & U(self.bits - 1)
        return (self.words[(spot >> U(6)).astype(np.int64)] >> (spot & U(63))) & U(1) == 1


# --- prefixes --------------------------------------------------------------


def combination_prefix(rare: int, hot: np.ndarray, n: int, similarity: int) -> np.ndarray:
    """Hashes of the indexed pairs of frequent shingles (sorted hashes) of a set of n with `rare` rare shingles."""
    missing = n - needed_overlap(n, similarity) + 1 - rare
    if missing <= 0 or len(hot) < 2:
        return np.zeros(0, U)
    out = []
    level = n.bit_length() - 1
    upper = 1 << (level + 1)
    for v in [level, level + 1] if n * 100 >= similarity * upper else [level]:
        classes = max(1, (1 << v) // 8)
        c = (mix(hot) % U(classes)).astype(np.int64)
        order = np.argsort(c, kind="stable")
        head = np.ones(len(c), bool)
        head[1:] = c[order][1:] != c[order][:-1]
        later = np.empty(len(c), bool)
        later[order] = ~head
        enough = np.searchsorted(np.cumsum(later), missing) + 1
        h, c = hot[:enough], c[:enough]
        for k in np.unique(c):
            own = h[c == k]
            if len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                with np.errstate(over="ignore"):
                    out.append(mix(own[i] * U(0x9E3779B97F4A7C15) ^ mix(own[j] + U(v))))
    return np.concatenate(out) if out else np.zeros(0, U)


class Frequencies:
    """Which shingles several nodes share, and which are frequent; the low part of the hash space counted over all sets, the rest
    over those sets alone whose prefixes reach it."""

    def __init__(self, low: tuple[Bitmap, Bitmap], high: tuple[Bitmap, Bitmap] | None = None) -> None:
        self.low, self.high = low, high

    @staticmethod
    def of(counts: DataFrame) -> tuple[Bitmap, Bitmap]:
        """counts: (token, hot) of shared shingles."""
        shared, hot = counts.agg(F.count("*"), F.count_if("hot")).first()
        return Bitmap.of(counts, "token", shared), Bitmap.of(counts.where("hot"), "token", 2 * hot)

    def rare_low(self, s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each shingle is rare and in the low part, and how many such each set has."""
        rare = (s < U(COUNTED)) & ~self.low[1].has(s)
        run = np.concatenate(([0], np.cumsum(rare)))
        return rare, run[offsets[1:]] - run[offsets[:-1]]


def _prefix_sizes(offsets: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    return n, n - needed_overlap(n, similarity) + 1


def prefix_rows(s: np.ndarray, offsets: np.ndarray, known: Frequencies, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of sets: (text, signature, rare shingles in the prefix, whether it is a pair). Order: low rare, high rare, frequent; each by hash."""
    n, p = _prefix_sizes(offsets, similarity)
    doc = np.repeat(np.arange(len(n)), n)

    def ranks(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags)))
        return run[:-1] - run[offsets[:-1]][doc]

    low, n_low = known.rare_low(s, offsets)
    reach = (n_low < p) & (n > 1)
    single = low & (ranks(low) < p[doc]) & known.low[0].has(s)
    high = (s >= U(COUNTED)) & reach[doc] & ~known.high[1].has(s)
    single |= high & (ranks(high) < (p - n_low)[doc]) & known.high[0].has(s)
    run = np.concatenate(([0], np.cumsum(high)))
    rare = n_low + run[offsets[1:]] - run[offsets[:-1]]
    at = np.flatnonzero(single)
    docs, sigs = [doc[at]], [s[at]]
    frequent = ~low & ~high
    for d in np.flatnonzero(reach & (rare < p)):
        own = slice(offsets[d], offsets[d + 1])
        pairs = combination_prefix(int(rare[d]), s[own][frequent[own]], int(n[d]), similarity)
        docs.append(np.full(len(pairs), d))
        sigs.append(pairs)
    docs = np.concatenate(docs)
    return docs, np.concatenate(sigs), np.minimum(rare, p)[docs], np.arange(len(docs)) >= len(at)


# --- components ------------------------------------------------------------


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node of links (a, b), by alternating large and small stars.

    Up to FEW_LINKS links are united by one task in one pass.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_unite, "node bigint, comp bigint")
    seen = None
    while True:
        # large star: a node's larger neighbours move to its smallest neighbour
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


# --- the join --------------------------------------------------------------


def _may_link(nx: str, ny: str, rx: str, ry: str, pair: str, similarity: int) -> Column:
    """Whether sizes, and for a pair of frequent shingles also rare ones, allow a link.

    A set that is indexed by pairs has all its rare shingles in its prefix. Two such sets that have a rare one in common meet in its
    own bucket; otherwise neither's rare ones are in the intersection.
    """
    nx, ny, rx, ry, pair = map(F.col, (nx, ny, rx, ry, pair))
    most = F.when(pair, F.least(nx - rx, ny - ry)).otherwise(F.least(nx, ny))
    return most * 100 >= (nx + ny - most) * similarity


class _Join:
    def __init__(self, docs: DataFrame, similarity: int, shingle: int, id_col: str, text_col: str) -> None:
        self.spark = docs.sparkSession
        ship_package(self.spark)
        doc_id = F.col(id_col).cast("long")
        self.texts = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(doc_id).alias("h"))
        self.similarity, self.shingle = similarity, shingle
        self.seed = 0

    def scan(self, make, schema: str, source: DataFrame | None = None, only: Bitmap | None = None) -> DataFrame:
        """make(rows, sets, offsets, nodes) gives columns; run over all texts. An id that is NULL takes no part in links.

        only: the ids to take, by hash; false bits let others by.
        """
        seed, shingle = self.seed, self.shingle
        names = [x.split()[0] for x in schema.split(", ")]
        sent = self.spark.sparkContext.broadcast(only)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("near duplicates")
            only = sent.value
            for batch in batches:
                if only is not None:
                    batch = batch.filter(pa.array(only.has(batch.column(2).to_numpy().view(U))))
                for part in slices(iter([batch]), "text", _TEXT):
                    s, offsets = doc_sets(part.column(1), shingle)
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(part, s, offsets, nodes_of(s, offsets, seed))], names=names)

        return (self.texts.where("doc_id IS NOT NULL") if source is None else source).mapInArrow(run, schema)

    def sets(self) -> DataFrame:
        """doc_id, n, node, sketch, t (hash of the text) of every document; retried with another seed should two different sets share a 64-bit node."""
        while True:
            table = cut(self.scan(lambda rows, s, offsets, nodes: [rows.column(0), np.diff(offsets), *nodes, sketches(s, offsets), rows.column(3)], "doc_id bigint, n bigint, node bigint, other bigint, sketch binary, t bigint", self.texts.withColumn("t", F.xxhash64("text"))))
            if not table.groupBy("node").agg((F.min("other") != F.max("other")).alias("bad")).where("bad").limit(1).count():
                return table.drop("other")
            self.seed += 1

    def members(self, nodes: DataFrame) -> DataFrame:
        """sig, node, n, rare, pair of every indexed signature, from one document of each node (false bits let some copies by)."""
        only = Bitmap.of(nodes.select(F.xxhash64("doc_id").alias("h")), "h", nodes.count())
        similarity = self.similarity
        mask = lambda nodes, doc: (U(1) << (nodes.view(U)[doc] & U(63))).view(np.int64)

        def shared(make) -> DataFrame:
            counts = self.scan(make, "token bigint, mask bigint", only=only).groupBy("token").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("mask")).alias("bits")).where("n > 1")
            return cut(counts.select("token", (F.col("bits") >= FREQUENT_BITS).alias("hot")))

        def in_low(rows, s, offsets, nodes):
            at = np.flatnonzero(s < U(COUNTED))
            return [s[at].view(np.int64), mask(nodes[0], np.searchsorted(offsets, at, "right") - 1)]

        low = Frequencies(Frequencies.of(shared(in_low)))
        sent_low = self.spark.sparkContext.broadcast(low)

        def in_high(rows, s, offsets, nodes):
            n, p = _prefix_sizes(offsets, similarity)
            reach = (sent_low.value.rare_low(s, offsets)[1] < p) & (n > 1)
            at = np.flatnonzero((s >= U(COUNTED)) & np.repeat(reach, n))
            return [s[at].view(np.int64), mask(nodes[0], np.searchsorted(offsets, at, "right") - 1)]

        sent = self.spark.sparkContext.broadcast(Frequencies(low.low, Frequencies.of(shared(in_high))))

        def signatures(rows, s, offsets, nodes):
            doc, sig, rare, pair = prefix_rows(s, offsets, sent.value, similarity)
            return [sig.view(np.int64), nodes[0][doc], np.diff(offsets)[doc], rare, pair]

        return cut(self.scan(signatures, "sig bigint, node bigint, n bigint, rare bigint, pair boolean", only=only))

    def bounded(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches allow a link. nodes: (node, doc_id, n, sketch) of one document of each set."""
        similarity = self.similarity

        def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, BUCKETS) for i in (4, 5))
                yield batch.select([0, 1]).filter(pa.array(sketches_allow(x, y, batch.column(2).to_numpy(), batch.column(3).to_numpy(), similarity)))

        side = nodes.select("node", "n", "sketch")
        with_a = pairs.join(side.toDF("a", "na", "sa"), "a")
        return with_a.join(side.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(allowed, "a bigint, b bigint")

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        similarity = self.similarity
        wanted = cut(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", "doc_id"))
        size = wanted.count()
        if not size:
            return pairs.limit(0)
        only = Bitmap.of(wanted.select(F.xxhash64("doc_id").alias("h")), "h", size)

        def whole(rows, s, offsets, nodes):
            data = s.tobytes()
            return [nodes[0], pa.array([data[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())]

        own = self.scan(whole, "node bigint, tokens binary", only=only)
        own = cut(own.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                left, right = batch.column(2), batch.column(3)
                for k in range(batch.num_rows):
                    x, y = (np.frombuffer(c[k].as_buffer(), U) for c in (left, right))
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum()) if len(y) else 0
                    keep[k] = both > 0 and 100 * both >= similarity * (len(x) + len(y) - both)
                yield batch.select([0, 1]).filter(pa.array(keep))

        with_b = pairs.join(own.toDF("b", "tb"), "b")
        return with_b.join(own.toDF("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")

    def rest(self, live: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (x, y) of different components that share a signature, for what the stars have left open.

        Small buckets are joined with themselves. In a large one nearly all are of one component by now; each other member meets
        that component's members, once whatever the number of signatures, and the other members of its bucket, in blocks that
        hand on only pairs which sizes, rare shingles and sketches allow.
        """
        similarity = self.similarity
        by_comp = live.groupBy("sig", "comp").agg(F.count("*").alias("m"))
        size = by_comp.groupBy("sig").agg(F.sum("m").alias("total"), F.max_by("comp", F.struct("m", "comp")).alias("main"))
        size = cut(size.select("sig", (F.col("total") <= SMALL_BUCKET).alias("small"), "main"))
        known = live.select("sig", "node", "n", "rare", "pair", "comp").join(size, "sig")
        left = cut(known.where("small OR comp <> main").distinct())
        small = left.where("small")
        one = small.select("sig", "pair", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rare").alias("rx"), F.col("comp").alias("cx"))
        two = small.select("sig", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rare").alias("ry"), F.col("comp").alias("cy"))
        may = _may_link("nx", "ny", "rx", "ry", "pair", similarity)
        inside = one.join(two, "sig").where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & may).select("x", "y")
        large = left.where("not small").select("pair", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rare").alias("rx"), F.col("main").alias("comp")).distinct()
        mains = live.select("comp", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rare").alias("ry")).distinct().join(large.select("comp").distinct(), "comp", "left_semi")
        across = large.join(mains, "comp").where(may).select("x", "y")
        return inside.unionAll(across).unionAll(self.blocks(left.where("not small").select("sig", "node", "n", "rare", "pair", "comp"), nodes))

    def blocks(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (x, y) of different components in large buckets (sig, node, n, rare, pair, comp) that may link.

        Buckets of the same members are one. Where the buckets overlap so much that all their members compared once are fewer
        comparisons, bands of sizes take the buckets' place: sets in bands that are not neighbours cannot link. A bucket is
        dealt into blocks of about BLOCK members, and each pair of blocks is a group of its own.
        """
        similarity = self.similarity
        alike = members.groupBy("sig", "pair").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("d1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("d2"))
        alike = cut(alike.groupBy("m", "d1", "d2", "pair").agg(F.min("sig").alias("sig")))
        work = alike.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0]
        if work is None:
            return members.select(F.col("node").alias("x"), F.col("node").alias("y")).limit(0)
        apart = members.select("node", "n", "rare", "comp").distinct()
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / similarity) * (1 + 1e-9))).cast("long") if similarity < 100 else F.col("n")
        banded = apart.withColumn("band", band)
        cells = banded.groupBy("band").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0]
        if work > 3 * cells:
            # a band meets itself and the one below, where its sets are marked as upper ones
            rows = banded.select(F.explode(F.array(F.struct(F.col("band").alias("bucket"), F.lit(False).alias("upper")), F.struct((F.col("band") - 1).alias("bucket"), F.lit(True).alias("upper")))).alias("at"), "node", "n", F.lit(0).cast("long").alias("rare"), "comp").select("at.*", "node", "n", "rare", "comp", F.lit(False).alias("pair"))
        else:
            rows = members.join(alike.select("sig"), "sig").select(F.col("sig").alias("bucket"), F.lit(False).alias("upper"), "node", "n", "rare", "comp", "pair")
        rows = cut(rows)
        dealt = rows.join(rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts")), "bucket")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int")).join(nodes.select("node", "sketch"), "node")
        sent = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        sent = sent.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "upper", "node", "n", "rare", "comp", "pair", "sketch")

        def compare(p: pd.DataFrame) -> pd.DataFrame:
            lo, hi = p["lo"].iloc[0], p["hi"].iloc[0]
            columns = [p[c].to_numpy() for c in ("node", "n", "rare", "comp", "upper")]
            sketch = np.frombuffer(b"".join(p["sketch"]), np.uint8).reshape(len(p), BUCKETS)
            left = np.flatnonzero(p["part"].to_numpy() == lo)
            right = left if lo == hi else np.flatnonzero(p["part"].to_numpy() == hi)
            node, n, rare, comp, upper = (c[right] for c in columns)
            right_sketch, pair = sketch[right], bool(p["pair"].all())
            found = []
            for k, i in enumerate(left.tolist()):
                xn, xs, xr, xc, xu = (c[i] for c in columns)
                most = np.minimum(xs - xr, n - rare) if pair else np.minimum(xs, n)
                may = (comp != xc) & (100 * most >= similarity * (xs + n - most)) & ~(upper & xu)
                if lo == hi:
                    may[: k + 1] = False
                at = np.flatnonzero(may)
                at = at[sketches_allow(sketch[i], right_sketch[at], xs, n[at], similarity)]
                found.append((np.full(len(at), xn), node[at]))
            x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            return pd.DataFrame({"x": x, "y": y})

        return sent.groupBy("bucket", "lo", "hi").applyInPandas(compare, "x bigint, y bigint")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Every document's set, and the component of every node that has one beside itself."""
        sets = self.sets()
        first = sets.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        nodes = cut(sets.where("doc_id IS NOT NULL AND n > 0").join(first, ["node", "doc_id"]).dropDuplicates(["node"]))
        members = self.members(nodes)
        similarity = self.similarity
        links: list[DataFrame] = []
        tried: list[DataFrame] = []
        comp: DataFrame | None = None
        live = members
        for k in range(STAR_ROUNDS + 1):
            if comp is not None:
                known = live.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            else:
                known = live.withColumn("comp", F.col("node"))
            known = known.select("sig", "node", "n", "rare", "pair", "comp")
            open_ = known.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("rare", F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "comp")).alias("pivot")).where("c0 <> c1").select("sig", F.col("pivot.node").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.rare").alias("pr"), F.col("pivot.comp").alias("pc"))
            live = cut(known.join(open_, "sig"))
            if not live.limit(1).count():
                break
            if k < STAR_ROUNDS:
                pairs = live.where((F.col("comp") != F.col("pc")) & _may_link("n", "pn", "rare", "pr", "pair", similarity)).select(F.col("p").alias("x"), F.col("node").alias("y"))
            else:
                pairs = self.rest(live, nodes)
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            if tried:
                pairs = pairs.join(reduce(DataFrame.unionAll, tried), ["a", "b"], "left_anti")
            # pairs that sketches rule out are not even written
            pairs = cut(self.bounded(pairs, nodes))
            tried.append(pairs)
            found = cut(self.verified(pairs, nodes))
            if found.limit(1).count():
                links.append(found)
                comp = cut(components(reduce(DataFrame.unionAll, links)))
            live = live.select("sig", "node", "n", "rare", "pair")
        return sets, comp if comp is not None else self.spark.createDataFrame([], "node bigint, comp bigint")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    A NULL text or one without words has no shingles and is linked with nothing: its component is its own id. A text with fewer
    words than a shingle is one shingle. A row with a NULL id takes no part in links and has a NULL component. Repeated
    rows, and different rows with one id and equal texts, share their component. Other columns are not read.
    """
    join = _Join(docs, similarity, shingle, id_col, text_col)
    sets, comp = join.run()
    least = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = least.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_node = placed.join(best, "comp").select("node", "component_id")
    alone = F.col("n") == 0
    return (
        sets.where(~alone & F.col("doc_id").isNotNull())
        .join(of_node, "node")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionAll(sets.where(alone | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def keep_representatives(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; columns as before. Rows with a NULL id all stay.

    Rows with one id and different texts are told apart by their sets; of rows without words one stays for each id. Other columns
    may have any names.
    """
    sets, comp = _Join(docs, similarity, shingle, id_col, text_col).run()
    own = F.when(F.col("n") == 0, F.col("doc_id")).alias("own")
    least = sets.where("doc_id IS NOT NULL").groupBy("node", own).agg(F.min(F.struct("doc_id", "t")).alias("row"))
    best = least.join(comp, "node", "left").groupBy(F.coalesce("comp", "node").alias("comp"), "own").agg(F.min("row").alias("row"))
    chosen = best.select(F.col("row.doc_id").alias("first"), F.col("row.t").alias("hash")).distinct()
    # whole rows travel as one column, so that their names cannot clash with those made here
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"))
    kept = rows.join(chosen, (F.col("id") == F.col("first")) & (F.col("t") == F.col("hash")), "left_semi")
    rank = F.row_number().over(Window.partitionBy("id", "t").orderBy("t"))
    kept = kept.withColumn("rank", rank).where("rank = 1").select("doc.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
