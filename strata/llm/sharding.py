"""Sharding by sampled splitters, with DataFrame functions only.

1. Every record is kept in the sample with a chance in proportion to its size (half by bytes, half by rows, so that no range
   is large in either sense). 2. Quantiles of the sampled keys split the key order into many small ranges. 3. Records are
   assigned to ranges by binary search; a range found to be overfull gets further splitters from a denser sample. 4. Inside
   ranges, running sums give each record its place in the whole order, and equal shares of all bytes are the shards.
   Records with equal group keys are neighbours and stay in one shard if their bytes fit the law's tolerance: 1 % of a shard or
   one largest record, by which no placement of whole records can do better. A larger group is split, which is what a group
   that holds a third of all rows needs.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut

SHARDS = 24
LEAST_RANGES = 192
MOST_RANGES = 8192
ROWS_A_RANGE = 200_000
SAMPLES_A_RANGE = 64
MOST_SAMPLES = 200_000
_ORDER = ["_s_key", "_s_tie", "_s_salt"]
_LOW = -(1 << 63)


def _longs(values: Iterable[int]) -> Column:
    """An array as one string constant, which the optimiser folds, instead of thousands of expressions in every plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """Number of splitters at or below a record's key, by binary search over three literal arrays."""
    if not splitters:
        return F.lit(0)
    keys, ties, salts = map(_longs, zip(*splitters, strict=True))
    k, t, s = (F.col(c) for c in _ORDER)
    n, steps = len(splitters), []
    step = 1 << (n.bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1

    def go(at: Column, step: Column) -> Column:
        i = at + step - 1
        a, b, c = F.get(keys, i), F.get(ties, i), F.get(salts, i)
        above = (k > a) | ((k == a) & ((t > b) | ((t == b) & (s >= c))))
        return F.when((at + step <= n) & above, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go)


def _sample(records: DataFrame, chance: Column, seed: int) -> list[tuple[int, int, int]]:
    u = F.shiftrightunsigned(F.xxhash64("_s_salt", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return sorted(tuple(r) for r in records.where(u < chance).select(*_ORDER).collect())


def _splitters(sample: list[tuple[int, int, int]], ranges: int, hot: int) -> list[tuple[int, int, int]]:
    """Quantiles of a sorted sample. One that falls into a group with fewer than `hot` samples moves to the group's start."""
    often = {k for k, g in groupby(sample, key=lambda x: x[0]) if sum(1 for _ in g) >= hot}
    found = set()
    for j in range(1, ranges):
        at = sample[j * len(sample) // ranges] if sample else None
        if at is not None:
            found.add(at if at[0] in often else (at[0], _LOW, _LOW))
    return sorted(found)


def assign_shards(records: DataFrame, size: Column, group: Column, tie: Column, shards: int = SHARDS) -> DataFrame:
    """records with shard (0 to shards - 1, nearly equal bytes) and slot (gapless from 0 inside each shard).

    size: bytes of a record, at least 1; group: a long that is equal for records that belong together; tie: a long that
    orders records of a group. Wholly equal records are ordered by a salt that is fixed once. An empty table stays empty.
    Columns of records must not begin with _s_. records are checkpointed twice, so pass no more columns than needed.
    """
    own = records.columns
    base = cut(records.select("*", size.cast("long").alias("_s_size"), group.alias("_s_key"), F.coalesce(tie.cast("long"), F.lit(_LOW)).alias("_s_tie"), F.xxhash64(F.monotonically_increasing_id()).alias("_s_salt")))
    total = base.agg(F.count("*").alias("n"), F.sum("_s_size").alias("bytes"), F.max("_s_size").alias("largest")).first()
    if not total.n:
        return base.select(*own, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-total.n // ROWS_A_RANGE)))
    wanted = min(MOST_SAMPLES, SAMPLES_A_RANGE * ranges)
    weight = F.col("_s_size") / F.lit(2.0 * total.bytes) + F.lit(0.5 / total.n)
    limit = max(total.bytes // (shards * 100), total.largest)
    splitters = _splitters(_sample(base, weight * wanted, 1), ranges, max(2, round(1.5 * wanted / (shards * 100))))
    for attempt in range(3):
        placed = base.withColumn("_s_range", _range_of(splitters))
        sums = {r[0]: (r.n, r.b) for r in placed.groupBy("_s_range").agg(F.count("*").alias("n"), F.sum("_s_size").alias("b")).collect()}
        full = [k for k, (n, b) in sums.items() if n * ranges > 4 * total.n or b * ranges > 4 * total.bytes]
        if not full or total.n < 4 * ranges:
            break
        more = _sample(placed.where(F.col("_s_range").isin(full)), weight * wanted * 4, 2 + attempt)
        share = max(2, len(more) // (2 * SAMPLES_A_RANGE))
        splitters = sorted({*splitters, *_splitters(more, share, 2)})
    # groups that splitters cut are judged by all their bytes; one that fits the tolerance is not cut after all
    cut_keys = sorted({k for k, t, _ in splitters if t != _LOW})
    if cut_keys:
        whole = {r[0] for r in base.where(F.col("_s_key").isin(cut_keys)).groupBy("_s_key").agg(F.sum("_s_size").alias("b")).where(F.col("b") <= limit).collect()}
        if whole:
            splitters = sorted({(k, _LOW, _LOW) if k in whole else (k, t, s) for k, t, s in splitters})
            cut_keys = [k for k in cut_keys if k not in whole]
            placed = base.withColumn("_s_range", _range_of(splitters))
            sums = {r[0]: (r.n, r.b) for r in placed.groupBy("_s_range").agg(F.count("*").alias("n"), F.sum("_s_size").alias("b")).collect()}
    first_row, first_byte, n, b = [], [], 0, 0
    for k in range(len(splitters) + 1):
        first_row.append(n)
        first_byte.append(b)
        n, b = n + sums.get(k, (0, 0))[0], b + sums.get(k, (0, 0))[1]

    def at_range(values: list[int]) -> Column:
        return F.get(_longs(values), F.col("_s_range"))

    inside = Window.partitionBy("_s_range").orderBy(*_ORDER)
    groups = Window.partitionBy("_s_range", "_s_key")
    placed = (
        placed.withColumn("_s_row", at_range(first_row) + F.row_number().over(inside) - 1)
        .withColumn("_s_at", at_range(first_byte) + F.sum("_s_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s_size"))
        .withColumn("_s_group_at", F.min("_s_at").over(groups))
        .withColumn("_s_group", F.sum("_s_size").over(groups))
    )
    fits = (F.col("_s_group") <= limit) & ~F.col("_s_key").isin(cut_keys) if cut_keys else F.col("_s_group") <= limit
    twice = F.when(fits, 2 * F.col("_s_group_at") + F.col("_s_group")).otherwise(2 * F.col("_s_at") + F.col("_s_size"))
    placed = cut(placed.select(*own, F.least(F.lit(shards - 1), F.floor(twice * F.lit(shards) / F.lit(2.0 * total.bytes))).cast("int").alias("_s_shard"), "_s_row"))
    begin = {r[0]: r[1] for r in placed.groupBy("_s_shard").agg(F.min("_s_row")).collect()}
    start = F.get(_longs(begin.get(k, 0) for k in range(shards)), F.col("_s_shard"))
    return placed.select(*own, F.col("_s_shard").alias("shard"), (F.col("_s_row") - start).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs, under the law of near-equal bytes.

    size is the text's UTF-8 bytes plus 8 (8 for a NULL text, whose text_crc32 is NULL). Groups are equal texts. Repeated rows
    each take a slot; a NULL doc_id orders first in its group. Other columns are not read.
    """
    text = F.col(text_col)
    compact = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_group"))
    placed = assign_shards(compact, F.col("size"), F.col("_group"), F.col("doc_id"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole records as path/shard=N/, in slot order inside each file."""
    text = F.col(text_col)
    placed = assign_shards(docs, F.coalesce(F.octet_length(text), F.lit(0)) + 8, F.xxhash64(text), F.col(id_col), shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
