"""Furthest ancestors in a forest, by pointer doubling."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import IllegalArgumentException
from strata.plans.paths import quote


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that all executors share; one of its own only where all of them live in this process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise IllegalArgumentException("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strata-"))
    return df.checkpoint(eager=True)


def ascending_forest_traversal(input_df: DataFrame, node_id: str, parent_id: str, keep_labels: bool = False) -> DataFrame:
    """For each node the id of its furthest ancestor, in the column parent_id.

    A node without a parent (NULL or itself) is its own ancestor; a parent that has no row is an ancestor without a parent. Nodes
    in a cycle, or below one, get NULL. Each round doubles the length of the jumps, so a forest of depth n takes about log2(n)
    rounds, and one more if there are cycles. keep_labels adds the rows of node and
    furthest_ancestor as structs; nodes whose ancestor has no row are then left out.
    """
    for c in (node_id, parent_id):
        assert c in input_df.columns, f"Could not find column {c} in Dataframe's columns: {input_df.columns}"
    node, parent = F.col(quote(node_id)), F.col(quote(parent_id))
    rooted: Column = parent.isNull() | (parent == node)
    steps = input_df.select(node.alias("id"), F.when(rooted, node).otherwise(parent).alias("up"), F.coalesce(rooted, F.lit(True)).alias("done"))
    # a parent without a row is where the way ends
    known = steps.select(F.col("id").alias("k")).distinct()
    state = _cut(steps.join(known, steps["up"] == known["k"], "left").select("id", "up", (F.col("done") | F.col("k").isNull()).alias("done")))
    done, open_ = state.where("done"), state.where("not done")
    left = open_.count()
    while left:
        near = open_.unionAll(done).select(F.col("id").alias("k"), F.col("up").alias("far"), F.col("done").alias("there"))
        moved = _cut(open_.join(near, open_["up"] == near["k"], "left").select("id", F.coalesce("far", "up").alias("up"), F.coalesce("there", F.lit(True)).alias("done")))
        done, open_ = done.unionAll(moved.where("done")), moved.where("not done")
        still = open_.count()
        if still == left:  # of the nodes that can arrive, the nearest always does: only cycles are left
            break
        left = still
    lost = open_.select("id", F.lit(None).cast(state.schema["up"].dataType).alias("up"))
    result = done.select("id", "up").unionAll(lost)
    named = result.select(F.col("id").alias(node_id), F.col("up").alias(parent_id))
    if not keep_labels:
        return named
    row = F.struct(*(F.col(quote(c)) for c in input_df.columns))
    own = input_df.select(node.alias("_own"), row.alias("node"))
    far = input_df.select(node.alias("_far"), row.alias("furthest_ancestor"))
    return named.join(own, F.col(quote(node_id)) == F.col("_own")).join(far, F.col(quote(parent_id)) == F.col("_far")).select(quote(node_id), quote(parent_id), "node", "furthest_ancestor")

