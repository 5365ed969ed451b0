"""Row-wise operators on streams.

Projections, explosions and reshaping keep no state, so they run on a streaming DataFrame as on any other. Profiles, JSON schema
inference, diffs and graph algorithms read their input more than once or globally, and are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strata import graph, nested, transformations

ROW_WISE = frozenset([
    nested.select, nested.with_fields, nested.unnest_field, transformations.convert_all_maps_to_arrays, transformations.flatten, transformations.flatten_all_arrays, transformations.sort_all_arrays,
    transformations.transform_all_field_names, transformations.transform_all_fields, transformations.unflatten, transformations.unpivot, transformations.with_generic_typed_struct,
])
WHOLE = frozenset([transformations.analyze, transformations.parse_json_columns, graph.ascending_forest_traversal])


def transform_stream(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame] | tuple) -> DataFrame:
    """Apply steps to a streaming DataFrame; a step is a function of a DataFrame, or (function, further arguments...)."""
    for step in steps:
        f, *args = step if isinstance(step, tuple) else (step,)
        if f in WHOLE:
            raise ValueError(f"{f.__name__} needs its whole input and cannot run on a stream")
        stream = f(stream, *args)
    return stream


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to Parquet files and stop; a restart goes on where the last run ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
