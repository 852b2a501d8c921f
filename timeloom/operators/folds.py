"""Folds over ordered rows that no window expresses: one sorted pass, linear in the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: fold(key) gives a function that takes a row as a dict, or None at the key's end, and gives the rows that are then finished.
Fold = Callable[[object], Callable[[dict | None], Iterable[dict]]]


def ordered_fold(df: DataFrame, key: str, order: list[str], fold: Fold, schema: str, batch: int = 4_096) -> DataFrame:
    """The rows that the fold makes of each key's rows in their order. Rows are dealt by key and sorted by Spark, which spills, and stream
    through the fold; no key's rows are held together. A null key is a key."""
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        now, step, out, begun = None, None, [], False
        for b in batches:
            for row in b.to_pylist():
                if not begun or row[key] != now:
                    if begun:
                        out += step(None)
                    now, step, begun = row[key], fold(row[key]), True
                out += step(row)
                if len(out) >= batch:
                    yield from pa.Table.from_pylist(out, schema=target).to_batches()
                    out = []
        if begun:
            out += step(None)
        yield from pa.Table.from_pylist(out, schema=target).to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
