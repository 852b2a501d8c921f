"""What the stateful streams share: the state store that they need, and a look at what a stopped stream has stored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State with several variables, timers and a time to live needs this provider in the session that starts the stream."""
    if "RocksDB" not in spark.conf.get(PROVIDER):
        spark.conf.set(PROVIDER, ROCKS)


def stored(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """(the key's columns, the variable's columns) of all keys in a stopped stream's last state."""
    use_state_store(spark)
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select("key.*", "value.*")


def plain_rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """All rows of a key in their order, with None for every missing value."""
    whole = pd.concat(list(batches))
    rows = (whole.sort_values(order) if order else whole).to_dict("records")
    missing = lambda v: v is None or (not isinstance(v, (list, str)) and not hasattr(v, "__len__") and pd.isna(v))
    return [{k: None if missing(v) else v for k, v in r.items()} for r in rows]
