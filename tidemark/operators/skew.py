"""Joining rows to a table with one row per key when one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is hot. At most (all rows / HOT_ROWS) keys can
# be, so a list of hot keys is short whatever the data, and safe to broadcast.
HOT_ROWS = 1_000_000


def attach(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], coarse: Sequence[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """`rows` left-joined to `table`, which has at most one row per key.

    Rows of hot keys meet their row of `table` where they are read and are never
    shuffled into one task; all others take the ordinary join. `coarse`, a part of
    the keys, makes finding hot keys cheap: only rows whose coarse key is hot are
    counted by the whole key. Without hot keys the second half of the plan is empty
    and does not run.
    """
    keys = list(keys)
    first = list(coarse or keys)
    counts = rows.groupBy(*first).agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > hot_rows).select(*first))
    cold = rows.join(hot, first, "left_anti").join(table, keys, "left")
    warm = rows.join(hot, first, "left_semi")
    if coarse is not None:
        return cold.unionByName(attach(warm, table, keys, None, hot_rows))
    return cold.unionByName(warm.join(F.broadcast(table.join(hot, keys, "left_semi")), keys, "left"))
