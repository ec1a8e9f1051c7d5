"""Trailing and running aggregates per key that no single hot key can overload.

A plain range frame puts every row of a key into one task and re-aggregates the
frame for each row. Here time is cut into chunks, and each value is put together
from three parts that are all computed on bounded groups:

* the points before the instant inside its own chunk,
* the whole chunks in between, pre-aggregated to one row per (key, chunk),
* the points after the lower end of the window inside the chunk it falls into.

Rows are first merged to one point per (key, instant) with a map-side combine,
so a chunk group holds at most one row per millisecond of its width, whatever
the number of rows, and every frame is a running one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# At most this many chunks make up one window. More chunks mean smaller groups for
# hot keys and longer frames over whole chunks.
CHUNKS_PER_WINDOW = 64
# No chunk need be shorter than this: a group holds at most its milliseconds, and
# a key has at most one carried row per chunk of its whole span.
RUN_CHUNK_MS = 3_600_000

# What a row of a chunk does: hold values, read what lies before it, read what lies
# after it, or carry the aggregate of earlier chunks.
POINT, UPPER, LOWER, CARRY = range(4)

Measure = tuple[str, Column]
_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def _chunks(width: int, shortest: int, most: int) -> int:
    """Into how many equal chunks a window is cut; a short window is one chunk."""
    return max(n for n in range(1, most + 1) if n == 1 or (width % n == 0 and width // n >= shortest))


def _chunk_of(at: str, chunk_ms: int) -> Column:
    """Which chunk of the epoch an instant falls into, also before 1970."""
    return F.expr(f"(`{at}` - pmod(`{at}`, {chunk_ms}L)) div {chunk_ms}L")


def _combine(measures: Mapping[str, Measure]) -> list[Column]:
    return [_COMBINE[kind](name).alias(name) for name, (kind, _) in measures.items()]


def _over(measures: Mapping[str, Measure], window: W, prefix: str = "") -> list[Column]:
    return [_COMBINE[kind](name).over(window).alias(prefix + name) for name, (kind, _) in measures.items()]


def _points(df: DataFrame, keys: Sequence[str], at: str, chunk_ms: int, measures: Mapping[str, Measure]) -> DataFrame:
    """One row per (key, instant), merged before the shuffle."""
    raw = df.select(
        *keys,
        _chunk_of(at, chunk_ms).alias("_chunk"),
        F.col(at).alias("_at"),
        *[value.alias(name) for name, (_, value) in measures.items()],
    )
    return raw.groupBy(*keys, "_chunk", "_at").agg(*_combine(measures))


def _carried(points: DataFrame, keys: Sequence[str], first: int | None, measures: Mapping[str, Measure]) -> DataFrame:
    """Per (key, chunk): the aggregate of the chunks before it, from `first` chunks back on."""
    chunks = points.groupBy(*keys, "_chunk").agg(*_combine(measures))
    ordered = W.partitionBy(*keys).orderBy("_chunk")
    frame = ordered.rowsBetween(W.unboundedPreceding, -1) if first is None else ordered.rangeBetween(-first, -1)
    carried = chunks.select(*keys, "_chunk", *_over(measures, frame))
    return carried.where(reduce(or_, [F.col(name).isNotNull() for name in measures]))


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    width_ms: int,
    measures: Mapping[str, Measure],
    probes: DataFrame | None = None,
    shortest_chunk_ms: int = RUN_CHUNK_MS,
    most_chunks: int = CHUNKS_PER_WINDOW,
) -> DataFrame:
    """Aggregates over `at - width < t < at`, open at both ends, per (key, instant).

    `measures` maps a name to ("sum" | "min" | "max", expression over `df`). One
    row comes back for every distinct (key, instant) of `probes`, which defaults
    to the instants of `df` itself; a measure of an empty window is null. With the
    default probes, `own_<name>` holds the aggregate at the instant itself.
    """
    parts = _chunks(width_ms, shortest_chunk_ms, most_chunks)
    chunk_ms = width_ms // parts
    names = list(measures)
    points = _points(df, keys, at, chunk_ms, measures)
    values = [F.col(name) for name in names]
    types = {f.name: f.dataType for f in points.schema.fields}
    blanks = [F.lit(None).cast(types[name]).alias(name) for name in names]

    def row(chunk: Column, pos: Column, role: int, cells: Sequence[Column]) -> Column:
        return F.struct(chunk.alias("_chunk"), pos.alias("_pos"), F.lit(role).alias("_role"), *cells)

    low = row(F.col("_chunk") - parts, F.col("_at") - width_ms, LOWER, blanks)
    if probes is None:
        # A point reads what lies before it, so it is its own upper probe.
        tagged = points.select(*keys, F.explode(F.array(row(F.col("_chunk"), F.col("_at"), UPPER, values), low)).alias("_r"))
        tagged = tagged.select(*keys, "_r.*")
        carriers = points
    else:
        asked = probes.select(
            *keys, _chunk_of(at, chunk_ms).alias("_chunk"), F.col(at).alias("_at")
        ).distinct()
        ends = asked.select(*keys, F.explode(F.array(row(F.col("_chunk"), F.col("_at"), UPPER, blanks), low)).alias("_r"))
        plain = points.select(*keys, "_chunk", F.col("_at").alias("_pos"), F.lit(POINT).alias("_role"), *names)
        tagged = plain.unionByName(ends.select(*keys, "_r.*"))
        carriers = points.unionByName(asked.select(*keys, "_chunk", "_at", *blanks))
    if parts > 1:
        carried = _carried(carriers, keys, parts - 1, measures)
        tagged = tagged.unionByName(
            carried.select(*keys, "_chunk", (F.col("_chunk") * chunk_ms - 1).alias("_pos"), F.lit(CARRY).alias("_role"), *names)
        )

    group = W.partitionBy(*keys, "_chunk")
    # A probe goes before a point of the same instant in either direction, so
    # neither end of the window is included.
    holds = (F.col("_role") == POINT) if probes is not None else F.col("_role").isin(POINT, UPPER)
    turn = F.when(holds, 1).otherwise(0)
    before = group.orderBy(F.col("_pos") * 2 + turn).rowsBetween(W.unboundedPreceding, -1)
    after = group.orderBy(F.col("_pos") * -2 + turn).rowsBetween(W.unboundedPreceding, -1)
    read = tagged.select(
        *keys, "_pos", "_role", *names,
        *_over(measures, before, "_before_"), *_over(measures, after, "_after_"),
    ).where(F.col("_role").isin(UPPER, LOWER))
    is_upper = F.col("_role") == UPPER
    rekeyed = read.select(
        *keys,
        F.when(is_upper, F.col("_pos")).otherwise(F.col("_pos") + width_ms).alias(at),
        *[F.when(is_upper, F.col(f"_before_{n}")).otherwise(F.col(f"_after_{n}")).alias(n) for n in names],
        *([F.col(n).alias(f"own_{n}") for n in names] if probes is None else []),
    )
    own = {f"own_{n}": (kind, value) for n, (kind, value) in measures.items()} if probes is None else {}
    return rekeyed.groupBy(*keys, at).agg(*_combine(measures), *_combine(own))


def running(
    df: DataFrame, keys: Sequence[str], at: str, measures: Mapping[str, Measure], chunk_ms: int = RUN_CHUNK_MS
) -> DataFrame:
    """Aggregates over everything strictly before each distinct (key, instant).

    `own_<name>` holds the aggregate at the instant itself.
    """
    names = list(measures)
    points = _points(df, keys, at, chunk_ms, measures)
    carried = _carried(points, keys, None, measures)
    tagged = points.select(*keys, "_chunk", "_at", F.lit(True).alias("_real"), *names).unionByName(
        carried.select(*keys, "_chunk", (F.col("_chunk") * chunk_ms - 1).alias("_at"), F.lit(False).alias("_real"), *names)
    )
    before = W.partitionBy(*keys, "_chunk").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    own = [F.col(n).alias(f"own_{n}") for n in names]
    return (
        tagged.select(*keys, F.col("_at").alias(at), "_real", *own, *_over(measures, before))
        .where("_real")
        .drop("_real")
    )
