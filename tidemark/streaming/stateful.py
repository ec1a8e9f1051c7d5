"""Streams with keyed state: cooldowns and the failure-rate breaker.

State lives in the checkpoint and survives a restart. What is held per key is
small by definition: one instant for a cooldown, the outcomes of one window, by
bucket of time, for a breaker. Cooldowns of many listings share a group, as a call
costs more than a listing. A key's rows of one micro-batch are processed in time
order, so the trigger bounds what a task holds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import BreakerSettings, Rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Into how many groups a stream's listings and rules are dealt by hash; a checkpoint belongs to one number.
BUCKETS = 4096

_INSTANT = T.StructType().add("at_ms", T.LongType())
_BUCKET = T.StructType().add("bucket", T.LongType())
_LASTS = (
    T.StructType().add("source_id", T.ArrayType(T.StringType())).add("listing_id", T.ArrayType(T.StringType()))
    .add("rule_id", T.ArrayType(T.StringType())).add("at_ms", T.ArrayType(T.LongType())).add("buckets", T.LongType())
)
_OUTCOMES = T.StructType().add("at_ms", T.BinaryType()).add("failed", T.BinaryType())
_SUMS = (
    T.StructType().add("newest_ms", T.LongType()).add("oldest", T.LongType()).add("n", T.LongType()).add("bad", T.LongType())
    .add("until_ms", T.LongType())
)

KEPT = (
    T.StructType().add("source_id", T.StringType()).add("listing_id", T.StringType()).add("rule_id", T.StringType())
    .add("at_ms", T.LongType()).add("obs_id", T.StringType()).add("amount_minor_units", T.LongType())
)
# Numbers as text: beside a null, pandas would make floats of all that come with it.
_TOLD = T.StructType([T.StructField(name, T.StringType()) for name in KEPT.names])
PAUSES = (
    T.StructType().add("source_id", T.StringType()).add("tripped_ms", T.LongType()).add("paused_until_ms", T.LongType())
    .add("failures", T.LongType()).add("outcomes", T.LongType())
)


def _in_order(rows: Iterator[pd.DataFrame], by: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by))


def _cooldown(cooldown_ms: dict[str, int]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Lets a firing through when the last one let through is at least a cooldown back.

    The state travels with the rows, many keys to a batch, where a state server would be asked for every key.
    """

    def judge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        firings = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        # Most keys have a handful of rows, for which sorting a frame takes longer than all the rest.
        columns = [firings[name].tolist() for name in ("at_ms", "amount_minor_units", "obs_id", "rule_id")]
        turns = sorted(zip(*columns, range(len(firings)), strict=True), key=lambda row: [(pd.isna(cell), cell) for cell in row[:3]])
        last = state.get[0] if state.exists else None
        kept = []
        for at, _, _, rule, place in turns:
            if last is None or at >= last + cooldown_ms[rule]:
                kept.append(place)
                last = at
        if kept:
            state.update((int(last),))
            yield firings if kept == list(range(len(firings))) else firings.iloc[kept]

    return judge


def _cooldowns(
    cooldown_ms: dict[str, int], buckets: int
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The same for one of `buckets`: its listings and rules in one call, whose state holds the last instant of each."""

    def judge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firings = pd.concat(list(rows), ignore_index=True)
        sources, listings, rules, instants, ids, amounts = (
            [None if gone else cell for cell, gone in zip(firings[name].tolist(), firings[name].isna().tolist(), strict=True)] for name in _TOLD.names
        )
        ats, amounts = ([None if cell is None else int(cell) for cell in cells] for cells in (instants, amounts))
        turns = [
            (at is None, at or 0, amount is None, amount or 0, obs is None, obs or "", place)
            for place, (at, amount, obs) in enumerate(zip(ats, amounts, ids, strict=True))
        ]
        keys = list(zip(sources, listings, rules, strict=True))
        lasts: dict[tuple, int] = {}
        if state.exists:
            *held, at_ms, dealt = state.get
            if dealt != buckets:
                raise ValueError(f"the checkpoint has {dealt} buckets, not {buckets}")
            lasts = dict(zip(zip(*held, strict=True), at_ms, strict=True))
        kept = []
        for *_, place in sorted(turns):
            at, own = ats[place], keys[place]
            last = lasts.get(own)
            if at is None and last is None:
                raise ValueError(f"a firing without an instant: {own}")
            if last is None or (at is not None and at >= last + cooldown_ms[own[2]]):
                kept.append(place)
                lasts[own] = at
        if kept:
            state.update((*map(list, zip(*lasts, strict=True)), list(lasts.values()), buckets))
            yield firings.iloc[kept][_TOLD.names]

    return judge


class BreakerState(StatefulProcessor):
    """Pauses a source when enough outcomes of its window failed; the pause drops what falls into it.

    Time is cut into buckets of a 64th of the window. State is a map from bucket to the outcomes in it, and the sums over
    the whole window; an arriving outcome touches its own bucket and those that leave the window, whatever the window
    holds. An outcome that comes late counts if the window of the newest one still reaches back to it, and is judged at
    the newest instant; one that is older, or lies in a pause, is dropped. A silent source keeps at most its last window:
    with a timer in processing time a run over what is available would never end.
    """

    def __init__(self, settings: BreakerSettings) -> None:
        self.settings = settings
        self.width = max(1, settings.window_ms // 64)
        share = Fraction(Decimal(str(settings.failure_rate_threshold)))
        self.num, self.den = share.numerator, share.denominator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", _BUCKET, _OUTCOMES)
        self.sums = handle.getValueState("sums", _SUMS)

    def _load(self, bucket: int, held: dict[int, list[list[int]]]) -> list[list[int]]:
        """The instants and failures of a bucket, in order."""
        if bucket not in held:
            cells = self.buckets.getValue((bucket,)) if self.buckets.containsKey((bucket,)) else None
            held[bucket] = [list(np.frombuffer(c, np.int64)) for c in cells] if cells else [[], []]
        return held[bucket]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        outcomes = _in_order(rows, ("at_ms", "request_id"))
        newest, oldest, n, bad, until = self.sums.get() if self.sums.exists() else (None, 0, 0, 0, None)
        held: dict[int, list[list[int]]] = {}
        trips = []
        for at, failed in zip(outcomes["at_ms"].tolist(), outcomes["failed"].tolist(), strict=True):
            if until is not None and at < until:
                continue
            newest = at if newest is None or n == 0 else max(newest, at)
            start = newest - self.settings.window_ms
            if at <= start:
                continue
            bucket = at // self.width
            oldest = bucket if n == 0 else min(oldest, bucket)
            instants, failures = self._load(bucket, held)
            place = bisect_right(instants, at)
            instants.insert(place, at), failures.insert(place, int(failed))
            n, bad = n + 1, bad + int(failed)
            while oldest <= start // self.width:
                instants, failures = self._load(oldest, held)
                gone = bisect_right(instants, start)
                n, bad = n - gone, bad - sum(failures[:gone])
                del instants[:gone], failures[:gone]
                if instants:
                    break
                oldest += 1
            if n >= self.settings.minimum_outcomes and bad * self.den >= self.num * n:
                until = newest + self.settings.pause_ms
                trips.append((key[0], newest, until, bad, n))
                for gone in range(oldest, newest // self.width + 1):
                    held[gone] = [[], []]
                n = bad = 0
        for bucket, cells in held.items():
            if cells[0]:
                self.buckets.updateValue((bucket,), tuple(np.array(c, np.int64).tobytes() for c in cells))
            elif self.buckets.containsKey((bucket,)):
                self.buckets.removeKey((bucket,))
        if newest is not None or until is not None:
            self.sums.update((newest, oldest, n, bad, until))
        if trips:
            yield pd.DataFrame(trips, columns=PAUSES.names)

    def close(self) -> None:
        pass


def stream_cooldowns(firings: DataFrame, rules: Sequence[Rule], buckets: int | None = BUCKETS) -> DataFrame:
    """The firings of a stream that a per-listing, per-rule cooldown lets through.

    A group is called for once a micro-batch, which takes milliseconds, so its state covers the listings of one of
    `buckets`; a batch writes the buckets that its firings fall into. None keeps a state per listing and rule, which a
    checkpoint begun that way needs, and which writes less where batches are small and listings many.
    """
    firings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cooldown_ms, keys = {rule.rule_id: rule.cooldown_ms for rule in rules}, KEPT.names[:3]
    told = {"outputMode": "append", "timeoutConf": GroupStateTimeout.NoTimeout}
    if buckets is None:
        return firings.select(*KEPT.names).groupBy(*keys).applyInPandasWithState(_cooldown(cooldown_ms), KEPT, _INSTANT, **told)
    plain = firings.select(*[F.col(field.name).cast(field.dataType).cast("string").alias(field.name) for field in KEPT])
    dealt = plain.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")
    kept = dealt.applyInPandasWithState(_cooldowns(cooldown_ms, buckets), _TOLD, _LASTS, **told)
    return kept.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in KEPT])


def stream_breaker(outcomes: DataFrame, settings: BreakerSettings) -> DataFrame:
    """Pauses per source, for a stream of `source_id, request_id, at_ms, failed`."""
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return outcomes.select("source_id", "request_id", "at_ms", "failed").groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=BreakerState(settings), outputStructType=PAUSES, outputMode="Append", timeMode="None"
    )
