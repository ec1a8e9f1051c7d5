"""The failure-rate breaker over a whole log, as joins and pointer doubling.

A trip drops the outcomes of its pause, and the window starts empty behind it, so every pause depends on the one before.
What happens behind a pause depends only on the first outcome that is heard again, the entry. So for every entry that
some trip could lead to, the next trip is looked up, all at once:

* as long as the window still reaches back before the entry, outcomes are counted from the entry by prefix sums, and the
  next trip is the first prefix that reaches the entry's own level again (a search in a tree of block maxima);
* later on the window is an ordinary one, and the next trip is the next outcome that trips the unrestricted rate.

Entry to entry is then a table of pointers, and the chain from each source's first outcome is followed by doubling them.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import BreakerSettings
from tidemark.functions.instants import is_failure, millis
from tidemark.operators.trailing import RUN_CHUNK_MS, running, trailing
from tidemark.session import cut_lineage

SOURCE = ["source_id"]
#: Values in one node of the search tree.
FANOUT = 64
#: Places of a log, instead of milliseconds, that make up one chunk of a running aggregate.
PLACES = 65_536


def _one() -> tuple[str, Column]:
    return ("sum", F.lit(1).cast("long"))


def _settings(log: DataFrame, default: BreakerSettings | None, special: Mapping[str, BreakerSettings]) -> DataFrame:
    """The log with its source's settings as columns; a source without any is left out.

    One row a configured source, joined like any other table. A share is the fraction `num / den`.
    """
    rows = []
    for source, s in special.items():
        share = Fraction(Decimal(str(s.failure_rate_threshold)))
        rows.append((source, s.window_ms, s.pause_ms, s.minimum_outcomes, share.numerator, share.denominator))
    known = log.sparkSession.createDataFrame(rows, "source_id string, width long, pause long, least long, num long, den long")
    joined = log.join(known, "source_id", "left")
    if default is None:
        return joined.where("width is not null")
    share = Fraction(Decimal(str(default.failure_rate_threshold)))
    plain = {
        "width": default.window_ms, "pause": default.pause_ms, "least": default.minimum_outcomes,
        "num": share.numerator, "den": share.denominator,
    }
    return joined.withColumns({name: F.coalesce(name, F.lit(value).cast("long")) for name, value in plain.items()})


def _places(log: DataFrame, widths: list[int], chunk_ms: int) -> DataFrame:
    """One row per outcome with its place in its source's log and everything that is counted up to it.

    `bad` failures up to it, `level` the surplus of failures over the share, `first` the first place of its window,
    `seen` and `seen_bad` the outcomes and failures of the unrestricted window.
    """
    measures = {"n": _one(), "bad": ("sum", F.col("failed"))}
    before = running(log, SOURCE, "at_ms", measures, chunk_ms)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    before = before.select("source_id", "at_ms", zero("n").alias("n_before"), zero("bad").alias("bad_before"))
    windows = [
        trailing(log.where(F.col("width") == width), SOURCE, "at_ms", width, measures).select(
            "source_id", "at_ms", zero("n").alias("n_window"), zero("bad").alias("bad_window")
        )
        for width in widths
    ]
    instants = before.join(reduce(DataFrame.unionByName, windows), ["source_id", "at_ms"])
    # Outcomes of one millisecond go by their request.
    same = W.partitionBy("source_id", "at_ms").orderBy("request_id", "failed")
    ranked = log.withColumn("rank", F.row_number().over(same).cast("long"))
    ranked = ranked.withColumn("bad_here", F.sum("failed").over(same.rowsBetween(W.unboundedPreceding, 0)))
    rows = ranked.join(instants, ["source_id", "at_ms"])
    place, bad = F.col("n_before") + F.col("rank"), F.col("bad_before") + F.col("bad_here")
    return rows.select(
        "source_id", "at_ms", "pause", "least", "num", "den", place.alias("place"), bad.alias("bad"), "failed",
        (bad * F.col("den") - place * F.col("num")).alias("level"),
        (F.col("n_before") - F.col("n_window") + 1).alias("first"),
        (F.col("n_window") + F.col("rank")).alias("seen"), (F.col("bad_window") + F.col("bad_here")).alias("seen_bad"),
    )


def _enough(bad: str, of: str) -> Column:
    return F.col(bad) * F.col("den") >= F.col("num") * F.col(of)


def _at_or_after(targets: DataFrame, asks: DataFrame, chunk: int) -> DataFrame:
    """For each (source, x) of `asks` the least `value` of `targets` (source, x, value) at that x or a later one."""
    # Time runs backwards, so what lies at or after x is what lies before it.
    put = targets.select("source_id", (-F.col("x")).alias("back"), "value", F.lit(0).alias("asks"))
    ask = asks.select("source_id", (1 - F.col("x")).alias("back"), F.lit(None).cast("long").alias("value"), F.lit(1).alias("asks"))
    found = running(put.unionByName(ask), SOURCE, "back", {"nxt": ("min", F.col("value")), "asks": ("max", F.col("asks"))}, chunk)
    return found.where("own_asks = 1 and nxt is not null").select("source_id", (1 - F.col("back")).alias("x"), "nxt")


def _tree(rows: DataFrame) -> list[DataFrame]:
    """Nodes (source, node, highest) of every height: the greatest level below each child, in order."""
    most = rows.agg(F.max("place")).first()[0] or 0
    below, nodes = rows.select("source_id", (F.col("place") - 1).alias("at"), F.col("level").alias("top")), []
    while True:
        cells = F.array_sort(F.collect_list(F.struct("at", "top")))
        grouped = below.groupBy("source_id", F.expr(f"at div {FANOUT}").alias("node")).agg(F.transform(cells, lambda c: c["top"]).alias("highest"))
        nodes.append(cut_lineage(grouped))
        most = -(-most // FANOUT)
        if most <= 1:
            return nodes
        below = nodes[-1].select("source_id", F.col("node").alias("at"), F.array_max("highest").alias("top"))


def _first_reaching(nodes: list[DataFrame], asks: DataFrame) -> DataFrame:
    """For each (source, entry, goal, at) the first place not before `at` (from 0) whose level is `goal` or more.

    Up the tree until a node holds one, then down to it; each step is an equi-join of those still searching.
    """
    found: list[DataFrame] = []
    searching = asks.select("source_id", "entry", "goal", "at")
    hit = F.array_position(F.transform(F.slice("highest", F.col("at") % FANOUT + 1, FANOUT), lambda x: x >= F.col("goal")), True)
    for node in nodes:
        step = searching.withColumn("node", F.expr(f"at div {FANOUT}")).join(node, ["source_id", "node"])
        step = cut_lineage(step.select("source_id", "entry", "goal", "at", "node", hit.alias("hit")))
        found.append(step.where("hit > 0").select("source_id", "entry", "goal", (F.col("at") + F.col("hit") - 1).alias("at")))
        searching = step.where("hit = 0").select("source_id", "entry", "goal", (F.col("node") + 1).alias("at"))
    inside = F.array_position(F.transform("highest", lambda x: x >= F.col("goal")), True)
    down = found[-1]
    for height in range(len(nodes) - 2, -1, -1):
        below = down.withColumnRenamed("at", "node").join(nodes[height], ["source_id", "node"])
        below = below.select("source_id", "entry", "goal", (F.col("node") * FANOUT + inside - 1).alias("at"))
        down = below.unionByName(found[height])
    return down.select("source_id", "entry", (F.col("at") + 1).alias("reached"))


def _chain(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """All entries (source, entry) that are reached from the starts; two doublings a round."""
    marked, front = starts, hops
    while True:
        ahead = lambda far: marked.join(far, SOURCE + ["entry"]).select("source_id", F.col("nxt").alias("entry"))
        then = front.select("source_id", F.col("entry").alias("nxt"), F.col("nxt").alias("nxt2"))
        twice = cut_lineage(front.join(then, ["source_id", "nxt"]).select("source_id", "entry", F.col("nxt2").alias("nxt")))
        # `marked` holds the first c entries of each chain; one hop of `front` is c entries far, one of `twice` 2c.
        two = marked.unionByName(ahead(front))
        marked = cut_lineage(two.unionByName(two.join(twice, SOURCE + ["entry"]).select("source_id", F.col("nxt").alias("entry"))))
        if twice.isEmpty():
            return marked
        then = twice.select("source_id", F.col("entry").alias("nxt"), F.col("nxt").alias("nxt2"))
        front = cut_lineage(twice.join(then, ["source_id", "nxt"]).select("source_id", "entry", F.col("nxt2").alias("nxt")))
        if front.isEmpty():
            return marked


def breaker_replay(
    outcomes: DataFrame,
    settings: BreakerSettings | None,
    slice_ms: int | None = None,
    failure: Column | None = None,
    special: Mapping[str, BreakerSettings] | None = None,
) -> DataFrame:
    """The pauses a failure-rate breaker would have imposed, over a whole log.

    `settings` hold for every source that `special` doesn't name; without them only the named sources are judged.
    Outcomes of one millisecond are heard in the order of their request. A trip needs enough outcomes in the window and
    failures at or above the share, compared exactly. The number of rounds grows with the logarithm of the number of
    pauses; no group of rows is folded, and a source may hold any share of the log. Prefix counts are made in slices of
    time, whose width changes no result.
    """
    failed = is_failure(F.col("status")) if failure is None else failure
    log = outcomes.select("source_id", "request_id", millis(F.col("at")).alias("at_ms"), failed.cast("long").alias("failed"))
    special = dict(special or {})
    log = _settings(log, settings, special)
    widths = sorted({s.window_ms for s in [*special.values(), *([settings] if settings else [])]})
    slice_ms = slice_ms or RUN_CHUNK_MS
    rows = cut_lineage(_places(log, widths, slice_ms))

    # Only an outcome with enough outcomes and failures in its whole window can trip, wherever counting started.
    possible = rows.where((F.col("seen") >= F.col("least")) & _enough("seen_bad", "least"))
    instants = rows.groupBy("source_id", "at_ms").agg(F.min("place").alias("value"))
    resumed = possible.select("source_id", (F.col("at_ms") + F.col("pause")).alias("x")).distinct()
    entries = _at_or_after(instants.withColumnRenamed("at_ms", "x"), resumed, slice_ms)
    heard = possible.withColumn("x", F.col("at_ms") + F.col("pause")).join(entries, ["source_id", "x"])
    # Without a pause counting starts anew right behind the trip.
    entry_of = cut_lineage(heard.select("source_id", "place", F.greatest("nxt", F.col("place") + 1).alias("entry")))

    starts = rows.where("place = 1").select("source_id", F.lit(1).cast("long").alias("entry"))
    asked = entry_of.select("source_id", "entry").unionByName(starts).distinct()
    at_entry = asked.join(rows.withColumnRenamed("place", "entry"), ["source_id", "entry"])
    step = F.col("failed") * F.col("den") - F.col("num")
    asks = cut_lineage(at_entry.select(
        "source_id", "entry", (F.col("level") - step).alias("goal"), (F.col("entry") + F.col("least") - 2).alias("at"),
        (F.col("bad") - F.col("failed")).alias("bad_until"),
    ))
    near = _first_reaching(_tree(rows), asks).join(rows.withColumnRenamed("place", "reached"), ["source_id", "reached"])
    near = near.where(F.col("first") <= F.col("entry")).select("source_id", "entry", "reached")
    tripping = rows.where((F.col("seen") >= F.col("least")) & _enough("seen_bad", "seen"))
    far = _at_or_after(
        tripping.select("source_id", F.col("first").alias("x"), F.col("place").alias("value")), asks.select("source_id", F.col("entry").alias("x")), PLACES
    ).select("source_id", F.col("x").alias("entry"), F.col("nxt").alias("later"))
    trips = asks.join(near, ["source_id", "entry"], "left").join(far, ["source_id", "entry"], "left")
    # As long as the window reaches back before the entry, every place is earlier than where it no longer does.
    trips = trips.withColumn("place", F.coalesce("reached", "later")).where("place is not null")
    trips = cut_lineage(trips.select("source_id", "entry", "bad_until", "place"))

    hops = cut_lineage(
        trips.join(entry_of.withColumnRenamed("entry", "nxt"), ["source_id", "place"]).select("source_id", "entry", "nxt")
    )
    on_chain = trips.join(_chain(hops, cut_lineage(starts)).distinct(), ["source_id", "entry"], "left_semi")
    told = on_chain.join(rows, ["source_id", "place"])
    whole = F.col("first") >= F.col("entry")
    return told.select(
        "source_id", F.col("at_ms").alias("tripped_ms"), (F.col("at_ms") + F.col("pause")).alias("paused_until_ms"),
        F.when(whole, F.col("seen_bad")).otherwise(F.col("bad") - F.col("bad_until")).alias("failures"),
        F.when(whole, F.col("seen")).otherwise(F.col("place") - F.col("entry") + 1).alias("outcomes"),
    )
