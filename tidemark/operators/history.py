"""The observation table: guard, ingest, retention and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import HOUR_MS, Registry
from tidemark.functions.instants import millis
from tidemark.functions.text import RAW_CONTEXT_STORED, bound_text, is_blank
from tidemark.session import cut_lineage

CURRENCY_SHAPE = r"\A[A-Z]{3}\z"


def observation_fault() -> Column:
    """The first rule an observation row breaks; null for a valid row."""
    return (
        F.when(is_blank(F.col("source_id")), F.lit("blank-source"))
        .when(is_blank(F.col("listing_id")), F.lit("blank-listing"))
        .when(is_blank(F.col("source_time_zone")), F.lit("blank-time-zone"))
        .when(F.col("amount_minor_units").isNull(), F.lit("no-amount"))
        .when(F.col("amount_minor_units") < 0, F.lit("negative-amount"))
        .when(F.col("store_id").isNotNull(), F.lit("store-id-reserved"))
        .when(F.col("observed_at").isNull(), F.lit("no-instant"))
        .when(F.col("raw_context_retention_hours") < 0, F.lit("negative-retention"))
        .when(~F.coalesce(F.col("currency").rlike(CURRENCY_SHAPE), F.lit(False)), F.lit("bad-currency"))
    )


def ingest(outcomes: DataFrame, registry: Registry) -> DataFrame:
    """Outcomes with their observation row and, where there is none, the reason.

    The source's zone and retention are stamped on from the registry, texts are
    bounded, and `refusal` names why a row must not be appended. Nothing is
    dropped: `accepted` and `refused` split the result.
    """
    known = registry.frame(outcomes.sparkSession).select(
        "source_id", F.col("time_zone").alias("source_time_zone"),
        F.col("retention_hours").alias("raw_context_retention_hours"), F.lit(True).alias("_known"),
    )
    if "store_id" not in outcomes.columns:
        outcomes = outcomes.withColumn("store_id", F.lit(None).cast("string"))
    # An outcome without an id of its own gets one from what it says, so a repeated run gives the same.
    told = ("source_id", "listing_id", "amount_minor_units", "currency", "kind", "raw_context")
    own_id = F.md5(F.to_json(F.struct(*told, millis(F.col("received_at")).alias("at"))))
    if "obs_id" in outcomes.columns:
        own_id = F.coalesce(F.col("obs_id").cast("string"), own_id)
    outcomes = outcomes.withColumn("obs_id", own_id)
    rows = outcomes.join(known, "source_id", "left").withColumn("observed_at", F.col("received_at"))
    refusal = (
        F.when(F.col("_known").isNull(), F.lit("unknown-source"))
        .when(F.col("kind") != "observed", F.coalesce(F.col("reason"), F.col("kind")))
        .otherwise(observation_fault())
    )
    return rows.select(
        "obs_id", "source_id", "listing_id", "store_id", "amount_minor_units", "currency", "observed_at", "source_time_zone",
        F.timestamp_millis("vendor_updated_ms").alias("vendor_price_updated_at"), "raw_context_retention_hours",
        bound_text(F.col("raw_context"), RAW_CONTEXT_STORED).alias("raw_context"),
        F.nullif(F.col("availability"), F.lit("")).alias("availability"),
        "kind", refusal.alias("refusal"),
    )


def accepted(ingested: DataFrame) -> DataFrame:
    """The rows to append."""
    return ingested.where("refusal is null").drop("kind", "refusal")


def refused(ingested: DataFrame) -> DataFrame:
    """The rows to set aside, with their reason."""
    return ingested.where("refusal is not null")


def ingest_report(ingested: DataFrame) -> DataFrame:
    """Per source, outcome kind and reason: how many."""
    return ingested.groupBy("source_id", "kind", "refusal").agg(F.count("*").alias("n"))


def retention_expired(as_of_ms: int) -> Column:
    """Raw content that is still held past the row's own hours."""
    until = millis(F.col("observed_at")) + F.col("raw_context_retention_hours").cast("long") * HOUR_MS
    return (
        F.col("raw_context_retention_hours").isNotNull() & F.col("raw_context").isNotNull() & (until < as_of_ms)
    )


def sweep_retention(observations: DataFrame, as_of_ms: int) -> DataFrame:
    """Every row, with expired raw content removed. Sweeping twice changes nothing."""
    return observations.withColumn(
        "raw_context", F.when(~retention_expired(as_of_ms), F.col("raw_context"))
    )


def swept(observations: DataFrame, as_of_ms: int) -> DataFrame:
    """How many rows of each listing a sweep clears."""
    return (
        observations.where(retention_expired(as_of_ms))
        .groupBy("source_id", "listing_id")
        .agg(F.count("*").alias("deleted"))
    )


def retention_audit(observations: DataFrame, registry: Registry) -> DataFrame:
    """Rows of a source with a retention ceiling whose stamped hours are absent, below 1 or above it."""
    capped = registry.frame(observations.sparkSession).where("ceiling_hours is not null").select("source_id", "ceiling_hours")
    hours = F.col("raw_context_retention_hours")
    return observations.join(capped, "source_id").where(
        hours.isNull() | (hours < 1) | (hours > F.col("ceiling_hours"))
    )


def snapshot(observations: DataFrame) -> DataFrame:
    """Every column as text, raw content as a digest, to compare two histories by."""
    return observations.select(
        *[
            (F.md5("raw_context") if name == "raw_context" else F.col(name).cast("string")).alias(name)
            for name in observations.columns
        ]
    )


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that one history lacks or holds as another type; one row each, empty when the schemas agree."""
    types = [{f.name: f.dataType.simpleString() for f in side.schema.fields} for side in (left, right)]
    names = sorted(set(types[0]) | set(types[1]))
    rows = [(n, types[0].get(n), types[1].get(n)) for n in names if types[0].get(n) != types[1].get(n)]
    return left.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string")


def _day_of(history: DataFrame) -> list[Column]:
    """What a history is compared by first: source and UTC day, as far as it has them."""
    known = {"source_id": F.col("source_id"), "observed_at": F.floor(millis(F.col("observed_at")) / (24 * HOUR_MS))}
    return [known[name].alias(f"_part{i}") for i, name in enumerate(known) if name in history.columns]


#: A longer text is compared by its digest of as many bytes.
DIGEST_BYTES = 16
#: Rows that one task compares, so that they fit into its memory without spilling.
ROWS_PER_TASK = 500_000
#: Types whose text is told by the value and tells the value.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp_ntz")


def _types(side: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in side.schema.fields}


def _narrow(side: DataFrame, names: list[str], types: tuple[dict[str, str], dict[str, str]], parts: list[Column]) -> DataFrame:
    """What tells the snapshots of rows apart, in few bytes: values that stand for their text, digests only where shorter."""
    # An hour that clocks repeat has one text for two instants.
    plain = (*_PLAIN, "timestamp") if side.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC" else _PLAIN

    def cell(name: str) -> Column:
        known = sorted({of[name] for of in types if name in of})
        value = F.col(name) if name in side.columns else F.lit(None)
        if name == "raw_context" and set(known) <= {"string", "binary"}:
            raw = value.cast("binary")
            return F.when(F.octet_length(raw) < DIGEST_BYTES, raw).otherwise(F.unhex(F.md5(raw))).alias(name)
        if name == "raw_context":
            return F.unhex(F.md5(value)).alias(name)
        return value.cast(known[0] if len(known) == 1 and known[0] in plain else "string").alias(name)

    return side.select(*[cell(n) for n in names], *parts)


def _shown(name: str) -> Column:
    """A narrow value as `snapshot` shows it."""
    value = F.col(name)
    if name != "raw_context":
        return value.cast("string").alias(name)
    return F.when(F.octet_length(value) < DIGEST_BYTES, F.md5(value)).otherwise(F.lower(F.hex(value))).alias(name)


def history_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one history holds more often than the other; empty when they agree.

    A column that only one side has counts as null on the other; `schema_diff` names it. Days of a source are compared
    by digest first: the number of rows and two sums of independent 64-bit hashes, combined before they move. Only rows
    of days whose digests differ are shuffled, as values and not as text, into as many tasks as their number needs, and
    one count per distinct row settles both directions.
    """
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    types = _types(left), _types(right)
    # A day can only be read off where both sides have it.
    parted = [c for c in ("source_id", "observed_at") if c in left.columns and c in right.columns]
    sides = [_narrow(side, names, types, _day_of(side.select(*parted)) if parted else []) for side in (left, right)]
    parts = [c for c in sides[0].columns if c.startswith("_part")]
    both = sides[0].withColumn("_n", F.lit(1)).unionByName(sides[1].withColumn("_n", F.lit(-1)))
    # A hash passes over nulls, so it gets their places too.
    row = [*[F.col(n).isNull() for n in names], *names]
    hashed = lambda seed: F.sum(F.col("_n") * F.xxhash64(F.lit(seed), *row).cast("decimal(20,0)"))
    digests = both.groupBy(*parts).agg(F.count("*").alias("held"), F.sum("_n").alias("rows"), hashed(1).alias("first"), hashed(2).alias("second"))
    differ = cut_lineage(
        digests.where("rows <> 0 or first <> 0 or second <> 0").select(*[F.col(c).alias(f"{c}d") for c in parts], "held")
    )
    held = differ.agg(F.sum("held")).first()[0] or 0
    if parts:
        same = [F.col(c).eqNullSafe(F.col(f"{c}d")) for c in parts]
        both = both.join(differ, same, "left_semi")
    elif not held:
        both = both.where(F.lit(False))
    # Most rows are distinct, so combining them before the shuffle would only fill the memory of the tasks that read.
    dealt = both.select(*names, "_n").repartition(-(-held // ROWS_PER_TASK) or 1, *names)
    surplus = dealt.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return surplus.select(
        *[_shown(n) for n in names],
        F.when(F.col("_n") > 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_copy"),
    ).drop("_copy")
