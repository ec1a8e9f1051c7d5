"""What became of the alerts of a run, and the cooldowns that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import attach

KEY = ["source_id", "listing_id", "rule_id"]
# Statuses that refuse the credential rather than the notification.
CREDENTIAL_REFUSALS = (401, 403)


def delivery_class(status: Column) -> Column:
    """2xx is delivered, a credential refusal is refused, anything else failed."""
    return (
        F.when(status.isin(*CREDENTIAL_REFUSALS), F.lit("refused"))
        .when(status.between(200, 299), F.lit("delivered"))
        .otherwise(F.lit("failed"))
    )


def reconcile_deliveries(outbox: DataFrame, run: str = "run_id", order: Sequence[str] = ("position",)) -> DataFrame:
    """`outbox` rows with their response `status`, and what each of them came to.

    After the first credential refusal of a run nothing more is attempted. That
    place is one aggregate per run, so a run of any size stays spread out.
    """
    place = F.struct(*order)
    stopped = F.col("status").isin(*CREDENTIAL_REFUSALS)
    first = outbox.groupBy(run).agg(F.min(F.when(stopped, place)).alias("_stop"))
    rows = attach(outbox, first, [run])
    outcome = F.when(place > F.col("_stop"), F.lit("not-attempted")).otherwise(delivery_class(F.coalesce(F.col("status"), F.lit(0))))
    return rows.withColumn("outcome", outcome).drop("_stop")


def update_cooldowns(cooldowns: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Cooldowns after a run: the last firing of a key wins, and only a delivered alert is one."""
    fields = [*KEY, "fired_at", "amount_minor_units", "currency"]
    delivered = reconciled.where("outcome = 'delivered'").select(*fields)
    cells = F.struct("fired_at", "amount_minor_units", "currency")
    return (
        cooldowns.select(*fields)
        .unionByName(delivered)
        .groupBy(*KEY)
        .agg(F.max(cells).alias("c"))
        .select(*KEY, "c.*")
    )


def run_report(statuses: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Per source: how many alerts ended in each status, what became of the deliverable ones included."""
    quiet = statuses.where("status <> 'deliverable'").select("source_id", "status")
    sent = reconciled.select("source_id", F.col("outcome").alias("status"))
    return quiet.unionByName(sent).groupBy("source_id", "status").agg(F.count("*").alias("n"))
