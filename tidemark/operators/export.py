"""Attributed exports: refused whole when one item lacks its notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Registry
from tidemark.functions.money import shown, with_code
from tidemark.functions.text import is_blank, iso_millis


class UnattributedExport(ValueError):
    """An export held an item whose required attribution is absent or names nobody."""


def attributed(observations: DataFrame, registry: Registry) -> DataFrame:
    """Observations with the notice their source's terms require, if they require one."""
    terms = registry.frame(observations.sparkSession).select("source_id", "attribution_required", "attribute_to", "notice")
    rows = observations.join(terms, "source_id", "left")
    noted = rows.withColumn("attribution", F.when(F.col("attribution_required"), F.col("notice"))).drop("notice")
    return with_code(noted, F.col("currency"))


def attribution_violation() -> Column:
    """Why an attributed row must not be emitted; null where it may be."""
    missing = is_blank(F.col("attribution"))
    unnamed = ~F.contains(F.col("attribution"), F.col("attribute_to"))
    return (
        F.when(F.col("attribution_required").isNull(), F.lit("unknown-source"))
        .when(F.col("attribution_required") & missing, F.lit("no-attribution"))
        .when(F.col("attribution_required") & unnamed, F.lit("party-not-named"))
    )


def violations(items: DataFrame) -> DataFrame:
    """Items that refuse the whole export."""
    return items.withColumn("violation", attribution_violation()).where("violation is not null")


def listing_line() -> Column:
    """One observation of an `attributed` table as a line of text."""
    # The wording of a line.
    updated = F.coalesce(
        F.concat(F.lit("vendor price updated "), iso_millis(F.col("vendor_price_updated_at"))),
        F.lit("vendor price-update instant not published"),
    )
    return F.concat(
        iso_millis(F.col("observed_at")), F.lit("  "), F.col("listing_id"), F.lit("  "),
        shown("amount_minor_units"), F.lit("  ("), updated, F.lit(")"),
    )


def listing_summary() -> Column:
    """The one-line display, with the notice where one is owed."""
    notice = F.when(F.col("attribution_required"), F.concat(F.lit(" - "), F.col("attribution")))
    return F.concat(listing_line(), F.coalesce(notice, F.lit("")))


def export_lines(items: DataFrame, title: str = "observations") -> DataFrame:
    """The document as lines (`source_id, part, place, line`), to be sorted by the first three.

    A document of any size stays a distributed table: headings are aggregated per
    source, and no source is gathered into one string.
    """
    place = F.concat_ws(" ", iso_millis(F.col("observed_at")), "listing_id", "obs_id")
    body = items.select("source_id", F.lit(2).alias("part"), place.alias("place"), listing_line().alias("line"))
    heads = items.groupBy("source_id").agg(F.max("attribution").alias("notice"))
    opening = F.array_compact(F.array(F.concat(F.lit("## "), "source_id"), F.col("notice"), F.lit("")))
    heads = heads.select("source_id", F.posexplode(opening).alias("n", "line")).select(
        "source_id", F.lit(1).alias("part"), F.lpad(F.col("n").cast("string"), 2, "0").alias("place"), "line"
    )
    ends = items.select("source_id").distinct().select(
        "source_id", F.lit(3).alias("part"), F.lit("").alias("place"), F.lit("").alias("line")
    )
    start = items.sparkSession.createDataFrame(
        [("", 1, "0", f"# {title}"), ("", 1, "1", "")], "source_id string, part int, place string, line string"
    )
    return start.unionByName(heads).unionByName(body).unionByName(ends)


def write_export(items: DataFrame, path: str, title: str = "observations") -> None:
    """Write the document as ordered text parts; nothing at all if one item is unattributed."""
    first = violations(items).select("source_id", "listing_id", "violation").head(1)
    if first:
        raise UnattributedExport(f"{first[0].violation}: {first[0].source_id}/{first[0].listing_id}")
    export_lines(items, title).sort("source_id", "part", "place").select("line").write.text(path)
