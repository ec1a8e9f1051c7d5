"""Vendor JSON responses to observation drafts, or the outcome that stands for none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Registry
from tidemark.functions.instants import vendor_timestamp_ms
from tidemark.functions.json_values import as_array, as_object, field, is_kind, number_text, trim_sql, unwrapped, wrapped
from tidemark.functions.money import exact, with_code
from tidemark.functions.text import RAW_CONTEXT_ADAPTER, bound_text, redact_credentials, summarise, trim_all

# The attributes that are read, and the shape of a listing id.
ATTRIBUTES = ("sku", "name", "salePrice", "regularPrice", "onSale", "priceUpdateDate")
SKU = r"\A[0-9]{1,12}\z"


NODE = "CASE WHEN _products IS NULL THEN _object ELSE try_element_at(_products, 1) END"


def _text_of(name: str) -> str:
    """The text of a price or key field: numbers in plain form, strings as they are."""
    number, text = number_text(f"try_cast({name} AS double)"), f"try_cast({name} AS string)"
    return f"CASE WHEN {is_kind(name, 'number')} THEN {number} WHEN {is_kind(name, 'string')} THEN {text} END"


def _price_fault(readable: str, amount: str) -> Column:
    """Why a price field gives no amount; null where it gives one."""
    return F.when(
        F.col(amount).isNull(),
        F.when(F.col(readable).isNotNull() & F.col("_places").isNull(), F.lit("no-currency")).otherwise(F.lit("no-price")),
    )


def map_payloads(payloads: DataFrame) -> DataFrame:
    """Columns `body, listing_id, currency, time_zone` to one resolved price or a typed reason.

    Both document shapes are read: a product, or `{"products": [one product]}`.
    """
    kept = [name for name in payloads.columns if name not in ("body", "currency", "time_zone")]
    # Only the requested attributes leave the document.
    read = (
        payloads.selectExpr("*", f"CASE WHEN startswith({trim_sql('body')}, '{{') THEN {wrapped('body')} END AS _document")
        .selectExpr("*", f"{unwrapped('_document')} AS _object")
        .selectExpr("*", f"filter({as_array(field('_object', 'products'))}, n -> {as_object('n')} IS NOT NULL) AS _products")
        .selectExpr("*", f"{NODE} AS _node")
        .selectExpr(
            *kept, "currency AS _currency", "time_zone", "_object IS NULL AS _no_document",
            "size(_products) AS _count", *[f"{field('_node', name)} AS _{name}" for name in ATTRIBUTES],
        )
        .selectExpr(
            *kept, "_currency", "time_zone", "_no_document", "_count",
            f"coalesce({_text_of('_sku')}, try_cast(_sku AS string)) AS _sku",
            f"{_text_of('_salePrice')} AS _sale_text", f"{_text_of('_regularPrice')} AS _regular_text",
            f"CASE WHEN {is_kind('_onSale', 'boolean')} THEN try_cast(_onSale AS boolean) END AS _on_sale",
            f"CASE WHEN {is_kind('_priceUpdateDate', 'string')} THEN try_cast(_priceUpdateDate AS string) END AS _stamp",
        )
    )
    judged = with_code(read, F.col("_currency")).select(
        "*", exact("_sale_text").alias("_sale"), exact("_regular_text").alias("_regular")
    ).withColumn(
        "reason",
        F.when(F.col("_no_document") | (F.col("_count") == 0), F.lit("no-offer"))
        .when(F.col("_count") > 1, F.lit("ambiguous-offer"))
        .when(F.coalesce(trim_all(F.col("_sku")) != trim_all(F.col("listing_id")), F.lit(True)), F.lit("no-offer"))
        .otherwise(F.coalesce(_price_fault("_sale_text", "_sale"), _price_fault("_regular_text", "_regular"))),
    )
    shown = {
        "amount_minor_units": F.col("_sale"),
        "regular_minor_units": F.col("_regular"),
        "currency": F.col("_code"),
        "on_sale": F.col("_sale") < F.col("_regular"),
        "vendor_on_sale": F.col("_on_sale"),
        "vendor_updated_ms": vendor_timestamp_ms(F.col("_stamp"), F.col("time_zone")),
    }
    ok = F.col("reason").isNull()
    return judged.select(
        *kept, ok.alias("ok"), "reason", *[F.when(ok, value).alias(name) for name, value in shown.items()]
    )


def response_outcomes(
    responses: DataFrame, registry: Registry, mapper: Callable[[DataFrame], DataFrame] = map_payloads
) -> DataFrame:
    """Saved responses to outcomes: observed, limit-exceeded, governor-refused, extraction-failed, source-error.

    `responses` has `source_id, listing_id, status, body, received_at` and may have
    `refusal`, the reason a request was never sent. Another vendor's documents need
    only another `mapper` with the result columns of `map_payloads`. Credentials are hidden in
    everything that is kept.
    """
    if "refusal" not in responses.columns:
        responses = responses.withColumn("refusal", F.lit(None).cast("string"))
    known = registry.frame(responses.sparkSession).select("source_id", "currency", "time_zone", "limit_statuses")
    rows = responses.join(known, "source_id", "left")
    mapped = mapper(rows.withColumn("_body", F.col("body")))
    sent = trim_all(F.col("listing_id")).rlike(SKU)
    success = F.col("status").between(200, 299)
    outcome = (
        F.when(~sent, F.lit("source-error"))
        .when(F.col("refusal").isNotNull(), F.lit("governor-refused"))
        .when(F.array_contains("limit_statuses", F.col("status")), F.lit("limit-exceeded"))
        .when(~success, F.lit("source-error"))
        .when(F.col("ok"), F.lit("observed"))
        .otherwise(F.lit("extraction-failed"))
    )
    judged = mapped.withColumn("kind", outcome)
    observed = F.col("kind") == "observed"
    keep = lambda name: F.when(observed, F.col(name)).alias(name)
    return judged.select(
        "source_id", "listing_id", "received_at", "kind",
        F.when(F.col("kind") == "extraction-failed", F.col("reason"))
        .when(F.col("kind") == "governor-refused", F.col("refusal")).alias("reason"),
        F.when(sent & F.col("refusal").isNull(), F.col("status")).alias("status"),
        F.when(~sent, F.lit("the listing id is not a product number and no request was made for it."))
        .when(F.col("kind") == "source-error", redact_credentials(summarise(F.col("_body")))).alias("detail"),
        keep("amount_minor_units"), keep("currency"),
        F.when(observed, F.lit("")).alias("availability"),
        keep("vendor_updated_ms"),
        F.when(observed, bound_text(redact_credentials(F.col("_body")), RAW_CONTEXT_ADAPTER)).alias("raw_context"),
    )
