"""Pages of markup to exactly one exact price each, or one typed failure.

Everything about a page stays in its row: candidates are arrays, the verdict is
an expression over them, and no page text is ever shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.json_values import as_array, as_object, field, scalar, trim_sql, unwrapped, wrapped
from tidemark.functions.money import exact, with_code
from tidemark.operators.microdata import OFFER_NAMES, deep_offers, offers

JSON_LD_BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
# JSON nested deeper than this goes on in the Python walk; nothing is dropped.
JVM_DEPTH = 8

CANDIDATES = T.ArrayType(
    T.StructType()
    .add("prices", T.ArrayType(T.StringType()))
    .add("currencies", T.ArrayType(T.StringType()))
    .add("availability", T.StringType())
    .add("is_range", T.BooleanType())
)

# Candidate readers in order of preference, by the name they are recorded under.
READERS = ("json-ld", "microdata")


NO_NODES = "cast(array() AS array<variant>)"
CONTAINER = f"{as_array('n')} IS NOT NULL OR {as_object('n')} IS NOT NULL"
MEMBERS = f"map_values(map_filter({as_object('n')}, (k, v) -> k <> '@context'))"
CHILDREN = f"filter(flatten(transform(_nodes, n -> coalesce({as_array('n')}, {MEMBERS}, {NO_NODES}))), n -> {CONTAINER})"
TYPES = field("n", "@type")
OFFER = (
    f"exists(coalesce({as_array(TYPES)}, array({TYPES})), t -> "
    f"coalesce(lower(substring_index(try_cast(t AS string), '/', -1)) IN {OFFER_NAMES}, false))"
)
# What one JSON-LD offer node states. A range whose ends agree is a price.
STATED = f"""
transform({{nodes}}, n -> named_struct(
  'price', {scalar(field('n', 'price'))},
  'low', {scalar(field('n', 'lowPrice'))},
  'high', {scalar(field('n', 'highPrice'))},
  'currency', upper({trim_sql(scalar(field('n', 'priceCurrency')))}),
  'availability', coalesce({scalar(field('n', 'availability'))}, '')))"""
CANDIDATE = """
transform({stated}, s -> named_struct(
  'prices', array_compact(array(coalesce(s.price, CASE WHEN s.low = s.high THEN s.low END))),
  'currencies', array_compact(array(s.currency)),
  'availability', s.availability,
  'is_range', s.price IS NULL AND coalesce(s.low <> s.high, s.low IS NOT NULL OR s.high IS NOT NULL)))"""


@F.pandas_udf(T.StructType().add("micro", CANDIDATES).add("deep", T.ArrayType(T.StringType())))
def _python_readers(html: pd.Series, rest: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "micro": [offers(text) if text is not None else [] for text in html],
            "deep": [deep_offers(list(texts)) if texts is not None else [] for texts in rest],
        }
    )


def offer_candidates(pages: DataFrame) -> DataFrame:
    """Per page the distinct offers it states, as an array, and the reader that found them.

    JSON-LD wins over microdata; two statements of the same offer are one.
    """
    kept = [name for name in pages.columns if name != "html"]
    blocks = F.regexp_extract_all("html", F.lit(JSON_LD_BLOCK), F.lit(1))
    walk = pages.select(*kept, "html", blocks.alias("_blocks")).selectExpr(
        *kept, "html", f"filter(transform(transform(_blocks, b -> {wrapped('b')}), a -> {unwrapped('a')}), n -> n IS NOT NULL) AS _nodes",
        f"{NO_NODES} AS _offers",
    )
    for _ in range(JVM_DEPTH):
        walk = walk.selectExpr(
            *kept, "html", f"{CHILDREN} AS _nodes", f"concat(_offers, filter(_nodes, n -> {OFFER})) AS _offers"
        )
    # Python sees the few documents that go deeper, and the markup of pages without a JSON-LD offer.
    walk = walk.selectExpr(
        *kept, "_offers",
        "CASE WHEN size(_offers) = 0 AND contains(lower(html), 'itemtype') THEN html END AS _html",
        "CASE WHEN size(_nodes) > 0 THEN transform(_nodes, n -> to_json(n)) END AS _rest",
    )
    read = walk.select(*kept, "_offers", _python_readers("_html", "_rest").alias("_more"))
    nodes = "concat(_offers, transform(_more.deep, d -> try_parse_json(d)))"
    stated = read.selectExpr(*kept, "_more.micro AS _micro", f"{STATED.format(nodes=nodes)} AS _stated")
    found = stated.select(*kept, "_micro", F.expr(CANDIDATE.format(stated="_stated")).cast(CANDIDATES).alias("_ld"))
    return found.selectExpr(
        *kept,
        "array_distinct(CASE WHEN size(_ld) > 0 THEN _ld ELSE _micro END) AS candidates",
        f"CASE WHEN size(_ld) > 0 THEN '{READERS[0]}' WHEN size(_micro) > 0 THEN '{READERS[1]}' END AS reader",
    )


def extract_offers(pages: DataFrame) -> DataFrame:
    """One verdict per page: an exact price, or the first typed reason against one.

    Order of refusals: no-offer, ambiguous-offer (several offers, a range, several
    currencies), no-price, no-currency, no-price (inexact), ambiguous-offer
    (several amounts).
    """
    return judge_candidates(offer_candidates(pages))


def judge_candidates(found: DataFrame) -> DataFrame:
    """The verdict over any reader's `candidates` (and `reader`), beside the other columns it kept."""
    kept = [name for name in found.columns if name not in ("candidates", "reader")]
    offer = found.select("*", F.try_element_at("candidates", F.lit(1)).alias("_offer"))
    coded = with_code(offer, F.try_element_at("_offer.currencies", F.lit(1)))
    priced = coded.withColumn("_amounts", F.array_distinct(F.transform("_offer.prices", exact)))
    reason = (
        F.when(F.size("candidates") == 0, F.lit("no-offer"))
        .when(F.size("candidates") > 1, F.lit("ambiguous-offer"))
        .when(F.col("_offer.is_range") | (F.size("_offer.currencies") > 1), F.lit("ambiguous-offer"))
        .when(F.size("_offer.prices") == 0, F.lit("no-price"))
        .when(F.col("_places").isNull(), F.lit("no-currency"))
        .when(F.exists("_amounts", lambda amount: amount.isNull()), F.lit("no-price"))
        .when(F.size("_amounts") > 1, F.lit("ambiguous-offer"))
    )
    judged = priced.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return judged.select(
        *kept,
        ok.alias("ok"),
        "reason",
        F.when(ok, F.try_element_at("_amounts", F.lit(1))).alias("amount_minor_units"),
        F.when(ok, F.col("_code")).alias("currency"),
        F.when(ok, F.col("_offer.availability")).alias("availability"),
    )
