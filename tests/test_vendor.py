import json

from pyspark.sql import functions as F

from tidemark.config import Registry, Source
from tidemark.operators.vendor import map_payloads, response_outcomes


def product(**changes):
    doc = {"sku": 1234567, "name": "Caliper", "salePrice": 7.99, "regularPrice": 9.99, "onSale": True, "priceUpdateDate": "2026-07-01T08:00:00"}
    doc.update(changes)
    return json.dumps({k: v for k, v in doc.items() if v is not ...})


ZONED = 1782907200000  # 2026-07-01T12:00:00Z
CASES = [
    (product(), (True, None, 799, 999, True, True, ZONED)),
    (product(salePrice="129.99", regularPrice="$129.99", onSale=False), (True, None, 12999, 12999, False, False, ZONED)),
    (product(salePrice=1299, regularPrice=1299), (True, None, 129900, 129900, False, True, ZONED)),
    # The flag is recomputed; the vendor's own stays beside it.
    (product(onSale=False), (True, None, 799, 999, True, False, ZONED)),
    (product(onSale="true"), (True, None, 799, 999, True, None, ZONED)),
    (product(priceUpdateDate=...), (True, None, 799, 999, True, True, None)),
    (product(priceUpdateDate="yesterday"), (True, None, 799, 999, True, True, None)),
    (product(priceUpdateDate=17), (True, None, 799, 999, True, True, None)),
    (product(sku=" 1234567 "), (True, None, 799, 999, True, True, ZONED)),
    (json.dumps({"total": 1, "products": [json.loads(product())]}), (True, None, 799, 999, True, True, ZONED)),
    (json.dumps({"products": [3, json.loads(product()), None]}), (True, None, 799, 999, True, True, ZONED)),
    (product(salePrice=...), "no-price"), (product(regularPrice=...), "no-price"), (product(salePrice=None), "no-price"),
    (product(salePrice="soon"), "no-price"), (product(salePrice=7.999), "no-price"), (product(salePrice=[7]), "no-price"),
    (product(salePrice=True), "no-price"), (product(salePrice=-1), "no-price"), (product(sku=7654321), "no-offer"),
    (product(sku=...), "no-offer"), (product(sku=None), "no-offer"), ('[{"sku":1234567}]', "no-offer"), ("17", "no-offer"),
    ("null", "no-offer"), ("<html>", "no-offer"), ("", "no-offer"), (None, "no-offer"), ('{"products":[]}', "no-offer"),
    (json.dumps({"products": [json.loads(product())] * 2}), "ambiguous-offer"),
    # A document is one JSON value and nothing else.
    (product() + " x", "no-offer"), (product() + product(), "no-offer"), (product() + "}", "no-offer"), (product() + ",1", "no-offer"),
    (" \n" + product() + "\t", (True, None, 799, 999, True, True, ZONED)),
]


def _mapped(spark, currency, zone="America/New_York"):
    rows = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES)], "i int, body string").selectExpr(
        "*", "'1234567' AS listing_id", f"'{currency}' AS currency", f"'{zone}' AS time_zone"
    )
    return {r.i: r for r in map_payloads(rows).collect()}


def test_payloads(spark):
    got = _mapped(spark, "usd")
    for i, (body, want) in enumerate(CASES):
        r = got[i]
        if isinstance(want, str):
            assert (r.ok, r.reason, r.amount_minor_units, r.currency) == (False, want, None, None), body
        else:
            assert (r.ok, r.reason, r.amount_minor_units, r.regular_minor_units, r.on_sale, r.vendor_on_sale, r.vendor_updated_ms) == want, body
            assert r.currency == "USD"


def test_an_unknown_currency_is_the_declaration_being_wrong(spark):
    got = _mapped(spark, "XXX")
    assert got[0].reason == "no-currency" and got[11].reason == "no-price" and got[16].reason == "no-price"


def test_outcomes(spark):
    registry = Registry((Source("s", "USD", "UTC", limit_statuses=(403, 420)),))
    secret = product(canonicalUrl="https://api.example/p?apiKey=SECRET")
    rows = [
        ("s", "1234567", 200, secret, None), ("s", "1234567", 403, "x", None), ("s", "1234567", 420, "x", None),
        ("s", "1234567", 500, "down\n\n for a?token=SECRET while", None), ("s", "1234567", 204, "", None),
        ("s", "abc", None, None, None), ("s", "1234567", None, None, "host-held"), ("s", "1234567", 200, product(sku=1), None),
        ("s", "1234567", 200, product(canonicalUrl="y" * 5000), None),
    ]
    responses = spark.createDataFrame(rows, "source_id string, listing_id string, status int, body string, refusal string").withColumn(
        "received_at", F.timestamp_millis(F.lit(0))
    )
    got = response_outcomes(responses.coalesce(1), registry).collect()
    assert [(r.kind, r.reason, r.status) for r in got] == [
        ("observed", None, 200), ("limit-exceeded", None, 403), ("limit-exceeded", None, 420), ("source-error", None, 500),
        ("extraction-failed", "no-offer", 204), ("source-error", None, None), ("governor-refused", "host-held", None),
        ("extraction-failed", "no-offer", 200), ("observed", None, 200),
    ]
    assert got[3].detail == "down for a?token=[redacted] while"
    assert "SECRET" not in got[0].raw_context and "[redacted]" in got[0].raw_context
    assert len(got[8].raw_context) == 4096 and got[8].raw_context.endswith("truncated at 4096 characters -->")
