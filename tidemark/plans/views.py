"""The inputs of the registered queries, derived from the given tables by Spark.

The given tables hold no prices over time, no offer markup and no request log,
so each input is an expression over a whole table. The DuckDB twins of these
expressions are in `oracles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import DAY_MS, HOUR_MS, Allowance, BreakerSettings, Ceiling, Registry, Rule, Source
from tidemark.operators import signals
from tidemark.session import configure

# 2001-06-01T00:00:00Z, inside the span of the derived observations.
AS_OF_MS = 991_353_600_000
# 2024-02-01T00:00:00Z, after the derived request log.
LOG_END_MS = 1_706_745_600_000

RULES = (
    Rule("low-365d", 365 * DAY_MS, 3, 100, 7 * DAY_MS),
    Rule("low-90d", 90 * DAY_MS, 2, 500, 30 * DAY_MS),
)
REPLAY_RULES = (Rule("low-365d", 365 * DAY_MS, 3, 100, 60 * DAY_MS),)
SIGNALS = (
    signals.low("low-all-time", None, 5, 1),
    signals.low("low-365d", 365 * DAY_MS, 3, 1),
    signals.low("low-90d", 90 * DAY_MS, 2, 1),
    signals.drop("drop-365d", 365 * DAY_MS, 3, 3_000),
    signals.outlier("outlier-365d", 365 * DAY_MS, 4, 15),
    signals.outlier("outlier-all-time", None, 8, 20),
)
ENDINGS = {"src-0": ["97", "7"], "src-1": ["99"], "src-2": ["00", "0", "5"], "src-3": []}
REGISTRY = Registry(
    (
        Source("src-0", "USD", "America/New_York", 24, 72, True, "Acme Data", "Prices by Acme Data", (403,), 5, 50_000),
        Source("src-1", "USD", "Europe/Berlin", 72, None),
        Source("src-2", "JPY", "Asia/Tokyo", None, None, True, "Beta", "Data from Beta"),
        Source("src-3", "KWD", "UTC", 48, 48, limit_statuses=(403, 429)),
    )
)
ALLOWANCES = {
    "src-0": Allowance(40), "src-1": Allowance(50, DAY_MS, 0.5), "src-2": Allowance(30, 12 * HOUR_MS, 0.9),
    "src-3": Allowance(8, HOUR_MS * 6), "src-4": Allowance(45),
}
BREAKER = BreakerSettings(6 * HOUR_MS, 5, 0.4, 12 * HOUR_MS)
CEILING = Ceiling(4, 10 * 60_000, 60_000)
HOST_CEILINGS = {"h1.example": Ceiling(2, 30 * 60_000, 5 * 60_000), "h2.example": Ceiling(3, 5 * 60_000, 20 * 60_000)}
BACKOFF_MS = 15 * 60_000

OFFER_PAGES = [
    '<html><head><script type="application/ld+json">{"@context":"https://schema.org","@type":"Product","sku":"#",'
    '"offers":{"@type":"Offer","price":"~","priceCurrency":"USD","availability":"https://schema.org/InStock"}}</script></head></html>',
    '<script type=\'application/ld+json\'>{"@type":"https://schema.org/Offer","price":1#,"priceCurrency":"JPY"}</script>',
    '<script type="application/ld+json">[{"@graph":[{"x":{"@type":["Thing","Offer"],"price":"#.125","priceCurrency":"kwd","availability":{"@id":" LimitedAvailability "}}}]}]</script>',
    '<script type="application/ld+json">{"offers":[{"@type":"Offer","price":"~","priceCurrency":"USD"},'
    '{"@type":"Offer","price":"1.#","priceCurrency":"USD"}]}</script>',
    '<script type="application/ld+json">{"@type":"AggregateOffer","lowPrice":"1.00","highPrice":"~","priceCurrency":"USD"}</script>',
    '<script type="application/ld+json">{"@type":"Offer","priceCurrency":"USD","availability":"x"}</script>',
    '<script type="application/ld+json">{"@type":"Offer","price":"Call for price #","priceCurrency":"USD"}</script>',
    '<script type="application/ld+json">{"@type":"Offer","price":"~"}</script>',
    '<script type="application/ld+json">{"@type":"Offer","price":"~","priceCurrency":"$"}</script>',
    '<script type="application/ld+json">{"@type":"Offer","price":"$1,299.00 USD","priceCurrency":" usd "}</script>'
    '<script type="application/ld+json">{"offers":{"@type":"AggregateOffer","lowPrice":"$1,299.00 USD","highPrice":"$1,299.00 USD","priceCurrency":"USD"}}</script>',
    '<body itemscope itemtype="https://schema.org/Product"><span itemprop="price">1</span><div itemprop="offers" itemscope '
    'itemtype="http://schema.org/Offer"><meta itemprop="priceCurrency" content="USD"/><meta itemprop="price" content="~">'
    '<span itemprop="price">$~</span><link itemprop="availability" href="https://schema.org/InStock"><div itemscope>'
    '<b itemprop="price">9</b></div></div></body>',
    '<div itemscope itemtype="https://schema.org/Offer"><i itemprop="price">~</i><i itemprop="priceCurrency">USD</i></div>'
    '<div itemscope itemtype="https://schema.org/Offer"><i itemprop="price">#.37</i><i itemprop="priceCurrency">USD</i></div>',
    '<script type="application/ld+json">{"@type":"Offer","price":"~",</script><p>no offer #</p>',
    '<script type="application/ld+json">{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":{"k":{"l":{"m":{"n":{"o":{"p":'
    '{"@type":"Offer","price":-#,"priceCurrency":"USD"}}}}}}}}}}}}}}}}}</script>',
    '<script type="application/ld+json">{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":{"j":{"k":{"l":{"m":{"n":{"o":{"p":'
    '{"@type":"Offer","price":~,"priceCurrency":"USD"},"@context":{"@type":"Offer","price":"1"}}}}}}}}}}}}}}}}}</script>',
]
PAYLOADS = [
    '{"sku":#,"name":"n","salePrice":~,"regularPrice":9999.5,"onSale":true,"priceUpdateDate":"2026-03-08T02:30:00","canonicalUrl":"https://api.example/p?apiKey=SECRET&x=1"}',
    '{"sku":"#","salePrice":"$~","regularPrice":~,"onSale":true,"priceUpdateDate":"2026-10-25 01:30"}',
    '{"sku":#,"salePrice":~,"regularPrice":1}',
    '{"sku":#,"salePrice":~,"regularPrice":2000,"priceUpdateDate":"not a date"}',
    '{"sku":#,"regularPrice":~}',
    '{"sku":#,"salePrice":~}',
    '{"sku":#,"salePrice":"soon","regularPrice":~}',
    '{"sku":#,"salePrice":1.23456,"regularPrice":~}',
    '{"sku":1#,"salePrice":~,"regularPrice":~}',
    '{"total":1,"products":[{"sku":#,"salePrice":7,"regularPrice":8,"onSale":"yes","priceUpdateDate":"2026-07-01T12:00:00.5Z"}]}',
    '{"products":[{"sku":#,"salePrice":7,"regularPrice":8},{"sku":1,"salePrice":7,"regularPrice":8}]}',
    '{"products":[]}',
    '[1,2]',
    '{"sku":null,"salePrice":1,"regularPrice":2}',
    'not json at all',
    '{"sku":#,"salePrice":[1],"regularPrice":2}',
]
ROBOTS_FILES = [
    "# comment\r\nUser-agent: OtherBot\r\nDisallow: /\r\n\r\nuser-agent: TideBot # ours\r\nDisallow: /fr/\r\nAllow: /fr/8\r\nDisallow: /*.html$\r\nSitemap: https://x/s.xml\r\nAllow: /tie\r\n",
    "Disallow: /orphan\nUser-agent: *\nDisallow: /en/\nAllow: /en/7\n",
    "User-agent: tidebot\nUser-agent: other\nDisallow: /*page=\n\nUser-agent: TIDEBOT\nDisallow: /de\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nAllow: /%65n\nDisallow: /en\nDisallow: /e*/2$\nDisallow: /fr/9",
    "User-agent: nobody\nDisallow: /\n",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream of its files, a bounded amount per trigger."""
    schema = table(spark, sf_dir, name).schema
    # A stream takes a single file only as a pattern; this one fits a file and a folder of part files alike.
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", 1 << 30).parquet(f"{sf_dir}/{name}[.]parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price history from the line items: a listing per part, a source per supplier group."""
    return observations_of(table(spark, sf_dir, "lineitem"))


def observations_of(lineitem: DataFrame) -> DataFrame:
    """The same, of a batch or a stream of line items."""
    return lineitem.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS obs_id",
        "concat('src-', l_suppkey % 5) AS source_id",
        "cast(l_partkey AS string) AS listing_id",
        "cast(null AS string) AS store_id",
        "cast(cast(l_extendedprice AS decimal(18,2)) * 100 AS bigint) div cast(l_quantity AS bigint) AS amount_minor_units",
        "CASE WHEN l_orderkey % 97 = 0 THEN 'CAD' WHEN l_orderkey % 89 = 0 THEN 'EUR' ELSE 'USD' END AS currency",
        "cast(l_shipdate AS timestamp) AS observed_at",
        "'America/New_York' AS source_time_zone",
        "CASE WHEN l_linenumber % 2 = 0 THEN cast(l_shipdate AS timestamp) - INTERVAL 90 MINUTE END AS vendor_price_updated_at",
        "CASE l_linenumber % 3 WHEN 1 THEN 24 WHEN 2 THEN 72 END AS raw_context_retention_hours",
        "CASE WHEN l_orderkey % 10 <> 0 THEN concat(l_returnflag, l_linestatus, l_orderkey) END AS raw_context",
        "CASE WHEN l_linestatus = 'O' THEN 'https://schema.org/InStock' END AS availability",
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watchlist entry per part; links of every kind."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('src-', p_partkey % 5) AS source_id",
        "cast(p_partkey AS string) AS listing_id",
        """CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('/item/', p_partkey)
           WHEN 2 THEN concat('https://shop.example/item?id=', p_partkey, '&Token=abc', p_size)
           WHEN 3 THEN concat('https://user:pw', p_size, '@shop.example/item/', p_partkey)
           WHEN 4 THEN concat('  https://shop.example:8443/item/', p_partkey, '?ref=mail#top ')
           WHEN 5 THEN concat('ftp://shop.example/item/', p_partkey)
           ELSE concat('https://shop.example/item/', p_partkey) END AS listing_url""",
        "p_size % 4 <> 0 AS enabled",
        "timestamp_millis(991353600000L - p_size * 86400000L) AS added_at",
        "CASE WHEN p_size % 2 = 0 THEN p_brand END AS note",
    )


def cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cooldown for every part and rule, fired between 0 and 40 days before `AS_OF_MS`."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('src-', p_partkey % 5) AS source_id", "cast(p_partkey AS string) AS listing_id",
        "explode(array('low-365d', 'low-90d')) AS rule_id",
        f"timestamp_millis({AS_OF_MS}L - (p_partkey % 41) * 86400000L) AS fired_at",
        "cast(p_size AS bigint) AS amount_minor_units", "'USD' AS currency",
    )


def stocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with an availability that comes and goes and is often unknown."""
    return observations(spark, sf_dir).selectExpr(
        "* EXCEPT (availability)",
        """CASE amount_minor_units % 6 WHEN 0 THEN 'https://schema.org/OutOfStock' WHEN 1 THEN 'http://schema.org/InStock '
           WHEN 2 THEN 'LimitedAvailability' WHEN 3 THEN 'BackOrder' WHEN 4 THEN 'https://schema.org/PreOrder' END AS availability""",
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target price for two parts in three, some of them twice or in another currency."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr(
        "cast(p_partkey AS string) AS listing_id",
        "explode(CASE WHEN p_partkey % 5 = 0 THEN array('CAD') WHEN p_partkey % 7 = 0 THEN array('USD', 'USD', 'EUR') ELSE array('USD') END) AS currency",
        "cast(cast(p_retailprice AS decimal(18,2)) * 90 AS bigint) AS target_minor_units",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sale season per supplier, for one source or for all; seasons overlap."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 11 <> 0 THEN concat('src-', s_suppkey % 5) END AS source_id",
        "date_add(date'1995-01-01', cast(s_suppkey * 37 % 2500 AS int)) AS starts_on",
        "date_add(date'1995-01-01', cast(s_suppkey * 37 % 2500 + s_suppkey % 41 AS int)) AS ends_before",
        "cast(500 + 300 * (s_suppkey % 10) AS int) AS extra_basis_points",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log from the events: a source and a host per user group, statuses and back-off headers by id."""
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """The same, of a batch or a stream of events."""
    return events.selectExpr(
        "event_id AS request_id", "concat('src-', user_id % 7) AS source_id",
        "concat('h', user_id % 11, '.example') AS host", "cast(ts AS timestamp) AS at",
        """CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 403 WHEN event_id % 5 = 1 THEN 429
           WHEN event_id % 5 = 2 THEN 404 WHEN event_id % 3 = 0 THEN NULL ELSE 503 END AS status""",
        """CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 7 = 0 THEN cast(60 * (event_id % 90) AS string)
           WHEN event_id % 7 = 1 THEN 'Wed, 10 Jan 2024 12:00:00 GMT' WHEN event_id % 7 = 2 THEN 'soon'
           WHEN event_id % 7 = 3 THEN '0' END AS retry_after""",
        """CASE event_id % 37 WHEN 1 THEN 'unconfigured-host' WHEN 2 THEN 'source-paused' WHEN 3 THEN 'host-held'
           WHEN 4 THEN 'transport-error' END AS refusal""",
    )


def _pick(key: str, templates: list[str]) -> str:
    """SQL for the template picked by `key`."""
    quoted = [t.replace("\\", "\\\\").replace("'", "\\'").replace("\r", "\\r").replace("\n", "\\n") for t in templates]
    branches = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(quoted))
    return f"CASE {key} % {len(templates)} {branches} END"


def _cases(key: str, templates: list[str], price: str) -> str:
    """SQL that fills the template picked by `key`: `#` is the key, `~` the price."""
    return f"replace(replace({_pick(key, templates)}, '#', cast({key} AS string)), '~', {price})"


PRICE = "cast(cast(p_retailprice AS decimal(18,2)) AS string)"


def offer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part, in one of the shapes offers come in."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS page_id", f"{_cases('p_partkey', OFFER_PAGES, PRICE)} AS html"
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved vendor response per part, in one of the shapes they come in."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey AS string) AS listing_id", "concat('src-', p_size % 5) AS source_id",
        """CASE WHEN p_partkey % 19 = 0 THEN 403 WHEN p_partkey % 19 = 1 THEN 429 WHEN p_partkey % 19 = 2 THEN 500
           ELSE 200 END AS status""",
        f"timestamp_millis({AS_OF_MS}L + p_partkey * 1000) AS received_at",
        f"{_cases('p_partkey', PAYLOADS, PRICE)} AS body",
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved response of another vendor per part: minor units and a code, some of them broken."""
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey AS string) AS listing_id", "concat('src-', p_size % 5) AS source_id",
        "CASE WHEN p_partkey % 19 = 0 THEN 403 WHEN p_partkey % 19 = 2 THEN 500 ELSE 200 END AS status",
        f"timestamp_millis({AS_OF_MS}L + p_partkey * 1000) AS received_at",
        """CASE p_partkey % 9 WHEN 0 THEN 'down' WHEN 1 THEN concat('{"ref":"x', p_partkey, '","quote":{"units":5,"code":"USD"}}')
           WHEN 2 THEN concat('{"ref":"', p_partkey, '","quote":{"units":null,"code":"USD"}}')
           ELSE concat('{"ref":"', p_partkey, '","quote":{"units":', p_size * 100 + 7, ',"was":9000,"code":" usd "}}') END AS body""",
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file for every origin of the given pages, picked by the length of the origin."""
    origins = table(spark, sf_dir, "pages").selectExpr(
        "lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin"
    ).distinct()
    return origins.selectExpr("origin", "length(origin) AS n").selectExpr(
        "origin", "CASE n % 7 WHEN 6 THEN 404 WHEN 5 THEN 503 ELSE 200 END AS status",
        f"{_pick('n', ROBOTS_FILES)} AS body", "n % 6 = 4 AS truncated",
    )
