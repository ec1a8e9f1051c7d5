"""DuckDB statements that compute the registered queries on the same tables.

They state each result directly, by range self-joins, window functions and
branch tables, and share no logic with the Spark operators.
"""

from __future__ import annotations

from tidemark.config import DAY_MS, HOUR_MS, Rule
from tidemark.plans import views
from tidemark.plans.views import AS_OF_MS

ORACLES: dict[str, str] = {}

OBS = """
obs AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS obs_id,
         'src-' || (l_suppkey % 5) AS source_id,
         CAST(l_partkey AS VARCHAR) AS listing_id,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) // CAST(l_quantity AS BIGINT) AS amount,
         CASE WHEN l_orderkey % 97 = 0 THEN 'CAD' WHEN l_orderkey % 89 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
         epoch_ms(l_shipdate) AS at_ms,
         CASE WHEN l_linenumber % 2 = 0 THEN epoch_ms(l_shipdate) - 5400000 END AS vendor_ms,
         CASE l_linenumber % 3 WHEN 1 THEN 24 WHEN 2 THEN 72 END AS hours,
         CASE WHEN l_orderkey % 10 <> 0 THEN l_returnflag || l_linestatus || l_orderkey END AS raw_context,
         CASE WHEN l_linestatus = 'O' THEN 'https://schema.org/InStock' END AS availability
  FROM lineitem)"""

WATCH = f"""
watch AS (
  SELECT p_partkey, 'src-' || (p_partkey % 5) AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id,
         CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '/item/' || p_partkey
           WHEN 2 THEN 'https://shop.example/item?id=' || p_partkey || '&Token=abc' || p_size
           WHEN 3 THEN 'https://user:pw' || p_size || '@shop.example/item/' || p_partkey
           WHEN 4 THEN '  https://shop.example:8443/item/' || p_partkey || '?ref=mail#top '
           WHEN 5 THEN 'ftp://shop.example/item/' || p_partkey
           ELSE 'https://shop.example/item/' || p_partkey END AS listing_url,
         CASE p_partkey % 8 WHEN 4 THEN 'https://shop.example:8443/item/' || p_partkey || '?ref=mail#top'
           WHEN 6 THEN 'https://shop.example/item/' || p_partkey WHEN 7 THEN 'https://shop.example/item/' || p_partkey END AS link,
         p_size % 4 <> 0 AS enabled,
         {AS_OF_MS} - CAST(p_size AS BIGINT) * 86400000 AS added_ms,
         CASE WHEN p_size % 2 = 0 THEN p_brand END AS note
  FROM part)"""

REQ = """
req AS (
  SELECT event_id AS request_id, 'src-' || (user_id % 7) AS source_id, 'h' || (user_id % 11) || '.example' AS host,
         epoch_us(ts) // 1000 AS at_ms,
         CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 403 WHEN event_id % 5 = 1 THEN 429
              WHEN event_id % 5 = 2 THEN 404 WHEN event_id % 3 = 0 THEN NULL ELSE 503 END AS status,
         CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 7 = 0 THEN 60000 * (event_id % 90)
              WHEN event_id % 7 = 1 THEN greatest(1704888000000 - epoch_us(ts) // 1000, 0)
              WHEN event_id % 7 IN (2, 3) THEN 0 END AS asked_ms,
         CASE event_id % 37 WHEN 1 THEN 'unconfigured-host' WHEN 2 THEN 'source-paused' WHEN 3 THEN 'host-held'
              WHEN 4 THEN 'transport-error' END AS refusal
  FROM events)"""


def iso(ms: str) -> str:
    return f"(strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z')"


def usd(amount: str, currency: str = "currency") -> str:
    return f"({currency} || ' ' || (({amount}) // 100) || '.' || lpad(CAST(({amount}) % 100 AS VARCHAR), 2, '0'))"


def judged(rule: Rule, n: int, rows: str = "obs", keys: tuple[str, ...] = ("listing_id",)) -> str:
    """CTEs `w{n}` and `v{n}`: windows and verdicts of one rule for `rows`."""
    key = ", ".join(keys)
    join = " AND ".join(f"h.{k} = p.{k}" for k in keys)
    back = " AND ".join(f"w.{k} = o.{k}" for k in keys)
    # One number orders by amount, then by instant.
    return f"""
w{n} AS (
  SELECT {", ".join("p." + k for k in keys)}, p.at_ms, count(*) AS n, min(h.amount::HUGEINT * 10000000000000 + h.at_ms) AS low,
         (min(struct_pack(t := h.at_ms, i := h.obs_id, c := h.currency)) FILTER (h.currency <> p.currency)).c AS other, p.currency
  FROM (SELECT DISTINCT {key}, at_ms, currency FROM {rows}) p JOIN obs h ON {join}
   AND h.at_ms > p.at_ms - {rule.window_ms} AND h.at_ms < p.at_ms
  GROUP BY ALL),
s{n} AS (
  SELECT o.*, '{rule.rule_id}' AS rule_id, coalesce(w.n, 0) AS window_count,
         CAST(w.low // 10000000000000 AS BIGINT) AS low_amount, CAST(w.low % 10000000000000 AS BIGINT) AS low_ms,
         w.other,
         CASE WHEN w.n IS NULL THEN 'empty-window' WHEN w.other IS NOT NULL THEN 'currency-mismatch'
              WHEN w.n < {rule.minimum_observations} THEN 'insufficient-history'
              WHEN o.amount + {rule.improvement_minor_units} <= w.low // 10000000000000 THEN 'fired' ELSE 'not-lower' END AS status
  FROM {rows} o LEFT JOIN w{n} w ON {back} AND w.at_ms = o.at_ms AND w.currency = o.currency),
v{n} AS (
  SELECT *, CASE WHEN status IN ('fired', 'not-lower') THEN low_amount END AS reference_amount,
         CASE WHEN status IN ('fired', 'not-lower') THEN low_ms END AS reference_at_ms,
         CASE WHEN status = 'currency-mismatch' THEN other END AS mismatch_currency
  FROM s{n})"""


R1, R2 = views.RULES
VERDICT = "listing_id, obs_id, at_ms, rule_id, status, window_count, reference_amount, reference_at_ms, mismatch_currency"
ORACLES["window_low_verdicts"] = f"""
WITH {OBS}, {judged(R1, 1)}, {judged(R2, 2)}
SELECT {VERDICT} FROM v1 UNION ALL SELECT {VERDICT} FROM v2"""

RR = views.REPLAY_RULES[0]
FIRED = f"{OBS}, {judged(RR, 1)}, fired AS (SELECT * FROM v1 WHERE status = 'fired')"
ORACLES["window_low_fired"] = f"""
WITH {FIRED}
SELECT source_id, listing_id, obs_id, at_ms, amount AS amount_minor_units, reference_amount, window_count FROM fired"""

ORACLES["window_low_by_source"] = f"""
WITH {OBS}, {judged(RR, 1, keys=("source_id", "listing_id"))}
SELECT source_id, listing_id, obs_id, at_ms, status, window_count FROM v1"""

ORACLES["history_window"] = f"""
WITH {OBS} SELECT listing_id, at_ms, amount AS amount_minor_units, currency FROM obs
WHERE at_ms > {AS_OF_MS - 90 * DAY_MS} AND at_ms <= {AS_OF_MS}"""

LAST = f"""
last AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY at_ms DESC, obs_id DESC) AS r FROM obs
    WHERE at_ms > {AS_OF_MS - 365 * DAY_MS} AND at_ms <= {AS_OF_MS}) WHERE r = 1)"""
ORACLES["latest_observation"] = f"""
WITH {OBS}, {LAST} SELECT listing_id, obs_id, at_ms, amount AS amount_minor_units, currency FROM last"""


def _ending() -> str:
    branches = []
    for source, endings in views.ENDINGS.items():
        picks = " ".join(f"WHEN ends_with(CAST(amount AS VARCHAR), '{e}') THEN '{e}'" for e in endings)
        if picks:
            branches.append(f"WHEN source_id = '{source}' THEN CASE {picks} END")
    return "CASE " + " ".join(branches) + " END"


STATUS = f"""
{OBS}, {WATCH}, {LAST}, {judged(R1, 1, "last")}, {judged(R2, 2, "last")},
allv AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2),
joined AS (
  SELECT w.source_id, w.listing_id, w.link, v.* EXCLUDE (source_id, listing_id, status), v.status AS verdict,
         CASE WHEN v.rule_id IS NOT NULL THEN {AS_OF_MS} - (w.p_partkey % 41) * 86400000
              + CASE v.rule_id WHEN '{R1.rule_id}' THEN {R1.cooldown_ms} ELSE {R2.cooldown_ms} END END AS quiet_ms
  FROM watch w LEFT JOIN allv v ON v.listing_id = w.listing_id WHERE w.enabled),
st AS (
  SELECT *, CASE WHEN verdict IS NULL THEN 'no-observation' WHEN verdict <> 'fired' THEN verdict
                 WHEN quiet_ms > {AS_OF_MS} THEN 'suppressed' WHEN link IS NULL THEN 'undeliverable' ELSE 'deliverable' END AS status
  FROM joined)"""
ORACLES["alert_status"] = f"""
WITH {STATUS}
SELECT source_id, listing_id, rule_id, status, at_ms, amount AS amount_minor_units, currency, window_count,
       reference_amount, reference_at_ms, mismatch_currency,
       CASE WHEN status = 'suppressed' THEN quiet_ms END AS quiet_until_ms,
       CASE WHEN status = 'deliverable' THEN link END AS link,
       CASE WHEN status = 'deliverable' THEN {_ending()} END AS clearance_ending
FROM st"""
ORACLES["alert_report"] = f"WITH {STATUS} SELECT source_id, status, count(*) AS n FROM st GROUP BY ALL"
ORACLES["alert_outbox"] = f"""
WITH {STATUS}, d AS (SELECT *, {_ending()} AS ending FROM st WHERE status = 'deliverable')
SELECT rule_id, source_id, listing_id, {usd('amount')} || ' on ' || listing_id || ' (' || rule_id || ')' AS title,
  rule_id || ' fired for ' || source_id || '/' || listing_id || '.' || chr(10)
  || 'Observed ' || {usd('amount')} || ' at ' || {iso('at_ms')} || '.' || chr(10)
  || 'It beats ' || {usd('reference_amount')} || ', the lowest of the ' || window_count
  || ' observation(s) in the window, seen ' || {iso('reference_at_ms')} || '.' || chr(10) || link
  || CASE WHEN ending IS NULL THEN '' ELSE chr(10) || 'Price ends in ' || ending || ', which is one of the endings you configured for this source. That is a corroborating tag only: it did not trigger this alert and it never can.' END AS body,
  link, amount AS observed_amount, reference_amount, currency, ending AS clearance_ending
FROM d"""

ORACLES["alert_run_report"] = f"""
WITH {STATUS},
d AS (SELECT source_id, listing_id, rule_id, amount, coalesce(max(CASE WHEN amount % 29 = 0 THEN 1 ELSE 0 END) OVER (
        ORDER BY source_id, listing_id, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped
      FROM st WHERE status = 'deliverable'),
e AS (SELECT source_id, CASE WHEN stopped = 1 THEN 'not-attempted' WHEN amount % 29 = 0 THEN 'refused'
        WHEN amount % 5 = 0 THEN 'failed' ELSE 'delivered' END AS status FROM d
      UNION ALL SELECT source_id, status FROM st WHERE status <> 'deliverable')
SELECT source_id, status, count(*) AS n FROM e GROUP BY ALL"""

ORACLES["alert_replay"] = f"""
WITH RECURSIVE {FIRED},
p AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id, at_ms ORDER BY amount, obs_id) AS r FROM fired) WHERE r = 1),
nxt AS MATERIALIZED (
  SELECT a.listing_id, a.at_ms, min(b.at_ms) AS nxt FROM p a
  JOIN p b ON b.listing_id = a.listing_id AND b.at_ms >= a.at_ms + {RR.cooldown_ms} GROUP BY ALL),
chain AS (
  SELECT listing_id, min(at_ms) AS at_ms FROM p GROUP BY listing_id
  UNION ALL SELECT n.listing_id, n.nxt FROM chain c JOIN nxt n ON n.listing_id = c.listing_id AND n.at_ms = c.at_ms)
SELECT p.listing_id, p.at_ms, p.obs_id, p.rule_id, p.amount AS amount_minor_units, p.reference_amount
FROM p JOIN chain c ON c.listing_id = p.listing_id AND c.at_ms = p.at_ms"""

ORACLES["clearance_tags"] = f"""
WITH {OBS} SELECT source_id, obs_id, amount AS amount_minor_units, {_ending()} AS clearance_ending FROM obs"""

RECON = f"""
{FIRED},
outbox AS (
  SELECT source_id || ':' || (at_ms - at_ms % 2592000000) AS run_id, *,
         CASE WHEN amount % 41 = 0 THEN 401 WHEN amount % 7 = 0 THEN 500 ELSE 200 END AS answer
  FROM fired),
recon AS (
  SELECT *, CASE WHEN coalesce(max(CASE WHEN answer = 401 THEN 1 ELSE 0 END) OVER (
                   PARTITION BY run_id ORDER BY at_ms, listing_id, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
                 THEN 'not-attempted' WHEN answer = 401 THEN 'refused' WHEN answer = 200 THEN 'delivered' ELSE 'failed' END AS outcome
  FROM outbox)"""
ORACLES["delivery_reconcile"] = f"""
WITH {RECON} SELECT run_id, listing_id, obs_id, answer AS status, outcome FROM recon"""
ORACLES["cooldowns_after"] = f"""
WITH {RECON},
cool AS (
  SELECT 'src-' || (p_partkey % 5) AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, r.rule_id,
         {AS_OF_MS} - (p_partkey % 41) * 86400000 AS fired_ms, CAST(p_size AS BIGINT) AS amount, 'USD' AS currency
  FROM part, (VALUES ('low-365d'), ('low-90d')) r(rule_id)
  UNION ALL SELECT source_id, listing_id, rule_id, at_ms, amount, currency FROM recon WHERE outcome = 'delivered')
SELECT source_id, listing_id, rule_id, fired_ms, amount AS amount_minor_units, currency FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, listing_id, rule_id ORDER BY fired_ms DESC, amount DESC, currency DESC) AS r FROM cool)
WHERE r = 1"""

# -- extraction: the verdict of every page shape, stated from its branch --------

CENTS = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
OFFERS = f"""
offers AS (
  SELECT p_partkey AS page_id, p_partkey % {len(views.OFFER_PAGES)} AS shape, {CENTS} AS cents,
    CASE p_partkey % {len(views.OFFER_PAGES)}
      WHEN 3 THEN 'ambiguous-offer'
      WHEN 4 THEN CASE WHEN {CENTS} = 100 THEN NULL ELSE 'ambiguous-offer' END
      WHEN 5 THEN 'no-price' WHEN 6 THEN 'no-price' WHEN 7 THEN 'no-currency' WHEN 8 THEN 'no-currency'
      WHEN 9 THEN NULL WHEN 11 THEN 'ambiguous-offer' WHEN 12 THEN 'no-offer' WHEN 13 THEN 'no-price' END AS reason
  FROM part)"""
ORACLES["extract_offers"] = f"""
WITH {OFFERS}
SELECT page_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN CASE shape WHEN 1 THEN CAST('1' || page_id AS BIGINT) WHEN 2 THEN page_id * 1000 + 125
       WHEN 9 THEN 129900 ELSE cents END END AS amount_minor_units,
  CASE WHEN reason IS NULL THEN CASE shape WHEN 1 THEN 'JPY' WHEN 2 THEN 'KWD' ELSE 'USD' END END AS currency,
  CASE WHEN reason IS NULL THEN CASE WHEN shape IN (0, 10) THEN 'https://schema.org/InStock'
       WHEN shape = 2 THEN 'LimitedAvailability' ELSE '' END END AS availability
FROM offers"""
ORACLES["extract_reasons"] = f"""
WITH {OFFERS} SELECT coalesce(reason, 'ok') AS verdict, count(*) AS n FROM offers GROUP BY ALL"""
ORACLES["offer_candidate_counts"] = f"""
SELECT p_partkey AS page_id,
  CASE WHEN p_partkey % {len(views.OFFER_PAGES)} IN (10, 11) THEN 'microdata'
       WHEN p_partkey % {len(views.OFFER_PAGES)} <> 12 THEN 'json-ld' END AS reader,
  CAST(CASE p_partkey % {len(views.OFFER_PAGES)} WHEN 3 THEN 2 WHEN 11 THEN 2 WHEN 12 THEN 0 ELSE 1 END AS BIGINT) AS candidates
FROM part"""
ORACLES["extract_real_pages"] = """
SELECT page_id, url, false AS ok, 'no-offer' AS reason FROM pages
WHERE NOT regexp_matches(html, 'ld\\+json|schema\\.org', 'i')
UNION ALL SELECT page_id, url, NULL, 'holds offer markup' FROM pages WHERE regexp_matches(html, 'ld\\+json|schema\\.org', 'i')"""

ZONES = "CASE 'src-' || (p_size % 5) WHEN 'src-0' THEN 'America/New_York' WHEN 'src-1' THEN 'Europe/Berlin' WHEN 'src-2' THEN 'Asia/Tokyo' WHEN 'src-3' THEN 'UTC' END"
VENDOR = f"""
pay AS (
  SELECT *, p_partkey % {len(views.PAYLOADS)} AS shape, CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size % 5 AS src,
    CASE p_size % 5 WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 4 THEN NULL ELSE 2 END AS places FROM part),
exact AS (
  SELECT *, CASE WHEN places = 0 THEN price = floor(price) ELSE places IS NOT NULL END AS fits,
    CAST(price * CASE places WHEN 0 THEN 1 WHEN 3 THEN 1000 ELSE 100 END AS BIGINT) AS minor,
    CAST(CASE places WHEN 0 THEN 1 WHEN 3 THEN 1000 ELSE 100 END AS BIGINT) AS unit
  FROM pay),
why AS (
  SELECT *, CASE
    WHEN shape IN (8, 11, 12, 13, 14) THEN 'no-offer' WHEN shape = 10 THEN 'ambiguous-offer'
    WHEN shape IN (4, 5, 15) THEN CASE WHEN shape = 5 AND places IS NULL THEN 'no-currency' ELSE 'no-price' END
    WHEN places IS NULL THEN 'no-currency' WHEN shape IN (6, 7) THEN 'no-price'
    WHEN shape = 9 THEN NULL
    WHEN NOT fits THEN 'no-price'
    WHEN shape = 0 AND places = 0 THEN 'no-price' END AS reason
  FROM exact)"""
ORACLES["vendor_mapping"] = f"""
WITH {VENDOR}
SELECT 'src-' || src AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, reason IS NULL AS ok, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN shape = 9 THEN 7 * unit ELSE minor END END AS amount_minor_units,
  CASE WHEN reason IS NULL THEN CASE shape WHEN 0 THEN CAST(9999.5 * unit AS BIGINT) WHEN 2 THEN unit WHEN 3 THEN 2000 * unit WHEN 9 THEN 8 * unit ELSE minor END END AS regular_minor_units,
  CASE WHEN reason IS NULL THEN CASE src WHEN 2 THEN 'JPY' WHEN 3 THEN 'KWD' ELSE 'USD' END END AS currency,
  CASE WHEN reason IS NULL THEN CASE shape WHEN 0 THEN minor < 9999.5 * unit WHEN 1 THEN false WHEN 2 THEN minor < unit WHEN 3 THEN minor < 2000 * unit WHEN 9 THEN true END END AS on_sale,
  CASE WHEN reason IS NULL AND shape IN (0, 1) THEN true END AS vendor_on_sale,
  CASE WHEN reason IS NULL THEN CASE shape
    WHEN 0 THEN CASE src WHEN 0 THEN epoch_ms(TIMESTAMP '2026-03-08 06:30:00') WHEN 1 THEN epoch_ms(TIMESTAMP '2026-03-08 01:30:00') ELSE epoch_ms(timezone('UTC', timezone({ZONES}, TIMESTAMP '2026-03-08 02:30:00'))) END
    WHEN 1 THEN epoch_ms(timezone('UTC', timezone({ZONES}, TIMESTAMP '2026-10-25 01:30:00')))
    WHEN 9 THEN epoch_ms(TIMESTAMP '2026-07-01 12:00:00.5') END END AS vendor_updated_ms
FROM why"""


def _filled(templates: list[str]) -> str:
    quoted = [t.replace("'", "''") for t in templates]
    branches = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(quoted))
    return f"replace(replace(CASE shape {branches} END, '#', CAST(p_partkey AS VARCHAR)), '~', CAST(price AS VARCHAR))"


OUTCOME = f"""
{VENDOR},
answered AS (
  SELECT *, 'src-' || src AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, {_filled(views.PAYLOADS)} AS body,
    CASE p_partkey % 19 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 200 END AS status FROM why),
outcome AS (
  SELECT *, CASE WHEN (status = 403 AND src <> 4) OR (status = 429 AND src = 3) THEN 'limit-exceeded'
                 WHEN status <> 200 THEN 'source-error' WHEN reason IS NULL THEN 'observed' ELSE 'extraction-failed' END AS kind,
    CASE WHEN shape = 9 THEN 7 * unit ELSE minor END AS sale FROM answered)"""
ORACLES["response_outcomes"] = f"""
WITH {OUTCOME}
SELECT source_id, listing_id, kind, CASE WHEN kind = 'extraction-failed' THEN reason END AS reason, status,
  CASE WHEN kind = 'source-error' THEN replace(body, 'apiKey=SECRET', 'apiKey=[redacted]') END AS detail,
  CASE WHEN kind = 'observed' THEN sale END AS amount_minor_units,
  CASE WHEN kind = 'observed' THEN CASE src WHEN 2 THEN 'JPY' WHEN 3 THEN 'KWD' ELSE 'USD' END END AS currency,
  CASE WHEN kind = 'observed' THEN replace(body, 'apiKey=SECRET', 'apiKey=[redacted]') END AS raw_context
FROM outcome"""
ORACLES["collection_report"] = f"""
WITH {OUTCOME}
SELECT source_id, kind, CASE WHEN source_id = 'src-4' THEN 'unknown-source' WHEN kind = 'extraction-failed' THEN reason
  WHEN kind <> 'observed' THEN kind END AS refusal, count(*) AS n FROM outcome GROUP BY ALL"""

ORACLES["minor_units"] = """
WITH p AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS plain,
    ['USD', 'JPY', 'KWD', 'ZZZ', 'eur ', 'CLF', 'UYW'][l_orderkey % 7 + 1] AS code FROM lineitem),
q AS (
  SELECT *, CASE l_linenumber % 5 WHEN 0 THEN '$ ' || plain WHEN 1 THEN plain WHEN 2 THEN code || plain
      WHEN 3 THEN '1,234,' || right('00' || plain, 6) ELSE '-' || plain END AS price,
    CASE l_linenumber % 5 WHEN 3 THEN '1234' || right('00' || plain, 6) WHEN 4 THEN NULL ELSE plain END AS digits,
    CASE l_orderkey % 7 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN NULL WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE 2 END AS places
  FROM p)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, price, CASE WHEN places IS NOT NULL THEN upper(trim(code)) END AS currency,
  CASE WHEN digits IS NOT NULL AND places IS NOT NULL AND (places > 0 OR ends_with(digits, '.00'))
       THEN CAST(CAST(digits AS DECIMAL(18,2)) * CAST(CASE places WHEN 0 THEN 1 WHEN 2 THEN 100 WHEN 3 THEN 1000 ELSE 10000 END AS BIGINT) AS BIGINT) END AS amount_minor_units
FROM q"""
ORACLES["format_money"] = f"""
WITH {OBS}
SELECT listing_id, obs_id, amount AS amount_minor_units, ['USD', 'JPY', 'KWD', 'ZZZ', 'UYW'][amount % 5 + 1] AS currency,
  CASE amount % 5 WHEN 0 THEN 'USD ' || (amount // 100) || '.' || lpad(CAST(amount % 100 AS VARCHAR), 2, '0')
    WHEN 1 THEN 'JPY ' || amount WHEN 2 THEN 'KWD ' || (amount // 1000) || '.' || lpad(CAST(amount % 1000 AS VARCHAR), 3, '0')
    WHEN 3 THEN 'ZZZ ' || amount || ' (minor units)'
    ELSE 'UYW ' || (amount // 10000) || '.' || lpad(CAST(amount % 10000 AS VARCHAR), 4, '0') END AS shown
FROM obs"""

# -- history --------------------------------------------------------------------

FAULTY = f"""
{OBS},
f AS (
  SELECT CASE WHEN amount % 23 = 0 THEN ' ' ELSE source_id END AS source_id,
    CASE WHEN amount % 29 = 1 THEN '' ELSE listing_id END AS listing_id, amount AS a,
    CASE WHEN amount % 37 = 3 THEN -amount WHEN amount % 37 <> 4 THEN amount END AS amount_minor_units,
    CASE amount % 41 WHEN 5 THEN 'usd' WHEN 6 THEN 'USD' || chr(10) ELSE currency END AS currency,
    CASE WHEN amount % 43 <> 7 THEN at_ms END AS at_ms,
    CASE amount % 11 WHEN 0 THEN 'extraction-failed' WHEN 1 THEN 'source-error' ELSE 'observed' END AS kind,
    repeat(coalesce(raw_context, '-'), CASE WHEN amount % 50 = 0 THEN 1300 ELSE amount % 9 END) AS raw, availability
  FROM obs),
g AS (
  SELECT *, CASE WHEN source_id NOT IN ('src-0', 'src-1', 'src-2', 'src-3') THEN 'unknown-source'
    WHEN kind = 'extraction-failed' THEN 'no-price' WHEN kind = 'source-error' THEN 'source-error'
    WHEN listing_id = '' THEN 'blank-listing' WHEN amount_minor_units IS NULL THEN 'no-amount'
    WHEN amount_minor_units < 0 THEN 'negative-amount' WHEN a % 31 = 2 THEN 'store-id-reserved'
    WHEN at_ms IS NULL THEN 'no-instant' WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'bad-currency' END AS refusal,
    '{chr(10)}<!-- truncated at 8192 characters -->' AS marker
  FROM f)"""
ORACLES["ingest_split"] = f"""
WITH {FAULTY}
SELECT source_id, listing_id, at_ms, amount_minor_units, currency, kind, refusal,
  CASE source_id WHEN 'src-0' THEN 'America/New_York' WHEN 'src-1' THEN 'Europe/Berlin' WHEN 'src-2' THEN 'Asia/Tokyo' WHEN 'src-3' THEN 'UTC' END AS source_time_zone,
  CASE source_id WHEN 'src-0' THEN 24 WHEN 'src-1' THEN 72 WHEN 'src-3' THEN 48 END AS raw_context_retention_hours,
  availability, md5(CASE WHEN length(raw) <= 8192 THEN raw ELSE left(raw, 8192 - length(marker)) || marker END) AS raw_md5
FROM g"""
ORACLES["ingest_report"] = f"WITH {FAULTY} SELECT source_id, kind, refusal, count(*) AS n FROM g GROUP BY ALL"

EXPIRED = f"(hours IS NOT NULL AND raw_context IS NOT NULL AND at_ms + hours * 3600000 < {AS_OF_MS})"
ORACLES["retention_sweep"] = f"""
WITH {OBS} SELECT listing_id, obs_id, at_ms, CASE WHEN NOT {EXPIRED} THEN raw_context END AS raw_context FROM obs"""
ORACLES["retention_counts"] = f"""
WITH {OBS} SELECT source_id, listing_id, count(*) AS deleted FROM obs WHERE {EXPIRED} GROUP BY ALL"""
ORACLES["retention_audit"] = f"""
WITH {OBS}, c AS (SELECT *, CASE source_id WHEN 'src-0' THEN 72 WHEN 'src-3' THEN 48 END AS ceiling_hours FROM obs)
SELECT source_id, listing_id, obs_id, hours AS raw_context_retention_hours, ceiling_hours FROM c
WHERE ceiling_hours IS NOT NULL AND (hours IS NULL OR hours < 1 OR hours > ceiling_hours)"""
SHOWN = "obs_id, source_id, listing_id, amount, currency, at_ms, vendor_ms, hours, availability"
ORACLES["history_diff"] = f"""
WITH {OBS},
a AS (SELECT {SHOWN}, md5(raw_context) AS raw FROM obs),
b AS (SELECT {SHOWN}, md5(CASE WHEN hours = 72 THEN 'changed' ELSE raw_context END) AS raw FROM obs WHERE raw_context IS NOT NULL
      UNION ALL SELECT {SHOWN}, md5(raw_context) FROM obs WHERE currency = 'CAD'),
d AS (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
      UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT side, listing_id, obs_id, CAST(amount AS VARCHAR) AS amount_minor_units, raw AS raw_context,
       CAST(hours AS VARCHAR) AS raw_context_retention_hours FROM d"""

ORACLES["history_diff_columns"] = f"""
WITH {OBS}
SELECT obs_id, listing_id, NULL::VARCHAR AS grade, 'left' AS side FROM obs WHERE amount % 13 = 0
UNION ALL SELECT obs_id, listing_id, currency, 'right' FROM obs WHERE amount % 13 = 0"""
ORACLES["sweep_with_append"] = f"""
WITH {OBS}
SELECT listing_id, obs_id, CASE WHEN amount % 4 = 0 OR NOT {EXPIRED} THEN raw_context END AS raw_context FROM obs"""

# -- watchlist ------------------------------------------------------------------

CHANGES = """
ch AS (
  SELECT 'src-' || ((l_partkey + l_suppkey % 2) % 5) AS source_id, CAST(l_partkey AS VARCHAR) AS listing_id,
    CASE WHEN l_linenumber % 3 > 0 THEN 'https://shop.example/' || l_orderkey END AS listing_url,
    CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS note,
    CASE l_linenumber % 4 WHEN 0 THEN false WHEN 1 THEN true END AS enabled, epoch_ms(l_shipdate) AS added_ms,
    l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_returnflag FROM lineitem)"""
SEQ = "ORDER BY l_orderkey {d}, l_linenumber {d}, l_suppkey {d}, l_shipdate {d}, l_returnflag {d}"
ORACLES["watchlist_upsert"] = f"""
WITH {WATCH}, {CHANGES},
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, listing_id {SEQ.format(d='DESC')}) AS r FROM ch) WHERE r = 1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, listing_id {SEQ.format(d='ASC')}) AS r FROM ch) WHERE r = 1)
SELECT coalesce(n.source_id, w.source_id) AS source_id, coalesce(n.listing_id, w.listing_id) AS listing_id,
  CASE WHEN n.r = 1 THEN n.listing_url ELSE w.listing_url END AS listing_url,
  CASE WHEN n.r = 1 THEN coalesce(n.enabled, true) ELSE w.enabled END AS enabled,
  CASE WHEN n.r = 1 THEN n.note ELSE w.note END AS note, coalesce(w.added_ms, o.added_ms) AS added_ms
FROM watch w FULL JOIN n ON n.source_id = w.source_id AND n.listing_id = w.listing_id
LEFT JOIN o ON o.source_id = n.source_id AND o.listing_id = n.listing_id"""
ORACLES["watchlist_switch"] = f"""
WITH {WATCH}, {CHANGES},
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, listing_id {SEQ.format(d='DESC')}) AS r FROM ch WHERE enabled IS NOT NULL) WHERE r = 1)
SELECT coalesce(n.source_id, w.source_id) AS source_id, coalesce(n.listing_id, w.listing_id) AS listing_id,
  CASE WHEN w.listing_id IS NOT NULL THEN coalesce(n.enabled, w.enabled) END AS enabled,
  CASE WHEN n.r = 1 THEN w.listing_id IS NOT NULL END AS existed
FROM watch w FULL JOIN n ON n.source_id = w.source_id AND n.listing_id = w.listing_id"""
ORACLES["watchlist_enabled"] = f"WITH {WATCH} SELECT source_id, listing_id, listing_url FROM watch WHERE enabled"
ORACLES["attempted_audit"] = f"""
WITH {OBS}, {WATCH} SELECT DISTINCT source_id, listing_id FROM obs
WHERE (source_id, listing_id) NOT IN (SELECT (source_id, listing_id) FROM watch WHERE enabled)"""
ORACLES["usable_links"] = f"""
WITH {WATCH}
SELECT listing_id, link,
  CASE p_partkey % 8 WHEN 2 THEN 'https://shop.example/item?id=' || p_partkey || '&Token=[redacted]'
    WHEN 3 THEN 'https://[redacted]@shop.example/item/' || p_partkey ELSE listing_url END AS redacted,
  CASE WHEN p_partkey % 8 IN (2, 3, 6, 7) THEN 'https://shop.example' WHEN p_partkey % 8 = 4 THEN 'https://shop.example:8443'
    WHEN p_partkey % 8 = 5 THEN 'ftp://shop.example' END AS origin,
  CASE WHEN p_partkey % 8 >= 2 THEN 'shop.example' END AS host, p_partkey % 8 = 3 AS userinfo
FROM watch"""
ORACLES["redacted_texts"] = r"""
WITH c AS (
  SELECT doc_id, text, trim(regexp_replace(text, '[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS line,
    regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)([^\s/?#@]+)@', '\1[redacted]@', 'g'),
      '([?&](?:auth|apikey|api_key|key|token|access_token|password)=)[^&#\s]*', '\1[redacted]', 'gi') AS hidden,
    chr(10) || '<!-- truncated at 8192 characters -->' AS marker FROM documents)
SELECT doc_id, md5(hidden) AS redacted_md5,
  CASE WHEN line = '' THEN 'the body was empty.' WHEN length(line) <= 200 THEN line ELSE left(line, 200) || '...' END AS summary,
  md5(CASE WHEN length(text) <= 8192 THEN text ELSE left(text, 8192 - length(marker)) || marker END) AS bounded_md5
FROM c"""

ORACLES["scrubbed_reports"] = """
SELECT p_partkey, 'posting ' || p_name || ' to https://hook.example, then https://hook.example. Key ' || replace(p_brand, 'Brand#1', '[redacted]')
  || ' at http://api.example/x?a=1&Token=[redacted]#f' AS report, 'postgres://me:***@db:5432/' || p_partkey AS connection
FROM part"""

# -- export ---------------------------------------------------------------------

NOTICE = "CASE source_id WHEN 'src-0' THEN 'Prices by Acme Data' WHEN 'src-2' THEN 'Data from Beta' END"
LINE = (
    f"{iso('at_ms')} || '  ' || listing_id || '  ' || {usd('amount')} || '  (' || "
    f"coalesce('vendor price updated ' || {iso('vendor_ms')}, 'vendor price-update instant not published') || ')'"
)
ORACLES["export_lines"] = f"""
WITH {OBS}, s AS (SELECT DISTINCT source_id, {NOTICE} AS notice FROM obs)
SELECT source_id, 2 AS part, {iso('at_ms')} || ' ' || listing_id || ' ' || obs_id AS place, {LINE} AS line FROM obs
UNION ALL SELECT source_id, 1, '00', '## ' || source_id FROM s
UNION ALL SELECT source_id, 1, '01', coalesce(notice, '') FROM s
UNION ALL SELECT source_id, 1, '02', '' FROM s WHERE notice IS NOT NULL
UNION ALL SELECT source_id, 3, '', '' FROM s
UNION ALL SELECT '', 1, '0', '# observations' UNION ALL SELECT '', 1, '1', ''"""
ORACLES["export_violations"] = f"""
WITH {OBS}
SELECT source_id, obs_id, CASE WHEN source_id = 'src-4' THEN 'unknown-source' WHEN amount % 3 = 0 THEN 'no-attribution' ELSE 'party-not-named' END AS violation
FROM obs WHERE source_id = 'src-4' OR (source_id IN ('src-0', 'src-2') AND amount % 3 < 2)"""
ORACLES["listing_summaries"] = f"WITH {OBS} SELECT obs_id, {LINE} || coalesce(' - ' || {NOTICE}, '') AS summary FROM obs"

# -- request log ----------------------------------------------------------------

ORACLES["period_counts"] = f"""
WITH {REQ} SELECT source_id, at_ms - at_ms % {DAY_MS} AS period_start_ms, count(*) AS requests FROM req GROUP BY ALL"""
LIMITS = ", ".join(f"('{s}', {a.limit}, {a.period_ms}, {a.warn_fraction}::DOUBLE)" for s, a in views.ALLOWANCES.items())
ORACLES["allowance_usage"] = f"""
WITH {REQ}, lim(source_id, lim, period, warn) AS (VALUES {LIMITS}),
n AS (SELECT r.*, l.*  EXCLUDE (source_id), at_ms - at_ms % period AS period_start_ms,
        row_number() OVER (PARTITION BY r.source_id, at_ms - at_ms % period ORDER BY at_ms, request_id) AS ordinal
      FROM req r JOIN lim l ON l.source_id = r.source_id)
SELECT source_id, period_start_ms, count(*) FILTER (ordinal <= lim) AS consumed, count(*) FILTER (ordinal > lim) AS refused,
  min(at_ms) FILTER (ordinal <= lim AND ordinal::DOUBLE / lim >= warn) AS warned_ms,
  min(at_ms) FILTER (ordinal = lim) AS stopped_ms
FROM n GROUP BY ALL"""
B = views.BREAKER
ORACLES["failure_rate_rolling"] = f"""
WITH {REQ},
t AS (SELECT source_id, request_id, at_ms, count(*) OVER w AS outcomes,
        CAST(sum(CASE WHEN coalesce(status, 999) >= 400 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures
      FROM req WINDOW w AS (PARTITION BY source_id ORDER BY at_ms RANGE BETWEEN {B.window_ms - 1} PRECEDING AND CURRENT ROW))
SELECT *, outcomes >= {B.minimum_outcomes} AND failures / outcomes::DOUBLE >= {B.failure_rate_threshold} AS tripping FROM t"""
ORACLES["breaker_replay"] = f"""
WITH RECURSIVE {REQ},
o AS MATERIALIZED (SELECT source_id, at_ms, CASE WHEN coalesce(status, 999) >= 400 THEN 1 ELSE 0 END AS bad,
        row_number() OVER (PARTITION BY source_id ORDER BY at_ms, request_id) AS k FROM req),
run AS (
  SELECT source_id, 0::BIGINT AS k, 0::BIGINT AS until, []::BIGINT[] AS good_at, []::BIGINT[] AS bad_at, 0::BIGINT AS tripped,
    0::BIGINT AS nbad, 0::BIGINT AS n FROM (SELECT DISTINCT source_id FROM o)
  UNION ALL
  SELECT source_id, k, CASE WHEN trip THEN at_ms + {B.pause_ms} ELSE until END, CASE WHEN trip THEN [] ELSE good END,
    CASE WHEN trip THEN [] ELSE sick END, CASE WHEN trip THEN at_ms ELSE 0 END, len(sick), len(sick) + len(good)
  FROM (
    SELECT *, NOT held AND len(good) + len(sick) >= {B.minimum_outcomes}
        AND len(sick) / (len(good) + len(sick))::DOUBLE >= {B.failure_rate_threshold} AS trip
    FROM (
      SELECT o.source_id, o.k, o.at_ms, r.until, r.until > o.at_ms AS held,
        CASE WHEN r.until > o.at_ms THEN r.good_at ELSE list_filter(CASE WHEN o.bad = 0 THEN list_append(r.good_at, o.at_ms) ELSE r.good_at END, lambda x: x > o.at_ms - {B.window_ms}) END AS good,
        CASE WHEN r.until > o.at_ms THEN r.bad_at ELSE list_filter(CASE WHEN o.bad = 1 THEN list_append(r.bad_at, o.at_ms) ELSE r.bad_at END, lambda x: x > o.at_ms - {B.window_ms}) END AS sick
      FROM run r JOIN o ON o.source_id = r.source_id AND o.k = r.k + 1)))
SELECT source_id, tripped AS tripped_ms, until AS paused_until_ms, nbad AS failures, n AS outcomes FROM run WHERE tripped > 0"""
ORACLES["source_health"] = f"""
WITH {REQ} SELECT source_id, at_ms - at_ms % {DAY_MS} AS period_start_ms, count(*) AS requests,
  count(*) FILTER (status < 400) AS successes, count(*) FILTER (status IN (401, 403, 429)) AS blocks FROM req GROUP BY ALL"""
HOSTS = ", ".join(f"('{h}', {c.max_requests}, {c.interval_ms}, {c.min_delay_ms})" for h, c in views.HOST_CEILINGS.items())
C = views.CEILING
ORACLES["ceiling_audit"] = f"""
WITH {REQ}, hc(host, most, span, gap) AS (VALUES {HOSTS}),
r AS (SELECT req.host, at_ms, request_id, coalesce(most, {C.max_requests}) AS most, coalesce(span, {C.interval_ms}) AS span,
        coalesce(gap, {C.min_delay_ms}) AS gap, row_number() OVER (PARTITION BY req.host ORDER BY at_ms, request_id) AS k,
        lag(at_ms) OVER (PARTITION BY req.host ORDER BY at_ms, request_id) AS prev
      FROM req LEFT JOIN hc ON hc.host = req.host),
w AS (SELECT a.host, a.k, count(*) AS inside FROM r a JOIN r b ON b.host = a.host AND b.at_ms > a.at_ms - a.span AND b.k <= a.k GROUP BY ALL)
SELECT r.host, count(*) AS requests, count(*) FILTER (w.inside > r.most) AS over_ceiling,
  count(*) FILTER (r.at_ms - r.prev < r.gap) AS too_close
FROM r JOIN w ON w.host = r.host AND w.k = r.k GROUP BY r.host"""
ORACLES["documented_limits"] = f"""
WITH {REQ},
s AS (SELECT source_id, max(n) AS peak_per_second FROM (
  SELECT source_id, count(*) OVER (PARTITION BY source_id ORDER BY at_ms RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) AS n FROM req) GROUP BY ALL),
d AS (SELECT source_id, max(n) AS peak_per_day FROM (SELECT source_id, at_ms // {DAY_MS} AS day, count(*) AS n FROM req GROUP BY ALL) GROUP BY ALL)
SELECT s.source_id, peak_per_second, peak_per_day, s.source_id = 'src-0' AND peak_per_second > 5 AS over_per_second,
  s.source_id = 'src-0' AND peak_per_day > 50000 AS over_per_day FROM s JOIN d ON d.source_id = s.source_id"""
ORACLES["hold_audit"] = f"""
WITH {REQ},
h AS (SELECT *, at_ms + CASE WHEN asked_ms > 0 THEN asked_ms WHEN asked_ms = 0 OR status = 429 THEN {views.BACKOFF_MS} END AS until FROM req),
m AS (SELECT host, request_id, at_ms, max(until) OVER (PARTITION BY host ORDER BY at_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM h)
SELECT host, request_id, at_ms, CASE WHEN held > at_ms THEN held END AS held_until_ms, coalesce(held > at_ms, false) AS inside_hold FROM m"""
PERIOD = f"CASE source_id WHEN 'src-0' THEN {DAY_MS} WHEN 'src-1' THEN {6 * HOUR_MS} ELSE {HOUR_MS} END"
ORACLES["period_stops"] = f"""
WITH {REQ},
p AS (SELECT *, at_ms - at_ms % ({PERIOD}) AS period_start_ms FROM req),
x AS (SELECT *, row_number() OVER (PARTITION BY source_id, period_start_ms ORDER BY at_ms, request_id) AS r
      FROM p WHERE status = 403 OR (status = 429 AND source_id = 'src-3'))
SELECT source_id, period_start_ms, at_ms AS stopped_ms, request_id, 'answered ' || status AS reason FROM x
WHERE r = 1 AND (source_id, period_start_ms) NOT IN (SELECT (source_id, period_start_ms) FROM p WHERE status = 503)"""
NOW = views.LOG_END_MS - 20 * HOUR_MS
ORACLES["stopped_entries"] = f"""
WITH {REQ}, {WATCH},
p AS (SELECT DISTINCT source_id, at_ms - at_ms % ({PERIOD}) AS period_start_ms FROM req WHERE status = 503),
e AS (SELECT source_id, {NOW} - {NOW} % ({PERIOD}) AS period_start_ms FROM watch WHERE enabled)
SELECT e.source_id, e.period_start_ms, CASE WHEN p.source_id IS NULL THEN 'attempted' ELSE 'skipped' END AS state, count(*) AS n
FROM e LEFT JOIN p ON p.source_id = e.source_id AND p.period_start_ms = e.period_start_ms GROUP BY ALL"""
ORACLES["refusal_report"] = f"""
WITH {REQ}, r(refusal) AS (VALUES ('unconfigured-host'), ('unknown-source'), ('source-paused'), ('allowance-exhausted'),
  ('robots-unreachable'), ('robots-disallowed'), ('robots-stale'), ('host-held'), ('transport-error'))
SELECT r.refusal, count(req.request_id) AS n FROM r LEFT JOIN req ON req.refusal = r.refusal GROUP BY ALL"""

# The rules of each robots file that apply to the fetcher, and the paths they match, stated by file.
ORIGINS = """
org AS (
  SELECT DISTINCT lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin FROM pages),
rob AS (SELECT origin, length(origin) % 6 AS file, length(origin) % 7 AS answer FROM org),
rules(file, kind, pattern, regex) AS (VALUES
  (0, 'disallow', '/fr/', '^/fr/'), (0, 'allow', '/fr/8', '^/fr/8'), (0, 'disallow', '/*.html$', '^/.*\\.html$'), (0, 'allow', '/tie', '^/tie'),
  (1, 'disallow', '/en/', '^/en/'), (1, 'allow', '/en/7', '^/en/7'),
  (2, 'disallow', '/*page=', '^/.*page='), (2, 'disallow', '/de', '^/de'),
  (3, 'disallow', '', '^$'),
  (4, 'allow', '/%65n', '^/en'), (4, 'disallow', '/en', '^/en'), (4, 'disallow', '/e*/2$', '^/e.*/2$'))"""
ORACLES["robots_rules"] = f"""
WITH {ORIGINS} SELECT origin, kind, pattern FROM rob JOIN rules ON rules.file = rob.file WHERE answer NOT IN (5, 6)"""
ORACLES["robots_other_records"] = f"""
WITH {ORIGINS} SELECT origin, 'sitemap' AS field, 'https://x/s.xml' AS value FROM rob WHERE file = 0 AND answer NOT IN (5, 6)"""
ORACLES["robots_decisions"] = f"""
WITH {ORIGINS},
u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) AS origin,
        regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?#]*', '') AS tail FROM pages),
v AS (SELECT page_id, origin, CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS path FROM u),
m AS (SELECT v.page_id, r.kind, r.pattern, row_number() OVER (PARTITION BY v.page_id ORDER BY strlen(r.pattern) DESC, r.kind ASC) AS k
      FROM v JOIN rob ON rob.origin = v.origin JOIN rules r ON r.file = rob.file
      WHERE rob.answer NOT IN (5, 6) AND r.pattern <> '' AND v.path <> '/robots.txt' AND regexp_matches(v.path, r.regex))
SELECT v.page_id, v.path, CASE WHEN rob.answer = 5 THEN 'unreachable' WHEN m.kind = 'disallow' THEN 'disallowed' ELSE 'allowed' END AS decision, m.pattern
FROM v JOIN rob ON rob.origin = v.origin LEFT JOIN m ON m.page_id = v.page_id AND m.k = 1"""

ORACLES["vendor_instants"] = """
WITH e AS (SELECT event_id, event_id % 6 AS form, ts, ['America/New_York', 'Europe/Berlin', 'Asia/Tokyo', 'Nowhere/Land'][event_id % 4 + 1] AS zone,
  date_trunc('second', ts) AS sec FROM events),
s AS (SELECT *, CASE form WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M')
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30'
    WHEN 4 THEN strftime(ts, '%Y-%m-') || '3' || day(ts) || strftime(ts, 'T%H:%M:%SZ') ELSE strftime(ts, '%d.%m.%Y') END AS stamp FROM e)
SELECT event_id, zone, stamp, CASE
  WHEN form = 0 AND zone <> 'Nowhere/Land' THEN epoch_us(timezone('UTC', timezone(zone, ts))) // 1000
  WHEN form = 1 AND zone <> 'Nowhere/Land' THEN epoch_ms(timezone('UTC', timezone(zone, date_trunc('minute', ts))))
  WHEN form = 2 THEN epoch_ms(sec) WHEN form = 3 THEN epoch_ms(sec) - 19800000
  WHEN form = 4 AND day(ts) = 1 THEN epoch_ms(date_trunc('month', sec)) + 2592000000 + epoch_ms(sec) % 86400000 END AS at_ms
FROM s"""

ORACLES["other_vendor_outcomes"] = """
WITH r AS (SELECT *, p_partkey % 9 AS form, CASE WHEN p_partkey % 19 = 0 THEN 403 WHEN p_partkey % 19 = 2 THEN 500 ELSE 200 END AS status FROM part),
k AS (SELECT *, CASE WHEN status = 403 AND p_size % 5 <> 4 THEN 'limit-exceeded' WHEN status <> 200 THEN 'source-error'
  WHEN form IN (0, 1, 2) THEN 'extraction-failed' ELSE 'observed' END AS kind FROM r)
SELECT 'src-' || (p_size % 5) AS source_id, CAST(p_partkey AS VARCHAR) AS listing_id, kind,
  CASE WHEN kind = 'extraction-failed' THEN CASE WHEN form = 2 THEN 'unparseable-price' ELSE 'no-offer' END END AS reason, status,
  CASE WHEN kind = 'observed' THEN CAST(p_size * 100 + 7 AS BIGINT) END AS amount_minor_units, CASE WHEN kind = 'observed' THEN 'USD' END AS currency FROM k"""
ORACLES["stop_ends"] = f"""
WITH {REQ}, p AS (SELECT *, CASE source_id WHEN 'src-2' THEN {12 * HOUR_MS} WHEN 'src-3' THEN {6 * HOUR_MS} WHEN 'src-5' THEN {12 * HOUR_MS}
  WHEN 'src-6' THEN 900000 ELSE {DAY_MS} END AS period FROM req WHERE status IN (403, 429))
SELECT request_id, source_id, at_ms - at_ms % period + period AS ends_ms FROM p"""

# -- signals: each row against all earlier ones of its window --------------------


def earlier(width_ms: int | None, n: int = 1) -> str:
    """CTE `e{n}`: what lies before each (listing, instant) in the window."""
    since = "" if width_ms is None else f" AND h.at_ms > p.at_ms - {width_ms}"
    return f"""
e{n} AS (
  SELECT p.listing_id, p.at_ms, count(*) AS n, min(h.amount) AS low, sum(h.amount::HUGEINT) AS s, sum(h.amount::HUGEINT * h.amount) AS q,
         min(h.currency) AS c1, max(h.currency) AS c2
  FROM (SELECT DISTINCT listing_id, at_ms FROM obs) p JOIN obs h ON h.listing_id = p.listing_id AND h.at_ms < p.at_ms{since}
  GROUP BY ALL)"""


def refused(least: int, rest: str, n: int = 1) -> str:
    return f"""CASE WHEN e{n}.n IS NULL THEN 'empty-window' WHEN e{n}.c1 <> o.currency OR e{n}.c2 <> o.currency THEN 'currency-mismatch'
  WHEN e{n}.n < {least} THEN 'insufficient-history' {rest} END"""


def signal(signal_id: str, width_ms: int | None, least: int, rest: str, reference: str) -> str:
    status = refused(least, rest)
    return f"""
SELECT * FROM (WITH {earlier(width_ms)}
  SELECT o.listing_id, o.obs_id, o.at_ms, '{signal_id}' AS signal_id, {status} AS status, coalesce(e1.n, 0) AS window_count,
         CASE WHEN {status} IN ('fired', 'not-lower') THEN {reference} END AS reference_amount
  FROM obs o LEFT JOIN e1 ON e1.listing_id = o.listing_id AND e1.at_ms = o.at_ms)"""


_LOW = "WHEN o.amount + 1 <= e1.low THEN 'fired' ELSE 'not-lower'"
_FAR = """WHEN e1.n * e1.q = e1.s * e1.s THEN 'no-spread'
  WHEN e1.s > e1.n * o.amount AND 100 * (e1.s - e1.n * o.amount) * (e1.s - e1.n * o.amount) * (e1.n - 1) >= {z} * e1.n * (e1.n * e1.q - e1.s * e1.s)
  THEN 'fired' ELSE 'not-lower'"""
YEAR, QUARTER = 365 * DAY_MS, 90 * DAY_MS
ORACLES["historical_lows"] = f"WITH {OBS} " + " UNION ALL ".join([
    signal("low-all-time", None, 5, _LOW, "e1.low"), signal("low-365d", YEAR, 3, _LOW, "e1.low"), signal("low-90d", QUARTER, 2, _LOW, "e1.low"),
])
ORACLES["average_drops"] = f"WITH {OBS} " + signal(
    "drop-365d", YEAR, 3, "WHEN 10000 * e1.n * o.amount <= 7000 * e1.s THEN 'fired' ELSE 'not-lower'", "CAST(e1.s // e1.n AS BIGINT)"
)
ORACLES["price_outliers"] = f"WITH {OBS} SELECT * EXCLUDE (reference_amount) FROM (" + " UNION ALL ".join([
    signal("outlier-365d", YEAR, 4, _FAR.format(z=225), "0"), signal("outlier-all-time", None, 8, _FAR.format(z=400), "0"),
]) + ")"
ORACLES["back_in_stock"] = f"""
WITH {OBS},
s AS (SELECT *, CASE amount % 6 WHEN 0 THEN 'out' WHEN 1 THEN 'in' WHEN 2 THEN 'in' WHEN 3 THEN 'out' END AS state FROM obs),
k AS (SELECT p.listing_id, p.at_ms, arg_max(struct_pack(state := h.state, amount := h.amount), (h.at_ms, h.obs_id)) AS last
  FROM (SELECT DISTINCT listing_id, at_ms FROM obs) p JOIN s h ON h.listing_id = p.listing_id AND h.at_ms < p.at_ms AND h.state IS NOT NULL GROUP BY ALL)
SELECT s.listing_id, s.obs_id, s.at_ms,
  CASE WHEN s.state IS NULL THEN 'unknown' WHEN k.last IS NULL THEN 'no-earlier-state' WHEN s.state = 'in' AND k.last.state = 'out' THEN 'fired'
    ELSE 'no-change' END AS status,
  CASE WHEN s.state IS NOT NULL THEN k.last.amount END AS reference_amount
FROM s LEFT JOIN k ON k.listing_id = s.listing_id AND k.at_ms = s.at_ms"""
ORACLES["target_prices"] = f"""
WITH {OBS},
t AS (SELECT CAST(p_partkey AS VARCHAR) AS listing_id, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 90 AS BIGINT) AS target,
  CASE WHEN p_partkey % 5 = 0 THEN ['CAD'] WHEN p_partkey % 7 = 0 THEN ['USD', 'EUR'] ELSE ['USD'] END AS codes FROM part WHERE p_partkey % 3 <> 0)
SELECT o.listing_id, o.obs_id, o.amount AS amount_minor_units, CASE WHEN list_contains(t.codes, o.currency) THEN t.target END AS target_minor_units,
  CASE WHEN NOT list_contains(t.codes, o.currency) THEN 'currency-mismatch' WHEN o.amount <= t.target THEN 'fired' ELSE 'above-target' END AS status
FROM obs o JOIN t ON t.listing_id = o.listing_id"""
ORACLES["seasonal_drops"] = f"""
WITH {OBS}, {earlier(YEAR, 1)}, {earlier(None, 2)},
c AS (SELECT CASE WHEN s_suppkey % 11 <> 0 THEN 'src-' || (s_suppkey % 5) END AS source_id, (s_suppkey * 37) % 2500 AS d0, s_suppkey % 41 AS days,
  500 + 300 * (s_suppkey % 10) AS extra FROM supplier),
r AS (SELECT source_id, extra, epoch_ms(TIMESTAMP '1995-01-01') + d0 * {DAY_MS} AS lo, epoch_ms(TIMESTAMP '1995-01-01') + (d0 + days) * {DAY_MS} AS hi FROM c),
b AS (SELECT i.source_id, i.at_ms, count(*) AS seasons, max(r.extra) AS extra
  FROM (SELECT DISTINCT source_id, at_ms FROM obs) i JOIN r ON coalesce(r.source_id, i.source_id) = i.source_id AND i.at_ms >= r.lo AND i.at_ms < r.hi
  GROUP BY ALL),
o AS (SELECT obs.*, coalesce(b.seasons, 0) AS seasons, coalesce(b.extra, 0) AS extra FROM obs LEFT JOIN b ON b.source_id = obs.source_id AND b.at_ms = obs.at_ms),
v AS (SELECT o.*, coalesce(e1.n, 0) AS window_count, CAST(e1.s // e1.n AS BIGINT) AS average,
  {refused(3, "WHEN 10000 * e1.n * o.amount <= 8000 * e1.s THEN 'fired' ELSE 'not-lower'", 1)} AS plain,
  {refused(3, "WHEN 10000 * e1.n * o.amount <= (8000 - o.extra) * e1.s THEN 'fired' ELSE 'not-lower'", 1)} AS raised,
  {refused(3, "WHEN o.amount < e2.low THEN 'fired' ELSE 'not-lower'", 2)} AS lowest
  FROM o LEFT JOIN e1 ON e1.listing_id = o.listing_id AND e1.at_ms = o.at_ms LEFT JOIN e2 ON e2.listing_id = o.listing_id AND e2.at_ms = o.at_ms)
SELECT source_id, listing_id, obs_id, at_ms, CAST(seasons AS BIGINT) AS seasons, CAST(extra AS INTEGER) AS extra,
  CASE WHEN lowest = 'fired' THEN 'all-time-low' WHEN raised = 'fired' THEN 'fired' WHEN plain = 'fired' THEN 'seasonal' ELSE plain END AS status,
  window_count, CASE WHEN plain IN ('fired', 'not-lower') THEN average END AS reference_amount
FROM v"""

# -- streams: what the batch statements say ---------------------------------------

ORACLES["stream_period_counts"] = ORACLES["stream_repeated"] = ORACLES["period_counts"]
ORACLES["stream_window_low"] = f"""
WITH {OBS}, {judged(RR, 1)} SELECT listing_id, obs_id, at_ms, status, window_count, reference_amount FROM v1"""
ORACLES["stream_cooldowns"] = f"""
SELECT listing_id, at_ms, obs_id, rule_id, amount_minor_units FROM ({ORACLES["alert_replay"]})"""
ORACLES["stream_breaker"] = ORACLES["breaker_replay"]
ORACLES["stream_ingest"] = f"""
WITH {FAULTY}
SELECT source_id, listing_id, amount_minor_units, currency, coalesce(refusal, 'history') AS state FROM g"""
