import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.functions.instants import (
    header_date_ms, hold_ms, is_failure, is_robots_failure, is_time_zone, local_to_instant_ms, period_start, retry_after_ms,
    robots_status_class, time_zone_names, vendor_timestamp_ms, zone_offset_ms,
)
from tidemark.functions.money import format_minor_units, minor_unit_exponent, normalise_currency, to_minor_units
from tidemark.functions.text import (
    bound_text, carries_userinfo, channel_origin, hide_password, host_key, redact_credentials, scrub, single_line, summarise,
    url_origin, usable_link,
)
from tidemark.operators.robots import normalise_path, path_fits, path_pieces, path_regex


def column(spark, rows, schema, expression):
    """The values of one expression over literal rows, in order."""
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema)
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_to_minor_units(spark):
    cases = [
        ("1299", "USD", 129900), ("1299.00", "USD", 129900), ("1,299.00", "USD", 129900), ("$129.99", "USD", 12999),
        ("129.99 USD", "USD", 12999), ("usd129.99", "USD", 12999), ("US 129.99", "USD", None),
        ("$ 129.99", "USD", 12999), (" 5 ", "usd", 500), ("€ 5", "EUR", 500), ("12.9900", "USD", 1299),
        ("12.995", "USD", None), ("12.995", "KWD", 12995), ("12800", "JPY", 12800), ("1299.50", "JPY", None),
        ("1299.00", "JPY", 1299), ("-5", "USD", None), ("1.299,00", "EUR", None), ("1,29", "USD", None), ("", "USD", None),
        ("$", "USD", None), ("Call for price", "USD", None), ("5", "XXX", None), ("5", "$", None), ("1234,567", "USD", None),
        ("9007199254740993", "JPY", 9007199254740993), ("99999999999999999999", "USD", None), ("0", "USD", 0),
        ("5", " usd ", 500), ("1.2345", "CLF", 12345), (".5", "USD", None), ("5.", "USD", None), ("USDUSD5", "USD", None),
    ]
    got = column(spark, [c[:2] for c in cases], "p string, c string", to_minor_units(F.col("p"), F.col("c")))
    assert got == [c[2] for c in cases]


def test_currency_table(spark):
    rows = [("JPY",), ("kwd",), (" usd",), ("UYW",), ("EUR",), ("XXX",), ("US",), ("",)]
    assert column(spark, rows, "c string", minor_unit_exponent(F.col("c"))) == [0, 3, 2, 4, 2, None, None, None]
    assert column(spark, rows, "c string", normalise_currency(F.col("c"))) == ["JPY", "KWD", "USD", "UYW", "EUR", None, None, None]


def test_format_minor_units(spark):
    cases = [
        (1299, "USD", "USD 12.99"), (5, "usd", "USD 0.05"), (1299, "JPY", "JPY 1299"), (12995, "KWD", "KWD 12.995"),
        (-5, "USD", "USD -0.05"), (0, "USD", "USD 0.00"), (7, "ZZZ", "ZZZ 7 (minor units)"),
        (-9223372036854775808, "USD", "USD -92233720368547758.08"), (-7, "JPY", "JPY -7"),
    ]
    got = column(spark, [c[:2] for c in cases], "a long, c string", format_minor_units(F.col("a"), F.col("c")))
    assert got == [c[2] for c in cases]


def _ms(text):
    return int(datetime.fromisoformat(text).timestamp() * 1000)


def test_vendor_timestamp(spark):
    cases = [
        ("2026-03-08T02:30:00", "America/New_York", _ms("2026-03-08T06:30:00+00:00")),
        ("2026-10-25 02:30", "Europe/Berlin", _ms("2026-10-25T01:30:00+00:00")),
        ("2026-07-01T12:00:00.1239", "America/New_York", _ms("2026-07-01T16:00:00.123+00:00")),
        ("2026-02-30T00:00:00", "UTC", None), ("2026-13-01T00:00:00", "UTC", None), ("2026-01-01T24:00:00", "UTC", None),
        ("2026-01-01T00:00:60Z", "Nope", _ms("2026-01-01T00:00:59+00:00")), ("2026-01-01T00:00:61Z", "UTC", None),
        ("2026-01-01T00:00:00+0530", "", _ms("2025-12-31T18:30:00+00:00")),
        ("2026-01-01T00:00:00 -08:00", "", _ms("2026-01-01T08:00:00+00:00")),
        ("2026-01-01T00:00:00", "Nope", None), ("garbage", "UTC", None), (None, "UTC", None),
        (" 2026-01-01T00:00:00z ", "UTC", _ms("2026-01-01T00:00:00+00:00")),
        ("2026-01-01", "UTC", None), ("2026-01-01T00:00:00Z extra", "UTC", None),
    ]
    got = column(spark, [c[:2] for c in cases], "t string, z string", vendor_timestamp_ms(F.col("t"), F.col("z")))
    assert got == [c[2] for c in cases]


def test_local_time_follows_the_two_step_rule(spark):
    zones = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "UTC"]
    start = datetime(2026, 1, 1)
    rows = [(int((start + timedelta(minutes=97 * i)).replace(tzinfo=timezone.utc).timestamp() * 1000), z) for i in range(0, 5400, 7) for z in zones]

    def offset(ms, zone):
        moment = datetime.fromtimestamp(ms / 1000, timezone.utc).astimezone(ZoneInfo(zone))
        return int(moment.utcoffset().total_seconds() * 1000)

    def expected(ms, zone):
        first = offset(ms, zone)
        return ms - offset(ms - first, zone)

    got = column(spark, rows, "n long, z string", local_to_instant_ms(F.col("n"), F.col("z")))
    assert got == [expected(*row) for row in rows]


def test_every_known_zone_resolves(spark):
    names = time_zone_names()
    rows = [(name,) for name in names]
    assert all(column(spark, rows, "z string", is_time_zone(F.col("z"))))
    assert all(v is not None for v in column(spark, rows, "z string", zone_offset_ms(F.lit(0).cast("long"), F.col("z"))))
    assert column(spark, [("Nope",), ("",), (None,), ("europe/berlin",)], "z string", is_time_zone(F.col("z"))) == [False] * 4


def test_period_start(spark):
    rows = [(0,), (1,), (86_399_999,), (86_400_000,), (-1,)]
    assert column(spark, rows, "t long", period_start(F.col("t"), 86_400_000)) == [0, 0, 0, 86_400_000, -86_400_000]


def test_retry_after(spark):
    at = _ms("1999-12-31T23:58:59+00:00")
    cases = [
        ("120", 120_000, 120_000), (" 7 ", 7000, 7000), ("Fri, 31 Dec 1999 23:59:59 GMT", 60_000, 60_000),
        ("Fri Dec 31 23:59:59 1999", 60_000, 60_000), ("Fri, 31 Dec 1999 23:58:59 GMT", None, 9000),
        ("Sun, 06 Nov 1994 08:49:37 GMT", None, 9000), ("junk", None, 9000), ("120s", None, 9000), ("+120", None, 9000),
        ("1.5", None, 9000), ("", None, 9000), ("0", 0, 9000), ("Fri, 31 Feb 1999 23:59:59 GMT", None, 9000),
    ]
    rows = [(c[0], at) for c in cases]
    assert column(spark, rows, "h string, t long", retry_after_ms(F.col("h"), F.col("t"))) == [c[1] for c in cases]
    assert column(spark, rows, "h string, t long", hold_ms(F.lit(200), F.col("h"), F.col("t"), 9000)) == [c[2] for c in cases]
    absent = [(None, 429), (None, 200), (None, 503)]
    assert column(spark, absent, "h string, s int", hold_ms(F.col("s"), F.col("h"), F.lit(0).cast("long"), 9000)) == [9000, None, None]


def test_header_dates(spark):
    at = _ms("1994-11-06T08:49:37+00:00")
    cases = {
        "Sun, 06 Nov 1994 08:49:37 GMT": at, "Sunday, 06-Nov-94 08:49:37 GMT": at, "Sun Nov  6 08:49:37 1994": at, "1994-11-06T08:49:37Z": at,
        "1994-11-06T09:49:37.25+01:00": at + 250, "1994-11-06 08:49:37": at, "1994-11-06": at - 31_777_000, "6 November 1994 08:49 UTC": at - 37_000,
        "Nov 6, 1994 03:49:37 EST": at, "sun, 06 nov 1994 00:49:37 PST": at, "Sun Nov 06 1994 08:49:37 GMT+0000": at, "11/6/1994 08:49:37": at,
        "Sun, 06 Nov 1994 08:49:37 -0130": at + 5_400_000, "06 Nov 2094 08:49:37 GMT": _ms("2094-11-06T08:49:37+00:00"),
        "06-Nov-31 08:49:37 GMT": _ms("2031-11-06T08:49:37+00:00"), "1994-13-06T08:49:37Z": None, "1994-02-30": None, "06 Nox 1994": None,
        "06 Nov 1994 24:00:00 GMT": None, "1994": None, "": None, None: None, "soon": None, "06 Nov 1994 08:49:37 GMT x": None,
    }
    assert dict(zip(cases, column(spark, [(c,) for c in cases], "h string", header_date_ms(F.col("h"))), strict=True)) == cases


def test_status_classes(spark):
    rows = [(200,), (204,), (301,), (404,), (429,), (500,)]
    assert column(spark, rows, "s int", is_failure(F.col("s"))) == [False, False, False, True, True, True]
    assert column(spark, rows, "s int", robots_status_class(F.col("s"))) == ["rules", "rules", "unreachable", "unavailable", "unavailable", "unreachable"]
    assert column(spark, rows, "s int", is_robots_failure(F.col("s"))) == [False, False, True, False, False, True]


def test_redaction(spark):
    cases = [
        ("https://u:p@h.example/x?Token=abc&z=1", "https://[redacted]@h.example/x?Token=[redacted]&z=1"),
        ("see http://h/?apikey=K1#f and https://h/?a=1&api_key=K2 end", "see http://h/?apikey=[redacted]#f and https://h/?a=1&api_key=[redacted] end"),
        ("monkey=1 ?monkey=2", "monkey=1 ?monkey=2"),
        ("https://h/path@x", "https://h/path@x"),
    ]
    assert column(spark, [(c[0],) for c in cases], "t string", redact_credentials(F.col("t"))) == [c[1] for c in cases]
    text = "posted https://hook.example/secret/p?x=1, then https://hook.example:8443/secret/q. key s3cret $1"
    got = column(spark, [(text,)], "t string", scrub(F.col("t"), "s3cret", "https://hook.example/secret/p"))
    assert got == ["posted https://hook.example, then https://hook.example. key [redacted] $1"]


def test_connection_passwords(spark):
    rows = [("postgres://me:pw@db:5432/x",), ("postgres://db/x",), ("postgres://me@db/x",)]
    want = ["postgres://me:***@db:5432/x", "postgres://db/x", "postgres://me@db/x"]
    assert column(spark, rows, "u string", hide_password(F.col("u"))) == want


def test_links(spark):
    cases = [
        (None, None), ("", None), ("  ", None), ("/item/1", None), ("javascript:alert(1)", None), ("ftp://h/x", None),
        ("https://shop.example/item?token=abc", None), ("https://u:p@shop.example/item", None), ("https://", None),
        ("https://shop.example/" + "x" * 2048, None), (" https://shop.example/item/1 ", "https://shop.example/item/1"),
        ("HTTP://shop.example:8080/a?b=c#d", "HTTP://shop.example:8080/a?b=c#d"),
    ]
    assert column(spark, [(c[0],) for c in cases], "u string", usable_link(F.col("u"))) == [c[1] for c in cases]
    urls = [("https://Shop.Example:443/x",), ("http://u@h.example:81/",), ("nothing",), ("mailto:a@b",)]
    assert column(spark, urls, "u string", url_origin(F.col("u"))) == ["https://shop.example", "http://h.example:81", None, None]
    assert column(spark, urls, "u string", host_key(F.col("u"))) == ["shop.example", "h.example", None, None]
    assert column(spark, urls, "u string", carries_userinfo(F.col("u"))) == [False, True, False, False]
    assert column(spark, urls, "u string", channel_origin(F.col("u")))[2:] == ["the configured channel"] * 2


def test_bounding(spark):
    rows = [("x" * 100,), ("y" * 101,), ("",)]
    got = column(spark, rows, "t string", bound_text(F.col("t"), 100))
    assert got[0] == "x" * 100 and got[2] == ""
    assert len(got[1]) == 100 and got[1].endswith("\n<!-- truncated at 100 characters -->")
    texts = [(" a\n b\t c ",), ("\n ",), ("z" * 201,)]
    assert column(spark, texts, "t string", summarise(F.col("t"))) == ["a b c", "the body was empty.", "z" * 200 + "..."]
    assert column(spark, [("a\r\nb\n",)], "t string", single_line(F.col("t"))) == ["a b"]


def test_path_patterns(spark):
    cases = [
        ("/fish", "/fishheads", True), ("/fish*.php", "/fish/x.php?y", True), ("/fish*.php$", "/fish.php", True),
        ("/fish*.php$", "/fish.php?x", False), ("/*.pdf$", "/report.pdf", True), ("/*.pdf$", "/report.pdf.html", False),
        ("/this/*/exactly", "/this/or/that/exactly", True), ("/this/path/exactly$", "/this/path/exactly/more", False),
        ("/Case/", "/case/page", False), ("/a\\Eb", "/a\\Ebc", True), ("*", "/z", True), ("/a*$", "/abc", True),
        ("/x$", "/x/x", False), ("/a.c", "/abc", False), ("/a*b*c$", "/a-b-b-c-c", True), ("/%62%61%7A%3a", "/baz%3A/1", True),
        ("/%E3%83%84", "/%e3%83%84", True), ("/a%2562", "/a%2562", True), ("/%41%zz", "/A%zz", True), ("$", "/", False),
    ]
    expression = F.rlike(normalise_path(F.col("u")), path_regex(normalise_path(F.col("p"))))
    assert column(spark, [c[:2] for c in cases], "p string, u string", expression) == [c[2] for c in cases]
    fits = path_fits(normalise_path(F.col("u")), path_pieces(normalise_path(F.col("p"))))
    assert column(spark, [c[:2] for c in cases], "p string, u string", fits) == [c[2] for c in cases]


def test_pieces_and_expressions_agree(spark):
    dice = random.Random(2)
    pick = lambda letters, most: "".join(dice.choice(letters) for _ in range(dice.randint(0, most)))
    rows = [("/" + pick("ab*é", 5) + dice.choice(["", "$", "*$", "*"]), "/" + pick("abé", 7)) for _ in range(1500)]
    got = column(spark, rows, "p string, u string", path_fits(F.col("u"), path_pieces(F.col("p"))))
    want = []
    for pattern, path in rows:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        want.append(re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + end, path) is not None)
    assert got == want and 100 < sum(got) < 1400
