"""Exact money: decimal text to integer minor units and back, with no floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITESPACE, trim_all

# The ISO 4217 codes that are recognised, by minor-unit exponent.
EXPONENT_0 = (
    "BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF"
).split()
EXPONENT_2 = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF "
    "CNY COP CRC CUP CVE CZK DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GTQ GYD HKD HNL HTG HUF "
    "IDR ILS INR IRR JMD KES KGS KHR KPW KYD KZT LAK LBP LKR LRD LSL MAD MDL MKD MMK MNT MOP MUR MVR MWK MXN "
    "MYR MZN NAD NGN NIO NOK NPR NZD PAB PEN PGK PHP PKR PLN QAR RON RSD RUB SAR SBD SCR SDG SEK SGD SHP SOS "
    "SRD SSP STN SVC SYP SZL THB TJS TMT TOP TRY TTD TWD TZS UAH USD UZS VES WST XCD YER ZAR ZMW"
).split()
EXPONENT_3 = "BHD IQD JOD KWD LYD OMR TND".split()
EXPONENT_4 = "CLF UYW".split()
# The symbols that may decorate a price.
CURRENCY_SYMBOLS = "$€£¥₩₹₽₦₱฿₪"

PLAIN_OR_GROUPED = r"\A(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?\z"


_PLACES = "map({})".format(
    ", ".join(
        f"'{code}', {places}"
        for places, codes in ((2, EXPONENT_2), (0, EXPONENT_0), (3, EXPONENT_3), (4, EXPONENT_4))
        for code in codes
    )
)


def clean_code(code: Column) -> Column:
    """A currency code as it is looked up: trimmed, in upper case."""
    return F.upper(trim_all(code))


def minor_unit_exponent(code: Column) -> Column:
    """Decimal places of a currency, or null for a code that is not recognised."""
    return F.try_element_at(F.expr(_PLACES), clean_code(code))


def normalise_currency(code: Column) -> Column:
    """The upper-case code, or null for one that is not recognised."""
    return F.when(minor_unit_exponent(code).isNotNull(), clean_code(code))


def with_code(df: DataFrame, currency: Column) -> DataFrame:
    """`df` with `_code` and `_places`, so that the expressions below look them up once per row."""
    return df.withColumn("_code", clean_code(currency)).withColumn(
        "_places", F.try_element_at(F.expr(_PLACES), F.col("_code"))
    )


def strip_decoration(price: Column, code: Column) -> Column:
    """Price text without whitespace, outer symbols and one copy of the clean code on each side."""
    has_code = F.length(code) == 3
    text = F.btrim(F.translate(price, WHITESPACE, ""), F.lit(CURRENCY_SYMBOLS))
    starts = has_code & (F.upper(F.left(text, F.lit(3))) == code)
    text = F.when(starts, F.substr(text, F.lit(4))).otherwise(text)
    ends = has_code & (F.length(text) >= 3) & (F.upper(F.right(text, F.lit(3))) == code)
    return F.when(ends, F.left(text, F.length(text) - 3)).otherwise(text)


def to_minor_units(
    price: Column, currency: Column, code: Column | None = None, places: Column | None = None
) -> Column:
    """Exact minor units, or null where the text or the currency allows none.

    Digits past the exponent must be zeros; nothing is rounded and no sign is
    accepted. An amount beyond 64 bits is null as well.
    """
    exponent = minor_unit_exponent(currency) if places is None else places
    text = strip_decoration(price, clean_code(currency) if code is None else code)
    digits = F.translate(text, ",", "")
    whole = F.substring_index(digits, ".", 1)
    fraction = F.substr(digits, F.length(whole) + 2)
    kept = F.rpad(F.left(fraction, exponent), exponent, "0")
    dropped = F.substr(fraction, exponent + 1)
    exact = text.rlike(PLAIN_OR_GROUPED) & ~dropped.rlike("[^0]")
    return F.when(exact, F.concat(whole, kept).try_cast("bigint"))


def format_minor_units(
    amount: Column, currency: Column, code: Column | None = None, places: Column | None = None
) -> Column:
    """Minor units as `CODE 12.99`, placed by the currency's own exponent."""
    code = clean_code(currency) if code is None else code
    exponent = minor_unit_exponent(currency) if places is None else places
    plain = amount.cast("string")
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.ltrim(plain, F.lit("-"))
    padded = F.lpad(digits, F.greatest(F.length(digits), exponent + 1), "0")
    point = F.length(padded) - exponent
    return (
        F.when(exponent.isNull(), F.concat(code, F.lit(" "), plain, F.lit(" (minor units)")))
        .when(exponent == 0, F.concat(code, F.lit(" "), plain))
        .otherwise(
            F.concat(code, F.lit(" "), sign, F.left(padded, point), F.lit("."), F.right(padded, exponent))
        )
    )


def shown(amount: str) -> Column:
    """An amount of a table that `with_code` has prepared, as text."""
    return format_minor_units(F.col(amount), F.col("_code"), F.col("_code"), F.col("_places"))


def exact(price: str | Column) -> Column:
    """A price text of a table that `with_code` has prepared, as minor units."""
    text = F.col(price) if isinstance(price, str) else price
    return to_minor_units(text, F.col("_code"), F.col("_code"), F.col("_places"))
