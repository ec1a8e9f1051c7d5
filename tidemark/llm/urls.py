"""URL filters: rules on host and path, and equivalence of URLs over redirect and canonical-link edges.

Only DataFrame functions; the components come from rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.llm.components import components

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title)\b.*?(?:</\1\s*>|\z)"
_TAGS = r"(?is)<(?:link|meta)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_ATTRIBUTES = r"(?s)([^\s\"'<>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"
_DELAYED = r"(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.*?)\s*$"
_NAMED = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, ASCII letters in lower case; empty without "://"."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form that a site's redirects lead to: host in lower case, no scheme, fragment, tracking or closing slash."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w+|ref)=")), "&")
    short = F.regexp_replace(path(url), r"(\.html?|/)$", "")
    return F.concat(host(url), short, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def decoded(value: Column) -> Column:
    """`value` with the character references that occur in URLs (numbers and the five of markup) as characters."""

    def piece(after: Column) -> Column:
        digits, hexadecimal = F.regexp_extract(after, r"^#(\d{1,7});", 1), F.regexp_extract(after, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("long"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # Four bytes of a number are its character in UTF-32.
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        shown = F.when(valid, F.concat(character, F.regexp_replace(after, r"^#[^;]*;", "")))
        for name, sign in _NAMED:
            shown = shown.when(after.startswith(name + ";"), F.concat(F.lit(sign), F.substr(after, F.lit(len(name) + 2))))
        return shown.otherwise(F.concat(F.lit("&"), after))

    pieces = F.split(value, "&")
    read = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), piece), ""))
    return F.when(value.contains("&"), read).otherwise(value)


def without_dots(where: Column) -> Column:
    """A path without its "." and ".." steps; steps above the top are dropped."""
    steps = F.split(where, "/")
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        F.slice(steps, F.lit(2), F.size(steps)),
        empty,
        lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    end = F.when(where.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(where.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"), end)).otherwise(where)


def target(url: Column, link: Column) -> Column:
    """The absolute form of a link found on the page at `url`; null if there is none or it names no page."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    base = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    link = F.trim(F.regexp_replace(F.coalesce(link, F.lit("")), r"[\t\r\n]", ""))
    steps, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*/)", 1)
    absolute = F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(link)
    whole = F.concat(F.regexp_extract(absolute, r"(?s)^(.*?://[^/?#]*)", 1), without_dots(path(absolute)), F.regexp_extract(absolute, r"(?s)^[^?#]*(.*)$", 1))
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://") | link.startswith("//"), whole)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit(None))
        .when(link.startswith("?"), F.concat(site, base, link))
        .when(link.startswith("/"), F.concat(site, without_dots(steps), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, steps)), rest))
    )


def rule_of(site: Column, where: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((site == name) | site.endswith("." + name)) & where.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if it has none."""
    inside = F.regexp_replace(tag, r"^<\w+", "")
    names, values = (F.regexp_extract_all(inside, F.lit(_ATTRIBUTES), F.lit(k)) for k in (1, 2))
    value = F.element_at(values, F.array_position(F.transform(names, ascii_lower), F.lit(name)).cast("int"))
    return F.when(F.array_contains(F.transform(names, ascii_lower), name), decoded(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")))


def links(html: Column) -> Column:
    """What the canonical links and the refresh redirects of a page name, in any number and as written there.

    Comments, scripts and other text that is not markup are passed over; values may be quoted either way or not at all.
    """
    tags = F.regexp_extract_all(F.regexp_replace(html, _UNREAD, " "), F.lit(_TAGS), F.lit(0))

    def named(tag: Column) -> Column:
        is_canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(ascii_lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        is_refresh = tag.rlike("(?i)^<meta") & (ascii_lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
        delayed = F.regexp_replace(F.regexp_extract(_attribute(tag, "content"), _DELAYED, 1), r"(?s)^([\"'])(.*?)\1.*$", "$2")
        return F.when(is_canonical, _attribute(tag, "href")).when(is_refresh, delayed)

    return F.filter(F.transform(F.filter(tags, lambda t: t.rlike("(?i)canonical|refresh")), named), lambda x: F.coalesce(x, F.lit("")) != "")


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's URL form and the forms that its canonical links and its refresh redirects name."""
    rows = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    rows = rows.select("url", F.explode(links(F.col("html"))).alias("link"))
    rows = rows.select("url", target(F.col("url"), F.col("link")).alias("to")).where("to is not null")
    return rows.select(canonical(F.col("url")).alias("a"), canonical(F.col("to")).alias("b")).distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A URL that a rule fits has the rule's verdict, so an explicit allow is never overruled. Any other takes the verdict
    of its equivalents: URLs of one canonical form, and forms linked over redirect and canonical-link edges, over any
    number of steps. An allowed equivalent lets it pass, else a blocked one blocks it, else it passes. A null URL or
    one without "://" has empty host and path, no rule and no equivalents, and passes; null html has no links.
    Repeated rows are judged each, and other columns are ignored. Links are read whatever their number, resolved against
    the page's URL (a <base> is not looked at); those of other schemes than a page's, like mailto:, name none.

    Verdicts of equivalents are combined per form before they shuffle; a form that many pages share is one row.
    """
    read = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    read = read.withColumn("rule", rule).withColumn("_says", verdict)
    read = read.withColumn("_form", F.when(F.col("url").contains("://"), canonical(F.col("url"))))
    member = components(edges(pages))
    says = read.where("_form is not null and _says is not null").groupBy("_form").agg(F.max(F.when(F.col("_says") == "allow", 2).otherwise(1)).alias("said"))
    # Forms that no page has carry no verdict of their own, and most forms have no edge and stand for themselves.
    rooted = says.join(member, says["_form"] == member["node"], "left")
    root = F.coalesce("root", "_form")
    decided = rooted.groupBy(root.alias("_root")).agg(F.max("said").alias("said"))
    linked = member.join(decided, member["root"] == decided["_root"]).select(F.col("node").alias("_f"), "said")
    alone = says.join(member, says["_form"] == member["node"], "left_anti").select(F.col("_form").alias("_f"), "said")
    told = linked.unionByName(alone)
    open_ = read.where("rule is null")
    judged = open_.join(told, open_["_form"] == told["_f"], "left")
    method = F.when(F.col("said") == 1, "block").otherwise("allow")
    columns = ["page_id", "host", "path", "rule"]
    ruled = read.where("rule is not null").select(*columns, F.col("_says").alias("verdict"))
    return ruled.unionByName(judged.select(*columns, method.alias("verdict")))
