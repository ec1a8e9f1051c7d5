"""robots files as rows, and the decision for every URL of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.instants import robots_status_class
from tidemark.functions.text import trim_all, url_origin
from tidemark.operators.skew import HOT_ROWS, attach

# Field names, the path that is always open, and the octets that need no escape.
AGENT_FIELDS = ("user-agent", "useragent")
RULE_FIELDS = ("allow", "disallow")
ROBOTS_PATH = "/robots.txt"
UNRESERVED = r"\A[A-Za-z0-9\-._~]\z"


def normalise_path(path: Column) -> Column:
    """Escaped unreserved octets decoded, other escapes in upper case, in one pass."""

    def decoded(token: Column) -> Column:
        octet = F.char(F.conv(F.substring(token, 2, 2), 16, 10).cast("int"))
        return F.when(~token.rlike(r"\A%[0-9A-Fa-f]{2}\z"), token).when(octet.rlike(UNRESERVED), octet).otherwise(F.upper(token))

    tokens = F.regexp_extract_all(path, F.lit("%[0-9A-Fa-f]{2}|[^%]+|%"), F.lit(0))
    return F.array_join(F.transform(tokens, decoded), "")


def path_regex(pattern: Column) -> Column:
    """A path pattern as an anchored regular expression.

    Each literal piece is found as early as possible and never given back, which
    is exact for wildcards and linear in the length of the path.
    """
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    literal = lambda text: F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.split(body, r"\*", -1)
    first = literal(F.element_at(pieces, 1))
    many = F.size(pieces) > 1
    inner = F.when(F.size(pieces) > 2, F.slice(pieces, F.lit(2), F.size(pieces) - 2)).otherwise(F.array().cast("array<string>"))
    middle = F.array_join(F.transform(inner, lambda piece: F.concat(F.lit("(?>.*?"), literal(piece), F.lit(")"))), "")
    last = F.when(many, F.concat(F.lit(".*"), literal(F.element_at(pieces, -1)))).otherwise(F.lit(""))
    end = F.when(anchored, F.lit(r"\z")).otherwise(F.lit(""))
    return F.concat(F.lit(r"(?s)\A"), first, middle, last, end)


def path_pieces(pattern: Column) -> Column:
    """A normalised path pattern as what `path_fits` looks for: `head`, the `inner` pieces, and `tail` where `$` ends it."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    pieces = F.split(body, r"\*", -1)
    many = F.size(pieces) > 1
    # The last piece of an anchored pattern is its tail; a pattern without a wildcard has no other piece than its head.
    between = F.when(many, F.slice(pieces, F.lit(2), F.size(pieces) - 1 - anchored.cast("int"))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.element_at(pieces, 1).alias("head"),
        F.filter(between, lambda piece: piece != "").alias("inner"),
        F.when(anchored & many, F.element_at(pieces, -1)).alias("tail"),
        (anchored & ~many).alias("whole"),
    )


def path_fits(path: Column, pieces: Column) -> Column:
    """Whether a path fits the pieces: each is found as early as possible, which is exact for wildcards.

    Plain comparisons and searches, so nothing is compiled for a URL and a rule; most rules are a head alone.
    """
    start = F.length(pieces["head"]) + 1

    def found(at: Column, piece: Column) -> Column:
        place = F.call_function("locate", piece, path, at)
        return F.when((at > 0) & (place > 0), place + F.length(piece)).otherwise(F.lit(0))

    end = F.when(F.size(pieces["inner"]) == 0, start).otherwise(F.aggregate(pieces["inner"], start, found))
    rest = pieces["tail"].isNull() | (F.endswith(path, pieces["tail"]) & (F.length(path) - F.length(pieces["tail"]) + 1 >= end))
    return F.when(pieces["whole"], path == pieces["head"]).otherwise(F.startswith(path, pieces["head"]) & (end > 0) & rest)


def robots_lines(robots: DataFrame) -> DataFrame:
    """Files (`origin, status, body, truncated`) to one row per field line.

    Comments and lines without a colon are gone; a truncated file loses its last
    line, which may be half a rule.
    """
    lines = F.split("body", "\r\n|\r|\n", -1)
    kept = F.when(F.col("truncated"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    rows = robots.where(robots_status_class(F.col("status")) == "rules").select(
        "origin", F.posexplode(kept).alias("line_no", "raw")
    )
    line = trim_all(F.substring_index("raw", "#", 1))
    colon = F.instr(line, ":")
    return rows.select(
        "origin", "line_no",
        F.lower(trim_all(F.left(line, colon - 1))).alias("field"),
        trim_all(F.substr(line, colon + 1)).alias("value"),
        colon.alias("colon"),
    ).where("colon > 0").drop("colon")


def robots_rules(robots: DataFrame) -> DataFrame:
    """Files to rows of `origin, group_no, line_no, is_agent, kind, value`.

    Agent lines in a row share a group, and an agent line after a rule opens the
    next one. Rules before the first agent line belong to nobody. A file is
    bounded by its parsing limit, so a window per origin is too.
    """
    in_file = W.partitionBy("origin").orderBy("line_no")
    rows = robots_lines(robots).where(F.col("field").isin(*AGENT_FIELDS, *RULE_FIELDS))
    rows = rows.withColumn("is_agent", F.col("field").isin(*AGENT_FIELDS))
    opens = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(in_file), F.lit(False))
    rows = rows.withColumn("opens", opens.cast("int"))
    return rows.select(
        "origin", F.sum("opens").over(in_file).alias("group_no"), "line_no", "is_agent",
        F.when(~F.col("is_agent"), F.col("field")).alias("kind"),
        F.when(F.col("is_agent"), F.lower("value")).otherwise(F.col("value")).alias("value"),
    ).where("group_no > 0")


def robots_other_records(robots: DataFrame) -> DataFrame:
    """Fields that are neither agent nor rule, such as sitemaps."""
    return robots_lines(robots).where(~F.col("field").isin(*AGENT_FIELDS, *RULE_FIELDS))


def selected_rules(robots: DataFrame, token: str) -> DataFrame:
    """The rules that apply to one product token: all groups naming it, else all `*` groups."""
    group = W.partitionBy("origin", "group_no")
    rows = robots_rules(robots).select(
        "*",
        F.max(F.col("is_agent") & (F.col("value") == token.lower())).over(group).alias("named"),
        F.max(F.col("is_agent") & (F.col("value") == "*")).over(group).alias("star"),
    )
    rows = rows.withColumn("any_named", F.max("named").over(W.partitionBy("origin")))
    applies = F.when(F.col("any_named"), F.col("named")).otherwise(F.col("star"))
    return rows.where(applies & ~F.col("is_agent")).select("origin", "line_no", "kind", F.col("value").alias("pattern"))


def robots_decide(urls: DataFrame, robots: DataFrame, token: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`allowed`, `disallowed`, `unreachable` or `unfetched` for every row of `urls` (column `url`).

    The rules of an origin come as one array bounded by its file, so a URL meets
    its rules inside its own row and no pair of URL and rule is ever a row.
    """
    rules = selected_rules(robots, token).where(F.length("pattern") > 0)
    rule = F.struct(
        F.octet_length("pattern").alias("octets"),
        (F.col("kind") == "allow").alias("allow"),
        (-F.col("line_no")).alias("turn"),
        "pattern",
        path_pieces(normalise_path(F.col("pattern"))).alias("pieces"),
    )
    per_origin = rules.groupBy("origin").agg(F.collect_list(rule).alias("rules"))
    files = robots.select("origin", robots_status_class(F.col("status")).alias("file")).join(per_origin, "origin", "left")
    tail = F.regexp_replace(F.regexp_replace("url", r"(?s)#.*\z", ""), r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    path = F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))
    asked = urls.withColumn("origin", url_origin(F.col("url"))).withColumn("path", normalise_path(path))
    rows = attach(asked, files, ["origin"], hot_rows=hot_rows)
    matching = F.filter("rules", lambda r: path_fits(F.col("path"), r["pieces"]))
    # The most octets win, and an allow wins a tie.
    rows = rows.withColumn("best", F.array_max(matching))
    ruled = (F.col("file") == "rules") & (F.col("path") != ROBOTS_PATH)
    decision = (
        F.when(F.col("file").isNull(), F.lit("unfetched"))
        .when(F.col("file") == "unreachable", F.lit("unreachable"))
        .when(ruled & ~F.col("best.allow"), F.lit("disallowed"))
        .otherwise(F.lit("allowed"))
    )
    return rows.select(
        *urls.columns, "origin", "path", decision.alias("decision"),
        F.when(ruled, F.col("best.pattern")).alias("pattern"),
    )
