"""Reading loosely typed JSON, as SQL text over VARIANT expressions.

These are pieces of SQL rather than columns because they are used inside lambdas
and nest deeply: one parsed string keeps a plan quick to build.
"""

from __future__ import annotations

from tidemark.functions.text import WHITESPACE

BLANKS = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"


def wrapped(text: str) -> str:
    """A document inside an array that ends in a marker.

    The parser stops after the first value and ignores what follows it; with the
    marker missing or misplaced, `unwrapped` knows that the text was not one value.
    """
    return f"""try_cast(try_parse_json(concat('[', {text}, ',"end"]')) AS array<variant>)"""


def unwrapped(array: str) -> str:
    """The document of a `wrapped` array; null where its text was not exactly one value."""
    return f"CASE WHEN size({array}) = 2 AND try_cast({array}[1] AS string) = 'end' THEN {array}[0] END"


def trim_sql(text: str) -> str:
    """Trim every kind of whitespace."""
    return f"btrim({text}, {BLANKS})"


def field(node: str, name: str) -> str:
    """A member of a JSON object as a variant; null when absent or when it is no object."""
    return f"""try_variant_get({node}, '$["{name}"]', 'variant')"""


def as_object(node: str) -> str:
    """A JSON object as a map, null for anything else."""
    return f"try_cast({node} AS map<string,variant>)"


def as_array(node: str) -> str:
    """A JSON array as an array, null for anything else."""
    return f"try_cast({node} AS array<variant>)"


def is_kind(node: str, kind: str) -> str:
    """Whether a value is a JSON `string`, `number` or `boolean`; false for null."""
    shapes = {"string": "STRING", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL|TINYINT|SMALLINT|INT)", "boolean": "BOOLEAN"}
    return f"coalesce(schema_of_variant({node}) RLIKE '^{shapes[kind]}', false)"


def number_text(number: str) -> str:
    """A double in plain shortest form; null where that form needs an exponent."""
    plain = f"regexp_replace(cast(try_cast({number} AS decimal(38,18)) AS string), '[.]?0+$', '')"
    return f"CASE WHEN {number} = 0 THEN '0' WHEN abs({number}) >= 1e-6 AND abs({number}) < 1e21 THEN {plain} END"


def plain_scalar(node: str) -> str:
    """A trimmed non-empty string, or a number in plain form."""
    return (
        f"CASE WHEN {is_kind(node, 'string')} THEN nullif({trim_sql(f'try_cast({node} AS string)')}, '') "
        f"WHEN {is_kind(node, 'number')} THEN {number_text(f'try_cast({node} AS double)')} END"
    )


def scalar(node: str) -> str:
    """A plain scalar, or the one inside `{"@id": …}` or `{"@value": …}`."""
    named, inner = field(node, "@id"), field(node, "@value")
    return (
        f"coalesce({plain_scalar(node)}, "
        f"CASE WHEN {is_kind(named, 'string')} THEN {trim_sql(f'try_cast({named} AS string)')} END, "
        f"{plain_scalar(inner)})"
    )
