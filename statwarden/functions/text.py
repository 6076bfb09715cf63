"""String helpers with the naming rules of bracket-quoted identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = 128  # fixed value: longest identifier, in characters


def quote_name(name: Column) -> Column:
    """``a]b`` -> ``[a]]b]``; NULL when the name is too long to be an identifier."""
    quoted = F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))
    return F.when(F.length(name) <= MAX_NAME, quoted)


def dotted_parts(name: Column) -> Column:
    """Parts of a dotted name; dots inside brackets do not separate."""
    return F.split(name, r"\.(?![^\[]*\])", -1)


def _unbracket(part: Column) -> Column:
    inner = F.replace(F.substr(part, F.lit(2), F.length(part) - 2), F.lit("]]"), F.lit("]"))
    return F.when(part.startswith("[") & part.endswith("]"), inner).otherwise(part)


def name_part(name: Column, position: int) -> Column:
    """Part ``position`` counted from the right (1 = last).

    NULL when the name has more than four parts, or the part is missing, empty
    or too long.
    """
    parts = dotted_parts(name)
    part = _unbracket(F.get(F.reverse(parts), F.lit(position - 1)))
    return F.when((F.size(parts) <= 4) & F.length(part).between(1, MAX_NAME), part)


def list_tokens(text: Column) -> Column:
    """Trimmed tokens of a comma list, empty ones kept so they can be reported."""
    return F.transform(F.split(text, ",", -1), lambda token: F.trim(token))


def has_empty_token(text: Column) -> Column:
    compact = F.regexp_replace(text, "[ \t\r\n]", "")
    return compact.startswith(",") | compact.endswith(",") | compact.contains(",,") | (F.length(compact) == 0)


def length_without_trailing_blanks(text: Column) -> Column:
    return F.length(F.rtrim(text))


def is_blank(text: Column) -> Column:
    return F.length(F.trim(text)) == 0
