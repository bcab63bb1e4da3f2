"""String expressions over descriptions, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n]"
#: What counts as white space in Unicode, the separators of ASCII too.
ANY_SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Words that open a description and say nothing about the tool.
OPENERS = r"(?i)^([ \t\r\n]*(optional|required|output only|deprecated|read-only)\b[.:]?[ \t\r\n]*)+"


def first_sentence(text: Column, length: int = 140) -> Column:
    """The first sentence without opening boilerplate, cut to a length; '' for null."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", ""), OPENERS, "")
    return F.regexp_replace(F.substring(F.element_at(F.split(body, rf"(?<=[.!?]){SPACE}", 2), 1), 1, length), rf"{SPACE}+$", "")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def root_segment(call: Column) -> Column:
    return F.substring_index(call, ".", 1)


def distinct_words(query: Column) -> Column:
    """The different lower-case words of a query, between white space of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(query), rf"{ANY_SPACE}+"), lambda w: w != ""))


def plain_name(name: Column) -> Column:
    return F.lower(F.translate(name, "_", " "))


def tool_text(name: Column, description: Column) -> Column:
    """What stands for a tool when it is embedded."""
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def unquoted(x: Column) -> Column:
    """Without the quotation marks around it."""
    return F.btrim(x, F.lit("'\"`"))
