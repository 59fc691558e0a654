"""Scalar text functions: value formats, trimming, masks, paths and urls. All are Catalyst expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed set: white space as the reference's script engine trims it (JavaScript rules).
JS_SPACE = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def format_mask(c: Column) -> Column:
    """A value's shape: digits as 9, lower-case Latin letters as a, upper-case ones as A, the rest as it is."""
    return F.translate(c, string.digits + string.ascii_lowercase + string.ascii_uppercase, "9" * 10 + "a" * 26 + "A" * 26)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def remove_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{JS_SPACE}+", "")


def int_or_null(c: Column) -> Column:
    """The integer that a text begins with, after white space; null if it begins with none."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def mask(c: Column, head: int, tail: int) -> Column:
    """All but the first `head` and last `tail` signs as stars; wholly stars if the text is no longer than both."""
    n = F.length(c)
    hidden = F.concat(F.substring(c, 1, head), F.repeat(F.lit("*"), n - head - tail), F.right(c, F.lit(tail)) if tail else F.lit(""))
    return F.when(n <= head + tail, F.repeat(F.lit("*"), n)).otherwise(hidden)


def mask_email(c: Column, head: int, tail: int) -> Column:
    """Masks the part before the first @ and keeps the domain; without a part before an @ the whole text is masked."""
    at = F.instr(c, "@")
    local = F.substring_index(c, "@", 1)
    return F.when(at <= 1, mask(c, head, tail)).otherwise(F.concat(mask(local, head, tail), F.substring(c, at, F.length(c))))


def digest12(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def excerpt(c: Column) -> Column:
    return F.substring(F.trim(c), 1, 160)


def line_count(c: Column) -> Column:
    """Lines of a text; a line end at its end begins no further line; an empty text has none."""
    return F.when(F.length(c) == 0, 0).otherwise(F.size(F.split(c, "\n")) - F.when(c.endswith("\n"), 1).otherwise(0))


def url_normalise(c: Column) -> Column:
    """Trimmed and cut at the query; null if nothing is left."""
    return F.nullif(F.trim(F.substring_index(F.trim(c), "?", 1)), F.lit(""))


def url_module(c: Column) -> Column:
    """The first two parts of a url's path, its last part and query not counted; '/' if there are none."""
    parts = F.filter(F.split(F.substring_index(c, "?", 1), "/"), lambda x: x != "")
    kept = F.slice(parts, 1, F.least(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(F.size(kept) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def folder_at(path: Column, depth: int, root: str = "(root)") -> Column:
    """The first `depth` folders of a path without its file name; the root's label if it has none."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(F.size(folders) == 0, root).otherwise(F.array_join(folders, "/"))


def type_normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"\(.*?\)", " "), r"\s+", " "))
