"""Natural order, numbers as text, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(s: Column, width: int = 20) -> Column:
    """A text that sorts as s does when its numbers count as numbers: digit runs padded with zeros."""
    parts = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def padded(n: Column, digits: int) -> Column:
    """n with zeros in front, at least digits long."""
    t = n.cast("string")
    return F.when(F.length(t) >= digits, t).otherwise(F.lpad(t, digits, "0"))


def wildcard(s: Column, pattern: str) -> Column:
    """Whether s matches a pattern with * (any text) and ? (one character)."""
    made = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return s.rlike(f"^(?s:{made})$")


#: What a path may begin with, and the kind of file that it says.
PROTOCOLS = {"ascii": "ascii", "bin": "binary"}


def protocol(path: Column) -> Column:
    """"none" without "name://", the kind that the name says, or "unknown"."""
    name = F.regexp_extract(path, "^([^:/]*)://", 1)
    found = F.when(~path.rlike("^[^:/]*://"), "none")
    for k, v in PROTOCOLS.items():
        found = found.when(name == k, v)
    return found.otherwise("unknown")


def without_protocol(path: Column) -> Column:
    return F.regexp_replace(path, "^[^:/]*://", "")


def basename(path: Column, extensions: int = 1) -> Column:
    """What follows the last /, without the last extensions (up to so many)."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, "(\\.[^.]*){1,%d}$" % extensions, "") if extensions else name


def fill_wildcard(pattern: Column, by: Column, wild: str = "*", escape: str = "\\") -> Column:
    """pattern with each wild character replaced by ``by``; one behind an escape stays, without it."""
    parts = F.split(pattern, re.escape(escape + wild), -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(wild), by)), wild)


def last_place(text: Column, char: str) -> Column:
    """Place of the last char in text, from 0; -1 without it."""
    back = F.instr(F.reverse(text), char)
    return F.when(back == 0, -1).otherwise(F.char_length(text) - back)


def compare_caseless(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order of the lower-cased texts."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
