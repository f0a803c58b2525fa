"""Column helpers for whole-text work that stay inside the JVM."""

import functools
import operator

from pyspark.sql import Column, functions as F

NL = "\n"


def rx(pattern: str, flags: str = "") -> str:
    """Pattern with Unix lines and Unicode classes, as the scanned text expects."""
    return f"(?{flags}dU){pattern}"


def has(col, pattern: str, flags: str = "") -> Column:
    return F.rlike(col, F.lit(rx(pattern, flags)))


def holds(col, words) -> Column:
    """Does the text hold one of the words? A plain search that spares most texts a pattern."""
    return functools.reduce(operator.or_, [F.contains(col, F.lit(w)) for w in words])


def count_of(col, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(col, F.lit(rx(pattern, flags)))


def all_of(col, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, flags)), F.lit(group))


def group_of(col, pattern: str, group: int, flags: str = "") -> Column:
    return F.regexp_extract(col, rx(pattern, flags), group)


def newlines(col) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(NL), F.lit("")))


def lines_of(col) -> Column:
    return F.split(col, NL)


def nonblank(col) -> Column:
    return F.length(F.trim(F.translate(col, "\t\r\f\v\n", "     "))) > 0


def strip(col) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(col, rx(r"\A\s+|\s+\z"), "")


def words_list(text, sep=",") -> Column:
    """Split on ``sep``, trim, drop empty parts."""
    return F.filter(F.transform(F.split(text, sep), lambda p: F.trim(F.translate(p, "\t\n\r", "   "))),
                    lambda p: p != "")


def let(value, body) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slice_lines(lines, first, last) -> Column:
    """Lines ``first..last`` (1-based, inclusive) of an array, clipped to it."""
    return F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0)))


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(mapping: dict, key) -> Column:
    """Value of a small fixed mapping, null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def empty_to_null(col) -> Column:
    return F.when(col != "", col)
