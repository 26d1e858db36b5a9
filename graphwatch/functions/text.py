"""Column-level text helpers (all built-in expressions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_g(x: Column) -> Column:
    """C/Python ``%g``: 6 significant digits, trailing zeros stripped, scientific
    notation when the decimal exponent is below -4 or at least 6.

    Java's ``%g`` keeps trailing zeros, so it is rebuilt from ``%.5e``.
    Rounding follows Java's formatter (half-up on the shortest decimal form).
    """
    sci = F.format_string("%.5e", x)
    exp = F.split(sci, "e").getItem(1).cast("int")
    mant = F.regexp_replace(F.regexp_replace(F.split(sci, "e").getItem(0), "0+$", ""), "\\.$", "")
    exp_txt = F.concat(F.when(exp < 0, "-").otherwise("+"),
                       F.lpad(F.abs(exp).cast("string"), 2, "0"))
    scientific = F.concat(mant, F.lit("e"), exp_txt)
    fixed = None
    for e in range(-4, 6):
        txt = F.format_string(f"%.{5 - e}f", x)
        fixed = F.when(exp == e, txt) if fixed is None else fixed.when(exp == e, txt)
    fixed_trim = F.when(fixed.contains("."),
                        F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "")
                        ).otherwise(fixed)
    out = F.when((exp < -4) | (exp >= 6), scientific).otherwise(fixed_trim)
    return (F.when(x.isNull(), F.lit(None))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf"))
            .when(x == 0, F.when(F.format_string("%s", x).startswith("-"), "-0").otherwise("0"))
            .otherwise(out))


def strip(text: Column) -> Column:
    """``text`` without the white space (blanks, tabs, line ends) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_path_segment(path: Column) -> Column:
    """``/a/b`` -> ``a``; ``/`` or ``//`` -> ``/``; a query string stays (``/?q=1`` -> ``?q=1``)."""
    seg = F.split(F.btrim(path, F.lit("/")), "/").getItem(0)
    return F.coalesce(F.nullif(seg, F.lit("")), F.lit("/"))


# Request target inside a log line: the token after an upper-case method in quotes.
REQUEST_TARGET_PATTERN = r'"[A-Z]+\s+(\S+)'


def request_target(line: Column) -> Column:
    """The request target of a log line, or null when the line has none."""
    t = F.regexp_extract(line, REQUEST_TARGET_PATTERN, 1)
    return F.when(line.rlike(REQUEST_TARGET_PATTERN), t)


def parse_json_strict(text: Column) -> Column:
    """``try_parse_json`` that also rejects trailing content after the first value.

    Spark's parser stops after one complete value; wrapping the text in
    ``[...]`` makes trailing content a syntax error (or a second element).
    """
    arr = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.try_variant_get(arr, "$[0]", "variant")
    second = F.try_variant_get(arr, "$[1]", "variant")
    return F.when(first.isNotNull() & second.isNull(), first)


def elapsed_stamp(window_no: Column, window_seconds: int = 5, speed: float = 1.0,
                  live: bool = False) -> Column:
    """``mm:ss`` elapsed at a window: ``window × seconds`` (live mode counts from
    index + 1); with a replay ``speed`` other than 1 both parts are divided by it
    and rounded half-to-even, as the console stamp does."""
    w = (window_no + 1) if live else window_no
    secs = w * F.lit(int(window_seconds))
    if speed == 1.0:
        return F.format_string("%02d:%02d", F.floor(secs / 60).cast("long"), (secs % 60).cast("long"))
    scaled = secs / F.lit(float(speed))
    return F.format_string("%02d:%02d", F.bround(scaled / 60, 0).cast("long"),
                           F.bround(scaled % 60, 0).cast("long"))
