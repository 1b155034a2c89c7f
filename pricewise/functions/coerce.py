"""Typed values out of loosely typed model output.

Model replies may hold a number as 1299, "£1,299.00", "84 inches" or true. Each
helper takes two columns of a JSON value: ``t``, its type name (``schema_of_variant``:
BIGINT / DECIMAL / DOUBLE are numbers, STRING, BOOLEAN, VOID = JSON null, OBJECT,
ARRAY; null when the key is absent), and ``s``, its text (strings verbatim, others
as JSON text, null for JSON null).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes besides the ASCII space.
PY_WS = "\\t\\n\\x{0B}\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
PY_STRIP_RE = f"^[{PY_WS}]+|[{PY_WS}]+$"
# Currency signs and thousands separators dropped before parsing a number.
NUMBER_JUNK = ",$£€"
# Trailing units stripped (never converted), any case.
UNIT_SUFFIX_RE = "(?i)[" + PY_WS + "]*(cm|mm|in|inch|inches|\"|')[" + PY_WS + "]*$"
# Text that a cast to bigint may take: it skips blanks and control characters at both ends.
INTEGER_TEXT_RE = "^[\\x00-\\x20\\x7F]*[+-]?[0-9]+[\\x00-\\x20\\x7F]*$"
# Integer text whose number any bigint holds.
PLAIN_INTEGER_RE = "^-?[0-9]{1,18}$"
# A decimal literal as Python's float() reads it (inf / nan excluded on purpose).
FLOAT_TEXT_RE = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Boolean words.
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]


# The same set as literal characters, for the (regex-free) trim with a character set.
PY_WS_CHARS = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(s: Column) -> Column:
    """Python ``str.strip()``: trims Unicode whitespace, not only spaces. Text that
    starts and ends with a printable ASCII character, most of it, is taken as it is."""
    def plain(c: Column) -> Column:
        return F.ascii(c).between(33, 126)

    return F.when(plain(s) & plain(F.right(s, F.lit(1))), s).otherwise(F.trim(s, F.lit(PY_WS_CHARS)))


def is_number_type(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | t.startswith("DECIMAL")


def number_text(s: Column) -> Column:
    """Text without , $ £ € and one trailing unit. Text of digits only is taken as it is.
    Each step names its input once: an inlined ``py_strip`` would repeat the regexes."""
    white = F.lit(PY_WS_CHARS)
    t = F.translate(F.trim(s, white), NUMBER_JUNK, "")
    digits = s.rlike(INTEGER_TEXT_RE) & s.try_cast("bigint").isNotNull()  # a cast that fails costs an exception
    return F.when(digits & ~s.contains(" "), s).otherwise(
        F.trim(F.regexp_replace(t, UNIT_SUFFIX_RE, ""), white))


def is_number_text(s: Column) -> Column:
    """Is the text a decimal literal? Every JSON number is one, and no other JSON value but a string may be."""
    return s.rlike(FLOAT_TEXT_RE)


def bool_from_text(s: Column) -> Column:
    w = F.lower(py_strip(s))
    return F.when(w.isin(*TRUE_WORDS), F.lit(True)).when(w.isin(*FALSE_WORDS), F.lit(False))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def as_int_ts(t: Column, s: Column) -> Column:
    digits = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), "-?[0-9]+", 0)
    d = s.try_cast("double")
    return (
        F.when(t == "BIGINT", s.try_cast("bigint"))
        .when(is_number_type(t), F.when(_finite(d).isNotNull(), d.try_cast("bigint")))
        .when(t == "STRING", F.nullif(digits, F.lit("")).try_cast("bigint"))
    )


def as_int_of(s: Column, t: Column) -> Column:
    """``as_int_ts`` that looks at the type only where the text is not a plain integer, which reads the same as a number and as text."""
    return F.when(s.rlike(PLAIN_INTEGER_RE), s.try_cast("bigint")).when(s.isNotNull(), as_int_ts(t, s))


def as_bool_of(s: Column, t: Column) -> Column:
    """boolean, or text that is a boolean word. The type tells the text 1 and 0 from the numbers; other words are never JSON text of another type."""
    return F.when(s.isin("0", "1"), F.when(t == "STRING", s == F.lit("1"))).otherwise(bool_from_text(s))


def is_blank_text(s: Column) -> Column:
    """absent, JSON null or ''."""
    return s.isNull() | (s == F.lit(""))


def is_absent_ts(t: Column) -> Column:
    return t.isNull() | (t == "VOID")


def is_truthy_ts(t: Column, s: Column) -> Column:
    return (
        F.when(is_absent_ts(t), F.lit(False))
        .when(t == "BOOLEAN", s == F.lit("true"))
        .when(is_number_type(t), s.try_cast("double") != 0)
        .when(t == "STRING", s != F.lit(""))
        .when(t.startswith("ARRAY"), s != F.lit("[]"))
        .when(t.startswith("OBJECT"), s != F.lit("{}"))
        .otherwise(F.lit(True))
    )
