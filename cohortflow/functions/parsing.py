"""Column expressions that read text fields: trimming, numbers, codes, flags and labels.

The number readers keep their differing comma rules apart.  All of them give null
for text that is no number and for infinite or not-a-number values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LABEL_TEXT

# Texts that mean "missing" for each reader.
NA_UPPER = ["", "NA", "NAN", "NULL"]
NA_MIXED = ["", "NA", "na", "N/A", "None", "<NA>"]
NA_LIST = ["", "NA", "N/A", "<NA>", "None"]

# Fixed value: text of a plain decimal number.
DECIMAL_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def nan_to_null(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def nullable_string(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def text_to_double(c: Column) -> Column:
    """Plain decimal text as double, anything else null."""
    t = F.trim(c)
    return nan_to_null(F.when(t.rlike(DECIMAL_TEXT), t.try_cast("double")))


def _unquote(c: Column, marks: list[str]) -> Column:
    t = F.trim(c)
    for mark in marks:
        t = F.btrim(t, F.lit(mark))
    return t


def parse_number_decimal_comma(c: Column) -> Column:
    """Every comma is a decimal mark; NA, NAN and NULL in any case are missing."""
    t = _unquote(c, ["'", '"'])
    return F.when(~F.upper(t).isin(NA_UPPER), text_to_double(F.replace(t, F.lit(","), F.lit("."))))


def parse_integer_code(c: Column) -> Column:
    """Number text read as a whole-number code; fractions are null."""
    x = parse_number_decimal_comma(c)
    return F.when(x == F.floor(x), x.cast("long"))


def parse_float_mixed(c: Column) -> Column:
    """One comma before at most three digits is decimal, other commas separate thousands."""
    t = _unquote(c, ['"', "'"])
    decimal = t.rlike(r"^[^.,]*,[0-9]{1,3}$")
    fixed = F.coalesce(
        text_to_double(t),
        F.when(decimal, text_to_double(F.replace(t, F.lit(","), F.lit(".")))),
        text_to_double(F.replace(t, F.lit(","), F.lit(""))),
    )
    return F.when(~t.isin(NA_MIXED), fixed)


def parse_number_na_list(c: Column, missing: list[str] = NA_LIST) -> Column:
    """Every comma is decimal; the listed texts are missing."""
    t = _unquote(c, ["'", '"'])
    return F.when(~t.isin(missing), text_to_double(F.replace(t, F.lit(","), F.lit("."))))


def parse_number_regex(c: Column) -> Column:
    """A comma between a digit and the trailing digits is decimal, other commas are dropped."""
    t = F.regexp_replace(F.trim(c), r"(?<=[0-9]),(?=[0-9]+$)", ".")
    return text_to_double(F.replace(t, F.lit(","), F.lit("")))


def normalise_code(c: Column) -> Column:
    """`3`, `3.0` and `3,0` all read as `3`; other text stays, blank is null."""
    t = F.trim(c)
    x = text_to_double(F.replace(t, F.lit(","), F.lit(".")))
    return F.nullif(F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(t), F.lit(""))


def flag_01(code: Column) -> Column:
    """Three-valued flag: 1 true, 0 false, anything else null."""
    return F.when(code == 1, F.lit(True)).when(code == 0, F.lit(False))


def decode(code: Column, labels: dict) -> Column:
    """Label of a code from a fixed dictionary; unlisted codes stay null."""
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def binary_label_text(c: Column) -> Column:
    """0/1 from the accepted spellings; null where the text is none of them."""
    t = F.lower(F.trim(c.cast("string")))
    return decode(t, LABEL_TEXT)


def required_binary_label(c: Column) -> Column:
    """As `binary_label_text`, but an unknown spelling stops the job."""
    return F.coalesce(
        binary_label_text(c),
        F.raise_error(F.concat(F.lit("unsupported label: "), F.coalesce(c.cast("string"), F.lit("<null>")))).cast("int"),
    )


def entity_id_from_name(c: Column) -> Column:
    """Entity id held in a record name such as `P0001` or `P0001_H`; null if the name has another form."""
    return F.nullif(F.regexp_extract(c, r"^(P[0-9]+)(?:_H)?$", 1), F.lit(""))
