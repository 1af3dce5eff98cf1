"""Normalisation of identifiers and detection of values that stand for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for "no value" in keys and attributes (compared in lower case, trimmed).
FILLERS = (
    "", "-", "--", ".", "0", "?", "n/a", "na", "nan", "nil", "none", "null", "(null)", "undefined", "unknown",
    "missing", "tbd", "test", "x", "xx", "xxx",
    "00000000-0000-0000-0000-000000000000",
)

#: Blanks of any kind: ASCII white space, the no-break space, the zero-width space and the byte order mark.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u200b\ufeff"


def squeeze(c: Column) -> Column:
    """Without outer blanks (of any kind); null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def key_text(c: Column) -> Column:
    """Lower case without outer blanks; null for a filler value."""
    v = F.lower(squeeze(c))
    return F.when(~v.isin(*FILLERS), v)


def numeric_id(c: Column) -> Column:
    """The canonical decimal digits of an id written as 42, ' 42', '0042', '42.0' or gid://host/Kind/42.

    Other text is returned as by key_text (it names some record, though none with a numeric id); fillers give null.
    """
    v = key_text(c)
    digits = F.regexp_extract(v, r"^(?:gid://[^?]*/)?0*(\d+?)(?:\.0*)?(?:\?.*)?$", 1)
    return F.when(v.isNull(), None).when(digits == "", v).when(digits != "0", digits)
