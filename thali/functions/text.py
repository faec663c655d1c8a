"""Display texts: money in two styles, IST date-time text, URL encoding.

All built from Spark column functions; the formats follow the reference:

* western money  ``₹1,234,567.00`` (server side), NULL -> ``₹0.00``
* plain money    ``₹1234567.00`` (statistics page ``"%.2f"``)
* Indian money   ``₹12,34,567.00`` (browser ``en-IN`` locale), NULL -> ``₹0.00``
* date-time      ``05 Jan 2024, 06:30 PM`` in IST, NULL -> ``''``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thali.functions.temporal import ist_timestamp

# Currency sign, date-time pattern, default texts.
RUPEE = "₹"
IST_TEXT_PATTERN = "dd MMM yyyy, hh:mm a"
ZERO_MONEY = "₹0.00"
# Insert a comma after a digit followed by 3 + 2k digits (Indian grouping).
_INDIAN_GROUPS = r"(\d)(?=(\d\d)*\d{3}$)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money_text(col: Column | str) -> Column:
    """Western grouping, 2 decimals, rupee sign; NULL -> ``₹0.00``."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(ZERO_MONEY)).otherwise(F.concat(F.lit(RUPEE), F.format_number(c, 2)))


def money_plain_text(col: Column | str) -> Column:
    """``₹`` + ``%.2f`` (no grouping); NULL -> ``₹0.00``."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(ZERO_MONEY)).otherwise(
        F.concat(F.lit(RUPEE), F.regexp_replace(F.format_number(c, 2), ",", "")))


def money_indian_text(col: Column | str) -> Column:
    """Indian grouping (12,34,567.00); NULL -> ``₹0.00``."""
    c = _c(col)
    plain = F.regexp_replace(F.format_number(F.abs(c), 2), ",", "")
    whole = F.substring_index(plain, ".", 1)
    frac = F.substring_index(plain, ".", -1)
    grouped = F.regexp_replace(whole, _INDIAN_GROUPS, "$1,")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(c.isNull(), F.lit(ZERO_MONEY)).otherwise(
        F.concat(F.lit(RUPEE), sign, grouped, F.lit("."), frac))


def ist_text(col: Column | str) -> Column:
    """``dd Mon YYYY, hh:mm AM`` in IST; NULL -> ``''``.

    Built from the wall-clock fields of the IST ``TIMESTAMP_NTZ`` (the date
    half formats a ``DATE``), because ``date_format`` on a timestamp goes
    through the session zone and would move times that fall in that zone's
    DST gap.  The result equals ``IST_TEXT_PATTERN`` under any session zone.
    """
    t = ist_timestamp(_c(col))
    h = F.hour(t)
    clock = F.concat(F.lpad(((h + 11) % 12 + 1).cast("string"), 2, "0"), F.lit(":"),
                     F.lpad(F.minute(t).cast("string"), 2, "0"), F.lit(" "),
                     F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM")))
    text = F.concat(F.date_format(F.to_date(t), "dd MMM yyyy"), F.lit(", "), clock)
    return F.coalesce(text, F.lit(""))


def truncate_text(col: Column | str, max_length: int, empty: str = "") -> Column:
    """First ``max_length`` characters plus ``...`` when longer; empty/NULL -> ``empty``."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), F.lit(empty))
            .when(F.char_length(c) <= max_length, c)
            .otherwise(F.concat(F.substring(c, 1, max_length), F.lit("..."))))


def template_truncate(col: Column | str, length: int, leeway: int = 5) -> Column:
    """The page templates' ``truncate``: unchanged up to ``length + leeway``
    characters, else the first ``length - 3`` cut back to the last blank, and
    ``...``; NULL -> ``''``."""
    c = _c(col)
    head = F.substring(c, 1, length - 3)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(c.isNull(), F.lit("")).when(F.char_length(c) <= length + leeway, c).otherwise(F.concat(cut, F.lit("...")))


def uri_component(col: Column | str) -> Column:
    """Browser-style ``encodeURIComponent``: blanks as ``%20``, ``!'()~`` left as is."""
    enc = F.url_encode(_c(col))
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    for raw, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        enc = F.replace(enc, F.lit(code), F.lit(raw))
    return enc
