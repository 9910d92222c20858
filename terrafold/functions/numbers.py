"""Numbers as maps show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def localise(text: Column, lang: str) -> Column:
    """Vietnamese swaps the thousands and decimal marks."""
    return F.translate(text, ",.", ".,") if lang == "vi" else text


def format_value(v: Column, semantic: str, decimals: int | None = None, unit: str = "", lang: str = "vi") -> Column:
    """A value as its legend prints it: grouped counts, money with its unit, percentages, signed points; null is a dash."""
    places = {"count": 0, "money": 0}.get(semantic, 1) if decimals is None else decimals
    text = F.format_number(F.when(F.round(v, places) == 0, F.lit(0.0)).otherwise(v.cast("double")), places)
    if semantic == "percentage-point":
        text = F.when(F.round(v, places) > 0, F.concat(F.lit("+"), text)).otherwise(text)
    text = localise(text, lang)
    if semantic == "percent":
        text = F.concat(text, F.lit("%"))
    elif semantic == "money" and unit:
        text = F.concat(text, F.lit(f" {unit}"))
    return F.when(v.isNull() | F.isnan(v.cast("double")), "–").otherwise(text)


def nice_length(span: Column, share: float = 0.25) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that fits a share of the span."""
    target = span * share
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    return F.when(target >= 5 * power, 5 * power).when(target >= 2 * power, 2 * power).otherwise(power)


def blend(a: Column, b: Column, t: Column) -> Column:
    """Linear mix of two ``#rrggbb`` colours."""
    def channel(at: int) -> Column:
        x, y = (F.conv(F.substring(c, at, 2), 16, 10).cast("int") for c in (a, b))
        return F.lower(F.lpad(F.hex(F.rint(x + (y - x) * t).cast("int")), 2, "0"))

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))
