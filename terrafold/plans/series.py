"""Series of maps over periods: one classification and one symbol scale for all of them, and what each frame shows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import blend
from ..functions.periods import ordered_periods
from ..operators import checks, classify
from ..operators.aggregate import combine_column
from ..operators.classify import Bins
from ..operators.longform import where_chain
from ..operators.semantics import resolve_method
from ..staging import stage
from .mapquery import MapSpec, frame_plan


@dataclass
class Series:
    """``values(key, period, ord, value, class_idx, colour)``, with a symbol also ``symbol, radius``; ``periods(period, ord)``; the classes
    and the largest symbol of all periods together."""

    key: str
    values: DataFrame
    periods: DataFrame
    bins: Bins
    largest: float | None = None
    issues: list[DataFrame] = field(default_factory=list)


def period_pins(period: str, where: Sequence[str]) -> list[str]:
    """Those of the filters ``COLUMN=VALUE`` that pin the column of periods."""
    split = [[x.strip() for x in e.partition("=")] for e in where]
    return [f"{column}={value}" for column, _, value in split if column == period]


def animated(rows: DataFrame, period: str, spec: MapSpec, where: Sequence[str] = (), ramp: Sequence[str] | None = None) -> Series:
    """The rows that meet ``where``, combined by unit and period in one shuffle, fill and symbol together, and classified over all
    periods, so that a colour or a circle means the same in each; ``ramp`` as in `classified`.

    ValueError with fewer than two periods: it names the filters that pinned the column, if any did, and how many periods they left out.
    Periods that can't be read stay, after the others, and are an issue. Rows without a period go; a series without any value is a ValueError.
    """
    if not spec.value:
        raise ValueError("a series needs a column to colour by")
    kept = where_chain(rows, list(where))
    periods = stage(ordered_periods(kept, period), "series-periods")
    n = periods.count()
    if n < 2:
        pins = period_pins(period, where)
        if pins:
            raise ValueError(f"of the {ordered_periods(rows, period).count()} periods of {period!r}, {' and '.join(pins)} leaves {n}; a series needs two")
        raise ValueError(f"{period!r} has {n} period{'s' if n != 1 else ''}; a series needs two")
    weight, order = (F.col(c) if c else None for c in (spec.weight, spec.order))
    found = [combine_column(resolve_method(spec.method, spec.semantic, spec.weight is not None), F.col(spec.value), weight, order).alias("value")]
    if spec.symbol:
        found.append(combine_column(resolve_method(spec.symbol_method, spec.symbol_semantic, False), F.col(spec.symbol)).alias("symbol"))
    cells = kept.groupBy(spec.key, F.trim(F.col(period).cast("string")).alias("period")).agg(*found)
    values = stage(cells.join(periods, "period"), "series-values")
    bins = classify.compute_bins(values, "value", spec.breaks, spec.classes, spec.integer, center_zero=spec.kind == "change")
    out, largest = classify.classified(values, "value", bins, ramp), None
    if spec.symbol:
        largest = float(values.agg(F.max("symbol").alias("m")).first().m or 1.0)
        out = out.withColumn("radius", classify.radius(F.col("symbol"), largest))
    issues = [checks.check_unreadable_periods(periods, "period", period), *checks.check_classes(values, "value", bins)]
    return Series(spec.key, out, periods, bins, largest, issues)


def frame_states(series: Series, units: DataFrame) -> DataFrame:
    """``(frame, key, colour, radius)``: every unit in every frame, blended from its state in one period into that in the next.

    A unit without a value has the colour of no data, without a symbol the radius 0. The rows are units times frames, which is what an
    animation shows; the states joined are units times periods.
    """
    key = series.key
    radius = F.coalesce("radius", F.lit(0.0)) if "radius" in series.values.columns else F.lit(0.0)
    every = units.select(key).crossJoin(series.periods.select("period")).join(series.values, [key, "period"], "left")
    states = every.select(key, "period", F.coalesce("colour", F.lit(classify.NO_DATA)).alias("colour"), radius.alias("radius"))
    a = states.select(key, "period", F.struct("colour", "radius").alias("a"))
    b = states.select(key, F.col("period").alias("next_period"), F.struct("colour", "radius").alias("b"))
    shown = frame_plan(series.periods).join(a, "period").join(b, ["next_period", key])
    grown = F.col("a.radius") + (F.col("b.radius") - F.col("a.radius")) * F.col("t")
    return shown.select("frame", key, blend(F.col("a.colour"), F.col("b.colour"), F.col("t")).alias("colour"), grown.alias("radius"))
