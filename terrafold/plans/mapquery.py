"""Map queries: rows and units to drawn values, classes, symbols, legend and issues."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import blend, format_value
from ..operators import checks, classify
from ..operators.aggregate import combine
from ..operators.classify import Bins
from ..staging import stage

MAP_TYPES = ["choropleth", "choropleth-symbol", "graduated-symbol", "categorized", "boundary", "change", "point"]
FILL = {"percent", "rate-per-capita", "percentage-point", "ratio", "score", "category"}
SYMBOL = {"count", "money"}
FRAMES_PER_SECOND, HOLD_SECONDS, FADE_SECONDS = 25, 1.8, 0.35


@dataclass(frozen=True)
class MapSpec:
    """What a map shows. ``value`` is the fill, ``symbol`` the circles; each with its method (``auto``: what its semantic deserves) and weight."""

    kind: str
    key: str = "shape_id"
    value: str | None = None
    method: str = "sum"
    weight: str | None = None
    semantic: str = "unknown"
    symbol: str | None = None
    symbol_method: str = "sum"
    symbol_semantic: str = "count"
    classes: int = 5
    breaks: str = "quantile"
    integer: bool = False
    lang: str = "en"
    order: str | None = None

    def token(self) -> str:
        """Eight hex digits that name these settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:8]


@dataclass
class MapResult:
    """The frames of a map: ``drawn`` has a row for each unit, values or not."""

    drawn: DataFrame
    legend: DataFrame | None = None
    bins: Bins | None = None
    issues: list[DataFrame] = field(default_factory=list)


def thematic_map(rows: DataFrame, units: DataFrame, spec: MapSpec) -> MapResult:
    """``rows(key, ..)`` over ``units(shape_id, unit)``: combined by one shuffle for each channel, joined left onto all units, classified.

    A unit without rows keeps null and the colour of no data: grey is not zero.
    """
    if spec.kind not in MAP_TYPES:
        raise ValueError(f"unknown map type {spec.kind!r}; known: {', '.join(MAP_TYPES)}")
    frame, issues = units.select("shape_id", "unit"), []
    if spec.value:
        values = combine(rows, [spec.key], spec.value, spec.method, spec.weight, spec.order, spec.semantic).select(F.col(spec.key).alias("shape_id"), "value")
        frame = frame.join(values, "shape_id", "left")
    if spec.symbol:
        symbols = combine(rows, [spec.key], spec.symbol, spec.symbol_method, semantic=spec.symbol_semantic).select(F.col(spec.key).alias("shape_id"), F.col("value").alias("symbol"))
        frame = frame.join(symbols, "shape_id", "left")
    if spec.value or spec.symbol:
        # A row for each unit: all that follows reads it again, not the facts.
        frame = stage(frame, "map-units")
    result = MapResult(frame)
    if spec.kind in ("choropleth", "choropleth-symbol", "change") and spec.value:
        bins = classify.compute_bins(frame, "value", spec.breaks, spec.classes, spec.integer, center_zero=spec.kind == "change")
        result.bins, result.legend = bins, classify.legend(frame, "value", bins, spec.semantic, spec.lang)
        frame = classify.classified(frame, "value", bins)
        decimals = 0 if bins.integer else classify.label_decimals(bins.edges)
        frame = frame.withColumn("formatted", format_value(F.col("value"), spec.semantic, decimals, lang=spec.lang))
        issues += [checks.check_coverage(frame, "value"), *checks.check_classes(frame, "value", bins), checks.check_colour_choice(frame, "value", spec.semantic, spec.kind)]
    if spec.kind == "categorized" and spec.value:
        order = classify.category_order(frame.where("value is not null"), "value")
        result.legend = order
        frame = frame.join(order.select(F.col("label").alias("value"), F.col("ord").alias("class_idx"), "colour"), "value", "left").withColumn("colour", F.coalesce("colour", F.lit(classify.NO_DATA)))
    if spec.kind in ("graduated-symbol", "choropleth-symbol") and spec.symbol:
        most = frame.agg(F.max("symbol").alias("m")).first().m or 1.0
        frame = frame.withColumn("radius", classify.radius(F.col("symbol"), most)).withColumn("symbol_formatted", format_value(F.col("symbol"), spec.symbol_semantic, lang=spec.lang))
    rank_by = "value" if spec.value and spec.kind != "categorized" else "symbol" if spec.symbol else None
    if rank_by:
        place = F.row_number().over(Window.orderBy(F.abs(rank_by).desc_nulls_last(), "shape_id"))
        frame = frame.withColumn("label_rank", F.when(F.col(rank_by).isNotNull(), place))
    result.drawn, result.issues = frame, issues
    return result


def drawn_numbers(drawn: DataFrame) -> DataFrame:
    """What a map shows as numbers, a row for each unit: ``unit``, then ``value`` and ``symbol`` each beside its text as the legend writes it."""
    return drawn.select("unit", *(c for c in ("value", "formatted", "symbol", "symbol_formatted") if c in drawn.columns))


def needs_place_column(kind: str, province: str | None, commune: str | None, tier: str) -> bool:
    """Whether a place column must still be named: a point map without one is drawn from coordinates; the coarse tier needs the province's,
    the fine one either."""
    if province or (kind == "point" and not commune):
        return False
    return tier == "province" or not commune


def series(rows: DataFrame, key: str, period: str, value: str, method: str = "sum", classes: int = 5, ramp: Sequence[str] | None = None) -> tuple[DataFrame, Bins]:
    """``(key, period, value, class_idx, colour)`` with one classification over all periods, so that colours compare; ``ramp`` as in `classified`."""
    values = stage(combine(rows, [key, period], value, method), "series-values")
    bins = classify.compute_bins(values, "value", "quantile", classes)
    return classify.classified(values, "value", bins, ramp), bins


def frame_plan(periods: DataFrame, fps: int = FRAMES_PER_SECOND, hold: float = HOLD_SECONDS, fade: float = FADE_SECONDS) -> DataFrame:
    """``periods(period, ord)`` to ``(frame, period, next_period, t)``: each held, then faded into the next; t is the blend."""
    holds, fades = round(fps * hold), round(fps * fade)
    w = Window.orderBy("ord")
    nxt = periods.withColumn("next_period", F.lead("period").over(w))
    steps = F.concat(F.array_repeat(F.lit(0.0), holds), F.when(F.col("next_period").isNotNull(), F.array(*(F.lit((s + 1) / (fades + 1)) for s in range(fades)))).otherwise(F.array().cast("array<double>")))
    out = nxt.select("ord", "period", "next_period", F.posexplode(steps).alias("k", "t"))
    return out.select((F.col("ord") * (holds + fades) + F.col("k")).alias("frame"), "period", F.coalesce("next_period", "period").alias("next_period"), "t")


def frame_colours(plan: DataFrame, coloured: DataFrame, key: str, period: str) -> DataFrame:
    """``(frame, key, colour)``: each unit's colour of a period blended into that of the next."""
    now = coloured.select(F.col(period).alias("period"), key, F.col("colour").alias("a"))
    then = coloured.select(F.col(period).alias("next_period"), key, F.col("colour").alias("b"))
    return plan.join(now, "period").join(then, ["next_period", key]).select("frame", key, blend(F.col("a"), F.col("b"), F.col("t")).alias("colour"))


def allocate(requests: list[tuple[str, str]]) -> tuple[list[dict], list[tuple[str, str]]]:
    """``(name, semantic)`` to (maps, rejected): fills and symbols pair up in the order they were asked for, so that what a full channel
    turns away goes to the next map. Rejected, with the reason: what suits neither channel."""
    fills, symbols = ([n for n, s in requests if s in channel] for channel in (FILL, SYMBOL))
    kinds = dict(requests)
    maps = []
    for k in range(max(len(fills), len(symbols))):
        fill, symbol = (names[k] if k < len(names) else None for names in (fills, symbols))
        kind = "graduated-symbol" if fill is None else "categorized" if symbol is None and kinds[fill] == "category" else "choropleth-symbol" if symbol else "choropleth"
        maps.append({"map": k, "fill": fill, "symbol": symbol, "kind": kind})
    why = {"time": "no quantity", "identifier": "no quantity", "text": "no quantity", "coordinate": "a coordinate"}
    return maps, [(n, why.get(s, "meaning unclear")) for n, s in requests if s not in FILL | SYMBOL]


def conflicts(requests: list[tuple[str, str]]) -> list[str]:
    """What to say before an allocation is accepted: channels asked for twice, categories beside continuous fills."""
    fills, symbols = ([s for _, s in requests if s in channel] for channel in (FILL, SYMBOL))
    mixed = "category" in fills and set(fills) != {"category"}
    return [x for x, found in (("fill-taken", len(fills) > 1), ("symbol-taken", len(symbols) > 1), ("category-beside-continuous", mixed)) if found]


def frame_coverage(values: DataFrame, key: str, period: str, columns: list[str]) -> DataFrame:
    """``(period, units)``: for each frame of a series the units with any value."""
    some = F.greatest(*(F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) == 1
    return values.groupBy(period).agg(F.countDistinct(F.when(some, F.col(key))).alias("units"))


def units_shown(drawn: DataFrame, columns: list[str]) -> DataFrame:
    """One row: units with a fill or a symbol."""
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    return drawn.agg(F.count_if(some).alias("units"))


def insight(drawn: DataFrame, category: bool = False) -> DataFrame:
    """One row ``(unit, value, n_units)``: the unit with the highest value, of equal ones the first by name; or the commonest category."""
    if category:
        return drawn.where("value is not null").groupBy("value").agg(F.count("*").alias("n_units")).agg(F.min_by(F.struct("value", "n_units"), F.struct((-F.col("n_units")).alias("n"), "value")).alias("b")).select(F.lit(None).cast("string").alias("unit"), "b.*")
    best = F.min_by(F.struct("unit", "value"), F.struct((-F.col("value")).alias("v"), "unit"))
    return drawn.where("value is not null").agg(best.alias("b"), F.count("*").alias("n_units")).select("b.*", "n_units")


def page_payload(drawn: DataFrame, facts: DataFrame, spec: MapSpec) -> DataFrame:
    """``(shape_id, payload)``: what an interactive page needs of each unit, as JSON: its name, colour, values as drawn and facts."""
    shown = [c for c in ("unit", "value", "formatted", "symbol", "symbol_formatted", "class_idx", "colour", "radius", "label_rank") if c in drawn.columns]
    told = [c for c in facts.columns if c != "shape_id"]
    out = drawn.join(facts, "shape_id", "left")
    return out.select("shape_id", F.to_json(F.struct(F.lit(spec.kind).alias("kind"), *shown, F.struct(*told).alias("facts"))).alias("payload"))


def plan_table(spark, spec: MapSpec) -> DataFrame:
    """``(item, setting, value)`` of a map before it is drawn, numbered, with the token that names these settings in the last row."""
    rows = [(k, name, None if v is None else str(v)) for k, (name, v) in enumerate(asdict(spec).items(), 1)]
    return spark.createDataFrame([*rows, (len(rows) + 1, "token", spec.token())], "item int, setting string, value string")
