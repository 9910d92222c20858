"""What is drawn: the whole country, one province, a map for each province, or the units with data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ["auto", "national", "single-province", "province-series", "matched-only"]
#: Up to so many provinces, an automatic scope draws one map for each.
SERIES_UP_TO = 5


def contexts(units: DataFrame, matched: DataFrame, scope: str = "auto", tier: str = "commune", series_up_to: int = SERIES_UP_TO) -> tuple[str, DataFrame]:
    """The scope that applies and ``(map_name, shape_id, locator)``, a row for each unit of each map.

    ``units(shape_id, province)`` are all shapes; ``matched(shape_id, province)`` the rows of a review, null where nothing matched.
    Coarse units are always one map. Fine ones are one map too where no row names a province or, if the scope is automatic, where more
    than ``series_up_to`` do; one province is drawn alone. ``locator`` is the province that a map lies in. Two numbers come to the driver;
    units are met by semi joins.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}; known: {', '.join(SCOPES)}")
    nothing = F.lit(None).cast("string")

    def one_map(name: str, of: DataFrame, locator: str | None = None) -> DataFrame:
        return of.select(F.lit(name).alias("map_name"), "shape_id", F.lit(locator).cast("string").alias("locator") if locator else nothing.alias("locator"))

    met = matched.where("shape_id is not null")
    with_data = units.join(met.select("shape_id").distinct(), "shape_id", "left_semi")
    if tier == "province":
        return "national", one_map("national", with_data if scope == "matched-only" else units)
    named = met.where("province is not null and province != ''").select("province")
    s = named.agg(F.countDistinct("province").alias("n"), F.min("province").alias("first")).first()
    if s.n and scope == "matched-only":
        return scope, one_map("units with data", with_data, s.first if s.n == 1 else None)
    if not s.n or scope == "national" or (scope == "auto" and s.n > series_up_to):
        return "national", one_map("national", units)
    if scope == "single-province" or s.n == 1:
        return "single-province", one_map(s.first, units.where(F.col("province") == s.first), s.first)
    series = units.join(named.distinct(), "province", "left_semi")
    return "province-series", series.select(F.col("province").alias("map_name"), "shape_id", F.col("province").alias("locator"))
