"""Boundary folders, ``root/country/tier/layer``: which countries there are, which tier plays which role; adopting files of users."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boundaries import property_names, read_geojson, read_kml, scheme, tier_roles
from .delimited import SUFFIXES
from .lines import steps
from .shapefile import layer_files, read_shapefiles

#: Suffixes of layers, the preferred first, and the files that one of the first kind needs beside it.
LAYERS, SIDECARS = ["shp", "geojson", "json", "kml"], ["shx", "dbf"]
LISTED = "country string, tier string, stem string, suffix string, path string"


def layer_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(country, tier, stem, suffix, path)`` of the files two folders below the root; no file is opened. Hidden folders are left out."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for found in (fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base, "*/*/*")) if fs.exists(base) else None) or []:
        path = found.getPath().toString()
        country, tier, name = path.split("/")[-3:]
        if found.isFile() and not country.startswith(".") and not tier.startswith("."):
            stem, dot, suffix = name.rpartition(".")
            rows.append((country, tier, stem if dot else name, suffix.lower() if dot else "", path))
    return spark.createDataFrame(rows, LISTED)


def countries(listing: DataFrame) -> list[str]:
    """The folders with a tier that holds a layer, in order."""
    return [r.country for r in listing.where(F.col("suffix").isin(LAYERS)).select("country").distinct().orderBy("country").collect()]


def resolve_country(listing: DataFrame, requested: str | None = None) -> str:
    """The country asked for, or the only one. ValueError if it isn't there, if there is none, or if there are several to choose from."""
    found = countries(listing)
    if requested:
        if requested not in found:
            raise ValueError(f"no country {requested!r}; there are {', '.join(found) or 'none'}")
        return requested
    if len(found) != 1:
        raise ValueError(f"name one of the countries {', '.join(found)}" if found else "no country has a layer")
    return found[0]


def one_layer(files: list[tuple[str, str, str]], tier: str) -> str:
    """The path of a tier's one layer out of its files (stem, suffix, path). The same layer in several formats is one, in the preferred
    format; two layers in a folder are a ValueError, as is a shapefile without its index or attributes."""
    layers = sorted((f for f in files if f[1] in LAYERS), key=lambda f: (LAYERS.index(f[1]), f[0]))
    if not layers:
        raise ValueError(f"tier {tier!r} has no layer; accepted: {', '.join(LAYERS)}")
    if len({stem for stem, _, _ in layers}) > 1:
        raise ValueError(f"tier {tier!r} has several layers: {', '.join(f'{s}.{x}' for s, x, _ in layers)}")
    stem, suffix, path = layers[0]
    missing = [s for s in SIDECARS if suffix == "shp" and (stem, s) not in {(a, b) for a, b, _ in files}]
    if missing:
        raise ValueError(f"{stem}.shp lacks {', '.join(f'{stem}.{s}' for s in missing)}")
    return path


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """``(shape_id, properties, geom)`` of a layer in any of the formats."""
    suffix = path.rpartition(".")[2].lower()
    return read_shapefiles(spark, path) if suffix == "shp" else read_kml(spark, path) if suffix == "kml" else read_geojson(spark, path)


def country_tiers(spark: SparkSession, listing: DataFrame, country: str) -> DataFrame:
    """``(tier, path, units, role)`` of a country: the tier of fewest units is ``province``, the next ``commune``, more have no role, and
    neither has the outline of the whole country.

    Units of shapefiles are counted from their index, others from their features. A layer of one unit is opened to see whether its columns
    are those of an outline; a single unit that isn't plays a role. Files of one country are few.
    """
    files: dict[str, list[tuple[str, str, str]]] = {}
    for r in listing.where(F.col("country") == country).collect():
        files.setdefault(r.tier, []).append((r.stem, r.suffix, r.path))
    rows = []
    for tier in sorted(t for t, found in files.items() if any(suffix in LAYERS for _, suffix, _ in found)):
        path = one_layer(files[tier], tier)
        shapefile = path.lower().endswith(".shp")
        units = sum(n for _, n in layer_files(path)) if shapefile else read_layer(spark, path).count()
        outline = units == 1 and scheme(property_names(read_layer(spark, path)))["level"] == 0
        rows.append((tier, path, units, outline))
    known = spark.createDataFrame(rows, "tier string, path string, units long, outline boolean")
    # One more for each, since a tier of one unit ranks too unless it is an outline.
    ranked = tier_roles(known.where("not outline and units > 0").select("tier", (F.col("units") + 1).alias("units")))
    return known.join(ranked.select("tier", "role"), "tier", "left").select("tier", "path", "units", "role")


def resolve_tier(tiers: DataFrame, asked: str) -> dict:
    """The tier that a role (``province``, ``commune``) or a folder's name means: its ``tier, path, units, role``. ValueError with what
    there is, if none does."""
    rows = sorted((r.asDict() for r in tiers.collect()), key=lambda r: (r["units"], r["tier"]))
    for r in rows:
        if r["role"] and asked in (r["tier"], r["role"]):
            return r
    raise ValueError(f"no tier {asked!r}; there are {', '.join(f'{r['tier']} ({r['units']})' for r in rows)}")


def fine_tier(spark: SparkSession, tiers: DataFrame) -> DataFrame | None:
    """The shapes of the fine tier, or None: a country with one tier is complete."""
    found = tiers.where("role = 'commune'").select("path").first()
    return read_layer(spark, found.path) if found else None


def _digest(path: str, size: int) -> bytes:
    told = hashlib.sha256()
    for some in steps(path, 0, size):
        told.update(some)
    return told.digest()


def adopt(spark: SparkSession, source: str, folder: str) -> tuple[str, str]:
    """Copies a table that somebody handed over into a folder and returns its path there and ``copied`` or ``already_present``.

    Nothing is overwritten: a file of the same name and content is used as it is, one of the same name and other content gets a number
    from 02. Contents are compared some bytes at a time. ValueError on a suffix that no reader takes, FileNotFoundError without the file.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    path = at(source)
    here = path.getFileSystem(conf)
    if not here.exists(path) or not here.getFileStatus(path).isFile():
        raise FileNotFoundError(source)
    stem, _, suffix = path.getName().rpartition(".")
    if suffix.lower() not in SUFFIXES:
        raise ValueError(f"{path.getName()!r} is no table; accepted: {', '.join(SUFFIXES)}")
    stem = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", stem).strip(" .") or "data"
    there = at(folder).getFileSystem(conf)
    target, size, k = at(folder, f"{stem}.{suffix}"), here.getFileStatus(path).getLen(), 1
    while there.exists(target):
        same = there.getFileStatus(target).getLen() == size and _digest(target.toString(), size) == _digest(source, size)
        if same:
            return target.toString(), "already_present"
        k += 1
        target = at(folder, f"{stem}_{k:02d}.{suffix}")
    there.mkdirs(at(folder))
    jvm.org.apache.hadoop.fs.FileUtil.copy(here, path, there, target, False, conf)
    return target.toString(), "copied"
