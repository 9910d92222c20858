"""Shapefile layers: read in ranges of records that the index gives, attributes beside shapes; written a file for each partition."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import GEOMETRY, signed_ring_area, without_repeats
from ..functions.text import demojibake

SCHEMA = f"shape_id bigint, properties map<string,string>, geom {GEOMETRY}"
#: Bytes of shapes that one task reads, about.
RANGE_BYTES = 16 << 20
# Fixed values of the format: sizes of the headers and of an index record; types of polygons, plain and with further ordinates.
HEADER, INDEX_RECORD, FIELD, POLYGONS, MAGIC, VERSION = 100, 8, 32, (5, 15, 25), 9994, 1000
#: What a code page file says, to a codec.
CODE_PAGES = {"1258": "cp1258", "1252": "cp1252", "ansi 1252": "cp1252", "utf8": "utf-8", "88591": "latin-1"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; Spark's short local form is one of a local file."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _read(fs: pafs.FileSystem, path: str, start: int = 0, size: int | None = None) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def layer_files(path: str) -> list[tuple[str, int]]:
    """(path without suffix, number of features) of the layers at a path, a file or a folder, in order. Counts come from the lengths of the
    index files: no shape is read."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    found = {f.path[:-4]: f for f in files if f.path.lower().endswith(".shp")}
    out = []
    for base in sorted(found):
        index = fs.get_file_info(base + found[base].path[-4:].replace("p", "x").replace("P", "X"))
        if index.type != pafs.FileType.File:
            raise FileNotFoundError(f"{base}.shx is missing")
        out.append((base, max(0, (index.size - HEADER) // INDEX_RECORD)))
    return out


def layer_units(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(tier, units)`` of layers by tier, from their indexes alone."""
    return spark.createDataFrame([(tier, sum(n for _, n in layer_files(p))) for tier, p in paths.items()], "tier string, units long")


def fields_of(header: bytes) -> list[tuple[str, str, int]]:
    """(name, type, width) of the fields that an attribute file's header lists."""
    out = []
    for at in range(FIELD, len(header) - FIELD + 1, FIELD):
        if header[at] == 0x0D:
            break
        out.append((header[at : at + 11].split(b"\0")[0].decode("latin-1").strip(), chr(header[at + 11]), header[at + 16]))
    return out


def rings_of(content: bytes) -> list[np.ndarray]:
    """The rings of a record, without their closing vertex; nothing for a null shape. Types without area raise ValueError."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == 0:
        return []
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} has no area")
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", n_parts, 44).tolist()
    xy = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    out = []
    for a, b in zip(starts, [*starts[1:], n_points]):
        ring = xy[a:b]
        out.append(ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring)
    return [r for r in out if len(r)]


def _turn(ring: np.ndarray) -> float:
    """Twice the signed area, taken from the first vertex, so that far-off coordinates don't cancel."""
    d = ring - ring[0]
    return float(np.sum(d[:, 0] * np.roll(d[:, 1], -1) - np.roll(d[:, 0], -1) * d[:, 1]))


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, 0)
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    at = a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1])
    return bool((x < at).sum() % 2)


def parts_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outlines, which the format turns clockwise, each with the holes that it holds; a hole that none holds is an outline itself. They
    come out the other way round, outlines counter-clockwise, from the same first vertex."""
    back = lambda r: np.concatenate((r[:1], r[:0:-1]))
    parts = [[r] for r in rings if _turn(r) <= 0]
    for hole in (r for r in rings if _turn(r) > 0):
        home = [p for p in parts if _holds(p[0], *hole[0])]
        if home:
            min(home, key=lambda p: abs(_turn(p[0]))).append(hole)
        else:
            parts.append([back(hole)])
    return [[back(r) for r in p] for p in parts]


class Records(InputPartition):
    def __init__(self, base: str, first: int, end: int, id_from: int):
        self.base, self.first, self.end, self.id_from = base, first, end, id_from


class LayerReader(DataSourceReader):
    """Plans ranges of records from the index; a task reads its range of shapes in one piece, and the fixed-width attributes beside it."""

    def __init__(self, options: dict):
        self.path, self.range_bytes, self.encoding = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("encoding")

    def partitions(self) -> list[Records]:
        out, so_far = [], 0
        fs, _ = _open(self.path)
        for base, n in layer_files(self.path):
            size = fs.get_file_info(base + ".shp").size
            tasks = max(1, min(n, -(-size // self.range_bytes)))
            cuts = [n * k // tasks for k in range(tasks + 1)]
            out += [Records(base, a, b, so_far) for a, b in zip(cuts, cuts[1:]) if a < b]
            so_far += n
        return out or [Records("", 0, 0, 0)]

    def _codec(self, fs: pafs.FileSystem, base: str) -> str:
        if self.encoding:
            return self.encoding
        if fs.get_file_info(base + ".cpg").type != pafs.FileType.File:
            return "latin-1"
        told = _read(fs, base + ".cpg").decode("latin-1").strip().lower()
        return CODE_PAGES.get(told, CODE_PAGES.get(told.replace("-", "").replace("iso", "").replace("_", ""), told))

    def read(self, p: Records) -> Iterator[tuple]:
        if p.first == p.end:
            return
        fs, _ = _open(self.path)
        index = np.frombuffer(_read(fs, p.base + ".shx", HEADER + INDEX_RECORD * p.first, INDEX_RECORD * (p.end - p.first)), ">u4").reshape(-1, 2).astype(np.int64) * 2
        start, end = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
        shapes = _read(fs, p.base + ".shp", start, end - start)
        lead = _read(fs, p.base + ".dbf", 0, FIELD)
        head, width = struct.unpack_from("<HH", lead, 8)
        fields, codec = fields_of(_read(fs, p.base + ".dbf", 0, head)), self._codec(fs, p.base)
        rows = _read(fs, p.base + ".dbf", head + width * p.first, width * (p.end - p.first))
        for k, (at, size) in enumerate((index - [start, 0]).tolist()):
            row = rows[width * k : width * (k + 1)]
            if row[:1] == b"*":  # deleted
                continue
            properties, pos = {}, 1
            for name, _, w in fields:
                properties[name] = row[pos : pos + w].decode(codec, "replace").strip(" \0") or None
                pos += w
            geom = [[[(float(x), float(y)) for x, y in r] for r in part] for part in parts_of(rings_of(shapes[at + 8 : at + 8 + size]))]
            yield p.id_from + p.first + k, properties, geom


class LayerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options)


def read_shapefiles(spark: SparkSession, path: str, encoding: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(shape_id, properties map<string,string>, geom)`` of the features of a .shp file or of all in a folder: ids count from 0 in the
    order of the files and records, deleted records go, null shapes are empty.

    The index (.shx) says where records lie, so a layer is read by as many tasks as it has ranges of ``range_bytes``, each with the
    attributes (.dbf) of the same records. Attributes are in the code page that .cpg names, else Latin-1: see `repaired`. Outlines
    turn counter-clockwise. Any file system that pyarrow opens.
    """
    spark.dataSource.register(LayerSource)
    reader = spark.read.format("shapefile").option("rangeBytes", str(range_bytes))
    return (reader.option("encoding", encoding) if encoding else reader).load(path)


def repaired(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shapes`` with attributes that were read in the wrong code page mended, and what was found, ``(property, values, misread,
    correct)`` with one example each: a pass over the attributes, which leaves the columns it finds nothing in alone."""
    cells = shapes.select(F.explode("properties").alias("property", "value")).withColumn("fixed", demojibake(F.col("value"))).where("fixed is not null")
    found = cells.groupBy("property").agg(F.count("*").alias("values"), F.min(F.struct("value", "fixed")).alias("one"))
    found = found.select("property", "values", F.col("one.value").alias("misread"), F.col("one.fixed").alias("correct"))
    broken = [r.property for r in found.select("property").collect()]
    mend = lambda k, v: F.when(k.isin(broken), F.coalesce(demojibake(v), v)).otherwise(v)
    return (shapes.withColumn("properties", F.transform_values("properties", mend)) if broken else shapes), found


def _shape_record(geom: list | None) -> tuple[bytes, tuple | None]:
    """The content of a record, and its bounds."""
    rings = [r for part in geom or [] for r in part if r]
    if not rings:
        return struct.pack("<i", 0), None
    points = [np.array([(v["x"], v["y"]) for v in [*r, r[0]]]) for r in rings]
    xy = np.concatenate(points)
    box = (*xy.min(0).tolist(), *xy.max(0).tolist())
    starts = np.concatenate(([0], np.cumsum([len(p) for p in points])[:-1])).astype("<i4")
    return struct.pack("<i4d2i", 5, *box, len(points), len(xy)) + starts.tobytes() + xy.astype("<f8").tobytes(), box


def _header(size: int, kind: int, box: tuple) -> bytes:
    return struct.pack(">7i", MAGIC, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, kind, *box, 0.0, 0.0, 0.0, 0.0)


def write_shapefiles(shapes: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Writes ``shapes(geom, *columns)`` as shapefiles in the shared folder, one for each partition that has rows, with UTF-8 attributes,
    and returns ``(base, features)``. Names longer than ten bytes are cut, values longer than 254 raise an error. A partition's file is
    built in its task's memory; the name belongs to one attempt, and the result names those that succeeded."""
    names = [c.encode()[:10].decode(errors="ignore") for c in columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"names are not distinct in ten bytes: {names}")
    texts = shapes.select(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)))
    widest = texts.agg(*(F.max(F.octet_length(f"c{k}")).alias(f"c{k}") for k in range(len(columns)))).first() if columns else ()
    widths = [max(1, w or 1) for w in widest]
    if max(widths, default=1) > 254:
        raise ValueError("the format holds values of up to 254 bytes")
    turned = lambda r, i: F.when((signed_ring_area(r) < 0) == (i == 0), r).otherwise(F.concat(F.slice(r, 1, 1), F.reverse(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))))))
    geom = F.transform("geom", lambda p: F.transform(F.transform(p, without_repeats), turned))
    rows = shapes.select(geom.alias("geom"), *(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = f"{folder.rstrip('/')}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        shp, shx, dbf, n, whole = io.BytesIO(), io.BytesIO(), io.BytesIO(), 0, None
        for b in batches:
            for row in b.to_pylist():
                content, box = _shape_record(row["geom"])
                shx.write(struct.pack(">2i", (HEADER + shp.tell()) // 2, len(content) // 2))
                shp.write(struct.pack(">2i", n + 1, len(content) // 2) + content)
                dbf.write(b" " + b"".join((row[f"c{k}"] or "").encode().ljust(w) for k, w in enumerate(widths)))
                n += 1
                if box:
                    whole = box if whole is None else (*map(min, whole[:2], box[:2]), *map(max, whole[2:], box[2:]))
        if not n:
            return
        fs, path = _open(base)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        fields = b"".join(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for name, w in zip(names, widths))
        head = struct.pack("<4BIHH", 3, 100, 1, 1, n, FIELD + len(fields) + 1, 1 + sum(widths)) + bytes(20) + fields + b"\r"
        frame = whole or (0.0, 0.0, 0.0, 0.0)
        for suffix, data in ((".shp", _header(HEADER + shp.tell(), 5, frame) + shp.getvalue()), (".shx", _header(HEADER + shx.tell(), 5, frame) + shx.getvalue()), (".dbf", head + dbf.getvalue() + b"\x1a"), (".cpg", b"UTF-8")):
            with fs.open_output_stream(path + suffix) as out:
                out.write(data)
        yield pa.RecordBatch.from_pydict({"base": [base], "features": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "base string, features long")
