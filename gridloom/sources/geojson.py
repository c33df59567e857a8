"""GeoJSON feature collections as a Spark data source: incremental scan, parallel sink, and a stream of new files.

    spark.dataSource.register(GeoJsonSource)      # or geojson.register(spark)
    spark.read.format("geojson").load(path)       # a file or a folder, read one feature at a time
    df.write.format("geojson").save(folder)       # one valid collection a partition
    spark.readStream.format("geojson").load(path) # files as they arrive

Paths are local (shared) ones or any URI that pyarrow's file systems know.  A
file is read by one task in bounded memory, so many files run in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import IO

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.runtime import ship

GEOM = "struct<type:string,parts:array<array<array<struct<x:double,y:double>>>>>"
SCHEMA = f"feature_id string, object_type string, properties string, geom {GEOM}"
BLOCK = 1 << 16
SPACE = " \t\r\n﻿"


class _Text:
    """A text file that is seen through a window, which grows only as far as one value needs."""

    def __init__(self, stream: IO[bytes]):
        self.stream, self.window, self.at, self.done, self.tail = stream, "", 0, False, b""

    def more(self) -> bool:
        if self.done:
            return False
        block = self.stream.read(max(BLOCK, len(self.window) - self.at))  # doubles, so a long value costs linear time
        self.done = not block
        data = self.tail + block
        cut = len(data)
        if not self.done:  # leave a broken last character for the next block
            while cut and cut > len(data) - 4 and data[cut - 1] & 0xC0 == 0x80:
                cut -= 1
            if cut and data[cut - 1] >= 0xC0:
                cut -= 1
            else:
                cut = len(data)
        self.window, self.at, self.tail = self.window[self.at :] + data[:cut].decode("utf-8", "replace"), 0, data[cut:]
        return True

    def peek(self) -> str:
        """Next character that is not white, or none at the end."""
        while True:
            while self.at < len(self.window) and self.window[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.window):
                return self.window[self.at]
            if not self.more():
                return ""

    def expect(self, chars: str) -> str:
        c = self.peek()
        if not c or c not in chars:
            raise ValueError(f"expected one of {chars!r}, found {c!r}")
        self.at += 1
        return c

    def value(self):
        """The next JSON value."""
        self.peek()
        while True:
            try:
                out, end = _DECODER.raw_decode(self.window, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise ValueError("the file ends inside a value or holds invalid JSON") from None
                continue
            if end < len(self.window) or not self.more():  # a number could go on in the next block
                self.at = end
                return out


_DECODER = json.JSONDecoder()


def iter_features(stream: IO[bytes]) -> Iterator[dict]:
    """Members of ``features``, one at a time; other keys of the root are skipped.

    A root that is not an object, lacks ``features`` or has something else than an
    array there is an error.
    """
    text, found = _Text(stream), False
    if text.peek() != "{":
        raise ValueError("the root of a feature collection must be an object")
    text.expect("{")
    while text.peek() != "}":
        name = text.value()
        text.expect(":")
        if name != "features":
            text.value()
        else:
            found = True
            if text.peek() != "[":
                raise ValueError("features must be an array")
            text.expect("[")
            while text.peek() != "]":
                yield text.value()
                if text.peek() != "]":
                    text.expect(",")
            text.expect("]")
        if text.peek() != "}":
            text.expect(",")
    if not found:
        raise ValueError("the root has no features")


def _point(p) -> dict:
    return {"x": float(p[0]), "y": float(p[1])}


def parse_geometry(g: dict | None) -> dict | None:
    """The seven kinds as parts > rings > points; a collection's parts follow each other. None for what is not a geometry."""
    try:
        kind, c = g["type"], g.get("coordinates")
        line = lambda ps: [_point(p) for p in ps]
        if kind == "GeometryCollection":
            inner = [parse_geometry(x) for x in g["geometries"]]
            return None if None in inner else {"type": kind, "parts": [p for x in inner for p in x["parts"]]}
        parts = {
            "Point": lambda: [[[_point(c)]]],
            "MultiPoint": lambda: [[[_point(p)]] for p in c],
            "LineString": lambda: [[line(c)]],
            "MultiLineString": lambda: [[line(x)] for x in c],
            "Polygon": lambda: [[line(r) for r in c]],
            "MultiPolygon": lambda: [[line(r) for r in x] for x in c],
        }[kind]()
        return {"type": kind, "parts": parts}
    except (KeyError, TypeError, ValueError, IndexError, AttributeError):
        return None


def parse_feature(f) -> tuple | None:
    """(feature_id, object_type, properties, geom), or none for anything but a Feature with properties, an object_type and, if it has a geometry, a known one."""
    if not isinstance(f, dict) or f.get("type") != "Feature" or not isinstance(f.get("properties"), dict):
        return None
    p = f["properties"]
    kind, geom = p.get("object_type"), parse_geometry(f.get("geometry"))
    if kind in (None, "") or (geom is None and f.get("geometry") is not None):
        return None
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    return text(p.get("id")), text(kind), json.dumps(p, ensure_ascii=False), geom


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def list_files(path: str) -> list[str]:
    """The file itself, or the collections below a folder; hidden files are passed over."""
    system, inner = _filesystem(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.base_name.endswith((".geojson", ".json")) and not f.base_name.startswith(("_", ".")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _rows(path: str) -> Iterator[tuple]:
    system, inner = _filesystem(path)
    with system.open_input_stream(inner) as stream:
        for f in iter_features(stream):
            row = parse_feature(f)
            if row is not None:
                kind, text, props, geom = row
                shape = geom and (geom["type"], [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in geom["parts"]])
                yield kind, text, props, shape


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p) for p in list_files(self.path)]

    def read(self, partition):
        return iter(()) if partition is None else _rows(partition.path)


class _StreamReader(DataSourceStreamReader):
    """An offset names the files seen, by time and path, so each is read once, even one that arrives with an old time."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"seen": []}

    def latestOffset(self):
        seen = []
        for p in list_files(self.path):
            system, inner = _filesystem(p)
            seen.append(f"{system.get_file_info(inner).mtime_ns or 0}:{p}")
        return {"seen": sorted(seen)}

    def partitions(self, start, end):
        return [_File(f.split(":", 1)[1]) for f in sorted(set(end["seen"]) - set(start["seen"]))]

    def read(self, partition):
        return _rows(partition.path)


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """One collection a task, from a single string column ``feature``; files of failed attempts are removed."""

    def __init__(self, path: str, overwrite: bool):
        import uuid

        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        c = TaskContext.get()
        system, inner = _filesystem(self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/.part-{c.partitionId():05d}-{c.taskAttemptId()}-{self.run}.geojson"
        with system.open_output_stream(name) as out:
            write_collection(out, (row[0] for row in iterator))
        return _Done(name)

    def commit(self, messages):
        system, inner = _filesystem(self.path)
        new = [m.path for m in messages if m]
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.base_name.startswith("part-"):
                    system.delete_file(f.path)
        for name in new:  # becomes visible only now
            system.move(name, name.replace("/.part-", "/part-"))
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


class GeoJsonSource(DataSource):
    @classmethod
    def name(cls):
        return "geojson"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite):
        if len(schema.fields) != 1:
            raise ValueError("the sink takes one string column: see feature_json")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(GeoJsonSource)


def write_collection(out: IO[bytes], features: Iterator[str]) -> int:
    """Writes feature texts as one collection, one at a time; returns their number."""
    out.write(b'{"type":"FeatureCollection","features":[')
    n = 0
    for f in features:
        out.write((b",\n" if n else b"\n") + f.encode())
        n += 1
    out.write(b"\n]}\n")
    return n


def geometry_json(geom: Column) -> Column:
    """GeoJSON text of a geometry column; null stays null. Collections are written as a collection of their parts' polygons, lines or points."""
    point = lambda p: F.array(p.x, p.y)
    ring = lambda r: F.transform(r, point)
    part = lambda p: F.transform(p, ring)
    parts, kind = geom["parts"], geom["type"]
    first = F.get(parts, F.lit(0))
    one = lambda p: F.when(F.size(p) > 1, F.lit("Polygon")).when(F.size(p[0]) == 1, F.lit("Point")).when((F.size(p[0]) > 3) & (p[0][0] == F.element_at(p[0], -1)), F.lit("Polygon")).otherwise(F.lit("LineString"))
    coordinates = lambda k, p: F.when(k == "Point", F.to_json(point(p[0][0]))).when(k == "LineString", F.to_json(ring(p[0]))).otherwise(F.to_json(part(p)))
    shape = lambda k, c: F.concat(F.lit('{"type":"'), k, F.lit('","coordinates":'), c, F.lit("}"))
    members = F.array_join(F.transform(parts, lambda p: shape(one(p), coordinates(one(p), p))), ",")
    many = F.when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: point(p[0][0])))).when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: ring(p[0])))).when(kind == "MultiPolygon", F.to_json(F.transform(parts, part)))
    return F.when(kind == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), members, F.lit("]}"))).otherwise(shape(kind, F.coalesce(many, coordinates(kind, first))))


def feature_json(properties: Column, geometry: Column | None) -> Column:
    """Feature text from a struct (nulls are written) or JSON text of properties and geometry text; a null geometry is written as null."""
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.coalesce(geometry if geometry is not None else F.lit(None).cast("string"), F.lit("null")), F.lit("}"))


def properties_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def export_file(features: DataFrame, path: str, *order: str) -> int:
    """One ordered file through the driver, a row at a time; for results that one reader takes, such as a project's variants."""
    system, inner = _filesystem(path)
    with system.open_output_stream(inner) as out:
        return write_collection(out, (r[0] for r in features.orderBy(*order).select("feature").toLocalIterator()))
