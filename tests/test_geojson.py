"""GeoJSON source, sink and stream."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from gridloom.sources import geojson
from gridloom.streaming import feature_stream, running_report

GEOMETRIES = [
    {"type": "Point", "coordinates": [37.5, 55.5]},
    {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]},
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]},
    {"type": "MultiPoint", "coordinates": [[1.0, 1.0], [2.0, 2.0]]},
    {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 6.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]}]},
    None,
]


def feature(i, g, **more):
    return {"type": "Feature", "properties": {"id": i, "object_type": "restriction", "note": "теплосеть ☃ " * 3, **more}, "geometry": g}


def collection(features):
    return json.dumps({"type": "FeatureCollection", "crs": {"features": [1, {"a": "]"}]}, "features": features, "after": [2]}, ensure_ascii=False)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 16])
def test_blocks_of_any_size_give_the_same(monkeypatch, block):
    monkeypatch.setattr(geojson, "BLOCK", block)
    features = [feature(i, g) for i, g in enumerate(GEOMETRIES)] + [12345, 1.5e3, None]
    assert list(geojson.iter_features(io.BytesIO(("﻿ " + collection(features)).encode()))) == features


@pytest.mark.parametrize("text", ["[]", "", "{}", '{"type":"x"}', '{"features":{}}', '{"features":null}', '{"features":[{}', '{"features":[{} {}]}'])
def test_broken_collections_are_errors(text):
    with pytest.raises(ValueError):
        list(geojson.iter_features(io.BytesIO(text.encode())))


def test_rows_that_are_no_features_are_dropped():
    good = feature(1, GEOMETRIES[0])
    bad = [None, 5, {**good, "type": "x"}, {**good, "properties": None}, {**good, "properties": {"object_type": ""}}, {**good, "properties": {"id": 1}}, {**good, "geometry": {"type": "Circle"}}, {**good, "geometry": {"type": "Point", "coordinates": []}}]
    assert [geojson.parse_feature(f) is not None for f in [good, *bad]] == [True] + [False] * len(bad)
    assert geojson.parse_feature(good)[0] == "1"


def features_of(df):
    own = geojson.feature_json(F.col("properties"), geojson.geometry_json(F.col("geom")))
    return df.select("feature_id", own.alias("feature"))


def test_round_trip(spark, tmp_path):
    geojson.register(spark)
    wanted = [feature(i, g) for i, g in enumerate(GEOMETRIES)]
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.geojson").write_text(collection(wanted[k::2]))
    df = spark.read.format("geojson").load(str(tmp_path / "in"))
    assert df.count() == len(wanted)
    out = str(tmp_path / "out")
    for _ in range(2):  # overwriting leaves nothing of the first run
        features_of(df).select("feature").repartition(3).write.format("geojson").mode("overwrite").save(out)
    read = spark.read.format("geojson").load(out)
    again = sorted(json.loads(r.feature)["properties"]["id"] for r in features_of(read).collect())
    assert again == list(range(len(wanted)))
    assert geojson.export_file(features_of(read), str(tmp_path / "all.geojson"), "feature_id") == len(wanted)
    assert json.loads((tmp_path / "all.geojson").read_text())["features"] == wanted


def test_null_properties_are_written(spark):
    row = spark.range(1).select(geojson.feature_json(geojson.properties_json(F.col("id"), F.lit(None).cast("double").alias("depth")), None).alias("feature")).first()
    assert json.loads(row.feature) == {"type": "Feature", "properties": {"id": 0, "depth": None}, "geometry": None}


def test_stream_reads_new_files_once(spark, tmp_path):
    geojson.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        q = spark.readStream.format("geojson").load(str(tmp_path / "in")).select("feature_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "table"))
        q.awaitTermination()
        return sorted(r.feature_id for r in spark.read.schema("feature_id string").parquet(str(tmp_path / "table")).collect())

    (tmp_path / "in" / "a.geojson").write_text(collection([feature(1, None)]))
    assert run() == ["1"]
    (tmp_path / "in" / "b.geojson").write_text(collection([feature(2, None), feature(3, None)]))
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]
    (tmp_path / "in" / "late.geojson").write_text(collection([feature(4, None)]))
    os.utime(tmp_path / "in" / "late.geojson", (1_000_000, 1_000_000))  # older than all that was read
    assert run() == ["1", "2", "3", "4"]


def test_running_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.geojson").write_text(collection([feature(1, None), feature(None, None)]))
    q = running_report(feature_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("report").start()
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "b.geojson").write_text(collection([feature(2, None)]))
        q.processAllAvailable()
        assert {r.code: r.n for r in spark.table("report").collect()} == {"total": 3, "missing_id": 1, "restriction_without_type": 3}
    finally:
        q.stop()
