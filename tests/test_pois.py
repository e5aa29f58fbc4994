import json

import pytest

from sitewise import schemas
from sitewise.operators.pois import distinct_elements, exclude_name, exclude_tag, flatten
from sitewise.sources.overpass import OverpassReader, build_query, recorded_elements

ELEMENTS = [
    ("node", 1, 55.7, 37.6, None, {"name": "Центр", "amenity": "clinic"}), ("way", 2, None, None, (55.8, 37.7), None), ("way", 3, None, None, None, {"name": "x"}),
]


def test_flatten(spark):
    got = flatten(spark.createDataFrame(ELEMENTS, schemas.ELEMENT)).orderBy("osm_id").collect()
    assert [tuple(r) for r in got] == [(1, "node", "Центр", "clinic", None, 37.6, 55.7), (2, "way", None, None, None, 37.7, 55.8)]


def test_filters_keep_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "laboratory", "ЭСТЕТИКА"), (3, "clinic", "ok")], "i int, healthcare string, name string")
    ids = lambda df: {r["i"] for r in df.collect()}
    assert ids(exclude_tag(rows, ["laboratory"])) == {1, 3} and ids(exclude_tag(rows, [])) == {1, 2, 3}
    assert ids(exclude_name(rows, ["эстет", "x|y"])) == {1, 3} and ids(exclude_name(rows, None)) == {1, 2, 3}


def test_union_has_each_element_once(spark):
    df = spark.createDataFrame(ELEMENTS, schemas.ELEMENT)
    assert distinct_elements(df, df.limit(2)).count() == 3


def test_query():
    got = build_query([1, 2, 3, 4], ["amenity=clinic"])
    assert got == '[out:json][timeout:60];(node["amenity"="clinic"](2,1,4,3);way["amenity"="clinic"](2,1,4,3););out center;'
    with pytest.raises(ValueError):
        build_query([1, 2, 3, 4], ["amenity"])


def test_recorded_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"type": "node", "id": 5, "lat": 1.0, "lon": 2.0, "tags": {"name": "n"}}]}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": []}))
    assert [r["osm_id"] for r in flatten(recorded_elements(spark, str(tmp_path))).collect()] == [5]


def test_reader_tries_again(monkeypatch):
    reader = OverpassReader({"url": "u", "bbox": "1,2,3,4", "tags": "a=b", "retries": "3", "pause_s": "0"})
    calls = []

    def fetch(query):
        calls.append(query)
        if len(calls) < 3:
            raise OSError("down")
        return {"elements": [{"type": "way", "id": 1, "center": {"lat": 1.0, "lon": 2.0}}]}

    monkeypatch.setattr(reader, "_fetch", fetch)
    assert list(reader.read(reader.partitions()[0])) == [("way", 1, None, None, (1.0, 2.0), {})]

    monkeypatch.setattr(reader, "_fetch", lambda q: 1 / 0)
    with pytest.raises(RuntimeError):
        list(reader.read(reader.partitions()[0]))
