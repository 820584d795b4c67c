"""Loaders and files."""

import io
import json
import zipfile

import pytest

from loomgrid.sources import datasets as D
from loomgrid.sources import files as FS


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_chickenpox(spark, tmp_path):
    source = {"edges": [[0, 1], [1, 0], [1, 1]], "node_ids": {"B": 1, "A": 0}, "FX": [[0.0, 10.0], [1, 11], [2, 12], [3, 13]]}
    signal = D.chickenpox(spark, put(tmp_path, "c.json", json.dumps(source)), 2)
    assert signal.steps == 2 and signal.graph.edge_count() == 3
    assert sorted(map(tuple, signal.series.collect())) == [(0, 0, 0, 1, 2), (0, 1, 1, 2, 3), (1, 0, 10, 11, 12), (1, 1, 11, 12, 13)]
    assert signal.violations().count() == 0
    for change in ({"node_ids": {"A": 0, "B": 2}}, {"FX": [[0.0], [1.0, 2.0]]}, {"edges": [[0, 5]]}):
        with pytest.raises(D.DatasetError):
            D.chickenpox(spark, put(tmp_path, "bad.json", json.dumps(source | change)), 1)
    with pytest.raises(D.DatasetError):
        D.chickenpox(spark, str(tmp_path / "c.json"), 4)


BUS = {
    "directed": True, "multigraph": False,
    "nodes": [{"bus_stop": 30, "lon": 1.0, "lat": 2.0, "X": {"y": [1.0, 2.0, 3.0]}, "y": [10.0, 20.0, 30.0]}, {"bus_stop": 7, "lon": 4.0, "lat": 6.0, "X": {"y": [4.0, 5.0, 6.0]}, "y": [40.0, 50.0, 60.0]}],
    "links": [{"source": 30, "target": 7, "weight": 5.0}, {"source": 7, "target": 30, "weight": 6.0}],
}


def test_montevideo(spark, tmp_path):
    bus = D.montevideo_bus(spark, put(tmp_path, "m.json", json.dumps(BUS)), 1)
    assert sorted((r.source, r.target, r.road_distance) for r in bus.signal.graph.edges.collect()) == [(0, 1, 5.0), (1, 0, 6.0)]
    assert sorted(map(tuple, bus.signal.series.collect())) == [(0, 0, 1.0, 20.0), (0, 1, 2.0, 30.0), (1, 0, 4.0, 50.0), (1, 1, 5.0, 60.0)]
    assert sorted(map(tuple, bus.position.collect())) == [(0, 1.0, 2.0), (1, 4.0, 6.0)]


@pytest.mark.parametrize("change", [{"directed": False}, {"links": [{"source": 30, "target": 99, "weight": 1.0}]}, {"links": BUS["links"] + BUS["links"][:1]}, {"links": [{"source": 30, "target": 7, "weight": 0.0}]}, {"nodes": [BUS["nodes"][0], BUS["nodes"][0]]}])
def test_wrong_montevideo(spark, tmp_path, change):
    with pytest.raises(D.DatasetError):
        D.montevideo_bus(spark, put(tmp_path, "m.json", json.dumps(BUS | change)), 1)


def metr(folder, **changes):
    texts = {
        "graph_sensor_ids.txt": "a,b,c", "METR-LA.csv": ",a,b,c\n2012-03-01 00:00:00,10,0,30\n2012-03-01 00:05:00,11,21,31\n2012-03-01 00:10:00,12,22,0\n",
        "distances_la_2012.csv": "from,to,cost\na,a,0\na,b,1\nb,a,2\nb,b,0\nb,c,4\nc,a,10\nc,c,0\noutside,a,1\n",
    } | changes
    for n, t in texts.items():
        put(folder, n, t)
    return str(folder)


def test_metr_la(spark, tmp_path):
    data = D.metr_la(spark, metr(tmp_path))
    assert data.steps == 3 and data.speed.filter("not observed").count() == 2
    edges = {(r.source, r.target): r.affinity for r in data.graph.edges.collect()}
    assert edges[(0, 0)] == 1.0 and (2, 0) not in edges and (0, 1) in edges


@pytest.mark.parametrize("name, text", [("METR-LA.csv", ",a,c,b\n2012-03-01 00:00:00,1,2,3\n"), ("METR-LA.csv", ",a,b,c\n2012-03-01 00:00:00,1,2,3\n2012-03-01 00:07:00,1,2,3\n"), ("METR-LA.csv", ",a,b,c\n2012-03-01 00:00:00,1,-2,3\n"), ("distances_la_2012.csv", "from,to,cost\na,a,0\nb,b,0\n"), ("distances_la_2012.csv", "from,to,cost\na,a,0\na,a,0\nb,b,0\nc,c,0\n"), ("graph_sensor_ids.txt", "a,a,c")])
def test_wrong_metr_la(spark, tmp_path, name, text):
    with pytest.raises(D.DatasetError):
        D.metr_la(spark, metr(tmp_path, **{name: text}))


def zipped(**changes):
    texts = {"A": "1, 2\n2, 1\n3, 4\n4, 3\n", "graph_indicator": "1\n1\n2\n2\n2\n", "node_labels": "0\n3\n6\n1\n0\n", "edge_labels": "0\n0\n2\n2\n", "graph_labels": "1\n-1\n"} | changes
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in texts.items():
            z.writestr(f"MUTAG/MUTAG_{n}.txt", t)
    return out.getvalue()


def test_mutag(spark):
    c = D.graph_collection(spark, zipped())
    assert sorted(map(tuple, c.graphs.collect())) == [(0, 1), (1, 0)]
    assert sorted(map(tuple, c.nodes.collect())) == [(0, 0, 0), (0, 1, 3), (1, 0, 6), (1, 1, 1), (1, 2, 0)]
    assert sorted((r.graph, r.source, r.target, r.label) for r in c.edges.collect()) == [(0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 1, 2), (1, 1, 0, 2)]


@pytest.mark.parametrize("change", [{"A": "1, 2\n2, 1\n3, 4\n4, 1\n"}, {"A": "1, 1\n2, 1\n3, 4\n4, 3\n"}, {"edge_labels": "0\n1\n2\n2\n"}, {"graph_indicator": "1\n2\n1\n2\n2\n"}, {"graph_labels": "1\n3\n"}, {"node_labels": "0\n3\n7\n1\n0\n"}, {"A": "1, 2\n2, x\n3, 4\n4, 3\n"}])
def test_wrong_mutag(spark, change):
    with pytest.raises(D.DatasetError):
        D.graph_collection(spark, zipped(**change))
    with pytest.raises(D.DatasetError):
        D.graph_collection(spark, b"none")


def test_files_are_whole_or_absent(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id * 2 as v")
    manifest = FS.publish(rows.coalesce(1), str(tmp_path / "out"), "csv", ["id"])
    one = manifest.collect()
    assert len(one) == 1 and one[0]["rows"] == 10 and not (tmp_path / "out.part").exists()
    FS.verify(spark, str(tmp_path / "out"), manifest)
    name = one[0]["name"]
    assert FS.scan_csv(spark, str(tmp_path / "out" / name), "id long, v long").count() == 10
    with pytest.raises(FS.SourceError):
        FS.scan_csv(spark, str(tmp_path / "out" / name), "v long, id long")
    with pytest.raises(FS.SourceError):
        FS.publish(rows, str(tmp_path / "out"), "csv")
    (tmp_path / "out" / name).write_text("changed")
    (tmp_path / "out" / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(FS.SourceError):
        FS.verify(spark, str(tmp_path / "out"), spark.createDataFrame([(name, one[0]["bytes"], one[0]["sha256"])], "name string, bytes long, sha256 string"))
    with pytest.raises(FS.SourceError):
        FS.require_columns(rows, ["id", "w"])


def test_days_are_planned(spark):
    index = spark.createDataFrame([("2024-01-01", "a", 5), ("2024-01-03", "c", 5), ("2024-01-03", "d", 5), ("2023-12-31", "z", 5)], "service_date string, path string, bytes long")
    chosen, bad = FS.plan_days(index, "2024-01-01", "2024-01-03", "2024-01-03", 12)
    assert chosen.count() == 3 and sorted(map(tuple, bad.collect())) == [("day missing", "2024-01-02"), ("day not complete", "2024-01-03"), ("day repeated", "2024-01-03"), ("too many bytes", "15")]


def test_observation(spark):
    assert json.loads(FS.observation(spark.range(1), {"a": 1})) == {"settings": {"a": 1}, "observation": {"id": 0}}
    with pytest.raises(FS.SourceError):
        FS.observation(spark.range(2))
