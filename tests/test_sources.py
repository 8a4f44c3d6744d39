import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from levelgraph import tasks
from levelgraph.sources import fgf, generators, registry, snap, xs1
from levelgraph.store import Store

from .conftest import rows


def test_snap(spark, tmp_path):
    p = tmp_path / "a.net"
    p.write_text("# comment\n\n1 2\n3\t4\n  5   6  \nbad line\n7 8 9\n")
    assert rows(snap.read_snap(spark, str(p))) == [(1, 2), (3, 4), (5, 6)]
    p.write_text("x\n" * 100 + "1 2\n")
    with pytest.raises(ValueError):
        snap.read_snap(spark, str(p))
    snap.write_snap(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "b.net"))
    assert rows(snap.read_snap(spark, str(tmp_path / "b.net"))) == [(1, 2)]


def test_xs1(spark, tmp_path):
    p = tmp_path / "a.xs1"
    p.write_bytes(struct.pack("<IIf", 1, 2, 0.5) + struct.pack("<IIf", 2**32 - 1, 0, float("nan")))
    got = xs1.read_xs1(spark, str(p))
    assert rows(got, "src", "dst") == [(1, 2), (2**32 - 1, 0)] and got.where("isnan(weight)").count() == 1
    assert xs1.read_xs1(spark, str(p), weights=False).columns == ["src", "dst"]
    assert xs1.scan_ini(spark, str(p), "a") == {"vertices": 2**32, "edges": 2}
    assert xs1.read_ini(str(p))["edges"] == "2"
    with pytest.raises(FileExistsError):
        xs1.scan_ini(spark, str(p), "a")
    p.write_bytes(b"12345")
    with pytest.raises(ValueError):
        xs1.read_xs1(spark, str(p))
    e = spark.range(1000).selectExpr("id as src", "id * 2 as dst", "cast(id as float) as weight")
    xs1.write_xs1(e, str(tmp_path / "b.xs1"))
    assert rows(xs1.read_xs1(spark, str(tmp_path / "b.xs1"))) == rows(e)
    with pytest.raises(FileExistsError):
        xs1.write_xs1(e, str(tmp_path / "b.xs1"))
    both = xs1.snap_to_weighted(spark.createDataFrame([(1, 2)], "src long, dst long"), 1, both_ways=True).collect()
    assert len(both) == 2 and both[0].weight == both[1].weight and 0 <= both[0].weight < 1


def test_fgf(spark, tmp_path):
    nodes = pd.DataFrame({"node_kind": ["person"] * 300 + ["page"], "name": ["é" * (i % 40) for i in range(300)] + [None], "age": [float(i) for i in range(301)]})
    nodes["age"] = nodes["age"].astype(int)
    edges = pd.DataFrame({"src": [0, 1, 300], "dst": [1, 300, 0], "edge_kind": ["knows", "knows", "links"], "big": [2**40, None, 5]}, dtype=object)
    path = str(tmp_path / "g.fgf")
    fgf.write_fgf(edges, nodes, {"name": "string", "age": "int", "big": "bigint"}, path)
    e, n = fgf.read_fgf(spark, path)
    assert rows(e, "src", "dst", "edge_kind", "big", "file_edge") == [(0, 1, "knows", 2**40, 0), (1, 300, "knows", None, 1), (300, 0, "links", 5, 2)]
    got = rows(n, "id", "node_kind", "name", "age")
    assert len(got) == 301 and got[39] == (39, "person", "é" * 39, 39) and got[300] == (300, "page", None, 300)
    g = registry.load(spark, path)
    assert g.max_nodes == 301 and rows(g.node_property("age"))[5] == (5, 5)
    data = (tmp_path / "g.fgf").read_bytes()
    (tmp_path / "cut.fgf").write_bytes(data[:-10])
    with pytest.raises(Exception, match="ends too early|end is missing"):
        fgf.read_fgf(spark, str(tmp_path / "cut.fgf"))[0].collect()
    (tmp_path / "no.fgf").write_bytes(b"nothing at all")
    with pytest.raises(ValueError):
        fgf.read_fgf(spark, str(tmp_path / "no.fgf"))


def test_generators(spark):
    a = generators.erdos_renyi(spark, 50, 2000, seed=3)
    assert rows(a) == rows(generators.from_spec(spark, "ER(50, 2000, 3)")) and a.count() == 2000
    low, high = a.agg(F.min("src"), F.max("dst")).first()
    assert low == 0 and high == 49
    b = generators.rmat(spark, 8, 4, seed=1)
    assert b.count() == 1024 and rows(b) == rows(generators.from_spec(spark, "rmat(8, 4, .57, .19, .19, 1)"))
    assert b.where("src < 128").count() > 700  # three quarters
    for bad in ("ER(5)", "RMAT(0, 3)", "RMAT(5, 1, 2)", "XX(1)"):
        with pytest.raises(ValueError):
            generators.from_spec(spark, bad)


def test_spellings_and_noise(spark):
    assert rows(generators.from_spec(spark, "R-MAT(6, 4)")) == rows(generators.from_spec(spark, "rmat(6, 4)"))
    assert rows(generators.from_spec(spark, "ErdosRenyi(9, 30, 2)")) == rows(generators.from_spec(spark, "ER(9, 30, 2)"))
    e = generators.rmat(spark, 10, 60, seed=2)
    first = e.where("src >= 512 and dst >= 512").count() / e.count()  # the first choice has no noise
    assert abs(first - 0.05) < 0.005


def test_first_edges_in_file_order(spark, tmp_path):
    (tmp_path / "a.net").write_text("".join(f"{900 - i} {i}\n" for i in range(300)))
    assert rows(registry.load(spark, str(tmp_path / "a.net"), max_edges=3).view, "src", "dst") == [(898, 2), (899, 1), (900, 0)]
    xs1.write_xs1(spark.range(500, 0, -1).selectExpr("id as src", "1L as dst"), str(tmp_path / "b.xs1"))
    assert rows(registry.load(spark, str(tmp_path / "b.xs1"), max_edges=2).view, "src") == [(499,), (500,)]


def test_incremental_load(spark, tmp_path):
    (tmp_path / "a.net").write_text("0 1\n0 1\n")
    (tmp_path / "b.net").write_text("1 2\n1 2\n2 0\n")
    store = Store(spark, str(tmp_path / "db"))
    g = registry.append(store, str(tmp_path / "a.net"), str(tmp_path / "b.net"), deduplicate=True)
    assert rows(g.view, "src", "dst", "created_level") == [(0, 1, 0), (1, 2, 1), (2, 0, 1)] and rows(g.at(0).view, "src") == [(0,)]
    nodes = pd.DataFrame({"node_kind": ["x"] * 3, "age": [5, 6, 7]})
    edges = pd.DataFrame({"src": [0], "dst": [1], "edge_kind": ["k"]})
    fgf.write_fgf(edges, nodes, {"age": "int"}, str(tmp_path / "c.fgf"))
    g = registry.append(store, str(tmp_path / "c.fgf"))  # its vertices are new ones
    assert rows(g.within_level(2), "src", "dst") == [(3, 4)] and g.max_nodes == 6 and (5,) in rows(g.existing())
    assert rows(g.node_property("age"))[3:] == [(3, 5), (4, 6), (5, 7)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.net").write_text("".join(f"{i % 3} {i % 4}\n" for i in range(10)))
    a, db = str(tmp_path / "a.net"), str(tmp_path / "db")
    assert tasks.main([a, "-d", db, "-I"]) == 0 and tasks.main([a, "-d", db, "-I"]) == 0 and Store(spark, db).levels() == [0, 1]
    assert tasks.main([a, "-r", "bfs_count", "-B", "4", "-W", "2", "-M", "2", "-S", str(tmp_path / "s.csv")]) == 0
    lines = [x for x in capsys.readouterr().out.splitlines() if '"batch"' in x]
    assert len(lines) == 2 and '"batch": 1' in lines[1]
    assert tasks.main([a, "--part", "0/2", "-r", "bfs_count", "-S", str(tmp_path / "s.csv")]) == 0 and "utime" in (tmp_path / "s.csv").read_text()


def test_loading_levels(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.net").write_text(f"{k} {k + 1}\n{k} {k + 1}\n0 0\n")
    paths = [str(tmp_path / f"{k}.net") for k in range(3)]
    g = registry.load(spark, *paths, deduplicate=True, direction="double")
    assert g.num_levels == 3 and g.view.count() == 9 and g.view.select("edge_id").distinct().count() == 9
    assert registry.load(spark, *paths, max_level=1).view.count() == 6
    assert registry.load(spark, *paths, max_edges=1).view.count() == 3
    assert sum(registry.load(spark, paths[0], part=(k, 2)).view.count() for k in range(2)) == 3
    with pytest.raises(ValueError):
        registry.load(spark, paths[0], "ER(3, 3)")
    with pytest.raises(ValueError):
        registry.load(spark, "a.unknown")
    registry.register_loader("mine", lambda p: p.endswith(".mine"), lambda s, p: s.createDataFrame([(1, 2)], "src long, dst long"))
    assert rows(registry.load(spark, "x.mine").view, "src", "dst") == [(1, 2)]
