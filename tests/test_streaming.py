from levelgraph.store import Store
from levelgraph.streaming import windows

from .conftest import rows
from .test_graph import graph

BATCHES = [(0, 1, 0), (0, 1, 1), (0, 2, 2), (0, 1, 3)]


def test_window_weights(spark):
    g = graph(spark, BATCHES)
    weights = lambda k, w: {(a, b): n for a, b, n, _ in rows(windows.window_weights(g.window(max(0, k - w + 1), k)))}
    assert weights(1, 2) == {(0, 1): 2}
    assert weights(2, 2) == {(0, 1): 1, (0, 2): 1}
    assert weights(3, 2) == {(0, 2): 1, (0, 1): 1}
    every = rows(windows.all_window_weights(g.edges, 2), "batch", "src", "dst", "weight")
    assert every == sorted((k, a, b, n) for k in range(4) for (a, b), n in weights(k, 2).items())


def test_replay(spark):
    g = graph(spark, BATCHES)
    seen = [(k, df.count()) for k, df in windows.replay(g.edges, 2, lambda w: w.view)]
    assert seen == [(0, 1), (1, 2), (2, 2), (3, 2)]
    assert [df.count() for _, df in windows.replay(g.edges, 2, lambda w: w.view, max_batches=2, compat_window=True)] == [1, 1]
    assert rows(windows.numbered_batches(g.edges, ["edge_id"], 2), "edge_id", "created_level") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_stream_into_store(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([(k, 9, float(k))] * (k + 1), "src long, dst long, weight double").coalesce(1).write.parquet(str(source / f"b{k}"))
    stream = spark.readStream.schema("src long, dst long, weight double").option("maxFilesPerTrigger", 1).parquet(str(source) + "/*")
    store, seen = Store(spark, str(tmp_path / "db")), []
    q = windows.stream_into(stream, store, 2, str(tmp_path / "cp"), lambda g, k: seen.append((k, g.view.count())))
    q.processAllAvailable()
    q.stop()
    assert [k for k, _ in seen] == [0, 1, 2, 3] and store.levels() == [2, 3]
    assert sum(n for _, n in seen) > 10 and store.open().view.count() == seen[-1][1]


def test_event_time(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:01' as ts, 1L as src, 2L as dst union all select timestamp'2024-01-01 00:00:02', 1L, 2L").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, src long, dst long").parquet(str(tmp_path / "ev"))
    q = windows.event_time_weights(stream, "ts", "1 minute").writeStream.outputMode("complete").format("memory").queryName("weights").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("weights"), "src", "dst", "weight") == [(1, 2, 2)]
