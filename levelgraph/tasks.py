"""Analyses by name, run again and again and reported like a benchmark; and a command line for loading and running."""

from __future__ import annotations

import argparse
import csv
import json
import platform
import resource
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .plans import betweenness, components, pagerank, traversal, triangles
from .tools import inspect


@dataclass(frozen=True)
class Task:
    """run gives a DataFrame; scalar, a number from it, or None."""

    name: str
    run: Callable[..., DataFrame]
    scalar: Callable[[DataFrame], float | None]


TASKS: dict[str, Task] = {}


def task(name: str, scalar: Callable[[DataFrame], float | None] = lambda df: None) -> Callable:
    """Registers a function from (graph, **options) to a DataFrame."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TASKS[name] = Task(name, f, scalar)
        return f

    return register


def _agg(fn, column: str) -> Callable[[DataFrame], float | None]:
    return lambda df: df.agg(fn(column)).first()[0]


def _only(df: DataFrame) -> float | None:
    return df.first()[0]


def _farthest(df: DataFrame) -> float | None:
    return traversal.farthest(df).first()[0]


def _hops(g: Graph, root: int = 0, **_) -> DataFrame:
    return traversal.bfs(g, root).select("id", F.col("level").cast("double").alias("dist"))


for _name, _single in (("pagerank", True), ("pagerank_push", True), ("pagerank_double", False), ("pagerank_double_push", False)):
    task(_name, _agg(F.sum, "rank"))(lambda g, iterations=10, single=_single, **_: pagerank.pagerank(g, iterations, single=single))
task("bfs_count", _only)(lambda g, root=0, **_: traversal.bfs_count(g, root))
task("sssp_unweighted", _farthest)(_hops)
task("sssp_unweighted_iter", _farthest)(lambda g, root=0, **_: traversal.shortest_paths(g, root))
task("sssp_weighted", _farthest)(lambda g, root=0, **_: traversal.shortest_paths(g, root, "weight"))
task("bc_adj", _agg(F.max, "bc"))(lambda g, **_: betweenness.betweenness(g))
task("bc_random", _agg(F.max, "bc"))(lambda g, sources=100, seed=1, **_: betweenness.betweenness(g, betweenness.drawn_sources(g, sources, seed)))
task("tarjan_scc", _agg(F.max, "component"))(lambda g, **_: components.strong_components(g))
task("tc_i", _only)(lambda g, **_: triangles.triangles(g))
task("tc_od", _only)(lambda g, **_: triangles.triangles(g))
task("tc_u", _only)(lambda g, **_: triangles.triangles_doubled(g))
task("avg_teen_cnt", _only)(lambda g, older_than=0, **_: triangles.avg_teen_followers(g, older_than))
task("level_spread")(lambda g, **_: inspect.level_spread(g))
task("degree_distribution")(lambda g, **_: inspect.degree_distribution(g))
task("edge_prop_stats", lambda df: df.first()["mean"])(lambda g, name="weight", **_: inspect.edge_property_stats(g, name))
task("dump")(lambda g, **_: inspect.dump(g))


@dataclass
class Run:
    """What running a task gave: its rows, its scalar, and the seconds of each repetition."""

    name: str
    result: DataFrame
    scalar: float | None
    seconds: list[float] = field(default_factory=list)
    used: dict[str, float] = field(default_factory=dict)  # of the driver process, over all repetitions

    def stats(self) -> dict[str, float]:
        dev = statistics.pstdev(self.seconds)
        return {
            "mean": statistics.mean(self.seconds), "stdev": dev, "min": min(self.seconds), "max": max(self.seconds),
            "c95": 1.96 * dev / len(self.seconds) ** 0.5,
        }

    def save_stats(self, path: str) -> None:
        """A CSV of the summary and a row for each repetition."""
        with open(path, "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["task", "scalar", *self.stats()])
            w.writerow([self.name, self.scalar, *self.stats().values()])
            w.writerow(["host", "python", "began", *self.used])
            w.writerow([platform.node(), platform.python_version(), time.strftime("%Y-%m-%dT%H:%M:%S"), *self.used.values()])
            w.writerow(["iteration", "seconds"])
            w.writerows(enumerate(self.seconds))


def run(name: str, graph: Graph, repeat: int = 1, **options) -> Run:
    """Runs a registered task; ValueError for an unknown name, or a property that the graph lacks."""
    if name not in TASKS:
        raise ValueError(f"no task {name}; there are {sorted(TASKS)}")
    t, seconds, before = TASKS[name], [], resource.getrusage(resource.RUSAGE_SELF)
    for _ in range(max(1, repeat)):
        began = time.perf_counter()
        result = t.run(graph, **options)
        scalar = t.scalar(result)
        if scalar is None:
            result.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    after = resource.getrusage(resource.RUSAGE_SELF)
    used = {k: getattr(after, f"ru_{k}") - getattr(before, f"ru_{k}") for k in ("utime", "stime", "minflt", "majflt", "inblock", "oublock")}
    return Run(name, result, scalar, seconds, used)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .sources.registry import DIRECTIONS, append, load
    from .store import Store, flatten
    from .streaming import windows

    p = argparse.ArgumentParser(prog="python -m levelgraph.tasks", description="Loads edge files, a level each, and runs a task on them.")
    p.add_argument("files", nargs="*", help="edge files, folders, or generators such as 'RMAT(10, 8)'")
    p.add_argument("-d", "--database", help="folder of a stored graph: loaded into if there are files, else opened")
    p.add_argument("-r", "--run", choices=sorted(TASKS))
    p.add_argument("-c", "--count", type=int, default=1, help="repetitions")
    p.add_argument("-n", "--iterations", type=int, default=10)
    p.add_argument("-R", "--root", type=int, default=0)
    p.add_argument("-D", "--deduplicate", action="store_true")
    p.add_argument("-N", "--no-properties", action="store_true")
    p.add_argument("-l", "--levels", help="N or N-M")
    p.add_argument("--direction", choices=sorted(DIRECTIONS), default="directed")
    p.add_argument("--max-edges", type=int)
    p.add_argument("--part", help="K/N: the K-th of N stretches of each file, from 0")
    p.add_argument("-I", "--incremental", action="store_true", help="add the files to the database as its next levels")
    p.add_argument("-B", "--batch", type=int, help="replay the edges as a stream of batches of so many, in order of their ids")
    p.add_argument("-W", "--window", type=int, default=10, help="batches that a task sees")
    p.add_argument("-M", "--max-batches", type=int)
    p.add_argument("--flatten", help="folder for the graph as one level")
    p.add_argument("-P", "--print", dest="show", help="adjacency of ids N or N-M")
    p.add_argument("-C", "--compare", nargs="+", help="files to compare with")
    p.add_argument("-o", "--output", help="folder for the task's rows, as CSV")
    p.add_argument("-S", "--save-stats", help="CSV for times")
    a = p.parse_args(argv)
    span = lambda s: (int(s.split("-")[0]), int(s.split("-")[-1])) if s else (None, None)
    spark = SparkSession.builder.getOrCreate()
    low, high = span(a.levels) if a.levels and "-" in a.levels else (None, span(a.levels)[1])
    how = {"direction": a.direction, "deduplicate": a.deduplicate, "properties": not a.no_properties, "max_edges": a.max_edges}
    if a.part:
        how["part"] = tuple(map(int, a.part.split("/")))
    if a.incremental:
        if not (a.files and a.database):
            p.error("an incremental load takes files and a database")
        graph = append(Store(spark, a.database), *a.files, direction=a.direction, deduplicate=a.deduplicate, properties=not a.no_properties)
    elif a.files:
        graph = load(spark, *a.files, min_level=low, max_level=high, **how)
        if a.database:
            Store(spark, a.database).save(graph)
    elif a.database:
        graph = Store(spark, a.database).open(high, low)
    else:
        p.error("give files or a database")
    if a.show:
        graph.adjacency(*span(a.show)).show(truncate=False)
    if a.compare:
        other = load(spark, *a.compare, **how)
        n, m = inspect.cross_validate(graph, other).count(), inspect.cross_validate_nodes(graph, other).count()
        print(f"{n} edges and {m} nodes differ")
        if n or m:
            return 1
    if a.flatten:
        Store(spark, a.flatten).save(flatten(graph))
    if a.run and a.batch:
        edges = windows.numbered_batches(graph.edges, ["edge_id"], a.batch)
        seen = lambda g: run(a.run, g, a.count, iterations=a.iterations, root=a.root)
        for k, done in windows.replay(edges, a.window, seen, a.max_batches):
            print(json.dumps({"batch": k, "task": a.run, "scalar": done.scalar, **done.stats()}))
    elif a.run:
        done = run(a.run, graph, a.count, iterations=a.iterations, root=a.root)
        print(json.dumps({"task": a.run, "scalar": done.scalar, **done.stats()}))
        if a.output:
            done.result.write.mode("overwrite").csv(a.output, header=True)
        else:
            done.result.orderBy(*done.result.columns[:1]).limit(50).show(50, truncate=False)
        if a.save_stats:
            done.save_stats(str(Path(a.save_stats)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
