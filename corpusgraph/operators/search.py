"""Searches over stored adjacency: bounded impact of node sets, shortest flows from both ends.

The adjacency is written once, bucketed by node, so that a level brings its frontier to the edges and the edges
are never exchanged again. A hub's edges are dealt over several buckets; each row says in how many parts its
neighbour lies, so that a frontier row is copied to the parts of its node without a lookup.
"""

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.tables import new_path, written

FOLLOWED = ("calls", "imports")
NODE = ["repo_id", "id"]
PLACE = [*NODE, "part"]
#: Most neighbours of a node in one part, and rows of a bucket aimed at.
HUB, BUCKET_ROWS = 100_000, 2_000_000
#: Parents that one job of the way back follows.
STRIDE = 4


def neighbours(edges: DataFrame, kinds=FOLLOWED) -> DataFrame:
    """Undirected adjacency ``(repo_id, id, next)`` over some edge types."""
    kept = edges.where(F.col("type").isin(list(kinds)))
    return kept.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("next")).unionByName(
        kept.select("repo_id", F.col("dst").alias("id"), F.col("src").alias("next")))


@dataclass
class Adjacency:
    """``rows``: (repo_id, id, part, next, next_parts); ``hubs``: (repo_id, id, parts) of nodes with several parts, or None."""
    rows: DataFrame
    hubs: DataFrame | None = None

    @classmethod
    def of(cls, edges: DataFrame, kinds=FOLLOWED) -> "Adjacency":
        """Not stored: for a search of a hop or two, where writing would cost more than it saves."""
        return cls(_rows(neighbours(edges, kinds), None))

    def placed(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (repo_id, id, ...) with the number of parts of each node."""
        found = nodes.join(self.hubs, NODE, "left") if self.hubs else nodes.withColumn("parts", F.lit(None).cast("int"))
        return found.withColumn("parts", F.coalesce("parts", F.lit(1)))

    def reached(self, frontier: DataFrame, *keep: str) -> DataFrame:
        """(keep, repo_id, id, next, next_parts) of the neighbours of a frontier with ``parts``."""
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if self.hubs else F.lit(0)
        return frontier.select(*keep, *NODE, part.alias("part")).join(self.rows, PLACE).select(*keep, *NODE, "next", "next_parts")


def _rows(both: DataFrame, hubs: DataFrame | None) -> DataFrame:
    if hubs is None:
        return both.select(*NODE, F.lit(0).alias("part"), "next", F.lit(1).alias("next_parts"))
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    return (
        both.join(hubs, NODE, "left")
        .join(hubs.select("repo_id", F.col("id").alias("next"), F.col("parts").alias("next_parts")), ["repo_id", "next"], "left")
        .select(*NODE, F.pmod(F.hash("next"), one("parts")).alias("part"), "next", one("next_parts").alias("next_parts"))
    )


@contextmanager
def stored(edges: DataFrame, kinds=FOLLOWED, hub: int = HUB):
    """Adjacency of ``edges`` for one or more searches; its name leaves the catalog afterwards.

    Edges are read twice (degrees, rows) and exchanged once: give a written table.
    """
    spark, both = edges.sparkSession, neighbours(edges, kinds)
    degrees = written(both.groupBy(*NODE).agg(F.count("*").alias("n")), "degrees")
    total, most = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_ROWS))
    hubs = None
    if most > hub:
        hubs = written(degrees.where(F.col("n") > hub).select(*NODE, F.ceil(F.col("n") / hub).cast("int").alias("parts")), "hubs")
    name = f"adjacency_{uuid.uuid4().hex}"
    _rows(both, hubs).repartition(buckets, *PLACE).write.bucketBy(buckets, *PLACE).sortBy(*PLACE).option("path", new_path(spark, "adjacency")).saveAsTable(name)
    try:
        yield Adjacency(spark.table(name), hubs)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def impact(seeds: DataFrame, edges: DataFrame, key: str = "seed", max_depth: int = 2, adjacency: Adjacency = None) -> DataFrame:
    """Nodes within ``max_depth`` undirected call/import hops of each seed, with the hop count.

    Each level is written, so its size is known to the planner (a small one is broadcast to the edges) and a lost
    executor repeats one level only. A neighbour of a level lies in it or in the one before or after it, so the
    last two levels are all that a new one is compared with. Several searches, or deep ones, share a ``stored`` adjacency.
    """
    adjacency = adjacency or Adjacency.of(edges)
    levels = [adjacency.placed(seeds.select(key, *NODE).distinct()).withColumn("hops", F.lit(0))]
    for hop in range(1, max_depth + 1):
        step = (
            adjacency.reached(levels[-1], key)
            .groupBy(key, "repo_id", F.col("next").alias("other")).agg(F.max("next_parts").alias("parts"))
            .withColumnRenamed("other", "id")
        )
        recent = reduce(DataFrame.unionByName, [before.select(key, *NODE) for before in levels[-2:]])
        levels.append(written(step.join(recent, [key, *NODE], "left_anti").select(key, *NODE, "parts", F.lit(hop).alias("hops")), "frontier"))
        if hop < max_depth and levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels).drop("parts")


PAIR = ["pair", "repo_id", "src", "dst"]
END = ["repo_id", "start"]


class _Levels:
    """Levels of a search, each written once and all read by one scan, so that plans do not grow with the rounds."""

    def __init__(self, spark):
        self.spark, self.paths, self.schema = spark, [], None

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def add(self, level: DataFrame) -> DataFrame:
        self.paths.append(new_path(self.spark, "level"))
        self.schema = self.schema or level.schema
        level.write.parquet(self.paths[-1])
        return self._read(self.paths[-1:])

    def all(self) -> DataFrame:
        return self._read(self.paths)


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_depth: int = None, hub: int = HUB) -> DataFrame:
    """Shortest undirected call path per ``(pair, repo_id, src, dst)``: rows ``(pair, repo_id, step, id)``.

    Both ends search towards each other. A node is searched from once, however many pairs begin or end there; of each pair the end with
    the smaller frontier, for each of the pairs that share it, advances, so a hub next to one end is not unfolded when the other end
    gets there. Where they meet, the nodes of the target's side that lie on a shortest path are followed forward, which gives the
    smallest parent at every node as a search from the source alone would.
    Pairs without a path, or with none of ``max_depth`` steps, have no rows; a pair of one node has one.
    """
    with stored(edges, ("calls",), hub) as adjacency:
        wanted = written(pairs.select(*PAIR).dropna(subset=PAIR).distinct(), "pairs")
        seen = _Levels(edges.sparkSession)
        starts = wanted.select("repo_id", F.explode(F.array("src", "dst")).alias("start")).distinct().withColumn("id", F.col("start"))
        seen.add(adjacency.placed(starts).select(*END, F.lit(0).alias("depth"), "id", F.lit(None).cast("string").alias("parent"), "parts"))
        met = [wanted.where("src = dst").select(*PAIR, F.lit(0).alias("step"), F.lit(0).alias("left"), F.col("src").alias("id"), F.lit(1).alias("parts"))]
        state = wanted.where("src <> dst").select(*PAIR, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b"))
        while True:
            # a pair whose end finds nothing new has no path and leaves
            state = state.where("n_a > 0 and n_b > 0" if max_depth is None else f"n_a > 0 and n_b > 0 and a + b < {int(max_depth)}")
            if state.isEmpty():
                break
            moving = written(_moving(state), "moving")
            grown = seen.add(_level(seen.all(), moving, adjacency)).groupBy(*END).agg(F.count("*").alias("n"))
            state = written(_moved(state, moving.join(grown, END, "left")), "pairs")
            met.append(written(_meeting(state.where("n_a > 0 and n_b > 0"), seen.all(), max_depth), "met"))
            state = state.join(met[-1].select(*PAIR).distinct(), PAIR, "left_anti")
        met = written(reduce(DataFrame.unionByName, met), "met")
        links = _parents(met, seen.all(), adjacency)
        return _walked(met.select(*PAIR, (F.col("step") + F.col("left")).alias("step"), "left").distinct(), links, seen.all())


def _moving(state: DataFrame) -> DataFrame:
    """(repo_id, start, depth) of the ends that advance: for each pair the one with the smaller frontier per open pair that shares it."""
    shared = state.select("repo_id", F.explode(F.array("src", "dst")).alias("start")).groupBy(*END).agg(F.count("*").alias("pairs"))
    for node, of in (("src", "pairs_a"), ("dst", "pairs_b")):
        state = state.join(shared.select("repo_id", F.col("start").alias(node), F.col("pairs").alias(of)), ["repo_id", node])
    first = F.col("n_a") / F.col("pairs_a") <= F.col("n_b") / F.col("pairs_b")
    return state.select("repo_id", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("start"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("depth")).distinct()


def _level(rows: DataFrame, moving: DataFrame, adjacency: Adjacency) -> DataFrame:
    """New nodes of the advancing ends; a neighbour of a level lies in it or in the one before or after it."""
    recent = rows.join(moving.withColumnRenamed("depth", "now"), END).where("depth >= now - 1")
    step = (
        adjacency.reached(recent.where("depth = now"), "start", "depth")
        .groupBy(*END, F.col("next").alias("other")).agg(F.max("depth").alias("depth"), F.min("id").alias("parent"), F.max("next_parts").alias("parts"))
        .withColumnRenamed("other", "id")
    )
    return step.join(recent.select(*END, "id"), [*END, "id"], "left_anti").select(*END, (F.col("depth") + 1).alias("depth"), "id", "parent", "parts")


def _moved(state: DataFrame, moved: DataFrame) -> DataFrame:
    """Pairs with the new depths and frontiers of their ends; an end without new nodes has a frontier of none."""
    for node, depth, n in (("src", "a", "n_a"), ("dst", "b", "n_b")):
        end = moved.select("repo_id", F.col("start").alias(node), (F.col("depth") + 1).alias("_depth"), F.coalesce("n", F.lit(0)).alias("_n"))
        state = state.join(end, ["repo_id", node], "left").withColumns({depth: F.coalesce("_depth", depth), n: F.coalesce("_n", n)}).drop("_depth", "_n")
    return state


def _meeting(state: DataFrame, rows: DataFrame, max_depth: int = None) -> DataFrame:
    """(pair, step, left, id, parts) of all nodes with which the shortest paths of a pair cross the last level of its smaller end.

    As the ends had not met before they advanced, every shortest path has a node in the last level of either end.
    """
    small = F.col("n_a") <= F.col("n_b")
    asked = state.select(*PAIR, small.alias("from_a"), F.when(small, F.col("src")).otherwise(F.col("dst")).alias("start"),
                         F.when(small, F.col("dst")).otherwise(F.col("src")).alias("other"), F.when(small, F.col("a")).otherwise(F.col("b")).alias("depth"))
    own = rows.join(asked, [*END, "depth"]).select(*PAIR, "from_a", "other", "depth", "id", "parts")
    far = rows.select("repo_id", F.col("start").alias("other"), "id", F.col("depth").alias("far"))
    step, left = [F.when(F.col("from_a"), F.col(x)).otherwise(F.col(y)) for x, y in (("depth", "far"), ("far", "depth"))]
    both = written(own.join(far, ["repo_id", "other", "id"]).select(*PAIR, step.alias("step"), left.alias("left"), "id", "parts"), "crossed")
    least = both.groupBy(*PAIR).agg(F.min(F.col("step") + F.col("left")).alias("least"))
    kept = both.join(least if max_depth is None else least.where(F.col("least") <= int(max_depth)), PAIR)
    return kept.where("step + left = least").drop("least")


def _parents(met: DataFrame, rows: DataFrame, adjacency: Adjacency) -> DataFrame:
    """(pair, step, id, parent) of the nodes behind the crossing that lie on a shortest path."""
    target = rows.select("repo_id", F.col("start").alias("dst"), F.col("depth").alias("left"), "id", "parts")
    out, front = [], met
    for _ in range(met.agg(F.max("left")).first()[0] or 0):
        step = (
            adjacency.reached(front.where("left > 0"), "pair", "src", "dst", "step", "left")
            .groupBy(*PAIR, (F.col("step") + 1).alias("step"), (F.col("left") - 1).alias("left"), F.col("next").alias("id")).agg(F.min("id").alias("parent"))
            .join(target, ["repo_id", "dst", "left", "id"])
        )
        front = written(step.select(*PAIR, "step", "left", "id", "parent", "parts"), "way")
        out.append(front.select(*PAIR, "step", "id", "parent"))
    return written(reduce(DataFrame.unionByName, out), "parents") if out else None


def _walked(ends: DataFrame, links: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Paths (pair, repo_id, step, id) from the targets back: along ``links`` to the crossing, then along the search of the source."""
    at = written(ends.select(*PAIR, "step", "left", F.col("dst").alias("id"), F.array("dst").alias("path")), "way")
    behind, before = at.agg(F.max("left"), F.max(F.col("step") - F.col("left"))).first()

    def back(known, on):
        found = at.join(known, [*on, "step", "id"], "left")
        return found.select(*PAIR, F.when(F.col("parent").isNull(), F.col("step")).otherwise(F.col("step") - 1).alias("step"), F.coalesce("parent", "id").alias("id"),
                            F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))

    for k in range(1, (behind or 0) + 1):
        at = back(links, PAIR)
        if k % STRIDE == 0 or k == behind:
            at = written(at, "way")
    searched = rows.select("repo_id", F.col("start").alias("src"), F.col("depth").alias("step"), "id", "parent")
    for _ in range(before or 0):
        at = written(back(searched, ["repo_id", "src"]), "way")
    return at.select("pair", "repo_id", F.posexplode("path").alias("step", "id"))
