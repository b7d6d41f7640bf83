"""Traversal of a lineage graph kept as vertices (id, kind) and edges (src, dst, label)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = 10, upstream: bool = False) -> DataFrame:
    """(root, node, distance): all nodes within ``depth`` steps (None: any number) of each start (root), by true breadth-first
    search; the root itself only if a cycle leads back. Starts that aren't in the graph reach nothing.

    Each step is one join of the frontier with the edges; visited nodes are removed by an anti-join, so a step costs what
    is new. Lineage is cut every few steps by a checkpoint.
    """
    src, dst = ("dst", "src") if upstream else ("src", "dst")
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d")).filter("__s is not null and __d is not null").distinct()
    frontier = starts.select(F.col(starts.columns[0]).alias("root")).distinct().withColumn("node", F.col("root"))
    seen = None
    for k in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(links, F.col("node") == F.col("__s")).select("root", F.col("__d").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = checkpointed(step)
        if frontier.isEmpty():
            break
        found = frontier.withColumn("distance", F.lit(k))
        seen = found if seen is None else seen.union(found)
        if k % 16 == 0:
            seen = checkpointed(seen)
    return seen if seen is not None else frontier.withColumn("distance", F.lit(0)).limit(0)


def shortest_path(edges: DataFrame, start: str, end: str) -> list | None:
    """One shortest path of any length as a list of nodes, or None. Each node keeps one path, so the frontier never outgrows
    the graph; the search ends when no new node is found."""
    links = edges.select("src", "dst").distinct()
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    frontier = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    seen = frontier.select("node")
    if start == end:
        return [start]
    for k in count(1):
        step = frontier.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = checkpointed(step.join(seen, "node", "left_anti"))
        hit = frontier.filter(F.col("node") == end).select("path").first()
        if hit:
            return list(hit["path"])
        if frontier.isEmpty():
            return None
        seen = seen.union(frontier.select("node"))
        if k % 16 == 0:
            seen = checkpointed(seen)


def impact(vertices: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    """Per start: downstream nodes n, those of kind ``model``, and the risk of n + 2 m: from 20 critical, 10 high, 5 medium."""
    down = reach(edges, starts, depth).join(vertices.select(F.col("id").alias("node"), "kind"), "node", "left")
    n, m = F.count(F.lit(1)), F.count_if(F.col("kind") == "model")
    score = F.col("downstream") + 2 * F.col("models")
    return down.groupBy("root").agg(n.alias("downstream"), m.alias("models")).withColumn("risk_score", score).withColumn("risk", F.when(score >= 20, "critical").when(score >= 10, "high").when(score >= 5, "medium").otherwise("low"))


def impact_by_kind(vertices: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 10) -> DataFrame:
    down = reach(edges, starts, depth).join(vertices.select(F.col("id").alias("node"), "kind"), "node", "left")
    return down.groupBy("root", "kind").agg(F.count(F.lit(1)).alias("n"))


def dangling(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, missing): edges that name a node which isn't there."""
    ids = vertices.select(F.col("id"))
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(ids, ends["missing"] == ids["id"], "left_anti").select("src", "dst", "missing")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves in any number of steps. Nodes without edges in or out are trimmed first, again and again,
    so a graph without cycles costs no search."""
    links = checkpointed(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    n = links.count()
    while n:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        links, before = checkpointed(kept.select("src", "dst")), n
        n = links.count()
        if n == before:
            break
    nodes = links.select(F.col("src").alias("id")).distinct()
    return reach(links, nodes, None).filter("root = node").select(F.col("root").alias("id"))


def orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.join(linked, "id", "left_anti")


def subgraph(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """Edges between nodes within reach of the start, up, down or both ways."""
    parts = [reach(edges, start, depth, upstream=u).select("node") for u, way in ((True, "up"), (False, "down")) if direction in (way, "both")]
    nodes = start.select(F.col(start.columns[0]).alias("node"))
    for p in parts:
        nodes = nodes.union(p)
    nodes = nodes.distinct()
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def dot(vertices: DataFrame, edges: DataFrame, most: int = 10_000) -> str:
    """The graph in DOT; for display, so at most that many edges or an error."""
    rows = edges.select("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    return "digraph lineage {\n" + "".join(f'  "{r.src}" -> "{r.dst}";\n' for r in rows) + "}\n"
