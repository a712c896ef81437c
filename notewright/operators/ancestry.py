"""Hierarchies of unknown depth from parent-child links: roots, depths, paths, descendants and circles.

A node may have several parents and links may close circles. A fixed hash names one node in ``spacing`` or so a
splitter. Every node is walked upwards to its next splitters only; the splitters with those walks between them are
a graph ``spacing`` times smaller and shallower, which is solved by itself; the two are then joined into whole
distances and exact paths. Both the walks and the reduced graph are solved by doubling: what reaches 1, 2, 4 ...
steps up is joined with itself, so the number of jobs grows with the logarithm of the depth. Circles are found in the
reduced graph; those that hold no splitter never get there and show themselves in the walks. Links are only joined,
never gathered in one task or on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.runtime import Scratch

CYCLE, NONE = "CYCLE", "NONE"


@dataclass
class Ancestry:
    """``walks``: (start, at, d, stop[, path]) from each node up to its next splitters and roots, with what lies between.
    ``hops``: those that end at a splitter or root. ``reach``: (start, at, d[, path]) from splitter to splitter.
    ``cyclic``: (node) on circles. ``nodes``: (node, is_root, split)."""

    nodes: DataFrame
    walks: DataFrame
    hops: DataFrame
    reach: DataFrame
    cyclic: DataFrame
    scratch: Scratch
    with_paths: bool

    def finish(self, result: DataFrame) -> DataFrame:
        """Write what was read out of this, and delete all else that was written for it."""
        return self.scratch.result(result)


def clean_links(df: DataFrame, child, parent) -> tuple[DataFrame, DataFrame]:
    """Distinct links and distinct nodes. A row with a null parent is no link, yet its child is a node; a row with
    a null child gives its parent as a node; a row with both null gives nothing."""
    raw = df.select(child.alias("child"), parent.alias("parent"))
    links = raw.where("child is not null and parent is not null").distinct()
    nodes = raw.select(F.explode(F.array("child", "parent")).alias("node")).where("node is not null").distinct()
    return links, nodes


def _best(df: DataFrame, keys: list[str], with_paths: bool) -> DataFrame:
    """The shortest way for each key; of equally short ones the least path."""
    if not with_paths:
        return df.groupBy(*keys).agg(F.min("d").alias("d"))
    return df.groupBy(*keys).agg(F.min(F.struct("d", "path")).alias("m")).select(*keys, "m.d", "m.path")


def _joined(a: DataFrame, b: DataFrame, with_paths: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Ways (start, at, d[, path]) of ``a`` that go on by those of ``b``, with ``extra`` columns of ``b``."""
    x, y = a.alias("x"), b.alias("y")
    path = [F.concat("x.path", F.slice("y.path", 2, 1 << 30)).alias("path")] if with_paths else []
    return x.join(y, F.col("x.at") == F.col("y.start")).select("x.start", "y.at", (F.col("x.d") + F.col("y.d")).alias("d"), *[f"y.{e}" for e in extra], *path)


def _doubled(keep: Scratch, edges: DataFrame, with_paths: bool) -> DataFrame:
    """Every way of one edge or more in ``edges`` (start, at, d, stop[, path]) with the fewest links; a way ends at
    ``stop``.

    After k rounds the table holds the best ways of up to 2^k edges, each with its number of edges ``h``. A best way of
    more begins with a best one of exactly 2^k, so only those are joined with what follows them, and each longer way
    comes once. When none has 2^k edges, all are found, on circles too: best ways never go round."""
    keys, rank = ["start", "at", "stop"], ["d", "path", "h", "full"] if with_paths else ["d", "h", "full"]
    # ``full``: of 2^k edges, ``open``: and not at a stop. No round has a constant of its own, so all run the same code.
    ways = keep.save(edges.select(*keys, "d", *(["path"] if with_paths else []), F.lit(1).cast("long").alias("h"), F.lit(True).alias("full"), (~F.col("stop")).cast("int").alias("open")), total="open")
    while ways._notewright_total:
        x, y = ways.where("open = 1").alias("x"), ways.alias("y")
        path = [F.concat("x.path", F.slice("y.path", 2, 1 << 30)).alias("path")] if with_paths else []
        longer = x.join(y, F.col("x.at") == F.col("y.start")).select("x.start", "y.at", "y.stop", (F.col("x.d") + F.col("y.d")).alias("d"), (F.col("x.h") + F.col("y.h")).alias("h"), "y.full", *path)
        both = ways.withColumn("full", F.lit(False)).select(*keys, *rank).unionByName(longer.select(*keys, *rank))
        best = both.groupBy(*keys).agg(F.min(F.struct(*rank)).alias("m")).select(*keys, "m.*")
        grown = keep.save(best.withColumn("open", (F.col("full") & ~F.col("stop")).cast("int")), total="open")
        keep.drop(ways)
        ways = grown
    return ways.drop("h", "full", "open")


def build(spark: SparkSession, links: DataFrame, nodes: DataFrame, with_paths: bool = False, spacing: int = 8) -> Ancestry:
    """Walk, reduce and solve. ``links`` (child, parent) and ``nodes`` (node) are distinct; empty tables give empty
    results."""
    keep = Scratch(spark)
    # One reading of the source; few nodes have several parents, so links are about as many as nodes.
    links = keep.save(links)
    rooted = links.select(F.col("child").alias("node")).distinct()
    nodes = nodes.join(rooted.withColumn("up", F.lit(True)), "node", "left")
    nodes = keep.save(nodes.select("node", F.col("up").isNull().alias("is_root"), (F.pmod(F.xxhash64("node"), F.lit(spacing)) == 0).alias("split")))
    ends = nodes.where("is_root or split").select(F.col("node").alias("parent"), F.lit(True).alias("stop"))
    path = [F.array("child", "parent").alias("path")] if with_paths else []
    edges = links.join(ends, "parent", "left").select(F.col("child").alias("start"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("d"), F.coalesce("stop", F.lit(False)).alias("stop"), *path)
    walks = _doubled(keep, edges, with_paths)
    hops = walks.where("stop")
    splitters = nodes.where("split and not is_root").select("node")
    between = hops.join(splitters.withColumnRenamed("node", "start"), "start", "left_semi").join(splitters.withColumnRenamed("node", "at"), "at", "left_semi")
    reach = _doubled(keep, between.withColumn("stop", F.lit(False)), with_paths).drop("stop")
    cyclic = keep.save(_circles(walks, reach))
    return Ancestry(nodes, walks, hops, reach, cyclic, keep, with_paths)


def _circles(walks: DataFrame, reach: DataFrame) -> DataFrame:
    """Nodes that can reach themselves."""
    # Without a splitter on the way: the walk itself comes back.
    closed = walks.where("start = at").select(F.col("start").alias("node"))
    # Splitters that reach each other are one component, named by its least member.
    x, y = reach.alias("x"), reach.alias("y")
    mutual = x.join(y, (F.col("x.start") == F.col("y.at")) & (F.col("x.at") == F.col("y.start"))).select(F.col("x.start").alias("node"), F.col("x.at").alias("label"))
    labels = mutual.groupBy("node").agg(F.min("label").alias("label"))
    # Any other node lies on a circle with splitters if it reaches one of a component that reaches it.
    to = walks.where("stop").join(labels.withColumnRenamed("node", "at"), "at").select(F.col("start").alias("node"), "label").distinct()
    frm = walks.join(labels.withColumnRenamed("node", "start"), "start").select(F.col("at").alias("node"), "label").distinct()
    return closed.union(labels.select("node")).union(to.join(frm, ["node", "label"]).select("node")).distinct()


def roots_of(a: Ancestry) -> DataFrame:
    """(node, root, d[, path]): one row ``CYCLE``/-1 for a node on a circle; for any other node one row for each root
    it reaches, with the fewest links; ``NONE``/-1 where it reaches none."""
    p, extra = a.with_paths, ["path"] if a.with_paths else []
    roots = a.nodes.where("is_root").select("node")
    self_rows = roots.select(F.col("node").alias("start"), F.col("node").alias("at"), F.lit(0).cast("long").alias("d"), *([F.array("node").alias("path")] if extra else []))
    direct = a.hops.join(roots.withColumnRenamed("node", "at"), "at", "left_semi").select("start", "at", "d", *extra)
    # Of the splitters: those a hop from a root, and those that reach such a one.
    solved = _best(direct.unionByName(_joined(a.reach, direct, with_paths=p)), ["start", "at"], p)
    found = _best(self_rows.unionByName(direct).unionByName(_joined(a.hops, solved, with_paths=p)), ["start", "at"], p)
    ways = found.groupBy(F.col("start").alias("node")).agg(F.collect_list(F.struct(F.col("at").alias("root"), "d", *extra)).alias("ways"))
    # Circles and nodes without a root come beside the nodes, so each node is looked up once.
    rows = a.nodes.select("node").join(a.cyclic.withColumn("on_circle", F.lit(True)), "node", "left").join(ways, "node", "left")
    none = F.lit(None).cast("array<string>").alias("path")

    def sign(name: str) -> Column:
        return F.array(F.struct(F.lit(name).alias("root"), F.lit(-1).cast("long").alias("d"), *([none] if extra else [])))

    rows = rows.select("node", F.inline(F.when(F.col("on_circle"), sign(CYCLE)).otherwise(F.coalesce("ways", sign(NONE)))))
    return rows


def reaching(a: Ancestry, root: str) -> DataFrame:
    """(node): nodes that reach ``root``, which has no link upwards, by one link or more."""
    direct = a.hops.where(F.col("at") == root).select("start").distinct()
    far = a.reach.join(direct.withColumnRenamed("start", "at"), "at", "left_semi").select("start")
    splitters = direct.union(far).distinct().withColumnRenamed("start", "at")
    return direct.union(a.hops.join(splitters, "at", "left_semi").select("start")).distinct().withColumnRenamed("start", "node")


def descendants_of(a: Ancestry) -> DataFrame:
    """(node, descendant, d): every pair in which the descendant reaches the node by one or more links, with the
    fewest links. Nodes on circles take no part; circles are reported by ``roots_of``."""
    ways, hops, reach = (df.select("start", "at", "d") for df in (a.walks, a.hops, a.reach))
    ways = ways.join(a.cyclic.withColumnRenamed("node", "start"), "start", "left_anti")
    hops = hops.join(a.cyclic.withColumnRenamed("node", "start"), "start", "left_anti")
    far = a.scratch.save(_best(hops.unionByName(_joined(hops, reach)), ["start", "at"], False))
    pairs = _best(ways.unionByName(far).unionByName(_joined(far, a.walks)), ["start", "at"], False)
    pairs = pairs.join(a.cyclic.withColumnRenamed("node", "at"), "at", "left_anti")
    return pairs.select(F.col("at").alias("node"), F.col("start").alias("descendant"), "d")


def disease_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of the disease table: rows whose ``pred`` is is_a (any case, trimmed); ids as ``MONDO:`` and digits."""

    def key(c: str):
        digits = F.regexp_extract(F.col(c), r"(?i)mondo[:_](\d+)", 1)
        return F.when(digits != "", F.concat(F.lit("MONDO:"), digits))

    rows = edges.where(F.lower(F.trim(F.regexp_replace("pred", r"(?U)^\s+|\s+$", ""))) == "is_a")
    return clean_links(rows, key("sub"), key("obj"))


def company_links(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of the company table: names trimmed, inner white space made one blank, lower-cased."""

    def key(c: str):
        name = F.lower(F.trim(F.regexp_replace(F.col(c), r"(?U)[\s\p{Z}]+", " ")))
        return F.when(name != "", name)

    return clean_links(table, key("child"), key("parent"))
