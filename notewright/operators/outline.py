"""Page hierarchies: depth, parent, ancestors and children from indentation levels, display names, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.functions import text as T
from notewright.operators import ancestry
from notewright.runtime import Scratch


def with_depth(pages: DataFrame, section: list[str], order: str, level: str) -> DataFrame:
    """``depth``: where the page stands in its section's outline.

    A page of level n hangs below the last page of a lower level before it, so depth grows by one a step at most. In
    closed form it is the least of the page's number and that plus the least surplus of level over number so far; one
    window a section. Levels are 1 or more; null counts as 1. Equal orders give an undefined, yet valid, outline.
    """
    w = W.partitionBy(*section).orderBy(order)
    rn = F.row_number().over(w)
    lv = F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1))
    least = F.min(lv - F.col("__rn")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return pages.withColumn("__rn", rn).withColumn("depth", F.least(F.col("__rn"), F.col("__rn") + least)).drop("__rn")


def with_parents(pages: DataFrame, section: list[str], order: str, page_id: str, deepest: int = 12) -> DataFrame:
    """``parent_id``: the last page before it that stands one step higher; null at the top. Below ``deepest`` steps a
    second way is taken, so the depth has no cap."""
    w = W.partitionBy(*section).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == k, F.col(page_id)), ignorenulls=True).over(w) for k in range(1, deepest + 1)]
    near = F.coalesce(*[F.when(F.col("depth") == k + 1, c) for k, c in enumerate(last, 1)])
    out = pages.withColumn("parent_id", near)
    keys = [*section, "depth"]
    deep = out.where(F.col("depth") > deepest + 1)
    # As-of by depth: the latest page of the step above, as one ordered union and a running last.
    above = out.where(F.col("depth") > deepest).select(*section, (F.col("depth") + 1).alias("depth"), F.col(order).alias("__o"), F.col(page_id).alias("above"), F.lit(0).alias("side"))
    both = above.unionByName(deep.select(*keys, F.col(order).alias("__o"), F.col(page_id).alias("__id"), F.lit(1).alias("side")), allowMissingColumns=True)
    run = W.partitionBy(*keys).orderBy("__o", "side").rowsBetween(W.unboundedPreceding, -1)
    found = both.withColumn("__p", F.last("above", ignorenulls=True).over(run)).where("side = 1").select("__id", "__p")
    return out.join(found, out[page_id] == found["__id"], "left").withColumn("parent_id", F.coalesce("parent_id", "__p")).drop("__id", "__p")


def with_ancestors(pages: DataFrame, section: list[str], order: str, name: str, deepest: int = 12) -> DataFrame:
    """``ancestor_names``: from the top down to the parent. One window; of the sections with pages below ``deepest``
    steps, those pages take their names by ``lineage``, so the depth has no cap. ``order`` is unique in a section."""
    w = W.partitionBy(*section).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == k, F.col(name)), ignorenulls=True).over(w) for k in range(1, deepest + 1)]
    out = pages.withColumn("ancestor_names", F.slice(F.array(*last), 1, F.least(F.col("depth"), F.lit(deepest + 1)) - 1))
    if pages.where(F.col("depth") > deepest + 1).isEmpty():
        return out
    at = F.to_json(F.struct(*section, order))
    most = F.max("depth").over(W.partitionBy(*section))
    rows = pages.select(*dict.fromkeys([*section, order]), "depth", at.alias("__at"), F.col(name).alias("__name")).withColumn("__most", most).where(F.col("__most") > deepest + 1)
    up = lineage(with_parents(rows, section, order, "__at").select("__at", "parent_id"), "__at")
    steps = up.join(rows.where(F.col("depth") > deepest + 1).select("__at"), "__at").select("__at", F.posexplode("ancestor_ids").alias("__step", "__up"))
    names = rows.select(F.col("__at").alias("__up"), "__name")
    found = steps.join(names, "__up").groupBy("__at").agg(F.sort_array(F.collect_list(F.struct((-F.col("__step")).alias("o"), F.col("__name").alias("n")))).alias("__names"))
    found = found.select("__at", F.transform("__names", lambda x: x["n"]).alias("__names"))
    return out.withColumn("__at", at).join(found, "__at", "left").withColumn("ancestor_names", F.coalesce("__names", "ancestor_names")).drop("__at", "__names")


def lineage(pages: DataFrame, page_id: str) -> DataFrame:
    """(page_id, ancestor_ids) from the parent up for pages of any depth, by the splitter walks of ``ancestry``."""
    links = pages.where("parent_id is not null").select(F.col(page_id).alias("child"), F.col("parent_id").alias("parent"))
    a = ancestry.build(pages.sparkSession, links, pages.select(F.col(page_id).alias("node")).distinct(), with_paths=True)
    return a.finish(ancestry.roots_of(a).select(F.col("node").alias(page_id), F.slice("path", 2, 1 << 30).alias("ancestor_ids")))


def children(pages: DataFrame, page_id: str, order: str, name: str) -> DataFrame:
    """(parent_id, children): names in page order; a list is one section's at most."""
    rows = pages.where("parent_id is not null").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))).alias("c"))
    return rows.select("parent_id", F.transform("c", lambda x: x["n"]).alias("children"))


def display_names(pages: DataFrame, name: str, parent_name: str) -> Column:
    return T.display_name(pages[name], pages[parent_name])


def first_wins(pages: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of the rows of one key the first's value."""
    return pages.groupBy(key).agg(F.min_by(value, order).alias(value))


def unique_paths(pages: DataFrame, path: str, order: str) -> DataFrame:
    """``unique_path``: a path that came before gets `` (2)``, `` (3)`` and so on before its ending. Rounds go on while
    a numbered path meets another; an earlier row keeps the plainer path. Each round adds to a path that meets one, and
    the row that keeps a path keeps it for good, so they end. Only rows that met are numbered again; ``order`` is unique."""
    keep = Scratch(pages.sparkSession)
    stem, ending = F.regexp_extract("unique_path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("unique_path", r"^(.*?)(\.[^./]*)?$", 2)
    numbered = F.concat(stem, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ending)
    w = W.partitionBy("unique_path").orderBy("__new", F.col(order))
    rows = keep.save(pages.withColumn("unique_path", F.col(path)).withColumn("__new", F.lit(0)))
    while True:
        # A path taken in an earlier round stays with its row; those that come to it now queue behind.
        rows = keep.save(rows.withColumn("__n", F.row_number().over(w)).withColumn("unique_path", F.when(F.col("__n") > 1, numbered).otherwise(F.col("unique_path"))).withColumn("__new", (F.col("__n") > 1).cast("int")).drop("__n"))
        if rows.groupBy("unique_path").count().where("count > 1").isEmpty():
            return rows.drop("__new")


def in_notebooks(pages: DataFrame, column: str, only: list[str] | None = None, but: list[str] | None = None) -> DataFrame:
    """Pages of the named notebooks; both lists hold if both are given."""
    if only:
        pages = pages.where(F.col(column).isin(*only))
    if but:
        pages = pages.where(~F.col(column).isin(*but))
    return pages


def folders(pages: DataFrame, path: str) -> DataFrame:
    """(folders): the distinct top folders, sorted, in one row; an empty table gives an empty list."""
    return pages.select(F.split(path, "/")[0].alias("f")).where("f <> ''").distinct().agg(F.sort_array(F.collect_list("f")).alias("folders"))
