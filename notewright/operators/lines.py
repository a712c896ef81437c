"""Texts by lines: fences, code islands, embeds, numbering. Windows over one document's lines, no state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notewright.functions import patterns as P
from notewright.functions import text as T


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, line): lines numbered from 0; a null text has none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("n", "line"))


def join_lines(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """(doc_id, text): the inverse. A document's lines meet in one task, as they did in its text."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))


def _by_doc():
    return W.partitionBy("doc_id").orderBy("n")


def with_fences(lines: DataFrame) -> DataFrame:
    """``is_fence`` and ``inside``: whether a line lies between an opening fence and its end (the fences excluded)."""
    fence = F.startswith("line", F.lit("```"))
    count = F.sum(fence.cast("int")).over(_by_doc())
    return lines.withColumn("is_fence", fence).withColumn("inside", (count % 2 == 1) & ~fence)


def is_continuation(line: Column) -> Column:
    """Whether a line goes on with code that began before it."""
    s = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return (s != "") & (
        (s.rlike(r"^\\?#") & ~F.contains(s, F.lit("(")))
        | s.rlike(r"(?U)\b\w+\s*(?:<-|=)\s")
        | s.rlike(r"(?U)^\w[\w.]+\s*\(")
        | line.rlike(r"^\s{4,}")
        | s.rlike(r"(?U)^(?:-\w|--\w)")
        | s.rlike(r"^(?:[)\]}|+]|%>%|&&)")
    )


def code_islands(lines: DataFrame) -> DataFrame:
    """``in_code`` and ``island``: lines outside fences that look like code, or go on with such, in runs of two or more.

    A line is in code if the last matching line comes after the last break; a break is a fence, or a line outside that
    neither matches nor continues. Runs of one line are none."""
    w = _by_doc().rowsBetween(W.unboundedPreceding, 0)
    rows = with_fences(lines).withColumn("hit", ~F.col("is_fence") & ~F.col("inside") & F.col("line").rlike(P.CODE_LINE))
    stop = F.col("is_fence") | F.col("inside") | ~(F.col("hit") | is_continuation(F.col("line")))
    last_hit = F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))).over(w), F.lit(-1))
    last_stop = F.coalesce(F.max(F.when(stop, F.col("n"))).over(w), F.lit(-1))
    rows = rows.withColumn("__in", ~stop & (last_hit > last_stop)).withColumn("__first", F.col("__in") & ~F.coalesce(F.lag("__in").over(_by_doc()), F.lit(False)))
    rows = rows.withColumn("island", F.when(F.col("__in"), F.sum(F.col("__first").cast("int")).over(w)))
    size = F.count("*").over(W.partitionBy("doc_id", "island"))
    return rows.withColumn("in_code", F.col("__in") & (size >= 2)).withColumn("island", F.when(F.col("in_code"), F.col("island"))).drop("__in", "__first", "hit")


def fence_islands(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): code islands put between fences with their language and without escapes."""
    rows = code_islands(split_lines(docs, doc_id, text))
    whole = W.partitionBy("doc_id", "island")
    of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line")).over(whole)), lambda x: x["line"]), "\n")
    rows = rows.withColumn("lang", F.when(F.col("in_code"), T.code_language(of)))
    first, last = F.col("n") == F.min("n").over(whole), F.col("n") == F.max("n").over(whole)
    line = F.when(F.col("in_code"), F.concat(F.when(first, F.concat(F.lit("```"), F.col("lang"), F.lit("\n"))).otherwise(""), T.unescape_code(F.col("line")), F.when(last, F.lit("\n```")).otherwise(""))).otherwise(F.col("line"))
    return join_lines(rows.select("doc_id", "n", line.alias("line")))


def label_fences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): bare opening fences labelled by what stands between them and their end. Fences open and close by
    turns, labelled ones included."""
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = split_lines(docs, doc_id, text).withColumn("bare", bare).withColumn("fence", F.startswith("bare", F.lit("```")))
    k = F.sum(F.col("fence").cast("int")).over(_by_doc())
    rows = rows.withColumn("k", k).withColumn("opens", F.col("fence") & (F.col("k") % 2 == 1))
    # The lines between the k-th fence and the next have the count k.
    inside = F.when(~F.col("fence") & (F.col("k") % 2 == 1), F.struct("n", "line"))
    rows = rows.withColumn("code", F.array_join(F.transform(F.array_sort(F.collect_list(inside).over(W.partitionBy("doc_id", "k"))), lambda x: x["line"]), "\n"))
    line = F.when(F.col("opens") & (F.col("bare") == "```") & (F.col("code") != ""), F.concat(F.lit("```"), T.code_language(F.col("code"), P.FENCE_LANGUAGE))).otherwise(F.col("line"))
    return join_lines(rows.select("doc_id", "n", line.alias("line")))


def numbered(items: DataFrame, by: list[str], order: str, is_numbered: str) -> DataFrame:
    """``item_no``: numbers from 1 within each run of numbered items; any other item ends the run."""
    w = W.partitionBy(*by).orderBy(order)
    run = F.sum((~F.col(is_numbered)).cast("int")).over(w)
    rows = items.withColumn("__run", run)
    return rows.withColumn("item_no", F.when(F.col(is_numbered), F.sum(F.col(is_numbered).cast("int")).over(W.partitionBy(*by, "__run").orderBy(order)))).drop("__run")


def embeds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, ord, type, filename, text): images, files and the texts between them in order. Of a line's embeds the
    first counts; a heading begins a new text."""
    pattern = r"!?\[\[(?:[^\[\]|]*/)?([^\[\]|/]+\.[A-Za-z0-9]{2,5})(?:\|[^\[\]]*)?\]\]"
    rows = split_lines(docs, doc_id, text).withColumn("file", F.regexp_extract("line", pattern, 1))
    kind = F.when(F.col("file") == "", None).when(F.lower("file").rlike(r"\.(png|jpe?g|bmp|tiff?|gif)$"), "image").otherwise("file")
    breaks = (F.col("file") != "") | F.startswith("line", F.lit("#"))
    rows = rows.withColumn("kind", kind).withColumn("part", F.sum(breaks.cast("int")).over(_by_doc()))
    files = rows.where("file <> ''").select("doc_id", F.struct(F.col("n"), F.lit(0).alias("k")).alias("at"), F.col("kind").alias("type"), F.col("file").alias("filename"), F.lit(None).cast("string").alias("text"))
    texts = rows.where("file = ''").groupBy("doc_id", "part").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts = texts.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''").select("doc_id", F.struct(F.col("n"), F.lit(1).alias("k")).alias("at"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("filename"), "text")
    both = files.unionByName(texts)
    return both.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).select("doc_id", "ord", "type", "filename", "text")


def drop_list_entries(docs: DataFrame, doc_id: str, text: str, section: str, entries: list[str]) -> DataFrame:
    """(doc_id, text): listed entries taken out of one list of the front matter."""
    rows = split_lines(docs, doc_id, text)
    dashes = F.sum((F.trim("line") == "---").cast("int")).over(_by_doc())
    head = F.last(F.when(F.col("line").rlike(r"^\s{0,2}[\w-]+:"), F.trim(F.regexp_extract("line", r"^\s*([\w-]+):", 1))), ignorenulls=True).over(_by_doc())
    entry = F.regexp_extract("line", r'^\s*-\s*"?([^"]*?)"?\s*$', 1)
    rows = rows.withColumn("__drop", (dashes == 1) & (head == section) & F.lower(entry).isin(*[e.lower() for e in entries]) & (entry != ""))
    return join_lines(rows.where(~F.coalesce("__drop", F.lit(False))).drop("__drop"))
