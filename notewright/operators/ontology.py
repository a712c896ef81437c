"""Gene, disease and variant dictionaries from their public sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import patterns as P
from notewright.operators import ancestry, packed

# Labels and synonyms that are words of everyday language.
DISEASE_STOP = (
    "disease", "syndrome", "disorder", "neoplasm", "infection", "cancer", "tumor", "tumour", "deficiency", "malformation", "carcinoma", "adenocarcinoma",
    "complete", "not rare", "incl", "mosaic", "canvas", "mass", "mild", "dose", "loss", "gain", "risk", "diet", "test",
)


def genes(table: DataFrame, order: str = "row_id") -> DataFrame:
    """(symbol, hgnc_id) of approved records with a symbol; of repeated symbols the last holds."""
    rows = table.where((F.trim("status") == "Approved") & (F.coalesce(F.trim("symbol"), F.lit("")) != ""))
    return rows.groupBy(F.trim("symbol").alias("symbol")).agg(F.max_by("hgnc_id", order).alias("hgnc_id"))


def gene_aliases(table: DataFrame, order: str = "row_id") -> DataFrame:
    """(alias, symbol): aliases and former symbols of approved records that are no symbol themselves; the last record
    holds. Fields are split by the packed-field operator, so any delimiter counts."""
    rows = table.where((F.trim("status") == "Approved") & (F.coalesce(F.trim("symbol"), F.lit("")) != ""))
    values = packed.explode_packed(rows, order, ["alias_symbol", "prev_symbol"])
    named = values.join(rows.select(order, F.trim("symbol").alias("symbol")), order)
    last = named.groupBy(F.col("val").alias("alias")).agg(F.max_by("symbol", F.struct(order, "field_name", "pos")).alias("symbol"))
    return last.join(genes(table, order).select(F.col("symbol").alias("alias")), "alias", "left_anti")


def bar_aliases(table: DataFrame, order: str = "row_id") -> DataFrame:
    """As ``gene_aliases`` for fields packed with bars only, in plain expressions: the source's own layout."""
    rows = table.where((F.trim("status") == "Approved") & (F.coalesce(F.trim("symbol"), F.lit("")) != ""))
    both = F.explode(F.concat(F.split(F.coalesce("alias_symbol", F.lit("")), r"\|"), F.split(F.coalesce("prev_symbol", F.lit("")), r"\|")))
    named = rows.select(order, F.trim("symbol").alias("symbol"), both.alias("a")).select(order, "symbol", F.trim("a").alias("alias")).where("alias <> ''")
    last = named.groupBy("alias").agg(F.max_by("symbol", order).alias("symbol"))
    return last.join(genes(table, order).select(F.col("symbol").alias("alias")), "alias", "left_anti")


def below(spark: SparkSession, root: str, links: DataFrame) -> DataFrame:
    """(node): the root and all that reach it by links (child, parent); circles and several parents do no harm.

    Every node is walked to its next splitters; those from which the root is reached carry the answer down, so the
    number of jobs grows with the logarithm of the depth."""
    links = links.select("child", "parent").where(F.col("child") != root).distinct()  # the root is a root
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    a = ancestry.build(spark, links, nodes)
    return a.finish(ancestry.reaching(a, root).union(spark.createDataFrame([(root,)], "node string")).distinct())


def disease_keys(spark: SparkSession, nodes: DataFrame, edges: DataFrame, root: str | None, stop: tuple[str, ...] = DISEASE_STOP) -> DataFrame:
    """(id, label, ord, key): lower labels and synonyms of the live classes under ``root`` (all, if None), in their order.
    Labels of three characters or more, synonyms of four."""
    node = F.regexp_extract("node_id", r"(?i)mondo[:_](\d+)", 1)
    live = nodes.where((F.upper(F.trim("node_type")) == "CLASS") & (node != "") & ~F.coalesce("deprecated", F.lit(False)) & (F.length(F.trim("lbl")) >= 3)).withColumn("id", F.concat(F.lit("MONDO:"), node))
    if root is not None:
        links, _ = ancestry.disease_links(edges)
        live = live.join(below(spark, root, links).withColumnRenamed("node", "id"), "id", "left_semi")
    names = F.concat(F.array(F.col("lbl")), F.filter(F.coalesce("synonyms", F.array()), lambda s: F.length(F.trim(s)) >= 4))
    return live.select("id", F.col("lbl").alias("label"), F.posexplode(names).alias("ord", "name")).withColumn("key", F.lower(P.any_space(F.col("name")))).where(~F.col("key").isin(*stop)).drop("name")


def diseases(spark: SparkSession, nodes: DataFrame, edges: DataFrame, root: str | None, stop: tuple[str, ...] = DISEASE_STOP) -> DataFrame:
    """(key, label, mondo_id): ``disease_keys``, each key with its first node; a label comes before its node's synonyms."""
    keys = disease_keys(spark, nodes, edges, root, stop)
    return keys.groupBy("key").agg(F.min_by(F.struct("label", F.col("id").alias("mondo_id")), F.struct("id", "ord")).alias("m")).select("key", "m.label", "m.mondo_id")


def variants(table: DataFrame, drugs_name_themselves: bool = True) -> DataFrame:
    """(entity_type, variant, canonical, ord): one row a lower variant. The last row holds, yet the variant keeps the
    place of its first; blank variants are none. Drugs' canonicals are variants too."""
    rows = table.select(F.lower(F.trim("entity_type")).alias("entity_type"), F.lower(P.any_space(F.col("variant_name"))).alias("variant"), "canonical", "ord").where("variant <> '' and canonical is not null")
    if drugs_name_themselves:
        own = rows.where("entity_type = 'drugs'").select("entity_type", F.lower(P.any_space(F.col("canonical"))).alias("variant"), "canonical", "ord")
        rows = rows.unionByName(own)
    return rows.groupBy("entity_type", "variant").agg(F.max_by("canonical", F.struct("ord", "canonical")).alias("canonical"), F.min("ord").alias("ord"))


def without_denied(table: DataFrame, denied: DataFrame) -> DataFrame:
    """Variants without those a denylist (guard, entity_type, term) names as variants or as canonicals of their type."""
    d = denied.select("guard", "entity_type", F.lower("term").alias("term"))
    kept = table.join(d.where("guard = 'variants'").select(F.col("term").alias("variant")).distinct(), "variant", "left_anti")
    canon = d.where("guard = 'canonicals'").select("entity_type", F.col("term").alias("__c")).distinct()
    return kept.join(canon, (kept["entity_type"] == canon["entity_type"]) & (F.lower(kept["canonical"]) == canon["__c"]), "left_anti")


def check_size(table: DataFrame, least: int) -> DataFrame:
    """The table itself; reading it fails if it has fewer rows than ``least``."""
    n = table.count()
    if n < least:
        raise ValueError(f"a dictionary of {n} rows where {least} are the least")
    return table
