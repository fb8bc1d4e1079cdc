"""The engine's relations over the driver's tables: which table stands for what. The mapping is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core
from ..session import table


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: source is the folder batch, lang the detected type."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("capture"), F.col("source").alias("batch"), F.col("lang").alias("detected_type"), core.byte_length(F.col("text")).alias("bytes"), core.content_hash(F.col("text")).alias("sha256"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels: a row means reviewed, quality 1 approved, toxic 1 failed."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("capture"), (F.col("quality") == 1).alias("approved"), (F.col("toxic") == 1).alias("failed"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent) of customers, nations and regions."""
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    out = c.select(key("customer", "c_custkey").alias("id"), key("nation", "c_nationkey").alias("parent"))
    out = out.unionByName(n.select(key("nation", "n_nationkey").alias("id"), key("region", "n_regionkey").alias("parent")))
    return out.unionByName(r.select(key("region", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))


def edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """src, predicate, dst over keys of the star schema. With ``parts``, lines are dealt into so many to find their distinct keys."""
    o, l, p, n = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "nation"))  # noqa: E741
    one = lambda *c: (l.select(*c) if parts is None else l.select(*c).repartition(parts, *c)).distinct()
    key = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    edge = lambda df, s, name, d: df.select(s.alias("src"), F.lit(name).alias("predicate"), d.alias("dst"))
    out = edge(o, key("order", "o_orderkey"), "DERIVES_FROM", key("customer", "o_custkey"))
    out = out.unionByName(edge(n, key("region", "n_regionkey"), "GOVERNS", key("nation", "n_nationkey")))
    out = out.unionByName(edge(one("l_partkey", "l_suppkey"), key("part", "l_partkey"), "IMPLEMENTS", key("supplier", "l_suppkey")))
    lines = one("l_orderkey", "l_linenumber")
    out = out.unionByName(edge(lines, F.concat(key("line", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")), "EVIDENCES", key("order", "l_orderkey")))
    return out.unionByName(edge(p, key("part", "p_partkey"), "TRANSMUTES", F.concat(F.lit("type:"), F.col("p_type"))))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as reviewed notes: the size gives the exposure, the type the description, the brand the body; each names its type's first part as related."""
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    first = p.groupBy("p_type").agg(F.min("p_partkey").alias("first"))
    exposure = F.element_at(F.array(F.lit("public"), F.lit("restricted"), F.lit("private"), F.lit("secret")), (F.col("p_size") % 4 + 1).cast("int"))
    edge = F.struct(F.when(F.col("p_size") % 7 == 0, "LIKES").otherwise("IMPLEMENTS").alias("predicate"), F.concat(F.lit("part:"), F.col("first").cast("string")).alias("target"), F.lit("same type").alias("rationale"))
    out = p.join(first, "p_type")
    return out.select(
        key.alias("id"), F.lit(None).cast("string").alias("parent"), F.array(edge).alias("related"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.array(F.col("p_brand")).alias("tags"),
        F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.col("p_brand").alias("body"), exposure.alias("exposure"), (F.col("p_size") == 50).alias("malformed"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders as notes that link to their lines, lines as records that name a part's file, and the parts of an odd size as archived files."""
    o, l, p = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part"))  # noqa: E741
    links = l.groupBy("l_orderkey").agg(F.collect_set(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("source_links"))
    nodes = o.join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), "source_links")
    lines = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    assets = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"), F.concat(F.lit("raw-"), F.col("part").cast("string")).alias("archive_path"))
    return nodes, assets, p.where("p_size % 2 = 1").select(F.concat(F.lit("raw-"), F.col("p_partkey").cast("string")).alias("path"))


def frontier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """labels as frontier artifacts, documents as their intakes and sources, in the contract's shape: (artifacts, intakes, inventory)."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = lambda c: F.col(c).cast("string")
    art = b.select("doc_id", "quality", "toxic").distinct()
    artifacts = art.select(
        text("doc_id").alias("artifact_id"), F.when(F.col("toxic") == 1, "model").otherwise("frontier-model").alias("provenance"), F.lit("m").alias("frontier_model"), F.when(F.col("quality") == 1, "r").alias("frontier_request"),
        text("doc_id").alias("source_intake"), F.lit("all").alias("source_coverage"), F.lit("low").alias("uncertainty"), F.when(F.col("doc_id") % 3 != 0, F.sha2(text("doc_id"), 256)).alias("source_sha256"),
        F.when(F.col("doc_id") % 3 != 1, F.concat(F.lit("inv-"), (F.col("doc_id") % 5).cast("string"))).alias("source_inventory"),
        F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array()).cast("array<string>").alias("related"),
    )
    intakes = d.where("lang <> 'fr'").select(text("doc_id").alias("intake_id"), F.concat(F.lit("inv-"), (F.col("doc_id") % 4).cast("string")).alias("inventory_path")).distinct()
    inventory = d.where("lang = 'en'").select(F.concat(F.lit("inv-"), (F.col("doc_id") % 4).cast("string")).alias("inventory_path"), F.sha2(text("doc_id"), 256).alias("sha256"))
    return artifacts, intakes, inventory
