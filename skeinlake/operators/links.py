"""Links between vaults: where they stand, what they lead to, and texts rebuilt with the target's vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core

LINK = r"obsidian://open\?[^)\s\"'<>\]]*"


def _parameter(link: str, name: str) -> Column:
    raw = F.nullif(F.regexp_extract(link, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def page_path(domain: Column, path: Column) -> Column:
    """A note's path within its domain."""
    return F.when(F.startswith(path, F.concat(domain, F.lit("/"))), F.substr(path, F.length(domain) + 2)).otherwise(path)


def extracted(notes: DataFrame) -> DataFrame:
    """domain, path, k (from 0), place (code points before it), link, vault, file of all links of (domain, path, text)."""
    found = notes.select("domain", "path", F.regexp_extract_all("text", F.lit(LINK), F.lit(0)).alias("links"), F.split("text", LINK, -1).alias("between")).where("size(links) > 0")
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda total, x: total + F.length(x))
    out = found.select("domain", "path", "links", "between", F.posexplode("links").alias("k", "link"))
    return out.select("domain", "path", "k", (size(F.col("between"), F.col("k") + 1) + size(F.col("links"), F.col("k"))).alias("place"), "link", _parameter("link", "vault").alias("vault"), _parameter("link", "file").alias("file"))


def resolved(links: DataFrame, notes: DataFrame, domains: DataFrame) -> DataFrame:
    """``extracted`` with to (the target's vault, null if nothing tells it) and found (null without a file; else whether there is such a note).

    A vault is named by its domain or its own name, in any case. Where that fails, the file says: by the domain in front
    of its path, or if one domain alone has a note of that path. Notes: domain, path.
    """
    d = domains.select(F.col("name").alias("target"), F.coalesce("vault_name", core.vault_name(F.col("name"))).alias("to"))
    names = d.select(F.lower("target").alias("name"), "target", "to").union(d.select(F.lower("to"), "target", "to")).dropDuplicates(["name"])
    clean = F.regexp_replace("file", r"\.md$", "")
    wanted = links.select("vault", "file").distinct()
    by_name = wanted.join(names.withColumnRenamed("name", "_v"), F.lower("vault") == F.col("_v"), "left")
    by_name = by_name.withColumn("head", F.split_part("file", F.lit("/"), F.lit(1))).join(names.select(F.col("name").alias("_h"), F.col("target").alias("target2"), F.col("to").alias("to2")), F.lower("head") == F.col("_h"), "left")
    pages = notes.select(F.col("domain").alias("has"), F.regexp_replace(page_path(F.col("domain"), F.col("path")), r"\.md$", "").alias("page")).distinct()
    lone = pages.groupBy("page").agg(F.min("has").alias("only"), F.count("*").alias("n")).where("n = 1").select(F.col("page").alias("_p"), "only").join(d.select(F.col("target").alias("only"), F.col("to").alias("to3")), "only")
    known = by_name.join(lone, clean == F.col("_p"), "left")
    known = known.select("vault", "file", F.coalesce("target", "target2", "only").alias("target"), F.coalesce("to", "to2", "to3").alias("to"))
    at = page_path(F.col("target"), clean)
    there = known.where("target is not null and file is not null").select("vault", "file", F.col("target").alias("has"), at.alias("page")).join(pages, ["has", "page"], "left_semi").select("vault", "file", F.lit(True).alias("there"))
    known = known.join(there.withColumnsRenamed({"vault": "_v", "file": "_f"}), F.col("vault").eqNullSafe(F.col("_v")) & (F.col("file") == F.col("_f")), "left").select("vault", "file", "to", F.when(F.col("file").isNotNull(), F.coalesce("there", F.lit(False))).alias("found"))
    a, b = links.alias("a"), known.alias("b")
    return a.join(b, F.col("a.vault").eqNullSafe(F.col("b.vault")) & F.col("a.file").eqNullSafe(F.col("b.file")), "left").select("a.*", "b.to", "b.found")


def unresolved(links: DataFrame) -> DataFrame:
    """Violations: links to no known vault, and to notes that are not there."""
    bad = links.where("to is null or not found")
    return bad.select(F.lit("unresolved-link").alias("rule"), F.col("path").alias("subject"), F.concat_ws(" ", "place", "link").alias("detail"))


def rebuilt(notes: DataFrame, links: DataFrame, own: Column) -> DataFrame:
    """``notes`` with links that open the target's vault; ``own``: the vault of links that lead nowhere known.

    Links travel apart from texts; a text is rebuilt where it is, from what stands between its links.
    """
    by_note = links.groupBy("domain", "path").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("to")))).alias("_to"))
    between, found = F.split("text", LINK, -1), F.regexp_extract_all("text", F.lit(LINK), F.lit(0))
    vault = lambda k: F.coalesce(F.element_at("_to", k - 1)["to"], own)
    encoded = lambda k: F.replace(F.url_encode(vault(k)), F.lit("+"), F.lit("%20"))
    renamed = lambda link, k: F.when(link.rlike(r"[?&]vault="), F.concat(F.regexp_extract(link, r"^(.*?[?&]vault=)", 1), encoded(k), F.regexp_extract(link, r"[?&]vault=[^&#]*(.*)$", 1))).otherwise(link)
    k = F.sequence(F.lit(1), F.size(found))
    text = F.concat(F.array_join(F.transform(k, lambda i: F.concat(F.element_at(between, i), renamed(F.element_at(found, i), i))), ""), F.element_at(between, -1))
    out = notes.join(by_note, ["domain", "path"], "left")
    return out.withColumn("text", F.when(F.col("_to").isNotNull(), text).otherwise(F.col("text"))).drop("_to")
