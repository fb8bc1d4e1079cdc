"""The audit: independent rules, each a DataFrame of (rule, subject, detail). It reads and reports only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core
from ..model.schemas import FRONTIER_FIELDS
from . import graph


def _found(df: DataFrame, rule: str, subject: Column | str, detail: Column | str) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(rule).alias("rule"), as_col(subject).cast("string").alias("subject"), F.coalesce(as_col(detail).cast("string"), F.lit("")).alias("detail"))


def unresolved_intake(frontier: DataFrame, intakes: DataFrame) -> DataFrame:
    known = intakes.select(F.col("intake_id").alias("source_intake"))
    return _found(frontier.join(known, "source_intake", "left_anti"), "unresolved-intake", "artifact_id", "source_intake")


def inventory_mismatch(frontier: DataFrame, intakes: DataFrame) -> DataFrame:
    i = intakes.select(F.col("intake_id").alias("source_intake"), "inventory_path")
    bad = frontier.where("source_inventory is not null").join(i, "source_intake").where(~F.col("source_inventory").eqNullSafe(F.col("inventory_path")))
    return _found(bad, "inventory-mismatch", "artifact_id", "source_inventory")


def hash_not_in_inventory(frontier: DataFrame, intakes: DataFrame, inventory: DataFrame) -> DataFrame:
    """inventory: (inventory_path, sha256). Only inventories that an artifact refers to are joined."""
    f = frontier.where("source_sha256 is not null").join(intakes.select(F.col("intake_id").alias("source_intake"), "inventory_path"), "source_intake")
    lines = inventory.select("inventory_path", F.col("sha256").alias("source_sha256"))
    return _found(f.join(lines, ["inventory_path", "source_sha256"], "left_anti"), "hash-not-in-inventory", "artifact_id", "source_sha256")


def incomplete_contract(frontier: DataFrame) -> DataFrame:
    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in FRONTIER_FIELDS]
    missing = F.array_compact(F.array(F.when(~core.is_frontier(F.col("provenance")), F.lit("provenance")), *blank))
    return _found(frontier.select("artifact_id", F.explode(missing).alias("field")), "incomplete-contract", "artifact_id", "field")


def source_pointer(frontier: DataFrame) -> DataFrame:
    none = frontier.where("source_sha256 is null and source_inventory is null")
    both = frontier.where("source_sha256 is not null and source_inventory is not null")
    return _found(none, "no-source-pointer", "artifact_id", F.lit("")).union(_found(both, "two-source-pointers", "artifact_id", F.lit("")))


def broken_lineage(nodes: DataFrame, assets: DataFrame, archives: DataFrame) -> DataFrame:
    return _found(graph.trace(nodes, assets, archives).where("state not in ('whole', 'no source')"), "broken-lineage", "id", F.concat_ws(": ", "state", "asset"))


def unknown_predicate(edge_table: DataFrame) -> DataFrame:
    return _found(edge_table.where(~core.known_predicate(F.col("predicate"))), "unknown-predicate", "src", "predicate")


def unknown_exposure(nodes: DataFrame) -> DataFrame:
    return _found(nodes.where(~core.known_exposure(F.col("exposure"))), "unknown-exposure", "id", "exposure")


def dangling_edge(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    return _found(edge_table.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti"), "dangling-edge", "src", "dst")


def exposure_boundary(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """A note that leans on a more restrictive one."""
    level = lambda end: nodes.select(F.col("id").alias(end), core.exposure_level(F.col("exposure")).alias(f"{end}_level"))
    bad = edge_table.join(level("src"), "src").join(level("dst"), "dst").where("src_level < dst_level")
    return _found(bad, "exposure-boundary", "src", F.concat_ws(" ", "predicate", "dst"))


def identifiers(nodes: DataFrame) -> DataFrame:
    shape = _found(nodes.where(~core.canonical_id(F.col("id"))), "id-shape", F.coalesce("id", "path"), "path")
    twice = nodes.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return shape.union(_found(twice, "id-repeated", "id", "n"))


def frontier_edges(frontier: DataFrame) -> DataFrame:
    return _found(frontier.where("size(related) > 0"), "edges-on-frontier", "artifact_id", F.size("related"))


def malformed(nodes: DataFrame) -> DataFrame:
    return _found(nodes.where("malformed"), "malformed-note", "path", F.lit(""))


def charter_shape(charters: DataFrame) -> DataFrame:
    """3 to 7 families with the domain's full name in front, at most three principles; placeholders are reported as such."""
    open_ = core.is_placeholder(F.col("body"))
    n = F.size(F.coalesce("families", F.array()))
    out = _found(charters.where(open_), "charter-placeholder", "domain", F.lit(""))
    out = out.union(_found(charters.where(~open_ & ~n.between(3, 7)), "charter-families", "domain", n))
    out = out.union(_found(charters.where(~open_ & (F.size(F.coalesce("principles", F.array())) > 3)), "charter-principles", "domain", F.size("principles")))
    each = charters.where(~open_).select("domain", F.explode("families").alias("family")).where(~core.in_namespace(F.col("family"), F.col("domain")))
    return out.union(_found(each, "charter-namespace", "domain", "family"))


def missing_primary(debriefs: DataFrame, assets: DataFrame) -> DataFrame:
    return _found(debriefs.join(assets.select(F.col("path").alias("primary_asset")), "primary_asset", "left_anti"), "missing-primary", "record_id", "primary_asset")


def audit(nodes: DataFrame, assets: DataFrame, archives: DataFrame, frontier: DataFrame, intakes: DataFrame, inventory: DataFrame, charters: DataFrame | None = None, debriefs: DataFrame | None = None) -> DataFrame:
    """All rules; every violation a row. Every rule is a join or filter of its own, so they run side by side."""
    e = graph.edges(nodes)
    parts = [
        unresolved_intake(frontier, intakes), inventory_mismatch(frontier, intakes), hash_not_in_inventory(frontier, intakes, inventory), incomplete_contract(frontier), source_pointer(frontier),
        frontier_edges(frontier), broken_lineage(nodes, assets, archives), unknown_predicate(e), unknown_exposure(nodes), dangling_edge(e, nodes), exposure_boundary(e, nodes), identifiers(nodes), malformed(nodes),
    ]
    if charters is not None:
        parts.append(charter_shape(charters))
    if debriefs is not None:
        parts.append(missing_primary(debriefs, assets))
    return reduce(DataFrame.union, parts)
