"""Publish and upgrade: overlay, vaults, mirrors, domains, tools, dashboard."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core
from ..session import checkpointed
from ..sources.file_sink import exists, file_system, remove, write_files
from . import links
from .transfer import WORK


def overlay(instance: DataFrame, published: DataFrame, preserved: DataFrame, key: str = "path") -> DataFrame:
    """key, action: what an upgrade does with each path. Preserved paths and what is only in the instance stay."""
    a = instance.select(key).distinct().withColumn("here", F.lit(True))
    b = published.join(preserved.select(key), key, "left_anti").select(key).distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("there").isNull(), "keep").when(F.col("here").isNull(), "add").otherwise("replace")
    return a.join(b, key, "full").select(key, action.alias("action"))


def apply_overlay(actions: list[tuple[str, str]], source: str, target: str) -> None:
    """Copy what the plan adds or replaces."""
    for path, action in actions:
        if action in ("add", "replace"):
            to = Path(target, path)
            to.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(Path(source, path), to)


def with_domain(domains: DataFrame, spec: str, label: str | None = None) -> DataFrame:
    """``domains`` and the one of 'name:exposure', unless its name is there; names and labels are written once."""
    name, _, exposure = spec.partition(":")
    new = domains.sparkSession.createDataFrame([(name, exposure, label)], "name string, exposure string, vault_name string")
    new = new.withColumn("vault_name", F.coalesce("vault_name", core.vault_name(F.col("name"))))
    if not name or exposure not in ("private", "restricted", "public"):
        raise ValueError(f"not a domain with an exposure: {spec!r}")
    return domains.select("name", "exposure", "vault_name").unionByName(new.join(domains, "name", "left_anti").select("name", "exposure", "vault_name"))


def compiled(notes: DataFrame, domains: DataFrame) -> DataFrame:
    """vault_name, path (within the vault), text of every note, links opening the vault of what they lead to."""
    d = domains.select(F.col("name").alias("domain"), F.coalesce("vault_name", core.vault_name(F.col("name"))).alias("vault_name"))
    to = links.resolved(links.extracted(notes), notes, domains)
    out = links.rebuilt(notes.select("domain", "path", "text").join(d, "domain"), to, F.col("vault_name"))
    return out.select("vault_name", links.page_path(F.col("domain"), F.col("path")).alias("path"), "text")


def changes(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """path, action (add, replace, delete, same): what makes ``present`` (path, sha256) equal to ``wanted`` (path, sha256)."""
    a, b = wanted.select("path", F.col("sha256").alias("new")), present.select("path", F.col("sha256").alias("old"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("new") == F.col("old"), "same").otherwise("replace")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def _carried_out(plan: DataFrame, source: str, target: str, move: bool) -> None:
    """Do what a plan (path, action) says, on executors: files come from ``source``, moved or copied, over what is there."""

    def run(it):
        (system, a), (other, b) = file_system(source), file_system(target)
        for pdf in it:
            for path, action in zip(pdf["path"], pdf["action"], strict=True):
                if action == "delete":
                    if exists(other, f"{b}/{path}"):
                        other.delete_file(f"{b}/{path}")
                    continue
                if move and not exists(system, f"{a}/{path}"):
                    continue  # an earlier attempt has moved it
                other.create_dir(f"{b}/{path}".rpartition("/")[0], recursive=True)
                if move:
                    other.move(f"{a}/{path}", f"{b}/{path}")
                else:
                    new = f"{b}/{path}.new-copy"
                    fs.copy_files(f"{a}/{path}", new, source_filesystem=system, destination_filesystem=other) if system != other else other.copy_file(f"{a}/{path}", new)
                    other.move(new, f"{b}/{path}")
            yield pdf

    plan.where("action in ('add', 'replace', 'delete')").select("path", "action").repartition("path").mapInPandas(run, "path string, action string").write.format("noop").mode("overwrite").save()


def publish(violations: DataFrame, pages: DataFrame, vaults: list[str], only_vaults: bool = False) -> list[str]:
    """Bring each vault's folders up to date; refuses if the audit found something. No vault: fine, unless vaults were asked for.

    What was published is remembered by content hash beside the vault's folders: only pages that changed are written, by
    executors, pages whose note is gone are deleted, an unchanged vault is not touched, and neither is any other file.
    """
    if only_vaults and not vaults:
        raise ValueError("no vault is configured")
    if not violations.isEmpty():
        raise ValueError("the audit found violations; nothing was published")
    if not vaults:
        return []
    spark = pages.sparkSession
    names = [r.vault_name for r in pages.select("vault_name").distinct().collect()]  # a row for each domain
    files = checkpointed(pages.select(F.concat_ws("/", "vault_name", "path").alias("path"), "text").withColumn("sha256", F.sha2("text", 256)))
    for vault in vaults:
        system, top = file_system(vault)
        memory = f"{vault}/{WORK}/published"
        known = spark.read.parquet(memory) if exists(system, f"{top}/{WORK}/published/_SUCCESS") else spark.createDataFrame([], "path string, sha256 string")
        plan = checkpointed(changes(files, known).where("action <> 'same'"))
        if plan.isEmpty():
            continue
        stage = f"{vault}/{WORK}/stage-{uuid.uuid4().hex}"
        try:
            fresh = files.join(plan.where("action <> 'delete'"), "path", "left_semi")
            write_files(fresh.select("path", F.lit("").alias("seq"), F.encode("text", "UTF-8").alias("content")), stage)
            remove(memory)  # if what follows is lost, all pages are written again
            _carried_out(plan, stage, vault, move=True)
            files.select("path", "sha256").write.parquet(memory)
        finally:
            remove(stage)
    return sorted(names)


def synced(violations: DataFrame, pages: DataFrame, instance: str, config: dict, only_vaults: bool = False, quick: bool = False) -> dict[str, list[str]]:
    """Validate, compile the configured vaults, and mirror the instance. ``quick`` leaves out what the audit would find and the mirrors."""
    if quick:
        violations = violations.limit(0)
    vaults = publish(violations, pages, config.get("vaults", []), only_vaults)
    return {"vaults": vaults, "mirrors": [] if quick or only_vaults else [mirror(instance, x) for x in config.get("mirrors", [])]}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, changed of all files below a folder, hidden and empty ones too, listed on executors by what stands at its top."""
    system, top = file_system(root)
    heads = [(x.path, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(top, allow_not_found=True))]

    def run(it):
        system, top = file_system(root)
        for pdf in it:
            for path, folder in zip(pdf["path"], pdf["folder"], strict=True):
                found = system.get_file_info(fs.FileSelector(path, recursive=True)) if folder else [system.get_file_info(path)]
                own = [(x.path.removeprefix(top).lstrip("/"), x.size, x.mtime_ns // 1000) for x in found if x.type == fs.FileType.File]
                yield pd.DataFrame(own, columns=["path", "bytes", "changed"])

    return spark.createDataFrame(heads, "path string, folder boolean").repartition("path").mapInPandas(run, "path string, bytes bigint, changed bigint")


def mirror(instance: str, target: str) -> str:
    """A raw copy of the instance under its folder's name: new and changed files are copied by executors, and those that are gone go."""
    spark = SparkSession.active()
    to = f"{target.rstrip('/')}/{instance.rstrip('/').rpartition('/')[2]}"
    a, b = tree(spark, instance).select("path", "bytes", "changed"), tree(spark, to).select("path", F.col("bytes").alias("size"), F.col("changed").alias("copied"))
    action = F.when(F.col("size").isNull(), "add").when(F.col("bytes").isNull(), "delete").when((F.col("bytes") != F.col("size")) | (F.col("changed") > F.col("copied")), "replace")
    plan = checkpointed(a.join(b, "path", "full").select("path", action.alias("action")).where("action is not null"))
    _carried_out(plan, instance, to, move=False)
    return to


def doctor(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """job, tool, state and, for what is missing, the hint. A missing tool skips its job only."""
    found = present.where("path is not null").select("tool").distinct().withColumn("state", F.lit("present"))
    out = wanted.join(found, "tool", "left")
    return out.select("job", "tool", F.coalesce("state", F.lit("missing")).alias("state"), F.when(F.col("state").isNull(), F.col("hint")).alias("hint"))


def status(captures: DataFrame, records: DataFrame, nodes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """The dashboard: measure, value."""
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    out = one(captures, "pending captures").union(one(captures.where("batch is not null").select("batch").distinct(), "pending batches"))
    out = out.union(one(records.where("state = 'pending'"), "pending debriefs"))
    return out.union(one(nodes, "notes")).union(one(edge_table, "edges"))


LINT = {
    "trailing-space": r"(?m)[ \t]+$",
    "tab": r"\t",
    "no-final-newline": r"(?s)[^\n]\z",
    "many-blank-lines": r"\n{4,}",
}


def lint(texts: DataFrame) -> DataFrame:
    """rule, subject, detail of (path, text)."""
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in LINT.items())))
    return texts.select(F.explode(hit).alias("rule"), F.col("path").alias("subject"), F.lit("").alias("detail"))


def formatted(texts: DataFrame) -> DataFrame:
    """(path, text) with the lint rules applied; formatting twice changes nothing."""
    t = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\t", "    ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)[ ]+$", ""), r"\n{4,}", "\n\n\n")
    return texts.select("path", F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n")).alias("text"))
