"""Column functions: hashing, naming, parsing and gates. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.schemas import CHARTER_PLACEHOLDER, EXPOSURES, FRONTIER_PROVENANCE, ID_PATTERN, PREDICATES


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def byte_length(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; paths elsewhere stay as they are."""
    own = F.regexp_replace(path, "^file:/+", "/")
    top = "/" + root.removeprefix("file:").strip("/") + "/"
    return F.when(F.startswith(own, F.lit(top)), F.substr(own, F.lit(len(top) + 1))).otherwise(own)


#: Leading bytes (hex) of formats whose names can be missing or wrong.
MAGIC = {"89504E47": "png", "FFD8FF": "jpeg", "25504446": "pdf", "504B0304": "zip", "7B5C727466": "rtf", "52494646": "riff"}


#: Formats that are zip files inside; their names tell which.
ZIPPED = ("xlsx", "docx", "pptx", "epub", "odt", "ods")


def detected_type(path: Column, content: Column | None = None) -> Column:
    """By leading bytes where content is given and known, else the lower-case suffix, else 'unknown'."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))
    out = F.when(suffix == "", F.lit("unknown")).otherwise(F.when(suffix == "jpg", "jpeg").when(suffix == "htm", "html").when(suffix == "markdown", "md").otherwise(suffix))
    if content is not None:
        head = F.hex(F.substring(content, 1, 5))
        known = F.lit(None).cast("string")
        for magic, kind in MAGIC.items():
            known = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(known)
        out = F.when(known.isNull() | (known == "zip") & out.isin(*ZIPPED), out).otherwise(known)
    return out


def vault_name(domain: Column) -> Column:
    """personal -> Personal; words between hyphens each get a capital."""
    return F.initcap(F.replace(domain, F.lit("-"), F.lit(" ")))


def domain_spec(spec: Column) -> Column:
    """'name:exposure' as a struct."""
    return F.struct(F.split_part(spec, F.lit(":"), F.lit(1)).alias("name"), F.split_part(spec, F.lit(":"), F.lit(2)).alias("exposure"))


def in_namespace(family: Column, domain: Column) -> Column:
    return F.startswith(family, F.concat(domain, F.lit(":family-")))


def record_name(prefix: str, sha256: Column) -> Column:
    """A deterministic name: the prefix and the first twelve digits of a hash."""
    return F.concat(F.lit(prefix), F.substring(sha256, 1, 12))


def handoff_name(hashes: Column, batch: bool) -> Column:
    return record_name("frontier-batch-intake-" if batch else "frontier-intake-", F.sha2(F.array_join(F.array_sort(hashes), ""), 256))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")


def source_links(text: Column) -> Column:
    """Link targets below a heading Source or Sources, up to the next heading."""
    section = F.regexp_extract(text, r"(?ms)^## Sources?[ \t]*$(.*?)(?=^#|\z)", 1)
    plain = F.regexp_extract_all(section, F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))
    wiki = F.regexp_extract_all(section, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return F.concat(plain, wiki)


def is_placeholder(charter: Column) -> Column:
    return F.contains(charter, F.lit(CHARTER_PLACEHOLDER))


def is_frontier(provenance: Column) -> Column:
    return F.coalesce(provenance == FRONTIER_PROVENANCE, F.lit(False))


def known_predicate(predicate: Column) -> Column:
    return F.coalesce(predicate.isin(*PREDICATES), F.lit(False))


def known_exposure(exposure: Column) -> Column:
    return F.coalesce(exposure.isin(*EXPOSURES), F.lit(False))


def exposure_level(exposure: Column) -> Column:
    """0 public, 1 restricted, 2 private, null for anything else."""
    out = F.lit(None).cast("int")
    for level, name in enumerate(EXPOSURES):
        out = F.when(exposure == name, level).otherwise(out)
    return out


def canonical_id(id_: Column) -> Column:
    return F.coalesce(id_.rlike(ID_PATTERN), F.lit(False))


def tier(path: Column) -> Column:
    """1 note, 2 asset, 3 archive, 0 pending in an inbox: a matter of the path below a domain."""
    return F.when(path.rlike(r"(^|/)inbox/archive/"), 3).when(path.rlike(r"(^|/)inbox/"), 0).when(path.rlike(r"(^|/)assets/"), 2).when(path.rlike(r"\.md$"), 1)


def vault_links(text: Column, vault: Column) -> Column:
    """Cross-domain links opened by the vault's own name."""
    return F.regexp_replace(text, F.lit(r"obsidian://open\?vault=[^&)\s]+"), F.concat(F.lit("obsidian://open?vault="), vault))


def sample_of(content: Column, n: int = 512) -> Column:
    """A bounded structural sample of an unknown capture."""
    return F.substring(content, 1, n)
