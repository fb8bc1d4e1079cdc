"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates of every kind are cut out of whole texts by regular expressions;
their positions follow from the lengths of the matches and of the gaps between
them. The secret part of each is hashed, and hashes are counted over the whole
corpus by distinct owners and repositories (a repository is a name under an
owner). A secret of one owner is ``owned``, one of ``COPIED`` owners or more is
``copied`` (an example that went round), others are ``shared``.

Base kinds (assign, access, hex) are reported wherever they stand. The method
adds ``token``: long mixed tokens of no known form, which are noise unless they
belong to one owner; they are reported where they do.

Distinct (hash, owner, repository) triples are combined before they are
shuffled, and hashes are counted in two steps, so that a secret in a third of
all documents is a few rows a task. The join of statistics to candidates is a
plain sort-merge join, which adaptive execution splits where a hash is hot.

Defined results: null texts are empty; positions are code points; a null owner
or repository counts as one of its own; equal rows get equal results; rows that
share a doc_id but differ in text, or have no doc_id, are scanned on their own;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_column, hash_column, staged

#: Owners from which on a secret is a widely copied example.
COPIED = 3


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
#: kind -> (pattern, group that is the secret, least length of the secret)
KINDS = {
    "assign": (f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),  # a shorter run holds no longer one, so the least length can stand here
    "hex": ("[0-9a-f]{24,}", 0, 24),
    "token": ("[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")


def _cut(kind: str) -> Column:
    """Structs (kind number, position in the row, gap before, length, secret) of all matches of a kind; null if none."""
    pattern, group, _ = KINDS[kind]
    text = F.col("text")
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    parts = F.arrays_zip(
        F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("gap"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("size"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("secret"),
    )
    rows = F.transform(parts, lambda x, i: F.struct(F.lit(list(KINDS).index(kind)).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["secret"].alias("secret")))
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """doc, h, kind, start, end, secret_hash, owner, repository of every match that is long enough."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(doc_column().alias("doc"), hash_column(text).alias("h"), name(owner).alias("owner"), name(repository).alias("repository"), text.alias("text"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,secret:string>>")
    found = F.concat(*(F.coalesce(_cut(k), none) for k in KINDS))
    each = base.select("doc", "h", "owner", "repository", F.explode(found).alias("m")).select("doc", "h", "owner", "repository", "m.*")
    by = Window.partitionBy("doc", "h", "kind").orderBy("i", "owner", "repository")
    each = each.withColumn("again", F.coalesce(F.lag("i").over(by) == F.col("i"), F.lit(False)))  # equal rows
    long = F.when(F.col("again"), 0).otherwise(F.col("gap") + F.col("size")).cast("bigint")
    end = F.sum(long).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(x[2]) for x in KINDS.values())), F.col("kind") + 1)
    s = F.col("secret")
    mixed = s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")
    keep = (F.length(s) >= least) & ((F.col("kind") != list(KINDS).index("token")) | mixed)
    return placed.where(keep).select("doc", "h", "kind", "start", "end", F.xxhash64(s, F.length(s)).alias("secret_hash"), "owner", "repository")


def _of(kind: str):
    return lambda x: x["kind"] == list(KINDS).index(kind)


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash, n_owners, n_repositories over the whole corpus."""
    repos = found.select("secret_hash", "owner", "repository").distinct()
    owners = repos.groupBy("secret_hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("secret_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "source") -> DataFrame:
    """A row per row of ``docs``: counts of the base kinds, digest of base spans, all spans, and counts by ownership."""
    found = staged(candidates(docs, owner, repository), "secrets")  # few rows; two joins read them, and the patterns run once
    judged = found.join(ownership(found), "secret_hash")
    owned, copied = F.col("n_owners") == 1, F.col("n_owners") >= COPIED
    token = list(KINDS).index("token")
    judged = judged.where((F.col("kind") != token) | owned)
    by_doc = judged.groupBy("doc", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", "kind", "end", owned.alias("owned"), copied.alias("copied")))).alias("s")
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    spell = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owned:boolean,copied:boolean>>")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", doc_column().alias("doc"), hash_column(text).alias("h"))
    out = rows.join(by_doc, ["doc", "h"], "left").withColumn("s", F.coalesce("s", empty))
    count = lambda test: F.size(F.filter("s", test)).cast("bigint")
    return out.select(
        "doc_id",
        *(count(_of(k)).alias(f"n_{k}") for k in BASE),
        F.sha2(spell(F.filter("s", lambda x: x["kind"] < token)), 256).alias("base_sha256"),
        spell(F.col("s")).alias("spans"),
        count(lambda x: x["owned"]).alias("n_owned"),
        count(lambda x: x["copied"]).alias("n_copied"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
