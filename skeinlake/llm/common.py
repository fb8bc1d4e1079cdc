"""What the corpus operators share: words, hashes, row keys and the shared folder.

Row key
    Operators that relate documents to each other identify a row by
    ``(doc, h)``: ``doc`` is ``doc_id`` (a null id sorts after every other id)
    and ``h`` is a 64-bit hash of the text. A null id shares its ``doc`` with
    the greatest id; for these two ``h`` is a 63-bit hash, below zero for the
    id and not for null. Rows that agree in both are one
    document and get the same result, once per row; rows that share a doc_id
    but differ in text are separate documents, ordered by ``h``.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1  # doc of a null doc_id, and of that id
HALF = 2**62


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a folder of our own is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_remove, at)
    return at.rstrip("/")


def _remove(at: str) -> None:
    import shutil

    shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


_STAGED: set[str] = set()


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Shuffle files of the write are of no use then; Spark drops them as the
    write ends (they would otherwise stay until the driver collects the plan).
    What is not discarded before goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _STAGED:
        atexit.register(_discard_all, spark)
    _STAGED.add(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _STAGED.discard(folder)


def _discard_all(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc:
        return  # the session is over
    for folder in sorted(_STAGED):
        _delete(spark, folder)


def discard(*dfs: DataFrame) -> None:
    """Remove the folders of ``staged`` tables that nothing will read again."""
    for df in dfs:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def doc_column() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def hash_column(text: Column) -> Column:
    """h of the row key, for a text that is not null. The order of hashes stays."""
    h, own = F.xxhash64(text), F.col("doc_id").cast("bigint")
    return F.when(own < NO_ID, h).otherwise(F.shiftright(h, 1) + F.when(own.isNull(), HALF).otherwise(-HALF))


def id_column() -> Column:
    """doc_id of a row key."""
    return F.when((F.col("doc") < NO_ID) | (F.col("h") < 0), F.col("doc"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, h, text) with null texts as empty ones; all other columns are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(doc_column().alias("doc"), hash_column(text).alias("h"), text.alias("text"))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones, for operators that look at one row at a time."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


ODD = np.uint64(0x9E3779B97F4A7C15)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two uint64 arrays."""
    with np.errstate(over="ignore"):
        return mix(mix(a + ODD) * np.uint64(0xD6E8FEB86659FD93) + b)


class Remembered(dict):
    """A cache of a Python worker, bounded by bytes: it forgets all at ``limit``, and when a task ends (see ``task``)."""

    every: weakref.WeakSet[Remembered] = weakref.WeakSet()

    def __init__(self, limit: int = 24 << 20):
        super().__init__()
        self.limit, self.size = limit, 0
        Remembered.every.add(self)

    def keep(self, key, value, size: int):
        """``size``: bytes of key and value; the dictionary's own are added."""
        self.size += size + 120
        if self.size > self.limit:
            self.forget()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.size = 0

    __hash__ = object.__hash__


def task(run):
    """A mapInArrow function that leaves its worker, which later stages use too, with empty caches and without spare memory."""

    def inner(it):
        try:
            yield from run(it)
        finally:
            tidy()

    return inner


def tidy() -> None:
    for x in [*Remembered.every]:
        x.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no GNU libc
        pass


class WordHashes(Remembered):
    """bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        return self.keep(word, xxhash.xxh3_64_intdigest(word), len(word) + 65)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(it: Iterator, n: int = 500) -> Iterator:
    """Arrow record batches in pieces of ``n`` rows, so that few of them become Python objects at once."""
    for b in it:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; one hash of all words if there are fewer; empty if none."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    out = mix(words[: n - width + 1] + ODD)
    for k in range(1, width):
        out = combine(out, words[k : n - width + 1 + k])
    return out


#: Columns that stages of a pipeline know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def plain_names(stage):
    """A function from documents to the same columns of documents, whatever other columns are called: they get plain names on their way."""

    @wraps(stage)
    def inner(docs: DataFrame, *rest, **more) -> DataFrame:
        names = docs.columns
        out = stage(docs.toDF(*(x if x in KNOWN else f"extra{k}" for k, x in enumerate(names))), *rest, **more)
        return out.toDF(*names)

    return inner


def components(spark: SparkSession, edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b bigint).

    Alternates large-star and small-star (Kiveris et al., 2014); every round is
    aggregations and joins, staged to the shared folder, and edges never grow
    in number. Nothing is collected but two counts a round.
    """
    e = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label)
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("m").alias("a"), F.col("b")).where("a <> b").distinct()
        low2 = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low2, large.b == low2.u)
        new = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), F.col("b"))).where("a <> b").distinct()
        last, e = e, staged(new, label)
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
