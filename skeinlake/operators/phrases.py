"""Which texts contain which phrases: an inverted index of words, and phrases checked by positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Characters of phrases that are broadcast at once at most (one phrase may be longer), and words and texts looked for by broadcast.
BLOCK_CHARS, FEW_WORDS = 8_000_000, 100_000
#: Phrases of one or two words that are held against all texts at most; more are looked for in the texts' distinct words.
FEW_SHORT = 50
#: Sizes of grams, in characters, that lead from parts of words to words.
GRAMS = (1, 2, 4, 8, 16)
#: Parts of a stored index; words are dealt by hash.
INDEX_PARTS = 64


def _words(c: Column | str) -> Column:
    return F.split(c, " ", -1)


def index(texts: DataFrame) -> DataFrame:
    """word, text (hash of it), positions: every word between spaces of the texts (t), equal texts once. Texts themselves don't travel."""
    one = texts.where("t is not null").select(F.xxhash64("t").alias("text"), F.posexplode(_words("t")).alias("position", "word"))
    return one.groupBy("word", "text").agg(F.sort_array(F.collect_set("position")).alias("positions"))


def store(index_: DataFrame, folder: str) -> None:
    """Write an index in parts by word, sorted, so that a few words read a few row groups."""
    part = F.pmod(F.xxhash64("word"), F.lit(INDEX_PARTS)).cast("int")
    index_.withColumn("part", part).repartition("part").sortWithinPartitions("part", "word").write.partitionBy("part").mode("overwrite").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def small(df: DataFrame) -> DataFrame:
    """Broadcast what has been counted to be small."""
    return F.broadcast(df) if df.limit(FEW_WORDS + 1).count() <= FEW_WORDS else df


def postings(texts: DataFrame) -> DataFrame:
    """word, text (hash of it), position: a row per word between spaces of the texts (t). Nothing is gathered, so words that aren't sought end in the scan."""
    return texts.where("t is not null").select(F.xxhash64("t").alias("text"), F.posexplode(_words("t")).alias("position", "word")).select("word", "text", "position")


def _placed(index_: DataFrame, words: DataFrame) -> DataFrame:
    """``index_`` as postings; of a stored one the parts of ``words`` only."""
    if "part" in index_.columns:
        part = F.pmod(F.xxhash64("word"), F.lit(INDEX_PARTS)).cast("int")
        index_ = index_.where(F.col("part").isin([r.part for r in words.select(part.alias("part")).distinct().collect()]))  # INDEX_PARTS at most
    return index_.select("word", "text", F.explode("positions").alias("position")) if "positions" in index_.columns else index_.select("word", "text", "position")


def candidates(index_: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, text (hash) of texts that may contain a phrase (three words or more): those with its two rarest inner words in their places.

    index_: of ``index``, ``stored`` or ``postings``. It is passed over twice, to count the sought words and to fetch
    the two of each phrase; what leaves the second pass is as long as those words are rare.
    """
    parts = phrases.select("phrase", F.posexplode(F.expr("slice(split(phrase, ' ', -1), 2, size(split(phrase, ' ', -1)) - 2)")).alias("offset", "word"))
    sought = checkpointed(parts.groupBy("phrase", "word").agg(F.min("offset").alias("offset")))
    words = sought.select("word").distinct()
    placed = _placed(index_, words)
    counted = placed.join(small(words), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "word"))
    ranked = checkpointed(sought.join(counted, "word", "left").withColumn("rank", rank).where("rank <= 2").select("phrase", F.xxhash64("phrase").alias("key"), "word", "offset", "rank"))
    starts = placed.join(small(ranked.select("key", "word", "offset", "rank")), "word").select("key", "text", (F.col("position") - F.col("offset")).alias("start"), "rank")
    both = starts.groupBy("key", "text", "start").agg(F.bit_or("rank").alias("ranks"))  # 3 where both words are in their places
    wanted = ranked.groupBy("phrase", "key").agg(F.bit_or("rank").alias("ranks"))
    return both.join(small(wanted), ["key", "ranks"]).select("phrase", "text").distinct()


def _grams(word: Column, size: int) -> Column:
    return F.when(F.length(word) >= size, F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda k: F.substring(word, k, F.lit(size))))


def words_around(words: DataFrame, parts: DataFrame) -> DataFrame:
    """part, kind, word, n: the words (word, n; each once) that contain a part (kind 'in'), end with it ('end') or start with it ('start').

    A word that contains a part has its first and its last gram, of the greatest size of ``GRAMS`` that fits. The rarer of both leads to the words.
    """
    sized = parts.select("part", "kind", F.coalesce(*(F.when(F.length("part") >= g, F.lit(g)) for g in sorted(GRAMS, reverse=True))).alias("size"))
    sized = sized.where("size is not null").select("part", "kind", F.explode(F.array(F.substring("part", F.lit(1), F.col("size")), F.substring("part", F.length("part") - F.col("size") + 1, F.col("size")))).alias("gram")).distinct()
    sized = checkpointed(sized)
    sought = small(sized.select("gram").distinct())
    each = words.where("word <> ''").select("word", "n", F.explode(F.array_distinct(F.concat(*(F.coalesce(_grams(F.col("word"), g), F.array().cast("array<string>")) for g in GRAMS)))).alias("gram"))
    held = checkpointed(each.join(sought, "gram", "left_semi"))
    rare = F.row_number().over(Window.partitionBy("part", "kind").orderBy(F.coalesce("m", F.lit(0)), "gram"))
    led = sized.join(held.groupBy("gram").agg(F.count("*").alias("m")), "gram", "left").withColumn("rare", rare).where("rare = 1").select("part", "kind", "gram")
    fits = F.when(F.col("kind") == "in", F.contains("word", "part")).when(F.col("kind") == "end", F.endswith("word", "part")).otherwise(F.startswith("word", "part"))
    return led.join(held, "gram").where(fits).select("part", "kind", "word", "n")


def short_candidates(index_: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, text (hash) of texts that may contain a phrase of one or two words, '' and ' ' aside.

    A phrase without a space is inside of a word. One of two words has a word that ends with the first and
    one that starts with the second; the half that fewer places have leads to the texts.
    """
    first, second = (F.element_at(_words("phrase"), k) for k in (1, -1))
    half = lambda part, kind: F.struct(part.alias("part"), F.lit(kind).alias("kind"))
    halves = phrases.select("phrase", F.explode(F.when(F.size(_words("phrase")) == 1, F.array(half(first, "in"))).otherwise(F.array(half(first, "end"), half(second, "start")))).alias("h")).select("phrase", "h.*").where("part <> ''")
    halves = checkpointed(halves)
    placed = (index_.select("word", "text") if "positions" in index_.columns else index_).select("word", "text")
    around = checkpointed(words_around(placed.groupBy("word").agg(F.count("*").alias("n")), halves.select("part", "kind").distinct()))
    rarer = F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "kind"))
    led = halves.join(around.groupBy("part", "kind").agg(F.sum("n").alias("n")), ["part", "kind"], "left").withColumn("rarer", rarer).where("rarer = 1").select("phrase", "part", "kind")
    pairs = checkpointed(led.join(around, ["part", "kind"]).select("phrase", "word"))
    return placed.join(small(pairs), "word").select("phrase", "text").distinct()


def containing(texts: DataFrame, phrases: DataFrame, index_: DataFrame | None = None) -> DataFrame:
    """The rows of ``texts`` (t, ...) beside those of ``phrases`` (phrase, ...) where t contains phrase, and ``first``: t starts with it.

    A word that stands between two spaces in a phrase stands alone in every text that contains it. So the words of
    texts (or a stored ``index``) tell which texts have a phrase's two rarest inner words at the right
    distance; only those texts are fetched, once, and searched. Phrases of fewer than three words have no inner
    word: the distinct words of the texts are searched for them by grams (``short_candidates``). Only up to ``FEW_SHORT`` such
    phrases, '' and ' ' are held against all texts, in blocks of bounded size, one pass over the texts for each.

    Nulls contain nothing and are contained nowhere; the empty phrase is in every text; repeated rows count one by one.
    """
    distinct = checkpointed(phrases.select("phrase").where("phrase is not null").distinct().withColumn("n", F.size(_words("phrase"))))
    long, short = distinct.where("n > 2").drop("n"), distinct.where("n <= 2").drop("n")
    words = postings(texts) if index_ is None else index_
    n_long, n_short = distinct.agg(F.count_if(F.col("n") > 2), F.count_if(F.col("n") <= 2)).first()
    ways = [candidates(words, long)] if n_long else []
    if n_short > FEW_SHORT:
        bare = F.col("phrase").isin("", " ")
        ways.append(short_candidates(words, short.where(~bare)))
        short = short.where(bare)
    held = None
    if ways:
        found = checkpointed(reduce(DataFrame.unionByName, ways)).withColumnRenamed("text", "_text")
        few = small(found)  # else texts and candidates meet by hash of text
        held = texts.withColumn("_text", F.xxhash64("t")).join(few, "_text").where(F.contains("t", "phrase")).drop("_text")
    chars = short.agg(F.sum(F.length("phrase") + 1)).first()[0] or 0
    for k in range(blocks := -(-chars // BLOCK_CHARS)):
        block = F.broadcast(short.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k))
        near = texts.join(block, F.contains("t", "phrase"))
        held = near if held is None else held.unionByName(near)
    if held is None:
        held = texts.crossJoin(distinct.select("phrase")).limit(0)
    return held.withColumn("first", F.startswith("t", "phrase")).join(phrases, "phrase")
