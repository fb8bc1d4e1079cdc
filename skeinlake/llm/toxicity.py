"""Toxicity by weak supervision.

1. A bounded sample of labelled training rows (``SAMPLE`` of least hash) gives
   the lexicon: words whose presence goes with the toxic label. Equal texts of
   equal label count once there.
2. Voters look at those rows and at as many rows without a label: one for each
   lexicon word (toxic or abstain), and patterns over the whole text (several
   hits, dense hits, shouting). A generative model of class-conditional votes is
   fitted to the votes by EM. Labels say once which class is which: they give the
   rates that EM starts from. From the posteriors, the correlation of each pair of
   voters within the classes is estimated, and a voter that goes with others counts
   for less (one part in the number of voters it doubles). EM stops early, after
   ``ROUNDS``: votes that go together pull it away from toxicity later on.
3. A logistic regression over the voters' evidence, and whether there was any, is
   trained on the posterior labels of all these rows, brought to the labelled rows'
   scale by two numbers, and scores every whole text in one pass.

The bounds of what reaches the driver and is broadcast are ``SAMPLE`` rows of
voter numbers, twice, and ``LEXICON`` words. Labels of held-out rows are never
read into the model, nor are lang, source or doc_id of any row, nor held-out texts.

Defined results: null texts are empty; an empty text has no hits and gets the
score of such texts; without a label of both classes every score is the
training rate of toxic labels (0 without labels); rows are scored on their own,
so repeated rows and extra columns need no care; a document with several label
rows counts once for each (in the lexicon, once for each class); null labels are no labels; a null doc_id has none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged
from .decontaminate import words_of

#: Labelled rows that the models are fitted on at most.
SAMPLE = 20_000
#: Words of the lexicon at most; least evidence (a z score of log odds) and toxic documents of each.
LEXICON, LEAST_Z, LEAST_DOCS = 400, 3.5, 4
#: Least ratio of a lexicon word's shares in toxic and in other documents, which holds at any rate of toxic labels.
RATIO = 4
THRESHOLD = 0.3
ROUNDS = 1
#: The first are evidence for the classifier only: they repeat what the lexicon's voters say.
PATTERNS = ("any hit", "no hit", "two hits", "four hits", "dense", "very dense", "shouting")
EVIDENCE = 2


def _crc(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, bound: int = SAMPLE) -> DataFrame:
    """(id, toxic, h, x, text): the rows of the first ``bound`` labelled ids by hash, and of as many others, toxic null, outside the held-out remainder.

    Ids are chosen before texts are read, so a text is only read for them. h and x are the hashes of id and text; rows that
    repeat an id are all here, ``first_rows`` bounds them.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and id is not null").where(_crc("id") % modulus != held_out)
    hash_ = F.xxhash64("id", F.lit(7))
    few = own.withColumn("k", hash_).orderBy("k", "id", "toxic").limit(bound)
    ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").where(_crc("id") % modulus != held_out)
    others = ids.join(own.select("id").distinct(), "id", "left_anti").withColumn("k", hash_).orderBy("k", "id").limit(bound).withColumn("toxic", F.lit(None).cast("int"))
    chosen = few.unionByName(others.distinct())
    text = F.coalesce("text", F.lit(""))
    own_text = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return own_text.select("id", "toxic", F.xxhash64("id", F.lit(7)).alias("h"), F.xxhash64("text").alias("x"), "text")


def first_rows(rows: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` labelled rows and ``bound`` others, those of least hashes."""
    few = lambda which: rows.where(which).orderBy("h", "x", "toxic").limit(bound)
    return few("toxic is not null").unionByName(few("toxic is null"))


def lexicon(rows: DataFrame) -> dict[bytes, int]:
    """word -> number of its voter: the words that go with toxic labels most clearly."""

    def count(it):
        for b in it:
            n: Counter = Counter()
            toxic: Counter = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = set(words_of(text))
                own.add(b"")  # counts the documents
                n.update(own)
                if y:
                    toxic.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[w] for w in n], pa.int64())], names=["word", "n", "a"])

    once = rows.where("toxic is not null").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates()  # copies prove nothing more
    by_word = once.mapInArrow(count, "word binary, n bigint, a bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where(f"a >= {LEAST_DOCS}")
    by_word = staged(by_word, "lexicon")
    whole = by_word.where("word = binary('')").first()
    if whole is None or whole.a == whole.n:
        discard(by_word)
        return {}
    b, rest, a = F.col("n") - F.col("a"), whole.n - whole.a, F.col("a")
    odds = F.log((a + 0.5) / (whole.a - a + 0.5)) - F.log((b + 0.5) / (rest - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    # a word of the lexicon is said far more often by toxic documents, else it is common speech of long ones
    often = (a + 0.5) / (whole.a + 1) >= RATIO * (b + 0.5) / (rest + 1)
    top = by_word.where("word <> binary('')").withColumn("z", z).where(F.col("z") >= LEAST_Z).where(often)
    words = {bytes(r.word): k for k, r in enumerate(top.orderBy(F.desc("z"), "word").limit(LEXICON).collect())}
    discard(by_word)
    return words


def voters(text: str, words: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Numbers of the voters that speak: lexicon words found (with repeats) and patterns."""
    all_words = words_of(text)
    hits = [k for k in map(words.get, all_words) if k is not None]
    n, m = len(hits), max(1, len(all_words))
    letters = sum(map(text.count, "aeiounrst")) + 1
    loud = sum(map(text.count, "AEIOUNRST"))
    said = [n > 0, n == 0, n > 1, n > 3, n / m > 0.01, n / m > 0.05, loud > letters]
    return hits, [k for k, x in enumerate(said) if x]


def _parts(x: np.ndarray, n: int = 2048):
    """Row ranges and their rows in double precision, so that the whole matrix never is."""
    for at in range(0, len(x), n):
        yield slice(at, at + n), x[at : at + n].astype(float)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(rows @ w for _, rows in _parts(x))])


def _gram(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The sum of p times the outer square of each row."""
    return sum(((rows * p[at, None]).T @ rows for at, rows in _parts(x)), np.zeros((x.shape[1],) * 2))


def _sums(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sum((p[at] @ rows for at, rows in _parts(x)), np.zeros(x.shape[1]))


class LabelModel:
    """Class-conditional rates of each voter, fitted to the votes by EM; weights for correlated voters.

    ``start``: labels of the rows where known, else nan. They are used for the first rates only.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS):
        known = ~np.isnan(start)
        self._fit(votes[known], np.where(start[known] == 1, 0.95, 0.05))
        for _ in range(rounds):
            self._fit(votes, self.posterior(votes))
        self.post = self.posterior(votes)

    def _fit(self, votes: np.ndarray, post: np.ndarray) -> None:
        self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        self.on = (_sums(post, votes) + 0.5) / (post.sum() + 1)
        self.off = (_sums(1 - post, votes) + 0.5) / ((1 - post).sum() + 1)
        self.weight = self._weights(votes, post)

    def _weights(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        total = np.zeros((votes.shape[1],) * 2)
        for p, rate in ((post, self.on), (1 - post, self.off)):
            joint = _gram(votes, p) / max(p.sum(), 1e-9)
            sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
            total += p.mean() * np.clip((joint - np.outer(rate, rate)) / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(total, 1)
        return 1 / np.where(total > 0.2, total, 0).sum(1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on, off = np.log(self.on / self.off), np.log((1 - self.on) / (1 - self.off))
        z = np.log(self.prior / (1 - self.prior)) + _times(votes, self.weight * (on - off)) + (self.weight * off).sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(_times(x, w), -30, 30)))
        step = np.linalg.solve(_gram(x, p * (1 - p) + 1e-6) + np.diag(penalty), _sums(y - p, x) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Classifier:
    def __init__(self, words: dict[bytes, int], weights: np.ndarray):
        self.words, self.weights = words, weights

    def score(self, text: str) -> float:
        hits, said = voters(text, self.words)
        z = self.weights[-1] + self.weights[list(set(hits))].sum() + self.weights[[len(self.words) + k for k in said]].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Classifier:
    rows = sample(docs, labels, modulus, held_out)
    words = lexicon(rows)

    def vote(it):
        for b in it:
            both = [voters(t, words) for t in b.column("text").to_pylist()]
            ids = [sorted(set(h)) + [len(words) + k for k in s] for h, s in both]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("x"), b.column("toxic"), pa.array(ids, pa.list_(pa.int32()))], names=["h", "x", "toxic", "votes"])

    # the votes are chosen from, not the texts, so that no task sees more of these than its share
    voted = staged(rows.mapInArrow(vote, "h bigint, x bigint, toxic int, votes array<int>"), "votes")
    got = first_rows(voted).select("toxic", "votes").toArrow()  # SAMPLE rows, twice, at most
    discard(voted)
    y = (got.column("toxic").to_numpy().astype(float) > 0).astype(float)
    y[got.column("toxic").is_null().to_numpy()] = np.nan
    size = len(words) + len(PATTERNS)
    known = y[~np.isnan(y)]
    if not len(known) or known.min() == known.max():
        w = np.zeros(size + 1)
        w[-1] = 30.0 if len(known) and known[0] else -30.0
        return Classifier(words, w)
    votes = np.zeros((len(y), size), np.float32)
    said = got.column("votes").combine_chunks()
    votes[np.repeat(np.arange(len(y)), said.value_lengths().to_numpy()), said.flatten().to_numpy()] = 1
    voting = np.r_[: len(words), len(words) + EVIDENCE : size]
    w = regression(votes, LabelModel(votes[:, voting], y).post)
    own = ~np.isnan(y)
    scale, shift = regression((votes[own] @ w[:-1] + w[-1])[:, None], y[own], ridge=1e-3)
    w *= scale
    w[-1] += shift
    return Classifier(words, w)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out))

    def run(it):
        model = shared.value
        for b in it:
            score = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    base = docs.select("doc_id", F.coalesce(_crc("doc_id") % modulus == held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    out = base.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
