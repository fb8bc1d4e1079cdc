"""Language identification with interpolated Kneser-Ney character models.

Characters of letters fall into 63 buckets (a-z, and 37 for all others by
hash), 0 stands for the edge of a word; a word is predicted letter by letter
and at its end, from the three characters before. An n-gram's hash is its
bucket codes packed into six bits each, so a language has 2**24 four-grams at
most: the bound of what is gathered and broadcast, whatever the corpus.

Four-gram counts are summed over all training documents (each batch adds up its
own first); lower orders use continuation counts. Each language's probabilities
lie in arrays of its own, sorted by hash. A document gets the language of lowest
cross-entropy per character, ties to the smaller name. ``score`` is the normalised
likelihood of that choice over ``SHARPNESS`` characters.

Rejection is calibrated by cross-fitting: training documents fall into ``FOLDS``
by hash of their id, counts are kept by fold, and the documents of fold 0 are scored
by the models of all other counts. Of two measures, the cross-entropy above the
median of those of its language (which tells for long texts) and the same times the
root of the number of predictions (which tells for short ones, whose entropies
scatter), a document is rejected if both are over ``SPREAD`` times their 99.9 % quantile. The
model itself is of all folds. A language that fold 0 has no documents of, or that
only it has, has no limit.

Defined results: null texts and texts without letters are ``und``, score 0, and
rejected; without any training document so is everything; rows are scored on
their own, so repeated rows and extra columns need no care; a row without
doc_id is not trained on and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, plain_names, slices, staged, task

ORDER = 4
BITS = 6
OTHERS = 37
SHARPNESS = 20.0
FOLDS = 3
#: How many times as far above its language's median as 99.9 % of the calibrating documents a rejected one lies, at least.
SPREAD = 4
#: Calibrating documents from which a language's limits are taken. With fewer, they are those of all languages together where
#: these are wider. All languages need ``POOLED`` together, else nothing with letters is rejected.
CALIBRATING, POOLED = 100, 20
UNKNOWN = "und"


def _letter_table() -> np.ndarray:
    """Code of each code point below 2**18: 1-26, 27-63, or -1 for what is no letter."""
    out = np.full(1 << 18, -1, np.int64)
    for c in range(1 << 18):
        if chr(c).isalpha():
            low = chr(c).lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % OTHERS
    return out


_TABLE: list[np.ndarray] = []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams of the words' letters in a row, and how many belong to each word (0 without letters)."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    cut = points == 10
    word = np.cumsum(cut) - cut
    code = np.where(points < 1 << 18, _TABLE[0][np.minimum(points, (1 << 18) - 1)], -1)
    code[cut] = 0
    keep = code >= 0
    code, word, cut = code[keep], word[keep], cut[keep]
    size = np.bincount(word, minlength=len(words)) - 1
    keep = size[word] > 0
    code, word, cut = code[keep], word[keep], cut[keep]
    begin = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1]) if len(code) else np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
    key = code.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(code)
        before[back:] = code[:-back]
        before[place < back] = 0
        key |= before << (BITS * back)
    return key, np.where(size > 0, size + 1, 0)


def flat_words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts as a dictionary array, and the number of words of each."""
    all_words: list[str] = []
    n = []
    for t in texts:
        w = t.split() if t else []
        all_words += w
        n.append(len(w))
    return pa.array(all_words, pa.string()).dictionary_encode(), np.array(n, np.int64)


class KneserNey:
    """One language: for each order, sorted hashes of n-grams and of contexts with their interpolation terms."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for n in range(ORDER, 0, -1):
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
            context, at = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(at, counts)
            kinds = np.bincount(at)
            self.orders.append((keys, (counts - d) / total[at], context, d * kinds / total))
            keys, counts = np.unique(keys & ((1 << BITS * (n - 1)) - 1), return_counts=True)  # continuations
            counts = counts.astype(np.float64)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        out, weight = np.zeros(len(keys)), np.ones(len(keys))
        for n, (known, p, context, back) in zip(range(ORDER, 0, -1), self.orders, strict=True):
            k = keys & ((1 << BITS * n) - 1)
            i = np.minimum(np.searchsorted(known, k), len(known) - 1)
            out += weight * np.where(known[i] == k, p[i], 0)
            c = k >> BITS
            i = np.minimum(np.searchsorted(context, c), len(context) - 1)
            weight = weight * np.where(context[i] == c, back[i], 1)
        return out + weight / (1 << BITS)


class Model:
    """All languages, each with sorted arrays of its own."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.each = [KneserNey(*counts[x]) for x in self.langs]

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word in each language, and its number of predictions."""
        keys, size = grams(words)
        found, at = np.unique(keys, return_inverse=True)
        word = np.repeat(np.arange(len(words)), size)
        sums = [np.bincount(word, np.log(m.probability(found))[at], minlength=len(words)) for m in self.each]
        return np.stack(sums, 1) if sums else np.zeros((len(words), 0)), size

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per prediction in each language, and the number of predictions, of each text."""
        words, n = flat_words(texts)
        sums, size = self.word_sums(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        doc = np.repeat(np.arange(len(texts)), n)
        total = np.bincount(doc, size[at], minlength=len(texts))
        out = np.stack([np.bincount(doc, -sums[at, k], minlength=len(texts)) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return out / np.maximum(total, 1)[:, None], total


def _remainders(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs.select("doc_id", "text", "lang", crc.alias("crc"))


def counted(training: DataFrame) -> pa.Table:
    """(lang, gram, n, n_fold): four-grams over all rows of (text, lang, fold), n_fold those of fold 0."""

    def count(it):
        for b in slices(it, 4000):
            texts, langs, folds = (b.column(x).to_pylist() for x in ("text", "lang", "fold"))
            for lang in sorted(set(langs)):
                parts = []
                for zero in (True, False):
                    words, _ = flat_words([t for t, x, k in zip(texts, langs, folds, strict=True) if x == lang and (k == 0) == zero])
                    often = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                    keys, size = grams(words.dictionary.to_pylist())
                    parts.append((keys, np.repeat(often, size), np.full(len(keys), zero)))
                keys, n, zero = (np.concatenate(x) for x in zip(*parts, strict=True))
                found, at = np.unique(keys, return_inverse=True)
                both = [pa.array(np.bincount(at, x, minlength=len(found)).astype(np.int64)) for x in (n, n * zero)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), *both], names=["lang", "gram", "n", "n_fold"])

    rows = training.select("text", "lang", "fold").mapInArrow(task(count), "lang string, gram bigint, n bigint, n_fold bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_fold").alias("n_fold")).toArrow()  # 2**24 rows a language at most


def fit(counts: pa.Table) -> tuple[Model, Model]:
    """The model of all counts, and that of all but fold 0."""
    names = counts.column("lang").combine_chunks().dictionary_encode()
    lang, names = names.indices.to_numpy(), names.dictionary.to_pylist()
    gram, n, fold = (counts.column(x).to_numpy() for x in ("gram", "n", "n_fold"))
    models = []
    for total in (n, n - fold):
        own = {}
        for k, name in enumerate(names):
            at = np.flatnonzero((lang == k) & (total > 0))
            if len(at):
                at = at[np.argsort(gram[at])]
                own[name] = gram[at], total[at].astype(np.float64)
        models.append(Model(own))
    return models[0], models[1]


def scored(docs: DataFrame, model: Model, limits: dict[str, tuple[float, float, float]] | None = None, also: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``also`` of each row with lang_pred, score, entropy (null for und), number of predictions and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast((model, limits or {}))

    def run(it):
        m, most = shared.value
        langs = np.array([*m.langs, UNKNOWN], object)
        median, far, scaled = np.array([most.get(x, (0.0, np.inf, np.inf)) for x in m.langs] + [(0.0, np.inf, np.inf)]).T
        for b in slices(it, 1000):
            h, n = m.entropies(b.column("text").to_pylist())
            known = (n > 0) & (len(m.langs) > 0)
            best = np.where(known, h.argmin(1) if m.langs else 0, len(m.langs))
            low = h.min(1) if m.langs else np.zeros(len(h))
            score = np.where(known, 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(1) if m.langs else 0.0, 0.0)
            above = low - median[best]
            rejected = ~known | (above > far[best]) & (above * np.sqrt(n) > scaled[best])
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in also] + [pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64(), mask=~known), pa.array(n.astype(np.int64)), pa.array(rejected)],
                names=[*also, "lang_pred", "score", "entropy", "predictions", "rejected"],
            )

    own = "".join(f"`{x}` {docs.schema[x].dataType.simpleString()}, " for x in also)
    return docs.mapInArrow(task(run), f"{own}lang_pred string, score double, entropy double, predictions bigint, rejected boolean")


def train(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> tuple[Model, dict[str, tuple[float, float, float]]]:
    """Model and rejection limits from the documents with a language whose id's crc32 leaves another remainder."""
    own = _remainders(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("crc") % modulus != held_out))
    own = own.select("text", "lang", (F.floor(F.col("crc") / modulus) % FOLDS).alias("fold"))
    model, other = fit(counted(own))
    seen = staged(scored(own.where("fold = 0").select("text"), other, also=[]).where("entropy is not null").select("lang_pred", "entropy", F.sqrt("predictions").alias("root")), "entropies")
    above = F.col("entropy") - F.col("median")
    half = F.percentile_approx("entropy", 0.5, 10_000).alias("median")
    top = lambda x: SPREAD * F.percentile_approx(x, 0.999, 10_000)
    both = top(above).alias("far"), top(above * F.col("root")).alias("scaled")
    whole = seen.agg(F.count("*").alias("n"), half).first()
    if whole.n < POOLED:
        discard(seen)
        return model, {}
    pooled = seen.withColumn("median", F.lit(whole.median)).agg(*both).first()
    median = seen.groupBy("lang_pred").agg(half)
    limits = {}
    for r in seen.join(F.broadcast(median), "lang_pred").groupBy("lang_pred", "median").agg(F.count("*").alias("n"), *both).collect():  # a row for each language
        own = (r.median, r.far, r.scaled)
        limits[r.lang_pred] = own if r.n >= CALIBRATING else tuple(map(max, own, (whole.median, pooled.far, pooled.scaled)))
    discard(seen)
    return model, limits


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected: a row for each row of ``docs``."""
    model, limits = train(docs, modulus, held_out)
    base = _remainders(docs).select("doc_id", "text", F.coalesce(F.col("crc") % modulus == held_out, F.lit(False)).alias("held_out"))
    return scored(base, model, limits, ["doc_id", "held_out"])


@plain_names
def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model, limits = train(docs)
    names = docs.columns
    base = docs.select(F.struct(*(x for x in names if x != "text"), F.lit(0).alias("_")).alias("row"), "text")
    out = scored(base, model, limits, ["row", "text"]).where("not rejected")
    return out.select(*(F.col("text") if x == "text" else F.col("row")[x].alias(x) for x in names))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
