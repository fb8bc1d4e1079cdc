import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, starts string, items int"


def docs(spark, texts, langs=None):
    """A documents table with two extra columns whose names clash with internal ones. texts: list of texts or (doc_id, text)."""
    rows = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        rows.append((i, t, (langs or {}).get(i, "en"), f"src{k % 3}", None if t is None else len(t), "x", 7))
    return spark.createDataFrame(rows, DOCS)


def noise(seed, n, words=("ab", "cd", "ef", "gh"), size=60):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randrange(size))) for _ in range(n)]
