import random

from pyspark.sql import functions as F

from skeinlake.operators import graph, phrases

NODE = "id string, path string, title string, description string, body string, tags array<string>"


def _notes(spark):
    r = random.Random(4)
    word = lambda: r.choice("alpha beta gamma delta-x epsilon Zeta of the".split())
    text = lambda n: " ".join(word() for _ in range(r.randrange(1, n)))
    rows = [(f"n:{k}", f"w/{k}.md", text(4), text(6) if k % 3 else None, text(12), [word()]) for k in range(40)]
    rows += [("n:40", "w/40.md", None, "alpha beta", None, None), (None, "w/x.md", "alpha", "b", "c", []), ("alpha beta", "p", "t", "d", "b", []), ("n:1", "w/again.md", "of the beta", None, None, [])]
    return spark.createDataFrame(rows, NODE)


def test_a_table_of_topics_equals_topic_by_topic(spark):
    notes = _notes(spark)
    topics = ["n:3", "w/3.md", " alpha ", "ALPHA BETA", "beta gamma delta-x", "of the", "the alpha gamma", "alpha epsilon nothing", "a b c d", "nothing", "gamma zeta of the", "eta", "the"]
    got: dict = {}
    for r in graph.retrieve_many(notes, spark.createDataFrame([(t,) for t in topics + topics[:2] + [None]], "topic string")).collect():
        got.setdefault(r.topic, set()).add(tuple(r)[1:])
    want = {t: {(r.id, r.title, r.match, r.score if r.match == "words" else 0, r.ties, r.decisive) for r in graph.retrieve(notes, t).collect()} for t in topics}
    assert got == {t: x for t, x in want.items() if x}


def test_a_stored_index_reads_the_parts_it_needs(spark, tmp_path):
    notes = _notes(spark)
    hay = graph.haystack(notes)
    phrases.store(phrases.index(hay), f"{tmp_path}/index")
    index = phrases.stored(spark, f"{tmp_path}/index")
    topics = spark.createDataFrame([("beta gamma alpha",), ("of the beta gamma",), ("alpha beta",)], "topic string")
    plain, by_index = (sorted(map(str, graph.retrieve_many(notes, topics, x).collect())) for x in (None, index))
    assert plain == by_index
    assert {r.word for r in index.where("array_contains(positions, 0)").select("word").collect()} <= {w for r in hay.collect() for w in r.t.split(" ")}
    # other parts may be gone: only that of the sought word is read
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit("alpha")), F.lit(phrases.INDEX_PARTS))).first()[0]
    for folder in (tmp_path / "index").glob("part=*"):
        if folder.name != f"part={part}":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"not a table")
    assert phrases.candidates(spark.read.schema("word string, text bigint, positions array<int>, part int").parquet(f"{tmp_path}/index"), spark.createDataFrame([("x alpha y",)], "phrase string")).count() > 0
