"""The reviewed graph: edges, retrieval with ties, one hop, ancestors, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..session import checkpointed
from . import phrases


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.explode("related").alias("e")).select("src", "e.predicate", F.col("e.target").alias("dst"), "e.rationale")


#: Kinds of match from best to worst; the first three decide, the others only propose.
MATCHES = ("id", "path", "title", "prefix", "contains", "words")


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """id, match, score of nodes that match a short phrase or an id, path or title in some way."""
    q = F.lit(query.strip())
    low, title = F.lower(q), F.lower("title")
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    hay = F.split(F.lower(F.concat_ws(" ", "title", "description", F.array_join("tags", " "))), r"[^\p{L}\p{N}-]+")
    shared = F.size(F.array_intersect(words, hay))
    kind = F.when(F.col("id") == q, "id").when(F.col("path") == q, "path").when(title == low, "title").when(F.startswith(title, low), "prefix")
    kind = kind.when(F.contains(F.lower(F.concat_ws("\n", "title", "description", "body")), low), "contains").when(shared > 0, "words")
    found = nodes.select("*", kind.alias("match"), shared.alias("score")).where("match is not null and id is not null")
    place = F.array_position(F.array(*(F.lit(m) for m in MATCHES)), F.col("match"))
    return found.withColumn("place", place.cast("int"))


def retrieve(nodes: DataFrame, query: str) -> DataFrame:
    """The best matches, all of them if several tie; ``decisive`` for a lone match by id, path or title."""
    m = matches(nodes, query)
    score = F.when(F.col("match") == "words", F.col("score")).otherwise(0)
    best = m.agg(F.min(F.struct("place", (-score).alias("s"))).alias("b"))
    top = m.crossJoin(F.broadcast(best)).where((F.col("place") == F.col("b.place")) & (-score == F.col("b.s")))  # one row
    ties = F.count("*").over(Window.partitionBy("match"))
    return top.select("id", "title", "match", "score", ties.alias("ties")).withColumn("decisive", (F.col("ties") == 1) & F.col("match").isin(*MATCHES[:3]))


def retrieve_many(nodes: DataFrame, topics: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``retrieve`` for a table of topics (topic) in one plan: topic, id, title, match, score, ties, decisive.

    Exact matches are joins, phrases go through an index of the notes' words (``phrases.index`` of ``haystack``), and
    single words are looked at for topics only that nothing better matches; score counts them and is 0 for other matches. Topics that match nothing give no row.
    """
    q = checkpointed(topics.where("topic is not null").select("topic").distinct().select("topic", F.trim("topic").alias("q"), F.lower(F.trim("topic")).alias("phrase")))
    n = nodes.where("id is not null")
    place = lambda kind: F.lit(MATCHES.index(kind)).alias("place")
    exact = [n.join(q, F.col(c) == F.col(k)).select("topic", "id", "title", place(c)) for c, k in (("id", "q"), ("path", "q"))]
    exact.append(n.join(q, F.lower("title") == F.col("phrase")).select("topic", "id", "title", place("title")))
    held = phrases.containing(haystack(n), q.select("topic", "phrase"), index)
    within = held.select("topic", "id", "title", F.when(F.startswith(F.lower("title"), "phrase"), MATCHES.index("prefix")).otherwise(MATCHES.index("contains")).alias("place"))
    better = checkpointed(reduce(DataFrame.unionByName, [*exact, within]).withColumn("score", F.lit(0)))
    left = checkpointed(q.join(better.select("topic").distinct(), "topic", "left_anti").select("topic", F.explode(F.array_distinct(F.split("phrase", r"\s+"))).alias("word")).where("word <> ''"))
    hay = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "title", "description", F.array_join("tags", " "))), r"[^\p{L}\p{N}-]+"))
    words = n.select("id", "title", "path", F.explode(hay).alias("word")).join(phrases.small(left), "word").groupBy("topic", "id", "title", "path").agg(F.count("*").cast("int").alias("score")).select("topic", "id", "title", place("words"), "score")
    best = F.rank().over(Window.partitionBy("topic").orderBy("place", F.desc("score")))
    # a note that matches in several ways counts once, in its best way
    own = better.groupBy("topic", "id", "title").agg(F.min("place").alias("place"), F.lit(0).alias("score")).unionByName(words)
    top = own.withColumn("best", best).where("best = 1")
    match = F.element_at(F.array(*(F.lit(m) for m in MATCHES)), F.col("place") + 1)
    out = top.select("topic", "id", "title", match.alias("match"), "score", F.count("*").over(Window.partitionBy("topic")).alias("ties"))
    return out.withColumn("decisive", (F.col("ties") == 1) & F.col("match").isin(*MATCHES[:3]))


def haystack(nodes: DataFrame) -> DataFrame:
    """t, id, title: what phrases are looked for in."""
    return nodes.select(F.lower(F.concat_ws("\n", "title", "description", "body")).alias("t"), "id", "title")


#: Rows of a part, about, where the number of parts has to grow with the rows, so that a task's memory does not.
PART_ROWS = 500_000


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def profile(edge_table: DataFrame, rows: int) -> DataFrame:
    """predicate, edges, sources, targets (distinct ones): of about ``rows`` edges at most.

    Sources and targets are counted apart, each dealt by its own name into parts by the number of edges; one pass that
    counts both would hold every edge twice in a task's map, in as many tasks as a session happens to have.
    """
    def ends(name: str) -> DataFrame:
        dealt = edge_table.select("predicate", name).repartition(parts_for(rows), "predicate", name)
        return dealt.groupBy("predicate", name).agg(F.count("*").alias("n")).groupBy("predicate").agg(F.sum("n").alias("edges"), F.count(name).alias("names"))

    src, dst = ends("src").select("predicate", "edges", F.col("names").alias("sources")), ends("dst").select("predicate", F.col("names").alias("targets"))
    return src.join(dst, "predicate")


#: Ids that are broadcast to the edges at most; more are joined by a shuffle.
FEW_IDS = 100_000


def one_hop(edge_table: DataFrame, ids: DataFrame) -> DataFrame:
    """id, direction, predicate, neighbour, rationale of all edges at the given ids.

    Semi joins of few ids sink below the unions and distincts that edges are made of, to the scans.
    """
    ids = ids.select("id").distinct()
    few = F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids
    out = edge_table.join(few.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.lit("out").alias("direction"), "predicate", F.col("dst").alias("neighbour"), "rationale")
    into = edge_table.join(few.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "predicate", F.col("src").alias("neighbour"), "rationale")
    return out.unionByName(into)


def ancestors(nodes: DataFrame, most: int = 100_000) -> DataFrame:
    """id, ancestor, level along ``parent``, each ancestor at its least level; cycles end where they would repeat a node.

    By doubling: what is known up to level 2^k is joined to itself at those exactly 2^k up, so a chain takes a
    round for each doubling of its length; every round is checkpointed. A chain of more than ``most`` levels is an error.
    """
    parents = nodes.where("parent is not null and id <> parent").select("id", F.col("parent").alias("ancestor")).distinct()
    known, reach = checkpointed(parents.withColumn("level", F.lit(1))), 1
    while True:
        top = known.where(F.col("level") == reach).select("id", F.col("ancestor").alias("middle"))
        rest = known.select(F.col("id").alias("middle"), "ancestor", (F.col("level") + reach).alias("level"))
        further = top.join(rest, "middle").where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("level").alias("level"))
        new = checkpointed(further.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        longest = new.agg(F.max("level")).first()[0]
        if longest is None:
            return known
        if longest > most:
            raise ValueError(f"a chain of parents is longer than {most} levels")
        known, reach = known.unionByName(new), 2 * reach


def trace(nodes: DataFrame, assets: DataFrame, archives: DataFrame, node_id: str | None = None) -> DataFrame:
    """id, asset, archive, state: note -> record (assets: path, archive_path) -> raw file (archives: path)."""
    own = nodes if node_id is None else nodes.where(F.col("id") == node_id)
    links = own.select("id", F.explode_outer("source_links").alias("asset"))
    t2 = assets.select(F.col("path").alias("asset"), F.col("archive_path").alias("archive"), F.lit(True).alias("has2"))
    t3 = archives.select(F.col("path").alias("archive")).distinct().withColumn("has3", F.lit(True))
    out = links.join(t2, "asset", "left").join(t3, "archive", "left")
    state = F.when(F.col("asset").isNull(), "no source").when(F.col("has2").isNull(), "no record").when(F.col("archive").isNull() | F.col("has3").isNull(), "no archive").otherwise("whole")
    return out.select("id", "asset", "archive", state.alias("state"))


def deep(nodes: DataFrame, assets: DataFrame, archives: DataFrame, query: str) -> DataFrame:
    """One-hop context and evidence of what ``retrieve`` finds: id, kind, relation, other."""
    hit = retrieve(nodes, query).select("id")
    near = one_hop(edges(nodes), hit).select("id", F.lit("edge").alias("kind"), F.concat_ws(" ", "direction", "predicate").alias("relation"), F.col("neighbour").alias("other"))
    proof = trace(nodes.join(hit, "id", "left_semi"), assets, archives).select("id", F.lit("evidence").alias("kind"), F.col("state").alias("relation"), F.col("asset").alias("other"))
    return near.unionByName(proof)


def mintable(proposals: DataFrame, charters: DataFrame, approvals: DataFrame) -> DataFrame:
    """Proposed notes of chartered domains that were approved (approvals: id)."""
    open_ = charters.where(core.is_placeholder(F.col("body"))).select("domain")
    return proposals.join(open_, "domain", "left_anti").join(approvals.select("id"), "id", "left_semi")


def _sound(proposals: DataFrame) -> DataFrame:
    return proposals.where(core.known_predicate(F.col("predicate")) & (F.trim(F.coalesce("rationale", F.lit(""))) != ""))


def proposed(nodes: DataFrame, proposals: DataFrame) -> DataFrame:
    """src, predicate, dst, rationale, outcome: edges that may be put to approval, and 'none warranted' for every note without one."""
    fine = _sound(proposals).select("src", "predicate", "dst", "rationale")
    out = nodes.select(F.col("id").alias("src")).distinct().join(fine, "src", "left")
    return out.withColumn("outcome", F.when(F.col("predicate").isNull(), "none warranted").otherwise("proposed"))


def woven(proposals: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approved edges with a rationale and a known predicate (proposals: EDGES)."""
    return _sound(proposals).join(approvals.select("src", "predicate", "dst"), ["src", "predicate", "dst"], "left_semi")
