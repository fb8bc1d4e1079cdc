"""All queries of the engine's own operators with their SQL twins, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import core
from ..model import analogs, schemas
from ..operators import audit, graph, ingest, instance, links, phrases, sensors, sync, units
from ..session import checkpointed, passing_checkpoints, shared_folder, table
from ..sources import file_sink, files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("SELECT lang AS detected_type, count(*) AS captures, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def ingest_plan_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan_by_type(analogs.captures(spark, sf_dir))


@query("SELECT doc_id AS capture, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def content_hash_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.captures(spark, sf_dir).select("capture", "bytes", "sha256")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_capture FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.captures(spark, sf_dir).groupBy("sha256").agg(F.count("*").alias("copies"), F.min("capture").alias("first_capture")).where("copies > 1")


@query("SELECT source AS batch, count(*) AS captures FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING bool_and(coalesce(toxic, 0) <> 1)")
def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analogs.captures(spark, sf_dir).join(analogs.reviews(spark, sf_dir), "capture", "left")
    return ingest.complete_batches(c, ~F.coalesce("failed", F.lit(False)))


@query("SELECT doc_id AS capture FROM documents WHERE source IN (SELECT source FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source HAVING NOT bool_and(coalesce(toxic, 0) <> 1))")
def restored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analogs.captures(spark, sf_dir).join(analogs.reviews(spark, sf_dir), "capture", "left")
    return ingest.restored(c, ~F.coalesce("failed", F.lit(False))).select("capture")


@query("SELECT doc_id AS capture, source AS batch, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, '')) AS record_sha256, 1 AS version FROM documents")
def ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as captures of instance folders, ingested batch by batch and read back from archive and records. doc_id is unique.

    Batches that together take about ``TURN`` on disk share a folder, which is removed when its rows are written.
    """
    d = table(spark, sf_dir, "documents").select("source", F.concat_ws("/", F.lit("corpus/inbox"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit("").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    at = f"{shared_folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    routes = spark.createDataFrame([("txt", None, "reader", 1)], schemas.ROUTES)
    try:
        for k, own in enumerate(_turns(d)):
            root = f"{at}/instance-{k}"
            with passing_checkpoints(spark):
                file_sink.write_files(d.where(own), root, whole=True)
                instance.run_ingest(spark, root, routes, "linux")
                manifest = instance.archive_manifest(spark, root)
                records = files.contents(root, files.listed(spark, root).where(F.col("path").rlike(r"^corpus/assets/record-[^/]*\.md$"))).select(F.col("content").cast("string").alias("value"))
                said = records.select(F.regexp_extract("value", '(?m)^archive_path: "([^"]*)"', 1).alias("path"), core.content_hash(F.substr(core.body(F.col("value")), F.lit(2))).alias("record_sha256"))
                place = lambda k: F.regexp_extract("path", r"^corpus/inbox/archive/([^/]+)/(.*)\.txt$", k)
                manifest.join(said, "path").select(place(2).cast("bigint").alias("capture"), place(1).alias("batch"), "bytes", "sha256", "record_sha256", "version").write.mode("append").parquet(f"{at}/rows")
            file_sink.remove(root)
        return checkpointed(spark.read.schema("capture bigint, batch string, bytes bigint, sha256 string, record_sha256 string, version int").parquet(f"{at}/rows"))
    finally:
        file_sink.remove(at)


#: Disk that the files of a turn may take, about; a larger batch has a turn of its own. A run has 32 turns at most, and batches are dealt by as many hashes.
TURN, TURNS, DEALT = 1 << 30, 32, 1000


def _turns(files: DataFrame) -> list[Column]:
    """Conditions on ``files`` (source, content) that share its batches out to turns, each batch to one, by the disk of raw files and records."""
    part = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(DEALT))
    size = F.ceil((F.octet_length("content") + 1) / 4096).cast("bigint") * (2 * 4096)
    sizes = sorted(files.groupBy(part.alias("part")).agg(F.sum(size).alias("size")).collect())  # DEALT rows at most
    most = max(TURN, sum(r.size for r in sizes) * 2 // TURNS)
    turns, left = [[]], most
    for r in sizes:
        if turns[-1] and r.size > left:
            turns.append([])
            left = most
        turns[-1].append(r.part)
        left -= r.size
    return [part.isin(x) for x in turns]


@query("SELECT source AS batch, count(*) AS pending FROM documents d ANTI JOIN labels l USING (doc_id) GROUP BY source")
def pending_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pending(analogs.captures(spark, sf_dir), analogs.reviews(spark, sf_dir)).groupBy("batch").agg(F.count("*").alias("pending"))


@query("SELECT source AS batch, array_to_string(list_sort(list(DISTINCT lang)), ',') AS types FROM documents GROUP BY source")
def batch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.captures(spark, sf_dir).groupBy("batch").agg(F.array_join(F.sort_array(F.collect_set("detected_type")), ",").alias("types"))


@query("SELECT source AS batch, lang AS detected_type, CAST(grouping(source, lang) AS BIGINT) AS level, count(*) AS captures, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source, lang)")
def plan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.captures(spark, sf_dir).rollup("batch", "detected_type").agg(F.grouping_id("batch", "detected_type").cast("bigint").alias("level"), F.count("*").alias("captures"), F.sum("bytes").alias("bytes"))


@query("SELECT source AS batch, bool_and(quality = 1) AS approved FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def batch_all_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.captures(spark, sf_dir).join(analogs.reviews(spark, sf_dir), "capture", "left").groupBy("batch").agg(F.bool_and("approved").alias("approved"))


@query("""
WITH q AS (SELECT item_id, lower(text) AS phrase FROM benchmark),
m AS (SELECT item_id, doc_id, CASE WHEN starts_with(lower(text), phrase) THEN 0 WHEN contains(lower(text), phrase) THEN 1 END AS place FROM q, documents),
r AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY place) AS k, count(*) OVER (PARTITION BY item_id, place) AS ties FROM m WHERE place IS NOT NULL)
SELECT item_id, doc_id, CAST(place AS INT) AS place, ties, ties = 1 AS lone FROM r WHERE k = 1
""")
def retrieve_ties_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("phrase"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    m = phrases.containing(d, b).select("item_id", "doc_id", F.when(F.col("first"), 0).otherwise(1).alias("place"))
    by = Window.partitionBy("item_id")
    r = m.withColumn("k", F.rank().over(by.orderBy("place"))).withColumn("ties", F.count("*").over(Window.partitionBy("item_id", "place")))
    return r.where("k = 1").select("item_id", "doc_id", "place", "ties", (F.col("ties") == 1).alias("lone"))


@query("SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def topic_containment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return phrases.containing(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")), b).select("item_id", "doc_id")


_PARENTS = """p AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || c_nationkey AS parent FROM customer
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


@query(f"WITH RECURSIVE {_PARENTS}, up(id, ancestor, level) AS (SELECT id, parent, 1 FROM p UNION ALL SELECT up.id, p.parent, level + 1 FROM up JOIN p ON p.id = up.ancestor) SELECT id, ancestor, level FROM up")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(analogs.parents(spark, sf_dir))


@query("""
WITH v AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS s, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS t
FROM orders JOIN customer ON c_custkey = o_custkey) SELECT s AS src_level, t AS dst_level, count(*) AS violations FROM v WHERE s < t GROUP BY 1, 2
""")
def exposure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.expr("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END").alias("src_level"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END").alias("dst_level"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).where("src_level < dst_level").groupBy("src_level", "dst_level").agg(F.count("*").alias("violations"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def notes_without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("""
SELECT 'order' AS kind, count(*) AS dangling FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'part', count(*) FROM lineitem ANTI JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'supplier', count(*) FROM lineitem ANTI JOIN supplier ON s_suppkey = l_suppkey
""")
def dangling_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    out = None
    for kind, name, key, own in (("order", "orders", "o_orderkey", "l_orderkey"), ("part", "part", "p_partkey", "l_partkey"), ("supplier", "supplier", "s_suppkey", "l_suppkey")):
        n = l.join(table(spark, sf_dir, name), F.col(key) == F.col(own), "left_anti").agg(F.count("*").alias("dangling")).select(F.lit(kind).alias("kind"), "dangling")
        out = n if out is None else out.union(n)
    return out


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'keep' WHEN a.doc_id IS NULL THEN 'add' ELSE 'replace' END AS action
FROM documents a FULL JOIN (SELECT DISTINCT doc_id FROM labels ANTI JOIN pages ON page_id = doc_id) b ON a.doc_id = b.doc_id
""")
def overlay_merge_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("path"))
    return sync.overlay(path("documents", "doc_id"), path("labels", "doc_id"), path("pages", "page_id"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sensors.page_title("html").alias("title"), core.byte_length(F.col("html")).alias("bytes"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"))


@query("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'answered' ELSE 'pending' END AS state FROM (SELECT DISTINCT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) = 1) GROUP BY conv_id")
def dialogue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    last = F.max_by("role", "turn")
    return one.groupBy("conv_id").agg(F.count("*").alias("turns"), last.alias("last_role"), F.when(last == "assistant", "answered").otherwise("pending").alias("state"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT lang AS domain, upper(lang[1]) || lower(lang[2:]) AS vault_name FROM documents")
def vault_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("domain")).distinct().select("domain", core.vault_name(F.col("domain")).alias("vault_name"))


_EDGES = """e AS (SELECT 'order:' || o_orderkey AS src, 'DERIVES_FROM' AS predicate, 'customer:' || o_custkey AS dst FROM orders
UNION ALL SELECT 'region:' || n_regionkey, 'GOVERNS', 'nation:' || n_nationkey FROM nation
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'IMPLEMENTS', 'supplier:' || l_suppkey FROM lineitem
UNION ALL SELECT DISTINCT 'line:' || l_orderkey || '-' || l_linenumber, 'EVIDENCES', 'order:' || l_orderkey FROM lineitem
UNION ALL SELECT 'part:' || p_partkey, 'TRANSMUTES', 'type:' || p_type FROM part)"""


@query(f"""WITH {_EDGES}
SELECT src AS id, 'out' AS direction, predicate, dst AS neighbour FROM e WHERE src IN ('part:0', 'order:5')
UNION ALL SELECT dst, 'in', predicate, src FROM e WHERE dst IN ('part:0', 'order:5')""")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = analogs.edges(spark, sf_dir).withColumn("rationale", F.lit(None).cast("string"))
    return graph.one_hop(e, spark.createDataFrame([("part:0",), ("order:5",)], "id string")).drop("rationale")


@query("""
SELECT o_orderkey, l_linenumber, p_name, s_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
""")
def evidence_trace_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l, p, s = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part", "supplier"))  # noqa: E741
    own = o.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return own.join(p, F.col("p_partkey") == F.col("l_partkey"), "left").join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("o_orderkey", "l_linenumber", "p_name", "s_name")


@query(f"WITH {_EDGES} SELECT predicate, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY predicate")
def edge_predicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, others = table(spark, sf_dir, "lineitem").count(), sum(table(spark, sf_dir, x).count() for x in ("orders", "part", "nation"))
    e = analogs.edges(spark, sf_dir, graph.parts_for(lines)).where(core.known_predicate(F.col("predicate")))
    return graph.profile(e, 2 * lines + others)


@query("SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS place FROM documents")
def doc_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source").orderBy(F.desc("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.dense_rank().over(by).cast("bigint").alias("place"))


@query("SELECT source AS batch, 'frontier-batch-intake-' || substr(sha256(string_agg(sha256(text), '' ORDER BY sha256(text))), 1, 12) AS name FROM documents GROUP BY source")
def handoff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.handoffs(analogs.captures(spark, sf_dir)).select("batch", "name")


@query("""
WITH h AS (SELECT source AS batch, sha256(text) AS x FROM documents),
a AS (SELECT batch, substr(x, 1, 4) AS p, sha256(string_agg(x, '' ORDER BY x)) AS d FROM h GROUP BY batch, substr(x, 1, 4)),
b AS (SELECT batch, substr(p, 1, 2) AS q, sha256(string_agg(d, '' ORDER BY p)) AS d FROM a GROUP BY batch, substr(p, 1, 2))
SELECT batch, sha256(string_agg(d, '' ORDER BY q)) AS digest FROM b GROUP BY batch
""")
def batch_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.digests(analogs.captures(spark, sf_dir), ["batch"])


@query("""
WITH n AS (SELECT lower(replace(n_name, ' ', '-')) AS name, n_nationkey AS k FROM nation),
v AS (SELECT name, k, array_to_string(list_transform(string_split(name, '-'), lambda x: upper(x[1]) || x[2:]), ' ') AS vault FROM n),
c AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN v.vault WHEN 1 THEN v.name ELSE 'nowhere' END AS named, c_custkey % 4 AS kind, v.name AS target, v.vault FROM customer JOIN v ON k = (c_nationkey + 1) % 25)
SELECT c_custkey, CASE WHEN kind < 3 THEN vault END AS vault, CASE kind WHEN 3 THEN false ELSE true END AS found,
    'see [it](obsidian://open?vault=' || CASE WHEN kind < 3 THEN replace(vault, ' ', '%20') ELSE replace((SELECT vault FROM v WHERE k = c_nationkey), ' ', '%20') END || '&file=' || CASE kind WHEN 3 THEN 'no-such' ELSE target || '/index' END || ') end' AS text
FROM c
""")
def linked_vaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as domains with an index note, customers as notes that link to the next nation's: by vault, by domain, by file alone, or to nothing."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    domains = n.select(name.alias("name"), F.lit("public").alias("exposure"), F.lit(None).cast("string").alias("vault_name"))
    own, target = n.select(F.col("n_nationkey").alias("c_nationkey"), name.alias("domain")), n.select(((F.col("n_nationkey") + 24) % 25).alias("c_nationkey"), name.alias("target"))
    kind = F.col("c_custkey") % 4
    vault = F.when(kind == 0, F.replace(core.vault_name(F.col("target")), F.lit(" "), F.lit("%20"))).when(kind == 1, F.col("target")).otherwise("nowhere")
    file = F.when(kind == 3, "no-such").otherwise(F.concat("target", F.lit("/index")))
    notes = c.join(own, "c_nationkey").join(target, "c_nationkey").select("domain", F.concat("domain", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("see [it](obsidian://open?vault="), vault, F.lit("&file="), file, F.lit(") end")).alias("text"))
    index = domains.select(F.col("name").alias("domain"), F.concat("name", F.lit("/index.md")).alias("path"), F.lit("index").alias("text"))
    whole = notes.unionByName(index)
    to = links.resolved(links.extracted(whole), whole, domains)
    pages = sync.compiled(whole, domains).select(F.split_part("path", F.lit("."), F.lit(1)).try_cast("bigint").alias("c_custkey"), "text")
    said = to.select(F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("bigint").alias("c_custkey"), F.col("to").alias("vault"), "found")
    return said.join(pages, "c_custkey").select("c_custkey", "vault", "found", "text")


@query("SELECT doc_id AS capture, CASE lang WHEN 'en' THEN 'reader-a' WHEN 'de' THEN 'reader-b' END AS tool FROM documents")
def sensor_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("en", "linux", "reader-a", 1), ("en", None, "reader-c", 2), ("de", None, "reader-b", 1), ("fr", "macos", "reader-d", 1)], "detected_type string, platform string, tool string, priority int")
    return ingest.routed(analogs.captures(spark, sf_dir), routes, "linux").select("capture", "tool")


@query("SELECT doc_id AS capture FROM documents WHERE lang NOT IN ('en', 'de')")
def unrecognised_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("en",), ("de",)], "detected_type string")
    return ingest.unrecognised(analogs.captures(spark, sf_dir), routes).select("capture")


@query("SELECT source AS batch, array_to_string(list_sort(list(sha256(text))), '') AS hashes, count(*) AS captures, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def batch_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analogs.captures(spark, sf_dir).withColumn("domain", F.lit("corpus"))
    return ingest.envelopes(c).select("batch", F.array_join("source_hashes", "").alias("hashes"), "captures", "bytes")


@query("SELECT doc_id AS capture, substr(text, 1, 64) AS sample FROM documents")
def structural_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture"), core.sample_of(F.col("text"), 64).alias("sample"))


@query("SELECT 'captures' AS kind, count(*) AS items FROM documents UNION ALL SELECT 'reviewed', count(*) FROM labels UNION ALL SELECT 'dialogues', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, kind, what=None: table(spark, sf_dir, name).agg((F.count_distinct(what) if what else F.count("*")).alias("items")).select(F.lit(kind).alias("kind"), "items")
    return one("documents", "captures").union(one("labels", "reviewed")).union(one("conversations", "dialogues", "conv_id")).union(one("pages", "pages"))


@query("SELECT doc_id AS subject, 'many-blank-lines' AS rule FROM documents WHERE contains(text, chr(10) || chr(10) || chr(10) || chr(10)) UNION ALL SELECT doc_id, 'no-final-newline' FROM documents WHERE text <> '' AND right(text, 1) <> chr(10) UNION ALL SELECT doc_id, 'tab' FROM documents WHERE contains(text, chr(9)) UNION ALL SELECT doc_id, 'trailing-space' FROM documents WHERE regexp_matches(text, '(?m)[ \\t]+$')")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.lint(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")).select("subject", "rule")


# ---------------------------------------------------------------- retrieval by the operator itself

_NOTES = """p AS (SELECT 'part:' || p_partkey AS id, p_name AS title, p_type AS description, p_brand AS body, 'parts/' || p_partkey || '.md' AS path, ['public', 'restricted', 'private', 'secret'][p_size % 4 + 1] AS exposure,
CASE WHEN p_size % 7 = 0 THEN 'LIKES' ELSE 'IMPLEMENTS' END AS predicate, 'part:' || min(p_partkey) OVER (PARTITION BY p_type) AS target, p_size FROM part)"""


def _retrieved(phrase: str, where: str, match: str) -> None:
    """A query for one kind of match; all notes take part. ``where`` is its condition in SQL."""
    sql = f"WITH {_NOTES} SELECT id, '{match}' AS match, count(*) OVER () AS ties, count(*) OVER () = 1 AND '{match}' IN ('id', 'path', 'title') AS decisive FROM p WHERE {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.retrieve(analogs.notes(spark, sf_dir), phrase).select("id", "match", "ties", "decisive")

    run.__name__ = f"retrieve_by_{match}"
    query(sql)(run)


_retrieved("part:7", "id = 'part:7'", "id")
_retrieved("parts/7.md", "path = 'parts/7.md'", "path")
_retrieved("Brand#1", "contains(lower(concat_ws(chr(10), title, description, body)), 'brand#1') AND NOT starts_with(lower(title), 'brand#1')", "contains")


@query(f"""
WITH {_NOTES}, t AS (SELECT DISTINCT type AS topic FROM (SELECT p_type AS type FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT 'part:' || p_partkey FROM part UNION ALL SELECT upper(p_name) FROM part)),
m AS (SELECT topic, id, CASE WHEN id = topic THEN 0 WHEN lower(title) = lower(topic) THEN 2 WHEN starts_with(lower(title), lower(topic)) THEN 3 WHEN contains(lower(concat_ws(chr(10), title, description, body)), lower(topic)) THEN 4 END AS place FROM t, p),
r AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY place) AS k FROM m WHERE place IS NOT NULL),
b AS (SELECT topic, id, place, count(*) OVER (PARTITION BY topic) AS ties FROM r WHERE k = 1)
SELECT topic, id, ['id', 'path', 'title', 'prefix', 'contains'][place + 1] AS match, ties, ties = 1 AND place < 3 AS decisive FROM b""")
def retrieve_many_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types, brands, ids and names of parts as topics, in one plan."""
    p = table(spark, sf_dir, "part")
    topics = p.select(F.col("p_type").alias("topic")).union(p.select("p_brand")).union(p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))).union(p.select(F.upper("p_name")))
    return graph.retrieve_many(analogs.notes(spark, sf_dir), topics).select("topic", "id", "match", "ties", "decisive")


@query(f"WITH {_NOTES} SELECT id, 'out' AS relation, target AS other FROM p WHERE id = 'part:7' UNION ALL SELECT target, 'in', id FROM p WHERE target = 'part:7'")
def deep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = analogs.notes(spark, sf_dir)
    hit = graph.retrieve(n, "part:7").select("id")
    return graph.one_hop(graph.edges(n), hit).select("id", F.col("direction").alias("relation"), F.col("neighbour").alias("other"))


_EVIDENCE = """n AS (SELECT 'order:' || o_orderkey AS id, l.l_linenumber, CAST(o_orderkey AS VARCHAR) || '-' || l.l_linenumber AS asset, l.part, p_size
FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) l ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l.part),
t AS (SELECT id, asset, CASE WHEN l_linenumber IS NULL THEN 'no source' WHEN p_size % 2 = 1 THEN 'whole' ELSE 'no archive' END AS state FROM n)"""


@query(f"WITH {_EVIDENCE} SELECT id, asset, state FROM t")
def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(*analogs.evidence(spark, sf_dir)).select("id", "asset", "state")


@query("""
WITH c AS (SELECT conv_id, 'conversation:' || conv_id AS id, turn, role, text, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE doc_id % 2 = 0 AND doc_id = conv_id) THEN 'whole' ELSE 'no archive' END AS state FROM conversations)
SELECT DISTINCT id, 'record' AS kind, 'conv-' || conv_id AS place, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS role, state FROM c
UNION ALL SELECT id, 'turn', 'conv-' || conv_id, turn, role, state FROM c
UNION ALL SELECT DISTINCT id, 'raw', 'raw-' || conv_id, NULL, NULL, state FROM c
""")
def trace_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as records whose turns are units; documents of an even id are their raw files."""
    c = table(spark, sf_dir, "conversations")
    one = c.select("conv_id").distinct()
    name = lambda kind: F.concat(F.lit(kind), F.col("conv_id").cast("string"))
    nodes = one.select(name("conversation:").alias("id"), F.array(name("conv-")).alias("source_links"))
    assets = one.select(name("conv-").alias("path"), name("raw-").alias("archive_path"))
    raw = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("raw-"), F.col("doc_id").cast("string")).alias("path"))
    turns = c.select(name("conv-").alias("path"), F.lit("turns").alias("detected_type"), F.encode(F.to_json(F.struct("turn", "role", "text")), "UTF-8").alias("content"))
    out = units.companions(graph.trace(nodes, assets, raw), units.units(turns))
    return out.select("id", "kind", "place", F.variant_get("locator", "$.turn", "bigint").alias("turn"), F.variant_get("locator", "$.role", "string").alias("role"), "state")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
p AS (SELECT doc_id, k, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS BIGINT) AS a FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit, a AS start, a + length(line) AS stop, sha256(line) AS sha256 FROM p WHERE regexp_matches(line, '[^ \\t\\r\\x0b\\x0c]')
""")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents, by the table function."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit("txt").alias("detected_type"), F.encode("text", "UTF-8").alias("content"))
    place = lambda name: F.variant_get("locator", f"$.{name}", "bigint")
    return units.units(d).select(F.col("path").alias("doc_id"), "unit", place("start").alias("start"), place("end").alias("stop"), core.content_hash(F.col("text")).alias("sha256"))


@query(f"WITH {_EVIDENCE} SELECT id AS subject, state || ': ' || asset AS detail FROM t WHERE state = 'no archive'")
def audit_broken_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.broken_lineage(*analogs.evidence(spark, sf_dir)).select("subject", "detail")


# ---------------------------------------------------------------- the audit's rules, each by its own function


def _rule(name: str, sql: str, found: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).select("rule", "subject", "detail")

    run.__name__ = f"audit_{name}"
    query(sql)(run)


_ON_NOTES = lambda f: lambda spark, at: f(analogs.notes(spark, at))
_ON_EDGES = lambda f: lambda spark, at: f(graph.edges(n := analogs.notes(spark, at)), n)
_LEVEL = "CASE exposure WHEN 'public' THEN 0 WHEN 'restricted' THEN 1 WHEN 'private' THEN 2 END"
_rule("predicate", f"WITH {_NOTES} SELECT 'unknown-predicate' AS rule, id AS subject, predicate AS detail FROM p WHERE predicate = 'LIKES'", _ON_EDGES(lambda e, n: audit.unknown_predicate(e)))
_rule("exposure", f"WITH {_NOTES} SELECT 'unknown-exposure' AS rule, id AS subject, exposure AS detail FROM p WHERE exposure = 'secret'", _ON_NOTES(audit.unknown_exposure))
_rule("dangling", f"WITH {_NOTES} SELECT 'dangling-edge' AS rule, p.id AS subject, p.target AS detail FROM p ANTI JOIN p q ON q.id = p.target AND q.exposure <> 'secret'", _ON_EDGES(lambda e, n: audit.dangling_edge(e, n.where("exposure <> 'secret'"))))
_rule("boundary", f"WITH {_NOTES}, v AS (SELECT id, predicate, target, {_LEVEL} AS level FROM p) SELECT 'exposure-boundary' AS rule, a.id AS subject, a.predicate || ' ' || a.target AS detail FROM v a JOIN v b ON b.id = a.target WHERE a.level < b.level", _ON_EDGES(audit.exposure_boundary))
_rule("malformed", f"WITH {_NOTES} SELECT 'malformed-note' AS rule, path AS subject, '' AS detail FROM p WHERE p_size = 50", _ON_NOTES(audit.malformed))
_rule("identifiers", "SELECT 'id-repeated' AS rule, 'doc:' || quality AS subject, CAST(count(*) AS VARCHAR) AS detail FROM labels GROUP BY quality HAVING count(*) > 1", lambda spark, at: audit.identifiers(table(spark, at, "labels").select(F.concat(F.lit("doc:"), F.col("quality").cast("string")).alias("id"), F.lit("").alias("path"))))

_FRONTIER = """f AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS a, doc_id AS k, quality, toxic, CASE WHEN doc_id % 3 <> 0 THEN sha256(CAST(doc_id AS VARCHAR)) END AS sha, CASE WHEN doc_id % 3 <> 1 THEN 'inv-' || (doc_id % 5) END AS inv FROM labels),
i AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS intake, 'inv-' || (doc_id % 4) AS path FROM documents WHERE lang <> 'fr'),
v AS (SELECT 'inv-' || (doc_id % 4) AS path, sha256(CAST(doc_id AS VARCHAR)) AS sha FROM documents WHERE lang = 'en')"""
_OF = lambda f, n: lambda spark, at: f(*analogs.frontier(spark, at)[:n])
_rule("intake", f"WITH {_FRONTIER} SELECT 'unresolved-intake' AS rule, a AS subject, a AS detail FROM f ANTI JOIN i ON intake = a", _OF(audit.unresolved_intake, 2))
_rule("inventory", f"WITH {_FRONTIER} SELECT 'inventory-mismatch' AS rule, a AS subject, inv AS detail FROM f JOIN i ON intake = a WHERE inv IS NOT NULL AND inv <> path", _OF(audit.inventory_mismatch, 2))
_rule("source_hash", f"WITH {_FRONTIER} SELECT 'hash-not-in-inventory' AS rule, a AS subject, f.sha AS detail FROM f JOIN i ON intake = a ANTI JOIN v ON v.path = i.path AND v.sha = f.sha WHERE f.sha IS NOT NULL", _OF(audit.hash_not_in_inventory, 3))
_rule("contract", f"WITH {_FRONTIER} SELECT 'incomplete-contract' AS rule, a AS subject, 'provenance' AS detail FROM f WHERE toxic = 1 UNION ALL SELECT 'incomplete-contract', a, 'frontier_request' FROM f WHERE quality IS DISTINCT FROM 1", _OF(audit.incomplete_contract, 1))
_rule("pointer", f"WITH {_FRONTIER} SELECT CASE WHEN sha IS NULL THEN 'no-source-pointer' ELSE 'two-source-pointers' END AS rule, a AS subject, '' AS detail FROM f WHERE (sha IS NULL) = (inv IS NULL)", _OF(audit.source_pointer, 1))
_rule("frontier_edges", f"WITH {_FRONTIER} SELECT 'edges-on-frontier' AS rule, a AS subject, '1' AS detail FROM f WHERE toxic = 1", _OF(audit.frontier_edges, 1))


@query("SELECT 'pending captures' AS measure, count(*) AS value FROM documents UNION ALL SELECT 'pending batches', count(DISTINCT source) FROM documents UNION ALL SELECT 'pending debriefs', count(*) FROM conversations WHERE role = 'user' UNION ALL SELECT 'notes', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM part")
def status_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "pending").otherwise("archived").alias("state"))
    n = analogs.notes(spark, sf_dir)
    return sync.status(analogs.captures(spark, sf_dir), records, n, graph.edges(n))


# ---------------------------------------------------------------- charters, debriefs, groups, tools, formatting

_CHARTERS = """o AS (SELECT 'c' || o_custkey AS domain, o_custkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'c' || o_custkey END || ':family-' || o_orderpriority || o_orderstatus AS family, o_orderpriority AS p FROM orders),
c AS (SELECT domain, k, count(DISTINCT family) AS n, count(DISTINCT p) AS m FROM o GROUP BY domain, k)"""


def _charters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as domains, the kinds of their orders as families; every seventh charter is a placeholder."""
    domain = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    family = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(domain), F.lit(":family-"), "o_orderpriority", "o_orderstatus")
    by = table(spark, sf_dir, "orders").groupBy(domain.alias("domain"), "o_custkey").agg(F.collect_set(family).alias("families"), F.collect_set("o_orderpriority").alias("principles"))
    return by.withColumn("body", F.when(F.col("o_custkey") % 7 == 0, schemas.CHARTER_PLACEHOLDER).otherwise("what belongs here"))


_rule(
    "charters",
    f"""WITH {_CHARTERS} SELECT 'charter-placeholder' AS rule, domain AS subject, '' AS detail FROM c WHERE k % 7 = 0
UNION ALL SELECT 'charter-families', domain, CAST(n AS VARCHAR) FROM c WHERE k % 7 <> 0 AND n NOT BETWEEN 3 AND 7
UNION ALL SELECT 'charter-principles', domain, CAST(m AS VARCHAR) FROM c WHERE k % 7 <> 0 AND m > 3
UNION ALL SELECT DISTINCT 'charter-namespace', domain, family FROM o WHERE k % 7 <> 0 AND family LIKE 'x:%'""",
    lambda spark, at: audit.charter_shape(_charters(spark, at)),
)
_rule(
    "primary",
    "SELECT 'missing-primary' AS rule, CAST(o_orderkey AS VARCHAR) AS subject, 'c' || o_custkey AS detail FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey",
    lambda spark, at: audit.missing_primary(
        table(spark, at, "orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("primary_asset")),
        table(spark, at, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path")),
    ),
)
_IDS = "n AS (SELECT 'p/' || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name ELSE 'nation:' || c_nationkey || '-' || c_custkey // 2 END AS id FROM customer)"
_rule(
    "id_shapes",
    f"WITH {_IDS} SELECT 'id-shape' AS rule, coalesce(id, path) AS subject, path AS detail FROM n WHERE id IS NULL OR id LIKE 'Customer%' UNION ALL SELECT 'id-repeated', id, CAST(count(*) AS VARCHAR) FROM n WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    lambda spark, at: audit.identifiers(
        table(spark, at, "customer").selectExpr(
            "concat('p/', c_custkey) AS path", "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name ELSE concat('nation:', c_nationkey, '-', c_custkey DIV 2) END AS id"
        )
    ),
)


@query(
    """SELECT 'file' AS kind, CAST(doc_id AS VARCHAR) AS name, CAST(1 AS BIGINT) AS items FROM documents WHERE doc_id % 3 = 0 OR source IS NULL
UNION ALL SELECT 'batch', source, count(*) FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL GROUP BY lang, source
UNION ALL SELECT 'debrief', CAST(o_orderkey AS VARCHAR), CAST(1 AS BIGINT) FROM orders WHERE o_orderstatus = 'O'"""
)
def inbox_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as captures: every third a single file, the others in batches of their domain; open orders as pending debriefs."""
    captures = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("capture"), F.col("lang").alias("domain"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("batch"))
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("archived").alias("state"))
    return ingest.inbox(captures, records)


@query(
    "SELECT o_orderkey AS job, 'c' || o_custkey AS tool, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'present' END AS state, CASE WHEN c_custkey IS NULL THEN 'install c' || o_custkey END AS hint FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey"
)
def job_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs that need their customer as a tool, which has a path where the account is not overdrawn."""
    tool = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), tool("o_custkey").alias("tool"), F.concat(F.lit("install "), tool("o_custkey")).alias("hint"))
    present = table(spark, sf_dir, "customer").select(tool("c_custkey").alias("tool"), F.when(F.col("c_acctbal") >= 0, F.lit("/bin/tool")).alias("path"))
    return sync.doctor(wanted, present)


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), '    '), '(?m)[ ]+$', '', 'g') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, sha256(regexp_replace(regexp_replace(t, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '\n+\z', '') || chr(10)) AS sha256 FROM t"""
)
def formatted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return sync.formatted(d).select("path", F.sha2("text", 256).alias("sha256"))


@query(
    f"""WITH {_NOTES} SELECT id AS src, CASE WHEN p_size % 3 <> 0 AND predicate <> 'LIKES' THEN predicate END AS predicate, CASE WHEN p_size % 3 <> 0 AND predicate <> 'LIKES' THEN target END AS dst,
CASE WHEN p_size % 3 <> 0 AND predicate <> 'LIKES' THEN 'proposed' ELSE 'none warranted' END AS outcome FROM p"""
)
def edge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of notes as proposals; those of every third size have no rationale."""
    n, p = analogs.notes(spark, sf_dir), table(spark, sf_dir, "part")
    bare = p.where("p_size % 3 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("src"), F.lit(True).alias("bare"))
    put = graph.edges(n).join(bare, "src", "left").withColumn("rationale", F.when(F.col("bare"), " ").otherwise(F.col("rationale")))
    return graph.proposed(n, put).select("src", "predicate", "dst", "outcome")


@query(
    f"""WITH {_NOTES} SELECT id, 'edge' AS kind, 'out ' || predicate AS relation, target AS other FROM p WHERE id = 'part:7' UNION ALL SELECT target, 'edge', 'in ' || predicate, id FROM p WHERE target = 'part:7'
UNION ALL SELECT id, 'evidence', CASE WHEN s_suppkey IS NULL THEN 'no record' WHEN c_custkey IS NULL THEN 'no archive' ELSE 'whole' END, 'rec-' || id FROM p
LEFT JOIN supplier ON id = 'part:' || s_suppkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = s_suppkey WHERE id = 'part:7'"""
)
def deep_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as notes with a record each; suppliers are the records that exist, customers in credit the archived files."""
    n = analogs.notes(spark, sf_dir).withColumn("source_links", F.array(F.concat(F.lit("rec-"), F.col("id"))))
    assets = table(spark, sf_dir, "supplier").selectExpr("concat('rec-part:', s_suppkey) AS path", "concat('raw-', s_suppkey) AS archive_path")
    return graph.deep(n, assets, table(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("concat('raw-', c_custkey) AS path"), "part:7")
