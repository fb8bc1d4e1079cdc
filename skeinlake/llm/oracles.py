"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import fill_in_middle, periodic_runs, suffix_dedup
from .secret_scan import COPIED, KINDS


def _secrets() -> str:
    parts = []
    for number, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, source, {number} AS kind, len(m[i]) AS size, s[i] AS secret, {least} AS least,
               CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
            SELECT doc_id, source, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS s, string_split_regex(text, '{p}') AS g FROM documents))""")
    names = "CASE kind " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END"
    spell = f"{names} || ':' || start || ':' || (start + size)"
    return f"""
    WITH f AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE len(secret) >= least
        AND (kind < 3 OR (regexp_matches(secret, '[A-Z]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[0-9]')))),
    o AS (SELECT secret, count(DISTINCT source) AS owners FROM f GROUP BY secret),
    j AS (SELECT f.*, owners FROM f JOIN o USING (secret) WHERE kind < 3 OR owners = 1),
    d AS (SELECT doc_id,
        count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        sha256(coalesce(string_agg({spell}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
        string_agg({spell}, ',' ORDER BY start, kind) AS spans,
        count(*) FILTER (owners = 1) AS n_owned, count(*) FILTER (owners >= {COPIED}) AS n_copied
        FROM j GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
    FROM documents LEFT JOIN d USING (doc_id)"""


_REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM v) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
    sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda y, i: NOT list_contains(ps, i)), ' ') END, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)"""

_LINKS = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, t FROM (
    SELECT doc_id, array_to_string(w[i:i+4], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM d)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.far)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(far) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op8_jaccard_join": _LINKS,
    "op1_secret_scan": _secrets(), "op3_substring_dedup": _REPEATS,
    "op11_fill_in_middle": fill_in_middle.ORACLE, "op12_periodic_runs": periodic_runs.ORACLE, "op13_suffix_dedup": suffix_dedup.ORACLE,
}
