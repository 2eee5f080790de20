"""SQL for the rows of the operators that SQL can express."""

from __future__ import annotations

from marlstone.llm.decontamination import OP7_SQL
from marlstone.llm.prefix_trie import OP12_SQL
from marlstone.llm.ranked_search import OP13_SQL
from marlstone.llm.secrets import BASE, RULES
from marlstone.llm.substring_dedup import WINDOW

_QUOTED = ", ".join("({}, '{}', '{}', {}, {})".format(k, r.kind, r.pattern.replace("'", "''"), r.group, r.shortest) for k, r in enumerate(RULES))
_BASE = ", ".join(f"'{k}'" for k in BASE)

OP6_SQL = f"""
WITH rules(no, kind, pattern, grp, shortest) AS (VALUES {_QUOTED}),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(
    f"SELECT doc_id, no, kind, shortest, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS f, regexp_extract_all(text, '{p}', {r.group}) AS v FROM texts, rules WHERE no = {k} AND regexp_matches(text, '{p}')"
    for k, r in enumerate(RULES) for p in [r.pattern.replace("'", "''")])}),
each AS (SELECT doc_id, no, kind, shortest, unnest(list_zip(range(1, len(f) + 1), g[1:len(f)], f, v)) AS x FROM found),
ends AS (SELECT doc_id, no, kind, length(x[3]) AS n, length(x[4]) >= shortest AS ok, sum(length(x[2]) + length(x[3])) OVER (PARTITION BY doc_id, no ORDER BY x[1]) AS e FROM each),
spans AS (SELECT doc_id, no, kind, kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS s, e - n AS b FROM ends WHERE ok),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(s, ',' ORDER BY b, no) FILTER (kind IN ({_BASE})) AS base, string_agg(s, ',' ORDER BY b, no) AS spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN per USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_in JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_in.n >= 75 * (p.n + q.n - both_in.n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""

OP10_SQL = f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE k IN (SELECT k FROM again)),
kept AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words d LEFT JOIN kept k USING (doc_id)
"""

SQL = {"op6_secret_scan": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_near_dedup": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_ranked_search": OP13_SQL}
