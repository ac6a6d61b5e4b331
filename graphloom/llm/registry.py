"""The corpus queries by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from graphloom.llm import collocations, fingerprints, html_extraction, jaccard_join, lexical_search, mixing, packing, privacy, quality_classifier, quality_rules, sharding, suffix_dedup, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_warc": warc.op7_warc,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_privacy": privacy.op12_privacy,
    "op13_collocations": collocations.op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

#: What SQL can express in whole; the others are tested against brute force, exact round trips or held-out accuracy.
SQL: dict[str, str] = {
    # sets of shingles, pairs by inverted lists, links, and components by the smallest id that is reached
    "op3_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sets AS (SELECT doc_id, sha256(string_agg(t, chr(10) ORDER BY t)) AS sig FROM s GROUP BY 1),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id, count(*) OVER (PARTITION BY sig) AS copies FROM sets),
one AS (SELECT s.t, s.doc_id, n.n FROM s JOIN n USING (doc_id) JOIN class c ON c.doc_id = s.doc_id AND c.class_id = s.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM one a JOIN one b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (na + nb - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT class_id AS x, class_id AS y FROM class WHERE doc_id = class_id UNION SELECT r.x, e.b FROM reach r JOIN edges e ON e.a = r.y),
root AS (SELECT x AS class_id, min(y) AS component_id FROM reach GROUP BY 1),
size AS (SELECT DISTINCT class_id, copies FROM class),
met AS (SELECT e.a AS class_id, sum(z.copies) AS others FROM edges e JOIN size z ON z.class_id = e.b GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(m.others, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN class c ON c.doc_id = d.doc_id LEFT JOIN root r ON r.class_id = c.class_id LEFT JOIN met m ON m.class_id = c.class_id
""",
    # strings of 50 bytes by their digests, the first document of each, spans of those that go, and what lies between spans
    "op4_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, 2000 * k AS since, substr(x, 4000 * k + 1, 4098) AS y FROM h, LATERAL (SELECT unnest(range(0, length(x) // 4000 + 1)) AS k)),
w AS (SELECT doc_id, since + j AS i, md5_number(substr(y, 2 * j + 1, 100)) AS s FROM b, LATERAL (SELECT unnest(range(0, least(2000, greatest(0, length(y) // 2 - 49)))) AS j)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM g),
p AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM o),
q AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM p GROUP BY doc_id, span),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM q),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM k JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN m USING (doc_id)
""",
    # all n-grams of a piece, cuts of the frequent ones, and phrases that longer ones explain
    "op13_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_extract_all(piece, '[^\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.k, a, c.w, j, array_to_string(c.w[1:j], ' ') AS x, array_to_string(c.w[j + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < c.k),
e AS (SELECT s.lang, s.phrase, s.k, a, j, u.f AS l, v.f AS r, CAST(2000000::HUGEINT * a // (u.f + v.f) AS BIGINT) AS score FROM s JOIN f u ON u.lang = s.lang AND u.phrase = x JOIN f v ON v.lang = s.lang AND v.phrase = y),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, a, array_to_string(w[o:o + m - 1], ' ') AS inner_phrase FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS o) WHERE m < k AND o + m - 1 <= k),
q AS (SELECT lang, inner_phrase, max(a) AS most FROM i GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN q ON q.lang = b.lang AND q.inner_phrase = b.phrase WHERE most IS NULL OR 100 * most < 80 * a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN t USING (lang))
SELECT * FROM r WHERE rank <= 2000
""",
    # every document's terms against every item's, in 64-bit integers but for the weights
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')) AS t FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
c AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM c, s WHERE t IN (SELECT t FROM i) GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN c USING (t) JOIN v USING (t) JOIN m USING (r) GROUP BY ALL HAVING score > 0),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x)
SELECT * FROM k WHERE rank <= 50
""",
    # the record with the largest id answers for all of one payload of 1000 bytes or more
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM r
""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
