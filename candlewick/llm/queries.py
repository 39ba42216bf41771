"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from . import cuckoo, huffman, langid, mixing, negatives, pii, secrets, simhash, spm, tokencount, topk, vectorcodes, warc
from .common import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"))


@query
def op2_warc(spark, sf):
    return warc.archive(table(spark, sf, "pages"))


@query
def op3_private(spark, sf):
    return pii.scan_private(table(spark, sf, "documents"))


@query
def op4_simhash(spark, sf):
    return simhash.near_dedup(table(spark, sf, "documents"))


@query
def op5_token_counts(spark, sf):
    return tokencount.token_counts(table(spark, sf, "documents"))


@query
def op6_language(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query
def op7_secrets(spark, sf):
    return secrets.scan_secrets(table(spark, sf, "documents"))


@query
def op8_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query
def op9_sentencepiece(spark, sf):
    return spm.encode(table(spark, sf, "documents"))


@query
def op10_exact_dedup(spark, sf):
    return cuckoo.exact_dedup(table(spark, sf, "documents"))


@query
def op11_hard_negatives(spark, sf):
    return negatives.hard_negatives(table(spark, sf, "embeddings"))


@query
def op12_vector_codes(spark, sf):
    return vectorcodes.compress(table(spark, sf, "embeddings"))


@query
def op13_token_files(spark, sf):
    return huffman.token_files(table(spark, sf, "documents"))


SQL["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
b AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             first_value(points) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_points,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AND points = keep_points AS kept, text_sha256 FROM b
"""

SQL["op1_topk"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
"""

SQL["op2_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM g
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One pair of tables per round: the nearest entries, then the floored means."""
    steps = [f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, i // (len(e) // {parts}) AS part, i % (len(e) // {parts}) AS d, e[i + 1] AS a
  FROM (SELECT vec_id, e, unnest(range(len(e))) AS i FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, entry, d, a FROM x JOIN f USING (vec_id))"""]
    near = """n{r} AS (SELECT vec_id, part, entry, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY s, entry) AS k
  FROM (SELECT x.vec_id, x.part, c.entry, sum((x.a - c.a) * (x.a - c.a)) AS s FROM x JOIN c{r} c ON x.part = c.part AND x.d = c.d GROUP BY ALL)) WHERE k = 1)"""
    for r in range(rounds):
        steps += [near.format(r=r), f"""c{r + 1} AS (SELECT c.part, c.entry, c.d, coalesce(m.a, c.a) AS a FROM c{r} c LEFT JOIN
  (SELECT n.part, n.entry, x.d, floor(sum(x.a) / count(*)) AS a FROM n{r} n JOIN x ON n.vec_id = x.vec_id AND n.part = x.part GROUP BY ALL) m
  ON c.part = m.part AND c.entry = m.entry AND c.d = m.d)"""]
    steps += [near.format(r=rounds), f"""k AS (SELECT sha256(string_agg(a::BIGINT::VARCHAR, ',' ORDER BY part, entry, d)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT vec_id, string_agg(substr('0123456789abcdef', 1 + (entry // 16)::INT, 1) || substr('0123456789abcdef', 1 + (entry % 16)::INT, 1), '' ORDER BY part) AS code,
  sum(s)::BIGINT AS error FROM n{rounds} GROUP BY vec_id)"""]
    return "WITH " + ",\n".join(steps) + """
SELECT o.vec_id, code, error, sum(error) OVER (PARTITION BY v.label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id) CROSS JOIN k"""


SQL["op12_vector_codes"] = vector_codes_sql()

SQL["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.r AS other, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id,
             p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
