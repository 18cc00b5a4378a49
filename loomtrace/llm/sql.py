"""SQL twins (DuckDB) of the queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM l)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(w[p], ' ' ORDER BY p) AS kept FROM p ANTI JOIN r USING (doc_id, p) GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i : array_to_string(w[i : i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id
"""

#: Vectors as whole numbers, without those that hold nothing or no finite number.
WHOLE = """
SELECT {columns}, list_transform(embedding, lambda x : floor({factor} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
"""

TOP_PRODUCTS = f"""
WITH x AS ({WHOLE.format(columns="vec_id", factor=256)}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p : p[1] * p[2]))::BIGINT AS score
      FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _vector_codes() -> str:
    """Four rounds as a chain of tables: places of parts, the nearest entry of each, then the floored means."""
    steps = [
        f"x AS MATERIALIZED ({WHOLE.format(columns='vec_id, label', factor=1024)})",
        "p AS MATERIALIZED (SELECT vec_id, label, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS w FROM x, range(4) t(k))",
        "b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, w FROM p QUALIFY e < 256)",
    ]
    for r in range(5):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, label, k, p.w, min(row(list_sum(list_transform(list_zip(p.w, b.w), lambda z : (z[1] - z[2]) * (z[1] - z[2]))), e)) AS m
                FROM p JOIN b{r} b USING (k) GROUP BY ALL)"""
        )
        if r < 4:
            steps.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(c.w, b.w) AS w FROM b{r} b LEFT JOIN (
                SELECT k, e, list(floor_mean ORDER BY i) AS w FROM (
                  SELECT k, m[2] AS e, i, ((sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean
                  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY k, e) c ON c.k = b.k AND c.e = b.e)"""
            )
    return "WITH " + ",\n".join(steps) + """,
c AS (SELECT vec_id, label, string_agg(printf('%02x', m[2]), '' ORDER BY k) AS code, sum(m[1])::BIGINT AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY k, e)) FROM b4) AS codebooks_sha256 FROM c
"""


VECTOR_CODES = _vector_codes()
