"""Reusable DuckDB CTE blocks for similarity / ranking oracles."""

from __future__ import annotations

from tidewater.functions import STOP_WORDS, TOKEN_PATTERN

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def tfidf_sql(docs_sql: str, name: str = "X") -> str:
    """CTEs ``{name}_DOCS``, ``{name}`` (doc_id, term, tf, idf, weight) from a (doc_id, txt) query."""
    return f"""
{name}_DOCS AS ({docs_sql}),
{name}_TOK AS (SELECT doc_id, unnest(regexp_extract_all(lower(txt), '{TOKEN_PATTERN}')) AS term FROM {name}_DOCS),
{name}_TF AS (SELECT doc_id, term, count(*) AS tf FROM {name}_TOK WHERE term NOT IN ({STOP_SQL}) GROUP BY doc_id, term),
{name}_IDF AS (SELECT term, ln((1 + (SELECT count(*) FROM {name}_DOCS)) / (1 + count(*))) + 1 AS idf FROM {name}_TF GROUP BY term),
{name}_W AS (SELECT doc_id, term, tf, idf, tf * idf AS raw FROM {name}_TF JOIN {name}_IDF USING (term)),
{name} AS (SELECT doc_id, term, tf, idf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM {name}_W)
"""


def colcos_sql(r: str, key: str, item: str, value: str, name: str = "SIM") -> str:
    """CTE ``name`` (item_i, item_j, sim): cosine of item columns of the key x item matrix."""
    return f"""
{name}_AG AS (SELECT {key} AS k, {item} AS it, sum({value}) AS v FROM {r} GROUP BY 1, 2 HAVING sum({value}) <> 0),
{name}_N AS (SELECT it, sqrt(sum(v * v)) AS nrm FROM {name}_AG GROUP BY it),
{name}_U AS (SELECT a.k, a.it, a.v / n.nrm AS u FROM {name}_AG a JOIN {name}_N n USING (it)),
{name} AS (SELECT a.it AS item_i, b.it AS item_j, sum(a.u * b.u) AS sim FROM {name}_U a JOIN {name}_U b ON a.k = b.k GROUP BY 1, 2)
"""


def hybrid_sql(r: str, products: str, alpha: float) -> str:
    """CTEs through ``HY`` (user_id, item_id, cf, cb, hybrid, seen) for user scores ``r`` (user_id, item_id, score)."""
    return f"""
RR AS (SELECT user_id, item_id, sum(score) AS score FROM {r} WHERE item_id IN (SELECT product_id FROM {products}) GROUP BY 1, 2),
{colcos_sql('RR', 'user_id', 'item_id', 'score')},
DEN AS (SELECT item_i, CASE WHEN sum(abs(sim)) = 0 THEN 1.0 ELSE sum(abs(sim)) END AS den FROM SIM GROUP BY item_i),
CFS AS (SELECT r.user_id, s.item_i AS item_id, sum(r.score * s.sim) / max(d.den) AS cf
        FROM RR r JOIN SIM s ON r.item_id = s.item_j JOIN DEN d ON s.item_i = d.item_i GROUP BY 1, 2),
{tfidf_sql(f"SELECT product_id AS doc_id, category || ' ' || description AS txt FROM {products}")},
PRF AS (SELECT r.user_id, x.term, sum(r.score * x.weight) AS p FROM RR r JOIN X x ON r.item_id = x.doc_id GROUP BY 1, 2),
CBS AS (SELECT p.user_id, x.doc_id AS item_id, sum(p.p * x.weight) AS cb FROM PRF p JOIN X x USING (term) GROUP BY 1, 2),
J AS (SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(a.item_id, b.item_id) AS item_id,
             COALESCE(a.cf, 0.0) AS cf, COALESCE(b.cb, 0.0) AS cb
      FROM CFS a FULL JOIN CBS b ON a.user_id = b.user_id AND a.item_id = b.item_id),
JS AS (SELECT *, count(*) OVER (PARTITION BY user_id) < (SELECT count(*) FROM {products}) AS partial,
              min(cf) OVER (PARTITION BY user_id) AS cmn0, max(cf) OVER (PARTITION BY user_id) AS cmx0,
              min(cb) OVER (PARTITION BY user_id) AS bmn0, max(cb) OVER (PARTITION BY user_id) AS bmx0 FROM J),
JM AS (SELECT *, CASE WHEN partial THEN least(cmn0, 0.0) ELSE cmn0 END AS cmn, CASE WHEN partial THEN greatest(cmx0, 0.0) ELSE cmx0 END AS cmx,
              CASE WHEN partial THEN least(bmn0, 0.0) ELSE bmn0 END AS bmn, CASE WHEN partial THEN greatest(bmx0, 0.0) ELSE bmx0 END AS bmx FROM JS),
HY AS (SELECT j.user_id, j.item_id, j.cf, j.cb,
              {1.0 - alpha} * (CASE WHEN cmx > cmn THEN (cf - cmn) / (cmx - cmn) ELSE cf END)
              + {alpha} * (CASE WHEN bmx > bmn THEN (cb - bmn) / (bmx - bmn) ELSE cb END) AS hybrid,
              COALESCE(r.score > 0, false) AS seen
       FROM JM j LEFT JOIN RR r ON j.user_id = r.user_id AND j.item_id = r.item_id)
"""


def topk_backfill_sql(users: str, popular: str, k: int) -> str:
    """CTEs ``PERS`` (personal top-k) and ``RECS`` (user_id, rank, item_id, score, source) from ``HY``."""
    return f"""
PERS AS (SELECT user_id, item_id, round(hybrid, 4) AS score,
                row_number() OVER (PARTITION BY user_id ORDER BY round(hybrid, 9) DESC, item_id ASC) AS rk
         FROM HY WHERE NOT seen AND hybrid > 0 QUALIFY rk <= {k}),
US AS (SELECT DISTINCT user_id FROM {users}),
PC AS (SELECT u.user_id, COALESCE(count(p.item_id), 0) AS c FROM US u LEFT JOIN PERS p USING (user_id) GROUP BY u.user_id),
BF AS (SELECT pc.user_id, pp.item_id, pc.c,
              row_number() OVER (PARTITION BY pc.user_id ORDER BY pp.pos) AS j
       FROM PC pc CROSS JOIN (SELECT * FROM {popular} WHERE pos <= {2 * k}) pp
       WHERE NOT EXISTS (SELECT 1 FROM PERS p WHERE p.user_id = pc.user_id AND p.item_id = pp.item_id)),
RECS AS (SELECT user_id, CAST(rk AS BIGINT) AS rank, item_id, score, 'personal' AS source FROM PERS
         UNION ALL
         SELECT user_id, CAST(c + j AS BIGINT) AS rank, item_id, {0.5} AS score, 'popular' AS source FROM BF WHERE c + j <= {k})
"""
