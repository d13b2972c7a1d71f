"""SQL (DuckDB dialect) for the compressed-index queries.

Vectors are scalar rows (Id, p, x) wherever sums are taken, so every sum is an ordinary aggregate; scores and
distances are rounded to 6 decimals and ties go to the smaller id / cluster / code. The Lloyd steps of training are
unrolled, one group of CTEs a step. Functions take the names of the vector and query tables, so the same
text serves the given embeddings and the encoded catalogue.
"""

from __future__ import annotations

from tomescope.config import DEFAULT as P
from tomescope.plans.ann_queries import FIXED_NPROBE, NLIST, NPROBE, PQ_BITS, PQ_KSUB, PQ_M, REFINE, SAMPLE, TOP_K, TRAIN_STEPS

EV = """ev AS (SELECT vec_id AS Id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
ev_rows AS (SELECT Id, label, unnest(range(len(vec))) AS p, unnest(vec) AS x FROM ev)"""

FIXED = f"""{EV},
cent_rows AS (SELECT label AS cluster, p, avg(x) AS x FROM ev_rows GROUP BY label, p),
cent AS (SELECT cluster, list(x ORDER BY p) AS centroid FROM cent_rows GROUP BY cluster),
qc AS (SELECT e.Id AS query_id, c.cluster, round(list_dot_product(e.vec, c.centroid), 6) AS s FROM ev e CROSS JOIN cent c),
asg AS (SELECT query_id AS Id, cluster FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) AS r FROM qc) WHERE r = 1),
prb AS (SELECT query_id, cluster FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) AS r FROM qc) WHERE r <= {FIXED_NPROBE})"""


def _start(v: str, k: int) -> str:
    return f"""start_k AS (SELECT Id, vec, CAST(row_number() OVER (ORDER BY md5(CAST(Id AS VARCHAR) || '|{P.seed}')) - 1 AS INTEGER) AS n FROM {v})
""".strip() + f""",
km0_rows AS (SELECT n AS cluster, unnest(range(len(vec))) AS p, unnest(vec) AS x FROM start_k WHERE n < {k}),
km0 AS (SELECT cluster, list(x / nrm ORDER BY p) AS centroid FROM km0_rows JOIN (
  SELECT cluster, CASE WHEN sqrt(sum(x * x)) = 0 THEN 1 ELSE sqrt(sum(x * x)) END AS nrm FROM km0_rows GROUP BY cluster) USING (cluster) GROUP BY cluster)"""


def _assign(name: str, v: str, cents: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT Id, cluster FROM (
  SELECT e.Id, c.cluster, row_number() OVER (PARTITION BY e.Id ORDER BY round(list_dot_product(e.vec, c.centroid), 6) DESC, c.cluster) AS r
  FROM {v} e CROSS JOIN {cents} c) WHERE r = 1)"""


def kmeans(v: str, rows: str, k: int, steps: int) -> str:
    """CTEs up to ``cent`` (cluster, centroid)."""
    out = [_start(v, k)]
    for i in range(1, steps + 1):
        out.append(_assign(f"ka{i}", v, f"km{i - 1}"))
        out.append(f"""km{i}_rows AS (SELECT a.cluster, r.p, avg(r.x) AS x FROM {rows} r JOIN ka{i} a USING (Id) GROUP BY a.cluster, r.p),
km{i}_new AS (SELECT cluster, list(x / nrm ORDER BY p) AS centroid FROM km{i}_rows JOIN (
  SELECT cluster, CASE WHEN sqrt(sum(x * x)) = 0 THEN 1 ELSE sqrt(sum(x * x)) END AS nrm FROM km{i}_rows GROUP BY cluster) USING (cluster) GROUP BY cluster),
km{i} AS MATERIALIZED (SELECT o.cluster, coalesce(n.centroid, o.centroid) AS centroid FROM km{i - 1} o LEFT JOIN km{i}_new n USING (cluster))""")
    out.append(f"cent AS MATERIALIZED (SELECT * FROM km{steps}),\ncent_rows AS (SELECT cluster, unnest(range(len(centroid))) AS p, unnest(centroid) AS x FROM cent)")
    return ",\n".join(out)


def product_quantiser(v: str, rows: str, m: int, ksub: int, steps: int) -> str:
    """CTEs up to ``cb_rows`` (s, code, p, c) and ``codes`` (Id, cluster, s, code)."""
    out = [_assign("asg", v, "cent"), f"""dsub AS (SELECT max(p) + 1 AS dim, CAST((max(p) + 1) / {m} AS INTEGER) AS d FROM cent_rows),
res_rows AS MATERIALIZED (SELECT r.Id, a.cluster, CAST(r.p // (SELECT d FROM dsub) AS INTEGER) AS s, r.p, r.x - c.x AS r
  FROM {rows} r JOIN asg a ON a.Id = r.Id JOIN cent_rows c ON c.cluster = a.cluster AND c.p = r.p),
cb0 AS (SELECT x.s, k.n AS code, x.p, x.r AS c FROM res_rows x JOIN start_k k ON k.Id = x.Id WHERE k.n < {ksub})"""]

    def nearest(name: str, cb: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT Id, cluster, s, code FROM (
  SELECT *, row_number() OVER (PARTITION BY Id, s ORDER BY d, code) AS rn FROM (
    SELECT a.Id, a.cluster, a.s, b.code, round(sum((a.r - b.c) * (a.r - b.c)), 6) AS d
    FROM res_rows a JOIN {cb} b ON b.p = a.p GROUP BY a.Id, a.cluster, a.s, b.code)) WHERE rn = 1)"""

    for i in range(1, steps + 1):
        out.append(nearest(f"pa{i}", f"cb{i - 1}"))
        out.append(f"""cb{i}_new AS (SELECT a.s, a.code, r.p, avg(r.r) AS c FROM res_rows r JOIN pa{i} a ON a.Id = r.Id AND a.s = r.s GROUP BY a.s, a.code, r.p),
cb{i} AS MATERIALIZED (SELECT o.s, o.code, o.p, coalesce(n.c, o.c) AS c FROM cb{i - 1} o LEFT JOIN cb{i}_new n ON n.s = o.s AND n.code = o.code AND n.p = o.p)""")
    out.append(f"cb_rows AS MATERIALIZED (SELECT * FROM cb{steps})")
    out.append(nearest("codes", "cb_rows"))
    return ",\n".join(out)


def pq_scores(q: str, q_rows: str, nprobe: int, k: int, exclude_self: bool) -> str:
    """CTE ``approx`` (query_id, Id, score, rank) for queries (Id, vec) in ``q``."""
    own = "WHERE a.Id <> p.query_id" if exclude_self else ""
    return f"""qc AS (SELECT e.Id AS query_id, c.cluster, round(list_dot_product(e.vec, c.centroid), 6) AS s, list_dot_product(e.vec, c.centroid) AS raw
  FROM {q} e CROSS JOIN cent c),
prb AS MATERIALIZED (SELECT query_id, cluster, raw FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) AS r FROM qc) WHERE r <= {nprobe}),
decoded AS MATERIALIZED (SELECT k.Id, list(b.c ORDER BY b.p) AS r FROM codes k JOIN cb_rows b ON b.s = k.s AND b.code = k.code GROUP BY k.Id),
pairs AS MATERIALIZED (SELECT p.query_id, p.raw, a.Id FROM prb p JOIN asg a ON a.cluster = p.cluster {own}),
approx AS MATERIALIZED (
  SELECT query_id, Id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS rank FROM (
      SELECT p.query_id, p.Id, round(p.raw + list_dot_product(q.vec, d.r), 6) AS score
      FROM pairs p JOIN decoded d ON d.Id = p.Id JOIN {q} q ON q.Id = p.query_id))
  WHERE rank <= {k})"""


def refined(q: str, v: str, name: str, k: int) -> str:
    """CTE ``name``: the hits of ``approx`` ranked by exact score."""
    return f"""{name} AS (
  SELECT query_id, Id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS rank FROM (
      SELECT a.query_id, a.Id, round(list_dot_product(q.vec, x.vec), 6) AS score
      FROM approx a JOIN {q} q ON q.Id = a.query_id JOIN {v} x ON x.Id = a.Id))
  WHERE rank <= {k})"""


EXACT = f"""exact AS (
  SELECT query_id, Id FROM (
    SELECT a.Id AS query_id, b.Id,
      row_number() OVER (PARTITION BY a.Id ORDER BY round(list_dot_product(a.vec, b.vec), 6) DESC, b.Id) AS rank
    FROM ev a JOIN ev b ON a.Id <> b.Id) WHERE rank <= {TOP_K})"""


def sql() -> dict[str, str]:
    s = {}
    s["ivf_assign"] = f"WITH {FIXED}\nSELECT Id, cluster FROM asg"
    s["ivf_search"] = f"""WITH {FIXED}
SELECT query_id, Id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, Id) AS rank FROM (
    SELECT p.query_id, a.Id, round(list_dot_product(q.vec, x.vec), 6) AS score
    FROM prb p JOIN asg a ON a.cluster = p.cluster JOIN ev q ON q.Id = p.query_id JOIN ev x ON x.Id = a.Id
    WHERE a.Id <> p.query_id))
WHERE rank <= {TOP_K}"""
    km = f"WITH {EV}, {kmeans('ev', 'ev_rows', NLIST, TRAIN_STEPS)}"
    pq = f"{km}, {product_quantiser('ev', 'ev_rows', PQ_M, PQ_KSUB, TRAIN_STEPS)}"
    search = f"{pq}, {pq_scores('ev', 'ev_rows', NPROBE, TOP_K * REFINE, True)}, {refined('ev', 'ev', 'best', TOP_K)}"
    s["kmeans_train"] = km + "\nSELECT cluster, CAST(p AS INTEGER) AS p, round(x, 6) AS x FROM cent_rows"
    s["pq_train"] = pq + "\nSELECT s AS m, code, CAST(p % (SELECT d FROM dsub) AS INTEGER) AS p, round(c, 6) AS x FROM cb_rows"
    s["pq_encode"] = pq + "\nSELECT Id, cluster, string_agg(CAST(code AS VARCHAR), ',' ORDER BY s) AS codes FROM codes GROUP BY Id, cluster"
    s["pq_search"] = search + "\nSELECT query_id, Id, score, rank FROM best"
    s["train_sample"] = f"SELECT vec_id AS Id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '|{P.seed}') LIMIT {SAMPLE}"
    per_q = f"""per_q AS (
  SELECT e.query_id, CAST(count(a.Id) AS DOUBLE) / {TOP_K} AS r
  FROM exact e LEFT JOIN best a ON a.query_id = e.query_id AND a.Id = e.Id
  GROUP BY e.query_id)"""
    s["recall_interval"] = f"""{search}, {EXACT}, {per_q}
SELECT count(*) AS n_queries, round(avg(r), 6) AS recall, round(1.96 * sqrt(var_samp(r) / count(*)), 6) AS half_width
FROM per_q WHERE query_id % 50 = 0"""
    s["recall_at_10"] = f"""{search}, {EXACT}, {per_q}
SELECT count(*) AS n_queries, round(avg(r), 6) AS recall_at_10, avg(r) >= 0.8 AS passed FROM per_q"""
    code_bytes = PQ_M * (1 if PQ_BITS <= 8 else 2)
    s["index_report"] = f"""WITH n AS (SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings),
b AS (SELECT n, dim, n * ({code_bytes} + 8) + {NLIST} * dim * 4 + {PQ_KSUB} * dim * 4 AS bytes FROM n)
SELECT n AS n_vectors, CAST(dim AS INTEGER) AS dim, CAST(n * dim * 4 AS BIGINT) AS flat_bytes, CAST(bytes AS BIGINT) AS ivfpq_bytes,
  round((1 - CAST(bytes AS DOUBLE) / (n * dim * 4)) * 100, 1) AS reduction_pct FROM b"""
    return s
