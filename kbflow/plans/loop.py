"""Policies over all windows: recall, coverage and writes of each."""

from __future__ import annotations

from kbflow.operators import loop
from kbflow.plans import vectors as B
from kbflow.plans.register import QUERIES, SQL, query

_KIND = "policy string, window_idx long, n_queries long, recall double, coverage double, hit_recall double, writes long, gap double"


def _run(spark, sf, policy: str):
    pool = B.pool(spark, sf)
    rows = loop.run(policy, B.queries(spark, sf), pool, B.kb(spark, sf), B.gold(spark, sf), B.HIT, B.BUDGET)
    return spark.createDataFrame(rows, _KIND)  # a row a window


def _register(policy: str) -> None:
    def run(spark, sf):
        return _run(spark, sf, policy)

    run.__name__, run.__doc__ = f"loop_{policy}", f"The window loop under the policy {policy}."
    QUERIES[run.__name__] = run


for _policy in loop.POLICIES:
    _register(_policy)
# without changes the loop is a plain join, which SQL can say
SQL["loop_static"] = f"""WITH {B.BASE}, X AS (SELECT Q.window_idx, Q.q, avg(CASE WHEN KR.rank <= {B.K} THEN 1.0::DOUBLE ELSE 0 END) AS r, max(CASE WHEN KR.rank <= {B.K} THEN 1.0::DOUBLE ELSE 0 END) AS h FROM Q JOIN G USING (q) LEFT JOIN KR ON KR.q = Q.q AND KR.d = G.d GROUP BY Q.window_idx, Q.q),
W AS (SELECT DISTINCT window_idx, d FROM Q JOIN G USING (q)), C AS (SELECT window_idx, avg((d IN (SELECT d FROM KB))::INT) AS c FROM W GROUP BY window_idx), P1 AS (SELECT window_idx, 1 - avg(best) AS gap, count(*) AS n FROM Q JOIN F1 USING (q) GROUP BY window_idx)
SELECT 'static' AS policy, window_idx, n AS n_queries, round(avg(r), 6) AS recall, round(any_value(c), 6) AS coverage, round(avg(h), 6) AS hit_recall, 0::BIGINT AS writes, round(any_value(gap), 6) AS gap FROM X JOIN C USING (window_idx) JOIN P1 USING (window_idx) GROUP BY window_idx, n"""


@query(f"""WITH {B.BASE}, T AS (SELECT d, dv FROM KB ORDER BY md5('edit|1|' || d), d LIMIT 8), X AS (SELECT T.d AS resident, P.d, list_inner_product(T.dv, P.dv) AS sim FROM T, P WHERE P.d NOT IN (SELECT d FROM KB))
SELECT resident, d, rank::INT AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY resident ORDER BY sim DESC, d) AS rank FROM X WHERE sim > 0.1::DOUBLE AND sim < 0.8::DOUBLE) WHERE rank <= 3""")
def pol_edit_candidates(spark, sf):
    """Residents that are drawn for an edit, and the most like documents outside the knowledge base in a band of similarity."""
    from pyspark.sql import functions as F

    from kbflow.operators import knn
    from kbflow.operators.stream import order_key

    kb = B.kb(spark, sf)
    drawn = kb.orderBy(order_key("edit|1", "d"), "d").limit(8).select(F.col("d").alias("resident"), F.col("dv").alias("qv"))
    rest = B.pool(spark, sf).join(F.broadcast(kb.select("d")), "d", "left_anti").select("d", "dv")
    from kbflow.functions.vectors import dot

    near = rest.crossJoin(F.broadcast(drawn)).withColumn("sim", dot("qv", "dv")).where("sim > 0.1D AND sim < 0.8D")  # eight residents, a stated set
    return knn.top(near.select("resident", "d", "sim"), 3, by="resident").select("resident", "d", "rank", F.round("sim", 6).alias("sim"))
