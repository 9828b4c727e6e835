"""One window of each admission policy: which documents enter the knowledge base and which leave it for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbflow.operators import admission as A
from kbflow.operators import knn
from kbflow.operators.stream import order_key
from kbflow.plans import vectors as B
from kbflow.plans.register import QUERIES, SQL, query

NOW, ARRIVALS, CAP = 1, 80, 40

_STATE = f"""{B.BASE}, F AS (SELECT q FROM Q JOIN F1 USING (q) WHERE window_idx = {NOW} AND best < {B.HIT}),
AR AS (SELECT d, label, dv FROM P WHERE d NOT IN (SELECT d FROM KB) ORDER BY md5('arrive|{NOW}|' || d), d LIMIT {ARRIVALS}),
ST AS (SELECT d, label, coalesce(max(CASE WHEN sim >= {B.HIT} THEN window_idx END), -1) AS last_hit, sum((sim >= {B.HIT})::INT) AS freq, max(sim * pow(0.8::DOUBLE, {NOW} - window_idx)) AS heat, sum(CASE WHEN window_idx = {NOW} THEN sim ELSE 0 END) AS serve
  FROM S WHERE window_idx <= {NOW} GROUP BY d, label),
AB AS (SELECT AR.d, max(list_inner_product(AR.dv, KB.dv)) AS near FROM AR, KB GROUP BY AR.d),
FE AS (SELECT R.q, R.d, R.sim, R.rank FROM R JOIN F USING (q) WHERE rank <= 5),
DE AS (SELECT d, sum(0.4::DOUBLE * sim / tot + CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS demand FROM (SELECT *, sum(sim) OVER (PARTITION BY q) AS tot FROM FE) GROUP BY d)"""


class State:
    """What a policy sees at the start of a window."""

    def __init__(self, spark, sf) -> None:
        self.spark, self.sf = spark, sf
        self.kb = B.kb(spark, sf)
        served = B.served(spark, sf).where(F.col("window_idx") <= NOW)
        hit = F.col("sim") >= B.HIT
        heat = F.max(F.col("sim") * F.pow(F.lit(0.8), NOW - F.col("window_idx")))
        last = F.coalesce(F.max(F.when(hit, F.col("window_idx"))), F.lit(-1))
        self.residents = served.groupBy("d", "label").agg(last.alias("last_hit"), F.sum(hit.cast("int")).alias("freq"), heat.alias("heat"), F.sum(F.when(F.col("window_idx") == NOW, F.col("sim")).otherwise(0.0)).alias("serve"))
        self.served = served

    def arrivals(self) -> DataFrame:
        rest = B.pool(self.spark, self.sf).join(F.broadcast(self.kb.select("d")), "d", "left_anti")
        return rest.orderBy(order_key(f"arrive|{NOW}", "d"), "d").limit(ARRIVALS)

    def failing(self) -> DataFrame:
        best = self.served.where(F.col("window_idx") == NOW).groupBy("q").agg(F.max("sim").alias("best")).where(F.col("best") < B.HIT).select("q")
        return B.queries(self.spark, self.sf).join(best, "q", "left_semi")

    def fetched(self, k: int = 5) -> DataFrame:
        return knn.nearest(self.failing(), B.pool(self.spark, self.sf), k)

    def demand(self, gain: float = 0.4) -> DataFrame:
        return A.demand(self.fetched(), gain)

    def near(self) -> DataFrame:
        """Arrivals with the similarity of the nearest resident."""
        return knn.nearest(self.arrivals().select(F.col("d").alias("q"), F.col("dv").alias("qv")), self.kb, 1).select(F.col("q").alias("d"), F.col("sim").alias("near"))


def policy(name: str, about: str, candidates: Callable[[State], DataFrame], residents: str, sql_candidates: str, sql_residents: str, gate: str | None = None, cap: int = CAP) -> None:
    """Register a policy: candidates (d, value), and a value for each resident; values are compared to nine digits."""

    def run(spark, sf):
        s = State(spark, sf)
        kb = s.kb.select("d")
        own = candidates(s).join(F.broadcast(kb), "d", "left_anti").select("d", F.round("value", 9).alias("value"))
        return A.swaps(own, s.residents.select("d", F.round(F.expr(residents), 9).alias("value")), cap, None if gate is None else F.expr(gate)).withColumn("i", F.col("i").cast("long"))

    run.__name__, run.__doc__ = name, about
    QUERIES[name] = run
    SQL[name] = f"""WITH {_STATE}, C AS (SELECT d, round(value, 9) AS gain, row_number() OVER (ORDER BY round(value, 9) DESC, d DESC) AS i FROM ({sql_candidates}) WHERE d NOT IN (SELECT d FROM KB)),
E AS (SELECT d, round(value, 9) AS loss, row_number() OVER (ORDER BY round(value, 9), d) AS i FROM (SELECT d, ({sql_residents})::DOUBLE AS value FROM ST))
SELECT C.i, C.d AS added, E.d AS removed FROM C JOIN E USING (i) WHERE i <= {cap}{f" AND {gate}" if gate else ""}"""


_ONE = lambda s: s.arrivals().select("d", F.lit(1.0).alias("value"))
_YEAR = "abs(2008 + d % 13 - 2014)"
policy("pol_fifo", "Random arrivals replace the oldest.", lambda s: s.arrivals().select("d", (F.col("d") * 1.0).alias("value")), "d * 1.0D", "SELECT d, d::DOUBLE AS value FROM AR", "d")
policy("pol_lru", "Arrivals replace the least recently hit.", _ONE, "last_hit * 1.0D", "SELECT d, 1.0::DOUBLE AS value FROM AR", "last_hit")
policy("pol_temporal", "Arrivals replace the least fresh around the queries' year.", lambda s: s.arrivals().select("d", F.expr(f"exp(-{_YEAR} / 2.0D)").alias("value")), f"exp(-{_YEAR} / 2.0D)", f"SELECT d, exp(-{_YEAR} / 2.0::DOUBLE) AS value FROM AR", f"exp(-{_YEAR} / 2.0::DOUBLE)", "gain > loss")
policy("pol_ttl", "Arrivals of the era replace the oldest year.", lambda s: s.arrivals().where(f"{_YEAR} <= 2").select("d", F.expr("(2008 + d % 13) * 1.0D").alias("value")), "(2008 + d % 13) * 1.0D", f"SELECT d, (2008 + d % 13)::DOUBLE AS value FROM AR WHERE {_YEAR} <= 2", "2008 + d % 13")
policy("pol_semantic_cache", "Arrivals in the band of similarity replace the coldest.", lambda s: s.near().where("near BETWEEN 0.25D AND 0.37D").select("d", F.col("near").alias("value")), "heat", "SELECT d, near AS value FROM AB WHERE near BETWEEN 0.25::DOUBLE AND 0.37::DOUBLE", "heat")
policy("pol_decayed_frequency", "Arrivals replace the smallest decayed frequency.", _ONE, f"freq * pow(0.88D, {NOW} - last_hit)", "SELECT d, 1.0::DOUBLE AS value FROM AR", f"freq * pow(0.88::DOUBLE, {NOW} - last_hit)")
policy("pol_tiny_lfu", "Arrivals, of no frequency yet, replace residents that were never hit.", lambda s: s.arrivals().select("d", F.lit(0.0).alias("value")), "freq * 1.0D", "SELECT d, 0.0::DOUBLE AS value FROM AR", "freq", "gain >= loss")
policy("pol_log_driven", "What failing queries would have fetched replaces the least useful.", lambda s: s.fetched().groupBy("d").agg(F.avg("sim").alias("value")), "serve", "SELECT d, avg(sim) AS value FROM FE GROUP BY d", "serve")
policy("pol_demand", "Documents in demand replace those that serve less.", lambda s: s.demand().select("d", F.col("demand").alias("value")), "serve / 10", "SELECT d, demand AS value FROM DE", "serve / 10", "gain > loss")
policy("pol_demand_loose", "As pol_demand with a looser gate.", lambda s: s.demand().select("d", F.col("demand").alias("value")), "serve / 10", "SELECT d, demand AS value FROM DE", "serve / 10", "gain > 0.7 * loss")


@query(f"""WITH {_STATE}, LK AS (SELECT q, label FROM FE JOIN P USING (d) WHERE rank <= 3), BR AS (SELECT P.d, sum(0.6::DOUBLE / n) AS extra FROM (SELECT q, label, count(*) AS n FROM LK GROUP BY q, label) JOIN P USING (label) GROUP BY P.d),
C AS (SELECT d, coalesce(demand, 0) + coalesce(extra, 0) AS value FROM DE FULL JOIN BR USING (d)) SELECT d, round(value, 6) AS demand FROM C WHERE d NOT IN (SELECT d FROM KB)""")
def pol_bridge_demand(spark, sf):
    """Demand that reaches documents by what they share with the first documents of a failing query."""
    s = State(spark, sf)
    pool = B.pool(spark, sf).select("d", "label")
    first = s.fetched().where("rank <= 3").join(pool, "d").groupBy("q", "label").agg(F.count(F.lit(1)).alias("n"))
    by_label = first.groupBy("label").agg(F.sum(F.lit(0.6) / F.col("n")).alias("extra"))
    own = pool.join(by_label, "label").select("d", "extra").join(s.demand(), "d", "full_outer")
    zero = F.lit(0.0)
    return own.join(F.broadcast(s.kb.select("d")), "d", "left_anti").select("d", F.round(F.coalesce("demand", zero) + F.coalesce("extra", zero), 6).alias("demand"))


@query(f"WITH {_STATE} SELECT d FROM KB")
def pol_static(spark, sf):
    return B.kb(spark, sf).select("d")


@query(f"""WITH {_STATE}, X AS (SELECT q, d FROM R JOIN F USING (q) WHERE rank <= 50), V AS (SELECT d FROM KB UNION SELECT d FROM X), H AS (SELECT G.q, avg((G.d IN (SELECT d FROM V))::INT) AS r FROM G JOIN Q USING (q) WHERE window_idx = {NOW} GROUP BY G.q)
SELECT count(*) AS n, round(avg(r), 6) AS recall, (SELECT count(*) FROM V) AS kb_size FROM H""")
def pol_fetch_on_demand(spark, sf):
    """The knowledge base with what failing queries fetch, for one window only."""
    s = State(spark, sf)
    virtual = s.kb.select("d").unionByName(s.fetched(50).select("d")).distinct()
    own = B.gold(spark, sf, NOW).join(virtual.withColumn("hit", F.lit(1)), "d", "left").groupBy("q").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("recall")).crossJoin(virtual.agg(F.count(F.lit(1)).alias("kb_size")))


@query(f"""WITH {_STATE}, WG AS (SELECT DISTINCT d FROM G JOIN Q USING (q) WHERE window_idx = {NOW}), FI AS (SELECT d, round(avg(sim), 9) AS use FROM A WHERE window_idx = {NOW} AND d NOT IN (SELECT d FROM WG) GROUP BY d)
SELECT d FROM (SELECT d, 1 AS g, 0.0::DOUBLE AS use FROM WG UNION ALL SELECT d, 0, use FROM FI) ORDER BY g DESC, use DESC, d LIMIT {B.BUDGET}""")
def pol_oracle(spark, sf):
    """The window's gold, filled up with the documents most like its queries."""
    asked = B.queries(spark, sf).where(F.col("window_idx") == NOW)
    gold = B.gold(spark, sf, NOW).select("d").distinct().select("d", F.lit(1).alias("g"), F.lit(0.0).alias("use"))
    rest = B.pool(spark, sf).join(gold.select("d"), "d", "left_anti")
    sims = rest.crossJoin(asked.select("q", "qv")).groupBy("d").agg(F.round(F.avg(_sim()), 9).alias("use"))
    return gold.unionByName(sims.select("d", F.lit(0).alias("g"), "use")).orderBy(F.col("g").desc(), F.col("use").desc(), "d").limit(B.BUDGET).select("d")


def _sim():
    from kbflow.functions.vectors import dot

    return dot("qv", "dv")


@query(f"""WITH {_STATE}, C AS (SELECT d, round(demand, 9) AS gain, row_number() OVER (ORDER BY round(demand, 9) DESC, d DESC) AS i FROM DE WHERE d NOT IN (SELECT d FROM KB)), E AS (SELECT d, round(serve / 10, 9) AS loss, row_number() OVER (ORDER BY round(serve / 10, 9), d) AS i FROM ST),
M AS (SELECT C.d AS added, E.d AS removed FROM C JOIN E USING (i) WHERE gain > loss AND i <= {CAP}), N AS (SELECT d FROM KB WHERE d NOT IN (SELECT removed FROM M) UNION ALL SELECT added FROM M), NX AS (SELECT Q.q, G.d FROM Q JOIN G USING (q) WHERE window_idx = {NOW + 1})
SELECT round(avg((d IN (SELECT d FROM KB))::INT), 6) AS before, round(avg((d IN (SELECT d FROM N))::INT), 6) AS after FROM NX""")
def pol_next_window(spark, sf):
    """Coverage of the next window's gold by the knowledge base before and after a step: tested on the version of its time."""
    s = State(spark, sf)
    own = s.demand().join(F.broadcast(s.kb.select("d")), "d", "left_anti").select("d", F.round("demand", 9).alias("value"))
    moved = A.swaps(own, s.residents.select("d", F.round(F.col("serve") / 10, 9).alias("value")), CAP, F.expr("gain > loss"))
    gold = B.gold(spark, sf, NOW + 1)
    old, new = s.kb.select("d", F.lit(1).alias("a")), A.apply(s.kb, moved).withColumn("b", F.lit(1))
    both = gold.join(old, "d", "left").join(new, "d", "left")
    return both.agg(F.round(F.avg(F.coalesce("a", F.lit(0))), 6).alias("before"), F.round(F.avg(F.coalesce("b", F.lit(0))), 6).alias("after"))


