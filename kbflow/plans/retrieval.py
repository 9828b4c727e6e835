"""Joins by similarity, sparse and hybrid retrieval, entity hops and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbflow.functions import text as T
from kbflow.operators import knn
from kbflow.operators import retrieval as R
from kbflow.plans import vectors as B
from kbflow.plans.register import query, read, spread


@query(f"WITH {B.BASE} SELECT q, d, rank::INT AS rank, round(sim, 6) AS sim FROM R WHERE rank <= 10")
def jon_nearest(spark, sf):
    return B.fetched(spark, sf, 10).select("q", "d", "rank", F.round("sim", 6).alias("sim"))


@query(f"WITH {B.BASE} SELECT q, d, rank::INT AS rank, round(sim, 6) AS sim FROM KR WHERE rank <= 10 AND sim >= {B.HIT}")
def ret_dense(spark, sf):
    return knn.top(B.served(spark, sf), 10).where(F.col("sim") >= B.HIT).select("q", "d", "rank", F.round("sim", 6).alias("sim"))


@query(f"WITH {B.BASE} SELECT q, arg_max(d, (sim, -d)) AS d, round(max(sim), 6) AS sim, max(sim) >= {B.HIT} AS hit FROM S GROUP BY q")
def jon_best(spark, sf):
    best = F.max(F.struct("sim", (-F.col("d")).alias("n"))).alias("b")
    return B.served(spark, sf).groupBy("q").agg(best).select("q", (-F.col("b.n")).alias("d"), F.round("b.sim", 6).alias("sim"), (F.col("b.sim") >= B.HIT).alias("hit"))


@query(f"WITH {B.BASE} SELECT q, count(*) AS n, round(max(sim), 6) AS best FROM S WHERE sim > 0.2::DOUBLE AND sim < 0.35::DOUBLE GROUP BY q")
def jon_band(spark, sf):
    return B.served(spark, sf).where("sim > 0.2D AND sim < 0.35D").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sim"), 6).alias("best"))


@query(f"WITH {B.BASE} SELECT P.d, round(max(list_inner_product(P.dv, KB.dv)), 6) AS best FROM P, KB WHERE P.d NOT IN (SELECT d FROM KB) GROUP BY P.d HAVING max(list_inner_product(P.dv, KB.dv)) BETWEEN 0.25::DOUBLE AND 0.37::DOUBLE")
def flt_dedup_band(spark, sf):
    """Pool documents by the nearest resident: the residents, a budget, go to the pool."""
    own = B.kb(spark, sf)
    rest = B.pool(spark, sf).join(F.broadcast(own.select("d")), "d", "left_anti").select(F.col("d").alias("q"), F.col("dv").alias("qv"))
    best = knn.pairs(rest, own, B.BUDGET).groupBy("q").agg(F.max("sim").alias("best"))
    return best.where("best BETWEEN 0.25D AND 0.37D").select(F.col("q").alias("d"), F.round("best", 6).alias("best"))


@query(f"WITH {B.BASE} SELECT q, d, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM (SELECT q, d, sim FROM A WHERE d NOT IN (SELECT d FROM KB))) WHERE rank <= 5")
def flt_excluded(spark, sf):
    """Documents that the knowledge base has not: left out before the top k, not after it."""
    rest = B.pool(spark, sf).join(B.kb(spark, sf).select("d"), "d", "left_anti")
    return knn.nearest(B.queries(spark, sf), rest, 5).select("q", "d", "rank")


@query(f"""WITH {B.BASE}, X AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(dv) AS x, generate_subscripts(dv, 1) AS i FROM P) GROUP BY label, i),
C AS (SELECT label, list(m ORDER BY i) AS cv FROM X GROUP BY label), T AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY list_inner_product(qv, cv) DESC, label) AS n FROM Q, C)
SELECT q, d, rank::INT AS rank FROM (SELECT A.q, A.d, row_number() OVER (PARTITION BY A.q ORDER BY sim DESC, A.d) AS rank FROM A JOIN T ON A.q = T.q AND A.label = T.label AND n <= 3) WHERE rank <= 5""")
def jon_probe(spark, sf):
    p = B.pool(spark, sf)
    m = p.select("label", F.posexplode("dv").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("own")).select(F.col("label").cast("long").alias("c"), F.transform("own", lambda x: x["m"]).alias("cv"))
    return knn.probe(B.queries(spark, sf), c, p.select("d", F.col("label").cast("long").alias("c"), "dv"), 3, 5).select("q", "d", "rank")


_BM25_SQL = r"""qs AS (SELECT item_id AS q, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))) AS w FROM benchmark),
ds AS (SELECT doc_id AS d, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS words FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM ds), tt AS (SELECT d, len(words) AS len, unnest(words) AS w FROM ds), tf AS (SELECT d, w, len, count(*) AS tf FROM tt GROUP BY d, w, len),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
bm AS (SELECT q, d, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM qs JOIN tf USING (w) JOIN df USING (w), st GROUP BY q, d)"""


def _bm25_sides(spark, sf):
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("q"), T.tokens(F.col("text")).alias("words"))
    docs = spread(read(spark, sf, "documents").select("doc_id", "text"))
    return q, docs.select(F.col("doc_id").alias("d"), T.tokens(F.col("text")).alias("words"))


@query(f"WITH {_BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, d) AS rank FROM bm) SELECT q, d, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def ret_bm25(spark, sf):
    return R.bm25_top(*_bm25_sides(spark, sf), 10).select("q", "d", "rank", "score")


_HASHED = """, hq AS (SELECT item_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM benchmark), hd AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents),
vq AS (SELECT id, ('0x' || substr(md5(w), 1, 2))::INT % 32 AS i, count(*)::DOUBLE AS x FROM hq GROUP BY ALL), vd AS (SELECT id, ('0x' || substr(md5(w), 1, 2))::INT % 32 AS i, count(*)::DOUBLE AS x FROM hd GROUP BY ALL),
uq AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM vq), ud AS (SELECT id, i, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM vd), dn AS (SELECT uq.id AS q, ud.id AS d, round(sum(uq.x * ud.x), 6) AS sim FROM uq JOIN ud USING (i) GROUP BY 1, 2),
de AS (SELECT q, d, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS n FROM dn) WHERE n <= 10 AND sim >= 0.6::DOUBLE)"""


@query(f"""WITH {_BM25_SQL}{_HASHED}, tk AS (SELECT q, d, score FROM (SELECT q, d, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, d) AS n FROM bm) WHERE n <= 10),
sp AS (SELECT q, d, CASE WHEN max(score) OVER o = min(score) OVER o THEN 0.5 ELSE (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o + 1e-6) END AS s FROM tk WINDOW o AS (PARTITION BY q)),
fu AS (SELECT coalesce(de.q, sp.q) AS q, coalesce(de.d, sp.d) AS d, round(0.6::DOUBLE * coalesce(sim, 0) + 0.4::DOUBLE * coalesce(s, 0), 6) AS score FROM de FULL JOIN (SELECT * FROM sp WHERE s >= 0.8::DOUBLE) sp ON de.q = sp.q AND de.d = sp.d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM fu) SELECT q, d, rank::INT AS rank, score FROM r WHERE rank <= 5""")
def ret_hybrid(spark, sf):
    """Dense and sparse lists of ten, fused by weight; the dense vectors are hashed counts of words, as an embedding is passed in elsewhere."""
    asked, docs = _bm25_sides(spark, sf)
    sparse = R.bm25_top(asked, docs, 10).withColumn("score", R.min_max(F.col("score"))).where("score >= 0.8D")
    dense = R.hashed_top(asked, docs, 10).withColumn("sim", F.round("sim", 6)).where("sim >= 0.6D")
    fused = R.fuse(dense, sparse).withColumn("score", F.round("score", 6))
    return knn.top(fused, 5, score="score").select("q", "d", "rank", "score")


@query(f"WITH {B.BASE}, U AS (SELECT q, d, 0 AS l, sim FROM KR WHERE rank <= 3 UNION ALL SELECT q, d, 1, sim FROM R WHERE rank <= 3) SELECT q, d, min(l)::INT AS list FROM U GROUP BY q, d")
def set_union_first(spark, sf):
    kb = knn.top(B.served(spark, sf), 3).select("q", "d")
    return R.union_first(kb, B.fetched(spark, sf, 3).select("q", "d")).select("q", "d", "list")


@query(f"""WITH {B.BASE}, N AS (SELECT d FROM (SELECT d FROM P ORDER BY md5('43|' || d), d LIMIT {B.BUDGET})) SELECT 'add' AS change, d FROM N WHERE d NOT IN (SELECT d FROM KB) UNION ALL SELECT 'remove', d FROM KB WHERE d NOT IN (SELECT d FROM N)""")
def set_sync(spark, sf):
    from kbflow.operators.stream import sample

    old, new = B.kb(spark, sf).select("d"), sample(B.pool(spark, sf), B.BUDGET, 43, "d").select("d")
    return new.join(old, "d", "left_anti").select(F.lit("add").alias("change"), "d").unionByName(old.join(new, "d", "left_anti").select(F.lit("remove").alias("change"), "d"))


_ENT = "E AS (SELECT DISTINCT p_partkey AS d, unnest(string_split(lower(p_name), ' ')) || p_size AS e FROM part)"


def _entities(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("d"), "p_size", F.explode(T.tokens(F.col("p_name"))).alias("w"))
    return p.select("d", F.concat("w", F.col("p_size").cast("string")).alias("e")).distinct()


@query(f"""WITH {_ENT}, H AS (SELECT l_orderkey AS q, min(l_partkey) AS d FROM lineitem GROUP BY l_orderkey), V AS (SELECT DISTINCT q, e FROM H JOIN E USING (d)),
O AS (SELECT q, d, count(*) AS overlap FROM V JOIN E USING (e) GROUP BY q, d) SELECT q, d, overlap FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, d) AS n FROM O WHERE (q, d) NOT IN (SELECT q, d FROM H)) WHERE n <= 20""")
def jon_entity_hop(spark, sf):
    """Documents that share entities with an order's first document: found once for each set of entities, however many documents have it."""
    first = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.min("l_partkey").alias("d"))
    return R.hop_top(first, _entities(spark, sf), 20)


@query(f"WITH {_ENT}, N AS (SELECT count(DISTINCT d) AS n FROM E) SELECT e, count(*) AS df, round(greatest(0.001::DOUBLE, ln((n + 1.0::DOUBLE) / (count(*) + 1)) + 1), 6) AS idf FROM E, N GROUP BY e, n")
def agg_entity_idf(spark, sf):
    e = _entities(spark, sf)
    df = e.groupBy("e").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(e.agg(F.countDistinct("d").alias("n"))))
    return df.select("e", "df", F.round(F.greatest(F.lit(0.001), F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1), 6).alias("idf"))


@query("""WITH L AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT a.p AS e1, b.p AS e2, count(*) AS n FROM L a JOIN L b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p""")
def jon_cooccur(spark, sf):
    """Pairs of entities of one passage (an order's parts, seven at most by its key)."""
    own = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    return own.select("o", F.col("p").alias("e1")).join(own.select("o", F.col("p").alias("e2")), "o").where("e1 < e2").groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH E AS (SELECT DISTINCT lower(n_name) AS e FROM nation), A AS (SELECT DISTINCT lower(n_name) AS a FROM nation WHERE n_nationkey < 3 UNION SELECT substr(lower(r_name), 1, 1) FROM region), M AS (SELECT a, e, a = e AS exact FROM A JOIN E ON contains(e, a) OR contains(a, e))
SELECT a, e, round(CASE WHEN exact THEN 1.0 ELSE 0.5::DOUBLE / count(*) OVER (PARTITION BY a) END, 6) AS weight FROM M WHERE exact OR a NOT IN (SELECT a FROM M WHERE exact)""")
def jon_contains(spark, sf):
    """Names that hold one another; an exact match excludes the others."""
    e = read(spark, sf, "nation").select(F.lower("n_name").alias("e")).distinct()
    a = read(spark, sf, "nation").where("n_nationkey < 3").select(F.lower("n_name").alias("a")).union(read(spark, sf, "region").select(F.substring(F.lower("r_name"), 1, 1))).distinct()
    m = e.join(F.broadcast(a), F.contains("e", "a") | F.contains("a", "e")).withColumn("exact", F.col("a") == F.col("e"))
    m = m.withColumn("any", F.max("exact").over(Window.partitionBy("a"))).where("exact OR NOT any")
    return m.select("a", "e", F.round(F.when(F.col("exact"), 1.0).otherwise(0.5 / F.count(F.lit(1)).over(Window.partitionBy("a"))), 6).alias("weight"))


_PPR_ROUNDS = 20
_PPR_SQL = "WITH E AS (SELECT DISTINCT c_nationkey AS s, n_regionkey + 100 AS t FROM customer JOIN nation ON c_nationkey = n_nationkey), D AS (SELECT s, t FROM E UNION ALL SELECT t, s FROM E), T AS (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) AS p FROM D),\nM0 AS (SELECT r_regionkey AS q, r_regionkey + 100 AS node, 1.0::DOUBLE AS mass FROM region)" + "".join(
    f",\nM{i + 1} AS (SELECT q, node, sum(mass) AS mass FROM (SELECT q, t AS node, 0.5::DOUBLE * mass * p AS mass FROM M{i} JOIN T ON node = s UNION ALL SELECT q, node, 0.5::DOUBLE * mass FROM M0) GROUP BY q, node)" for i in range(_PPR_ROUNDS)
) + f"\nSELECT q, node, round(mass, 6) AS mass FROM M{_PPR_ROUNDS}"


@query(_PPR_SQL)
def ret_page_rank(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 100).alias("t"))
    e = read(spark, sf, "customer").select("c_nationkey").distinct().join(n, "c_nationkey").select(F.col("c_nationkey").alias("src"), F.col("t").alias("dst"), F.lit(1.0).alias("weight"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    seeds = read(spark, sf, "region").select(F.col("r_regionkey").alias("q"), (F.col("r_regionkey") + 100).alias("node"), F.lit(1.0).alias("mass"))
    return R.page_rank(both, seeds, _PPR_ROUNDS).select("q", "node", F.round("mass", 6).alias("mass"))


@query("""WITH L AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS t FROM lineitem) SELECT DISTINCT a.o AS item, b.o AS neighbour FROM L a JOIN L b ON a.t = b.t AND a.o <> b.o""")
def jon_item_graph(spark, sf):
    own = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("t")).distinct()
    return own.select("t", F.col("o").alias("item")).join(own.select("t", F.col("o").alias("neighbour")), "t").where("item <> neighbour").select("item", "neighbour").distinct()


@query("""WITH N AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), O AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0)
SELECT N.doc_id, CASE WHEN O.doc_id IS NULL THEN 'add' WHEN md5(N.text) = md5(O.text) THEN 'skip' ELSE 'replace' END AS change FROM N LEFT JOIN O USING (doc_id)""")
def ret_ingest(spark, sf):
    """What an upsert of documents does to each: by id and content hash."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    old = d.where("doc_id % 2 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("was"))
    new = d.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("now")).join(old, "doc_id", "left")
    return new.select("doc_id", F.when(F.col("was").isNull(), "add").when(F.col("was") == F.col("now"), "skip").otherwise("replace").alias("change"))
