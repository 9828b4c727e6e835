"""Sparse scoring, fusion of ranked lists, and entity hops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbflow.operators import knn

K1, B = 1.5, 0.75
#: Queries that are sent to all tasks at a time, and documents that are scored together.
BLOCK, TOGETHER = 1024, 256
#: Entities of a set whose subsets are listed, 255 at most; sets of more are compared by entity.
WIDE = 8


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, k1: float = K1, b: float = B, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(q, d, score, rank): the k best documents (d, words) of each query (q, words) by BM25, ties at ``digits`` digits to the smaller d.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)). A block of queries and the counts of its words go to all tasks; each
    task scores its documents and keeps k a query, so that a frequent word makes no row for each query and document.
    Null ids and null words take no part, rows that repeat a document count each; documents that share no word with a
    query are not found. Without queries or documents there are no rows.
    """
    spark = queries.sparkSession
    own = queries.where("q IS NOT NULL AND words IS NOT NULL").select("q", F.array_distinct("words").alias("words"))
    docs = docs.where("d IS NOT NULL AND words IS NOT NULL").select("d", "words")
    n, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    asked, out = own.count(), None
    blocks = -(-asked // block) if n else 0
    for i in range(blocks):
        held = own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        words = sorted({w for r in held for w in r.words if w is not None})
        if not words:
            continue
        wanted = spark.createDataFrame([(w,) for w in words], "w string")  # the words of a block of queries
        df = docs.select(F.explode(F.array_distinct("words")).alias("w")).join(F.broadcast(wanted), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df")).collect()
        idf = {r.w: float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))) for r in df}
        known = sorted(idf)
        at = {w: j for j, w in enumerate(known)}
        pairs = sorted((at[w], j) for j, r in enumerate(held) for w in r.words if w in at)
        postings = (known, np.array([q for _, q in pairs], np.int64), np.bincount([w for w, _ in pairs], minlength=len(known)), np.array([idf[w] for w in known]))
        sent = spark.sparkContext.broadcast((np.array([r.q for r in held], np.int64), *postings))
        part = docs.mapInArrow(_score(sent, k, k1, b, float(mean or 1), digits), "q long, d long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "q long, d long, score double, rank int")
    return knn.top(out, k, score="score")


def _score(sent, k: int, k1: float, b: float, mean: float, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, asked, n_asked, idf = sent.value
        vocabulary = pa.array(words, pa.string())
        first = np.cumsum(n_asked) - n_asked
        best_d, best_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                d, lists = batch.column(0).slice(at, TOGETHER).to_numpy(), batch.column(1).slice(at, TOGETHER)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                word = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                met = word >= 0
                pair, tf = np.unique(np.repeat(np.arange(len(d)), sizes)[met] * len(words) + word[met], return_counts=True)
                doc, word = pair // max(1, len(words)), pair % max(1, len(words))
                part = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / mean))
                n = n_asked[word]
                ends = np.cumsum(n)
                place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[word] - (ends - n), n)
                score = np.bincount(asked[place] * len(d) + np.repeat(doc, n), weights=np.repeat(part, n), minlength=len(ids) * len(d)).reshape(len(ids), len(d))
                best_s = np.hstack([best_s, np.round(score, digits)])
                best_d = np.hstack([best_d, np.broadcast_to(d, score.shape)])
                order = np.lexsort((best_d, -best_s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_d, order, 1)
        found = best_s > 0
        yield pa.record_batch([pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(best_d[found]), pa.array(best_s[found])], names=["q", "d", "score"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, d, score) of documents (d, words) that share a word with a query (q, words); idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only words of queries are counted: they are joined before the counts are shuffled. Counts for the corpus are one row.
    """
    asked = queries.select("q", F.explode(F.array_distinct("words")).alias("w"))
    sizes = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("words")).alias("mean"))
    terms = docs.select("d", F.size("words").alias("len"), F.explode("words").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    tf = terms.groupBy("d", "w", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(sizes)).select("w", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return asked.join(tf.join(idf, "w"), "w").groupBy("q", "d").agg(F.sum(part).alias("score"))


def hashed_top(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, d, sim, rank) of the k documents (d, words) nearest to each query (q, words) by hashed counts; similarities are compared to six digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for words in batch.column(1).to_pylist():
                v = np.zeros(32)
                for w in words:
                    if (i := known.get(w)) is None:
                        i = int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % 32
                        if len(known) < 1_000_000:
                            known[w] = i
                    v[i] += 1
                out.append((v / max(float(np.sqrt(v @ v)), 1e-10)).tolist())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "v"])

    vectors = lambda df, c: df.where("words IS NOT NULL").select(c, "words").mapInArrow(run, "id long, v array<double>")
    asked = vectors(queries, "q").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return knn.nearest(asked, vectors(docs, "d").select(F.col("id").alias("d"), F.col("v").alias("dv")), k, digits=6)


def min_max(score: Column, by: str = "q") -> Column:
    """Scores of a query between 0 and 1; 0.5 where all are equal."""
    own = Window.partitionBy(by)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high == low, 0.5).otherwise((score - low) / (high - low + 1e-6))


def fuse(dense: DataFrame, sparse: DataFrame, weight: float = 0.6) -> DataFrame:
    """(q, d, score) of two lists (q, d, sim) and (q, d, score): a weighted sum, a list that has not a document counts as 0."""
    both = dense.select("q", "d", "sim").join(sparse.select("q", "d", "score"), ["q", "d"], "full_outer")
    zero = F.lit(0.0)
    return both.select("q", "d", (weight * F.coalesce("sim", zero) + (1 - weight) * F.coalesce("score", zero)).alias("score"))


def union_first(*lists: DataFrame, key: tuple[str, ...] = ("q", "d")) -> DataFrame:
    """The rows of all lists, of one key only that of the first list which has it; null keys are a key, empty lists add nothing."""
    out = lists[0].dropDuplicates(list(key)).withColumn("list", F.lit(0))
    for i, own in enumerate(lists[1:], 1):
        out = out.unionByName(own.dropDuplicates(list(key)).withColumn("list", F.lit(i)))
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("list"))).where("n = 1").drop("n")


def entity_hop(first: DataFrame, entities: DataFrame) -> DataFrame:
    """(q, d, overlap): documents that share entities with a query's first-hop documents (q, d), without these; entities: distinct (d, e). Nulls meet nothing."""
    seen = first.join(entities, "d").select("q", "e").distinct()
    second = seen.join(entities, "e").groupBy("q", "d").agg(F.count(F.lit(1)).alias("overlap"))
    return second.join(first.select("q", "d"), ["q", "d"], "left_anti")


def hop_top(first: DataFrame, entities: DataFrame, k: int, wide: int = WIDE) -> DataFrame:
    """(q, d, overlap): of entity_hop for queries with one first document (q, d) each, the k of the largest overlap, ties to the smaller d.

    Documents of one set of entities are one class. Every subset of a set keeps the k + 1 smallest documents that have
    all of it: one that is not among them has as many before it, of no smaller overlap, in every list that meets it by
    this subset, so none is lost, and no pairs of documents are made. The best of a class are found once, one more for
    the first document itself. Classes of more than ``wide`` entities have too many subsets; these are paired with
    the classes that share an entity. Sets are known by 128 bits of hashes of their entities.
    """
    most = k + 1
    hashed = entities.where("d IS NOT NULL AND e IS NOT NULL").select("d", F.struct(F.xxhash64("e").alias("x"), F.xxhash64(F.lit("|"), "e").alias("y")).alias("e"))
    sets = hashed.groupBy("d").agg(F.struct(F.bit_xor("e.x").alias("x"), F.bit_xor("e.y").alias("y"), F.count(F.lit(1)).alias("n")).alias("c"), F.sort_array(F.collect_list("e")).alias("own"))
    members = knn.smallest(sets.select("c", "d"), most, "c", "d")
    classes = sets.groupBy("c").agg(F.min("own").alias("own"))
    none = F.expr("array(struct(0L AS x, 0L AS y, 0L AS n))")
    more = lambda acc, e: F.concat(acc, F.transform(acc, lambda s: F.struct(s["x"].bitwiseXOR(e["x"]).alias("x"), s["y"].bitwiseXOR(e["y"]).alias("y"), (s["n"] + 1).alias("n"))))
    subsets = classes.where(F.col("c.n") <= wide).select("c", F.explode(F.filter(F.aggregate("own", none, more), lambda s: s["n"] > 0)).alias("s"))
    lists = knn.smallest(subsets.join(members, "c").select("s", "d"), most, "s", "d").groupBy("s").agg(F.collect_list("d").alias("held"))
    near = subsets.join(lists, "s").select("c", F.explode("held").alias("d"), F.col("s.n").alias("overlap"))
    one = classes.select("c", F.explode("own").alias("e"))
    large, other = one.where(F.col("c.n") > wide), one.select(F.col("c").alias("o"), "e")
    both = large.join(other, "e").select("c", "o").unionByName(one.where(F.col("c.n") <= wide).join(other.where(F.col("o.n") > wide), "e").select("c", "o"))
    near = near.unionByName(both.groupBy("c", "o").agg(F.count(F.lit(1)).alias("overlap")).join(members.withColumnRenamed("c", "o"), "o").select("c", "d", "overlap"))
    # a document's overlap is the largest by which it is listed
    best = knn.top(near.groupBy("c", "d").agg(F.max("overlap").alias("overlap")), most, by="c", score="overlap")
    best = best.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "d", "overlap"))), lambda r: F.struct(r["d"].alias("d"), r["overlap"].alias("overlap"))).alias("near"))
    own = first.select("q", "d").join(sets.select("d", "c"), "d").join(best, "c")
    return own.select("q", F.explode(F.slice(F.filter("near", lambda r: r["d"] != F.col("d")), 1, k)).alias("r")).select("q", "r.d", "r.overlap")


def page_rank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, restart: float = 0.5) -> DataFrame:
    """(q, node, mass): mass that starts at a query's seeds (q, node, mass, summing to 1) and walks weighted edges (src, dst, weight).

    Each round is an equi-join and a sum; the lineage is cut every few rounds by checkpoint(). Mass of a node without
    edges goes only by the restart.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))
    now = seeds
    for i in range(rounds):
        walked = now.join(step, now.node == step.src).select("q", F.col("dst").alias("node"), ((1 - restart) * F.col("mass") * F.col("p")).alias("mass"))
        now = walked.unionByName(seeds.select("q", "node", (restart * F.col("mass")).alias("mass"))).groupBy("q", "node").agg(F.sum("mass").alias("mass"))
        if i % 5 == 4 and i + 1 < rounds and now.sparkSession.sparkContext.getCheckpointDir():
            now = now.checkpoint()
    return now


def rerank(found: DataFrame, scorer: Column, score: str, weight: float = 0.5, least: float = 0.0) -> DataFrame:
    """Adds rerank and score, the weighted sum of ``scorer`` and the column ``score``, and drops rows under ``least``.

    ``scorer`` is any expression, a pandas function of a model too; where it gives null, the first score alone counts.
    """
    own = found.withColumn("rerank", scorer)
    both = F.coalesce(weight * F.col("rerank") + (1 - weight) * F.col(score), F.col(score))
    return own.withColumn("score", both).where(F.col("score") >= least)


def reflect(queries: DataFrame, retrieve, grade, refine, rounds: int = 2, least: int = 3) -> DataFrame:
    """Results (q, d, ..., round) of queries (q, question); those graded under ``least`` are refined and asked again, ``rounds`` times at most.

    retrieve(queries) gives (q, d, ...); grade(results) gives (q, grade); refine(queries) gives (q, question) anew. A
    question keeps the results of its last round; one without results counts as graded 0.
    """
    now, done = queries, None
    for i in range(rounds):
        found = retrieve(now)
        graded = now.select("q").join(grade(found), "q", "left").select("q", F.coalesce("grade", F.lit(0)).alias("grade"))
        last = i == rounds - 1
        settled = graded if last else graded.where(F.col("grade") >= least)
        part = found.join(settled.select("q"), "q", "left_semi").withColumn("round", F.lit(i))
        done = part if done is None else done.unionByName(part)
        if not last:
            now = refine(now.join(graded.where(F.col("grade") < least).select("q"), "q", "left_semi"))
    return done
