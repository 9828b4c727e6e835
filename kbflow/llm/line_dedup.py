"""Fuzzy duplicate lines: SimHash of normalised lines, block joins, edit similarity, one occurrence of each group.

A line's words are dealt to 2**e blocks by the first e bits of their hashes, and each block of the fingerprint is the
SimHash of its own words alone: a word is a vector that is zero outside its block. A changed word then touches one block
and leaves the others as they are, so that, by the pigeonhole principle, lines which differ in c words (2 c words that
only one of them has) share a block if they have more than 2 c. About five words make a block, so that equal blocks are
rare between other lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbflow.llm.shared import Table, components, within

#: Words of the shortest line that is judged, most differing bits of two fingerprints, and least edit similarity.
WORDS, RADIUS, SIMILARITY = 5, 12, 0.8
#: Words of a block, about; bits that choose a block, at least and at most; words of a block that its SimHash takes.
PER_BLOCK, FEWEST, MOST, SAMPLE = 5, 2, 5, 4
#: Lines whose number of words is so near to the next e, in e, have the blocks of both.
OVERLAP = 0.15
#: Lines of a block that a line is compared with, besides the first: those that follow in the order of their fingerprints.
NEXT = 8
#: Lines of a tile of a larger block: a task compares two tiles.
TILE = 256
#: Characters of the longest line whose edit similarity counts characters; that of longer ones counts words.
BY_CHARACTERS = 120
#: Rows and bytes up to which a table is broadcast to the documents; beyond it the two are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: SQL: characters of two lines that may be alike.
_LENGTHS = f"least({{0}}, {{1}}) >= {SIMILARITY} * greatest({{0}}, {{1}}) - 1"


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, and single blanks for all runs of what is neither letter nor digit."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[^\p{L}\p{M}\p{N}]+", " "))


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, raw) of all lines; th tells apart texts of one id.

    What a generator multiplies holds columns only: expressions beside it would be worked out for each row it makes.
    It is an outer one, as Spark would work out another's array once more for a filter on its size.
    """
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    return own.select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "raw"))


#: SQL: SimHash of n longs at 1 + b in ``dealt``: a bit is 1 if it is set in over half of them.
_SIMHASH = """CASE n WHEN 0 THEN NULL WHEN 1 THEN dealt[b] WHEN 2 THEN dealt[b] & dealt[b + 1]
WHEN 3 THEN (dealt[b] & dealt[b + 1]) | (dealt[b + 2] & (dealt[b] | dealt[b + 1]))
ELSE (dealt[b] & dealt[b + 1] & (dealt[b + 2] | dealt[b + 3])) | (dealt[b + 2] & dealt[b + 3] & (dealt[b] | dealt[b + 1])) END"""


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, n, main, fp, keys) of every judged line, once for each e that it has; ``main`` for the first.

    h: MD5 of the normalised line; n: its characters. A block's SimHash is that of the XXH64 of its distinct words, of the SAMPLE smallest
    where there are more: a bit is set if it is in over half of them. fp: 64 bits, 64 / 2**e of each block's SimHash.
    keys: a hash of e, the block's number and its whole SimHash, for each block with words.
    """
    # a filter on the words would work them out twice, so short lines go after the generator
    own = _split(docs).select("doc_id", "th", "pos", normalised(F.col("raw")).alias("line")).select("doc_id", "th", "pos", "line", F.split("line", " ").alias("words"))
    own = own.select("doc_id", "th", "pos", F.unhex(F.md5("line")).alias("h"), F.length("line").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    own = own.select("doc_id", "th", "pos", "h", "n", F.size("hashes").alias("words"), F.array_distinct("hashes").alias("hashes"))
    own = own.select("doc_id", "th", "pos", "h", "n", "words", "hashes", (F.log2(F.size("hashes")) - F.log2(F.lit(PER_BLOCK))).alias("e"))
    near = f"array(floor(e), IF(e - floor(e) < {OVERLAP}, floor(e) - 1, floor(e)), IF(e - floor(e) > {1 - OVERLAP}, floor(e) + 1, floor(e)))"
    es = f"IF(words >= {WORDS}, array_distinct(transform({near}, x -> cast(least({MOST}, greatest({FEWEST}, x)) AS int))), NULL)"
    own = own.select("doc_id", "th", "pos", "h", "n", "hashes", F.expr(es).alias("es"))
    own = own.select("doc_id", "th", "pos", "h", "n", "hashes", F.posexplode_outer("es").alias("at", "e")).where("e IS NOT NULL")
    # arrays that may hold no null are sorted without objects
    own = own.withColumn("e", F.coalesce("e", F.lit(0)))
    # the least hash of each block, sorted in among the hashes, marks where the block begins
    marks = "transform(sequence(0, shiftleft(1, e) - 1), i -> shiftleft(cast(i AS bigint), 64 - e) ^ shiftleft(1L, 63))"
    own = own.select("doc_id", "th", "pos", "h", "n", "at", "e", "hashes", F.expr(marks).alias("marks"))
    own = own.select("doc_id", "th", "pos", "h", "n", "at", "e", "marks", F.expr("sort_array(concat(marks, hashes))").alias("dealt"))
    own = own.select("doc_id", "th", "pos", "h", "n", "at", "e", "dealt", F.expr("transform(marks, m -> cast(array_position(dealt, m) AS int))").alias("begins"))
    sizes = "transform(begins, (b, i) -> struct(b, coalesce(get(begins, i + 1), size(dealt) + 1) - b - 1 AS n))"
    own = own.select("doc_id", "th", "pos", "h", "n", "at", "e", "dealt", F.expr(sizes).alias("begins"))
    simhash = _SIMHASH.replace("CASE n", "CASE least(x.n, 4)").replace("[b", "[x.b")
    own = own.select("doc_id", "th", "pos", "h", "n", "at", "e", F.expr(f"transform(begins, x -> {simhash})").alias("blocks"))
    mask = "shiftleft(shiftrightunsigned(-1L, 64 - shiftright(64, e)), i * shiftright(64, e))"
    fp = f"aggregate(transform(blocks, (b, i) -> coalesce(b, 0L) & {mask}), 0L, (a, x) -> a | x)"
    keys = "filter(transform(blocks, (b, i) -> IF(b IS NULL, NULL, xxhash64(e, i, b))), k -> k IS NOT NULL)"
    return own.select("doc_id", "th", "pos", "h", "n", (F.col("at") == 0).alias("main"), F.expr(fp).alias("fp"), F.expr(keys).alias("keys"))


def blocks(lines: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, key, fp, n, near, large): the blocks of lines (id, fp, keys, n) with the others that a line meets first.

    Within a block, lines are ordered by their fingerprints, turned by an amount of the block's own. Each meets the
    first and the NEXT that follow: up to NEXT + 1 lines these are all pairs. Larger blocks are ``large``: rest() has
    their other pairs. ``near``: those met that differ in at most ``radius`` bits and whose lengths n do not rule out that
    the two are like, so that no text is looked up for others.
    """
    keyed = lines.select("id", "fp", "n", F.explode("keys").alias("key"))
    turned = F.expr("shiftleft(fp, cast(key & 63 AS int)) | shiftrightunsigned(fp, cast(64 - (key & 63) AS int))")
    keyed = keyed.select("id", "key", turned.alias("fp"), "n")
    order = Window.partitionBy("key").orderBy("fp", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # most blocks have one line, for which nothing is gathered
    keyed = keyed.select("id", "key", "fp", "n", F.count(F.lit(1)).over(whole).alias("size")).where("size > 1")
    own = F.struct("id", "fp", "n")
    met = keyed.select("id", "key", "fp", "n", F.first(own).over(order).alias("first"), F.collect_list(own).over(order.rowsBetween(1, NEXT)).alias("next"), (F.col("size") > NEXT + 1).alias("large"))
    sized = lambda x: F.least(x["n"], "n") >= SIMILARITY * F.greatest(x["n"], "n") - 1
    near = F.filter(F.concat(F.array("first"), "next"), lambda x: (x["id"] != F.col("id")) & (F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))) <= radius) & sized(x))
    return met.select("id", "key", "fp", "n", F.transform(near, lambda x: x["id"]).alias("near"), "large").where(F.col("large") | (F.size("near") > 0))


def first(met: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of blocks() that meet first."""
    pairs = met.select("id", F.explode("near").alias("other"))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def meets(met: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """(x, y): the pairs of lines (id, fp, n, group) of large blocks that rest() compares, each once a block.

    A block's lines go to tiles of ``tile`` lines: those of a group that fills a tile next to each other, all others in
    order of their lengths. Lines of one tile meet once, each two other tiles in a row of their own, so that no task
    holds a block; tiles of one and the same group, and tiles whose lengths lie apart, do not meet. A line without a
    group is one of its own. What is left is quadratic in the lines of a block.
    """
    own = met.where("large").select("id", "key", "fp", "n").join(groups, "id", "left").select("id", "key", "fp", "n", F.coalesce("group", "id").alias("group"))
    own = own.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("key", "group")) >= tile)
    order = Window.partitionBy("key").orderBy(F.when(F.col("alone"), F.col("group")), "n", "id")
    own = own.select("key", F.floor((F.row_number().over(order) - 1) / tile).alias("tile"), F.struct("id", "fp", "n", "group").alias("line"))
    bounds = [f("line." + c).alias(f"{name}_{c}") for c in ("n", "group") for name, f in (("lo", F.min), ("hi", F.max))]
    tiles = Table(own.groupBy("key", "tile").agg(F.collect_list("line").alias("lines"), *bounds), "tiles").df
    within_tiles = tiles.where("lo_group <> hi_group").select(F.posexplode("lines").alias("at", "x"), "lines").select("x", F.explode(F.expr("slice(lines, at + 2, size(lines))")).alias("y"))
    name = lambda x, *columns: tiles.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("tile", *columns)))
    sized = ("lo_n", "hi_n", "lo_group", "hi_group")
    # which tiles meet is found without their lines
    met = name("x", *sized).join(name("y", *sized), "key").where("x_tile < y_tile AND NOT (x_lo_group = y_hi_group AND x_hi_group = y_lo_group)")
    met = met.where(f"x_hi_n >= {SIMILARITY} * y_lo_n - 1 AND y_hi_n >= {SIMILARITY} * x_lo_n - 1").select("key", "x_tile", "y_tile")
    both = met.join(name("x", "lines"), ["key", "x_tile"]).join(name("y", "lines"), ["key", "y_tile"])
    return both.select(F.explode("x_lines").alias("x"), "y_lines").select("x", F.explode("y_lines").alias("y")).unionByName(within_tiles)


def rest(met: DataFrame, groups: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: all pairs in large blocks that differ in at most ``radius`` bits, whose lengths n do not rule out
    that they are like, and that ``groups`` (id, group) has not in one group yet.
    """
    pairs = meets(met, groups, tile).where(f"x.group <> y.group AND bit_count(x.fp ^ y.fp) <= {radius} AND {_LENGTHS.format('x.n', 'y.n')}")
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def candidates(lines: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: all pairs of lines (id, fp, keys) that share a block and differ in at most ``radius`` bits."""
    met = Table(blocks(lines.select("id", "fp", "keys", F.lit(0).alias("n")), radius), "blocks").df
    none = lines.sparkSession.createDataFrame([], "id long, group long")
    return first(met).unionByName(rest(met, none, radius)).distinct()


def symbols(line: Column) -> Column:
    """A character for each word of a normalised line, one of 32,768."""
    return F.decode(F.unhex(F.array_join(F.transform(F.split(line, " "), lambda w: F.lpad(F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x7FFF)) + 256), 4, "0")), "")), "UTF-16BE")


def similar(a: str, b: str, least: float = SIMILARITY) -> Column:
    """Edit similarity of two columns, 1 - distance / length of the longer, is at least ``least``."""
    most, short = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    limit = F.floor(most * F.lit(round(1 - least, 9)) + F.lit(1e-9)).cast("int")
    return (most - short <= limit) & (F.call_function("levenshtein", F.col(a), F.col(b), limit) >= 0)


def _lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The normalised lines at (doc_id, th, pos), with the other columns of ``places``."""
    sent = F.broadcast if within(places, BROADCAST_ROWS) else lambda x: x
    found = _split(docs).join(sent(places), ["doc_id", "th", "pos"]).dropDuplicates(["doc_id", "th", "pos"])
    return found.withColumn("line", normalised(F.col("raw"))).drop("raw")


def classes(docs: DataFrame, texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, group) of the lines that are like another: components of the candidates whose edit similarity is at least SIMILARITY.

    The pairs that meet first are compared first. Of the others in large blocks only those are left that are not in one
    group by then: a link between two lines of a group changes no group.
    """
    again = Table(texts.where("k > 1").select("h", F.col("first").alias("kept")), "again").df
    again = F.broadcast(again) if within(again, BROADCAST_ROWS) else again
    once = lines.join(again, "h", "left").where(F.col("kept").isNull() | (F.struct("doc_id", "th", "pos") == F.col("kept")))
    met = Table(blocks(once.select(F.xxhash64("h").alias("id"), "fp", "keys", "n")), "blocks").df
    like = Table(alike(docs, texts, Table(first(met), "pairs").df), "like").df
    groups = Table(components(like, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group")), "settled").df
    more = Table(alike(docs, texts, Table(rest(met, groups), "pairs").df), "like").df
    # the later links join whole groups
    of = lambda x: groups.select(F.col("id").alias(x), F.col("group").alias(f"{x}_group"))
    more = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = Table(more.select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b")), "joined").df
    moved = Table(components(more, "a", "b").select(F.col("node").alias("group"), F.col("component").alias("to")), "moved").df
    known = groups.join(moved, "group", "left").select("id", F.coalesce("to", "group").alias("group"))
    new = moved.join(groups.select("group").distinct(), "group", "left_anti")
    return known.unionByName(new.select(F.col("group").alias("id"), F.col("to").alias("group")))


def links(docs: DataFrame, texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): each line that is like another with the name of its group, links whose components are the groups."""
    return classes(docs, texts, lines).select(F.col("id").alias("a"), F.col("group").alias("b"))


def alike(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose edit similarity is at least SIMILARITY."""
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    places = Table(texts.select(F.xxhash64("h").alias("id"), "first.*").join(involved, "id"), "places").df
    held = _lines_at(docs, places).select("id", "line")
    held = held.select("id", F.length("line").alias("n"), "line", F.when(F.length("line") > BY_CHARACTERS, symbols(F.col("line"))).alias("words"))
    # a pair of which one line is short compares characters, and its lengths alone tell most of them apart
    held = Table(held.select("id", "n", F.when((F.col("n") <= BY_CHARACTERS / SIMILARITY + 1), F.col("line")).alias("line"), "words"), "held").df
    side = lambda x: held.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("line").alias(f"{x}_line"), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_LENGTHS.format("a_n", "b_n"))
    like = F.when((F.col("a_n") <= BY_CHARACTERS) | (F.col("b_n") <= BY_CHARACTERS), similar("a_line", "b_line")).otherwise(similar("a_words", "b_words"))
    return both.where(like).select("a", "b")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): positions of the lines that go, for each document that has any.

    Lines link if their normalised texts are equal, or if they share a block of their fingerprints, differ in at most
    RADIUS bits and have an edit similarity of at least SIMILARITY, in characters if one of them has BY_CHARACTERS at
    most, else in words. Of each connected group the first occurrence stays,
    by doc_id, text hash and position. Lines are equal by MD5; links go by 64 bits of it.
    """
    lines = Table(fingerprints(docs), "lines").df
    place = F.struct("doc_id", "th", "pos")
    texts = Table(lines.where("main").groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")), "texts").df
    groups = Table(classes(docs, texts, lines), "groups").df
    # the first occurrence of each text's group, where it is not the text's own or the text occurs again
    grouped = texts.withColumn("id", F.xxhash64("h")).join(groups, "id").select("h", "group", "first")
    firsts = grouped.join(grouped.groupBy("group").agg(F.min("first").alias("kept")), "group").select("h", "kept")
    moved = texts.where("k > 1").select("h", "first").join(firsts, "h", "full").select("h", F.coalesce("kept", "first").alias("kept"))
    moved = Table(moved, "moved").df
    moved = F.broadcast(moved) if within(moved, BROADCAST_ROWS) else moved
    gone = lines.where("main").select("doc_id", "th", "pos", "h").join(moved, "h").where(place != F.col("kept")).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    return Table(gone, "gone").df


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that repeat another; each row gains ``n_lines`` and ``n_removed``.

    Lines are parted by \\n. Lines under WORDS words, null texts and rows without an id are never judged and stay as
    they are; no row goes, a text of which no line is left becomes empty. Repeated rows are one document and come out
    alike. An empty table stays empty; columns named as work columns do no harm, and those named as the two new ones
    are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = duplicates(own)
    small = within(gone, BROADCAST_ROWS, "gone", size=BROADCAST_BYTES)
    whole = docs.select(F.struct(*names).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string").alias("text")).alias("th"), F.split(F.col(text_col).cast("string"), "\n").alias("lines"))
    joined = whole.join(F.broadcast(gone) if small else gone, ["doc_id", "th"], "left")
    left = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(left)
    kept = [(text if n == text_col else F.col("row")[n]).alias(n) for n in names]
    return joined.select(*kept, F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "text", "n_lines", "n_removed")
