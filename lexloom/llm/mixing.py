"""Mixing sources to target weights by blocks of equal length and highest quotients.

Every source has a target in words. Its documents are dealt to shards in an order given by a seed; the shards of a source follow
each other in one line of words, which is cut into blocks of equal length (the last one is what remains). A block belongs
to the shard it begins in. Blocks are handed out by Sainte-Lague quotients ``votes / (2 k + 1)``: first to the sources,
then each source's blocks to its shards. A shard with a quota of ``q`` out of ``n`` blocks takes every block ``q div n``
times and ``q mod n`` blocks, chosen by the seed, once more. No block is taken more than twice, so no document is taken
more than twice its size, and a source misses its target by about a block.

Everything is done in Spark's own functions. A source of ``d`` documents has about ``sqrt(d)`` shards of
``sqrt(d)`` documents, so neither the order inside a shard nor the shards of a source are a large group, however
large one source is. Only the table of sources (a row each) is numbered as a whole.

Null text has size 0 and gives nothing; null sources are one source, last in order. Rows that repeat count as
rows of their own. An empty table gives an empty result. Columns of the input do not clash with those made here:
the input is held in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.registry import query, table
from lexloom.llm.words import words_of
from lexloom.sources.store import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block of a large source, and the least number of blocks for a target, which makes them shorter.
BLOCK_WORDS = 2048
LEAST_BLOCKS = 1024
SEED = "mix-1"
#: Parts of a source that are joined to its target on their own.
SALTS = 64


def source_targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target``: ``share`` of all words by weight, none above ``most`` times its source.

    ``sources`` has ``key``, ``source``, ``total`` (words), one row each. Resharing what is above until nothing is
    comes to one level: with sources in the order of limit by weight, one stops at its limit if the level that the
    sources from it on would have is at least that.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = sources.withColumn("weight", F.get(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")))
    limit = F.col("total") * most
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    rows = rows.withColumns({
        "left_words": share * F.sum("total").over(everyone) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(after),
        "stops": limit * F.sum("weight").over(after)
        <= F.col("weight") * (share * F.sum("total").over(everyone) - F.coalesce(F.sum(limit).over(before), F.lit(0))),
    })
    # The first one that does not stop; of those with equal limits by weight the first has the most words left.
    first = F.struct((limit / F.col("weight")).alias("o"), (-F.col("left_words")).alias("fewest"), "left_words", "left_weight")
    level = F.min(F.when(~F.col("stops"), first))
    rows = rows.withColumn("free", level.over(everyone))
    shared = F.col("free.left_words") * F.col("weight") / F.col("free.left_weight")
    return rows.withColumn("target", F.when(F.col("stops"), limit.cast("double")).otherwise(shared)).drop(
        "left_words", "left_weight", "free", "stops"
    )


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str, most: str) -> DataFrame:
    """Add ``quota``: the group's ``seats`` go to the highest quotients ``votes / (2 k + 1)``, none beyond ``most``.

    ``seats`` is the same for all rows of a group. With the divisor ``votes / seats`` of the whole group, rounding
    misses the number of seats by half the parties at most, and a party then wins or loses no more than its
    share of twice the parties, and two. So only that many quotients of each party are put in order: about ten
    for each, whatever the number of seats. Ties go to the party that comes first.
    """
    every = Window.partitionBy(*group)
    share = F.try_divide(F.col(votes), F.sum(votes).over(every))
    start = F.least(F.floor(F.coalesce(share * F.col(seats), F.lit(0.0)) + 0.5), F.col(most))
    slack = F.ceil(F.coalesce(share, F.lit(0.0)) * 2 * F.count("*").over(every)) + 2
    rows = parties.withColumn("_from", F.greatest(F.lit(0), start - slack).cast("long")).withColumn(
        "_to", F.least(F.col(most), start + slack).cast("long")
    )
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_from").over(every))
    seat = F.when(F.col("_to") > F.col("_from"), F.sequence("_from", F.col("_to") - 1))
    asked = rows.where(F.col(votes) > 0).select(*group, party, votes, "_left", F.explode(seat).alias("_k"))
    ranked = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col("_k"), F.col(party))
    won = asked.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= F.col("_left"))
    won = won.groupBy(*group, party).agg(F.count("*").alias("_won"))
    return (
        rows.join(won, [*group, party], "left")
        .withColumn("quota", F.col("_from") + F.coalesce("_won", F.lit(0)))
        .drop("_from", "_to", "_left", "_won")
    )


def _number(*parts: Column | str) -> Column:
    """A number of 32 bits from the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def mix(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many words the mix takes of every row.

    ``rows`` has ``key``, ``source`` and ``size`` (words). Adds ``source_size``, ``target``, ``taken`` and ``spans``, the
    places ``(first, length, times)`` of the row's words that are taken, in order.
    """
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    held = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("id"), F.col("size").cast("long").alias("size"),
        name.alias("key"), "source",
    )
    sources = held.groupBy("key", "source").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    # A row for each source; written, as every later step names it and its plan is long.
    sources = materialise(_source_seats(materialise(sources, "sources")), "seats")
    placed = materialise(_in_lines(held, sources), "lines")
    shards = materialise(_shard_blocks(placed), "shards")
    blocks = shards.where("n_blocks > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("nth")
    )
    drawn = Window.partitionBy("key", "shard").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "key", "shard", "nth")), "nth")
    extra = (F.row_number().over(drawn) <= F.col("quota") % F.col("n_blocks")).cast("long")
    at = F.col("block_from") + F.col("nth")
    cut = lambda no: F.least(no * F.col("block"), F.col("all_words"))
    blocks = blocks.select(
        "key", at.alias("block_no"), cut(at).alias("from_word"), cut(at + 1).alias("to_word"),
        (F.floor(F.col("quota") / F.col("n_blocks")) + extra).alias("times"),
    ).where("times > 0")

    in_block = lambda word: F.floor(word / F.col("block"))
    begun = shards.select("key", "shard", "block", "before")
    spans = placed.where("size > 0").drop("block").join(begun, ["key", "shard"]).withColumn("start", F.col("before") + F.col("first")).select(
        "key", "shard", "no", "start", "size",
        F.explode(F.sequence(in_block(F.col("start")), in_block(F.col("start") + F.col("size") - 1))).alias("block_no"),
    )
    begin = F.greatest(F.col("start"), F.col("from_word"))
    length = F.least(F.col("start") + F.col("size"), F.col("to_word")) - begin
    spans = spans.join(blocks, ["key", "block_no"]).select(
        "key", "shard", "no",
        F.struct((begin - F.col("start")).alias("first"), length.alias("length"), "times").alias("span"),
    )
    taken = spans.groupBy("key", "shard", "no").agg(
        F.sum(F.col("span.length") * F.col("span.times")).alias("taken"),
        F.array_sort(F.collect_list("span")).alias("spans"),
    )
    empty = F.array().cast("array<struct<first:bigint,length:bigint,times:bigint>>")
    return placed.join(taken, ["key", "shard", "no"], "left").select(
        "row.*", F.col("total").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("spans", empty).alias("spans"),
    )


def _source_seats(sources: DataFrame) -> DataFrame:
    """Targets, the length of blocks, the number of shards and the blocks to take of each source."""
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("target") / LEAST_BLOCKS)))
    sources = source_targets(sources).withColumn("block", block.cast("long"))
    sources = sources.withColumns({
        "all_of": F.lit("mix"), "votes": F.col("target") / F.col("block"),
        "limit": F.ceil(F.col("total") / F.col("block")) * MOST,
    })
    every = Window.partitionBy("all_of")
    sources = sources.withColumn("seats", F.round(F.sum("votes").over(every)).cast("long"))
    return sainte_lague(sources, ["all_of"], "key", "votes", "seats", "limit").select(
        "key", "total", "target", "block", F.ceil(F.sqrt("n")).alias("n_shards"), F.col("quota").alias("seats")
    )


def _in_lines(held: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its shard, its number there and the words before it there."""
    own = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("null")), "size")
    # A source may hold a third of all rows: its row is copied for every salt, so its documents meet it in many tasks.
    salts = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
    placed = salted.join(salts, ["key", "salt"]).select(
        "row", "id", "size", "key", "total", "target", "block", "seats",
        F.pmod(_number(F.lit("shard"), own), F.col("n_shards")).alias("shard"),
        F.md5(F.concat_ws("|", F.lit(SEED), F.lit("order"), own)).alias("place"),
    )
    line = Window.partitionBy("key", "shard").orderBy("place", "id", "size")
    sofar = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("no", F.row_number().over(line)).withColumn("first", F.sum("size").over(sofar) - F.col("size")).drop("place")


def _shard_blocks(placed: DataFrame) -> DataFrame:
    """Every shard with its place in the line of its source, the blocks that begin in it, and how many of them are taken."""
    shards = placed.groupBy("key", "shard").agg(
        F.sum("size").alias("words"), F.first("block").alias("block"), F.first("seats").alias("seats"),
    ).where("words > 0")
    source = Window.partitionBy("key")
    behind = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = shards.withColumns({
        "before": F.sum("words").over(behind) - F.col("words"), "all_words": F.sum("words").over(source),
    })
    begun = lambda word: F.floor((word + F.col("block") - 1) / F.col("block"))
    shards = shards.withColumn("block_from", begun(F.col("before")))
    shards = shards.withColumn("n_blocks", begun(F.col("before") + F.col("words")) - F.col("block_from"))
    shards = shards.withColumns({"votes": F.col("n_blocks").cast("double"), "limit": F.col("n_blocks") * MOST})
    return sainte_lague(shards, ["key"], "shard", "votes", "seats", "limit").select(
        "key", "shard", "words", "block", "before", "all_words", "block_from", "n_blocks", "quota"
    )


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each time that words of a document are taken.

    A document taken whole keeps its text; of one that is cut by the border of a block, the taken words are joined by
    spaces. Documents taken twice come twice, those not taken do not come.
    """
    words = words_of(F.col("own.text"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    held = materialise(held.select("own", F.size(words).cast("long").alias("size"), F.monotonically_increasing_id().alias("at")), "held")
    sizes = held.select(F.col("own.doc_id").alias("doc_id"), F.col("own.source").alias("source"), "size", "at")
    spans = mix(sizes).where(F.size("spans") > 0).select("at", "spans")
    mixed = held.join(spans, "at")
    for_pass = lambda p: F.filter("spans", lambda s: s["times"] >= p)
    passes = F.filter(F.array(F.lit(1), F.lit(2)), lambda p: F.exists("spans", lambda s: s["times"] >= p))
    each = mixed.withColumn("pass", F.explode(passes)).withColumn("mine", for_pass(F.col("pass")))
    n_taken = F.aggregate("mine", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    piece = F.flatten(F.transform("mine", lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["length"].cast("int"))))
    text = F.when(n_taken == F.col("size"), F.col("own.text")).otherwise(F.array_join(piece, " "))
    new = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("bigint")}
    return each.withColumn("mixed_text", text).select(*[new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns])


_NAME = "coalesce('s' || source, 'null')"
_OWN = "coalesce(doc_id::VARCHAR, 'null') || '|' || size"
_SQL = f"""
WITH d AS (
  SELECT doc_id, source, {_NAME} AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s0 AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS total, count(*) AS n FROM d GROUP BY key),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s0),
-- the level of words for each weight at which all targets sum to the share
lv AS (
  SELECT arg_min(l, cap) AS level FROM (
    SELECT a.total * 2 / a.w AS cap,
           (1.5 * (SELECT sum(total) FROM s1) - sum(CASE WHEN b.total * 2 * a.w < a.total * 2 * b.w THEN b.total * 2 ELSE 0 END))
           / sum(CASE WHEN b.total * 2 * a.w < a.total * 2 * b.w THEN 0 ELSE b.w END) AS l
    FROM s1 a, s1 b GROUP BY a.key, a.total, a.w) WHERE l < cap),
s2 AS (SELECT *, CASE WHEN total * 2 / w <= (SELECT level FROM lv) THEN (total * 2)::DOUBLE ELSE (SELECT level FROM lv) * w END
       AS target FROM s1),
s3 AS (SELECT *, greatest(1, least({BLOCK_WORDS}, floor(target / {LEAST_BLOCKS})))::BIGINT AS block FROM s2),
s4 AS (SELECT *, target / block AS votes, ceil(total / block)::BIGINT * 2 AS cap FROM s3),
sq AS (SELECT key, votes / (2 * k + 1) AS q, k FROM (SELECT key, votes, unnest(range(cap)) AS k FROM s4 WHERE votes > 0)),
sw AS (SELECT key, count(*) AS seats FROM (
         SELECT key, row_number() OVER (ORDER BY q DESC, k, key) AS r FROM sq)
       WHERE r <= (SELECT round(sum(votes)) FROM s4) GROUP BY key),
p AS (SELECT d.*, s4.total, s4.target, s4.block, coalesce(sw.seats, 0) AS seats,
        ('0x' || substr(md5('{SEED}|shard|' || {_OWN}), 1, 8))::BIGINT % ceil(sqrt(n))::BIGINT AS shard,
        md5('{SEED}|order|' || {_OWN}) AS place
      FROM d JOIN s4 USING (key) LEFT JOIN sw USING (key)),
l AS (SELECT *, (sum(size) OVER (PARTITION BY key, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT
        AS first FROM p),
h AS (SELECT key, shard, sum(size)::BIGINT AS words, any_value(block) AS block, any_value(seats) AS seats
      FROM l GROUP BY key, shard HAVING sum(size) > 0),
-- the shards of a source in one line, and the blocks that begin in each
h0 AS (SELECT *, (sum(words) OVER (PARTITION BY key ORDER BY shard ROWS UNBOUNDED PRECEDING) - words)::BIGINT AS before,
         (sum(words) OVER (PARTITION BY key))::BIGINT AS line FROM h),
h1 AS (SELECT *, (before + block - 1) // block AS bf, (before + words + block - 1) // block - (before + block - 1) // block AS nb FROM h0),
hq AS (SELECT key, shard, seats, nb::DOUBLE / (2 * k + 1) AS q, k
       FROM (SELECT *, unnest(range(2 * nb)) AS k FROM h1)),
hw AS (SELECT key, shard, count(*) AS quota FROM (
         SELECT *, row_number() OVER (PARTITION BY key ORDER BY q DESC, k, shard) AS r FROM hq)
       WHERE r <= seats GROUP BY key, shard),
h2 AS (SELECT h1.*, coalesce(quota, 0) AS quota FROM h1 LEFT JOIN hw USING (key, shard)),
b AS (SELECT key, (bf + j) * block AS b0, least((bf + j + 1) * block, line) AS b1,
        quota // nb + CASE WHEN row_number() OVER (PARTITION BY key, shard
          ORDER BY md5('{SEED}|' || key || '|' || shard || '|' || j), j) <= quota % nb THEN 1 ELSE 0 END AS times
      FROM (SELECT *, unnest(range(nb)) AS j FROM h2)),
ls AS (SELECT l.*, h0.before + l.first AS start FROM l JOIN h0 USING (key, shard) WHERE l.size > 0),
t AS (SELECT ls.doc_id, ls.key, ls.shard, ls.first,
        sum((least(ls.start + ls.size, b.b1) - greatest(ls.start, b.b0)) * b.times)::BIGINT AS taken
      FROM ls JOIN b ON ls.key = b.key AND b.b0 < ls.start + ls.size AND b.b1 > ls.start GROUP BY ALL)
SELECT l.doc_id, l.size, l.total AS source_size, l.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM l LEFT JOIN t ON l.size > 0 AND l.doc_id IS NOT DISTINCT FROM t.doc_id AND l.key = t.key AND l.shard = t.shard
  AND l.first = t.first
"""


@query("op2_mix_by_quotients", _SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))
    return mix(materialise(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken")
