"""Mixing sources to target weights, native DataFrame operations only.

Method: the words of each source, its documents in a fixed order, are packed into
blocks of BLOCK words. The mix is dealt over shards of about SHARD slots. Every
shard draws how many slots each source gets: the whole part of its expected count
plus a multinomial draw of the rest. A source's slots, numbered through all
shards, go through its own pseudorandom permutation of block numbers (swap-or-not
rounds keyed by an md5), so a block comes again only after all others of its
source have come. Slots join blocks by number.

Only (doc_id, source, size) leave the scan; all joins and windows are over these
narrow rows. Offsets of documents are hierarchical prefix sums over buckets of a
few thousand rows, so a source with a third of all rows is never one group.
Tables of one row per source are ordered in one task; their size is the number of
distinct sources.

Defined results: null text has size 0; null source is a source, after all others;
repeated rows are packed one after another and share what they got evenly by
place; documents without words are returned with taken 0; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import shuffle_partitions, written

WORD_GAP = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 64
SHARD = 1024
ROUNDS = 12
BUCKET_ROWS = 1024


def _number(key: Column) -> Column:
    """The first 8 hex digits of an md5 as a number below 2**32."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1)
    outer = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - outer).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, source_no, n_blocks, target: shares by weight, levelled until none is above ``cap`` times its size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = s.select("*", w.alias("w"), (F.col("source_size") * cap).cast("double").alias("most"))
    level = Window.orderBy(F.col("most") / F.col("w"), "source_no")
    everything = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("most_before"),
        F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("w_from"),
    )
    s = s.withColumn("full", F.col("most_before") + F.col("most") / F.col("w") * F.col("w_from") <= F.col("total"))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0))
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("total") - used) / rest_w * F.col("w"))
    return s.select("source", "source_size", F.col("source_no").cast("long").alias("source_no"), F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("long").alias("n_blocks"), target.alias("target"))


def _placed(sizes: DataFrame) -> DataFrame:
    """Each row of ``sizes`` with ``at``: the words of its source before it."""
    rows = sizes.count()
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    b = sizes.withColumn("bucket", _number(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % buckets)
    parts = b.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # a null source joins its own buckets; bucket starts are as many as rows / BUCKET_ROWS for each source
    same = b["source"].eqNullSafe(starts["source"]) & (b["bucket"] == starts["bucket"])
    return b.join(starts, same).select(*[b[c] for c in sizes.columns], (starts["start"] + b["inner"]).alias("at"))


def _slots(sources: DataFrame, keys: Column) -> DataFrame:
    """source_no, n_blocks, keys, k: the numbered slots that the shards' draws give each source."""
    spark = sources.sparkSession
    want = F.col("n_blocks") * F.col("target") / F.col("source_size")
    s = sources.filter("source_size > 0 AND target > 0").withColumn("want", want)
    everything = Window.partitionBy()
    s = s.withColumn("all_slots", F.sum("want").over(everything))
    total = s.agg(F.max("all_slots")).first()[0] or 0.0
    slots = int(math.floor(total + 0.5))
    if slots == 0:
        return spark.createDataFrame([], "source_no long, n_blocks long, keys array<struct<r:int,key:long>>, k long")
    shards = max(1, slots // SHARD)
    each = slots / shards
    # the whole part of a shard's expected count, and the rest that is drawn
    s = s.withColumn("whole", F.floor(F.col("want") / F.col("all_slots") * F.lit(each)).cast("long"))
    s = s.withColumn("part", F.col("want") / F.col("all_slots") * F.lit(each) - F.col("whole"))
    so_far = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("upto", F.sum("part").over(so_far)).withColumn("parts", F.sum("part").over(everything)).withColumn("wholes", F.sum("whole").over(everything))
    s = s.withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("source_no")), F.lit(0.0)))
    s = written(s.select("source_no", "n_blocks", "whole", "wholes", "from", "upto", "parts"), "mix-sources")

    shard = spark.range(shards).select(F.col("id").alias("shard"), (F.floor((F.col("id") + 1) * F.lit(slots) / F.lit(shards)) - F.floor(F.col("id") * F.lit(slots) / F.lit(shards))).cast("long").alias("slots"))
    wholes, parts = s.agg(F.max("wholes"), F.max("parts")).first()
    draws = shard.filter(F.col("slots") > wholes).select("shard", F.explode(F.sequence(F.lit(1), F.col("slots") - F.lit(wholes))).alias("draw"))
    at = _number(F.concat_ws(":", F.lit("draw"), "shard", "draw")) / F.lit(4294967296.0) * F.lit(parts)
    draws = draws.withColumn("u", at).withColumn("cell", F.floor(F.col("u")))
    cells = s.select("source_no", "from", "upto", F.explode(F.sequence(F.floor("from"), F.floor("upto"))).alias("cell"))
    hit = draws.join(cells, "cell").filter("`from` <= u AND u < upto")
    extra = hit.groupBy("source_no").agg(F.count("*").alias("extra"))
    # counts of one source over shards follow one another, so its slots are numbered 0 .. whole*shards+extra-1
    counts = s.join(extra, "source_no", "left").select("source_no", "n_blocks", F.least(F.col("whole") * shards + F.coalesce("extra", F.lit(0)), F.col("n_blocks") * CAP).alias("n"))
    chunk = 4096
    ranges = counts.filter("n > 0").select("source_no", "n_blocks", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    ranges = ranges.repartition(shuffle_partitions(spark), "source_no", "c").withColumn("keys", keys)
    return ranges.select("source_no", "n_blocks", "keys", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk) - 1)).alias("k"))


def block_takes(sources: DataFrame) -> DataFrame:
    """source_no, block, times: how often each block is in the mix (blocks that aren't don't appear).

    The permutation is a bijection of [0, n_blocks): in each round x and key - x are swapped or not by one bit of an md5 of the larger.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(r.alias("r"), (_number(F.concat_ws(":", F.concat(F.lit("key"), r), "source_no")) % F.col("n_blocks")).alias("key")))

    def swapped(x: Column, round_: Column) -> Column:
        other = (round_["key"] - x + F.col("n_blocks")) % F.col("n_blocks")
        bit = F.substring(F.md5(F.concat_ws(":", F.concat(F.lit("bit"), round_["r"]), "source_no", F.greatest(x, other))), 1, 1) < "8"
        return F.when(bit, other).otherwise(x)

    slots = _slots(sources, keys).withColumn("x", F.aggregate("keys", F.col("k") % F.col("n_blocks"), swapped))
    return slots.groupBy("source_no", F.col("x").alias("block")).agg(F.count("*").alias("times"))


def mix(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, size, ...): those rows with source_no, source_size, target and ``at``, and what the mix takes of
    them: source_no, at, skip (words of the row before the piece), words, times."""
    sources = written(source_targets(sizes), "mix-targets")
    placed = _placed(sizes)
    rows = placed.join(sources.withColumnRenamed("source", "of"), placed["source"].eqNullSafe(F.col("of"))).drop("of", "n_blocks")
    rows = written(rows, "mix-rows")
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    cover = rows.filter("size > 0").select("source_no", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * BLOCK)
    stop = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    pieces = cover.join(block_takes(sources), ["source_no", "block"])
    return rows, pieces.select("source_no", "at", (start - F.col("at")).alias("skip"), (stop - start).alias("words"), "times")


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows, pieces = mix(sizes)
    got = pieces.groupBy("source_no", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = rows.withColumn("place", F.when(F.col("size") > 0, F.col("at")))  # rows without words share a place and take nothing
    got = got.withColumnRenamed("at", "place")
    taken = F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken")
    return rows.join(got, ["source_no", "place"], "left").select("doc_id", "size", "source_size", "target", taken)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The documents as the mix holds them, in the columns of ``docs``: each text is cut to the words taken, a second helping
    follows on a new line, and documents of which nothing is taken go. n_chars is that of the new text."""
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("row_hash"), word_count(F.col("text")).alias("size"))
    # copies are numbered on ids and hashes; among themselves they are told apart by source only
    copy = F.row_number().over(Window.partitionBy("doc_id", "row_hash").orderBy("source"))
    sizes = keyed.select("doc_id", "source", "row_hash", "size").withColumn("dup", copy)
    rows, pieces = mix(written(sizes, "mix-sizes"))
    piece = F.struct("skip", "words", "times")
    got = pieces.groupBy("source_no", "at").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("words").alias("once"), F.sum(F.when(F.col("times") > 1, F.col("words")).otherwise(0)).alias("twice"))
    got = rows.filter("size > 0").join(got, ["source_no", "at"]).select(F.col("doc_id").alias("of_id"), F.col("row_hash").alias("of_hash"), F.col("dup").alias("of_dup"), "pieces", "once", "twice")
    keyed = keyed.select("row", "doc_id", "row_hash", "size", copy.alias("dup"))
    both = keyed.join(got, keyed["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("row_hash") == F.col("of_hash")) & (F.col("dup") == F.col("of_dup")))
    old = F.col("row")["text"]

    def taken(words: Column) -> Column:
        def helping(n: int, got_words: Column) -> Column:
            some = F.filter("pieces", lambda p: p["times"] >= n)
            cut = F.array_join(F.flatten(F.transform(some, lambda p: F.slice(words, (p["skip"] + 1).cast("int"), p["words"].cast("int")))), " ")
            return F.when(got_words == F.col("size"), old).otherwise(cut)

        return F.when(F.col("twice") > 0, F.concat_ws("\n", helping(1, F.col("once")), helping(2, F.col("twice")))).otherwise(helping(1, F.col("once")))

    # the words stand in an array of one, whose only element is bound once, so a text isn't split again for each of its pieces
    words = F.filter(F.split(old, WORD_GAP, -1), lambda x: x != "")
    out = both.select("row", F.get(F.transform(F.array(words), taken), 0).alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def _oracle() -> str:
    number = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    rounds, last = [], "slots"
    for r in range(ROUNDS):
        key = number(f"'key{r}:' || source_no") + " % n_blocks"
        bit = f"substr(md5('bit{r}:' || source_no || ':' || greatest(x, (key - x + n_blocks) % n_blocks)), 1, 1) < '8'"
        rounds.append(f"r{r} AS (SELECT source_no, n_blocks, CASE WHEN {bit} THEN (key - x + n_blocks) % n_blocks ELSE x END AS x FROM (SELECT *, {key} AS key FROM {last}))")
        last = f"r{r}"
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM s0),
s2 AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, ({CAP} * source_size)::DOUBLE AS most FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () * {SHARE})::DOUBLE AS total,
         coalesce(sum(most) OVER (ORDER BY most / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
         sum(w) OVER (ORDER BY most / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM s2),
s4 AS (SELECT *, most_before + most / w * w_from <= total AS filled FROM s3),
s5 AS (SELECT *, coalesce(sum(most) FILTER (filled) OVER (), 0) AS used, sum(w) FILTER (NOT filled) OVER () AS rest_w FROM s4),
sources AS (SELECT source, source_size, source_no, CASE WHEN filled THEN most ELSE (total - used) / rest_w * w END AS target,
              ceil(source_size / {BLOCK}.0)::BIGINT AS n_blocks FROM s5),
buckets AS (SELECT *, {number("doc_id::VARCHAR")} % (SELECT greatest(1, ceil(count(*) / {BUCKET_ROWS}.0))::BIGINT FROM sizes) AS bucket FROM sizes),
rows_ AS (SELECT b.doc_id, b.size, s.source_no, s.source_size, s.target,
            coalesce(sum(b.size) OVER (PARTITION BY s.source_no ORDER BY b.bucket, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
          FROM buckets b JOIN sources s ON b.source IS NOT DISTINCT FROM s.source),
w1 AS (SELECT *, n_blocks * target / source_size AS want FROM sources WHERE source_size > 0),
w2 AS (SELECT *, sum(want) OVER () AS all_slots FROM w1),
n AS (SELECT floor(max(all_slots) + 0.5)::BIGINT AS slots, greatest(1, floor(max(all_slots) + 0.5)::BIGINT // {SHARD}) AS shards FROM w2),
w3 AS (SELECT w2.*, n.slots, n.shards, floor(want / all_slots * (n.slots / n.shards))::BIGINT AS whole,
         want / all_slots * (n.slots / n.shards) - floor(want / all_slots * (n.slots / n.shards)) AS part FROM w2, n),
w4 AS (SELECT *, sum(part) OVER (ORDER BY source_no ROWS UNBOUNDED PRECEDING) AS upto, sum(part) OVER () AS parts, sum(whole) OVER () AS wholes FROM w3),
w5 AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY source_no), 0) AS lower FROM w4),
shards AS (SELECT i AS shard, (floor((i + 1) * n.slots / n.shards) - floor(i * n.slots / n.shards))::BIGINT AS slots FROM n, range(n.shards) t(i)),
draws AS (SELECT shard, unnest(range(1, 1 + greatest(0, slots - (SELECT max(wholes) FROM w5)::BIGINT))) AS draw FROM shards),
drawn AS (SELECT {number("'draw:' || shard || ':' || draw")} / 4294967296.0 * (SELECT max(parts) FROM w5) AS u FROM draws),
extra AS (SELECT source_no, count(*) AS extra FROM drawn JOIN w5 ON lower <= u AND u < upto GROUP BY source_no),
counts AS (SELECT w5.source_no, n_blocks, least(whole * shards + coalesce(extra, 0), n_blocks * {CAP})::BIGINT AS n FROM w5 LEFT JOIN extra USING (source_no)),
slots AS (SELECT source_no, n_blocks, k % n_blocks AS x FROM (SELECT source_no, n_blocks, unnest(range(n)) AS k FROM counts)),
{", ".join(rounds)},
takes AS (SELECT source_no, x AS block, count(*) AS times FROM {last} GROUP BY ALL),
cover AS (SELECT source_no, off, size, unnest(range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1)) AS block FROM rows_ WHERE size > 0),
got AS (SELECT source_no, off, sum((least(off + size, (block + 1) * {BLOCK}) - greatest(off, block * {BLOCK})) * times)::BIGINT AS taken
        FROM cover JOIN takes USING (source_no, block) GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, CASE WHEN r.size > 0 THEN coalesce(g.taken, 0) ELSE 0 END AS taken
FROM rows_ r LEFT JOIN got g ON r.source_no = g.source_no AND r.off = g.off AND r.size > 0"""


ORACLE = _oracle()
