"""Tables of contents: numbers of nested entries in reading order, and what an entry of another table says of each.

A tree is walked by its Euler tour: every node is entered and left, and every such event
knows the next one from the node's children and siblings alone. Events then add up what
lies ahead of them by jumping, each round twice as far, so the number of rounds is the
logarithm of the longest tour, however deep or unbalanced a tree is, and no task follows
a tree from end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.workspace import written

#: A link that stands for no page.
HEADING = "___"


def _events(nodes: DataFrame) -> DataFrame:
    """event, next (null at a tour's end), toc, node, leaves, enters, depth: weights of each event."""
    key = lambda node, leaves: F.xxhash64("toc", node, F.lit(leaves))
    n = nodes.select("toc", "node", "parent", "ord")
    among = Window.partitionBy("toc", "parent").orderBy("ord", "node")
    n = n.withColumn("sibling", F.lead("node").over(among))
    first = n.groupBy("toc", "parent").agg(F.min_by("node", F.struct("ord", "node")).alias("child")).withColumnRenamed("parent", "node")
    n = n.join(first, ["toc", "node"], "left")
    after_enter = F.when(F.col("child").isNotNull(), key(F.col("child"), False)).otherwise(key(F.col("node"), True))
    after_leave = F.when(F.col("sibling").isNotNull(), key(F.col("sibling"), False)).when(F.col("parent").isNotNull(), key(F.col("parent"), True))
    enter = F.struct(key(F.col("node"), False).alias("event"), after_enter.alias("next"), F.lit(False).alias("leaves"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("depth"))
    leave = F.struct(key(F.col("node"), True).alias("event"), after_leave.alias("next"), F.lit(True).alias("leaves"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("depth"))
    return n.select("toc", "node", F.explode(F.array(enter, leave)).alias("e")).select("e.event", "e.next", "toc", "node", "e.leaves", "e.enters", "e.depth")


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes (toc, node, parent, ord) with ``pre`` (from 0, in reading order in its toc), ``size`` (itself and all beneath) and ``depth``
    (0 at the top); all null for nodes no top reaches, as their parents are missing or form a cycle. Nodes are unique in a toc."""
    e = written(_events(nodes), "tour")
    rounds = max(1, e.count()).bit_length() + 1
    for _ in range(rounds):
        if not e.filter("next IS NOT NULL").take(1):
            break
        ahead = e.select(F.col("event").alias("next"), F.col("next").alias("then"), F.col("enters").alias("more"), F.col("depth").alias("deeper"))
        moving = e.filter("next IS NOT NULL").join(ahead, "next", "left")
        # a parent that isn't there has no event: what hangs beneath never ends
        moving = moving.select("event", F.when(F.col("more").isNull(), F.col("next")).otherwise(F.col("then")).alias("next"), "toc", "node", "leaves", (F.col("enters") + F.coalesce("more", F.lit(0))).alias("enters"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"))
        e = written(e.filter("next IS NULL").unionByName(moving), "tour")
    ended = e.filter("next IS NULL")
    # what lies ahead of the first event is everything
    total = ended.groupBy("toc").agg(F.max("enters").alias("total"))
    enter = ended.filter("NOT leaves").select("toc", "node", "enters", (-F.col("depth")).alias("depth"))
    leave = ended.filter("leaves").select("toc", "node", F.col("enters").alias("behind"))
    got = enter.join(leave, ["toc", "node"]).join(total, "toc")
    got = got.select("toc", "node", (F.col("total") - F.col("enters")).alias("pre"), (F.col("enters") - F.col("behind")).alias("size"), F.col("depth").cast("int").alias("depth"))
    return nodes.join(got, ["toc", "node"], "left")


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """toc, index, link, title, bookmark of chunks (toc, chunk, link, i, t, b): of a link's parallel arrays each place is an entry; of several
    for one index the last in the order of chunk, link and place."""
    texts = [F.coalesce(c, F.array().cast("array<string>")).alias(name) for c, name in (("t", "title"), ("b", "bookmark"))]
    e = chunks.select("toc", "chunk", "link", F.posexplode(F.arrays_zip(F.col("i").alias("index"), *texts)).alias("place", "x"))
    e = e.filter("x.index IS NOT NULL")
    one = F.struct("link", F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.bookmark", F.lit("")).alias("bookmark"))
    return e.groupBy("toc", F.col("x.index").alias("index")).agg(F.max_by(one, F.struct("chunk", "link", "place")).alias("e")).select("toc", "index", "e.*")


def entry_address(link: Column, bookmark: Column) -> Column:
    """The link without leading slashes, with its bookmark unless it names a place already; null for headings."""
    mark = F.when((bookmark != "") & ~link.contains("#"), F.concat(F.lit("#"), F.regexp_replace(bookmark, "^#", ""))).otherwise("")
    return F.when((link != "") & (link != HEADING), F.concat(F.regexp_replace(link, "^/+", ""), mark))


def drawn(nodes: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a table of contents shows: (toc, node, place, depth, kind, label, url), and its problems (toc, node, problem).

    nodes: toc, node, parent, ord, index; entries: toc, index, link, title, bookmark. A node without an entry is ``unresolved`` and goes
    with all beneath; one no top reaches is ``unreached``. A node with something beneath that is shown is a group named by its title,
    a page only if it has an address; what shows nothing is left out. Places count what is shown, from 0."""
    n = numbered(nodes).join(entries, ["toc", "index"], "left").withColumn("url", entry_address(F.col("link"), F.col("bookmark")))
    in_order = Window.partitionBy("toc").orderBy("pre")
    gone_upto = F.max(F.when(F.col("link").isNull(), F.col("pre") + F.col("size")))
    above = gone_upto.over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    reached = n.filter("pre IS NOT NULL").withColumn("covered", F.coalesce(above > F.col("pre"), F.lit(False)))
    reached = written(reached.withColumn("shown", ~F.col("covered") & F.col("url").isNotNull()), "toc")
    unresolved = reached.filter("link IS NULL AND NOT covered").select("toc", "node", F.lit("unresolved").alias("problem"))
    problems = unresolved.union(n.filter("pre IS NULL").select("toc", "node", F.lit("unreached")))
    # pages up to a node's last descendant less those ahead of it are those beneath it
    upto = F.sum(F.col("shown").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    counted = reached.withColumn("upto", upto)
    last = counted.select("toc", (F.col("pre")).alias("last"), F.col("upto").alias("at_last"))
    counted = counted.withColumn("last", F.col("pre") + F.col("size") - 1).join(last, ["toc", "last"])
    beneath = F.col("at_last") - F.col("upto")
    kept = counted.filter(~F.col("covered") & F.col("link").isNotNull() & ((beneath > 0) | F.col("shown")))
    is_group = beneath > 0
    label = F.when(is_group & (F.coalesce("title", F.lit("")) == ""), "Untitled").otherwise(F.nullif("title", F.lit("")))
    shown = kept.select("toc", "node", (F.row_number().over(in_order) - 1).alias("place"), "depth", F.when(is_group, "group").otherwise("page").alias("kind"), label.alias("label"), "url")
    return shown, problems
