"""API descriptions: references between documents, their closure, and whether pages' operations exist."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import written

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def references(documents: DataFrame) -> DataFrame:
    """document, target, pointer: $ref values of JSON or YAML documents (document, body); the target of a local one is its document."""
    raw = F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"""["']?\$ref["']?\s*:\s*["']([^"'\n]+)["']"""), F.lit(1)))
    r = documents.select("document", raw.alias("ref"))
    file = F.regexp_extract("ref", "^([^#]*)", 1)
    beside = F.concat(F.regexp_replace("document", "[^/]*$", ""), F.regexp_replace(file, r"^\./", ""))
    up = F.regexp_replace(beside, r"[^/]+/\.\./", "")
    target = F.when(file == "", F.col("document")).when(file.rlike("^[a-z]+://"), file).otherwise(up)
    return r.select("document", target.alias("target"), F.regexp_extract("ref", "#(.*)$", 1).alias("pointer")).distinct()


#: Levels are united into one table whenever so many have been written since the last time.
_LEVELS = 4
#: A level of no more documents is sent to the edges; larger ones meet them in a shuffle, whatever their files' size.
_SENT = 65_536


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """document, depth: what roots (document) reach over edges (document, target), each once at its smallest depth.

    A level is one join and one write. What has been seen is kept as few tables: when the latest levels have grown to half of what
    was seen before, or are many, all become one, so a level reads what was seen once and not a table for each level before. Edges
    to what is seen already are found by their target, so a document with many references to it is met by its key alone. What is sent
    through the driver doesn't grow with the tables: levels of at most ``_SENT`` documents, once each."""
    step = written(edges.filter("document <> target").select("document", "target").distinct(), "closure")
    base = written(roots.select("document").distinct().withColumn("depth", F.lit(0)), "closure")
    n_base = n_level = base.count()
    level, late, n_late = base, [], 0
    for depth in count(1):
        few = n_level <= _SENT
        reached = step.join(F.broadcast(level.select("document")) if few else level.select("document").hint("merge"), "document").select(F.col("target").alias("document")).distinct()
        seen = base
        for part in late:
            seen = seen.union(part)
        level = written(reached.join(seen.select("document").hint("merge"), "document", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        n_level = level.count()
        if not n_level:
            return seen
        late, n_late = [*late, level], n_late + n_level
        if len(late) >= _LEVELS and (2 * n_late >= n_base or len(late) >= 4 * _LEVELS):
            base, n_base, late, n_late = written(seen.union(level), "closure"), n_base + n_late, [], 0


def unresolved(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges to documents that there are not; addresses on the network are left alone."""
    inside = edges.filter(~F.col("target").rlike("^[a-z]+://"))
    return inside.join(documents.select(F.col("document").alias("target")), "target", "left_anti").select("document", "target", "pointer")


def operations(documents: DataFrame) -> DataFrame:
    """document, path, method, operation_id of JSON descriptions (document, body), read as a variant."""
    paths = documents.select("document", F.expr("try_parse_json(body)").alias("v")).filter("v IS NOT NULL")
    p = paths.select("document", F.explode(F.expr("cast(try_variant_get(v, '$.paths', 'map<string,variant>') AS map<string,variant>)")).alias("path", "item"))
    o = p.select("document", "path", F.explode(F.expr("try_variant_get(item, '$', 'map<string,variant>')")).alias("method", "op"))
    o = o.filter(F.lower("method").isin(*METHODS))
    return o.select("document", "path", F.lower("method").alias("method"), F.expr("try_variant_get(op, '$.operationId', 'string')").alias("operation_id"))


def duplicate_ids(operations_: DataFrame) -> DataFrame:
    return operations_.filter("operation_id IS NOT NULL").groupBy("document", "operation_id").agg(F.count("*").alias("n")).filter("n > 1")


def unbound(pages: DataFrame, operations_: DataFrame) -> DataFrame:
    """page_id, document, method, path, reason of pages whose stated operation no description has."""
    o = operations_.select("document", "path", "method", F.lit(True).alias("found")).distinct()
    d = operations_.select("document", F.lit(True).alias("known")).distinct()
    p = pages.withColumn("method", F.lower("method")).join(d, "document", "left").join(o, ["document", "path", "method"], "left")
    reason = F.when(F.col("known").isNull(), "no such description").when(F.col("found").isNull(), "no such operation")
    return p.select("page_id", "document", "method", "path", reason.alias("reason")).filter("reason IS NOT NULL")


def parameter_anchors(links: DataFrame, anchors: DataFrame, places: tuple[str, ...] = ("path", "query", "header", "body")) -> DataFrame:
    """links (page_id, fragment) of the form param-x with ``anchor``: the first of path-x, query-x, header-x and body-x that the page has."""
    l = links.withColumn("name", F.regexp_extract("fragment", "^param-(.+)$", 1)).filter("name <> ''")
    c = l.select("page_id", "fragment", F.posexplode(F.array(*[F.concat(F.lit(f"{p}-"), "name") for p in places])).alias("n", "anchor"))
    hit = c.join(anchors.select("page_id", "anchor").distinct(), ["page_id", "anchor"]).groupBy("page_id", "fragment").agg(F.min_by("anchor", "n").alias("anchor"))
    return l.drop("name").join(hit, ["page_id", "fragment"], "left")


def merged_fragments(fragments: DataFrame) -> DataFrame:
    """spec, key, value of fragments (spec, path, method, key, value): the first by path and method wins for each key."""
    return fragments.groupBy("spec", "key").agg(F.min_by("value", F.struct("path", "method")).alias("value"))
