"""Queries over parsed pages. SQL has no HTML parser: tests hold the blocks against literal pages, and what can be said of them in SQL is."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.operators import trees
from foliograph.sources import blocks
from foliograph.workspace import table


def _blocks(spark, d):
    return blocks.html_blocks(table(spark, d, "pages"))


def html_blocks(spark, d):
    return _blocks(spark, d).select("page_id", "seq", F.array_join("path", ".").alias("path"), "kind", "level", "text")


def block_kinds(spark, d):
    return _blocks(spark, d).groupBy("kind").agg(F.count("*").alias("n_blocks"), F.count_distinct("page_id").alias("n_pages"))


def block_titles(spark, d):
    return trees.titles(_blocks(spark, d))


def html_to_mdx(spark, d):
    m = trees.to_mdx(_blocks(spark, d).filter("kind <> 'title'"))
    return m.select("page_id", F.length("mdx").cast("long").alias("n_chars"), F.sha2("mdx", 256).alias("mdx_sha256"))


def markdown_round_trip(spark, d):
    """Documents parsed as Markdown, written out and parsed again: whether the second parse gives the texts of the first."""
    first = blocks.markdown_blocks(table(spark, d, "documents"), "doc_id", "text").filter("kind IN ('paragraph', 'heading', 'code')")
    again = blocks.markdown_blocks(trees.to_mdx(first), "page_id", "mdx")
    h = lambda b: b.groupBy("page_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("ks"))
    a, b = h(first), h(again).select("page_id", F.col("n").alias("m"))
    return a.join(b, "page_id").groupBy((F.col("n") == F.col("m")).alias("same")).agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (html_blocks, block_kinds, block_titles, html_to_mdx, markdown_round_trip)}
ORACLES = {
    "block_titles": r"""SELECT page_id::VARCHAR AS page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS title FROM (
      SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM pages) WHERE h <> ''"""
}
