"""Queries over documents, conversations, labels and benchmark: prose, passages, secrets, duplicates, lines and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import text
from foliograph.operators import order, passages, reconcile, sites
from foliograph.plans.page_queries import sql_prose, sql_slug
from foliograph.workspace import table


def docs(spark, d):
    return table(spark, d, "documents")


def content_dedupe(spark, d):
    return reconcile.duplicates(docs(spark, d), F.col("text"), "doc_id").filter("n > 1")


def prose_segments(spark, d):
    """Segments of 12 characters or more of each document's lines, normalised."""
    s = passages.segments(docs(spark, d), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("segment").cast("long")).alias("n_chars"))


def prose_missing(spark, d):
    """Segments of documents that a copy lacks in which every tenth document lost its first 200 characters."""
    source = docs(spark, d)
    copy = source.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.expr("substring(text, 201)")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    m = passages.missing_segments(passages.segments(source, "doc_id", "text"), copy, "doc_id", "text")
    return m.select("doc_id", "pos", F.sha2("segment", 256).alias("segment_sha256"))


def benchmark_passage_presence(spark, d):
    """Documents that hold a whole benchmark passage, word for word."""
    return passages.holders(docs(spark, d), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def passage_presence(spark, d):
    """How much of its first line, respelled or altered, each document still has."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    altered = F.when(F.col("doc_id") % 3 == 0, F.replace(line, F.lit(" "), F.lit(" - "))).when(F.col("doc_id") % 3 == 1, F.concat(F.substring(line, 1, 40), F.lit(" zzz "), F.expr("substring(split(text, '\n')[0], 41)"))).otherwise(line)
    return docs(spark, d).select("doc_id", text.presence(altered, F.col("text"), F.col("doc_id") % 2 == 0).alias("presence"))


def redact_documents(spark, d):
    r = text.redacted(F.col("text"))
    return docs(spark, d).filter(text.looks_secret(F.col("text"))).select("doc_id", F.sha2(r, 256).alias("redacted_sha256"), (F.length("text") - F.length(r)).cast("long").alias("n_removed"))


def looks_secret(spark, d):
    c = table(spark, d, "conversations")
    return docs(spark, d).select(F.lit("documents").alias("kind"), F.col("source").alias("part"), "text").union(c.select(F.lit("conversations"), "role", "text")).groupBy("kind", "part").agg(F.count("*").alias("n"), F.count_if(text.looks_secret(F.col("text"))).alias("n_secret"))


def slug_documents(spark, d):
    first = F.substring_index(F.col("text"), "\n", 1)
    return docs(spark, d).select("doc_id", text.slug(first).alias("slug"), text.slug_erased(first).alias("erased"))


def majority_locale(spark, d):
    return sites.majority(docs(spark, d), "source", "lang")


def canonical_hash(spark, d):
    """One hash for each source's documents, whatever order they come in."""
    return reconcile.merkle_hash(docs(spark, d).withColumn("sha256", F.sha2("text", 256)), "source", "doc_id", "sha256")


def adjacent_merge(spark, d):
    """Turns of a conversation whose lengths fall in the same class of 400 characters, merged while adjacent."""
    c = table(spark, d, "conversations").withColumn("size", F.floor(F.length("text") / 400).cast("long"))
    return order.merged_runs(c, ["conv_id"], "turn", ["size"], "text").select("conv_id", F.col("run").cast("long").alias("run"), "size", "first_at", "n", F.sha2("text", 256).alias("text_sha256"))


def fence_state(spark, d):
    """Lines inside fences, where every document's second and fourth line are given fences."""
    lines = order.lines_of(docs(spark, d), "doc_id", "text")
    lines = lines.withColumn("line", F.when(F.col("line_no") == 1, "```text").when(F.col("line_no") == 3, "```").otherwise(F.col("line")))
    f = order.fence_states(lines, "doc_id")
    return f.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("fenced").alias("n_fenced"))


def repeated_turns(spark, d):
    """Turns equal to the turn before them."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("before", before).filter("text = before").select("conv_id", "turn")


def last_speaker(spark, d):
    """Each turn with the last turn of a user at or before it."""
    c = table(spark, d, "conversations")
    return order.carried(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "user_turn").select("conv_id", "turn", "user_turn")


def first_turns(spark, d):
    c = table(spark, d, "conversations")
    f = reconcile.first_of_each(c.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])
    return f.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"))


def labels_quality_by_source(spark, d):
    """Labels by source; sources are few, so counts meet, and labels join documents by id."""
    both = docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("n_quality"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))


def conflicting_lines(spark, d):
    """Sources whose documents are in several languages, with those."""
    return reconcile.conflicting(docs(spark, d), ["source"], ["lang"])


def markdown_text(spark, d):
    t = text.markdown_text(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (
    content_dedupe, prose_segments, prose_missing, benchmark_passage_presence, passage_presence, redact_documents, looks_secret, slug_documents, majority_locale, canonical_hash, adjacent_merge,
    fence_state, repeated_turns, last_speaker, first_turns, labels_quality_by_source, conflicting_lines, markdown_text)}


def _re(p: str) -> str:
    return p.replace("'", "''")


_SECRET = "|".join(f"(?:{_re(p)})" for _, p in text.SECRETS)


def _sql_redacted(x: str) -> str:
    for name, p in text.SECRETS:
        x = f"regexp_replace({x}, '{_re(p)}', '[redacted:{name}]', 'g')"
    return x


def _sql_skeleton(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '&#?[A-Za-z0-9]+;', '', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def _sql_markdown(x: str) -> str:
    from foliograph.plans.page_queries import sql_entities

    for pattern, by in ((r"(?s)^---\r?\n.*?\r?\n---\r?\n", ""), (r"(?m)^(import|export) .*$", ""), (r"(?s)\{/\*.*?\*/\}", ""), (r"(?m)^[ \t]*(```|~~~).*$", ""), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*([-*+]|[0-9]+[.)])[ \t]+", ""), (r"(?m)^[ \t]*>[ \t]?", ""), (r"</?[A-Za-z][^>]*>", ""), (r"(\*\*|__|\*|`|~~)", ""), (r"\|", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    x = rf"regexp_replace({x}, '\\([\\`*_{{}}\[\]()#+.!<>|~-])', '\1', 'g')"
    return f"lower({sql_prose(sql_entities(x))})"


_SEGMENTS = f"""
segments AS (
  SELECT doc_id, pos - 1 AS pos, {sql_prose("line")} AS segment FROM (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE length({sql_prose("line")}) >= 12)"""
_FIRST = "string_split(text, chr(10))[1]"
ORACLES = {
    "content_dedupe": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
    "prose_segments": f"WITH {_SEGMENTS} SELECT doc_id, count(*) AS n_segments, sum(length(segment))::BIGINT AS n_chars FROM segments GROUP BY 1",
    "prose_missing": f"""WITH {_SEGMENTS},
      copy AS (SELECT doc_id, {sql_prose("CASE WHEN doc_id % 10 = 0 THEN substr(text, 201) ELSE replace(text, chr(10), chr(10) || chr(10)) END")} AS hay FROM documents)
      SELECT doc_id, pos, sha256(segment) AS segment_sha256 FROM segments JOIN copy USING (doc_id) WHERE NOT contains(hay, segment)""",
    "benchmark_passage_presence": r"""
      WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[ \t\r\n\x0B\f]+', ' ', 'g')) || ' ' AS hay FROM documents),
      b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[ \t\r\n\x0B\f]+', ' ', 'g')) || ' ' AS needle FROM benchmark)
      SELECT doc_id, item_id FROM d, b WHERE contains(hay, needle) AND trim(needle) <> ''""",
    "passage_presence": f"""
      WITH p AS (SELECT doc_id, text, doc_id % 2 = 0 AS is_code, CASE WHEN doc_id % 3 = 0 THEN replace({_FIRST}, ' ', ' - ') WHEN doc_id % 3 = 1 THEN substr({_FIRST}, 1, 40) || ' zzz ' || substr({_FIRST}, 41) ELSE {_FIRST} END AS passage FROM documents),
      s AS (SELECT *, {_sql_skeleton("passage")} AS bare, {_sql_skeleton("text")} AS body,
              list_filter(regexp_split_to_array(lower(passage), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM p),
      c AS (SELECT *, list_transform(range(0, greatest(length(bare) // 24, 1)), lambda k: substr(bare, k * 24 + 1, 24)) AS pieces,
              list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1]) AS pairs FROM s)
      SELECT doc_id, CASE WHEN contains(text, passage) OR bare = '' THEN 'exact' WHEN contains(body, bare) THEN 'respelled'
        WHEN is_code THEN CASE WHEN length(body) >= 8 AND contains(bare, body) THEN 'altered' WHEN len(pairs) > 0 AND len(list_filter(pairs, lambda p: contains(body, p))) / len(pairs) >= 0.5 THEN 'altered' ELSE 'absent' END
        WHEN length(bare) < 48 THEN 'absent' WHEN len(list_filter(pieces, lambda p: contains(body, p))) / len(pieces) >= 0.8 THEN 'altered' ELSE 'absent' END AS presence FROM c""",
    "redact_documents": f"""WITH r AS (SELECT doc_id, text, {_sql_redacted("text")} AS out FROM documents WHERE regexp_matches(text, '{_SECRET}'))
      SELECT doc_id, sha256(out) AS redacted_sha256, length(text) - length(out) AS n_removed FROM r""",
    "looks_secret": f"""WITH t AS (SELECT 'documents' AS kind, source AS part, text FROM documents UNION ALL SELECT 'conversations', role, text FROM conversations)
      SELECT kind, part, count(*) AS n, count(*) FILTER (regexp_matches(text, '{_SECRET}')) AS n_secret FROM t GROUP BY 1, 2""",
    "slug_documents": rf"""SELECT doc_id, {sql_slug("split_part(text, chr(10), 1)")} AS slug,
      regexp_matches(regexp_replace(translate(replace(split_part(text, chr(10), 1), 'ß', 'ss'), '{text.MARKED}', '{text.PLAIN}'), '[A-Za-z]', '', 'g'), '\p{{L}}') AS erased FROM documents""",
    "majority_locale": """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""",
    "canonical_hash": """
      WITH b AS (SELECT source, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::BIGINT % 256 AS bucket, doc_id::VARCHAR || chr(10) || sha256(text) AS line FROM documents),
      p AS (SELECT source, bucket, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM b GROUP BY 1, 2)
      SELECT source, sum(n)::BIGINT AS n_files, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS tree_hash FROM p GROUP BY 1""",
    "adjacent_merge": """
      WITH c AS (SELECT *, floor(length(text) / 400)::BIGINT AS size FROM conversations),
      l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(size) OVER w = size THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)
      SELECT conv_id, run, size, min(turn) AS first_at, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256 FROM r GROUP BY 1, 2, 3""",
    "fence_state": """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
      SELECT doc_id, n AS n_lines, CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN n - 1 ELSE 3 END AS n_fenced FROM n""",
    "repeated_turns": "SELECT conv_id, turn FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE text = before",
    "last_speaker": "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations",
    "first_turns": "SELECT conv_id, turn, role, sha256(text) AS text_sha256 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "labels_quality_by_source": "SELECT source, count(*) AS n, sum(quality)::BIGINT AS n_quality, sum(toxic)::BIGINT AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "conflicting_lines": "SELECT source, count(DISTINCT lang) AS n_values FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1",
    "markdown_text": f"WITH m AS (SELECT doc_id, {_sql_markdown('text')} AS t FROM documents) SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM m",
}
