"""Queries over trees and markup: converted components, merged navigations, tables of contents, configurations, grids, sanitised pages,
icons. Their trees are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.operators import contents, conversion, icons, inline, merging, order, sanitize, tables
from foliograph.sources import configs
from foliograph.workspace import table

_RULES = [
    ("unwrap", "*", 1, "Box", None, {}, None, {}, "unwrap", [], [], None),
    ("note", "*", 1, "Note", None, {}, "Callout", {"kind": "$map(tone)", "title": "$title", "parts": "$count"}, None, ["width"], [], None),
    *[(h, "*", 1, h, None, {}, None, {}, None, [], [], h) for h in ("grid-to-columns", "step-title-from-heading", "anchor-div-to-heading", "faq-to-expandable-group", "color-row-to-titled-group", "prompt-to-code")],
]
#: What a page holds, one after another, each with a heading, text or picture and a note.
_HELD = ("Box", "grid-to-columns", "step-title-from-heading", "anchor-div-to-heading", "faq-to-expandable-group", "color-row-to-titled-group", "Excluded", "prompt-to-code", "Unknown", "Held")


def _component_blocks(spark, d):
    """Ten components a page, with two blocks in each."""
    p = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(len(_HELD) - 1))).alias("i"))
    p = p.withColumns({"held": F.element_at(F.array(*map(F.lit, _HELD)), F.col("i") + 1), "turn": ((F.col("page_id") + F.col("i")) % 3).cast("int")})
    lead = F.element_at(F.array(*map(F.lit, ("heading", "paragraph", "image"))), F.col("turn") + 1)
    none = F.lit(None).cast("string")
    title = lambda t: F.create_map(F.lit("title"), F.concat(F.lit(t), "i"))
    own = F.map_concat(title("T"), F.create_map(F.lit("id"), F.concat(F.lit("a"), "i"), F.lit("className"), F.lit("grid md:grid-cols-3")))
    note = F.map_concat(title("N"), F.create_map(F.lit("tone"), F.when(F.col("page_id") % 2 == 0, "Warn").otherwise("calm"), F.lit("width"), F.lit("9")))
    block = lambda path, kind, name, text, props, expressions=None: F.struct(path.alias("path"), kind.alias("kind"), name.alias("name"), text.alias("text"), props.alias("props"), (expressions if expressions is not None else F.array().cast("array<string>")).alias("expressions"))
    at = lambda *more: F.array("i", *map(F.lit, more))
    held = F.when(F.col("held") == "Held", F.array(F.lit("onClick"))).otherwise(F.array().cast("array<string>"))
    three = F.array(
        block(at(), F.lit("component"), F.when(F.col("held") == "Held", "Note").otherwise(F.col("held")), none, own, held),
        block(at(0), lead, none, F.when(F.col("turn") < 2, F.concat(F.lit("x"), "page_id")), F.create_map().cast("map<string,string>")),
        block(at(1), F.lit("component"), F.lit("Note"), none, note),
    )
    b = p.select("page_id", "held", "i", F.explode(three).alias("b")).select("page_id", "held", "i", "b.*")
    return b.select("page_id", "path", "kind", F.lit("web").alias("platform"), "name", F.when(F.col("kind") == "heading", 2).alias("level"), "text", F.when(F.col("kind") == "image", F.concat(F.lit("/"), F.col("i").cast("string"), F.lit(".png"))).alias("url"), F.lit(False).alias("bold"), "props", F.array().cast("array<string>").alias("style_deps"), "expressions", F.concat(F.lit("s:"), F.coalesce("name", F.lit(""))).alias("signature"))


def _rules_and_plan(spark):
    return spark.createDataFrame(_RULES, conversion.RULES), spark.createDataFrame([("s:Excluded", "excluded", "no page of ours", None)], conversion.PLAN)


def converted_components(spark, d):
    """Pages' components under rules, handlers and a plan."""
    got = conversion.converted(_component_blocks(spark, d), *_rules_and_plan(spark), {"Callout.kind.warn": "warning"})
    props = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return got.select("page_id", F.array_join("path", ".").alias("path"), "kind", "name", "text", "url", props.alias("props"), "source_id", "reason")


def component_dispositions(spark, d):
    """How many blocks of each disposition a page has, and which properties are lost."""
    got = conversion.dispositions(_component_blocks(spark, d), *_rules_and_plan(spark))
    return got.groupBy("page_id", "disposition", F.array_join("lossy", ",").alias("lossy")).agg(F.count("*").alias("n"))


def _navigation(spark, d, pages, groups, order):
    """A group for each nation, with customers as its pages."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    p = pages(c).select(F.concat_ws(".", F.lit("p"), "n", "c").alias("node_id"), F.concat(F.lit("g"), "n").alias("parent_id"), F.lit("page").alias("kind"), F.concat(F.lit("P"), "c").alias("label"), F.concat(F.lit("c"), "c").alias("page_id"), order.cast("int").alias("ord"))
    g = groups(table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))).select(F.concat(F.lit("g"), "n").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("group").alias("kind"), F.concat(F.lit("N"), "n").alias("label"), F.lit(None).cast("string").alias("page_id"), F.col("n").cast("int").alias("ord"))
    return g.union(p)


def merged_navigation(spark, d):
    """Two readings of one sidebar: each lacks some nations and customers, the second lists some twice and turns every fifth nation around."""
    first = _navigation(spark, d, lambda c: c.filter("c % 3 <> 0 AND n % 7 <> 3"), lambda n: n.filter("n % 7 <> 3"), F.col("c"))

    def listed(c):
        own = c.filter("c % 3 <> 1 AND n % 7 <> 5")
        again = c.filter("c % 3 = 1 AND c % 10 = 1 AND n % 7 <> 3").withColumn("n", (F.col("n") + 1) % 25).filter("n % 7 <> 5")
        return own.union(again)

    second = _navigation(spark, d, listed, lambda n: n.filter("n % 7 <> 5"), F.when(F.col("n") % 5 == 0, -F.col("c")).otherwise(F.col("c")))
    return merging.merged(first, second).select(F.array_join("path", ".").alias("path"), "side", "kind", "label", "page_id")


def _contents(spark, d):
    """A table of contents for each nation: customers, numbered, hang beneath earlier ones in a chain of threes."""
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, d, "customer").select(F.concat(F.lit("t"), "c_nationkey").alias("toc"), k.alias("k"))
    above = F.col("k") - 1 - F.col("k") % 3
    name = lambda x: F.lpad(x.cast("string"), 6, "0")
    nodes = c.select("toc", name(F.col("k")).alias("node"), F.when(above > 0, name(above)).alias("parent"), (F.col("k") * 7 % 5).cast("int").alias("ord"), F.col("k").cast("int").alias("index"))
    e = c.filter("k % 11 <> 4").select("toc", F.col("k").cast("int").alias("index"), F.when(F.col("k") % 7 == 0, "___").otherwise(F.concat(F.lit("/c/"), "k")).alias("link"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("T"), "k")).alias("title"), F.when(F.col("k") % 4 == 1, "m").otherwise("").alias("bookmark"))
    return nodes, e


def contents_numbered(spark, d):
    nodes, _ = _contents(spark, d)
    # two that hold each other, and one whose parent is missing
    lost = nodes.filter("index = 1").select("toc", F.explode(F.array(*[F.struct(F.lit(a).alias("node"), F.lit(b).alias("parent")) for a, b in (("x", "y"), ("y", "x"), ("z", "nowhere"))])).alias("l"))
    lost = lost.select("toc", "l.node", "l.parent", F.lit(0).alias("ord"), F.lit(None).cast("int").alias("index"))
    got = contents.numbered(nodes.union(lost))
    return got.select("toc", "node", "pre", "size", F.col("depth").cast("long").alias("depth"))


def contents_drawn(spark, d):
    return contents.drawn(*_contents(spark, d))[0].select("toc", "node", F.col("place").cast("long").alias("place"), F.col("depth").cast("long").alias("depth"), "kind", "label", "url")


def contents_unresolved(spark, d):
    return contents.drawn(*_contents(spark, d))[1]


def configured_pages(spark, d):
    """A configuration for each nation: its customers by segment in two versions, the second in two languages, one hidden."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("config"), "c_mktsegment", "c_custkey")
    groups = c.groupBy("config", "c_mktsegment").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    quoted = F.array_join(F.transform("keys", lambda x: F.concat(F.lit('"c/'), x.cast("string"), F.lit('"'))), ",")
    groups = groups.select("config", "c_mktsegment", F.concat(F.lit('{"group":"'), "c_mktsegment", F.lit('","pages":['), quoted, F.lit(',{"group":"more","pages":["only","gone"]}]}')).alias("g"))
    whole = groups.groupBy("config").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "g"))), lambda x: x["g"]), ",").alias("g"))
    json = F.concat(F.lit('{"navigation":{"versions":[{"version":"1","tabs":[{"tab":"T","groups":['), "g", F.lit(']}]},{"version":"2","languages":[{"language":"en","groups":['), "g", F.lit(']},{"language":"fr","hidden":true,"pages":["only"]}]}]}}'))
    files = c.filter("c_custkey % 5 <> 0").select("config", F.concat(F.lit("c/"), "c_custkey").alias("path"))
    files = files.union(whole.select("config", F.explode(F.array(F.lit("only"), F.lit("extra")))))
    got = configs.listed_pages(whole.select("config", json.alias("json")), files)
    return got.select("config", "path", "locale", "version", F.array_join("groups", "/").alias("groups"), "hidden", F.col("place").cast("long").alias("place"), "status")


#: What pages end in, and what becomes of it.
_UNSAFE = (
    ('<p onclick="x()">{a}</p>', "<p>&#123;a&#125;</p>"), ("<form><p>in</p><input></form>out", "out"), ('<a href="java\tscript:x">l</a><a href="/y">m</a>', '<a>l</a><a href="/y">m</a>'), ('<iframe src="https://x.example/"></iframe>end', "end"),
    ('<iframe src="https://www.youtube.com/embed/a" allow="b"></iframe>', '<iframe src="https://www.youtube.com/embed/a"></iframe>'), ("<svg><circle/>", ""), ("<script>var b = '<form>'</script>rest", "rest"),
)
_DECLARED = ("p { color: red }", "@import 'x';", "p { position: fixed }", "p { z-index: 99; background: url(https://x) }", "p { behavior: url(x) }")


def expanded_cells(spark, d):
    """Orders as tables, their line items as cells of rows of two, which span by what was ordered."""
    k = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1).cast("int")
    c = table(spark, d, "lineitem").select("l_orderkey", k.alias("k"), "l_partkey")
    c = c.select("l_orderkey", F.floor(F.col("k") / 2).cast("int").alias("row"), F.col("k").alias("cell"), F.when(F.col("l_partkey") % 3 == 0, "2").alias("rowspan"), F.when(F.col("l_partkey") % 4 == 1, "2").when(F.col("l_partkey") % 4 == 2, "none").alias("colspan"))
    return tables.grid(c, ["l_orderkey"]).select("l_orderkey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("cell").cast("long").alias("cell"))


def sanitized_pages(spark, d):
    """Pages' whole markup, with something unsafe at the end, sanitised: hashes and lengths."""
    bad = F.element_at(F.array(*[F.lit(given) for given, _ in _UNSAFE]), (F.col("page_id") % len(_UNSAFE) + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("html", r"(?is)^.*?<body>|</body>.*$", ""), bad).alias("html"))
    return sanitize.sanitized(p, "page_id", "html").select("page_id", F.md5("html").alias("md5"))


def style_sheet_problems(spark, d):
    """Pages' style sheets, with another declaration by turns."""
    more = F.element_at(F.array(*map(F.lit, _DECLARED)), (F.col("page_id") % len(_DECLARED) + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("html", r"(?s)<style>(.*?)</style>", 1), F.lit(" "), more).alias("css"))
    return sanitize.style_problems(p, "page_id", "css")


def _icons(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" / ", "p_type", "p_brand").alias("label"), F.when(F.col("p_size") % 2 == 0, "group").otherwise("page").alias("kind"), F.col("p_brand").alias("box"))
    p = p.withColumn("label", F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("20"), F.lpad((F.col("p_partkey") / 50 % 100).cast("int").cast("string"), 2, "0"))).otherwise(F.col("label")))
    drawable = spark.createDataFrame([(n,) for n in ("shield", "box", "star", "folder", "calendar", "leaf")], "name string")
    phrases = spark.createDataFrame([("large", "ghost", 0), ("conomy b", "box", 1), ("economy", "star", 2), ("small br", "shield", 3), ("rand 2", "leaf", 4)], icons.PHRASES)
    words = spark.createDataFrame([("promo", "leaf"), ("medium", "star"), ("brand", "ghost")], icons.WORDS)
    return icons.suggested(p, phrases, words, spark.createDataFrame([("group", "folder"), ("page", "folder")], icons.FALLBACK), drawable)


def suggested_icons(spark, d):
    """Parts' types as labels; every fiftieth is a year."""
    return _icons(spark, d).select("p_partkey", "icon", "icon_by")


def filled_icons(spark, d):
    """Parts of a brand as a container's pages; some brands state icons of their own, some have too few suggestions."""
    p = _icons(spark, d).withColumn("stated", F.when((F.col("box") == "Brand#11") & (F.col("p_partkey") % 9 == 0), "own"))
    p = p.withColumn("icon", F.when((F.col("box") != "Brand#12") | (F.col("p_partkey") % 5 == 0), F.col("icon")))
    return icons.filled(p, "box", "file").select("p_partkey", "shown")


def inline_normal_form(spark, d):
    """Turns of conversations as marked-up words: of three in a row one is bold in italic, one italic in bold, one a link named by its
    own address; halves of words stand apart."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\s&<]+"), F.lit(0))
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("root"), F.posexplode(words).alias("i", "w"))
    node = lambda name, parent, ord_, kind, text=None, url=None: F.struct(F.concat(F.lit(name), F.col("i").cast("string")).alias("node"), (F.concat(F.lit(parent), F.col("i").cast("string")) if parent else F.lit(None).cast("string")).alias("parent"), ord_.cast("int").alias("ord"), F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("text"), (url if url is not None else F.lit(None).cast("string")).alias("url"))
    at, one, w, url = F.col("i") * 2, F.lit(0), F.col("w"), F.concat(F.lit("https://w.example/"), F.col("w"))
    half = F.floor(F.length("w") / 2).cast("int")
    halves = [node("x", "b", one, "text", F.substring(w, F.lit(1), half)), node("y", "b", one + 1, "text", F.substring(w, half + 1, F.length("w")))]
    gap = node("g", None, at + 1, "text", F.lit("&#32;"))
    rows = F.when(F.col("i") % 3 == 0, F.array(node("a", None, at, "italic"), node("b", "a", one, "bold"), *halves, gap)).when(F.col("i") % 3 == 1, F.array(node("a", None, at, "bold"), node("b", "a", one, "italic"), *halves, gap)).otherwise(F.array(node("a", None, at, "link", url=url), node("x", "a", one, "text", url), gap))
    got = inline.as_text(inline.normalised(c.select("root", F.explode(rows).alias("r")).select("root", "r.*")))
    return got.select("root", F.md5("said").alias("md5"))


def names_by_locale(spark, d):
    """Parts' names in the order of their letters, every other one in capitals, and where each stands."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    got = order.placed_by_locale(p, "name", "p_partkey")
    return got.select("p_partkey", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (converted_components, component_dispositions, merged_navigation, contents_numbered, contents_drawn, contents_unresolved, configured_pages, expanded_cells, sanitized_pages, style_sheet_problems, suggested_icons, filled_icons, inline_normal_form, names_by_locale)}

_ICONS = """p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'year' WHEN p_type = 'ECONOMY' THEN 'box' WHEN p_type = 'SMALL' THEN 'shield' WHEN p_brand LIKE 'Brand#2%' THEN 'leaf'
    WHEN p_type = 'PROMO' THEN 'word leaf' WHEN p_type = 'MEDIUM' THEN 'word star' WHEN p_size % 2 = 0 THEN 'kind' END AS what FROM part),
  i AS (SELECT p_partkey, p_brand, CASE what WHEN 'year' THEN 'calendar' WHEN 'word leaf' THEN 'leaf' WHEN 'word star' THEN 'star' WHEN 'kind' THEN 'folder' ELSE what END AS icon,
    CASE WHEN what IN ('box', 'shield', 'leaf') THEN 'phrase' WHEN what LIKE 'word%' THEN 'word' ELSE what END AS icon_by FROM p)"""
_TOC = """WITH RECURSIVE c AS (SELECT c_nationkey AS toc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
  w AS (SELECT toc, k, [(k * 7 % 5) || lpad(k::VARCHAR, 6, '0')] AS path, 0 AS above FROM c WHERE k - 1 - k % 3 <= 0
    UNION ALL SELECT c.toc, c.k, list_append(w.path, (c.k * 7 % 5) || lpad(c.k::VARCHAR, 6, '0')), w.above + (w.k % 11 = 4)::INT FROM w JOIN c ON c.toc = w.toc AND c.k - 1 - c.k % 3 = w.k),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY toc ORDER BY path) - 1 AS pre, len(path) - 1 AS depth, (SELECT count(*) FROM w b WHERE b.toc = w.toc AND b.path[1:len(w.path)] = w.path) AS size FROM w)"""
_NOTE = "'kind=' || CASE WHEN page_id % 2 = 0 THEN 'warning' ELSE 'calm' END || ',parts=0,title=N' || i"
ORACLES = {
    "converted_components": f"""
      WITH c AS (SELECT page_id, i, (page_id + i) % 3 AS k, 'x' || page_id AS said, (page_id + i) % 3 < 2 AS says FROM pages, range(10) r(i)),
      top AS (
        SELECT *, unnest(CASE i
          WHEN 0 THEN [{{'s': 0, 'kind': 'lead', 'name': NULL, 'p': '', 'why': NULL}}, {{'s': 1, 'kind': 'note', 'name': NULL, 'p': '', 'why': NULL}}]
          WHEN 1 THEN [{{'s': 0, 'kind': 'component', 'name': 'Columns', 'p': 'cols=3', 'why': NULL}}]
          WHEN 2 THEN [{{'s': 0, 'kind': 'component', 'name': 'Step', 'p': CASE WHEN k = 0 THEN 'title=' || said || ',titleType=h2' ELSE 'title=Step' END, 'why': NULL}}]
          WHEN 3 THEN CASE WHEN k = 0 THEN [{{'s': 0, 'kind': 'lead', 'name': NULL, 'p': '', 'why': NULL}}, {{'s': 1, 'kind': 'note', 'name': NULL, 'p': '', 'why': NULL}}]
            ELSE [{{'s': 0, 'kind': 'quarantined', 'name': 'anchor-div-to-heading', 'p': '', 'why': 'no heading leads it'}}] END
          WHEN 4 THEN [{{'s': 0, 'kind': 'component', 'name': 'ExpandableGroup', 'p': '', 'why': NULL}}]
          WHEN 5 THEN [{{'s': 0, 'kind': 'component', 'name': 'Expandable', 'p': 'defaultOpen=true,title=T5', 'why': NULL}}]
          WHEN 7 THEN [CASE WHEN says THEN {{'s': 0, 'kind': 'code', 'name': NULL, 'p': '', 'why': NULL}} ELSE {{'s': 0, 'kind': 'quarantined', 'name': 'prompt-to-code', 'p': '', 'why': 'no text to copy'}} END]
          WHEN 8 THEN [{{'s': 0, 'kind': 'preserved', 'name': 'Unknown', 'p': '', 'why': 'no rule for s:Unknown'}}]
          WHEN 9 THEN [{{'s': 0, 'kind': 'quarantined', 'name': 'Note', 'p': '', 'why': 'expression: onClick'}}] END) AS t FROM c WHERE i <> 6),
      placed AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY i, t.s) - 1)::VARCHAR AS path FROM top),
      beneath AS (
        SELECT page_id, i, k, said, says, path || '.0' AS path, 'component' AS kind, 'Columns' AS name, 'cols=3' AS p, NULL AS why FROM placed WHERE i = 5
        UNION ALL SELECT page_id, i, k, said, says, path || CASE WHEN i = 5 THEN '.0' ELSE '' END || '.' || n - CASE WHEN i = 2 AND k = 0 THEN 1 ELSE 0 END,
          CASE WHEN n = 0 THEN 'lead' WHEN i = 4 THEN 'expandable' ELSE 'note' END, NULL, '', NULL
        FROM placed, range(2) r(n) WHERE i IN (1, 2, 4, 5, 8) AND NOT (i = 2 AND k = 0 AND n = 0)),
      every AS (SELECT page_id, i, k, said, says, path, t.kind AS kind, t.name AS name, t.p AS p, t.why AS why FROM placed UNION ALL SELECT * FROM beneath)
      SELECT page_id, path, CASE kind WHEN 'lead' THEN ['heading', 'paragraph', 'image'][k + 1] WHEN 'note' THEN 'component' WHEN 'expandable' THEN 'component' ELSE kind END AS kind,
        CASE kind WHEN 'note' THEN 'Callout' WHEN 'expandable' THEN 'Expandable' ELSE name END AS name,
        CASE WHEN (kind = 'lead' AND says) OR kind = 'code' THEN said END AS text, CASE WHEN kind = 'lead' AND k = 2 THEN '/' || i || '.png' END AS url,
        CASE kind WHEN 'note' THEN {_NOTE} WHEN 'expandable' THEN 'title=N' || i ELSE p END AS props, CASE WHEN i = 3 AND kind = 'lead' THEN 'a3' END AS source_id, why AS reason
      FROM every""",
    "component_dispositions": """
      WITH b AS (SELECT page_id, i, j FROM pages, range(10) r(i), range(3) s(j))
      SELECT page_id, CASE i WHEN 6 THEN 'excluded' WHEN 9 THEN 'quarantined' ELSE CASE WHEN j = 1 THEN 'identical' ELSE 'transformed' END END AS disposition,
        CASE WHEN i IN (6, 9, 8) OR j = 1 THEN '' WHEN j = 2 THEN '' WHEN i = 0 THEN 'className,id,title' WHEN i = 1 THEN 'id,title' WHEN i = 3 THEN 'className,title' WHEN i = 5 THEN 'className,id'
          WHEN i IN (2, 4, 7) THEN 'className,id,title' END AS lossy, count(*) AS n FROM b GROUP BY ALL""",
    "merged_navigation": """
      WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer), g AS (SELECT n_nationkey AS n, n_nationkey % 7 AS m FROM nation),
      top AS (SELECT n, CASE m WHEN 3 THEN 'second' WHEN 5 THEN 'first' ELSE 'both' END AS side,
        row_number() OVER (ORDER BY CASE WHEN m = 3 THEN coalesce((SELECT min(h.n) FROM g h WHERE h.n > g.n AND h.m NOT IN (3, 5)), 999) ELSE n END, m <> 3, n) - 1 AS place FROM g),
      p AS (SELECT c, n, CASE WHEN c % 3 = 0 OR n % 7 = 3 THEN 'second' WHEN c % 3 = 1 OR n % 7 = 5 THEN 'first' ELSE 'both' END AS side FROM c
        WHERE NOT (c % 3 = 0 AND n % 7 = 5) AND NOT (c % 3 = 1 AND n % 7 = 3)),
      s AS (SELECT n, max(c) AS high FROM p WHERE side = 'both' GROUP BY n),
      k AS (SELECT p.*, CASE WHEN side <> 'second' THEN c WHEN p.n % 5 = 0 THEN CASE WHEN c > high THEN high ELSE 1e9 END
        ELSE coalesce((SELECT min(q.c) FROM p q WHERE q.n = p.n AND q.side = 'both' AND q.c > p.c), 1e9) END AS ahead FROM p LEFT JOIN s ON s.n = p.n),
      o AS (SELECT k.*, row_number() OVER (PARTITION BY k.n ORDER BY ahead, side <> 'second', CASE WHEN k.n % 5 = 0 THEN -c ELSE c END) - 1 AS place FROM k)
      SELECT place::VARCHAR AS path, side, 'group' AS kind, 'N' || n AS label, NULL AS page_id FROM top
      UNION ALL SELECT top.place || '.' || o.place, o.side, 'page', 'P' || c, 'c' || c FROM o JOIN top ON top.n = o.n""",
    "contents_numbered": f"""{_TOC}
      SELECT 't' || toc AS toc, lpad(k::VARCHAR, 6, '0') AS node, pre, size, depth FROM numbered
      UNION ALL SELECT 't' || n_nationkey, x, NULL, NULL, NULL FROM nation, (VALUES ('x'), ('y'), ('z')) v(x) WHERE n_nationkey IN (SELECT toc FROM c)""",
    "contents_drawn": f"""{_TOC},
      shown AS (SELECT * FROM numbered WHERE above = 0 AND k % 11 <> 4),
      holds AS (SELECT a.toc, a.k, count(*) FILTER (b.k % 7 <> 0 AND b.k <> a.k) AS below, a.k % 7 <> 0 AS page FROM shown a JOIN shown b ON b.toc = a.toc AND b.pre >= a.pre AND b.pre < a.pre + a.size GROUP BY ALL),
      kept AS (SELECT n.*, below > 0 AS grp FROM shown n JOIN holds h ON h.toc = n.toc AND h.k = n.k WHERE below > 0 OR page)
      SELECT 't' || toc AS toc, lpad(k::VARCHAR, 6, '0') AS node, row_number() OVER (PARTITION BY toc ORDER BY pre) - 1 AS place, depth, CASE WHEN grp THEN 'group' ELSE 'page' END AS kind,
        CASE WHEN k % 5 = 0 THEN CASE WHEN grp THEN 'Untitled' END ELSE 'T' || k END AS label, CASE WHEN k % 7 <> 0 THEN 'c/' || k || CASE WHEN k % 4 = 1 THEN '#m' ELSE '' END END AS url FROM kept""",
    "contents_unresolved": f"{_TOC} SELECT 't' || toc AS toc, lpad(k::VARCHAR, 6, '0') AS node, 'unresolved' AS problem FROM numbered WHERE above = 0 AND k % 11 = 4",
    "configured_pages": """
      WITH c AS (SELECT c_nationkey AS config, c_mktsegment AS s, c_custkey AS k FROM customer), one AS (SELECT DISTINCT config FROM c),
      x AS (SELECT config, s AS seg, k, 'c/' || k AS path, k % 5 <> 0 AS there FROM c UNION ALL SELECT config, min(s), 1e9::BIGINT, 'only', true FROM c GROUP BY config UNION ALL SELECT config, min(s), 2e9::BIGINT, 'gone', false FROM c GROUP BY config),
      v AS (SELECT x.*, '1' AS version, NULL AS locale FROM x UNION ALL SELECT x.*, '2', 'en' FROM x),
      l AS (SELECT config, path, locale, version, CASE version WHEN '1' THEN 'T/' ELSE '' END || seg || CASE WHEN k >= 1e9 THEN '/more' ELSE '' END AS groups, false AS hidden, there, version AS a, seg, k FROM v
        UNION ALL SELECT config, 'only', 'fr', '2', '', true, true, '3', '', 0 FROM one)
      SELECT config, path, locale, version, groups, hidden, CASE WHEN there THEN row_number() OVER (PARTITION BY config, there ORDER BY a, seg, k) - 1 END AS place, CASE WHEN there THEN 'listed' ELSE 'missing' END AS status FROM l
      UNION ALL SELECT config, 'extra', NULL, NULL, NULL, NULL, NULL, 'unlisted' FROM one""",
    "expanded_cells": """
      WITH RECURSIVE c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k, k AS cell, CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END AS down,
          CASE WHEN l_partkey % 4 = 1 THEN 2 ELSE 1 END AS across FROM lineitem),
      t AS (SELECT *, k // 2 AS r, max(k // 2) OVER (PARTITION BY l_orderkey) AS last FROM c),
      -- here: columns of the row so far; next: what it leaves to the row below
      f AS (SELECT l_orderkey, k, r, MAP {}::MAP(BIGINT, BIGINT) AS here, MAP {}::MAP(BIGINT, BIGINT) AS next, 0::BIGINT AS at, -1::BIGINT AS cell, 0 AS across, 0::BIGINT AS low FROM t WHERE k = 0
        UNION ALL
        SELECT s.l_orderkey, s.k + 1, s.r, map_concat(s.base, map_from_entries(list_transform(range(s.col, s.col + s.w), lambda x: {'key': x, 'value': s.c}))),
          CASE WHEN s.down = 2 AND s.r < s.last THEN map_concat(s.left_over, map_from_entries(list_transform(range(s.col, s.col + s.w), lambda x: {'key': x, 'value': s.c}))) ELSE s.left_over END, s.col + s.w, s.c, s.w, s.col
        FROM (SELECT *, (SELECT min(x) FROM range(0, 40) q(x) WHERE x >= start AND NOT list_contains(map_keys(base), x)) AS col, across AS w
          FROM (SELECT t.l_orderkey, t.k, t.r, t.down, t.across, t.last, t.cell AS c, CASE WHEN t.k > 0 AND t.r > f.r THEN f.next ELSE f.here END AS base,
            CASE WHEN t.k > 0 AND t.r > f.r THEN MAP {}::MAP(BIGINT, BIGINT) ELSE f.next END AS left_over, CASE WHEN t.k > 0 AND t.r > f.r THEN 0 ELSE f.at END AS start FROM f JOIN t ON t.l_orderkey = f.l_orderkey AND t.k = f.k)) s),
      ends AS (SELECT l_orderkey, r, max_by(here, k) AS here FROM f WHERE cell >= 0 GROUP BY ALL)
      SELECT l_orderkey, r AS row, unnest(map_keys(here)) AS col, unnest(map_values(here)) AS cell FROM ends""",
    "sanitized_pages": f"""
      WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '^.*?<body>', '', 's'), '</body>.*$', '', 's') AS html, page_id % {len(_UNSAFE)} AS turn FROM pages),
      e(turn, becomes) AS (VALUES {", ".join(f"({i}, '{b}')" for i, (_, b) in enumerate(_UNSAFE))})
      SELECT page_id, md5(replace(replace(replace(replace(regexp_replace(html, '<!--.*?-->', '', 'g'), '<br>', '<br />'), 'class="', 'className="'), '{{', '&#123;'), '}}', '&#125;') || becomes) AS md5 FROM p JOIN e USING (turn)""",
    "style_sheet_problems": """
      WITH e(turn, problem) AS (VALUES (1, 'import'), (2, 'fixed position'), (3, 'z-index above 9'), (3, 'external address'), (4, 'script-like'))
      SELECT page_id, problem FROM pages JOIN e ON page_id % 5 = turn""",
    "suggested_icons": f"WITH {_ICONS} SELECT p_partkey, icon, icon_by FROM i",
    "filled_icons": f"""
      WITH {_ICONS}, j AS (SELECT p_partkey, p_brand, CASE WHEN p_brand <> 'Brand#12' OR p_partkey % 5 = 0 THEN icon END AS icon, CASE WHEN p_brand = 'Brand#11' AND p_partkey % 9 = 0 THEN 'own' END AS stated FROM i),
      n AS (SELECT p_brand, count(stated) AS own, count(icon) AS named, count(*) AS every FROM j GROUP BY p_brand)
      SELECT p_partkey, CASE WHEN own > 0 THEN stated WHEN 2 * named >= every THEN coalesce(icon, 'file') END AS shown FROM j JOIN n USING (p_brand)""",
    "inline_normal_form": """
      WITH c AS (SELECT conv_id * 1000 + turn AS root, regexp_extract_all(coalesce(text, ''), '[^\\s&<]+') AS w FROM conversations)
      SELECT root, md5(array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 3 = 0 THEN 'https://w.example/' || x ELSE '**_' || x || '_**' END || ' '), '')) AS md5 FROM c WHERE len(w) > 0""",
    "names_by_locale": "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey % 2 = 0, p_partkey) - 1 AS place FROM part",
}
