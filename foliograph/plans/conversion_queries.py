"""Queries over plans, fidelity and the contract; customers, orders, pages and parts stand in for pages, routes and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliograph.functions import urls
from foliograph.operators import contract, fidelity, masking, routing, sites
from foliograph.plans import gates
from foliograph.plans.operator_queries import TREE
from foliograph.workspace import bounded_batches, table


def _losses(spark):
    return spark.createDataFrame([("Hidden", "drop", []), ("Frame", "unwrap", []), ("Note", "keep", ["icon"])], "name string, action string, dropped array<string>")


def _source_blocks(spark, d):
    """Fifteen blocks a page: every fifth is hidden, framed or a note with an icon and a tone."""
    b = table(spark, d, "pages").select("page_id", F.posexplode(F.array(*[F.array(*map(F.lit, p)) for p in TREE])).alias("seq", "path"))
    turn = (F.col("page_id") + F.col("seq")) % 5
    name = F.when(turn == 0, "Note").when(turn == 1, "Frame").when(turn == 2, "Hidden")
    props = F.create_map(F.lit("icon"), F.lit("i"), F.lit("tone"), F.concat(F.lit("t"), F.col("page_id") % 3), F.lit("width"), F.col("seq").cast("string"))
    return b.select("page_id", "seq", "path", name.alias("name"), F.coalesce(name, F.lit("paragraph")).alias("kind"), F.concat(F.lit("x"), "seq").alias("text"), props.alias("props"))


def declared_losses(spark, d):
    kept = fidelity.declared_losses(_source_blocks(spark, d), _losses(spark))
    return kept.select("page_id", F.col("seq").cast("long").alias("seq"), F.col("depth").cast("long").alias("depth"), F.array_join(F.array_sort(F.map_keys("props")), ",").alias("props"))


def _differences(spark, d):
    kept = fidelity.declared_losses(_source_blocks(spark, d), _losses(spark))
    k = F.col("page_id") * 7 + F.col("seq")
    out = kept.filter("NOT (page_id % 4 = 0 AND seq = 14)").withColumn("text", F.when(k % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    out = out.withColumn("props", F.when(k % 17 == 0, F.map_concat(F.map_filter("props", lambda n, _: n != "tone"), F.create_map(F.lit("tone"), F.lit("new")))).otherwise(F.map_filter("props", lambda n, _: n != "width")))
    return fidelity.first_differences(fidelity.snapshot(kept), fidelity.snapshot(out))


def first_differences(spark, d):
    """The source without its declared losses against a copy with altered texts and tones and, on every fourth page, without its last block."""
    return _differences(spark, d).select("page_id", F.col("place").cast("long").alias("place"), "field", "first", "second")


def gate_source_content(spark, d):
    return gates.gate("source-content", _differences(spark, d))


def running_order(spark, d):
    """Each turn's words against the turn itself, and for odd turns against its words in reverse."""
    c = bounded_batches(table(spark, d, "conversations"))
    words = F.split(F.coalesce("text", F.lit("")), " ")
    rendered = F.when(F.col("turn") % 2 == 1, F.array_join(F.reverse(words), " ")).otherwise(F.array_join(words, " "))
    got = c.select("conv_id", "turn", fidelity.running_order(F.concat(words, F.array(F.lit("\x01"))), rendered).alias("o"))
    return got.groupBy("conv_id", "turn").agg(*[F.sum(f"o.{x}").alias(x) for x in ("moved", "absent")])


#: What pages of a converted site end in.
_ENDS = (
    "Text {user.name} {3} {true} {/* note */}", "<Unknown>", "{a + b}", '<Image src="a" />\n<Columns cols={4}>', "import A from '/snippets/a.mdx'\nimport B from './b'", ":::note", "```js\nnever closed",
    '<Card look="say &quot;hi" />', "<draft/>\n<Script/>", '`{x}` <Card\n look="wide" />', "> 🚧 stop\n{% hint %}", "@embed[x] <<glossary:y>> {{ snippet.z }}", "<Note>",
)


def _contract_problems(spark, d):
    """Documents as bodies of pages; by turns a page has no front matter, one without a title, or ends in something of its own."""
    turn = (F.col("doc_id") % len(_ENDS)).cast("int")
    front = F.when(turn == 1, "").when(turn == 2, "---\ndescription: d\n---\n").otherwise("---\ntitle: t\n---\n")
    p = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(front, F.coalesce("text", F.lit("")), F.lit("\n"), F.element_at(F.array(*map(F.lit, _ENDS)), turn + 1)).alias("mdx"))
    known = spark.createDataFrame([("Card", False, False), ("Columns", False, False), ("Draft", True, False), ("Image", False, False), ("Script", False, True)], contract.COMPONENTS)
    props = spark.createDataFrame([("Image", "alt", "required", None), ("Columns", "cols", "enum", ["2", "3"]), ("Card", "look", "tokens", ["wide", "dark"])], contract.PROPS)
    return contract.problems(p, known, props)


def contract_problems(spark, d):
    return _contract_problems(spark, d).withColumn("line", F.col("line").cast("long"))


def gate_contract_valid(spark, d):
    return gates.gate("contract-valid", _contract_problems(spark, d))


def _with_code(spark, d, text, *more):
    """Documents' texts as changed by ``text``, every third line as code."""
    i_th = lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("`"), x, F.lit("`"))).when((i % 3 == 1) & F.lit(bool(more)), F.concat(F.lit("".join(more)), x)).otherwise(x)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split(text, "\n", -1), i_th), "\n").alias("text"))


def emoji_outside_code(spark, d):
    """Documents with shortcodes in place of commas: a hash of what becomes of them."""
    texts = _with_code(spark, d, F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit(" :boom: :no_name: ")))
    emoji = spark.createDataFrame([("boom", "💥"), ("rocket", "🚀")], "name string, char string")
    return masking.with_emoji(texts, "doc_id", "text", emoji).select("doc_id", F.md5("text").alias("md5"))


def literal_braces(spark, d):
    """Documents with braces in place of full stops, tags with braces in place of commas, and lines that begin with import."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(" {x} ")), F.lit(", "), F.lit(" <T a={1}> "))
    return masking.with_literal_braces(_with_code(spark, d, text, "import "), "doc_id", "text").select("doc_id", F.md5("text").alias("md5"))


def plan_extension(spark, d):
    """Every third customer has a planned route; the others' default routes repeat, and some are taken by the plan."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "page_id")
    plan = c.filter("page_id % 3 = 0").select("page_id", F.concat(F.lit("/p"), "page_id").alias("route"))
    return routing.plan_extended(plan, c.select("page_id", F.concat(F.lit("/p"), F.col("page_id") + F.col("c_nationkey") % 4).alias("route")))


def routes_of_plan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderstatus") != "F").alias("migrate"), F.col("o_orderpriority").alias("reason"), "o_custkey")
    plan = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("/c"), "c_custkey").alias("route"), F.col("c_mktsegment").alias("reason"))
    return routing.with_plan(o, plan).select("page_id", "route", "reason")


def component_decisions(spark, d):
    """Parts as components: their container is the signature, their type's last word the name."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("component_id"), F.element_at(F.split("p_type", " "), -1).alias("name"), F.concat(F.col("p_brand"), F.col("p_size") % 3).alias("signature"))
    brands = table(spark, d, "part").filter("p_size % 3 = 0").select(F.concat("p_brand", F.lit("0")).alias("signature")).distinct()
    plan = brands.select("signature", F.when(F.col("signature").endswith("20"), "open").otherwise("approved").alias("status"), F.when(F.col("signature").endswith("30"), "Card").alias("target"))
    names = table(spark, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("name")).distinct()
    rules = names.filter("name < 'C'").select("name", F.concat(F.lit("R"), "name").alias("target"))
    return routing.component_decisions(p, plan, rules, names.filter("name < 'P'")).select("component_id", "decided_by", "outcome")


def page_titles(spark, d):
    o = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" L"), "c_custkey")).alias("listed"), F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.when(F.col("c_custkey") % 5 == 0, "H")).alias("heading"), F.concat(F.lit("/docs/api-start-"), "c_custkey", F.lit("/")).alias("path"))
    return routing.titled(o, ["listed", "heading"]).select("c_custkey", "title", "title_source")


def categories_of_files(spark, d):
    e = table(spark, d, "customer").select(F.col("c_nationkey").alias("workspace"), F.col("c_custkey").alias("entry_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("s-"), "c_custkey")).alias("slug"), F.concat(F.lit("S "), F.col("c_custkey") + 1).alias("title"))
    f = table(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_nationkey").alias("workspace"), (F.col("c_custkey") * 10).alias("file_id"), F.concat(F.lit("s-"), "c_custkey").alias("slug"))
    return routing.categories_of_files(e, f)


ICONS = ("faCircleCheck", "fa-solid", "bolt", "lucide:Home", "https://x/y.svg", "fas fa-home-alt", "nothing", "")


def drawable_icons(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ICONS)), (F.col("p_partkey") % len(ICONS) + 1).cast("int")).alias("icon"))
    can = spark.createDataFrame([("house",), ("zap",), ("circle-check",), ("solid",)], "name string")
    same = spark.createDataFrame([("home", "house"), ("bolt", "zap"), ("fa-circle-check", "circle-check"), ("nothing", "void")], "name string, other string")
    return routing.drawable_icons(p, "icon", can, same).select("p_partkey", "icon", "drawn")


def _routes(key, kind):
    return F.concat(F.lit("n"), F.col("nation") % 7, F.when(F.col(key) % 3 > 0, F.concat(F.lit("/s"), F.col(key) % 3)).otherwise(""), F.lit(f"/{kind}"), F.col(key))


def pages_placed(spark, d):
    """Nations are containers of their customers' routes; suppliers are the pages that no container lists."""
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation").filter("c_custkey % 4 > 0 AND (nation % 2 = 0 OR c_custkey % 3 = 1)").select(F.concat(F.lit("g"), "nation").alias("container"), _routes("c_custkey", "c").alias("route"))
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation").select(F.col("s_suppkey").alias("page_id"), _routes("s_suppkey", "p").alias("route"))
    return routing.placed_by_route(s, c)


def navigation_steps(spark, d):
    """All orders' paths shrink to those of open orders, three tenths a write at most."""
    path = F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path")
    o = table(spark, d, "orders")
    return routing.navigation_steps(o.select(path), o.filter("o_orderstatus = 'O'").select(path), 0.3, 20).select("path", F.col("step").cast("long").alias("step"))


def archive_problems(spark, d):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    name = F.when(k % 50 == 0, F.concat(F.lit("../"), k)).when(k % 50 == 1, F.concat(F.lit("/etc/"), k)).when(k % 50 == 2, F.concat(F.lit("a..b/"), k)).otherwise(F.concat(F.lit("docs/"), k))
    e = table(spark, d, "lineitem").select(name.alias("name"), (F.col("l_partkey") * 2_000_000).alias("bytes"), (F.col("l_partkey") * F.col("l_suppkey") * 200).alias("packed"), (k % 50 == 3).alias("is_link"))
    return routing.archive_problems(e)


PATHS = ("guide%20#/a+b%2Fc%C3%A9\\x/", "/x/%zz/#//", "/", "%E4%#")


def decoded_paths(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, PATHS)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("given"))
    return p.select("c_custkey", urls.decoded_path(F.replace("given", F.lit("#"), F.col("c_custkey").cast("string"))).alias("path"))


HOSTS = ("HTTP://Www.Example.com", "https://docs.example.com", "https://other.example", "https://help.example.com:8443")


def seed_hosts(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("host"))
    return p.select("c_custkey", urls.on_seed(F.concat("host", F.lit("/p?x="), "c_custkey"), "https://docs.example.com", ["www.example.com", "help.example.com"]).alias("url"))


def proxied_images(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://c.example/~gitbook/image?width=3&url=https%3A%2F%2Ff.example%2Fa%20"), k, F.lit("&q=1"))).when(k % 3 == 1, F.concat(F.lit("https://c.example/a.png?url=https://f.example/"), k)).otherwise(F.concat(F.lit("https://c.example/~gitbook/image?url=local"), k))
    return table(spark, d, "customer").select("c_custkey", urls.unproxied(url).alias("url"))


def markdown_answers(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.when(k % 7 == 0, 404).otherwise(200).alias("status"), F.when(k % 5 == 0, "text/html").otherwise("Text/Markdown; charset=utf-8").alias("media"), F.when(k % 3 == 0, "\ufeff <!DOCTYPE html><p>").when(k % 11 == 0, "\ufeff \n").otherwise("# x").alias("body"))
    return e.select("event_id", urls.markdown_problem(F.col("status"), F.col("media"), F.col("body")).alias("problem"))


def component_signatures(spark, d):
    """Parts as components with platform, depth, children, styles and a definition: what has one signature differs in nothing of these."""
    p = table(spark, d, "part").select(
        F.lit("web").alias("platform"), F.element_at(F.split("p_type", " "), 1).alias("name"), F.create_map(F.lit("tone"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("props"),
        (F.col("p_size") % 2).alias("depth"), F.array(F.element_at(F.split("p_type", " "), -1), F.lit("a")).alias("children"))
    s = sites.full_signatures(p, enums=("tone",))
    return s.groupBy("signature").agg(F.min("name").alias("name"), F.count("*").alias("n"), F.min(F.element_at("props", "tone")).alias("tone"), F.min("depth").cast("long").alias("depth")).drop("signature")


QUERIES = {f.__name__: f for f in (declared_losses, first_differences, gate_source_content, running_order, contract_problems, gate_contract_valid, emoji_outside_code, literal_braces, plan_extension, routes_of_plan, component_decisions, page_titles,
    categories_of_files, drawable_icons, pages_placed, navigation_steps, archive_problems, decoded_paths, seed_hosts, proxied_images, markdown_answers, component_signatures)}

_KEPT = """b AS (SELECT page_id, unnest(range(15)) AS seq FROM pages),
up AS (SELECT page_id, seq, seq AS above, 0 AS up FROM b UNION ALL SELECT page_id, seq, (above - 1) // 2, up + 1 FROM up WHERE above > 0),
s AS (SELECT page_id, seq, bool_or((page_id + above) % 5 = 2) AS gone, bool_or(up = 0 AND (page_id + above) % 5 = 1) AS frame, count(*) - count(*) FILTER ((page_id + above) % 5 = 1) AS depth FROM up GROUP BY ALL),
kept AS (SELECT page_id, seq, depth, (page_id + seq) % 5 = 0 AS note FROM s WHERE NOT gone AND NOT frame)"""
_FIRST = f"""{_KEPT}, p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY list_position([0, 1, 3, 7, 8, 4, 9, 10, 2, 5, 11, 12, 6, 13, 14], seq)) - 1 AS place FROM kept),
x AS (SELECT page_id, place, 'text' AS field, 'x' || seq AS first, 'x' || seq || '!' AS second FROM p WHERE (page_id * 7 + seq) % 13 = 0 AND NOT (page_id % 4 = 0 AND seq = 14)
  UNION ALL SELECT page_id, place, 'props.tone', 't' || (page_id % 3), 'new' FROM p WHERE (page_id * 7 + seq) % 17 = 0 AND NOT (page_id % 4 = 0 AND seq = 14)
  UNION ALL SELECT page_id, place, 'kind', CASE WHEN note THEN 'Note' ELSE 'paragraph' END, NULL FROM p WHERE page_id % 4 = 0 AND seq = 14),
d AS (SELECT page_id, min_by(x, (place, field)) AS x FROM x GROUP BY page_id)"""
_BROKEN = """WITH found(turn, code, below, detail) AS (VALUES (1, 'frontmatter-missing', 0, ''), (1, 'unknown-component', 1, 'Unknown'), (2, 'frontmatter-title-missing', 0, ''), (2, 'expression', 1, 'a + b'),
  (3, 'missing-required-prop', 1, 'Image.alt'), (3, 'invalid-prop-value', 2, 'Columns.cols=4'), (4, 'esm', 2, 'import B from ''./b'''), (5, 'residual-source-syntax', 1, 'admonition'), (6, 'deployment-code-fence', 1, ''),
  (7, 'deployment-attribute-quote', 1, ''), (7, 'invalid-prop-value', 1, 'Card.look=say &quot;hi'), (8, 'editor-only-node', 1, 'draft'), (8, 'executable', 2, 'Script'), (10, 'residual-source-syntax', 1, 'callout'),
  (10, 'residual-source-syntax', 2, 'liquid'), (10, 'expression', 2, '% hint %'), (11, 'residual-source-syntax', 1, 'embed'), (11, 'residual-source-syntax', 1, 'glossary'), (11, 'residual-source-syntax', 1, 'snippet'),
  (11, 'expression', 1, 'snippet.z'), (12, 'residual-source-syntax', 1, 'component'), (12, 'unknown-component', 1, 'Note')),
broken AS (SELECT doc_id AS page_id, code, CASE WHEN below = 0 THEN 1 ELSE CASE WHEN turn = 1 THEN 1 ELSE 4 END + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + below END::BIGINT AS line, detail
  FROM documents JOIN found ON doc_id % 13 = turn)"""
_ROUTE = "'n' || (nation % 7) || CASE WHEN k % 3 > 0 THEN '/s' || (k % 3) ELSE '' END"


def _in_turn(values: list[str | None], key: str) -> str:
    q = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"replace(([{', '.join(q)}])[({key}) % {len(values)} + 1], '#', ({key})::VARCHAR)"


ORACLES = {
    "declared_losses": f"WITH RECURSIVE {_KEPT} SELECT page_id, seq, depth, CASE WHEN note THEN 'tone,width' ELSE 'icon,tone,width' END AS props FROM kept",
    "first_differences": f"WITH RECURSIVE {_FIRST} SELECT page_id, x.place AS place, x.field AS field, x.first AS first, x.second AS second FROM d",
    "gate_source_content": f"WITH RECURSIVE {_FIRST} SELECT 'source-content' AS gate, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS count FROM d",
    "contract_problems": f"{_BROKEN} SELECT page_id, code, line, detail FROM broken",
    "gate_contract_valid": f"{_BROKEN} SELECT 'contract-valid' AS gate, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS count FROM broken",
    "emoji_outside_code": """
      WITH l AS (SELECT doc_id, string_split(replace(coalesce(text, ''), ', ', ' :boom: :no_name: '), chr(10)) AS lines FROM documents)
      SELECT doc_id, md5(array_to_string(list_transform(lines, lambda x, i: CASE WHEN i % 3 = 0 THEN '`' || x || '`' ELSE replace(x, ':boom:', '💥') END), chr(10))) AS md5 FROM l""",
    "literal_braces": """
      WITH l AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), '. ', ' {x} '), ', ', ' <T a={1}> '), chr(10)) AS lines FROM documents)
      SELECT doc_id, md5(array_to_string(list_transform(lines, lambda x, i: CASE WHEN i % 3 = 0 THEN '`' || x || '`' ELSE CASE WHEN i % 3 = 2 THEN '&#105;mport ' ELSE '' END || replace(x, '{x}', '\\{x\\}') END), chr(10))) AS md5 FROM l""",
    "plan_extension": """
      WITH n AS (SELECT c_custkey AS page_id, c_custkey + c_nationkey % 4 AS r FROM customer WHERE c_custkey % 3 > 0), p AS (SELECT c_custkey AS page_id FROM customer WHERE c_custkey % 3 = 0)
      SELECT page_id, '/p' || page_id AS route, 'planned' AS status, NULL::BIGINT AS holder FROM p
      UNION ALL SELECT n.page_id, '/p' || r, CASE WHEN p.page_id IS NULL THEN 'added' ELSE 'refused' END, p.page_id FROM n LEFT JOIN p ON p.page_id = r""",
    "routes_of_plan": "SELECT o_orderkey AS page_id, '/c' || c_custkey AS route, CASE WHEN c_custkey IS NOT NULL AND o_orderstatus <> 'F' THEN c_mktsegment ELSE o_orderpriority END AS reason FROM orders LEFT JOIN customer ON c_custkey = o_orderkey",
    "component_decisions": """
      WITH p AS (SELECT p_partkey AS component_id, string_split(p_type, ' ')[-1] AS name, p_brand, p_size % 3 = 0 AND p_brand NOT LIKE '%2' AS planned FROM part)
      SELECT component_id, CASE WHEN planned THEN 'plan' WHEN name < 'C' THEN 'rule' WHEN name < 'P' THEN 'handler' ELSE 'unresolved' END AS decided_by,
        CASE WHEN planned AND p_brand LIKE '%3' THEN 'Card' WHEN planned THEN 'approved' WHEN name < 'C' THEN 'R' || name END AS outcome FROM p""",
    "page_titles": """
      SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'H' ELSE 'API start ' || c_custkey END AS title,
        CASE WHEN c_custkey % 3 = 0 THEN 'listed' WHEN c_custkey % 2 = 1 AND c_custkey % 5 = 0 THEN 'heading' ELSE 'path' END AS title_source FROM customer""",
    "categories_of_files": """
      WITH f AS (SELECT c_nationkey AS workspace, c_custkey AS k FROM customer WHERE c_custkey % 3 > 0),
      e AS (SELECT c.c_nationkey AS workspace, c_custkey AS entry_id, a.k AS own, b.k AS next FROM customer c LEFT JOIN f a ON a.workspace = c_nationkey AND a.k = c_custkey AND c_custkey % 2 = 0
        LEFT JOIN f b ON b.workspace = c_nationkey AND b.k = c_custkey + 1)
      SELECT workspace, entry_id, coalesce(own, next) * 10 AS file_id, CASE WHEN own IS NOT NULL THEN 'slug' WHEN next IS NOT NULL THEN 'title' END AS matched_by FROM e
      UNION ALL SELECT workspace, NULL, k * 10, NULL FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.workspace = f.workspace AND coalesce(own, next) = f.k)""",
    "drawable_icons": f"SELECT p_partkey, {_in_turn(list(ICONS), 'p_partkey')} AS icon, {_in_turn(['circle-check', 'solid', 'zap', 'house', None, 'house', None, None], 'p_partkey')} AS drawn FROM part",
    "pages_placed": f"""
      WITH c AS (SELECT 'g' || nation AS g, {_ROUTE} || '/c' || k AS r FROM (SELECT c_nationkey AS nation, c_custkey AS k FROM customer) WHERE k % 4 > 0 AND (nation % 2 = 0 OR k % 3 = 1)),
      s AS (SELECT k AS page_id, {_ROUTE} AS folder FROM (SELECT s_nationkey AS nation, s_suppkey AS k FROM supplier)),
      t AS (SELECT g, count(*) AS total, count(DISTINCT regexp_replace(r, '/[^/]*$', '')) AS folders, min(regexp_replace(r, '/[^/]*$', '')) AS a, min(split_part(r, '/', 1)) AS top, min(r) AS only_one FROM c GROUP BY g),
      i AS (SELECT folder, g, total, count(*) AS inside FROM (SELECT DISTINCT folder FROM s) JOIN c ON starts_with(r, folder || '/') JOIN t USING (g) GROUP BY ALL HAVING count(*) * 2 > total),
      h AS (SELECT folder, min_by(g, (-inside, total, g)) AS home FROM i GROUP BY folder),
      p AS (SELECT g, total, CASE WHEN total = 1 THEN only_one WHEN folders = 1 THEN a ELSE top END AS prefix FROM t),
      w AS (SELECT page_id, min_by(g, (-len(prefix), -total, g)) AS wide FROM s JOIN p ON starts_with(folder || '/', prefix || '/') GROUP BY page_id)
      SELECT s.page_id, coalesce(home, wide) AS container, CASE WHEN home IS NOT NULL THEN 'folder' WHEN wide IS NOT NULL THEN 'prefix' END AS placed_by FROM s LEFT JOIN h USING (folder) LEFT JOIN w ON w.page_id = s.page_id""",
    "navigation_steps": """
      WITH RECURSIVE n AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS after, count(*) FILTER (o_orderstatus <> 'O') AS stale FROM orders),
      s AS (SELECT 1 AS step, 0::BIGINT AS low, greatest(1, floor((after + stale) * 0.3))::BIGINT AS high, after, stale FROM n
        UNION ALL SELECT step + 1, high, high + greatest(1, floor((after + stale - high) * 0.3))::BIGINT, after, stale FROM s WHERE high < stale),
      p AS (SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS path, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 9, '0')) - 1 AS place FROM orders WHERE o_orderstatus <> 'O')
      SELECT path, step::BIGINT AS step FROM p JOIN s ON place >= low AND place < high""",
    "archive_problems": """
      WITH e AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey * 2000000 AS bytes, l_partkey * l_suppkey * 200 AS packed FROM lineitem),
      p AS (SELECT CASE k % 50 WHEN 0 THEN '../' WHEN 1 THEN '/etc/' WHEN 2 THEN 'a..b/' ELSE 'docs/' END || k AS name,
        CASE WHEN k % 50 = 3 THEN 'link' WHEN k % 50 < 2 THEN 'traversal' WHEN bytes > 209715200 THEN 'size' WHEN bytes > packed * 1000 THEN 'ratio' END AS problem FROM e)
      SELECT name, problem FROM p WHERE problem IS NOT NULL""",
    "decoded_paths": f"SELECT c_custkey, {_in_turn(['/guide #/a+b%2Fcé/x', '/x/%zz/#', '/', '/%E4%#'], 'c_custkey')} AS path FROM customer",
    "seed_hosts": f"SELECT c_custkey, {_in_turn(['https://docs.example.com', 'https://docs.example.com', 'https://other.example', 'https://docs.example.com'], 'c_custkey')} || '/p?x=' || c_custkey AS url FROM customer",
    "proxied_images": f"SELECT c_custkey, {_in_turn(['https://f.example/a #', 'https://c.example/a.png?url=https://f.example/#', 'https://c.example/~gitbook/image?url=local#'], 'c_custkey')} AS url FROM customer",
    "markdown_answers": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'status' WHEN event_id % 5 = 0 THEN 'media-type' WHEN event_id % 3 = 0 THEN 'html-document' WHEN event_id % 11 = 0 THEN 'empty' END AS problem FROM events""",
    "component_signatures": """
      SELECT string_split(p_type, ' ')[1] AS name, count(*) AS n, p_brand AS tone, p_size % 2 AS depth FROM part GROUP BY 1, 3, 4, string_split(p_type, ' ')[-1]""",
}
