"""Components of a source turned into blocks of the target: decisions for all at once, then rewriting level by level from the deepest.

A tree is rows with parent pointers and order keys (arrays of numbers, compared from the
left). Lifting a node's children therefore touches only those children: their key becomes
the node's key followed by their own. Each level meets its children in one join on equal
keys and one window per parent; materialised paths are rebuilt once, at the end, from the
top, and what hangs beneath something that went is not reached there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import urls
from foliograph.operators import rules as matching
from foliograph.operators.lookups import looked_up
from foliograph.operators.trees import with_paths
from foliograph.workspace import written

#: What rules are made of; a rule has a handler, a target, or says what becomes of its children (unwrap, drop).
RULES = "rule_id string, platform string, ord int, name string, class string, props map<string,string>, to_name string, to_props map<string,string>, children string, drop array<string>, drop_expressions array<string>, handler string"
PLAN = "signature string, status string, reason string, rule_id string"
#: The lowest and the highest number of columns, and the one used where a source states none.
COLUMNS = (2, 4, 3)
FRAMED_HOSTS = ("youtube.com", "youtu.be", "player.vimeo.com", "www.loom.com")
#: Properties each handler carries over; others that an author set are losses.
READS = {
    "cards-to-columns": ("cols", "columns"), "columns-count-children": (), "tabs": (), "list-to-steps": (), "faq-to-expandable-group": (), "anchor-div-to-heading": ("id",),
    "to-card": ("title", "href", "description", "icon", "image", "cta", "repo", "horizontal"), "color-row-to-titled-group": ("title",), "color-item-to-card": ("name", "value"),
    "tree-file-to-text": ("name",), "prompt-to-code": ("description", "actions"), "grid-to-columns": ("className", "class"), "html-heading-to-heading": (), "html-rule-to-thematic-break": (),
    "view-to-expandable": ("title", "icon"), "frame-to-image": ("caption",), "step-title-from-heading": (), "embed-to-iframe": ("src", "url", "title"), "embed-to-iframe-or-link": ("src", "url", "title"),
    "live-demo-to-card": (), "tooltip-to-abbr": ("tip", "title", "content", "text"), "badge-to-span": ("text", "label"), "item-to-step": (),
}
_STRINGS = "array<string>"
_PROPS = "map<string,string>"
_ROW = ["node", "parent", "key", "kind", "name", "level", "text", "url", "props", "bold", "source_id", "reason", "rule_id", "says"]


def decided(components: DataFrame, rules: DataFrame, plan: DataFrame) -> DataFrame:
    """components (page_id, node, platform, name, props, style_deps, expressions, signature) with ``act`` (drop, quarantine, unwrap, to,
    handler, preserve), ``reason`` and ``rule``.

    The plan's word on a signature comes first: excluded goes with all beneath, quarantined is held. A property that is an expression
    holds a component back unless its rule drops it, the rule emits nothing, or the plan approves the signature. Then the rule that
    the plan names, else the first that matches (the platform's own before general ones); what has none is preserved."""
    p = plan.groupBy("signature").agg(F.min_by(F.struct("status", F.col("reason").alias("plan_reason"), F.col("rule_id").alias("plan_rule")), F.struct("status", "reason", "rule_id")).alias("plan"))
    c = components.withColumnRenamed("node", "node_id")
    found = looked_up(matching.matched(c, rules).withColumnRenamed("rule", "first_rule"), p, "signature")
    named = rules.select(F.col("rule_id").alias("plan_rule"), F.struct(*[F.col(x).alias(f"r_{x}") for x in rules.columns]).alias("named_rule")).dropDuplicates(["plan_rule"])
    found = looked_up(found.withColumn("plan_rule", F.col("plan.plan_rule")), named.filter("plan_rule IS NOT NULL"), "plan_rule")
    first = F.col("first_rule")
    given_up = F.concat(F.coalesce(first["r_drop"], F.array().cast(_STRINGS)), F.coalesce(first["r_drop_expressions"], F.array().cast(_STRINGS)))
    blocking = F.array_sort(F.array_except(F.coalesce("expressions", F.array().cast(_STRINGS)), given_up))
    emits_nothing = F.coalesce((first["r_children"] == "drop") & first["r_to_name"].isNull() & first["r_handler"].isNull(), F.lit(False))
    held = (F.size(blocking) > 0) & ~emits_nothing & ~F.coalesce(F.col("plan.status") == "approved", F.lit(False))
    rule = F.when(F.col("plan_rule").isNotNull(), F.col("named_rule")).otherwise(first)
    act = (
        F.when(F.col("plan.status") == "excluded", "drop")
        .when((F.col("plan.status") == "quarantined") | held, "quarantine")
        .when(F.col("rule").isNull(), "preserve")
        .when(F.col("rule.r_handler").isNotNull(), "handler")
        .when(F.col("rule.r_children").isin("unwrap", "drop"), F.col("rule.r_children"))
        .otherwise("to")
    )
    why = F.when(F.col("plan.status").isin("excluded", "quarantined"), F.coalesce("plan.plan_reason", F.concat(F.lit("plan: "), F.col("plan.status"))))
    why = why.when(held, F.concat(F.lit("expression: "), F.array_join(blocking, ", "))).when(F.col("rule").isNull(), F.concat(F.lit("no rule for "), F.col("signature")))
    out = found.withColumn("rule", rule).withColumns({"act": act, "reason": why})
    return out.withColumnRenamed("node_id", "node").select(*components.columns, "act", "reason", "rule")


def _given(c: str, *names: str) -> Column:
    """The first of the properties that says something, trimmed; null if none does."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(c, F.lit(n))), F.lit("")) for n in names])


def _map(**values: Column) -> Column:
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def _nodes(blocks: DataFrame, rules: DataFrame, plan: DataFrame) -> DataFrame:
    """All blocks with what is decided on them; an ordered list that becomes steps, and its items, are decided here as well."""
    path = F.col("path")
    name_of = lambda p: F.array_join(p, ".")
    b = blocks.withColumns({"node": name_of(path), "parent": name_of(F.slice(path, F.lit(1), F.size(path) - 1)), "key": F.slice(path, -1, 1), "depth": F.size(path)})
    is_component = F.coalesce(F.col("kind") == "component", F.lit(False))
    # neither components nor other blocks move for what is decided
    b = decided(b.filter(is_component), rules, plan).unionByName(b.filter(~is_component), allowMissingColumns=True)
    steps = b.filter("act = 'handler' AND rule.r_handler = 'list-to-steps'").select("page_id", F.col("node").alias("parent"))
    ordered = b.filter((F.col("kind") == "list") & (F.try_element_at("props", F.lit("ordered")) == "true")).join(steps.hint("merge"), ["page_id", "parent"])
    lists = ordered.groupBy("page_id", "parent").agg(F.min_by("node", "key").alias("node")).select("page_id", "node", F.lit("unwrap").alias("as_step"))
    items = b.filter("kind = 'listItem'").join(lists.select("page_id", F.col("node").alias("parent")).hint("merge"), ["page_id", "parent"]).select("page_id", "node", F.lit("item-to-step").alias("as_step"))
    of_lists = F.coalesce(F.col("kind").isin("list", "listItem"), F.lit(False))
    told = b.filter(of_lists).join(lists.union(items).hint("merge"), ["page_id", "node"], "left")
    b = told.unionByName(b.filter(~of_lists), allowMissingColumns=True)
    act = F.when(F.col("as_step") == "unwrap", "unwrap").when(F.col("as_step").isNotNull(), "handler").otherwise(F.col("act"))
    return b.withColumns({"act": act, "handler": F.coalesce("as_step", "rule.r_handler"), "rule_id": F.col("rule.r_rule_id")}).drop("as_step")


def _fates(carry: DataFrame, here: DataFrame) -> DataFrame:
    """Children with ``pos``, ``n``, ``lead_kind``, their parent's decision (act, handler, own) and ``fate``: keep, eat, lift, inner
    (beneath a node the handler adds), open (transparent: its children stand in its place) or a name they take."""
    told = here.select("page_id", F.col("node").alias("parent"), "act", "handler", F.col("props").alias("own"), F.col("key").alias("above_key"), F.col("parent").alias("above"))
    among = Window.partitionBy("page_id", "parent")
    c = carry.join(told.hint("merge"), ["page_id", "parent"])
    c = c.withColumns({"pos": F.row_number().over(among.orderBy("key", "node")), "n": F.count("*").over(among), "lead_kind": F.first("kind").over(among.orderBy("key", "node"))})
    c = c.withColumn("image_pos", F.min(F.when(F.col("kind") == "image", F.col("pos"))).over(among))
    said, kind, h = F.trim(F.coalesce("text", F.lit(""))) != "", F.col("kind"), F.col("handler")
    titles_step = (F.col("pos") == 1) & said & ((kind == "heading") | ((kind == "paragraph") & F.coalesce("bold", F.lit(False))))
    card_titled = _given("own", "title", "repo").isNotNull()
    card_image = (F.col("pos") == F.col("image_pos")) & _given("own", "image").isNull()
    is_anchor = _given("own", "id").isNotNull() & (F.col("lead_kind") == "heading")
    of_handler = (
        F.when(h.isin("html-heading-to-heading", "prompt-to-code", "color-item-to-card", "tree-file-to-text", "html-rule-to-thematic-break", "embed-to-iframe", "embed-to-iframe-or-link", "tooltip-to-abbr", "badge-to-span"), "eat")
        .when(h == "cards-to-columns", F.when(_whole_or_none(_given("own", "cols", "columns")), "keep").otherwise("eat"))
        .when((h == "columns-count-children") & (F.col("name") == "Column"), "open")
        .when((h == "tabs") & kind.isin("component", "preserved"), "Tab")
        .when((h == "faq-to-expandable-group") & kind.isin("component", "preserved"), "Expandable")
        .when(h == "anchor-div-to-heading", F.when(is_anchor, "lift").otherwise("eat"))
        .when(h == "to-card", F.when(card_image | (~card_titled & (kind != "image")), "eat").otherwise("keep"))
        .when(h == "color-row-to-titled-group", F.when(_given("own", "title").isNotNull(), "inner").otherwise("keep"))
        .when(h == "grid-to-columns", F.when((kind == "paragraph") & ~said, "eat").otherwise("keep"))
        .when(h == "frame-to-image", F.when((F.col("n") == 1) & (kind == "image") & _given("own", "caption").isNotNull(), "eat").otherwise("lift"))
        .when(h == "step-title-from-heading", F.when(titles_step, "eat").otherwise("keep"))
        .when(h == "item-to-step", F.when((F.col("pos") == 1) & (kind == "paragraph"), "eat").otherwise("keep"))
        .otherwise("keep")
    )
    act = F.col("act")
    fate = F.when(act.isin("drop", "quarantine"), "eat").when(act == "unwrap", "lift").when(act == "handler", of_handler).otherwise("keep")
    return c.withColumn("fate", fate)


def _whole_or_none(stated: Column) -> Column:
    return stated.isNull() | stated.rlike(r"^-?\d+$")


def _children(c: DataFrame) -> DataFrame:
    """Children as their parents leave them; ``up``: they now hang where their parent did."""
    lifted, renamed = F.col("fate") == "lift", F.col("fate").isin("Tab", "Expandable")
    title = F.when(F.col("fate") == "Tab", F.coalesce(_given("props", "title", "label"), F.lit("Tab"))).otherwise(F.coalesce(_given("props", "summary", "title", "question"), F.lit("Details")))
    anchored = (F.col("handler") == "anchor-div-to-heading") & (F.col("pos") == 1)
    new = {
        "parent": F.when(lifted, F.col("above")).when(F.col("fate") == "inner", F.concat("parent", F.lit(":cols"))).otherwise(F.col("parent")),
        "key": F.when(lifted, F.concat("above_key", "key")).otherwise(F.col("key")),
        "kind": F.when(F.col("fate") == "open", "open").when(renamed, "component").otherwise(F.col("kind")),
        "name": F.when(renamed, F.col("fate")).otherwise(F.col("name")),
        "props": F.when(renamed, _map(title=title)).otherwise(F.col("props")),
        "source_id": F.when(anchored, _given("own", "id")).otherwise(F.col("source_id")),
    }
    return c.filter("fate <> 'eat'").select("page_id", *[new.get(x, F.col(x)).alias(x) for x in _ROW], lifted.alias("up"))


def _summary(c: DataFrame) -> DataFrame:
    """What each parent needs to know of its children."""
    wants_text = F.col("handler").isin("html-heading-to-heading", "prompt-to-code", "to-card", "tooltip-to-abbr", "badge-to-span") & (F.col("kind") != "image") & (F.trim("text") != "")
    first = lambda x: F.first(x, ignorenulls=True)
    s = c.groupBy("page_id", "parent").agg(
        F.count("*").alias("n"), F.count_if(F.col("name") == "Column").alias("n_columns"), F.bool_or("says").alias("children_say"),
        first(F.when(F.col("pos") == 1, F.struct("kind", "text", "level", "bold", "url"))).alias("lead"),
        first(F.when(F.col("pos") == F.col("image_pos"), F.col("url"))).alias("image_url"),
        F.array_sort(F.collect_list(F.when(wants_text, F.struct("pos", "text")))).alias("ts"),
    )
    return s.select("page_id", F.col("parent").alias("node"), "n", "n_columns", "children_say", "lead", "image_url", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("said"))


def _resolved_props(value_maps: dict[str, str]) -> Column:
    """The target's properties: constants, ``$count`` (children), ``$name`` (that property) or ``$map(name)`` (its value, lower-cased,
    by value_maps: "Target.property.value" to value). A property that the source lacks is left out."""
    known = F.create_map(*[F.lit(x) for kv in value_maps.items() for x in kv]) if value_maps else F.create_map().cast(_PROPS)
    own = lambda n: F.try_element_at("props", n)

    def of(k: Column, v: Column) -> Column:
        mapped = F.regexp_extract(v, r"^\$map\(([\w-]+)\)$", 1)
        low = F.lower(own(mapped))
        by_map = F.coalesce(F.try_element_at(known, F.concat_ws(".", "rule.r_to_name", k, low)), F.try_element_at(known, F.concat_ws(".", "rule.r_to_name", mapped, low)), low)
        return F.when(v == "$count", F.col("n").cast("string")).when(mapped != "", by_map).when(v.startswith("$"), own(F.substring(v, 2, 10**6))).otherwise(v)

    return F.map_filter(F.transform_values(F.coalesce("rule.r_to_props", F.create_map().cast(_PROPS)), of), lambda k, v: v.isNotNull())


def _row(kind, name=None, props=None, text=None, level=None, url=None, suffix="", reason=None, key=None, parent=None, says=True, keep=False) -> Column:
    """One emitted row; with ``keep`` the columns not named stay as they are in the source."""
    none = lambda kind_, c: F.col(c) if keep else F.lit(None).cast(kind_)
    made = {
        "node": F.concat("node", F.lit(suffix)) if suffix else F.col("node"),
        "parent": F.col("parent") if parent is None else parent,
        "key": F.col("key") if key is None else key,
        "kind": kind if isinstance(kind, Column) else F.lit(kind),
        "name": none("string", "name") if name is None else (name if isinstance(name, Column) else F.lit(name)),
        "level": none("int", "level") if level is None else level,
        "text": none("string", "text") if text is None else text,
        "url": none("string", "url") if url is None else url,
        "props": (F.col("props") if keep else F.create_map().cast(_PROPS)) if props is None else props,
        "bold": none("boolean", "bold"),
        "source_id": none("string", "source_id"),
        "reason": F.lit(None).cast("string") if reason is None else (reason if isinstance(reason, Column) else F.lit(reason)),
        "rule_id": F.col("rule_id"),
        "says": says if isinstance(says, Column) else F.lit(says),
    }
    return F.struct(*[made[c].alias(c) for c in _ROW])


def _emitted(nodes: DataFrame, value_maps: dict[str, str]) -> DataFrame:
    """The rows that stand for each node once its children are settled."""
    h, given, lead, one = F.col("handler"), lambda *n: _given("props", *n), F.col("lead"), lambda *rows: F.array(*rows)
    says = (F.trim(F.coalesce("text", F.lit(""))) != "") | F.coalesce("children_say", F.lit(False)) | F.col("kind").isin("image", "code", "thematicBreak")
    held = lambda why: one(_row("quarantined", F.col("name"), reason=why))
    after = lambda n: F.concat("key", F.array(F.lit(n)))
    inside = lambda s: F.concat("node", F.lit(s)) if s else F.col("node")
    lowest, highest, usual = COLUMNS
    clamp = lambda c: F.least(F.lit(highest), F.greatest(F.lit(lowest), c))
    stated_cols = given("cols", "columns")
    named = lambda name, **p: _row("component", name, _map(**p))
    grid = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(given("className", "class"), F.lit("")), F.lit(r"(?:^|[\s:])grid-cols-(\d+)(?=\s|$)"), F.lit(1)), lambda x: x.cast("int")))
    lead_title = F.when((lead["kind"] == "heading") | ((lead["kind"] == "paragraph") & F.coalesce(lead["bold"], F.lit(False))), F.nullif(F.trim(lead["text"]), F.lit("")))
    title_type = F.when((lead["kind"] == "heading") & lead_title.isNotNull(), F.when(lead["level"] <= 2, "h2").otherwise("h3"))
    src = given("src", "url")
    host = F.lower(urls.part(F.coalesce(src, F.lit("")), 2))
    framed = host.isin(*FRAMED_HOSTS) | F.lit(False)
    for site in FRAMED_HOSTS:
        framed = framed | host.endswith("." + site)
    iframe = named("Iframe", src=F.coalesce(urls.video_player(src), src), title=F.coalesce(given("title"), F.lit("Embedded content")))
    only_image = (F.col("n") == 1) & (lead["kind"] == "image")
    attribute = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    content = lambda c: F.replace(c, F.lit("<"), F.lit("&lt;"))
    words = F.coalesce(F.nullif(F.trim("said"), F.lit("")), given("text", "label"), F.lit(""))
    repo = given("repo")
    card = named("Card", title=F.coalesce(given("title"), repo, F.nullif(F.trim("said"), F.lit("")), F.lit("Card")), href=F.coalesce(given("href"), F.concat(F.lit("https://github.com/"), repo)), image=F.coalesce(given("image"), F.col("image_url")), icon=given("icon"))
    step = lambda t, more=None: _row("component", "Step", _map(title=t, titleType=more) if more is not None else _map(title=t))
    caption = given("caption")
    of_handler = (
        F.when(h == "cards-to-columns", F.when(_whole_or_none(stated_cols), one(named("Columns", cols=clamp(F.coalesce(stated_cols.cast("int"), F.lit(usual)))))).otherwise(held("cols is no whole number")))
        .when(h == "columns-count-children", one(named("Columns", cols=clamp(F.coalesce(F.nullif(F.col("n_columns").cast("int"), F.lit(0)), F.lit(2))))))
        .when(h == "tabs", one(named("Tabs")))
        .when(h == "list-to-steps", one(named("Steps")))
        .when(h == "faq-to-expandable-group", one(named("ExpandableGroup")))
        .when(h == "anchor-div-to-heading", F.when(given("id").isNotNull() & (F.col("n") == 0), one(_row("anchor", text=given("id")))).when(given("id").isNotNull() & (lead["kind"] == "heading"), one()).otherwise(held("no heading leads it")))
        .when(h == "to-card", F.when(given("description").isNotNull(), one(card, _row("paragraph", text=given("description"), suffix=":desc", parent=inside(""), key=F.array(F.lit(-1))))).otherwise(one(card)))
        .when(h == "color-row-to-titled-group", F.when(given("title").isNotNull(), one(named("Expandable", title=given("title"), defaultOpen=F.lit("true")), _row("component", "Columns", _map(cols=F.lit(3)), suffix=":cols", parent=inside(""), key=F.array(F.lit(0))))).otherwise(one(named("Columns", cols=F.lit(3)))))
        .when(h == "color-item-to-card", F.when(given("name", "value").isNull(), held("neither name nor value")).when(given("value").isNull(), one(named("Card", title=given("name")))).otherwise(one(named("Card", title=given("name", "value")), _row("code", text=given("value"), suffix=":val", parent=inside(""), key=F.array(F.lit(0))))))
        .when(h == "tree-file-to-text", F.when(given("name").isNull(), held("no name")).otherwise(one(_row("paragraph", text=given("name")))))
        .when(h == "prompt-to-code", F.when(F.trim("said") == "", held("no text to copy")).when(given("description").isNull(), one(_row("code", text=F.col("said")))).otherwise(one(_row("paragraph", text=given("description"), suffix=":desc", key=after(0)), _row("code", text=F.col("said"), key=after(1)))))
        .when(h == "grid-to-columns", one(named("Columns", cols=clamp(F.coalesce(grid, F.lit(lowest))))))
        .when(h == "html-heading-to-heading", F.when(F.trim("said") == "", held("no text")).otherwise(one(_row("heading", text=F.replace("said", F.lit("\n"), F.lit("")), level=F.coalesce(F.nullif(F.regexp_extract("name", r"^[hH]([1-6])$", 1), F.lit("")).cast("int"), F.lit(2))))))
        .when(h == "html-rule-to-thematic-break", one(_row("thematicBreak")))
        .when(h == "view-to-expandable", one(named("Expandable", title=F.coalesce(given("title"), F.lit("View")))))
        .when(h == "frame-to-image", F.when(caption.isNull(), one()).when(only_image, one(_row("figure", text=caption, url=lead["url"]))).otherwise(one(_row("paragraph", text=caption, suffix=":cap", key=after(10**9)))))
        .when(h == "step-title-from-heading", one(step(F.coalesce(lead_title, F.lit("Step")), title_type)))
        .when(h == "item-to-step", one(step(F.when(lead["kind"] == "paragraph", F.substring(lead["text"], 1, 120)).otherwise("Step"))))
        .when(h == "embed-to-iframe", F.when(framed, one(iframe)).otherwise(held(F.concat(F.lit("host not allowed: "), host))))
        .when(h == "embed-to-iframe-or-link", F.when(framed, one(iframe)).when(F.coalesce(src, F.lit("")).rlike("^(?i)https?://"), one(_row("paragraph", text=src, url=src))).otherwise(held(F.concat(F.lit("host not allowed: "), host))))
        .when(h == "live-demo-to-card", one(_row("component", "Card", _map(title=F.coalesce(F.try_element_at("rule.r_to_props", F.lit("title")), F.col("name")), href=F.try_element_at("rule.r_to_props", F.lit("href"))))))
        .when(h == "tooltip-to-abbr", one(_row("html", text=F.concat(F.lit('<abbr title="'), attribute(F.coalesce(given("tip", "title", "content"), F.lit(""))), F.lit('">'), content(words), F.lit("</abbr>")))))
        .when(h == "badge-to-span", one(_row("html", text=F.concat(F.lit("<span>"), content(words), F.lit("</span>")))))
        .otherwise(held(F.concat(F.lit("unknown handler "), h)))
    )
    nothing = F.filter(one(_row("none")), lambda x: F.lit(False))
    of_handler = F.filter(of_handler, lambda x: x["kind"].isNotNull())
    act = F.col("act")
    rows = (
        F.when(act.isNull(), one(_row(F.col("kind"), keep=True, says=says)))
        .when(act == "quarantine", one(_row("quarantined", F.col("name"), reason=F.col("reason"))))
        .when(act.isin("drop", "unwrap"), nothing)
        .when(act == "preserve", F.when(says, one(_row("preserved", F.col("name"), text=F.col("text"), reason=F.col("reason")))).otherwise(held(F.col("reason"))))
        .when(act == "to", one(_row("component", F.col("rule.r_to_name"), _resolved_props(value_maps), text=F.col("text"), says=says)))
        .otherwise(of_handler)
    )
    return nodes.select("page_id", "node", F.explode(rows).alias("r")).select("page_id", "r.*", ((F.col("r.parent") != F.col("node"))).alias("up"))


def _opened(rows: DataFrame) -> DataFrame:
    """rows without those of kind ``open``; their children stand in their place."""
    opened = rows.filter("kind = 'open'").select("page_id", F.col("node").alias("parent"), F.col("parent").alias("open_parent"), F.col("key").alias("open_key"))
    r = rows.filter("kind <> 'open'").join(opened.hint("merge"), ["page_id", "parent"], "left")
    return r.withColumns({"key": F.when(F.col("open_key").isNotNull(), F.concat("open_key", "key")).otherwise(F.col("key")), "parent": F.coalesce("open_parent", "parent")}).drop("open_key", "open_parent")


def converted(blocks: DataFrame, rules: DataFrame, plan: DataFrame, value_maps: dict[str, str] | None = None) -> DataFrame:
    """page_id, path, node (the source's path, joined by points, with a suffix where a handler adds rows), kind, name, level, text, url,
    props, source_id, reason, rule_id of blocks (page_id, path, kind, platform, name, level, text, url, bold, props, style_deps,
    expressions, signature).

    Children are settled before their parents. Kinds that appear: quarantined (with a reason; all beneath is gone), preserved
    (no rule; children stay), figure, anchor, html. A first block of a step that isn't its title stays, and so do a card's images
    beyond the one it shows. Other blocks than components stay as they are."""
    nodes = written(_nodes(blocks, rules, plan), "decided", by=["depth"])
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    blank = {"source_id": F.lit(None).cast("string"), "says": F.lit(False)}
    carry, done = None, []
    for d in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == d).withColumns(blank)
        if carry is None:
            out = _emitted(here.withColumns({"n": F.lit(0), "n_columns": F.lit(0), "children_say": F.lit(False), "lead": F.lit(None).cast("struct<kind:string,text:string,level:int,bold:boolean,url:string>"), "image_url": F.lit(None).cast("string"), "said": F.lit("")}), value_maps or {})
        else:
            c = written(_fates(carry, here), "children")
            about = here.join(_summary(c).hint("merge"), ["page_id", "node"], "left").fillna({"n": 0, "n_columns": 0, "children_say": False, "said": ""})
            out = _emitted(about, value_maps or {}).unionByName(_children(c))
        out = written(out, "level")
        carry = out.filter("up").drop("up")
        done.append(out.filter("NOT up").drop("up"))
    if carry is None:
        return nodes.select("page_id", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("node", "string"), ("kind", "string"), ("name", "string"), ("level", "int"), ("text", "string"), ("url", "string"), ("props", _PROPS), ("source_id", "string"), ("reason", "string"), ("rule_id", "string"))])
    for part in done:
        carry = carry.union(part)
    return with_paths(_opened(carry), ["page_id"]).select("page_id", "path", "node", "kind", "name", "level", "text", "url", "props", "source_id", "reason", "rule_id")


def dispositions(blocks: DataFrame, rules: DataFrame, plan: DataFrame) -> DataFrame:
    """page_id, node, disposition, reason, lossy of every source block: what is beneath an excluded or quarantined component shares its
    fate, other components are ``transformed`` (lossy: properties that neither the target nor a drop takes), the rest ``identical``.

    Only decisions count here, not what handlers find in children. A block meets the components above it on prefixes of its path."""
    n = written(_nodes(blocks, rules, plan), "decided")
    ends = n.filter("act IN ('drop', 'quarantine')").select("page_id", F.col("path").alias("prefix"), F.struct(F.size("path").alias("at"), F.when(F.col("act") == "drop", "excluded").otherwise("quarantined").alias("how"), F.coalesce("reason", F.concat(F.lit("dropped by "), "rule_id")).alias("why")).alias("end"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))
    # the uppermost end holds: what it takes is never looked at again
    met = n.select("page_id", "node", F.explode(prefixes).alias("prefix")).join(ends.hint("merge"), ["page_id", "prefix"]).groupBy("page_id", "node").agg(F.min("end").alias("end"))
    to = F.coalesce(F.map_values("rule.r_to_props"), F.array().cast(_STRINGS))
    copied = F.transform(F.filter(to, lambda v: v.startswith("$")), lambda v: F.regexp_replace(v, r"^\$(?:map\()?([\w-]+)\)?$", "$1"))
    reads = F.create_map(*[x for k, v in READS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast(_STRINGS))])
    used = F.when(F.col("act") == "handler", F.try_element_at(reads, F.col("handler"))).when(F.col("act") == "to", copied)
    used = F.concat(F.coalesce(used, F.array().cast(_STRINGS)), F.coalesce("rule.r_drop", F.array().cast(_STRINGS)))
    lossy = F.array_sort(F.array_except(F.map_keys(F.map_filter("props", lambda k, v: v.isNotNull())), used))
    is_component = F.col("act").isNotNull() & F.col("end").isNull()
    how = F.coalesce("end.how", F.when(F.col("act").isNotNull(), "transformed").otherwise("identical"))
    return n.join(met.hint("merge"), ["page_id", "node"], "left").select("page_id", "node", how.alias("disposition"), F.coalesce("end.why", F.when(is_component, F.coalesce("rule_id", "reason"))).alias("reason"), F.when(is_component & (F.col("act") != "preserve"), lossy).otherwise(F.array().cast(_STRINGS)).alias("lossy"))
