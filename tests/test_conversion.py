"""Component conversion against a recursive walk over nested trees."""

import random
import re

import pytest

from foliograph.operators import conversion as cv

BLOCKS = "page_id long, path array<int>, kind string, platform string, name string, level int, text string, url string, bold boolean, props map<string,string>, style_deps array<string>, expressions array<string>, signature string"
HANDLERS = sorted(set(cv.READS) - {"item-to-step"})


def rule(rule_id, name, platform="*", ord=1, to=None, props=None, children=None, drop=(), drop_expressions=(), handler=None, match=None, cls=None):
    return (rule_id, platform, ord, name, cls, match or {}, to, props or {}, children, list(drop), list(drop_expressions), handler)


RULES = [
    *[rule(f"h/{h}", {"html-heading-to-heading": "h3"}.get(h, f"N-{h}"), handler=h, props={"title": "Demo", "href": "https://d.example"} if h == "live-demo-to-card" else None) for h in HANDLERS],
    rule("note", "Note", to="Callout", props={"kind": "$map(type)", "n": "$count", "title": "$title", "fixed": "yes"}, drop=["color"], drop_expressions=["icon"]),
    rule("note/own", "Note", platform="md", ord=9, to="Aside", props={"by": "$author-name"}),
    rule("frame", "Box", children="unwrap"), rule("gone", "Script", children="drop"), rule("big", "Any", ord=2, to="Big", match={"size": "any"}), rule("any", "Any", ord=5, children="unwrap"),
    rule("classed", "Styled", to="Styled", cls="wide"), rule("chosen", "never", to="Chosen", props={"t": "$title"}),
]
PLAN = [("s-out", "excluded", None, None), ("s-hold", "quarantined", "later", None), ("s-ok", "approved", None, None), ("s-rule", "approved", None, "chosen"), ("s-open", "open", None, None)]
MAPS = {"Callout.kind.warn": "warning", "Callout.type.tip": "hint"}
NAMES = [r[3] for r in RULES if r[3] != "never"] + ["Column", "Unknown", "Tab"]


def tree(rng, depth=0):
    """Nested nodes: dicts with kids."""
    kind = rng.choice(["component"] * 5 + ["paragraph", "heading", "image", "code", "list"]) if depth < 4 else rng.choice(["paragraph", "heading", "image", "code"])
    node = {"kind": kind, "name": None, "level": None, "text": rng.choice(["", " ", "some text", "Title ", "a < b"]) if kind in ("paragraph", "heading", "code") else None, "url": f"/{rng.randint(1, 9)}.png" if kind == "image" else None, "bold": rng.random() < 0.4, "props": {}, "style_deps": [], "expressions": [], "signature": None, "platform": rng.choice(["md", "html"]), "kids": []}
    if kind == "heading":
        node["level"] = rng.randint(1, 4)
    if kind == "list":
        node["props"] = {"ordered": rng.choice(["true", "false"])}
        node["kids"] = [{**node, "kind": "listItem", "props": {}, "kids": [tree(rng, depth + 2) for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 3))]
    if kind == "component":
        node["name"] = rng.choice(NAMES)
        values = {"title": ["", "T1"], "cols": ["3", "9", "x"], "caption": ["Cap"], "id": ["here"], "repo": ["o/r"], "description": ["Desc"], "className": ["grid sm:grid-cols-3 gap", "grid-cols-9 flex"], "src": ["https://www.youtube.com/watch?v=abcdefgh", "https://x.example/a", "nothing"], "type": ["WARN", "tip", "odd"], "size": ["1"], "name": ["file.txt"], "value": ["#fff"], "author-name": ["me"], "tip": ['say "x" & y'], "image": ["/own.png"], "color": ["red"], "label": ["L"]}
        node["props"] = {k: rng.choice(v) for k, v in values.items() if rng.random() < 0.3}
        node["style_deps"] = rng.choice([[], ["wide"]])
        node["expressions"] = rng.choice([[], [], [], ["icon"], ["onClick", "icon"]])
        node["signature"] = rng.choice(["s1", "s2", "s3", "s4", "s-out", "s-hold", "s-ok", "s-rule", "s-open"])
        node["kids"] = [tree(rng, depth + 1) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    return node


def rows_of(page, nodes, above=()):
    for k, n in enumerate(nodes):
        path = (*above, k)
        n["node"] = ".".join(map(str, path))
        yield (page, list(path), n["kind"], n["platform"], n["name"], n["level"], n["text"], n["url"], n["bold"], n["props"], n["style_deps"], n["expressions"], n["signature"])
        yield from rows_of(page, n["kids"], path)


def given(n, *names):
    for x in names:
        if (n["props"].get(x) or "").strip():
            return n["props"][x].strip()
    return None


def out(n, kind, name=None, props=None, text=None, kids=(), **more):
    return {"node": n["node"], "kind": kind, "name": name, "props": {k: str(v) for k, v in (props or {}).items() if v is not None}, "text": text, "kids": list(kids), "level": None, "url": None, "source_id": None, "reason": None, "bold": None, "says": True, **more}


def decide(n):
    plan = {p[0]: p for p in PLAN}.get(n["signature"], (None,) * 4)
    fits = [r for r in RULES if r[3] == n["name"] and r[1] in ("*", n["platform"]) and (r[4] is None or r[4] in n["style_deps"]) and all(k in n["props"] if v == "any" else n["props"].get(k) == v for k, v in r[5].items())]
    first = min(fits, key=lambda r: (r[1] == "*", r[2])) if fits else None
    if plan[1] == "excluded":
        return "drop", plan[2] or "plan: excluded", None
    blocking = sorted(set(n["expressions"]) - set((first[9] + first[10]) if first else []))
    if plan[1] == "quarantined":
        return "quarantine", plan[2], first
    if blocking and not (first and first[8] == "drop") and plan[1] != "approved":
        return "quarantine", "expression: " + ", ".join(blocking), first
    chosen = next((r for r in RULES if r[0] == plan[3]), None) if plan[3] else first
    if chosen is None:
        return "preserve", f"no rule for {n['signature']}", None
    return (chosen[11] and "handler") or chosen[8] or "to", None, chosen


def steps_of(n, kids):
    """An ordered list's items as steps, in place of the list; kids of the items are settled."""
    made = []
    for item in kids:
        first = item["kids"][0] if item["kids"] else None
        is_text = first is not None and first["kind"] == "paragraph"
        made.append(out(item, "component", "Step", {"title": (first["text"] or "")[:120] if is_text else "Step"}, kids=item["kids"][1:] if is_text else item["kids"]))
    return made


def settle(n):
    """The nodes that stand for one source node."""
    if n["kind"] != "component":
        kids = [x for k in n["kids"] for x in settle(k)]
        says = bool((n["text"] or "").strip()) or any(k["says"] for k in kids) or n["kind"] in ("image", "code", "thematicBreak")
        return [out(n, n["kind"], n["name"], n["props"], n["text"], kids, level=n["level"], url=n["url"], bold=n["bold"], says=says)]
    act, why, r = decide(n)
    handler = r[11] if r and act == "handler" else None
    held = lambda reason: [out(n, "quarantined", n["name"], reason=reason)]
    if act == "drop":
        return []
    if act == "quarantine":
        return held(why)
    the_list = next((k for k in n["kids"] if k["kind"] == "list" and k["props"].get("ordered") == "true"), None) if handler == "list-to-steps" else None
    kids = []
    for k in n["kids"]:
        kids += steps_of(k, [settle(i)[0] for i in k["kids"]]) if k is the_list else settle(k)
    if act == "unwrap":
        return kids
    if act == "preserve":
        return [out(n, "preserved", n["name"], reason=why, kids=kids)] if any(k["says"] for k in kids) else held(why)
    if act == "to":
        props = {}
        for k, v in r[7].items():
            m = re.fullmatch(r"\$map\(([\w-]+)\)", v)
            if v == "$count":
                props[k] = len(kids)
            elif m:
                low = n["props"].get(m[1], None)
                low = low.lower() if low is not None else None
                props[k] = MAPS.get(f"{r[6]}.{k}.{low}", MAPS.get(f"{r[6]}.{m[1]}.{low}", low))
            else:
                props[k] = n["props"].get(v[1:]) if v.startswith("$") else v
        return [out(n, "component", r[6], props, kids=kids, says=any(k["says"] for k in kids))]
    lead = kids[0] if kids else None
    said = "\n".join(k["text"] for k in kids if k["kind"] != "image" and (k["text"] or "").strip())
    component = lambda name, props=None, kids=kids: [out(n, "component", name, props, kids=kids)]
    text = lambda suffix, kind, value: out({"node": n["node"] + suffix}, kind, text=value)
    retitled = lambda name, default, *props: [{**k, "kind": "component", "name": name, "props": {"title": given(k, *props) or default}} if k["kind"] in ("component", "preserved") else k for k in kids]
    match handler:
        case "cards-to-columns":
            c = given(n, "cols", "columns")
            return held("cols is no whole number") if c and not re.fullmatch(r"-?\d+", c) else component("Columns", {"cols": min(4, max(2, int(c or 3)))})
        case "columns-count-children":
            inner = [x for k in kids for x in (k["kids"] if k["name"] == "Column" else [k])]
            return component("Columns", {"cols": min(4, max(2, sum(k["name"] == "Column" for k in kids) or 2))}, inner)
        case "tabs":
            return component("Tabs", kids=retitled("Tab", "Tab", "title", "label"))
        case "faq-to-expandable-group":
            return component("ExpandableGroup", kids=retitled("Expandable", "Details", "summary", "title", "question"))
        case "list-to-steps":
            return component("Steps")
        case "anchor-div-to-heading":
            if given(n, "id") and not kids:
                return [out(n, "anchor", text=given(n, "id"))]
            return [{**lead, "source_id": given(n, "id")}, *kids[1:]] if given(n, "id") and lead["kind"] == "heading" else held("no heading leads it")
        case "to-card":
            titled, image = given(n, "title", "repo"), next((k for k in kids if k["kind"] == "image"), None)
            body = [k for k in kids if not (k is image and not given(n, "image")) and (titled or k["kind"] == "image")]
            desc = [text(":desc", "paragraph", given(n, "description"))] if given(n, "description") else []
            href = given(n, "href") or (given(n, "repo") and "https://github.com/" + given(n, "repo"))
            return component("Card", {"title": titled or said.strip() or "Card", "href": href, "image": given(n, "image") or (image and image["url"]), "icon": given(n, "icon")}, desc + body)
        case "color-row-to-titled-group":
            if not given(n, "title"):
                return component("Columns", {"cols": 3})
            return component("Expandable", {"title": given(n, "title"), "defaultOpen": "true"}, [out({"node": n["node"] + ":cols"}, "component", "Columns", {"cols": 3}, kids=kids)])
        case "color-item-to-card":
            v = given(n, "value")
            return component("Card", {"title": given(n, "name", "value")}, [text(":val", "code", v)] if v else []) if given(n, "name", "value") else held("neither name nor value")
        case "tree-file-to-text":
            return [out(n, "paragraph", text=given(n, "name"))] if given(n, "name") else held("no name")
        case "prompt-to-code":
            if not said.strip():
                return held("no text to copy")
            return ([text(":desc", "paragraph", given(n, "description"))] if given(n, "description") else []) + [out(n, "code", text=said)]
        case "grid-to-columns":
            counts = [int(m[1]) for t in (given(n, "className", "class") or "").split() if (m := re.search(r"(?:^|:)grid-cols-(\d+)$", t))]
            return component("Columns", {"cols": min(4, max([2, *counts]))}, [k for k in kids if not (k["kind"] == "paragraph" and not (k["text"] or "").strip())])
        case "html-heading-to-heading":
            return [out(n, "heading", text=said.replace("\n", ""), level=int(n["name"][1]))] if said.strip() else held("no text")
        case "html-rule-to-thematic-break":
            return [out(n, "thematicBreak")]
        case "view-to-expandable":
            return component("Expandable", {"title": given(n, "title") or "View"})
        case "frame-to-image":
            cap = given(n, "caption")
            if cap and len(kids) == 1 and lead["kind"] == "image":
                return [out(n, "figure", text=cap, url=lead["url"])]
            return kids + ([text(":cap", "paragraph", cap)] if cap else [])
        case "step-title-from-heading":
            if lead and (lead["text"] or "").strip() and (lead["kind"] == "heading" or (lead["kind"] == "paragraph" and lead["bold"])):
                return component("Step", {"title": lead["text"].strip(), "titleType": ("h2" if lead["level"] <= 2 else "h3") if lead["kind"] == "heading" else None}, kids[1:])
            return component("Step", {"title": "Step"})
        case "embed-to-iframe" | "embed-to-iframe-or-link":
            src = given(n, "src", "url") or ""
            host = src.split("/")[2] if "://" in src else ""
            if host == "www.youtube.com":
                return component("Iframe", {"src": "https://www.youtube.com/embed/" + src[-8:], "title": given(n, "title") or "Embedded content"}, [])
            return [out(n, "paragraph", text=src, url=src)] if handler.endswith("link") and src.startswith("https://") else held(f"host not allowed: {host}")
        case "live-demo-to-card":
            return component("Card", {"title": "Demo", "href": "https://d.example"})
        case "tooltip-to-abbr" | "badge-to-span":
            words = (said.strip() or given(n, "text", "label") or "").replace("<", "&lt;")
            tip = (given(n, "tip", "title", "content") or "").replace("&", "&amp;").replace('"', "&quot;")
            return [out(n, "html", text=f'<abbr title="{tip}">{words}</abbr>' if handler.startswith("tool") else f"<span>{words}</span>")]
    raise AssertionError(handler)


def flat(page, nodes, above=()):
    for k, n in enumerate(nodes):
        path = (*above, k)
        yield (page, path, n["node"], n["kind"], n["name"], n["level"], n["text"], n["url"], tuple(sorted(n["props"].items())), n["source_id"], n["reason"])
        yield from flat(page, n["kids"], path)


def test_against_a_recursive_walk(spark):
    rng, pages = random.Random(8), {}
    for page in range(130):
        pages[page] = [tree(rng) for _ in range(rng.randint(0, 4))]
    # each handler with each kind of first child, and steps made of lists
    for k, h in enumerate(HANDLERS):
        name = next(r[3] for r in RULES if r[11] == h)
        pages[1000 + k] = []
        for lead in ("paragraph", "heading", "image", "list", "component"):
            t = next(x for x in iter(lambda: tree(rng), None) if x["kind"] == lead)
            pages[1000 + k].append({**next(x for x in iter(lambda: tree(rng), None) if x["kind"] == "component"), "name": name, "signature": "s1", "expressions": [], "kids": [t, tree(rng, 3)]})
    image = {**next(x for x in iter(lambda: tree(rng), None) if x["kind"] == "image")}
    frame = {**next(x for x in iter(lambda: tree(rng), None) if x["kind"] == "component"), "name": "N-frame-to-image", "signature": "s1", "expressions": [], "kids": [image]}
    pages[2000] = [{**frame, "props": {"caption": "Cap"}}, {**frame, "kids": [{**image}], "props": {}}]
    rows = [r for page, nodes in pages.items() for r in rows_of(page, nodes)]
    got = cv.converted(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(RULES, cv.RULES), spark.createDataFrame(PLAN, cv.PLAN), MAPS).collect()
    want = [r for page, nodes in pages.items() for r in flat(page, [x for n in nodes for x in settle(n)])]
    have = [(r["page_id"], tuple(r["path"]), r["node"], r["kind"], r["name"], r["level"], r["text"], r["url"], tuple(sorted(r["props"].items())), r["source_id"], r["reason"]) for r in got]
    key = lambda r: (r[0], r[1])
    have, want = sorted(have, key=key), sorted(want, key=key)
    for h, w in zip(have, want, strict=False):
        assert h == w
    assert len(have) == len(want)
    assert {w[3] for w in want} >= {"quarantined", "preserved", "figure", "anchor", "html", "thematicBreak", "code"} and {r[4] for r in want} >= {"Step", "Tab", "Expandable", "Columns", "Card", "Iframe", "Callout", "Aside", "Chosen", "Big"}


def test_dispositions(spark):
    nodes = [
        {"name": "Script", "kids": [{"name": "Note", "signature": "s-hold", "kids": []}]}, {"name": "Note", "signature": "s-out", "kids": [{"name": "Box", "kids": []}]},
        {"name": "Box", "kids": [{"name": "Note", "props": {"type": "tip", "color": "red", "other": "x"}, "kids": []}, {"name": "Note", "expressions": ["onClick"], "kids": []}]}, {"name": "Unknown", "props": {"a": "b"}, "kids": []},
        {"kind": "paragraph", "kids": []}, {"name": "N-to-card", "props": {"title": "t", "color": "red"}, "kids": []},
    ]
    blank = {"kind": "component", "platform": "html", "name": None, "level": None, "text": None, "url": None, "bold": None, "props": {}, "style_deps": [], "expressions": [], "signature": "s"}
    fill = lambda ns: [{**blank, **n, "kids": fill(n["kids"])} for n in ns]
    got = cv.dispositions(spark.createDataFrame(list(rows_of(1, fill(nodes))), BLOCKS), spark.createDataFrame(RULES, cv.RULES), spark.createDataFrame(PLAN, cv.PLAN)).collect()
    assert sorted((r["node"], r["disposition"], r["reason"], r["lossy"]) for r in got) == [
        ("0", "excluded", "dropped by gone", []), ("0.0", "excluded", "dropped by gone", []), ("1", "excluded", "plan: excluded", []), ("1.0", "excluded", "plan: excluded", []),
        ("2", "transformed", "frame", []), ("2.0", "transformed", "note", ["other"]), ("2.1", "quarantined", "expression: onClick", []),
        ("3", "transformed", "no rule for s", []), ("4", "identical", None, []), ("5", "transformed", "h/to-card", ["color"]),
    ]


@pytest.mark.parametrize("rows", [[], [(1, [0], "paragraph", "md", None, None, "x", None, None, None, None, None, None), (None, [0], None, None, None, None, None, None, None, None, None, None, None)]])
def test_empty_and_nulls(spark, rows):
    got = cv.converted(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], cv.RULES), spark.createDataFrame([], cv.PLAN)).collect()
    assert [(r["page_id"], r["path"], r["text"]) for r in got] == ([(1, [0], "x")] if rows else [])


def test_no_table_of_blocks_is_broadcast(spark):
    """Small or well packed files say nothing of how many blocks they hold; only rules and plans go through the driver."""
    from foliograph.plans import tree_queries

    plan = tree_queries.component_dispositions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
