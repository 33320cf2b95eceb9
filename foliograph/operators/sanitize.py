"""HTML and style sheets made safe: what runs, frames foreign sites or reaches beyond the page goes, the rest stays as it is.

Tags are tokens of the text. Elements to drop become spans, by running counts of their
opening and closing tags; a text is put together again from its pieces, without those in a
dropped span and with each remaining tag written anew from its allowed attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.operators.masking import _pieces

# Elements that go with all they hold, those without an end tag, attributes under other names in the target, attributes
# that hold addresses, what an embedded frame may state, and whose frames may be embedded.
DROPPED = ("applet", "base", "button", "canvas", "embed", "form", "frame", "frameset", "input", "link", "meta", "noscript", "object", "script", "select", "style", "svg", "template", "textarea")
VOID = ("area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "source", "wbr")
RENAMED = {"allowfullscreen": "allowFullScreen", "autoplay": "autoPlay", "class": "className", "colspan": "colSpan", "for": "htmlFor", "frameborder": "frameBorder", "maxlength": "maxLength", "readonly": "readOnly", "rowspan": "rowSpan", "srcset": "srcSet", "tabindex": "tabIndex"}
ADDRESSES = ("action", "data", "formaction", "href", "poster", "src", "xlink:href")
FRAME_ATTRIBUTES = ("allowfullscreen", "height", "loading", "src", "title", "width")
FRAME_HOSTS = ("player.vimeo.com", "www.loom.com", "www.youtube.com", "youtube.com")
#: A tag; quoted values may hold angle brackets. Loops give nothing back, so long tags take no stack.
TAG = r"""</?[A-Za-z][^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""
#: Comments, and elements whose content is no markup, closed or not.
_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\z)"
_ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""


def is_safe_address(value: Column, schemes: tuple[str, ...]) -> Column:
    """Whether an attribute's value is relative or has one of the schemes; white space, control characters and their references don't
    count, and a scheme written with references is not safe."""
    bare = F.regexp_replace(F.lower(value), r"[\x00-\x20]+|&(?:tab|newline);|&#0*(?:9|1[03]|32)(?![0-9]);?|&#x0*(?:9|a|d|20)(?![0-9a-f]);?", "")
    bare = F.replace(F.regexp_replace(bare, r"&colon;|&#0*58(?![0-9]);?|&#x0*3a(?![0-9a-f]);?", ":"), F.lit("&#"), F.lit("&"))
    head = F.regexp_extract(bare, r"^([^:/?#]*):", 1)
    return (head == "") | head.isin(*schemes) | (~head.rlike(r"^[a-z][a-z0-9+.-]*$") & ~head.contains("&"))


def _attribute(tag: Column, frame: Column) -> Column:
    """The attributes of a tag that stay, as they are written."""
    inner = F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*|/?>$", "")
    parts = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)).alias("name"), F.regexp_replace(F.regexp_extract(a, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1), r"""^["']|["']$""", "").alias("value")))
    names = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])

    def stays(a: Column) -> Column:
        n, v = a["name"], a["value"]
        safe = F.when(n == "href", is_safe_address(v, ("http", "https", "mailto", "tel"))).otherwise(is_safe_address(v, ("http", "https")))
        named = ~n.startswith("on") & (n != "style") & n.rlike(r"^[a-z_][\w:-]*$")
        return named & (~n.isin(*ADDRESSES) | safe) & ((n != "id") | v.rlike(r"^[A-Za-z][\w:.-]*$")) & (~frame | n.isin(*FRAME_ATTRIBUTES))

    def said(a: Column) -> Column:
        value = F.replace(F.replace(F.replace(a["value"], F.lit('"'), F.lit("&quot;")), F.lit("{"), F.lit("&#123;")), F.lit("}"), F.lit("&#125;"))
        name = F.coalesce(F.try_element_at(names, a["name"]), a["name"])
        return F.when(a["value"] == "", F.concat(F.lit(" "), name)).otherwise(F.concat(F.lit(" "), name, F.lit('="'), value, F.lit('"')))

    return F.array_join(F.transform(F.filter(parts, stays), said), "")


def sanitized(texts: DataFrame, key: str, html: str, frame_hosts: tuple[str, ...] = FRAME_HOSTS) -> DataFrame:
    """key, html: the texts without dropped elements, comments, event handlers, styles and unsafe addresses.

    A dropped element goes with all it holds; one that is never closed takes the rest of the text, a closing tag without an opening
    one only itself. Frames of other hosts go likewise. Braces become references, as the target reads them as code. Null stays null;
    keys are unique."""
    t = texts.select(key, F.regexp_replace(F.col(html).cast("string"), _RAW, "").alias("__html"))
    tags = t.filter(F.col("__html").rlike(TAG)).select(key, F.posexplode(F.regexp_extract_all("__html", F.lit(TAG), F.lit(0))).alias("n", "tag"))
    tags = tags.withColumns({"name": F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][^\s/>]*)", 1)), "closes": F.col("tag").startswith("</")})
    source = F.regexp_extract("tag", r"""(?i)\ssrc\s*=\s*["']?\s*https?://([^/?#"'\s:>]+)""", 1)
    allowed = F.lower(source).isin(*frame_hosts)
    for host in frame_hosts:
        allowed = allowed | F.lower(source).endswith("." + host)
    of_frame = F.col("name") == "iframe"
    # a frame's end tag follows its own start tag: frames hold none
    opened_ok = F.last(F.when(of_frame & ~F.col("closes"), allowed), ignorenulls=True).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    tags = tags.withColumn("frame_ok", F.coalesce(opened_ok, F.lit(False)))
    drop = F.col("name").isin(*DROPPED) | (of_frame & ~F.col("frame_ok"))
    alone = F.col("name").isin(*VOID) | F.col("tag").endswith("/>")
    step = F.when(drop & ~alone, F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    tags = tags.withColumns({"drop": drop, "step": step})
    # open elements of each name, never below none; then those of all names
    by_name = Window.partitionBy(key, "name").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    tags = tags.withColumn("level", F.sum("step").over(by_name)).withColumn("floor", F.least(F.min("level").over(by_name), F.lit(0)))
    tags = tags.withColumn("open", F.when(F.col("drop"), F.col("level") - F.col("floor")).otherwise(0))
    change = F.col("open") - F.coalesce(F.lag("open").over(Window.partitionBy(key, "name").orderBy("n")), F.lit(0))
    tags = tags.withColumn("change", F.when(F.col("drop"), change).otherwise(0))
    depth = F.sum("change").over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    tags = tags.withColumn("depth", depth)
    gone = F.col("drop") | (F.col("depth") > 0)
    void = F.col("name").isin(*VOID)
    anew = F.when(F.col("closes"), F.when(void, "").otherwise(F.concat(F.lit("</"), "name", F.lit(">")))).otherwise(F.concat(F.lit("<"), F.col("name"), _attribute(F.col("tag"), of_frame), F.when(void, " />").otherwise(">")))
    rows = tags.select(key, "n", F.when(gone, "").otherwise(anew).alias("put"), (F.col("depth") > 0).alias("mute"))
    done = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "put", "mute"))).alias("__tags"))
    text = lambda c: F.replace(F.replace(c, F.lit("{"), F.lit("&#123;")), F.lit("}"), F.lit("&#125;"))
    muted = lambda i: F.coalesce(F.get("__tags", i - 1)["mute"], F.lit(False))
    made = F.transform(_pieces(F.col("__html"), TAG), lambda x, i: F.concat(F.when((i > 0) & muted(i), "").otherwise(text(x["gap"])), F.coalesce(F.get("__tags", i)["put"], F.lit(""))))
    joined = t.join(done, key, "left")
    return joined.select(key, F.when(F.col("__tags").isNotNull(), F.array_join(made, "")).otherwise(text(F.col("__html"))).alias(html))


#: What a style sheet must not do, by name.
STYLE_RULES = {
    "import": r"(?i)@import", "external address": r"(?i)url\(\s*[\"']?https?:", "fixed position": r"(?i)position\s*:\s*(?:fixed|sticky)",
    "z-index above 9": r"(?i)z-index\s*:\s*\d{2,}", "script-like": r"(?i)expression\(|behavior\s*:|-moz-binding",
}


def style_problems(sheets: DataFrame, key: str, css: str) -> DataFrame:
    """key, problem: a row for each rule of STYLE_RULES that a style sheet breaks."""
    broken = F.array(*[F.when(F.col(css).rlike(r), F.lit(name)) for name, r in STYLE_RULES.items()])
    return sheets.select(key, F.explode(F.array_compact(broken)).alias("problem"))
