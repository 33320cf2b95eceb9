"""A normal form of inline content: what says the same reads the same, however it was nested, split or spelled.

Inline content is rows: a node with its parent, its place among siblings, its kind (text,
code, link, bold, italic, image, break, html) and its text or address. Spark deals the rows
by piece of content and sorts them by parent and place; a piece is one paragraph or turn, and
the rules below are applied to its nodes again and again, until a round changes nothing. Every
rule but one makes the content smaller, and that one only brings bold nodes further out, so
rounds end. However many rounds a piece takes, the table is shuffled once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text
from foliograph.workspace import bounded_batches, shuffle_partitions, written

COLUMNS = ["root", "node", "parent", "key", "kind", "text", "url"]
_OF = ["root", "parent"]
#: A node within a piece: its name, kind, text and address. A piece: parents' names with their children in order.
Node = list
Piece = dict[str, list[Node]]
_NAME, _KIND, _TEXT, _URL = range(4)
_SCHEME, _LAST_SLASH = re.compile(r"\A(?:mailto:|https?://)"), re.compile(r"/(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")
_ANCHOR = re.compile(r"""(?i)\A<a\s+(?:id|name)=["'][^"']*["']\s*(?:/>|>\s*</a>)\Z""", re.ASCII)


def decoded(rows: DataFrame) -> DataFrame:
    """Texts with their character references as characters and white space as single spaces; code keeps its own."""
    plain = F.regexp_replace(text.char_references(F.coalesce("text", F.lit(""))), r"[\s ]+", " ")
    return rows.withColumn("text", F.when(F.col("kind") == "text", plain).otherwise(F.col("text")))


def own_addresses(piece: Piece) -> bool:
    """A link whose whole label is its own address reads as that text."""
    bare = lambda x: _LAST_SLASH.sub("", _SCHEME.sub("", x))
    changed = False
    for node in [n for held in piece.values() for n in held if n[_KIND] == "link" and n[_URL] is not None]:
        held = piece.get(node[_NAME])
        if held and all(n[_KIND] == "text" for n in held):
            said = "".join(n[_TEXT] or "" for n in held).strip(" ")
            if bare(said) == bare(node[_URL]):
                node[_KIND:] = "text", said, None
                del piece[node[_NAME]]
                changed = True
    return changed


def bold_outside(piece: Piece) -> bool:
    """Italic around nothing but one bold node becomes bold around italic."""
    turned = []
    for node in [n for held in piece.values() for n in held if n[_KIND] == "italic"]:
        held = piece.get(node[_NAME], ())
        if len(held) == 1 and held[0][_KIND] == "bold":
            turned.append((node, held[0]))
    for outer, inner in turned:
        outer[_KIND], inner[_KIND] = "bold", "italic"
    return bool(turned)


def nested_once(piece: Piece) -> bool:
    """Bold right inside bold, and italic right inside italic, says nothing more: what it holds stands in its place."""
    marks = {n[_NAME]: n[_KIND] for held in piece.values() for n in held if n[_KIND] in ("bold", "italic")}
    changed = False
    for parent, kind in marks.items():
        held = piece.get(parent, ())
        if any(n[_KIND] == kind and n[_NAME] != parent for n in held):
            piece[parent] = [x for n in held for x in (piece.pop(n[_NAME], ()) if n[_KIND] == kind and n[_NAME] != parent else (n,))]
            changed = True
    return changed


def joined(piece: Piece) -> bool:
    """Neighbours of one kind are one: texts are put together, and of bold, italic and links to one address the first takes what the
    next ones hold."""
    changed = False
    for parent in list(piece):
        held = piece.get(parent, ())
        like = [(n[_KIND], n[_URL] or "") for n in held]
        if not any(a == b and a[0] in ("text", "bold", "italic", "link") for a, b in zip(like, like[1:], strict=False)):
            continue
        changed, kept, at = True, [], 0
        while at < len(held):
            first, end = held[at], at + 1
            while end < len(held) and like[end] == like[at] and first[_KIND] in ("text", "bold", "italic", "link"):
                end += 1
            if end - at > 1 and first[_KIND] == "text":
                first[_TEXT] = "".join(n[_TEXT] or "" for n in held[at:end])
            elif end - at > 1:
                taken = [x for n in held[at:end] for x in piece.pop(n[_NAME], ())]
                if taken:
                    piece[first[_NAME]] = taken
            kept.append(first)
            at = end
        piece[parent] = kept
    return changed


def without_empty(piece: Piece) -> bool:
    """Empty texts go, so do empty anchors, and bold, italic and links that hold nothing."""

    def empty(n: Node) -> bool:
        kind = n[_KIND]
        if kind == "text":
            return not n[_TEXT]
        if kind == "html":
            return n[_TEXT] is None or _ANCHOR.search(n[_TEXT]) is not None
        return kind in ("bold", "italic", "link") and not piece.get(n[_NAME])

    changed = False
    for parent in list(piece):
        kept = [n for n in piece[parent] if not empty(n)]
        if len(kept) < len(piece[parent]):
            changed = True
            piece[parent] = kept
    return changed


RULES = (without_empty, own_addresses, bold_outside, nested_once, joined)


def _settled(piece: Piece, rules) -> None:
    while any([rule(piece) for rule in rules]):  # every rule of a round, also after one that changed something
        pass


def normalised(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (root, node, parent, ord, kind, text, url) in normal form, with ``key``, the place among siblings, for ord; root tells one
    piece of content from another, parent is '' at its top. The order of the rules makes no difference to the result. Nulls: a node
    without a parent is at the top. A task holds one piece at a time."""
    r = rows.select("root", "node", F.coalesce("parent", F.lit("")).alias("parent"), F.col("ord").cast("int").alias("ord"), "kind", F.col("text").cast("string").alias("text"), F.col("url").cast("string").alias("url"))
    r = decoded(r).repartition(shuffle_partitions(rows.sparkSession), "root").sortWithinPartitions("root", "parent", "ord", "node").drop("ord")

    def run(batches) -> Iterator:
        import pyarrow as pa

        piece, root, of_root, out = {}, None, None, []

        def settle() -> None:
            _settled(piece, rules)
            out.extend((root, n[_NAME], parent, k, *n[_KIND:]) for parent, held in piece.items() for k, n in enumerate(held))

        def made():
            columns = list(zip(*out, strict=True)) if out else [()] * len(COLUMNS)
            arrays = [pa.array(c, of_root if k == 0 else pa.int32() if k == 3 else pa.string()) for k, c in enumerate(columns)]
            arrays[3] = pa.ListArray.from_arrays(pa.array(range(len(out) + 1), pa.int32()), arrays[3])
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, COLUMNS)

        for batch in batches:
            of_root = batch.schema.field(0).type
            texts = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[1:])
            for of, node, parent, kind, said, url in zip(batch.column(0).to_pylist(), *texts, strict=True):
                if of != root and piece:
                    settle()
                    piece = {}
                root = of
                piece.setdefault(parent, []).append([node, kind, said, url])
            yield made()
        if piece:
            settle()
            yield made()

    schema = f"root {rows.schema['root'].dataType.simpleString()}, node string, parent string, key array<int>, kind string, text string, url string"
    return written(bounded_batches(r).mapInArrow(run, schema), "inline")


def as_text(rows: DataFrame) -> DataFrame:
    """root, said: normal content written as one line, marks around what they hold; from the deepest level up, one join a level."""
    mark = {"bold": ("**", "**"), "italic": ("_", "_"), "link": ("[", "]"), "code": ("`", "`")}
    open_, close = (F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in mark.items() for x in (k, v[side])]), F.col("kind")), F.lit("")) for side in (0, 1))
    leaf = F.when(F.col("kind") == "break", "\n").when(F.col("kind") == "image", F.concat(F.lit("!["), F.coalesce("text", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))).otherwise(F.concat(open_, F.coalesce("text", F.lit("")), close))
    level, depth = rows.filter("parent = ''").withColumn("depth", F.lit(0)), 0
    parts = []
    while True:
        level = written(level, "inline-level")
        if not level.take(1):
            break
        parts.append(level)
        depth += 1
        level = rows.join(level.select("root", F.col("node").alias("parent")), ["root", "parent"]).select(*COLUMNS).withColumn("depth", F.lit(depth))
    held = None
    for part in reversed(parts):
        j = part if held is None else part.join(held, ["root", "node"], "left")
        inner = F.lit(None).cast("string") if held is None else F.col("said")
        address = F.when(F.col("kind") == "link", F.concat(F.lit("("), F.coalesce("url", F.lit("")), F.lit(")"))).otherwise("")
        own = j.select("root", "parent", "key", F.when(inner.isNotNull(), F.concat(open_, inner, close, address)).otherwise(leaf).alias("own"))
        held = written(own.groupBy(*_OF).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "own"))), lambda x: x["own"]), "").alias("said")).withColumnRenamed("parent", "node"), "inline-said")
    return rows.select("root").distinct().withColumn("said", F.lit("")) if held is None else held.select("root", "said")
