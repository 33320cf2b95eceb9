import pytest

from foliograph.operators import contract

COMPONENTS = [("Card", False, False), ("Image", False, False), ("Draft", True, False), ("Script", False, True), ("Columns", False, False)]
PROPS = [("Image", "alt", "required", None), ("Columns", "cols", "enum", ["2", "3"]), ("Card", "look", "tokens", ["wide", "dark"])]
HEAD = "---\ntitle: t\n---\n"
CASES = {
    "": [("frontmatter-missing", 1, "")],
    HEAD + "Text {user.name} {} {3} {true} {/* {note} */} {\"a \\\" b\"}": [("expression", 4, "note")],
    HEAD + '{/* note */} {"a \\" b"} {a + b}\n{"x" + "y"}': [("expression", 4, "a + b"), ("expression", 5, '"x" + "y"')],
    "---\ndescription: d\n---\nx": [("frontmatter-title-missing", 1, "")],
    "---\ntitle:\n  on the next line\n---\n": [],
    "---\r\ntitle: t\r\n---\r\n{}\r\n": [],
    HEAD + "<Unknown> </Unknown> <div> <Card\n  look=\"wide dark\"\n/> <Card look='wide odd'>": [("unknown-component", 4, "Unknown"), ("invalid-prop-value", 6, "Card.look=wide odd")],
    HEAD + "<draft/> <Draft> `<Draft>`\n```\n<Draft>\n```\n<Script/>": [("editor-only-node", 4, "draft"), ("editor-only-node", 4, "Draft"), ("executable", 8, "Script")],
    HEAD + "<Image src='a' /><Image alt=\"\" /> <Columns cols={4}> <Columns cols={3}>": [("missing-required-prop", 4, "Image.alt"), ("invalid-prop-value", 4, "Columns.cols=4")],
    HEAD + "import A from '/snippets/a.mdx';\nimport B from \"/snippets/../b.mdx\"\nexport const x = 1\nimported": [("esm", 5, 'import B from "/snippets/../b.mdx"'), ("esm", 6, "export const x = 1")],
    HEAD + "````md\n```js\nx\n```\n````\n\n```js\nnever": [("deployment-code-fence", 10, "")],
    HEAD + "```js\n```js\n```\n": [("deployment-code-fence", 5, "")],
    HEAD + "<Card look=\"say &quot;\" /> <Card x='&apos;' />\n<Card x='&quot;'>": [("deployment-attribute-quote", 4, ""), ("invalid-prop-value", 4, "Card.look=say &quot;")],
    HEAD + ":::note\n{% hint %}\n@embed[x]\n<< glossary:x >>\n> 📘 x\n\n> quote\n> 👍 y\n<Note>": [("residual-source-syntax", 4, "admonition"), ("residual-source-syntax", 5, "liquid"), ("expression", 5, "% hint %"), ("residual-source-syntax", 6, "embed"), ("residual-source-syntax", 7, "glossary"), ("residual-source-syntax", 8, "callout"), ("residual-source-syntax", 12, "component"), ("unknown-component", 12, "Note")],
    HEAD + "{{ snippet.x }}": [("residual-source-syntax", 4, "snippet"), ("expression", 4, "snippet.x")],
}


def found(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, mdx string")
    return contract.problems(rows, spark.createDataFrame(COMPONENTS, contract.COMPONENTS), spark.createDataFrame(PROPS, contract.PROPS))


def test_each_rule(spark):
    got = {}
    for r in found(spark, list(enumerate(CASES))).collect():
        got.setdefault(r["page_id"], []).append((r["code"], r["line"], r["detail"]))
    for i, (mdx, want) in enumerate(CASES.items()):
        assert sorted(got.get(i, [])) == sorted(want), mdx


def test_null_and_empty(spark):
    assert [tuple(r) for r in found(spark, [(1, None)]).collect()] == [(1, "frontmatter-missing", 1, "")]
    assert found(spark, []).count() == 0


@pytest.mark.parametrize("body", ['{"' + "a" * 1_000_000 + '"}', '{"' + "\\a" * 500_000 + '"}', "<Card look='" + "x " * 500_000 + "'>", "{ " * 300_000, "import " * 150_000])
def test_very_long_pages(spark, body):
    assert found(spark, [(1, HEAD + body)]).count() < 10
