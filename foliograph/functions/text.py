"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters with marks and what is left of them; ligatures and sharp s apart.
MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
# Typographic quotes and wide spaces with what stands for them, and characters without width.
QUOTES_AND_SPACES = "\u2018\u2019\u201a\u201c\u201d\u201e\u00a0\u202f\u2007"
PLAIN_QUOTES_AND_SPACES = "'''" + '"""' + "   "
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# Shapes of credentials and personal tokens.
SECRETS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"AKIA[0-9A-Z]{16}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack-token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    ("bearer", r"(?i:bearer) [A-Za-z0-9._~+/-]{16,}=*"),
    ("assignment", r"""(?i:api[_-]?key|secret|token|password)["']?[ ]*[:=][ ]*["']?[A-Za-z0-9+/_.-]{16,}"""),
    ("url-password", r"[a-z]+://[^/ :@]+:[^/ :@]+@"),
)


def with_parts(pages: DataFrame, **found: Callable[[Column, Column], Column]) -> DataFrame:
    """pages with columns of what functions of their html (as it is, in lower case) find; columns that pages have already were found
    before (operators.findings.parts) and stay."""
    found = {name: f for name, f in found.items() if name not in pages.columns}
    if not found:
        return pages
    return pages.withColumn("lower", F.lower("html")).withColumns({name: f(F.col("html"), F.col("lower")) for name, f in found.items()})


def prose(text: Column) -> Column:
    """Straight quotes, ordinary spaces, no zero-width characters, single spaces."""
    plain = F.translate(F.translate(text, QUOTES_AND_SPACES, PLAIN_QUOTES_AND_SPACES), ZERO_WIDTH, "")
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n\x0B\f]+", " "))


def skeleton(text: Column) -> Column:
    """Letters and digits only, lower-case, without character references."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "&#?[A-Za-z0-9]+;", ""), r"[^\p{L}\p{N}]+", ""))


def entities(text: Column) -> Column:
    """The common named references; & last, so nothing is decoded twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


#: Characters by name, as HTML has them; the numbers of all others can be written instead.
NAMED = {
    "amp": "&", "apos": "'", "bull": "•", "cent": "¢", "copy": "©", "deg": "°", "euro": "€", "frac12": "½", "gt": ">", "hellip": "…", "laquo": "«", "larr": "←", "ldquo": "“", "lsquo": "‘", "lt": "<", "mdash": "—", "middot": "·",
    "nbsp": "\u00a0", "ndash": "–", "para": "¶", "plusmn": "±", "pound": "£", "quot": '"', "raquo": "»", "rarr": "→", "rdquo": "”", "reg": "®", "rsquo": "’", "sect": "§", "shy": "\u00ad", "times": "×", "trade": "™", "yen": "¥",
}
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def char_references(text: Column) -> Column:
    """Named and numbered character references as characters, each decoded once; names that NAMED lacks and numbers of no character stay."""
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])

    def char(ref: Column) -> Column:
        inner = F.regexp_extract(ref, "^&(.*);$", 1)
        number = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, 3, 9), 16, 10).cast("long")).when(inner.startswith("#"), F.substring(inner, 2, 9).cast("long"))
        is_char = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        by_number = F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(by_number, F.try_element_at(named, inner), ref)

    pieces = F.arrays_zip(F.split(text, _REFERENCE, -1).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), char).alias("char"))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(x["char"], F.lit("")))), "")).otherwise(text)


def visible(html: Column) -> Column:
    """What a reader sees of HTML: no comments, scripts, styles or tags; blocks end lines; single spaces."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|noscript|template|svg)\b[^>]*>.*?</(script|style|noscript|template|svg)>", "")
    bare = F.regexp_replace(bare, r"(?i)<(/?)(p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|main|br|hr|title|blockquote|pre|dd|dt)\b[^>]*>", "\n")
    bare = entities(F.regexp_replace(bare, r"<[^>]*>", ""))
    bare = F.regexp_replace(bare, r"[ \t\r\x0B\f ]+", " ")
    return F.trim(F.regexp_replace(bare, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


#: What differs from one fetch of a page to the next though nobody edited it.
VOLATILE = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script>", ""),
    (r"(?is)<style\b[^>]*>.*?</style>", ""),
    (r"(?is)<time\b[^>]*>.*?</time>", ""),
    (r'(?i) (nonce|integrity|data-build|data-build-id|data-reactroot|crossorigin)="[^"]*"', ""),
    (r'(?i)([?&])(v|ver|build|t|cb)=[A-Za-z0-9._-]+', "$1"),
    (r'(?i) (id|for|aria-labelledby|aria-describedby|aria-controls)="[^"]*(:r[0-9a-z]+:|radix-|headlessui-)[^"]*"', ""),
)


def fingerprint(html: Column) -> Column:
    """Equal for two fetches of a page that differ in nothing an author wrote."""
    for pattern, by in VOLATILE:
        html = F.regexp_replace(html, pattern, by)
    return F.sha2(F.trim(F.regexp_replace(html, r"\s+", " ")), 256)


def redacted(text: Column) -> Column:
    for name, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[redacted:{name}]")
    return text


def looks_secret(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for _, p in SECRETS))


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; Latin marks are dropped, other letters are lost (see slug_erased)."""
    plain = F.translate(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and ")), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_erased(text: Column) -> Column:
    """Whether a slug lost letters of its text altogether."""
    plain = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), MARKED, PLAIN)
    return F.regexp_replace(plain, "[A-Za-z]", "").rlike(r"\p{L}")


def is_slug(segment: Column) -> Column:
    return segment.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def legal_path(path: Column, most_bytes: int = 1024) -> Column:
    """Each segment as a slug; null if the whole is too long."""
    out = F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), slug), "/")
    return F.when(F.octet_length(out) <= most_bytes, out)


def heading_slug(text: Column) -> Column:
    """As code hosts make them: lower-case, punctuation dropped, each space a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N} _-]", ""), " ", "-")


# Abbreviations that labels keep in capitals.
ABBREVIATIONS = ("api", "cli", "sdk", "url", "http", "https", "html", "css", "json", "yaml", "xml", "sql", "faq", "id", "ui", "sso", "oauth")


def label(segment: Column) -> Column:
    """A path segment as a title: words, first letter a capital, abbreviations in capitals."""
    words = F.filter(F.split(F.regexp_replace(segment, r"\.[a-z]+$", ""), "[-_ ]+"), lambda w: w != "")
    shaped = F.transform(words, lambda w, i: F.when(F.lower(w).isin(*ABBREVIATIONS), F.upper(w)).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(w))
    return F.array_join(shaped, " ")


def unescaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+.!<>|~-])", "$1")


def escaped_mdx(text: Column) -> Column:
    """Text that MDX takes as text: braces and angle brackets escaped."""
    return F.regexp_replace(text, r"([{}<>])", r"\\$1")


def markdown_text(text: Column) -> Column:
    """The prose of Markdown or MDX: no frontmatter, fences kept as text, no tags, link and emphasis marks."""
    for pattern, by in (
        (r"(?s)^---\r?\n.*?\r?\n---\r?\n", ""),
        (r"(?m)^(import|export) .*$", ""),
        (r"(?s)\{/\*.*?\*/\}", ""),
        (r"(?m)^[ \t]*(```|~~~).*$", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
        (r"(?m)^[ \t]*([-*+]|[0-9]+[.)])[ \t]+", ""),
        (r"(?m)^[ \t]*>[ \t]?", ""),
        (r"</?[A-Za-z][^>]*>", ""),
        (r"(\*\*|__|\*|`|~~)", ""),
        (r"\|", " "),
    ):
        text = F.regexp_replace(text, pattern, by)
    return F.lower(prose(entities(unescaped_markdown(text))))


def pixels(value: Column) -> Column:
    """A positive whole number of pixels, or null."""
    number = F.regexp_extract(value, r"^\s*([0-9]+)(px)?\s*$", 1)
    return F.when((number != "") & (F.length(number) < 9) & ~number.rlike("^0+$"), number.cast("int"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, though lambdas in it name it for each of their elements."""
    return F.get(F.transform(F.array(value), use), 0)


def _share_held(parts: Column, held: Column) -> Column:
    return _once(parts, lambda ps: F.when(F.size(ps) > 0, F.size(F.filter(ps, lambda p: held.contains(p))) / F.size(ps)).otherwise(0.0))


def presence(passage: Column, rendered: Column, is_code: Column) -> Column:
    """exact, respelled, altered or absent: how much of a passage is in a rendered text. Skeletons are made once a row, and only if the
    passage isn't there as it is."""

    def judged(x: Column) -> Column:
        bare, body = x["bare"], x["body"]
        pieces = F.when(F.length(bare) < 24, F.array(bare)).otherwise(F.regexp_extract_all(bare, F.lit("(?s).{24}"), F.lit(0)))
        words = F.filter(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        pairs = _once(words, lambda ws: F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
        code = F.when((F.length(body) >= 8) & bare.contains(body), "altered").when(_share_held(pairs, body) >= 0.5, "altered").otherwise("absent")
        text = F.when(F.length(bare) < 48, "absent").when(_share_held(pieces, body) >= 0.8, "altered").otherwise("absent")
        return F.when(bare == "", "exact").when(body.contains(bare), "respelled").when(is_code, code).otherwise(text)

    both = F.struct(skeleton(passage).alias("bare"), skeleton(rendered).alias("body"))
    return F.when(rendered.contains(passage), "exact").otherwise(_once(both, judged))
