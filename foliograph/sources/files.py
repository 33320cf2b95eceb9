"""Files of a repository or an export as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that hold no pages, and names of files with credentials.
SKIPPED = (".git", "node_modules", ".next", "dist", "build", ".cache")
CREDENTIALS = r"(^|/)(\.env(\..*)?|\.npmrc|\.netrc|id_(rsa|dsa|ecdsa|ed25519)|.*\.(pem|p12|pfx|key))$"
PAGES = r"(?i)\.(mdx?|html?)$"
LIMITS = {"file_bytes": 200 * 2**20, "all_bytes": 2**30, "files": 100_000}


def scan(spark: SparkSession, root: str, pattern: str | None = PAGES) -> DataFrame:
    """path (below root), bytes, content of the files below ``root`` whose path matches, without skipped directories.

    Spark's readers pass over names that start with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/+|/+$", "")
    whole = F.regexp_replace("path", "^[a-z]+:/+", "")
    at = F.instr(whole, F.regexp_replace(base, "^/+", ""))
    below = F.regexp_replace(F.expr("substring(__whole, __at + length(__base))"), "^/+", "")
    f = files.withColumns({"__whole": whole, "__base": F.regexp_replace(base, "^/+", ""), "__at": at}).select(below.alias("path"), F.col("length").alias("bytes"), "content")
    f = f.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED)))
    return f.filter(F.col("path").rlike(pattern)) if pattern else f


def frozen(files: DataFrame) -> DataFrame:
    """path, sha256, bytes: what a later scan is held against (see reconcile.drift)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), "bytes")


def freeze_problems(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """problem, path: credential files, files or folders too large, too many files."""
    each = files.select("path", F.when(F.col("path").rlike(CREDENTIALS), "credentials").when(F.col("bytes") > limits["file_bytes"], "file too large").alias("problem")).filter("problem IS NOT NULL")
    whole = files.agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).select(F.lit("").alias("path"), F.explode(F.array(F.when(F.col("b") > limits["all_bytes"], "too many bytes"), F.when(F.col("n") > limits["files"], "too many files"))).alias("problem")).filter("problem IS NOT NULL")
    return each.unionByName(whole).select("problem", "path")


def body_kind(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.html?$"), "html").when(path.rlike(r"(?i)\.mdx?$"), "markdown").otherwise("other")


def with_frontmatter(files: DataFrame, text: str = "text") -> DataFrame:
    """files with ``data``, a map of the top-level scalars between the leading --- lines, and ``body``, the rest."""
    head = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*:"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^([^:]+):", 1).alias("key"), value(x).alias("value")))
    # the last of equal keys wins, as in YAML readers that don't refuse them
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "")
    return files.withColumns({"data": F.map_from_entries(last), "body": body})


def missing_and_unlisted(listed: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem: pages that a navigation (path) lists and no file (path) has, and files that it doesn't list."""
    a, b = listed.select("path").distinct(), files.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("problem", F.lit("missing")).union(b.join(a, "path", "left_anti").withColumn("problem", F.lit("unlisted")))


def tokens_used(files: DataFrame, text: str = "text") -> DataFrame:
    """token, n: {{name}} placeholders and how often they come."""
    return files.select(F.explode(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"), F.lit(1))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def component_definitions(files: DataFrame) -> DataFrame:
    """name, definition_hash, path of components exported below snippets/ or components/; the first path wins."""
    code = files.filter(F.col("path").rlike(r"(^|/)(snippets|components)/.*\.(jsx|tsx|mdx|js|ts)$")).select("path", F.col("content").cast("string").alias("code"))
    names = F.regexp_extract_all("code", F.lit(r"export\s+(?:default\s+)?(?:const|function|class)\s+([A-Z][A-Za-z0-9]*)"), F.lit(1))
    d = code.select("path", F.substring(F.sha2("code", 256), 1, 16).alias("definition_hash"), F.explode(names).alias("name"))
    return d.groupBy("name").agg(F.min_by(F.struct("definition_hash", "path"), "path").alias("x")).select("name", "x.definition_hash", "x.path")
