"""Secret scans over whole texts, native DataFrame operations only.

Method: rules find assignments, access keys and hexadecimal strings; two first-order
character Markov models, one of random strings and one of ordinary identifiers,
are compared by log-likelihood ratio on every further run of token characters.
The models are trained from labelled samples (value, label): label 1 for random
strings, 0 for identifiers. The query labels generated digests 1 and, as 0, the
token runs of a sample of SAMPLE_DOCS documents or fewer expected, taken by hash;
rule matches are cut out of it first. The trained table has ALPHABET² numbers, which
bounds what reaches the driver and every expression.

All work is map-side; nothing but the training counts is shuffled.

Positions are code points, ends exclusive. They come from splitting the text at a
rule's matches: match i starts after the pieces up to i and the matches before it.

Defined results: null text is empty and has no spans; repeated rows are scanned each;
an empty table trains on the generated strings alone and gives an empty table;
extra columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGNED = 12
# a maximal run below these lengths fails as a whole, so the bound can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
TRAIN_RUN = r"[A-Za-z0-9+/_=-]{6,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET)
SMOOTHING, LEAN = 0.5, 20.0
#: Log-odds that outweigh a prior of about one random string in 10**5 runs.
THRESHOLD = 12.0
SAMPLE_DOCS = 2000
GENERATED = 4096
#: Matches of a text that are placed together.
GROUP = 64


def _pairs(values: DataFrame) -> DataFrame:
    """label, pair, n: how often each two characters follow one another; partial counts before the shuffle."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))
    return values.filter(F.length("value") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def train(samples: DataFrame) -> list[float]:
    """ALPHABET² log-likelihood ratios, random over identifier, of a character after another, from samples (value, label).

    A model's P(b | a) leans on how often b comes at all in its samples, with the weight of LEAN pairs."""
    counts = {0: [0.0] * STATES**2, 1: [0.0] * STATES**2}
    at = {c: i for i, c in enumerate(ALPHABET)}
    for label, pair, n in _pairs(samples.filter(F.col("value").rlike(r"^[A-Za-z0-9+/_=-]+$"))).collect():
        if label in counts and len(pair) == 2 and pair[0] in at and pair[1] in at:
            counts[label][at[pair[0]] * STATES + at[pair[1]]] += n
    logs = {}
    for label, pairs in counts.items():
        often = [SMOOTHING + sum(pairs[b::STATES]) for b in range(STATES)]
        often = [x / sum(often) for x in often]
        rows = [sum(pairs[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        logs[label] = [math.log((pairs[a * STATES + b] + LEAN * often[b]) / (rows[a] + LEAN)) for a in range(STATES) for b in range(STATES)]
    return [r - p for r, p in zip(logs[1], logs[0], strict=True)]


def random_strings(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """Digests in the usual spellings, labelled 1."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    spelt = F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"))
    return spark.range(0, n, 1, 4).select(F.explode(spelt).alias("value"), F.lit(1).alias("label"))


def identifiers(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Token runs, and names of three words joined by underscores, of about ``sample_docs`` documents chosen by hash (all, if there are fewer), without rule matches, labelled 0."""
    rows = max(1, docs.count())
    share = min(1.0, sample_docs / rows)
    few = docs.filter(F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5 <= share)
    text = F.coalesce("text", F.lit(""))
    for rule in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, rule, " ")
    # runs with more digits aren't labelled: a secret no rule knows would teach the wrong model
    words = F.filter(F.regexp_extract_all(text, F.lit(TRAIN_RUN), F.lit(0)), lambda x: ~x.rlike("[0-9].*[0-9].*[0-9]"))
    names = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"), F.lit(0)), lambda x: F.translate(x, " ", "_"))
    return few.select(F.explode(F.concat(words, names)).alias("value"), F.lit(0).alias("label"))


def _numbers(values, kind: str) -> Column:
    """A constant array; one literal that is folded once, not thousands of expressions."""
    return F.split(F.lit(",".join(repr(x) for x in values)), ",").cast(f"array<{kind}>")


def log_ratio(token: Column, model: list[float]) -> Column:
    """The summed log-likelihood ratio of the token's character pairs."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i
    codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.get(_numbers(places, "int"), F.ascii(c)))
    steps = F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(_numbers(model, "double"), acc["last"] * STATES + c))).alias("sum")),
    )
    return steps["sum"]


def _spans(text: Column, rule: str, found: Column, kind: int) -> Column:
    """(start, kind, end, value) of the matches ``found`` of ``rule``."""
    pieces = F.split(text, rule, -1)
    whole = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value"))).alias("out"))

    # matches are placed in groups of GROUP, then groups: arrays that grow by one stay short
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(whole, g * GROUP + 1, GROUP), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))

    def shifted(groups: Column) -> Column:
        ends = lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        before = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), ends)["out"]
        move = lambda g, by: F.transform(g["out"], lambda x: F.struct((x["start"] + by).alias("start"), F.lit(kind).alias("kind"), (x["end"] + by).alias("end"), x["value"].alias("value")))
        return F.flatten(F.zip_with(groups, before, move))

    placed = F.get(F.transform(F.array(groups), shifted), 0)  # bound once
    return F.when(F.size(found) == 0, F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")).otherwise(placed)


def _touches(span: Column, others: Column) -> Column:
    """Whether ``span`` overlaps one of ``others``, which are in order and apart; by halving."""
    halve = lambda low, step: F.when((low + step <= F.size(others)) & (F.get(others, low + step - 1)["start"] < span["end"]), low + step).otherwise(low)
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    last = F.get(others, F.aggregate(steps, F.lit(0), halve) - 1)
    return F.when(F.size(others) == 0, F.lit(False)).otherwise(F.coalesce(last["end"] > span["start"], F.lit(False)))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end, value), base in order of start then kind; added spans touch no base span."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = lambda rule, group=0: F.regexp_extract_all("text", F.lit(rule), F.lit(group))
    d = d.select("*", every(ASSIGN).alias("m0"), every(ASSIGN, 1).alias("v0"), every(ACCESS).alias("m1"), every(HEX).alias("m2"), every(RUN).alias("m3"))
    d = d.select("doc_id", "v0", *[_spans(F.col("text"), rule, F.col(f"m{k}"), k).alias(f"s{k}") for k, rule in enumerate((ASSIGN, ACCESS, HEX, RUN))])
    assigned = F.filter("s0", lambda x, i: F.length(F.get("v0", i)) >= MIN_ASSIGNED)
    d = d.select("doc_id", assigned.alias("s0"), "s1", "s2", "s3")
    free = F.filter("s3", lambda x: ~(_touches(x, F.col("s0")) | _touches(x, F.col("s1")) | _touches(x, F.col("s2"))))
    d = d.select("doc_id", F.array_sort(F.concat("s0", "s1", "s2")).alias("base"), F.when(F.size("s3") == 0, F.col("s3")).otherwise(free).alias("free"))
    random = F.filter("free", lambda x: log_ratio(x["value"], model) > threshold)
    return d.select("doc_id", "base", F.when(F.size("free") == 0, F.col("free")).otherwise(random).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(random_strings(spark).union(identifiers(docs))))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
