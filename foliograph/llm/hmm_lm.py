"""Language-model scores from a hidden Markov model.

Tokens are the words of the text, A-Z lower-cased, and one end. The TOP most frequent
words of the training texts are symbols of their own; every other word belongs to one
of CLASSES symbols by its last SUFFIX bytes and has a share of its class:
P(word | state) = P(symbol | state) * (c + 0.1) / (C + 0.1 * (V + 1)), with c the word's
count and C and V the class's tokens and distinct words in training.

Method: counts of all training words are aggregated through a shuffle and written. The
first model comes from the corpus's symbol counts; every Baum-Welch step goes over all
training texts in PARTS parts taken by hash (incremental expectation maximisation): for
each part tasks add up the expected counts of their texts, a shuffle adds tasks by symbol,
symbols times STATES numbers reach the driver, replace what that part gave in the step before,
and the sum over all parts makes the next model. Steps go on until two in a row have
gained less than SETTLED in log-likelihood a token. Training reads texts in stretches,
each with some tokens more on either side (see Expected), so no transition is lost.
Scores are exact: the scaled forward recursion runs over each whole text.

Counts of the KNOWN most frequent words are broadcast; the other words of each text, with
how often it has them, meet the count table in a shuffle join, so nothing is cut off.
Words too rare for the broadcast can't be hot among training rows, and unknown ones are
folded by text first.

Defined results: null text is empty (one token, its end); texts with a null doc_id are
scored, are not held out and aren't learned from; repeated rows count as often as they
come and are scored each; without training texts every count is 0 and the model is
uniform; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import bounded_batches, written

STATES = 12
TOP, CLASSES, SUFFIX = 16384, 1024, 3
KNOWN = 200_000
END = TOP + CLASSES
SYMBOLS = END + 1
ADD = 0.1
#: Training runs stretches of SEGMENT tokens, with MARGIN more on either side, IN_STEP at a time; a task holds HELD_TOKENS.
SEGMENT, MARGIN = 512, 16
IN_STEP, HELD_TOKENS = 1024, 1_000_000
#: Steps between two scalings of a sequence's probabilities.
SCALED = 4
PARTS = 4
SETTLED = 1e-3
PRIOR = 20.0
#: What training takes a transition, or an emission beside the symbol's likeliest state, to be at least.
LEAST = 1e-12
FOLDS = 10
COUNTER_WORDS = 300_000
TOKENS_AT_ONCE = 1_500_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes split and lower-case just as the definition has it, at ASCII white space and A-Z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n over all rows of docs (doc_id, text): tasks count first, then the shuffle adds."""

    def run(batches):
        import pyarrow as pa

        def flush(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > COUNTER_WORDS:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    return bounded_batches(docs.select("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What tasks know of the counts: the KNOWN most frequent words, and each class's size."""

    def __init__(self, counts: DataFrame, training_texts: int):
        # a histogram of some hundred steps says in which one the KNOWN words run out; of that one, equal counts go by hash
        step = F.floor(F.log2("n") * 64)
        left, cut = KNOWN, None
        for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
            if r["words"] > left:
                cut = r["step"]
                break
            left -= r["words"]
        top = counts.select("word", "n")
        if cut is not None:
            rest = counts.filter(step == cut).orderBy(F.desc("n"), F.xxhash64("word"), "word").select("word", "n").limit(left)
            top = counts.filter(step > cut).select("word", "n").union(rest)
        top = top.toArrow()
        words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank = {words[i]: k for k, i in enumerate(order)}
        self.n = n[order].astype(np.float64)
        word_total, words = counts.agg(F.sum("n"), F.count("*")).first()
        self.ends = training_texts
        self.tokens = int(word_total or 0) + training_texts
        self.distinct = int(words) + (training_texts > 0)
        self.classes = np.array([class_of(w) for w in self.rank], np.int64)
        suffix = F.when(F.length("word") > SUFFIX, F.substring("word", -SUFFIX, SUFFIX)).otherwise(F.col("word"))
        total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in counts.groupBy((F.crc32(suffix) % CLASSES).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            total[r["c"]], kinds[r["c"]] = r["n"], r["v"]
        own = slice(0, TOP)
        total -= np.bincount(self.classes[own], self.n[own], CLASSES)
        kinds -= np.bincount(self.classes[own], minlength=CLASSES)
        self.class_log = np.log10(total + ADD * (kinds + 1))
        # how often each symbol comes in training, never quite 0
        self.symbols = np.full(SYMBOLS, ADD)
        self.symbols[: min(TOP, len(self.n))] += self.n[own]
        self.symbols[TOP:END] += total
        self.symbols[END] += self.ends
        self.symbol = np.where(np.arange(len(self.n)) < TOP, np.arange(len(self.n)), TOP + self.classes)
        self.count_log = np.log10(self.n + ADD)


class Encoder:
    """Texts as symbols, with the parts of their scores that need no model; all texts of a call together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __call__(self, texts: list[str | None]):
        """Counts of symbols, the symbols, words to look up by text with their times, and base, share and known of each text."""
        v, of = self.v, [tokens(t) for t in texts]
        n = np.fromiter(map(len, of), np.int64, len(of))
        words = list(chain.from_iterable(of))
        row = np.repeat(np.arange(len(of)), n)
        rank = np.fromiter(map(v.rank.get, words, repeat(-1)), np.int64, len(words))
        known = rank >= 0
        seen, seen_row = rank[known], row[known]
        symbol = np.empty(len(words), np.int64)
        symbol[known] = v.symbol[seen]
        unknown = np.flatnonzero(~known)
        other = [words[i] for i in unknown.tolist()]
        symbol[unknown] = [TOP + class_of(w) for w in other]
        symbols = np.full(len(words) + len(of), END, np.uint16)
        symbols[np.arange(len(words)) + row] = symbol
        ends = np.searchsorted(row[unknown], np.arange(len(of) + 1)).tolist()
        tails = [Counter(other[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        add = lambda rows, values: np.bincount(rows, values, len(of))
        base = add(seen_row, v.count_log[seen]) + float(np.log10(v.ends + ADD))
        tail, classed = seen >= TOP, symbol >= TOP
        share = add(seen_row[tail], v.count_log[seen[tail]]) - add(row[classed], v.class_log[symbol[classed] - TOP])
        return n + 1, symbols, tails, base, share, np.bincount(seen_row, minlength=len(of)) + (v.ends > 0)


ENCODED = "doc_id long, held_out boolean, trains boolean, n_tokens long, symbols binary, tail array<struct<word:binary,times:int>>, base double, share double, known long"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each row of docs (doc_id, held_out, trains, text): symbols as 16-bit numbers, the words to look up, sums so far."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import pyarrow as pa

        def cut(values, sizes):
            at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(values)])

        encode = Encoder(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                n, symbols, tails, base, share, known = encode(part.column(3).to_pylist())
                words = pa.array(list(chain.from_iterable(tails)), pa.binary())
                times = pa.array(list(chain.from_iterable(t.values() for t in tails)), pa.int32())
                at = pa.array(np.r_[0, np.cumsum([len(t) for t in tails])], pa.int32())
                tail = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([words, times], ["word", "times"]))
                columns = [part.column(0), part.column(1), part.column(2), pa.array(n), cut(symbols, n * 2), tail, *(pa.array(x.astype(np.float64)) for x in (base, share)), pa.array(known.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "trains", "n_tokens", "symbols", "tail", "base", "share", "known"])

    return bounded_batches(docs.select("doc_id", "held_out", "trains", "text")).mapInArrow(run, ENCODED)


class Model:
    """Start, transition and emission probabilities and the states' overall shares."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray):
        self.start, self.move, self.emit, self.share = start, move, emit, share  # emit: symbols x states
        self.parts: dict[int, list[np.ndarray]] = {}  # in training, the expected counts it was made from

    @classmethod
    def first(cls, symbols: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = symbols[:, None] / symbols.sum() * np.exp(rng.normal(0, 0.5, (len(symbols), STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
        even = np.full(STATES, 1 / STATES)
        return cls(even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), even)

    @classmethod
    def counted(cls, emit: np.ndarray, move: np.ndarray, start: np.ndarray, symbols: np.ndarray) -> Model:
        """From expected counts; the symbols' overall frequencies are the prior of every state's emissions."""
        share = emit.sum(axis=0) + 1e-3
        emit = emit + PRIOR * (symbols / symbols.sum())[:, None]
        move, start = move + 1e-2, start + 1e-2
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), share / share.sum())


class Expected:
    """Expected counts of a model, summed over texts.

    Texts are cut into stretches of SEGMENT tokens that run in step. Each is read with MARGIN tokens more on either side, which
    only tell it what surrounds it: every token and every transition of a text is counted in one stretch."""

    def __init__(self, model: Model):
        self.m = model
        self.emit, self.move, self.start = np.zeros((len(model.emit), STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        self.log_likelihood = 0.0
        peak = np.maximum(model.emit.max(axis=1), 1e-300)
        self.log_peak = np.log(peak)
        # with no step below LEAST ** 2, scaled at every step, all that follows stays within single precision
        self.table = np.maximum(model.emit / peak[:, None], LEAST).astype(np.float32)
        self.moves = np.maximum(model.move, LEAST).astype(np.float32)
        self.held: list[tuple[np.ndarray, int, int]] = []  # stretch with margins, where its own tokens start and end
        self.n_held = 0

    def add(self, texts: list[np.ndarray]) -> None:
        for t in texts:
            for k in range(0, len(t), SEGMENT):
                low, high = max(0, k - MARGIN), min(len(t), k + SEGMENT + MARGIN)
                self.held.append((t[low:high], k - low, min(len(t), k + SEGMENT) - low))
                self.n_held += high - low
            if self.n_held > HELD_TOKENS:
                self.flush()

    def flush(self) -> None:
        """Counts what has been added; to be called before the sums are read."""
        self.held.sort(key=lambda x: -len(x[0]))
        for low in range(0, len(self.held), IN_STEP):
            self._stretches(self.held[low : low + IN_STEP])
        self.held, self.n_held = [], 0

    def _stretches(self, parts: list[tuple[np.ndarray, int, int]]) -> None:
        """Longest first; rows of one step lie together, so position = first row of the step + row."""
        length = np.array([len(p[0]) for p in parts])
        own_from, own_to = (np.array([p[k] for p in parts]) for k in (1, 2))
        steps, row = int(length[0]), np.repeat(np.arange(len(parts)), length)
        active = np.searchsorted(-length, -np.arange(steps), "left")
        at = np.r_[0, np.cumsum(active)]
        step = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        place = at[step] + row
        symbols = np.empty(len(row), np.int32)
        symbols[place] = np.concatenate([p[0] for p in parts])
        own = np.empty(len(row), bool)
        own[place] = (step >= own_from[row]) & (step < own_to[row])
        emits, one = self.table.take(symbols, axis=0), np.ones((STATES, 1), np.float32)
        move = self.moves
        back, begins = np.ascontiguousarray(move.T), (own_from == 0)[:, None]
        alphas, betas, scale = np.empty_like(emits), np.empty_like(emits), np.empty((len(row), 1), np.float32)
        n, low = active.tolist(), at.tolist()
        for t in range(steps):
            a = alphas[low[t] : low[t + 1]]
            if t:
                np.matmul(alphas[low[t - 1] : low[t - 1] + n[t]], move, out=a)
            else:
                a[:] = np.maximum(np.where(begins, self.m.start, self.m.share), LEAST)
            a *= emits[low[t] : low[t + 1]]
            np.matmul(a, one, out=scale[low[t] : low[t + 1]])
            a /= scale[low[t] : low[t + 1]]
        # a step's scale is the probability of its token, given what came before it
        self.log_likelihood += float(np.log(scale[own, 0]).sum(dtype=np.float64)) + float(self.log_peak[symbols[own]].sum())
        emits /= scale
        betas[low[steps - 1] :] = 1
        for t in range(steps - 1, 0, -1):
            e = emits[low[t] : low[t + 1]]
            e *= betas[low[t] : low[t + 1]]
            b = betas[low[t - 1] : low[t]]
            np.matmul(e, back, out=b[: n[t]])
            b[n[t] :] = 1  # stretches that end here
        # scaled alike in both directions, a token's states add up to one; margins don't count
        betas *= alphas
        betas[~own] = 0
        emits[~own] = 0
        pairs = np.zeros((STATES, STATES), np.float32)
        for t in range(1, steps):
            pairs += alphas[low[t - 1] : low[t - 1] + n[t]].T @ emits[low[t] : low[t + 1]]
        self.move += pairs * move.astype(np.float64)
        self.start += betas[: n[0]][begins[:, 0]].sum(axis=0, dtype=np.float64)
        for k, of_state in enumerate(np.eye(STATES, dtype=np.float32) @ betas.T):  # a product, as it is the fast way to turn the table
            self.emit[:, k] += np.bincount(symbols, of_state.astype(np.float64), len(self.emit))


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's probability: the scaled forward recursion, all texts in step, longest first."""
    length = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-length, kind="stable")
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    length = length[order]
    at = np.cumsum(length) - length
    active = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # how many are longer than t
    total = np.zeros(len(texts))
    alpha, after = np.broadcast_to(model.start, (len(texts), STATES)), [*active.tolist()[1:], 0]
    for t, (k, left) in enumerate(zip(active.tolist(), after, strict=True)):
        alpha = (alpha[:k] if t == 0 else alpha[:k] @ model.move) * model.emit[flat[at[:k] + t]]
        if t % SCALED == 0:
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:k] += np.log10(scale)
        if left < k:  # sequences that end here
            total[left:k] += np.log10(alpha[left:].sum(axis=1))
    out = np.empty(len(texts))
    out[order] = total
    return out


def _lists(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in column]


def expected_counts(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Emissions, moves and starts that ``model`` expects in rows (symbols), and their log-likelihood."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Model(model.start, model.move, model.emit, model.share))
    names = [f"s{k}" for k in range(STATES)]

    def run(batches):
        import pyarrow as pa

        got = Expected(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                got.add(_lists(batch.column(0).slice(low, 1000)))
        got.flush()
        numbers = np.concatenate([got.emit, got.move, got.start[None], np.full((1, STATES), got.log_likelihood)])
        at = np.flatnonzero(numbers.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(numbers[at, k]) for k in range(STATES))], ["at", *names])

    sums = bounded_batches(rows.select("symbols")).mapInArrow(run, f"at int, {', '.join(f'{x} double' for x in names)}").groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    shared.destroy()
    numbers = np.zeros((SYMBOLS + STATES + 2, STATES))
    numbers[sums.column("at").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1)
    if not np.isfinite(numbers).all():
        raise ArithmeticError("expected counts are not finite")
    return numbers[:SYMBOLS], numbers[SYMBOLS : SYMBOLS + STATES], numbers[-2], float(numbers[-1, 0])


def baum_welch(rows: DataFrame, model: Model, symbols: np.ndarray) -> tuple[Model, float]:
    """One step over all rows (part, symbols), part by part: the next model, and the parts' log-likelihoods as they were met."""
    parts, found = dict(model.parts), 0.0
    for part in range(PARTS):
        *parts[part], likelihood = expected_counts(rows.filter(F.col("part") == part), model)
        found += likelihood
        model = Model.counted(*[np.sum([p[k] for p in parts.values()], axis=0) for k in range(3)], symbols)
    model.parts = parts
    return model, found


def train(rows: DataFrame, vocabulary: Vocabulary) -> Model:
    """From encoded training rows: steps over everything until the likelihood has settled."""
    model = Model.first(vocabulary.symbols)
    if not vocabulary.ends:
        return model
    last, still = -np.inf, 0
    while still < 2:
        model, now = baum_welch(rows, model, vocabulary.symbols)
        still = 0 if now - last >= SETTLED * vocabulary.tokens else still + 1
        last = now
    return Model(model.start, model.move, model.emit, model.share)


def model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """rid and log10 probability of the symbols of every row (rid, symbols)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, low, size = _lists(batch.column(1)), 0, 0
            out = np.empty(len(texts))
            for i in range(len(texts) + 1):
                if i == len(texts) or (i > low and size + len(texts[i]) > TOKENS_AT_ONCE):
                    if i > low:
                        out[low:i] = forward(shared.value, texts[low:i])
                    low, size = i, 0
                if i < len(texts):
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["rid", "hmm"])

    return bounded_batches(rows.select("rid", "symbols")).mapInArrow(run, "rid long, hmm double")


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumns({"held_out": held_out(F.col("doc_id")), "trains": F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))})
    counts = written(word_counts(d.filter("trains")), "words")
    vocabulary = Vocabulary(counts, d.filter("trains").count())
    part = F.when(F.col("trains"), F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(PARTS))).otherwise(-1).cast("int")
    rows = written(encoded(d, vocabulary).withColumns({"rid": F.monotonically_increasing_id(), "part": part}), "symbols", ["part"])
    model = train(rows.filter("part >= 0"), vocabulary)
    look = rows.select("rid", F.explode("tail").alias("x")).select("rid", F.col("x.word").alias("word"), F.col("x.times").alias("times"))
    found = look.join(counts, "word", "left")
    tails = found.groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD)) * F.col("times")).alias("tail_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known"))
    heads = rows.drop("tail", "symbols", "trains", "part").join(tails, "rid", "left").join(model_scores(rows, model), "rid")
    tail, base_size = F.coalesce("tail_log", F.lit(0.0)), float(np.log10(vocabulary.tokens + ADD * (vocabulary.distinct + 1)))
    return heads.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + tail - F.col("n_tokens") * F.lit(base_size)).alias("base_score"),
        (F.col("hmm") + F.col("share") + tail).alias("score"),
    )


def op5_hmm_lm(spark, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
