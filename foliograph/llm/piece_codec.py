"""SentencePiece BPE encoding and decoding with a distinct-chunk table.

Pieces never hold a whitespace marker after another character, so a text falls
into chunks (a run of markers and what follows it, up to the next marker or line
feed) that no merge can cross. Each task keeps a table of the distinct chunks it
has met, segments the new ones of a batch together with array operations, and puts
the ids back by position. The model file is only read for its pieces and scores;
it is opened in each Python worker from a path that is a parameter, so every
machine needs the file there.

The work is map-side: no shuffle. A worker holds one batch and at most TABLE_CHUNKS
distinct chunks; beyond that the table starts afresh.

Defined results: null text is the empty text, whose ids are begin and end; repeated
rows are encoded each; an empty table gives an empty table; a null doc_id stays null;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import bounded_batches

MARK = "▁"
TABLE_CHUNKS = 400_000
#: Longer chunks are merged one by one with a heap instead of in step with others.
LONG_CHUNK = 64
CHARS_AT_ONCE = 4_000_000
_CHUNK = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_NEVER = np.iinfo(np.int64).max


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start+length-1 of each range, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class PieceModel:
    """Pieces, scores and the merge table of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        is_byte = [model.is_byte(i) for i in range(size)]
        self.bos, self.eos, self.size = model.bos_id(), model.eos_id(), size
        self.bytes = np.zeros(256, np.int64)
        for i in range(size):
            if is_byte[i]:
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces of this model cross whitespace markers")
        self.score = np.array([model.get_score(i) for i in range(size)])
        # equal scores must stay equal: ranks number the distinct scores, best first
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        # merges: two pieces side by side whose letters make a piece
        pairs: dict[int, int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        # a piece may need a character that is no piece itself: such merges can't be kept by ids
        if any(self.chars[ord(c)] < 0 for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        # what each id decodes to
        text = [b"" if special[i] and i != model.unk_id() else bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if model.unk_id() >= 0:
            text[model.unk_id()] = " ⁇ ".encode()
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.out_len = np.array([len(t) for t in text], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(text), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, -1 for none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def one(self, chunk: str) -> list[int]:
        """Segments a single long chunk: the best pair first, the leftmost of equals."""
        ids = [int(self.chars[ord(c)]) for c in chunk]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and ids[i] >= 0 and ids[j] >= 0 and (m := self.pairs.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, ids[i], ids[j], m))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = m, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for i in range(n):
            if not gone[i]:
                out += [ids[i]] if ids[i] >= 0 else [int(self.bytes[x]) for x in chunk[i].encode()]
        return out

    def many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segments short chunks together, one merge of each in a round; returns ids, one chunk after another, and their counts."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids, word = self.chars[points].astype(np.int64), np.repeat(np.arange(len(chunks)), lengths)
        origin = np.arange(len(ids))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = np.full(len(ids), -1, np.int64)
        if len(ids) > 1:
            made[:-1] = np.where(word[:-1] == word[1:], self.merged(ids[:-1], ids[1:]), -1)
        while len(ids):
            # of each word the pair of best rank, the leftmost of equals
            cost = np.where(made >= 0, self.rank[made] * len(ids) + np.arange(len(ids)), _NEVER)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(cost, first)
            over = best == _NEVER
            if over.any():
                still = np.repeat(~over, np.diff(np.r_[first, len(ids)]))
                done.append((ids[~still], word[~still], origin[~still]))
                best = best[~over]
                ids_before = len(ids)
                at = best % ids_before
                moved = np.cumsum(still) - 1
                at = moved[at]
                ids, word, origin, made = ids[still], word[still], origin[still], made[still]
            else:
                at = best % len(ids)
            if not len(ids):
                break
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, word, origin, made = ids[keep], word[keep], origin[keep], made[keep]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                same = (right > left) & (word[left] == word[right])
                made[left] = np.where(same, self.merged(ids[left], ids[right]), -1)
        ids, word, origin = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(origin, kind="stable")
        ids, word, origin = ids[order], word[order], origin[order]
        if (ids < 0).any():  # characters that are no piece become their bytes
            spelt = [[i] if i >= 0 else self.bytes[list(chr(points[o]).encode())].tolist() for i, o in zip(ids.tolist(), origin.tolist(), strict=True)]
            word = np.repeat(word, [len(s) for s in spelt])
            ids = np.array([i for s in spelt for i in s], np.int64)
        return ids, np.bincount(word, minlength=len(chunks)).astype(np.int64)


class ChunkTable:
    """Distinct chunks and their ids, segmented once each."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _segment_new(self) -> None:
        new = list(self.number)[len(self.n) :] if len(self.n) < len(self.number) else []
        if not new:
            return
        short = [c for c in new if len(c) <= LONG_CHUNK]
        ids, counts = self.model.many(short)
        if len(short) < len(new):
            parts, spelt = iter(np.split(ids, np.cumsum(counts)[:-1])), []
            for c in new:
                spelt.append(next(parts) if len(c) <= LONG_CHUNK else np.array(self.model.one(c), np.int64))
            ids, counts = np.concatenate(spelt), np.array([len(x) for x in spelt], np.int64)
        at = len(self.ids) + np.cumsum(counts) - counts
        self.ids, self.at, self.n = np.r_[self.ids, ids.astype(np.int32)], np.r_[self.at, at], np.r_[self.n, counts]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, begin and end ids included, and how many each has."""
        if len(self.number) > TABLE_CHUNKS:
            self.clear()
        number, chunks, per_text = self.number, [], []
        for text in texts:
            found = _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
            chunks.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            per_text.append(len(found))
        self._segment_new()
        flat = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
        lengths = self.n[flat]
        inner = self.ids[_ranges(self.at[flat], lengths)]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(per_text, dtype=np.int64)] if per_text else np.zeros(0, np.int64)
        counts = np.diff(np.r_[0, ends]) + 2
        out = np.empty(int(counts.sum()), np.int32)
        last = np.cumsum(counts)
        body = np.ones(len(out), bool)
        body[last - counts] = body[last - 1] = False
        out[body], out[last - counts], out[last - 1] = inner, self.model.bos, self.model.eos
        return out, counts


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids: their pieces with markers as spaces, without the one space that encoding put first."""
    lengths = model.out_len[ids]
    raw = model.out[_ranges(model.out_at[ids], lengths)].tobytes()
    seen = ids[(ids != model.bos) & (ids != model.eos)]
    if len(seen) and model.marked[seen[0]]:
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        # each byte that starts no character stands for one replacement character
        out, i = [], 0
        while i < len(raw):
            n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 0
            try:
                out.append(raw[i : i + n].decode() if n else "�")
                i += n or 1
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of this worker process, read once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most CHARS_AT_ONCE characters (or one row)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every row."""

    def run(batches):
        import pyarrow as pa

        table = ChunkTable(load(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, counts = table.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bounded_batches(d).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row: encoded, then decoded from the ids."""

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        import pyarrow as pa

        model = load(path)
        table = ChunkTable(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, counts = table.encode(texts[a:b])
                own = np.split(ids, np.cumsum(counts)[:-1])
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(counts),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                    pa.array([hashlib.sha256(decode(model, x).encode()).hexdigest() for x in own]),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return bounded_batches(d).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_codec(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_model())
