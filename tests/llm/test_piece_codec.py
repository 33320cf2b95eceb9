import hashlib
import random

import numpy as np
import sentencepiece

from foliograph.llm import piece_codec
from tests.llm.helpers import ODD, docs, prose, with_clashes

PATH = piece_codec.default_model()


def library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [(ids := model.encode(t, add_bos=True, add_eos=True), model.decode(ids)) for t in texts]


def test_same_ids_and_texts_as_the_library():
    rng = random.Random(3)
    parts = ["a", "th", "er", " ", "  ", "▁", "\n", "é", "ß", "日本", "😀", "1", ".", "\t", " ", "<s>", "x" * 90, "\x00"]
    texts = ["", " ", "▁▁▁ a", "\n\n", "<0x0A>", " " * 40 + "y", prose(1, 300), "ab" * 400] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    model = piece_codec.load(PATH)
    ids, counts = piece_codec.ChunkTable(model).encode(texts)
    for own, (want, text) in zip(np.split(ids, np.cumsum(counts)[:-1]), library(texts), strict=True):
        assert own.tolist() == want and piece_codec.decode(model, own) == text


def test_odd_ids_decode_as_in_the_library():
    lib, model = sentencepiece.SentencePieceProcessor(model_file=PATH), piece_codec.load(PATH)
    for ids in ([1, 2], [264], [1, 28705, 264, 2], [1, 0, 264, 2], [200, 201, 300], [1, 130, 2], [28705, 28705]):
        assert piece_codec.decode(model, np.array(ids)) == lib.decode(ids)


def test_table_starts_afresh(monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_CHUNKS", 5)
    table, model = piece_codec.ChunkTable(piece_codec.load(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for seed in range(4):
        ids, _ = table.encode([prose(seed, 30)])
        assert ids.tolist() == model.encode(prose(seed, 30), add_bos=True, add_eos=True)


def test_query_rows(spark):
    rows = [*ODD, *[(100 + i, prose(i, 50)) for i in range(40)]]
    got = piece_codec.digests(with_clashes(docs(spark, rows)), PATH, with_ids=True).collect()
    want = []
    for (i, _), (ids, text) in zip(rows, library([t or "" for _, t in rows]), strict=True):
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(map(str, got)) == sorted(str(type(got[0])(**dict(zip(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"], w, strict=True)))) for w in want)
    assert piece_codec.encoded(docs(spark, rows), PATH).count() == len(rows)
    assert piece_codec.digests(docs(spark, []), PATH).count() == 0
