import hashlib

import corpus_pipeline
import numpy as np
import sentencepiece

from foliograph.llm import piece_codec
from tests.llm.helpers import saved
from tests.llm.test_toxicity import corpus


def test_stages_in_order(spark, tmp_path):
    rows, labels = corpus(260)
    rows = [(i, t, f"s{i % 4}") for i, t in rows]
    clean = [r for r, (_, t) in zip(rows, labels, strict=True) if not t]
    line = "a passage that several documents share word for word"
    long = [r for r in clean if len(r[1].split()) > 80][:5]
    for k, (_, text, _) in enumerate(long):  # near copies that also share a line
        words = text.split()
        words[10] = "changed"
        rows.append((1000 + k, f"{' '.join(words)}\n{line}", "s1"))
    rows += [(2000, None, None), (2001, "", "s2")]
    folder = saved(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], folder))
    assert all(d.columns == names for d in kept[1:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    toxic = {i for i, t in labels if t}
    assert len(ids[1] & toxic) < 0.1 * len(toxic) and len(ids[0] - ids[1] - toxic) < 0.03 * len(ids[0])
    assert ids[2] == ids[1]
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert sum(line in (t or "") for t in texts.values()) == 1
    assert all(1000 + k in ids[2] and (1000 + k in ids[3]) != (r[0] in ids[2]) for k, r in enumerate(long))
    assert ids[4] <= ids[3] and ids[5] == ids[4]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    mixed = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    for r in kept[5].collect():
        want = model.encode(mixed[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == want and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
