"""The pipeline's stages on a small table, and its end against brute force."""

import hashlib
from collections import Counter

import pytest

from conftest import folder

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    from tracewash.llm import minhash, mixing, pii, quality
    from tracewash.llm.common import cut, table

    docs = table(spark, folder("sf0.001"), "documents")
    seen = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        seen.append(cut(stage(spark, seen[-1], "")))
        assert seen[-1].columns == COLUMNS
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[1]) == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert sorted(ids[2]) == sorted(r.doc_id for r in minhash.near_duplicates(seen[1]).where("kept").collect())
    assert sorted(ids[3]) == sorted(ids[2])
    assert not any(s.startswith(("email", "phone", "card", "ip")) for r in pii.digests(pii.find(seen[3])).collect() for s in r.spans.split(",") if s)
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert Counter(ids[4]) == Counter({i: n for i, n in copies.items() if n})

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in seen[4].collect():
        found = sp.encode(r.text, add_eos=True)
        want[r.doc_id, len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()] += 1
    got = pipeline.STAGES[-1][1](spark, seen[4], "")
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()) == want


CLASHING = ["size", "_row", "_doc", "_kept", "_id", "_key", "kept", "taken", "target", "position", "text_key", "rid", "key", "weight"]


def test_nulls_extra_columns_and_an_empty_table(spark):
    from tracewash.llm.common import cut

    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    clean = " ".join(f"the word{i} of line{i}x" for i in range(60))
    other = " ".join(f"a thing{i} in that{i}y" for i in range(60))
    rows = [(1, clean, "en", None, None), (1, clean, "en", None, None), (1, other, "en", None, 7), (None, clean + " more", None, "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    for data, ends in ((rows, {(1, clean), (1, other), (None, clean + " more")}), ([], set())):
        docs = spark.createDataFrame([(*r, *CLASHING) for r in data], schema)
        for name, stage in pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, ""))
            assert docs.columns == [c.strip().split()[0] for c in schema.split(",")] and all(list(r)[5:] == CLASHING for r in docs.collect())
            if name == "near_duplicates":
                assert {(r.doc_id, r.text) for r in docs.collect()} == ends and docs.count() == len(ends)
        assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, "").collect()} <= {i for i, _ in ends}
