import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import spiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize(("giant", "chunk"), [(65_536, 16_384), (300, 70), (40, 3)])
def test_same_ids_as_the_library(spark, sf_dir, library, giant, chunk):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.where("length(text) < 1500") if chunk < 50 else docs
    got = spiece.decode(spiece.encode(docs, PATH, giant=giant, chunk=chunk), PATH).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] == r.text


def test_chunks_of_odd_texts(library):
    """The scan without Spark, cut everywhere."""
    import pyarrow as pa

    v, rng = spiece.Vocabulary(open(PATH, "rb").read()), random.Random(2)
    texts = ["a", " ", "     ", "        x         ", "\n\n\t", "日本語 ▁▁ x", "é😀é\x00", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalization 2024-01-01 12345678", "===---===   def f(x):\n        return x"]
    texts += ["".join(rng.choice(["a", "e", "th", "in", "er", " ", "  ", "ing", "\n", "é", "9"]) for _ in range(60)) for _ in range(40)]
    for text in texts:
        s = spiece.SPACE + text.replace(" ", spiece.SPACE)
        for chunk in (1, 2, 5, 17):
            cuts = [(b, min(b + chunk, len(s)), b + chunk >= len(s)) for b in range(0, len(s), chunk)]
            m = [v.transfer(s, *c) for c in cuts]
            table = pa.table({"key": ["k"] * len(m), "chunk": range(len(m)), "entries": [x.shape[0] for x in m], "exits": [x.shape[1] for x in m], "matrix": [spiece.np.packbits(x).tobytes() for x in m]})
            states = spiece._scan(table).to_pylist()
            ids = [i for c, r in zip(cuts, states) for i in v.traced(s, *c, r["entry"], r["exit"])]
            assert ids == library.encode(text), (text, chunk)
            assert v.decoded(spiece.np.array(ids)) == library.decode(ids)


def test_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "word " * 20_000), (4, "word " * 20_000), (5, "a" * 70_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, chunk int")
    got = spiece.decode(spiece.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") and r.key == "k"
    assert spiece.encode(df.limit(0), PATH).count() == 0
