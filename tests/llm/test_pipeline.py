import re

import pytest
import sentencepiece

import public_tokenizers

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.count() == len(kept[name])
        else:
            tokens = {r.doc_id: r for r in docs.collect()}
            assert tokens.keys() == {r.doc_id for r in before.collect()}
    assert len(kept["language_id"]) >= 0.99 * len(texts)
    # one of each exact copy
    assert len({*kept["near_dedup"].values()}) == len(kept["near_dedup"]) and {*kept["language_id"].values()} >= {*kept["near_dedup"].values()}
    first = {}
    for d in sorted(kept["language_id"]):
        first.setdefault(kept["language_id"][d], d)
    assert kept["near_dedup"].keys() <= {*first.values()} and len(kept["near_dedup"]) >= 0.97 * len(first)
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, t in kept["near_dedup"].items() if any(b in t for b in bench)}
    assert leaks and kept["decontamination"].keys() == kept["near_dedup"].keys() - leaks
    private = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)|\b[0-9a-f]{40}\b")
    for d, t in kept["decontamination"].items():
        after = kept["personal_data"][d]
        assert not any(x in after for x in private.findall(t)) and (private.search(t) or re.search(r"[\d@]|M[rs]|Frau|Herr", t) or after == t)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, t in kept["personal_data"].items():
        assert tokens[d].ids == library.encode(t) and tokens[d].decoded == t and tokens[d].n_tokens == len(tokens[d].ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_every_stage_takes_nulls(spark, sf_dir):
    rows = [(None, "the and of to with in that for is on", None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "the and of", "en", None, 10), (3, "the and of", "en", None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3]
