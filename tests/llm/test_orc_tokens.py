import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import orc_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(spark, docs, path, tokenizer):
    orc_tokens.write(docs, path, PATH)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: r[0])
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    stored = orc_tokens.read(spark, path)
    assert {r.doc_id: r.ids for r in stored.collect()} == ids
    at, want = 0, []
    for d, _ in rows:
        want.append((d, at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        at += len(ids[d])
    assert sorted(map(tuple, orc_tokens.summary(spark, path).collect())) == want


def test_same_ids_as_the_library_on_whole_texts(spark, sf_dir, tmp_path, tokenizer):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "t"), tokenizer)


def test_edge_cases(spark, tmp_path, tokenizer):
    texts = [None, "", " \t\n", "A<|endoftext|>b x́ ́y É z it's 2024!?", "ΑΣ ß İ k \x1c q", "long " * 100_000]
    docs = spark.createDataFrame([(9 - i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int")
    check(spark, docs, str(tmp_path / "e"), tokenizer)
    orc_tokens.write(docs.limit(0), str(tmp_path / "none"), PATH)
    repeated = docs.unionAll(docs)
    orc_tokens.write(repeated, str(tmp_path / "twice"), PATH)
    rows = sorted(orc_tokens.summary(spark, str(tmp_path / "twice")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()] and len(rows) == 12


def test_lookup_prunes_by_metadata(spark, sf_dir, tmp_path):
    orc_tokens.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "p"), PATH)
    found = orc_tokens.read(spark, str(tmp_path / "p"), [3, 77])
    assert sorted(r.doc_id for r in found.collect()) == [3, 77]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_ties_start_where_the_files_have_them(spark, tmp_path, tokenizer):
    """Many rows with one id over several files: starts follow the stored order, and each has its own ids' checksum."""
    docs = spark.createDataFrame([(7 if i % 3 else i, f"text {'x ' * (i % 11)}{i}") for i in range(200)], "doc_id long, text string").repartition(5)
    orc_tokens.write(docs, str(tmp_path / "t"), PATH, file_bytes=100)
    stored = [r.ids for f in sorted((tmp_path / "t").glob("part-*")) for r in sorted(spark.read.orc(str(f)).collect(), key=lambda r: r.place)]
    rows = sorted(orc_tokens.summary(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(stored) == len(rows) == 200 and len({*(tmp_path / "t").glob("part-*")}) > 4
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in stored]
    assert [r.start for r in rows] == [0, *np.cumsum([len(x) for x in stored])[:-1].tolist()]


def test_a_tokenizer_of_other_steps_encodes_whole_texts():
    source = open(PATH).read()
    assert orc_tokens.words_stand_alone(source)
    other = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    assert not orc_tokens.words_stand_alone(other) and not orc_tokens.words_stand_alone(source.replace('"Lowercase"', '"NFD"'))
    texts = ["It's  a TEST of 2024!", "", "  x y"]
    ids, sizes = orc_tokens._Words(other).encode([t.encode() for t in texts], 1)
    want = [[*e.ids, 1] for e in Tokenizer.from_str(other).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
