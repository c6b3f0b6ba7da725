"""The pipeline's stages against their operators' decisions and brute force."""

import hashlib

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from spandrel.llm.queries import PIECE_FILE, tokenizer_path
from tests.llm.test_similar import brute_similar

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.collect()
        assert set(now) <= set(rows)
        if k == 1:
            best = {}
            for r in rows:
                key = hashlib.sha256(r.text.encode().lower()).digest()
                best[key] = max(best.get(key, -1), r.doc_id)
            assert sorted(r.doc_id for r in now) == sorted(best.values())
        if k == 2:
            assert sorted(r.doc_id for r in now) == sorted({c for _, c in brute_similar([(r.doc_id, r.text) for r in rows])})
        rows = now
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_FILE))
    text = {r.doc_id: r.text for r in rows}
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(rows) and all(r.pieces == model.encode(text[r.doc_id]) for r in last)


def test_run_and_odd_rows(spark, odd, empty):
    assert C.run(spark, SF).count() > 100
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, empty):
        for _, stage in C.STAGES:
            stage(spark, frame, SF).collect()


def test_clashing_columns(spark, odd):
    docs = odd
    for name in ("_kept", "_id", "_copies", "_copy", "id", "n", "row", "col"):
        docs = docs.withColumn(name, F.lit("clash"))
    before = docs.count()
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        rows = out.collect()
        assert all(r["_copy"] == r["row"] == r["id"] == "clash" for r in rows) and len({tuple(r) for r in rows}) <= before
    assert C.mixed(spark, docs, SF).count() > 0
