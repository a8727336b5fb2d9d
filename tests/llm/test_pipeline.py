"""The pipeline's stages in order, each on what the one before kept."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from mosaiq.llm import decontaminate, lines, quality


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    good, fresh, single, clean, encoded = kept
    everything = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r.doc_id for r in quality.classify(everything, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 0").collect()}
    assert set(good) == {r.doc_id for r in everything.select("doc_id").collect()} - rejected and rejected
    seen = [lines.normalise(x.encode()) for r in fresh.values() for x in r.text.split("\n")]
    seen = [x for x in seen if x]
    assert len(seen) == len(set(seen)) and set(seen) <= {lines.normalise(x.encode()) for r in good.values() for x in r.text.split("\n")}
    assert all(r.n_chars == len(r.text) for r in fresh.values())
    assert set(single) <= set(fresh) and set(clean) <= set(single)
    items = decontaminate.read_items(spark.read.parquet(f"{sf}/benchmark.parquet"))
    for i, r in single.items():
        text = b" " + b" ".join(decontaminate.tokens(r.text)) + b" "
        if any(x.joined in text for x in items):
            assert i not in clean
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(encoded) == set(clean)
    for i, r in list(clean.items())[::20]:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert encoded[i].ids == ids and encoded[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run(spark, sf):
    """run() gives what the stages give one after the other, and loses no clean document."""
    rows = cp.run(spark, sf).collect()
    assert set(rows[0].__fields__) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    assert 0 < len(rows) <= 200 and len({r.doc_id for r in rows}) == len(rows)
