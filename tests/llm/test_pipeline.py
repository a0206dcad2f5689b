"""Each stage against a plain version of its decision, and the whole run."""

import random
import re

import corpus_pipeline
from regiotally.llm import tree_bpe
from tests.llm.cases import changed, documents, prose, row

ITEM = " ".join(f"question{i}" for i in range(20)) + ". answer of it"


def _tables(spark, folder):
    base = prose(90, 40)
    more = [row(20, prose(60, 50) + " " + ITEM), row(21, base), row(22, changed(base, 30)), row(23, prose(50, 51) + " 4785380592391139")]
    docs = documents(spark, more)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = _tables(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE encoding and decoding"]
    now, seen = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"s{number}")
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        if number < 4:
            assert now.columns == docs.columns
        seen.append([r.doc_id for r in now.select("doc_id").collect()])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lettered = sorted((d for d, t in rows if t and re.search(r"[^\W\d_]", t)), key=str)
    assert sorted(seen[0], key=str) == lettered
    assert sorted(seen[1], key=str) == sorted([1, 4, 8, 10, 11, 12, 13, 20, 21, 23, None], key=str)
    assert sorted(seen[2], key=str) == sorted([1, 4, 8, 10, 11, 12, 13, 21, 23, None], key=str)
    assert sorted(seen[3], key=str) == sorted(seen[2], key=str) == sorted(seen[4], key=str)
    private = spark.read.parquet(str(tmp_path / "s3")).filter("doc_id = 23").first().text
    assert "4785380592391139" not in private and len(private) == len(dict(rows)[23])
    assert now.filter("doc_id = 10").first().n_tokens > 0 and tree_bpe.LEAF


def test_run_over_an_empty_table(spark, tmp_path):
    docs = _tables(spark, str(tmp_path)).limit(0)
    folder = str(tmp_path / "none")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_near_pairs_among_strangers_leave_one(spark):
    """The stage keeps one of each pair at 0.8, though all share three quarters of their words."""
    pick, shared, rows = random.Random(8), [f"all{i}" for i in range(150)], []
    for k in range(40):
        own, kept = [f"own{k}x{i}" for i in range(50)], set(pick.sample(range(50), 10))
        rows += [row(k, " ".join(shared + own)), row(1000 + k, " ".join(shared + [w if i in kept else f"other{k}x{i}" for i, w in enumerate(own)]))]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, documents(spark).schema), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(40))
