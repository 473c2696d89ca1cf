"""The pipeline's stages, each on its predecessor's rows, and the registered queries."""

import duckdb

import __spark_entry__
import corpus_pipeline
from diskloom.llm import entries, quality
from tests.llm import corpus

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = seen["quality_classifier"]
    model = quality.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(quality.score(before, model).where("predicted = 1"))
    before, after = seen["exact_dedup"]
    assert ids(after) == ids(entries.exact_dedup.exact_dedup(before).where("kept"))
    before, after = seen["simhash_near_dedup"]
    rows = before.select("doc_id", "text").collect()
    kept = {c for c in corpus.classes([corpus.simhash(r[1]) for r in rows], [r[0] for r in rows])}
    assert ids(after) == sorted(kept)
    before, after = seen["source_mixing"]
    copies = {r["doc_id"]: r["copies"] for r in entries.mixing.mix(before).collect()}
    assert ids(after) == sorted(i for i, n in copies.items() for _ in range(n))
    before, after = seen["best_fit_packing"]
    assert after.where("piece = 0").count() == before.count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0
    empty = spark.createDataFrame([], corpus.SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11)) and "pipeline" in names


def test_sql_of_exact_dedup(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    wanted = sorted(con.execute(entries.oracle_sql()["op5_exact_dedup"]).fetchall())
    assert sorted(map(tuple, entries.op5_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == wanted
