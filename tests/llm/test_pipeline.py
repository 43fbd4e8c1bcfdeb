import corpus_pipeline
from tests.llm.fixtures import documents, prose


def test_stages_and_run(spark, tmp_path):
    docs = documents(spark, 60)
    copy = spark.createDataFrame([(4000, prose("en", 150, 77), "en", "s", 0), (4001, prose("en", 150, 77) + " end", "en", "s", 0), (4002, prose("en", 150, 77), "en", "s", 0)], docs.schema)
    docs = docs.unionByName(copy)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "packing"]
    held, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns
        left.append({r["doc_id"] for r in held.collect()})
    assert not left[0] & {1000, 1001, 1002, 1003} and {4000, 4001, 4002} <= left[0]
    assert {4000, 4001, 4002} & left[1] == {4001, 4002}  # of equal texts the largest id stays
    assert {4001, 4002} & left[2] == {4001}  # of near copies the smallest
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == left[2] and all(r["offset"] + r["length"] <= 4096 for r in out)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
