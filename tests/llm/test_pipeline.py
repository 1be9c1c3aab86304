"""The pipeline on small tables against the same steps by brute force."""

import corpus_pipeline
from locusframe.llm import queries

from .test_dedup import brute_leaks, brute_links, lines_left

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram join", "decontamination", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        after[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == before.columns
    rows = lambda name: [(r[0], r[1]) for r in after[name]]
    rejected = {r.doc_id for r in queries.op6_quality_rules(spark, SF).collect() if not r.kept}
    assert rejected and {i for i, _ in rows("quality rules")}.isdisjoint(rejected)
    assert sum(lines_left(rows("quality rules"), 10).values()) == len(rows("line dedup"))
    classes = {c for c, _ in brute_links(rows("line dedup")).values()}
    assert {i for i, _ in rows("n-gram join")} == classes
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _ in brute_leaks(rows("n-gram join"), bench)}
    assert {i for i, _ in rows("decontamination")} == classes - leaks
    assert {r[0] for r in after["packing"]} == classes - leaks
    assert corpus_pipeline.run(spark, SF).count() == len(after["packing"])


def test_odd_rows_through_all_stages(spark, odd, odd_rows, no_rows):
    """Nulls, repeated rows, long texts and clashing columns; then an empty table."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), "test-odd")
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
            assert docs.where("doc_id is null").count() == (0 if name == "quality rules" else before.where("doc_id is null").count())
        else:
            ids = {r.doc_id for r in before.collect()}
            assert ids and {r.doc_id for r in docs.collect()} == ids
    empty = no_rows
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF), "test-none")
        assert empty.count() == 0
