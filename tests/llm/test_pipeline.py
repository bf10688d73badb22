"""The pipeline, each stage against a plain version of it on the stage's own input."""
import corpus_pipeline as pipeline

from cases import linked, removed, words
from oracle import compare, connect

from srcgraph.llm import decontaminate, packing, quality
from srcgraph.llm.queries import ORACLES, QUERIES
from srcgraph.llm.tables import cut, table
from srcgraph.llm.tokens import WordEncoder, default_path

FOLDER = "/root/testdata/sf0.001"

def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    model = quality.fit(docs, table(spark, FOLDER, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}

    first = {r.doc_id: r for r in cut(pipeline.quality_rules(spark, docs, FOLDER))[0].collect()}
    verdict = {r.doc_id: r.kept for r in quality.quality(docs, model).collect()}
    assert first == {i: rows[i] for i, kept in verdict.items() if kept}

    frame = spark.createDataFrame(list(first.values()), docs.schema)
    second = {r.doc_id: r for r in pipeline.near_duplicates(spark, frame, FOLDER).collect()}
    component = linked([(i, r.text) for i, r in first.items()])
    assert second == {i: first[i] for i, (_, c) in component.items() if c == i}

    frame = spark.createDataFrame(list(second.values()), docs.schema)
    third = {r.doc_id: r for r in pipeline.repeated_passages(spark, frame, FOLDER).collect()}
    want = removed([(i, r.text) for i, r in second.items()], words, 13, b" ".join)
    assert set(third) == {i for i, (n, m, *_) in want.items() if m < n or n == 0}
    assert all(len(words(third[i].text)) == want[i][0] - want[i][1] for i in third)
    assert all(third[i] == second[i] for i in third if want[i][1] == 0)
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[i].lang, rows[i].source) for i, r in third.items())

    frame = spark.createDataFrame(list(third.values()), docs.schema)
    fourth = {r.doc_id: r for r in pipeline.benchmark_free(spark, frame, FOLDER).collect()}
    items = [" ".join(decontaminate.TOKEN.findall(r.text.lower())) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {i for i, r in third.items() if not any(x in " ".join(decontaminate.TOKEN.findall(r.text.lower())) for x in items)}
    assert set(fourth) <= clean and all(fourth[i] == third[i] for i in fourth)
    assert len(clean - set(fourth)) <= 2  # windows that differ in a word or two

    frame = spark.createDataFrame(list(fourth.values()), docs.schema)
    coder = WordEncoder(default_path())
    last = pipeline.packed_sequences(spark, frame, FOLDER).collect()
    assert sum(r.length for r in last) == sum(len(coder.ids(r.text)) // 4 + 1 for r in fourth.values())
    assert {r.doc_id for r in last} == set(fourth)

def test_run_and_columns(spark):
    docs = table(spark, FOLDER, "documents")
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "near duplicates", "repeated passages", "benchmark decontamination", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), FOLDER).columns == docs.columns, name
    found = pipeline.run(spark, FOLDER)
    assert found.columns == packing.best_fit(docs).columns and found.count() > 50

def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0

def test_sql(spark):
    connection = connect(FOLDER)

    for name, sql in ORACLES.items():
        good, note = compare(QUERIES[name](spark, FOLDER), connection, sql)
        assert good, (name, note)
