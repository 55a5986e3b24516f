from __future__ import annotations

from itertools import combinations

import duckdb
import sentencepiece

from quillspark.llm import mixing, queries
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import plain_simhash
from tests.oracle import connect, spark_rows, sql_rows


def test_native_queries_equal_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in queries.ORACLE.items():
        assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(con, sql), name


def test_stages_one_by_one(spark, sf_dir, docs, tmp_path, sets):
    import corpus_pipeline

    from tests.llm.conftest import Sets

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "encode"]
    model, now, ids = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model()), docs, [set(r[0] for r in docs.select("doc_id").collect())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r[0] for r in now.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and now.count() == len(ids[-1])
        if k < 4:
            assert now.columns == docs.columns
    letters = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert ids[1] == letters
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    # each stage against brute force on its own input
    read = lambda k: sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/{k}").select("doc_id", "text").collect())
    given, kept = read(0), dict(read(1))
    gone = brute_lines(given, sets)
    lost = 0
    for i, text in given:
        rest = [(n, line) for n, line in enumerate(text.split("\n"))]
        want = "\n".join(line for n, line in rest if (i, n) not in gone)
        if kept.get(i, "") != want:  # a pair that the signature missed leaves more lines, never fewer
            lost += 1
            left = kept[i].split("\n")
            assert [line for n, line in rest if (i, n) not in gone or line in left] == left
    assert lost <= 0.02 * len(gone)
    prints, groups = {i: plain_simhash(t) for i, t in read(1)}, Sets()
    for (i, a), (j, b) in combinations(sorted(prints.items()), 2):
        if (a ^ b).bit_count() <= 4:
            groups.join(i, j)
    assert [i for i, _ in read(2)] == sorted(i for i in prints if groups.root(i) == i)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    chosen = con.execute(mixing.mix_sql(queries.WEIGHTS, str(corpus_pipeline.TOKEN_SHARE), 1, 42)).fetchall()
    assert [i for i, _ in read(3)] == sorted(r[0] for r in chosen)
    rows = now.collect()
    assert {r["doc_id"]: r["piece_ids"] for r in rows} == {i: model.encode(t or "") for i, t in texts.items()}
    assert all(r["n_tokens"] == len(r["piece_ids"]) for r in rows)


def test_odd_documents_and_an_empty_table(spark, odd_docs, no_docs, sf_dir, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or now.columns == docs.columns
        ids = sorted(str(r["doc_id"]) for r in now.collect())
        assert ids == ([] if name == "none" else sorted(set(ids))) and set(ids) <= {"4", "6", "None"}


def test_clashing_names_stay(spark, odd_docs, sf_dir, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    names = ["_id", "_said", "_gone", "gone", "_null", "row", "id", "said", "lost", "kept", "fp", "node", "language_id", "a.b"]
    now = odd_docs.withColumns({c: F.lit(c) for c in names})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = now.columns
        stage(spark, now, sf_dir).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        assert all(r[c] == c for r in now.collect() for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).count() == now.count() > 0


def test_each_stage_runs_once_and_leaves_nothing_behind(spark, sf_dir, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from quillspark.llm import graph

    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        asked.add(1)
        return text

    first = corpus_pipeline.STAGES[0][1]

    def counting(spark, docs, sf_dir):
        return first(spark, docs, sf_dir).withColumn("text", counted.asNondeterministic()("text"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("language_id", counting), *corpus_pipeline.STAGES[1:]])
    before = graph.written_so_far()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
    assert asked.value == first(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count()
    left = graph.written_so_far() - before
    assert len(left) == 1 and graph.drop_written(spark, left) == 1


def test_stages_bound_what_a_task_holds(spark, docs, sf_dir):
    import corpus_pipeline

    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": corpus_pipeline.BATCH_ROWS, "spark.sql.parquet.columnarReaderBatchSize": corpus_pipeline.READ_ROWS}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for _, stage in corpus_pipeline.STAGES:
            for k in bounds:
                spark.conf.set(k, 4096)
            stage(spark, docs.limit(20), sf_dir)
            assert {k: int(spark.conf.get(k)) for k in bounds} == bounds
        smaller = {k: str(most - 1) for k, most in bounds.items()}
        for k, v in smaller.items():
            spark.conf.set(k, v)
        corpus_pipeline.encode(spark, docs.limit(20), sf_dir)
        assert {k: spark.conf.get(k) for k in bounds} == smaller
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
