"""What keeps work in proportion to the tables, and what must not depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import similarity, spans, titles
from quillspark.operators import aggregates


def test_borders_of_percentiles_are_drawn_once(spark, capsys):
    rows = spark.range(5000).selectExpr("id % 3 as k", "(id * 7919) % 1000 as v")
    out = aggregates.nearest_rank(rows, "v", {"p50": 0.5, "p95": 0.95}, ["k"])
    out.explain(True)
    assert "percentile_approx" not in capsys.readouterr().out
    want = rows.groupBy("k").agg(F.expr("percentile_disc(0.5) within group (order by v)").alias("p50"))
    assert {(r["k"], r["p50"]) for r in out.collect()} == {(r["k"], r["p50"]) for r in want.collect()}


def test_values_are_worked_out_once_within_lambdas():
    text = F.col("x")
    assert str(titles.query_set(text)).count("regexp_replace") == 1
    assert str(similarity.bigrams(text)).count("regexp_replace") == 1
    assert str(spans.detect(text)).count("regexp_replace") == 1
    assert str(spans.detect_spans(F.col("files"), F.col("said"))).count("said") == 1


def test_costly_expressions_are_dealt_over_all_tasks(spark, sf_dir):
    from quillspark.plans.registry import QUERIES

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("title_dice", "title_spans", "cleaned_titles", "search_query_set", "capped_query_sets", "file_spans", "listing_rows", "detail_pages"):
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == parts, name


def _titles(spark):
    names = ["cold widget", "widget cold", "Cold  Widget!", "cold widgets", "small ring", "", None]
    return spark.createDataFrame([(i, names[i % len(names)]) for i in range(70)], "id long, title string")


def test_all_copies_are_candidates(spark):
    from quillspark.operators import search

    rows = _titles(spark)
    asked = spark.createDataFrame([(1, "widget cold"), (2, "cold"), (3, "cold cold"), (4, "no such"), (5, "")], "query_id long, text string")
    got = sorted(map(tuple, search.candidate_pairs(asked, rows, "id", "title").collect()))
    assert got == sorted(map(tuple, search.candidates(asked, search.token_index(rows, "id", "title")).collect()))
    assert len(got) == 30 + 40 + 40


def test_all_copies_are_similar_pairs(spark, sf_dir):
    from quillspark.operators import joins
    from quillspark.plans.registry import QUERIES

    rows = _titles(spark)
    got = sorted(map(tuple, joins.similar_title_rows(rows.where("id % 20 = 0"), rows, 0.8).collect()))
    cross = rows.where("id % 20 = 0").selectExpr("id as left_id", "coalesce(title, '') as a").crossJoin(rows.selectExpr("id as right_id", "coalesce(title, '') as b"))
    want = cross.select("left_id", "right_id", similarity.dice(F.col("a"), F.col("b")).alias("score")).where("score >= cast(0.8 as float)")
    assert got == sorted(map(tuple, want.collect()))
    assert QUERIES["similar_title_pairs"](spark, sf_dir).columns == ["left_id", "right_id", "score"]


def test_pairs_of_many_copies_take_little_disk(spark, tmp_path):
    from quillspark.operators import search

    pairs = spark.createDataFrame([("a", "b", 0.9)], "left_class string, right_class string, score double")
    left = spark.range(40).selectExpr("id * 20 as left_id", "'a' as left_class")
    right = spark.range(100000).selectExpr("id as right_id", "'b' as right_class")
    search.expanded(pairs, left, right, "left_id", "right_id").write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 40 * 100000
    assert sum(f.stat().st_size for f in files) < 40 * 100000 * 0.6


def test_members_of_blocks_are_all_paired(spark, monkeypatch):
    from quillspark.operators import search

    monkeypatch.setattr(search, "STRIP", 20, raising=False)
    monkeypatch.setattr(search, "BLOCK", 3, raising=False)
    pairs = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (2, 2, 1.0), (3, 1, 0.1), (1, 3, 0.1)], "left_class long, right_class long, score double")
    left = spark.createDataFrame([(i, 1 + i % 2) for i in range(50)] + [(None, 1), (4, 1), (4, 1)], "query_id long, left_class long")
    right = spark.createDataFrame([(str(i), 1 + i % 2) for i in range(70)] + [(None, 2), ("7", 2), ("x", None)], "id string, right_class long")
    got = search.expanded(pairs, left, right, "query_id", "id")
    want = pairs.join(left, "left_class").join(right, "right_class").select("query_id", "id", "score")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.columns == ["query_id", "id", "score"]


def test_first_records_of_a_title_answer(spark):
    from quillspark.operators import misses

    dump = _titles(spark).selectExpr("cast(id as string) as id", "title").where("title is not null")
    asked = spark.createDataFrame([(1, "widget cold"), (2, "widget cold"), (3, "ring")], "query_id long, text string")
    got = misses.titled_hits(asked, dump, 3)
    assert {r["query_id"]: [] for r in got.collect()}.keys() == {1, 2, 3}
    both = dump.crossJoin(asked).where("(query_id < 3 and lower(title) like '%cold%' and lower(title) not like '%widgets%') or (query_id = 3 and title = 'small ring')")
    ranked = both.select("query_id", "id", similarity.dice(F.col("text"), F.col("title")).alias("score")).selectExpr("*", "row_number() over (partition by query_id order by score desc, id) as rank").where("rank <= 3")
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == sorted(map(tuple, ranked.collect()))


def test_what_was_settled_is_not_sent_through_the_driver(spark, capsys):
    from quillspark.operators.lineage import settled

    rows = settled(spark.range(100).selectExpr("id", "id * 2 as double"))
    rows.where("id > 3").join(spark.range(50).hint("broadcast").withColumnRenamed("id", "other"), F.col("double") == F.col("other")).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out
    rows.where("id > 3").join(spark.range(50), "id").explain()
    assert "SortMergeJoin" in capsys.readouterr().out


def test_places_are_gathered_within_a_row(spark):
    from quillspark.operators import text_index

    rows = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), (["x"],), ([],)], "words array<string>")
    got = [{p["token"]: list(p["places"]) for p in r["p"] or []} for r in rows.select(text_index.places_of(F.col("words")).alias("p")).collect()]
    assert got == [{"a": [1, 4], "b": [0, 2, 5], "c": [3]}, {"x": [0]}, {}]


def test_narrow_rows_are_dealt_before_they_are_distinct(spark, sf_dir, capsys):
    from quillspark.plans.registry import QUERIES
    from quillspark.plans.views import VIEWS, spark_view

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, table in (("release_sources", "lineitem"), ("series_genres", "part")):
        rows = spark_view(spark, sf_dir, name)
        assert rows.rdd.getNumPartitions() == parts, name
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, spark.sql(VIEWS[name]).collect()))
    assert QUERIES["bridge_insert_ignore"](spark, sf_dir).rdd.getNumPartitions() == parts
    QUERIES["source_facet"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(release_id") >= 3 and plan.count("REPARTITION_BY_NUM") == 3 and "BroadcastHashJoin" not in plan
