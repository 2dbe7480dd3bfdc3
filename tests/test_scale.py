"""Plans and skew: what must hold for tables that do not fit one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sqlloom import schemas
from sqlloom.functions import ranking
from sqlloom.functions.ranking import number_rows
from sqlloom.functions.relational import join_catalog
from sqlloom.operators import catalog as C
from sqlloom.operators import evaluate as E
from sqlloom.operators import extract as R
from sqlloom.operators import item_ranker as L
from sqlloom.operators import prompts as P
from sqlloom.operators import schema_filter as S
from sqlloom.plans import fixtures as X
from sqlloom.plans import registry

# a write-and-read-back query shows the plan of its reader only
LAZY = [n for n in registry.OPERATORS if not n.startswith(("read_", "write_", "commit_", "stream_", "progress_by_batch"))]
SORTED = {"w_sort_asc", "w_join3_sorted"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("name", [n for n in LAZY if n not in SORTED])
def test_window_without_key_sees_limited_rows_only(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    if re.search(r"Window \[row_number\(\) windowspecdefinition\(\w+#\d+L? (ASC|DESC)", text):
        assert "TakeOrderedAndProject" in text


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cat") / "c")
    registry.inputs(spark, sf_dir).catalog.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("f", [
    C.catalog_columns, C.catalog_primary_keys, C.catalog_foreign_keys, C.catalog_by_db,
    C.serialize_fields, C.serialize_primary_keys, C.serialize_foreign_keys, C.schema_texts,
    C.serialize_typed_schema, C.serialize_linking_schema, S._weighted_items,
])
def test_catalog_work_needs_no_shuffle(stored, f):
    assert "Exchange" not in plan(f(stored))


def test_rejects_shuffle_counted_identifiers_only(stored):
    text = plan(C.catalog_rejects(stored))
    assert text.count("Exchange") == 1
    assert "partial_count(1)" in text.split("Exchange")[1]


def test_question_tables_partitioned_alike_are_not_shuffled_again(spark, sf_dir):
    i = registry.inputs(spark, sf_dir)
    text = plan(R.class_agreement(i.labels, i.questions))
    assert "SortMergeJoin" in text
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(question_id" in text
    assert len(re.findall(r"hashpartitioning\(question_id#\d+L, \d+\), ENSURE", text)) == 0


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(registry.queries()["w_filter_gt"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,25)]" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_size:int>" in text


def test_external_top_k_is_cut_before_the_shuffle(spark, sf_dir, tmp_path):
    registry.inputs(spark, sf_dir).item_scores.write.parquet(str(tmp_path / "s"))
    text = plan(S.external_top_tables(spark.read.parquet(str(tmp_path / "s")), 3))
    assert re.search(r"WindowGroupLimit .* Final\n.*\n.*Exchange hashpartitioning\(question_id.*\n\s*\+- WindowGroupLimit .* Partial", text)


def test_numbering_with_a_hot_value(spark):
    random.seed(7)
    data = [(5 if random.random() < 0.4 else random.randint(0, 50), i) for i in range(4000)]
    df = spark.createDataFrame(data, "v int, id long").repartition(7)
    got = number_rows(df, ["v", "id"], "n").collect()
    assert [(r["n"], r["v"], r["id"]) for r in got] == [(n, *vi) for n, vi in enumerate(sorted(data), 1)]


def test_numbering_works_its_input_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000, numPartitions=5).selectExpr("(id * 7919) % 3000 AS v", "id").mapInArrow(count, "v long, id long")
    got = number_rows(df, ["v"], "n")
    assert [r["n"] for r in got.collect()] == [r["v"] + 1 for r in got.collect()] == list(range(1, 3001))
    assert seen.value == 3000


def test_numbering_of_nothing(spark):
    assert number_rows(spark.createDataFrame([], "v int"), ["v"], "n").collect() == []


def test_numbering_of_mixed_keys(spark):
    data = [(None if i % 9 == 0 else f"k{i % 5}", float("nan") if i % 7 == 0 else i / 3, i) for i in range(3000)]
    df = spark.createDataFrame(data, "s string, d double, id long").repartition(5)
    got = number_rows(df, ["s", "d", "id"], "n")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1] != r[1], 0 if r[1] != r[1] else r[1], r[2]))
    assert [r["id"] for r in got.collect()] == [r[2] for r in order]
    assert [r["n"] for r in got.collect()] == list(range(1, 3001))


@pytest.fixture
def skewed(spark):
    """Questions of which a third belong to one database."""
    return spark.range(3000).select(
        F.col("id").alias("question_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("db"), (F.col("id") % 40).cast("string"))).alias("db_id"),
        F.lit("count song name").alias("question"))


def test_catalog_joins_give_equal_rows_either_way(spark, skewed):
    texts = spark.range(40).select(F.concat(F.lit("db"), "id").alias("db_id"), F.col("id").alias("n"))
    merged, sent = join_catalog(skewed, texts), join_catalog(skewed, texts, broadcast=True)
    assert "SortMergeJoin" in plan(merged) and "BroadcastHashJoin" in plan(sent)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, sent.collect()))


def test_year_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list of filters is cut
    try:
        for name in ("w_join_distinct_or", "w_join_filter", "w_never"):
            text = plan(registry.queries()[name](spark, sf_dir))
            assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(\w+date.*LessThan\(\w+date", text), name
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_hot_database(spark, skewed):
    catalog = spark.createDataFrame(
        [(d, ["song"], [["-1", "*"], ["0", "name"]], ["text", "text"], [1], []) for d in ["hot"] + [f"db{i}" for i in range(40)]],
        schemas.RAW_CATALOG)
    links = skewed.withColumn("schema_links", F.lit("[song.name, song.gone]"))
    for confs in ({}, {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
                       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB"}):
        for k, v in confs.items():
            spark.conf.set(k, v)
        try:
            assert R.validate_schema_links(links, catalog).where("valid_links = '[song.name]'").count() == 3000
            assert S.top_k_columns(S.scored_items(skewed, catalog)).count() == 3000
            usage = {(r["db_id"], r["level"], r["column_name"]): r["n_links"] for r in R.schema_link_usage(links).collect()}
            assert usage["hot", "table", None] == 2000 and usage["hot", "column", "name"] == 1000
        finally:
            for k in confs:
                spark.conf.unset(k)


def test_hot_query_result(spark):
    gold = spark.range(9000).select((F.col("id") % 3 * 0 + 1).alias("query_id"), F.lit("gold").alias("side"),
                                    (F.col("id") % 10).cast("string").alias("row_json"))
    pred = gold.withColumn("side", F.lit("pred"))
    ran = spark.range(1, 2).select(F.col("id").alias("query_id"))
    assert E.execution_match(gold.union(pred), ran).first()["matches"]
    assert E.execution_match(gold.union(pred.limit(8999)), ran).first()["n_missing"] == 1


def test_best_beam_needs_no_window(spark):
    df = spark.createDataFrame([(1, b, f"o{b}") for b in (3, 1, 2)] + [(2, 0, "x")], "question_id long, beam int, output string")
    got = R.best_beam(df)
    assert "Window" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "o1"), (2, 0, "x")]


def test_outside_scores_against_brute_force(spark):
    random.seed(3)
    data = [(q, t, f"t{t}", None if c < 0 else c, None if c < 0 else f"c{c}", random.randint(0, 4) / 4)
            for q in range(30) for t in range(random.randint(1, 9)) for c in range(-1, random.randint(1, 15))]
    df = spark.createDataFrame(data, "question_id long, tab_idx int, table_name string, col_idx int, column_name string, score double")
    kept, expected = {}, set()
    for q in range(30):
        tables = sorted([(-d[5], d[1]) for d in data if d[0] == q and d[4] is None])[:6]
        kept[q] = {t: n for n, (_, t) in enumerate(tables, 1)}
    for q, tables in kept.items():
        for t, n in tables.items():
            columns = sorted([(-d[5], d[3], d[4]) for d in data if d[0] == q and d[1] == t and d[4] is not None])[:10]
            expected |= {(q, n, f"t{t}", m, c, -s) for m, (s, _, c) in enumerate(columns, 1)}
    assert {tuple(r) for r in S.external_top_columns(df).collect()} == expected


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_TASK", 100)
    for rows, tasks in ((10, spark.sparkContext.defaultParallelism), (2950, 30)):
        df = spark.range(0, rows, 1, 40)  # many splits, as a file of few row groups may have
        got = X.spread(df, "id")
        assert got.rdd.getNumPartitions() == tasks and got.count() == rows


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 100)
    got = number_rows(spark.range(2000).selectExpr("id * 7 % 2000 AS v"), ["v"], "n")
    assert "rangepartitioning(_part" in plan(got) and re.search(r"rangepartitioning\(_part#\d+ ASC NULLS FIRST, 20\)", plan(got))
    assert all(r["n"] == r["v"] + 1 for r in got.collect())


def test_training_works_out_features_of_its_sample_only(spark, sf_dir):
    i = registry.inputs(spark, sf_dir)
    rows = L.training_rows(i.questions, i.catalog, i.links_by_db, n_questions=5)
    assert "LeftSemi" in plan(rows)
    assert rows.select("features").count() > 5
