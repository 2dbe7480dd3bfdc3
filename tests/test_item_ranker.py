"""The trained item ranking against token overlap, on questions it has not seen."""

import math
from types import SimpleNamespace

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from sqlloom.operators import item_ranker as L
from sqlloom.operators import schema_filter as S
from sqlloom.plans import registry


#: Held out by a hash, since the derived responses repeat with the question id.
HELD_OUT = "pmod(xxhash64(question_id + 7), 2) = 1"


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    i = registry.inputs(spark, sf_dir)
    catalog = spark.createDataFrame(i.catalog.collect(), i.catalog.schema)
    return i.questions, catalog, i.links_by_db


@pytest.fixture(scope="module")
def ranker(made):
    questions, catalog, links = made
    return L.fit_ranker(questions, catalog, links.where(f"NOT {HELD_OUT}"), n_questions=150)


def test_recall_is_above_overlap(made, ranker):
    questions, catalog, links = made
    held_out = questions.where(HELD_OUT)
    kept = links.where(HELD_OUT)

    def recall(cut):
        return L.recall_at(cut, kept, catalog).first()

    learned, overlap = L.ranked_items(held_out, catalog, ranker), S.scored_items(held_out, catalog)
    found = {}
    for name, cut in {
        "ten of all": L.best_columns, "one table": lambda s: S.top_k_columns(s, 1, 2), "two tables": lambda s: S.top_k_columns(s, 2, 3),
    }.items():
        found[name] = recall(cut(learned)), recall(cut(overlap))
    assert all(a["n_linked"] == b["n_linked"] > 0 and a["recall"] > b["recall"] for a, b in found.values()), found


def test_scores_are_the_model(spark, made, ranker):
    """Against the sum over features worked out row by row."""
    questions, catalog, _ = made
    few = questions.where("question_id < 12")
    features = {r["question_id"]: r["items"] for r in L._with_features(few, catalog, len(ranker.tokens)).collect()}
    scored = {r["question_id"]: r["items"] for r in L.ranked_items(few, catalog, ranker).collect()}
    assert features.keys() == scored.keys() and scored

    def chance(i):
        z = ranker.intercept + sum(w * x for w, x in zip(ranker.numbers, i["x"], strict=True)) + sum(ranker.tokens[p] for p in i["h"])
        return 1 / (1 + math.exp(-z))

    for q, items in features.items():
        for t, s in zip(items, scored[q], strict=True):
            assert s["score"] == pytest.approx(chance(t), abs=1e-6)
            assert [c["score"] for c in s["columns"]] == pytest.approx([chance(c) for c in t["columns"]], abs=1e-6)


def test_questions_are_not_shuffled_by_item(spark, made, ranker):
    catalog = made[1]
    questions = spark.createDataFrame([(1, "db_1", "List c_name")], "question_id long, db_id string, question string")
    plan = S.top_k_columns(L.ranked_items(questions, catalog, ranker))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(db_id")
    assert "Python" not in plan


def test_sample_is_bounded_and_known_by_id(made):
    questions, catalog, links = made
    def items(ls, n):
        return L.training_rows(questions, catalog, ls, n, 8).groupBy("label", "features").count()

    assert items(links, 5).exceptAll(items(links.orderBy(F.desc("question_id")), 5)).count() == 0
    assert L.training_rows(questions, catalog, links, 5, 8).count() < L.training_rows(questions, catalog, links, 10, 8).count()


def test_nothing_to_learn(spark, made):
    questions, catalog, links = made
    empty = L.fit_ranker(questions, catalog, links.where("false"))
    assert empty.intercept == 0 and set(empty.numbers) == set(empty.tokens) == {0.0}
    scored = L.ranked_items(questions.where("question_id = 1"), catalog, empty).first()
    assert {t["score"] for t in scored["items"]} == {0.5}
    assert L.ranked_items(questions.where("false"), catalog, empty).count() == 0
    assert L.recall_at(S.top_k_columns(S.scored_items(questions, catalog)), links.where("false"), catalog).first()["recall"] is None


def test_nulls_ties_and_odd_records(spark):
    schema = """db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>,
                primary_keys array<int>, foreign_keys array<array<int>>"""
    catalog = spark.createDataFrame([
        ("d", ["a", None], [["-1", "*"], ["0", "id"], ["0", "id"], ["1", None]], ["text", None], None, None),
        ("e", [], [], [], [], [])], schema)
    questions = spark.createDataFrame([(1, "d", None), (2, "e", "id"), (3, None, "id"), (None, "d", "id")], "question_id long, db_id string, question string")
    links = spark.createDataFrame([(1, "d", "[a.id]"), (2, "e", None), (3, None, "[a.id]")], "question_id long, db_id string, schema_links string")
    ranker = L.fit_ranker(questions, catalog, links, n_tokens=8)
    got = {r["question_id"]: r["items"] for r in L.ranked_items(questions, catalog, ranker).collect()}
    assert got.keys() == {1, 2, None} and got[2] == []
    first = got[1][0]["columns"]
    assert [c["column_name"] for c in first] == ["id", "id"] and all(0 < c["score"] < 1 for c in first)
    assert 0 < got[1][1]["columns"][0]["score"] < 1


def asked_of_one_table(spark, n, links_x):
    """n questions of a table with columns x and y; ``links_x`` says of which ids x is linked, of the others y is."""
    catalog = spark.createDataFrame(
        [("d", ["t"], [["-1", "*"], ["0", "x"], ["0", "y"]], ["text", "text", "text"], [], [])],
        """db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>,
           primary_keys array<int>, foreign_keys array<array<int>>""")
    questions = spark.range(n).selectExpr("id AS question_id", "'d' AS db_id", "'What is asked?' AS question")
    links = questions.select("question_id", "db_id", F.expr(f"if({links_x}, '[t.x]', '[t.y]')").alias("schema_links"))
    return SimpleNamespace(questions=questions, catalog=catalog, links_by_db=links)


def test_links_of_all_questions_teach(spark):
    """Of 2,500 questions, those 2,000 of smallest hash link one column, the others the other one."""
    first = [r[0] for r in spark.range(2500).orderBy(F.xxhash64("id"), "id").limit(2000).collect()]
    i = asked_of_one_table(spark, 2500, f"question_id IN ({', '.join(map(str, first))})")
    ranker = L.fit_ranker(i.questions, i.catalog, i.links_by_db)
    found = L.best_columns(L.ranked_items(i.questions.where("question_id = 1"), i.catalog, ranker)).collect()
    assert {r["column_name"]: r["score"] for r in found} == {"x": pytest.approx(0.8, abs=0.01), "y": pytest.approx(0.2, abs=0.01)}


def test_registered_query_learns_from_both_halves(spark):
    i = asked_of_one_table(spark, 400, "pmod(xxhash64(question_id + 7), 2) = 0")
    share = i.links_by_db.where("schema_links = '[t.x]'").count() / 400
    found = registry.ranked_columns(i).groupBy("column_name").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
    for r in found.collect():
        assert r["n"] == 400 and r["low"] == r["high"] == pytest.approx(share if r["column_name"] == "x" else 1 - share, abs=0.01)


def test_counted_rows_are_fitted_as_single_ones(made, monkeypatch):
    questions, catalog, links = made
    rows = L.training_rows(questions, catalog, links, n_tokens=8).cache()
    plain = LogisticRegression(regParam=1e-4, maxIter=50).fit(rows)
    ranker = L.fit_ranker(questions, catalog, links, n_tokens=8)
    assert [*ranker.numbers, *ranker.tokens, ranker.intercept] == pytest.approx([*plain.coefficients, plain.intercept], abs=1e-6)
    assert rows.count() > 1000 and rows.distinct().count() * 2 < rows.count()
    monkeypatch.setattr(L, "PIECES", rows.count() // 3)  # pieces of weight three and less
    heavier = L.fit_ranker(questions, catalog, links, n_tokens=8)
    few = questions.where("question_id < 12")

    def scores(fitted):
        found = L.best_columns(L.ranked_items(few, catalog, fitted), 1000).collect()
        return {(r["question_id"], r["table_name"], r["column_name"]): r["score"] for r in found}

    assert scores(heavier) == pytest.approx(scores(ranker), abs=0.01)
    rows.unpersist()
