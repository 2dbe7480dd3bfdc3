"""Hand-made cases for the rules a registered query alone would not show."""

import json
import random
import time
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sqlloom import schemas
from sqlloom.functions.relational import not_in
from sqlloom.functions.text import SQL_KEYWORDS, collapse, normalise_sql, strip, upper_keywords
from sqlloom.operators import catalog as C
from sqlloom.operators import evaluate as E
from sqlloom.operators import extract as R
from sqlloom.operators import prompts as P
from sqlloom.operators import schema_filter as S
from sqlloom.operators import training as D


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, text, f):
    """Value of a column expression on one text."""
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame([
        ("shop", ["zebra", "ant"],
         [["-1", "*"], ["0", "id"], ["0", "part"], ["1", "id"], ["1", "zebra_id"], ["7", "lost"]],
         ["text", "number", "text", "number", "number", "text"],
         [1, 2, 3, 0, 50], [[4, 1], [0, 1], [4, 99], [4]]),
        ("bare", ["only"], [["-1", "*"], ["0", "a"]], ["text", "text"], [], []),
        ("empty", [], [["-1", "*"]], ["text"], [], []),
    ], schemas.RAW_CATALOG)


# --- catalog

def test_star_once_per_table_and_bad_table_index_left_out(shop):
    got = rows(C.catalog_columns(shop).where("db_id = 'shop'").orderBy("tab_idx", "col_idx").select(
        "table_name", "column_name", "column_type"))
    assert got == [("zebra", "*", "text"), ("zebra", "id", "number"), ("zebra", "part", "text"),
                   ("ant", "*", "text"), ("ant", "id", "number"), ("ant", "zebra_id", "number")]


def test_column_without_type_is_dropped_but_keys_still_find_it(spark):
    df = spark.createDataFrame([("d", ["t"], [["0", "a"], ["0", "b"]], ["text"], [1], [])], schemas.RAW_CATALOG)
    assert rows(C.catalog_columns(df).select("column_name")) == [("a",)]
    assert rows(C.catalog_primary_keys(df).select("column_name")) == [("b",)]
    assert ("column", "b", "no type") in rows(C.catalog_rejects(df).select("item", "detail", "reason"))


def test_composite_key_flat_keeps_all_map_keeps_last(shop):
    assert rows(C.catalog_primary_keys(shop).select("table_name", "column_name")) == [
        ("zebra", "id"), ("zebra", "part"), ("ant", "id")]
    by_db = C.catalog_by_db(shop).where("db_id = 'shop'").first()
    assert by_db["primary_keys"] == {"zebra": "part", "ant": "id"}
    assert by_db["tables"] == {"zebra": ["id", "part"], "ant": ["id", "zebra_id"]}
    assert [tuple(k) for k in by_db["foreign_keys"]] == [("ant.zebra_id", "zebra.id")]


def test_repeated_table_name_keeps_last_definition(spark):
    df = spark.createDataFrame(
        [("d", ["t", "u", "t"], [["0", "a"], ["1", "b"], ["2", "c"]], ["text"] * 3, [0, 2], [])], schemas.RAW_CATALOG)
    got = C.catalog_by_db(df).first()
    assert got["tables"] == {"t": ["c"], "u": ["b"]}
    assert got["primary_keys"] == {"t": "c"}
    assert C.serialize_fields(df).first()["fields"] == "Table t, columns = [a,c]\nTable u, columns = [b]\n"


def test_rejects_balance(shop):
    got = sorted(rows(C.catalog_rejects(shop).select("db_id", "item", "detail", "reason")))
    assert got == [
        ("shop", "column", "lost", "bad table index"),
        ("shop", "foreign_key", "0,1", "star column"),
        ("shop", "foreign_key", "4", "not a pair"),
        ("shop", "foreign_key", "4,99", "index out of range"),
        ("shop", "primary_key", "0", "star column"),
        ("shop", "primary_key", "50", "index out of range"),
    ]
    keys = shop.agg(F.sum(F.size("primary_keys")), F.sum(F.size("foreign_keys"))).first()
    rejected = [r[1] for r in got]
    assert keys[0] == C.catalog_primary_keys(shop).count() + rejected.count("primary_key")
    assert keys[1] == C.catalog_foreign_keys(shop).count() + rejected.count("foreign_key")


def test_incomplete_database_is_rejected(spark):
    df = spark.createDataFrame([("d", None, [["0", "a"]], ["text"], [0], None)], schemas.RAW_CATALOG)
    assert rows(C.catalog_rejects(df).select("item", "detail").where("item = 'database'")) == [
        ("database", "table_names_original,foreign_keys")]


def test_summary_warns(shop):
    got = {r["db_id"]: r for r in C.catalog_summary(shop).collect()}
    assert got["empty"]["no_columns"] and got["bare"]["no_primary_keys"] and got["bare"]["no_foreign_keys"]
    assert got[None]["n_databases"] == 3 and got[None]["n_columns"] == 5


def test_texts(shop):
    texts = {r["db_id"]: r for r in C.schema_texts(shop).collect()}
    assert texts["shop"]["fields"] == "Table ant, columns = [*,id,zebra_id]\nTable zebra, columns = [*,id,part]\n"
    assert texts["shop"]["primary_keys"] == "[zebra.id,zebra.part,ant.id]"
    assert texts["shop"]["foreign_keys"] == "[ant.zebra_id = zebra.id]"
    assert (texts["bare"]["primary_keys"], texts["bare"]["foreign_keys"]) == ("[]", "[]")
    assert texts["empty"]["fields"] == ""
    typed = {r["db_id"]: r["typed_schema"] for r in C.serialize_typed_schema(shop).collect()}
    assert typed["shop"] == (
        "table zebra , columns = [ zebra.id ( number | primary key ) , zebra.part ( text | primary key ) ]\n"
        "table ant , columns = [ ant.id ( number | primary key ) , ant.zebra_id ( number ) ]\n"
        "foreign keys :\nant.zebra_id = zebra.id")
    assert typed["bare"] == "table only , columns = [ only.a ( text ) ]\nforeign keys : None"
    linking = {r["db_id"]: r for r in C.serialize_linking_schema(shop).collect()}
    assert linking["shop"]["schema_text"] == (
        "Database Schema:\nTable zebra, columns = [id,part]\nTable ant, columns = [id,zebra_id]\n")
    assert linking["shop"]["fk_text"] == (
        "Foreign Keys:\n- ant.zebra_id = zebra.id\n\nForeign_keys = [ant.zebra_id = zebra.id]")
    assert linking["bare"]["fk_text"] == "No Foreign Keys\nForeign_keys = []"


def test_parse_fields_round_trip_and_rejects(spark, shop):
    parsed = C.parse_fields(C.serialize_fields(shop).where("db_id = 'shop'"))
    assert [tuple(r) for r in parsed.select("table_name", "column_names", "status").collect()] == [
        ("ant", ["id", "zebra_id"], "ok"), ("zebra", ["id", "part"], "ok")]
    odd = spark.createDataFrame([("d", "Table t2, columns = [*,a1]\nTable x, columns = [*]\nnoise\n")], "db_id string, fields string")
    assert rows(C.parse_fields(odd).select("table_pos", "table_name", "status")) == [
        (0, "t2", "ok"), (1, None, "reject"), (2, None, "reject")]


def test_parse_foreign_keys_round_trip_and_empty(spark, shop):
    got = rows(C.parse_foreign_keys(C.serialize_foreign_keys(shop)))
    assert got == [("shop", 0, "ant", "zebra_id", "zebra", "id")]


def test_filtered_schema_keeps_all_keys_unless_told(spark):
    df = spark.createDataFrame(
        [([("a", "about a", ["x", "y"], ["", ""])], "[a.x = b.z,a.y = a.x]")],
        "schema_items array<struct<table_name:string,table_comment:string,column_names:array<string>,"
        "column_comments:array<string>>>, foreign_keys string")
    head = "table a ( comment : about a ) , columns = [ a ( comment : about a ).x , a ( comment : about a ).y ]\n"
    assert C.serialize_filtered_schema(df).first()["filtered_schema"] == head + "foreign keys :\na.x = b.z\na.y = a.x"
    assert C.serialize_filtered_schema(df, kept_only=True).first()["filtered_schema"] == head + "foreign keys :\na.y = a.x"
    none = df.withColumn("foreign_keys", F.lit("[]"))
    assert C.serialize_filtered_schema(none).first()["filtered_schema"] == head + "foreign keys : None"


# --- text

def test_white_space_is_unicode_wide(spark):
    assert one(spark, "   a \x1c b\n", strip) == "a \x1c b"
    assert one(spark, "\x1f a   b\n\n", collapse) == "a b"


def test_keywords_whole_words_only(spark):
    assert one(spark, "select Count(x), éon from a where b = 'on' group by c", upper_keywords) == (
        "SELECT COUNT(x), éon FROM a WHERE b = 'ON' GROUP BY c")
    assert one(spark, "SELECT only, selection FROM t", upper_keywords) == "SELECT only, selection FROM t"
    assert one(spark, "SELECT a FROM t Group By a", upper_keywords) == "SELECT a FROM t GROUP BY a"
    assert one(spark, " select  a\nfrom t ; ", normalise_sql) == "SELECT a FROM t"


# --- responses

@pytest.mark.parametrize("text, links", [
    ("x\n  Schema Links: [a.b,c.d]\nSchema Links: [z.z]", "[a.b,c.d]"),
    ("**Schema Links:** [a.b]", "[]"),
    ("Schema Links: **[`a.b`, `c.d`]**", "[a.b, c.d]"),
    ("Schema Links: ['a.b', 'c']", "['a.b', 'c']"),
    ("Schema_links: [a.b]", "[]"),
    ("Schema Links:", "[]"),
    ("", "[]"),
    (None, "[]"),
])
def test_schema_links(spark, text, links):
    assert one(spark, text, R.schema_links) == links


def test_schema_links_lenient(spark):
    assert one(spark, "Schema_links: [a.b]", lambda c: R.schema_links(c, lenient=True)) == "[a.b]"


def test_links_quotes_values_and_two_equals(spark):
    df = spark.createDataFrame([(1, "['a.b', 'it', c.d=e.f, a.b = c.d = e.f, 2.5,, ]")], "question_id long, schema_links string")
    assert rows(R.explode_schema_links(df).select("pos", "link", "kind", "left_item", "right_item")) == [
        (0, "a.b", "column", "a.b", None), (1, "it", "value", None, None), (2, "c.d=e.f", "join", "c.d", "e.f"),
        (3, "a.b = c.d = e.f", "join", None, None), (4, "2.5", "column", "2.5", None)]


def test_validate_links(spark, shop):
    df = spark.createDataFrame(
        [(1, "shop", "[ant.id, 50, ant.*, Ant.id, zebra.id=ant.id, zebra.id = ant.id = ant.id, ant.id.x, ant.id = nope.id]"),
         (2, "unknown", "[ant.id]"), (3, "shop", "[]")],
        "question_id long, db_id string, schema_links string")
    got = {r["question_id"]: r["valid_links"] for r in R.validate_schema_links(df, shop).collect()}
    assert got == {1: "[ant.id, zebra.id = ant.id]", 2: "[]", 3: "[]"}


@pytest.mark.parametrize("text, label, norm", [
    ('a Label: "EASY" Label: "NESTED"', "EASY", "EASY"),
    ('Label: "easy"', "easy", "NESTED"),
    ('Label: ""', "", "NESTED"),
    ("Label: EASY", "NESTED", "NESTED"),
    ('Label: "OPEN', "OPEN", "NESTED"),
    ('Label: "a Label: "b"', "a ", "NESTED"),
])
def test_label(spark, text, label, norm):
    assert one(spark, text, R.label) == label
    assert one(spark, text, lambda c: R.norm_class(R.label(c))) == norm


@pytest.mark.parametrize("text, expected", [
    ("<REASONING>r</REASONING><SQL>a</SQL><chains> c\n d </chains>x<sql> select  1 </sql>", ("c d", "SELECT 1", "ok")),
    ("<CHAINS>c</CHAINS><SQL>a</SQL>", (None, None, "no_tags")),
    ("<chains>c <SQL>a</SQL> ", ("<chains>c <SQL>a</SQL>", "SELECT", "unclosed")),
    ("<SQL>early</SQL><chains>c</chains> <SQL>late</SQL><SQL>more</SQL>", ("c", "late", "ok")),
    ("<chains></chains><SQL></SQL>", ("", "", "ok")),
    ("<REASONING>a</REASONING><SQL>x</SQL> <chains>", ("<REASONING>a</REASONING><SQL>x</SQL> <chains>", "SELECT", "unclosed")),
    ("", (None, None, "no_tags")),
])
def test_reasoning_sql(spark, text, expected):
    assert tuple(one(spark, text, R.reasoning_sql)) == expected


def test_parsed_and_rejected_add_up(spark):
    from sqlloom.plans import fixtures as X

    parsed = R.extract_reasoning_sql(X.sql_responses(spark, "/root/testdata/sf0.001"))
    counts = {r["parse_status"]: r["count"] for r in parsed.groupBy("parse_status").count().collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {"ok", "unclosed", "no_tags"}


def test_steps_of_any_number_and_title(spark):
    df = spark.createDataFrame(
        [(1, "1. Grouping Structure: by a 10. Ordering: b: c 11. plain 2.5 text"), (2, "none"), (3, None)],
        "question_id long, reasoning string")
    assert rows(R.reasoning_steps(df)) == [
        (1, 0, 1, "Grouping Structure", "by a"), (1, 1, 10, "Ordering", "b: c"), (1, 2, 11, None, "plain 2.5 text")]


def test_nth_block_and_marker(spark):
    df = spark.createDataFrame(
        [(1, "<SQL>a</SQL><SQL>b</SQL><SQL>\n c \n</SQL>"), (2, "<SQL>a</SQL>"), (3, "<sql>a</sql>" * 3)],
        "question_id long, output string")
    assert rows(R.nth_sql_block(df)) == [(1, "c"), (2, None), (3, None)]
    assert rows(R.nth_sql_block(df, 1))[1] == (2, "a")
    marked = spark.createDataFrame([(1, "[SQL] x [SQL]\nselect\n1[/SQL]"), (2, "plain [x")], "question_id long, output string")
    assert rows(R.after_sql_marker(marked)) == [(1, "select 1"), (2, "plain")]


def test_blocks_with_stray_tags(spark):
    df = spark.createDataFrame(
        [(1, "</SQL>x<SQL>a<SQL>b</SQL></SQL><SQL></SQL><SQL>c\n</SQL><SQL>open"), (2, None)], "question_id long, output string")
    assert [rows(R.nth_sql_block(df, n))[0][1] for n in (1, 2, 3, 4)] == ["a<SQL>b", "", "c", None]
    assert rows(R.nth_sql_block(df))[1] == (2, None)


def test_very_long_texts_take_linear_time(spark):
    tags = F.repeat(F.lit("x <SQL> </chain>\n"), 100_000)
    blanks = F.repeat(F.lit(" \n"), 50_000)
    df = spark.range(1).select(F.col("id").alias("question_id"), F.concat(
        F.lit("<chains>"), tags, F.lit("</chains>"), blanks, F.lit("<SQL> a\n"), blanks, F.lit("Schema Links: [a.b]")).alias("response"))
    assert R.extract_reasoning_sql(df).first()["parse_status"] == "unclosed"
    assert R.extract_schema_links(df).first()["schema_links"] == "[a.b]"
    assert R.nth_sql_block(df.withColumnRenamed("response", "output"), 1).first()["model_predicted_sql"] is None
    assert R.after_sql_marker(df.withColumnRenamed("response", "output")).first()["generated_sql"].startswith("<chains>")
    spaced = df.select(F.length(strip(F.concat(F.lit("a"), blanks, F.lit("b"), blanks))).alias("n"))
    assert spaced.first()["n"] == 100_002


def test_sql_class_ignores_literals(spark):
    cases = {"SELECT 'a JOIN b' FROM t": "EASY", "select a from b join c on x": "NON-NESTED",
             "SELECT a FROM t WHERE b IN ( SELECT c FROM d)": "NESTED", "SELECT 1 union SELECT 2": "NESTED"}
    assert {sql: one(spark, sql, R.sql_class) for sql in cases} == cases


# --- prompts

def test_inference_prompt_defaults(spark):
    df = spark.createDataFrame([(1, None)], "question_id long, question string")
    text = P.inference_prompt(df).first()["prompt"]
    assert "No question provided" in text and "No schema provided" in text


def test_completions_last_attempt_of_three(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "question_id long, prompt string")
    done = P.with_prompt_hash(prompts.where("question_id = 1")).select("prompt_hash").join(
        spark.createDataFrame([(a, "ok", f"c{a}") for a in (1, 2, 3, 4)], "attempt int, status string, completion string"),
        how="cross")
    assert sorted(rows(P.join_completions(prompts, done).select("question_id", "n_attempts", "completion"))) == [
        (1, 3, "c3"), (2, 3, "c3"), (3, None, None)]
    assert rows(P.pending_prompts(prompts, done).select("question_id")) == [(3,)]


# --- schema filter

def test_scores_and_cut(spark):
    catalog = spark.createDataFrame(
        [("d", ["song", "singer", "___"], [["-1", "*"], ["0", "song_name"], ["0", "year"], ["1", "singer_name"], ["2", "x"]],
          ["text"] * 5, [], [])], schemas.RAW_CATALOG)
    asked = spark.createDataFrame([(1, "d", "Which song has a singer? The NAME of the song."), (2, "d", "?")],
                                  "question_id long, db_id string, question string")
    got = {(r["question_id"], r["table_name"], r["column_name"]): r["score"]
           for r in S.schema_item_scores(asked, catalog).collect()}
    # song and singer are held by two items each, name by two
    assert got[1, "song", None] == 0.5 and got[1, "song", "song_name"] == 1.0 and got[1, "song", "year"] == 0.0
    assert got[1, "singer", "singer_name"] == 1.0 and got[1, "___", None] == 0.0
    assert len(got) == 14 and all(v == 0 for (q, *_), v in got.items() if q == 2)
    scored = S.scored_items(asked, catalog)
    assert rows(S.top_k_tables(scored, 2).where("question_id = 1").select("table_rank", "table_name")) == [
        (1, "song"), (2, "singer")]
    assert rows(S.top_k_columns(scored, 1, 1).where("question_id = 1").select("table_name", "column_name")) == [
        ("song", "song_name")]


# --- training and evaluation

def test_split_reasoning(spark):
    assert one(spark, "1. a 10. b 2.5", D.split_reasoning) == "1. a 1\n0. b \n2.5"


def test_token_budget(spark):
    df = spark.createDataFrame([(1, " a  b\nc "), (2, "")], "question_id long, text string")
    assert rows(D.token_budget(df, "text", 2)) == [(1, 3, True, "a b"), (2, 0, False, "")]


def test_execution_match_tells_copies_apart(spark):
    data = [(1, "gold", "r"), (1, "pred", "r"), (2, "gold", "r"), (2, "pred", "r"), (2, "pred", "r"),
            (3, "gold", "r"), (4, "pred", "r")]
    results = spark.createDataFrame(data, "query_id long, side string, row_json string")
    ran = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    got = {r["query_id"]: (r["n_missing"], r["n_extra"], r["matches"]) for r in E.execution_match(results, ran).collect()}
    assert got == {1: (0, 0, True), 2: (0, 1, False), 3: (1, 0, False), 4: (0, 1, False), 5: (0, 0, True)}


RESULTS = {  # name: gold rows, predicted rows, missing, extra
    "swapped": (['{"a":1,"b":"x"}', '{"a":2,"b":"y"}'], ['{"p":"x","q":1}', '{"p":"y","q":2}'], 0, 0),
    "swapped, other pairs": (['{"a":1,"b":"x"}', '{"a":2,"b":"y"}'], ['{"p":"y","q":1}', '{"p":"x","q":2}'], 2, 2),
    "numbers": (["[1]", "[2.50]", "[0.1]", "[100000000000000000000]"], ["[1.0]", "[25e-1]", "[1e-1]", "[1e20]"], 0, 0),
    "text is no number": (["[1]"], ['["1"]'], 1, 1),
    "large integers": (["[9007199254740993]"], ["[9007199254740992]"], 1, 1),
    "lists and objects": (['{"a":1,"b":"x"}'], ['["x",1]'], 0, 0),
    "same values in two columns": (["[1,2]", "[2,3]", "[3,1]"], ["[2,1]", "[3,2]", "[1,3]"], 0, 0),
    "three alike, turned": (["[1,2,3]", "[2,3,1]", "[3,1,2]"], ["[1,3,2]", "[2,1,3]", "[3,2,1]"], 0, 0),
    "alike by column only": (["[1,1]", "[2,2]"], ["[1,2]", "[2,1]"], 2, 2),
    "column twice": (["[1,1,5]", "[2,2,6]"], ["[1,5,1]", "[2,6,2]"], 0, 0),
    "column twice on one side": (["[1,1,5]", "[2,2,6]"], ["[1,5,5]", "[2,6,6]"], 2, 2),
    "copies": (["[1,2]", "[1,2]", "[3,4]"], ["[2,1]", "[4,3]", "[4,3]"], 3, 3),  # no columns of equal values, so by place
    "fewer columns": (["[1,2]"], ["[1]"], 1, 1),
    "a row too many, columns named alike": (['{"a":1,"b":2}'], ['{"b":2,"a":1}', '{"b":7,"a":8}'], 0, 1),
    "nulls": (["[null,1]", "[2,null]"], ["[1,null]", "[null,2]"], 0, 0),
    "null for absent": (['{"a":1,"b":null}', '{"a":2,"b":3}'], ['{"a":1}', '{"b":3,"a":2}'], 0, 0),
    "true is not 1": (["[true]"], ["[1]"], 1, 1),
    "no gold rows": ([], ["[1]", "[1]"], 0, 2),
    "no predicted rows": (["[1,2]"], [], 1, 0),
    "neither": ([], [], 0, 0),
    "rows without cells": (["[]", "{}"], ["[]", "[]"], 0, 0),
    "null texts": ([None], [None], 0, 0),
    "other text": (["ab", "5"], ["5", "ab"], 0, 0),
    "five columns, one cell each": ([str([int(i == k) for i in range(5)]) for k in range(5)], [str([int(i == k) for i in range(5)]) for k in (3, 1, 4, 0, 2)], 0, 0),
}


def test_execution_match_over_columns_in_any_order(spark):
    data = [(n, side, r) for n, (gold, pred, *_) in enumerate(RESULTS.values()) for side, rs in (("gold", gold), ("pred", pred)) for r in rs]
    results = spark.createDataFrame(data, "query_id long, side string, row_json string")
    ran = spark.range(len(RESULTS)).withColumnRenamed("id", "query_id")
    got = {r["query_id"]: (r["n_missing"], r["n_extra"], r["matches"]) for r in E.execution_match(results, ran).collect()}
    assert {name: got[n] for n, name in enumerate(RESULTS)} == {
        name: (missing, extra, missing + extra == 0) for name, (_, _, missing, extra) in RESULTS.items()}


def test_execution_match_equals_trying_every_order(spark):
    rng, data, want = random.Random(5), [], {}
    for n in range(60):
        width = rng.randint(1, 4)
        gold = [[rng.choice([0, 1, 2, "a", None]) for _ in range(width)] for _ in range(rng.randint(1, 5))]
        order = rng.sample(range(width), width)
        pred = [[row[i] for i in order] for row in rng.sample(gold, len(gold))]
        if n % 2:
            pred[0][0] = rng.choice([0, 1, 2, "a", None])
        data += [(n, side, json.dumps(row)) for side, rows_ in (("gold", gold), ("pred", pred)) for row in rows_]
        want[n] = any(Counter(tuple(r[i] for i in p) for r in pred) == Counter(map(tuple, gold)) for p in permutations(range(width)))
    results = spark.createDataFrame(data, "query_id long, side string, row_json string")
    got = E.execution_match(results, spark.range(60).withColumnRenamed("id", "query_id")).collect()
    assert {r["query_id"]: r["matches"] for r in got} == want and 30 <= sum(want.values()) < 60


def test_typed_export(spark):
    df = spark.createDataFrame([(1, 2.9, "a"), (2, -2.9, None), (3, float("nan"), "c"), (4, float("inf"), "d"), (5, None, "e")],
                               "i int, x double, s string")
    got = E.typed_export(df)
    assert got.dtypes == [("i", "bigint"), ("x", "bigint"), ("s", "string")]
    assert [r["x"] for r in got.orderBy("i").collect()] == [2, -2, None, None, None]


def test_default_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "q")], "question_id long, question string")
    assert rows(E.default_missing(df, {"question": "none", "schema": "empty"})) == [(1, "none", "empty"), (2, "q", "empty")]


def test_clause_match(spark):
    df = spark.createDataFrame(
        [(1, "SELECT a, b FROM t WHERE x = 1 AND y = 2", "select b from t where X = 1"), (2, "SELECT a FROM t", None)],
        "question_id long, gold_sql string, pred_sql string")
    got = {(r["question_id"], r["clause"]): (r["precision"], r["recall"], r["f1"]) for r in E.clause_match(df).collect()}
    assert got[1, "select"] == (1.0, 0.5, 0.666667) and got[1, "where"] == (1.0, 0.5, 0.666667)
    assert got[1, "group"] == (1.0, 1.0, 1.0) and got[2, "from"] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("gold, pred, clause, f1", [
    ("SELECT DISTINCT a FROM t", "SELECT a FROM t", "select", 0.666667),
    ("SELECT DISTINCT a FROM t", "select distinct a from t", "select", 1.0),
    ("SELECT a FROM t GROUP BY a HAVING COUNT(*) > 5", "SELECT a FROM t GROUP BY a HAVING COUNT(*) > 9", "having", 0.0),
    ("SELECT a FROM t WHERE x = 1 AND y = 2", "SELECT a FROM t WHERE x = 1 OR y = 2", "connective", 0.0),
    ("SELECT a FROM t WHERE x = 1 AND y = 2", "SELECT a FROM t WHERE y = 2 AND x = 1", "where", 1.0),
    ("SELECT a FROM t WHERE n = 'Ab'", "SELECT a FROM t WHERE n = 'aB'", "where", 0.0),
    ("SELECT a FROM t WHERE n = 'x AND y FROM z'", "SELECT a FROM t WHERE n = 'x AND y FROM w'", "where", 0.0),
    ("SELECT a FROM t WHERE n BETWEEN 1 AND 2", "SELECT a FROM t WHERE n BETWEEN 1 AND 3", "where", 0.0),
    ("SELECT a FROM t WHERE n BETWEEN 1 AND 2", "SELECT a FROM t", "connective", 1.0),
    ("SELECT a FROM t UNION SELECT a FROM s", "SELECT a FROM t", "from", 1.0),
    ("SELECT a FROM t UNION SELECT a FROM s", "SELECT a FROM t INTERSECT SELECT a FROM s", "set", 0.0),
    ("SELECT a FROM t WHERE a IN (SELECT b FROM s UNION SELECT c FROM r)", "SELECT a FROM t", "set", 1.0),
])
def test_clause_match_cases(spark, gold, pred, clause, f1):
    df = spark.createDataFrame([(1, gold, pred)], "question_id long, gold_sql string, pred_sql string")
    assert E.clause_match(df).where(F.col("clause") == clause).first()["f1"] == f1


@pytest.mark.parametrize("gold, pred, clause, f1", [
    # a sub-query is one part of its clause, and its own clauses are compared apart
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1) GROUP BY a", "SELECT a FROM t WHERE b IN (SELECT c FROM u) GROUP BY a", "where", 1.0),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1) GROUP BY a", "SELECT a FROM t WHERE b IN (SELECT c FROM u) GROUP BY a", "nested", 0.8),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1) GROUP BY a", "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d = 1) GROUP BY a", "group", 1.0),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u GROUP BY d)", "SELECT a FROM t GROUP BY d", "group", 0.0),
    # the place of a sub-query counts
    ("SELECT a FROM (SELECT c FROM u) WHERE b > 1", "SELECT a FROM t WHERE b > (SELECT c FROM u)", "nested", 0.0),
    # a set operation in parentheses is the same without them
    ("(SELECT a FROM t) UNION (SELECT b FROM s)", "SELECT a FROM t UNION SELECT b FROM s", "set", 1.0),
    ("(SELECT a FROM t) UNION (SELECT b FROM s)", "SELECT a FROM t UNION SELECT b FROM s", "select", 1.0),
    ("SELECT a FROM t UNION SELECT b FROM s WHERE b = 1", "SELECT a FROM t UNION SELECT b FROM s", "set", 0.857143),
    ("SELECT a FROM t WHERE a IN (SELECT b FROM s UNION SELECT c FROM r)", "SELECT a FROM t WHERE a IN (SELECT b FROM s EXCEPT SELECT c FROM r)", "nested", 0.4),
    # commas, AND and FROM inside a function are no separators
    ("SELECT f(a, b), extract(year from d) FROM t", "SELECT extract(year from d), f(a, b) FROM t", "select", 1.0),
    ("SELECT f(a, b) FROM t", "SELECT f(a), b FROM t", "select", 0.0),
    ("SELECT a FROM t JOIN s ON t.a = s.a AND t.b = s.b", "SELECT a FROM s ON t.a = s.a AND t.b = s.b JOIN t", "from", 1.0),
    # grouped conditions
    ("SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3", "SELECT a FROM t WHERE z = 3 AND (y = 2 OR x = 1)", "where", 1.0),
    ("SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3", "SELECT a FROM t WHERE x = 1 OR (y = 2 AND z = 3)", "where", 0.333333),
    ("SELECT a FROM t WHERE NOT (x = 1)", "SELECT a FROM t WHERE (x = 1)", "where", 0.0),
    ("SELECT a FROM t WHERE x IN ('(SELECT', 'q)')", "SELECT a FROM t WHERE x IN ('(SELECT', 'q)') ORDER BY a", "where", 1.0),
    # what is not balanced still gives a row for each clause
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u", "SELECT a) FROM t))", "select", 1.0),
])
def test_clause_match_of_nested_queries(spark, gold, pred, clause, f1):
    df = spark.createDataFrame([(1, gold, pred)], "question_id long, gold_sql string, pred_sql string")
    assert E.clause_match(df).where(F.col("clause") == clause).first()["f1"] == f1


def test_clauses_of_deep_and_long_queries(spark):
    deep = "SELECT a FROM t WHERE b IN (" * 40 + "SELECT 1" + ")" * 40
    wide = "SELECT " + ", ".join(f"c{i}" for i in range(3000)) + " FROM t"
    df = spark.createDataFrame([(1, deep, deep), (2, wide, wide), (3, None, None), (4, "", "x")], "question_id long, gold_sql string, pred_sql string")
    got = {(r["question_id"], r["clause"]): r["f1"] for r in E.clause_match(df).collect()}
    assert {v for (q, _), v in got.items() if q in (1, 2)} == {1.0} and len(got) == 4 * len(E.CLAUSES)


@pytest.mark.parametrize("gold, pred, same", [
    ("SELECT DISTINCT a FROM t WHERE x = 1 AND y IN (2)", "select distinct a  from t where x = 1 and y in (2);", True),
    ("SELECT a FROM t WHERE n = 'and  on'", "SELECT a FROM t WHERE n = 'AND ON'", False),
    ("SELECT a FROM t WHERE n = 'it''s'", "select a from t where n = 'it''s'", True),
    ("SELECT a FROM t", None, False),
])
def test_exact_match_cases(spark, gold, pred, same):
    df = spark.createDataFrame([(1, gold, pred)], "question_id long, gold_sql string, pred_sql string")
    assert E.exact_match(df).first()["exact"] is same


def test_null_table_name_and_repeated_database(spark):
    df = spark.createDataFrame([
        ("d", ["t", None], [["0", "a"], ["1", "b"]], ["text"] * 2, [0], []),
        ("d", ["u"], [["0", "a"]], ["text"], [0], [])], schemas.RAW_CATALOG)
    assert sorted(rows(C.catalog_rejects(df))) == [
        ("d", "column", "b", "bad table index"), ("d", "database", "2 records", "repeated db_id"), ("d", "table", "1", "no name")]
    assert {k: v for r in C.catalog_by_db(df).collect() for k, v in r["tables"].items()} == {"t": ["a"], "u": ["a"]}


def test_wide_database_grows_linearly(spark):
    """Four times the tables take about four times as long, not sixteen."""
    def seconds(n):
        columns = [["-1", "*"]] + [[str(t), f"c_{t}_{c}"] for t in range(n) for c in range(20)]
        df = spark.createDataFrame([("d", [f"t_{t}" for t in range(n)], columns, ["text"] * len(columns), [1], [])], schemas.RAW_CATALOG)
        best = []
        for _ in range(2):
            start = time.perf_counter()
            S._weighted_items(df).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)

    seconds(50)
    assert seconds(1000) < 8 * max(seconds(250), 0.5)


def test_success_rate_without_questions(spark):
    none = spark.createDataFrame([], "question_id long")
    assert rows(E.success_rate(none, none)) == [(0, 0, 0.0)]


@pytest.mark.parametrize("listed, kept", [([2], [1]), ([2, None], []), ([], [1, 2, None])])
def test_not_in_null_rules(spark, listed, kept):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(v,) for v in listed], "v int")
    assert [r["k"] for r in not_in(left, "k", right, "v").orderBy(F.asc_nulls_last("k")).collect()] == kept


def test_a_response_is_cut_once(spark):
    rows = spark.createDataFrame([(1, "")], "question_id long, response string")
    plan = R.extract_reasoning_sql(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 8  # four cuts for either kind of tag
    assert plan.count("regexp_replace(") < 20


def test_only_keywords_that_occur_are_replaced_and_all_spellings_are_found(spark):
    texts = ["select a from b", "Group By x order by y Having count(*) > 1", "group  by limits", "ſelect lımit joİn mın lİmit", "é select min_x Max(x)",
             "", None, "SELECT 1", "on ON oN _on on_ 1on", "sum avg min max limit where join"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for word in SQL_KEYWORDS:
        plain = F.regexp_replace(plain, rf"(?iU)\b{word}\b", word)
    for r in df.select("t", upper_keywords(F.col("t")).alias("found"), plain.alias("wanted")).collect():
        assert r.found == r.wanted, r.t
