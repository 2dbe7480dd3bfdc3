"""Round trips through files."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlloom import schemas
from sqlloom.sources import csv_spans, json_spans, readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_catalog_list_in_one_file(spark, tmp_path):
    record = {"db_id": "d", "table_names_original": ["t"], "column_names_original": [[-1, "*"], [0, "a"]],
              "column_names": [[-1, "*"], [0, "shown"]], "table_names": ["shown"], "column_types": ["text", "text"],
              "primary_keys": [1], "foreign_keys": [[1, 1]]}
    (tmp_path / "tables.json").write_text(json.dumps([record, {**record, "db_id": "e"}], indent=1))
    got = readers.read_catalog(spark, str(tmp_path / "tables.json"))
    assert got.schema == schemas.RAW_CATALOG
    assert [r["column_names_original"] for r in got.collect()] == [[["-1", "*"], ["0", "a"]]] * 2


def test_columnar_documents(spark, tmp_path):
    # an index repeats in another document; cells may be null, absent, or in another order
    (tmp_path / "a.json").write_text(json.dumps({"q": {"0": "x", "10": "y"}, "n": {"10": 5, "0": None}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"q": {"0": "z"}, "n": {}}))
    got = readers.read_columnar_json(spark, str(tmp_path), ["q", "n"])
    assert rows(got.select(F.substring_index("document", "/", -1), "idx", "q", "n")) == [
        ("a.json", 0, "x", None), ("a.json", 10, "y", "5"), ("b.json", 0, "z", None)]


def test_columnar_documents_with_types(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"q": {"0": "x", "1": None}, "score": {"0": 1, "1": "high"}}))
    got = readers.read_columnar_json(spark, str(tmp_path), T.StructType().add("q", "string").add("score", "integer"))
    assert [tuple(r)[1:] for r in got.orderBy("idx").collect()] == [(0, "x", 1, None), (1, None, None, {"score": "high"})]


def test_columnar_documents_round_trip_and_size(spark, tmp_path):
    df = spark.range(25).select("id", F.concat(F.lit('q "'), F.col("id"), F.lit('"\n')).alias("a"),
                                F.when(F.col("id") % 3 != 0, F.lit("v")).alias("b"))
    path = str(tmp_path / "out")
    sinks.write_columnar_json(df, path, "id", rows_per_document=10)
    got = readers.read_columnar_json(spark, path, ["a", "b"])
    assert got.select("document").distinct().count() == 3
    key = lambda t: (t[0], t[1])
    assert sorted(map(tuple, got.drop("document").collect()), key=key) == sorted(map(tuple, df.collect()), key=key)


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    data = [(1, 'say "hi",\nthen', "[a,b]", "SELECT 'x'"), (2, "plain", None, None)]
    df = spark.createDataFrame(data, schemas.PREDICTIONS)
    sinks.write_predictions_csv(df, str(tmp_path / "p"))
    got = {r[0]: tuple(r) for r in readers.read_predictions_csv(spark, str(tmp_path / "p")).collect()}
    assert got[1] == data[0] and got[2][:2] == (2, "plain")


def test_eval_pairs_are_one_line_each(spark, tmp_path):
    df = spark.createDataFrame([(1, "SELECT\t1\nFROM t", None, None)], "question_id long, gold_sql string, pred_sql string, db_id string")
    sinks.write_eval_pairs(df, str(tmp_path / "e"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()] == ["1\t\tSELECT 1 FROM t\t"]


def test_transcript_is_numbered_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i * 7 % 40, f"p{i * 7 % 40}", None if i == 3 else "a") for i in range(40)],
                               "question_id long, sample string, answer string").repartition(6)
    got = sorted(sinks.transcript(df).collect())
    assert [r["sample_no"] for r in got] == list(range(1, 41))
    assert got[0]["entry"] == "Sample 1:\np0\nGenerated SQL:\na\n"
    sinks.write_transcript(df, str(tmp_path / "t"))
    files = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))
    heads = [l for p in files for l in p.read_text().splitlines() if l.startswith("Sample ")]
    assert heads == [f"Sample {i}:" for i in range(1, 41)]


def test_annotations_are_partitioned_by_class(spark, tmp_path):
    df = spark.createDataFrame([(1, "EASY"), (2, "NESTED"), (3, ""), (4, "my own / class")], "question_id long, classification string")
    path = str(tmp_path / "a")
    sinks.write_annotations(df, path)
    easy = spark.read.parquet(path).where("class_norm = 'EASY'")
    assert "PartitionFilters: [isnotnull(class_norm" in easy._jdf.queryExecution().executedPlan().toString()
    assert easy.count() == 1
    assert rows(spark.read.parquet(path).drop("class_norm")) == rows(df)
    with pytest.raises(AnalysisException):
        sinks.write_annotations(df, path)
    sinks.write_annotations(df, path, mode="overwrite")
    assert spark.read.parquet(path).count() == 4


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text('model_predicted_sql,question_id,question\n"SELECT 1, 2",7,why\nx,seven,how\n')
    got = readers.read_predictions_csv(spark, str(tmp_path / "p.csv"))
    assert got.schema == schemas.PREDICTIONS
    assert sorted(map(tuple, got.collect()), key=str) == [(7, "why", None, "SELECT 1, 2"), (None, "how", None, "x")]


def test_csv_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffquestion_id,question\n1,"a\nb"\n\n2,c\n')
    (tmp_path / "b.csv").write_bytes(b'"question","other","question_id"\r\n"x, ""y""\r\nz",,3\r\n,"q",4')
    (tmp_path / "none.csv").write_text("")
    got = readers.read_predictions_csv(spark, str(tmp_path)).select("question_id", "question")
    assert rows(got.fillna("", "question")) == [(1, "a\nb"), (2, "c"), (3, 'x, "y"\r\nz'), (4, "")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert readers.read_predictions_csv(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("line, inside, behind", [
    ("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('"a""', False, True), ('"a"""', False, False),
    ('x"y', False, False), ('"a"b"c', False, False), ('","', True, True), ('","', False, False), ('"', True, False), ('""', True, True), ("", True, True)])
def test_csv_quote_state_of_a_line(line, inside, behind):
    assert csv_spans.open_behind(line, inside) == behind


def test_one_csv_file_is_many_tasks(spark, tmp_path):
    draw = random.Random(5)
    bits = ["a", ",", '"', "\n", '",', "\n\n", '\n"', "word ", "\u00e9"]
    data = [(i, "".join(draw.choices(bits, k=draw.randrange(1, 30))), "x" * draw.choice([1, 1, 1, 4000]) + "\n", "s") for i in range(400)]
    cell = lambda v: '"' + str(v).replace('"', '""') + '"'
    text = "question_id,question,schema_links,model_predicted_sql\n" + "\n".join(",".join(map(cell, r)) for r in data) + "\n"
    (tmp_path / "p.csv").write_text(text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = readers.read_predictions_csv(spark, str(tmp_path / "p.csv"))
        ends = csv_spans._lines(spark, str(tmp_path / "p.csv")).mapInArrow(
            csv_spans._ends, "file string, split bigint, ends_0 boolean, ends_1 boolean, header string").collect()
        begins = csv_spans.begin_states([tuple(r)[:4] for r in ends])
        assert len(begins) > 20 and 0 < sum(begins.values()) < len(begins)
        assert rows(got) == data
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_unreadable_records_are_shown(spark, tmp_path):
    good = {"question_id": 1, "db_id": "d", "question": "q", "query": "s"}
    (tmp_path / "q.json").write_text(json.dumps(good) + "\n{broken\n\n" + json.dumps(good) + " tail\n[1]\n")
    (tmp_path / "list.json").write_text(json.dumps([good, good], indent=1))
    got = readers.unreadable_records(spark, str(tmp_path), schemas.QUESTIONS)
    assert sorted(r["rejected"] for r in got.collect()) == ["tail\n[1", "{broken"]
    assert readers.read_questions(spark, str(tmp_path)).count() == 4


def made_questions(n):
    rng = random.Random(3)
    letters = 'ab{}[]",\\é😀\n '
    return [{"question_id": i, "db_id": f"db_{i}", "question": "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))),
             "query": "select '}' ", "sql": {"a": [{"b": "}{"}, [1, [2]]], "c": {}}} for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("form", ["compact", "pretty", "lines", "objects", "blank", "long"])
def test_json_files_are_cut_in_parallel(spark, tmp_path, small_splits, form):
    records = made_questions(200)
    if form == "long":  # records that reach over many splits
        records = [{**r, "question": r["question"] * 400} for r in records[:20]]
    text = {"compact": json.dumps(records), "long": json.dumps(records), "pretty": json.dumps(records, indent=4, ensure_ascii=False),
            "lines": "\n".join(map(json.dumps, records)), "objects": "\n".join(json.dumps(r, indent=2) for r in records) + "\n",
            "blank": "\ufeff \n" + json.dumps(records, indent=1) + "\n\n  "}[form]
    (tmp_path / "q.json").write_text(text, encoding="utf-8")
    got = json_spans.read_records(spark, str(tmp_path), schemas.QUESTIONS).collect()
    assert [r["rejected"] for r in got if r["rejected"]] == []
    wanted = sorted((r["question_id"], r["db_id"], r["question"], r["query"]) for r in records)
    assert sorted(tuple(r)[:4] for r in got) == wanted
    assert json_spans.split_sums(spark, str(tmp_path)).count() > 5  # tasks with a share of the file


@pytest.mark.parametrize("indent", [None, 2])
def test_broken_records_do_not_take_others(spark, tmp_path, small_splits, indent):
    texts = [json.dumps(r, indent=indent) for r in made_questions(60)]
    broken = {5: texts[5][:-30], 20: "oops", 30: texts[30].replace('"db_id"', '"db_id', 1), 40: '{"question_id": "x"}', 59: texts[59][:25]}
    for i, t in broken.items():
        texts[i] = t
    (tmp_path / "q.json").write_text("\n".join(texts))
    got = json_spans.read_records(spark, str(tmp_path), schemas.QUESTIONS).collect()
    good = {r["question_id"] for r in got if r["rejected"] is None}
    assert good == set(range(60)) - set(broken)
    assert "".join("".join(r["rejected"].split()) for r in got if r["rejected"]).count("oops") == 1
    assert sum(len("".join(r["rejected"].split())) for r in got if r["rejected"]) >= sum(len("".join(t.split())) for t in broken.values()) - 5


def test_a_split_is_scanned_in_blocks(monkeypatch):
    texts = ["[\n" + "".join(random.Random(1).choices('{["\\\\\n ,a\t]', k=3000))] + [f',\n{{"question": "a\\"{{b {i}"' for i in range(40_000)]
    columns = [pa.array(["f"] * len(texts)), pa.array([0] * len(texts), pa.int64()), pa.array([1 << 40] * len(texts), pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, names=["file", "split", "size", "value"])
    tracemalloc.start()
    try:
        in_blocks = next(json_spans._sums(iter([batch]))).to_pylist()
        assert tracemalloc.get_traced_memory()[1] < 50 * in_blocks[0]["size"]  # 80 bytes a byte, and more, for a split at once
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(json_spans, "_BLOCK", 100)
    assert next(json_spans._sums(iter([batch]))).to_pylist() == in_blocks


def test_files_without_records(spark, tmp_path):
    for name, text in {"a": "", "b": "[]", "c": " \n", "d": "[\n]\n"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert readers.read_catalog(spark, str(tmp_path)).count() == 0
    assert readers.unreadable_records(spark, str(tmp_path), schemas.QUESTIONS).count() == 0


def test_states_of_splits_follow_from_their_sums():
    # file, split, size, file size, base, indent, ends out/in a string, depth out/in, depth behind the last sure record
    sums = [("f", 10, 10, 29, 0, -1, 1, 0, 1, -1, {}), ("f", 0, 10, 29, 1, 4, 1, 0, 2, 0, {4: 1}), ("f", 20, 10, 29, 0, -1, 0, 0, 0, 0, {4: 5})]
    assert json_spans.begin_states(sums) == [("f", 0, 0, 0, 1, 4, True), ("f", 10, 1, 2, 1, 4, True), ("f", 20, 0, 1, 1, 4, False)]


def test_evaluator_files_are_line_aligned(spark, tmp_path):
    df = spark.createDataFrame([(i * 7 % 40, f"SELECT {i * 7 % 40}", None if i == 3 else f"select\n{i * 7 % 40}", "d") for i in range(40)],
                               "question_id long, gold_sql string, pred_sql string, db_id string").repartition(5)
    sinks.write_evaluator_files(df, str(tmp_path / "p"), str(tmp_path / "g"))

    def lines(name):
        return [l for f in sorted((tmp_path / name).glob("part*")) for l in f.read_text().split("\n")[:-1]]

    assert lines("g") == [f"SELECT {i}\td" for i in range(40)]
    assert lines("p") == ["" if i == 21 else f"select {i}" for i in range(40)]


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "k long, a string, b double")
    assert sorted(map(tuple, sinks.unpivot_export(df, "k").collect()), key=str) == [(1, "a", None), (1, "b", "2.5")]
