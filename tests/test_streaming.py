"""The incremental path gives what the batch gives, once."""

from sqlloom.operators.extract import extract_reasoning_sql
from sqlloom.plans import fixtures as X
from sqlloom.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_equals_batch_and_repeats_nothing(spark, sf_dir, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    responses = X.sql_responses(spark, sf_dir)
    first, second = responses.where("question_id < 600"), responses.where("question_id >= 600")

    def landed():
        return spark.read.schema(incremental.PARSED).parquet(sink)

    first.repartition(4).write.mode("append").json(source)
    incremental.stream_extract(spark, source, sink, state)
    assert rows(landed()) == rows(extract_reasoning_sql(first))

    incremental.stream_extract(spark, source, sink, state)
    assert landed().count() == 600

    second.repartition(2).write.mode("append").json(source)
    incremental.stream_extract(spark, source, sink, state)
    assert rows(landed()) == rows(extract_reasoning_sql(responses))


def test_a_later_delivery_replaces(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def deliver(data, names="question_id long, response string, attempt int"):
        spark.createDataFrame(data, names).coalesce(1).write.mode("append").json(source)
        incremental.stream_extract(spark, source, sink, state)
        return sorted((r["question_id"] or -1, r["sql"]) for r in incremental.read_parsed(spark, sink).collect())

    def answer(sql):
        return f"<REASONING>because</REASONING><SQL>{sql}</SQL>"

    parsed = {t: extract_reasoning_sql(spark.createDataFrame([(answer(t),)], "response string")).first()["sql"] for t in "abcd"}
    a, b, c, d = (parsed[t] for t in "abcd")
    assert len({a, b, c, d}) == 4
    assert deliver([(1, answer("a")), (2, answer("a")), (3, answer("d"))], "question_id long, response string") == [(1, a), (2, a), (3, d)]
    assert deliver([(1, answer("a"), None), (2, answer("b"), 2)]) == [(1, a), (2, b), (3, d)]      # once more; retried
    assert deliver([(2, answer("c"), 1), (3, answer("c"), None)]) == [(1, a), (2, b), (3, c)]      # late; replaced
    assert deliver([(None, answer("a"), 1), (None, answer("a"), 1), (1, answer("d"), 0)]) == [(-1, a), (-1, a), (1, d), (2, b), (3, c)]
    incremental.stream_extract(spark, source, sink, state)  # nothing new
    assert spark.read.parquet(sink).count() == 10 and incremental.read_parsed(spark, sink).count() == 5


def test_often_delivered_question_is_cut_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame([], incremental._DELIVERED).write.parquet(str(tmp_path / "s"))
    text = incremental.read_parsed(spark, str(tmp_path / "s"))._jdf.queryExecution().executedPlan().toString()
    assert text.index("Final") < text.index("Exchange hashpartitioning(question_id") < text.index("Partial")


def test_progress_counts_a_question_once(spark):
    questions = spark.createDataFrame([(i,) for i in range(10)], "question_id long")
    done = spark.createDataFrame([(0,), (0,), (5,), (99,)], "question_id long")
    got = {r["shard"]: (r["n_asked"], r["n_processed"]) for r in incremental.progress_by_shard(questions, done, 4).collect()}
    assert got == {0: (3, 1), 1: (3, 1), 2: (2, 0), 3: (2, 0)}
