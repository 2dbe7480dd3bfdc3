"""Published runs: one copy after a failure at any step, one publication of several files, counts by batch."""

import pytest
from sqlloom.plans import fixtures as X
from sqlloom.plans import registry
from sqlloom.sources import bucketed, commits, sinks
from sqlloom.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    return registry.inputs(spark, sf_dir)


@pytest.mark.parametrize("step", ["before", "within", "manifest"])
def test_a_failed_run_is_started_again(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    schema = df.schema
    assert commits.commit(spark, path, "first", lambda f: df.where("k = 1").write.parquet(f))

    def fails(folder):
        if step == "within":
            df.write.parquet(folder)  # all data is there, but nothing names it
        raise RuntimeError("lost")

    if step == "manifest":
        with monkeypatch.context() as m:
            m.setattr(commits.json, "dumps", lambda o: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                commits.commit(spark, path, "second", lambda f: df.write.parquet(f))
    else:
        with pytest.raises(RuntimeError):
            commits.commit(spark, path, "second", fails)
    assert rows(commits.read_committed(spark, path, schema)) == [(1, "a", "first")]
    assert commits.commit(spark, path, "second", lambda f: df.where("k = 2").write.parquet(f))
    assert not commits.commit(spark, path, "second", lambda f: df.write.parquet(f))
    assert rows(commits.read_committed(spark, path, schema)) == [(1, "a", "first"), (2, "b", "second")]


def test_of_two_attempts_one_is_published(spark, tmp_path):
    path, df = str(tmp_path / "runs"), spark.createDataFrame([(1,)], "k long")

    def overtaken(folder):
        df.write.parquet(folder)
        assert commits.commit(spark, path, "r", lambda f: df.union(df).write.parquet(f))

    assert not commits.commit(spark, path, "r", overtaken)
    assert commits.read_committed(spark, path, df.schema).count() == 2


def test_no_run_and_odd_names(spark, tmp_path):
    df = spark.createDataFrame([], "k long")
    assert commits.read_committed(spark, str(tmp_path / "none"), df.schema).count() == 0
    for name in ("", "../x", "_hidden", "a/b"):
        with pytest.raises(ValueError):
            commits.commit(spark, str(tmp_path / "none"), name, lambda f: None)
    commits.commit(spark, str(tmp_path / "some"), "empty", lambda f: df.write.parquet(f))
    assert commits.read_committed(spark, str(tmp_path / "some"), df.schema).count() == 0


def test_runs_of_annotations_are_pruned(spark, made, tmp_path):
    path = str(tmp_path / "ann")
    few = spark.createDataFrame(made.annotations.where("question_id < 50").collect(), made.annotations.schema)
    sinks.commit_annotations(few.where("question_id < 20"), path, "a")
    sinks.commit_annotations(few.where("question_id >= 20"), path, "b")
    back = commits.read_committed(spark, path, few.schema)
    assert rows(back.drop("run_id")) == rows(few)
    plan = back.where("run_id = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_evaluator_files_are_published_together(spark, tmp_path):
    data = spark.createDataFrame([(2, "p2", "g2", "d"), (1, "p1", "g1", "d")], "question_id long, pred_sql string, gold_sql string, db_id string")
    path = str(tmp_path / "eval")
    assert sinks.commit_evaluator_files(data, path, "x") and not sinks.commit_evaluator_files(data, path, "x")
    folder = commits.committed_folders(spark, path)["x"]
    assert [r[0] for r in spark.read.text(f"{folder}/pred").collect()] == ["p1", "p2"]
    assert [r[0] for r in spark.read.text(f"{folder}/gold").collect()] == ["g1\td", "g2\td"]


def test_progress_counts_by_batch(spark, tmp_path, monkeypatch):
    source, path, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    questions = spark.createDataFrame([(i,) for i in range(10)], "question_id long")

    def deliver(ids):
        spark.createDataFrame([(i,) for i in ids], "question_id long").coalesce(1).write.mode("append").parquet(source)

    def count():
        stream = spark.readStream.schema("question_id long").parquet(source)
        incremental.stream_progress(stream, questions, path, state)
        return {r["shard"]: (r["n_asked"], r["n_processed"]) for r in incremental.read_progress(spark, path, questions).collect()}

    deliver([0, 0, 5, 99, None])
    assert count() == {0: (3, 1), 1: (3, 1), 2: (2, 0), 3: (2, 0)}
    deliver([5, 9, 0])
    publish = incremental.commit

    def lost(spark, path, run, write):  # published, but the batch is not known to be done
        publish(spark, path, run, write)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "commit", lost)
        with pytest.raises(Exception, match="lost"):
            count()
    assert count() == {0: (3, 1), 1: (3, 2), 2: (2, 0), 3: (2, 0)}
    assert count()[1] == (3, 2)
    assert len(commits.committed_folders(spark, path)) == 2


def test_stored_sides_are_not_shuffled(spark, made, tmp_path):
    from sqlloom.operators import prompts as P
    from sqlloom.plans.annotation import annotate

    def stored(name, df, key):
        bucketed.append(df, name, key, 4, str(tmp_path / name))
        return spark.table(name)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    prompts = stored("b_prompts", P.with_prompt_hash(made.link_prompts), "prompt_hash")
    done = stored("b_done", made.completions, "prompt_hash")
    for f in (P.pending_prompts, P.join_completions):
        assert "Exchange" not in plan(f(prompts, done)) and rows(f(prompts, done)) == rows(f(made.link_prompts, made.completions))

    s, d = made.spark, made.sf_dir
    parts = [X.link_responses(s, d), X.class_responses(s, d), X.sql_responses(s, d)]
    kept = [stored(f"b_{n}", df, "question_id") for n, df in enumerate([made.questions, *parts])]
    catalog = spark.createDataFrame(made.catalog.collect(), made.catalog.schema)
    by_bucket = annotate(kept[0], catalog, *kept[1:])
    assert plan(by_bucket).count("Exchange hashpartitioning") == plan(by_bucket).count("Exchange hashpartitioning(db_id") == 2
    assert rows(by_bucket) == rows(made.annotations)


def test_new_rows_are_added_once(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string")
    more = spark.createDataFrame([(2, "b"), (3, "b")], "k long, v string")
    for df in (first, more, more):
        bucketed.append_new(df, "b_new", "k", 4, str(tmp_path / "new"))
    assert rows(spark.table("b_new")) == [(1, "a"), (2, "a"), (3, "b")]
    added = more.join(spark.table("b_new").select("k").hint("merge"), "k", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert added.count("Exchange") == 1  # the new rows
    bucketed.compact(spark, "b_new", "b_new_small", "k", 2, str(tmp_path / "small"))
    assert rows(spark.table("b_new_small")) == rows(spark.table("b_new"))
