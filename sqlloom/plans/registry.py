"""Every operator under a name, applied to inputs derived from the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_rows
from sqlloom.operators import catalog as C
from sqlloom.operators import evaluate as E
from sqlloom.operators import extract as R
from sqlloom.operators import item_ranker as L
from sqlloom.operators import prompts as P
from sqlloom.operators import schema_filter as S
from sqlloom.operators import training as D
from sqlloom.plans import fixtures as X
from sqlloom.plans.annotation import annotate, annotation_rejects
from sqlloom.plans.workload import SHAPES
from sqlloom.session import scratch_dir
from sqlloom.sources import bucketed, commits, readers, sinks
from sqlloom.streaming import incremental

EVAL_SHARE = 10  # one question in ten belongs to the evaluation split
SHORT_BUDGET = 60  # tokens; the derived prompts are short


class Inputs:
    """Input tables of one session and folder; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return X.table(self.spark, self.sf_dir, name)

    def _fixture(self, f: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        return f(self.spark, self.sf_dir)

    @cached_property
    def catalog(self) -> DataFrame:
        return self._fixture(X.raw_catalog)

    @cached_property
    def questions(self) -> DataFrame:
        return self._fixture(X.questions)

    @cached_property
    def scores(self) -> DataFrame:
        return self._fixture(X.scores)

    @cached_property
    def links(self) -> DataFrame:
        return R.extract_schema_links(self._fixture(X.link_responses))

    @cached_property
    def links_by_db(self) -> DataFrame:
        return join_rows(self.links, self.questions.select("question_id", "db_id"))

    @cached_property
    def labels(self) -> DataFrame:
        return R.extract_label(self._fixture(X.class_responses))

    @cached_property
    def parsed(self) -> DataFrame:
        return R.extract_reasoning_sql(self._fixture(X.sql_responses))

    @cached_property
    def annotations(self) -> DataFrame:
        return annotate(self.questions, self.catalog, self._fixture(X.link_responses),
                        self._fixture(X.class_responses), self._fixture(X.sql_responses))

    @cached_property
    def valid(self) -> DataFrame:
        return D.valid_samples(self.annotations, self.scores)

    @cached_property
    def predictions(self) -> DataFrame:
        return R.nth_sql_block(R.best_beam(self._fixture(X.raw_generations))).select(
            "question_id", "model_predicted_sql")

    @cached_property
    def attached(self) -> DataFrame:
        rows = self.questions.select("question_id", "db_id", F.col("query").alias("gold_sql"))
        return E.attach_predictions(rows, self.predictions)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.attached.withColumnRenamed("model_predicted_sql", "pred_sql")

    @cached_property
    def link_prompts(self) -> DataFrame:
        return P.schema_link_prompt(self.questions, self.catalog)

    @cached_property
    def completions(self) -> DataFrame:
        return X.completions(P.with_prompt_hash(self.link_prompts))

    @cached_property
    def scored(self) -> DataFrame:
        return S.scored_items(self.questions, self.catalog)

    @cached_property
    def item_scores(self) -> DataFrame:
        return self._fixture(X.item_scores)

    def scratch(self, name: str) -> str:
        return scratch_dir(self.spark, name)


# --- sources and sinks: write the input, then read it back ---------------------------------------

def _joined(name: str, sep: str = ",") -> Column:
    return F.array_join(F.col(name).cast("array<string>"), sep).alias(name)


def _pairs(name: str) -> Column:
    return F.array_join(F.transform(name, lambda p: F.array_join(p.cast("array<string>"), ":")), ",").alias(name)


def read_catalog(i: Inputs) -> DataFrame:
    path = i.scratch("catalog")
    i.catalog.write.json(path)
    return readers.read_catalog(i.spark, path).select(
        "db_id", _joined("table_names_original"), _pairs("column_names_original"), _joined("column_types"),
        _joined("primary_keys"), _pairs("foreign_keys"))


def read_questions(i: Inputs) -> DataFrame:
    path = i.scratch("questions")
    i.questions.write.json(path)
    return readers.read_questions(i.spark, path)


def read_columnar_json(i: Inputs) -> DataFrame:
    path = i.scratch("columnar")
    sinks.write_columnar_json(i.questions, path, "question_id")
    return readers.read_columnar_json(i.spark, path, ["db_id", "question", "query"]).drop("document")


def read_predictions_csv(i: Inputs) -> DataFrame:
    path = i.scratch("predictions")
    rows = join_rows(join_rows(i.questions.select("question_id", "question"), i.links), i.predictions)
    sinks.write_predictions_csv(rows, path)
    return readers.read_predictions_csv(i.spark, path)


def write_annotations(i: Inputs) -> DataFrame:
    path = i.scratch("annotations")
    sinks.write_annotations(i.annotations, path)
    schema = i.annotations.schema
    return i.spark.read.schema(schema).parquet(path).select(*schema.names)


def commit_annotations(i: Inputs) -> DataFrame:
    path, even = i.scratch("runs"), F.col("question_id") % 2 == 0
    for run, rows in (("even", i.annotations.where(even)), ("odd", i.annotations.where(~even)), ("even", i.annotations)):
        sinks.commit_annotations(rows, path, run)  # the third is a rerun, which writes nothing
    return commits.read_committed(i.spark, path, i.annotations.schema).drop("run_id")


def progress_by_batch(i: Inputs) -> DataFrame:
    source, counts, state = i.scratch("done"), i.scratch("counts"), i.scratch("state")
    done = i.annotations.select("question_id")
    for part in (done.where("question_id % 3 = 0"), done):  # a third is delivered again
        part.write.mode("append").parquet(source)
        incremental.stream_progress(i.spark.readStream.schema(done.schema).parquet(source), i.questions, counts, state)
    return incremental.read_progress(i.spark, counts, i.questions)


def ranked_columns(i: Inputs) -> DataFrame:
    """Trained on the links of all questions and applied to all."""
    ranker = L.fit_ranker(i.questions, i.catalog, i.links_by_db)
    return L.best_columns(L.ranked_items(i.questions, i.catalog, ranker))


def _stored_prompts(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Prompts and completions kept in buckets of their hash, each of which one task reads."""
    tables, buckets = [], max(8, X.tasks_for(i.table("events")))
    for name, rows in (("prompts", P.with_prompt_hash(i.link_prompts)), ("completions", i.completions)):
        path = i.scratch(name)
        table = path.rpartition("/")[2].replace("-", "_")
        bucketed.append(rows, table, "prompt_hash", buckets, path)
        tables.append(i.spark.table(table))
    return tables[0], tables[1]


def write_eval_pairs(i: Inputs) -> DataFrame:
    path = i.scratch("pairs")
    sinks.write_eval_pairs(i.pairs, path)
    parts = F.split("value", "\t")
    return i.spark.read.text(path).select(
        F.get(parts, F.lit(0)).cast("long").alias("question_id"),
        *[F.get(parts, F.lit(n)).alias(c) for n, c in enumerate(("pred", "gold", "db_id"), 1)])


def write_transcript(i: Inputs) -> DataFrame:
    easy = D.samples_by_class(i.valid)
    prompts = P.inference_prompt(easy, "fields").withColumnRenamed("prompt", "sample")
    answers = E.attach_predictions(prompts, i.predictions).withColumnRenamed("model_predicted_sql", "answer")
    return sinks.transcript(answers)


def stream_extract(i: Inputs) -> DataFrame:
    source, sink, state = i.scratch("responses"), i.scratch("parsed"), i.scratch("state")
    responses = X.sql_responses(i.spark, i.sf_dir)
    cut = responses.where("question_id % 5 = 0").withColumn("response", F.substring("response", 1, 20))
    for attempt, delivered in enumerate((cut, responses), 1):  # what was cut is retried
        delivered.withColumn("attempt", F.lit(attempt)).write.mode("append").option("maxRecordsPerFile", 2500).json(source)
        incremental.stream_extract(i.spark, source, sink, state)
    return incremental.read_parsed(i.spark, sink)


# --- results with arrays or maps, shown as rows or joined text --------------------------------------

def catalog_by_db(i: Inputs) -> DataFrame:
    keys = F.array_join(F.transform("foreign_keys", lambda k: F.concat_ws(" = ", k["left"], k["right"])), ",")
    return (
        C.catalog_by_db(i.catalog)
        .select("db_id", F.explode("tables").alias("table_name", "columns"), "primary_keys", keys.alias("foreign_keys"))
        .select("db_id", "table_name", _joined("columns"),
                F.try_element_at("primary_keys", F.col("table_name")).alias("primary_key"), "foreign_keys")
    )


def serialize_filtered_schema(i: Inputs) -> DataFrame:
    texts = C.schema_texts(i.catalog)
    items = F.transform(C.schema_items(F.col("fields")), lambda t: t.withField(
        "table_comment", F.when(F.length(t["table_name"]) == 6, F.concat(F.lit("rows of "), t["table_name"])).otherwise("")))
    return C.serialize_filtered_schema(texts.select("db_id", "foreign_keys", items.alias("schema_items"))).select(
        "db_id", "filtered_schema")


def parse_fields(i: Inputs) -> DataFrame:
    return C.parse_fields(C.serialize_fields(i.catalog)).select(
        "db_id", "table_pos", "table_name", _joined("column_names"), "status")


def _accuracy(i: Inputs, matches: DataFrame) -> DataFrame:
    known = join_rows(i.questions.select("question_id", "db_id"), i.labels.select("question_id", "classification"))
    return E.accuracy_by_class(join_rows(matches.select("question_id", "exact"), known))


def executed(i: Inputs) -> DataFrame:
    return E.execution_match(X.query_results(i.spark, i.sf_dir), X.executed_queries(i.spark, i.sf_dir))


def train_eval_union(i: Inputs) -> DataFrame:
    easy = D.samples_by_class(i.valid, ("EASY", "NON-NESTED"))
    is_eval = F.col("question_id") % EVAL_SHARE == 0
    return D.train_eval_union(easy.where(~is_eval), easy.where(is_eval))


def typed_export(i: Inputs) -> DataFrame:
    gap = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return E.typed_export(i.table("events").select("event_id", "user_id", "event_type", gap.alias("value")))


def default_missing(i: Inputs) -> DataFrame:
    from sqlloom.plans.templates import NO_QUESTION, NO_SCHEMA

    asked = F.when(F.col("question_id") % 7 != 0, F.col("question")).alias("question")
    return E.default_missing(
        i.questions.select("question_id", asked), {"question": NO_QUESTION, "schema_links": NO_SCHEMA})


def inference_prompt(i: Inputs) -> DataFrame:
    return P.inference_prompt(join_rows(i.questions.select("question_id", "question"), i.links))


OPERATORS: dict[str, Callable[[Inputs], DataFrame]] = {
    "read_catalog": read_catalog,
    "read_questions": read_questions,
    "read_columnar_json": read_columnar_json,
    "read_predictions_csv": read_predictions_csv,
    "write_annotations": write_annotations,
    "commit_annotations": commit_annotations,
    "unpivot_export": lambda i: sinks.unpivot_export(i.questions, "question_id"),
    "write_eval_pairs": write_eval_pairs,
    "write_transcript": write_transcript,
    "catalog_columns": lambda i: C.catalog_columns(i.catalog),
    "catalog_primary_keys": lambda i: C.catalog_primary_keys(i.catalog),
    "catalog_foreign_keys": lambda i: C.catalog_foreign_keys(i.catalog),
    "catalog_by_db": catalog_by_db,
    "catalog_rejects": lambda i: C.catalog_rejects(i.catalog),
    "catalog_summary": lambda i: C.catalog_summary(i.catalog),
    "serialize_fields": lambda i: C.serialize_fields(i.catalog),
    "serialize_primary_keys": lambda i: C.serialize_primary_keys(i.catalog),
    "serialize_foreign_keys": lambda i: C.serialize_foreign_keys(i.catalog),
    "serialize_typed_schema": lambda i: C.serialize_typed_schema(i.catalog),
    "serialize_linking_schema": lambda i: C.serialize_linking_schema(i.catalog),
    "serialize_filtered_schema": serialize_filtered_schema,
    "parse_fields": parse_fields,
    "parse_foreign_keys": lambda i: C.parse_foreign_keys(C.serialize_foreign_keys(i.catalog)),
    "question_schema": lambda i: P.question_schema(i.questions, i.catalog),
    "questions_without_schema": lambda i: P.questions_without_schema(i.questions, i.catalog),
    "baseline_prompt": lambda i: P.baseline_prompt(i.questions, i.catalog),
    "schema_link_prompt": lambda i: i.link_prompts,
    "classification_prompt": lambda i: P.classification_prompt(i.questions, i.links),
    "sql_prompt": lambda i: P.sql_prompt(i.questions, i.links, i.labels, i.catalog),
    "correction_prompt": lambda i: P.correction_prompt(i.questions, i.parsed, i.catalog),
    "inference_prompt": inference_prompt,
    "question_shards": lambda i: P.question_shards(i.questions),
    "pending_prompts": lambda i: P.pending_prompts(i.link_prompts, i.completions),
    "join_completions": lambda i: P.join_completions(i.link_prompts, i.completions),
    "pending_prompts_stored": lambda i: P.pending_prompts(*_stored_prompts(i)),
    "join_completions_stored": lambda i: P.join_completions(*_stored_prompts(i)),
    "extract_schema_links": lambda i: i.links,
    "explode_schema_links": lambda i: R.explode_schema_links(i.links),
    "schema_link_usage": lambda i: R.schema_link_usage(i.links_by_db),
    "validate_schema_links": lambda i: R.validate_schema_links(i.links_by_db, i.catalog),
    "extract_label": lambda i: i.labels,
    "extract_sub_questions": lambda i: R.extract_sub_questions(X.class_responses(i.spark, i.sf_dir), i.questions),
    "extract_reasoning_sql": lambda i: i.parsed,
    "reasoning_steps": lambda i: R.reasoning_steps(i.parsed),
    "nth_sql_block": lambda i: R.nth_sql_block(X.raw_generations(i.spark, i.sf_dir)),
    "after_sql_marker": lambda i: R.after_sql_marker(X.marked_generations(i.spark, i.sf_dir)),
    "best_beam": lambda i: R.best_beam(X.raw_generations(i.spark, i.sf_dir)),
    "invalid_sql": lambda i: R.invalid_sql(i.parsed),
    "classify_gold_sql": lambda i: R.classify_gold_sql(i.questions),
    "class_agreement": lambda i: R.class_agreement(i.labels, i.questions),
    "changed_by_correction": lambda i: R.changed_by_correction(
        i.parsed, R.extract_reasoning_sql(X.corrected_responses(i.spark, i.sf_dir))),
    "schema_item_scores": lambda i: S.schema_item_scores(i.questions, i.catalog),
    "top_k_tables": lambda i: S.top_k_tables(i.scored),
    "top_k_tables_three": lambda i: S.top_k_tables(i.scored, 3),  # a derived database holds five tables or more
    "top_k_columns": lambda i: S.top_k_columns(i.scored),
    "filtered_schema": lambda i: S.filtered_schema(i.scored),
    "top_k_columns_trained": ranked_columns,
    "top_k_tables_external": lambda i: S.external_top_tables(i.item_scores, 3),
    "top_k_columns_external": lambda i: S.external_top_columns(i.item_scores, 3, 4),
    "valid_samples": lambda i: i.valid,
    "samples_by_class": lambda i: D.samples_by_class(i.annotations),
    "sft_pairs": lambda i: D.sft_pairs(D.samples_by_class(i.valid)),
    "sft_single_text": lambda i: D.sft_single_text(D.samples_by_class(i.valid)),
    "train_eval_union": train_eval_union,
    "token_budget": lambda i: D.token_budget(D.sft_pairs(i.valid), "text", SHORT_BUDGET),
    "dataset_stats": lambda i: D.dataset_stats(i.annotations, i.scores),
    "attach_predictions": lambda i: i.attached,
    "exact_match": lambda i: E.exact_match(i.pairs),
    "execution_match": executed,
    "annotation_rejects": lambda i: annotation_rejects(
        i.questions, i.catalog, X.link_responses(i.spark, i.sf_dir), X.class_responses(i.spark, i.sf_dir),
        X.sql_responses(i.spark, i.sf_dir)),
    "typed_export": typed_export,
    "default_missing": default_missing,
    "accuracy_by_class": lambda i: _accuracy(i, E.exact_match(i.pairs)),
    "accuracy_by_class_clauses": lambda i: _accuracy(i, E.all_clauses_match(E.clause_match(i.pairs))),
    "accuracy_by_class_execution": lambda i: _accuracy(
        i, executed(i).select(F.col("query_id").alias("question_id"), F.col("matches").alias("exact"))),
    "clause_match": lambda i: E.clause_match(i.pairs),
    "success_rate": lambda i: E.success_rate(i.questions, i.annotations),
    "stream_extract": stream_extract,
    "progress_by_shard": lambda i: incremental.progress_by_shard(i.questions, i.annotations),
    "progress_by_batch": progress_by_batch,
    **{name: (lambda i, f=f: f(i.table)) for name, f in SHAPES.items()},
}


_INPUTS: WeakKeyDictionary[SparkSession, dict[str, Inputs]] = WeakKeyDictionary()


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """The (unevaluated) input plans of a folder, built once per session."""
    return _INPUTS.setdefault(spark, {}).setdefault(sf_dir, Inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(inputs(spark, sf_dir))) for name, f in OPERATORS.items()}
