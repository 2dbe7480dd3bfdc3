"""Scoring of predicted queries against gold queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.arrays import let
from sqlloom.functions.relational import join_rows
from sqlloom.functions.text import normalise_sql, outside_literals
from sqlloom.operators.execution import execution_match  # noqa: F401


def attach_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions back onto their rows by key; rows without one keep a null."""
    return join_rows(rows, predictions.select("question_id", "model_predicted_sql"), how="left")


def exact_match(pairs: DataFrame) -> DataFrame:
    """Whether ``gold_sql`` and ``pred_sql`` agree after normalisation."""
    keys = [c for c in pairs.columns if c not in ("gold_sql", "pred_sql")]
    return pairs.select(
        *keys, normalise_sql(F.col("gold_sql")).alias("gold_norm"), normalise_sql(F.col("pred_sql")).alias("pred_norm")
    ).withColumn("exact", F.coalesce(F.col("gold_norm") == F.col("pred_norm"), F.lit(False)))


def typed_export(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats truncated to bigint, NaN and out-of-range values null."""
    def out(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c), F.expr(f"try_cast(`{name}` AS bigint)"))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("bigint")
        return c.alias(name)

    return df.select(*[out(name, kind) for name, kind in df.dtypes])


def default_missing(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Default text for null cells and for columns that are absent."""
    for name, text in defaults.items():
        value = F.coalesce(F.col(name), F.lit(text)) if name in rows.columns else F.lit(text)
        rows = rows.withColumn(name, value)
    return rows


def accuracy_by_class(matches: DataFrame) -> DataFrame:
    """Accuracy per class, per database and in total, from ``classification, db_id, exact``."""
    return (
        matches.groupingSets([["classification"], ["db_id"], []], "classification", "db_id")
        .agg(
            F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("exact"), 1)).alias("n_match"),
        )
        .select(
            F.when(F.col("g") == 1, "class").when(F.col("g") == 2, "database").otherwise("total").alias("level"),
            "classification", "db_id", "n", "n_match",
            F.round(F.col("n_match") / F.col("n"), 6).alias("accuracy"),
        )
    )


# Clauses of the result; ``nested`` holds the parts of sub-queries, ``set`` those behind a set operation.
CLAUSES = ("select", "from", "where", "group", "having", "order", "connective", "set", "nested")
# Tokens of a lower-cased query that are no plain words, by kind; an opening brace with SELECT is a ``query``.
_TOKENS = {
    "open": ["("], "close": [")"], "comma": [","], "connective": ["and", "or"], "join": ["join"],
    "clause": ["select", "from", "where", "group by", "having", "order by", "limit"], "set": ["union", "union all", "intersect", "except"],
}
_TOKEN = r"\(\s*+select\b|[(),]|\b(?:group by|order by|union all)\b|[^\s(),]++"
_FRAME = "struct<path:string,clause:string,kind:string,text:string>"
_PART = "struct<path:string,clause:string,text:string>"


def _comparable(sql: Column) -> Column:
    """Lower-cased query whose literals are written in hexadecimal and whose BETWEEN holds no AND.

    So neither a literal nor a range can be taken for a clause, a connective or a separator.
    """
    masked = outside_literals(normalise_sql(sql), F.lower, F.hex)
    return F.regexp_replace(masked, r" between (\S+) and ", " between $1 ~ ")


def _tokens(query: Column) -> Column:
    """Array of (kind, text)."""
    def kind(t: Column) -> Column:
        out = F.when(t.endswith("select") & t.startswith("("), "query")
        for name, words in _TOKENS.items():
            out = out.when(t.isin(words), name)
        return out.otherwise("word")

    return F.transform(F.regexp_extract_all(query, F.lit(_TOKEN), F.lit(0)), lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))


def _query_parts(query: Column) -> Column:
    """Array of (path, clause, text) of a comparable query: one pass over its tokens with a stack.

    The state is the open frame, the frames around it and the parts so far.  A frame is a query, a condition in
    parentheses, or other parentheses, whose text belongs to the part around them.  Each part carries the path of its query: the clauses that
    sub-queries stand in, the set operations before it and the parentheses of conditions.  A query in
    parentheses that begins the text, or follows a set operation, is no sub-query.
    """
    none = F.array().cast(f"array<{_PART}>")

    def frame(path: Column, clause: Column, kind: Column, text: Column) -> Column:
        return F.struct(path.alias("path"), clause.alias("clause"), kind.alias("kind"), text.alias("text"))

    def state(top: Column, stack: Column, out: Column) -> Column:
        return F.struct(top.alias("top"), stack.alias("stack"), out.alias("out"))

    def part(path: Column, clause: Column, text: Column) -> Column:
        return F.array(F.struct(path.alias("path"), clause.alias("clause"), text.alias("text")))

    def flushed(s: Column) -> Column:
        return F.when(s["top"]["text"] != "", F.concat(s["out"], part(s["top"]["path"], s["top"]["clause"], s["top"]["text"]))).otherwise(s["out"])

    def longer(text: Column, more: Column | str) -> Column:
        return F.ltrim(F.concat_ws(" ", text, F.lit(more) if isinstance(more, str) else more))

    def step(s: Column, token: Column) -> Column:
        path, clause, kind, text = (s["top"][f] for f in ("path", "clause", "kind", "text"))
        word, blank = token["text"], F.lit("")
        is_query = kind == "query"
        in_conditions = (kind != "other") & clause.isin("where", "having")
        follows = clause.isin("", "set") & is_query
        around = F.when(follows, s["top"]).otherwise(frame(path, clause, kind, longer(text, "(query)")))
        as_word = state(frame(path, clause, kind, longer(text, word)), s["stack"], s["out"])
        return (
            F.when(token["kind"] == "word", F.when((word == "distinct") & is_query & (clause == "select") & (text == ""), state(
                s["top"], s["stack"], F.concat(s["out"], part(path, clause, word)))).otherwise(as_word))
            .when(token["kind"] == "query", state(
                frame(F.when(follows, path).otherwise(F.concat(path, clause, F.lit("/"))), F.lit("select"), F.lit("query"), blank),
                F.concat(s["stack"], F.array(around)), s["out"]))
            .when((token["kind"] == "open") & in_conditions & text.isin("", "not"), state(
                frame(F.concat(path, text, F.lit("(")), clause, F.lit("condition"), blank),
                F.concat(s["stack"], F.array(frame(path, clause, kind, blank))), s["out"]))
            .when(token["kind"] == "open", state(
                frame(path, clause, F.lit("other"), longer(text, "(")), F.concat(s["stack"], F.array(s["top"])), s["out"]))
            .when((token["kind"] == "close") & (F.size(s["stack"]) > 0), F.transform(F.array(F.element_at(s["stack"], -1)), lambda o: state(
                F.when(kind == "other", frame(o["path"], o["clause"], o["kind"], longer(text, ")"))).otherwise(o),
                F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1), F.when(kind == "other", s["out"]).otherwise(flushed(s))))[0])
            .when(token["kind"] == "close", s)  # one too many
            .when(((token["kind"] == "comma") & is_query & clause.isin("select", "from", "group by", "order by")) | ((token["kind"] == "join") & is_query & (clause == "from")),
                  state(frame(path, clause, kind, blank), s["stack"], flushed(s)))
            .when((token["kind"] == "connective") & in_conditions, state(
                frame(path, clause, kind, blank), s["stack"], F.concat(flushed(s), part(path, F.lit("connective"), word))))
            .when((token["kind"] == "clause") & is_query, state(frame(path, word, kind, blank), s["stack"], flushed(s)))
            .when((token["kind"] == "set") & is_query, state(
                frame(F.concat(path, word, F.lit("/")), F.lit("set"), kind, blank), s["stack"], F.concat(flushed(s), part(path, F.lit("set"), word))))
            .otherwise(as_word)
        )

    start = state(frame(*[F.lit(v) for v in ("", "", "query", "")]), F.array().cast(f"array<{_FRAME}>"), none)
    return F.aggregate(_tokens(query), start, step, flushed)


def _clause_parts(query: Column) -> Column:
    """Array of (clause, distinct parts) of a comparable query.

    The clauses of the outer query come first.  A part behind a set operation belongs to ``set`` and one of a sub-query to
    ``nested``, each with its path and clause, so these are compared part by part, too.  DISTINCT is a part of the select clause and the
    connectives of WHERE and HAVING are a clause, so that the order of conditions does not count.
    """
    def placed(p: Column) -> Column:
        place = F.when(F.contains(p["path"], F.lit("/")) & p["path"].rlike("(select|from|where|group by|having|order by|limit)/"), "nested").when(
            F.contains(p["path"], F.lit("/")), "set").otherwise(F.substring_index(p["clause"], " ", 1))
        text = F.concat(p["path"], F.when(place.isin("nested", "set"), F.concat(p["clause"], F.lit(" "))).otherwise(""), p["text"])
        return F.struct(place.alias("clause"), text.alias("text"))

    def of(parts: Column, name: str) -> Column:
        own = F.transform(F.filter(parts, lambda p: p["clause"] == name), lambda p: p["text"])
        return F.struct(F.lit(name).alias("clause"), F.array_distinct(own).alias("parts"))

    return let(F.transform(_query_parts(query), placed), lambda parts: F.array(*[of(parts, n) for n in CLAUSES]))


def clause_match(pairs: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every clause's parts; a clause absent on both sides is a match."""
    clauses = F.zip_with(
        _clause_parts(F.col("g")), _clause_parts(F.col("p")),
        lambda g, p: F.struct(g["clause"].alias("clause"), g["parts"].alias("gold"), p["parts"].alias("pred")))
    both = F.size(F.array_intersect("c.gold", "c.pred"))
    n_gold, n_pred = F.size("c.gold"), F.size("c.pred")
    empty = (n_gold == 0) & (n_pred == 0)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.round(F.when(empty, 1.0).when(bottom == 0, 0.0).otherwise(top / bottom), 6)

    return (
        pairs.select(
            "question_id", _comparable(F.col("gold_sql")).alias("g"),
            _comparable(F.coalesce("pred_sql", F.lit(""))).alias("p"))
        .select("question_id", F.explode(clauses).alias("c"))
        .select(
            "question_id", "c.clause",
            ratio(both, n_pred).alias("precision"), ratio(both, n_gold).alias("recall"),
            ratio(2 * both, n_gold + n_pred).alias("f1"),
        )
    )


def all_clauses_match(clauses: DataFrame) -> DataFrame:
    """``exact`` for every question of ``clause_match``: whether each of its clauses agrees."""
    return clauses.groupBy("question_id").agg((F.min("f1") == 1).alias("exact"))


def success_rate(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Questions asked, questions answered, and their ratio in percent (0 without questions)."""
    done = annotations.select("question_id").distinct().withColumn("done", F.lit(1))
    return (
        join_rows(questions.select("question_id"), done, how="left")
        .agg(F.count(F.lit(1)).alias("n_asked"), F.count("done").alias("n_generated"))
        .withColumn("success_rate", F.round(
            F.when(F.col("n_asked") == 0, 0.0).otherwise(F.col("n_generated") * 100.0 / F.col("n_asked")), 4))
    )
