"""Extraction of links, classes, reasoning and SQL from response text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_catalog, join_rows
from sqlloom.functions.text import SPACE, before, between, bound, collapse, strip, upper_keywords

# Markers the responses are asked to use.
LINK_KEY = "Schema Links:"
LINK_KEY_LENIENT = "(?:Schema Links|Schema_links):"
LABEL_MARK = 'Label: "'
SUB_QUESTION_MARK = 'questions = ["'
SQL_MARK = "[SQL]"
CLASSES = ("EASY", "NON-NESTED", "NESTED")
DEFAULT_CLASS = "NESTED"
NO_SQL = "SELECT"


# --- schema links -----------------------------------------------------------------------------

def schema_links(response: Column, lenient: bool = False) -> Column:
    """Cleaned ``[..]`` text of the first link line, ``[]`` without one."""
    key = LINK_KEY_LENIENT if lenient else LINK_KEY
    # (?md): lines end at \n only, as a split on newlines would have it
    links = strip(F.regexp_extract(response, rf"(?Umd)^[{SPACE}&&[^\n]]*+{key}(.*)$", 1))
    links = F.btrim(links, F.lit("[]()* "))
    links = F.replace(F.replace(links, F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    return F.concat(F.lit("["), F.coalesce(links, F.lit("")), F.lit("]"))


def extract_schema_links(responses: DataFrame, lenient: bool = False) -> DataFrame:
    return responses.select("question_id", schema_links(F.col("response"), lenient).alias("schema_links"))


def _unquote(link: Column) -> Column:
    return F.regexp_replace(link, r"\A(['\"])(.*)\1\z", "$2")


def link_structs(links: Column) -> Column:
    """Links as array<struct<link, kind, left_item, right_item>>.

    ``left_item``/``right_item`` are null where the link cannot name a column:
    for values and for links with more than one ``=``.
    """
    texts = F.transform(F.split(F.btrim(links, F.lit("[]")), ","), lambda x: _unquote(strip(x)))

    def one(link: Column) -> Column:
        sides = F.transform(F.split(link, "="), strip)
        is_join = F.contains(link, F.lit("="))
        is_column = F.contains(link, F.lit("."))
        return F.struct(
            link.alias("link"),
            F.when(is_join, "join").when(is_column, "column").otherwise("value").alias("kind"),
            F.when(is_join & (F.size(sides) == 2), F.get(sides, F.lit(0)))
            .when(~is_join & is_column, link).alias("left_item"),
            F.when(is_join & (F.size(sides) == 2), F.get(sides, F.lit(1))).alias("right_item"),
        )

    return F.transform(F.filter(texts, lambda x: x != ""), one)


def explode_schema_links(links: DataFrame) -> DataFrame:
    """One row per link of ``schema_links``."""
    keys = [c for c in links.columns if c != "schema_links"]
    return links.select(*keys, F.posexplode(link_structs(F.col("schema_links"))).alias("pos", "l")).select(
        *keys, "pos", "l.link", "l.kind", "l.left_item", "l.right_item"
    )


def schema_link_usage(links: DataFrame) -> DataFrame:
    """How often tables and columns are linked in each database.

    Table rows have a null ``column_name``.  Counts are combined before the
    shuffle, so a database with most of the questions costs no more than others.
    """
    items = explode_schema_links(links.select("db_id", "schema_links")).select(
        "db_id", F.explode(F.array("left_item", "right_item")).alias("item")
    )
    parts = F.split("item", r"\.")
    columns = items.where(F.size(parts) == 2).select(
        "db_id", F.get(parts, F.lit(0)).alias("table_name"), F.get(parts, F.lit(1)).alias("column_name")
    )
    return (
        columns.groupBy("db_id", "table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
        .groupingSets(
            [[F.col("db_id"), F.col("table_name"), F.col("column_name")], [F.col("db_id"), F.col("table_name")]],
            "db_id", "table_name", "column_name",
        )
        .agg(F.sum("n").alias("n_links"), F.grouping_id().alias("g"))
        .select("db_id", "table_name", "column_name",
                F.when(F.col("g") == 0, "column").otherwise("table").alias("level"), "n_links")
    )


def validate_schema_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keep only links to existing tables and columns, in order, as ``[a, b = c]``.

    ``catalog`` is the raw catalog.  Each question meets the column names of its
    own database once; the test of every link then stays inside the row.
    """
    tables = F.col("table_names_original")
    known = catalog.select(
        "db_id",
        F.filter(
            F.transform("column_names_original", lambda c: F.concat(
                F.get(tables, F.get(c, F.lit(0)).try_cast("int")), F.lit("."), F.get(c, F.lit(1)))),
            lambda c: c.isNotNull(),
        ).alias("_known"),
    )

    def exists(item: Column) -> Column:
        # a name with a further dot would not split into table and column
        return (F.size(F.split(item, r"\.")) == 2) & F.array_contains("_known", item)

    def valid(l: Column) -> Column:
        return F.coalesce(
            F.when(l["kind"] == "join", exists(l["left_item"]) & exists(l["right_item"]))
            .when(l["kind"] == "column", exists(l["left_item"])), F.lit(False))

    texts = F.transform(
        F.filter(link_structs(F.col("schema_links")), valid),
        lambda l: F.concat_ws(" = ", l["left_item"], l["right_item"]),
    )
    return join_catalog(links, known, "left").select(
        "question_id", "db_id",
        F.when(F.col("_known").isNull(), "[]").otherwise(
            F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))).alias("valid_links"),
    )


# --- class --------------------------------------------------------------------------------------

def label(response: Column) -> Column:
    return F.coalesce(between(response, LABEL_MARK, '"'), F.lit(DEFAULT_CLASS))


def norm_class(label: Column) -> Column:
    """Any label but EASY and NON-NESTED is handled as NESTED."""
    return F.when(label.isin("EASY", "NON-NESTED"), label).otherwise(DEFAULT_CLASS)


def extract_label(responses: DataFrame) -> DataFrame:
    return responses.select("question_id", label(F.col("response")).alias("classification")).withColumn(
        "class_norm", norm_class(F.col("classification"))
    )


def extract_sub_questions(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """Sub-question text of the class response, the question itself when there is none."""
    found = responses.select("question_id", between(F.col("response"), SUB_QUESTION_MARK, '"]').alias("found"))
    return join_rows(questions.select("question_id", "question"), found).select(
        "question_id", F.coalesce("found", "question").alias("sub_questions")
    )


# --- reasoning and SQL ---------------------------------------------------------------------------

def _cut(c: Column, tag: str) -> Column:
    """Text before and after the first tag, whatever its case; one part without it."""
    return F.split(c, f"(?i){tag}", 2)


def reasoning_sql(response: Column) -> Column:
    """struct<reasoning, sql, parse_status>.

    ``ok``: both blocks found; ``unclosed``: an opening tag without a full match,
    the whole response is the reasoning; ``no_tags``: neither tag.

    The first tag of each kind after the previous one is the leftmost shortest
    match, so four cuts do the work of one backtracking pattern in linear time.
    """
    def parse(tag: str) -> Column:
        first, second = F.lit(0), F.lit(1)

        def found(block: Column, sql: Column) -> Column:
            return F.when(
                F.get(sql, second).isNotNull(),
                F.struct(
                    collapse(F.get(block, first)).alias("reasoning"),
                    bound(collapse(F.get(sql, first)), upper_keywords).alias("sql"),
                    F.lit("ok").alias("parse_status"),
                ),
            ).otherwise(F.struct(
                strip(response).alias("reasoning"), F.lit(NO_SQL).alias("sql"), F.lit("unclosed").alias("parse_status"),
            ))

        return bound(_cut(F.get(_cut(response, f"<{tag}>"), second), f"</{tag}>"), lambda block: bound(
            _cut(F.get(_cut(F.get(block, second), "<SQL>"), second), "</SQL>"), lambda sql: found(block, sql)))

    return (
        F.when(F.contains(response, F.lit("<chains>")), parse("chains"))
        .when(F.contains(response, F.lit("<REASONING>")), parse("REASONING"))
        .otherwise(F.struct(
            F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("string").alias("sql"),
            F.lit("no_tags").alias("parse_status"),
        ))
    )


def has_tags(response: Column) -> Column:
    """Whether the response opens a reasoning block; cheap enough to run at the scan."""
    return F.contains(response, F.lit("<chains>")) | F.contains(response, F.lit("<REASONING>"))


def extract_reasoning_sql(responses: DataFrame) -> DataFrame:
    """``response`` replaced by ``reasoning``, ``sql`` and ``parse_status``.

    The generator keeps the extraction to one run per row: a later filter on the
    result would otherwise be pushed below it and repeat it.
    """
    keys = [c for c in responses.columns if c != "response"]
    return responses.select(*keys, F.inline(F.array(reasoning_sql(F.col("response")))))


def reasoning_steps(parsed: DataFrame) -> DataFrame:
    """Numbered steps of ``reasoning`` as rows; titles and their number are free."""
    marked = F.regexp_replace(F.col("reasoning"), r"(?:^|\s)(\d+\.\s)", "\u0001$1")
    head = r"\A(\d+)\.\s+"
    steps = F.filter(F.split(marked, "\u0001"), lambda s: s.rlike(head))
    body = F.regexp_replace(F.col("s"), head, "")
    has_title = body.rlike(r"\A[^:]+:")
    return parsed.select("question_id", F.posexplode(steps).alias("pos", "s")).select(
        "question_id", "pos",
        F.regexp_extract("s", head, 1).try_cast("int").alias("step_no"),
        F.when(has_title, F.trim(before(body, ":"))).alias("title"),
        F.trim(F.when(has_title, F.regexp_replace(body, r"\A[^:]+:", "")).otherwise(body)).alias("step_text"),
    )


def nth_sql_block(outputs: DataFrame, n: int = 3) -> DataFrame:
    """The n-th ``<SQL>`` block of ``output`` or null; the tag is case-sensitive.

    Each closing tag ends one block at most, which starts at the first opening
    tag since the closing tag before; so two splits find all blocks in linear time.
    """
    keys = [c for c in outputs.columns if c != "output"]
    pieces = F.split("output", "</SQL>")
    closed = F.slice(pieces, 1, F.size(pieces) - 1)
    blocks = F.filter(F.transform(closed, lambda p: F.get(F.split(p, "<SQL>", 2), F.lit(1))), lambda b: b.isNotNull())
    return outputs.select(*keys, strip(F.get(blocks, F.lit(n - 1))).alias("model_predicted_sql"))


def after_sql_marker(outputs: DataFrame) -> DataFrame:
    """Text after the last ``[SQL]`` up to the next ``[``, on one line."""
    keys = [c for c in outputs.columns if c != "output"]
    tail = before(F.substring_index("output", SQL_MARK, -1), "[")
    return outputs.select(*keys, strip(F.replace(tail, F.lit("\n"), F.lit(" "))).alias("generated_sql"))


def best_beam(candidates: DataFrame) -> DataFrame:
    """Output of the lowest beam of each question; combined before the shuffle."""
    return candidates.groupBy("question_id").agg(
        F.min("beam").alias("beam"), F.min_by("output", "beam").alias("output")
    )


def invalid_sql(parsed: DataFrame) -> DataFrame:
    """Rows whose SQL is missing, empty or the bare word the parser falls back to."""
    return parsed.where(F.coalesce(F.col("sql"), F.lit("")).isin("", NO_SQL))


def sql_class(sql: Column) -> Column:
    """Class by the rule on the query text; string literals do not count."""
    bare = F.regexp_replace(sql, "'[^']*'", "''")
    return (
        F.when(bare.rlike(r"(?i)\b(INTERSECT|UNION|EXCEPT)\b|\(\s*SELECT\b"), "NESTED")
        .when(bare.rlike(r"(?i)\bJOIN\b"), "NON-NESTED")
        .otherwise("EASY")
    )


def classify_gold_sql(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "query", sql_class(F.col("query")).alias("sql_class"))


def class_agreement(labels: DataFrame, questions: DataFrame) -> DataFrame:
    """Predicted class against the class of the gold query, counted."""
    rule = classify_gold_sql(questions).select("question_id", "sql_class")
    return (
        join_rows(labels.select("question_id", "classification"), rule)
        .groupBy("classification", "sql_class").agg(F.count(F.lit(1)).alias("n_questions"))
    )


def changed_by_correction(first: DataFrame, corrected: DataFrame) -> DataFrame:
    """Questions whose SQL differs after correction; a missing SQL counts as a value."""
    return (
        join_rows(first.select("question_id", F.col("sql").alias("first_sql")),
                  corrected.select("question_id", F.col("sql").alias("corrected_sql")))
        .where(~F.col("first_sql").eqNullSafe(F.col("corrected_sql")))
    )
