"""A trained ranking of schema items: logistic regression over linked and not linked items of answered questions.

The labels are the validated schema links; an item is a table or a column of the question's database.  Training reads the
links of all questions it is given; the fitted weights are some hundred numbers, and the score of an item is a column expression inside the
row of its question, in the form of ``schema_filter.scored_items``, so all cuts and texts of that module take it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_catalog, join_rows, once
from sqlloom.operators.extract import link_structs, validate_schema_links
from sqlloom.operators.schema_filter import TOP_COLUMNS, _weighted_items, best, score_items
from sqlloom.session import scratch_dir

#: Of equal training rows so many are fitted as one that it weighs no more than one in ``PIECES`` of all.
PIECES = 1 << 20
ROWS_PER_TASK = 50_000  # training rows of a task, beyond one task a core
#: Weights for hashed tokens of names.
TOKEN_WEIGHTS = 128
#: Numeric features, in the order of ``_numbers``; ``ASKED`` depend on the question.
NUMBERS = ("is_table", "overlap", "any_overlap", "table_overlap", "nearness", "primary_key", "foreign_key", "number", "text", "time")
ASKED = ("overlap", "any_overlap", "table_overlap")


@dataclass(frozen=True)
class ItemRanker:
    """Weights of the numeric features, weights by token hash, and the intercept."""

    numbers: tuple[float, ...]
    tokens: tuple[float, ...]
    intercept: float


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _hashes(table: Column, column: Column | None, n: int) -> Column:
    """Places of the distinct tokens of an item, of its table's name and of both names as a whole."""
    kind, column = ("t", F.lit(None).cast("string")) if column is None else ("c", column)
    words = F.filter(F.split(F.lower(F.coalesce(column, table, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    marked = F.array_union(
        F.transform(words, lambda w: F.concat(F.lit(f"{kind}:"), w)),
        F.array(F.concat(F.lit(f"{kind}/"), F.lower(F.coalesce(table, F.lit(""))), F.lit("."), F.lower(F.coalesce(column, F.lit(""))))))
    return F.array_distinct(F.transform(marked, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int")))


def _asked_numbers(t: Column, own: Column) -> tuple[Column, Column, Column]:
    """The numeric features of an item of table ``t`` that depend on the question, in the order of ``ASKED``."""
    return own["score"], (own["score"] > 0).cast("double"), t["score"]


def _plain_numbers(position: Column, c: Column | None) -> dict[str, Column]:
    """The numeric features that do not depend on the question."""
    def typed(name: str) -> Column:
        return F.lit(0.0) if c is None else _flag(F.get("column_types", c["col_idx"]) == name)

    def key(holds: Column | None) -> Column:
        return F.lit(0.0) if holds is None else _flag(holds)

    return {
        "is_table": F.lit(1.0 if c is None else 0.0), "nearness": F.lit(1.0) / (position + 1),
        "primary_key": key(None if c is None else F.array_contains("primary_keys", c["col_idx"])),
        "foreign_key": key(None if c is None else F.array_contains("_linked_keys", c["col_idx"])),
        "number": typed("number"), "text": typed("text"), "time": typed("time")}


def _known(catalog: DataFrame) -> DataFrame:
    return catalog.select("db_id", "column_types", "primary_keys", F.flatten("foreign_keys").alias("_linked_keys"))


def _with_fixed(catalog: DataFrame, fixed: Callable[[Column, Column, Column | None], list[Column]], **literals: Column) -> DataFrame:
    """Weighted items with the fields ``fixed`` gives for a table, or for its column, at a position.

    These do not depend on a question and are worked out once a database; ``literals`` are columns that ``fixed`` may name.
    """
    known = join_catalog(_weighted_items(catalog), _known(catalog))
    known = once(known, **literals) if literals else known
    items = F.transform("items", lambda t, i: F.struct(
        t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"), t["tokens"].alias("tokens"), *fixed(t, i, None),
        F.transform(t["columns"], lambda c, j: F.struct(
            c["col_idx"].alias("col_idx"), c["column_name"].alias("column_name"), c["tokens"].alias("tokens"), *fixed(t, j, c))).alias("columns")))
    return once(known, fixed=items).select("db_id", "foreign_keys_text", F.col("fixed").alias("items"))


def _with_features(questions: DataFrame, catalog: DataFrame, n_tokens: int, along: tuple[str, ...] = ()) -> DataFrame:
    """``items`` with the features ``x`` and token places ``h`` of each table and column; no shuffle of items.

    ``along`` names columns of the questions that go with them.
    """
    def fixed(t: Column, position: Column, c: Column | None) -> list[Column]:
        plain = _plain_numbers(position, c)
        return [F.array(*[plain[n] for n in NUMBERS if n not in ASKED]).alias("x"),
                _hashes(t["table_name"], None if c is None else c["column_name"], n_tokens).alias("h")]

    def features(t: Column, own: Column) -> list[Column]:
        asked = dict(zip(ASKED, _asked_numbers(t, own)))
        plain = {n: F.get(own["x"], F.lit(k)) for k, n in enumerate(n for n in NUMBERS if n not in ASKED)}
        return [F.array(*[(asked | plain)[n] for n in NUMBERS]).alias("x"), own["h"].alias("h")]

    items = F.transform("items", lambda t: F.struct(
        t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"), *features(t, t),
        F.transform(t["columns"], lambda c: F.struct(
            c["col_idx"].alias("col_idx"), c["column_name"].alias("column_name"), *features(t, c))).alias("columns")))
    rows = score_items(questions, _with_fixed(catalog, fixed), "x", "h", along=along)
    return once(rows, featured=items).select("question_id", "db_id", *along, "foreign_keys_text", F.col("featured").alias("items"))


def linked_items(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """``table.column`` of every valid link of a question, as one array; questions without links keep an empty one."""
    valid = validate_schema_links(links, catalog).select("question_id", link_structs(F.col("valid_links")).alias("l"))
    both = F.flatten(F.transform("l", lambda l: F.array(l["left_item"], l["right_item"])))
    return valid.select("question_id", F.array_distinct(F.filter(both, lambda i: i.isNotNull())).alias("linked"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written to the scratch folder and read back, for what is read several times."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _labelled_items(questions: DataFrame, catalog: DataFrame, links: DataFrame, n_questions: int | None, n_tokens: int) -> DataFrame:
    """``label``, features ``x`` and token places ``h`` of each item of the questions with a valid link."""
    taught = linked_items(links, catalog).where(F.size("linked") > 0)
    if n_questions is not None:
        taught = _stored(taught.orderBy(F.xxhash64("question_id"), "question_id").limit(n_questions), "sample")
        questions = join_rows(questions, taught.select("question_id").distinct(), how="left_semi")
    rows = _with_features(join_rows(questions, taught), catalog, n_tokens, ("linked",))

    def labelled(item: Column, label: Column) -> Column:
        return F.struct(F.coalesce(label, F.lit(False)).cast("double").alias("label"), item["x"].alias("x"), item["h"].alias("h"))

    def of_table(t: Column) -> Column:
        table = labelled(t, F.exists("linked", lambda l: F.startswith(l, F.concat(t["table_name"], F.lit(".")))))
        return F.concat(F.array(table), F.transform(t["columns"], lambda c: labelled(
            c, F.array_contains("linked", F.concat_ws(".", t["table_name"], c["column_name"])))))

    return rows.select(F.inline(F.flatten(F.transform("items", of_table))))


def _as_vectors(rows: DataFrame, n_tokens: int) -> DataFrame:
    """``x`` and ``h`` as one vector ``features``, sparse where that is smaller; no Python per row."""
    places = F.transform(F.sequence(F.lit(0), F.lit(n_tokens - 1)), lambda p: F.array_contains("h", p).cast("double"))
    size = {"ml_attr": {"num_attrs": len(NUMBERS) + n_tokens}}  # else the assembler reads a row to learn it
    dense = rows.withColumn("_dense", array_to_vector(F.concat("x", places)).alias("_dense", metadata=size))
    return VectorAssembler(inputCols=["_dense"], outputCol="features").transform(dense).drop("x", "h", "_dense")


def training_rows(questions: DataFrame, catalog: DataFrame, links: DataFrame,
                  n_questions: int | None = None, n_tokens: int = TOKEN_WEIGHTS) -> DataFrame:
    """``label`` and ``features`` of each item of the questions that have a valid link.

    ``links`` has question_id, db_id and schema_links.  Questions without a valid link teach nothing and are left out.  All others
    are taken, unless a caller asks for ``n_questions``; which these are follows from their ids alone.
    """
    return _as_vectors(_labelled_items(questions, catalog, links, n_questions, n_tokens), n_tokens)


def fit_ranker(questions: DataFrame, catalog: DataFrame, links: DataFrame, n_questions: int | None = None,
               n_tokens: int = TOKEN_WEIGHTS, regularisation: float = 1e-4, rounds: int = 50) -> ItemRanker:
    """Weights by gradient descent over the training rows, which stay distributed.

    Equal rows are stored once with their number, so questions of one database that ask for the same items cost one row an item.  They are
    fitted as rows of bounded weight: Spark's scale of a feature, and with it what the rounds arrive at, depends on how uneven weights are.
    Where no item is linked, or every one, there is nothing to tell apart and all weights are zero: every item then scores one half.
    """
    counted = _stored(_labelled_items(questions, catalog, links, n_questions, n_tokens).groupBy("label", "x", "h").agg(
        F.count(F.lit(1)).alias("n")), "training")
    seen = counted.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()  # two labels at most
    if len(seen) < 2:
        return ItemRanker((0.0,) * len(NUMBERS), (0.0,) * n_tokens, 0.0)
    heaviest = max(1, sum(r["n"] for r in seen) // PIECES)
    pieces = F.ceil(F.col("n") / heaviest).cast("int")
    weighted = _as_vectors(counted, n_tokens).select(
        "label", "features", F.explode(F.array_repeat(F.col("n") / pieces, pieces)).alias("weight"))
    most = sum(r["rows"] + r["n"] // heaviest for r in seen)
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS_PER_TASK))
    rows = _stored(weighted.repartition(tasks), "vectors")
    fitted = LogisticRegression(regParam=regularisation, maxIter=rounds, weightCol="weight").fit(rows)
    weights = [float(w) for w in fitted.coefficients.toArray()]
    return ItemRanker(tuple(weights[:len(NUMBERS)]), tuple(weights[len(NUMBERS):]), float(fitted.intercept))


def ranked_items(questions: DataFrame, catalog: DataFrame, ranker: ItemRanker) -> DataFrame:
    """As ``schema_filter.scored_items``, with the chance that an item is linked as its score (six decimals).

    Feed it to ``top_k_tables``, ``top_k_columns`` or ``filtered_schema``.  Questions of unknown databases are left out,
    null names score by their other features, and equal scores go by position there.
    """
    n = len(ranker.tokens)
    weights = dict(zip(NUMBERS, ranker.numbers))

    def fixed(t: Column, position: Column, c: Column | None) -> list[Column]:
        """What an item adds up to whatever the question is."""
        total = F.lit(ranker.intercept)
        for name, x in _plain_numbers(position, c).items():
            total = total + x * F.lit(weights[name])
        places = _hashes(t["table_name"], None if c is None else c["column_name"], n)
        return [F.aggregate(places, total, lambda acc, p: acc + F.get("_weights", p)).alias("fixed")]

    weighed = _with_fixed(catalog, fixed, _weights=F.array(*[F.lit(w) for w in ranker.tokens]))

    def score(t: Column, own: Column) -> Column:
        total = own["fixed"]
        for name, x in zip(ASKED, _asked_numbers(t, own)):
            total = total + x * F.lit(weights[name])
        return F.round(F.lit(1.0) / (F.exp(-total) + 1), 6).alias("score")

    items = F.transform("items", lambda t: F.struct(
        t["tab_idx"].alias("tab_idx"), t["table_name"].alias("table_name"), score(t, t),
        F.transform(t["columns"], lambda c: F.struct(
            c["col_idx"].alias("col_idx"), c["column_name"].alias("column_name"), score(t, c))).alias("columns")))
    return once(score_items(questions, weighed, "fixed"), scored=items).select(
        "question_id", "db_id", "foreign_keys_text", F.col("scored").alias("items"))


def best_columns(scored: DataFrame, k: int = TOP_COLUMNS) -> DataFrame:
    """The k best columns of a question over all tables of its database, ties by position."""
    columns = F.flatten(F.transform("items", lambda t: F.transform(t["columns"], lambda c: F.struct(
        t["table_name"].alias("table_name"), c["col_idx"].alias("col_idx"), c["column_name"].alias("column_name"), c["score"].alias("score")))))
    return once(scored, _best=best(columns, "col_idx", k)).select("question_id", F.posexplode("_best").alias("pos", "c")).select(
        "question_id", (F.col("pos") + 1).alias("column_rank"), "c.table_name", "c.column_name", "c.score")


def recall_at(cut: DataFrame, links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Linked columns, and how many of them a cut (``table_name``, ``column_name`` per question) holds: one row.

    Questions without a valid link have nothing to find and do not count.
    """
    wanted = linked_items(links, catalog).select("question_id", F.explode("linked").alias("item"))
    kept = cut.select("question_id", F.concat_ws(".", "table_name", "column_name").alias("item")).distinct().withColumn("hit", F.lit(1))
    return join_rows(wanted, kept, ["question_id", "item"], "left").agg(
        F.count(F.lit(1)).alias("n_linked"), F.count("hit").alias("n_found")).select(
        "n_linked", "n_found", F.round(F.try_divide(F.col("n_found"), F.col("n_linked")), 4).alias("recall"))
