"""Input tables derived from the star-schema tables, so that they grow with them.

See FIXTURES.md for the recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlloom.functions.relational import join_catalog, once
from sqlloom.functions.text import render

# The relational tables every derived database draws from.
TABLES: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "number"), ("r_name", "text")],
    "nation": [("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")],
    "customer": [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"),
                 ("c_acctbal", "number"), ("c_mktsegment", "text")],
    "supplier": [("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number"), ("s_acctbal", "number")],
    "part": [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
             ("p_size", "number"), ("p_retailprice", "number")],
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
               ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"),
                 ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"),
                 ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"),
                 ("l_linestatus", "text"), ("l_shipdate", "time")],
    "events": [("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"),
               ("value", "number"), ("props", "text")],
}
PRIMARY_KEYS = [
    "region.r_regionkey", "nation.n_nationkey", "customer.c_custkey", "supplier.s_suppkey", "part.p_partkey",
    "orders.o_orderkey", "lineitem.l_orderkey", "lineitem.l_linenumber", "events.event_id",
]
FOREIGN_KEYS = [
    ("nation.n_regionkey", "region.r_regionkey"),
    ("customer.c_nationkey", "nation.n_nationkey"),
    ("supplier.s_nationkey", "nation.n_nationkey"),
    ("orders.o_custkey", "customer.c_custkey"),
    ("lineitem.l_orderkey", "orders.o_orderkey"),
    ("lineitem.l_partkey", "part.p_partkey"),
    ("lineitem.l_suppkey", "supplier.s_suppkey"),
]


ROWS_PER_TASK = 50_000  # rows of a table before it is expanded


def tasks_for(df: DataFrame) -> int:
    """Tasks for a plain table by its rows, which are counted from the footers of its files."""
    return -(-df.count() // ROWS_PER_TASK)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table by its keys before it is expanded, over as many partitions as its rows need, one per core at least.

    Splits of a file say little about rows, which come in whole row groups; so these are counted.
    What is expanded, sorted or joined by these keys later stays in these partitions, whose size does not grow with the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, tasks_for(df)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _template() -> Column:
    """The tables as one array literal."""
    def table(t: int, name: str, cols: list[tuple[str, str]]) -> str:
        pairs = ", ".join(f"struct('{c}' AS name, '{kind}' AS type)" for c, kind in cols)
        return f"struct({t} AS t, '{name}' AS name, array({pairs}) AS cols)"

    return F.expr("array(" + ", ".join(table(t, n, c) for t, (n, c) in enumerate(TABLES.items())) + ")")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one nested database record per customer."""
    key = F.col("c_custkey")
    kept = F.filter(_template(), lambda t: (key + t["t"]) % 3 != 0)
    base = once(spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), kept=kept)
    base = once(base, flat=F.flatten(F.transform("kept", lambda t: F.transform(
        t["cols"], lambda c: F.concat(t["name"], F.lit("."), c["name"])))))

    def pos(name: Column) -> Column:
        return F.array_position("flat", name).cast("int")

    pks = F.transform(
        F.filter(F.array(*map(F.lit, PRIMARY_KEYS)), lambda k: F.array_contains("flat", k)), pos)
    fks = F.transform(
        F.filter(
            F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in FOREIGN_KEYS]),
            lambda k: F.array_contains("flat", k["l"]) & F.array_contains("flat", k["r"])),
        lambda k: F.array(pos(k["l"]), pos(k["r"])))
    bad = key % 50
    none = F.array().cast("array<int>")
    none2 = F.array().cast("array<array<int>>")
    record = {
        "db_id": F.concat(F.lit("db_"), key.cast("string")),
        "table_names_original": F.transform("kept", lambda t: t["name"]),
        "column_names_original": F.concat(
            F.array(F.array(F.lit("-1"), F.lit("*"))),
            F.flatten(F.transform("kept", lambda t, i: F.transform(
                t["cols"], lambda c: F.array(i.cast("string"), c["name"])))),
        ),
        "column_types": F.concat(
            F.array(F.lit("text")),
            F.flatten(F.transform("kept", lambda t: F.transform(t["cols"], lambda c: c["type"]))),
        ),
        "primary_keys": F.concat(pks, F.when(bad == 0, F.array(F.lit(999))).otherwise(none)),
        "foreign_keys": F.concat(
            fks,
            F.when(bad == 1, F.array(F.array(F.lit(999), F.lit(1))))
            .when(bad == 2, F.array(F.array(F.lit(0), F.lit(1)))).otherwise(none2),
        ),
    }
    return once(base, **record).select(*record)


# Question and gold query per event type; {u} is the user id.
QUESTION_TEMPLATES = {
    "click": ("How many rows of customer have c_acctbal above {u}?",
              "SELECT COUNT(*) FROM customer WHERE c_acctbal > {u}"),
    "error": ("Which o_custkey of orders has more than {u} rows?",
              "SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > {u}"),
    "view": ("List c_name of customer for orders with o_totalprice above {u}.",
             "SELECT customer.c_name FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey "
             "WHERE orders.o_totalprice > {u}"),
    "signup": ("Which supplier s_name has s_acctbal above the mean of nation {u}?",
               "SELECT s_name FROM supplier WHERE s_acctbal > "
               "(SELECT AVG(s_acctbal) FROM supplier WHERE s_nationkey = {u})"),
    "purchase": ("Which customer c_name has no orders with o_totalprice above {u}?",
                 "SELECT c_name FROM customer WHERE c_custkey NOT IN "
                 "(SELECT o_custkey FROM orders WHERE o_totalprice > {u})"),
}


def _by_type(pick: int) -> Column:
    u = F.col("user_id").cast("string")
    out = None
    for kind, texts in QUESTION_TEMPLATES.items():
        cond = F.col("event_type") == kind
        value = render(texts[pick], u=u)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("question_id"), "user_id", "event_type")
    return spread(events, "question_id")


def _row_count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: one question with its gold query per event."""
    qid = F.col("question_id")
    n = _row_count(table(spark, sf_dir, "customer"))
    return _events(spark, sf_dir).select(
        "question_id",
        F.when(qid % 97 == 0, "db_missing").otherwise(
            F.concat(F.lit("db_"), (qid % n).cast("string"))).alias("db_id"),
        _by_type(0).alias("question"),
        _by_type(1).alias("query"),
    )


# Model answers by question_id modulo their number.
LINK_RESPONSES = [
    "The question needs two tables.\nSchema Links: [customer.c_name, orders.o_custkey = customer.c_custkey]",
    "Reading the question.\n  **note**\nSchema Links: **[`orders.o_custkey`, `orders.o_totalprice`]**\nDone.",
    "Schema Links: (supplier.s_name, supplier.s_acctbal)",
    "Schema_links: [customer.c_acctbal]",
    "No links could be found for this question.",
    "Schema Links: [customer.c_acctbal, 50, customer.shoe_size, customer.*, "
    "orders.o_custkey = customer.c_custkey = lineitem.l_orderkey, nation.n_regionkey = region.r_regionkey]",
]
CLASS_RESPONSES = [
    'One table is enough, so no join is needed. questions = [""]\nLabel: "EASY"',
    'Two tables have to be joined. questions = [""]\nLabel: "NON-NESTED"',
    'A list must be excluded. questions = ["Which customers ordered for more than {u}?"]\nLabel: "NESTED"',
    'This one is unusual. questions = ["What is the mean of {u}?"]\nLabel: "HARD"',
    "I am not sure about the class.",
]
SQL_RESPONSES = [
    "Thinking.\n<chains>\n1. Sequential Structure: Start with SELECT on customer.\n"
    "2. Condition Structure: Keep balances above {u}.\n3. Join Structure: None.\n"
    "4. Aggregation Structure: Use COUNT.\n</chains>\n<SQL>\nselect count(*)\nfrom customer\n"
    "where c_acctbal > {u};\n</SQL>",
    "<REASONING> 1. Sequential Structure: Read orders.  2. Grouping Structure: One group per o_custkey. </REASONING>"
    "\nThe query is:\n<sql>SELECT o_custkey, count(*) FROM orders\n  group by o_custkey having COUNT(*) > {u}</sql>",
    "<REASONING>1. Draft: not final</REASONING>\n<chains>1. Join Structure: customer with orders.\n"
    "2. Ordering Structure: By o_totalprice.</chains><SQL>Select customer.c_name From customer Join orders "
    "On customer.c_custkey = orders.o_custkey Order By o_totalprice Limit {u}</SQL>",
    "  <chains> 1. Sequential Structure: the answer was cut at {u}\n",
    "SELECT s_name FROM supplier WHERE s_acctbal > {u}",
    "<chains></chains> first <SQL> SELECT </SQL> then <SQL>SELECT c_name FROM customer</SQL>",
]
_CORRECTED = (
    "<REASONING> 1. Check: one condition was missing. </REASONING>"
    "<SQL>SELECT COUNT(*) FROM customer WHERE c_acctbal > {u} AND c_nationkey = 1</SQL>"
)


def _pick(texts: list[str], n: int | None = None) -> Column:
    """The text chosen by question_id, with the user id filled in."""
    chosen = F.element_at(
        F.array(*[F.lit(t) for t in texts]), (F.col("question_id") % len(texts) + 1).cast("int"))
    return F.replace(chosen, F.lit("{u}"), F.col("user_id").cast("string"))


def _responses(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    return _events(spark, sf_dir).select("question_id", _pick(texts).alias("response"))


def link_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3."""
    return _responses(spark, sf_dir, LINK_RESPONSES)


def class_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4."""
    return _responses(spark, sf_dir, CLASS_RESPONSES)


def sql_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5."""
    return _responses(spark, sf_dir, SQL_RESPONSES)


def corrected_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5 after a correction round: every fourth answer changed, every fifth without an answer."""
    qid = F.col("question_id")
    fixed = F.replace(F.lit(_CORRECTED), F.lit("{u}"), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select(
        "question_id",
        F.when(qid % 4 == 0, fixed).when(qid % 5 == 1, "").otherwise(_pick(SQL_RESPONSES)).alias("response"),
    )


def raw_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: four beams per question; the prompt echo already holds two SQL blocks."""
    qid, beam = F.col("question_id"), F.col("beam")
    third = (
        F.when(qid % 4 == 1, F.concat(F.lit("<SQL>\n"), F.col("query"), F.lit(" LIMIT 5\n</SQL>")))
        .when(qid % 4 == 2, "no answer")
        .when(qid % 4 == 3, F.concat(F.lit("<SQL> "), F.replace(F.lower("query"), F.lit(" "), F.lit("  ")), F.lit("; </SQL>")))
        .otherwise(F.concat(F.lit("<SQL>"), F.col("query"), F.lit("</SQL>")))
    )
    suffix = F.when(beam == 0, "").otherwise(F.concat(F.lit(" beam "), beam.cast("string")))
    return (
        questions(spark, sf_dir)
        .withColumn("beam", F.explode(F.array(*[F.lit(b) for b in range(4)])))
        .select(
            "question_id", "beam",
            F.concat(F.lit("Example <SQL>SELECT 1</SQL> and <SQL>SELECT 2</SQL>\n"), F.col("question"),
                     F.lit("\n"), third, suffix).alias("output"),
        )
    )


def marked_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6, second variant: the query follows a ``[SQL]`` marker."""
    return questions(spark, sf_dir).select(
        "question_id",
        F.concat(F.lit("[QUESTION]"), F.col("question"), F.lit("[/QUESTION]\n[SQL]\n"),
                 F.replace("query", F.lit(" FROM "), F.lit("\nFROM ")), F.lit(" [/SQL] end")).alias("output"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: 0/1 score of the questions whose document is labelled."""
    n = _row_count(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        _events(spark, sf_dir).select("question_id", (F.col("question_id") % n).alias("doc_id"))
        .join(labels, "doc_id")
        .select("question_id", F.col("quality").alias("score"))
    )


def completions(prompts: DataFrame) -> DataFrame:
    """FX9: one to three attempts for each distinct prompt, none for every eleventh."""
    asked = prompts.groupBy("prompt_hash").agg(F.min("question_id").alias("q")).where(F.col("q") % 11 != 0)
    n = (F.least(F.col("q") % 4, F.lit(2)) + 1).cast("int")
    return asked.withColumn("attempt", F.explode(F.sequence(F.lit(1), n))).select(
        "prompt_hash", "attempt",
        F.when(F.col("attempt") == n, "ok").otherwise("error").alias("status"),
        F.when(F.col("attempt") == n, F.concat(F.lit("answer to "), F.col("q").cast("string"))).alias("completion"),
    )


def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11: result rows of a gold and a predicted query per nation.

    The predicted side has its columns in the other order; for nations 0, 3, .. they
    are renamed, too, and keys are written with a fraction.  It repeats the row of the smallest key for nations
    1, 4, .. and lacks it for nations 2, 5, ...
    """
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("query_id"), "c_custkey", "c_mktsegment")
    smallest = customer.groupBy("query_id").agg(F.min("c_custkey").alias("first_key"))
    is_first = F.col("c_custkey") == F.col("first_key")
    kind = F.col("query_id") % 3
    copies = F.when(is_first & (kind == 1), 2).when(is_first & (kind == 2), 0).otherwise(1)
    gold = F.to_json(F.struct("c_custkey", "c_mktsegment"))
    swapped = F.to_json(F.struct("c_mktsegment", "c_custkey"))
    renamed = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").cast("double").alias("number")))
    sides = F.concat(F.array(F.lit("gold")), F.array_repeat(F.lit("pred"), copies))
    row_json = F.when(F.col("side") == "gold", gold).when(kind == 0, renamed).otherwise(swapped)
    return customer.join(smallest, "query_id").withColumn("side", F.explode(sides)).select("query_id", "side", row_json.alias("row_json"))


def executed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11: the ids that were run; those of 100 and above gave no row on either side."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
    empty = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("query_id"))
    return nations.unionByName(empty)


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX10: an outside score for every table and column of the question's database."""
    kind = "array<struct<tab_idx:int,table_name:string,col_idx:int,column_name:string>>"
    tables = F.transform("table_names_original", lambda t, i: F.struct(
        i.alias("tab_idx"), t.alias("table_name"), F.lit(None).alias("col_idx"), F.lit(None).alias("column_name")))
    columns = F.transform("column_names_original", lambda c, i: F.struct(
        c[0].cast("int").alias("tab_idx"), F.get("table_names_original", c[0].cast("int")).alias("table_name"),
        i.alias("col_idx"), c[1].alias("column_name")))
    real = F.filter(columns, lambda c: c["tab_idx"] >= 0)
    catalog = raw_catalog(spark, sf_dir)
    items = catalog.select("db_id", F.concat(tables.cast(kind), real.cast(kind)).alias("items"))
    idx = F.coalesce("i.col_idx", "i.tab_idx")
    return (
        join_catalog(questions(spark, sf_dir).select("question_id", "db_id"), items)
        .select("question_id", F.explode("items").alias("i"))
        .select("question_id", "i.*", (((F.col("question_id") * 31 + idx * 17) % 101) / 100.0).alias("score"))
    )
