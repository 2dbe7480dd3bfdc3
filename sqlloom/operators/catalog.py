"""Catalog preparation: nested database records to flat tables and schema text.

A raw catalog row holds one whole database, and every index in it points into
the same row.  All lookups are therefore array positions inside the row: no
operator of this module shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.functions.arrays import new_value, runs
from sqlloom.functions.relational import once
from sqlloom.functions.text import bracketed, strip

_TABLES = "table_names_original"
_COLUMNS = "column_names_original"
_TYPES = "column_types"

# Fixed value: the pseudo column that stands for every column of a table.
STAR = "*"


def _column_structs(truncate: bool) -> Column:
    """Columns of the row as array<struct<col_idx, tab_idx, name, type, table_name>>.

    With ``truncate`` a column without a type is dropped, which is what pairing
    the two lists gives; key lookups need the full list.
    """
    names = F.col(_COLUMNS)
    if truncate:
        names = F.slice(names, 1, F.least(F.size(_COLUMNS), F.size(_TYPES)))

    def one(pair: Column, i: Column) -> Column:
        tab_idx = F.get(pair, F.lit(0)).try_cast("int")
        return F.struct(
            i.alias("col_idx"),
            tab_idx.alias("tab_idx"),
            F.get(pair, F.lit(1)).alias("name"),
            F.get(F.col(_TYPES), i).alias("type"),
            F.get(F.col(_TABLES), tab_idx).alias("table_name"),
        )

    return F.transform(names, one)


def _tables() -> Column:
    return F.transform(_TABLES, lambda t, i: F.struct(i.alias("tab_idx"), t.alias("name")))


def _key_column(col_idx: Column, columns: Column) -> Column:
    """Column a key index points at, null when out of range or the star."""
    found = F.get(columns, col_idx)
    return F.when(found["table_name"].isNotNull(), found)


def _primary_key_structs(columns: Column) -> Column:
    found = F.transform(
        F.coalesce("primary_keys", F.array().cast("array<int>")),
        lambda k, i: F.struct(i.alias("pk_pos"), _key_column(k, columns).alias("col")),
    )
    return F.filter(found, lambda p: p["col"].isNotNull())


def _foreign_key_structs(columns: Column) -> Column:
    found = F.transform(
        F.coalesce("foreign_keys", F.array().cast("array<array<int>>")),
        lambda k, i: F.struct(
            i.alias("fk_pos"),
            _key_column(F.get(k, F.lit(0)), columns).alias("l"),
            _key_column(F.get(k, F.lit(1)), columns).alias("r"),
            F.size(k).alias("n"),
        ),
    )
    return F.filter(found, lambda f: f["l"].isNotNull() & f["r"].isNotNull() & (f["n"] == 2))


def _with_columns(catalog: DataFrame) -> DataFrame:
    """Catalog rows with the key structs worked out once."""
    columns = once(catalog, _cols=_column_structs(truncate=False))
    return once(columns, _pks=_primary_key_structs(F.col("_cols")), _fks=_foreign_key_structs(F.col("_cols")))


def _qualified(c: Column) -> Column:
    return F.concat(c["table_name"], F.lit("."), c["name"])


def catalog_columns(catalog: DataFrame) -> DataFrame:
    """One row per column; the star column becomes one ``*`` row per table."""
    col = F.col("_c")
    owners = F.when(col["tab_idx"] == -1, _tables()).otherwise(
        F.array(F.struct(col["tab_idx"].alias("tab_idx"), col["table_name"].alias("name")))
    )
    star = col["tab_idx"] == -1
    return (
        catalog.select("db_id", _TABLES, F.explode(_column_structs(truncate=True)).alias("_c"))
        .select("db_id", "_c", F.explode(owners).alias("_t"))
        .where(F.col("_t.name").isNotNull())
        .select(
            "db_id",
            F.col("_t.tab_idx").alias("tab_idx"),
            F.col("_t.name").alias("table_name"),
            F.col("_c.col_idx").alias("col_idx"),
            F.when(star, STAR).otherwise(col["name"]).alias("column_name"),
            F.when(star, "text").otherwise(col["type"]).alias("column_type"),
        )
    )


def catalog_primary_keys(catalog: DataFrame) -> DataFrame:
    """Every valid primary-key column, composite keys in full."""
    return (
        once(catalog, _cols=_column_structs(truncate=False))
        .select("db_id", F.explode(_primary_key_structs(F.col("_cols"))).alias("p"))
        .select("db_id", "p.pk_pos", F.col("p.col.table_name").alias("table_name"),
                F.col("p.col.name").alias("column_name"))
    )


def catalog_foreign_keys(catalog: DataFrame) -> DataFrame:
    """Every foreign key whose two ends are real columns."""
    return (
        once(catalog, _cols=_column_structs(truncate=False))
        .select("db_id", F.explode(_foreign_key_structs(F.col("_cols"))).alias("f"))
        .select(
            "db_id", "f.fk_pos",
            F.col("f.l.table_name").alias("left_table"), F.col("f.r.table_name").alias("right_table"),
            F.col("f.l.name").alias("left_column"), F.col("f.r.name").alias("right_column"),
        )
    )


def _last_positions(names: Column) -> Column:
    """Distinct names in order of first occurrence, each with the position of its last one; null is no name."""
    keyed = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("pos"))),
                     lambda k: k["name"].isNotNull())
    spans = F.transform(runs(F.array_sort(keyed), new_value("name")), lambda r: F.struct(
        r[0]["pos"].alias("first"), r[0]["name"].alias("name"), F.element_at(r, -1)["pos"].alias("pos")))
    return F.transform(F.array_sort(spans), lambda s: F.struct(s["name"].alias("name"), s["pos"].alias("pos")))


def _columns_per_table() -> Column:
    """Columns of every table by table index, in file order.

    A mark for each table is sorted in front of its columns, so one sort serves all tables.
    """
    marks = F.transform(_TABLES, lambda t, i: F.struct(
        i.alias("tab_idx"), F.lit(-1).alias("pos"), F.get("_cols", F.lit(-1)).alias("col")))
    placed = F.transform(
        F.filter("_cols", lambda c: (c["tab_idx"] >= 0) & (c["tab_idx"] < F.size(_TABLES))),
        lambda c: F.struct(c["tab_idx"].alias("tab_idx"), c["col_idx"].alias("pos"), c.alias("col")))
    per_table = runs(F.array_sort(F.concat(marks, placed)), lambda a, x, i: x["pos"] == -1)
    return F.transform(per_table, lambda r: F.transform(F.slice(r, 2, F.size(r)), lambda m: m["col"]))


def catalog_by_db(catalog: DataFrame) -> DataFrame:
    """Per database: map table -> columns, map table -> key column, list of foreign keys.

    A repeated table name keeps its last definition and a composite key its last column.
    """
    tables = F.transform(_last_positions(F.col(_TABLES)), lambda t: F.struct(
        t["name"].alias("key"), F.transform(F.get("_own", t["pos"]), lambda c: c["name"]).alias("value")))
    keys = F.transform(
        _last_positions(F.transform("_pks", lambda p: p["col"]["table_name"])),
        lambda t: F.struct(t["name"].alias("key"), F.get("_pks", t["pos"])["col"]["name"].alias("value")))
    return once(_with_columns(catalog), _own=_columns_per_table()).select(
        "db_id",
        F.map_from_entries(tables).alias("tables"),
        F.transform("_fks", lambda f: F.struct(
            _qualified(f["l"]).alias("left"), _qualified(f["r"]).alias("right"))).alias("foreign_keys"),
        F.map_from_entries(keys).alias("primary_keys"),
    )


def catalog_rejects(catalog: DataFrame) -> DataFrame:
    """Everything the flat tables leave out, with the reason, and each ``db_id`` held by several records."""
    cols = F.col("_cols")

    def reject(item: str, detail: Column, reason: Column) -> Column:
        return F.struct(F.lit(item).alias("item"), detail.alias("detail"), reason.alias("reason"))

    def key_reason(idx: Column) -> Column:
        target = F.get(cols, idx)
        return (
            F.when(idx.isNull() | target.isNull(), "index out of range")
            .when(target["tab_idx"] == -1, "star column")
            .when(target["table_name"].isNull(), "bad table index")
        )

    bad_tables = F.transform(
        F.filter(_tables(), lambda t: t["name"].isNull()),
        lambda t: reject("table", t["tab_idx"].cast("string"), F.lit("no name")))
    bad_columns = F.transform(
        F.filter(cols, lambda c: ~F.coalesce(c["tab_idx"] == -1, F.lit(False)) & c["table_name"].isNull()),
        lambda c: reject("column", F.coalesce(c["name"], F.lit("")), F.lit("bad table index")),
    )
    untyped = F.transform(
        F.filter(cols, lambda c: c["col_idx"] >= F.size(_TYPES)),
        lambda c: reject("column", F.coalesce(c["name"], F.lit("")), F.lit("no type")),
    )
    bad_pks = F.transform(
        F.filter("primary_keys", lambda k: key_reason(k).isNotNull()),
        lambda k: reject("primary_key", F.coalesce(k.cast("string"), F.lit("")), key_reason(k)),
    )

    def pair_reason(k: Column) -> Column:
        return F.when(F.size(k) != 2, "not a pair").otherwise(
            F.coalesce(key_reason(F.get(k, F.lit(0))), key_reason(F.get(k, F.lit(1))))
        )

    bad_fks = F.transform(
        F.filter("foreign_keys", lambda k: pair_reason(k).isNotNull()),
        lambda k: reject("foreign_key", F.array_join(k.cast("array<string>"), ","), pair_reason(k)),
    )
    required = ("db_id", _TABLES, _COLUMNS, _TYPES, "primary_keys", "foreign_keys")
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in required])
    bad_database = F.when(
        missing != "", F.array(reject("database", missing, F.lit("missing part")))
    ).otherwise(F.filter(F.array(reject("", F.lit(""), F.lit(""))), lambda _: F.lit(False)))

    none = F.filter(F.array(reject("", F.lit(""), F.lit(""))), lambda _: F.lit(False))
    found = F.concat(bad_database, *[F.coalesce(a, none) for a in (bad_tables, bad_columns, untyped, bad_pks, bad_fks)])
    repeated = catalog.where(F.col("db_id").isNotNull()).groupBy("db_id").count().where("count > 1").select(
        "db_id", F.lit("database").alias("item"), F.concat(F.col("count").cast("string"), F.lit(" records")).alias("detail"),
        F.lit("repeated db_id").alias("reason"))
    return (
        once(catalog, _cols=_column_structs(truncate=False))
        .select("db_id", F.explode(found).alias("r"))
        .select("db_id", "r.item", "r.detail", "r.reason")
        .unionByName(repeated)
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Counts and warnings per database, and one total row with a null ``db_id``."""
    real = F.filter("_cols", lambda c: c["table_name"].isNotNull())
    per_db = _with_columns(catalog).select(
        "db_id",
        F.lit(1).cast("long").alias("n_databases"),
        F.size(_TABLES).cast("long").alias("n_tables"),
        F.size(real).cast("long").alias("n_columns"),
        F.size("_pks").cast("long").alias("n_primary_keys"),
        F.size("_fks").cast("long").alias("n_foreign_keys"),
    )
    counts = ["n_databases", "n_tables", "n_columns", "n_primary_keys", "n_foreign_keys"]
    total = per_db.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(
        F.lit(None).cast("string").alias("db_id"), *counts
    )
    return per_db.unionByName(total).select(
        "*",
        (F.col("n_columns") == 0).alias("no_columns"),
        (F.col("n_primary_keys") == 0).alias("no_primary_keys"),
        (F.col("n_foreign_keys") == 0).alias("no_foreign_keys"),
    )


def _with_fields(catalog: DataFrame) -> DataFrame:
    """Catalog rows with their field text and the columns it is made of."""
    def item(table: Column, c: Column, name: Column) -> Column:
        return F.struct(table.alias("table"), c["col_idx"].alias("pos"), name.alias("name"))

    # the name of a table, with no column at place -1, is sorted in front of its columns
    named = F.transform(F.filter(F.array_distinct(_TABLES), lambda t: t.isNotNull()), lambda t: F.struct(
        t.alias("table"), F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("name")))
    owned = F.transform(
        F.filter("_typed", lambda c: (c["tab_idx"] != -1) & c["table_name"].isNotNull()),
        lambda c: item(c["table_name"], c, c["name"]))
    stars = F.transform(F.filter("_typed", lambda c: c["tab_idx"] == -1), lambda c: item(F.lit(""), c, F.lit(STAR)))

    def line(run: Column) -> Column:
        own = F.transform(F.concat(F.slice(run, 2, F.size(run)), F.col("_stars")),
                          lambda c: F.struct(c["pos"].alias("pos"), c["name"].alias("name")))
        names = F.transform(F.array_sort(own), lambda c: c["name"])
        return F.when(F.size(names) > 0, F.concat(
            F.lit("Table "), run[0]["table"], F.lit(", columns = "), bracketed(names), F.lit("\n")))

    per_table = runs(F.array_sort(F.concat(named, owned)), lambda a, x, i: x["pos"] == -1)
    rows = once(once(catalog, _typed=_column_structs(truncate=True)), _stars=stars, _own=per_table)
    return rows.withColumn("fields", F.array_join(F.transform("_own", line), ""))


def serialize_fields(catalog: DataFrame) -> DataFrame:
    """``Table t, columns = [*,a,b]`` lines, tables by name, columns in file order."""
    return _with_fields(catalog).select("db_id", "fields")


def serialize_primary_keys(catalog: DataFrame) -> DataFrame:
    """``[t.a,t.b]``, ``[]`` when there is none."""
    return once(catalog, _cols=_column_structs(truncate=False)).select(
        "db_id",
        bracketed(F.transform(_primary_key_structs(F.col("_cols")), lambda p: _qualified(p["col"]))).alias("primary_keys"),
    )


def _foreign_key_texts(fks: Column) -> Column:
    return F.transform(fks, lambda f: F.concat(_qualified(f["l"]), F.lit(" = "), _qualified(f["r"])))


def foreign_keys_text() -> Column:
    """``[a.x = b.y,..]`` of a raw catalog row."""
    return F.transform(
        F.array(_column_structs(truncate=False)),
        lambda cols: bracketed(_foreign_key_texts(_foreign_key_structs(cols))))[0]


def serialize_foreign_keys(catalog: DataFrame) -> DataFrame:
    """``[a.x = b.y,..]``, ``[]`` when there is none."""
    return catalog.select("db_id", foreign_keys_text().alias("foreign_keys"))


def schema_texts(catalog: DataFrame) -> DataFrame:
    """Fields, primary-key and foreign-key text of each database in one pass."""
    return _with_fields(_with_columns(catalog)).select(
        "db_id", "fields",
        bracketed(F.transform("_pks", lambda p: _qualified(p["col"]))).alias("primary_keys"),
        bracketed(_foreign_key_texts(F.col("_fks"))).alias("foreign_keys"),
    )


def serialize_typed_schema(catalog: DataFrame) -> DataFrame:
    """Declaration-order schema with types, key marks and a foreign-key block."""
    # the marks of the key columns, by column index
    flags = F.transform(
        runs(F.array_sort(F.concat(
            F.transform("_cols", lambda c: F.struct(c["col_idx"].alias("pos"), F.lit(False).alias("key"))),
            F.transform(F.filter("primary_keys", lambda k: (k >= 0) & (k < F.size("_cols"))),
                        lambda k: F.struct(k.alias("pos"), F.lit(True).alias("key"))))), new_value("pos")),
        lambda r: F.element_at(r, -1)["key"])

    def column(c: Column, table: Column) -> Column:
        about = F.concat_ws(" | ", c["type"], F.when(F.get("_flags", c["col_idx"]), "primary key"))
        return F.concat(table["name"], F.lit("."), c["name"], F.lit(" ( "), about, F.lit(" )"))

    def table(t: Column) -> Column:
        own = F.get("_own", t["tab_idx"])
        return F.concat(
            F.lit("table "), t["name"], F.lit(" , columns = [ "),
            F.array_join(F.transform(own, lambda c: column(c, t)), " , "), F.lit(" ]\n"),
        )

    keys = F.transform(_foreign_key_texts(F.col("_fks")), lambda k: F.concat(k, F.lit("\n")))
    block = F.when(
        F.size("_fks") > 0, F.concat(F.lit("foreign keys :\n"), F.array_join(keys, ""))
    ).otherwise("foreign keys : None\n")
    text = F.concat(F.array_join(F.transform(_tables(), table), ""), block)
    rows = once(_with_columns(catalog), _own=_columns_per_table(), _flags=flags)
    return rows.select("db_id", strip(text).alias("typed_schema"))


def serialize_linking_schema(catalog: DataFrame) -> DataFrame:
    """Schema without the star and foreign keys as bullets plus a one-line list."""
    def line(t: Column) -> Column:
        own = F.get("_own", t["pos"])
        return F.concat(
            F.lit("Table "), t["name"], F.lit(", columns = "),
            bracketed(F.transform(own, lambda c: c["name"])), F.lit("\n"),
        )

    keys = _foreign_key_texts(F.col("_fks"))
    bullets = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- "), k, F.lit("\n"))), "")
    fk_text = F.when(
        F.size("_fks") > 0,
        F.concat(F.lit("Foreign Keys:\n"), bullets, F.lit("\nForeign_keys = "), bracketed(keys)),
    ).otherwise("No Foreign Keys\nForeign_keys = []")
    return once(_with_columns(catalog), _own=_columns_per_table()).select(
        "db_id",
        F.concat(F.lit("Database Schema:\n"),
                 F.array_join(F.transform(_last_positions(F.col(_TABLES)), line), "")).alias("schema_text"),
        fk_text.alias("fk_text"),
    )


def _foreign_key_list(text: Column) -> Column:
    """Entries between the outer brackets, an empty array for ``[]``."""
    inner = F.regexp_extract(text, r"\[(.*)\]", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def filtered_schema_text(items: Column, foreign_keys: Column, kept_only: bool = False) -> Column:
    """Schema text of a list of schema items and a foreign-key list text.

    All foreign keys are written, one per line; ``kept_only`` restricts them to
    keys between listed tables.
    """
    def block(item: Column) -> Column:
        shown = F.when(
            item["table_comment"] != "",
            F.concat(item["table_name"], F.lit(" ( comment : "), item["table_comment"], F.lit(" )")),
        ).otherwise(item["table_name"])
        columns = F.transform(item["column_names"], lambda c: F.concat(shown, F.lit("."), c))
        return F.concat(F.lit("table "), shown, F.lit(" , columns = [ "), F.array_join(columns, " , "), F.lit(" ]\n"))

    keys = _foreign_key_list(foreign_keys)
    if kept_only:
        kept = F.transform(items, lambda i: i["table_name"])
        keys = F.filter(keys, lambda k: F.forall(
            F.transform(F.split(k, " = "), lambda side: F.substring_index(side, ".", 1)),
            lambda t: F.array_contains(kept, t)))
    tail = F.when(F.size(keys) > 0, F.concat(F.lit("foreign keys :\n"), F.array_join(keys, "\n"))).otherwise(
        "foreign keys : None\n"
    )
    return strip(F.concat(F.array_join(F.transform(items, block), ""), tail))


def serialize_filtered_schema(df: DataFrame, kept_only: bool = False) -> DataFrame:
    """Add ``filtered_schema`` to rows with ``schema_items`` and ``foreign_keys``."""
    return df.withColumn(
        "filtered_schema", filtered_schema_text(F.col("schema_items"), F.col("foreign_keys"), kept_only)
    )


# Fixed value: format of a field line; digits are accepted in names.
FIELD_LINE = r"Table ([A-Za-z0-9_]+), columns = \[\*,(.+)\]"


def parse_fields(df: DataFrame, text: str = "fields") -> DataFrame:
    """Field text back to one row per table; lines that do not parse keep ``status='reject'``."""
    keys = [c for c in df.columns if c != text]
    line = F.col("_line")
    good = line.rlike(FIELD_LINE)
    return (
        df.select(*keys, F.posexplode(F.split(strip(F.col(text)), "\n")).alias("table_pos", "_line"))
        .select(
            *keys, "table_pos",
            F.when(good, F.regexp_extract(line, FIELD_LINE, 1)).alias("table_name"),
            F.when(good, F.split(F.regexp_extract(line, FIELD_LINE, 2), ",")).alias("column_names"),
            F.when(good, "ok").otherwise("reject").alias("status"),
            line.alias("line"),
        )
    )


def schema_items(text: Column) -> Column:
    """Field text to array<struct<table_name, table_comment, column_names, column_comments>>."""
    lines = F.filter(F.split(strip(text), "\n"), lambda x: x.rlike(FIELD_LINE))

    def item(line: Column) -> Column:
        columns = F.split(F.regexp_extract(line, FIELD_LINE, 2), ",")
        return F.struct(
            F.regexp_extract(line, FIELD_LINE, 1).alias("table_name"),
            F.lit("").alias("table_comment"),
            columns.alias("column_names"),
            F.transform(columns, lambda _: F.lit("")).alias("column_comments"),
        )

    return F.transform(lines, item)


def parse_foreign_keys(df: DataFrame, text: str = "foreign_keys") -> DataFrame:
    """Foreign-key list text to one row per key."""
    keys = [c for c in df.columns if c != text]
    parts = F.split("_key", r" = |\.")
    return (
        df.select(*keys, F.posexplode(_foreign_key_list(F.col(text))).alias("fk_pos", "_key"))
        .select(*keys, "fk_pos", *[
            F.get(parts, F.lit(i)).alias(name)
            for i, name in enumerate(("left_table", "left_column", "right_table", "right_column"))
        ])
    )
