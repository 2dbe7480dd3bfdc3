"""Fixed schemas of the tables that cross the engine's boundary."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_CATALOG = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_names_original", T.ArrayType(T.StringType())),
    # pairs [table index, column name]; the mixed pair is read as strings
    T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("column_types", T.ArrayType(T.StringType())),
    T.StructField("primary_keys", T.ArrayType(T.IntegerType())),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("query", T.StringType()),
])

RESPONSES = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("response", T.StringType()),
])

# Responses as they arrive; a retried one has a higher ``attempt``, which may be absent.
DELIVERIES = T.StructType([*RESPONSES.fields, T.StructField("attempt", T.IntegerType())])

PREDICTIONS = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("schema_links", T.StringType()),
    T.StructField("model_predicted_sql", T.StringType()),
])
