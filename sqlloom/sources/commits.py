"""Runs that are published whole and once.

A run is written into a folder of its own attempt; one small manifest that names this folder publishes
it.  Readers take the folders that manifests name, so what a failed attempt left behind is never read, and a run
that is started again after it was published writes nothing.  Several outputs of one run are published by one manifest.
All paths are of any file system that Spark can write to.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")


def _files(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, run: str) -> str:
    if not _RUN.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, - and _: {run!r}")
    return f"{path.rstrip('/')}/manifests/{run}.json"


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    p, fs = _files(spark, _manifest(path, run))
    return fs.exists(p)


def commit(spark: SparkSession, path: str, run: str, write: Callable[[str], None]) -> bool:
    """Publish what ``write(folder)`` writes as ``run`` of ``path``; False if that run had been published.

    The manifest is written beside its place and renamed without overwriting, so of two attempts at one run that end at the
    same time one is published.
    """
    if is_committed(spark, path, run):
        return False
    folder = f"run_id={run}/attempt={uuid.uuid4().hex}"
    write(f"{path.rstrip('/')}/data/{folder}")
    target = _manifest(path, run)
    beside, fs = _files(spark, f"{target.rpartition('/')[0]}/.{run}-{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(json.dumps({"run": run, "folder": folder}).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = plain
    try:
        context.rename(beside, _files(spark, target)[0], options)
    except Exception:
        if is_committed(spark, path, run):  # another attempt was first
            return False
        raise
    return True


def committed_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Run -> folder of the published runs: one entry a run."""
    p, fs = _files(spark, f"{path.rstrip('/')}/manifests")
    if not fs.exists(p) or not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(p)):
        return {}
    named = spark.read.schema("run string, folder string").json(f"{path.rstrip('/')}/manifests/*.json")
    return {r["run"]: f"{path.rstrip('/')}/data/{r['folder']}" for r in named.collect()}


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the published runs with their ``run_id``; the folders of runs were written as Parquet.

    A filter on ``run_id`` reads the folders of those runs only.  Without a run there are no rows.
    """
    full = T.StructType([*schema.fields, T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())])
    folders = sorted(committed_folders(spark, path).values())
    if not folders:
        return spark.createDataFrame([], full).drop("attempt")
    return spark.read.schema(full).option("basePath", f"{path.rstrip('/')}/data").parquet(*folders).select(
        *schema.names, "run_id")
