"""Whole-file trace and prompt sources, and result sinks.

A trace file is one trace: the file is read whole, stripped, and rejected when
it is missing, blank or no UTF-8. Files are independent, so a directory of
them splits across tasks file by file.

Traces are small, and a file costs more than its bytes: Hadoop's local file
system starts a process for each file it makes, the driver holds the status of
each file that Spark lists, and a scan counts each as 4 MB and so gives a few to
a task. Folders that are mounted (``file:``) are therefore written, listed and
read by the tasks themselves; other stores go through Spark's sources.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import session
from tracelens.functions import lexicon, text

#: Bytes and files that a task of a scan gives out at a time, about.
READ_BYTES, READ_FILES = 8 << 20, 1000
#: FIXED VALUES (Spark's, for folders of partitions): characters escaped in file names, and the name without an id.
ESCAPED, NO_ID = '%"#\'*/:=?\\{[]^\x7f' + "".join(map(chr, range(1, 32))), "__HIVE_DEFAULT_PARTITION__"


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path on a file system that is mounted; None where only Spark can open it."""
    if path.startswith("file:"):
        found = re.fullmatch(r"file:(?://)?(/(?!/).*)", path)
        return found and (found[1].rstrip("/") or "/")
    sc = session._context(spark)
    if not path.startswith("/") or sc is None or not sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return None
    return path.rstrip("/") or "/"


def _hidden(name: str) -> bool:
    """Names that Spark's file scans pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _visible(folder: str) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as entries:
        yield from (e for e in entries if not _hidden(e.name))


def _listable(folder: str) -> bool:
    """Whether the folder holds files only, or folders ``<column>=<value>`` of one column only."""
    if re.search(r"[*?{}\[\]\\]", folder) or not os.path.isdir(folder):
        return False
    kinds: set[str | None] = set()
    for e in _visible(folder):
        kinds.add("" if e.is_file() else e.name.partition("=")[0] if e.is_dir() and not e.name.startswith("=") and "=" in e.name else None)
        if None in kinds or len(kinds) > 1:
            return False
    return bool(kinds)


def _files(folder: str) -> Iterator[str]:
    for e in _visible(folder):
        if e.is_dir():
            yield from _files(e.path)
        else:
            yield e.path


def _listed(folder: str):
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[str] = []
            for path in _files(folder) if batch.num_rows else ():
                some.append(path)
                if len(some) == 10 * READ_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])

    return names


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(paths: list[str], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"file:{p}" for p in paths], pa.string()), pa.array(held, pa.binary())], ["path", "content"])

    for batch in batches:
        paths, held, size = [], [], 0
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as fh:
                content = fh.read()
            if not content:
                continue
            if paths and (size + len(content) > READ_BYTES or len(paths) == READ_FILES):
                yield rows(paths, held)
                paths, held, size = [], [], 0
            paths.append(path)
            held.append(content)
            size += len(content)
        yield rows(paths, held)


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the files that Spark's ``binaryFile`` source finds, without those of no bytes."""
    folder = _mounted(spark, path)
    if folder is None or not _listable(folder):
        return spark.read.format("binaryFile").load(path)
    session.ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = spark.range(0, 1, 1, 1).mapInArrow(_listed(folder), "path string").repartition(n, "path")
    return paths.mapInArrow(_contents, "path string, content binary")


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, text)``: one row per file, stripped; the text of a file that is no UTF-8 is null."""
    df = _binary_files(spark, path)
    content = F.col("content").cast("string")
    return df.select(F.col("path").alias("file_path"), F.when(F.is_valid_utf8(content), text.strip_ws(content)).alias("text"))


def _plain_path(path: Column) -> Column:
    """A path without scheme and authority, as requests and readers write them differently."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"/+$", "")


def scan_trace_files(spark: SparkSession, path: str, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces, rejects): ``(file_path, text)``, and ``(file_path, reason)`` of ``empty_file``, ``not_utf8`` or ``missing_file``.

    ``requested`` (``file_path``) names the files, or folders of files, that
    are wanted: others are left out, and those that are not there are
    rejected as missing, as are files of no bytes, which Spark's file scans
    pass over. Repeated requests count once, null ones not at all.
    """
    df = scan_text_files(spark, path)
    if requested is not None:
        wanted = requested.where("file_path IS NOT NULL").select(F.col("file_path").alias("request"), _plain_path(F.col("file_path")).alias("_at")).dropDuplicates(["_at"])
        own = _plain_path(F.col("file_path"))
        there = df.withColumn("_own", own).withColumn("_at", F.explode(F.array_distinct(F.array(own, F.regexp_replace(own, "/[^/]*$", "")))))
        absent = wanted.join(there.select("_at").distinct(), "_at", "left_anti").select(F.col("request").alias("file_path"), F.lit("missing_file").alias("reason"))
        df = there.join(wanted.select("_at"), "_at", "left_semi").dropDuplicates(["_own"]).select("file_path", "text")
    reason = F.when(F.col("text").isNull(), "not_utf8").when(F.col("text") == "", "empty_file")
    rejects = df.select("file_path", reason.alias("reason")).where("reason IS NOT NULL")
    if requested is not None:
        rejects = rejects.unionByName(absent)
    return df.where("text <> ''"), rejects


def scan_prompt_files(spark: SparkSession, path: str | None) -> DataFrame:
    """Prompt text per file; the default prompt when no path is given. A file that is blank or no UTF-8 is rejected: it gives no row."""
    if path is None:
        return spark.createDataFrame([(None, lexicon.DEFAULT_PROMPT)], "file_path string, prompt string")
    df = scan_text_files(spark, path)
    return df.where(F.col("text") != "").select("file_path", F.col("text").alias("prompt"))


def _escaped(trace_id: Column) -> Column:
    trace_id = trace_id.cast("string")
    name = trace_id
    for c in ESCAPED:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    some = trace_id.rlike("[" + "".join(rf"\x{ord(c):02x}" for c in ESCAPED) + "]")
    return F.when(F.coalesce(trace_id, F.lit("")) == "", NO_ID).when(some, name).otherwise(trace_id)


def _file_name(spark: SparkSession, trace_id: Column, id_col: str) -> Column:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.hash(trace_id.cast("string")), F.lit(n)).cast("string")
    part = F.when(F.length(part) < 5, F.lpad(part, 5, "0")).otherwise(part)
    return F.concat(F.lit("part-"), part, F.lit(f"-{id_col}="), _escaped(trace_id), F.lit(".txt"))


def trace_file(spark: SparkSession, path: str, trace_id: Column, id_col: str = "trace_id") -> Column:
    """Where :func:`write_trace_files` puts a trace under ``path``: its file, or the folder of its file; null for a null id."""
    if _mounted(spark, path) is None:
        at = F.concat(F.lit(f"{path}/{id_col}="), _escaped(trace_id))
    else:
        at = F.concat(F.lit(f"{path}/"), _file_name(spark, trace_id, id_col))
    return F.when(trace_id.isNotNull(), at)


def id_in_path(file_path: Column, id_col: str = "trace_id") -> Column:
    """The (escaped) id in a path of :func:`write_trace_files`."""
    return F.regexp_extract(file_path, rf"{id_col}=([^/]+?)(?:/|\.txt$|$)", 1)


def _written(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one attempt's open file; it gets its name when it is whole
        temp, name, out, n = f"{folder}/.{TaskContext.get().taskAttemptId()}.tmp", None, None, 0
        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != name:
                    if out is not None:
                        out.close()
                        os.replace(temp, f"{folder}/{name}")
                    name, out, n = at, open(temp, "wb"), n + 1
                out.write((line or b"") + b"\n")
        if out is not None:
            out.close()
            os.replace(temp, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write


def write_trace_files(traces: DataFrame, path: str, id_col: str = "trace_id") -> None:
    """One text file per trace (for trace-file sources), at the place that :func:`trace_file` names.

    The rows keep the shuffle width, as AQE, which goes by bytes, would merge
    them into a few tasks. In a mounted folder the files lie side by side, each
    written under a hidden name first, so that a repeated task does no harm.
    Elsewhere each lies in a folder ``<id_col>=<id>/``, put in place by its task.
    Rows of one id are lines of one file.
    """
    spark = traces.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _mounted(spark, path)
    if folder is None:
        out = traces.select(id_col, "text").repartition(n, id_col).write.mode("overwrite").partitionBy(id_col)
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    session.ship_package(spark)
    if os.path.isdir(folder):
        shutil.rmtree(folder)
    os.makedirs(folder)
    rows = traces.select(_file_name(spark, F.col(id_col), id_col).alias("name"), F.col("text").cast("binary").alias("line"))
    rows.repartition(n, "name").sortWithinPartitions("name").mapInArrow(_written(folder), "files long").agg(F.sum("files")).collect()
    open(f"{folder}/_SUCCESS", "wb").close()


def sink_metrics_json(scored: DataFrame, path: str) -> None:
    """Full nested result as JSON lines; null fields are written as ``null``
    (Spark drops them by default; the reference keeps them)."""
    scored.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sink_results_table(results: DataFrame, path: str, partition_col: str = "batch") -> None:
    """Typed per-case results, partitioned for pruning by batch."""
    results.write.mode("overwrite").partitionBy(partition_col).parquet(path)
