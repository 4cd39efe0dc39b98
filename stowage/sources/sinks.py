"""Writers: tables, manifests, reports, logs. All commit through Spark's
committer, so a failed job leaves no partial result behind."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces a table; only the partitions that df has, if it is partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


_GUARD, _STAGE = "_append_guard", "_append_stage"


class Interrupted(RuntimeError):
    """An append that a drill stopped."""


def guarded_append(df: DataFrame, path: str, stop_after: int | None = None) -> int:
    """Appends all of df's files or none, over any file system that renames: the
    files are staged, a guard lists them, they are moved into the table, and the
    guard goes last. What an append that died has left is rolled back first.
    Returns the number of files. One append at a time. stop_after: a drill that
    ends as a crash would, after so many moves."""
    spark = df.sparkSession
    recover(spark, path)
    fs, make = file_system(spark, path)
    stage = f"{path}/{_STAGE}-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    names = sorted(f.getPath().getName() for f in fs.listStatus(make(stage)) if f.getPath().getName().startswith("part-"))
    _write(fs, make, f"{path}/{_GUARD}", json.dumps({"stage": stage, "files": names}))
    for i, name in enumerate(names):
        if stop_after is not None and i >= stop_after:
            raise Interrupted(f"stopped after {i} of {len(names)} files")
        if not fs.rename(make(f"{stage}/{name}"), make(f"{path}/{name}")):
            recover(spark, path)
            raise OSError(f"can't move {name} into {path}")
    fs.delete(make(f"{path}/{_GUARD}"), False)
    fs.delete(make(stage), True)
    return len(names)


def recover(spark: SparkSession, path: str) -> list[str]:
    """Undoes an append that didn't end: the files that its guard lists leave the
    table, staged files and the guard are deleted. The names that were undone;
    none if nothing was open. Doing it again changes nothing."""
    fs, make = file_system(spark, path)
    guard = make(f"{path}/{_GUARD}")
    undone: list[str] = []
    if fs.exists(guard):
        stream = fs.open(guard)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        for name in json.loads(text)["files"]:
            if fs.delete(make(f"{path}/{name}"), False):
                undone.append(name)
        fs.delete(guard, False)
    if fs.exists(make(path)):
        for f in fs.listStatus(make(path)):
            if f.getPath().getName().startswith((_STAGE, f"{_GUARD}-")):
                fs.delete(f.getPath(), True)
    return undone


def _write(fs, make, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    part = make(f"{path}-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    if not fs.rename(part, make(path)):
        raise OSError(f"can't write {path}")


def manifest_documents(archives: DataFrame, members: DataFrame, version: int = 2) -> DataFrame:
    """id, document: each archive's manifest as JSON; archives: id, archive_name,
    category, archive_size, archive_sha256; members: id, pos, path_in_archive,
    original_size, compressed_size, sha256, crc32 and, from version 2, strategy
    and original_sha256."""
    names = ["path_in_archive", "original_size", "compressed_size", "sha256", F.col("crc32").alias("_crc32")]
    if version >= 2:
        names += ["strategy", "original_sha256"]
    entry = F.struct(F.col("pos").alias("pos"), F.struct(*names).alias("f"))
    files = members.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["f"]).alias("files"), F.count("*").alias("item_count"))
    doc = F.struct(F.lit(version).alias("manifest_version"), "archive_name", "category", F.coalesce("item_count", F.lit(0)).alias("item_count"), "archive_size", "archive_sha256", "files")
    return archives.join(files, "id", "left").select("id", F.to_json(doc).alias("document"))


def csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def markdown(df: DataFrame, order: list, title: str, most: int = 10_000) -> str:
    """A small result as a Markdown table (a row per group of a rollup). A result
    of over `most` rows is an error: it is no report."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows for a Markdown table")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def report(df: DataFrame, order: list, title: str, path: str) -> str:
    """A rollup as CSV, JSON and Markdown below one folder; the Markdown text."""
    csv_report(df, f"{path}/csv")
    json_report(df, f"{path}/json")
    text = markdown(df, order, title)
    fs, make = file_system(df.sparkSession, path)
    if fs.exists(make(f"{path}/report.md")):
        fs.delete(make(f"{path}/report.md"), False)
    _write(fs, make, f"{path}/report.md", text)
    return text
