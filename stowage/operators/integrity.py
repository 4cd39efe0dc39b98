"""Integrity: folder hashes, manifests, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import columns as C


def folder_hash(members: DataFrame, folder: str = "folder") -> DataFrame:
    """SHA-256 over path and digest of a folder's files in walk order; null if a
    digest is missing. members: folder, relpath, sha256. A hash goes over its
    input in order, so a folder is one task's work; its rows are sorted there and
    stream through the hash, and none of them is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        digest, files, bad = hashlib.sha256(), 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([files], pa.int64()), pa.array([None if bad else digest.hexdigest()], pa.string())], names=[folder, "files", "folder_hash"])

        kind = None
        for batch in batches:
            kind = batch.column(folder).type
            for name, path, sha in zip(*(batch.column(c).to_pylist() for c in (folder, "relpath", "sha256"))):
                if now != (name,):
                    if now:
                        yield out()
                    now, digest, files, bad = (name,), hashlib.sha256(), 0, 0
                files += 1
                bad += path is None or sha is None
                digest.update(f"{path}{sha}".encode())
        if now:
            yield out()

    rows = members.select(folder, "relpath", "sha256", C.walk_key(F.col("relpath")).alias("k"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = members.schema[folder].dataType.simpleString()
    return rows.repartition(parts, folder).sortWithinPartitions(folder, "k", "relpath", "sha256").mapInArrow(run, f"`{folder}` {kind}, files long, folder_hash string")


def incremental_manifest(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """now: path, crc, fresh_sha; manifest: path, crc, sha256. The old hash where
    path and crc agree, else the fresh one."""
    old = manifest.select("path", F.col("crc").alias("old_crc"), F.col("sha256").alias("old_sha"))
    same = F.col("old_sha").isNotNull() & (F.col("old_crc") == F.col("crc"))
    return now.join(old, "path", "left").select("path", "crc", F.when(same, F.col("old_sha")).otherwise(F.col("fresh_sha")).alias("sha256"), F.coalesce(same, F.lit(False)).alias("reused"))


def manifest_diff(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CHANGED, SAME per path; both have path, sha256."""
    m = manifest.select("path", F.col("sha256").alias("expected"))
    a = actual.select("path", F.col("sha256").alias("found"))
    kind = F.when(F.col("expected").isNull(), "ADDED").when(F.col("found").isNull(), "REMOVED").when(F.col("expected") != F.col("found"), "CHANGED").otherwise("SAME")
    return m.join(a, "path", "full_outer").select("path", kind.alias("change"))


def verify(archives: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """archives: id, exists, readable, expected_hash, current_hash,
    manifest_hash, manifest_size, size. manifest and actual: id, pos, name,
    sha256. The first rule that fails names the status."""

    def listed(t: DataFrame, p: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("pos", "name", "sha256")))
        return t.groupBy("id").agg(rows.alias(f"{p}_rows")).select("id", F.transform(f"{p}_rows", lambda r: r["name"]).alias(f"{p}_names"), F.transform(f"{p}_rows", lambda r: r["sha256"]).alias(f"{p}_hashes"))

    out = archives.join(listed(manifest, "m"), "id", "left").join(listed(actual, "a"), "id", "left")
    empty = F.array().cast("array<string>")
    m, a = F.coalesce("m_names", empty), F.coalesce("a_names", empty)
    status = (
        F.when(~F.col("exists"), "MISSING")
        .when(~F.col("readable"), "CORRUPTED")
        .when(F.col("expected_hash").isNotNull() & (F.col("expected_hash") != F.col("current_hash")), "CHANGED")
        .when(F.col("m_names").isNull(), "CHANGED")
        .when(F.col("manifest_hash").isNotNull() & (F.col("manifest_hash") != F.col("current_hash")), "CHANGED")
        .when(F.col("manifest_hash").isNull() & (F.col("manifest_size") != F.col("size")), "CHANGED")
        .when(F.size(F.array_distinct(a)) != F.size(a), "CHANGED")
        .when(m != a, "CHANGED")
        .when(F.coalesce("m_hashes", empty) != F.coalesce("a_hashes", empty), "CHANGED")
        .otherwise("VERIFIED")
    )
    return out.select("id", status.alias("status"))
