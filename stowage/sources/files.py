"""Readers: folders of files, ZIP members, JSON documents and logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import columns as C


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Every file below root: path, relpath, size, modified, content. Extensions
    are compared without case, on the path alone, so contents that are not
    wanted are not read where only paths are asked for."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    rel = F.substring_index(F.col("path"), base + "/", -1)
    out = t.select("path", rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return out.filter(C.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions])) if extensions else out


def walk(files: DataFrame) -> DataFrame:
    """In walk order: files of a folder before its subfolders."""
    return files.orderBy(C.walk_key(F.col("relpath")))


def categories(files: DataFrame) -> DataFrame:
    """Files of a two-level tree, with the first folder as their category."""
    return files.filter(F.size(F.split("relpath", "/")) == 2).withColumn("category", F.split("relpath", "/")[0])


def archive_list(files: DataFrame, category: str) -> DataFrame:
    """*.zip of a category in code point order of their names."""
    return files.filter(F.col("relpath").startswith(category + "/") & F.col("relpath").endswith(".zip")).orderBy("relpath")


_MEMBERS = "path string, pos int, name string, size long, compressed_size long, crc long, comment string, error string"


def zip_members(files: DataFrame) -> DataFrame:
    """A row per member of each ZIP's directory, folders left out; a file that
    isn't a ZIP gives one row with the error. files: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                            rows.append((path, i, m.filename, m.file_size, m.compress_size, m.CRC, m.comment.decode("utf-8", "replace"), None))
                except (zipfile.BadZipFile, ValueError) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            c = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["path", "pos", "name", "size", "compressed_size", "crc", "comment", "error"])

    return files.select("path", "content").mapInArrow(run, _MEMBERS)


MANIFEST = "manifest_version int, archive_name string, category string, created_at string, updated_at string, item_count long, archive_size long, archive_sha256 string, files array<struct<path_in_archive: string, original_size: long, compressed_size: long, sha256: string, _crc32: long, strategy: string, original_sha256: string>>"


def manifests(files: DataFrame) -> DataFrame:
    """path, manifest (null if the document can't be read)."""
    return files.select("path", F.from_json(F.col("content").cast("string"), MANIFEST, {"mode": "PERMISSIVE"}).alias("m")).select("path", F.when(F.col("m.files").isNotNull(), F.col("m")).alias("manifest"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Readable lines of an append log; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_entry(log: DataFrame, order: str) -> DataFrame:
    """The latest entry, by one aggregate."""
    return log.agg(F.max_by(F.struct(*log.columns), order).alias("e")).filter("e is not null").select("e.*")


def text_verdict(content, max_bytes: int = 50 * 1024 * 1024):
    """Why a file can't be filtered as text lines, or OK."""
    text = content.cast("string")
    return F.when(content.isNull(), "MISSING").when(F.octet_length(content) == 0, "EMPTY").when(F.octet_length(content) > max_bytes, "TOO_LARGE").when(~F.is_valid_utf8(text), "NOT_UTF8").when(F.size(F.split(F.rtrim(text), "\n")) < 2, "TOO_FEW_ROWS").otherwise("OK")
