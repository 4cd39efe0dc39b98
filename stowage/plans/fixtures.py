"""The archive domain's tables made of the driver's tables. Only the columns
that a query uses are read: all views are projections that Catalyst prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import constants as K
from stowage.operators import selection


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floor_long(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def category(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("grp"))


def archive(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "CHANGED").otherwise("CORRUPTED")
    name = F.concat(F.lit("arc_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".zip"))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("category_id"), name.alias("file_name"), floor_long(F.col("o_totalprice")).alias("current_size"), (F.col("o_orderkey") % 5).alias("item_count"), status.alias("integrity_status"), F.col("o_orderdate").alias("created_at"))


def item(spark: SparkSession, d: str) -> DataFrame:
    """Rows have no key of their own: item_key is a hash of their content."""
    t = table(spark, d, "lineitem")
    m = F.col("l_partkey") % 6
    ext = F.when(m == 0, "txt").when(m == 1, "csv").when(m == 2, "json").when(m == 3, "JPG").when(m == 4, "zip").otherwise("py")
    part, supp, line = F.col("l_partkey").cast("string"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = t.select(
        F.col("l_orderkey").alias("archive_id"), line.cast("bigint").alias("line"), F.concat(F.lit("part_"), part, F.lit("."), ext).alias("file_name"),
        F.concat(F.lit("d"), (supp % 10).cast("string"), F.lit("/part_"), part).alias("path_in_archive"), floor_long(F.col("l_extendedprice")).alias("original_size"),
        floor_long(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("compressed_size"), F.when(F.col("l_returnflag") == "R", "CHECKED_OUT").otherwise("ARCHIVED").alias("status"),
        F.sha2(F.concat(part, F.lit(":"), supp.cast("string")), 256).alias("original_hash"), F.when(line % 4 == 1, K.ZSTD).when(line % 4 == 2, K.LZMA).when(line % 4 == 3, K.ZLIB).alias("strategy"),
    )
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("archive_id", "line", "path_in_archive", "original_size", "compressed_size", "status")])
    return rows.withColumn("item_key", F.sha2(key, 256))


def file(spark: SparkSession, d: str) -> DataFrame:
    lang = F.col("lang")
    rows = table(spark, d, "documents").withColumn("ext", F.when(lang == "en", "txt").when(lang == "de", "md").when(lang == "fr", "csv").when(lang == "es", "json").otherwise("bin"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext"))
    return rows.select(F.col("doc_id").alias("seq"), path.alias("relpath"), "ext", F.col("text").alias("content"), F.octet_length("text").cast("bigint").alias("size"), F.sha2(F.col("text"), 256).alias("sha256"))


def candidate(spark: SparkSession, d: str) -> DataFrame:
    """Measured candidates: one row per (file, place in the measured order)."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("bigint").alias("pos")).agg(
        F.sum(floor_long(price * 8192)).alias("baseline"), F.sum(floor_long(price * (1 - off) * 8192)).alias("candidate"),
        (12 * F.sum(F.round(F.col("l_tax") * 100).cast("bigint"))).cast("bigint").alias("seconds"), F.every(~((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5))).alias("sha_ok"),
    )


def decided(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("pos") % 4
    named = candidate(spark, d).withColumn("strategy", F.when(m == 0, K.LZMA).when(m == 1, K.ZSTD).when(m == 2, K.BROTLI).otherwise(K.ZLIB))
    return selection.decide(named)


def op(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return t.select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("operation"), floor_long(F.col("value") * 100).alias("ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")
