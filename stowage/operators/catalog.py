"""The catalogue: look-ups, search, dashboard, and changes of state. Changes are
functional: they return the table or the outcomes after the change."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.functions import constants as K


def enum_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows per value of an enum: 0 where there are none, other values left out."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return values.join(F.broadcast(counts.filter(F.col(column).isin(domain))), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def items_in_place(items: DataFrame, archives: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with their archive's and category's names."""
    a = archives.select(F.col("id").alias("archive_id"), "category_id", F.col("file_name").alias("archive_name"), "integrity_status")
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return items.join(a, "archive_id").join(c, "category_id")


def search(placed: DataFrame, text: str, category: str | None = None, suffix: str | None = None) -> DataFrame:
    """Name contains text (letters A-Z in any case, % and _ as in LIKE), in a
    category, with a name's suffix."""
    hit = C.like_contains(F.col("file_name"), text)
    if category is not None:
        hit = hit & (F.col("category") == category)
    if suffix is not None:
        hit = hit & C.like_suffix(F.col("file_name"), suffix)
    return placed.filter(hit)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key the table lacks; of new rows with one key, one."""
    return new.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def item_problem(r: dict[str, Column]) -> Column:
    """The first rule that an item breaks, or VALID."""
    blank = lambda c: c.isNull() | (F.length(F.trim(c)) == 0)
    return (
        F.when(r["archive_id"].isNull() | (r["archive_id"] <= 0), "ARCHIVE_ID")
        .when(~F.coalesce(r["file_type"].isin("file", "folder"), F.lit(False)), "FILE_TYPE")
        .when(blank(r["file_name"]), "FILE_NAME")
        .when(blank(r["path_in_archive"]), "PATH")
        .when(r["original_size"].isNull() | (r["original_size"] < 0), "ORIGINAL_SIZE")
        .when(r["compressed_size"].isNull() | (r["compressed_size"] < 0), "COMPRESSED_SIZE")
        .when(~F.coalesce(r["original_hash"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "HASH")
        .when(~F.coalesce(r["status"].isin(K.ITEM_STATUSES), F.lit(False)), "STATUS")
        .otherwise("VALID")
    )


def renamed(table: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (id, new_name). Outcome NOT_FOUND, NAME_TAKEN (another row has
    the name) or RENAMED."""
    there = table.select("id", F.lit(True).alias("there"))
    taken = table.select(F.col("name").alias("new_name"), F.col("id").alias("owner"))
    out = changes.join(there, "id", "left").join(taken, "new_name", "left")
    out = out.groupBy("id", "new_name").agg(F.bool_or("there").alias("there"), F.bool_or(F.col("owner") != F.col("id")).alias("other"))
    return out.select("id", "new_name", F.when(F.col("there").isNull(), "NOT_FOUND").when(F.col("other"), "NAME_TAKEN").otherwise("RENAMED").alias("outcome"))


def deletion(requests: DataFrame, table: DataFrame, children: DataFrame, parent: str) -> DataFrame:
    """requests: (id). NOT_FOUND, NOT_EMPTY or DELETED."""
    counts = children.groupBy(F.col(parent).alias("id")).agg(F.count("*").alias("n"))
    there = table.select("id", F.lit(True).alias("there"))
    out = requests.join(there, "id", "left").join(counts, "id", "left")
    return out.select("id", F.when(F.col("there").isNull(), "NOT_FOUND").when(F.coalesce("n", F.lit(0)) > 0, "NOT_EMPTY").otherwise("DELETED").alias("outcome"))


def duplicate_verdict(new: DataFrame, placed: DataFrame, key: str = "original_hash") -> DataFrame:
    """new: (id, key). DUPLICATE if a stored item of that key, a content's hash,
    lies in a verified archive, DUPLICATE_UNTRUSTED if only elsewhere, else
    PROCEED. placed: key, archive_id, integrity_status."""
    known = placed.groupBy(key).agg(F.bool_or(F.col("integrity_status") == "VERIFIED").alias("trusted"), F.min("archive_id").alias("archive_id"))
    out = new.join(known, key, "left")
    verdict = F.when(F.col("trusted").isNull(), "PROCEED").when(F.col("trusted"), "DUPLICATE").otherwise("DUPLICATE_UNTRUSTED")
    return out.select("id", verdict.alias("verdict"), "archive_id")


class Rooms:
    """The free room of bins in a tree of maxima: the first bin with room for a
    size is found, and its room changed, in logarithmic time."""

    def __init__(self):
        self.leaves, self.n = 1, 0
        self.most = [-inf, -inf]

    def add(self, room: float) -> int:
        if self.n == self.leaves:
            old = self.most[self.leaves :]
            self.leaves *= 2
            self.most = [-inf] * self.leaves + old + [-inf] * self.leaves
            self.most = self.most[: 2 * self.leaves]
            for i in range(self.leaves - 1, 0, -1):
                self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])
        self.n += 1
        self.put(self.n - 1, room)
        return self.n - 1

    def put(self, at: int, room: float) -> None:
        i = at + self.leaves
        self.most[i] = room
        while i > 1:
            i //= 2
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def room(self, at: int) -> float:
        return self.most[at + self.leaves]

    def first(self, size: float) -> int | None:
        if self.most[1] < size:
            return None
        i = 1
        while i < self.leaves:
            i = 2 * i if self.most[2 * i] >= size else 2 * i + 1
        return i - self.leaves


def first_fit(items: DataFrame, archives: DataFrame, limit: int | None) -> DataFrame:
    """Online first fit per category, a fold over its items in their order:
    the first archive with room, else a new one; an item over the limit gets
    one too; without a limit, every item does.

    items: (category_id, seq, size); archives: (category_id, name, size), tried
    by name; a null size counts as 0. Adds bin: place among the category's
    archives, from 0. First fit depends on all items before, so a category is a
    task's work by definition; its rows stream through in order, and only the
    bins' free room is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rooms = None, Rooms()
        for batch in batches:
            out = []
            for c, there, seq, size in zip(*(batch.column(x).to_pylist() for x in ("category_id", "there", "seq", "size"))):
                if now != (c,):
                    now, rooms = (c,), Rooms()
                if there:
                    rooms.add(-inf if limit is None else limit - size)
                    continue
                at = None if limit is None else rooms.first(size)
                if at is None:
                    at = rooms.add(-inf if limit is None else limit - size)
                else:
                    rooms.put(at, rooms.room(at) - size)
                out.append((c, seq, size, at))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["category_id", "seq", "size", "bin"])

    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0).cast("bigint")).alias("size")
    category, none = F.col("category_id").cast("bigint").alias("category_id"), F.lit(None)
    old = archives.select(category, F.lit(True).alias("there"), none.cast("bigint").alias("seq"), size, F.col("name").cast("string").alias("name"))
    new = items.select(category, F.lit(False).alias("there"), F.col("seq").cast("bigint").alias("seq"), size, none.cast("string").alias("name"))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = old.unionByName(new).repartition(parts, "category_id").sortWithinPartitions("category_id", F.desc("there"), "name", "seq")
    return rows.select("category_id", "there", "seq", "size").mapInArrow(run, "category_id long, seq long, size long, bin long")


def next_sequence(archives: DataFrame) -> DataFrame:
    """Per category the number after that of the last name in code point order;
    1 if it can't be read."""
    last = archives.groupBy("category_id").agg(F.max("file_name").alias("last_name"))
    digits = F.regexp_extract("last_name", r"_([0-9]{1,18})(?:\.[^_.]*)?$", 1)
    return last.select("category_id", "last_name", (F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0)) + 1).alias("next_number"))


def replace_members(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Members without those of the same key, and the new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def all_or_nothing(batch: DataFrame, key: str, ok: str) -> DataFrame:
    """Rows of a batch only if all of the batch are good."""
    w = Window.partitionBy(key)
    return batch.withColumn("committed", F.min(F.col(ok)).over(w))
