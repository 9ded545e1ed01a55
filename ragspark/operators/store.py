"""Table mutations as copy-on-write frames (SNK-01..16, JOIN-03..05, AGG-13, STA-14..17) and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transactions import TransactionalStore


def upsert_last_writer(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def delete_ids(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def replace_by_key(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys in ``new`` give way to it."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append the rows whose key the store does not have; a null key counts as a key."""
    have = store.select(F.col(key).alias("_have")).distinct()
    return store.unionByName(new.join(have, F.col(key).eqNullSafe(F.col("_have")), "left_anti"))


def enrich_titles(store: DataFrame, title: Column) -> DataFrame:
    """Put a heading before texts that have none; running it again changes nothing."""
    return store.withColumn("text", F.when(F.col("text").startswith("# "), F.col("text")).otherwise(F.concat(F.lit("# "), title, F.lit("\n"), F.col("text"))))


def fingerprint(files: DataFrame, by: str, path: Column, content: Column) -> DataFrame:
    """A fingerprint of each source in two levels: md5 over the sorted ``path:md5(content)`` of each of 4,096 parts, dealt by
    md5 of the path, then md5 over the sorted ``part:md5``. So no row holds all files of a large source."""
    name = path.cast("string")
    entries = files.select(F.col(by), F.substring(F.md5(name), 1, 3).alias("_part"), F.concat_ws(":", name, F.md5(content)).alias("_entry"))
    joined = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(c)), "|"))
    parts = entries.groupBy(by, "_part").agg(joined("_entry").alias("_digest"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(by).agg(joined(F.concat_ws(":", "_part", "_digest")).alias("fingerprint"), F.sum("_n").alias("n_files"))


def changed_sources(stored: DataFrame, current: DataFrame, key: str = "source", value: str = "fingerprint") -> DataFrame:
    """Sources whose fingerprint differs, null-safe: new, removed or changed."""
    a, b = stored.select(F.col(key).alias("k1"), F.col(value).alias("v1")), current.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    both = a.join(b, F.col("k1") == F.col("k2"), "full_outer")
    status = F.when(F.col("k1").isNull(), "new").when(F.col("k2").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("v1").eqNullSafe(F.col("v2"))).select(F.coalesce("k1", "k2").alias(key), status.alias("status"))


def file_status(files: DataFrame, log: DataFrame) -> DataFrame:
    """new, updated or up_to_date, by version hash and then by url."""
    by_url = log.select(F.col("url").alias("_url"), F.col("version").alias("_version"))
    joined = files.join(by_url, files["url"] == by_url["_url"], "left")
    status = F.when(F.col("_url").isNull(), "new").when(F.col("version").eqNullSafe(F.col("_version")), "up_to_date").otherwise("updated")
    return joined.withColumn("status", status).drop("_url", "_version")


def version_hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def coerce_time(value: Column) -> Column:
    """The timestamp of an ISO text, with Z or an offset or neither; null for any other text."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")))


def upsert_users(store: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Conversations (user_id, messages, created_at, last_updated), the new ones replacing a user's old one.

    Times come as text; one that is missing or can't be read becomes ``as_of``.
    """
    coerced = new.select("user_id", "messages", *[F.coalesce(coerce_time(F.col(c)), as_of).alias(c) for c in ("created_at", "last_updated")])
    return replace_by_key(store, coerced, ["user_id"])


def flatten_users(rows: DataFrame) -> DataFrame:
    """(user_id, pos, item) of JSON objects ``payload`` keyed by user: a list gives a row an element, a dict or scalar one row."""
    users = rows.select(F.explode(F.from_json("payload", "map<string,string>")).alias("user_id", "value"))
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return users.select("user_id", F.posexplode(items).alias("pos", "item"))


def full_refresh(store: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """The store with all rows of one ``type`` replaced by ``new``, which may be empty."""
    return store.filter(~F.col("type").eqNullSafe(F.lit(kind))).unionByName(new.withColumn("type", F.lit(kind)), allowMissingColumns=True)


def migrate_vectors(rows: DataFrame, dim: int, embed) -> DataFrame:
    """Rows (text, embedding, ...) with ``embedding`` copied where it has ``dim`` numbers, else made anew from the text; ``copied`` tells which."""
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    made = F.when(fits, F.col("embedding").cast("array<double>")).otherwise(embed(F.col("text"), dim))
    return rows.withColumn("copied", fits).withColumn("embedding", made)


class SnapshotStore(TransactionalStore):
    """A table whose every write is a version of its own: readers keep the one they opened, and writers at the same time do not lose each other's rows."""

    def __init__(self, spark: SparkSession, path: str, partition_by: str | None = "source"):
        super().__init__(spark, path, partition_by)

    def write(self, df: DataFrame) -> int:
        """The version that has these rows only."""
        return self.overwrite(df)
