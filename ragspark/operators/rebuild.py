"""Building and keeping a store (SRC-02, SRC-03, SRC-40, SRC-41, SNK-01..03, SNK-05, SNK-07, SNK-12..14, SNK-19, SNK-22, STA-14..16)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .composition import chunk_by_profile

EMPTY_METADATA = "{}"


def listing_mode(url: Column) -> Column:
    """single if the query names a page, else paged: by its keys, so ``per_page`` is not taken for ``page``."""
    return F.when(url.rlike(r"[?&]page="), "single").otherwise("paged")


def page_address(url: Column, page: Column, per_page: int) -> Column:
    """The address of one page of a listing: other parameters stay, ``page`` and ``per_page`` are set anew."""
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])(per_)?page=[^&#]*", "$1"), r"([?&])&+", "$1")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    return F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit(f"per_page={per_page}&page="), page.cast("string"))


def web_documents(posts: DataFrame, fetch_config: str, source: str = "blog") -> DataFrame:
    """Chunks of posts (id, item: JSON with content.rendered), each post cleaned and cut by itself and stamped; posts without text give none."""
    rows = posts.select("id", F.get_json_object("item", "$.content.rendered").alias("text"))
    stamps = {"source_type": "web", "source": source, "fetch_config": fetch_config}
    return chunk_by_profile(rows, F.lit("web"), html=True).withColumns({k: F.lit(v) for k, v in stamps.items()})


def embed_rows(docs: DataFrame, embed, dim: int, model: str) -> DataFrame:
    """``docs`` ready for a store: id, metadata ({} if missing), embedding and the model that made it."""
    meta = F.coalesce("metadata", F.lit(EMPTY_METADATA)) if "metadata" in docs.columns else F.lit(EMPTY_METADATA)
    rows = docs if "id" in docs.columns else docs.withColumn("id", F.expr("uuid()"))
    return rows.withColumn("metadata", meta).withColumn("embedding", embed(F.col("text"), dim)).withColumn("model_id", F.lit(model))


def from_texts(spark: SparkSession, texts: list[str], embed, dim: int, model: str) -> DataFrame:
    """Rows for a few texts given in code; tables go to ``embed_rows``."""
    return embed_rows(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), embed, dim, model)


def cleared(rows: DataFrame) -> DataFrame:
    """The store's table without rows."""
    return rows.limit(0)


def file_log(written: DataFrame, as_of: Column) -> DataFrame:
    """One log row a file key (url, else file_name, else page_url): chunks, and failed where no chunk has text."""
    have = [F.col(c) for c in ("url", "file_name", "page_url") if c in written.columns]
    key = F.coalesce(*[F.nullif(c, F.lit("")) for c in have], F.lit("unknown"))
    counts = written.groupBy(key.alias("file")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.length("text") > 0).alias("full"))
    return counts.select("file", "n_chunks", F.when(F.col("full") > 0, "success").otherwise("failed").alias("status"), as_of.alias("logged_at"))


def refresh_all(rows: DataFrame, datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """The store with the rows of each dataset's type replaced: {type: (new rows, source file)}; every row is tagged with its file."""
    for kind, (new, source_file) in datasets.items():
        rows = store.full_refresh(rows, new.withColumn("source_file", F.lit(source_file)), kind)
    return rows


def verify_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after, complete."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = n(before, "n_before").join(F.broadcast(n(after, "n_after")))  # one row each
    return both.withColumn("complete", F.col("n_before") == F.col("n_after"))


def enrich_and_embed(rows: DataFrame, title: Column, embed, dim: int) -> DataFrame:
    """Titles put before texts that have none; only changed rows get a new embedding. Adds changed."""
    new = store.enrich_titles(rows.withColumn("_before", F.col("text")), title).withColumn("changed", ~F.col("text").eqNullSafe(F.col("_before")))
    made = embed(F.when(F.col("changed"), F.col("text")), dim)
    return new.withColumn("embedding", F.when(F.col("changed"), made).otherwise(F.col("embedding").cast("array<double>"))).drop("_before")


def scan_user_map(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, pos, item) of JSON objects keyed by user, one object a file."""
    return store.flatten_users(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def write_user_map(items: DataFrame, path: str) -> None:
    """JSON lines of one user each (user_id, pos, item): the map's rewrite, a folder that is replaced as a whole."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    items.groupBy("user_id").agg(F.to_json(F.struct(F.first("user_id").alias("user_id"), rows.alias("items"))).alias("line")).select("line").write.mode("overwrite").text(path)


def scan_pages_of_rows(fetch: Callable[[int, int], list[dict]], fetch_one: Callable[[int], dict | None], spark: SparkSession, total: int, page: int, schema: str) -> DataFrame:
    """(offset, ok, row) of a store read by offset and limit in tasks; a page that fails is read row by row, and rows that fail stay as ok = false."""
    import pandas as pd
    from pyspark.sql import types as T

    def run(frames):
        for frame in frames:
            out = []
            for start in frame["id"].tolist():
                size = min(page, total - start)
                try:
                    got = fetch(start, size)
                    if len(got) != size:
                        raise ValueError("short page")
                    out += [(start + i, True, row) for i, row in enumerate(got)]
                except Exception:  # a corrupt page is quarantined row by row
                    for at in range(start, start + size):
                        try:
                            row = fetch_one(at)
                        except Exception:
                            row = None
                        out.append((at, row is not None, row))
            yield pd.DataFrame(out, columns=["offset", "ok", "row"])

    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else schema
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in kind.fields)
    return spark.range(0, total, page, 8).mapInPandas(run, f"offset long, ok boolean, row struct<{fields}>")


def snapshot(files: DataFrame, enabled: DataFrame, path: Column, content: Column, by: str = "source") -> DataFrame:
    """Fingerprints of the sources that ``enabled`` has in its column ``by``, however many."""
    return store.fingerprint(files.join(enabled.select(by).distinct(), by, "left_semi"), by, path, content)


def rebuild_changed(rows: DataFrame, stored: DataFrame, current: DataFrame, documents: DataFrame, by: str = "source") -> DataFrame:
    """The store after an incremental rebuild: sources whose fingerprint changed are replaced by their ``documents``, removed ones go, the rest stays."""
    changed = store.changed_sources(stored, current, by)
    kept = rows.join(changed.select(by), by, "left_anti")
    new = documents.join(changed.filter("status <> 'removed'").select(by), by, "left_semi")
    return kept.unionByName(new)


def lifecycle(exists: bool, n_changed: int, force: bool = False, enabled: bool = True) -> str:
    """What a start does: none (building is off and there is no store), rebuild, incremental or load."""
    if not exists:
        return "rebuild" if enabled or force else "none"
    if force:
        return "rebuild"
    return "incremental" if n_changed and enabled else "load"


def status(rows: DataFrame, stored: DataFrame, current: DataFrame, by: str = "source") -> DataFrame:
    """(source, n_rows, state) of every source that the store or the snapshots know: unchanged, new, changed or removed."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    known = stored.select(by).unionByName(current.select(by)).distinct()
    state = store.changed_sources(stored, current, by).withColumnRenamed("status", "state")
    out = known.join(counts, by, "left").join(state, by, "left")
    return out.select(by, F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.coalesce("state", F.lit("unchanged")).alias("state"))
