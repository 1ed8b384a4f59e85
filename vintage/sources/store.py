"""Keyed tables: upserts, ingest reports, the decision journal."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions import scalars

#: Key of each table, and what an update leaves as it was first written.
KEYS = {
    "bars": (["symbol", "date"], ["knowable_at"]),
    "splits": (["symbol", "date"], []),
    "news": (["symbol", "published_at", "content_hash"], []),
    "facts": (["symbol", "concept", "period_end", "accn"], []),
    "universe": (["effective", "symbol"], []),
}


def upsert(existing: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """existing with the rows of new (with seq, their order) put in by key: the last one wins, but for the columns that stay.

    Partial maxima go before the shuffle, so repeated keys cost a row each task.
    """
    key, stay = KEYS[table]
    values = [c for c in existing.columns if c not in key]
    both = existing.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    packed = F.struct("seq", *values)
    found = both.groupBy(*key).agg(F.max_by(packed, "seq").alias("last"), F.min_by(packed, "seq").alias("first"))
    return found.select(*key, *(F.col("first" if c in stay else "last").getField(c).alias(c) for c in values)).select(*existing.columns)


def bars_frame(parsed: DataFrame) -> DataFrame:
    """Parsed bars with the date on which they are known: their own."""
    return parsed.withColumn("knowable_at", F.col("date"))


def ingest_report(requested: DataFrame, stored: DataFrame, failed: DataFrame) -> DataFrame:
    """status, symbols of each status and the share of those asked for: failed, empty or succeeded."""
    got = stored.groupBy("symbol").agg(F.count("*").alias("n"))
    joined = requested.select("symbol").distinct().join(got, "symbol", "left").join(failed.select("symbol").distinct().withColumn("bad", F.lit(True)), "symbol", "left")
    status = F.when(F.col("bad"), "failed").when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("succeeded")
    counted = joined.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("symbols"))
    total = requested.select(F.count_distinct("symbol").alias("requested"))
    # One row.
    return counted.crossJoin(F.broadcast(total)).select("status", "symbols", F.try_divide("symbols", "requested").alias("share"))


def unseen(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items whose content no classifier has judged yet."""
    return items.join(cache, "content_hash", "left_anti")


def classify(items: DataFrame, cache: DataFrame) -> DataFrame:
    """cache with the judgements of unseen items (content_hash, direction, confidence); failures are not kept."""
    direction, confidence = scalars.keyword_direction(F.col("headline"), F.col("body"))
    return cache.unionByName(unseen(items, cache).select("content_hash", direction.alias("direction"), confidence.alias("confidence")).dropDuplicates(["content_hash"]))


JOURNAL_SCHEMA = "seq long, as_of date, mode string, equity double, cash double, peak_equity double, positions map<string,double>, targets map<string,double>, vetoes array<string>, notes array<string>"


def append_journal(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal's records; torn or foreign lines are left out."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("as_of IS NOT NULL")


def journal_state(journal: DataFrame) -> DataFrame:
    """records, last_as_of (of the record written last), last_equity, total_return over the curve by date, halted days."""
    found = journal.agg(
        F.count("*").alias("records"), F.max_by("as_of", "seq").alias("last_as_of"), F.max_by("equity", "seq").alias("last_equity"),
        F.min_by("equity", F.struct("as_of", "seq")).alias("e0"), F.max_by("equity", F.struct("as_of", "seq")).alias("e1"), F.count_if(F.size("vetoes") > 0).alias("halted_days"),
    )
    return found.select("records", "last_as_of", "last_equity", F.when((F.col("records") >= 2) & (F.col("e0") > 0), F.try_divide("e1", "e0") - 1).otherwise(0.0).alias("total_return"), "halted_days")


SCHEMAS = {
    "bars": "symbol string, date date, open double, high double, low double, close double, adj_close double, volume long, knowable_at date",
    "universe": "effective date, symbol string, knowable_at date",
    "facts": "symbol string, concept string, period_end date, value double, knowable_at date, accn string",
    "splits": "symbol string, date date, ratio double, knowable_at date",
    "news": "symbol string, published_at timestamp, source string, headline string, body string, content_hash string, knowable_at date",
}


class Store:
    """The keyed tables below a folder that driver and executors share; opening it is enough to have them, empty at first.

    An upsert writes a table anew and then points to it, so a reader sees
    either version and a job that dies leaves the old one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._kept = spark, folder.rstrip("/"), None
        os.makedirs(self.folder, exist_ok=True)

    def _pointer(self, name: str) -> str:
        return f"{self.folder}/{name}.json"

    def table(self, name: str) -> DataFrame:
        if not os.path.exists(self._pointer(name)):
            return self.spark.createDataFrame([], SCHEMAS[name])
        with open(self._pointer(name)) as f:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{json.load(f)['version']}")

    def replace(self, name: str, rows: DataFrame) -> None:
        version = f"{name}-{uuid.uuid4().hex}"
        rows.select(*(c.split(" ")[0] for c in SCHEMAS[name].split(", "))).write.parquet(f"{self.folder}/{version}")
        with open(self._pointer(name) + ".new", "w") as f:
            json.dump({"version": version}, f)
        os.replace(self._pointer(name) + ".new", self._pointer(name))

    def upsert(self, name: str, new: DataFrame) -> None:
        """Put rows in by key; with seq, their order, the last of a key wins."""
        if "seq" not in new.columns:
            new = new.withColumn("seq", F.lit(0))
        self.replace(name, upsert(self.table(name), new, name))

    def preload(self, start, end, symbols: list[str] | None = None) -> DataFrame:
        """The bars of a span, of all symbols or of those named (none for an empty list), kept in the executors' memory."""
        self.drop_cache()
        found = self.table("bars").where(F.col("date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
        if symbols is not None:
            found = found.where(F.col("symbol").isin(symbols)) if symbols else found.limit(0)
        self._kept = found.persist()
        return self._kept

    def drop_cache(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
