"""Queries over the log of events: its moments as locales write them, and its revisions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..ship import ship, spread, work_folder
from ..streaming.revisions import revision_stream, state_on_disk
from .queries import _table, query

#: Names of months.
_THAI = "['มกราคม', 'กุมภาพันธ์', 'มีนาคม', 'เมษายน', 'พฤษภาคม', 'มิถุนายน', 'กรกฎาคม', 'สิงหาคม', 'กันยายน', 'ตุลาคม', 'พฤศจิกายน', 'ธันวาคม']"
_THAI_SHORT = "['ม.ค.', 'ก.พ.', 'มี.ค.', 'เม.ย.', 'พ.ค.', 'มิ.ย.', 'ก.ค.', 'ส.ค.', 'ก.ย.', 'ต.ค.', 'พ.ย.', 'ธ.ค.']"
_INDONESIAN = "['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des']"


@query(f"""
WITH e AS (SELECT event_id, ts, ts + INTERVAL 7 HOUR AS east FROM events)
SELECT event_id, strftime(ts, '%b %-d, %Y') AS en, day(ts) || ' thg ' || month(ts) || ', ' || year(ts) AS vi, day(ts) || ' ' || {_THAI_SHORT}[month(ts)] || ' ' || (year(ts) + 543) AS th,
  day(ts) || ' ' || {_INDONESIAN}[month(ts)] || ' ' || year(ts) AS id, translate(day(east) || ' ' || {_THAI}[month(east)] || ' ' || (year(east) + 543), '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS in_thailand,
  strftime(ts, '%-I:%M') || chr(8239) || strftime(ts, '%p') AS time_en, strftime(ts, '%H:%M') AS time_vi, strftime(ts, '%H.%M') AS time_id FROM e""")
def event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and times of events as four locales write them, and the day in Thailand in its own digits."""
    at = F.col("ts").cast("timestamp")
    days = [dates.format_date(spark, at, c).alias(c) for c in ("en", "vi", "th", "id")]
    abroad = dates.format_date_for_country(spark, at, "TH", style="long", native_digits=True).alias("in_thailand")
    times = [dates.format_time(spark, at, c).alias(f"time_{c}") for c in ("en", "vi", "id")]
    return spread(_table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", *days, abroad, *times)


@query("""
WITH e AS (SELECT event_id, event_type || ':' || user_id AS key, ['th', 'vi', 'id'][event_id % 3 + 1] AS locale, ts, props FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 0))
SELECT event_id, key, locale, lag(props) OVER (PARTITION BY key, locale ORDER BY ts, event_id) AS before, props AS after FROM e""")
def streamed_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of edits in three locales, the value before each from the state of its slot; those of regulated keys by ai are refused."""
    ship(spark)
    kinds = _table(spark, sf_dir, "events")
    # A pattern that fits the table alone, be it a file or a folder.
    events = spark.readStream.schema(kinds.schema).parquet(f"{sf_dir}/events.[p]arquet")
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"))
    locale = F.get(F.array(*map(F.lit, ("th", "vi", "id"))), (F.col("event_id") % 3).cast("int"))
    source = F.when(F.col("event_id") % 2 == 0, "ai").otherwise("human")
    edits = events.select(F.col("event_id").alias("id"), key.alias("key"), locale.alias("locale"), F.lit("neutral").alias("register"), F.col("props").alias("value"), F.lit("u").alias("user"), source.alias("source"), F.col("ts").cast("timestamp").alias("at"))
    regulated = kinds.where("event_type = 'error'").select(key.alias("key")).distinct()
    folder = work_folder(spark, "revisions")
    with state_on_disk(spark):
        run = revision_stream(edits, regulated=regulated).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(F.col("id").alias("event_id"), "key", "locale", "before", "after")
