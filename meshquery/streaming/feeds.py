"""Structured Streaming: event feeds, watch rules with state, bucket aggregates with watermarks, delta feeds, rotation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.timeseries import PERIODS

EVENTS = "type string, domain string, ts timestamp, payload string"
# Events that go to every subscriber.
SYSTEM = ("runtime_started", "runtime_stopped", "cache_cleared", "maintenance")
ALERTS = "id string, domain string, url string, field string, ts timestamp, before double, value double"


def event_feed(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events from a folder of JSON files that grows."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def delta_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def for_domain(events: DataFrame, domain: str) -> DataFrame:
    """A domain's events and those of the system."""
    return events.where((F.col("domain") == domain) | F.col("type").isin(*SYSTEM))


def timestamped(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def bucket_stream(points: DataFrame, keys: list[str], period: str, lateness: str = "1 day") -> DataFrame:
    """Min, max, mean and count per epoch-anchored bucket; late points up to ``lateness`` count."""
    days = PERIODS[period] // 86_400
    return timestamped(points).withWatermark("ts", lateness).groupBy(F.window("ts", f"{days} days"), *keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("n")).select(*keys, F.col("window.start").alias("bucket"), "low", "high", "mean", "n")


def session_stream(points: DataFrame, keys: list[str], gap: str, lateness: str = "1 day") -> DataFrame:
    return timestamped(points).withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _fires(kind: str, threshold: float, now: float, before: float | None) -> bool:
    if kind == "new_instance":
        return before is None
    if before is None:
        return False
    if kind == "value_above":
        return now > threshold >= before
    if kind == "value_below":
        return now < threshold <= before
    if kind == "change_by_percent":
        return before != 0 and abs((now - before) / before) > threshold
    return kind == "available" and before <= 0 < now


# A state is a bucket's of series, not one series': a batch costs a call a bucket, however many series it has, and a call reads a share of them.
BUCKETS, SERIES = 4096, ["domain", "url", "field"]
NAMES = "domain array<string>, url array<string>, field array<string>"


def bucketed(points: DataFrame, *kept: str):
    return points.select(F.pmod(F.xxhash64(*SERIES), F.lit(BUCKETS)).cast("int").alias("bucket"), *SERIES, *kept, "value").groupBy("bucket")


def _columns(pdf: pd.DataFrame, *numbers: str) -> tuple[list, ...]:
    """The columns of points as a state holds them."""
    return (*(pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in SERIES), *(pdf[c].tolist() for c in numbers))


def _stepped(state, pdf: pd.DataFrame, at: str) -> pd.DataFrame:
    """Points in their order, each with the value before it in its series; the state then has every series' last value."""
    *names, values = _columns(pdf.astype({"value": "float64"}), "value")
    *known, lasts = state.get() or ([], [], [], [])
    last, before = dict(zip(zip(*known, strict=True), lasts, strict=True)), []
    for name, value in zip(zip(*names, strict=True), values, strict=True):
        before.append(last.get(name))
        last[name] = value
    state.update((*map(list, zip(*last, strict=True)), list(last.values())))
    return pd.DataFrame(dict(zip(SERIES, names, strict=True)) | {at: pdf[at].to_numpy(), "before": pd.array(before, dtype="Float64"), "value": values})


class LastValue(StatefulProcessor):
    """Keeps the last values of a bucket's series; gives each new value with the one before it, in time order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"{NAMES}, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        yield _stepped(self.last, pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable"), "ts")

    def close(self) -> None:
        pass


class OrderedValues(StatefulProcessor):
    """Holds the points of a bucket's series until the watermark has passed them, then gives each with the one before it in event time: however
    points arrive, and in whatever batches, the steps are those of the whole series. A batch sets one timer per bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"{NAMES}, value array<double>")
        self.held = handle.getListState("held", f"{NAMES}, us array<bigint>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:
            pdf = pdf.astype({"us": "int64", "value": "float64"})
            self.held.appendValue(_columns(pdf, "us", "value"))
            newest = max(int(pdf.us.max()), newest if newest is not None else int(pdf.us.max()))
        if newest is not None:
            self.handle.registerTimer(newest // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        held = [pd.DataFrame(dict(zip([*SERIES, "us", "value"], chunk, strict=True))) for chunk in self.held.get()]
        if not held:  # an earlier timer of this turn gave all
            return
        points = pd.concat(held, ignore_index=True)
        due = points.us < limit
        if due.any():
            self.held.clear()
            if not due.all():
                self.held.appendValue(_columns(points[~due], "us", "value"))
            yield _stepped(self.last, points[due].sort_values(["us", "value"], kind="stable", na_position="first"), "us")

    def close(self) -> None:
        pass


def ordered_steps(points: DataFrame, lateness: str) -> DataFrame:
    """(domain, url, field, ts, before, value) of a stream of points in event time. A point may be late by ``lateness``; its step is given
    when the stream's time has passed it by as much. Points of one time go by value, as in the batch query."""
    told = bucketed(timestamped(points).withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness), "ts", "us")
    out = told.transformWithStateInPandas(OrderedValues(), "domain string, url string, field string, us long, before double, value double", "append", "EventTime")
    return out.select("domain", "url", "field", F.timestamp_micros("us").alias("ts"), "before", "value")


def steps(points: DataFrame) -> DataFrame:
    """(domain, url, field, ts, before, value) of a stream of points; needs the RocksDB state store."""
    return bucketed(timestamped(points), "ts").transformWithStateInPandas(LastValue(), "domain string, url string, field string, ts timestamp, before double, value double", "append", "None")


#: So many rules are broadcast; the points of a field meet more rules in so many parts.
RULES, PARTS = 100_000, 64


def _watched(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points with the rules of their field. Which side is broadcast is said here: Spark goes by what a batch reads, and a batch of one late row can
    give all that waited for it, more than the driver holds. More rules are joined by sort, in parts, for points often have a few (domain, field)."""
    if rules.limit(RULES + 1).count() <= RULES:
        return points.join(F.broadcast(rules), ["domain", "field"])
    each = rules.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return points.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS).cast("long"))).join(each.hint("merge"), ["domain", "field", "part"]).drop("part")


def alert_stream(points: DataFrame, rules: DataFrame, lateness: str | None = None) -> DataFrame:
    """Alerts of active rules on a stream of points: state per series, then a join with the rules. With ``lateness`` points are taken in event
    time (``ordered_steps``), else as they come. Rules are saved first, so that every batch reads the same ones."""
    from ..operators.graph import written
    from ..operators.timeseries import fires

    kept = written(rules.where("active").drop("active"), "rules")
    met = _watched(steps(points) if lateness is None else ordered_steps(points, lateness), kept)
    return met.where(F.coalesce(fires(F.col("condition"), F.col("threshold"), F.col("value"), F.col("before")), F.lit(False))).select("id", "domain", "url", "field", "ts", "before", "value")


def append_rotating(stream: DataFrame, path: str, checkpoint: str, batches: int = 100):
    """Appends a stream as JSON lines to numbered folders, a new one every ``batches`` micro-batches; a repeated batch replaces its own rows."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{path}/part={batch // batches}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected_every(stream: DataFrame, path: str, checkpoint: str, keys: list[str], keep: int, ticks: int = 12, every: str | None = None):
    """Gathers a stream of rows with ``ts`` under ``path``; every ``ticks`` micro-batches what is there becomes a new version with the
    newest ``keep`` of each key. Readers take ``collected``: a version is published when it is whole, and the one before it is
    removed at the next turn, so that nobody loses what they read."""
    from ..operators.delta import keep_last

    def put(rows: DataFrame, batch: int) -> None:
        version = batch // ticks
        rows.write.mode("overwrite").parquet(f"{path}/version={version}/batch={batch}")
        if batch and batch % ticks == 0:
            spark = rows.sparkSession
            older = spark.read.schema(rows.schema).parquet(f"{path}/version={version - 1}/batch=*")
            keep_last(older, keys, keep).write.mode("overwrite").parquet(f"{path}/version={version}/batch={batch - 1}")
            spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/_published")
            _remove(spark, f"{path}/version={version - 2}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def collected(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``collected_every`` has gathered: the rows of the version published last, and of no other."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    version = (spark.read.schema("version long").parquet(f"{path}/_published").agg(F.max("version")).first()[0] if found else None) or 0
    return spark.read.schema(schema).parquet(f"{path}/version={version}/batch=*")


class ProgressEvents(StreamingQueryListener):
    """Turns the progress of streaming queries into events (type, name, batch, rows) for a callback."""

    def __init__(self, tell):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell({"type": "runtime_started", "name": event.name, "batch": None, "rows": None})

    def onQueryProgress(self, event) -> None:
        self.tell({"type": "progress", "name": event.progress.name, "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell({"type": "runtime_stopped", "name": None, "batch": None, "rows": None})


def changed_steps(points: DataFrame, dims: list[str], least: float) -> DataFrame:
    """Steps of a stream of points in some fields only that move by over ``least``: the old and the new value."""
    return steps(points.where(F.col("field").isin(dims))).where(F.abs(F.col("value") - F.col("before")) > least)


def append_to(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts writing a stream as JSON lines; a trigger interval is the maintenance tick."""
    writer = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
