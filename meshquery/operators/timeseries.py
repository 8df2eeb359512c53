"""Time series of (key..., ts, value): buckets, trend, prediction, periodicity, anomalies, as-of, watch rules."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written
from .ranks import ranked

# Period widths in seconds (a month is thirty days), and the thresholds of the detectors.
PERIODS = {"day": 86_400, "week": 604_800, "month": 2_592_000}
LEAST_FIT, STABLE = 0.3, 0.01
LEAST_REPEAT, LEAST_POINTS, DEVIATIONS = 0.5, 7, 2.0
#: Points of a series that one task transforms, and frequencies that one task multiplies.
BLOCK, SLICE = 1 << 16, 1 << 12


def seconds(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6


def history(points: DataFrame, domain: str | None = None, url: str | None = None, field: str | None = None, since=None, until=None) -> DataFrame:
    """Points of one node and field after ``since`` (exclusive) up to ``until``, in time order."""
    out = points
    for name, value in (("domain", domain), ("url", url), ("field", field)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if since is not None:
        out = out.where(F.col("ts") > F.lit(since))
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until))
    return out.orderBy("ts")


def compare_history(points: DataFrame, nodes: list[tuple[str, str]], field: str, since=None) -> DataFrame:
    """The series of several (domain, url) nodes side by side, long form."""
    spark = points.sparkSession
    asked = spark.createDataFrame(nodes, "domain string, url string")
    return history(points.join(F.broadcast(asked), ["domain", "url"], "left_semi"), field=field, since=since)


def changes(points: DataFrame, keys: list[str], since=None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the value before it: (keys, ts, old_value, new_value) where it differs. ``ties`` order points of one
    time; without them, they stand in the order of their values."""
    w = W.partitionBy(*keys).orderBy("ts", *(ties or ("value",)))
    out = points.withColumn("old_value", F.lag("value").over(w)).withColumnRenamed("value", "new_value")
    out = out.where(F.col("old_value").isNull() | (F.col("old_value") != F.col("new_value")))
    return out if since is None else out.where(F.col("ts") > F.lit(since))


def buckets(points: DataFrame, keys: list[str], period: str, how: str, tie: str | None = None) -> DataFrame:
    """(keys, bucket timestamp, value, raw_count): min, max, avg, first or last per epoch-anchored bucket."""
    width = PERIODS[period]
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width) * width)
    order = F.struct("ts", tie) if tie else F.col("ts")
    value = {"min": F.min("value"), "max": F.max("value"), "avg": F.avg("value"), "first": F.min_by("value", order), "last": F.max_by("value", order)}[how]
    return points.groupBy(*keys, start.alias("bucket")).agg(value.alias("value"), F.count("*").alias("raw_count"))


def _line(points: DataFrame, keys: list[str], day: Column | None = None) -> DataFrame:
    """Least-squares sums per key over days since the key's first point."""
    first = points.groupBy(*keys).agg(F.min(seconds()).alias("t0"))
    x = (seconds() - F.col("t0")) / 86_400
    return (
        points.join(first, keys)
        .select(*keys, x.alias("x"), F.col("value").cast("double").alias("y"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.var_pop("x").alias("vx"),
            F.var_pop("y").alias("vy"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("intercept"),
            F.regr_r2("y", "x").alias("r2"),
            F.max("x").alias("last_x"),
            F.max_by("y", "x").alias("last_y"),
        )
    )


def trends(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction, slope per day, r2): series of three points or more with a fit of 0.3 or better."""
    fits = _line(points, keys).withColumn("r2", F.when(F.col("vy") == 0, 0.0).otherwise(F.col("r2")))
    direction = F.when(F.abs("slope") < STABLE, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return fits.where((F.col("n") >= 3) & (F.col("vx") * F.col("n") * F.col("n") >= 1e-10) & (F.col("r2") >= LEAST_FIT)).select(*keys, direction.alias("direction"), "slope", "r2")


def predictions(points: DataFrame, keys: list[str], days: float) -> DataFrame:
    """(keys, predicted): the fitted line ``days`` after the last point; the last value where time stands still."""
    fits = _line(points, keys).where("n >= 3")
    flat = F.col("vx") * F.col("n") * F.col("n") < 1e-10
    return fits.select(*keys, F.when(flat, F.col("last_y")).otherwise(F.col("intercept") + F.col("slope") * (F.col("last_x") + days)).alias("predicted"))


def anomalies(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points over two population deviations from their series' mean; series of five points or more."""
    stats = points.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.count("*").alias("n"))
    joined = points.join(stats.where("n >= 5 and spread >= 1e-6"), keys)
    z = F.abs(F.col("value") - F.col("mean")) / F.col("spread")
    return joined.withColumn("deviation", z).where(F.col("deviation") > DEVIATIONS).drop("n")


def _strongest(values: np.ndarray) -> tuple[int, float] | None:
    """The lag from 2 to below half the series with the strongest autocorrelation; all lags from one transform."""
    n = len(values)
    if n < LEAST_POINTS:
        return None
    c = values - values.mean()
    var = float((c * c).mean())
    last = n // 2 - 1
    if var < 1e-6 or last < 2:
        return None
    size = 1 << (2 * n - 1).bit_length()
    wave = np.fft.rfft(c, size)
    sums = np.fft.irfft(wave * wave.conj(), size)[: last + 1]
    lags = np.arange(2, last + 1)
    r = np.round(sums[2:] / ((n - lags) * var), 12)
    best = int(r.argmax())
    return (int(lags[best]), float(r[best])) if r[best] >= LEAST_REPEAT else None


def periodicity(points: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, lag, strength, period_seconds, phase): the lag of the strongest autocorrelation of 0.5 or more, the smaller
    on ties. Series of up to ``block`` points are transformed in one task each, longer ones by blocks of points (``_by_blocks``)."""
    slim = points.select(*keys, seconds().alias("t"), F.col("value").cast("double").alias("v"))
    stats = slim.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    series = written(stats.where((F.col("n") >= LEAST_POINTS) & (F.col("var") >= 1e-6)).withColumn("series", F.monotonically_increasing_id()), "series")
    told = series.select("series", "n", "mean", "var", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    rows = slim.join(told, same).select("series", "n", "var", "t", (F.col("v") - F.col("mean")).alias("c"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _strongest(pdf.sort_values("t", kind="stable").c.to_numpy(dtype=np.float64))
        return pd.DataFrame([[int(pdf["series"].iloc[0]), *got]] if got else [], columns=["series", "lag", "strength"])

    short = rows.where(F.col("n") <= block).groupBy("series").applyInPandas(one, "series long, lag long, strength double")
    found = short
    if not series.where(F.col("n") > block).isEmpty():
        found = short.unionByName(_by_blocks(rows.where(F.col("n") > block), block))
    period = (F.col("t1") - F.col("t0")) / F.col("n") * F.col("lag")
    phase = F.when(F.col("period_seconds") > 0, F.pmod("t1", "period_seconds") / F.col("period_seconds")).otherwise(0.0)
    return found.join(series, "series").withColumn("period_seconds", period).select(*keys, F.col("lag").cast("int").alias("lag"), "strength", "period_seconds", phase.alias("phase"))


def _by_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(series, lag, strength) of rows (series, n, var, t, c) of long series, by a transform in two steps. Points are ranked by a
    range sort and cut into at most 256 blocks of m. Each block is transformed apart, at twice its length; for each frequency the
    products of blocks d apart are added (themselves by a transform along the blocks); transformed back, difference d holds the
    lag sums from (d - 1) * m to (d + 1) * m. Points move three times, however many lags there are, and no task holds more than
    a block or a slice of frequencies of all blocks."""
    m = F.greatest(F.lit(block).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / F.lit(256.0)))).cast("long"))
    placed = ranked(rows, ["series"], [F.asc("t")], "i").withColumn("m", m).withColumn("block", F.floor(F.col("i") / F.col("m")))

    def transformed(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = int(pdf["m"].iloc[0]), int(pdf["n"].iloc[0])
        wave = np.zeros(2 * size)
        wave[(pdf["i"] % size).to_numpy()] = pdf["c"].to_numpy()
        spectrum = np.fft.rfft(wave)
        cuts = range(0, len(spectrum), SLICE)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "slice": np.arange(len(cuts)), "block": pdf["block"].iloc[0], "n": n, "m": size, "var": pdf["var"].iloc[0], "data": [spectrum[c : c + SLICE].tobytes() for c in cuts]})

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        n, size = int(pdf["n"].iloc[0]), int(pdf["m"].iloc[0])
        blocks, most = -(-n // size), (n // 2 - 1) // size + 1
        spectra = np.zeros((blocks, len(pdf["data"].iloc[0]) // 16), dtype=complex)
        for at, data in zip(pdf["block"], pdf["data"], strict=True):
            spectra[at] = np.frombuffer(data, dtype=complex)
        along = np.fft.fft(spectra, 1 << (blocks + most).bit_length(), axis=0)
        products = np.fft.ifft(along * along.conj(), axis=0)[: most + 1]
        return pd.DataFrame({"series": pdf["series"].iloc[0], "apart": np.arange(most + 1), "slice": pdf["slice"].iloc[0], "n": n, "m": size, "var": pdf["var"].iloc[0], "data": [p.tobytes() for p in products]})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        size, apart = int(pdf["m"].iloc[0]), int(pdf["apart"].iloc[0])
        sums = np.fft.irfft(np.frombuffer(b"".join(pdf.sort_values("slice")["data"]), dtype=complex), 2 * size)
        halves = [(apart, sums[:size]), (apart - 1, sums[size:])]
        kept = [(at, half.tobytes()) for at, half in halves if at >= 0]
        return pd.DataFrame({"series": pdf["series"].iloc[0], "at": [a for a, _ in kept], "n": pdf["n"].iloc[0], "m": size, "var": pdf["var"].iloc[0], "data": [d for _, d in kept]})

    def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
        n, size, at = int(pdf["n"].iloc[0]), int(pdf["m"].iloc[0]), int(pdf["at"].iloc[0])
        lags = at * size + np.arange(size)
        inside = (lags >= 2) & (lags <= n // 2 - 1)
        if not inside.any():
            return pd.DataFrame(columns=["series", "lag", "strength"])
        r = np.round(sum(np.frombuffer(d) for d in pdf["data"])[inside] / ((n - lags[inside]) * pdf["var"].iloc[0]), 12)
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "lag": [int(lags[inside][r.argmax()])], "strength": [float(r.max())]})

    form = "series long, {} long, {}n long, m long, var double, data binary"
    spectra = placed.groupBy("series", "block").applyInPandas(transformed, form.format("slice", "block long, "))
    products = spectra.groupBy("series", "slice").applyInPandas(multiplied, form.format("apart", "slice long, "))
    sums = products.groupBy("series", "apart").applyInPandas(summed, form.format("at", ""))
    best = sums.groupBy("series", "at").applyInPandas(strongest, "series long, lag long, strength double")
    return best.groupBy("series").agg(F.max(F.struct("strength", (-F.col("lag")).alias("back"))).alias("b")).select("series", (-F.col("b.back")).alias("lag"), F.col("b.strength").alias("strength")).where(F.col("strength") >= LEAST_REPEAT)


def patterns(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, detail): trends, periodicities and anomalies of every series, as one table."""
    shown = lambda df, kind, *cols: df.select(*keys, F.lit(kind).alias("kind"), F.to_json(F.struct(*cols)).alias("detail"))
    return (
        shown(trends(points, keys), "trend", "direction", "slope", "r2")
        .unionByName(shown(periodicity(points, keys), "periodic", "lag", "strength", "period_seconds", "phase"))
        .unionByName(shown(anomalies(points, keys), "anomaly", "ts", "value", "deviation"))
    )


def value_ago(points: DataFrame, keys: list[str], now, days: int) -> DataFrame:
    """(keys, value): the last value at or before ``now`` minus ``days``. One aggregate, no join with the series."""
    cut = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return points.where(F.col("ts").cast("timestamp") <= cut).groupBy(*keys).agg(F.max_by("value", "ts").alias("value"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its keys not after it: one shuffle, a running window over the union."""
    tag = [f"_v_{v}" for v in values]
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(f"struct<{','.join(f'{t}:{right.schema[v].dataType.simpleString()}' for t, v in zip(tag, values, strict=True))}>").alias("_hit"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*[F.col(v).alias(t) for v, t in zip(values, tag, strict=True)]).alias("_hit"))
    run = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = a.unionByName(b).withColumn("_hit", F.last("_hit", ignorenulls=True).over(run)).where("_side = 1")
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in left.columns], *[F.col(f"_hit.{t}").alias(f"asof_{v}") for t, v in zip(tag, values, strict=True)])


def enrich(rows: DataFrame, pseudo: dict[str, tuple[str, str, int | None]], points: DataFrame | None, now: dt.datetime | None) -> DataFrame:
    """Adds temporal pseudo-columns (name -> kind, base field, days) by left joins on (domain, url)."""
    if points is None:
        raise ValueError("temporal columns need a history")
    keys = ["domain", "url"]
    clock = F.lit(now) if now is not None else F.current_timestamp()
    for name, (kind, base, days) in pseudo.items():
        own = points.where(F.col("field") == base.removesuffix("_domain"))
        if kind == "ago":
            got = value_ago(own, keys, now, days) if now is not None else own.where(F.col("ts") <= clock - F.expr(f"INTERVAL {days} DAYS")).groupBy(*keys).agg(F.max_by("value", "ts").alias("value"))
        elif kind == "trend":
            got = trends(own, keys).select(*keys, F.col("direction").alias("value"))
        elif kind == "predicted":
            got = predictions(own, keys, days).select(*keys, F.col("predicted").alias("value"))
        else:
            low = "price" in base or "cost" in base
            pick = F.min if low else F.max
            if kind == "best":
                got = own.groupBy(*keys).agg(pick("value").alias("value"))
            else:  # the domain that had the best value of all
                best = (F.min_by if low else F.max_by)("domain", F.struct("value", "domain"))
                rows = rows.crossJoin(F.broadcast(own.agg(best.alias(name))))  # one row
                continue
        rows = rows.join(got.withColumnRenamed("value", name), keys, "left")
    return rows


CONDITIONS = ("value_above", "value_below", "change_by_percent", "available", "new_instance")


def fires(kind: Column, threshold: Column, now: Column, before: Column) -> Column:
    """Whether a watch condition fires on a pair of consecutive values."""
    return (
        F.when(kind == "value_above", (now > threshold) & (before <= threshold))
        .when(kind == "value_below", (now < threshold) & (before >= threshold))
        .when(kind == "change_by_percent", (before != 0) & (F.abs((now - before) / F.nullif(before, F.lit(0.0))) > threshold))
        .when(kind == "available", (before <= 0) & (now > 0))
        .when(kind == "new_instance", before.isNull() & now.isNotNull())
        .otherwise(False)
    )


def alerts(points: DataFrame, rules: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Active rules (id, domain, field, condition, threshold, active) on every step of the series they watch. ``ties`` order
    points of one time and are kept."""
    w = W.partitionBy("domain", "url", "field").orderBy("ts", *(ties or ("value",)))
    steps = points.withColumn("before", F.lag("value").over(w))
    met = steps.join(rules.where("active").drop("active"), ["domain", "field"])
    return met.where(F.coalesce(fires(F.col("condition"), F.col("threshold"), F.col("value"), F.col("before")), F.lit(False))).select("id", "domain", "url", "field", "ts", *ties, "before", "value")


def with_rule(rules: DataFrame, rule: DataFrame) -> DataFrame:
    """The rules with one or more added; those of the same id are replaced."""
    return rules.join(rule.select("id"), "id", "left_anti").unionByName(rule)


def without_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.where(F.col("id") != rule_id)


def last_triggered(rules: DataFrame, raised: DataFrame) -> DataFrame:
    """The rules with the time of their latest alert, and how many there were."""
    seen = raised.groupBy("id").agg(F.max("ts").alias("last_triggered"), F.count("*").alias("alerts"))
    return rules.join(seen, "id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0).cast("long")))


def moment(text: Column) -> Column:
    """A time argument: RFC 3339, or a date alone; null if neither."""
    stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(F.regexp_replace(F.upper(text), "Z$", "+00:00")))
    return F.coalesce(stamp, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00+00:00")))))


def recent(rows: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    return rows.orderBy(F.col(ts).desc()).limit(n)
