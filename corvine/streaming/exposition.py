"""Counters and histograms of a stream of query records, in the text format that monitoring systems read.

Each batch adds its counts as a table of its own (batch=number, so that a repeated batch counts once); the totals are their sums, a row for each
metric, label and bucket, which no number of records makes more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


@dataclass(frozen=True)
class Counter:
    """Records for which `when` holds (all), by the value of `label`; a null label is `none`."""

    name: str
    about: str
    label: str | None = None
    value: Column | None = None
    when: Column | None = None


@dataclass(frozen=True)
class Histogram:
    """Values of the records, by bucket: rows with a value of the bound at most. series: a value column for each value of the label. Null values don't count; low and high: the range that
    values are cut to."""

    name: str
    about: str
    series: dict[str, Column]
    buckets: tuple[float, ...]
    label: str | None = None
    low: float | None = None
    high: float | None = None


def _number(value: float) -> str:
    return "+Inf" if value == float("inf") else repr(float(value))


def counted(records: DataFrame, metrics: list[Counter | Histogram]) -> DataFrame:
    """name, kind, label, series, le, value: what records add to the metrics. kind: count, bucket, sum or total. One pass for all metrics without a label column, one for each other."""
    found, plain = [], []
    for m in metrics:
        if isinstance(m, Counter) and m.value is not None:
            kept = records if m.when is None else records.where(m.when)
            found.append(kept.groupBy(F.coalesce(m.value.cast("string"), F.lit("none")).alias("series")).agg(F.count("*").cast("double").alias("value")).select(F.lit(m.name).alias("name"), F.lit("count").alias("kind"), F.lit(m.label).alias("label"), "series", F.lit(None).cast("double").alias("le"), "value"))
        elif isinstance(m, Counter):
            plain.append((m.name, "count", None, None, None, F.count_if(m.when) if m.when is not None else F.count("*")))
        else:
            for series, column in m.series.items():
                cut = column.cast("double")
                cut = cut if m.low is None else F.when(cut.isNotNull(), F.greatest(cut, F.lit(m.low)))
                cut = cut if m.high is None else F.when(cut.isNotNull(), F.least(cut, F.lit(m.high)))
                plain += [(m.name, "bucket", m.label, series, bound, F.count_if(cut <= bound)) for bound in m.buckets]
                plain += [(m.name, "total", m.label, series, None, F.count(cut)), (m.name, "sum", m.label, series, None, F.coalesce(F.sum(cut), F.lit(0.0)))]
    if plain:
        row = records.agg(*[e.cast("double").alias(f"v{i}") for i, (*_, e) in enumerate(plain)])
        text = lambda x: F.lit(x).cast("string")
        cells = [F.struct(text(n).alias("name"), text(k).alias("kind"), text(label).alias("label"), text(series).alias("series"), F.lit(le).cast("double").alias("le"), F.col(f"v{i}").alias("value")) for i, (n, k, label, series, le, _) in enumerate(plain)]
        found.append(row.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total


def accumulate(records: DataFrame, out: str, checkpoint: str, metrics: list[Counter | Histogram]) -> StreamingQuery:
    """Starts a job that adds the records that arrive to the metrics under out; it ends when all there is has been read."""

    def write(batch: DataFrame, number: int) -> None:
        counted(batch, metrics).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """name, kind, label, series, le, value over all batches."""
    return spark.read.parquet(out).groupBy("name", "kind", "label", "series", "le").agg(F.sum("value").alias("value"))


def exposition(sums: DataFrame, metrics: list[Counter | Histogram]) -> str:
    """The text format of totals: help and type of each metric, then its lines, labels in alphabetical order."""
    by_name: dict[str, list] = {}
    for r in sums.collect():  # a row for each metric, label and bucket
        by_name.setdefault(r["name"], []).append(r)
    escape = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    lines = []
    for m in metrics:
        kind = "counter" if isinstance(m, Counter) else "histogram"
        lines += [f"# HELP {m.name} {m.about}", f"# TYPE {m.name} {kind}"]
        rows = by_name.get(m.name, [])
        for series in sorted({r["series"] for r in rows}, key=lambda s: s or ""):
            own = [r for r in rows if r["series"] == series]
            label = [f'{m.label}="{escape(series)}"'] if m.label else []
            shown = lambda parts: "{" + ",".join(parts) + "}" if parts else ""
            value = lambda k: next(r["value"] for r in own if r["kind"] == k)  # noqa: B023, E731
            if kind == "counter":
                lines.append(f"{m.name}{shown(label)} {_number(value('count'))}")
                continue
            bounds = sorted((r["le"], r["value"]) for r in own if r["kind"] == "bucket")
            for bound, number in [*bounds, (float("inf"), value("total"))]:
                lines.append(f"{m.name}_bucket{shown(sorted([*label, f'le={chr(34)}{_number(bound)}{chr(34)}']))} {_number(number)}")
            lines += [f"{m.name}_count{shown(label)} {_number(value('total'))}", f"{m.name}_sum{shown(label)} {_number(value('sum'))}"]
    return "\n".join(lines) + "\n"


def export(spark: SparkSession, out: str, metrics: list[Counter | Histogram], path: str) -> None:
    """Writes the totals' text format as one text file in a folder, which another write replaces."""
    text = exposition(totals(spark, out), metrics)
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
