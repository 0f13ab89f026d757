"""Readers and writers of event logs: CSV with the standard column names, and XES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = {"case_id": "case:concept:name", "activity": "concept:name", "ts": "time:timestamp"}


def read_csv(spark: SparkSession, path: str, case: str = KEYS["case_id"], activity: str = KEYS["activity"], ts: str = KEYS["ts"], sep: str = ",") -> DataFrame:
    """The file's own columns, and case_id, activity, us and event_idx; rows lacking a key go."""
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=False)
    q = lambda c: F.col(f"`{c}`")
    out = raw.withColumns({"case_id": q(case), "activity": q(activity), "us": F.unix_micros(q(ts).cast("timestamp")), "event_idx": F.monotonically_increasing_id()})
    return out.where("case_id is not null and activity is not null and us is not null")


XES = "event array<struct<string:array<struct<_key:string,_value:string>>,date:array<struct<_key:string,_value:string>>,int:array<struct<_key:string,_value:string>>,float:array<struct<_key:string,_value:string>>,boolean:array<struct<_key:string,_value:string>>>>, string array<struct<_key:string,_value:string>>"


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each event, with its attributes as a map of strings; traces are read apart, so a file is split by trace."""
    t = spark.read.format("xml").option("rowTag", "trace").schema(XES).load(path)
    pick = lambda a, k: F.element_at(F.filter(a, lambda x: x["_key"] == k), 1)["_value"]
    e = t.select(pick(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("event_idx", "e"))
    kinds = [F.coalesce(F.col(f"e.{k}"), F.array()) for k in ("string", "date", "int", "float", "boolean")]
    a = e.withColumn("a", F.map_from_entries(F.transform(F.concat(*kinds), lambda x: F.struct(x["_key"].alias("key"), x["_value"].alias("value")))))
    return a.select("case_id", F.col("a")["concept:name"].alias("activity"), F.unix_micros(F.col("a")["time:timestamp"].cast("timestamp")).alias("us"), F.col("event_idx").cast("long").alias("event_idx"), F.col("a")["org:resource"].alias("resource"), F.col("a").alias("attributes"))


def write_csv(log: DataFrame, path: str) -> None:
    out = log.select(F.col("case_id").alias(KEYS["case_id"]), F.col("activity").alias(KEYS["activity"]), F.timestamp_micros("us").alias(KEYS["ts"]), *[c for c in log.columns if c not in ("case_id", "activity", "us", "event_idx", "attributes")])
    out.write.mode("overwrite").csv(path, header=True)


def from_strings(spark: SparkSession, lines: list[str], sep: str = ",") -> DataFrame:
    """A log from traces written as text ("A,B,C"), one a case; events are a second apart."""
    t = spark.createDataFrame(list(enumerate(lines)), "case_id long, line string")
    e = t.select(F.col("case_id").cast("string").alias("case_id"), F.posexplode(F.split("line", f"\\Q{sep}\\E")).alias("event_idx", "activity"))
    return e.select("case_id", "activity", (F.col("event_idx").cast("long") * 1_000_000).alias("us"), F.col("event_idx").cast("long").alias("event_idx"))


def _xes_lines(kinds: dict[str, str]):
    """Lines of one XES file from a partition's events, which are sorted by case and time."""
    from datetime import datetime, timedelta
    from xml.sax.saxutils import quoteattr

    start = datetime(1970, 1, 1)
    line = lambda kind, key, value: f"<{kind} key={quoteattr(key)} value={quoteattr(value)}/>"

    def lines(batches):
        import pandas as pd

        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0" xmlns="http://www.xes-standard.org/">']})
        case = None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                key, activity, us, *others = row
                if key != case:
                    out += [*(["</trace>"] if case is not None else []), "<trace>" + line("string", "concept:name", key)]
                    case = key
                when = (start + timedelta(microseconds=us)).isoformat(timespec="microseconds") + "+00:00"
                more = [line(kind, name, (str(v).lower() if kind == "boolean" else str(v))) for (name, kind), v in zip(kinds.items(), others) if v is not None]
                out.append("<event>" + line("string", "concept:name", activity) + line("date", "time:timestamp", when) + "".join(more) + "</event>")
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": [*(["</trace>"] if case is not None else []), "</log>"]})

    return lines


def write_xes(log: DataFrame, path: str) -> None:
    """A folder of XES files, each of whole traces; a task streams its cases and holds a batch of events at a time.

    Other columns of plain types become attributes (`resource` is org:resource), without those that are null or NaN.
    Line breaks in values are written as references, so that a line of the file stays a line.
    """
    types = {"string": "string", "bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "boolean"}
    names = [c for c, t in log.dtypes if t in types and c not in ("case_id", "activity", "us", "event_idx")]
    kinds = {"org:resource" if c == "resource" else c: types[dict(log.dtypes)[c]] for c in names}
    q = lambda c: F.col(f"`{c}`")
    # as strings, so that a null makes no float of a long
    flat = log.select(F.col("case_id").cast("string").alias("case_id"), "activity", "us", *(F.when(~F.isnan(q(c)), q(c)).cast("string").alias(c) if kinds.get(c) == "float" else q(c).cast("string") for c in names), F.col("event_idx").alias("_i"))
    rows = flat.repartition("case_id").sortWithinPartitions("case_id", "us", "_i").drop("_i")
    rows.mapInPandas(_xes_lines(kinds), "value string").write.mode("overwrite").option("compression", "none").text(path)
