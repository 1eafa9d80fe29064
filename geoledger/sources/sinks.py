"""Sinks: Spark's writers with the policies that a run needs."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid

POLICIES = ("error", "archive", "resume")


def metric_table(df: DataFrame) -> DataFrame:
    """metric, value of a one-row table."""
    return df.selectExpr(*(f"cast(`{c}` as string) as `{c}`" for c in df.columns)).unpivot([], df.columns, "metric", "value")


def chunks(df: DataFrame, path: str, by: str, policy: str = "error") -> None:
    """gzip CSV, a folder for each chunk, committed whole. error: raises if there is output; archive: writes to a dated folder
    beside it; resume: writes only chunks that aren't there."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    writer = lambda d, mode: d.write.mode(mode).option("header", "true").option("compression", "gzip").partitionBy(by)
    if policy == "error":
        return writer(df, "errorifexists").csv(path)
    if policy == "archive":
        return writer(df, "errorifexists").csv(f"{path}-{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S%f}")
    spark = df.sparkSession
    try:
        done = spark.read.option("header", "true").csv(path).select(by).distinct()
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return writer(df, "append").csv(path)
    return writer(df.join(done.withColumn(by, done[by].cast(df.schema[by].dataType)), by, "left_anti"), "append").csv(path)


def matrix(mask: DataFrame, predictions: DataFrame, shape: tuple[int, int], path: str) -> None:
    """A text matrix, in row order over its part files."""
    lines = grid.text_matrix(mask, predictions, shape).repartitionByRange("row").sortWithinPartitions("row")
    lines.select("line").write.text(path)


def bom_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV whose files each begin with a byte-order mark, as spreadsheets want it; `tables.wide_csv` takes the mark off again. Headers aren't quoted, so
    the first column's name must need no quotes."""
    first = df.columns[0]
    if any(c in first for c in ',"\n\r'):
        raise ValueError("the first column's name needs quotes")
    marked = df.toDF("\ufeff" + first, *df.columns[1:])
    marked.write.mode(mode).option("header", "true").option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def dated(path: str, day: datetime.date | None = None, run: str | None = None) -> str:
    """The folder of a run below path, by its day and its time (or a name given), so that an earlier run of the same day stays; readers of path see run_date and run as
    columns."""
    now = datetime.datetime.now(datetime.UTC)
    return f"{path.rstrip('/')}/run_date={(day or now.date()).isoformat()}/run={run or f'{now:%H%M%S.%f}Z'}"


def log(spark: SparkSession, path: str, event: str, details: dict[str, object]) -> None:
    """Appends a line (at, event, details) to a folder of JSON lines. A line is committed whole or not at all."""
    row = [(datetime.datetime.now(datetime.UTC).isoformat(), event, {k: str(v) for k, v in details.items()})]
    spark.createDataFrame(row, "at string, event string, details map<string,string>").coalesce(1).write.mode("append").json(path)


def summary(spark: SparkSession, path: str, settings: dict[str, object], results: dict[str, object]) -> None:
    """One JSON record of a run: the settings it had and what came out. The record is written beside the path and then takes the earlier one's place in one
    step, so readers find the old one or the new one whole, and a crash loses neither."""
    text = lambda d: {k: str(v) for k, v in d.items()}
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    spark.createDataFrame([(text(settings), text(results))], "settings map<string,string>, results map<string,string>").coalesce(1).write.json(beside)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    files = hadoop.Path(path).getFileSystem(conf)
    files.mkdirs(hadoop.Path(path))
    part = next(f.getPath() for f in files.listStatus(hadoop.Path(beside)) if f.getPath().getName().startswith("part-"))
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(part, hadoop.Path(f"{path.rstrip('/')}/record.json"), overwrite)
    files.delete(hadoop.Path(beside), True)


def markdown(df: DataFrame, order: list[str], digits: int = 4, most: int = 1000) -> str:
    """A summary table as Markdown. Raises for more rows than a report holds, rather than leave some out."""
    number = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    cells = [F.coalesce((F.format_number(F.col(c).cast("double"), digits) if c in number else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))), F.lit("")).alias(c) for c in df.columns]
    rows = df.orderBy(*order).select(*cells).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a summary")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])
