"""Reports and run data: tables as Markdown, configuration files, run records, series of a training log."""

from __future__ import annotations

import json
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """The rows of a small result as a Markdown table, figures to the right. A result of more than ``most`` rows raises: it is no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    right = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")}
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---:" if c in right else "---" for c in df.columns], *[[cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def read_config(path: str) -> dict:
    """A configuration file as a dict: YAML where a parser is installed, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def run_record(spark: SparkSession, seed: int, **more: str) -> DataFrame:
    """(name, value) of a run: seed, versions, and whatever else is given."""
    own = {"seed": seed, "python": platform.python_version(), "spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism, **more}
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(own.items())], "name string, value string")


def log_series(log: DataFrame) -> DataFrame:
    """(series, step, loss) of a training log (step, epoch, loss, eval_loss): a row with both losses is in both series; without a step the epoch counts."""
    step = F.coalesce(F.col("step").cast("double"), F.col("epoch").cast("double"))
    both = F.array(F.struct(F.lit("train").alias("series"), F.col("loss").cast("double").alias("loss")), F.struct(F.lit("eval").alias("series"), F.col("eval_loss").cast("double").alias("loss")))
    return log.select(step.alias("step"), F.explode(both).alias("x")).filter("x.loss is not null").select("x.series", "step", "x.loss")
