"""Files of training runs: predictions per fold and metric logs per run folder."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import codes
from chronoweave.schemas import METRIC_ROWS, POINT_PREDICTIONS, PREDICTIONS


def with_path_facts(df: DataFrame, prefix: str = "", file_path: Column | None = None) -> DataFrame:
    """Add what the file's path tells.

    `run_folder` is the folder's name, `fold` the last digit group of the path, `run` the first digits of the
    folder, `group_folder` the folder above. Folders that do not start with `prefix`, or start with a dot, go.
    A file may also be a folder of part files, as Spark writes it.
    """
    uri = F.col("_metadata.file_path") if file_path is None else file_path
    path = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri), r"/part-[^/]*$", "")
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    out = df.select(
        "*",
        folder.alias("run_folder"),
        F.regexp_extract(path, r"(\d+)\D*$", 1).try_cast("int").alias("fold"),
        F.regexp_extract(folder, r"(\d+)", 1).try_cast("int").alias("run"),
        F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("group_folder"),
    )
    out = out.filter(~F.col("run_folder").startswith("."))
    return out.filter(F.col("run_folder").startswith(prefix)) if prefix else out


@dataclass(frozen=True)
class FirstLines:
    """A file, the names in its first line, and the fields of its second one (none if there isn't any)."""

    path: str
    names: tuple[str, ...]
    fields: tuple[str, ...]


def first_lines(spark: SparkSession, pattern: str) -> list[FirstLines]:
    """The first two lines of every file of `pattern`; a small row per file comes to the driver, as its path does anyway.

    Lines of a file's first block are numbered without gaps along the file, so the least even and the least odd number are
    its first two lines: one aggregate, whose tasks keep two lines a file. No file, no rows.
    """
    try:
        lines = spark.read.text(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    place = lines.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
    ).filter(F.col("start") == 0)
    line = F.struct("id", "value")
    even, odd = (F.min(F.when(F.col("id") % 2 == side, line)).alias(name) for side, name in ((0, "even"), (1, "odd")))
    found = []
    for r in place.groupBy("path").agg(even, odd).collect():
        two = sorted((x.id, x.value) for x in (r["even"], r["odd"]) if x is not None)
        rows = [next(csv.reader([text]), []) for _, text in two]
        found.append(FirstLines(r["path"], tuple(c.strip() for c in rows[0]), tuple(rows[1]) if len(rows) > 1 else ()))
    return sorted(found, key=lambda f: f.path)


def _as_path(uri: str) -> str:
    """A file's address as a path to read, which has no escapes of an address, and whose glob signs mean themselves."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in unquote(uri))


def read_by_header(
    spark: SparkSession, pattern: str, known: list[str], kinds: dict[str, str], prefix: str = "", multiline: bool = False,
    files: list[FirstLines] | None = None,
) -> DataFrame:
    """All CSV files of `pattern`, each read by its own first line; a column that a file lacks is NULL.

    One scan per way of writing the header, whatever the number of files. Columns are doubles unless `kinds` says otherwise.
    `multiline` is for quoted fields with line breaks; such files aren't cut into blocks. `files` are their first lines, if
    known already. Where no file matches there are no rows.
    """
    files = first_lines(spark, pattern) if files is None else files
    heads: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        heads.setdefault(f.names, []).append(_as_path(f.path))
    columns = list(dict.fromkeys([*known, *(c for names in sorted(heads) for c in names)]))
    kind = {c: kinds.get(c, "double") for c in columns}
    parts = []
    for names, paths in sorted(heads.items()):
        schema = T.StructType.fromDDL(", ".join(f"`{c}` {kind[c]}" for c in names))
        rows = spark.read.schema(schema).option("header", True).option("multiLine", multiline).csv(paths)
        own = [(F.col(f"`{c}`") if c in names else F.lit(None).cast(kind[c])).alias(c) for c in columns]
        parts.append(rows.select(F.col("_metadata.file_path").alias("_path"), *own))
    if not parts:
        parts = [spark.createDataFrame([], ", ".join(["_path string", *[f"`{c}` {t}" for c, t in kind.items()]]))]
    return with_path_facts(reduce(DataFrame.unionByName, parts), prefix, F.col("_path")).drop("_path")


def read_predictions(spark: SparkSession, root: str, prefix: str = "version", task: str = "gaussian") -> DataFrame:
    """All prediction files of all run folders under `root`, with fold and run from the path; columns go by name."""
    schema = PREDICTIONS if task == "gaussian" else POINT_PREDICTIONS
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    found = read_by_header(spark, f"{root}/*/predictions*", schema.fieldNames(), kinds, prefix)
    return found.select(*schema.fieldNames(), "run_folder", "fold", "run", "group_folder")


def read_metrics(spark: SparkSession, root: str, name: str = "metrics.csv") -> DataFrame:
    """All metric logs under `root`, one file per run, whose columns may differ; a missing column is NULL."""
    return read_by_header(spark, f"{root}/*/{name}", METRIC_ROWS.fieldNames(), {}).drop("fold")


def run_models(spark: SparkSession, root: str, prefix: str = "", pattern: str = "*/predictions*") -> DataFrame:
    """The model name of each run folder, from the first row of its first file that has one; no other row is parsed."""
    named = [(f.path, f.fields[f.names.index("model")]) for f in first_lines(spark, f"{root}/{pattern}") if "model" in f.names and f.fields]
    rows = spark.createDataFrame([(p, m) for p, m in named if m], "_path string, model string")
    facts = with_path_facts(rows, prefix, F.col("_path"))
    return facts.groupBy("run_folder").agg(F.min_by("model", "_path").alias("model"))


def read_run_metrics(spark: SparkSession, root: str, prefix: str = "", columns=codes.METRICS) -> DataFrame:
    """Metric rows of the runs that also have predictions, with the model name; rows without any metric go."""
    metrics = read_metrics(spark, root)
    if prefix:
        metrics = metrics.filter(F.col("run_folder").startswith(prefix))
    kept = metrics.select("run_folder", "run", *columns).na.drop("all", subset=list(columns))
    return kept.join(F.broadcast(run_models(spark, root, prefix)), "run_folder")  # a row per run folder


def swept_value(column: str = "group_folder"):
    """The number behind a folder name's first letter, e.g. h32 -> 32."""
    return F.expr(f"substring({column}, 2)").try_cast("double")


def save_predictions(df: DataFrame, path: str, files: int = 8) -> None:
    """One folder per model and fold, with `rn`, `mu` and, if present, `sigma`; at most `files` files in each."""
    kept = [c for c in ("rn", "mu", "sigma", "model", "fold") if c in df.columns]
    df.select(*kept).repartition("model", "fold", F.pmod(F.xxhash64("rn"), F.lit(files))).write.mode("overwrite").partitionBy("model", "fold").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
