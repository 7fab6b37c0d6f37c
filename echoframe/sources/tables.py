"""Reading and writing the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echoframe.functions.transforms import with_categoricals, with_rate
from echoframe.operators.series import running_count


def read_table(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None,
               sep: str = " ", fmt: str | None = None) -> DataFrame:
    """Row-wise concatenation of delimited or parquet files, by column name.

    Files read in one go share columns; where columns differ the missing ones are null.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    fmt = fmt or ("parquet" if paths[0].rstrip("/").endswith("parquet") else "csv")
    if fmt == "parquet":
        return spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    reader = spark.read.options(sep=sep, header=True, ignoreLeadingWhiteSpace=True,
                                ignoreTrailingWhiteSpace=True, nullValue="nan")
    # Files of one header are read together; columns of different headers meet by name, never by place.
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(tuple(reader.csv(path).columns), []).append(path)
    if schema is None:
        frames = [reader.options(inferSchema=True).csv(own) for own in by_header.values()]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    frames = [reader.csv(own).select(*[
        (F.col(f"`{f.name}`") if f.name in header else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        for header, own in by_header.items()]
    return reduce(lambda x, y: x.unionByName(y), frames)


def split_column_files(spec: str | Sequence) -> list[list[str]]:
    """``a;b`` names column files (predictors of different clocks); a list concatenates rows."""
    parts = [spec] if isinstance(spec, str) else list(spec)
    rows = [p.split(";") if isinstance(p, str) else list(p) for p in parts]
    if len({len(r) for r in rows}) != 1:
        raise ValueError("every element must list the same number of column files")
    return [list(files) for files in zip(*rows)]


def read_tabular_data(spark: SparkSession, X_paths, Y_paths, series: Sequence[str],
                      categorical: Sequence[str] = (), sep: str = " ",
                      x_schemas: Sequence | None = None, y_schemas: Sequence | None = None
                      ) -> tuple[list[DataFrame], list[DataFrame]]:
    """Event and response tables, one per column file, with ids as strings and ``rate`` and ``trial``."""
    def load(spec, schemas):
        groups = split_column_files(spec)
        return [read_table(spark, g, (schemas or [None] * len(groups))[i], sep) for i, g in enumerate(groups)]

    X = [prepare_events(with_categoricals(x, _present(x, series)), series) for x in load(X_paths, x_schemas)]
    wanted = list(dict.fromkeys([*series, *categorical]))
    Y = [with_categoricals(y, _present(y, wanted)) for y in load(Y_paths, y_schemas)]
    return X, Y


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns or ":" in n]


def prepare_events(X: DataFrame, series: Sequence[str], order: Sequence[str] = ("time",)) -> DataFrame:
    """Add the constant predictor and the position in the series."""
    return running_count(with_rate(X), series, order, name="trial")


def partition_names(spec: str | Sequence[str]) -> list[str]:
    """Names in ``a:b``, ``a-b``, ``a+b`` or ``a b``."""
    parts = spec.split() if isinstance(spec, str) else list(spec)
    if len(parts) == 1:
        for sep in (":", "-", "+"):
            if sep in parts[0]:
                return parts[0].split(sep)
    return parts


def partition_paths(spec: str | Sequence[str], paths: dict[str, Sequence[str]]) -> list[str]:
    """Paths of the named partitions, each once, in order."""
    out: list[str] = []
    for name in partition_names(spec):
        if not paths.get(name):
            raise ValueError(f"no data path for partition {name!r}")
        out += [p for p in paths[name] if p not in out]
    return out


def write_partitions(df: DataFrame, path: str, part: str = "part", fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder per part; delimited output is space-separated with ``nan`` for missing values."""
    writer = df.write.mode(mode).partitionBy(part)
    if fmt == "csv":
        writer.options(sep=" ", header=True, nullValue="nan", emptyValue="").csv(path)
    else:
        writer.format(fmt).save(path)


#: What tells the rows of one result from those of another: folders of the result table, in this order.
RESULT_KEYS = ("model", "kind", "fold", "member", "response", "partition")


def write_results(df: DataFrame, path: str, keys: dict[str, str | Column | None], mode: str = "append") -> None:
    """Add rows (predictions, losses, likelihoods, convolved predictors) to the result table at ``path``.

    ``keys`` gives the values of RESULT_KEYS, as strings or as columns of ``df``; those left out are null
    (a model without folds or members).  The table is Parquet, one folder for each combination.
    """
    unknown = set(keys) - set(RESULT_KEYS)
    if unknown:
        raise ValueError(f"no such keys: {sorted(unknown)}")
    values = {k: keys.get(k) for k in RESULT_KEYS}
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in RESULT_KEYS], *[
        (v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in values.items()])
    out.write.mode(mode).partitionBy(*RESULT_KEYS).parquet(path)


def read_rows(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    """Rows of one kind (convolved predictors, parameters, integrals) of the result table, with ``columns`` and the keys."""
    keys = ", ".join(f"{k} string" for k in RESULT_KEYS)
    return spark.read.schema(f"{columns}, {keys}").parquet(path).where(F.col("kind") == kind)


#: How a result row is valued: observation and prediction, or a column of its own.
METRICS = {
    "mse": lambda: F.pow(F.col("obs") - F.col("pred"), 2.0),
    "loss": lambda: F.col("loss"),
    "loglik": lambda: F.col("loglik"),
    "corr": lambda: F.col("pred"),
}


def read_results(spark: SparkSession, path: str, metric: str = "mse",
                 columns: str = "obs double, pred double, loglik double, loss double") -> DataFrame:
    """The result table with a ``value`` for each row by ``metric``; rows without that value are left out.

    Folds of a model share its other keys, so their rows already stand together.  ``columns`` are
    the table's own; those that no file has are null.  Keys stay strings (``01`` is not 1).
    """
    keys = ", ".join(f"{k} string" for k in RESULT_KEYS)
    table = spark.read.schema(f"{columns}, {keys}").parquet(path)
    return table.withColumn("value", METRICS[metric]()).where("value is not null")
