"""Splitting response tables: modular partitions, cross-validation folds, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.operators.series import running_count


def level_codes(df: DataFrame, column: str, **layout) -> DataFrame:
    """Distinct levels and their rank from 0 in sort order.

    The rank runs over the level table only, and over range-partitioned pieces of it if it is long.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = running_count(distinct, [], [column], name="_code", **layout)
    return ranked.select(column, (F.col("_code") - 1).cast("int").alias("_code"))


def split_id(df: DataFrame, columns: Sequence[str], into: str = "splitID", **layout) -> DataFrame:
    """Sum of the level codes of ``columns``; a missing value counts -1."""
    total = F.lit(0)
    cols = list(df.columns)
    for i, c in enumerate(columns):
        codes = level_codes(df, c, **layout).toDF(f"_level{i}", f"_code{i}")
        df = df.join(codes, df[c] == codes[f"_level{i}"], "left")
        total = total + F.coalesce(F.col(f"_code{i}"), F.lit(-1))
    return df.select(*cols, total.cast("int").alias(into))


def part_of(split: Column, modulus: int = 4, parts: int = 3) -> Column:
    """Index of the part: the first takes what the last ``parts - 1`` residues leave over."""
    if modulus < parts:
        raise ValueError("the modulus must be at least the number of parts")
    residue = F.pmod(split, F.lit(modulus))
    return F.when(residue <= modulus - parts, 0).otherwise(residue - (modulus - parts)).cast("int")


#: Usual names of two and of three parts; more are numbered.
PARTS = {2: ("train", "test"), 3: ("train", "dev", "test")}


def modular_partition(df: DataFrame, columns: Sequence[str], modulus: int = 4, parts: int = 3,
                      names: Sequence[str] | None = None, into: str = "part", **layout) -> DataFrame:
    df = split_id(df, columns, **layout)
    index = part_of(F.col("splitID"), modulus, parts)
    names = list(names or PARTS.get(parts) or map(str, range(parts)))
    if len(names) != parts:
        raise ValueError(f"{parts} parts need as many names")
    return df.withColumn(into, F.get(F.lit(names), index))


def fold_plan(folds: Sequence) -> list[dict]:
    """For each fold: the test fold, the development fold before it (cyclically), the training folds."""
    folds = sorted(folds)
    return [
        {"fold": f, "dev_fold": folds[i - 1], "train": [g for g in folds if g not in (f, folds[i - 1])]}
        for i, f in enumerate(folds)
    ]


def fold_roles(df: DataFrame, column: str, folds: Sequence) -> DataFrame:
    """Every row once per model of the cross-validation, with its role there.

    The number of folds is a setting, so rows multiply by a constant.
    """
    plan = fold_plan(folds)
    c = F.col(column)
    models = [
        F.struct(F.lit(p["fold"]).alias("model_fold"),
                 F.when(c == F.lit(p["fold"]), "test").when(c == F.lit(p["dev_fold"]), "dev")
                 .otherwise("train").alias("role"))
        for p in plan
    ]
    out = df.where(c.isin([p["fold"] for p in plan])).withColumn("_m", F.explode(F.array(*models)))
    return out.select(*df.columns, "_m.model_fold", "_m.role")


def softmax(df: DataFrame, value: str, by: Sequence[str] = (), into: str = "weight") -> DataFrame:
    """exp(a - logsumexp(a)) within groups, as a join with two aggregates rather than a window."""
    tops = df.groupBy(*by).agg(F.max(value).alias("_top"))
    if by:
        shifted = df.join(tops, list(by))
        sums = shifted.groupBy(*by).agg(F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_sum"))
        shifted = shifted.join(sums, list(by))
        return shifted.select(*df.columns, (F.exp(F.col(value) - F.col("_top")) / F.col("_sum")).alias(into))
    top = df.agg(F.max(value)).first()[0]
    total = df.agg(F.sum(F.exp(F.col(value) - F.lit(top)))).first()[0]
    return df.withColumn(into, F.exp(F.col(value) - F.lit(top)) / F.lit(total))


def ensemble_predictions(df: DataFrame, row_id: str, model: str, value: str,
                         weights: DataFrame | None = None, into: str = "pred") -> DataFrame:
    """Combine the predictions of an ensemble per row: evenly, or by a table of model weights."""
    if weights is None:
        return df.groupBy(row_id).agg(F.avg(value).alias(into))
    w = F.col("weight")
    return df.join(weights, model).groupBy(row_id).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(into))


def nested_models(models: DataFrame, name: str = "model") -> DataFrame:
    """Pairs (smaller, larger) of models of one base whose ablations differ by exactly one.

    Instead of comparing all pairs, each model names its parents: itself with one ablation undone.
    """
    parts = F.split(F.col(name), "!", -1)
    ablated = F.array_sort(F.array_distinct(F.slice(parts, 2, 1_000_000)))
    keyed = models.select(F.col(name), F.get(parts, F.lit(0)).alias("_base"), ablated.alias("_set"))
    children = keyed.select(F.col(name).alias("smaller"), "_base", "_set", F.explode("_set").alias("_one"))
    children = children.withColumn("_set", F.array_remove("_set", F.col("_one")))
    parents = keyed.withColumnRenamed(name, "larger")
    return children.join(parents, ["_base", "_set"]).select("smaller", "larger")


def is_nested(a: str, b: str) -> bool:
    """Whether two model names differ by exactly one ablation of the same base."""
    (base_a, *out_a), (base_b, *out_b) = a.split("!"), b.split("!")
    return base_a == base_b and len(set(out_a) ^ set(out_b)) == 1


def ablation_family(name: str, ablatable: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Model names and the predictors each leaves out: every subset of ``ablatable``."""
    from itertools import combinations

    out = {}
    for k in range(len(ablatable) + 1):
        for drop in combinations(ablatable, k):
            out["!".join([name, *drop])] = drop
    return out


