"""Row filters on response tables.  All are plain ``where`` clauses that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.transforms import finite, known

_CONDITION = re.compile(r"^\s*(<=|>=|==|!=|<|>|=)\s*(.*?)\s*$")


def condition(df: DataFrame, field: str, cond: str) -> Column:
    """``field <op> rhs``; missing values never pass, whatever the operator.

    ``rhs`` is a number, ``inf``, the name of another column (unless it is also a value of
    ``field``), or a string.
    """
    m = _CONDITION.match(cond)
    if not m:
        raise ValueError(f"unknown filter condition: {cond!r}")
    op, text = m.groups()
    c = F.col(field)
    textual = df.schema[field].dataType.typeName() == "string"
    try:
        number = float(text)
    except ValueError:
        is_value = text in df.columns and textual and df.where(c == text).limit(1).count() > 0
        if text in df.columns and not is_value:
            rhs = F.col(text)
        else:
            c, rhs = c.cast("string"), F.lit(text)
    else:
        if textual and op in ("=", "==", "!="):
            rhs = F.lit(text)
        else:
            c, rhs = (c.try_cast("double") if textual else c), F.lit(number)
    test = {
        "<=": c <= rhs, ">=": c >= rhs, "<": c < rhs, ">": c > rhs,
        "=": c == rhs, "==": c == rhs, "!=": c != rhs,
    }[op]
    return known(df, field) & F.coalesce(test, F.lit(op == "!="))


def apply_filters(df: DataFrame, filters: Sequence[tuple[str, str]] | None) -> DataFrame:
    """Conjunction of filters, in order.

    A field that is no column is a count filter (``<column>nunique``: rows per value among the rows
    that passed so far) or a regular expression matched against the start of column names.
    """
    for field, cond in filters or ():
        if field in df.columns:
            df = df.where(condition(df, field, cond))
        elif field.lower().endswith("nunique") and field[:-7] in df.columns:
            df = count_filter(df, field[:-7], cond)
        else:
            for c in [c for c in df.columns if re.match(field, c)]:
                df = df.where(condition(df, c, cond))
    return df


def count_filter(df: DataFrame, column: str, cond: str) -> DataFrame:
    """Keep rows whose value of ``column`` occurs as often as ``cond`` asks.

    Counts are aggregated (partial sums first) and joined back, so a value holding a third of the
    rows costs no more than any other: the join is left to the optimiser, which broadcasts a small
    count table and splits a skewed one.
    """
    counts = df.where(known(df, column)).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.where(condition(counts, "_n", cond)).select(column)
    return df.join(keep, column, "left_semi").select(*df.columns)


def valid_responses(df: DataFrame, responses: Sequence[str], fold_column: str | None = None,
                    folds: Sequence | None = None) -> DataFrame:
    """Rows with at least one finite response, and in one of ``folds`` if given."""
    keep = None
    for r in responses:
        ok = finite(df, r)
        keep = ok if keep is None else keep | ok
    if fold_column is not None:
        keep = keep & F.col(fold_column).isin(list(folds or ()))
    return df.where(keep)
