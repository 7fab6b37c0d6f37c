"""Column transforms of predictors and responses.

Table-wide statistics (mean, standard deviation) are taken by one aggregation and enter the
projection as literals, so no unpartitioned window is ever needed.  Nested transforms such as
``z(log(x))`` are staged: all statistics of one nesting level come from one pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest argument a logarithm of a model term may see.
LOG_FLOOR = 1e-12
STATISTICAL = ("c", "z", "s")
_NESTED = re.compile(r"^\s*([A-Za-z_]\w*(?:\.\d+)?)\.?\((.+)\)\s*$")
_CONSTANT = re.compile(r"^(add|subtract|multiply|divide|pow)(\d+(?:[._]\d+)?)$")
_FLOATING = ("double", "float")


def finite(df: DataFrame, name: str) -> Column:
    """True where the value is neither null, NaN nor infinite; non-numeric values count if not null."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType.typeName()
    if kind in _FLOATING:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return c.isNotNull()


def known(df: DataFrame, name: str) -> Column:
    """True where the value is neither null nor NaN."""
    c = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() in _FLOATING:
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def zero_filled(df: DataFrame, name: str) -> Column:
    return F.when(finite(df, name), F.col(f"`{name}`").cast("double")).otherwise(0.0)


def mask_and_fill(df: DataFrame, names: Sequence[str], suffix: str = "_mask") -> DataFrame:
    """Replace non-finite values by 0 and add a 0/1 mask column for each name."""
    return df.withColumns({
        **{n + suffix: F.when(finite(df, n), 1.0).otherwise(0.0) for n in names},
        **{n: zero_filled(df, n) for n in names},
    })


@dataclass(frozen=True)
class Moments:
    mean: float
    sd: float


def moments(df: DataFrame, exprs: dict[str, Column], population: bool = False) -> dict[str, Moments]:
    """Mean and standard deviation of several expressions in one pass; NaN is skipped like null."""
    if not exprs:
        return {}
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for i, c in enumerate(exprs.values()):
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(c).alias(f"m{i}"), sd(c).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {k: Moments(row[f"m{i}"], row[f"s{i}"]) for i, k in enumerate(exprs)}


def parse_ops(name: str) -> tuple[str, list[str]]:
    """``z(log(x))`` -> (``x``, [``log``, ``z``])."""
    ops: list[str] = []
    while m := _NESTED.match(name):
        ops.append(m.group(1))
        name = m.group(2)
    return name.strip(), ops[::-1]


def pointwise(op: str, c: Column, floor_log: bool = True) -> Column:
    """Transforms that need no statistics."""
    if op == "log":
        return F.log(F.greatest(c, F.lit(LOG_FLOOR))) if floor_log else F.log(c)
    if op == "log1p":
        return F.log1p(c)
    if op == "exp":
        return F.exp(c)
    if m := _CONSTANT.match(op):
        verb, k = m.group(1), F.lit(float(m.group(2).replace("_", ".")))
        return {"add": c + k, "subtract": c - k, "multiply": c * k, "divide": c / k,
                "pow": F.pow(c, k)}[verb]
    raise ValueError(f"unknown transform: {op}")


def centred(op: str, c: Column, m: Moments) -> Column:
    mean, sd = F.lit(m.mean), F.lit(m.sd)
    return {"c": c - mean, "z": (c - mean) / sd, "s": c / sd}[op]


def apply_ops(df: DataFrame, names: Sequence[str], floor_log: bool = True,
              stats: dict[str, Moments] | None = None) -> DataFrame:
    """Add a column for every name such as ``z(log(x))`` that ``df`` lacks.

    ``stats`` supplies (and receives) the moments, keyed by the transformed name: pass the dictionary
    filled on training data to transform other data the same way.
    """
    stats = {} if stats is None else stats
    todo = [n for n in dict.fromkeys(names) if n not in df.columns]
    state: dict[str, tuple[str, Column, list[str]]] = {}
    for n in todo:
        base, ops = parse_ops(n)
        if base not in df.columns:
            raise ValueError(f"no column {base!r} for {n!r}")
        state[n] = (base, F.col(base).cast("double"), ops)
    while any(ops for _, _, ops in state.values()):
        wanted: dict[str, Column] = {}
        for n, (label, c, ops) in state.items():
            while ops and ops[0] not in STATISTICAL:
                c, label, ops = pointwise(ops[0], c, floor_log), f"{ops[0]}({label})", ops[1:]
            state[n] = (label, c, ops)
            if ops and label not in stats:
                wanted[label] = c
        stats.update(moments(df, wanted))
        for n, (label, c, ops) in state.items():
            if ops:
                state[n] = (f"{ops[0]}({label})", centred(ops[0], c, stats[label]), ops[1:])
    return df.withColumns({n: c for n, (_, c, _) in state.items()}) if state else df


def add_responses(df: DataFrame, names: Sequence[str] | str,
                  stats: dict[str, Moments] | None = None) -> DataFrame:
    """Response transforms: as :func:`apply_ops`, with the plain logarithm."""
    return apply_ops(df, [names] if isinstance(names, str) else names, floor_log=False, stats=stats)


def identifier(text: str) -> str:
    """A name with every character that cannot stand in an identifier replaced by ``_``."""
    return re.sub(r"\W|^(?=\d)", "_", text)


MAX_LEVELS = 10_000


def levels(df: DataFrame, column: str, at_most: int = MAX_LEVELS) -> list:
    """Sorted distinct values of a categorical; refuses a column that is not categorical in size."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"{column} has more than {at_most} levels; encode it as a key instead")
    return sorted(r[0] for r in rows)


def dummies(df: DataFrame, column: str, known_levels: Sequence | None = None,
            at_most: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """Treatment coding: an indicator per level but the first.

    Levels whose names clash once they are cleaned are numbered in order: ``_2``, ``_3``.  A column of more
    than ``at_most`` levels is refused; code it by :func:`echoframe.operators.partition.level_codes`.
    """
    values = list(levels(df, column, at_most) if known_levels is None else known_levels)
    names: dict[str, object] = {}
    for v in values[1:]:
        name = plain = identifier(f"{column}_{v}")
        again = 1
        while name in names:
            again += 1
            name = f"{plain}_{again}"
        names[name] = v
    coded = df.withColumns({
        n: F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for n, v in names.items()
    })
    return coded, list(names)


def product(df: DataFrame, names: Sequence[str]) -> Column:
    """Row product that skips missing factors."""
    out = None
    for n in names:
        factor = F.coalesce(F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")), F.lit(1.0))
        out = factor if out is None else out * factor
    return out


def interactions(df: DataFrame, terms: Sequence[Sequence[str]],
                 coded: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Add ``a:b`` columns; categorical members are crossed over their indicators."""
    coded = coded or {}
    added: dict[str, Column] = {}
    for term in terms:
        sets = [[]]
        for member in term:
            sets = [s + [m] for s in sets for m in coded.get(member, [member])]
        for s in sets:
            added[":".join(s)] = product(df, s)
    new = {n: c for n, c in added.items() if n not in df.columns}
    return (df.withColumns(new) if new else df), list(added)


def up_to_order(names: Sequence[str], order: int) -> list[tuple[str, ...]]:
    """Main effects and interactions of up to ``order`` distinct members: ``(a + b + c)^order``."""
    return [c for k in range(1, order + 1) for c in combinations(names, k)]


def crossed(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, ...]]:
    """``a * b``: both sides and their product."""
    return up_to_order([*left, *right], 2) if len(left) == len(right) == 1 else (
        [(x,) for x in [*left, *right]] + [(a, b) for a in left for b in right])


def all_interactions(names: Sequence[str]) -> list[tuple[str, ...]]:
    return up_to_order(names, len(names))


def matching(pattern: str, columns: Sequence[str]) -> list[str]:
    """Columns a regular expression matches in full, as predictor selections do."""
    compiled = re.compile(pattern if pattern.endswith("$") else pattern + "$")
    return [c for c in columns if compiled.match(c)]


def composite_key(names: Sequence[str], sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(n).cast("string") for n in names])


def with_categoricals(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ids as strings; a name ``a:b`` is derived from its parts."""
    for n in names:
        if n in df.columns:
            df = df.withColumn(n, F.col(n).cast("string"))
        elif ":" in n:
            df = df.withColumn(n, composite_key(n.split(":"), ":"))
        else:
            raise ValueError(f"no column {n!r}")
    return df


def with_rate(df: DataFrame) -> DataFrame:
    """The constant event predictor."""
    if "rate" in df.columns:
        raise ValueError("'rate' is reserved for the constant predictor")
    return df.withColumn("rate", F.lit(1.0))


def masked_ops(pairs: DataFrame, column: str, op: str, into: str) -> DataFrame:
    """A transform over all (response, event) pairs; standard deviations are population ones."""
    c = F.col(column).cast("double")
    if op in STATISTICAL:
        m = moments(pairs, {"v": c}, population=True)["v"]
        return pairs.withColumn(into, centred(op, c, m))
    return pairs.withColumn(into, F.log(c) if op == "log" else pointwise(op, c))


def display_names(df: DataFrame, column: str, names: dict[str, str], into: str) -> DataFrame:
    """Readable names: the exact key, else the longest key contained in the value, else the value.

    ``names`` is a small fixed dictionary, so it becomes a CASE expression (longest keys first).
    """
    c = F.col(column)
    out = None
    for key in sorted(names):
        hit = c == F.lit(key)
        out = F.when(hit, names[key]) if out is None else out.when(hit, names[key])
    for key in sorted(names, key=lambda k: (-len(k), k)):
        out = out.when(c.contains(key), names[key])
    return df.withColumn(into, out.otherwise(c) if out is not None else c)


def level_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and sample deviation of ``value`` in every level of ``by``; missing values are left out.

    One aggregation with partial sums before the shuffle.  A level of one value has no deviation.
    """
    v = F.col(f"`{value}`").cast("double")
    v = F.when(~F.isnan(v), v)
    return df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias("sd"))
