"""Table constraints as Spark checks (Q1-Q7).

Each check returns the violating rows (or groups); ``summary`` folds any of
them into ``(table, check, violations)``. Every check is one aggregate or one
anti-join: duplicate keys are counted with a partial aggregate, so a key
repeated across a third of the table never lands in one task as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Q1/Q2: keys present more than once, with their count ``n``."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Q1: rows with a null key part."""
    cond = None
    for k in key:
        c = F.col(k).isNull()
        cond = c if cond is None else (cond | c)
    return df.filter(cond)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Q3: child rows whose non-null reference has no parent."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.filter(F.col(fk).isNotNull()).join(p, child[fk] == p["_pk"], "left_anti")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q4: one pass, ``(column, nulls)`` per required column."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column, nulls)")


def domain_violations(df: DataFrame, col: str, allowed: Sequence[str] | None = None,
                      max_length: int | None = None) -> DataFrame:
    """Q5: values over ``max_length`` or outside ``allowed``, with the reason."""
    reason = F.lit(None).cast("string")
    if max_length is not None:
        reason = F.when(F.length(col) > max_length, F.lit(f"longer than {max_length}"))
    if allowed is not None:
        reason = F.coalesce(reason, F.when(~F.col(col).isin(*allowed), F.lit("value not allowed")))
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Q6: ``(conformed, set_aside)``. Each declared column is cast with
    ``try_cast``; missing ones are added as null; extra ones dropped. Rows
    with a value that does not cast go to ``set_aside`` as
    ``(row_key, column, value)`` rows, keyed by the first declared column."""
    cols, bad = [], []
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            cols.append(src.try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType)
                        else src.cast("string").alias(f.name))
            if not isinstance(f.dataType, T.StringType):
                bad.append(F.when(src.isNotNull() & src.try_cast(f.dataType).isNull(),
                                  F.struct(F.lit(f.name).alias("column"), src.cast("string").alias("value"))))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    key = schema.fields[0].name
    issues = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array()
    flagged = df.withColumn("_issues", issues)
    good = flagged.filter(F.size("_issues") == 0).select(*cols)
    aside = (flagged.filter(F.size("_issues") > 0)
             .select(F.col(key).cast("string").alias("row_key"), F.explode("_issues").alias("_i"))
             .select("row_key", "_i.column", "_i.value"))
    return good, aside


def vector_checks(df: DataFrame, vec: str = "embedding", width: int | None = None) -> DataFrame:
    """Q7: per vector width: rows, nulls, wrong width, zero norm, non-finite."""
    v = F.col(vec)
    norm2 = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    nonfinite = F.exists(v, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    g = df.select(F.size(v).alias("width"), v.isNull().alias("_null"), norm2.alias("_n2"), nonfinite.alias("_nf"))
    out = g.groupBy("width").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_null")).alias("nulls"),
        F.count_if(F.col("_n2") == 0).alias("zero_norm"),
        F.count_if(F.coalesce(F.col("_nf"), F.lit(False))).alias("non_finite"))
    if width is not None:
        out = out.withColumn("wrong_width", F.when(F.col("width") != width, F.col("rows")).otherwise(F.lit(0)))
    return out


def summary(checks: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """``(table, check, violations)`` for a dict of violation frames."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations"))
             .select(F.lit(t).alias("table"), F.lit(c).alias("check"), "violations")
             for (t, c), df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
