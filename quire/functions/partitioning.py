"""Parallelism helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str | None = None, factor: float = 0.5) -> DataFrame:
    """Hash-repartition ``df`` on ``key`` to the session's default
    parallelism when it has fewer than ``factor`` times that many partitions.

    For CPU-heavy per-row work (chunk folds, tokenising) over inputs stored
    as few large files: a single-row-group file otherwise keeps all the work
    in one task. Large inputs already split into many file partitions pass
    through untouched, so no shuffle is added at scale. An explicit partition
    count is kept by AQE (it does not coalesce it back), and hashing a key
    keeps the placement deterministic across task retries.
    """
    if df.isStreaming:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    need = max(1, int(target * factor))
    # Parquet is split by row group: a file holding one row group gives one
    # non-empty task however many byte ranges the scan plans, so count files
    try:
        # only the count crosses to Python (the JVM already holds the listing)
        n_files = len(df._jdf.inputFiles())
    except Exception:  # noqa: BLE001 - not a file-based plan
        n_files = 0
    pieces = n_files if n_files else df.rdd.getNumPartitions()
    if pieces >= need:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def ordered_index(df: DataFrame, part: list[str], order: list, slice_by, out: str = "pos",
                  slice_desc: bool = False) -> DataFrame:
    """1-based position of each row within its ``part`` group by ``order``,
    without putting a whole group into one task.

    A window ``row_number`` over ``part`` sends every row of a key to one
    task; a key holding a third of the table would then be sorted by a single
    core. Here a group is cut into slices by ``slice_by``, a column that never
    falls (``slice_desc``: never rises) along ``order``, such as the day of the
    leading time stamp. Rows are numbered inside ``(part, slice)`` and shifted
    by the number of rows in earlier slices of the group, a table with one
    narrow row per slice. Slices depend on values alone, so retries and plans
    of any shape give the same positions. Null group keys form one group.

    ``order`` items are column names or Columns (use ``.desc()`` for
    descending); include a unique column last to make positions total.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    s = df.withColumn("_sl", slice_by)
    b = s.groupBy(*part, "_sl").agg(F.count(F.lit(1)).alias("_n"))
    by_slice = F.col("_sl").desc_nulls_last() if slice_desc else F.col("_sl").asc_nulls_first()
    w = Window.partitionBy(*part).orderBy(by_slice).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    b = b.select(F.col("_off"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*part, "_sl"])])
    rn = F.row_number().over(Window.partitionBy(*part, "_sl").orderBy(*cols))
    n = s.withColumn("_rn", rn)
    same = [n[c].eqNullSafe(b[f"_k{i}"]) for i, c in enumerate([*part, "_sl"])]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return n.join(b, cond).select(*[n[c] for c in df.columns], (F.col("_rn") + F.col("_off")).cast("long").alias(out))


#: Rows below which a plain window over the groups is taken.
SLICE_ROWS = 100_000
#: Slices that the whole table is cut into, at least and at most.
SLICES = (64, 2048)


def _cuts(df: DataFrame, number, slices: int) -> tuple[int, list, list]:
    """``(rows, cut points, heavy values)`` of a numeric column: quantiles
    from one sketch. A heavy value is several quantiles at once."""
    from pyspark.sql import functions as F

    q = F.percentile_approx(number, [i / slices for i in range(1, slices)], 20 * slices)
    got = df.agg(F.count(F.lit(1)).alias("n"), q.alias("q")).first()
    found = [x for x in got["q"] or []]
    cuts = sorted(set(found))
    return int(got["n"]), cuts, [c for c in cuts if found.count(c) > 1]


def _place(number, cuts: list):
    """Place of a number among sorted cut points; a number that is a cut point
    has a place of its own, nulls come first."""
    from pyspark.sql import functions as F

    at = F.array(*[F.lit(c) for c in cuts])
    below = F.size(F.filter(at, lambda c: c < number))
    upto = F.size(F.filter(at, lambda c: c <= number))
    return F.when(number.isNull(), F.lit(-1)).otherwise(below + upto)


def text_number(text):
    """The first seven bytes of a text as a number that sorts as the text."""
    from pyspark.sql import functions as F

    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def quantile_index(df: DataFrame, part: list[str], order: list, lead, second=None, lead_desc: bool = False,
                   second_desc: bool = False, out: str = "pos", slice_rows: int = SLICE_ROWS,
                   slices: int | None = None) -> DataFrame:
    """1-based position of each row within its ``part`` group by ``order``, as
    ``ordered_index``, with slices taken from the data.

    ``lead`` is a number that sorts as the first column of ``order``, and
    ``second`` (optional) one that never falls along the second. The table's
    quantiles of ``lead`` are the cut points of all groups, so no slice of any
    group holds more than about ``1 / slices`` of the table, wherever its rows
    lie; where so many rows share one ``lead`` that it is several quantiles,
    they are cut again by ``second``. Positions don't depend on the cuts.
    Tables below ``slice_rows`` are numbered by a plain window."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    slices = slices or max(SLICES[0], min(SLICES[1], 4 * df.sparkSession.sparkContext.defaultParallelism))
    n, cuts, heavy = _cuts(df, lead, slices)
    if n <= slice_rows or not cuts:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*cols)).cast("long"))
    sign = -1 if lead_desc else 1
    first = _place(lead, cuts) * sign
    if heavy and second is not None:
        crowded = lead.isin(heavy)
        # cut points within the crowd
        cuts2 = _cuts(df.filter(crowded), second, slices)[1]
        then = F.when(crowded, _place(second, cuts2) * (-1 if second_desc else 1)).otherwise(F.lit(0)) if cuts2 else F.lit(0)
    else:
        then = F.lit(0)
    # one number that never falls along the order
    width = 4 * (slices + 1)
    return ordered_index(df, part, cols, (first * F.lit(width) + then).cast("long"), out=out)
