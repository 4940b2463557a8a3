"""The k nearest seeds of cells, exactly, by descending a pyramid of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a block in blocks of the next level, and blocks that the first level has along an axis, at most.
FAN, FIRST = 4, 8


def _blocks(cells: DataFrame, keys: list[str], size: int, p: str) -> DataFrame:
    """The blocks of a size that hold cells: place, box and number of cells."""
    place = [F.floor(F.col(c) / size).alias(f"{p}{c}") for c in ("row", "col")]
    ends = [f(c).alias(f"{p}{n}_{c}") for c in ("row", "col") for n, f in (("low", F.min), ("high", F.max))]
    return cells.groupBy(*keys, *place).agg(*ends, F.count("*").alias(f"{p}n"))


def _apart(bound: str) -> Column:
    """Squared distance of two boxes' nearest or farthest cells."""

    def along(c: str) -> Column:
        one, two = F.col(f"s_low_{c}") - F.col(f"t_high_{c}"), F.col(f"t_low_{c}") - F.col(f"s_high_{c}")
        gap = F.greatest(F.lit(0), one, two) if bound == "least" else F.greatest(-one, -two)
        return gap.cast("long") * gap

    return along("row") + along("col")


def _kept(pairs: DataFrame, keys: list[str], k: int, reach: float | None) -> DataFrame:
    """Pairs of blocks that may hold one of the k nearest seeds of a cell.

    Of a block's partners in order of their farthest cells, those up to the one that completes k seeds give each cell k
    seeds within its distance; partners whose nearest cell lies beyond it can't matter.
    """
    mine = Window.partitionBy(*keys, "t_row", "t_col")
    order = mine.orderBy("most", "s_row", "s_col").rowsBetween(Window.unboundedPreceding, 0)
    bounded = pairs.withColumns({"least": _apart("least"), "most": _apart("most")}).withColumn("sum", F.sum("s_n").over(order))
    bounded = bounded.withColumns({"limit": F.min(F.when(F.col("sum") >= k, F.col("most"))).over(mine), "first": F.min("least").over(mine)})
    near = F.col("limit").isNull() | (F.col("least") <= F.col("limit"))
    if reach is not None:
        near = near & (F.col("first") <= float(reach) * reach)
    return bounded.where(near).select(*keys, "t_row", "t_col", "s_row", "s_col")


def k_nearest(cells: DataFrame, seeds: DataFrame, k: int = 1, keys: tuple[str, ...] = (), reach: float | None = None, order: tuple[str, ...] = ("srow", "scol")) -> DataFrame:
    """*keys, row, col, srow, scol, d2, place and the seeds' other columns: for each of cells(*keys, row, col) its k nearest of seeds(*keys, row, col, ...), fewer if there are fewer; ties in the order of the columns ``order``.

    Cells whose nearest seed lies beyond ``reach`` are left out; cells and seeds are read once for each level, so
    give tables. Null places take no part, and keys that one side lacks have no rows. Cells and seeds are dealt into
    squares, and pairs of squares are kept by bounds, so a cell meets k seeds times a constant, however far they are; a
    square meets its children on keys and place, so one key's cells spread over all tasks.
    """
    if k < 1:
        raise ValueError("k is positive")
    g = list(keys)
    held = [c for c in seeds.columns if c not in (*g, "row", "col")]
    cells = cells.select(*g, "row", "col").dropna(subset=["row", "col"])
    seeds = seeds.dropna(subset=["row", "col"])
    span = lambda c: F.max(c) - F.min(c)
    both = cells.unionByName(seeds.select(*g, "row", "col"))
    extent = both.groupBy(*g).agg(F.greatest(span("row"), span("col")).alias("d")).agg(F.max("d")).first()[0] or 0
    size = FAN
    while size * FIRST <= extent:
        size *= FAN
    # the first level: at most (FIRST + 1) ** 2 blocks of either kind for each key
    one, two = _blocks(cells, g, size, "t_"), _blocks(seeds, g, size, "s_")
    if not g:
        one, two = one.withColumn("__all", F.lit(0)), two.withColumn("__all", F.lit(0))
    pairs = _kept(one.join(two, g or "__all"), g, k, reach)
    parent = lambda p: [F.floor(F.col(f"{p}_{c}") / FAN).alias(f"{p}_up_{c}") for c in ("row", "col")]
    while size > FAN:
        size //= FAN
        up = pairs.withColumnsRenamed({f"{p}_{c}": f"{p}_up_{c}" for p in "ts" for c in ("row", "col")})
        one, two = (_blocks(x, g, size, f"{p}_").select("*", *parent(p)) for x, p in ((cells, "t"), (seeds, "s")))
        pairs = up.join(one, [*g, "t_up_row", "t_up_col"]).join(two, [*g, "s_up_row", "s_up_col"])
        pairs = _kept(pairs, g, k, reach)
    inner = lambda p, row, col: [F.floor(F.col(c) / FAN).alias(f"{p}_{n}") for n, c in (("row", row), ("col", col))]
    seeds = seeds.select(*g, F.col("row").alias("srow"), F.col("col").alias("scol"), *held)
    found = pairs.join(cells.select("*", *inner("t", "row", "col")), [*g, "t_row", "t_col"]).join(seeds.select("*", *inner("s", "srow", "scol")), [*g, "s_row", "s_col"])
    dr, dc = (F.col("row") - F.col("srow")).cast("long"), (F.col("col") - F.col("scol")).cast("long")
    found = found.withColumn("d2", dr * dr + dc * dc)
    if reach is not None:
        mine = Window.partitionBy(*g, "row", "col")
        found = found.withColumn("first", F.min("d2").over(mine)).where(F.col("first") <= float(reach) * reach)
    place = F.row_number().over(Window.partitionBy(*g, "row", "col").orderBy("d2", *order))
    return found.withColumn("place", place).where(F.col("place") <= k).select(*g, "row", "col", "srow", "scol", "d2", "place", *held)
