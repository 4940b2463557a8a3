"""Grids and schemas. Row 0 is south; NULL is nodata; values are doubles inside the engine."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -9999.0
POINTS = "site string, x double, y double, z double, intensity float, return_number tinyint, classification tinyint"
CELLS = "site string, layer string, row int, col int, value double"
FEATURES = "feat_id long, cls string, score double, geom_type string, rings array<array<struct<x:double,y:double>>>"


#: Frames of sites are broadcast up to this many (5 MB); beyond it rows are shuffled by site.
BROADCAST_SITES = 100_000


class Frame:
    """What a grid computes; x_min, y_min, pixel_size, width and height are numbers or columns."""

    keys: tuple[str, ...] = ()

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x_min) / self.pixel_size)

    def row(self, y: Column) -> Column:
        return F.floor((y - self.y_min) / self.pixel_size)

    def holds(self, x: Column, y: Column) -> Column:
        """Half-open cell membership; NaN and infinities are outside."""
        right, top = self.x_min + self.width * self.pixel_size, self.y_min + self.height * self.pixel_size
        return F.coalesce((x >= self.x_min) & (x < right) & (y >= self.y_min) & (y < top), F.lit(False))

    def contains(self, x: Column, y: Column) -> Column:
        """Membership closed on all four sides."""
        right, top = self.x_min + self.width * self.pixel_size, self.y_min + self.height * self.pixel_size
        return x.between(self.x_min, right) & y.between(self.y_min, top)

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Fractional (col, row); whole numbers are cell centres."""
        return (x - self.x_min) / self.pixel_size - 0.5, (y - self.y_min) / self.pixel_size - 0.5

    def world(self, col: Column, row: Column) -> tuple[Column, Column]:
        return self.x_min + (col + 0.5) * self.pixel_size, self.y_min + (row + 0.5) * self.pixel_size

    def attach(self, df: DataFrame) -> DataFrame:
        """df with the columns that the frame's numbers refer to."""
        return df

    def detach(self, df: DataFrame) -> DataFrame:
        return df


@dataclass(frozen=True)
class Grid(Frame):
    """A raster frame: cell (0, 0) has its south-west corner at (x_min, y_min)."""

    x_min: float = 0.0
    y_min: float = 0.0
    pixel_size: float = 1.0
    width: int = 105
    height: int = 100
    crs: str = "EPSG:3857"

    def __post_init__(self) -> None:
        if self.pixel_size <= 0 or self.width < 1 or self.height < 1:
            raise ValueError("a grid needs a positive pixel size, width and height")

    @classmethod
    def from_dict(cls, given: dict) -> Grid:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown grid keys: {sorted(unknown)}")
        return cls(**given)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every (row, col)."""
        rows = spark.range(self.height).select(F.col("id").cast("int").alias("row"))
        return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(self.width - 1))).alias("col"))


class SiteGrids(Frame):
    """The frames of many sites, ``grids(*keys, x_min, y_min, pixel_size, width, height)``: operators that take a grid then keep the sites apart."""

    NUMBERS = ("x_min", "y_min", "pixel_size", "width", "height")

    def __init__(self, grids: DataFrame, keys: tuple[str, ...] = ("site",)):
        self.keys = tuple(keys)
        self.table = grids.select(*self.keys, *(F.col(n).alias(f"__{n}") for n in self.NUMBERS))
        for n in self.NUMBERS:
            setattr(self, n, F.col(f"__{n}"))

    def attach(self, df: DataFrame) -> DataFrame:
        few = self.table.count() <= BROADCAST_SITES
        return self.detach(df).join(F.broadcast(self.table) if few else self.table, list(self.keys))

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*(f"__{n}" for n in self.NUMBERS))

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every (*keys, row, col)."""
        span = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        rows = self.table.select(*self.keys, span("__height").alias("row"), "__width")
        return rows.select(*self.keys, "row", span("__width").alias("col"))


GRID = Grid()
