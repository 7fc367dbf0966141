"""Tables bound as sheets: the header is left out, columns are lettered in the order of the schema, and rows are in the
order of a key. Dates and timestamps become serial numbers; nulls are blank cells."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import Cell, serial_of
from gridloom.operators.ordered import with_positions
from gridloom.plans.syntax import column_letters


@dataclass
class Sheet:
    name: str
    df: DataFrame
    key: list[str]
    blanks: bool = True
    _placed: DataFrame | None = field(default=None, repr=False)

    def width(self) -> int:
        return len(self.df.columns)

    def kind(self, i: int) -> str:
        t = self.df.schema[i].dataType
        if isinstance(t, T.StringType):
            return "text"
        return "bool" if isinstance(t, T.BooleanType) else "num"

    def is_time(self, i: int) -> bool:
        return isinstance(self.df.schema[i].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)

    def cell(self, i: int, prefix: str = "") -> Cell:
        """Column i as cells."""
        own = self.df.schema[i]
        v: Column = F.col(prefix + own.name)
        day = None
        if self.is_time(i):
            v, day = serial_of(v), F.to_date(v)
        elif self.kind(i) == "num":
            v = v.cast("double")
        return Cell(self.kind(i), v, None, own.nullable and self.blanks, day=day)

    def placed(self) -> DataFrame:
        """The rows with their numbers, _row from 1."""
        if self._placed is None:
            self._placed = with_positions(self.df, self.key)
        return self._placed

    def letters(self) -> dict[str, str]:
        return {column_letters(i): c for i, c in enumerate(self.df.columns)}


def bind(spark: SparkSession, sf_dir: str, name: str, key: list[str] | None = None, columns: list[str] | None = None, blanks: bool = True) -> Sheet:
    """A parquet table as a sheet. Nulls are blank cells wherever the schema allows them; blanks=False promises that there
    are none, which makes plans shorter."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return Sheet(name, df, key or [df.columns[0]], blanks)
