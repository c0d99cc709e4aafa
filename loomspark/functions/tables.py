"""Calculators that return tables: one row in, one or more rows out, with state carried over a partition's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType


def potion_steps(needs: dict[int, int], top: int = 300):
    """A table function over (id, n, level, percent, sure_level, exp): what each potion, taken in the order of n, does to each id.

    The first row's level and percent are where an id starts. Up to sure_level a potion gives the level's need and keeps
    the percentage; above, it gives exp, carried over as many levels as it fills. At the top nothing more happens.
    Returns (id, n, level, percent, gained); call it with a table argument, it deals the rows by id and sorts them by n.
    """

    class Steps:
        def __init__(self) -> None:
            self.level: int | None = None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("potion_steps needs a table argument")
            names = {f.name: f.dataType for f in rows.dataType.fields}
            missing = {"id", "n", "level", "percent", "sure_level", "exp"} - names.keys()
            if missing:
                raise ValueError(f"potion_steps lacks {', '.join(sorted(missing))}")
            schema = StructType().add("id", names["id"]).add("n", IntegerType()).add("level", IntegerType()).add("percent", DoubleType()).add("gained", LongType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("id")], orderBy=[OrderingColumn("n")])

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.level is None:
                self.level, self.percent = row["level"], row["percent"]
                self.exp = int(needs[self.level] * (self.percent / 100.0)) if self.level < top else 0
            gained = 0
            if self.level < top:
                if self.level <= row["sure_level"]:
                    gained = needs[self.level]
                    self.level += 1
                    self.exp = int(needs.get(self.level, gained) * (self.percent / 100.0))
                else:
                    gained = row["exp"]
                    self.exp += gained
                    while self.level < top and self.exp >= needs[self.level]:
                        self.exp -= needs[self.level]
                        self.level += 1
                    self.percent = self.exp / needs[self.level] * 100.0 if self.level < top else 100.0
            yield row["id"], row["n"], self.level, self.percent if self.level < top else 100.0, gained

    return udtf(Steps)
