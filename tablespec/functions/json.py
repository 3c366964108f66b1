"""JSON columns against declared shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """An object with named attributes (name -> SQL type), an array of one type, or one type."""

    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    element: str | None = None
    scalar: str | None = None

    def holds(self, v: Column) -> Column:
        get = lambda path, t: F.try_variant_get(v, path, t).isNotNull()
        if self.scalar:
            return get("$", self.scalar)
        if self.element:
            return get("$", f"array<{self.element}>")
        out = F.schema_of_variant(v).startswith("OBJECT")
        for name, kind in self.attributes.items():
            out = out & get(f"$.{name}", kind)
        return F.coalesce(out, F.lit(False))

    def shred(self, v: Column) -> Column:
        if self.scalar or self.element:
            return F.try_variant_get(v, "$", self.scalar or f"array<{self.element}>")
        return F.struct(*(F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in self.attributes.items()))


def json_conform(df: DataFrame, col: str, branches: list[Shape]) -> DataFrame:
    """Adds branch (the first shape that a value matches; null: none), valid, and one shredded column
    per shape, null where another branch matched. Null values are valid; broken JSON is not."""
    parsed = df.withColumn("_v", F.try_parse_json(col))
    branch = F.lit(None).cast("string")
    for s in reversed(branches):
        branch = F.when(s.holds(F.col("_v")), F.lit(s.name)).otherwise(branch)
    named = parsed.withColumn("branch", branch).withColumn("valid", F.col(col).isNull() | F.col("branch").isNotNull())
    return named.withColumns({s.name: F.when(F.col("branch") == s.name, s.shred(F.col("_v"))) for s in branches}).drop("_v")
