"""Apply: missing members of dimensions, key resolution, facts that are not there yet.

Files know no unique constraint, so every insert is distinct keys, an anti join with
what exists, and an append; doing it twice inserts nothing the second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import first_of_each


def missing_members(rows: DataFrame, dimension: DataFrame, keys: list[str], others: list[str] = ()) -> DataFrame:
    """Members that dimension lacks: one row per key, with the least of each other column."""
    candidates = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    candidates = candidates.groupBy(*keys).agg(*[F.min(c).alias(c) for c in others]) if others else candidates.select(*keys).distinct()
    return candidates.join(dimension.select(*keys), keys, "left_anti")


def with_surrogate(new: DataFrame, dimension: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """new + ids that go on from the greatest one; new members of a dimension are few, so one window orders them."""
    last = dimension.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    place = F.row_number().over(Window.orderBy(*keys))
    return new.withColumn(id_column, (last + place).cast("bigint"))


def grown(dimension: DataFrame, new: DataFrame) -> DataFrame:
    return dimension.unionByName(new, allowMissingColumns=True)


def statuses(rows: DataFrame, columns: dict[str, str], default: str = "UNKNOWN") -> DataFrame:
    """(code, kind, name) of several status columns at once: one unpivot, not a scan each.

    columns: kind -> column.  Two spellings of one code are one member with the lesser name.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in columns.items()])
    long = rows.select(F.explode(pairs).alias("s")).select("s.*")
    name = F.coalesce("name", F.lit(default))
    code = F.upper(F.replace(name, F.lit(" "), F.lit("_")))
    return long.select(code.alias("code"), "kind", name.alias("name")).groupBy("code", "kind").agg(F.min("name").alias("name"))


def resolve(rows: DataFrame, dimension: DataFrame, on: dict[str, str], id_name: str, how: str = "inner", **constants) -> DataFrame:
    """rows + the id of the dimension member that on (column -> member column) and constants name."""
    kept = dimension
    for column, value in constants.items():
        kept = kept.where(F.col(column) == value)
    member = kept.select(F.col("id").alias(id_name), *[F.col(m).alias(f"__{id_name}_{m}") for m in on.values()])
    condition = [F.col(c) == F.col(f"__{id_name}_{m}") for c, m in on.items()]
    return rows.join(member, condition, how).drop(*[f"__{id_name}_{m}" for m in on.values()])


def new_boxes(rows: DataFrame, boxes: DataFrame, order: str = "row_num") -> DataFrame:
    """One row per box code that boxes lacks: the one with the least row number."""
    fresh = rows.where("box_code is not null").join(boxes.select(F.col("code").alias("box_code")), "box_code", "left_anti")
    return first_of_each(fresh, ["box_code"], order)


def new_facts(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no fact has; null parts are equal to each other, so nothing is inserted twice."""
    renamed = facts.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
