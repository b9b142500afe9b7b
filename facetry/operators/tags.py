"""Tags, fields and numberings of entities as tables: dim, ent, and a value that may be absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that say that a node is fixed, and that it is free and has no number.
FIXED, FREE = -2, -1


class Tags:
    """Named values of entities. Every operation gives a new set; tables are shared."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self.tables = dict(tables or {})

    def create(self, name: str, values: DataFrame) -> Tags:
        """`values`: dim, ent, value; entities without a row do not have the tag."""
        if name in self.tables:
            raise ValueError(f"there is a tag {name}")
        return Tags(self.tables | {name: values.select("dim", "ent", "value").where("value is not null")})

    def rename(self, old: str, new: str) -> Tags:
        return Tags({new if k == old else k: v for k, v in self.tables.items()})

    def destroy(self, name: str) -> Tags:
        return Tags({k: v for k, v in self.tables.items() if k != name})

    def names(self) -> list[str]:
        return list(self.tables)

    def has(self, name: str, entities: DataFrame) -> DataFrame:
        """`entities` (dim, ent) with has."""
        own = self.tables[name].select("dim", "ent", F.lit(True).alias("has"))
        return entities.join(own, ["dim", "ent"], "left").withColumn("has", F.coalesce("has", F.lit(False)))

    def remove(self, name: str, entities: DataFrame) -> Tags:
        """Takes the tag from some entities."""
        return Tags(self.tables | {name: self.tables[name].join(entities.select("dim", "ent"), ["dim", "ent"], "left_anti")})

    def remove_dimension(self, name: str, dim: int) -> Tags:
        return Tags(self.tables | {name: self.tables[name].where(F.col("dim") != dim)})

    def mapped(self, name: str, values: DataFrame, ids: DataFrame) -> Tags:
        """Values by a global id attached to entities: values(gid, value), ids(gid, dim, ent)."""
        return self.create(name, values.join(ids, "gid"))

    def checksum(self, name: str) -> DataFrame:
        """One row: a checksum that does not depend on the order of rows."""
        return self.tables[name].agg(F.coalesce(F.bit_xor(F.xxhash64("dim", "ent", "value")), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("entities"))


def field(entities: DataFrame, value: Column, components: int = 1) -> DataFrame:
    """ent, component, value: a field of `components` on the nodes of `entities`; `value` may use ent and component."""
    return entities.withColumn("component", F.explode(F.sequence(F.lit(0), F.lit(components - 1)))).withColumn("value", value).select("ent", "component", "value")


def packed(f: DataFrame) -> DataFrame:
    """ent, values: all components of a node in one array."""
    g = f.groupBy("ent").agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("c"))
    return g.select("ent", F.col("c.value").alias("values"))


def unpacked(p: DataFrame, first: int, count: int) -> DataFrame:
    """ent, component, value: components first .. first + count - 1 of a packed field, counted from 0."""
    return p.select("ent", F.posexplode(F.slice("values", first + 1, count)).alias("component", "value"))


def combined(fields: list[DataFrame]) -> DataFrame:
    """Packed fields side by side as one packed field."""
    out = fields[0]
    for k, f in enumerate(fields[1:]):
        out = out.join(f.withColumnRenamed("values", f"__{k}"), "ent").select("ent", F.concat("values", f"__{k}").alias("values"))
    return out


def synchronised_numbers(rep: DataFrame, own: DataFrame, numbers: DataFrame) -> DataFrame:
    """vert, part, number: every copy takes its owner's number. numbers: vert, part, number."""
    of = numbers.join(own, "vert").where("part = owner").select("vert", "number")
    return rep.select("vert", "part").join(of, "vert", "left")


def fixed(numbers: DataFrame, on: Column) -> DataFrame:
    return numbers.withColumn("number", F.when(on, F.lit(FIXED).cast("long")).otherwise(F.col("number")))


def is_numbered() -> Column:
    return F.col("number") >= 0


def with_offset(numbers: DataFrame, offset: int) -> DataFrame:
    """The offset added where there is a number; fixed and free nodes stay."""
    return numbers.withColumn("number", F.when(is_numbered(), F.col("number") + offset).otherwise(F.col("number")))


def path_of(part: Column, prefix: str, fanout: int = 2048, parts: int = 1) -> Column:
    """Where the file of a part lies: beyond `fanout` parts in a folder of `fanout` files each."""
    name = F.concat(part.cast("string"), F.lit(".smb"))
    return F.concat(F.lit(prefix), F.concat(F.floor(part / fanout).cast("string"), F.lit("/"), name) if parts > fanout else name)
