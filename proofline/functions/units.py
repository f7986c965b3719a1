"""Units as a dimension table: written unit to SI unit, scale and offset; compounds are parsed once per distinct unit."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Written unit, SI unit, scale, offset (si = value * scale + offset).
UNITS = [
    ("m", "m", 1.0, 0.0), ("mm", "m", 1e-3, 0.0), ("cm", "m", 1e-2, 0.0), ("m2", "m2", 1.0, 0.0), ("m3", "m3", 1.0, 0.0), ("s", "s", 1.0, 0.0), ("min", "s", 60.0, 0.0),
    ("h", "s", 3600.0, 0.0), ("kg", "kg", 1.0, 0.0), ("kg/m3", "kg/m3", 1.0, 0.0), ("kg/s", "kg/s", 1.0, 0.0), ("m3/s", "m3/s", 1.0, 0.0), ("ppm", "1", 1e-6, 0.0),
    ("kg/kg", "kg/kg", 1.0, 0.0), ("pa", "Pa", 1.0, 0.0), ("kpa", "Pa", 1e3, 0.0), ("bar", "Pa", 1e5, 0.0), ("degc", "K", 1.0, 273.15), ("k", "K", 1.0, 0.0), ("w", "W", 1.0, 0.0),
    ("kw", "W", 1e3, 0.0), ("a", "A", 1.0, 0.0), ("ma", "A", 1e-3, 0.0), ("v", "V", 1.0, 0.0), ("hz", "Hz", 1.0, 0.0), ("turns", "1", 1.0, 0.0), ("1", "1", 1.0, 0.0),
    ("1/h", "1/s", 1.0 / 3600.0, 0.0), ("1/s", "1/s", 1.0, 0.0), ("ach", "1/s", 1.0 / 3600.0, 0.0), ("person", "1", 1.0, 0.0), ("persons", "1", 1.0, 0.0), ("people", "1", 1.0, 0.0),
    ("count", "1", 1.0, 0.0), ("normalized", "1", 1.0, 0.0), ("normalised", "1", 1.0, 0.0),
]
# Units that are only read in the case in which they are written here.
CASE_SENSITIVE = ["m", "mm", "cm", "m2", "m3", "s", "min", "h", "kg", "kg/m3", "kg/s", "m3/s", "ppm", "kg/kg", "turns", "1", "1/h", "1/s"]
# Exponents of kg, m, s, K, A; a compound is reduced to the first unit of its dimension.
DIMENSIONS = {
    "1": (0, 0, 0, 0, 0), "kg/kg": (0, 0, 0, 0, 0), "m": (0, 1, 0, 0, 0), "m2": (0, 2, 0, 0, 0), "m3": (0, 3, 0, 0, 0), "s": (0, 0, 1, 0, 0), "kg": (1, 0, 0, 0, 0), "kg/m3": (1, -3, 0, 0, 0),
    "kg/s": (1, 0, -1, 0, 0), "m3/s": (0, 3, -1, 0, 0), "1/s": (0, 0, -1, 0, 0), "Hz": (0, 0, -1, 0, 0), "Pa": (1, -1, -2, 0, 0), "K": (0, 0, 0, 1, 0), "W": (1, 2, -3, 0, 0), "A": (0, 0, 0, 0, 1),
    "V": (1, 2, -3, 0, -1),
}


def unit_key(unit: Column) -> Column:
    """The table's key of a written unit, or null: case decides first, then lower case is tried."""
    text = F.trim(unit)
    for written, plain in (("²", "2"), ("³", "3"), ("^", ""), ("°C", "degC"), ("℃", "degC")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.when(text.isin(CASE_SENSITIVE), text).when(F.lower(text).isin([u for u, *_ in UNITS if u not in CASE_SENSITIVE]), F.lower(text))


def dimension(spark: SparkSession) -> DataFrame:
    """The unit table; three dozen rows."""
    return spark.createDataFrame(UNITS, "unit_key string, si_unit string, scale double, offset double")


def compound(unit: str) -> tuple[str, float] | None:
    """SI unit and scale of products and quotients of plain units. Shunting: values and pending operators on two stacks."""
    plain = {u: (si, scale) for u, si, scale, offset in UNITS if not offset}

    def known(word: str) -> tuple[tuple[int, ...], Fraction | float] | None:
        key = word.strip().replace("²", "2").replace("³", "3").replace("^", "")
        key = key if key in CASE_SENSITIVE else key.lower() if key.lower() not in CASE_SENSITIVE else None
        if key in plain:
            si, scale = plain[key]
            return DIMENSIONS[si], scale
        return None

    tokens = [t.strip() for t in re.split(r"(\(|\)|/|\*|·|\.|\bper\b)", unit, flags=re.I) if t.strip()]
    rank = {"/": 1, "per": 1, "*": 2, "·": 2, ".": 2}
    values: list = []
    pending: list[str] = []

    def apply() -> bool:
        op = pending.pop()
        if len(values) < 2 or op == "(":
            return False
        (d2, s2), (d1, s1) = values.pop(), values.pop()
        sign = -1 if rank[op] == 1 else 1
        values.append((tuple(a + sign * b for a, b in zip(d1, d2, strict=True)), s1 / s2 if sign < 0 else s1 * s2))
        return True

    operand_next = True
    for token in tokens:
        op = token.lower()
        if op == "(":
            if not operand_next:
                return None
            pending.append("(")
        elif op == ")":
            if operand_next:
                return None
            while pending and pending[-1] != "(":
                if not apply():
                    return None
            if not pending:
                return None
            pending.pop()
        elif op in rank:
            if operand_next:
                return None
            while pending and pending[-1] != "(" and rank[pending[-1]] >= rank[op]:
                if not apply():
                    return None
            pending.append(op)
            operand_next = True
        else:
            value = known(token)
            if value is None or not operand_next:
                return None
            values.append(value)
            operand_next = False
    while pending:
        if not apply():
            return None
    if operand_next or len(values) != 1:
        return None
    dim, scale = values[0]
    si = next((u for u, d in DIMENSIONS.items() if d == dim), None)
    return (si, float(scale)) if si else None


@F.pandas_udf(T.StructType([T.StructField("si_unit", T.StringType()), T.StructField("scale", T.DoubleType())]))
def compound_units(units: pd.Series) -> pd.DataFrame:
    """compound() over a column; meant for distinct units."""
    found = [compound(u) or (None, None) for u in units]
    return pd.DataFrame({"si_unit": [f[0] for f in found], "scale": [f[1] for f in found]})


def to_si(values: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """`values` with si_value and si_unit; both null where the unit is unknown. Units are resolved once each."""
    spark = values.sparkSession
    keyed = values.select(unit).distinct().withColumn("unit_key", unit_key(F.col(unit)))
    table = keyed.join(F.broadcast(dimension(spark)), "unit_key", "left")
    rest = table.where(F.col("si_unit").isNull() & F.col(unit).isNotNull()).withColumn("c", compound_units(F.col(unit))).select(unit, F.col("c.si_unit").alias("si_unit"), F.col("c.scale").alias("scale"), F.lit(0.0).alias("offset"))
    resolved = table.where("si_unit is not null").select(unit, "si_unit", "scale", "offset").union(rest)
    return values.join(resolved, unit, "left").withColumn("si_value", F.col(value) * F.col("scale") + F.col("offset")).drop("scale", "offset")


def list_to_si(values: Column, scale: Column, offset: Column) -> Column:
    """A list of values in SI."""
    return F.transform(values, lambda v: v * scale + offset)
