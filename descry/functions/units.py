"""Unit conversion by a rules table joined on (property, from, to); undefined cases are null with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: from, to, kind (fixed values). M is mol/L; kinds that need the molecular weight say so.
KINDS = {
    "log10": lambda v, w: F.log10(F.when(v > 0, v)),
    "neg_log10": lambda v, w: -F.log10(F.when(v > 0, v)),
    "pow10": lambda v, w: F.pow(F.lit(10.0), v),
    "pow10_neg": lambda v, w: F.pow(F.lit(10.0), -v),
    "gl_to_neg_log_m": lambda v, w: -F.log10(F.when((v > 0) & (w > 0), F.try_divide(v, w))),
    "mgl_to_neg_log_m": lambda v, w: -F.log10(F.when((v > 0) & (w > 0), F.try_divide(v, w * 1000))),
    "neg_log_m_to_gl": lambda v, w: F.pow(F.lit(10.0), -v) * F.when(w > 0, w),
    "neg_log_m_to_mgl": lambda v, w: F.pow(F.lit(10.0), -v) * F.when(w > 0, w) * 1000,
    "log_m_to_gl": lambda v, w: F.pow(F.lit(10.0), v) * F.when(w > 0, w),
}
NEEDS_WEIGHT = ("gl_to_neg_log_m", "mgl_to_neg_log_m", "neg_log_m_to_gl", "neg_log_m_to_mgl", "log_m_to_gl")


def convert(rows: DataFrame, rules: DataFrame, value: str = "value", weight: str = "mol_weight") -> DataFrame:
    """rows with `converted` and `reason`. rows: property, from_unit, to_unit, value, mol_weight; rules: property, from_unit, to_unit, kind.

    Equal units return the value untouched. No rule, a missing or non-positive weight where one is
    needed, or the logarithm of a value that isn't positive: null, and the reason says so.
    The rules table has one row for each property and pair of units, so the planner broadcasts it.
    """
    v, w, kind = F.col(value), F.col(weight), F.col("kind")
    same = F.col("from_unit") == F.col("to_unit")
    out = F.when(same, v)
    for name, f in KINDS.items():
        out = out.when(kind == name, f(v, w))
    reason: Column = (
        F.when(v.isNull(), "no value")
        .when(same, F.lit(None).cast("string"))
        .when(kind.isNull(), "no rule")
        .when(kind.isin(*NEEDS_WEIGHT) & ~F.coalesce(w > 0, F.lit(False)), "no molecular weight")
        .when(F.col("converted").isNull(), "logarithm of a value that is not positive")
    )
    joined = rows.join(rules, ["property", "from_unit", "to_unit"], "left")
    return joined.withColumn("converted", out).withColumn("reason", reason).drop("kind")


#: Properties that are shown in mg/L (fixed values).
IN_MGL = (
    "Water Solubility",
    "Acute aquatic toxicity",
    "96 hour fathead minnow LC50",
    "96 hour scud LC50",
    "96 hour rainbow trout LC50",
    "96 hour bluegill LC50",
    "48 hour Tetrahymena pyriformis IGC50",
    "48 hour Daphnia magna LC50",
)


def display_unit(prop: Column, unit: Column, to_mgl: tuple[str, ...] = IN_MGL) -> Column:
    return F.when(prop.isin(*to_mgl), F.lit("mg/L")).otherwise(unit)
