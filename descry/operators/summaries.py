"""Summaries of runs, histograms by a property's own bins, and whole prediction reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a summary reads of a results document.
RUN_SCHEMA = """model_details struct<is_binary: boolean, embedding_len: int, embedding: array<string>>,
 model_statistics struct<test_stats: map<string, double>, cv_stats: map<string, double>, ext_stats: map<string, double>>"""
#: The sets of a summary: its column, the document's block, the end of a statistic's name there.
_SETS = (("test", "test_stats", "Test"), ("training_cv", "cv_stats", "CV_Training"), ("external", "ext_stats", "External"))
#: Characters of a list of features that a summary shows.
SHOWN = 100


def run_summary(runs: DataFrame, continuous: str = "MAE", binary: str = "BA", by: str | None = "auto", ascending: bool | None = None) -> DataFrame:
    """One row for each run (of `read_runs` with RUN_SCHEMA): its metric by task on each set, its number of features and their list, shortened.

    by: the set to sort by, or None; auto sorts by the test set if all runs have the same metric.
    Smaller is better but for the binary metric, unless ascending is given. Runs without the value
    come last; equal ones by name. A value that is no finite number counts as missing.
    """
    columns = [name for name, *_ in _SETS]
    if by not in (None, "auto", *columns):
        raise ValueError(f"sort by one of {', '.join(columns)}, auto or None")
    details, found = F.col("model_details"), F.col("model_statistics")
    is_binary = F.coalesce(details["is_binary"], F.lit(False))
    metric = F.when(is_binary, binary).otherwise(continuous)

    def value(block: str, end: str) -> Column:
        x = F.coalesce(*[F.when(is_binary == flag, F.try_element_at(found[block], F.lit(f"{m}_{end}"))) for flag, m in ((True, binary), (False, continuous))])
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    listed = F.array_join(details["embedding"], ", ")
    shown = F.when(F.char_length(listed) > SHOWN, F.concat(F.substring(listed, 1, SHOWN), F.lit("..."))).otherwise(listed)
    n = F.coalesce(details["embedding_len"], F.when(details["embedding"].isNotNull(), F.size(details["embedding"])))
    out = runs.select("run", metric.alias("metric"), *[value(block, end).alias(name) for name, block, end in _SETS], n.alias("n_variables"), shown.alias("embedding"))
    if by == "auto":
        by = "test" if len(out.select("metric").distinct().limit(2).collect()) == 1 else None
    if by is None:
        return out
    rising = F.lit(ascending) if ascending is not None else F.col("metric") != binary
    return out.orderBy(F.asc_nulls_last(F.when(rising, F.col(by)).otherwise(-F.col(by))), "run")


def _edges(lo: float, hi: float, width: float) -> list[float]:
    n = max(1, round((hi - lo) / width))
    return [lo + (hi - lo) * i / n for i in range(n + 1)]


def _padded(lo: float, hi: float, pad: int, least: float = -math.inf) -> list[float]:
    """Edges of width `pad` over the range to the nearest hundreds, one bin more on either side."""
    return _edges(max(round(lo, -2) - pad, least), round(hi, -2) + pad, pad)


def bin_edges(name: str, unit: str, lo: float, hi: float) -> list[float]:
    """Edges of a property's histogram over values from lo to hi, by its name, else by its unit."""
    lo, hi = math.floor(lo), math.ceil(hi)
    # Ranges and widths below are fixed values: histograms of one property must agree between runs.
    fixed = {"Density": (0.5, 4, 0.25), "Liquid Chromatography Retention Time": (0, 50, 5), "Percentage Biodegradation": (0, 100, 10), "Fraction Unbound in Human Plasma": (0, 1, 0.1)}
    padded = {"Surface Tension": 10, "Thermal Conductivity": 25}
    if name in padded:
        return _padded(lo, hi, padded[name], 0)
    if name == "Viscosity":
        return _edges(lo, hi, 0.5)
    # A unit of degrees goes before the fixed range of a fraction; both never meet.
    if name in fixed:
        return _edges(*fixed[name])
    if "°C" in unit:
        return _padded(lo, hi, 50)
    if "log" in unit.lower():
        lo, hi = lo - 1, hi + 1
        return _edges(lo, hi, 0.5) if hi - lo + 1 < 12 else [float(x) for x in range(lo, hi)]
    if unit == "Binary 0/1":
        return [-0.5, 0.5, 1.5]
    return [float(x) for x in range(lo, hi + 1)] if hi > lo else [float(lo), lo + 1.0]


def histogram_of(df: DataFrame, column: str, edges: list[float], *by: str) -> DataFrame:
    """(by, bin, low, high, n) for the bins between edges that hold values; the last one holds its right edge, values outside of all edges are not counted."""
    at = F.array(*map(F.lit, map(float, edges)))
    x = F.col(column)
    place = F.least(F.size(F.filter(at, lambda e: e <= x)) - 1, F.lit(len(edges) - 2))
    own = df.filter(x.between(float(edges[0]), float(edges[-1]))).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return own.select(*by, "bin", F.get(at, F.col("bin")).alias("low"), F.get(at, F.col("bin") + 1).alias("high"), "n")


def histogram_by_rule(df: DataFrame, column: str, name: str, unit: str, *by: str) -> DataFrame:
    """`histogram_of` over the bins of a property, shared by all groups."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = (0.0, 1.0) if ends["lo"] is None else (float(ends["lo"]), float(ends["hi"]))
    return histogram_of(df, column, bin_edges(name, unit, lo, hi), *by)


def prediction_reports(results: DataFrame, chemicals: DataFrame, experiments: DataFrame, estimates: DataFrame, neighbours: DataFrame, details: Column, units: tuple[str, str], display=lambda x: x, key: str = "id") -> DataFrame:
    """(id, report): one JSON document for each query row, missing values as null.

    results (id, pred, error), chemicals (id, ...) with its identifiers, experiments (id, exp, set),
    estimates (id, method, conclusion, reason) with a row for each domain measure, neighbours
    (id, set, rank, ...) with set Training or Test. details: the model's description. units: the
    model's and those shown, between which `display` converts. A row with an error has no
    prediction. Each side is summed by id before the joins: an id has as many estimates as there are
    measures and as many neighbours as were asked for, never more.
    """
    shown = [c for c in chemicals.columns if c != key]
    who = chemicals.select(key, F.struct(*shown).alias("chemical"))
    judged = estimates.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("method", "conclusion", "reason"))).alias("judged"))
    of_row = [c for c in neighbours.columns if c not in (key, "set")]
    listed = lambda name: F.array_sort(F.collect_list(F.when(F.col("set") == name, F.struct("rank", *[c for c in of_row if c != "rank"]))))
    near = neighbours.groupBy(key).agg(listed("Training").alias("near_training"), listed("Test").alias("near_test"))
    rows = results.join(who, key, "left").join(experiments.select(key, "exp", "set"), key, "left").join(judged, key, "left").join(near, key, "left")
    pred = F.when(F.col("error").isNull(), F.col("pred"))
    found = F.struct(
        F.col("exp").alias("experimentalValueUnitsModel"),
        display(F.col("exp")).alias("experimentalValueUnitsDisplay"),
        F.col("set").alias("experimentalValueSet"),
        pred.alias("predictionValueUnitsModel"),
        F.lit(units[0]).alias("unitsModel"),
        display(pred).alias("predictionValueUnitsDisplay"),
        F.lit(units[1]).alias("unitsDisplay"),
        F.col("error").alias("predictionError"),
        F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType)).alias("adEstimates"),
    )
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    report = F.struct(F.col("chemical").alias("chemicalIdentifiers"), details.alias("modelDetails"), found.alias("modelResults"), some("near_training").alias("neighborResultsTraining"), some("near_test").alias("neighborResultsPrediction"))
    return rows.select(key, F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))
