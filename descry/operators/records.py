"""Records with a changing set of parameters, and the report tables made of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.scalars import sanitised_name
from descry.operators.metric_index import written


def parameter_pivot(rows: DataFrame, key: str, name: str, fields: Sequence[str], order: str, duplicates: str = "id_suffix", prefix: str = "", most_columns: int = 5000) -> DataFrame:
    """One row for each key; a column <prefix><parameter>_<field> for each parameter and field (<prefix><parameter> for a single field).

    A parameter that a record holds more than once: `id_suffix` numbers its columns _1, _2, ... in
    that record, `first` takes the first by `order`, `list` makes every column an array in that
    order. Keys without any named parameter keep a row of nulls. The set of parameters is read
    first and bounds the width: more than most_columns is an error.
    """
    if duplicates not in ("id_suffix", "first", "list"):
        raise ValueError(f"no such way with duplicates: {duplicates}")
    fields = list(fields)
    named = F.when(F.col(name).isNotNull(), sanitised_name(F.col(name), F.lit("unnamed")))
    base = rows.select(F.col(key), named.alias("p"), F.struct(F.col(order).alias("o"), F.struct(*fields).alias("v")).alias("c"))
    # Sums by (record, parameter) first, so that a record of very many values is dealt by its parameters.
    if duplicates == "first":
        cells = base.groupBy(key, "p").agg(F.array(F.min_by("c", "c.o")).alias("cs"))
    else:
        cells = base.groupBy(key, "p").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    if duplicates == "list":
        of = lambda f: F.transform("cs", lambda c: c["v"][f]).alias(f)
        lists = F.struct(*map(of, fields))
        entries = F.array(F.struct(F.col("p").alias("name"), lists.alias("value")))
    else:
        numbered = lambda c, i: F.struct(F.concat("p", F.when(F.size("cs") > 1, F.concat(F.lit("_"), (i + 1).cast("string"))).otherwise("")).alias("name"), c["v"].alias("value"))
        entries = F.transform("cs", numbered)
    none = F.filter(entries, lambda _: F.lit(False))
    each = cells.select(key, F.when(F.col("p").isNotNull(), entries).otherwise(none).alias("entries"))
    # A number may make one parameter's column another's name: the first of both values stays.
    whole = each.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("entries")), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("entries"))
    records = written(whole.select(key, F.filter("entries", lambda e, i: (i == 0) | (F.get("entries", i - 1)["name"] != e["name"])).alias("entries")))
    names = sorted(r["n"] for r in records.select(F.explode("entries.name").alias("n")).distinct().limit(most_columns + 1).collect())
    if len(names) > most_columns:
        raise ValueError(f"more than {most_columns} parameter columns")
    label = (lambda p, f: f"{prefix}{p}") if len(fields) == 1 else (lambda p, f: f"{prefix}{p}_{f}")
    cell = F.map_from_entries("entries")
    return records.select(key, cell.alias("m")).select(key, *[F.try_element_at("m", F.lit(p))[f].alias(label(p, f)) for p in names for f in fields])


def fold_table(predictions: DataFrame, substances: DataFrame, key: str = "id") -> DataFrame:
    """Cross-validation predictions with their substance, absolute error and fold."""
    return predictions.join(substances, key, "left").withColumn("abs_error", F.abs(F.col("exp") - F.col("pred")))


def test_table(predictions: DataFrame, substances: DataFrame, flags: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Test predictions with their substance, absolute error and one AD_<measure> column for each measure."""
    out = fold_table(predictions, substances, key)
    for measure, flag in flags.items():
        out = out.join(flag.select(key, F.col("inside").alias(f"AD_{measure}")), key, "left")
    return out


test_table.__test__ = False  # not a test, whatever its name


def external_table(predictions: DataFrame, training: DataFrame, substances: DataFrame, key: str = "id") -> DataFrame:
    """External predictions without the members of the training set and without rows that lack id, exp or pred."""
    whole = predictions.dropna(how="any", subset=[key, "exp", "pred"])
    return fold_table(whole.join(training.select(key), key, "left_anti"), substances, key)


def parameter_names(rows: DataFrame, name: str) -> DataFrame:
    """One row with the distinct parameter names, sorted."""
    return rows.agg(F.array_sort(F.collect_set(name)).alias("names"))


def evaluated(predictions: DataFrame) -> DataFrame:
    """Rows with both values, their absolute error, the largest first."""
    return predictions.dropna(subset=["exp", "pred"]).withColumn("abs_diff", F.abs(F.col("exp") - F.col("pred"))).orderBy(F.desc("abs_diff"))


def performance(stats: Column, binary: bool) -> Column:
    """The performance block of a model from its map of statistics: train, fiveFoldICV, external and externalAD, each metric by its first name that the map has."""
    first = lambda *names: F.coalesce(*[F.try_element_at(stats, F.lit(n)) for n in names])
    if binary:
        rules = {"train": {m: [f"{m}_Training"] for m in ("BA", "SN", "SP")}, "fiveFoldICV": {m: [f"{m}_CV_Training"] for m in ("BA", "SN", "SP")}, "external": {m: [f"{m}_Test"] for m in ("BA", "SN", "SP")}}
        inside = {"BA_inside_AD": ["BA_Test_inside_AD"], "BA_outside_AD": ["BA_Test_outside_AD"]}
    else:
        rules = {
            "train": {"R2": ["PearsonRSQ_Training", "R2_Training"], "RMSE": ["RMSE_Training"], "MAE": ["MAE_Training"]},
            "fiveFoldICV": {"R2": ["PearsonRSQ_CV_Training", "PearsonRSQ_CV"], "RMSE": ["RMSE_CV_Training", "RMSE_CV", "RMSE_CV_Train"], "MAE": ["MAE_CV_Training", "MAE_CV"]},
            "external": {"R2": ["PearsonRSQ_Test", "R2_Test"], "RMSE": ["RMSE_Test"], "MAE": ["MAE_Test"]},
        }
        inside = {"MAE_inside_AD": ["MAE_Test_inside_AD"], "MAE_outside_AD": ["MAE_Test_outside_AD"]}
    rules["externalAD"] = inside | {"Fraction_inside_AD": ["Coverage_Test"]}
    return F.struct(*[F.struct(*[first(*names).alias(m) for m, names in block.items()]).alias(k) for k, block in rules.items()])


#: Groups of a record table's headers. These names are fixed values: tables show them as they are.
HEADER_GROUPS: dict[str, tuple[str, ...]] = {
    "Identifiers": ("Exp Prop ID", "Canon QSAR SMILES"),
    "Literature Source Metadata": ("Page URL", "Public Source Name", "Public Source URL", "Public Source Original Name", "Public Source Original URL", "Literature Source Citation", "Literature Source DOI"),
    "Source Chemical Metadata": ("Source DTXRID", "Source DTXSID", "Source CASRN", "Source Chemical Name", "Source SMILES"),
    "Mapped DSSTox Record Metadata": ("Mapped DTXCID", "Mapped DTXSID", "Mapped CAS", "Mapped Chemical Name", "Mapped SMILES", "Mapped Molweight"),
    "Property Value Data": ("Value Original", "Value Max", "Value Min", "Value Point Estimate", "Value Units", "QSAR Property Value", "QSAR Property Units"),
    "Experimental Details": ("Measurement Method", "Media", "Percentage Organic Carbon", "Percentage Organic Matter", "pH", "Soil Type", "Temperature", "Testing Conditions", "Notes", "Pressure", "Reliability"),
    "Quality Control": ("QC Flag", "Flag Reason"),
}


def header_groups(table: DataFrame, details: Sequence[str] | None = None) -> DataFrame:
    """(place, column, header_group) for each column of a record table; details: the experimental ones of this table, to which notes always belong."""
    groups = HEADER_GROUPS if details is None else HEADER_GROUPS | {"Experimental Details": (*details, "Notes")}
    of = {c: g for g, members in groups.items() for c in members}
    return table.sparkSession.createDataFrame([(i, c, of.get(c, "Other")) for i, c in enumerate(table.columns)], "place int, column string, header_group string")


def field_descriptions(descriptions: DataFrame, table: DataFrame) -> DataFrame:
    """Descriptions (name, description) of the columns that a table has, by name."""
    return descriptions.filter(F.col("name").isin(*table.columns)).orderBy("name")


def statistics_row(stats: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """One row for each model, a column for each statistic, two decimals."""
    return stats.groupBy(key).pivot("name", list(names)).agg(F.round(F.first("value"), 2))


def available_models(models: DataFrame, *dimensions: tuple[DataFrame, str], public: str = "is_public") -> DataFrame:
    """Models that are public, with their dimensions where there are any."""
    own = models.filter(F.col(public))
    for d, key in dimensions:
        own = own.join(d, key, "left")
    return own


def titled(df: DataFrame, rules: Sequence[tuple[str, str | None]]) -> DataFrame:
    """The columns that a list of (name, title) rules has, in its order and under their titles (None: the name with spaces for underscores); a rule whose column is missing is passed over."""
    return df.select(*[F.col(f"`{c}`").alias(c.replace("_", " ") if t is None else t) for c, t in rules if c in df.columns])


def domain_columns(df: DataFrame, measures: Sequence[str], prefix: str = "AD_") -> DataFrame:
    """Without the domain columns of other measures than the model's; all other columns stay."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith(prefix) or c.removeprefix(prefix) in measures])


def target_by_unit(df: DataFrame, unit: str, columns: dict[str, str], target: str = "property") -> DataFrame:
    """The target column of a unit under one name, those of the other units dropped; an unknown unit is an error."""
    if unit not in columns:
        raise ValueError(f"no target in {unit}; there are {', '.join(columns)}")
    others = [c for c in columns.values() if c != columns[unit]]
    return df.drop(*others).withColumnRenamed(columns[unit], target)


def in_order(df: DataFrame, *names: str) -> DataFrame:
    """Sorted by those of the names that are columns, missing values last; untouched if none is. For sinks: the last step before a table is written or shown."""
    own = [F.asc_nulls_last(n) for n in names if n in df.columns]
    return df.orderBy(*own) if own else df


def prediction_report(query: Column, pred: Column, inside: Column, neighbours: Column, unit: str) -> Column:
    """One query row's report as JSON: the value, its unit, the domain's verdict and the neighbours."""
    verdict = F.when(inside, "Inside AD").when(~inside, "Outside AD").otherwise("Unknown")
    return F.to_json(F.struct(query.alias("query"), pred.alias("value"), F.lit(unit).alias("unit"), verdict.alias("domain"), neighbours.alias("neighbours")))


def results_document(run: DataFrame, statistics: DataFrame, key: str = "run_id") -> DataFrame:
    """One JSON document for each run: its own columns and its statistics by set.

    statistics: (run_id, set, name, value).
    """
    by_set = statistics.groupBy(key, "set").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("values"))
    sets = by_set.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("set", "values"))).alias("sets"))
    nested = sets.select(key, F.map_from_entries(F.transform("sets", lambda s: F.struct(s["set"], F.map_from_entries(s["values"])))).alias("statistics"))
    details = [c for c in run.columns if c != key]
    return run.join(nested, key, "left").select(key, F.to_json(F.struct(F.struct(*details).alias("details"), "statistics")).alias("document"))
