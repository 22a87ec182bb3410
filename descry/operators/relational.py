"""Joins and set operations: instance assembly, lookups, enrichment, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.functions.scalars import first_part
from descry.operators.order import keep_last


def assemble(points: DataFrame, datasets: DataFrame, values: DataFrame, splits: DataFrame | None, dataset: str, splitting: int | None = None) -> DataFrame:
    """Instances of a named dataset: points, their descriptor values, and with `splits` their part.

    points (point_id, dataset_id, structure, property), datasets (dataset_id, name), values
    (structure, features...), splits (point_id, splitting_id, split_num). Filters reach the scans;
    the planner broadcasts what its statistics prove small.
    """
    out = points.join(datasets.filter(F.col("name") == dataset).select("dataset_id"), "dataset_id").join(values, "structure")
    if splits is not None:
        own = splits.filter(F.col("splitting_id") == splitting) if splitting is not None else splits
        out = out.join(own.select("point_id", "split_num"), "point_id")
    return out


def part(df: DataFrame, split_num: int) -> DataFrame:
    """Training (0) or prediction (1) rows; an empty part is an error."""
    out = df.filter(F.col("split_num") == split_num)
    if out.isEmpty():
        raise ValueError(f"no rows in part {split_num}")
    return out


def points_of(points: DataFrame, datasets: DataFrame, dataset: str) -> DataFrame:
    """The points of a named dataset."""
    return points.join(datasets.filter(F.col("name") == dataset).select("dataset_id"), "dataset_id").select(*points.columns)


def members_of_split(points: DataFrame, datasets: DataFrame, splits: DataFrame, splittings: DataFrame, dataset: str, splitting: str, values: DataFrame | None = None) -> DataFrame:
    """Points of a named dataset with their part (split_num) in a named splitting, splittings (splitting_id, name); with `values` only structures that have descriptors.

    Inner joins whose names reach the scans; a point twice in a splitting comes twice.
    """
    own = points_of(points, datasets, dataset)
    if values is not None:
        own = only_in(own, values, "structure")
    chosen = splits.join(splittings.filter(F.col("name") == splitting).select("splitting_id"), "splitting_id")
    return own.join(chosen.select("point_id", "split_num"), "point_id")


def both_parts(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, test) of `members_of_split`; either part empty is an error. Both are checked by one count."""
    n = {r["split_num"]: r["count"] for r in members.groupBy("split_num").count().collect()}
    if missing := [name for name, k in (("training", 0), ("test", 1)) if not n.get(k)]:
        raise ValueError(f"no {' and no '.join(missing)} rows in this split")
    return members.filter("split_num = 0").drop("split_num"), members.filter("split_num = 1").drop("split_num")


def test_structures(members: DataFrame) -> DataFrame:
    """The test part's structures, each once; none is an error."""
    return part(members, 1).select("structure").distinct()


test_structures.__test__ = False  # not a test, whatever its name


def not_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def with_substance(points: DataFrame, substances: DataFrame, cid: str, snapshot: int, inner: bool = False) -> DataFrame:
    """Substance records on the first part of a piped id; the snapshot narrows the records, so points without one stay unless inner."""
    own = substances.filter(F.col("snapshot") == snapshot).drop("snapshot").withColumnRenamed("cid", "__cid")
    return points.join(own, first_part(F.col(cid)) == F.col("__cid"), "inner" if inner else "left").drop("__cid")


def with_sources(rows: DataFrame, sources: DataFrame, public: str, original: str) -> DataFrame:
    """rows with the names of their public and their original source: one table joined twice, either may be missing."""
    a = sources.select(F.col("source_id").alias(public), F.col("name").alias("public_source"))
    b = sources.select(F.col("source_id").alias(original), F.col("name").alias("original_source"))
    return rows.join(a, public, "left").join(b, original, "left")


def nested_record(rows: DataFrame, records: DataFrame, key: str, out: str = "record") -> DataFrame:
    """The id in `key` replaced by its whole record, itself included; an id without a record keeps the id alone."""
    own = records.select(F.col(key), F.struct(*[F.col(c) for c in records.columns if c != key]).alias("__r"))
    named = [F.col(f"__r.{c}").alias(c) for c in records.columns if c != key]
    return rows.join(own, key, "left").withColumn(out, F.struct(*named, F.col(key).alias("qsar_smiles"))).drop("__r", key)


def experimental_value(queries: DataFrame, training: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """queries with the experimental value that a set has for them and the set; the test set's comes first."""
    a = training.select(key, F.col("property").alias("__a"), F.lit(True).alias("__in_a"))
    b = test.select(key, F.col("property").alias("__b"), F.lit(True).alias("__in_b"))
    joined = queries.join(a, key, "left").join(b, key, "left")
    said = F.when(F.col("__in_b"), "Test").when(F.col("__in_a"), "Training")
    return joined.withColumn("exp", F.when(F.col("__in_b"), F.col("__b")).otherwise(F.col("__a"))).withColumn("exp_set", said).drop("__a", "__b", "__in_a", "__in_b")


#: Elements that a structure may hold (fixed values).
ELEMENTS = ("C", "H", "O", "N", "F", "Cl", "Br", "I", "S", "P", "Si", "As", "Hg", "Sn")


def eligible(structures: DataFrame, atoms: DataFrame, key: str = "id", elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """structures with `reason`, ok if a model can run: known elements only, two heavy atoms or more, carbon. atoms: (id, element), heavy ones."""
    c = F.col("element")
    seen = atoms.groupBy(key).agg(F.bool_and(c.isin(*elements)).alias("__known"), F.count(c).alias("__n"), F.bool_or(c == "C").alias("__carbon"))
    reason = (
        F.when(F.coalesce("__n", F.lit(0)) == 0, "Number of atoms equals zero")
        .when(~F.col("__known"), "Molecule contains unsupported element")
        .when(F.col("__n") == 1, "Only one non-hydrogen atom")
        .when(~F.col("__carbon"), "Molecule does not contain carbon")
        .otherwise("ok")
    )
    return structures.join(seen, key, "left").withColumn("reason", reason).drop("__known", "__n", "__carbon")


def standardised(structures: DataFrame, components: str, omit_salts: bool) -> DataFrame:
    """structures with `status`: failed without a component, mixture with several where salts are omitted, else ok; and the first component."""
    n = F.coalesce(F.size(components), F.lit(0))
    status = F.when(n <= 0, "failed standardization").when((n > 1) & F.lit(omit_salts), "model can't run mixtures").otherwise("ok")
    return structures.withColumn("status", status).withColumn("standard", F.when(F.col("status") == "ok", F.get(components, 0)))


def record_filter(df: DataFrame, keep: str = "keep", **clauses: object) -> DataFrame:
    """Rows with the keep flag, and each clause (column = value, or any of a list) that is given a value."""
    wanted = [F.col(keep)]
    for name, value in clauses.items():
        if value is not None:
            wanted.append(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df.filter(reduce(lambda a, b: a & b, wanted))


def missing_records(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that have no record."""
    return rows.select(key).distinct().join(records.select(key), key, "left_anti")


def inner_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join without repeated rows."""
    return a.join(b, key).dropDuplicates()


def record_join(core: DataFrame, needed: Sequence[tuple[DataFrame, str]], optional: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Records with their dimensions: a record without a needed one goes, an optional one may be missing."""
    return metadata(reduce(lambda d, x: d.join(x[0], x[1]), needed, core), *optional)


def parameters_of(records: DataFrame, parameters: DataFrame, names: DataFrame, units: DataFrame, key: str = "record_id") -> DataFrame:
    """Parameters of these records only, with their name (needed) and their unit (optional)."""
    return record_join(only_in(parameters, records, key), [(names, "name_id")], [(units, "unit_id")])


def split_predictions(predictions: DataFrame, points: DataFrame, splits: DataFrame, models: DataFrame, split_num: int) -> DataFrame:
    """Predictions of one part of a split, with their model and data point."""
    part_ids = splits.filter(F.col("split_num") == split_num)
    return predictions.join(models, "model_id").join(points, "point_id").join(part_ids.select("point_id"), "point_id", "left_semi")


def external_predictions(predictions: DataFrame, points: DataFrame, datasets: DataFrame, model_id: object, splitting_id: object, dataset: str) -> DataFrame:
    """(id, exp, pred) of a model in a splitting for the structures of a named dataset; predictions (structure, model_id, splitting_id, pred).

    A structure that the dataset holds twice comes twice, as the join of both tables has it.
    """
    own = predictions.filter((F.col("model_id") == model_id) & (F.col("splitting_id") == splitting_id)).select("structure", "pred")
    return points_of(points, datasets, dataset).join(own, "structure").select(F.col("structure").alias("id"), F.col("property").alias("exp"), "pred")


def unknown_to(rows: DataFrame, external: DataFrame, key: str, seq: str, known: str) -> DataFrame:
    """Rows with an external tool's last values, where the tool has no experimental value of its own."""
    return rows.join(keep_last(external, key, seq), key, "left").filter(F.col(known).isNull())


def lookup_ids(wanted: Sequence[str], table: DataFrame, name: str, key: str) -> dict[str, object]:
    """Name to id; a missing name is an error."""
    got = {r[name]: r[key] for r in table.filter(F.col(name).isin(*wanted)).select(name, key).collect()}
    if missing := [w for w in wanted if w not in got]:
        raise ValueError(f"not found: {', '.join(missing)}")
    return got


def join_many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that the right side must hold at most once; a duplicate is an error before the join."""
    twice = right.groupBy(key).count().filter("count > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"{key} {twice[0]!r} is not unique on the right side")
    return left.join(right, key, "left")


def stack_prediction(df: DataFrame, predictions: DataFrame, name: str) -> DataFrame:
    """Another model's prediction and its square as last features."""
    own = predictions.select("id", F.col("pred").alias(name))
    joined = join_many_to_one(df, own, "id")
    return joined.withColumn("features", F.concat("features", F.array(F.col(name), F.pow(F.col(name), 2)))).drop(name)


def attach_flag(predictions: DataFrame, flags: DataFrame, measure: str, inner: bool = False) -> DataFrame:
    """Domain flags as AD_<measure>, joined by id."""
    return predictions.join(flags.select("id", F.col("inside").alias(f"AD_{measure}")), "id", "inner" if inner else "left")


def cv_predictions(predictions: DataFrame, splits: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """Predictions whose splitting is the one their point belongs to, for splittings named prefix...; fold = id - 1."""
    own = names.filter(F.col("name").startswith(prefix)).select("splitting_id")
    joined = predictions.join(splits, ["point_id", "splitting_id"]).join(own, "splitting_id")
    return joined.withColumn("cv_fold", (F.col("splitting_id") - 1).cast("int"))


def metadata(models: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """Models with each dimension joined left, so that a missing one keeps the row."""
    return reduce(lambda d, x: d.join(x[0], x[1], "left"), dimensions, models)


def statistics_map(stats: DataFrame, dropped: Sequence[str] = ("Coverage_Training",)) -> DataFrame:
    """(model_id, stats): one map of statistics for each model."""
    kept = stats.filter(~F.col("name").isin(*dropped))
    return kept.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("stats"))


def definitions_for(coefficients: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every coefficient with its definition if there is one."""
    return definitions.join(coefficients, "name", "right")


def fallback(*choices: Column) -> Column:
    return F.coalesce(*choices)


def enrich_neighbours(neighbours: DataFrame, records: DataFrame, lookups: DataFrame) -> DataFrame:
    """Neighbours (.., neighbour_id) with a label: the record's, else the lookup's, else the id."""
    a = neighbours.join(records.select(F.col("id").alias("neighbour_id"), F.col("label").alias("__r")), "neighbour_id", "left")
    b = a.join(lookups.select(F.col("id").alias("neighbour_id"), F.col("label").alias("__l")), "neighbour_id", "left")
    return b.withColumn("label", F.coalesce("__r", "__l", F.col("neighbour_id").cast("string"))).drop("__r", "__l")


def mapped_keys(blueprint: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A split blueprint on another dataset's keys."""
    return blueprint.join(targets, "id").dropDuplicates(list(keys))


def split_blueprint(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, split_num, splitting_id): a hold-out (id, split_num) as splitting 1, and the assignments of the training part's folds from 2 on."""
    return outer.select("id", "split_num", F.lit(1).cast("int").alias("splitting_id")).unionByName(inner.select("id", "split_num", F.col("splitting_id").cast("int").alias("splitting_id")))


def cloned_blueprint(blueprint: DataFrame, targets: DataFrame, user: str, at: Column) -> DataFrame:
    """A blueprint's rows on the points of a dataset, targets (id, point_id), each (point, splitting, part) once, with who made them and when. Ids without a point go."""
    rows = mapped_keys(blueprint, targets.select("id", "point_id"), ["point_id", "splitting_id", "split_num"])
    whole = rows.select(*[F.col(c).cast("long").alias(c) for c in ("point_id", "split_num", "splitting_id")])
    return whole.withColumns({"created_at": at, "updated_at": at, "created_by": F.lit(user), "updated_by": F.lit(user)})


def leaks(external: DataFrame, training: DataFrame, key: str) -> DataFrame:
    """External rows whose structure key agrees with a training row's in its first block."""
    block = F.split_part(F.col(key), F.lit("-"), F.lit(1))
    return external.withColumn("__k", block).join(training.select(block.alias("__k")).distinct(), "__k", "left_semi").drop("__k")


def union_folds(parts: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn("cv_fold", F.lit(i)) for i, d in parts])


def union_sets(**sets: DataFrame) -> DataFrame:
    """Rows of all sets with the set's name; columns that a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("Set", F.lit(n)) for n, d in sets.items()])


def fold_conflicts(folds: DataFrame) -> DataFrame:
    """(id, folds) of ids in more than one fold."""
    return folds.groupBy("id").agg(F.array_sort(F.collect_set("fold")).alias("folds")).filter(F.size("folds") > 1)


def check_folds(base: DataFrame, folds: DataFrame) -> dict[str, int]:
    """Ids outside the base and base rows in no fold; an id in two folds is an error."""
    if (bad := fold_conflicts(folds).first()) is not None:
        raise ValueError(f"id {bad['id']!r} is in folds {bad['folds']}")
    return {"outside": folds.join(base.select("id"), "id", "left_anti").count(), "in_no_fold": base.join(folds.select("id"), "id", "left_anti").count()}


def merge_maps(*maps: Column) -> Column:
    """Maps merged, the later value for a key that several have."""

    def merged(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    return reduce(merged, maps)
