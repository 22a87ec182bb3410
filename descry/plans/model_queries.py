"""Queries of records, models, feature selection and incremental scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.operators import models, overview, records, relational, select, split, stats, stepwise
from descry.plans import stand_ins as own
from descry.plans.queries import query, rounded
from descry.plans.stand_ins import PREDICTIONS_SQL, table
from descry.sources.tables import shared_dir
from descry.streaming import scoring

#: An order of an order's lines that leaves no ties between different ones.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
NUMBERED = f"""select *, row_number() over (partition by l_orderkey, l_returnflag order by {", ".join(LINE_ORDER)}) as nth,
 count(*) over (partition by l_orderkey, l_returnflag) as n from lineitem"""


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an order's parameters: named by their flag, with a quantity and a price."""
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct(*LINE_ORDER))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), "seq")


#: An order has seven lines at most, so a flag comes seven times at most.
_SUFFIXED = [f"{p}{n}" for p in "anr" for n in ("", *(f"_{i}" for i in range(1, 8)))]


@query(f"""with c as (select l_orderkey as id, lower(l_returnflag) || case when n > 1 then '_' || nth else '' end as p, l_quantity as x from ({NUMBERED}))
 select id, {", ".join(f"max(case when p = '{p}' then x end) as {p}" for p in _SUFFIXED)} from c group by id""")
def parameters_suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.parameter_pivot(_parameters(spark, sf_dir), "id", "name", ["quantity"], "seq")
    return out.select("id", *[F.col(p) if p in out.columns else F.lit(None).cast("double").alias(p) for p in _SUFFIXED])


@query(f"""select l_orderkey as id, {", ".join(f"max(case when l_returnflag = '{p}' then {x} end) as exp_{p.lower()}_{n}" for p in "ANR" for n, x in (("quantity", "l_quantity"), ("price", "l_extendedprice")))}
 from ({NUMBERED}) where nth = 1 group by l_orderkey""")
def parameters_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parameter_pivot(_parameters(spark, sf_dir), "id", "name", ["quantity", "price"], "seq", "first", prefix="exp_")


@query(f"""select l_orderkey as id, {", ".join(f"string_agg(cast(l_quantity as int)::varchar, ',' order by nth) filter (l_returnflag = '{p}') as {p.lower()}" for p in "ANR")} from ({NUMBERED}) group by 1""")
def parameters_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.parameter_pivot(_parameters(spark, sf_dir), "id", "name", ["quantity"], "seq", "list")
    names = [c for c in out.columns if c != "id"]
    return out.select("id", *[F.array_join(F.transform(n, lambda x: x.cast("int").cast("string")), ",").alias(n) for n in names])


@query(f"""with p as ({PREDICTIONS_SQL}), g as (select id, sum(exp) as exp, sum(pred) as pred, bool_and(flag_a) as near, bool_and(flag_b) as far from p group by id)
 select g.id, round(exp, 2) as exp, round(pred, 2) as pred, round(abs(exp - pred), 2) as abs_error, o_custkey as substance, near as "AD_near", case when far then far end as "AD_far" from g left join orders on o_orderkey = g.id""")
def test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test rows, two measures' flags; the second has none for rows outside."""
    p = own.predictions(spark, sf_dir).groupBy("id").agg(F.sum("exp").alias("exp"), F.sum("pred").alias("pred"), F.bool_and("flag_a").alias("near"), F.bool_and("flag_b").alias("far"))
    subs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("substance"))
    flags = {m: p.filter(f"'{m}' = 'near' or far").select("id", F.col(m).alias("inside")) for m in ("near", "far")}
    return rounded(records.test_table(p.select("id", "exp", "pred"), subs, flags), 2, "exp", "pred", "abs_error")


test_report.__test__ = False  # not a test, whatever its name


@query(f"""with p as ({PREDICTIONS_SQL}) select p.id, line, p.exp, round(pred, 4) as pred, round(abs(p.exp - pred), 4) as abs_error, o_custkey as substance
 from p left join orders on o_orderkey = p.id where p.id not in (select o_orderkey from orders where o_orderstatus = 'F') and p.exp is not null and pred is not null""")
def external_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("substance"), "o_orderstatus")
    out = records.external_table(own.predictions(spark, sf_dir), orders.filter("o_orderstatus = 'F'"), orders.drop("o_orderstatus"))
    return rounded(out.select("id", "line", "exp", "pred", "abs_error", "substance"), 4, "pred", "abs_error")


_STATS = {"Coverage": "count(pred) filter (exp is not null) / count(exp)", "MAE": "avg(abs(exp - pred))", "PearsonRSQ": "regr_r2(pred, exp)", "Q2": "1 - sum((exp - pred) ** 2) / sum(case when pred is not null then (exp - 40000) ** 2 end)", "RMSE": "sqrt(avg((exp - pred) ** 2))", "n": "count(exp)", "n_predicted": "count(pred) filter (exp is not null)"}
_BLOCK = " || ',' || ".join(f"""'"{n}":' || round(({x})::double, 3)""" for n, x in _STATS.items())


@query(f"""with p as (select *, case when id % 5 = 0 then 'test' else 'training' end as set from ({PREDICTIONS_SQL})), s as (select grp, set, '"' || set || '":{{' || {_BLOCK} || '}}' as block from p group by grp, set)
 select grp as run_id, '{{"details":{{"n_rows":' || n || '}},"statistics":{{' || string_agg(block, ',' order by set) || '}}}}' as document from s join (select grp, count(*) as n from p group by grp) using (grp) group by grp, n""")
def results_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir).withColumn("set", F.when(F.col("id") % 5 == 0, "test").otherwise("training"))
    wide = stats.continuous(p, "grp", "set", mean=40000.0)
    names = ["n", "n_predicted", "Coverage", "MAE", "RMSE", "PearsonRSQ", "Q2"]
    long = wide.unpivot([F.col("grp").alias("run_id"), "set"], [F.round(F.col(n).cast("double"), 3).alias(n) for n in names], "name", "value")
    runs = p.groupBy(F.col("grp").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return records.results_document(runs, long)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as instances: price by quantity and discount, folds by order."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity is not null and l_discount is not null")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("property"), F.array("l_quantity", "l_discount").alias("features"), F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"))


@query("""with r as (select l_extendedprice as y, l_quantity as a, l_discount as b from lineitem where l_quantity is not null and l_discount is not null and l_extendedprice is not null),
 m as (select avg(y) as my, avg(a) as ma, avg(b) as mb, count(*) as n from r),
 s as (select any_value(n) as n, any_value(my) as my, any_value(ma) as ma, any_value(mb) as mb, sum((a - ma) ** 2) as aa, sum((b - mb) ** 2) as bb, sum((a - ma) * (b - mb)) as ab,
  sum((a - ma) * (y - my)) as ay, sum((b - mb) * (y - my)) as y_b, sum((y - my) ** 2) as yy from r, m),
 c as (select *, aa * bb - ab * ab as d, (bb * ay - ab * y_b) / (aa * bb - ab * ab) as ca, (aa * y_b - ab * ay) / (aa * bb - ab * ab) as cb from s),
 e as (select *, (yy - ca * ay - cb * y_b) / (n - 3) as v from c)
 select 'intercept' as name, round(my - ca * ma - cb * mb, 3) as estimate, round(sqrt(v * (1 / n + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / d)), 3) as std_error from e
 union all select 'quantity', round(ca, 3), round(sqrt(v * bb / d), 3) from e union all select 'discount', round(cb, 3), round(sqrt(v * aa / d), 3) from e""")
def linear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.least_squares(_prices(spark, sf_dir), ["quantity", "discount"])
    return rounded(out.select("name", "estimate", "std_error"), 3, "estimate", "std_error")


@query("""with r as (select l_extendedprice as y, l_quantity as a, cast(l_orderkey % 5 as int) as fold from lineitem where l_quantity is not null and l_discount is not null and l_extendedprice is not null),
 f as (select k, regr_slope(y, a) as s, regr_intercept(y, a) as i from r, range(5) t(k) where fold <> k group by k)
 select fold as cv_fold, count(*) as n, round(avg(abs(y - s * a - i)), 3) as "MAE", round(sqrt(avg((y - s * a - i) ** 2)), 3) as "RMSE" from r join f on fold = k group by fold""")
def fold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prices(spark, sf_dir).withColumn("features", F.slice("features", 1, 1))
    out = stats.continuous(models.fold_least_squares(rows), "cv_fold").select("cv_fold", "n", "MAE", "RMSE")
    return rounded(out, 3, "MAE", "RMSE")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.k_folds(own.instances(spark, sf_dir), 5)


@query("""with e as (select vec_id as id, label::double as y, embedding::double[] as x, (row_number() over (order by md5('42|' || vec_id), vec_id) - 1) % 5 as fold from embeddings where embedding is not null),
 l as (select fold, y, i - 1 as idx, x[i] as v from e, unnest(range(1, len(x) + 1)) t(i) where y is not null),
 f as (select idx, k, regr_slope(y, v) as s, regr_intercept(y, v) as c from l, range(5) t(k) where fold <> k group by idx, k),
 r as (select l.idx, k, 1 - sum((y - s * v - c) ** 2) / (var_pop(y) * count(*)) as r2 from l join f on l.idx = f.idx and fold = k group by l.idx, k)
 select cast(idx as int) as idx, round(avg(r2), 6) as mean, round(stddev_pop(r2), 6) as std, round(avg(r2) - stddev_pop(r2) - 0.002, 6) as fitness from r group by idx""")
def single_feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _folded(spark, sf_dir)
    width = rows.select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)).alias("idx")).distinct()
    out = select.score_subsets(width.select(F.array("idx").alias("features")), select.grams_of(rows), 0.002)
    return rounded(out.select(F.get("features", F.lit(0)).alias("idx"), "mean", "std", "fitness"), 6, "mean", "std", "fitness")


@query()
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select.forward(_folded(spark, sf_dir), 8)
    return spark.createDataFrame(list(enumerate(chosen)), "step int, idx int")


@query()
def uncorrelated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.uncorrelated(own.instances(spark, sf_dir), 1.5)
    return spark.createDataFrame([(i,) for i in kept], "idx int")


@query("""select l_orderkey as record_id, l_linenumber as line, s_name as name, n_name as unit, l_quantity as value from lineitem
 join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = l_partkey % 30 where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')""")
def record_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    records_of = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id"))
    values = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("name_id"), (F.col("l_partkey") % 30).cast("int").alias("unit_id"), F.col("l_quantity").alias("value"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name"))
    unit = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit"))
    return relational.parameters_of(records_of, values, names, unit).select("record_id", "line", "name", "unit", "value")


@query(f"""with p as ({PREDICTIONS_SQL}) select p.id as point_id, line, n_name as model, o_totalprice as property, round(pred, 4) as pred from p join orders on o_orderkey = p.id join nation on n_nationkey = line where p.id % 5 = 0""")
def predictions_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir).select(F.col("id").alias("point_id"), "line", F.col("line").alias("model_id"), "pred")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("property"))
    splits = points.select("point_id", F.when(F.col("point_id") % 5 == 0, 1).otherwise(0).alias("split_num"))
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("model"))
    out = relational.split_predictions(p, points, splits, named, 1)
    return rounded(out.select("point_id", "line", "model", "property", "pred"), 4, "pred")


@query("""with x as (select user_id, arg_max(value, event_id) as pred, max(event_id) as event_id, arg_max(event_type, event_id) as kind from events group by user_id)
 select c_custkey as id, c_acctbal as exp, pred from customer left join x on user_id = c_custkey where kind is null or kind <> 'purchase'""")
def unknown_to_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("exp"))
    tool = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("value").alias("pred"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("known"))
    return relational.unknown_to(rows, tool, "id", "event_id", "known").select("id", "exp", "pred")


@query("select distinct o_custkey as id, o_orderstatus as status, c_mktsegment as segment from orders join customer on c_custkey = o_custkey")
def inner_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return relational.inner_distinct(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "id")


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = own.train_test(spark, sf_dir)
    return models.predict(models.fit(train, "rf", numTrees=30), test)


@query()
def boosted_class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (d.withColumn("property", (F.col("property") >= 5).cast("double")) for d in own.train_test(spark, sf_dir))
    return models.predict(models.fit(train, "gbt", binary=True, maxIter=10), test, binary=True)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stream reads folders or patterns; this pattern is the table alone, be it a file or a folder.
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("select event_id as id, user_id, round(value * 2 + 1, 6) as score from events")
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, schema = shared_dir(spark), "id long, user_id long, score double"
    stream = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "value")
    scoring.score_new(stream, lambda d: d.select("id", "user_id", F.round(F.col("value") * 2 + 1, 6).alias("score")), "id", f"{at}/scores", schema, f"{at}/place").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/scores")


@query("select user_id as id, event_type as model, count(*) as n, length(event_type) * 1000 + user_id as result from events group by all")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, keys = shared_dir(spark), ["id", "model"]
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_type").alias("model"))
    work = lambda d: d.select("id", "model", (F.length("model") * 1000 + F.col("id")).alias("result"))
    scoring.answer_requests(stream, work, keys, f"{at}/cache", "id long, model string, result long", f"{at}/answers", f"{at}/place").awaitTermination()
    return spark.read.parquet(f"{at}/answers").groupBy("id", "model", "result").agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test instances on the two principal components of the training set."""
    got = overview.projection(*own.train_test(spark, sf_dir))
    return got.select("id", "is_test", *[F.round(F.col("components")[i], 6).alias(f"component_{i + 1}") for i in range(2)])


@query()
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in groups of like ones."""
    return overview.row_groups(own.instances(spark, sf_dir))


#: Two features by fold: means, variances and the least squares of each of the three models on the other folds, then their errors on the fold.
_TWO = """r as (select l_extendedprice as y, l_quantity as a, l_discount as b, cast(l_orderkey % 5 as int) as fold from lineitem where l_quantity is not null and l_discount is not null and l_extendedprice is not null),
 s as (select k, avg(a) as ma, avg(b) as mb, avg(y) as my, covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from r, range(5) t(k) where fold <> k group by k),
 m as (select k, ma, mb, my, '0' as name, 1 as size, ay / aa as wa, 0.0 as wb from s union all select k, ma, mb, my, '1', 1, 0.0, by_ / bb from s
  union all select k, ma, mb, my, '0,1', 2, (ay * bb - by_ * ab) / (aa * bb - ab * ab), (by_ * aa - ay * ab) / (aa * bb - ab * ab) from s),
 e as (select name, size, k, avg((y - my - wa * (a - ma) - wb * (b - mb)) ** 2) as mse from r join m on fold = k group by all),
 g as (select name, size, avg(mse) as mse, avg(sqrt(mse)) as error, stddev_pop(sqrt(mse)) as deviation from e group by all), base as (select sqrt(mse) as base from g where size = 2)"""


@query(f"""with {_TWO}, t as (select size, arg_min(name, mse) as features, arg_min(error, mse) as error, arg_min(deviation, mse) as deviation from g group by size),
 o as (select size, features, error / base as error, deviation / base as deviation, error / base + deviation / base + 0.002 * size as objective from t, base)
 select size, features, round(error, 6) as error, round(deviation, 6) as deviation, round(objective, 6) as objective, objective = min(objective) over () as chosen from o""")
def stepwise_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and discount: the greedy subset of each size, its errors as shares of all features', and the size of least objective."""
    chosen, tried = stepwise.stepwise(_prices(spark, sf_dir), 1, 2)
    rows = [(s.size, ",".join(map(str, sorted(s.features))), s.error, s.deviation, s.objective, s.features == chosen) for s in tried]
    return rounded(spark.createDataFrame(rows, "size int, features string, error double, deviation double, objective double, chosen boolean"), 6, "error", "deviation", "objective")


@query(f"""with {_TWO}, d as (select stddev_pop(a) as sa, stddev_pop(b) as sb, covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from r),
 h as (select k, case when abs(wa) * sa >= abs(wb) * sb then '0' else '1' end as name from m, d where name = '0,1'), one as (select avg(mse) as mse from e join h using (k, name)),
 f as (select case when abs(ay * bb - by_ * ab) * sa >= abs(by_ * aa - ay * ab) * sb then 0 else 1 end as idx from d)
 select t.idx::int as idx from range(2) t(idx), f, one, g where g.size = 2 and (one.mse > g.mse or t.idx = f.idx)""")
def features_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and discount: what recursive elimination keeps."""
    return spark.createDataFrame([(j,) for j in stepwise.eliminated(_prices(spark, sf_dir))], "idx int")


_EXCHANGED = """with p as (select p_partkey as id, p_retailprice as y, p_size::double as a, (p_partkey % 1000)::double as b from part),
 s as (select avg(a) as ma, avg(b) as mb, avg(y) as my, covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from p),
 w as (select ma, mb, my, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb from s),
 o as (select *, row_number() over (order by md5('42|' || id), id) as n from p),
 q as (select r, a as a2, b as b2, row_number() over (partition by r order by md5((43 + r) || '|' || id), id) as n from p, range(3) t(r)),
 d as (select r, y - my - wa * (a - ma) - wb * (b - mb) as e, wa * (a2 - a) as da, wb * (b2 - b) as db from o join q using (n), w),
 x as (select r, avg((e - da) ** 2) - avg(e ** 2) as ia, avg((e - db) ** 2) - avg(e ** 2) as ib from d group by r)
 select 0 as idx, round(avg(ia), 4) + 0.0 as importance from x union all select 1, round(avg(ib), 4) + 0.0 from x"""


@query(_EXCHANGED)
def exchanged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of size and of the key's rest for the price, by three exchanges of each column."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("property"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double")).alias("features"))
    out = rounded(select.permutation_importance(rows, models.fit(rows, "reg"), 3), 4, "importance")
    return out.withColumn("importance", F.col("importance") + 0.0)  # no negative zero


@query()
def features_by_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evolution in two stages over the embeddings' features: the votes of the first stage, and what the second chose."""
    chosen, votes = select.evolve_in_stages(_folded(spark, sf_dir), runs=4, generations=5, population=24, most=8)
    return spark.createDataFrame([(j, n, j in chosen) for j, n in votes.items()], "idx int, votes int, chosen boolean")


@query()
def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances in groups by average linkage over each row's nearest."""
    return overview.linked_groups(own.instances(spark, sf_dir), 1.0)
