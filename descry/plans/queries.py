"""Queries by name: each takes (spark, sf_dir); SQL beside it gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.functions import scalars as S
from descry.functions import units
from descry.operators import columns, domain, knn, linalg, order, relational, set_similarity, split, stats
from descry.plans import stand_ins as own
from descry.plans.stand_ins import CLASS_SQL, PREDICTIONS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


SCALED = """
 e as (select vec_id as id, label::double as property, embedding::double[] as x from embeddings where embedding is not null),
 l as (select id, i, x[i] as v from e, unnest(range(1, len(x) + 1)) t(i)),
 s as (select i, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as d from l where id % 5 <> 0 group by i),
 z as (select id, list((v - m) / d order by i) as x from l join s using (i) group by id)"""
NEAR = """
 d as (select q.id, t.id as nid, {distance} as dist from z q join z t on q.id <> t.id and t.id % 5 <> 0),
 r as (select *, row_number() over (partition by id order by round(dist, 9), nid) as rank from d qualify rank <= {k})"""


def _knn_sql(distance: str) -> str:
    return f"""with {SCALED.strip()}, {NEAR.format(distance=distance, k=3).strip()},
 v as (select id, avg(dist) as value from r group by id),
 c as (select value as cutoff from (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from v where id % 5 <> 0) where k = floor(n * 0.95)::bigint)
 select id, case when id % 5 = 0 then 'test' else 'train' end as set, round(value, 4) as value, value <= cutoff as inside from v, c"""


@query(_knn_sql("list_distance(q.x, t.x)"))
def ad_knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, _ = domain.knn_distance(*own.train_test(spark, sf_dir))
    return rounded(flags.select("id", "set", "value", "inside"), 4, "value")


@query(_knn_sql("list_cosine_distance(q.x, t.x)"))
def ad_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, _ = domain.knn_distance(*own.train_test(spark, sf_dir), metric="cosine")
    return rounded(flags.select("id", "set", "value", "inside"), 4, "value")


@query(f"""with {SCALED.strip()}, {NEAR.format(distance="list_distance(q.x, t.x)", k=5).strip()},
 f as (select id, dist, case when dist <= 0.1 then 5e-4 else 5e-2 end as f from r),
 v as (select id, 1 / (1 + sum((f + dist) * dist) / sum(1 / (f + dist))) as value from f group by id),
 c as (select value as cutoff from (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from v where id % 5 <> 0) where k = floor(n * 0.050000000000000044)::bigint)
 select id, case when id % 5 = 0 then 'test' else 'train' end as set, round(value, 6) as value, value > cutoff as inside from v, c""")
def ad_local_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.local_similarity(*own.train_test(spark, sf_dir))[0].select("id", "set", "value", "inside"), 6, "value")


def _density_sql(kernels: str = "z", pairs: str = "true") -> str:
    """Values are compared to nine digits: what equals the cutoff but for rounding is outside."""
    return f"""with {SCALED.strip()},
 p as (select q.id, -(list_distance(q.x, t.x) * list_distance(q.x, t.x)) / 2 as e from z q, {kernels} t where t.id % 5 <> 0 and {pairs}),
 m as (select id, max(e) as m from p group by id),
 v as (select id, any_value(m) + ln(sum(exp(e - m))) as value from p join m using (id) group by id),
 c as (select value as cutoff from (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from v where id % 5 <> 0) where k = floor(n * 0.050000000000000044)::bigint)
 select id, case when id % 5 = 0 then 'test' else 'train' end as set, round(value, 4) as value, round(value, 9) > round(cutoff, 9) as inside from v, c"""


@query(_density_sql())
def ad_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.density(*own.train_test(spark, sf_dir))[0].select("id", "set", "value", "inside"), 4, "value")


@query(_density_sql(pairs="q.id <> t.id"))
def ad_density_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row's own kernel is no part of its value."""
    return rounded(domain.density(*own.train_test(spark, sf_dir), leave_out=True)[0].select("id", "set", "value", "inside"), 4, "value")


@query(_density_sql())
def ad_density_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels met through the index instead of sent."""
    return rounded(domain.density(*own.train_test(spark, sf_dir), sent_bytes=0)[0].select("id", "set", "value", "inside"), 4, "value")


@query(f"""with {SCALED.strip()}, {NEAR.format(distance="list_distance(q.x, t.x)", k=3).strip()} select id, nid as neighbour_id, cast(rank as int) as rank, round(dist, 4) as distance from r""")
def neighbours_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows' nearest training rows, met through the index instead of sent."""
    train, test = own.train_test(spark, sf_dir)
    st = columns.feature_stats(train)
    return rounded(knn.neighbours(columns.scale(train, st), columns.scale(train.unionByName(test), st), 3, sent_bytes=0), 4, "distance").select("id", "neighbour_id", "rank", "distance")


@query("""with r as (select vec_id % 3 as fold, list_transform(embedding::double[], lambda c, i: case when vec_id % 7 <> 0 or i <> vec_id % 64 + 1 then c end) as x from embeddings where embedding is not null and vec_id % 11 <> 0),
 w as (select fold, x from r where not list_bool_or(list_transform(x, lambda c: c is null))),
 l as (select fold, i, x[i] as a, x[1] as b from w, unnest(range(1, len(x) + 1)) t(i))
 select cast(fold as int) as fold, cast(i - 1 as int) as idx, count(*) as n, round(sum(a), 6) as total, round(sum(a * b), 6) as with_first from l group by fold, i""")
def sums_of_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products by fold where a seventh of the rows lacks a feature, another each, and an eleventh all."""
    i = F.col("id")
    gaps = F.when(i % 11 != 0, F.transform("features", lambda x, k: F.when((i % 7 != 0) | (k != i % 64), x)))
    got = linalg.fold_grams(own.instances(spark, sf_dir).select("id", (i % 3).alias("fold"), gaps.alias("features")), "fold")
    rows = [(k, j, n, float(s[j]), float(g[j, 0])) for k, (n, s, g) in got.items() for j in range(len(s))]
    return rounded(spark.createDataFrame(rows, "fold int, idx int, n long, total double, with_first double"), 6, "total", "with_first")


def inverted(width: int) -> str:
    """Elimination on rows u (i, row) of a matrix of `width` with more columns beside it: table w (i, row), those columns solved for."""
    return f""" g(k, i, row) as (select 0, i::int, row from u union all
  select k + 1, i, case when i = k + 1 then list_transform(row, lambda v: v / d) else list_transform(list_zip(row, p), lambda z: z[1] - f * z[2]) end
  from (select *, row[k + 1] / d as f from (select *, p[k + 1] as d from (select *, max(case when i = k + 1 then row end) over () as p from g where k < {width})))),
 w as (select i, row[{width + 1}:] as row from g where k = {width})"""


_LEVERAGE = f""",
 zl as (select id, i, x[i] as v from z, unnest(range(1, 65)) t(i) where id % 5 <> 0),
 s2 as (select a.i, b.i as j, sum(a.v * b.v) as g from zl a join zl b using (id) group by all),
 u as (select i, list_concat(list(g order by j), list((case when i = j then 1 else 0 end)::double order by j)) as row from s2 group by i),
{inverted(64)},
 h as (select id, sum(z.x[w.i] * list_dot_product(w.row, z.x)) as value from z, w group by id),
 hc as (select value as cutoff from (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from h where id % 5 <> 0) where k = floor(n * 0.95)::bigint)"""


@query(f"""with recursive {SCALED.strip()}{_LEVERAGE}
 select id, case when id % 5 = 0 then 'test' else 'train' end as set, round(value, 6) as value, value <= cutoff as inside from h, hc""")
def ad_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.leverage(*own.train_test(spark, sf_dir))[0].select("id", "set", "value", "inside"), 6, "value")


@query(f"""with recursive {SCALED.strip()}{_LEVERAGE}, {NEAR.format(distance="list_distance(q.x, t.x)", k=5).strip()},
 f as (select id, dist, case when dist <= 0.1 then 5e-4 else 5e-2 end as f from r),
 v as (select id, 1 / (1 + sum((f + dist) * dist) / sum(1 / (f + dist))) as value from f group by id),
 c as (select value as cutoff from (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from v where id % 5 <> 0) where k = floor(n * 0.050000000000000044)::bigint),
 b as (select v.id, v.value > c.cutoff as local, h.value <= hc.cutoff as lev from v join h using (id), c, hc)
 select id, case when id % 5 = 0 then 'test' else 'train' end as set, local, lev, case when local and lev then 'STRONG' when local or lev then 'MODERATE' else 'WEAK' end as strength from b""")
def ad_local_and_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.local_and_leverage(*own.train_test(spark, sf_dir))


@query("""with c as (select user_id as id, event_type as fragment, count(*)::double as x from events group by all),
 t as (select fragment, min(x) as lo, max(x) as hi, count(*) as n from c where id % 5 <> 0 group by 1)
 select id, string_agg(fragment || ':' || cast(x as int), ',' order by fragment) as fragments, bool_and(x between lo and hi) as inside
 from c join t using (fragment) where id % 5 = 0 group by id""")
def ad_fragment_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = own.fragments(spark, sf_dir)
    out = domain.fragment_range(f.filter("id % 5 <> 0"), f.filter("id % 5 = 0"), own.fragment_names(spark))
    text = F.array_join(F.transform("fragment_table", lambda r: F.concat(r["fragment"], F.lit(":"), r["test_value"].cast("int").cast("string"))), ",")
    return out.select("id", text.alias("fragments"), "inside")


@query(f"""with {SCALED.strip()}, {NEAR.format(distance="list_distance(q.x, t.x)", k=10).strip()}
 select r.id, nid as neighbour_id, cast(rank as int) as rank, round(dist, 4) as distance, e.property as exp from r join e on e.id = nid where r.id % 5 = 0""")
def neighbours_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = own.train_test(spark, sf_dir)
    st = columns.feature_stats(train)
    near = knn.neighbours(columns.scale(train, st), columns.scale(test, st), 10)
    return rounded(relational.join_many_to_one(near, train.select(F.col("id").alias("neighbour_id"), F.col("property").alias("exp")), "neighbour_id"), 4, "distance").select("id", "neighbour_id", "rank", "distance", "exp")


@query(f"""with {SCALED.strip()}, {NEAR.format(distance="list_distance(q.x, t.x)", k=5).strip()}
 select r.id, round(sum(e.property / dist) / sum(1 / dist), 6) as pred from r join e on e.id = nid where r.id % 5 = 0 group by r.id""")
def knn_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = own.train_test(spark, sf_dir)
    st = columns.feature_stats(train)
    return rounded(knn.knn_predict(columns.scale(train, st), columns.scale(test, st)), 6, "pred")


@query(f"""with p as ({PREDICTIONS_SQL}) select grp, count(exp) as n, count(pred) filter (exp is not null) as n_predicted,
 round(count(pred) filter (exp is not null) / count(exp), 6) as "Coverage", round(avg(abs(exp - pred)), 4) as "MAE", round(sqrt(avg((exp - pred) ** 2)), 4) as "RMSE",
 round(regr_r2(pred, exp), 6) as "PearsonRSQ",
 round(1 - sum((exp - pred) ** 2) / sum(case when pred is not null then (exp - 40000) ** 2 end), 6) as "Q2" from p group by grp""")
def stats_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.continuous(own.predictions(spark, sf_dir), "grp", mean=40000.0)
    return rounded(rounded(out, 4, "MAE", "RMSE"), 6, "Coverage", "PearsonRSQ", "Q2")


@query(f"""with p as ({CLASS_SQL}), c as (select source, count(exp) as n, count(*) filter (exp is not null and pred is not null) as n_predicted,
 count(*) filter (exp >= .5 and pred >= .5) as tp, count(*) filter (exp >= .5 and pred < .5) as fn, count(*) filter (exp < .5 and pred >= .5) as fp, count(*) filter (exp < .5 and pred < .5) as tn from p group by source)
 select source, n, n_predicted, tp as "TP", fn as "FN", fp as "FP", tn as "TN", round(n_predicted / nullif(n, 0), 6) as "Coverage", round((tp + tn) / nullif(n_predicted, 0), 6) as "Concordance",
 round(tp / nullif(tp + fn, 0), 6) as "SN", round(tn / nullif(tn + fp, 0), 6) as "SP", round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) as "BA" from c""")
def stats_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.binary(own.class_predictions(spark, sf_dir), "source"), 6, "Coverage", "Concordance", "SN", "SP", "BA")


@query(f"""with p as ({PREDICTIONS_SQL}), g as (select *, flag_a and coalesce(flag_b, false) as inside, (exp - pred) ** 2 as err from p),
 s as (select grp, count(*) filter (inside) as n_inside, count(*) filter (not inside) as n_outside, avg(inside::int) as cov,
 regr_r2(pred, exp) filter (inside) as r2i, regr_r2(pred, exp) filter (not inside) as r2o, sqrt(avg(err) filter (inside)) as ri, sqrt(avg(err) filter (not inside)) as ro,
 stddev_pop(err) filter (inside) as si, stddev_pop(err) filter (not inside) as so from g group by grp)
 select grp, n_inside, n_outside, round(cov, 6) as "Coverage", round(r2i, 6) as r2_inside, round(r2o, 6) as r2_outside, round(ri, 4) as "RMSE_inside", round(ro, 4) as "RMSE_outside",
 round(r2i / r2o, 6) as r2_ratio, round(so / si, 6) as spread_ratio, round(cov * r2i, 6) as coverage_r2 from s""")
def stats_consensus_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.inside_outside(stats.consensus(own.predictions(spark, sf_dir), ["flag_a", "flag_b"]), "inside", "grp")
    return rounded(rounded(out, 4, "RMSE_inside", "RMSE_outside"), 6, "Coverage", "r2_inside", "r2_outside", "r2_ratio", "spread_ratio", "coverage_r2")


@query(f"""with p as ({PREDICTIONS_SQL}) select grp, count(*) filter (flag_b) as n_inside, count(*) filter (not flag_b) as n_outside, round(avg(flag_b::int), 6) as "Coverage",
 round(regr_r2(pred, exp) filter (flag_b), 6) as r2_inside, round(regr_r2(pred, exp) filter (not flag_b), 6) as r2_outside from p group by grp""")
def stats_single_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.inside_outside(own.predictions(spark, sf_dir), "flag_b", "grp").select("grp", "n_inside", "n_outside", "Coverage", "r2_inside", "r2_outside")
    return rounded(out, 6, "Coverage", "r2_inside", "r2_outside")


@query(f"with p as ({PREDICTIONS_SQL}) select grp, round(regr_slope(pred, exp), 8) as slope, round(regr_intercept(pred, exp), 3) as intercept, round(regr_r2(pred, exp), 6) as r2, round(least(min(exp), min(pred)), 2) as low, round(greatest(max(exp), max(pred)), 2) as high from p group by grp")
def fit_and_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir)
    fit = rounded(rounded(rounded(stats.fit_line(p, "grp"), 8, "slope"), 3, "intercept"), 6, "r2")
    return fit.join(rounded(stats.axis_bounds(p, "grp"), 2, "low", "high"), "grp")


@query(f"""with p as ({PREDICTIONS_SQL}), e as (select min(exp) as lo, max(exp) as hi from p)
 select grp, cast(least(19, floor((exp - lo) / ((hi - lo) / 20))) as int) as bin, count(*) as n from p, e where exp is not null group by all""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(own.predictions(spark, sf_dir), "exp", 20, "grp")


@query("""with f as (select doc_id as id, quality, (row_number() over (partition by quality order by md5('42|' || doc_id), doc_id) - 1) % 5 as fold from labels)
 select id, quality, cast(fold as int) as fold from f""")
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return split.stratified_folds(rows, 5, ["quality"]).select("id", "quality", "fold")


@query("select o_orderkey as id, cast((row_number() over (order by md5('42|' || o_orderkey), o_orderkey) - 1) % 5 as int) as fold from orders")
def folds_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.k_folds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 5).select("id", "fold")


@query("""with m as (select o_orderkey as id, o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49) as is_member from orders)
 select id, is_member, cast((row_number() over (partition by is_member order by md5('42|' || id), id) - 1) % 5 as int) as fold from m""")
def folds_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    members = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return split.set_aside_folds(rows, members, 5).select("id", "is_member", "fold")


@query("""with f as (select doc_id as id, quality as property, (row_number() over (partition by quality order by md5('42|' || doc_id), doc_id) - 1) % 5 as fold from labels)
 select cast(k + 2 as int) as splitting_id, cast(fold = k as int) as split_num, property, count(*) as n, round(count(*) / sum(count(*)) over (partition by k, fold = k), 6) as share
 from f, range(5) r(k) group by k, fold = k, property""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("property"))
    folded = split.stratified_folds(rows, 5, ["property"])
    parts = split.assignments(folded).join(rows, "id").withColumn("part", F.struct("splitting_id", "split_num"))
    return rounded(stats.class_balance(parts, "part", "property"), 6, "share").select("part.*", "property", "n", "share")


@query("""with l as (select i - 1 as idx, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) t(i) where embedding is not null)
 select cast(idx as int) as idx, count(*) as n, count(x) as n_valid, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std_pop, round(stddev_samp(x), 6) as std_samp, round(min(x), 6) as least, round(max(x), 6) as most,
 count(*) filter (x <> 0) as n_nonzero, count(*) filter (x > 0) as n_positive, round(coalesce(min(x) filter (x > 0), 0), 6) as least_positive from l group by idx""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(columns.feature_stats(own.instances(spark, sf_dir)), 6, "mean", "std_pop", "std_samp", "least", "most", "least_positive")


@query("""with l as (select vec_id as id, i, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) t(i) where embedding is not null),
 s as (select i, avg(x) as m, stddev_pop(x) as d from l where id % 5 <> 0 group by i)
 select id, cast(i - 1 as int) as idx, round((x - m) / case when d = 0 then 1 else d end, 6) as x from l join s using (i) where id % 5 = 0""")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = own.train_test(spark, sf_dir)
    return rounded(columns.long_form(columns.scale(test, columns.feature_stats(train))), 6, "x")


@query("""with f as (select user_id as id, event_type as k, count(*) as n from events group by all), few as (select k from f group by k having count(*) < 148)
 select user_id as id, count(*) as n_events from events where user_id not in (select id from f where k in (select k from few)) group by 1""")
def sparse_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = columns.sparse(own.fragments(spark, sf_dir), 148)
    return kept.select("id", F.aggregate("features", F.lit(0.0), lambda a, b: a + b).cast("long").alias("n_events"))


@query("""with q as (select quantile_cont(l_extendedprice, [0, .2, .4, .6, .8, 1]) as e from lineitem)
 select cast((l_extendedprice >= e[2])::int + (l_extendedprice >= e[3])::int + (l_extendedprice >= e[4])::int + (l_extendedprice >= e[5])::int as int) as bin, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem, q group by 1""")
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    edges = order.quantile_edges(rows, "l_extendedprice", 5)
    return rows.groupBy(order.bin_of(F.col("l_extendedprice"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("""select o.o_orderkey as point_id, c.c_name as dataset, l.l_linenumber as line, l.l_quantity as x, o.o_totalprice as property, cast(o.o_orderkey % 5 = 0 as int) as split_num
 from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey where c.c_mktsegment = 'MACHINERY'""")
def assemble_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("dataset"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("structure"), F.col("o_totalprice").alias("property"))
    values = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("x"))
    splits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), F.lit(1).alias("splitting_id"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("split_num"))
    out = relational.assemble(points, datasets, values, splits, "MACHINERY", 1)
    return out.join(datasets.select("dataset_id", "dataset"), "dataset_id").select("point_id", "dataset", "line", "x", "property", "split_num")


@query("select o_orderkey as id, o_totalprice as value from orders where o_orderkey not in (select l_orderkey from lineitem where l_discount > 0.05)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return relational.not_in(orders, table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("id")), "id")


@query("select o_orderkey as id, o_orderstatus as status from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return relational.only_in(orders, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("id")), "id")


@query("select o_orderkey as id, c_name as name, c_nationkey as nation from orders left join customer on o_custkey = c_custkey and c_nationkey % 2 = 0")
def substance_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), F.lit("|x")).alias("piped"))
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cid"), (F.col("c_nationkey") % 2).alias("snapshot"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return relational.with_substance(points, subs, "piped", 0).select("id", "name", "nation")


@query("select distinct l_suppkey as suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 1000)")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey"))
    return relational.missing_records(rows, table(spark, sf_dir, "supplier").filter("s_acctbal > 1000").select(F.col("s_suppkey").alias("suppkey")), "suppkey")


@query("""select l_orderkey as id, l_linenumber as line, c1.n_name as public_source, c2.n_name as original_source from lineitem
 left join supplier on l_suppkey = s_suppkey left join nation c1 on s_nationkey = c1.n_nationkey left join nation c2 on l_partkey % 30 = c2.n_nationkey""")
def sources_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = relational.with_sources(rows.withColumn("original", F.col("l_partkey") % 30), n, "s_nationkey", "original")
    return out.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "public_source", "original_source")


@query(f"""with p as ({PREDICTIONS_SQL}) select o_orderkey as id, o_totalprice as value, s.total as pred, s.total * s.total as pred2 from orders left join (select id, round(sum(pred), 2) as total from p group by id) s on s.id = o_orderkey""")
def stacked_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = own.predictions(spark, sf_dir).groupBy("id").agg(F.round(F.sum("pred"), 2).alias("pred"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    out = relational.stack_prediction(rows.withColumn("features", F.array().cast("array<double>")), sums, "pred")
    return out.select("id", "value", F.get("features", F.lit(0)).alias("pred"), F.get("features", F.lit(1)).alias("pred2"))


@query("""with u as (select 'train' as "Set", doc_id as id, quality as exp, toxic as pred from labels where doc_id % 5 <> 0 union all by name select 'test' as "Set", doc_id as id, quality as exp, null as pred from labels where doc_id % 5 = 0)
 select "Set", id, exp, cast(pred as int) as pred from u""")
def union_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("exp"), F.col("toxic").alias("pred"))
    return relational.union_sets(train=rows.filter("id % 5 <> 0"), test=rows.filter("id % 5 = 0").drop("pred"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("select o_custkey as key, o_orderkey as id, o_totalprice as value, cast(rn as int) as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return order.top_k(rows, "key", 3, F.desc("value"), F.asc("id"))


@query("select l_shipdate as ship_date, l_orderkey as id, l_linenumber as line, cast(row_number() over w as int) as nth, count(*) over (partition by l_orderkey, l_returnflag) as n_of from lineitem window w as (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("__o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return order.occurrence(rows, "l_orderkey", "l_returnflag", order="__o").select(F.col("l_shipdate").alias("ship_date"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "nth", "n_of")


@query("""select event_id as id, cast(props->>'$.k' as double) as k, coalesce(props->>'$.mode', 'default') as mode from events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), S.json_number(F.col("props"), "$.k").alias("k"), S.json_default(F.col("props"), "$.mode", "default").alias("mode"))


@query(r"""select p_partkey as id, trim(split_part(p_name || ' | ' || p_brand, '|', 1)) as first_part, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') as name,
 regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g') || '_' || (p_partkey + 1) as unique_name, case when p_type = 'ECONOMY' then 1 when p_type = 'STANDARD' then 0 end as flag,
 floor(p_retailprice / 7 + 0.5)::bigint as half_up, round(1 / (1 + exp(-p_size / 10.0)), 8) as logistic, round(p_size / nullif(p_partkey % 3, 0), 8) as ratio from part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        S.first_part(F.concat_ws(" | ", "p_name", "p_brand")).alias("first_part"),
        S.sanitised_name(F.col("p_brand"), F.col("p_partkey")).alias("name"),
        S.unique_name(F.col("p_brand"), F.col("p_partkey")).alias("unique_name"),
        S.class_flag(F.col("p_type"), ("economy",), ("standard",)).alias("flag"),
        S.half_up(F.col("p_retailprice") / 7).alias("half_up"),
        F.round(S.logistic(F.col("p_size") / 10.0), 8).alias("logistic"),
        F.round(S.safe_divide(F.col("p_size"), F.col("p_partkey") % 3), 8).alias("ratio"),
    )


@query("""select p_partkey as id, round(case when p_size % 4 = 0 then p_retailprice when p_size % 4 = 1 then -log10(p_retailprice / (p_size * 1000.0)) when p_size % 4 = 2 then log10(p_retailprice) end, 6) as converted,
 case when p_size % 4 = 3 then 'no rule' end as reason from part""")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("solubility").alias("property"), F.when(kind == 0, "x").when(kind == 1, "mg/L").when(kind == 2, "plain").otherwise("odd").alias("from_unit"), F.when(kind == 0, "x").when(kind == 1, "-log10(mol/L)").when(kind == 2, "log10").otherwise("even").alias("to_unit"), F.col("p_retailprice").alias("value"), F.col("p_size").cast("double").alias("mol_weight"))
    rules = spark.createDataFrame([("solubility", "mg/L", "-log10(mol/L)", "mgl_to_neg_log_m"), ("solubility", "plain", "log10", "log10")], "property string, from_unit string, to_unit string, kind string")
    return rounded(units.convert(rows, rules), 6, "converted").select("id", "converted", "reason")


@query("""with w as (select doc_id as id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as words from documents where doc_id % 20 = 0),
 b as (select item_id as id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) as words from benchmark),
 s as (select w.id as q, b.id as r, len(list_intersect(w.words, b.words)) / (len(w.words) + len(b.words) - len(list_intersect(w.words, b.words))) as sim from w, b),
 t as (select q, r, sim from s where sim >= 0.01),
 c as (select q, step, count(*) filter (sim >= step) as n from t, (select round(0.95 - 0.02 * i, 2) as step from range(48) r(i)) group by q, step),
 p as (select q, max(step) filter (n >= 5 or step = 0.01) as threshold from c group by q)
 select q as query_id, round(any_value(threshold), 3)::double as threshold, cast(count(*) as int) as n from t join p using (q) where sim >= threshold group by q""")
def similar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != ""))
    docs = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), words.alias("words"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words.alias("words"))
    return set_similarity.similar_records(docs, items, 5).select("query_id", F.round("threshold", 3).alias("threshold"), "n")
