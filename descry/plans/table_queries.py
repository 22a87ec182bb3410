"""Queries of screens, lookups, upserts, statistics and texts, each by its operator, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from descry.functions import scalars as S
from descry.functions import units
from descry.operators import columns, domain, knn, models, order, records, relational, robust, split, stats, summaries
from descry.operators.metric_index import written
from descry.plans import stand_ins as own
from descry.plans.queries import NEAR, SCALED, _density_sql, inverted, query, rounded
from descry.plans.run import model_run
from descry.plans.stand_ins import CLASS_SQL, PREDICTIONS_SQL, table
from descry.sources import partitions, tables

# Screens over a few columns of the line items that differ in what is wrong with them.

NAMES = ("quantity", "LogP_one", "n_ACNT_zero", "tax", "big", "twice", "log p")
_VALUES = ("l_quantity", "1.0", "0.0", "case when l_tax < 0.08 then l_tax end", "1e9 + l_linenumber", "2 * l_quantity + l_discount", "l_discount")
WIDE_SQL = f"""select l_orderkey as id, [{", ".join(f"({v})::double" for v in _VALUES)}] as x from lineitem where l_quantity is not null and l_discount is not null"""
LONG_SQL = f"select id, i - 1 as idx, x[i] as x from ({WIDE_SQL}), unnest(range(1, {len(NAMES) + 1})) t(i)"


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity is not null and l_discount is not null")
    return rows.select(F.col("l_orderkey").alias("id"), F.array(*[F.expr(v).cast("double") for v in _VALUES]).alias("features"))


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES)), "idx int, name string")


@query(f"""with s as (select idx, count(*) as n, count(x) as v, stddev_samp(x) as sd, avg(x) as m, count(*) filter (x <> 0) as nz from ({LONG_SQL}) group by idx)
 select cast(idx as int) as idx, v < n or sd = 0 as constant_or_missing, sd < m * 1e-6 as nearly_constant, nz = 0 as all_zero from s""")
def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = written(columns.feature_stats(wide(spark, sf_dir)))
    out = s.select("idx")
    for name, screen in (("constant_or_missing", columns.constant_or_missing), ("nearly_constant", columns.nearly_constant), ("all_zero", columns.all_zero)):
        out = out.join(screen(s).withColumn(name, F.lit(True)), "idx", "left").fillna(False, [name])
    return out


@query(f"""with l as ({LONG_SQL}), a as (select idx, count(*) = count(x) as ok from l where id % 5 <> 0 group by idx), b as (select idx, count(*) = count(x) as ok from l where id % 5 = 0 group by idx)
 select cast(idx as int) as idx from a join b using (idx) where a.ok and b.ok""")
def valid_in_both_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide(spark, sf_dir)
    return columns.valid_in_both(columns.feature_stats(rows.filter("id % 5 <> 0")), columns.feature_stats(rows.filter("id % 5 = 0")))


@query("""with l as (select i - 1 as idx, vec_id, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) t(i) where embedding is not null)
 select distinct cast(b.idx as int) as idx from (select a.idx as i, b.idx, corr(a.x, b.x) as r from l a join l b on a.vec_id = b.vec_id and a.idx < b.idx group by all) b where abs(r) > 0.1""")
def correlated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in columns.correlated(own.instances(spark, sf_dir), 0.1)], "idx int")


@query(f"""with w as ({WIDE_SQL}) select round(sum(x[1]), 2) as quantity, count(*) as n, 'quantity,big,log p' as names from w""")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the seven columns: constants and missing ones, the logP and atom count ones, and the correlated one go."""
    rows, left = columns.prepare(wide(spark, sf_dir), names(spark), remove_logp=True, remove_corr=0.95, remove_acnt=True)
    said = left.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda s: s["name"]), ",").alias("names"))
    return rows.agg(F.round(F.sum(F.get("features", F.lit(0))), 2).alias("quantity"), F.count(F.lit(1)).alias("n")).join(F.broadcast(said))


@query(f"""select 'between' as screen, string_agg(l_shipmode, ',') as names from (select 'tax,big,twice' as l_shipmode from lineitem limit 1)
 union all select 'logp', 'LogP_one' union all select 'split', 'LogP_one,log p' union all select 'both', 'quantity,tax' """)
def name_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark)
    said = lambda screen, d: d.select("idx").join(n, "idx").agg(F.lit(screen).alias("screen"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda s: s["name"]), ",").alias("names"))
    other = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lit("tax"), F.lit("quantity"), F.lit("else"))).alias("name"))
    parts = [said("between", columns.between(n, "twice", "tax")), said("logp", columns.named_like(n, columns.LOGP)), said("split", columns.named_like(n, columns.LOGP_SPLIT)), said("both", columns.common_names(n, other))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"select id, round(sum(x[6]), 4) as twice, round(sum(x[1]), 4) as quantity from ({WIDE_SQL}) group by id")
def gathered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns.gather(wide(spark, sf_dir), columns.positions(names(spark), ["twice", "quantity"]))
    return rounded(rows.groupBy("id").agg(F.sum(F.get("features", F.lit(0))).alias("twice"), F.sum(F.get("features", F.lit(1))).alias("quantity")), 4, "twice", "quantity")


@query("select 'quality' as target, bool_and(coalesce(quality in (0, 1), false)) as is_binary from labels union all select 'doc_id', bool_and(coalesce(doc_id in (0, 1), false)) from labels")
def binary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return spark.createDataFrame([(c, columns.is_binary(rows.select(F.col(c).alias("property")))) for c in ("quality", "doc_id")], "target string, is_binary boolean")


@query("""select unnest(list_filter([case when count(*) filter (trim(o_comment) <> '') > 0 then 'text' end, case when count(o_totalprice) > 0 then 'price' end, case when count(*) filter (o_orderkey < 0) > 0 then 'none' end], lambda x: x is not null)) as name
 from (select *, o_orderstatus as o_comment from orders)""")
def meaningful_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("text"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") < 0, 1).alias("none"), F.array(F.when(F.col("o_orderkey") < 0, 1)).alias("nulls"), F.lit(" ").alias("blank"))
    return spark.createDataFrame([(c,) for c in tables.drop_meaningless(rows).columns], "name string")


@query("select unnest(list_filter([case when count(*) filter (p_name is not null and trim(p_name) <> '' and try_cast(p_name as double) is null) > 0 then 'p_name' end, case when count(*) filter (p_size is not null and try_cast(p_size::varchar as double) is null) > 0 then 'p_size' end], lambda x: x is not null)) as name from part")
def non_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in columns.non_numeric(table(spark, sf_dir, "part"), ["p_name", "p_size", "p_retailprice"])], "name string")


@query("""with l as (select vec_id as id, i, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) t(i) where embedding is not null), s as (select i, min(x) as a, max(x) as b from l where id % 5 <> 0 group by i)
 select id, cast(i - 1 as int) as idx, round((x - a) / case when b = a then 1 else b - a end, 6) as x from l join s using (i) where id % 5 = 0""")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = own.train_test(spark, sf_dir)
    return rounded(columns.long_form(columns.scale(test, columns.feature_stats(train), "range")), 6, "x")


# Rows in and out.


@query("select l_orderkey as id, l_linenumber as line, l_quantity + case when l_tax < 0.08 then l_tax else 0 end as total, l_tax >= 0.08 as lacks from lineitem")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.concat_ws("\t", F.col("l_quantity").cast("string"), F.when(F.col("l_tax") < 0.08, F.col("l_tax").cast("string")).otherwise("{}"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), cells.alias("v"))
    out, _ = tables.from_tsv_rows(rows, "id", "v", "quantity\ttax")
    tax = F.get("features", F.lit(1))
    return out.select("id", "line", (F.get("features", F.lit(0)) + F.coalesce(tax, F.lit(0.0))).alias("total"), tax.isNull().alias("lacks"))


@query("select o_custkey::varchar as id, cast(count(*) as long) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def service_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_custkey").cast("string").alias("id"), F.array(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("x")).alias("descriptors")).alias("c"))
    reply = each.groupBy("o_custkey").agg(F.to_json(F.struct(F.array(F.lit("price"), F.lit("none")).alias("headers"), F.collect_list("c").alias("chemicals"))).alias("reply"))
    out = tables.from_service_reply(reply, "reply")
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("features", F.lit(0))), 2).alias("total"))


@query("select p_partkey as id, case when p_size % 2 = 0 then p_size::double end as property, p_retailprice as price from part where p_partkey % 3 <> 0")
def cleaned_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("{}").alias("y"), F.when(F.col("p_partkey") % 3 == 0, "Error").otherwise(F.col("p_retailprice").cast("string")).alias("x0"))
    return tables.instances(raw, "p_partkey", "y", ["x0"]).select(F.col("id").cast("long"), "property", F.get("features", F.lit(0)).alias("price"))


_OLD = "select c_custkey as id, c_nationkey as v, 1::bigint as seq from customer where c_custkey % 3 <> 0"
_NEW = "select o_custkey as id, cast(o_orderkey % 25 as int) as v, o_orderkey as seq from orders where o_custkey % 2 = 0"


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"), F.lit(1).cast("long").alias("seq"))
    new = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 25).cast("int").alias("v"), F.col("o_orderkey").alias("seq"))
    return old, new


@query(f"with o as ({_OLD}), n as ({_NEW}) select id from o union all select distinct id from n where id not in (select id from o)")
def upsert_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_new(*_stored(spark, sf_dir), ["id"]).select("id")


@query(f"with o as ({_OLD}), n as (select id, arg_max(v, seq) as v, max(seq) as seq from ({_NEW}) group by id) select id, v, seq from o where id not in (select id from n) union all select id, v, seq from n")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_or_update(*_stored(spark, sf_dir), ["id"], "seq")


@query(f"with o as ({_OLD}), n as (select id, arg_max(v, seq) as v from ({_NEW}) group by id) select id, o.v as old, n.v as new from o join n using (id) where o.v is distinct from n.v")
def changed_by_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return tables.changed_values(old, order.keep_last(new, "id", "seq"), ["id"], "v")


@query("with g as (select * from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)) select 'stays' as what, (select count(*) from orders) - count(*) as n, null::bigint as first_id from g union all select 'goes', count(*), min(o_orderkey) from g")
def deletion_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders")
    gone = rows.join(doomed, "o_custkey", "left_semi").select("o_orderkey")
    stays, first, n = tables.delete_where(rows, gone, ["o_orderkey"])
    a = stays.agg(F.lit("stays").alias("what"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("first_id"))
    b = n.select(F.lit("goes").alias("what"), F.col("n_deleted").alias("n")).join(F.broadcast(first.agg(F.min("o_orderkey").alias("first_id"))))
    return a.unionByName(b)


@query("select p_partkey as id, '{\"p\":' || p_partkey || case when p_size % 2 = 0 then ',\"s\":' || p_size else '' end || '}' as json from part")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("s"))
    out = tables.to_json_rows(rows)
    return out.select(F.get_json_object("json", "$.p").cast("long").alias("id"), "json")


# Joins.


@query("select o_orderkey as id, c_name as name from orders join customer on o_custkey = c_custkey and c_nationkey % 2 = 0")
def substance_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_custkey").cast("string"), F.lit(" |x")).alias("piped"))
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cid"), (F.col("c_nationkey") % 2).alias("snapshot"), "c_name")
    return relational.with_substance(points, subs, "piped", 0, inner=True).select("id", F.col("c_name").alias("name"))


@query("select l_orderkey as point_id, l_linenumber as line, cast(l_linenumber - 1 as int) as cv_fold from lineitem where l_linenumber = l_orderkey % 5 + 2")
def predictions_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("splitting_id"))
    splits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 5 + 2).cast("int").alias("splitting_id"))
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("splitting_id"), F.when(F.col("n_nationkey").between(2, 6), F.concat(F.lit("CV"), F.col("n_nationkey").cast("string"))).otherwise("other").alias("name"))
    return relational.cv_predictions(p, splits, named, "CV").select("point_id", "line", "cv_fold")


@query("select s_suppkey as model_id, n_name as nation, r_name as region from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20 left join region on n_regionkey = r_regionkey")
def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region"))
    return relational.metadata(table(spark, sf_dir, "supplier"), (n, "s_nationkey"), (r, "r")).select(F.col("s_suppkey").alias("model_id"), "nation", "region")


_STATS_SQL = f"""with p as ({PREDICTIONS_SQL}), s as (select grp as model_id, count(exp)::double as n, round(avg(abs(exp - pred)), 4) as "MAE_Training", round(sqrt(avg((exp - pred) ** 2)), 4) as "RMSE_CV" from p group by grp)"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(stats.continuous(own.predictions(spark, sf_dir), "grp"), 4, "MAE", "RMSE")
    return stats.to_long(out.select(F.col("grp").alias("model_id"), "n", F.col("MAE").alias("MAE_Training"), F.col("RMSE").alias("RMSE_CV"), F.lit(1.0).alias("Coverage_Training")), ["model_id"])


@query(_STATS_SQL + """ select model_id, unnest(['n', 'MAE_Training', 'RMSE_CV']) as name, unnest([n, "MAE_Training", "RMSE_CV"]) as value from s""")
def statistics_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.statistics_map(_statistics(spark, sf_dir)).select("model_id", F.explode("stats").alias("name", "value"))


@query(_STATS_SQL + """ select model_id, null::double as train_r2, "MAE_Training" as train_mae, "RMSE_CV" as cv_rmse, null::double as fraction from s""")
def performance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = relational.statistics_map(_statistics(spark, sf_dir)).withColumn("p", records.performance(F.col("stats"), binary=False))
    return maps.select("model_id", F.col("p.train.R2").alias("train_r2"), F.col("p.train.MAE").alias("train_mae"), F.col("p.fiveFoldICV.RMSE").alias("cv_rmse"), F.col("p.externalAD.Fraction_inside_AD").alias("fraction"))


@query(f"""with p as ({PREDICTIONS_SQL}), g as (select id, bool_and(flag_a) as a, bool_and(coalesce(flag_b, false)) as b from p group by id) select id, a as "AD_near", b as "AD_far" from g where b""")
def flags_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measure joined left, another inner, so that rows without the second go."""
    p = own.predictions(spark, sf_dir).groupBy("id").agg(F.bool_and("flag_a").alias("a"), F.bool_and(F.coalesce("flag_b", F.lit(False))).alias("b"))
    out = relational.attach_flag(p.select("id"), p.select("id", F.col("a").alias("inside")), "near")
    return relational.attach_flag(out, p.filter("b").select("id", F.col("b").alias("inside")), "far", inner=True)


@query("select o_orderkey as id, cast(case when o_orderkey % 7 = 0 then -1 else o_orderkey % 5 end as int) as cv_fold from orders")
def folds_predefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return split.predefined(rows, rows.filter("id % 7 <> 0").withColumn("fold", (F.col("id") % 5).cast("int")))


@query("select s_name as name, n_name as definition, s_acctbal as estimate from supplier left join nation on s_suppkey = n_nationkey")
def coefficient_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    defined = table(spark, sf_dir, "nation").join(s, F.col("s_suppkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("definition"))
    return relational.definitions_for(s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("estimate")), defined).select("name", "definition", "estimate")


@query("select o_orderkey as id, coalesce(c_name, p_name, o_custkey::varchar) as label from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0 left join part on p_partkey = o_custkey and p_partkey % 3 = 0")
def labelled_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("neighbour_id"))
    rec = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    look = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return relational.enrich_neighbours(near, rec, look).select("id", "label")


@query("select distinct o_custkey as id, cast(o_custkey % 5 as int) as fold, c_nationkey as target from orders join customer on c_custkey = o_custkey")
def blueprint_on_other_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    blue = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("fold"))
    return relational.mapped_keys(blue, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("target")), ["id", "fold", "target"])


@query("select o_orderkey as id, o_custkey || '-' || o_orderkey as key from orders where o_custkey % 2 = 0 and o_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_custkey % 3 = 0)")
def leaked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "orders").withColumn("key", F.concat_ws("-", "o_custkey", "o_orderkey"))
    ext = keyed.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), "key")
    return relational.leaks(ext, keyed.filter("o_orderstatus = 'F' and o_custkey % 3 = 0").select("key"), "key")


@query("select n_nationkey as id, n_name as name from nation where n_name in (select n_name from nation where n_nationkey in (3, 7))")
def ids_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    wanted = [r["n_name"] for r in n.filter("n_nationkey in (3, 7)").select("n_name").collect()]
    return spark.createDataFrame([(i, w) for w, i in relational.lookup_ids(wanted, n, "n_name", "n_nationkey").items()], "id int, name string")


@query("select o_orderkey as id from orders where o_orderkey % 5 = 0")
def part_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.part(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("split_num")), 1).select("id")


@query("""with a as (select o_custkey as id, max(o_totalprice) as v from orders where o_custkey % 4 <> 0 group by 1), b as (select o_custkey as id, min(o_totalprice) as v from orders where o_custkey % 3 = 0 group by 1)
 select c_custkey as id, case when b.id is not null then b.v else a.v end as exp, case when b.id is not null then 'Test' when a.id is not null then 'Training' end as exp_set from customer left join a on a.id = c_custkey left join b on b.id = c_custkey""")
def experimental_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice")
    a = o.filter("id % 4 <> 0").groupBy("id").agg(F.max("o_totalprice").alias("property"))
    b = o.filter("id % 3 = 0").groupBy("id").agg(F.min("o_totalprice").alias("property"))
    return relational.experimental_value(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), a, b)


@query("select o_orderkey as id, o_custkey as qsar_smiles, c_name as name, c_acctbal as balance from orders left join customer on c_custkey = o_custkey and c_custkey % 2 = 0")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    rec = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return relational.nested_record(rows, rec, "key").select("id", "record.qsar_smiles", "record.name", "record.balance")


_ELEMENTS = ["C", "O", "N", "Xx", "H"]


@query("""with a as (select l_orderkey as id, ['C', 'O', 'N', 'Xx', 'H'][case when l_partkey % 29 = 0 then 4 else l_partkey % 3 + 1 end] as e from lineitem where l_orderkey % 11 <> 0),
 s as (select id, bool_and(e <> 'Xx') as known, count(*) as n, bool_or(e = 'C') as carbon from a group by id)
 select o_orderkey as id, case when coalesce(n, 0) = 0 then 'Number of atoms equals zero' when not known then 'Molecule contains unsupported element' when n = 1 then 'Only one non-hydrogen atom' when not carbon then 'Molecule does not contain carbon' else 'ok' end as reason from orders left join s on id = o_orderkey""")
def eligible_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*map(F.lit, _ELEMENTS)), F.when(F.col("l_partkey") % 29 == 0, 4).otherwise(F.col("l_partkey") % 3 + 1).cast("int"))
    atoms = table(spark, sf_dir, "lineitem").filter("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("id"), e.alias("element"))
    return relational.eligible(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), atoms)


@query("""with c as (select l_orderkey as id, list(l_linenumber order by l_linenumber) as x from lineitem where l_orderkey % 4 <> 0 and l_quantity > 20 group by 1)
 select o_orderkey as id, case when x is null then 'failed standardization' when len(x) > 1 then 'model can''t run mixtures' else 'ok' end as status, case when len(x) = 1 then x[1] end as standard from orders left join c on id = o_orderkey""")
def standardised_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 <> 0 and l_quantity > 20").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(parts, "id", "left")
    return relational.standardised(rows, "x", omit_salts=True).drop("x")


@query("select o_orderkey as id from orders where o_totalprice > 1000 and o_orderstatus in ('F', 'O') and o_custkey = 7")
def filtered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("keep", F.col("o_totalprice") > 1000)
    return relational.record_filter(rows, o_orderstatus=["F", "O"], o_custkey=7, o_orderdate=None).select(F.col("o_orderkey").alias("id"))


@query("select o_orderkey as id, cast(o_orderkey % 3 as int) as cv_fold, o_totalprice as pred from orders")
def union_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("pred"))
    return relational.union_folds([(i, o.filter(F.col("id") % 3 == i)) for i in range(3)])


@query("select (select count(*) from lineitem where l_linenumber = 1 and l_orderkey % 10 = 0 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')) as outside, (select count(*) from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1 and l_orderkey % 10 = 0)) as in_no_fold")
def fold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    folds = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("fold"))
    got = relational.check_folds(base, folds)
    return spark.createDataFrame([(got["outside"], got["in_no_fold"])], "outside long, in_no_fold long")


@query("select p_partkey as id, unnest(['a', 'b', 'c']) as name, unnest([p_size, p_partkey, p_partkey + 1]) as value from part")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("a"), F.col("p_size").cast("long"), F.lit("b"), F.lit(-1).cast("long")).alias("x"), F.create_map(F.lit("b"), F.col("p_partkey").cast("long"), F.lit("c"), (F.col("p_partkey") + 1).cast("long")).alias("y"))
    return p.select("id", F.explode(relational.merge_maps(F.col("x"), F.col("y"))).alias("name", "value"))


# Folds.


@query("select count(*) as n, max(n) - min(n) <= 4 as balanced, count(distinct fold) as folds from (select fold, count(*) as n from (select row_number() over () % 5 as fold from orders) group by fold)")
def folds_by_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of a continuous target: as many as asked, of sizes that differ by the number of bins at most."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("property"))
    n = split.binned_folds(rows, 5, 4).groupBy("fold").count()
    return n.agg(F.count(F.lit(1)).alias("n"), (F.max("count") - F.min("count") <= 4).alias("balanced"), F.count_distinct("fold").alias("folds"))


@query("select o_orderkey as id, case when ('0x' || md5('42|' || o_orderkey)[1:8])::bigint / 4294967296.0 < 0.2 then 1 else 0 end as split_num from orders")
def split_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hash_split(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 0.2)


@query("with t as (select doc_id as id, quality, doc_id % 4 = 0 as held from labels), f as (select id, (row_number() over (partition by quality order by md5('42|' || id), id) - 1) % 5 as fold from t where not held) select id, cast(fold as int) as fold from f")
def folds_of_training_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", (F.col("doc_id") % 4 == 0).cast("int").alias("split_num"))
    return split.inner_folds(rows, 5, ["quality"]).select("id", "fold")


@query("select c_custkey as id, c_mktsegment <> 'MACHINERY' as training from customer")
def folds_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = split.fold_by_label(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "c_mktsegment", "MACHINERY")
    return a.select("id", F.lit(True).alias("training")).unionByName(b.select("id", F.lit(False).alias("training")))


@query("with f as (select s_suppkey as id, (row_number() over (order by md5('42|' || s_suppkey), s_suppkey) - 1) % 3 as fold from supplier) select id, cast(fold = k as int) as split_num, cast(k + 2 as int) as splitting_id from f, range(3) t(k)")
def assignments_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.checked_assignments(split.k_folds(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), 3)).select(F.col("id").cast("int").alias("id"), "split_num", "splitting_id")


# Statistics.


@query("select source, count(quality) as n, round(count(*) filter (quality = 1) / count(quality), 6) as positive from labels join documents using (doc_id) group by source")
def positives_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("property", F.col("quality"))
    return rounded(stats.positive_fraction(rows, "source"), 6, "positive")


_FOLDED_SQL = f"select *, cast(id % 5 as int) as fold from ({PREDICTIONS_SQL})"


@query(f"""with f as (select grp, fold, avg(abs(exp - pred)) as m, sqrt(avg((exp - pred) ** 2)) as r from ({_FOLDED_SQL}) group by all) select grp, round(avg(m), 4) as "MAE", round(avg(r), 4) as "RMSE" from f group by grp""")
def means_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = stats.continuous(own.predictions(spark, sf_dir).withColumn("fold", F.col("id") % 5), "grp", "fold")
    return rounded(stats.mean_of_folds(per, ["MAE", "RMSE"], "grp"), 4, "MAE", "RMSE")


@query(f"""with p as ({PREDICTIONS_SQL}), s as (select count(exp)::double as n, avg(abs(exp - pred)) as m, sqrt(avg((exp - pred) ** 2)) as r from p) select 'all' as model, unnest(['MAE_CV_Training', 'RMSE_CV_Training']) as name, round(unnest([m, r]), 4) as value from s""")
def cross_validation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled over the union of the folds' rows, tagged, without the counts."""
    p = own.predictions(spark, sf_dir)
    pooled = relational.union_folds([(i, p.filter(F.col("id") % 5 == i)) for i in range(5)]).withColumn("model", F.lit("all"))
    long = stats.tagged(stats.continuous(pooled, "model").select("model", "MAE", "RMSE", "n"), ["model"], "_CV_Training")
    known = spark.createDataFrame([(1, "MAE_CV_Training"), (2, "RMSE_CV_Training"), (3, "n_CV_Training")], "statistic_id int, name string")
    return rounded(stats.known_statistics(long, known, skipped=["n_CV_Training"]), 4, "value").select("model", "name", "value")


@query("select o_custkey as key, round(avg(o_totalprice / 7.3), 4) as score from orders group by 1")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mean_scores(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_totalprice") / 7.3).alias("score")), "key"), 4, "score")


@query("select l_orderkey as id, max(l_extendedprice) filter (l_quantity > 10 and l_returnflag = 'N') as most from lineitem group by 1")
def largest_that_qualifies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_quantity", "l_returnflag", "l_extendedprice")).alias("i"))
    return items.select("id", stats.max_qualifying(F.col("i"), lambda x: (x["l_quantity"] > 10) & (x["l_returnflag"] == "N"), lambda x: x["l_extendedprice"]).alias("most"))


@query("select count(doc_id) as doc_id, count(text) as text, count(lang) as lang, count(source) as source, count(n_chars) as n_chars from documents")
def counts_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_counts(table(spark, sf_dir, "documents"))


@query("select o_orderstatus as status, count(*) as n, count(*) filter (o_totalprice > 20000) as n_visible, round(avg((o_totalprice > 20000)::int), 6) as share from orders group by 1")
def visible_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.share_visible(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), F.col("o_totalprice") > 20000, "status"), 6, "share")


@query("select string_agg(distinct l_returnflag, ',' order by l_returnflag) as names from lineitem")
def names_of_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parameter_names(table(spark, sf_dir, "lineitem"), "l_returnflag").select(F.array_join("names", ",").alias("names"))


@query("select event_type as name, count(distinct user_id) as n from events group by 1 having count(distinct user_id) >= 5")
def voted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("names"))
    return stats.votes(runs, "names", 5)


@query("select c_nationkey as nation, max(c_acctbal) as best, min(c_acctbal) as least from customer group by 1")
def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("score"))
    return stats.best_run(c, "score", True, "nation").withColumnRenamed("score", "best").join(stats.best_run(c, "score", False, "nation").withColumnRenamed("score", "least"), "nation")


@query(f"with p as ({PREDICTIONS_SQL}) select round(avg(exp), 4) as mean from p where exp is not null and pred is not null")
def mean_of_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(stats.training_mean(own.predictions(spark, sf_dir)), 4),)], "mean double")


@query(f"""with p as ({CLASS_SQL}), r as (select source, floor(exp + 0.5) as e, floor(pred * 0.7 + 0.5) as q from p where exp is not null and pred is not null)
 select source, round(list_avg(list_filter([count(*) filter (e = 1 and q = 1) / nullif(count(*) filter (e = 1), 0), count(*) filter (e = 0 and q = 0) / nullif(count(*) filter (e = 0), 0)], lambda x: x is not null)), 6) as "BA" from r group by source""")
def accuracy_of_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.balanced_accuracy_rounded(own.class_predictions(spark, sf_dir).withColumn("pred", F.col("pred") * 0.7), "source"), 6, "BA")


@query(f"""with p as ({PREDICTIONS_SQL}), t as (select grp, exp >= 40000 as e, pred >= 40000 as q from p where exp is not null and pred is not null)
 select grp, count(*) as n, count(*) filter (e and q) as "TP", count(*) filter (not e and not q) as "TN" from t group by grp""")
def classes_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.binary(stats.thresholded(own.predictions(spark, sf_dir).filter("exp is not null and pred is not null"), 40000), "grp").select("grp", "n", "TP", "TN")


_FLAGGED_SQL = f"select *, case when id % 9 <> 0 then id % 4 <> 0 end as inside from ({CLASS_SQL})"
_BA = "((count(*) filter (exp >= .5 and pred >= .5 and {0}) / count(*) filter (exp >= .5 and pred is not null and {0}) + count(*) filter (exp < .5 and pred < .5 and {0}) / count(*) filter (exp < .5 and pred is not null and {0})) / 2)"


@query(f"""with s as (select avg(inside::int) as c, {_BA.format("inside")} as a, {_BA.format("not inside")} as b from ({_FLAGGED_SQL})) select 'all' as model, round(c, 6) as "Coverage", round(a, 6) as "BA_inside", round(b, 6) as "BA_outside", round(a / b, 6) as "BA_ratio", round(c * a, 6) as "coverage_BA" from s""")
def accuracy_inside_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = own.class_predictions(spark, sf_dir).withColumn("model", F.lit("all")).withColumn("inside", F.when(F.col("id") % 9 != 0, F.col("id") % 4 != 0))
    return rounded(stats.inside_outside_binary(rows, "inside", "model"), 6, "Coverage", "BA_inside", "BA_outside", "BA_ratio", "coverage_BA")


@query(f"""with p as ({PREDICTIONS_SQL}) select grp, round(count(*) filter (flag_b and exp is not null and pred is not null) / count(*) filter (exp is not null and pred is not null), 6) as numbers, round(count(*) filter (flag_b and exp is not null) / count(exp), 6) as classes from p group by grp""")
def coverage_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir)
    out = stats.coverage(p, "flag_b", "grp").withColumnRenamed("Coverage", "numbers").join(stats.coverage(p, "flag_b", "grp", binary_target=True).withColumnRenamed("Coverage", "classes"), "grp")
    return rounded(out, 6, "numbers", "classes")


@query(f"with p as ({PREDICTIONS_SQL}), s as (select avg(flag_b::int) filter (id % 5 <> 0) as a, avg(flag_b::int) filter (id % 5 = 0) as b from p) select round(a, 6) as train, round(b, 6) as test, round(b / a, 6) as ratio from s")
def coverage_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir).withColumn("set", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return rounded(stats.coverage_ratio(p, "flag_b"), 6, "train", "test", "ratio")


@query("""with a as (select n_name as name, n_regionkey::double as value from nation where n_nationkey < 20), b as (select n_name as name, n_nationkey::double as value from nation where n_nationkey >= 5)
 select name, a.value as old, b.value as new, b.value - a.value as change from a full join b using (name)""")
def statistics_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    old = n.filter("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("value"))
    return stats.compare(old, n.filter("n_nationkey >= 5").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("value")))


@query("select c_custkey as id, coalesce(case when c_custkey % 3 <> 0 then c_acctbal end, case when c_custkey % 2 = 0 then c_nationkey::double end) as value, c_custkey % 3 = 0 and c_custkey % 2 = 0 as recomputed from customer")
def statistics_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("value"))
    return stats.recomputed(old, c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("value")), ["id"])


@query(f"""with p as ({PREDICTIONS_SQL}), s as (select id % 5 = 0 as t, avg(abs(exp - pred)) as m, sqrt(avg((exp - pred) ** 2)) as r from p group by 1)
 select 'MAE' as metric, round(max(m) filter (not t), 4) as train, round(max(m) filter (t), 4) as test from s union all select 'RMSE', round(max(r) filter (not t), 4), round(max(r) filter (t), 4) from s""")
def scores_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir).withColumn("set", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return rounded(stats.score_table(stats.continuous(p, "set"), ["MAE", "RMSE"]), 4, "train", "test")


@query("""with e as (select label::double as y, embedding[1]::double as x from embeddings where embedding is not null and label is not null) select round(1 - sum((x - y) ** 2) / (var_pop(x) * count(*)), 4) as r2 from e""")
def r2_of_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.descriptor_r2(own.instances(spark, sf_dir), 0), 4, "r2")


@query("with s as (select unnest([3, 5, 10]) as k), f as (select k as n_fold, avg(l_extendedprice) as score from lineitem, s group by k, l_orderkey % k) select n_fold, round(avg(score), 4) as mean, round(stddev_pop(score), 4) as std, round(max(score) - min(score), 4) as range from f group by n_fold")
def summary_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("n_fold"))
    scores = rows.groupBy("n_fold", F.col("l_orderkey") % F.col("n_fold")).agg(F.avg("l_extendedprice").alias("score"))
    return rounded(stats.fold_summary(scores), 4, "mean", "std", "range")


@query(f"with p as ({PREDICTIONS_SQL}) select id in (select o_orderkey from orders where o_orderstatus = 'F') as member, round(avg(abs(exp - pred)), 4) as \"MAE\" from p group by 1")
def statistics_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = own.predictions(spark, sf_dir)
    members = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    parts = [stats.continuous(d.withColumn("member", F.lit(m)), "member").select("member", "MAE") for m, d in ((True, relational.only_in(p, members, "id")), (False, relational.not_in(p, members, "id")))]
    return rounded(parts[0].unionByName(parts[1]), 4, "MAE")


@query(f"with p as ({PREDICTIONS_SQL}) select id, line, round(abs(exp - pred), 4) as abs_diff from p where exp is not null and pred is not null")
def evaluated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(records.evaluated(own.predictions(spark, sf_dir)), 4, "abs_diff").select("id", "line", "abs_diff")


# Order and bins.


@query("with f as (select l_linenumber as fold, avg(l_extendedprice) as score from lineitem group by 1), p as (select avg(l_extendedprice) as m from lineitem) select cast(fold as int) as fold from f, p order by abs(score - m), fold limit 1")
def representative_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    scores = rows.groupBy(F.col("l_linenumber").alias("fold")).agg(F.avg("l_extendedprice").alias("score"))
    return spark.createDataFrame([(order.closest_fold(scores, rows.agg(F.avg("l_extendedprice")).first()[0]),)], "fold int")


@query("with s as (select quantile_cont(l_extendedprice, [0.25, 0.75]) as q, count(l_extendedprice) as n, min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem) select cast(ceil((b - a) / (2 * (q[2] - q[1]) * n ** (-1.0 / 3))) as int) as bins from s")
def bins_by_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(order.freedman_diaconis(table(spark, sf_dir, "lineitem"), "l_extendedprice"),)], "bins int")


@query("select s_suppkey as run, s_acctbal as score, cast(row_number() over (order by s_acctbal desc nulls last, s_suppkey) as int) as place from supplier qualify place <= 10")
def runs_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("score"))
    best = order.by_metric(rows, "score", True).limit(10).collect()
    return spark.createDataFrame([(r["run"], r["score"], i + 1) for i, r in enumerate(best)], "run int, score double, place int")


@query("select o_orderkey as id from orders where o_orderkey >= (select arg_min(o_orderkey, md5('7|' || o_orderkey)) from orders) order by 1 limit 100")
def sample_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return order.id_sample(o, "o_orderkey", order.seeded_start(o, "o_orderkey", 7), 100).select(F.col("o_orderkey").alias("id"))


@query("select s_name as name, s_acctbal as estimate from supplier where s_acctbal <> 0 order by abs(s_acctbal) desc, s_name limit 11")
def largest_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.largest_coefficients(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("estimate")), 11)


@query("with l as (select i - 1 as idx, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) t(i) where embedding is not null) select cast(idx as int) as idx, round(avg(abs(x)), 6) as importance from l group by idx order by avg(abs(x)) desc, idx limit 12")
def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = columns.long_form(own.instances(spark, sf_dir)).groupBy("idx").agg(F.avg(F.abs("x")).alias("importance"))
    return rounded(order.top_importances(each), 6, "importance")


# Texts and numbers.


@query("""select id, t, n3, cell, quoted, reason from (select p_partkey as id, case p_partkey % 6 when 0 then 'Water pH' when 1 then 'Source QC DOI' when 2 then 'Chemical ID' when 3 then 'SMILES CASRN' when 4 then 'AD Distance' else 'Name CID' end as t,
 case when v = 0 then '0' when abs(v) < 0.01 or abs(v) > 1000 then printf('%.2e', v) else printf('%.3g', v) end as n3, case when p_partkey % 3 = 0 then '="' || '=' || p_name || '"' else p_name end as cell, case when p_partkey % 3 = 1 then '''' || '-' || p_name else p_name end as quoted,
 printf('Avg. distance (%.2f) %s %.2f', p_size / 7.0, case when p_size < 25 then '<' else '>' end, 25 / 7.0) as reason from (select *, case when p_partkey % 5 = 0 then p_size / 1e4 when p_partkey % 5 = 1 then p_size / 3.0 when p_partkey % 5 = 2 then -p_size * 100.0 else p_retailprice / 2 end as v from part))""")
def texts_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, ("exp_details_water_ph_str", "source_qc_doi", "chemical_id", "smiles_casrn", "ad_distance", "name_cid"))), (k % 6 + 1).cast("int"))
    v = F.when(k % 5 == 0, F.col("p_size") / 1e4).when(k % 5 == 1, F.col("p_size") / 3.0).when(k % 5 == 2, -F.col("p_size") * 100.0).otherwise(F.col("p_retailprice") / 2)
    cell = F.when(k % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    other = F.when(k % 3 == 1, F.concat(F.lit("-"), "p_name")).otherwise(F.col("p_name"))
    inside = F.col("p_size") < 25
    return p.select(k.alias("id"), S.title(said).alias("t"), S.short_number(v).alias("n3"), S.escaped_cell(cell).alias("cell"), S.escaped_cell(other, "quote").alias("quoted"), S.distance_reason(inside, F.col("p_size") / 7.0, F.lit(25 / 7.0)).alias("reason"))


@query("""select p_partkey as id, case p_size % 5 when 0 then printf('%d', p_size) || ' mg/L < value < ' || printf('%d', p_size + 1) || ' mg/L' when 1 then ' > ' || p_size || ' mg/L' when 2 then ' < ' || p_size || ' ' when 3 then p_size || ' mg/L' else p_name end as text from part""")
def texts_of_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, x = table(spark, sf_dir, "part"), F.col("p_size") % 5, F.col("p_size").cast("double")
    low, high, point = F.when(k.isin(0, 1), x), F.when(k == 0, x + 1).when(k == 2, x), F.when(k == 3, x)
    return p.select(F.col("p_partkey").alias("id"), S.parameter_text(low, high, point, F.when(k == 2, "Text").otherwise("mg/L"), F.col("p_name")).alias("text"))


@query("""select p_partkey as id, case when p_partkey % 2 = 0 then 'mg/L' else 'mol/L' end as unit, round(-log10(p_retailprice / (p_size * 1000.0)), 6) as neg_log, round_even(p_size / 2.0, 0)::double as even, 'http://x/y?' || 'a=' || p_size || '&b=' || replace(p_brand, '#', '%23') as url from part""")
def numbers_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    prop = F.when(F.col("p_partkey") % 2 == 0, units.IN_MGL[0]).otherwise("other")
    return p.select(F.col("p_partkey").alias("id"), units.display_unit(prop, F.lit("mol/L")).alias("unit"), F.round(S.mgl_to_neg_log_molar(F.col("p_retailprice"), F.col("p_size").cast("double")), 6).alias("neg_log"), S.half_even(F.col("p_size") / 2.0).alias("even"), S.with_query(F.lit("http://x/y"), a=F.col("p_size"), b=F.col("p_brand")).alias("url"))


@query("""with n as (select o_custkey as id, list(o_orderkey::varchar order by o_orderkey) as x from orders group by 1) select id, case when length(array_to_string(x, ', ')) > 40 then array_to_string(x, ', ')[1:40] || '...' else array_to_string(x, ', ') end as items, len(x)::double as metric from n""")
def lists_and_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("x"))
    m = F.create_map(F.lit("late"), F.size("x").cast("double"))
    return n.select("id", S.truncated_list(F.col("x"), 40).alias("items"), S.first_metric(m, "early", "late").alias("metric"))


# Domains.


@query("""with c as (select user_id as id, event_type as fragment, count(*)::double as x from events group by all), t as (select fragment, min(x) as lo, max(x) as hi from c where id % 5 <> 0 group by 1)
 select id, string_agg(fragment || case when x < lo or x > hi then '*' else '' end || case when fragment not in ('click', 'view') then '**' else '' end, ',' order by fragment) as marked, bool_and(fragment in ('click', 'view')) and bool_and(x between lo and hi) as concluded from c join t using (fragment) where id % 5 = 0 group by id""")
def fragments_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, model = own.fragments(spark, sf_dir), F.array(F.lit("click"), F.lit("view"))
    out = domain.fragment_range(f.filter("id % 5 <> 0"), f.filter("id % 5 = 0"), own.fragment_names(spark))
    ok = F.forall("fragment_table", lambda r: F.array_contains(model, r["fragment"]))
    return out.select("id", F.array_join(domain.marked_fragments(F.col("fragment_table"), model), ",").alias("marked"), (S.conclusion(F.col("inside") & ok) == "Inside").alias("concluded"))


@query(f"""with {SCALED.strip()}, {NEAR.format(distance="list_distance(q.x, t.x)", k=10).strip()} select r.id, round(avg(abs(e.property - 5)), 6) as "MAE", count(*) as n from r join e on e.id = nid where r.id % 5 = 0 group by r.id""")
def errors_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the ten nearest training rows of each test row, with 5 as every row's prediction."""
    train, test = own.train_test(spark, sf_dir)
    st = columns.feature_stats(train)
    known = train.select("id", F.col("property").alias("exp"), F.lit(5.0).alias("pred"))
    out = domain.neighbour_statistics(knn.neighbours(columns.scale(train, st), columns.scale(test, st), 10), known)
    return rounded(out, 6, "MAE").select("id", "MAE", "n")


def _listed(distance: str, metric: str) -> str:
    near = NEAR.format(distance=distance, k=5).strip()
    return f"""select '{metric}' as metric, r.id, r.rank, r.nid as neighbour_id, round(r.dist, 4) as distance, e.property as label from (with {near} select * from r) r join e on e.id = nid where r.id % 5 = 0"""


@query(f"""with {SCALED.strip()} {_listed("list_distance(q.x, t.x)", "euclidean")} union all {_listed("list_cosine_distance(q.x, t.x)", "cosine")}""")
def neighbours_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test rows as a list of queries, by two metrics."""
    return rounded(domain.neighbours_listed(*own.train_test(spark, sf_dir), 5), 4, "distance")


@query(_density_sql(kernels="e"))
def ad_density_unscaled_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels at the training rows as they come, scaled rows judged."""
    return rounded(domain.density(*own.train_test(spark, sf_dir), compat=True)[0].select("id", "set", "value", "inside"), 4, "value")


# Models.


@query()
def robust_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and discount, fitted by consensus and by the median of fits of random rows."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("property"), F.array("l_quantity", "l_discount").alias("features"))
    out = [(m, n, float(b)) for m, fit in (("consensus", robust.consensus), ("theil_sen", robust.theil_sen)) for n, b in zip(("intercept", "quantity", "discount"), fit(rows), strict=True)]
    return spark.createDataFrame(out, "method string, name string, estimate double")


_PERMUTED = f"""with recursive e as (select vec_id as id, label::double as y, embedding::double[] as x from embeddings where embedding is not null),
 t as (select * from e where id % 5 <> 0 and y is not null), q as (select unnest([1, 2, 3]) as seed),
 o as (select seed, id, row_number() over (partition by seed order by md5(seed || '|' || id), id) as n from t, q),
 y2 as (select seed, y, row_number() over (partition by seed order by md5((seed + 1) || '|' || id), id) as n from t, q),
 yp as (select seed, id, y2.y from o join y2 using (seed, n)),
 l as (select id, i, x[i] as v from t, unnest(range(1, 65)) s(i)), m as (select i, avg(v) as m from l group by i),
 c as (select id, i, v - m as v from l join m using (i)),
 gx as (select a.i, b.i as j, sum(a.v * b.v) as g from c a join c b using (id) group by all),
 gy as (select i, seed, sum(v * y) as g from c join yp using (id) group by all),
 u as (select i, list_concat(any_value(left_.row), list(gy.g order by seed)) as row from (select i, list(g order by j) as row from gx group by i) left_ join gy using (i) group by i),
{inverted(64)},
 b as (select seed, list(row[seed] order by i) as b from w, q group by seed),
 p as (select seed, case when id % 5 = 0 then 'validation' else 'training' end as set, y, list_dot_product(x, b) as pred from e, b)
 select seed, set, round(corr(y, pred) ** 2, 6) as r2 from p group by all"""


@query(_PERMUTED)
def permuted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.y_randomised(*own.train_test(spark, sf_dir), "reg"), 6, "r2")


@query()
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a linear run on the embeddings; a sixth of the training rows stands in the external set too, and is left out there."""
    train, test = own.train_test(spark, sf_dir)
    return model_run(train.filter("id % 5 < 4"), test, train.filter("id % 5 = 4 or id % 6 = 0"))[1]


@query("""select l_orderkey as id, count(*) as n, round(sum(l_extendedprice - s * l_quantity - i), 3) as residual from lineitem, (select regr_slope(l_extendedprice, l_quantity) as s, regr_intercept(l_extendedprice, l_quantity) as i from lineitem where l_orderkey % 5 <> 0) where l_orderkey % 5 = 0 and l_quantity is not null group by 1""")
def linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity is not null").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("property"), F.array("l_quantity").alias("features"))
    out = models.predict(models.fit(rows.filter("id % 5 <> 0"), "reg"), rows.filter("id % 5 = 0"))
    return rounded(out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exp") - F.col("pred")).alias("residual")), 3, "residual")


@query("""select vec_id as id, case when vec_id % 7 = 0 then 'no descriptors' when vec_id % 11 = 0 then 'expected 64 descriptors, got 3' when vec_id % 13 = 0 then 'missing or infinite descriptor' else 'ok' end as status, vec_id % 7 <> 0 and vec_id % 11 <> 0 and vec_id % 13 <> 0 as predicted from embeddings where embedding is not null and vec_id % 5 = 0""")
def batch_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with broken rows: each has an answer, with a prediction or with the reason for none."""
    train, test = own.train_test(spark, sf_dir)
    i, f = F.col("id"), F.col("features")
    broken = F.when(i % 7 == 0, None).when(i % 11 == 0, F.slice(f, 1, 3)).when(i % 13 == 0, F.transform(f, lambda x, k: F.when(k > 0, x))).otherwise(f)
    out = models.score_batch(models.fit(train, "reg"), test.withColumn("features", broken), 64)
    return out.select("id", "status", F.col("pred").isNotNull().alias("predicted"))


@query("""with r as (select l_orderkey as id, l_linenumber as line, l_quantity as a, l_discount as b from lineitem where l_quantity is not null and l_discount is not null),
 g as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb from r where id % 5 <> 0), v as (select id, (a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab) as h from r, g),
 c as (select h as cutoff from (select h, row_number() over (order by h) - 1 as k, count(*) over () as n from v where id % 5 <> 0) where k = floor(n * 0.95)::bigint)
 select id, count(*) as n, round(sum(h) * 1e6, 4) as total, count(*) filter (h <= cutoff) as n_inside from v, c where id % 5 = 0 group by id""")
def leverage_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity is not null and l_discount is not null").select(F.col("l_orderkey").alias("id"), F.array("l_quantity", "l_discount").alias("features"))
    out, _ = domain.leverage(rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0"), scaled=False)
    return out.filter("set = 'test'").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") * 1e6, 4).alias("total"), F.count_if("inside").alias("n_inside"))


@query()
def representative_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.representative_split(own.instances(spark, sf_dir), 5, numTrees=10, maxDepth=5).select("id", "fold", "split_num")


@query("""with k as (select case when o_orderkey % 11 = 0 then 'Z' else o_orderstatus end as status, o_orderkey as id, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then o_totalprice * 2 else o_totalprice end as total from orders
  union all select 'N', -o_orderkey, 1.0 from orders where o_orderkey % 13 = 0 and o_orderkey <> 0)
 select status, count(*) as n, sum(id)::bigint as ids, round(sum(total), 2) as total from k where id % 3 <> 0 or status = 'N' group by status""")
def table_changed_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by status: some get new values, some another status, some are new, and a third of the old keys goes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    path = tables.shared_dir(spark)
    tables.write_by(orders, path, "status")
    i = F.col("id")
    changed = orders.filter((i % 7 == 0) | (i % 11 == 0)).select("id", (F.col("total") * 2).alias("total"), F.when(i % 11 == 0, "Z").otherwise(F.col("status")).alias("status"), F.lit(1).alias("seq"))
    partitions.upsert(spark, path, changed.unionByName(changed.withColumns({"seq": F.lit(0), "total": F.lit(0.0)})), ["id"], ["status"], "seq")
    partitions.insert(spark, path, orders.filter(i % 13 == 0).select((-i).alias("id"), F.lit(1.0).alias("total"), F.lit("N").alias("status")), ["id"], ["status"])
    partitions.delete(spark, path, orders.filter(i % 3 == 0).select("id"), ["id"], ["status"])
    out = spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("total").alias("total"))
    return rounded(out, 2, "total")


@query("""select l_orderkey as "Order", l_linenumber as line, l_extendedprice as property, l_tax <= 0.04 as "AD leverage" from lineitem""")
def report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a report: the target of one unit, the model's own domain columns, titles by rule, sorted at the end."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_extendedprice", "l_discount", (F.col("l_tax") <= 0.04).alias("AD_leverage"), (F.col("l_tax") > 0.07).alias("AD_density"))
    own_target = records.target_by_unit(rows, "price", {"price": "l_extendedprice", "share": "l_discount"})
    return records.in_order(records.titled(records.domain_columns(own_target, ["leverage"]), [("l_orderkey", "Order"), ("line", None), ("property", None), ("AD_leverage", None), ("AD_density", None)]), "Order", "line")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' flags as runs, one results document each in a folder of its own, read again."""
    p = own.predictions(spark, sf_dir).withColumn("set", F.when(F.col("id") % 5 == 0, "Test").when(F.col("id") % 5 == 1, "CV_Training").otherwise("External"))
    by_set = p.groupBy("grp", "set").agg(F.round(F.avg(F.abs(F.col("exp") - F.col("pred"))), 3).alias("mae"))
    of = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("set") == s, F.struct(F.lit(f"MAE_{s}"), "mae"))))
    details = F.struct(F.lit(False).alias("is_binary"), F.when(F.col("grp") != "R", F.array(F.lit("quantity"), F.lit("discount"))).alias("embedding")).alias("model_details")
    blocks = by_set.groupBy("grp").agg(of("Test").alias("test_stats"), of("CV_Training").alias("cv_stats"), of("External").alias("ext_stats"))
    documents = blocks.select("grp", F.to_json(F.struct(details, F.struct("test_stats", "cv_stats", F.when(F.col("grp") != "N", F.col("ext_stats")).alias("ext_stats")).alias("model_statistics"))).alias("document"))
    at = tables.shared_dir(spark)
    documents.write.partitionBy("grp").text(at)
    return tables.read_runs(spark, f"{at}/*/part-*", summaries.RUN_SCHEMA)


@query(f"""with p as (select *, case when id % 5 = 0 then 't' when id % 5 = 1 then 'c' else 'e' end as s from ({PREDICTIONS_SQL})),
 m as (select grp, s, round(avg(abs(exp - pred)), 3) as mae from p group by all)
 select 'grp=' || grp as run, 'MAE' as metric, max(mae) filter (s = 't') as test, max(mae) filter (s = 'c') as training_cv, max(mae) filter (s = 'e' and grp <> 'N') as external,
  case when grp <> 'R' then 2 end as n_variables, case when grp <> 'R' then 'quantity, discount' end as embedding from m group by grp""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results documents of runs, written, found again by pattern, and summed up in a row each."""
    return summaries.run_summary(_runs(spark, sf_dir))


@query("""with p as (select p_retailprice as x, p_size % 2 as part from part), e as (select greatest(round(floor(min(x)), -2) - 10, 0) as lo, round(ceil(max(x)), -2) + 10 as hi from p),
 b as (select part, least(floor((x - lo) / 10), (hi - lo) / 10 - 1)::int as bin, lo from p, e where x between lo and hi)
 select cast(part as int) as part, bin, lo + 10.0 * bin as low, lo + 10.0 * bin + 10 as high, count(*) as n from b group by all""")
def bins_of_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in the bins of a surface tension, shared by parts of odd and of even size."""
    rows = table(spark, sf_dir, "part").select("p_retailprice", (F.col("p_size") % 2).cast("int").alias("part"))
    return summaries.histogram_by_rule(rows, "p_retailprice", "Surface Tension", "dyn/cm", "part")


def _split_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as points, market segments as datasets, two splittings of all orders, and those splittings' names."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    points = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("point_id"), F.length("c_mktsegment").alias("dataset_id"), F.col("o_custkey").alias("structure"), F.col("o_totalprice").alias("property"))
    datasets = customer.select(F.length("c_mktsegment").alias("dataset_id"), F.concat(F.lit("of "), F.length("c_mktsegment").cast("string")).alias("name")).distinct()
    splits = orders.select(F.col("o_orderkey").alias("point_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("splitting_id"), F.when(F.col("o_orderkey") % (k + 4) == 0, 1).otherwise(0).alias("split_num")) for k in (1, 2)])).alias("s")).select("point_id", "s.*")
    names = spark.createDataFrame([(1, "hold-out"), (2, "fold")], "splitting_id int, name string")
    return points, datasets, splits, names


_IN_SEGMENT = "select o_orderkey as point_id, o_custkey as structure, o_totalprice as property from orders join customer on c_custkey = o_custkey where length(c_mktsegment) = 9"


@query(f"""with p as ({_IN_SEGMENT}), v as (select distinct l_orderkey as k from lineitem where l_quantity > 45)
 select point_id, structure, property, case when point_id % 5 = 0 then 'test' else 'training' end as part, point_id % 5 = 0 as is_test from p where structure in (select k from v)""")
def parts_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of a named splitting of a named dataset, of structures that have descriptors."""
    values = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("structure"))
    members = relational.members_of_split(*_split_tables(spark, sf_dir), "of 9", "hold-out", values)
    training, test = relational.both_parts(members)
    both = training.withColumn("part", F.lit("training")).unionByName(test.withColumn("part", F.lit("test")))
    marked = both.join(relational.test_structures(members).withColumn("t", F.lit(True)), "structure", "left")
    return marked.select("point_id", "structure", "property", "part", (F.coalesce("t", F.lit(False)) & (F.col("part") == "test")).alias("is_test"))


@query(f"with p as ({_IN_SEGMENT}) select structure as id, property as exp, round(c_acctbal / 2, 4) as pred from p join customer on c_custkey = structure where structure % 3 = 1")
def external_of_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's predictions in one splitting for the structures of a named dataset."""
    points, datasets, *_ = _split_tables(spark, sf_dir)
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("structure"), (F.col("c_custkey") % 3).alias("model_id"), F.explode(F.array(F.lit(1), F.lit(43))).alias("splitting_id"), F.col("c_acctbal").alias("x"))
    p = p.select("structure", "model_id", "splitting_id", (F.col("x") * F.when(F.col("splitting_id") == 43, 0.5).otherwise(9.0)).alias("pred"))
    return rounded(relational.external_predictions(p, points, datasets, 1, 43, "of 9"), 4, "pred")


@query("""with o as (select o_orderkey as id, o_custkey as pt, o_orderkey % 5 = 0 as held from orders),
 f as (select id, (row_number() over (order by md5('42|' || id), id) - 1) % 5 as fold from o where not held),
 b as (select id, case when held then 1 else 0 end as split_num, 1 as splitting_id from o union all select id, case when fold = k then 1 else 0 end, 2 + k from f, range(5) t(k))
 select distinct pt as point_id, split_num::bigint as split_num, splitting_id::bigint as splitting_id, 'builder' as created_by, 'builder' as updated_by, true as same_time from b join o using (id)""")
def blueprint_cloned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hold-out and the folds of its training part, as rows of a second dataset's points (the customers)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("point_id"), F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0).alias("split_num"))
    inner = split.assignments(split.inner_folds(orders.select("id", "split_num"), 5))
    rows = relational.cloned_blueprint(relational.split_blueprint(orders, inner), orders, "builder", F.current_timestamp())
    return rows.select("point_id", "split_num", "splitting_id", "created_by", "updated_by", (F.col("created_at") == F.col("updated_at")).alias("same_time"))


@query("""select l_orderkey as id, to_json({'total': case when count(*) < 3 then sum(l_quantity)::int end, 'lines': list({'line': l_linenumber, 'tax': case when l_linenumber % 2 = 0 then round(l_tax, 2) end} order by l_linenumber, l_tax)})::varchar as json from lineitem group by 1""")
def safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as JSON; numbers that are none, however deep, as null."""
    tax = F.when(F.col("l_linenumber") % 4 == 1, float("nan")).when(F.col("l_linenumber") % 2 == 1, float("inf")).otherwise(F.round("l_tax", 2))
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.round("l_tax", 2).alias("o"), tax.alias("tax"))))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.count(F.lit(1)) < 3, F.sum("l_quantity").cast("int")).alias("total"), lines.alias("lines"))
    shaped = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x["line"], x["tax"])))
    kinds = {f.name: f.dataType for f in shaped.schema}
    safe = shaped.select("id", *[tables.json_safe(F.col(c), kinds[c]).alias(c) for c in ("total", "lines")])
    return safe.select("id", F.to_json(F.struct("total", "lines"), {"ignoreNullFields": "false"}).alias("json"))


@query("""with c as (select c_custkey as id, c_name as name, c_mktsegment as segment, floor(c_acctbal)::int as bal from customer),
 n as (select *, row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderkey) as rank from orders),
 g as (select o_custkey as id, list({'rank': rank, 'neighbour': o_orderkey} order by rank) filter (o_orderkey % 2 = 0) as tr, list({'rank': rank, 'neighbour': o_orderkey} order by rank) filter (o_orderkey % 2 = 1) as te from n where rank <= 3 group by 1)
 select c.id, to_json({'chemicalIdentifiers': {'name': name, 'segment': segment}, 'modelDetails': {'modelName': 'balance', 'nFeatures': 2}, 'modelResults': {
  'experimentalValueUnitsModel': case when c.id % 4 = 0 then bal end, 'experimentalValueUnitsDisplay': case when c.id % 4 = 0 then bal * 10 end, 'experimentalValueSet': case when c.id % 4 = 0 then 'Training' end,
  'predictionValueUnitsModel': case when c.id % 7 <> 0 then bal + 1 end, 'unitsModel': 'm', 'predictionValueUnitsDisplay': case when c.id % 7 <> 0 then (bal + 1) * 10 end, 'unitsDisplay': 'dm',
  'predictionError': case when c.id % 7 = 0 then 'no descriptors' end, 'adEstimates': case when c.id % 7 = 0 then [] else [{'method': 'density', 'conclusion': case when c.id % 2 = 0 then 'Inside' else 'Outside' end, 'reason': 'by remainder'}, {'method': 'leverage', 'conclusion': 'Inside', 'reason': 'always'}] end},
  'neighborResultsTraining': tr, 'neighborResultsPrediction': te})::varchar as report from c left join g using (id)""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as query rows: a whole report each, with two domain measures and the first orders of either parity as neighbours."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").cast("int").alias("bal"))
    bad = F.col("id") % 7 == 0
    results = c.select("id", (F.col("bal") + 1).alias("pred"), F.when(bad, "no descriptors").alias("error"))
    experiments = c.filter("id % 4 = 0").select("id", F.col("bal").alias("exp"), F.lit("Training").alias("set"))
    density = c.filter(~bad).select("id", F.lit("density").alias("method"), F.when(F.col("id") % 2 == 0, "Inside").otherwise("Outside").alias("conclusion"), F.lit("by remainder").alias("reason"))
    estimates = density.unionByName(c.filter(~bad).select("id", F.lit("leverage").alias("method"), F.lit("Inside").alias("conclusion"), F.lit("always").alias("reason")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "Training").otherwise("Test").alias("set"), F.col("o_orderkey").alias("neighbour"))
    near = orders.withColumn("rank", F.row_number().over(Window.partitionBy("id", "set").orderBy("neighbour"))).filter("rank <= 3")
    details = F.struct(F.lit("balance").alias("modelName"), F.lit(2).alias("nFeatures"))
    return summaries.prediction_reports(results, c.drop("bal"), experiments, estimates, near, details, ("m", "dm"), lambda x: x * 10)
