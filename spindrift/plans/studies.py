"""Further queries on the test tables, with their SQL: result summaries, folds, concordance,
scans over all features, training and evaluation.  Tables play the roles of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions import stats as S
from spindrift.functions import summaries as U
from spindrift.models import classify, cv, survival, train
from spindrift.plans.catalog import _P, ORACLES, _scores, _wide, query, r, t

_RISK = "x as (select c_custkey as id, c_acctbal as r, count(*) as t, max(case when o_orderstatus='F' then 1 else 0 end) as e from customer join orders on c_custkey=o_custkey group by c_custkey, c_acctbal)"
_PAIR = "sum(case when a.r>b.r then cast(1 as double) when a.r=b.r then cast(0.5 as double) else cast(0 as double) end)/count(*)"


def _risks(spark, d):
    x = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return x.groupBy("c_custkey", F.col("c_acctbal").alias("risk")).agg(F.count("*").alias("time"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("event"))


@query(f"with {_RISK} select round({_PAIR},6) as c_index from x a join x b on a.e=1 and a.t<b.t")
def cindex_all(spark, d):
    return M.concordance(_risks(spark, d))


@query(
    f"with {_RISK}, k as (select unnest(range(-1, 20)) as part),"
    f" c as (select part, round({_PAIR},6) as c from k, x a join x b on a.e=1 and a.t<b.t where a.id % 20 <> part and b.id % 20 <> part group by part),"
    " j as (select max(case when part=-1 then c end) as c, sqrt(var_pop(case when part>=0 then c end) * 19) as se from c)"
    " select c as c_index, round(se,6) as se, round(c-1.959963984540054*se,6) as ci_lo, round(c+1.959963984540054*se,6) as ci_hi from j"
)
def cindex_ci(spark, d):
    return M.concordance_ci(_risks(spark, d), "c_custkey")


@query(
    "with g as (select k, dense_rank() over (order by k) % 5 as fold from (select distinct c_mktsegment || '/' || cast(c_custkey as varchar) as k from customer) x) select c_custkey, fold from customer join g on c_mktsegment || '/' || cast(c_custkey as varchar) = k"
)
def fold_assign_text(spark, d):
    c = t(spark, d, "customer").withColumn("k", F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")))
    return cv.ranked_folds(c, "k", 5).select("c_custkey", F.col("fold").cast("long").alias("fold"))


@query("select 0::bigint as leaking, true as even, true as spread")
def fold_checks(spark, d):
    """Folds of text groups, a tenth of them NULL, dealt out by label: groups in several
    folds, whether the folds of each label's groups are even, and whether rows without a
    group reach all folds."""
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("g"), (F.col("o_custkey") % 3 == 0).cast("int").alias("y"))
    f = cv.group_folds(o, "g", 5, label="y")
    bad = cv.leaks(f.where("g is not null"), "g").agg(F.count("*").alias("leaking"))
    n = f.where("g is not null").groupBy("y", "fold").agg(F.countDistinct("g").alias("n")).groupBy("y").agg((F.max("n") - F.min("n") <= F.max("n") * 0.5 + 2).alias("ok")).agg(F.every("ok").alias("even"))
    alone = f.where("g is null").agg((F.countDistinct("fold") == 5).alias("spread"))
    return bad.crossJoin(n).crossJoin(alone)


_ICC = (
    "with w as (select l_suppkey % 40 as feature, l_partkey as pid, avg(case when l_linestatus='O' then l_quantity end) as a, avg(case when l_linestatus='F' then l_quantity end) as b from lineitem group by 1, 2),"
    " g as (select feature, cast(a as double) as a, cast(b as double) as b from w where a is not null and b is not null),"
    " i as (select feature, round((var_samp(a+b)/2 - var_samp(a-b)/2)/(var_samp(a+b)/2 + var_samp(a-b)/2), 6) as icc3 from g group by feature having count(*) > 1)"
)


def _iccs(spark, d):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity"))).cast("double")
    pairs = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("feature"), "l_partkey").agg(side("O").alias("a"), side("F").alias("b"))
    return S.icc31(pairs)


@query(_ICC + " select count(*) as n, round(avg(case when icc3 >= 0.75 then cast(1 as double) else 0 end),6) as good, round(avg(case when icc3 >= 0.9 then cast(1 as double) else 0 end),6) as excellent from i where icc3 is not null and not isnan(icc3)")
def icc_fractions(spark, d):
    return U.icc_fractions(_iccs(spark, d))


_SHIFT = "(select vec_id, unnest(range(64)) as i, unnest(embedding) as v from embeddings)"


@query(
    f"with x as {_SHIFT}, p as (select i, cast(v as double) as a, cast(v as double) + (i / 64.0)::double * ((vec_id * 31) % 17 - 8) / 8.0 as b from x)"
    " select 'f' || cast(i as varchar) as feature, round((var_samp(a+b) - var_samp(a-b))/(var_samp(a+b) + var_samp(a-b)), 6) as icc3 from p group by i having round((var_samp(a+b) - var_samp(a-b))/(var_samp(a+b) + var_samp(a-b)), 6) >= 0.75"
)
def stable_features(spark, d):
    w = _wide(spark, d)
    noise = (F.pmod(F.col("vec_id") * 31, F.lit(17)) - 8) / 8.0
    other = w.select("vec_id", *[(F.col(f"f{i}") + i / 64.0 * noise).alias(f"f{i}") for i in range(64)])
    return train.stable_features(w, other, [f"f{i}" for i in range(64)], "vec_id")


_FOLDS = "(select o_orderpriority as model, o_custkey % 5 as fold, cast(avg(case when o_orderstatus='F' then 1.0 else 0 end) as double) as auc, cast(max(o_totalprice) as double) as top, cast(mode(month(o_orderdate)) as integer) as depth from orders group by 1, 2)"


def _fold_table(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 5).alias("fold")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("auc"), F.max("o_totalprice").cast("double").alias("top"))


@query(f"select model, round(avg(auc),6) as auc_mean, round(stddev_pop(auc),6) as auc_std, round(avg(top),6) as top_mean, round(stddev_pop(top),6) as top_std from {_FOLDS} x group by model")
def fold_summary(spark, d):
    return U.mean_std(_fold_table(spark, d), ["auc", "top"], ["model"])


@query(f"select model, round(avg(auc),4) as auc_mean, round(stddev_pop(auc),4) as auc_std from {_FOLDS} x group by model")
def repeat_summary(spark, d):
    return U.mean_std(_fold_table(spark, d), ["auc"], ["model"], digits=4)


_MODE = "(select o_orderpriority, {c} as v, row_number() over (partition by o_orderpriority order by count(*) desc, {c}) as k from orders group by o_orderpriority, {c})"


@query(
    f"select a.o_orderpriority, a.v as month, b.v as o_orderstatus from {_MODE.format(c='month(o_orderdate)')} a join {_MODE.format(c='o_orderstatus')} b on a.o_orderpriority = b.o_orderpriority where a.k = 1 and b.k = 1"
)
def modal_params(spark, d):
    return U.modal(t(spark, d, "orders").withColumn("month", F.month("o_orderdate")), ["month", "o_orderstatus"], ["o_orderpriority"])


_Z = 1.959963984540054


@query(
    f"with p as (select cast(count(*) as double) as n, avg(case when n_chars > 1000 then cast(quality = 1 as integer) else cast(quality = 0 as integer) end) as a from labels join documents using (doc_id)),"
    f" m as (select a, (a + {_Z * _Z / 2}/n)/(1+{_Z * _Z}/n) as mid, {_Z}/(1+{_Z * _Z}/n)*sqrt(a*(1-a)/n+{_Z * _Z / 4}/(n*n)) as half from p) select round(a,6) as accuracy, round(mid-half,6) as ci_lo, round(mid+half,6) as ci_hi from m"
)
def accuracy_ci(spark, d):
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id")
    return U.accuracy_interval(x.select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("pred")))


@query("select count(toxic) as rows, count(*) filter (where toxic = 1) as events, round(avg(cast(toxic as double)),6) as prevalence from labels")
def prevalence(spark, d):
    return U.prevalence(t(spark, d, "labels"), "toxic")


@query("select o_orderpriority, count(*) as n, count(distinct o_totalprice) as distinct, round(median(o_totalprice),4) as median, round(quantile_cont(o_totalprice,0.1),4) as q10, round(quantile_cont(o_totalprice,0.9),4) as q90 from orders group by 1".replace(" as distinct", ' as "distinct"'))
def group_quantiles(spark, d):
    return U.group_summary(t(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double")), "o_orderpriority", "o_totalprice")


@query("select o_custkey, round(avg(o_totalprice),4) as o_totalprice, round(avg(o_orderkey),4) as o_orderkey, min_by(o_orderpriority, o_orderkey) as o_orderpriority from orders group by o_custkey")
def group_means(spark, d):
    return U.group_means(t(spark, d, "orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"], ["o_orderpriority"], ["o_orderkey"])


@query("select event_type as status, count(*) as n, coalesce(sum(length(props)), 0)::bigint as bytes from events group by 1")
def status_counts(spark, d):
    return U.status_counts(t(spark, d, "events").select(F.col("event_type").alias("status"), F.char_length("props").alias("size")), size="size")


@query(
    'with x as (select o_orderpriority as "case", cast(o_totalprice as double) as a, cast(o_totalprice as double) + (o_orderkey % 3) as b from orders)'
    ' select "case", count(*) as n, count(*) filter (where a = b) as equal, round(max(abs(a-b)),6) as max_abs, round(max(abs(a-b)/greatest(abs(a),abs(b))),6) as max_rel from x group by 1'
)
def sweep_summary(spark, d):
    a = F.col("o_totalprice").cast("double")
    return U.sweep_summary(t(spark, d, "orders").select(F.col("o_orderpriority").alias("case"), a.alias("a"), (a + F.col("o_orderkey") % 3).alias("b")))


@query(
    "with x as (select c_acctbal as a, cast(c_nationkey as double) as b from customer),"
    " k as (select rank() over (order by a) + (count(*) over (partition by a)-1)/cast(2 as double) as ra, rank() over (order by b) + (count(*) over (partition by b)-1)/cast(2 as double) as rb from x) select round(corr(ra, rb),6) as rho from k"
)
def spearman(spark, d):
    return U.spearman(t(spark, d, "customer"), "c_acctbal", "c_nationkey")


@query(f"select model, round(auc,6) as auc from (select model, avg(auc) as auc from {_FOLDS} x group by model) y order by auc desc, model")
def leaderboard(spark, d):
    m = _fold_table(spark, d).groupBy("model").agg(F.avg("auc").alias("auc"))
    return U.ranked(m, "auc").withColumn("auc", r("auc", 6))


@query(f"select fold, model, round(auc,6) as auc from (select *, row_number() over (partition by fold order by auc desc, model) as k from {_FOLDS} x) y where k = 1")
def best_model(spark, d):
    return U.best(_fold_table(spark, d), "auc", ["fold"]).select("fold", "model", r("auc", 6).alias("auc"))


_IMPORTANCE = f"(select case when i % 2 = 0 then 'even' else 'odd' end as method, 'f' || cast(i as varchar) as feature, round(abs(avg(cast(v as double))),6) as importance from {_SHIFT} x group by i)"


@query(f"select method, feature, importance from (select *, row_number() over (partition by method order by importance desc, feature) as k from {_IMPORTANCE} x) y where k <= 5 order by method, importance desc, feature")
def importance_order(spark, d):
    w = _wide(spark, d)
    means = w.agg(*[r(F.abs(F.avg(f"f{i}")), 6).alias(f"f{i}") for i in range(64)])
    long = means.select(F.explode(F.array(*[F.struct(F.lit("even" if i % 2 == 0 else "odd").alias("method"), F.lit(f"f{i}").alias("feature"), F.col(f"f{i}").alias("importance")) for i in range(64)])).alias("x")).select("x.*")
    return U.by_method(long, top=5)


@query('select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as "slice" from lineitem')
def slice_index(spark, d):
    return U.slice_index(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").withColumn("slice", F.col("slice").cast("long"))


@query("select o_orderkey, cast(o_custkey as varchar) || case when k > 1 then '-' || cast(k - 1 as varchar) else '' end as name from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) x")
def case_names(spark, d):
    return U.numbered_names(t(spark, d, "orders"), "o_custkey", ["o_orderkey"], "name").select("o_orderkey", "name")


@query("select cast(count(*) filter (where toxic = 1) as bigint) as positives, cast(least(3 * count(*) filter (where toxic = 1), count(*) filter (where toxic = 0)) as bigint) as negatives from labels where doc_id is not null and toxic is not null")
def negatives_sampled(spark, d):
    got = U.sampled_negatives(t(spark, d, "labels").where("doc_id is not null and toxic is not null"), "toxic", "doc_id")
    return got.agg(F.count_if(F.col("toxic") == 1).alias("positives"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("negatives"))


@query("select unnest(['c_custkey', 'c_nationkey']) as feature")
def shared_features(spark, d):
    c, s = t(spark, d, "customer"), t(spark, d, "supplier")
    both = U.shared_columns(c, s.withColumnsRenamed({"s_suppkey": "c_custkey", "s_nationkey": "c_nationkey"}))
    return spark.createDataFrame([(f,) for f in both], "feature string")


@query(
    "with z as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as z from lineitem where l_orderkey % 3 = 0)"
    " select l.l_orderkey, l.l_linenumber, z from lineitem l join z on z.l_orderkey = l.l_orderkey and z.l_linenumber = l.l_linenumber where z < 4"
)
def position_lookup(spark, d):
    key = F.concat_ws(":", "l_orderkey", "l_linenumber").alias("uid")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key)
    z = U.slice_index(x.where("l_orderkey % 3 = 0"), "l_orderkey", "l_linenumber").withColumnRenamed("slice", "z")
    return U.with_positions(x, z, "uid", "z", high=4).select("l_orderkey", "l_linenumber", F.col("z").cast("long").alias("z"))


@query("select c_custkey, coalesce(m, 0) as score from customer left join (select o_custkey, avg(cast(o_totalprice as double)) as m from orders where o_orderpriority = '1-URGENT' group by 1) x on o_custkey = c_custkey".replace("coalesce(m, 0)", "round(coalesce(m, 0), 4)"))
def mean_lookup(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("double").alias("score"))
    return U.with_mean(t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "score").withColumn("score", r("score"))


@query(
    "with v as (select 'p' || cast(p_partkey as varchar) as tag, cast(p_retailprice as double) as x from part where p_partkey % 5 <> 0), e as (select 'p' || cast(p_partkey as varchar) as tag, cast(p_retailprice as double) * (1 + (p_partkey % 7) / 1000.0) as expected, cast(1 as double) as tolerance from part)"
    " select e.tag, coalesce(abs(round(x / pow(10, floor(log10(x)) - 2)) * pow(10, floor(log10(x)) - 2) - round(expected / pow(10, floor(log10(expected)) - 2)) * pow(10, floor(log10(expected)) - 2)) <= tolerance + 1e-12, false) as passes from e left join v on v.tag = e.tag"
)
def parity(spark, d):
    p = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("tag"), F.col("p_partkey").alias("k"), F.col("p_retailprice").cast("double").alias("x"))
    ours = p.where("k % 5 <> 0").select("tag", F.col("x").alias("value"))
    return U.parity(ours, p.select("tag", (F.col("x") * (1 + (F.col("k") % 7) / 1000.0)).alias("expected"), F.lit(1.0).alias("tolerance"))).select("tag", "passes")


@query(
    "with x as (select o_orderkey, cast(o_totalprice as double) as y, cast(day(o_orderdate) as double) as c from orders), g as (select regr_slope(y, c) as b, avg(c) as m from x)"
    " select o_orderkey, round(y - b*(c - m), 2) as f_price, c from x cross join g"
)
def sanitize_table(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("f_price"), F.lit(3.0).alias("f_flat"), F.when(F.col("o_orderkey") % 9 != 0, 1.0 * F.col("o_orderkey")).alias("f_gaps"), F.dayofmonth("o_orderdate").cast("double").alias("c"))
    got, _ = train.sanitize(o, ["f_price", "f_flat", "f_gaps"], confounders=["c"])
    return got.withColumn("f_price", r("f_price", 2))


@query(
    "select * from (select count(*) as n from labels join documents using (doc_id)) a cross join ({auc}) b cross join ({average_precision}) c cross join ({brier}) e cross join ({ece}) f cross join ({at_threshold}) g".format(**{k: ORACLES[k] for k in ("auc", "average_precision", "brier", "ece", "at_threshold")})
)
def evaluate_scores(spark, d):
    return train.evaluate(_scores(spark, d), 0.1)


@query(_P + ", r as (select y, rank() over (order by p) + (count(*) over (partition by p)-1)/cast(2 as double) as rk from p) select round((sum(rk*y)-sum(y)*(sum(y)+1)/2)/(sum(y)*(count(*)-sum(y))),6) as auc, true as inside, cast(400 as bigint) as n_boot from r")
def auc_interval(spark, d):
    """The area itself, whether the interval holds it, and the replicates."""
    b = classify.bootstrap_auc(_scores(spark, d), n_boot=400)
    return b.select(r("auc", 6).alias("auc"), ((F.col("ci_lo") < F.col("auc")) & (F.col("auc") < F.col("ci_hi")) & (F.col("ci_hi") - F.col("ci_lo") < 0.5)).alias("inside"), "n_boot")


def _newton_logit(steps: int = 9) -> str:
    """Newton's method for all features at once, unrolled."""
    sql = "with x as (select i, cast(v as double) as v, case when label < 5 then cast(1 as double) else 0 end as y from (select vec_id, label, unnest(range(64)) as i, unnest(embedding) as v from embeddings) z), b0 as (select i, cast(0 as double) as a, cast(0 as double) as b from x group by i)"
    for k in range(steps):
        sql += (
            f", s{k} as (select i, any_value(a) as a, any_value(b) as b, sum(p*(1-p)) as w, sum(p*(1-p)*v) as wx, sum(p*(1-p)*v*v) as wxx, sum(y-p) as g, sum((y-p)*v) as gx from (select x.i, v, y, a, b, 1/(1+exp(-(a+b*v))) as p from x join b{k} on x.i = b{k}.i) q group by i)"
            f", b{k + 1} as (select i, a + (wxx*g - wx*gx)/(w*wxx - wx*wx) as a, b + (w*gx - wx*g)/(w*wxx - wx*wx) as b from s{k})"
        )
    return sql + f" select 'f' || cast(i as varchar) as feature, round(b,5) as coef from b{steps}"


@query(_newton_logit())
def logit_scan_all(spark, d):
    w = _wide(spark, d).withColumn("y", (F.col("label") < 5).cast("int")).drop("label")
    return classify.logit_scan(w, "y", exclude=["vec_id"]).select("feature", r("coef", 5).alias("coef"))


def _newton_cox(steps: int = 9) -> str:
    """The same for Cox models; equal times as Breslow does."""
    sql = "with x as (select i, cast(v as double) as v, vec_id % 4 <> 0 as e, vec_id * 7919 % 1000003 as t from (select vec_id, unnest(range(64)) as i, unnest(embedding) as v from embeddings) z), b0 as (select i, cast(0 as double) as b from x group by i)"
    for k in range(steps):
        sql += (
            f", s{k} as (select i, b, v, e, sum(w) over o as s0, sum(w*v) over o as s1, sum(w*v*v) over o as s2 from (select x.i, v, e, t, b, exp(b*v) as w from x join b{k} on x.i = b{k}.i) q window o as (partition by i order by t desc range between unbounded preceding and current row))"
            f", b{k + 1} as (select i, any_value(b) + sum(v - s1/s0)/sum(s2/s0 - (s1/s0)*(s1/s0)) as b from s{k} where e group by i)"
        )
    return sql + f" select 'f' || cast(i as varchar) as feature, round(b,5) as coef, round(exp(b),5) as hr from b{steps}"


@query(_newton_cox())
def cox_scan_all(spark, d):
    w = _wide(spark, d).withColumn("time", F.pmod(F.col("vec_id") * 7919, F.lit(1000003)).cast("double")).withColumn("event", (F.col("vec_id") % 4 != 0).cast("int")).drop("label")
    return survival.cox_scan(w, "time", "event", exclude=["vec_id"], ties="breslow").select("feature", r("coef", 5).alias("coef"), r("hr", 5).alias("hr"))


def _classes(spark, d, n=12):
    return _wide(spark, d, n).withColumnRenamed("vec_id", "patient_id").withColumn("y", (F.col("label") < 5).cast("int"))


@query()
def train_predict(spark, d):
    """(patient_id, proba) of a model trained with folds."""
    model, _ = train.train(_classes(spark, d).drop("label"), "y", folds=3)
    return model.predict(_classes(spark, d)).withColumn("proba", r("proba", 6))


@query()
def train_predict_classes(spark, d):
    e = _classes(spark, d, 8).withColumn("y", F.col("label") % 3).drop("label")
    model, _ = train.train(e, "y", folds=2)
    return model.predict(e)


@query()
def feature_importance(spark, d):
    return train.importance(_classes(spark, d, 8).drop("label"), "y", trees=50, repeats=3)


@query()
def external_scores(spark, d):
    e = _classes(spark, d, 8).drop("label")
    return train.evaluate(train.external(e.where("patient_id % 3 > 0"), e.where("patient_id % 3 = 0 and patient_id % 2 = 0"), "y", calibration=e.where("patient_id % 3 = 0 and patient_id % 2 = 1"), weight=2))
