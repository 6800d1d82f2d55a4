"""All queries of the engine on the test tables, with their SQL.

The tables play roles: customers are the clinical table (balance as time, segment as site),
orders are features over time, line items are replicated measurements (status as rater),
embeddings are wide features with a class, labels and documents give outcome and score,
events are a change feed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions import stats as S
from spindrift.operators import columns as C
from spindrift.operators import joins as J
from spindrift.operators import longitudinal as L

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, digits=4):
    return F.round(c, digits)


def _order_features(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count("*").alias("n_orders"), r(F.avg("o_totalprice")).alias("mean_price"))


@query(
    "with m as (select median(c_acctbal) as md from customer), "
    "f as (select o_custkey as patient_id, count(*) as n_orders, round(avg(o_totalprice), 4) as mean_price from orders group by o_custkey), "
    "c as (select c_custkey as patient_id, round(case when md > 100 then c_acctbal / 30.44 else c_acctbal end, 4) as OS_months, "
    "cast(case when c_nationkey < 12 then 1 else 0 end as integer) as OS_event, c_mktsegment from customer cross join m where c_acctbal is not null and c_mktsegment is not null) "
    "select f.patient_id, n_orders, mean_price, OS_months, OS_event, c_mktsegment from f join c on f.patient_id = c.patient_id"
)
def merge_outcome(spark, d):
    clinical = t(spark, d, "customer").withColumn("event", (F.col("c_nationkey") < 12).cast("int"))
    got = J.merge_outcome(_order_features(spark, d), clinical, "c_custkey", time="c_acctbal", event="event", outcome="c_mktsegment")
    return got.withColumn("OS_months", r("OS_months")).select("patient_id", "n_orders", "mean_price", "OS_months", "OS_event", "c_mktsegment")


@query(
    "with u as (select distinct c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 300000)) "
    "select count(*) as n_unmatched, (select list(id order by id) from (select id from u order by id limit 5) x) as sample from u"
)
def unmatched(spark, d):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    return J.unmatched(t(spark, d, "customer").select(F.col("c_custkey").alias("patient_id")), urgent.select(F.col("o_custkey").alias("patient_id")))


def _halves(spark, d):
    o = t(spark, d, "orders")
    tp = F.when(F.month("o_orderdate") <= 6, "early").otherwise("late")
    return o.groupBy(F.col("o_custkey").alias("patient_id"), tp.alias("timepoint")).agg(F.avg("o_totalprice").alias("v"))


@query(
    "with x as (select o_custkey as patient_id, case when month(o_orderdate)<=6 then 'early' else 'late' end as tp, avg(o_totalprice) as v from orders group by 1,2) "
    "select patient_id, round(max(case when tp='late' then v end)-max(case when tp='early' then v end),4) as delta_v from x group by patient_id having count(distinct tp)=2"
)
def delta_pair(spark, d):
    return L.delta(_halves(spark, d), "late", "early", features=["v"]).withColumn("delta_v", r("delta_v"))


def _quarters(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string")).alias("timepoint")).agg(F.avg("o_totalprice").alias("v"))


_Q = "with x as (select o_custkey as patient_id, 'q' || cast(quarter(o_orderdate) as varchar) as tp, avg(o_totalprice) as v from orders group by 1,2), y as (select *, row_number() over (partition by patient_id order by tp) - 1 as i from x) "


@query(_Q + "select patient_id, round(regr_slope(v, i), 4) as slope_v from y group by patient_id having count(*) >= 2")
def trend_slope(spark, d):
    return L.slopes(_quarters(spark, d), features=["v"]).withColumn("slope_v", r("slope_v"))


@query(
    _Q
    + ", g as (select patient_id, max(case when tp='q1' then v end) as a, max(case when tp='q2' then v end) as b, max(case when tp='q4' then v end) as c, count(*) as n, case when count(*) >= 2 then regr_slope(v, i) end as s from y group by patient_id) "
    "select patient_id, round(b - a, 4) as h1_v, round(c - a, 4) as year_v, round(s, 4) as slope_v from g where n >= 2 or (a is not null and b is not null) or (a is not null and c is not null)"
)
def delta_multi(spark, d):
    got = L.differences(_quarters(spark, d), {"h1": ("q2", "q1"), "year": ("q4", "q1")}, features=["v"], trend=True)
    return got.select("patient_id", *[r(c).alias(c) for c in ("h1_v", "year_v", "slope_v")])


@query(
    "with a as (select o_custkey as patient_id, count(*) as n from orders where o_orderstatus = 'F' group by 1), b as (select c_custkey as patient_id, c_nationkey as nation from customer where c_acctbal > 0), "
    "e as (select user_id as patient_id, count(*) as n from events group by 1), "
    "ab as (select coalesce(a.patient_id, b.patient_id) as patient_id, a.n as ord_n, b.nation as cust_nation from a full outer join b on a.patient_id = b.patient_id) "
    "select coalesce(ab.patient_id, e.patient_id) as patient_id, ord_n, cust_nation, e.n as ev_n from ab full outer join e on ab.patient_id = e.patient_id"
)
def multi_engine_merge(spark, d):
    return J.merge_engines(
        {
            "ord": t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count("*").alias("n")),
            "cust": t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("nation")),
            "ev": t(spark, d, "events").groupBy(F.col("user_id").alias("patient_id")).agg(F.count("*").alias("n")),
        }
    )


@query(
    "select c_custkey as id, c_acctbal as f1, cast(null as integer) as f2 from customer union all select s_suppkey, cast(null as double), s_nationkey from supplier"
)
def union_rows(spark, d):
    return J.union_rows(
        t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("f1")),
        t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("f2")),
    )


@query(
    "with w as (select l_partkey as pid, avg(case when l_linestatus='O' then l_quantity end) as a, avg(case when l_linestatus='F' then l_quantity end) as b from lineitem group by l_partkey),"
    "g as (select a, b, (a+b)/2 as m from w where a is not null and b is not null), t as (select avg(m) as gm, avg(a) as ma, avg(b) as mb, count(*) as n from g),"
    "s as (select sum(2*(m-gm)*(m-gm))/(max(n)-1) as msr, sum((a-m-ma+gm)*(a-m-ma+gm)+(b-m-mb+gm)*(b-m-mb+gm))/(max(n)-1) as mse from g cross join t)"
    "select round((msr-mse)/(msr+mse),6) as icc3 from s"
)
def icc31(spark, d):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    return S.icc31(t(spark, d, "lineitem").groupBy("l_partkey").agg(side("O").alias("a"), side("F").alias("b")))


def _scores(spark, d):
    return t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("double").alias("y"), F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("p"))


_P = "with p as (select cast(l.quality as double) as y, least(cast(d.n_chars as double)/20000,cast(1 as double)) as p from labels l join documents d on l.doc_id=d.doc_id)"


@query(_P + " select round(avg((p-y)*(p-y)),6) as brier from p")
def brier(spark, d):
    return M.brier(_scores(spark, d))


@query(
    _P
    + ", e as (select i, cast(i as double)*cast(0.1 as double) as lo, case when i=9 then cast(1 as double) else cast(i+1 as double)*cast(0.1 as double) end as hi from (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) as v(i)),"
    " b as (select i, count(*) as n, avg(p) as pm, avg(y) as ym from p join e on p>=lo and (p<hi or (i=9 and p<=hi)) group by i)"
    " select round(sum(n*abs(pm-ym))/(select count(*) from p),6) as ece from b"
)
def ece(spark, d):
    return M.ece(_scores(spark, d))


@query(
    _P
    + ", r as (select y, rank() over (order by p) + (count(*) over (partition by p)-1)/cast(2 as double) as rk from p)"
    " select round((sum(rk*y)-sum(y)*(sum(y)+1)/2)/(sum(y)*(count(*)-sum(y))),6) as auc from r"
)
def auc(spark, d):
    return M.auc(_scores(spark, d))


@query(
    _P
    + ", g as (select p, sum(y) as tp, count(*) as n from p group by p),"
    " c as (select tp, sum(tp) over w as ctp, sum(n) over w as cn, sum(tp) over () as pos from g window w as (order by p desc range between unbounded preceding and current row))"
    " select round(sum(tp/pos*ctp/cn),6) as ap from c"
)
def average_precision(spark, d):
    return M.average_precision(_scores(spark, d))


@query(
    _P
    + ", g as (select p, sum(y) as tp, sum(1-y) as fp from p group by p),"
    " c as (select p, sum(tp) over w/sum(tp) over () - sum(fp) over w/sum(fp) over () as j from g window w as (order by p desc range between unbounded preceding and current row))"
    " select round(p,6) as threshold, round(j,6) as youden_j from (select p, j, row_number() over (order by j desc, p desc) as rn from c) z where rn=1"
)
def youden(spark, d):
    return M.youden(_scores(spark, d))


@query(
    _P
    + ", t as (select cast(x as double) as threshold from (values (0.1),(0.2),(0.3),(0.4),(0.5)) as v(x)),"
    " g as (select threshold, count(*) as n, sum(case when p>=threshold then y else 0 end) as tp, sum(case when p>=threshold then 1-y else 0 end) as fp, avg(y) as prev from p cross join t group by threshold),"
    " k as (select threshold, tp/n-fp/n*(threshold/(1-threshold)) as nb, prev-(1-prev)*(threshold/(1-threshold)) as ta from g)"
    " select threshold, round(nb,4) as net_benefit, round(ta,4) as treat_all, nb>greatest(ta,cast(0 as double)) as beats_default from k"
)
def net_benefit(spark, d):
    return M.net_benefit(_scores(spark, d))


@query(_P + " select round(cast(sum(case when (p>=0.1)=(y=1) then 1 else 0 end) as double)/count(*),6) as accuracy, round(cast(sum(case when p>=0.1 and y=1 then 1 else 0 end) as double)/sum(y),6) as sensitivity, round(cast(sum(case when p<0.1 and y=0 then 1 else 0 end) as double)/sum(1-y),6) as specificity from p")
def at_threshold(spark, d):
    return M.at_threshold(_scores(spark, d), 0.1)


@query(
    _P
    + ", x as (select cast(y as integer) as y, case when p>=0.02 then 1 else 0 end as pred from p), k as (select unnest([0,1]) as class),"
    " g as (select class, sum(case when y=class and pred=class then 1 else 0 end) as hit, sum(case when y=class then 1 else 0 end) as support, sum(case when pred=class then 1 else 0 end) as called from x cross join k group by class)"
    " select class, round(cast(hit as double)/called,6) as precision, round(cast(hit as double)/support,6) as recall, round(cast(2*hit as double)/(called+support),6) as f1, cast(support as bigint) as support from g"
)
def class_report(spark, d):
    return M.class_report(_scores(spark, d).select(F.col("y").cast("int").alias("y"), (F.col("p") >= 0.02).cast("int").alias("pred")))


@query(
    "with r as (select c_mktsegment as g, rank() over (order by c_acctbal)+(count(*) over (partition by c_acctbal)-1)/cast(2 as double) as rk, cast(count(*) over (partition by c_acctbal) as double) as tie from customer),"
    "n as (select cast(count(*) as double) as nn, 1-sum(tie*tie-1)/(count(*)*(cast(count(*) as double)*count(*)-1)) as tc from r),"
    "h as (select g, sum(rk)*sum(rk)/count(*) as q from r group by g)"
    "select round((cast(12 as double)/(max(nn)*(max(nn)+1))*sum(q)-3*(max(nn)+1))/max(tc),4) as h, cast(count(*)-1 as integer) as df from h cross join n"
)
def kruskal_h(spark, d):
    return S.kruskal_h(t(spark, d, "customer"), "c_acctbal", "c_mktsegment")


@query(
    "with x as (select c_acctbal as r, count(*) as t, max(case when o_orderstatus='F' then 1 else 0 end) as e from customer join orders on c_custkey=o_custkey where c_custkey<=300 group by c_custkey, c_acctbal)"
    "select round(sum(case when a.r>b.r then cast(1 as double) when a.r=b.r then cast(0.5 as double) else cast(0 as double) end)/count(*),6) as c_index from x a join x b on a.e=1 and a.t<b.t"
)
def cindex(spark, d):
    x = t(spark, d, "customer").where("c_custkey <= 300").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.groupBy("c_custkey", F.col("c_acctbal").alias("risk")).agg(F.count("*").alias("time"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("event"))
    return M.concordance(x)


@query(
    "with x as (select o_orderkey, o_totalprice as y, cast(day(o_orderdate) as double) as c from orders), g as (select regr_slope(y, c) as b, regr_intercept(y, c) as a, avg(y) as m from x) "
    "select o_orderkey, round(y - (a + b*c) + m, 2) as o_totalprice from x cross join g"
)
def residualize(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.dayofmonth("o_orderdate").cast("double").alias("day"))
    return S.residualize(o, ["o_totalprice"], ["day"]).select("o_orderkey", r("o_totalprice", 2).alias("o_totalprice"))


@query(
    "with x as (select c_custkey, c_mktsegment as site, c_acctbal as v from customer),"
    " b as (select site, avg(v) as m, count(*) as n from x group by site), g as (select sum(m*n)/sum(n) as gm from b),"
    " pv as (select avg((v-m)*(v-m)) as pv from x join b on x.site=b.site),"
    " z as (select c_custkey, x.site, (v-gm)/sqrt(pv) as z, gm, pv from x cross join g cross join pv),"
    " k as (select site, avg(z) as gh, var_pop(z) as dh from z group by site)"
    " select c_custkey, round((z-gh)/sqrt(dh)*sqrt(pv)+gm,4) as v_h from z join k on z.site=k.site"
)
def combat_ls(spark, d):
    return S.combat(t(spark, d, "customer"), ["c_acctbal"], "c_mktsegment", eb=False).select("c_custkey", r("c_acctbal").alias("v_h"))


@query(
    "with x as (select c_custkey, cast(count(*) as double) as t, max(case when o_orderstatus='F' and o_orderpriority='1-URGENT' then 1 else 0 end) as e from customer join orders on c_custkey=o_custkey group by c_custkey),"
    "d as (select t, cast(sum(e) as double) as d, cast(count(*) as double) as n from x group by t),"
    "r as (select t, d, sum(n) over (order by t desc rows between unbounded preceding and current row) as at_risk from d)"
    "select t, round(exp(sum(ln(1-d/at_risk)) over (order by t rows between unbounded preceding and current row)),6) as s from r where d<at_risk"
)
def km_survival(spark, d):
    x = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("time"), F.max(((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int")).alias("event"))
    return S.kaplan_meier(x)


def _wide(spark, d, n=64):
    return t(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)])


@query(
    "with x as (select label, unnest(range(64)) as i, unnest(embedding) as v from embeddings) select 'f' || cast(i as varchar) as feature, round(abs(corr(cast(v as double), cast(label as double))), 6) as score from x group by i order by abs(corr(cast(v as double), cast(label as double))) desc, i limit 10"
)
def corr_topk(spark, d):
    w = _wide(spark, d)
    return S.correlation_with(w, [f"f{i}" for i in range(64)], "label").select("feature", F.abs("r").alias("s")).orderBy(F.desc("s"), "feature").limit(10).select("feature", r("s", 6).alias("score"))


@query(
    "with x as (select vec_id, unnest(range(8)) as i, unnest(embedding[1:8]) as v from embeddings) "
    "select 'f' || cast(a.i as varchar) as fa, 'f' || cast(b.i as varchar) as fb, round(corr(cast(a.v as double), cast(b.v as double)), 6) as r from x a join x b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i having abs(corr(cast(a.v as double), cast(b.v as double))) > 0.05"
)
def corr_prune_pairs(spark, d):
    m = S.correlations(_wide(spark, d, 8), [f"f{i}" for i in range(8)])
    rows = [(f"f{i}", f"f{j}", float(m[i, j])) for i in range(8) for j in range(i + 1, 8) if abs(m[i, j]) > 0.05]
    return spark.createDataFrame(rows, "fa string, fb string, r double").withColumn("r", r("r", 6))


@query("with x as (select c_custkey, case when c_custkey % 7 = 0 then null else c_acctbal end as v from customer) select c_custkey, coalesce(v, (select median(v) from x)) as v from x")
def median_impute(spark, d):
    x = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    return C.impute_median(x, ["v"])


@query(
    "with x as (select unnest(['a','b','c']) as feature, unnest([cast(c_acctbal as double), case when c_custkey % 5 = 0 then null else 1.0::double end, 2.0::double]) as v from customer) "
    "select feature, sum(case when v is null then 1 else 0 end)::bigint as missing, round(var_samp(v), 4) as variance from x group by feature"
)
def column_statistics(spark, d):
    x = t(spark, d, "customer").select(F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.lit(1.0)).alias("b"), F.lit(2.0).alias("c"))
    return C.column_statistics(x, ["a", "b", "c"]).withColumn("variance", r("variance"))


@query("select o_custkey as patient_id, round(avg(o_totalprice), 4) as price, min(o_orderkey) as first_key from orders group by o_custkey")
def group_mean_first(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(r(F.avg("o_totalprice")).alias("price"), F.min("o_orderkey").alias("first_key"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as k from orders) x where k = 1")
def largest_per_group(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("select o_custkey, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) as k from orders) x where k = 1")
def first_per_group(spark, d):
    return J.first_per(t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("select o_custkey, o_orderkey, k from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) x where k <= 3")
def top_n_per_group(spark, d):
    from pyspark.sql import Window

    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = J.top_per(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return top.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")).drop("o_totalprice")


@query("select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F'")
def series_intersection(spark, d):
    o = t(spark, d, "orders")
    return J.patients_with_both(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT' and o_totalprice > 200000)")
def series_semi(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


_A = "select cast(o_custkey as varchar) as case_id, o_orderpriority as feature, round(avg(o_totalprice), 6) as value from orders"


@query(
    f"with a as ({_A} where o_custkey % 3 <> 0 group by 1, 2), b as (select case_id, feature, case when cast(case_id as bigint) % 5 = 0 then value + 1 else value end as value from ({_A} where o_custkey % 4 <> 0 group by 1, 2) z) "
    "select coalesce(a.case_id, b.case_id) as case_id, coalesce(a.feature, b.feature) as feature, case when b.case_id is null then 'missing' when a.case_id is null then 'extra' else 'changed' end as status "
    "from a full outer join b on a.case_id = b.case_id and a.feature = b.feature where a.case_id is null or b.case_id is null or abs(a.value - b.value) > 1e-9 * greatest(1, abs(b.value))"
)
def case_compare(spark, d):
    g = lambda m: t(spark, d, "orders").where(F.col("o_custkey") % m != 0).groupBy(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("feature")).agg(r(F.avg("o_totalprice"), 6).alias("value"))
    b = g(4).withColumn("value", F.when(F.col("case_id").cast("long") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return J.compare_features(g(3), b).select("case_id", "feature", "status")


@query("select p_partkey, 'ANON-' || substr(sha1('pepper' || cast(p_partkey as varchar)), 1, 12) as pseudonym from part")
def pseudonym(spark, d):
    return t(spark, d, "part").select("p_partkey", C.pseudonym(F.col("p_partkey").cast("string"), "pepper").alias("pseudonym"))


@query("select event_id, cast(regexp_matches(lower(trim(event_type)), 'pur|click') as integer) as label, case when regexp_matches(lpad(cast(event_id as varchar), 6, '0'), '^[0-9]{6}$') then cast(substr(lpad(cast(event_id as varchar), 6, '0'), 1, 3) as integer) end as x from events")
def binary_label(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", F.lower(F.trim("event_type")).rlike("pur|click").cast("int").alias("label"), C.packed_xy(F.lpad(F.col("event_id").cast("string"), 6, "0"))["x"].alias("x"))


@query(
    "select o_orderkey, case when o_orderkey % 3 = 0 then printf('day%+d', cast(day(o_orderdate) as integer)) when o_orderkey % 3 = 1 then printf('fx%d', cast(month(o_orderdate) as integer)) else strftime(o_orderdate, '%Y-%m-%d') end as label from orders"
)
def timepoint_label(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey") % 3
    label = C.timepoint_label(F.when(k == 0, F.dayofmonth("o_orderdate")), F.when(k == 1, F.month("o_orderdate")), F.col("o_orderdate"), F.lit("study"))
    return o.select("o_orderkey", label.alias("label"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where json_extract(props, '$.k') is not null")
def json_flatten(spark, d):
    e = t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.where(F.col("m")["k"].isNotNull()).select("event_id", F.col("m")["k"].cast("bigint").alias("k"))


@query("select event_id, user_id, event_type from events where event_id > 1000 and event_type in ('click', 'purchase') and regexp_matches(props, '^.*1.*$')")
def watch_filter(spark, d):
    e = t(spark, d, "events").where((F.col("event_id") > 1000) & F.col("event_type").isin("click", "purchase"))
    return e.where(C.glob_match(F.col("props"), "*1*")).select("event_id", "user_id", "event_type")


@query(
    "with g as (select o_custkey as grp, dense_rank() over (order by o_custkey) % 5 as fold from (select distinct o_custkey from orders) x) select o_orderkey, fold from orders join g on o_custkey = grp"
)
def fold_assign(spark, d):
    from spindrift.models import cv

    return cv.ranked_folds(t(spark, d, "orders"), "o_custkey", 5).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


@query("with f as (select o_custkey, (o_orderkey / 32) % 4 as fold from orders) select o_custkey, count(distinct cast(floor(fold) as bigint)) as folds from f group by o_custkey having count(distinct cast(floor(fold) as bigint)) > 1")
def leak_check(spark, d):
    from spindrift.models import cv

    o = t(spark, d, "orders").select("o_custkey", F.floor((F.col("o_orderkey") / 32) % 4).alias("fold"))
    return cv.leaks(o, "o_custkey", "fold")


@query("select sum(quality)::bigint as events, round(sum(quality) / cast(8 as double), 4) as epv, case when sum(quality) / 8.0 >= 10 then 'PASS' when sum(quality) / 8.0 >= 5 then 'PARTIAL' else 'FAIL' end as verdict from labels")
def epv(spark, d):
    from spindrift.plans import qa

    return qa.events_per_variable(t(spark, d, "labels"), "quality", 8)


@query("select count(*) as n, round(avg(case when regexp_matches(p_name, '^[a-z]+ [a-z]+$') then 1.0::double else 0 end), 6) as fraction from part")
def naming_fraction(spark, d):
    return t(spark, d, "part").agg(F.count("*").alias("n"), r(F.avg(F.col("p_name").rlike("^[a-z]+ [a-z]+$").cast("double")), 6).alias("fraction"))


@query("select n_nationkey % 4 as site, count(*) as n, count(distinct c_mktsegment) as segments, round(median(c_acctbal), 4) as med, round(quantile_cont(c_acctbal, 0.025), 4) as lo, round(quantile_cont(c_acctbal, 0.975), 4) as hi, round(stddev_pop(c_acctbal), 4) as sd from customer join nation on c_nationkey = n_nationkey group by 1")
def group_summary(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = F.expr("percentile(c_acctbal, array(0.025, 0.975))")
    return c.groupBy((F.col("n_nationkey") % 4).alias("site")).agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"), r(F.median("c_acctbal")).alias("med"), q.alias("q"), r(F.stddev_pop("c_acctbal")).alias("sd")).select("site", "n", "segments", "med", r(F.col("q")[0]).alias("lo"), r(F.col("q")[1]).alias("hi"), "sd")


@query("select o_orderkey, cast(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') as date) as d from orders")
def date_parse(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"))


@query("select event_id, round(70000 / (370e6 * exp(-ln(2) * (event_id % 7200) / 6588)), 10) as factor from events")
def suv_factor(spark, d):
    one = lambda v: F.lit(float(v))
    f = C.suv_factor(one(70), F.lit("BQML"), (F.col("event_id") % 7200).cast("double"), one(0), one(6588), one(370e6), F.lit(None))
    return t(spark, d, "events").select("event_id", r(f["factor"], 10).alias("factor"))


@query("select o_orderkey, cast(o_totalprice >= (select median(o_totalprice) from orders) as integer) as high from orders")
def binarize_median(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", C.above_median(o, "o_totalprice").alias("high"))


@query("with s as (select l_suppkey, l_orderkey, count(*) as n from lineitem group by 1, 2) select o_orderkey as rt_id, (select max(l_suppkey) from s where s.l_orderkey = o_orderkey and s.n = (select max(n) from s s2 where s2.l_orderkey = o_orderkey)) as series_id from orders where o_orderkey % 10 = 0")
def referenced_series(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series_id"), F.col("l_orderkey").alias("study_id")).agg(F.count("*").alias("n"))
    rt = t(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("rt_id"), F.col("o_orderkey").alias("study_id"), F.lit(None).cast("long").alias("referenced"))
    return J.referenced_or_largest(rt, s).select("rt_id", "series_id")


def _survival_table(spark, d):
    e = _wide(spark, d, 12)
    return e.withColumn("OS_months", F.exp(-0.8 * F.col("f0")) * (1 + F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 100)).withColumn("OS_event", (F.col("vec_id") % 4 != 0).cast("int")).drop("label")


@query()
def cox_scan(spark, d):
    from spindrift.models import survival

    return survival.cox_scan(_survival_table(spark, d), exclude=["vec_id"])


@query()
def logit_scan(spark, d):
    from spindrift.models import classify

    return classify.logit_scan(_wide(spark, d, 12).withColumn("y", (F.col("label") < 5).cast("int")).drop("label"), "y", exclude=["vec_id"])


@query()
def boot_ci(spark, d):
    from spindrift.models import classify

    return classify.bootstrap_auc(_scores(spark, d), n_boot=500)


@query()
def cox_cv(spark, d):
    from spindrift.models import survival

    return survival.cross_validated_cox(_survival_table(spark, d), [f"f{i}" for i in range(12)], "OS_months", "OS_event", "vec_id")


@query()
def nested_cv(spark, d):
    from spindrift.models import classify

    e = _wide(spark, d, 6).withColumn("y", (F.col("label") < 5).cast("int"))
    return classify.nested_cv(e, [f"f{i}" for i in range(6)], "y", "vec_id", folds=3, inner=2)


@query()
def combat_eb(spark, d):
    c = t(spark, d, "customer").withColumn("other", F.col("c_acctbal") * 2 + F.col("c_custkey") % 13)
    got = S.combat(c, ["c_acctbal", "other"], "c_mktsegment", continuous=["c_nationkey"])
    return got.select("c_custkey", r("c_acctbal").alias("c_acctbal"), r("other").alias("other"))


@query()
def scorecard(spark, d):
    from spindrift.plans import qa

    e = qa.events_per_variable(t(spark, d, "labels"), "quality", 8).select(F.lit("C07").alias("check_id"), "verdict", F.lit(1.5).alias("weight"), F.lit(False).alias("gate"))
    names = naming_fraction(spark, d).select(F.lit("C17").alias("check_id"), F.when(F.col("fraction") > 0.9, "PASS").otherwise("PARTIAL").alias("verdict"), F.lit(0.8).alias("weight"), F.lit(True).alias("gate"))
    return qa.scorecard(e.unionAll(names))
