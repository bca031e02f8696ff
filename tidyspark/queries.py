"""The catalogue: one query per operator family over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidyspark as t
from tidyspark import c, f

from .plans.tbl import Tbl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> Tbl:
    return Tbl(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    """Register; the function's parameters after none are the tables it reads, by name."""

    def deco(fn):
        tables = fn.__code__.co_varnames[: fn.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .session import ship_package

            ship_package(spark)
            out = fn(*(_table(spark, sf_dir, n) for n in tables))
            return out.df.select(*out.columns) if isinstance(out, Tbl) else out

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


# ---- core ----


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 4) as avg_qty, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def q1_pricing(lineitem):
    return (
        lineitem
        >> t.filter_(f.l_shipdate <= "1998-09-02")
        >> t.mutate(disc=f.l_extendedprice * (1 - f.l_discount))
        >> t.group_by(f.l_returnflag, f.l_linestatus)
        >> t.summarise(sum_qty=t.round_(t.sum_(f.l_quantity), digits=2), sum_base=t.round_(t.sum_(f.l_extendedprice), digits=2), sum_disc=t.round_(t.sum_(f.disc), digits=2), avg_qty=t.round_(t.mean(f.l_quantity), digits=4), n=t.n(), _groups="drop")
    )


@query("select c_custkey, c_name as name, c_acctbal from customer")
def select_rename(customer):
    return customer >> t.select(f.c_custkey, f.c_acctbal, name=f.c_name)


@query("select c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal from customer")
def relocate(customer):
    return customer >> t.relocate(f.c_mktsegment, _before=f.c_custkey)


@query("select c_custkey, c_acctbal * 2 as twice, c_acctbal * 2 + 1 as more from customer")
def transmute(customer):
    return customer >> t.transmute(f.c_custkey, twice=f.c_acctbal * 2, more=f.twice + 1)


@query("select c_acctbal, c_acctbal / 2 as half from customer")
def mutate_keep_used(customer):
    return customer >> t.mutate(half=f.c_acctbal / 2, _keep="used")


@query("select * from orders where o_totalprice between 50000 and 100000 and o_orderstatus <> 'P'")
def filter_between(orders):
    return orders >> t.filter_(t.between(f.o_totalprice, 50000, 100000), f.o_orderstatus != "P")


@query("select o_orderkey, s from (select o_orderkey, nullif(o_orderstatus, 'P') as s from orders) where s is null or s <> 'F'")
def filter_na_logic(orders):
    return orders >> t.transmute(f.o_orderkey, s=t.na_if(f.o_orderstatus, "P")) >> t.filter_(f.s != "F")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_cols(lineitem):
    return lineitem >> t.distinct(f.l_returnflag, f.l_linestatus)


@query("select event_type, event_id, user_id from (select *, row_number() over (partition by event_type order by event_id) as r from events) where r = 1")
def distinct_keep_all(events):
    return events >> t.arrange(f.event_id) >> t.distinct(f.event_type, _keep_all=True) >> t.select(f.event_type, f.event_id, f.user_id)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def arrange_top(orders):
    return orders >> t.select(f.o_orderkey, f.o_totalprice) >> t.arrange(t.desc(f.o_totalprice), f.o_orderkey) >> t.head(20)


@query("select c_custkey, c_nationkey, c_mktsegment from customer")
def tidyselect(customer):
    return customer >> t.select(t.ends_with("key"), t.contains("segment"))


@query("select c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def select_negative(customer):
    return customer >> t.select(~c[f.c_custkey])


@query("select c_custkey as C_CUSTKEY, c_name as C_NAME, c_nationkey as C_NATIONKEY, c_acctbal as C_ACCTBAL, c_mktsegment as C_MKTSEGMENT from customer")
def rename_with(customer):
    return customer >> t.rename_with(str.upper)


# ---- aggregation ----


@query("select o_orderstatus, count(*) as n from orders group by all")
def count(orders):
    return orders >> t.count(f.o_orderstatus)


@query("select o_orderstatus, round(sum(o_totalprice), 2) as total from orders group by all")
def count_wt(orders):
    return orders >> t.count(f.o_orderstatus, wt=f.o_totalprice, name="total") >> t.mutate(total=t.round_(f.total, digits=2))


@query("select o_orderpriority, count(*) as n from orders group by all")
def tally(orders):
    return orders >> t.group_by(f.o_orderpriority) >> t.tally()


@query("select o_orderkey, o_custkey, count(*) over (partition by o_custkey) as n from orders")
def add_count(orders):
    return orders >> t.select(f.o_orderkey, f.o_custkey) >> t.add_count(f.o_custkey) >> t.ungroup()


@query("select event_type, count(distinct user_id) as users from events group by all")
def n_distinct(events):
    return events >> t.group_by(f.event_type) >> t.summarise(users=t.n_distinct(f.user_id))


@query("select l_returnflag, round(avg(l_quantity), 4) as l_quantity, round(avg(l_discount), 6) as l_discount from lineitem group by all")
def across_mean(lineitem):
    return lineitem >> t.group_by(f.l_returnflag) >> t.summarise(t.across([f.l_quantity, f.l_discount], t.mean)) >> t.mutate(l_quantity=t.round_(f.l_quantity, digits=4), l_discount=t.round_(f.l_discount, digits=6))


@query("select l_orderkey, l_linenumber, l_tax from lineitem where l_discount > 0.07 or l_tax > 0.07")
def if_any(lineitem):
    return lineitem >> t.filter_(t.if_any([f.l_discount, f.l_tax], lambda x: x > 0.07)) >> t.select(f.l_orderkey, f.l_linenumber, f.l_tax)


@query("select l_orderkey, l_linenumber from lineitem where l_discount > 0.05 and l_tax > 0.05")
def if_all(lineitem):
    return lineitem >> t.filter_(t.if_all([f.l_discount, f.l_tax], lambda x: x > 0.05)) >> t.select(f.l_orderkey, f.l_linenumber)


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) as p90, round(median(l_extendedprice), 4) as mid from lineitem group by all")
def quantile_median(lineitem):
    return lineitem >> t.group_by(f.l_returnflag) >> t.summarise(p90=t.round_(t.quantile(f.l_extendedprice, probs=0.9), digits=4), mid=t.round_(t.median(f.l_extendedprice), digits=4))


@query("select l_returnflag, round(var_samp(l_quantity), 4) as v, round(stddev_samp(l_quantity), 4) as s, round(sum(l_quantity * l_tax) / sum(l_tax), 4) as wm, round(covar_samp(l_quantity, l_extendedprice), 2) as cv from lineitem group by all")
def var_sd_cov(lineitem):
    return lineitem >> t.group_by(f.l_returnflag) >> t.summarise(v=t.round_(t.var(f.l_quantity), digits=4), s=t.round_(t.sd(f.l_quantity), digits=4), wm=t.round_(t.weighted_mean(f.l_quantity, f.l_tax), digits=4), cv=t.round_(t.cov(f.l_quantity, f.l_extendedprice), digits=2))


@query("select event_type, arg_min(user_id, event_id) as a, arg_max(user_id, event_id) as z, list(user_id order by event_id)[3] as third from events group by all")
def first_last_nth(events):
    return events >> t.group_by(f.event_type) >> t.summarise(a=t.first(f.user_id, order_by=f.event_id), z=t.last(f.user_id, order_by=f.event_id), third=t.nth(f.user_id, 2, order_by=f.event_id))


@query("select event_type, round(unnest(quantile_cont(value, [0.25, 0.5, 0.75])), 6) as q from events group by event_type")
def reframe_quantiles(events):
    return events >> t.group_by(f.event_type) >> t.reframe(q=t.quantile(f.value, probs=[0.25, 0.5, 0.75])) >> t.mutate(q=t.round_(f.q, digits=6))


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by all""")
def table_crosstab(orders):
    return orders >> t.table(f.o_orderpriority, f.o_orderstatus)


@query("select o_orderstatus, sum(n)::bigint as total from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all) group by all")
def drop_last_regroup(orders):
    return orders >> t.group_by(f.o_orderstatus, f.o_orderpriority) >> t.summarise(n=t.n()) >> t.summarise(total=t.sum_(f.n))


@query("select l_returnflag, round(avg(l_tax), 6) as m, round(avg(l_tax), 6) * 2 as twice from lineitem group by all")
def summarise_self_reference(lineitem):
    return lineitem >> t.group_by(f.l_returnflag) >> t.summarise(m=t.round_(t.mean(f.l_tax), digits=6), twice=f.m * 2)


@query("select date_trunc('day', ts) as ts, count(*) as n from events group by 1")
def grouper_day(events):
    return events >> t.group_by(t.Grouper(f.ts, "1 day")) >> t.summarise(n=t.n())


# ---- windows ----


@query("select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 8) as share from orders")
def grouped_share(orders):
    return orders >> t.group_by(f.o_custkey) >> t.mutate(share=t.round_(f.o_totalprice / t.sum_(f.o_totalprice), digits=8)) >> t.ungroup() >> t.select(f.o_orderkey, f.share)


@query("select o_orderkey, round(o_totalprice / (select sum(o_totalprice) from orders), 10) as share from orders")
def overall_share(orders):
    return orders >> t.transmute(f.o_orderkey, share=t.round_(f.o_totalprice / t.sum_(f.o_totalprice), digits=10))


@query("""select event_id, (row_number() over w)::int as rn, (rank() over v)::int as mr, (dense_rank() over v)::int as dr from events window w as (partition by user_id order by event_id), v as (partition by user_id order by event_type)""")
def ranks(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.mutate(rn=t.row_number(), mr=t.min_rank(f.event_type), dr=t.dense_rank(f.event_type)) >> t.ungroup() >> t.select(f.event_id, f.rn, f.mr, f.dr)


@query("""with r as (select event_id, user_id, event_type, rank() over (partition by user_id order by event_type) as r, count(*) over (partition by user_id) as n, cume_dist() over (partition by user_id order by event_type) as cd from events)
select event_id, case when max(r) over (partition by user_id) > 1 then round((r - 1)::double / (max(r) over (partition by user_id) - 1), 8) end as pr, round(cd, 8) as cd, (floor((r - 1) * least(4, n) / n) + 1)::bigint as nt from r""")
def percent_ntile(events):
    return events >> t.group_by(f.user_id) >> t.mutate(pr=t.round_(t.percent_rank(f.event_type), digits=8), cd=t.round_(t.cume_dist(f.event_type), digits=8), nt=t.as_integer(t.ntile(f.event_type, n=4))) >> t.ungroup() >> t.select(f.event_id, f.pr, f.cd, f.nt)


@query("""select event_id, lead(value) over w as nx, lag(value, 2, 0.0) over w as pv, round(sum(value) over (w rows unbounded preceding), 4) as cs, round(avg(value) over (w rows unbounded preceding), 10) as cm, max(value) over (w rows unbounded preceding) as cx from events window w as (partition by user_id order by event_id)""")
def offsets_cumulative(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.mutate(nx=t.lead(f.value), pv=t.lag(f.value, n=2, default=0.0), cs=t.round_(t.cumsum(f.value), digits=4), cm=t.round_(t.cummean(f.value), digits=10), cx=t.cummax(f.value)) >> t.ungroup() >> t.select(f.event_id, f.nx, f.pv, f.cs, f.cm, f.cx)


@query("""select event_id, bool_and(value > 1) over w as ca, bool_or(value > 50) over w as cy from events window w as (partition by user_id order by event_id rows unbounded preceding)""")
def cumall_any(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.mutate(ca=t.cumall(f.value > 1), cy=t.cumany(f.value > 50)) >> t.ungroup() >> t.select(f.event_id, f.ca, f.cy)


@query("""select event_id, sum(case when event_type is distinct from prev or prev is null then 1 else 0 end) over (partition by user_id order by event_id)::bigint as run from (select *, lag(event_type) over (partition by user_id order by event_id) as prev from events)""")
def consecutive_id(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.mutate(run=t.consecutive_id(f.event_type)) >> t.ungroup() >> t.select(f.event_id, f.run)


@query("select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_samp(o_totalprice) over (), 6) as z from orders")
def scale(orders):
    return orders >> t.transmute(f.o_orderkey, z=t.round_(t.scale(f.o_totalprice), digits=6))


@query("select * from (select event_id, round(value - lag(value) over (partition by user_id order by event_id), 6) as d from events) where d is not null")
def diff(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.mutate(d=t.round_(t.diff(f.value), digits=6)) >> t.ungroup() >> t.select(f.event_id, f.d) >> t.drop_na(f.d)


@query("select o_orderkey, o_custkey, o_totalprice from (select *, max(o_totalprice) over (partition by o_custkey) as m from orders) where o_totalprice = m")
def filter_group_max(orders):
    return orders >> t.group_by(f.o_custkey) >> t.filter_(f.o_totalprice == t.max_(f.o_totalprice)) >> t.ungroup() >> t.select(f.o_orderkey, f.o_custkey, f.o_totalprice)


# ---- slices ----


@query("select p_partkey, p_brand, p_size from (select *, rank() over (partition by p_brand order by p_size) as r from part) where r <= 3")
def slice_min_ties(part):
    return part >> t.group_by(f.p_brand) >> t.slice_min(f.p_size, n=3) >> t.ungroup() >> t.select(f.p_partkey, f.p_brand, f.p_size)


@query("select o_orderkey, o_totalprice from (select *, rank() over (order by o_totalprice desc) as r from orders) where r <= 10")
def slice_max(orders):
    return orders >> t.slice_max(f.o_totalprice, n=10) >> t.select(f.o_orderkey, f.o_totalprice)


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r <= 2")
def slice_head_by(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.slice_head(n=2) >> t.ungroup() >> t.select(f.event_id, f.user_id)


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 2")
def slice_tail_by(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.slice_tail(n=2) >> t.ungroup() >> t.select(f.event_id, f.user_id)


@query("select event_id from (select *, row_number() over (partition by user_id order by event_id) - 1 as r, count(*) over (partition by user_id) as n from events) where r in (0, 2) or r = n - 1")
def slice_index(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.slice_(0, 2, -1) >> t.ungroup() >> t.select(f.event_id)


@query("select event_id from (select *, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as n from events) where r <= floor(0.25 * n)")
def slice_prop(events):
    return events >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.slice_head(prop=0.25) >> t.ungroup() >> t.select(f.event_id)


@query()
def slice_sample(orders):
    return orders >> t.group_by(f.o_orderstatus) >> t.slice_sample(n=5) >> t.ungroup()


# ---- joins ----


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def inner_join(orders, customer):
    return t.inner_join(orders, customer, by={"o_custkey": "c_custkey"}) >> t.select(f.o_orderkey, f.c_name)


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def left_join(customer, orders):
    return t.left_join(customer, orders, by={"c_custkey": "o_custkey"}) >> t.select(f.c_custkey, f.o_orderkey)


@query("select k, o_orderkey, c_name from (select c_custkey as k, c_name from customer where c_acctbal < 5000) right join (select o_custkey as k, o_orderkey from orders) using (k)")
def right_join(customer, orders):
    a = customer >> t.filter_(f.c_acctbal < 5000) >> t.select(k=f.c_custkey, c_name=f.c_name)
    return t.right_join(a, orders >> t.select(k=f.o_custkey, o_orderkey=f.o_orderkey), by="k")


@query("select coalesce(a.k, b.k) as k, x, y from (select c_custkey as k, c_acctbal as x from customer where c_acctbal < 5000) a full join (select c_custkey as k, c_nationkey as y from customer where c_acctbal > 2000) b on a.k = b.k")
def full_join(customer):
    a = customer >> t.filter_(f.c_acctbal < 5000) >> t.select(k=f.c_custkey, x=f.c_acctbal)
    return t.full_join(a, customer >> t.filter_(f.c_acctbal > 2000) >> t.select(k=f.c_custkey, y=f.c_nationkey), by="k")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(customer, orders):
    return t.semi_join(customer, orders, by={"c_custkey": "o_custkey"}) >> t.select(f.c_custkey)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def anti_join(customer, orders):
    return t.anti_join(customer, orders, by={"c_custkey": "o_custkey"}) >> t.select(f.c_custkey)


@query("select r_name, n_name from region cross join nation")
def cross_join(region, nation):
    return t.cross_join(region, nation) >> t.select(f.r_name, f.n_name)


@query("select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by all")
def nest_join(nation, customer):
    return t.nest_join(nation, customer, by={"n_nationkey": "c_nationkey"}, name="cs") >> t.transmute(f.n_name, n=t.as_integer(t.lengths(f.cs)))


@query("select a.c_custkey, a.c_acctbal as c_acctbal_x, b.c_acctbal as c_acctbal_y from customer a join customer b using (c_custkey)")
def join_suffix(customer):
    a = customer >> t.select(f.c_custkey, f.c_acctbal)
    return t.inner_join(a, a, by="c_custkey")


@query("select a.o_orderkey, b.n from (select o_orderkey, nullif(o_orderstatus, 'P') as s from orders) a join (select nullif(o_orderstatus, 'P') as s, count(*) as n from orders group by all) b on a.s is not distinct from b.s")
def join_na_keys(orders):
    keyed = orders >> t.mutate(s=t.na_if(f.o_orderstatus, "P"))
    return t.inner_join(keyed >> t.select(f.o_orderkey, f.s), keyed >> t.count(f.s), by="s") >> t.select(f.o_orderkey, f.n)


# ---- sets and rows ----

_A, _B = "(select c_nationkey, c_mktsegment from customer where c_mktsegment <> 'BUILDING')", "(select c_nationkey, c_mktsegment from customer where c_nationkey > 5)"


def _halves(customer):
    narrow = t.select(f.c_nationkey, f.c_mktsegment)
    return customer >> t.filter_(f.c_mktsegment != "BUILDING") >> narrow, customer >> t.filter_(f.c_nationkey > 5) >> narrow


def _set_query(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(t, name)(*_halves(_table(spark, sf_dir, "customer")))
        return out.df.select(*out.columns)

    QUERIES[name], ORACLES[name] = run, sql


for _name, _sql in {"intersect": f"{_A} intersect {_B}", "union": f"{_A} union {_B}", "union_all": f"{_A} union all {_B}", "setdiff": f"{_A} except {_B}", "symdiff": f"({_A} except {_B}) union ({_B} except {_A})"}.items():
    _set_query(_name, _sql)


@query("select 'a' as src, n_name as name from nation union all select 'b', r_name from region")
def bind_rows_id(nation, region):
    return t.bind_rows(_id="src", a=nation >> t.select(name=f.n_name), b=region >> t.select(name=f.r_name))


@query("select r_regionkey, r_name, n_name from (select *, row_number() over (order by r_regionkey) as i from region) full join (select n_name, row_number() over (order by n_nationkey) as i from nation) using (i)")
def bind_cols(region, nation):
    return t.bind_cols(region >> t.arrange(f.r_regionkey), nation >> t.arrange(f.n_nationkey) >> t.select(f.n_nationkey, f.n_name) >> t.mutate(k=f.n_nationkey) >> t.arrange(f.n_nationkey)) >> t.select(f.r_regionkey, f.r_name, f.n_name)


_X, _Y = "(select n_nationkey, n_name, nullif(n_regionkey, 2) as n_regionkey from nation)", "(select n_nationkey, n_regionkey + 10 as n_regionkey from nation where n_nationkey % 4 = 0)"


def _upsert_tables(nation):
    return nation >> t.mutate(n_regionkey=t.na_if(f.n_regionkey, 2)), nation >> t.filter_(f.n_nationkey % 4 == 0) >> t.transmute(f.n_nationkey, n_regionkey=f.n_regionkey + 10)


@query(f"select x.n_nationkey, n_name, case when y.n_nationkey is not null then y.n_regionkey else x.n_regionkey end as n_regionkey from {_X} x left join {_Y} y using (n_nationkey)")
def rows_update(nation):
    return t.rows_update(*_upsert_tables(nation), by="n_nationkey")


@query(f"select n_nationkey, n_name, coalesce(x.n_regionkey, y.n_regionkey) as n_regionkey from {_X} x left join {_Y} y using (n_nationkey)")
def rows_patch(nation):
    return t.rows_patch(*_upsert_tables(nation), by="n_nationkey")


@query("select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey + 100, null, n_regionkey from nation where n_nationkey < 3")
def rows_insert(nation):
    new = nation >> t.filter_(f.n_nationkey < 3) >> t.transmute(n_nationkey=f.n_nationkey + 100, n_regionkey=f.n_regionkey)
    return t.rows_insert(nation, new, by="n_nationkey")


@query("select * from nation union all select * from nation where n_nationkey < 3")
def rows_append(nation):
    return t.rows_append(nation, nation >> t.filter_(f.n_nationkey < 3))


@query("select n_nationkey, n_name, case when n_nationkey in (23, 24) then 9 else n_regionkey end as n_regionkey from nation union all select n_nationkey, null, 9 from (values (25), (26)) v(n_nationkey)")
def rows_upsert(nation):
    new = nation >> t.filter_(f.n_nationkey < 4) >> t.transmute(n_nationkey=f.n_nationkey + 23, n_regionkey=f.n_regionkey * 0 + 9)
    return t.rows_upsert(nation, new, by="n_nationkey")


@query("select * from nation where n_nationkey % 4 <> 0")
def rows_delete(nation):
    return t.rows_delete(nation, nation >> t.filter_(f.n_nationkey % 4 == 0) >> t.select(f.n_nationkey), by="n_nationkey")


# ---- reshaping ----


@query("select p_partkey, name, value from (select p_partkey, p_size::double as p_size, p_retailprice from part) unpivot (value for name in (p_size, p_retailprice))")
def pivot_longer(part):
    return part >> t.select(f.p_partkey, f.p_size, f.p_retailprice) >> t.pivot_longer([f.p_size, f.p_retailprice])


@query("select s_suppkey, '1' as n, s_nationkey as x, s_acctbal as y from supplier union all select s_suppkey, '2', s_nationkey + 1, s_acctbal * 2 from supplier")
def pivot_longer_value(supplier):
    return supplier >> t.transmute(f.s_suppkey, x_1=f.s_nationkey, y_1=f.s_acctbal, x_2=f.s_nationkey + 1, y_2=f.s_acctbal * 2) >> t.pivot_longer(~c[f.s_suppkey], names_to=[".value", "n"], names_sep="_")


_PRIORITIES = ", ".join(f"""sum((o_orderpriority = '{p}')::int)::bigint as "{p}\"""" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query(f"select o_orderstatus, {_PRIORITIES} from orders group by all")
def pivot_wider(orders):
    return orders >> t.count(f.o_orderstatus, f.o_orderpriority) >> t.ungroup() >> t.pivot_wider(names_from="o_orderpriority", values_from="n", values_fill=0)


@query("select o_orderkey, split_part(o_orderpriority, '-', 1) as num, split_part(o_orderpriority, '-', 2) as label from orders")
def separate(orders):
    return orders >> t.select(f.o_orderkey, f.o_orderpriority) >> t.separate(f.o_orderpriority, ["num", "label"], sep="-", extra="merge")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as p_name from part")
def separate_rows(part):
    return part >> t.select(f.p_partkey, f.p_name) >> t.separate_rows(f.p_name, sep=" ")


@query("select c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) as num from customer")
def extract(customer):
    return customer >> t.select(f.c_custkey, f.c_name) >> t.extract(f.c_name, "num", r"#0*([0-9]+)")


@query("select c_custkey, c_nationkey::varchar || '_' || c_mktsegment as u from customer")
def unite(customer):
    return customer >> t.select(f.c_custkey, f.c_nationkey, f.c_mktsegment) >> t.unite("u", f.c_nationkey, f.c_mktsegment)


@query("select event_id, last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as v from (select event_id, user_id, case when event_type = 'purchase' then value end as v from events)")
def fill_down(events):
    return events >> t.transmute(f.event_id, f.user_id, v=t.case_when(f.event_type == "purchase", f.value)) >> t.arrange(f.event_id) >> t.group_by(f.user_id) >> t.fill(f.v) >> t.ungroup() >> t.select(f.event_id, f.v)


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') as s from orders")
def replace_na(orders):
    return orders >> t.transmute(f.o_orderkey, s=t.na_if(f.o_orderstatus, "P")) >> t.replace_na({"s": "?"})


@query("select o_orderkey, nullif(o_orderstatus, 'P') as s from orders where o_orderstatus <> 'P'")
def drop_na(orders):
    return orders >> t.transmute(f.o_orderkey, s=t.na_if(f.o_orderstatus, "P")) >> t.drop_na()


@query("select * from (select distinct o_orderstatus from orders) cross join (select distinct o_orderpriority from orders)")
def expand(orders):
    return orders >> t.expand(f.o_orderstatus, f.o_orderpriority)


@query("select g.c_nationkey, g.c_mktsegment, coalesce(n, 0) as n from (select * from (select distinct c_nationkey from customer) cross join (select distinct c_mktsegment from customer)) g left join (select c_nationkey, c_mktsegment, count(*) as n from customer where c_acctbal > 9000 group by all) using (c_nationkey, c_mktsegment) where g.c_nationkey in (select c_nationkey from customer where c_acctbal > 9000) and g.c_mktsegment in (select c_mktsegment from customer where c_acctbal > 9000)")
def complete(customer):
    return customer >> t.filter_(f.c_acctbal > 9000) >> t.count(f.c_nationkey, f.c_mktsegment) >> t.complete(f.c_nationkey, f.c_mktsegment, fill={"n": 0})


@query("select n_name from nation, generate_series(1, n_regionkey)")
def uncount(nation):
    return nation >> t.select(f.n_name, f.n_regionkey) >> t.uncount(f.n_regionkey)


@query("select n_regionkey, n_nationkey, n_name from nation")
def nest_unnest(nation):
    return nation >> t.group_by(f.n_regionkey) >> t.nest() >> t.ungroup() >> t.unnest("data")


@query("select n_regionkey, n_nationkey, n_name from nation")
def chop_unchop(nation):
    return nation >> t.chop([f.n_nationkey, f.n_name]) >> t.unchop([f.n_nationkey, f.n_name])


@query("select n_nationkey, n_name, n_regionkey from nation")
def pack_unpack(nation):
    return nation >> t.pack(p=[f.n_name, f.n_regionkey]) >> t.unpack("p")


@query("select unnest(generate_series(0, 24))::int as n_nationkey")
def full_seq(nation):
    return nation >> t.filter_(f.n_nationkey % 2 == 0) >> t.full_seq(f.n_nationkey, 1)


# ---- scalars ----


@query("""select o_orderkey, round(sqrt(o_totalprice), 6) as r, round(ln(o_totalprice), 6) as l, ceil(o_totalprice)::bigint as c, floor(o_totalprice / 7)::bigint as d, round_even(o_totalprice / 100, 0) as e, round(sin(o_orderkey), 8) as s, round(atan2(o_orderkey, 3), 8) as a, trunc(o_totalprice)::bigint as t from orders""")
def math(orders):
    p = f.o_totalprice
    return orders >> t.transmute(f.o_orderkey, r=t.round_(t.sqrt(p), digits=6), l=t.round_(t.log(p), digits=6), c=t.ceiling(p), d=p // 7, e=t.round_(p / 100), s=t.round_(t.sin(f.o_orderkey), digits=8), a=t.round_(t.atan2(f.o_orderkey, 3), digits=8), t=t.trunc(p))


@query("""select c_custkey, lower(c_name) as lo, upper(c_mktsegment) as up, length(c_name) as n, regexp_matches(c_name, '7') as g, regexp_replace(c_name, '0', 'o') as s1, regexp_replace(c_name, '0', 'o', 'g') as s2, substr(c_name, 2, 3) as sb, translate(c_mktsegment, 'AE', 'ae') as ch, starts_with(c_name, 'Cust') as st, c_name || '-' || c_nationkey as pa, trim('  ' || c_name || ' ') as tr, printf('%05d', c_nationkey) as sp from customer""")
def strings(customer):
    n = f.c_name
    return customer >> t.transmute(f.c_custkey, lo=t.tolower(n), up=t.toupper(f.c_mktsegment), n=t.as_integer(t.nchar(n)), g=t.grepl("7", n), s1=t.sub("0", "o", n), s2=t.gsub("0", "o", n), sb=t.substr(n, 1, 4), ch=t.chartr("AE", "ae", f.c_mktsegment), st=t.startswith(n, "Cust"), pa=t.paste(n, f.c_nationkey, sep="-"), tr=t.trimws(t.paste("  ", n, " ", sep="")), sp=t.sprintf("%05d", f.c_nationkey))


@query("""select o_orderkey, case when o_totalprice > 100000 then 'hi' else 'lo' end as i, case when o_totalprice > 150000 then 'a' when o_totalprice > 50000 then 'b' end as w, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as m, case o_orderstatus when 'F' then 'x' else o_orderstatus end as r, abs(o_totalprice - 100000) <= 1e-8 + 1 as nr, o_orderpriority in ('1-URGENT') as e from orders""")
def conditionals(orders):
    p = f.o_totalprice
    return orders >> t.transmute(f.o_orderkey, i=t.if_else(p > 100000, "hi", "lo"), w=t.case_when(p > 150000, "a", p > 50000, "b"), m=t.case_match(f.o_orderstatus, "F", "done", "O", "open", _default="part"), r=t.recode(f.o_orderstatus, F="x"), nr=t.near(p, 100000), e=t.is_element(f.o_orderpriority, ["1-URGENT"]))


@query("select p_partkey, case when p_size <= 10 then '(0, 10]' when p_size <= 25 then '(10, 25]' else '(25, 50]' end as k from part")
def cut(part):
    return part >> t.transmute(f.p_partkey, k=t.cut(f.p_size, [0, 10, 25, 50]))


@query("select o_orderkey, o_totalprice::bigint as i, o_orderkey::varchar as s, year(o_orderdate)::int as y, month(o_orderdate)::int as m, (o_orderdate::date) as d from orders where o_totalprice = floor(o_totalprice) or true")
def casts_dates(orders):
    return orders >> t.transmute(f.o_orderkey, i=t.as_integer(t.round_(f.o_totalprice)), s=t.as_character(f.o_orderkey), y=t.pd_dt(f.o_orderdate).year, m=t.pd_dt(f.o_orderdate).month, d=t.as_date(f.o_orderdate))


@query("select l_orderkey, l_linenumber, round(l_tax + l_discount, 6) as s, least(l_tax, l_discount) as lo, greatest(l_tax, l_discount) as hi from lineitem")
def row_sums_pmin(lineitem):
    return lineitem >> t.transmute(f.l_orderkey, f.l_linenumber, s=t.round_(t.row_sums(f.l_tax, f.l_discount), digits=6), lo=t.pmin(f.l_tax, f.l_discount), hi=t.pmax(f.l_tax, f.l_discount))


@query("select l_orderkey, l_linenumber, round((l_tax + l_discount) / 2, 6) as m from lineitem")
def c_across_mean(lineitem):
    return lineitem >> t.rowwise() >> t.mutate(m=t.round_(t.mean(t.c_across([f.l_tax, f.l_discount])), digits=6)) >> t.ungroup() >> t.select(f.l_orderkey, f.l_linenumber, f.m)


# ---- factors ----


@query("select o_orderkey, (list_position((select list(o_orderpriority order by n desc, o_orderpriority) from (select o_orderpriority, count(*) as n from orders group by all)), o_orderpriority) - 1)::int as code from orders")
def fct_infreq(orders):
    return orders >> t.mutate(p=t.fct_infreq(f.o_orderpriority)) >> t.transmute(f.o_orderkey, code=t.as_integer(f.p))


@query("""with n as (select p_brand, count(*) as n from part group by all), r as (select *, rank() over (order by n desc) as r, count(*) over () as k from n)
select p_partkey, case when r.r <= 5 or (select count(*) from r where r > 5) <= 1 then p_brand else 'Other' end as b from part join r using (p_brand)""")
def fct_lump_n(part):
    return part >> t.transmute(f.p_partkey, b=t.fct_lump_n(f.p_brand, n=5))


@query("select p_partkey, case when p_brand = 'Brand#11' then 'x' when p_brand = 'Brand#12' then 'x' else p_brand end as b, case when p_brand in ('Brand#11', 'Brand#12') then p_brand else 'Other' end as o from part")
def fct_collapse_other(part):
    return part >> t.transmute(f.p_partkey, b=t.fct_collapse(f.p_brand, x=["Brand#11", "Brand#12"]), o=t.fct_other(f.p_brand, keep=["Brand#11", "Brand#12"]))


@query("select p_brand as f, count(*) as n from part group by all")
def fct_count(part):
    return part >> t.fct_count(f.p_brand)


@query("select o_orderkey, o_orderstatus || ':' || o_orderpriority as x, coalesce(nullif(o_orderstatus, 'P'), '(Missing)') as e from orders")
def fct_cross_na(orders):
    return orders >> t.transmute(f.o_orderkey, x=t.fct_cross(f.o_orderstatus, f.o_orderpriority), e=t.fct_explicit_na(t.na_if(f.o_orderstatus, "P")))


# ---- user functions ----


@query("select o_orderstatus, round(max(o_totalprice), 2) as top from orders group by all")
def group_modify(orders):
    return orders >> t.select(f.o_orderstatus, f.o_totalprice) >> t.group_by(f.o_orderstatus) >> t.group_modify(_top, "top double") >> t.ungroup()


def _top(frame):
    import pandas as pd

    return pd.DataFrame({"top": [round(frame["o_totalprice"].max(), 2)]})


@query("select n_nationkey, round(lgamma(n_nationkey + 1), 6) as lg from nation")
def special_lgamma(nation):
    return nation >> t.transmute(f.n_nationkey, lg=t.round_(t.lgamma(f.n_nationkey + 1), digits=6))


@query()
def random_normal(nation):
    return nation >> t.transmute(f.n_nationkey, z=t.rnorm(1))


from . import queries_names  # noqa: E402, F401  registers more of the catalogue
