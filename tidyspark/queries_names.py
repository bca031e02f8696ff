"""More of the catalogue: names that the family queries don't reach, ten to twenty a query."""

from __future__ import annotations

import numpy as np

import tidyspark as t
from tidyspark import c, f

from .queries import query

# ---- types, predicates, casts ----


@query("""select n_nationkey, true as ch, true as it, true as nu, false as db, false as lg, false as cx, true as fc, true as od, true as am, false as nl, n_nationkey::double as d, n_nationkey::double as e, n_nationkey > 0 as l
from nation""")
def type_tests(nation):
    made = nation >> t.mutate(g=t.factor(f.n_name), o=t.ordered(f.n_name), o2=t.as_ordered(f.n_name), g2=t.as_factor(f.n_name))
    return made >> t.transmute(
        f.n_nationkey, ch=t.is_character(f.n_name), it=t.is_integer(f.n_nationkey), nu=t.is_numeric(f.n_nationkey), db=t.is_double(f.n_nationkey), lg=t.is_logical(f.n_name), cx=t.is_complex(f.n_name),
        fc=t.is_factor(f.g2), od=t.is_ordered(f.o2), am=t.is_atomic(f.n_name), nl=t.is_null(f.n_name), d=t.as_double(f.n_nationkey), e=t.as_numeric(f.n_nationkey), l=t.as_logical(f.n_nationkey),
    )


@query("""select o_orderkey, o_orderstatus = 'P' as na, o_totalprice > 0 as fin, false as inf, true as nz, ends_with(o_orderpriority, 'H') as h, coalesce(nullif(o_orderstatus, 'P'), 'none') as st,
 list_position(['F', 'O'], o_orderstatus) is not null as el, coalesce(list_position(['F', 'O', 'P'], o_orderstatus), 0)::int - 1 as at from orders""")
def predicates(orders):
    return orders >> t.transmute(
        f.o_orderkey, na=t.is_na(t.na_if(f.o_orderstatus, "P")), fin=t.is_finite(f.o_totalprice), inf=t.is_infinite(f.o_totalprice), nz=t.nzchar(f.o_orderstatus), h=t.endswith(f.o_orderpriority, "H"),
        st=t.coalesce(t.na_if(f.o_orderstatus, "P"), "none"), el=t.is_element(f.o_orderstatus, ["F", "O"]), at=t.match(f.o_orderstatus, ["F", "O", "P"]),
    )


@query("""select l_orderkey, l_linenumber, l_quantity as re, -l_tax as im, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) as mod, round(atan2(l_tax, l_quantity), 6) as arg from lineitem""")
def complex_parts(lineitem):
    z = lineitem >> t.mutate(z=t.as_complex(f.l_quantity, f.l_tax))
    return z >> t.transmute(f.l_orderkey, f.l_linenumber, re=t.re_(f.z), im=t.im(t.conj(f.z)), mod=t.round_(t.mod(f.z), digits=6), arg=t.round_(t.arg(f.z), digits=6))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, o_orderdate as p, year(o_orderdate) as y from orders")
def dates_from_text(orders):
    text = orders >> t.mutate(s=t.substr(t.as_character(f.o_orderdate), 0, 10))
    return text >> t.transmute(f.o_orderkey, d=t.as_character(t.as_date(f.s)), p=t.as_pd_date(f.s), y=t.attrgetter(f.o_orderdate, "year"))


# ---- mathematics ----

_X = "(o_orderkey % 19) / 20.0::double"


@query(f"""select o_orderkey, round(cos(x), 6) as c, round(tan(x), 6) as t, round(asin(x), 6) as asn, round(acos(x), 6) as acs, round(atan(x), 6) as atn, round(sinh(x), 6) as sh, round(cosh(x), 6) as ch, round(tanh(x), 6) as th,
 round(asinh(x), 6) as ash, round(acosh(x + 1), 6) as ach, round(atanh(x), 6) as ath, round(sin(x * pi()), 6) as sp, round(cos(x * pi() / 3), 6) as cp, round(tan(x * pi() / 3), 6) as tp from (select o_orderkey, {_X} as x from orders)""")
def trigonometry(orders):
    r = lambda e: t.round_(e, digits=6)
    return orders >> t.mutate(x=(f.o_orderkey % 19) / 20.0) >> t.transmute(
        f.o_orderkey, c=r(t.cos(f.x)), t=r(t.tan(f.x)), asn=r(t.asin(f.x)), acs=r(t.acos(f.x)), atn=r(t.atan(f.x)), sh=r(t.sinh(f.x)), ch=r(t.cosh(f.x)), th=r(t.tanh(f.x)),
        ash=r(t.asinh(f.x)), ach=r(t.acosh(f.x + 1)), ath=r(t.atanh(f.x)), sp=r(t.sinpi(f.x)), cp=r(t.cospi(f.x / 3)), tp=r(t.tanpi(f.x / 3)),
    )


@query("""select c_custkey, floor(c_acctbal)::bigint as fl, abs(c_acctbal) as ab, sign(c_acctbal)::int as sg, round(exp(c_acctbal / 10000), 6) as ex, round(log2(c_custkey + 1), 6) as l2, round(log10(c_custkey + 1), 6) as l10, round(ln(1 + c_custkey), 6) as l1,
 round((c_custkey + 1) * power(10.0, 2 - floor(log10(c_custkey + 1)))) / power(10.0, 2 - floor(log10(c_custkey + 1))) as si, round(sqrt(c_custkey), 6) as uf from customer""")
def logs_and_signs(customer):
    r = lambda e: t.round_(e, digits=6)
    return customer >> t.transmute(
        f.c_custkey, fl=t.floor(f.c_acctbal), ab=t.abs_(f.c_acctbal), sg=t.as_integer(t.sign(f.c_acctbal)), ex=r(t.exp(f.c_acctbal / 10000)), l2=r(t.log2(f.c_custkey + 1)), l10=r(t.log10(f.c_custkey + 1)), l1=r(t.log1p(f.c_custkey)),
        si=t.signif(t.as_double(f.c_custkey + 1), digits=3), uf=r(t.array_ufunc(np.sqrt, f.c_custkey)),
    )


_SERIES = "list_sum(list_transform(range(0, 40), lambda m: {sign} exp((2 * m + 1) * ln(x / 2.0) - lgamma(m + 1) - lgamma(m + 2))))"


@query(f"""select n_nationkey, round(gamma(x), 4) as g, round(exp(lgamma(x) + lgamma(2) - lgamma(x + 2)), 8) as b, round(lgamma(x) + lgamma(2) - lgamma(x + 2), 6) as lb, x * (x + 1) / 2.0::double as ch, round(ln(x * (x + 1) / 2.0), 6) as lch,
 round(gamma(x + 1), 3) as fa, round(lgamma(x + 1), 6) as lfa, round(coalesce(list_sum(list_transform(range(1, x), lambda k: 1.0::double / k)), 0) - 0.5772156649015329, 6) as dg,
 round(pi() * pi() / 6 - coalesce(list_sum(list_transform(range(1, x), lambda k: 1.0::double / (k * k))), 0), 6) as tg, round(pi() * pi() / 6 - coalesce(list_sum(list_transform(range(1, x), lambda k: 1.0::double / (k * k))), 0), 6) as pg,
 round({_SERIES.format(sign="(case when m % 2 = 0 then 1 else -1 end) *")}, 5) as bj, round({_SERIES.format(sign="")} / exp(x), 5) as bi, round(sqrt(pi() / (2 * x)) * exp(-x), 6) as bk, round(-sqrt(2 / (pi() * x)) * cos(x), 5) as yy
 from (select n_nationkey, n_regionkey::bigint + 1 as x from nation)""")
def special_functions(nation):
    r = lambda e, d=6: t.round_(e, digits=d)
    return nation >> t.mutate(x=f.n_regionkey + 1) >> t.transmute(
        f.n_nationkey, g=r(t.gamma(f.x), 4), b=r(t.beta(f.x, 2), 8), lb=r(t.lbeta(f.x, 2)), ch=t.choose(f.x + 1, 2), lch=r(t.lchoose(f.x + 1, 2)), fa=r(t.factorial(f.x), 3), lfa=r(t.lfactorial(f.x)), dg=r(t.digamma(f.x)),
        tg=r(t.trigamma(f.x)), pg=r(t.psigamma(f.x, 1)), bj=r(t.bessel_j(f.x, 1), 5), bi=r(t.bessel_i(f.x, 1) / t.exp(f.x), 5), bk=r(t.bessel_k(f.x, 0.5)), yy=r(t.bessel_y(f.x, 0.5), 5),
    )


@query("select true as u, true as n, true as e, true as ca, true as b, true as p, true as ch, count(*) as rows from nation")
def random_draws(nation):
    t.set_seed(11)
    drawn = nation >> t.mutate(u=t.runif(1), n=t.rnorm(1), e=t.rexp(1), ca=t.rcauchy(1), b=t.rbinom(1, 5, 0.5), p=t.rpois(1, 3), ch=t.rchisq(1, 2))
    return drawn >> t.summarise(
        u=t.all_(t.between(f.u, 0, 1)), n=t.all_(t.abs_(f.n) < 50), e=t.all_(f.e >= 0), ca=t.all_(t.is_finite(f.ca)), b=t.all_(t.is_element(t.as_integer(f.b), [0, 1, 2, 3, 4, 5])),
        p=t.all_((f.p >= 0) & (f.p == t.floor(f.p))), ch=t.all_(f.ch >= 0), rows=t.n(),
    )


# ---- strings and sequences ----


@query("""select n_nationkey, concat('N', '-', n_name) as p, substring(n_name, 3) as s, substring(n_name, 1, 3) as s3, string_split(n_name, '_')[2] as sp, n_nationkey * 16 + 10 as hx, lower(n_name) as lo, length(n_name) as le, n_nationkey + 255 as ix from nation""")
def text_pieces(nation):
    hexed = nation >> t.mutate(h=t.sprintf("%xa", f.n_nationkey))
    return hexed >> t.transmute(
        f.n_nationkey, p=t.paste0("N", "-", f.n_name), s=t.substring(f.n_name, 2), s3=t.substring(f.n_name, 0, 3), sp=t.itemgetter(t.strsplit(f.n_name, "_"), 1), hx=t.strtoi(f.h, 16), lo=t.pd_str(f.n_name).lower(), le=t.attrgetter(f.n_name, "len")(),
        ix=t.strtoi("0xff") + f.n_nationkey,
    )


@query("""select n_nationkey, n_regionkey + 1 as last_of, n_regionkey as n, 6 as reps, 3 as each_of, 4 as cut_of, 2 as top, 2 as low, 7 as joined, 5 as appended, 9 as inserted, n_name as same, 'c' as letter, 'C' as upper, 3.14159 as pi, true as na from nation""")
def sequences(nation):
    at = t.itemgetter
    return nation >> t.transmute(
        f.n_nationkey, last_of=at(t.rev(t.seq_len(f.n_regionkey + 1)), 0), n=t.lengths(t.seq(1, f.n_regionkey + 1)) - 1, reps=t.lengths(t.rep([1, 2, 3], times=2)), each_of=at(t.rep([1, 2, 3], each=2), 5), cut_of=t.lengths(t.rep([1, 2, 3], length=4)),
        top=at(t.sort([1, 2, 0], decreasing=True), 0), low=at(t.sort([4, 2, 3]), 0), joined=at(t.c_([1, 2], [7]), 2), appended=at(t.append([1, 2], [5]), 2), inserted=at(t.append([1, 2], [9], after=0), 1), same=t.identity(f.n_name),
        letter=t.letters[2], upper=t.LETTERS[2], pi=t.round_(t.pi, digits=5), na=t.is_infinite(t.Inf),
    )


# ---- selection and columns ----


@query("select c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey from customer")
def selection_helpers(customer):
    return customer >> t.select(t.all_of(["c_custkey"]), t.matches("^c_na.e$"), t.starts_with("c_mk"), t.where(t.is_double), t.any_of(["c_nationkey", "none"]), t.everything(), t.last_col())


@query("select c_custkey, c_nationkey * 2 as x2, c_nationkey * 3 as x3 from customer")
def numbered_columns(customer):
    made = customer >> t.transmute(f.c_custkey, x1=f.c_nationkey, x2=f.c_nationkey * 2, x3=f.c_nationkey * 3, y2=f.c_nationkey)
    return made >> t.select(c(f.c_custkey), t.num_range("x", [2, 3]))


@query("select n_nationkey as id, n_name as name, n_regionkey as region, true as ok, 'x' as tag from nation")
def column_verbs(nation):
    named = nation >> t.rename(id=f.n_nationkey, name=f.n_name) >> t.set_colnames(["id", "name", "region"])
    return named >> t.complete_cases(name="ok") >> t.add_column(tag="x") >> t.remove_rownames() >> t.select(t.everything())


@query("select n_nationkey, n_name, n_regionkey from nation union all select 99, 'NEW', 9")
def add_row(nation):
    return nation >> t.add_row(n_nationkey=99, n_name="NEW", n_regionkey=9)


@query("select i as rowid, i as rn, r_regionkey, r_name, 'row' || i as label from (select *, row_number() over (order by r_regionkey desc) - 1 as i from region)")
def row_names(region):
    rows = region >> t.arrange(t.desc(f.r_regionkey))
    numbers = t.rownames(rows)
    named = rows >> t.set_rownames([f"row{i}" for i in numbers], var="label") >> t.column_to_rownames("label")
    assert not t.has_rownames(named)
    return rows >> t.rownames_to_column("rn") >> t.arrange(f.rn) >> t.rowid_to_column() >> t.left_join(named >> t.select(f.r_regionkey, f.label), by="r_regionkey")


@query("select * from (select *, row_number() over (order by o_orderkey desc) as r from orders) where r <= 7")
def tail(orders):
    return orders >> t.arrange(f.o_orderkey) >> t.tail(7) >> t.mutate(r=t.rank(t.desc(f.o_orderkey), ties_method="first"))


@query("select n_name, n_nationkey as a, n_regionkey as b from nation")
def pick(nation):
    return nation >> t.mutate(p=t.pick(f.n_nationkey, f.n_regionkey)) >> t.transmute(f.n_name, a=f.p.n_nationkey, b=f.p.n_regionkey)


@query("select n_name, n_nationkey || '@n_nationkey' as n_nationkey, n_regionkey || '@n_regionkey' as n_regionkey from nation")
def cur_column(nation):
    return nation >> t.transmute(f.n_name, t.across(c(f.n_nationkey, f.n_regionkey), lambda x: t.paste0(x, "@", t.cur_column())))


@query("select n_name, case n_regionkey when 0 then 'zero' when 1 then 'one' else 'many' end as r, case n_regionkey when 0 then 1 when 1 then 0 else 2 end as code from nation")
def recode_factor(nation):
    return nation >> t.mutate(r=t.recode_factor(f.n_regionkey, {1: "one", 0: "zero"}, _default="many")) >> t.transmute(f.n_name, f.r, code=t.as_integer(f.r))


# ---- values that verbs hand back ----


@query("""select 25 as nrow, 3 as ncol, 25 as d0, 3 as d1, 'n_name' as second, 300 as total, 24 as top, 'NATION_1' as named, 75 as cells, 25 as framed, 'n_regionkey' as gv, 5 as groups, 25 as sizes, true as dropped, 5 as parts, 25 as mapped, true as seen, 5 as rows_of, true as equal, 1 as setting, true as version""")
def returned_values(nation):
    grouped = nation >> t.group_by(f.n_regionkey)
    keyed = nation >> t.arrange(f.n_nationkey) >> t.select(f.n_nationkey, f.n_name)
    shown = []
    grouped >> t.group_walk(lambda x: shown.append(t.nrow(x)))
    t.options(setting=1)
    # shapes are those of the table at hand; nation and region have the same rows at every scale
    return t.tibble(
        nrow=nation >> t.nrow(), ncol=nation >> t.ncol(), d0=(nation >> t.dim())[0], d1=(nation >> t.dim())[1], second=(nation >> t.colnames())[1], total=sum(nation >> t.pull(f.n_nationkey)), top=max(nation >> t.pull(0)), named=(keyed >> t.deframe())[1],
        cells=len(nation >> t.flatten()), framed=t.nrow(t.as_tibble(nation.df)), gv=(grouped >> t.group_vars())[0], groups=grouped >> t.n_groups(), sizes=sum(grouped >> t.group_size()), dropped=grouped >> t.group_by_drop_default(),
        parts=len(grouped >> t.group_split()), mapped=sum(grouped >> t.group_map(lambda x: t.nrow(x))), seen=sum(shown) == 25 and "n_name" in (nation >> t.glimpse()), rows_of=len(grouped >> t.group_rows()), equal=t.setequal(nation, nation),
        setting=t.options("setting")["setting"], version="pyspark" in t.get_versions(), spark=nation.df.sparkSession,
    )


@query("""select * from (values ('tibble', 1, 2.0::double), ('tibble', 2, 4.0), ('tribble', 1, 2.0), ('tribble', 3, 4.0), ('row', 5, 6.0), ('frame', 0, 7.0), ('frame', 1, 8.0), ('diag', 1, 0.0), ('diag', 0, 1.0), ('outer', 3, 4.0), ('outer', 6, 8.0), ('dict', 9, 9.5), ('short', 1, 1.5)) v(src, x, y)""")
def constructors(region):
    spark = region.df.sparkSession
    tables = {
        "tibble": t.tibble(x=[1, 2], y=f.x * 2.0, spark=spark), "tribble": t.tribble(f.x, f.y, 1, 2.0, 3, 4.0, spark=spark), "row": t.tibble_row(x=5, y=6.0, spark=spark), "frame": t.enframe([7.0, 8.0], name="x", value="y", spark=spark),
        "diag": t.diag(2, spark=spark) >> t.set_colnames(["x", "y"]), "outer": t.outer([1, 2], [3, 4], spark=spark) >> t.set_colnames(["x", "y"]), "dict": t.as_tibble({"x": [9], "y": [9.5]}, spark=spark), "short": t.tibble_(x=1, y=1.5, spark=spark),
    }
    return t.bind_rows(_id="src", **{k: v >> t.transmute(x=t.as_integer(f.x), y=t.as_double(f.y)) for k, v in tables.items()})


@query("select 'b' as key, 1 as r0, 3 as r1 union all select 'c', 2, 4")
def transposed(region):
    return t.tibble(a=["r0", "r1"], b=[1, 3], c=[2, 4], spark=region.df.sparkSession) >> t.t()


# ---- groups ----


@query("select n_name, n_regionkey, dense_rank() over (order by n_regionkey) - 1 as gid, dense_rank() over (order by n_regionkey) - 1 as gix, n_regionkey as k from nation")
def group_ids(nation):
    keyed = nation >> t.group_by(f.n_regionkey, _sort=True, _dropna=True)
    return keyed >> t.mutate(gid=t.cur_group_id(), k=t.cur_group().n_regionkey) >> t.group_indices(name="gix") >> t.ungroup() >> t.select(f.n_name, f.n_regionkey, f.gid, f.gix, f.k)


@query("select n_regionkey, count(*)::int as n, count(*)::int as m, count(*)::int as rows, count(*)::int as data, min(i)::int as first_row from (select *, row_number() over (order by n_nationkey) - 1 as i from nation) group by all")
def group_tables(nation):
    keyed = nation >> t.arrange(f.n_nationkey) >> t.group_by(f.n_regionkey)
    data = keyed >> t.group_data() >> t.mutate(rows=t.lengths(f._rows), first_row=t.as_integer(t.itemgetter(f._rows, 0)))
    seen = keyed >> t.summarise(n=t.lengths(t.cur_data()), m=t.lengths(t.cur_data_all()))
    return keyed >> t.group_keys() >> t.left_join(seen, by="n_regionkey") >> t.left_join(data >> t.mutate(data=f.rows) >> t.select(f.n_regionkey, f.rows, f.data, f.first_row), by="n_regionkey")


@query("select n_regionkey, count(*) as n, max(n_nationkey) as top from nation group by all")
def with_groups(nation):
    return nation >> t.with_groups(f.n_regionkey, t.summarise, n=t.n(), top=t.max_(f.n_nationkey))


@query("select n_regionkey, i - 1 as position from (select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)")
def cur_group_rows(nation):
    return nation >> t.arrange(f.n_nationkey) >> t.group_by(f.n_regionkey) >> t.summarise(position=t.cur_group_rows())


@query("select o_orderpriority, count(*) over () as n from orders")
def add_tally(orders):
    return orders >> t.add_tally() >> t.select(f.o_orderpriority, f.n)


@query("select b as bin, count(c_nationkey) as n from (select unnest(range(1, 26)) as b) left join customer on c_nationkey = b group by all")
def tabulate(customer):
    return customer >> t.tabulate(f.c_nationkey, 25)


@query("""select c_mktsegment, min(c_acctbal) as lo, round(ln(product(1 + c_nationkey / 1000.0::double)), 4) as pr, bool_and(c_acctbal > -2000) as al, bool_or(c_acctbal > 9000) as an, false as na, count(*) as le, false as tr, false as fa,
 arg_max(i, (c_acctbal, -i)) - 1 as wx, arg_min(i, (c_acctbal, i)) - 1 as wn, count(*) filter (c_acctbal < 0)::int as ws, count(distinct c_nationkey)::int as un, arg_min(i, (c_acctbal, i))::int - 1 as od, count(*) filter (c_name like '%7')::int as gr, count(*) filter (c_name like '%7')::int as gv
 from (select *, row_number() over (partition by c_mktsegment order by c_custkey) as i from customer) group by all""")
def positions_and_logic(customer):
    r = lambda e, d: t.round_(e, digits=d)
    keyed = customer >> t.arrange(f.c_custkey) >> t.rowid_to_column("at") >> t.group_by(f.c_mktsegment)
    out = keyed >> t.summarise(
        lo=t.min_(f.c_acctbal), p=t.prod(1 + f.c_nationkey / 1000.0), al=t.all_(f.c_acctbal > -2000), an=t.any_(f.c_acctbal > 9000), na=t.any_na(f.c_acctbal), le=t.length(f.c_acctbal), tr=t.is_true(f.c_acctbal > 0), fa=t.is_false(f.c_acctbal > 0),
        wx=t.which_max(f.c_acctbal, order_by=f.at), wn=t.which_min(f.c_acctbal, order_by=f.at), ws=t.lengths(t.which(f.c_acctbal < 0)), un=t.lengths(t.unique(f.c_nationkey)), od=t.as_integer(t.itemgetter(t.order(f.c_acctbal), 0)),
        gr=t.lengths(t.grep("7$", f.c_name)), gv=t.lengths(t.grep("7$", f.c_name, value=True)),
    )
    return out >> t.ungroup() >> t.transmute(
        f.c_mktsegment, f.lo, pr=r(t.log(f.p), 4), al=f.al, an=f.an, na=f.na, le=f.le, tr=f.tr, fa=f.fa, wx=f.wx, wn=f.wn, ws=f.ws, un=f.un, od=f.od, gr=f.gr, gv=f.gv,
    )


@query("""select round(sum(c_acctbal), 2) as s, round(avg(c_acctbal), 4) as m, round(stddev_samp(c_acctbal), 4) as d, round(median(c_acctbal), 4) as q from customer""")
def column_statistics(customer):
    one = customer >> t.select(f.c_acctbal)
    r = lambda verb, name, digits: one >> verb() >> t.transmute(**{name: t.round_(f.c_acctbal, digits=digits)})
    return t.bind_cols(r(t.col_sums, "s", 2), r(t.col_means, "m", 4), r(t.col_sds, "d", 4), r(t.col_medians, "q", 4))


@query("""select l_orderkey, l_linenumber, round((l_tax + l_discount) / 2, 8) as m, round(abs(l_tax - l_discount) / sqrt(2), 8) as d, round((l_tax + l_discount) / 2, 8) as q, case when l_tax >= l_discount then 0 else 1 end as mc from lineitem""")
def row_statistics(lineitem):
    r = lambda e: t.round_(e, digits=8)
    return lineitem >> t.transmute(f.l_orderkey, f.l_linenumber, m=r(t.row_means(f.l_tax, f.l_discount)), d=r(t.row_sds(f.l_tax, f.l_discount)), q=r(t.row_medians(f.l_tax, f.l_discount)), mc=t.as_integer(t.max_col(f.l_tax, f.l_discount)))


@query("select c_custkey, round(c_acctbal / sum(c_acctbal) over (partition by c_mktsegment), 10) as p from customer")
def proportions(customer):
    return customer >> t.group_by(f.c_mktsegment) >> t.transmute(f.c_custkey, p=t.round_(t.proportions(f.c_acctbal), digits=10)) >> t.ungroup() >> t.select(f.c_custkey, f.p)


@query("select c_mktsegment, 1 as s from customer group by all")
def sample(customer):
    drawn = customer >> t.group_by(f.c_mktsegment) >> t.summarise(v=t.lengths(t.sample(f.c_custkey, size=1)), w=t.lengths(t.sample(f.c_custkey, size=3, replace=True)))
    return drawn >> t.transmute(f.c_mktsegment, s=f.v + f.w - 3)


# ---- ranks and running values ----


@query("""select c_custkey, rank() over w + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0::double as r, min(c_acctbal) over r as lo, round(exp(sum(ln(1 + c_nationkey / 1000.0::double)) over r), 8) as pr, c_acctbal - 2 * lag(c_acctbal, 1) over o + lag(c_acctbal, 2) over o as d2,
 lead(c_custkey) over (partition by c_mktsegment order by c_acctbal, c_custkey) as nx, lag(c_custkey) over (partition by c_mktsegment order by c_acctbal, c_custkey) as pv, row_number() over (partition by c_mktsegment, c_nationkey order by c_custkey) > 1 as du, row_number() over o as sa
 from customer window w as (partition by c_mktsegment order by c_nationkey), o as (partition by c_mktsegment order by c_custkey), r as (partition by c_mktsegment order by c_custkey rows unbounded preceding)""")
def more_windows(customer):
    return (
        customer
        >> t.arrange(f.c_custkey)
        >> t.group_by(f.c_mktsegment)
        >> t.mutate(
            r=t.rank(f.c_nationkey), lo=t.cummin(f.c_acctbal), pr=t.round_(t.cumprod(1 + f.c_nationkey / 1000.0), digits=8), d2=t.diff(f.c_acctbal, differences=2), key=t.row_number(f.c_acctbal), du=t.duplicated(f.c_nationkey), sa=t.seq_along(),
        )
        >> t.mutate(nx=t.order_by(f.key, t.lead(f.c_custkey)), pv=t.with_order(f.key, t.lag, f.c_custkey))
        >> t.ungroup()
        >> t.select(f.c_custkey, f.r, f.lo, f.pr, f.d2, f.nx, f.pv, f.du, f.sa)
    )


# ---- factors: an order of levels is told by each value's code ----

_SEG = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"


@query(f"""select s as c_mktsegment, i::int as base, 5 as nl, 5 - 1 - i::int as rv, ((i::int - 1) + 5) % 5 as sh, 4 - i::int as re, i::int as ex, i::int as dr, case when i = 4 then 0 else i::int + 1 end as lr, 'L' || i as va, s in ('BUILDING', 'FURNITURE') as ma, lower(s) as lo, 5 as un, 6 as uf, 'seg' as fu, 5 as ca
from (select distinct c_mktsegment as s, list_position({_SEG}, c_mktsegment) - 1 as i from customer)""")
def level_orders(customer):
    code = t.as_integer
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    small = customer >> t.select(f.c_mktsegment) >> t.distinct() >> t.mutate(g=t.factor(f.c_mktsegment, levels=names))
    made = small >> t.mutate(
        rv_=t.fct_rev(f.g), sh_=t.fct_shift(f.g), re_=t.lvls_reorder(f.g, [4, 3, 2, 1, 0]), ex_=t.fct_expand(f.g, "NEW"), dr_=t.fct_drop(f.g), le_=t.lvls_expand(f.g, [*names, "LAST"]), lr_=t.fct_relevel(f.g, "MACHINERY"),
        va=t.lvls_revalue(f.g, [f"L{i}" for i in range(5)]), lo=t.fct_relabel(f.g, str.lower), fu=t.fct_recode(f.g, seg=names), uf_=t.fct_unify(f.g, t.fct_recode(f.g, seg=["BUILDING"]))[0],
    )
    levels = {k: len(made >> t.levels(f[k])) for k in ("uf_",)}
    return made >> t.transmute(
        f.c_mktsegment, base=code(f.g), nl=t.nlevels(t.droplevels(f.dr_)), rv=code(f.rv_), sh=code(f.sh_), re=code(f.re_), ex=code(f.ex_), dr=code(f.le_), lr=code(f.lr_), va=f.va, ma=t.fct_match(f.g, ["BUILDING", "FURNITURE"]), lo=f.lo,
        un=len(small >> t.fct_unique(f.g)), uf=levels["uf_"], fu=f.fu, ca=t.lengths(t.pd_cat(f.g).categories),
    )


@query("""with m as (select c_mktsegment as s, count(*) as n, median(c_acctbal) as md, arg_max(c_nationkey, c_custkey) as la, arg_min(c_nationkey, c_custkey) as fi, min(c_custkey) as first_seen from customer group by all)
select s as c_mktsegment, rank() over (order by md)::int - 1 as ro, row_number() over (order by la desc, s)::int - 1 as r2, row_number() over (order by first_seen)::int - 1 as io, la, fi from m""")
def levels_by_data(customer):
    code = t.as_integer
    made = customer >> t.arrange(f.c_custkey) >> t.rowid_to_column("at") >> t.mutate(g=t.factor(f.c_mktsegment)) >> t.mutate(ro_=t.fct_reorder(f.g, f.c_acctbal), r2_=t.fct_reorder2(f.g, f.at, f.c_nationkey), io_=t.fct_inorder(f.g))
    coded = made >> t.mutate(ro=code(f.ro_), r2=code(f.r2_), io=code(f.io_))
    ends = customer >> t.group_by(f.c_mktsegment) >> t.summarise(la=t.last2(f.c_custkey, f.c_nationkey), fi=t.first2(f.c_custkey, f.c_nationkey))
    return coded >> t.select(f.c_mktsegment, f.ro, f.r2, f.io) >> t.distinct() >> t.left_join(ends, by="c_mktsegment")


@query("""with n as (select o_orderpriority as p, count(*) as n, sum(count(*)) over () as total from orders group by all), k as (select p, case when n >= total / 5.0 then p else 'Other' end as lm from n)
select p as o_orderpriority, k.lm, case when (select count(*) from n where n / total <= 0.2) <= 1 then p when n / total > 0.2 then p else 'Other' end as lp, p as lw, p as ll, 5::int as anon, left(p, 1)::int - 1 as seq, 5 as shuffled from n join k using (p)""")
def lumps(orders):
    share = (orders >> t.nrow()) / 5
    made = orders >> t.mutate(
        lm=t.fct_lump_min(f.o_orderpriority, share), lp=t.fct_lump_prop(f.o_orderpriority, 0.2), lw=t.fct_lump_lowfreq(f.o_orderpriority), ll=t.fct_lump(f.o_orderpriority, n=5), an=t.fct_anon(f.o_orderpriority), q_=t.factor(t.substr(f.o_orderpriority, 0, 1)),
        sf=t.fct_shuffle(f.o_orderpriority),
    )
    coded = made >> t.mutate(seq=t.as_integer(f.q_), anon=len(made >> t.levels(f.an)), shuffled=len(made >> t.levels(f.sf)))
    return coded >> t.select(f.o_orderpriority, f.lm, f.lp, f.lw, f.ll, f.anon, f.seq, f.shuffled) >> t.distinct()


@query("select n_name, 30 as levels, 2 as values_of, n_name as a, (n_nationkey % 10)::int as code from nation")
def joined_factors(nation):
    made = nation >> t.mutate(x=t.factor(f.n_name), y=t.factor(t.as_character(f.n_regionkey)), z_=t.factor(t.as_character(f.n_nationkey % 10)))
    made = made >> t.mutate(z=t.fct_inseq(f.z_))
    return made >> t.transmute(f.n_name, levels=t.lengths(t.lvls_union(f.x, f.y)), values_of=t.lengths(t.fct_c(f.x, f.y)), a=t.itemgetter(t.fct_c(f.x, f.y), 0), code=t.as_integer(f.z))


@query("select o_orderstatus, count(*) as n from orders group by all")
def group_trim(orders):
    made = orders >> t.mutate(g=t.factor(f.o_orderstatus, levels=["F", "O", "P", "none"])) >> t.group_by(f.g) >> t.group_trim()
    return made >> t.summarise(n=t.n()) >> t.transmute(o_orderstatus=t.as_character(f.g), n=f.n)


# ---- grids ----


@query("select x, y from (values (1), (2)) a(x), (values ('u'), ('v'), ('w')) b(y) union all select x + 10, y from (values (1), (2)) a(x), (values ('u'), ('v')) b(y)")
def grids(region):
    spark = region.df.sparkSession
    one = t.expand_grid(x=[1, 2], y=["u", "v", "w"], spark=spark)
    two = t.crossing(x=[12, 11], y=["v", "u"], spark=spark)
    return t.bind_rows(one >> t.transmute(x=t.as_integer(f.x), y=f.y), two >> t.transmute(x=t.as_integer(f.x), y=f.y))


@query("select n_regionkey, n_nationkey from nation")
def nesting(nation):
    return nation >> t.expand(t.nesting(f.n_regionkey, f.n_nationkey))


# ---- user functions and verbs ----


@query("select c_mktsegment, round(avg(c_acctbal) * 2, 4) as twice, count(*)::int as n, round(max(c_acctbal), 4) as top, round(avg(c_acctbal) + 1, 4) as more from customer group by all")
def user_functions(customer):
    mean_of = t.func_factory(lambda x: float(x.mean()), kind="agg", post=lambda e: e * 2)
    longest = t.register_func(lambda x: x.sort_values(), kind="apply", returns="double")
    plus = t.func_bootstrap(t.identity, kind="transform")(lambda x: x + 1)
    rounded = t.register_verb(lambda tbl: tbl >> t.mutate(twice=t.round_(f.twice, digits=4), more=t.round_(f.more, digits=4)))
    out = customer >> t.group_by(f.c_mktsegment) >> t.summarise(twice=mean_of(f.c_acctbal), sorted=longest(f.c_acctbal)) >> t.ungroup() >> t.mutate(m=f.twice / 2)
    return out >> t.mutate(more=plus(f.m)) >> rounded() >> t.transmute(f.c_mktsegment, twice=f.twice, n=t.lengths(f.sorted), top=t.round_(t.itemgetter(f.sorted, -1), digits=4), more=f.more)
