"""ANSI SQL with the meaning of each registered query, for a second engine on the same tables."""

from __future__ import annotations

from scoretide.functions.normal import (
    ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, ACKLAM_SPLIT, HART_DEN, HART_NUM, HART_SPLIT, SQRT_2PI,
)
from scoretide.plans.views import DRAW_ORDER, INDICATORS, SAMPLER_ORDER

# shared subqueries

PANEL = """panel_raw as (
 select c.c_name as name,
  case when c.c_custkey % 97 = 13 then null else concat('T', cast(c.c_custkey % 97 as varchar)) end as ticker,
  case when year(o.o_orderdate) >= 2000 then concat('I', cast(c.c_custkey as varchar)) end as issuerid,
  cast(year(o.o_orderdate) as int) as period, min(o.o_orderkey) as row_ord, c.c_acctbal,
  max(case when o.o_orderpriority='1-URGENT' then 1 else 0 end) as pri_str_a,
  max(case when o.o_orderpriority='2-HIGH' then 1 else 0 end) as pri_str_b,
  max(case when o.o_orderpriority='5-LOW' then 1 else 0 end) as pri_con_a,
  max(case when o.o_orderstatus='F' then 1 else 0 end) as sta_str_a,
  max(case when o.o_orderstatus='P' then 1 else 0 end) as sta_con_a,
  cast(sum(case when o.o_totalprice > 250000 then 1 else 0 end) as int) as val_str_a,
  case when year(o.o_orderdate) >= 1997
       then cast(sum(case when o.o_totalprice < 50000 then 1 else 0 end) as int) end as val_con_a,
  count(*) as pri_str_num
 from orders o join customer c on o.o_custkey = c.c_custkey
 group by c.c_name, c.c_custkey, c.c_acctbal, year(o.o_orderdate))"""

RAW_OBS = PANEL + ", raw_obs as (" + " union all ".join(
    f"select name, period, '{i}' as indicator, {i} as y from panel_raw where {i} is not null" for i in INDICATORS
) + ")"
OBS = RAW_OBS + ", obs as (select name, period, indicator, case when y >= 2 then 1 else y end as y from raw_obs)"
THETA = ", theta as (select name, period, (c_acctbal - 4500) / 4500 + 0.05 * (period - 1998) as theta from panel_raw)"
ITEMS = """, items as (select indicator, period, 0.02 * (period - 1998) as alpha,
 case when contains(indicator, '_con_') then -0.5 else 0.8 end as beta from (select distinct indicator, period from obs) q)"""
EP = """, ep as (select distinct name, period from obs), lagged as (select name, period,
 lag(period) over (partition by name order by period) as prev_period from ep)"""
ANCHORS = """, anchors as (select min(name) as low, max(name) as high from (
 select name from ep group by name having count(*) = (select count(distinct period) from ep)) q)"""

LINES = "lines as (select * from lineitem)"
DRAWS = LINES + f""", dealt as (select l_suppkey, l_extendedprice,
 row_number() over (partition by l_suppkey order by {', '.join(DRAW_ORDER)}, l_linenumber) - 1 as place,
 count(*) over (partition by l_suppkey) as n from lines)
, chained as (select *, case when n % 4 = 0 then 4 when n % 3 = 0 then 3 when n % 2 = 0 then 2 else 1 end as c from dealt)
, draws as (select l_suppkey as idx, cast(place % c + 1 as int) as chain, l_extendedprice as value, place // c + 1 as iteration from chained)"""
EP_TABLE = """ep_table as (select concat('N', cast(s_nationkey as varchar)) as ticker, s_suppkey as ep_idx,
 cast(row_number() over (partition by s_nationkey order by s_suppkey) as int) as period_idx from supplier)"""
META = """meta as (select distinct n_name as name, e.ticker, 1990 + e.period_idx as year
 from ep_table e join nation n on e.ticker = concat('N', cast(n.n_nationkey as varchar)) where e.period_idx % 5 <> 0)"""
QUANTILES = [(5, "pct05"), (10, "pct10"), (25, "pct25"), (50, "pct50"), (75, "pct75"), (90, "pct90"), (95, "pct95")]


def summary(value: str, digits: int = 6, prefix: str = "", only: tuple[str, ...] = ()) -> str:
    """The eleven summary columns of a value expression."""
    parts = {"mean": f"avg({value})", "sd": f"stddev_samp({value})", "min": f"min({value})"}
    parts |= {name: f"quantile_cont({value}, {q / 100})" for q, name in QUANTILES}
    parts["max"] = f"max({value})"
    return ", ".join(
        f'round({e}, {digits}) as "{prefix}{n}"' for n, e in parts.items() if not only or n in only
    )


SCORES = f"""{LINES}, {EP_TABLE}, {META}, scores as (
 select m.name, e.ticker, 1990 + e.period_idx as year, d.* from (
  select l_suppkey as idx, avg(l_extendedprice) as mean, stddev_samp(l_extendedprice) as sd, min(l_extendedprice) as mn,
   max(l_extendedprice) as mx, {', '.join(f'quantile_cont(l_extendedprice, {q / 100}) as {n}' for q, n in QUANTILES)}
  from lines group by l_suppkey) d
 left join ep_table e on d.idx = e.ep_idx left join meta m on m.ticker = e.ticker and m.year = 1990 + e.period_idx)"""
CENTRED = SCORES + ", centred as (select ticker, year, mean / 1000 - 52 as mean, sd from scores)"
SCORE_OBS = """, score_obs as (select e.ticker, 1990 + e.period_idx as year, count(*) as n_items from (
 select distinct l_suppkey, l_partkey from lineitem) l join ep_table e on l.l_suppkey = e.ep_idx group by 1, 2)"""
ITEM_KEPT = ("mean", "sd", "pct05", "pct50", "pct95")
ITEM_PARAMS = f"""{LINES}, params as (
 select concat(case when p_size % 2 = 0 then 'par_str_' else 'par_con_' end, cast(p_partkey as varchar)) as item_col,
  cast(1990 + p_size % 7 + 1 as int) as year, p_partkey as item_idx, d.* exclude (idx) from part left join (
  select l_partkey as idx, {summary('l_quantity / 10 - 2.5', prefix='alpha_', only=ITEM_KEPT)},
   {summary('20 * l_discount - 1', prefix='beta_', only=ITEM_KEPT)} from lines group by l_partkey) d on d.idx = p_partkey)"""
SAMPLER = LINES + f""", sampler as (select l_linenumber as chain, l_extendedprice as energy,
 case when l_tax > 0.079 then 1 else 0 end as divergent, cast(floor(l_quantity / 5) as int) as treedepth,
 row_number() over (partition by l_linenumber order by {', '.join(SAMPLER_ORDER)}) as iteration from lines)
, diagnostics as (select chain, count(*) as n_draws, cast(sum(divergent) as bigint) as n_divergent,
 count(*) filter (where treedepth >= 10) as n_max_treedepth,
 var_samp(energy - prev) / var_samp(energy) as ebfmi from (
 select *, lag(energy) over (partition by chain order by iteration) as prev from sampler) q group by chain)"""


def poly(x: str, coefs: list[float]) -> str:
    out = repr(coefs[0]) + "::double"
    for c in coefs[1:]:
        out = f"({out} * {x} + ({c!r})::double)"
    return out


def mills(z: str) -> str:
    fraction = f"({z} + 0.65::double)"
    for k in (4, 3, 2, 1):
        fraction = f"({z} + {k}.0::double / {fraction})"
    return (f"(case when {z} < {HART_SPLIT}::double then {poly(z, HART_NUM)} / {poly(z, HART_DEN)} "
            f"else 1.0::double / ({fraction} * {SQRT_2PI}::double) end)")


def cdf(x: str) -> str:
    tail = f"(exp(-({x}) * ({x}) / 2) * {mills(f'abs({x})')})"
    return f"(case when {x} > 0 then 1 - {tail} else {tail} end)"


def log_cdf(x: str) -> str:
    m = mills(f"abs({x})")
    tail = f"(exp(-({x}) * ({x}) / 2) * {m})"
    return f"(case when {x} > 0 then ln(1 - {tail}) else ln({m}) - ({x}) * ({x}) / 2 end)"


def quantile(p: str) -> str:
    low, high, q, r = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    return (f"(case when {p} < {ACKLAM_SPLIT} then {poly(low, ACKLAM_C)} / {poly(low, ACKLAM_D)} "
            f"when {p} > {1 - ACKLAM_SPLIT} then -{poly(high, ACKLAM_C)} / {poly(high, ACKLAM_D)} "
            f"else {poly(r, ACKLAM_A)} * {q} / {poly(r, ACKLAM_B)} end)")


MU = OBS + THETA + ITEMS + """, mu as (select o.*, i.beta * t.theta - i.alpha as mu from obs o
 join theta t on o.name = t.name and o.period = t.period join items i on o.indicator = i.indicator and o.period = i.period)
, signed as (select *, case when y = 1 then mu else -mu end as s from mu)"""
LOG_LIK = MU + f", ll as (select *, {log_cdf('s')} as log_lik from signed)"
POINTWISE = OBS + THETA + ITEMS + f""", sampled as (select o.*, d.draw,
  (i.beta * (1 + 0.1 * (d.draw - 2))) * (t.theta + 0.1 * (d.draw - 2.5)) - (i.alpha + 0.05 * (d.draw - 2)) as mu
 from obs o join theta t on o.name = t.name and o.period = t.period
 join items i on o.indicator = i.indicator and o.period = i.period, (select unnest([1, 2, 3, 4]) as draw) d)
, ll as (select *, {log_cdf('s')} as log_lik from (select *, case when y = 1 then mu else -mu end as s from sampled) q)
, pointwise as (select name, indicator, period, count(*) as n_draws, ln(avg(exp(log_lik))) as lppd,
  var_samp(log_lik) as p_waic from ll group by name, indicator, period)"""
STEPS = OBS + EP + ANCHORS + """, steps as (select l.name, l.period,
  case when l.prev_period is null or l.period > l.prev_period + 1 then 1 else 0 end as fresh,
  case when l.prev_period is null and l.name = a.low then -1.0
       when l.prev_period is null and l.name = a.high then 1.0 end as pin,
  (p.row_ord % 7 - 3) / 2.0 as z, 0.5 as sigma_init, 0.1 + (abs(p.c_acctbal) % 10) / 100 as sigma
 from lagged l join panel_raw p on l.name = p.name and l.period = p.period, anchors a)"""

SIZED = DRAWS + """, sizes as (select idx, min(n) as n, count(*) as n_chains from (
 select idx, chain, count(*) as n from draws group by idx, chain) q group by idx)
, sized as (select d.*, s.n, s.n_chains, s.n // 2 as n_half from draws d join sizes s on d.idx = s.idx where d.iteration <= s.n)
, split as (select *, case when iteration > n - n_half then 1 else 0 end as half,
  case when iteration > n - n_half then iteration - (n - n_half) else iteration end as pos
 from sized where iteration <= n_half or iteration > n - n_half)"""


def z_of(source: str, keys: str, value: str) -> str:
    p = "((r - 0.375) / (n_half * 2 * n_chains + 0.25))"
    return f"""(select *, {quantile(p)} as z from (select *,
 rank() over (partition by {keys} order by {value}) + (count(*) over (partition by {keys}, {value}) - 1) / 2.0 as r
 from {source}) rk)"""


RHAT = SIZED + """, med as (select idx, quantile_cont(value, 0.5) as m from sized group by idx)
, kinds as (select idx, chain, half, n_half, n_chains, 'bulk' as kind, value as v from split union all
 select s.idx, chain, half, n_half, n_chains, 'fold', abs(value - m) from split s join med on s.idx = med.idx)
, halves as (select idx, kind, chain, half, n_half, avg(z) as m, var_samp(z) as v from """ + z_of("kinds", "idx, kind", "v") + """ q
 group by idx, kind, chain, half, n_half)
, per_kind as (select idx, kind, sqrt(((n_half - 1) * 1.0 / n_half * avg(v) + var_samp(m)) / avg(v)) as r
 from halves group by idx, kind, n_half)
, rhats as (select idx, max(case when kind = 'bulk' then r end) as rhat_bulk, max(case when kind = 'fold' then r end) as rhat_fold,
  max(r) as rhat from per_kind group by idx)"""

# Effective size by sums over pairs of positions; Geyer's pairs by window functions.
ESS = SIZED + """, ends as (select idx, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from sized group by idx)
, zed as """ + z_of("split", "idx", "value") + """
, series as (select idx, chain, half, pos, n_half, n_chains, 'z' as series, z as x from zed union all
 select s.idx, chain, half, pos, n_half, n_chains, 'lo', case when value <= lo then 1.0 else 0.0 end from split s join ends e on s.idx = e.idx union all
 select s.idx, chain, half, pos, n_half, n_chains, 'hi', case when value <= hi then 1.0 else 0.0 end from split s join ends e on s.idx = e.idx)
, centred as (select *, x - avg(x) over (partition by idx, series, chain, half) as c from series)
, acov as (select a.idx, a.series, a.n_half, a.n_chains, b.pos - a.pos as lag, sum(a.c * b.c) / a.n_half / (2 * a.n_chains) as s
 from centred a join centred b on a.idx = b.idx and a.series = b.series and a.chain = b.chain and a.half = b.half and b.pos >= a.pos
 group by 1, 2, 3, 4, 5)
, means as (select idx, series, var_samp(m) as vm from (
 select idx, series, chain, half, avg(x) as m from series group by idx, series, chain, half) q group by idx, series)
, zero as (select a.idx, a.series, a.n_half, a.s * a.n_half / (a.n_half - 1) as w, a.s + m.vm as tot
 from acov a join means m on a.idx = m.idx and a.series = m.series where a.lag = 0)
, rho as (select a.*, case when a.lag = 0 then 1.0 else 1 - (z.w - a.s) / z.tot end as rho
 from acov a join zero z on a.idx = z.idx and a.series = z.series where z.tot > 1e-15 and z.w > 1e-15)
, pairs as (select idx, series, n_half, n_chains, lag // 2 as k, sum(rho) as p, max(case when lag % 2 = 0 then rho end) as even
 from rho group by 1, 2, 3, 4, 5 having count(*) = 2)
, stops as (select idx, series, min(k) as last from pairs where p <= 0 or 2 * k >= n_half - 5 group by idx, series)
, mono as (select p.*, s.last, min(p) over (partition by p.idx, p.series order by k) as mp
 from pairs p join stops s on p.idx = s.idx and p.series = s.series)
, tau as (select idx, series, n_half * 2 * n_chains as total,
  -1 + 2 * coalesce(sum(case when k < last then mp end), 0) + greatest(max(case when k = last then even end), 0) as tau
 from mono group by idx, series, n_half, n_chains)
, sizes_eff as (select idx, series, total / greatest(tau, 1 / log10(total)) as ess from tau)
, ess as (select idx, min(case when series = 'z' then ess end) as ess_bulk, min(case when series <> 'z' then ess end) as ess_tail
 from sizes_eff group by idx)"""
# the ESS text continues from the same split, so both can be chained
CONV = RHAT + ESS[len(SIZED):] + """, conv as (select r.idx, r.rhat, e.ess_bulk, e.ess_tail from rhats r join ess e on r.idx = e.idx)"""

TRAJ = f"""{LINES}, {EP_TABLE}, per as (select ticker, period_idx, l_linenumber as chain, avg(l_extendedprice) as m
 from lines join ep_table on l_suppkey = ep_idx group by 1, 2, 3)"""
BOTH = LINES + """, two as (select 'theta' as param, l_suppkey as idx, l_linenumber as chain, l_extendedprice / 10000 - 5 as value from lines
 union all select 'beta', l_partkey, l_linenumber, 20 * l_discount - 1 from lines)
, means as (select chain, param, idx, avg(value) as m from two group by chain, param, idx)"""
CHAIN_TEXT = LINES + """, days as (select l_linenumber as chain, cast(l_shipdate as date) as day,
 cast(count(*) as double) as lp__, sum(l_quantity) as energy__, cast(0 as double) as divergent__, max(l_quantity) as treedepth__,
 sum(case when l_returnflag = 'N' then l_quantity else 0 end) as t1,
 sum(case when l_returnflag = 'R' then l_quantity else 0 end) as t2,
 sum(case when l_returnflag = 'A' then l_quantity else 0 end) as t3,
 min(l_quantity) as sigma_global from lines group by 1, 2)
, numbered as (select *, row_number() over (partition by chain order by day) as iteration from days)"""
CHAIN_CELLS = [("lp__", 0, "lp__"), ("energy__", 0, "energy__"), ("divergent__", 0, "divergent__"),
               ("treedepth__", 0, "treedepth__"), ("theta", 1, "t1"), ("theta", 2, "t2"), ("theta", 3, "t3"),
               ("sigma_global", 0, "sigma_global")]
FIRST_KEEPS = PANEL + """, pairs as (select ticker, name, min(period) as p, min_by(row_ord, period) as o
 from panel_raw where ticker is not null group by ticker, name)
, ranked as (select ticker, name, row_number() over (partition by ticker order by p, o) as k from pairs)"""
SPACED = """spaced as (select param, idx from (select param, cast(round_even(1 + j * (n - 1) / 49.0, 0) as bigint) as idx from (
 select 'alpha' as param, max(l_partkey) as n from lineitem union all
 select 'beta', max(l_partkey) from lineitem) q, (select unnest(range(50)) as j) g) s group by param, idx)"""


def coded(select: str) -> str:
    """Key resolution period by period as common tables: what came before, the id stage, the name stage."""
    parts = [PANEL, """log0 as (select null::varchar as name, null::varchar as old_key, null::varchar as new_key, 0 as year_created,
 0 as stage, 0::bigint as key_ord, 0::bigint as place where false), done0 as (select null::bigint as row_ord, null::varchar as name,
 null::varchar as issuerid, null::varchar as key where false)"""]
    for k, period in enumerate(range(1995, 2002)):
        before = "year_created, stage, key_ord, place"
        top = "select old_key, max(try_cast(regexp_extract(new_key, '\\.([0-9]+)$', 1) as int)) as top from {log} group by old_key"
        named = "concat({a}.key, '.', cast(coalesce(top + 1, 2) + place - 1 as varchar)) as new_key"
        parts += [
            f"""cur{k} as materialized (select p.row_ord, p.name, p.issuerid, coalesce(l.new_key, p.ticker) as key from panel_raw p left join (
 select name, last(new_key order by {before}) as new_key from log{k} group by name) l on p.name = l.name where p.period = {period})""",
            f"""ids{k} as materialized (select *, count(*) over (partition by key) as n, min(ord) over (partition by key) as key_ord from (
 select key, issuerid, name, min(row_ord) as ord from cur{k} where issuerid <> '' and key is not null group by 1, 2, 3) q qualify n > 1)""",
            f"""keeper{k} as materialized (select i.key, case when max(past.key) is not null then min(case when s.key is not null then i.issuerid end)
 else min(i.issuerid) end as keeper from ids{k} i left join (select distinct key, issuerid from done{k} where issuerid is not null) s
 on s.key = i.key and s.issuerid = i.issuerid left join (select distinct key from done{k} where issuerid is not null) past on past.key = i.key group by i.key)""",
            f"""idnames{k} as materialized (select m.*, {named.format(a='m')} from (select i.*, row_number() over (partition by i.key order by i.issuerid, i.ord) as place
 from ids{k} i join keeper{k} e on e.key = i.key where i.issuerid <> e.keeper) m left join ({top.format(log=f'log{k}')}) t on t.old_key = m.key)""",
            f"""mid{k} as materialized (select * from log{k} union all select name, key, new_key, {period}, 1, key_ord, place from idnames{k})""",
            f"""moved{k} as materialized (select c.row_ord, c.name, c.issuerid, coalesce(l.new_key, c.key) as key from cur{k} c left join (
 select issuerid, last(new_key order by key_ord, place) as new_key from idnames{k} group by issuerid) l on l.issuerid = c.issuerid)""",
            f"""claims{k} as materialized (select *, count(*) over (partition by key) as n, min(ord) over (partition by key) as key_ord from (
 select key, name, min(row_ord) as ord from moved{k} where key is not null group by 1, 2) q qualify n > 1)""",
            f"""fresh{k} as materialized (select * from (select *, row_number() over (partition by name order by key_ord, key, ord) as nth from claims{k} c where not exists (
 select 1 from (select key, name from done{k} union all select old_key, name from mid{k}) b where b.key = c.key and b.name is not distinct from c.name)) q
 where nth = 1 or name is null)""",
            f"""names{k} as materialized (select m.*, {named.format(a='m')} from (select *, row_number() over (partition by key order by ord) as place from fresh{k}) m
 left join ({top.format(log=f'mid{k}')}) t on t.old_key = m.key)""",
            f"""log{k + 1} as materialized (select * from mid{k} union all select name, key, new_key, {period}, 2, key_ord, place from names{k})""",
            f"""done{k + 1} as materialized (select * from done{k} union all select m.row_ord, m.name, m.issuerid, coalesce(l.new_key, m.key) from moved{k} m left join (
 select name, last(new_key order by key_ord) as new_key from names{k} group by name) l on l.name = m.name)""",
        ]
    parts.append("""coded as (select p.name, p.period, p.ticker, coalesce(d.key, p.ticker) as new_key from panel_raw p left join done7 d on d.row_ord = p.row_ord)""")
    return "with " + ", ".join(parts) + " " + select


def w(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"


def oracle() -> dict[str, str]:
    wide = "select name, " + ", ".join(
        f"max(case when indicator = '{i}' and period = {p} then y end) as {i}_{p}"
        for p in range(1995, 2002) for i in INDICATORS if not (i == "val_con_a" and p < 1997)
    ) + " from obs group by name"
    clamp = ", ".join(f"case when {i} >= 2 then 1 else {i} end as {i}" for i in INDICATORS)
    stat = lambda e: f"round({e}, 6)"
    return {
        "clean_panel": w(PANEL, f"select name, ticker, issuerid, period, row_ord, {clamp} from panel_raw"),
        "validate_binary": w(RAW_OBS, """select indicator, period, count(*) as n_bad, min(y) as min_y, max(y) as max_y
            from raw_obs where y not in (0, 1) group by indicator, period"""),
        "restrict_universe": w(PANEL, """, keyed as (select case when row_ord % 11 <> 0 then ticker end as ticker, period, name, row_ord from panel_raw)
            select name, ticker, period, row_ord from keyed c
            where exists (select 1 from keyed s where s.period <= 1995 and s.ticker is not distinct from c.ticker)"""),
        "apply_overrides": w(PANEL, """select name, period, case
            when name in ('Customer#000000013', 'Customer#000000007') then 'R1'
            when ticker = 'T5' then 'T5X' else ticker end as ticker from panel_raw"""),
        "items_by_period": w(OBS, "select period, indicator, count(*) as n_obs from obs group by period, indicator"),
        "dedup_first": w(PANEL, """select ticker, period, name, row_ord from (select *, row_number() over (
            partition by ticker, period order by row_ord) as k from panel_raw) q where k = 1"""),
        "duplicate_keys": w(PANEL, "select period, ticker, count(*) as n_rows from panel_raw group by 1, 2 having count(*) > 1"),
        "collisions": w(PANEL, """select period, ticker, count(distinct coalesce(name, '?')) as n_claims from panel_raw
            group by 1, 2 having count(distinct coalesce(name, '?')) > 1"""),
        "collisions_by_id": w(PANEL, """select period, ticker, count(*) as n_claims from (
            select distinct period, ticker, issuerid, name from panel_raw where issuerid is not null and issuerid <> '') q
            group by 1, 2 having count(*) > 1"""),
        "resolve_first_keeps": w(FIRST_KEEPS, """select p.name, p.period, p.ticker,
            case when r.k > 1 then concat(p.ticker, '.', cast(r.k as varchar)) else p.ticker end as new_key
            from panel_raw p left join ranked r on p.ticker = r.ticker and p.name = r.name"""),
        "resolve_coded": coded("select * from coded"),
        "resolve_resumed": coded("select * from coded"),
        "unresolved": coded("""select period, new_key, count(distinct coalesce(name, '?')) as n_names from coded where new_key is not null
            group by 1, 2 having count(distinct coalesce(name, '?')) > 1"""),
        "resolution_log": coded("select name, old_key, new_key, year_created, stage from log7"),
        "lost_rows": coded("""select period, cast(sum(n - 1) as bigint) as n_lost from (
            select period, new_key, count(*) as n from coded group by 1, 2 having count(*) > 1) q group by period"""),
        "to_long": w(OBS, "select name, period, indicator, y from obs"),
        "subset_periods": w(OBS, "select name, period, indicator, y from obs where period between 1996 and 1998"),
        "to_wide": w(OBS, wide),
        "wide_round_trip": w(OBS, "select name, period, indicator, y from obs"),
        "complete_panel": w(PANEL, "select n.name, y.period, " + ", ".join(
            f"coalesce(case when p.{i} >= 2 then 1 else p.{i} end, -1) as {i}" for i in INDICATORS) + """
            from (select distinct name from panel_raw) n cross join (select distinct period from panel_raw) y
            left join panel_raw p on p.name = n.name and p.period = y.period"""),
        "item_index": w(OBS, """select item_col, period, row_number() over (order by period, item_col) as item_idx from (
            select distinct concat(indicator, '_', cast(period as varchar)) as item_col, period from obs) q"""),
        "dense_index": w(OBS, """select name, period, row_number() over (order by name, period) as ep_idx,
            dense_rank() over (order by name) as entity_idx from (select distinct name, period from obs) q"""),
        "index_observations": w(OBS, """, ep as (select name, period, row_number() over (order by name, period) as ep_idx,
             dense_rank() over (order by name) as entity_idx from (select distinct name, period from obs) q)
            , it as (select indicator, period, row_number() over (order by period, concat(indicator, '_', cast(period as varchar))) as item_idx
             from (select distinct indicator, period from obs) q)
            select o.name, o.period, o.indicator, y, ep_idx, entity_idx, item_idx
            from obs o join ep on o.name = ep.name and o.period = ep.period
            join it on o.indicator = it.indicator and o.period = it.period"""),
        "period_index": w(PANEL, """select name, cast(period - (select min(period) - 1 from panel_raw) as int) as period_idx,
            period as year from panel_raw"""),
        "transitions": w(OBS + EP, "select name, prev_period, period from lagged where period = prev_period + 1"),
        "fresh_starts": w(OBS + EP, "select name, period from lagged where prev_period is null or period > prev_period + 1"),
        "classify_starts": w(OBS + EP + ANCHORS, """select name, period,
            case when prev_period is null and name = low then -1.0 when prev_period is null and name = high then 1.0 else 0.0 end as pin,
            case when prev_period is null and name in (low, high) then 'pinned' else 'free' end as kind
            from lagged, anchors where prev_period is null or period > prev_period + 1"""),
        "panel_dims": w(OBS + EP, """select (select count(*) from obs) as n_obs, (select count(*) from ep) as n_entity_periods,
            (select count(distinct name) from ep) as n_entities,
            (select count(*) - 2 from lagged where prev_period is null or period > prev_period + 1) as n_free_starts,
            (select count(*) from lagged where period = prev_period + 1) as n_transitions,
            (select count(*) from (select distinct indicator, period from obs) q) as n_items"""),
        "coverage": w(OBS, """select period, count(distinct name) as n_entities, count(*) as n_obs, cast(sum(y) as bigint) as n_ones,
            count(distinct indicator) as n_items, round(sum(y) * 1.0 / count(*), 6) as share_ones from obs group by period"""),
        "posterior_summary": w(LINES, f"select 'theta' as param, l_suppkey as idx, {summary('l_extendedprice')} from lines group by l_suppkey"),
        "scores": w(SCORES, "select name, ticker, year, round(mean, 6) as mean, round(sd, 6) as sd, round(mn, 6) as min, "
                    + ", ".join(f"round({n}, 6) as {n}" for _, n in QUANTILES) + ", round(mx, 6) as max from scores"),
        "item_params": w(ITEM_PARAMS, "select * from params"),
        "beta_sign_crosstab": w(ITEM_PARAMS, """select contains(item_col, '_con_') as is_concern, beta_mean < 0 as beta_neg, count(*) as n
            from params group by 1, 2"""),
        "anchor_check": w(CENTRED, """select a.ticker, count(mean) > 0 as found, count(mean) as n_periods,
            count(*) filter (where mean < 0) as n_negative,
            coalesce(bool_and(case when a.ticker = 'N3' then mean < 0 else mean > 0 end), false) as sign_ok
            from (values ('N3'), ('N7')) a(ticker) left join centred c on a.ticker = c.ticker group by a.ticker"""),
        "persistent_sign": w(CENTRED, """select ticker, count(*) as n_periods, round(avg(mean), 6) as mean, round(max(mean), 6) as max_mean
            from centred group by ticker having count(*) >= 2 and max(mean) < 0"""),
        "score_trend": w(CENTRED, """select year, count(*) as n, round(avg(mean), 6) as mean_score,
            round(stddev_samp(mean), 6) as sd_score from centred group by year"""),
        "precision_profile": w(CENTRED + SCORE_OBS, """select n_items, count(*) as n, round(avg(sd), 6) as mean_sd
            from centred c join score_obs o on c.ticker = o.ticker and c.year = o.year group by n_items"""),
        "precision_correlation": w(CENTRED + SCORE_OBS, """select count(*) as n, round(corr(n_items, sd), 6) as corr_items_sd
            from centred c join score_obs o on c.ticker = o.ticker and c.year = o.year"""),
        "draw_counts": w(LINES, """select chain, 'theta' as param, min(n) as min_draws, max(n) as max_draws, count(*) as n_params from (
            select l_linenumber as chain, l_suppkey, count(*) as n from lines group by 1, 2) q group by chain"""),
        "thin_draws": w(DRAWS, """select idx, chain, cast((iteration - 10) / 3 as bigint) as iteration, value from draws
            where iteration > 10 and (iteration - 10) % 3 = 0"""),
        "propagate": w(DRAWS, f"""select {summary('v')} from (select chain, iteration, avg(value) as v from draws group by 1, 2) q"""),
        "param_labels": """select concat('theta[', cast(p_partkey as varchar), ']') as bracket, 'theta' as name_b, cast(p_partkey as int) as idx_b,
            'sigma_firm' as name_d, cast(p_partkey as int) as idx_d from part""",
        "sampler_diagnostics": w(SAMPLER, """select chain, n_draws, n_divergent, n_max_treedepth, round(ebfmi, 6) as ebfmi,
            round(100.0 * n_divergent / n_draws, 6) as pct_divergent, ebfmi <= 0.3 as low_ebfmi from diagnostics"""),
        "rhat": w(RHAT, """select 'theta' as param, idx, round(rhat_bulk, 6) as rhat_bulk, round(rhat_fold, 6) as rhat_fold,
            round(rhat, 6) as rhat from rhats"""),
        "ess": w(ESS, "select 'theta' as param, idx, round(ess_bulk, 4) as ess_bulk, round(ess_tail, 4) as ess_tail from ess"),
        "convergence_rollup": w(CONV, """select 'theta' as param, count(*) as n_params, round(min(rhat), 4) as min_rhat, round(max(rhat), 4) as max_rhat, round(min(ess_bulk), 4) as min_ess_bulk,
            round(max(ess_bulk), 4) as max_ess_bulk, round(min(ess_tail), 4) as min_ess_tail, round(max(ess_tail), 4) as max_ess_tail,
            count(*) filter (where rhat > 1.01) as n_bad_rhat, count(*) filter (where ess_bulk < 400) as n_low_bulk,
            count(*) filter (where ess_tail < 400) as n_low_tail from conv"""),
        "offenders": w(RHAT, "select 'theta' as param, idx, round(rhat, 4) as rhat from rhats where rhat > 1.003"),
        "health_report": w(CONV + SAMPLER[len(LINES):], """select c.*, d.*,
            round(100.0 * n_bad_rhat / n_checked, 4) as pct_bad_rhat, round(100.0 * n_low_bulk / n_checked, 4) as pct_low_bulk,
            round(100.0 * n_low_tail / n_checked, 4) as pct_low_tail,
            n_bad_rhat = 0 and n_divergent = 0 and n_low_ebfmi = 0 as healthy from (
            select count(*) as n_checked, count(*) filter (where rhat > 1.01) as n_bad_rhat,
             count(*) filter (where ess_bulk < 400) as n_low_bulk, count(*) filter (where ess_tail < 400) as n_low_tail,
             round(min(rhat), 4) as min_rhat, round(max(rhat), 4) as max_rhat, round(min(ess_bulk), 4) as min_ess_bulk,
             round(min(ess_tail), 4) as min_ess_tail from conv) c, (
            select cast(sum(n_divergent) as bigint) as n_divergent, cast(sum(n_max_treedepth) as bigint) as n_max_treedepth,
             round(min(ebfmi), 4) as min_ebfmi, count(*) filter (where ebfmi <= 0.3) as n_low_ebfmi from diagnostics) d"""),
        "key_convergence": w(CONV + ", " + EP_TABLE, """select e.ticker, e.period_idx, round(avg(d.value), 6) as mean,
            round(stddev_samp(d.value), 6) as sd, round(quantile_cont(d.value, 0.05), 6) as pct05,
            round(quantile_cont(d.value, 0.95), 6) as pct95, round(max(r.rhat), 6) as rhat,
            round(max(r.ess_bulk), 4) as ess_bulk
            from draws d join ep_table e on d.idx = e.ep_idx join conv r on d.idx = r.idx
            where e.ticker in ('N3', 'N7') group by e.ticker, e.period_idx"""),
        "spaced_sample": w(SPACED, "select param, idx from spaced"),
        "spaced_draws": w(SPACED, """, two as (select 'alpha' as param, l_partkey as idx, l_quantity / 10 - 2.5 as value from lineitem
             union all select 'beta', l_partkey, 20 * l_discount - 1 from lineitem)
            select b.param, b.idx, count(*) as n, round(avg(value), 6) as mean
            from two b join spaced s on b.param = s.param and b.idx = s.idx group by b.param, b.idx"""),
        "trajectory": w(TRAJ, "select ticker, period_idx, round(avg(m), 6) as theta from per group by ticker, period_idx"),
        "trajectory_three_chains": w(TRAJ, """, t as (select ticker, period_idx, avg(m) as theta from per where chain <= 3 group by 1, 2)
            select ticker, round(avg(theta), 6) as overall_mean, round(min_by(theta, period_idx), 6) as first_mean,
            round(min(theta), 6) as min_theta, round(max(theta), 6) as max_theta from t group by ticker"""),
        "chain_pivot": w(TRAJ, """, s as (select chain, ticker, min_by(m, period_idx) as first, avg(m) as mean from per
            where chain <= 3 and ticker in ('N3', 'N7') group by chain, ticker)
            select chain, """ + ", ".join(
            f"round(max(case when ticker = '{k}' then {c} end), 6) as {k}_{c}" for k in ("N3", "N7") for c in ("first", "mean")
        ) + " from s group by chain"),
        "screen_anchors": w(TRAJ, """, t as (select ticker, period_idx, avg(m / 1000 - 52) as theta from per group by 1, 2)
            , listed as (select concat('N', cast(n_nationkey as varchar)) as ticker from nation
              where n_nationkey in (0, 3, 7, 12) union all select 'N99')
            select l.ticker, count(theta) > 0 as found, count(theta) as n_periods, coalesce(round(avg(theta), 6), -999) as mean,
            coalesce(round(stddev_samp(theta), 6), -999) as sd, coalesce(round(min(theta), 6), -999) as min_theta,
            coalesce(round(max(theta), 6), -999) as max_theta, coalesce(bool_and(theta < 0), false) as all_negative,
            coalesce(bool_and(theta > 0), false) as all_positive from listed l left join t on l.ticker = t.ticker group by l.ticker"""),
        "chain_key_stats": w(f"{LINES}, {EP_TABLE}", """select l_linenumber as chain, ticker, round(avg(l_extendedprice), 6) as mean,
            round(stddev_samp(l_extendedprice), 6) as sd, round(quantile_cont(l_extendedprice, 0.05), 6) as pct05,
            round(quantile_cont(l_extendedprice, 0.95), 6) as pct95 from lines join ep_table on l_suppkey = ep_idx
            where period_idx = 1 group by 1, 2"""),
        "chain_param_stats": w(LINES, " union all ".join(
            f"""select l_linenumber as chain, '{p}' as param, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as sd
            from lines group by l_linenumber""" for p, c in (("sigma_init", "l_tax"), ("sigma_global", "l_discount")))),
        "chain_means_spread": w(BOTH, """select chain, param, round(avg(8 * m), 6) as mean, round(stddev_samp(8 * m), 6) as sd,
            round(min(8 * m), 6) as min, round(max(8 * m), 6) as max, count(*) filter (where abs(8 * m) > 5) as n_large
            from means group by chain, param"""),
        "scale_check": w(BOTH, """, s as (select chain, stddev_samp(case when param = 'theta' then m end) as t,
             stddev_samp(case when param = 'beta' then m end) as b from means group by chain)
            select chain, round(t, 6) as theta_sd, round(b, 6) as beta_sd,
            round(t / first_value(t) over (order by chain), 6) as theta_ratio,
            round(b / first_value(b) over (order by chain), 6) as beta_ratio, round(t * b, 6) as theta_beta from s"""),
        "predict_prob": w(MU, f"select name, period, indicator, y, round({cdf('mu')}, 8) as prob from mu"),
        "log_likelihood": w(LOG_LIK, "select count(*) as n_obs, round(sum(log_lik), 4) as log_lik from ll"),
        "log_likelihood_by_item": w(LOG_LIK, """select indicator, period, count(*) as n_obs, round(sum(log_lik), 5) as log_lik
            from ll group by indicator, period"""),
        "log_likelihood_by_entity": w(LOG_LIK, "select name, count(*) as n_obs, round(sum(log_lik), 6) as log_lik from ll group by name"),
        "rebuild_paths": w(STEPS, """, runs as (select *, sum(fresh) over (partition by name order by period) as run from steps)
            select name, period, round(sum(case when pin is not null then pin when fresh = 1 then sigma_init * z else sigma * z end)
            over (partition by name, run order by period), 6) as theta from runs"""),
        "firm_scales": w(LINES, """, g as (select l_linenumber as chain, year(l_shipdate) as iteration, avg(l_discount) as sigma_global
             from lines group by 1, 2)
            , r as (select l_linenumber as chain, year(l_shipdate) as iteration, l_suppkey as key, avg(l_quantity) as raw
             from lines group by 1, 2, 3)
            select r.chain, cast(r.iteration as int) as iteration, r.key, round(sigma_global * raw, 6) as sigma
            from r join g on r.chain = g.chain and r.iteration = g.iteration"""),
        "log_likelihood_draws": w(POINTWISE.replace("[1, 2, 3, 4]", "[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]").replace("d.draw - 2.5", "d.draw - 5.5"),
            """select cast(draw % 2 + 1 as int) as chain, cast((draw + 1) // 2 as bigint) as iteration, count(*) as n_obs,
            round(sum(log_lik), 4) as log_lik from ll group by draw"""),
        "log_prior_draws": w(LINES, """, d as (select cast(l_linenumber as int) as chain, cast(year(l_shipdate) as int) as iteration, l_quantity / 25 - 1 as z,
            l_quantity / 10 - 2.5 as alpha, 20 * l_discount - 1 as beta, 10 * l_tax as raw from lines)
            , h as (select chain, iteration, avg(raw) as g, max(raw) as i from d group by 1, 2), blocks as (
            select chain, iteration, 'innovations' as block, z as v, 1.0 as sd, 0 as half from d union all
            select chain, iteration, 'alpha', alpha, 5.0, 0 from d union all select chain, iteration, 'beta', beta, 2.5, 0 from d union all
            select chain, iteration, 'firm_scales', raw, 1.0, 1 from d union all select chain, iteration, 'hyper_scales', unnest([g, i]), 1.0, 1 from h)
            select chain, iteration, block, count(*) as n,
            round(sum(-0.5 * (v / sd) * (v / sd) - ln(sd) - 0.5 * ln(2 * pi()) + half * ln(2)), 3) as log_prior from blocks group by 1, 2, 3"""),
        "log_prior": w(STEPS + ITEMS, """, blocks as (
            select 'innovations' as block, z as v, 1.0 as sd, 0 as half from steps where pin is null union all
            select 'alpha', alpha, 5.0, 0 from items union all select 'beta', beta, 2.5, 0 from items union all
            select 'firm_scales', abs(c_acctbal) / 1000, 1.0, 1 from customer union all
            select 'hyper_scales', unnest([0.7, 0.5]), 1.0, 1)
            select block, count(*) as n, round(sum(-0.5 * (v / sd) * (v / sd) - ln(sd) - 0.5 * ln(2 * pi()) + half * ln(2)), 4) as log_prior
            from blocks group by block"""),
        "pointwise_log_lik": w(POINTWISE, """select name, indicator, period, n_draws, round(lppd, 7) as lppd,
            round(p_waic, 7) as p_waic from pointwise"""),
        "waic": w(POINTWISE, """select count(*) as n_obs, round(sum(lppd), 4) as lppd, round(sum(p_waic), 4) as p_waic,
            round(-2 * sum(lppd - p_waic), 4) as waic, round(2 * sqrt(count(*) * var_samp(lppd - p_waic)), 4) as se_waic from pointwise"""),
        "additive_index": w(OBS, """select name, period, cast(sum(case when contains(indicator, '_con_') then -y else y end) as bigint) as index,
            count(*) as n_items from obs group by name, period"""),
        "item_labels": w(OBS, """select distinct concat(indicator, '_', cast(period as varchar)) as item_col,
            contains(indicator, '_con_') as is_concern from obs"""),
        "chain_wide": w(LINES, """, cells as (select max(l_quantity) as q, row_number() over (order by l_orderkey, l_linenumber) as idx
             from lines group by l_orderkey, l_linenumber)
            select cast(c as int) as chain, cast(i as bigint) as iteration, 'theta' as param, idx, cast(q + c + i / 4 as double) as value
            from cells, (select unnest([1, 2]) as c), (select unnest([1, 2, 3]) as i) where idx between 20001 and 40000"""),
        "chain_text": w(CHAIN_TEXT, " union all ".join(
            f"select chain, iteration, '{p}' as param, {i} as idx, {c} as value from numbered" for p, i, c in CHAIN_CELLS)),
        "chain_parameters": w(CHAIN_TEXT, """select param, count(*) as n_params, min(idx) as min_idx, max(idx) as max_idx from (values """
                              + ", ".join(f"('{p}', {i})" for p, i, _ in CHAIN_CELLS)
                              + ") q(param, idx) where exists (select 1 from numbered) group by param"),
        "sampler_table": w(CHAIN_TEXT, """select chain, iteration, divergent__ as divergent, treedepth__ as treedepth,
            energy__ as energy from numbered"""),
        "file_sizes": "select count(distinct l_linenumber) as n_files, true as has_bytes from lineitem",
        "read_panel": w(PANEL, """select name, coalesce(case when ticker = 'T5' then null else ticker end, '-') as ticker,
            coalesce(issuerid, '-') as issuerid, period, row_number() over (order by row_ord) as row_ord, pri_str_a as "PRI_str_a",
            pri_str_b as "PRI_str_b", pri_con_a as "PRI_con_a", sta_str_a as "STA_str_a", sta_con_a as "STA_con_a",
            case when val_str_a >= 2 then 1 else val_str_a end as "VAL_str_a",
            coalesce(case when val_con_a >= 2 then 1 else val_con_a end, -1) as "VAL_con_a" from panel_raw"""),
        "table_hand_off": w(OBS, """select period, indicator, count(*) as n_obs, cast(sum(y) as bigint) as n_ones
            from obs group by period, indicator"""),
        "write_scores": w(SCORES, "select name, ticker, cast(year as int) as year, round(mean, 4) as mean, round(sd, 4) as sd, round(mn, 4) as min, "
                    + ", ".join(f"round({n}, 4) as {n}" for _, n in QUANTILES) + ", round(mx, 4) as max from scores"),
        "write_item_params": w(ITEM_PARAMS, "select item_col, year, item_idx, " + ", ".join(
            f"round({q}_{c}, 6) as {q}_{c}" for q in ("alpha", "beta") for c in ("mean", "sd", "pct05", "pct50", "pct95")) + " from params"),
    }
