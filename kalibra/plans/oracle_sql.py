"""Pieces of DuckDB SQL for the twins of queries."""

from __future__ import annotations

from .bridge import SQL

FOLD = "cast(('0x' || substr(md5(prompt_id || '-42-5'), 1, 8)) as bigint) % 5"


def iso(name: str, train: str, rising: bool = True) -> str:
    """CTEs ending in {name}(k, x, y): the fit of train(k, x, y, w) at its levels, by the min-max formula."""
    sign = "" if rising else "-"
    return f"""{name}_g as (select k, x, sum(w) as w, sum({sign}w * y) as s from ({train}) where x is not null and y is not null group by k, x),
{name}_c as (select *, row_number() over (partition by k order by x) as i, sum(w) over (partition by k order by x) as cw, sum(s) over (partition by k order by x) as cs from {name}_g),
{name}_m as (select a.k, a.i as a, b.i as b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as m from {name}_c a join {name}_c b on a.k is not distinct from b.k and a.i <= b.i),
{name}_n as (select m1.k, i.i, m1.a, min(m1.m) as lowest from {name}_m m1 join {name}_c i on i.k is not distinct from m1.k and m1.a <= i.i and i.i <= m1.b group by m1.k, i.i, m1.a),
{name} as (select c.k, c.x, {sign}max(n.lowest) as y from {name}_n n join {name}_c c on c.k is not distinct from n.k and c.i = n.i group by c.k, c.x)"""


def pred(name: str, model: str, points: str) -> str:
    """CTEs ending in {name}(k, x, y): model(k, x, y) at points(k, x), linear between levels, flat beyond."""
    return f"""{name}_q as (select distinct k, x from ({points})),
{name}_b as (select q.k, q.x, max(case when m.x <= q.x then m.x end) as lo, min(case when m.x >= q.x then m.x end) as hi from {name}_q q join {model} m on m.k is not distinct from q.k group by q.k, q.x),
{name} as (select b.k, b.x, case when lo is null then h.y when hi is null or lo = hi then l.y else l.y + (h.y - l.y) * (b.x - lo) / (hi - lo) end as y from {name}_b b
 left join {model} l on l.k is not distinct from b.k and l.x = b.lo left join {model} h on h.k is not distinct from b.k and h.x = b.hi)"""


TRAIN = f"(select f.k as k, judge_score as x, oracle_label as y, 1.0 as w from (select *, {FOLD} as fold from logged) cross join (select unnest([0, 1, 2, 3, 4]) as k) f where oracle_label is not null and fold <> f.k)"

#: logged rows with fold, reward and reward_oof: CTE cal; then scored(policy, row_id, prompt_id, fold, judge_score, oracle_label, w, reward, reward_oof).
CALIBRATED = f"""{SQL},
{iso('m0', "select 0 as k, judge_score as x, oracle_label as y, 1.0 as w from logged where oracle_label is not null")},
{iso('mk', TRAIN)},
{pred('p0', 'm0', 'select 0 as k, judge_score as x from logged')},
{pred('pk', 'mk', f'select {FOLD} as k, judge_score as x from logged')},
cal as (select l.row_id, l.prompt_id, l.fold, l.judge_score, l.oracle_label, greatest(0.0, least(1.0, p0.y)) as reward, greatest(0.0, least(1.0, pk.y)) as reward_oof
 from (select *, {FOLD} as fold from logged) l left join p0 on p0.x = l.judge_score left join pk on pk.k = l.fold and pk.x = l.judge_score),
scored as (select w.policy, w.w, c.* from w join cal c using (row_id))"""

OUTER = FOLD.replace("-42-5", "-1042-5")

_TRAIN = """wl as (select policy, o, fold, x, count(*) * 1.0 as n, sum(w) as sw, min(w) as least, sum(w * reward_oof) as swr from wo group by all),
wt as (select policy || '-' || f.k as k, policy, f.k as o, fold, x, n, sw, swr, least from wl cross join (select unnest([0, 1, 2, 3, 4]) as k) f where o <> f.k)"""

#: scored with calibrated weights: CTE wcal adds w_cal, o (outer fold), psi_train, w_train.
WEIGHTS = f"""{CALIBRATED},
wo as (select s.*, {OUTER} as o, round(reward_oof, 9) as x from scored s), {_TRAIN},
{iso('wu', "select k, x, sw / n as y, n as w from wt")},
{iso('wd', "select k, x, sw / n as y, n as w from wt", rising=False)},
wc0 as (select t.k, t.fold, t.x, sum(t.n) as n, greatest(any_value(u.y), 1e-9) as u, greatest(any_value(d.y), 1e-9) as d from wt t join wu u on u.k = t.k and u.x = t.x join wd d on d.k = t.k and d.x = t.x group by 1, 2, 3),
wc as (select k, fold, x, n, u / (sum(n * u) over (partition by k) / sum(n) over (partition by k)) as u, d / (sum(n * d) over (partition by k) / sum(n) over (partition by k)) as d from wc0),
wf as (select k, fold, sum(n) as n, sum(n * u) as su, sum(n * d) as sd, sum(n * u * x) as xu, sum(n * d * x) as xd from wc group by 1, 2),
wr as (select k, fold, (sum(su) over p - su) / (sum(n) over p - n) as mu, (sum(sd) over p - sd) / (sum(n) over p - n) as md, (sum(xu) over p - xu) / (sum(su) over p - su) as pu, (sum(xd) over p - xd) / (sum(sd) over p - sd) as pd from wf window p as (partition by k)),
wi as (select k, n, u, d, (u * (x - pu) - pu * (u - mu)) / mu as fu, (d * (x - pd) - pd * (d - md)) / md as fd from wc join wr using (k, fold)),
wm as (select k, sum(n) as n, (sum(n * fu * fu) - sum(n * fu) * sum(n * fu) / sum(n)) / (sum(n) - 1) as cu, (sum(n * fu * fd) - sum(n * fu) * sum(n * fd) / sum(n)) / (sum(n) - 1) as cud, (sum(n * fd * fd) - sum(n * fd) * sum(n * fd) / sum(n)) / (sum(n) - 1) as cd,
 sum(n * (u - 1) * (u - 1)) / sum(n) as vu, sum(n * (u - 1) * (d - 1)) / sum(n) as vud, sum(n * (d - 1) * (d - 1)) / sum(n) as vd from wi group by 1),
wa as (select *, greatest(0.0, least(1.0, (cd + 0.5e-8 * (cu + cd) - cud) / (cu + cd + 1e-8 * (cu + cd) - 2 * cud))) as a from wm),
wg as (select k, a, least(1.0, sqrt(1.0 / (a * a * vu + 2 * a * (1 - a) * vud + (1 - a) * (1 - a) * vd))) as keep from wa),
wp as (select k, sum(swr) / sum(sw) as psi_train, sum(sw) / sum(n) as w_train from wt group by 1),
{pred('wpu', 'wu', "select policy || '-' || o as k, x from wo")},
{pred('wpd', 'wd', "select policy || '-' || o as k, x from wo")},
wb as (select wo.*, wp.psi_train, wp.w_train, keep, a * greatest(pu.y, 1e-9) / avg(greatest(pu.y, 1e-9)) over b + (1 - a) * greatest(pd.y, 1e-9) / avg(greatest(pd.y, 1e-9)) over b as mixed
 from wo join wpu pu on pu.k = policy || '-' || o and pu.x = wo.x join wpd pd on pd.k = policy || '-' || o and pd.x = wo.x join wg on wg.k = policy || '-' || o join wp on wp.k = wg.k window b as (partition by policy, o)),
we as (select * exclude (mixed), case when keep < 1 then greatest(1 + keep * (mixed - 1), 1e-9) else mixed end as v from wb),
wcal as (select * exclude (v, keep, x), v / avg(v) over (partition by policy, o) / avg(v / m0) over (partition by policy) as w_cal from (select *, avg(v) over (partition by policy, o) as m0 from we))"""

#: The contributions of calibrated IPS: CTE ips(policy, row_id, fold, c, phi), folds the outer ones.
IPS = f"""{WEIGHTS},
ips as (select policy, row_id, o as fold, w_cal * reward as c, p - avg(p) over (partition by policy) as phi from (select *, (w_cal * (reward_oof - psi_train) - psi_train * (w_cal - w_train)) / w_train as p from wcal))"""

#: scored with outcomes and calibrated weights: CTE dr adds q, draws, draw_var.
OUTCOMES = f"""{WEIGHTS},
{pred('pf', 'mk', f'select {FOLD} as k, judge_score as x from fresh')},
drawn as (select f.policy, f.prompt_id, avg(greatest(0.0, least(1.0, pf.y))) as q, count(*) as draws, coalesce(var_samp(greatest(0.0, least(1.0, pf.y))), 0) as draw_var from (select *, {FOLD} as fold from fresh) f join pf on pf.k = f.fold and pf.x = f.judge_score group by 1, 2),
dr as (select s.*, d.q, d.draws, d.draw_var, s.reward_oof as g from wcal s join drawn d using (policy, prompt_id))"""


def errors(contrib: str) -> str:
    """CTEs ending in est(policy, n, estimate, se_naive, se_cluster, groups) of a CTE contrib(policy, fold, c, phi), unrounded."""
    return f"""sums as (select policy, fold, sum(phi) as t from {contrib} group by 1, 2),
spread as (select policy, count(*) * 1.0 / (count(*) - 1) * (sum(t * t) - count(*) * avg(t) * avg(t)) as v, count(*) as groups from sums group by 1),
est as (select policy, count(*) as n, avg(c) as estimate, stddev_samp(phi) / sqrt(count(*)) as se_naive, sqrt(greatest(any_value(v), 0)) / count(*) as se_cluster, any_value(groups) as groups from {contrib} join spread using (policy) group by policy)"""


ERRORS = " select policy, n, round(estimate, 6) as estimate, round(se_naive, 6) as se_naive, round(se_cluster, 6) as se_cluster, groups from est"


def summary(rows: str, c: str) -> str:
    """The estimates of contributions c over the CTE rows, as cluster_robust() gives them."""
    return f"""contrib as (select policy, fold, {c} as c from {rows}), centred as (select *, c - avg(c) over (partition by policy) as phi from contrib), {errors('centred')}{ERRORS}"""


def two_sided(z: str) -> str:
    """The p-value of a normal deviate z: one less the error function, by its series."""
    term = f"exp((2 * i + 1) * ln(abs({z}) / sqrt(2)) + i * ln(2) - (lgamma(2 * i + 3) - (i + 1) * ln(2) - lgamma(i + 2)))"
    return f"(case when abs({z}) < 1e-9 then 1.0 when abs({z}) > 8 then 0.0 else 1 - 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * list_sum(list_transform(range(0, 120), lambda i: {term})) end)"
