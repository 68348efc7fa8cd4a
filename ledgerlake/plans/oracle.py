"""Parts of the SQL that stands beside the queries, generated from the same rule tables, for DuckDB."""

from __future__ import annotations

from ..functions import rules
from ..functions.kpi import RECORD_KPIS
from .fixtures import ELEMENTS, sql


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(pairs: list[tuple[str, str]], otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def r2(x: str) -> str:
    """Two places by the exact binary value, halves to even: what the product with 100 lost decides between two results."""
    high = "(v * 134217729 - (v * 134217729 - v))"
    lost = f"(({high} * 100 - v * 100) + (v - {high}) * 100)"
    up = f"case when v * 100 - floor(v * 100) > 0.5 or (v * 100 - floor(v * 100) = 0.5 and {lost} > 0) then 1 when v * 100 - floor(v * 100) = 0.5 and {lost} = 0 then abs(floor(v * 100) % 2) else 0 end"
    return f"list_transform([cast(({x}) as double)], lambda v: (floor(v * 100) + {up}) / 100)[1]"


def r1(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


def num(x: float) -> str:
    return f"cast({x!r} as double)"


def pct(n: str, d: str) -> str:
    return r2(f"{n} / nullif({d}, 0) * 100")


def growth(a: str, b: str) -> str:
    return r2(f"({a} / nullif({b}, 0) - 1) * 100")


def tokens(column: str, found: tuple[str, ...]) -> str:
    return f"coalesce(regexp_matches({column}, {text('|'.join(found))}), false)"


_METRIC = {t: m for m, tags in rules.METRIC_TAGS.items() for t in tags}
M_FACTS = "m_facts as (select doc_id, l_orderkey, seq, tag, bucket, value, " + case([(f"tag = '{t}'", f"'{_METRIC[t]}'") for t, _, _ in ELEMENTS]) + " as metric from fx_facts)"
_PICK = ", ".join(
    (f"sum(value) filter (metric = '{m}' and bucket = '{b}')" if m == rules.SUMMED_METRIC else f"arg_min(value, seq) filter (metric = '{m}' and bucket = '{b}')") + f" as {m}_{b}"
    for m in rules.METRIC_TAGS
    for b in rules.BUCKETS
)
WIDE = M_FACTS + f", wide as (select doc_id, {_PICK} from m_facts group by doc_id)"


def _records() -> str:
    def at(b: str):
        return lambda m: f"{m}_{b}"

    cd, ci, pd, pi = map(at, rules.BUCKETS)
    pairs = {
        "revenueGrowth": (growth(cd("revenue"), pd("revenue")), "null"),
        "operatingMargin": (pct(cd("operatingIncome"), cd("revenue")), pct(pd("operatingIncome"), pd("revenue"))),
        "netMargin": (pct(cd("netIncome"), cd("revenue")), pct(pd("netIncome"), pd("revenue"))),
        "roe": (pct(cd("netIncome"), ci("equity")), pct(pd("netIncome"), pi("equity"))),
        "equityRatio": (pct(ci("equity"), ci("totalAssets")), pct(pi("equity"), pi("totalAssets"))),
        "operatingCfMargin": (pct(cd("operatingCashFlow"), cd("revenue")), pct(pd("operatingCashFlow"), pd("revenue"))),
        "debtRatio": (r2(f"{ci('interestBearingDebt')} / nullif({ci('equity')}, 0)"), "null"),
        "netCash": (f"case when {ci('cash')} is not null or {ci('interestBearingDebt')} is not null then " + r2(f"(coalesce({ci('cash')}, 0) - coalesce({ci('interestBearingDebt')}, 0)) / 1e8") + " end", "null"),
        "inventoryGrowth": (growth(ci("inventories"), pi("inventories")), "null"),
        "receivablesGrowth": (growth(ci("receivables"), pi("receivables")), "null"),
    }
    columns = [f"{now} as v_{k}, case when {now} is not null then cast({before} as double) end as p_{k}" for k, (now, before) in pairs.items()]
    count = " + ".join(f"cast(v_{k} is not null as int)" for k in RECORD_KPIS)
    inner = f"select doc_id, {', '.join(columns)}, {r2(cd('eps'))} as eps, {r2(ci('bps'))} as bps from wide"
    return f"docs as (select * from (select *, {count} as n_kpis from ({inner})) where n_kpis >= {rules.LEAST_KPIS})"


DOCS = WIDE + ", " + _records()

_GROUP = case([(f"industry = '{k}'", f"'{g}'") for k, g in rules.GROUP_OF_INDUSTRY.items()] + [(f"regexp_matches(name, '{r}')", f"'{g}'") for g, r in rules.GROUP_OF_NAME.items()], "industry")
_THEMES = case([(f"grp = '{g}'", "[" + ", ".join(map(text, t)) + "]") for g, t in rules.THEMES.items()], "[" + ", ".join(map(text, rules.OTHER_THEMES)) + "]")
THEMED = f"""themed as (select *, list_extract(th, cast(row_index % 3 as int) + 1) as theme1, list_extract(th, cast((row_index + 1) % 3 as int) + 1) as theme2
  from (select *, {_THEMES} as th from (select *, row_number() over (order by seq) - 1 as row_index, {_GROUP} as grp from fx_companies)))"""

SECURITY = f"""(coalesce(length(code) > 4 and not regexp_matches(code, '^\\d{{3}}[A-Z]$'), false) or {tokens("market", rules.MARKET_TOKENS)}
  or industry in ({", ".join(map(text, rules.SEPARATE_INDUSTRIES))}) or {tokens("name", rules.SECURITY_NAME_TOKENS)})"""
CLASS = case([(SECURITY, f"'{rules.SEPARATE}'"), ("regexp_matches(code, '^\\d{3}[A-Z]$')", f"'{rules.NEW_LISTING}'")], f"'{rules.ORDINARY}'")

PAST = """past as (select code, list(m order by n desc) as history from (
   select f.company_code as code, d.v_operatingMargin as m, row_number() over (partition by f.company_code order by f.day_offset, d.doc_id desc) as n
   from fx_filings f join docs d on d.doc_id = f.doc_id where f.day_offset >= 45 and d.v_operatingMargin is not null) where n <= 3 group by code)"""


def _valid(k: str, x: str) -> str:
    if k in ("revenueGrowth", "inventoryGrowth", "receivablesGrowth"):
        return f"case when {x} >= -100 then {x} end"
    if k == "debtRatio":
        return f"case when {x} >= 0 then {x} end"
    return f"case when {x} between -100 and 100 then {x} end" if k == "equityRatio" else x


def _score(name: str) -> str:
    parts = []
    for weight, kpis, low, high in rules.SCORES[name]:
        f = lambda k: f"coalesce(v_{k}, {num(rules.KPIS[k][1])})"
        x = f"({f(kpis[0])} - {f(kpis[1])})" if len(kpis) > 1 and kpis[1] else f(kpis[0])
        s = f"least(100.0::double, greatest(0.0::double, ({x} - {num(low)}) / {num(high - low)} * 100))"
        parts.append((f"(100.0::double - {s})" if len(kpis) > 1 and kpis[1] is None else s) + f" * {num(weight)}")
    return f"least(100.0::double, greatest(0.0::double, {' + '.join(parts)}))"


#: Records as they are: some from the second source, some with ratios, a trend or a label of their own.
HELD = """held as (select x.code as rcode, d.*, coalesce(h.history, []) as history, case when c.seq % 10 = 3 then 'TDnet' else 'EDINET' end as source, x.filed_at, substr(x.filed_at, 1, 10) as period_end,
   'u:' || d.doc_id as source_url, case when c.seq % 7 = 1 then 10 + c.seq % 30 end::double as own_per, case when c.seq % 7 = 1 then 1 + c.seq % 3 end::double as own_pbr,
   c.seq % 5 = 2 as own_trend, c.seq % 6 = 1 as own_label
   from fx_records x join docs d on d.doc_id = x.document_id join fx_companies c on c.code = x.code left join past h on h.code = x.code)"""


def _view(held: str) -> str:
    base = f"""base as (select c.*, {", ".join(f"r.{x}_{k}" for k in RECORD_KPIS for x in "vp")}, r.eps, r.bps, coalesce(r.history, []) as history,
      r.source, r.filed_at, r.period_end, r.source_url, r.own_per, r.own_pbr, coalesce(r.own_trend, false) as own_trend, coalesce(r.own_label, false) as own_label,
      r.doc_id is not null as has_record, q.close, q.previous_close, q.change_percent, q.volume, q.code is not null as has_quote,
      case when f.code is not null then case when f.forecast_eps > 0 then f.forecast_eps else f.eps end else r.eps end as eps_used,
      case when f.code is not null then f.bps else r.bps end as bps_used,
      coalesce(q.close > 0 and q.previous_close > 0 and abs(q.close / nullif(q.previous_close, 0) - 1) <= 0.35::double, false) as prev_ok
      from themed c left join held r on r.rcode = c.code left join fx_quotes q on q.code = c.code left join fx_fundamentals f on f.code = c.code)"""
    val = """val as (select *, coalesce(case when eps_used > 0 then close / eps_used end, own_per) as v_per, case when prev_ok and eps_used > 0 then previous_close / eps_used end as p_per,
      coalesce(case when bps_used > 0 then close / bps_used end, own_pbr) as v_pbr, case when prev_ok and bps_used > 0 then previous_close / bps_used end as p_pbr,
      has_quote and eps_used > 0 as fresh_per, has_quote and bps_used > 0 as fresh_pbr from base)"""
    fixed = ", ".join(f"case when has_record then {_valid(k, f'v_{k}')} end as v_{k}, case when has_record then p_{k} end as p_{k}" for k in rules.KPIS)
    ok = f"ok as (select * replace ({fixed}, case when has_record then history else [] end as history) from val)"
    live = " + ".join(f"cast(v_{k} is not null as int)" for k in rules.KPIS)
    margin = f"coalesce(p_operatingMargin, case when len(history) >= 2 then history[len(history) - 1] end, v_operatingMargin, {num(5.0)})"
    sc1 = f"sc1 as (select *, {live} as live_kpis, {margin} as prev_margin, {', '.join(f'{_score(n)} as raw_{n}' for n in rules.SCORES)} from ok)"
    has = {n: "(" + " or ".join(f"v_{k} is not null" for k in ks) + ")" for n, (_, ks) in rules.OVERALL.items()}
    total = " + ".join(f"case when {has[n]} then {num(w)} else 0.0::double end" for n, (w, _) in rules.OVERALL.items())
    points = " + ".join(f"case when {has[n]} then raw_{n} * {num(w)} else 0.0::double end" for n, (w, _) in rules.OVERALL.items())
    w = rules.WARNINGS
    holds = ["v_revenueGrowth > 3 and v_operatingMargin < prev_margin - 0.8::double", "v_netMargin > 0 and v_operatingCfMargin < v_netMargin * 0.55::double", "v_inventoryGrowth > v_revenueGrowth + 8", "v_receivablesGrowth > v_revenueGrowth + 8", "v_equityRatio < 25", "v_debtRatio > 2.5", "v_per is not null and v_pbr is not null and (v_per > 50 or v_pbr > 6)", "v_roe > 18 and v_equityRatio < 30", "len(history) >= 3 and history[1] > history[2] and history[2] > history[3]"]
    warn = "concat_ws('|', " + ", ".join(f"case when {h} then {text(t)} end" for h, t in zip(holds, w, strict=True)) + ")"
    good = ["v_revenueGrowth >= 10", "v_operatingMargin >= 15", "v_roe >= 14", "v_equityRatio >= 55", "v_operatingCfMargin >= 12", "v_netCash >= 200", "v_per <= 13 and v_pbr <= 1.5"]
    strong = "array_to_string(list_slice(list_filter([" + ", ".join(f"case when {h} then {text(t)} end" for h, t in zip(good, rules.STRENGTHS, strict=True)) + f"], lambda x: x is not null), 1, {rules.MOST_STRENGTHS}), '|')"
    sc2 = f"""sc2 as (select *, coalesce(({points}) / nullif({total}, 0), 50) as raw_overall, {warn} as warn_text, {strong} as strong_text from sc1)"""
    comment = case(
        [("v_operatingMargin > prev_margin and v_operatingCfMargin >= 10", text(rules.IMPROVING_COMMENT))]
        + [(f"contains(warn_text, {text(k)})", text(t)) for k, t in rules.WARNING_COMMENTS.items()]
        + [("live_kpis < 6", text(rules.FEW_KPIS_COMMENT))],
        text(rules.DEFAULT_COMMENT),
    )
    scores = ", ".join(f"case when has_record then {'case when v_per is not null or v_pbr is not null then raw_valuation else 50 end' if n == 'valuation' else f'raw_{n}'} else 0 end as s_{n}" for n in rules.COMPARED_SCORES)
    view = f"""view as (select *, {scores}, case when has_record then warn_text else '' end as warnings,
      case when has_record then case when strong_text = '' then {text(rules.NO_STRENGTH)} else strong_text end else '' end as strengths,
      case when has_record then {comment} else {text(rules.UNAVAILABLE_COMMENT)} end as analysis_comment,
      case when has_record then warn_text <> '' else false end as has_warning, case when not has_record then 'unavailable' when source = 'TDnet' then source else 'EDINET' end as data_source from sc2)"""
    return ", ".join([THEMED, held, base, val, ok, sc1, sc2, view])


ACCEPTED = DOCS + f""", annual as (select f.*, substr(sec_code, 1, 4) as code from fx_filings f where doc_type_code = '{rules.ANNUAL_REPORT}' and day_offset >= 0 and day_offset < {rules.LOOKBACK_DAYS}
   and substr(sec_code, 1, 4) in (select code from fx_companies where not {SECURITY})),
 target as (select code from fx_companies where code not in (select code from fx_records) and {CLASS} = '{rules.ORDINARY}'),
 tried as (select a.*, r.filed_at, a.code in (select code from target) as is_target, o_orderkey % 17 = 0 as failed
   from annual a left join fx_records r on r.code = a.code where (o_orderkey % 17 = 0 or a.doc_id in (select doc_id from docs)) and (r.code is null or a.doc_id <> r.document_id)),
 cand as (select *, count(*) filter (not failed) over w as earlier, max(case when not failed then submit_ts end) over w as before from tried
   window w as (partition by code order by day_offset, day_seq rows between unbounded preceding and 1 preceding)),
 scanned as (select code, doc_id, day_offset, day_seq, submit_ts, period_end, case when failed then '{rules.FAILED}' when is_target and earlier = 0 then '{rules.ADDED_POLICY}' else '{rules.REFRESHED_POLICY}' end as policy,
     row_number() over (partition by code order by day_offset, day_seq) - 1 as nth
   from cand where (is_target and earlier = 0) or (day_offset < {rules.REFRESH_DAYS} and
     case when filed_at is null and not is_target then earlier = 0 or submit_ts > before else submit_ts > greatest(coalesce(before, ''), coalesce(filed_at, '')) end)),
 accepted as (select * from scanned where policy <> '{rules.FAILED}')"""

LAST = "last as (select code, arg_max(doc_id, nth) as document_id, arg_max(submit_ts, nth) as filed_at, arg_max(policy, nth) as policy from accepted group by code)"
#: Records after a run, as the snapshot has them.
_AFTER = ACCEPTED + ", " + LAST + ", after as (select code, document_id, filed_at, policy from last union all select code, document_id, filed_at, null from fx_records where code not in (select code from last))"
_HELD_AFTER = """held as (select x.code as rcode, d.*, [] as history, 'EDINET' as source, x.filed_at, f.period_end, x.policy, {url} || d.doc_id as source_url, null::double as own_per, null::double as own_pbr, false as own_trend, false as own_label
   from after x join docs d on d.doc_id = x.document_id join fx_filings f on f.doc_id = x.document_id)""".replace("{url}", text(rules.SOURCE_URL))  # fmt: skip
AFTER = _AFTER + ", " + _HELD_AFTER

VIEW = DOCS + ", " + PAST + ", " + _view(HELD)
VIEW_AFTER = _AFTER + ", " + _view(_HELD_AFTER)


def over(body: str, parts: str = "") -> str:
    return sql(body, parts)
