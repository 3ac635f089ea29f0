"""The registered queries in DuckDB SQL, by box arithmetic and plain SQL rather than by the operators' formulas."""

from __future__ import annotations

AREA = """fx_area as (
 select city, area_id, case when p_size > 48 then null when p_size > 40 then substr('ABCD', cast(p_size % 4 as int) + 1, 1)
   else substr('ABCD', cast((floor(x0/4)*7 + floor(y0/4)*3 + k) % 4 as int) + 1, 1) end as grade, x0, y0, x0+1 as x1, y0+1 as y1
 from (select r_name as city, cast(p_partkey as bigint) as area_id, p_size, r_regionkey as k,
   cast(floor(p_partkey/5) % 20 as double) as x0, cast(floor(p_partkey/5/20) as double) as y0
   from part join region on r_regionkey = p_partkey % 5) a)"""

HIGH = "(select cast(ceil(count(*)/100) as bigint) from part)"

ZONE = f"""fx_zone as (
 select city, cast(row_number() over (partition by city order by s_suppkey) as bigint) as zone_id, x0, y0,
  x0+cast(3+(s_suppkey % 4)*2 as double)/2 as x1, y0+cast(3+(s_suppkey % 3)*2 as double)/2 as y1
 from (select r_name as city, s_suppkey, cast((s_suppkey*7) % 37 as double)/2 as x0,
   cast((s_suppkey*13) % (2*{HIGH}) as double)/2 as y0
   from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey) z)"""

ENTITY = f"""fx_entity as (
 select city, '0' || cast(c_custkey as varchar) as entity_id, level,
  case when c_custkey % 10 = 0 then cast((c_custkey*37) % 80 as double)/4 else cast((c_custkey*7919) % 2000 as double)/100 end as x,
  cast((c_custkey*104729) % (100*{HIGH}) as double)/100 as y,
  case when c_custkey % 23 = 0 then '†' else cast(n1 as varchar) end as n_urgent, cast(n2 as varchar) as n_high,
  cast(n3 as varchar) as n_medium, cast(n4 as varchar) as n_unspecified, cast(n5 as varchar) as n_low,
  cast(nt as varchar) as n_total, cast(nf as varchar) as n_subsidised
 from (select c_custkey, max(r_name) as city, lower(max(c_mktsegment)) as level,
   sum(case when o_orderpriority='1-URGENT' then 1 else 0 end) as n1, sum(case when o_orderpriority='2-HIGH' then 1 else 0 end) as n2,
   sum(case when o_orderpriority='3-MEDIUM' then 1 else 0 end) as n3, sum(case when o_orderpriority='4-NOT SPECIFIED' then 1 else 0 end) as n4,
   sum(case when o_orderpriority='5-LOW' then 1 else 0 end) as n5, count(o_orderkey) as nt, sum(case when o_orderstatus='F' then 1 else 0 end) as nf
   from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
   left join orders on o_custkey=c_custkey group by c_custkey) c)"""

SPENDING = """fx_spending as (
 select max(r_name) as state, c_custkey as id, avg(o_totalprice) as pp_total
 from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey join orders on o_custkey=c_custkey
 where c_custkey % 11 <> 0 group by c_custkey)"""

TEXT = "fx_text as (select doc_id, lang, case when doc_id % 19 = 0 then null else text end as data from documents)"

GEO = """fx_geo as (
 select c_custkey as id, -125+cast((c_custkey*7919) % 5800 as double)/100 as lon, 25+cast((c_custkey*104729) % 2400 as double)/100 as lat
 from customer)"""

MODEL = """fx_model as (
 select o_orderkey as id, o_orderpriority as outcome, case when o_totalprice>250000 then 1 else 0 end as hi_value,
  case when o_orderstatus='F' then 1 else 0 end as is_final, case when c_mktsegment='BUILDING' then 1 else 0 end as is_building
 from orders join customer on o_custkey=c_custkey)"""

OVERLAP = """overlap as (
 select z.city, z.zone_id, a.area_id, a.grade,
  (least(z.x1, a.x1) - greatest(z.x0, a.x0)) * (least(z.y1, a.y1) - greatest(z.y0, a.y0)) as area
 from fx_zone z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1)"""

SHARES = """weights as (select city, zone_id, grade, sum(area) as area from overlap group by city, zone_id, grade),
shares as (select w.*, w.area / t.total as area_perc
 from weights w join (select city, zone_id, sum(area) as total from weights group by city, zone_id) t
 on w.city = t.city and w.zone_id = t.zone_id)"""

CLASSIFIED = """winners as (select city, zone_id, grade as majority_grade from shares where area_perc > 0.5 and grade is not null),
classified as (select s.*, v.majority_grade from shares s join winners v on s.city = v.city and s.zone_id = v.zone_id)"""

IN_ZONE = """in_zone as (select e.city, e.entity_id, z.zone_id from fx_entity e join fx_zone z
 on e.city = z.city and e.x between z.x0 and z.x1 and e.y between z.y0 and z.y1)"""

IN_AREA = """in_area as (select e.city, e.entity_id, a.area_id from fx_entity e join fx_area a
 on e.city = a.city and e.x between a.x0 and a.x1 and e.y between a.y0 and a.y1)"""

LOCATED = """located as (select z.city, z.entity_id, z.zone_id, a.area_id from in_zone z join in_area a
 on z.city = a.city and z.entity_id = a.entity_id)"""

COMBINED = """combined as (
 select c.city, c.zone_id, c.grade, c.area, c.area_perc, c.majority_grade, l.entity_id, l.area_id, e.level,
  e.n_urgent, e.n_high, e.n_medium, e.n_unspecified, e.n_low, e.n_total, e.n_subsidised
 from classified c left join located l on c.city = l.city and c.zone_id = l.zone_id
 left join fx_entity e on e.city = l.city and e.entity_id = l.entity_id)"""

GROUPS = """groups(comparison, grade_group, grade) as (values ('A vs D', 'A', 'A'), ('A vs D', 'D', 'D'), ('A/B vs C/D', 'A/B', 'A'),
 ('A/B vs C/D', 'A/B', 'B'), ('A/B vs C/D', 'C/D', 'C'), ('A/B vs C/D', 'C/D', 'D'))"""

COUNTS = ["n_urgent", "n_high", "n_medium", "n_unspecified", "n_low"]
LABELLED = [("n_urgent", "Urgent"), ("n_high", "High"), ("n_medium", "Medium"), ("n_unspecified", "Not specified"), ("n_low", "Low")]

CLASSIFIED_PARTS = [ZONE, AREA, OVERLAP, SHARES, CLASSIFIED]
COMBINED_PARTS = [*CLASSIFIED_PARTS, ENTITY, IN_ZONE, IN_AREA, LOCATED, COMBINED]


def _sql(parts: list[str], body: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + body


def _percent(part: str, total: str = "n_total") -> str:
    """Percent of text numbers; NULL for a bad number or a zero total."""
    return f"(try_cast({part} as double) / nullif(try_cast({total} as double), 0) * 100)"


def _number_or_null(column: str) -> str:
    return f"try_cast({column} as double)"


def _stacked(template: str) -> str:
    """One SELECT per count column, stacked."""
    return " union all ".join(template.format(c=c, percent=_percent(c), label=label) for c, label in LABELLED)


def _composition(grade_col: str) -> str:
    """Mean percentages per city, comparison, group and category over the combined rows."""
    return _sql(
        [*COMBINED_PARTS, GROUPS, "long as (" + _stacked(
            f"select city, {grade_col} as g, '{{c}}' as name, '{{label}}' as category, {{percent}} as value from combined"
        ) + ")"],
        """select city, comparison, grade_group, category, round(avg(value), 6) as value,
         cast(dense_rank() over (partition by city, comparison, grade_group order by name) as int) as paired
         from long join groups on long.g = groups.grade group by city, comparison, grade_group, name, category""",
    )


def _by_grade(body: str) -> str:
    return _sql(
        [*COMBINED_PARTS, "by_grade as (select city, grade, name as category, avg(value) as value from ("
         + _stacked("select city, grade, '{c}' as name, {percent} as value from combined") + ") t group by city, grade, name)"],
        body,
    )


def _flag(part: str) -> str:
    return f"case when {_percent(part)} > 50 then 1 when {_percent(part)} <= 50 then 0 end"


# Axis, flattening, parallels and origin as in the projections' definitions; the conic constants are worked out in SQL.
ALBERS = """shape as (select 6378137.0::double as a, (1/298.257222101::double) as f),
ell as (select a, f*(2-f) as e2, sqrt(f*(2-f)) as e from shape),
lats as (select a, e2, e, sin(radians(29.5)) as s1, sin(radians(45.5)) as s2, sin(radians(23.0)) as s0 from ell),
qs as (select *, (1-e2)*(s1/(1-e2*s1*s1) - ln((1-e*s1)/(1+e*s1))/(2*e)) as q1, (1-e2)*(s2/(1-e2*s2*s2) - ln((1-e*s2)/(1+e*s2))/(2*e)) as q2,
 (1-e2)*(s0/(1-e2*s0*s0) - ln((1-e*s0)/(1+e*s0))/(2*e)) as q0, (1-s1*s1)/(1-e2*s1*s1) as mm1, (1-s2*s2)/(1-e2*s2*s2) as mm2 from lats),
cone as (select a, e2, e, (mm1-mm2)/(q2-q1) as n, mm1 + (mm1-mm2)/(q2-q1)*q1 as c, q0 from qs),
placed as (select id, lon, lat, a, n, c, q0, radians(lon+96)*n as th,
 (1-e2)*(sin(radians(lat))/(1-e2*sin(radians(lat))*sin(radians(lat))) - ln((1-e*sin(radians(lat)))/(1+e*sin(radians(lat))))/(2*e)) as q
 from fx_geo, cone)"""

LAEA = """angles as (select id, lon, lat, radians(lat) as p, radians(lon+100) as l, radians(45.0) as o from fx_geo),
scaled as (select *, 6370997.0::double * sqrt(2/(1+sin(o)*sin(p)+cos(o)*cos(p)*cos(l))) as k from angles)"""

# One parameter at a time is moved by its own Newton step, in turn, until nothing moves any more; no gradient vector,
# Hessian or matrix solve as in the operator. Parameters: three coefficients, then four cut points.
ASCENT = """cells as (select cast(left(outcome, 1) as int) as y, hi_value as x1, is_final as x2, is_building as x3, count(*) as n
  from fx_model group by all),
shares as (select list(ln(p/(1-p)) order by y) as c from (select y, sum(sum(n)) over (order by y) / (select sum(n)::double from cells) as p
  from cells group by y) t where y < 5),
ascent(step, th) as (
 select 0, list_concat([0.0::double, 0.0::double, 0.0::double], c) from shares
 union all
 select step + 1, list_concat(list_concat(th[1:j-1], [th[j] - g / h]), th[j+1:7]) from (
  select step, th, j, sum(n * s) as g, sum(n * (k - s * s)) as h from (
   select step, th, j, n, (du*uj - dl*lj) / (u - l) as s, (du*(1-2*u)*uj*uj - dl*(1-2*l)*lj*lj) / (u - l) as k from (
    select *, u*(1-u) as du, l*(1-l) as dl, case when j <= 3 then -[x1, x2, x3][j] when y = j - 3 then 1 else 0 end as uj,
     case when j <= 3 then -[x1, x2, x3][j] when y = j - 2 then 1 else 0 end as lj from (
     select *, case when y = 5 then 1.0::double else 1/(1+exp(eta - th[y+3])) end as u, case when y = 1 then 0.0::double else 1/(1+exp(eta - th[y+2])) end as l
     from (select a.step, a.th, a.step % 7 + 1 as j, cells.*, th[1]*x1 + th[2]*x2 + th[3]*x3 as eta from ascent a, cells where a.step < 1400) e) p) d) q
  group by step, th, j) moved)"""

TERMS = """unnest(['hi_value', 'is_final', 'is_building', '1-URGENT|2-HIGH', '2-HIGH|3-MEDIUM', '3-MEDIUM|4-NOT SPECIFIED', '4-NOT SPECIFIED|5-LOW'])"""


def _newton(name: str, source: str) -> str:
    """A Newton step of the ordered logit from ``source(th)``: ``{name}_inv(v)``, the inverse information by Gauss-Jordan,
    and ``{name}(th)``, the parameters after the step."""
    arg = "list_transform(range(1, 8), lambda j: (case when j <= 3 then -xs[j] when y = j - {0} then 1 else 0 end)::double) as {1}".format
    return f"""{name}_prob as (select n, y, xs, case when y = 5 then 1.0::double else 1/(1+exp(eta - th[y+3])) end as u, case when y = 1 then 0.0::double else 1/(1+exp(eta - th[y+2])) end as l
  from (select n, y, th, [x1, x2, x3] as xs, th[1]*x1 + th[2]*x2 + th[3]*x3 as eta from cells, {source}) e),
{name}_arg as (select n, u - l as p, u*(1-u) as du, l*(1-l) as dl, u*(1-u)*(1-2*u) as hu, l*(1-l)*(1-2*l) as hl, {arg(3, 'up')}, {arg(2, 'lo')} from {name}_prob),
{name}_slope as (select *, list_transform(range(1, 8), lambda j: (du*up[j] - dl*lo[j]) / p) as g from {name}_arg),
{name}_flat as (select i, j, sum(n * ((hu*up[i]*up[j] - hl*lo[i]*lo[j]) / p - g[i]*g[j])) as h from {name}_slope, range(1, 8) a(i), range(1, 8) b(j) group by i, j),
{name}_grad as (select list(s order by i) as g from (select i, sum(n * g[i]) as s from {name}_slope, range(1, 8) a(i) group by i) q),
{name}_gauss(k, m) as (
 select 1, list(r order by i) from (select i, list_concat(list(-h order by j), list_transform(range(1, 8), lambda c: (case when c = i then 1 else 0 end)::double)) as r from {name}_flat group by i) q
 union all
 select k + 1, list_transform(range(1, 8), lambda i: list_transform(range(1, 15), lambda c: case when i = k then m[k][c] / m[k][k] else m[i][c] - m[i][k] * m[k][c] / m[k][k] end)) from {name}_gauss where k <= 7),
{name}_inv as (select list_transform(m, lambda r: r[8:14]) as v from {name}_gauss where k = 8),
{name} as (select list_transform(range(1, 8), lambda i: th[i] + list_sum(list_transform(range(1, 8), lambda j: v[i][j] * g[j]))) as th from {name}_inv, {name}_grad, {source})"""


# Coordinate ascent, two Newton steps from where it ends, and the inverse information there.
ESTIMATED = ["recursive " + MODEL, ASCENT, "risen as (select th from ascent where step = 1400)", _newton("near", "risen"), _newton("best", "near"), _newton("last", "best")]
# erfc by the series of erf with positive terms alone; over 6 it is 0 to ten digits.
ERFC = """case when z > 6 then 0.0::double else 1 - 2 / sqrt(pi()) * exp(-z*z) * list_sum(list_transform(range(0, 160), lambda k: exp((2*k+1)*ln(greatest(z, 1e-300)) + k*ln(2.0::double) - list_sum(list_transform(range(0, k+1), lambda i: ln((2*i+1)::double)))))) end"""
# Columns of the lower root of the inverse information, one per step.
CHOLESKY = """root(k, a) as (
 select 1, [[0.0::double], [0.0], [0.0], [0.0], [0.0], [0.0], [0.0]] union all
 select k + 1, list_transform(range(1, 8), lambda i: list_append(a[i], case when i < k then 0.0::double
  when i = k then sqrt(v[k][k] - list_sum(list_transform(a[k], lambda x: x * x)))
  else (v[i][k] - list_sum(list_transform(range(1, k + 1), lambda c: a[i][c] * a[k][c]))) / sqrt(v[k][k] - list_sum(list_transform(a[k], lambda x: x * x))) end)) from root, last_inv where k <= 7),
lower as (select list_transform(a, lambda r: r[2:8]) as a from root where k = 8)"""


def _uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0"


DRAWN = f"""noise as (select d, list_transform(range(0, 7), lambda j: sqrt(-2 * ln({_uniform("'11:' || d || ':' || j || ':r'")})) * cos(2 * pi() * {_uniform("'11:' || d || ':' || j || ':t'")})) as z from range(0, 1000) r(d)),
drawn as (select d, list_transform(range(1, 8), lambda i: th[i] + list_sum(list_transform(range(1, 8), lambda j: a[i][j] * z[j]))) as t from noise, lower, best),
combos as (select x2, x3, sum(n) as n from cells group by all),
chance as (select d, e as effect_value, n, [0.0::double, 1/(1+exp(eta - t[4])), 1/(1+exp(eta - t[5])), 1/(1+exp(eta - t[6])), 1/(1+exp(eta - t[7])), 1.0::double] as c
 from (select d, t, n, e, t[1]*e + t[2]*x2 + t[3]*x3 as eta from drawn, combos, (values (0.0::double), (1.0)) v(e)) q),
probs as (select d, effect_value, y, sum(n * (c[y + 1] - c[y])) / sum(n) as prob from chance, range(1, 6) r(y) group by all),
ranges as (select ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][y] as outcome, effect_value, quantile_cont(prob, 0.025) as lower, avg(prob) as mean, quantile_cont(prob, 0.975) as upper from probs group by all)"""


ORACLES: dict[str, str] = {
    "scan_entities": _sql([ENTITY], "select * from fx_entity"),
    "scan_spending": _sql([SPENDING], "select state, id, round(pp_total, 6) as pp_total from fx_spending"),
    "scan_layers": _sql([AREA], "select city, area_id, grade, x0 as xmin, y0 as ymin, x1 as xmax, y1 as ymax from fx_area"),
    "polygon_edges": _sql([ZONE], """select city, zone_id, cast(0 as bigint) as ring_no, n as edge_no,
      case n when 1 then x0 when 2 then x0 else x1 end as x1, case n when 1 then y0 when 4 then y0 else y1 end as y1,
      case n when 2 then x1 when 3 then x1 else x0 end as x2, case n when 1 then y1 when 2 then y1 else y0 end as y2
      from (select city, zone_id, x0, y0, x1, y1, unnest([1, 2, 3, 4]) as n from fx_zone) z"""),
    "publish_roundtrip": _sql([AREA], "select city, area_id, grade, x0, y0 from fx_area"),
    "clean_headers": _sql([ENTITY], "select entity_id as \"EntityID\", n_high as nhigh, n_low as nlowallgrades from fx_entity"),
    "drop_columns": _sql([ENTITY], "select city, entity_id, level, n_urgent, n_high, n_medium, n_low, n_total, n_subsidised from fx_entity"),
    "column_range": _sql([ENTITY], "select entity_id, n_urgent, n_high, n_medium, n_unspecified, n_low, n_total from fx_entity"),
    "rename_cols": _sql([AREA], "select city, area_id as unit_id, grade as \"Majority Grade\" from fx_area"),
    "tag_union": _sql([AREA], "select city, 'areas' as source, area_id, grade from fx_area"),
    "coerce_numeric": _sql([ENTITY], "select entity_id, " + ", ".join(f"{_number_or_null(c)} as {c}" for c in COUNTS) + " from fx_entity"),
    "row_percent": _sql([ENTITY], "select entity_id, " + ", ".join(f"round({_percent(c)}, 6) as {c}" for c in [*COUNTS, "n_subsidised"]) + " from fx_entity"),
    "ordinal_levels": _sql([AREA], "select city, area_id, case grade when 'A' then 1 when 'B' then 2 when 'C' then 3 end as grade_level from fx_area"),
    "relabel": _sql([ENTITY], _stacked(
        "select entity_id, '{label}' as label, case '{c}' when 'n_urgent' then 'urgent' when 'n_unspecified' then 'not specified'"
        " else substr('{c}', 3) end as rewritten, {c} as value from fx_entity")),
    "format_amount": _sql([SPENDING], "select id, format('{:,}', cast(round_even(pp_total, 0) as bigint)) as amount from fx_spending"),
    "filter_isin": _sql([ENTITY], "select city, entity_id, level from fx_entity where city in ('AMERICA', 'ASIA', 'EUROPE') and level = 'building'"),
    "dropna_subset": _sql([AREA], "select city, area_id, grade from fx_area where grade is not null"),
    "dropna_any": _sql([ENTITY, SPENDING], "select entity_id, " + ", ".join(f"{_number_or_null(c)} as {c}" for c in COUNTS)
        + ", round(pp_total, 6) as pp_total from fx_entity join fx_spending on id = cast(entity_id as bigint) where n_urgent <> '†'"),
    "nonempty_features": _sql([AREA], "select city, area_id, grade from fx_area where grade is not null"),
    "text_terms": _sql([TEXT], "select doc_id, lang, md5(data) as text_md5 from fx_text where regexp_matches(data, 'licen[cs]e|copyright|the best|low')"),
    "sample_text": _sql([TEXT], """select doc_id, lang, data from fx_text where regexp_matches(data, 'licen[cs]e|copyright|the best|low')
      order by md5('42:' || cast(doc_id as varchar)), doc_id limit 1"""),
    "make_points": _sql([ENTITY], "select city, entity_id, x, y from fx_entity where n_urgent <> '†'"),
    "project_albers": _sql([GEO, ALBERS], """select id, lon, lat, round(a*sqrt(c-n*q)/n*sin(th), 3) + 0.0::double as x,
      round(a*sqrt(c-n*q0)/n - a*sqrt(c-n*q)/n*cos(th), 3) + 0.0::double as y from placed"""),
    "project_laea": _sql([GEO, LAEA], """select id, lon, lat, round(k*cos(p)*sin(l), 3) + 0.0::double as x,
      round(k*(cos(o)*sin(p)-sin(o)*cos(p)*cos(l)), 3) + 0.0::double as y from scaled"""),
    "polygon_area": _sql([ZONE], "select city, zone_id, round((x1-x0)*(y1-y0), 6) as area from fx_zone"),
    "normalize_rings": _sql([ZONE], """select city, zone_id, x0 as x1, y0 as y1, x0 as x2, y1 as y2 from fx_zone
      union all select city, zone_id, x0, y1, x1, y1 from fx_zone union all select city, zone_id, x1, y1, x1, y0 from fx_zone
      union all select city, zone_id, x1, y0, x0, y0 from fx_zone"""),
    "layer_bbox": _sql([AREA], "select city, min(x0) as xmin, min(y0) as ymin, max(x1) as xmax, max(y1) as ymax from fx_area group by city"),
    "overlay_area": _sql([ZONE, AREA, OVERLAP], "select city, zone_id, area_id, round(area, 6) as area from overlap"),
    "multipart_zones": _sql([ZONE, AREA, ENTITY], """, parts as (
       select city, zone_id, x0, (x0 + x1) / 2 + 0.25 as x1, y0, y1 from fx_zone union all select city, zone_id, (x0 + x1) / 2 - 0.25, x1, y0, y1 from fx_zone),
      own as (select city, zone_id, sum((x1 - x0) * (y1 - y0)) as area from parts group by city, zone_id),
      meet as (select z.city, z.zone_id, a.area_id, (least(z.x1, a.x1) - greatest(z.x0, a.x0)) * (least(z.y1, a.y1) - greatest(z.y0, a.y0)) as area
       from parts z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1),
      shared as (select city, zone_id, sum(area) as shared, count(distinct area_id) as n_areas from meet group by city, zone_id),
      held as (select z.city, z.zone_id, count(*) as n_entities from fx_zone z join fx_entity e on e.city = z.city and e.x between z.x0 and z.x1 and e.y between z.y0 and z.y1 group by z.city, z.zone_id)
      select o.city, o.zone_id, round(o.area, 6) as area, round(s.shared, 6) as shared, s.n_areas, h.n_entities
      from own o left join shared s on s.city = o.city and s.zone_id = o.zone_id left join held h on h.city = o.city and h.zone_id = o.zone_id""").replace(")\n, parts", "),\nparts"),
    "overlay_polygons": _sql([ZONE, AREA], """, meet as (select z.city, z.zone_id, a.area_id, (z.y1 - z.y0) / (z.x1 - z.x0) as s, greatest(z.x0, a.x0) as lo, least(z.x1, a.x1) as hi,
       greatest(z.y0, a.y0) as bottom, a.y1 as top, z.x0, z.y0 from fx_zone z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1),
      ends as (select *, y0 + (lo - x0) * s as l, y0 + (hi - x0) * s as h from meet),
      above as (select *, case when h <= bottom then 0 when l >= bottom then (l + h - 2 * bottom) / 2 * (hi - lo) else (h - bottom) * (h - bottom) / (2 * s) end
       - case when h <= top then 0 when l >= top then (l + h - 2 * top) / 2 * (hi - lo) else (h - top) * (h - top) / (2 * s) end as area from ends)
      select city, zone_id, area_id, round(area, 6) as area from above where area > 1e-9""").replace(")\n, meet", "),\nmeet"),
    "project_edges": _sql([GEO.replace("fx_geo as", "fx_base as"), """fx_geo as (select id * 10 + c as id, lon + dx as lon, lat + dy as lat
       from fx_base, (values (1, 0.0::double, 0.0::double), (2, 0.0, 0.25), (3, 0.5, 0.25), (4, 0.5, 0.0)) v(c, dx, dy))""", ALBERS,
      """corners as (select id // 10 as id, id % 10 as c, lon, lat, round(a*sqrt(c-n*q)/n*sin(th), 3) + 0.0::double as x,
       round(a*sqrt(c-n*q0)/n - a*sqrt(c-n*q)/n*cos(th), 3) + 0.0::double as y from placed)"""],
      """select a.id, a.c::int as edge_no, a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2, a.x as x1, a.y as y1, b.x as x2, b.y as y2
       from corners a join corners b on b.id = a.id and b.c = a.c % 4 + 1"""),
    "points_in_zones": _sql([ZONE, ENTITY, IN_ZONE], "select city, entity_id, zone_id from in_zone"),
    "points_in_fragments": _sql([ZONE, AREA, ENTITY, IN_ZONE, IN_AREA, LOCATED], "select city, entity_id, zone_id, area_id from located"),
    "zone_grade_area": _sql([ZONE, AREA, OVERLAP], "select city, zone_id, grade, round(sum(area), 6) as area from overlap group by city, zone_id, grade"),
    "zone_grade_share": _sql([ZONE, AREA, OVERLAP, SHARES], "select city, zone_id, grade, round(area, 6) as area, round(area_perc, 6) as area_perc from shares"),
    "majority_grade": _sql(CLASSIFIED_PARTS, "select city, zone_id, grade, round(area, 6) as area, round(area_perc, 6) as area_perc, majority_grade from classified"),
    "grouped_members": _sql([ZONE, AREA, OVERLAP], """select city, zone_id, grade, cast(floor(area_id / 1000) as bigint) as block,
      string_agg(cast(area_id as varchar), ',' order by area_id) as area_ids, round(sum(area), 6) as area
      from overlap group by city, zone_id, grade, floor(area_id / 1000)"""),
    "zone_summary": _sql(CLASSIFIED_PARTS, "select city, zone_id as sab_id, grade, round(area, 6) as area, round(area_perc, 6) as area_perc, majority_grade from classified"),
    "zone_drilldown": _sql([*CLASSIFIED_PARTS, ENTITY, IN_ZONE, IN_AREA, LOCATED], """select o.city, o.zone_id, o.area_id, round(o.area, 6) as area, o.grade, w.majority_grade, l.entity_id
      from overlap o left join winners w on o.city = w.city and o.zone_id = w.zone_id
      left join located l on l.city = o.city and l.zone_id = o.zone_id and l.area_id = o.area_id where o.city = 'ASIA' and o.zone_id = 7"""),
    "area_layer": _sql([AREA], """select city, area_id, grade, n as edge_no,
      case n when 1 then x0 when 2 then x0 else x1 end as x1, case n when 1 then y0 when 4 then y0 else y1 end as y1,
      case n when 2 then x1 when 3 then x1 else x0 end as x2, case n when 1 then y1 when 2 then y1 else y0 end as y2
      from (select *, unnest([1, 2, 3, 4]) as n from fx_area where city = 'EUROPE') a"""),
    "combined": _sql(COMBINED_PARTS, """select city, zone_id, grade, round(area, 6) as area, round(area_perc, 6) as area_perc, majority_grade,
      entity_id, area_id, level, n_total from combined"""),
    "located_in_classified": _sql([*CLASSIFIED_PARTS, ENTITY, IN_ZONE, IN_AREA, LOCATED], """select city, entity_id, zone_id, area_id from located l
      where exists (select 1 from winners w where w.city = l.city and w.zone_id = l.zone_id)"""),
    "grade_share": _sql(COMBINED_PARTS, """select city, grade, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (partition by city), 6) as percent
      from combined group by city, grade"""),
    "group_membership": _sql([*COMBINED_PARTS, GROUPS], """select c.city, c.zone_id, c.grade, c.entity_id, g.comparison, g.grade_group
      from combined c join groups g on c.grade = g.grade"""),
    "spend_join": _sql([*COMBINED_PARTS, SPENDING], """select c.city, c.zone_id, c.grade, c.area_id, c.entity_id, round(s.pp_total, 6) as pp_total
      from combined c left join fx_spending s on s.state = c.city and s.id = cast(c.entity_id as bigint)"""),
    "compare_composition": _composition("grade"),
    "compare_composition_majority": _composition("majority_grade"),
    "compare_rate": _sql([*COMBINED_PARTS, GROUPS], f"""select city, comparison, grade_group, round(avg({_percent('n_subsidised')}), 6) as rate
      from combined join groups on combined.grade = groups.grade group by city, comparison, grade_group"""),
    "compare_spending": _sql([*COMBINED_PARTS, SPENDING, GROUPS], """select c.city, comparison, grade_group, round(avg(s.pp_total), 6) as pp_total
      from combined c join groups on c.grade = groups.grade left join fx_spending s on s.state = c.city and s.id = cast(c.entity_id as bigint)
      group by c.city, comparison, grade_group"""),
    "spend_by_group": _sql([*COMBINED_PARTS, SPENDING], """select c.city, case c.city when 'MIDDLE EAST' then 'ME' else left(c.city, 2) end as code, g.grade_group,
      round(avg(s.pp_total), 6) as pp_total from combined c join (values ('A', 'A'), ('D', 'D'), ('A/B', 'A'), ('A/B', 'B'), ('C/D', 'C'), ('C/D', 'D')) g(grade_group, grade)
      on g.grade = c.grade left join fx_spending s on s.state = c.city and s.id = cast(c.entity_id as bigint) group by c.city, g.grade_group""").replace("else left(c.city, 2)", "when 'AMERICA' then 'AM' else left(c.city, 2)"),
    "composition_mean": _by_grade("select city, grade, category, round(value, 6) as value from by_grade"),
    "pair_index": _by_grade("select city, grade, category, cast(row_number() over (partition by city, grade order by category) as int) as paired from by_grade"),
    "rank_by_mean": _by_grade("""select city, category, round(mean, 6) as value, cast(dense_rank() over (partition by city order by round(mean, 9)) as int) as rank
      from (select city, category, avg(value) as mean from by_grade group by city, category) m"""),
    "fixed_order": _by_grade("""select city, grade, category, round(value, 6) as value,
      cast(list_position(['n_low', 'n_urgent', 'n_high', 'n_medium', 'n_unspecified'], category) as bigint) as position from by_grade"""),
    "unpivot_counts": _sql([ENTITY], _stacked("select entity_id, n_total, '{c}' as category, {c} as value from fx_entity")),
    "nest_by_key": _sql([ENTITY], """select city, cast(floor(id / 1000) as bigint) as block, string_agg(id || ':' || level, ',' order by id) as members,
      cast(count(*) as int) as n_members from (select city, cast(entity_id as bigint) as id, level from fx_entity) e group by city, floor(id / 1000)"""),
    "union_layers": _sql([AREA], "select * from fx_area where grade is not null"),
    "mean_all_columns": _sql([ENTITY], "select " + ", ".join(f"round(avg({_number_or_null(c)}), 6) as {c}" for c in [*COUNTS, "n_total", "n_subsidised"]) + " from fx_entity"),
    "distinct_keys": _sql([ENTITY], "select count(distinct city) as cities, count(distinct level) as levels, count(distinct entity_id) as entities from fx_entity"),
    "register_views": _sql([AREA], "select city, grade, count(*) as n from fx_area group by city, grade"),
    "interval_quantiles": _sql([SPENDING], """select state, 0.025::double as prob, round(quantile_cont(pp_total, 0.025), 3) as quantile from fx_spending group by state
      union all select state, 0.975::double, round(quantile_cont(pp_total, 0.975), 3) from fx_spending group by state"""),
    "majority_flags": _sql([ENTITY], "select entity_id, " + ", ".join(f"{_flag(c)} as {c}_maj" for c in ("n_urgent", "n_low", "n_subsidised")) + " from fx_entity"),
    "counterfactual_mean": _sql([MODEL, """means as (select avg(1 - 1/(1+exp(-(1.4::double - (0.4::double*0 - 0.3::double*is_final + 0.2::double*is_building))))) as m0,
      avg(1 - 1/(1+exp(-(1.4::double - (0.4::double*1 - 0.3::double*is_final + 0.2::double*is_building))))) as m1 from fx_model)"""],
      """select 0.0::double as effect_value, round(m0, 6) as mean_prob, round(m1-m0, 6) as difference from means
      union all select 1.0::double, round(m1, 6), round(m1-m0, 6) from means"""),
    "fit_ordinal_null": _sql([MODEL, """per as (select outcome, count(*) as n from fx_model group by outcome),
      running as (select outcome, lead(outcome) over (order by outcome) as following,
       sum(n) over (order by outcome) / (select sum(n)::double from per) as p from per)"""],
      "select outcome || '|' || following as term, round(ln(p/(1-p)), 6) as estimate from running where following is not null"),
    "fit_ordinal_estimates": _sql(["recursive " + MODEL, ASCENT], """select term, round(v, 5) + 0.0::double as estimate
      from (select unnest(['hi_value', 'is_final', 'is_building', '1-URGENT|2-HIGH', '2-HIGH|3-MEDIUM', '3-MEDIUM|4-NOT SPECIFIED',
       '4-NOT SPECIFIED|5-LOW']) as term, unnest(th) as v from ascent where step = 1400) t"""),
    "study_model": _sql(COMBINED_PARTS, f"""select city, zone_id, entity_id, majority_grade, ascii(majority_grade) - 64 as majority_level,
      {_flag('n_urgent')} as urgent_maj, {_flag('n_low')} as low_maj, {_flag('n_subsidised')} as subsidised_maj
      from combined where grade is not null and entity_id is not null"""),
    "fit_ordinal": _sql(ESTIMATED, f"""select term, round(est, 6) + 0.0::double as estimate, round(se, 6) as std_error, round(est / se, 4) + 0.0::double as t_value, round({ERFC}, 6) + 0.0::double as p_value
      from (select *, abs(est / se) / sqrt(2.0::double) as z from (select {TERMS} as term, unnest(th) as est, unnest(list_transform(range(1, 8), lambda i: sqrt(v[i][i]))) as se from best, last_inv) a) b"""),
    "simulate_interval": _sql([*ESTIMATED, CHOLESKY, DRAWN], """select outcome, effect_value, round(lower, 3) as lower, round(mean, 3) as mean, round(upper, 3) as upper,
      max(lower) over (partition by outcome) > min(upper) over (partition by outcome) as apart from ranges"""),
    "fragment_edges": _sql([ZONE, AREA], """select city, zone_id, area_id, false as hole, e::bigint as edge_no,
       case when e <= 2 then x0 else x1 end as x1, case when e in (2, 3) then y1 else y0 end as y1, case when e in (2, 3) then x1 else x0 end as x2, case when e <= 2 then y1 else y0 end as y2
      from (select z.city, z.zone_id, a.area_id, greatest(z.x0, a.x0) as x0, greatest(z.y0, a.y0) as y0, least(z.x1, a.x1) as x1, least(z.y1, a.y1) as y1
       from fx_zone z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1) c, range(1, 5) r(e)"""),
    "fragment_polygons": _sql([ZONE, AREA], """select city, zone_id, area_id, round(area, 6) as area, round(case when l >= bottom then lo else x0 + (bottom - y0) / s end, 6) as xmin, round(bottom, 6) as ymin,
       round(hi, 6) as xmax, round(least(h, top), 6) as ymax from (
       select *, case when h <= bottom then 0 when l >= bottom then (l + h - 2 * bottom) / 2 * (hi - lo) else (h - bottom) * (h - bottom) / (2 * s) end
        - case when h <= top then 0 when l >= top then (l + h - 2 * top) / 2 * (hi - lo) else (h - top) * (h - top) / (2 * s) end as area from (
        select *, y0 + (lo - x0) * s as l, y0 + (hi - x0) * s as h from (
         select z.city, z.zone_id, a.area_id, (z.y1 - z.y0) / (z.x1 - z.x0) as s, greatest(z.x0, a.x0) as lo, least(z.x1, a.x1) as hi, greatest(z.y0, a.y0) as bottom, a.y1 as top, z.x0, z.y0
         from fx_zone z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1) m) e) f where area > 1e-9"""),
    "dissolved_edges": _sql([ZONE, AREA, """sides as (select city, zone_id, grade, e, case when e <= 2 then x0 else x1 end as x1, case when e in (2, 3) then y1 else y0 end as y1,
       case when e in (2, 3) then x1 else x0 end as x2, case when e <= 2 then y1 else y0 end as y2
      from (select z.city, z.zone_id, a.grade, greatest(z.x0, a.x0) as x0, greatest(z.y0, a.y0) as y0, least(z.x1, a.x1) as x1, least(z.y1, a.y1) as y1
       from fx_zone z join fx_area a on z.city = a.city and z.x0 < a.x1 and a.x0 < z.x1 and z.y0 < a.y1 and a.y0 < z.y1 where grade is not null) c, range(1, 5) r(e))"""],
      """select a.city, a.zone_id, a.grade, a.x1, a.y1, a.x2, a.y2 from sides a anti join sides b
       on a.city = b.city and a.zone_id = b.zone_id and a.grade = b.grade and a.x1 = b.x2 and a.y1 = b.y2 and a.x2 = b.x1 and a.y2 = b.y1"""),
    "repair_rings": _sql([ZONE], """select city, zone_id, false as hole, e::bigint as edge_no, xs[e] as x1, ys[e] as y1, xs[e % 3 + 1] as x2, ys[e % 3 + 1] as y2
      from (select city, zone_id, unnest([[x0, x0, (x0 + x1) / 2], [(x0 + x1) / 2, x1, x1]]) as xs, unnest([[y0, y1, (y0 + y1) / 2], [(y0 + y1) / 2, y1, y0]]) as ys from fx_zone) t, range(1, 4) r(e)"""),
    "unproject_albers": _sql([GEO], "select id, round(lon, 8) as lon, round(lat, 8) as lat from fx_geo"),
    "projected_study": _sql([ZONE, AREA, ENTITY, """fx_geo as (select {'city': city, 'zone': zone_id, 'c': c} as id, (case when c <= 2 then x0 else x1 end) * 0.01::double - 100 as lon,
       (case when c in (2, 3) then y1 else y0 end) * 0.01::double + 38 as lat from fx_zone, range(1, 5) r(c))""", ALBERS,
      """corners as (select id, a*sqrt(c-n*q)/n*sin(th) as x, a*sqrt(c-n*q0)/n - a*sqrt(c-n*q)/n*cos(th) as y from placed),
      own as (select a.id.city as city, a.id.zone as zone_id, sum((b.x - a.x) * (a.y + b.y) / 2) as own_area from corners a join corners b on a.id.city = b.id.city and a.id.zone = b.id.zone and b.id.c = a.id.c % 4 + 1 group by all),
      moved as (select city, entity_id, x + 0.0617::double as x, y + 0.0617::double as y from fx_entity),
      counts as (select z.city, z.zone_id, count(*) as n_entities, count(*) filter (a.grade = 'A') as n_in_a from fx_zone z join moved e on z.city = e.city and e.x between z.x0 and z.x1 and e.y between z.y0 and z.y1
       join fx_area a on a.city = e.city and e.x between a.x0 and a.x1 and e.y between a.y0 and a.y1 group by all)"""],
      "select city, zone_id, round(own_area, 1) as own_area, n_entities, n_in_a from own left join counts using (city, zone_id)"),
    "nest_any_id": _sql([ENTITY], """select city, (r // 50)::bigint as block, string_agg(coalesce(id, '-'), ',' order by r) as members
      from (select city, id, row_number() over (partition by city order by id nulls first) - 1 as r from (select city, case when cast(entity_id as bigint) % 3 <> 0 then entity_id end as id from fx_entity) e) n group by city, r // 50"""),
    "map_layer": _sql(CLASSIFIED_PARTS, "select city, zone_id, grade, round(area_perc, 6) as area_perc, majority_grade, (ascii(majority_grade) - 64)::int as majority_level from classified"),
    "published_results": _sql([*COMBINED_PARTS], """select 'zone_summary' as name, city, count(*) as n from classified group by city
      union all select 'map_layer', city, count(*) from classified group by city union all select 'fragments', city, count(*) from overlap group by city
      union all select 'located', city, count(*) from located group by city union all select 'grade_share', city, count(distinct coalesce(grade, '-')) from combined group by city
      union all select 'entities_in_zones', city, count(*) from located l where exists (select 1 from winners w where w.city = l.city and w.zone_id = l.zone_id) group by city"""),
    "model_report": _sql([*ESTIMATED, CHOLESKY, DRAWN], f"""select 'coefficients' as section, term as item, null::double as effect_value, round(est, 6) + 0.0::double as a, round(se, 6) as b, round({ERFC}, 6) + 0.0::double as c
       from (select *, abs(est / se) / sqrt(2.0::double) as z from (select {TERMS} as term, unnest(th) as est, unnest(list_transform(range(1, 8), lambda i: sqrt(v[i][i]))) as se from best, last_inv) q) r
      union all select 'counterfactual', 'top', e, round(m, 5), round(max(m) over () - min(m) over () * 1, 5) * (select sign(th[1]) from best), null
       from (select e, sum(n / (1 + exp(th[7] - th[1]*e - th[2]*x2 - th[3]*x3))) / sum(n) as m from cells, best, (values (0.0::double), (1.0)) v(e) group by e) s
      union all select 'intervals', outcome, effect_value, round(lower, 3), round(mean, 3), round(upper, 3) from ranges"""),
}
ORACLES["zone_drilldown_published"] = ORACLES["zone_drilldown"]
