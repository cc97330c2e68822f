"""Building blocks of the checking SQL (DuckDB dialect).

Each block is a common table expression; `sql()` puts those a query needs in
front of it. The blocks are written from the definitions, not from the Spark
plans: densifying is a grid join here, smoothing a recursive query, and so on.
"""

from __future__ import annotations

import re

from liftline.params import LAG_COLUMNS, LAGS, PROMOS, PROMOTIONS

SHOCK_WEEKS = (199910, 199911, 199912, 199913, 199914, 199915, 199916, 200050, 200051)

BLOCKS: dict[str, str] = {}


def block(name: str, text: str) -> None:
    BLOCKS[name] = text


def sql(body: str, **local: str) -> str:
    """The body with every block it names, directly or through other blocks."""
    known = {**BLOCKS, **local}
    used: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in known:
            if name != own and name not in used and re.search(rf"\b{name}\b", text):
                visit(known[name], name)
                if name not in used:
                    used.append(name)

    visit(body)
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in used)
    return f"WITH RECURSIVE {ctes}\n{body}"


def half_up(a: str, b: str) -> str:
    return f"((2*({a}) + ({b})) // (2*({b})))"


# --- adapter ---------------------------------------------------------------
block("lines0", """
SELECT l_partkey, l_suppkey, date_trunc('week', l_shipdate)::DATE AS wk_start,
  l_quantity::BIGINT AS qty, round(l_extendedprice*100)::BIGINT AS cents,
  round(l_discount*100)::BIGINT AS pct, l_returnflag AS rf, l_linestatus AS ls FROM lineitem""")

FACTS = """
  count(*) AS n, sum(qty)::BIGINT AS qty, sum(cents)::BIGINT AS cents,
  sum(cents*(100-pct))::BIGINT AS net, sum(pct)::BIGINT AS pct,
  (count(*) FILTER (rf<>'R')) AS kept_n,
  coalesce(sum(qty) FILTER (rf<>'R'),0)::BIGINT AS kept_qty,
  coalesce(sum(cents*(100-pct)) FILTER (rf<>'R'),0)::BIGINT AS kept_net,
  coalesce(sum(qty) FILTER (rf='A'),0)::BIGINT AS qty_a,
  coalesce(sum(qty) FILTER (rf='N'),0)::BIGINT AS qty_n,
  coalesce(sum(qty) FILTER (rf='R'),0)::BIGINT AS qty_r,
  coalesce(sum(qty) FILTER (ls='F'),0)::BIGINT AS qty_f,
  coalesce(sum(qty) FILTER (ls='O'),0)::BIGINT AS qty_o"""

block("sfacts", f"""
SELECT p_brand AS upc, n_regionkey::VARCHAR AS store, wk_start, {FACTS}
FROM lines0 JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
JOIN nation ON s_nationkey=n_nationkey GROUP BY ALL""")
block("sprice", f"""
SELECT upc, store, year(wk_start) AS y, quarter(wk_start) AS q,
  {half_up('sum(cents)::BIGINT', 'sum(qty)::BIGINT')} AS regular_cents
FROM sfacts GROUP BY ALL""")
block("panel", f"""
SELECT f.upc, f.store, (isoyear(wk_start)*100+weekofyear(wk_start))::INTEGER AS yr_wk,
  regular_cents/100.0::DOUBLE AS regular_price,
  CASE WHEN kept_n>0 THEN {half_up('regular_cents*(100*n-pct)', '100*n')}/100.0::DOUBLE END AS retail_price,
  qty::DOUBLE AS units, net/10000.0::DOUBLE AS sales,
  (pct > 5*n)::INTEGER AS instore_promo, (qty_r > qty_a)::INTEGER AS flyer,
  CASE WHEN qty_f<>qty_o THEN (qty_f>qty_o)::INTEGER END AS cpp,
  (2*kept_qty-qty)::DOUBLE AS net_units, (2*kept_net-net)/10000.0::DOUBLE AS net_sales
FROM sfacts f JOIN sprice p ON f.upc=p.upc AND f.store=p.store
  AND year(wk_start)=p.y AND quarter(wk_start)=p.q""")
block("gfacts", f"""
SELECT p_brand AS group_code, wk_start, {FACTS}
FROM lines0 JOIN part ON l_partkey=p_partkey GROUP BY ALL""")
block("gprice", f"""
SELECT group_code, year(wk_start) AS y, quarter(wk_start) AS q,
  {half_up('sum(cents)::BIGINT', 'sum(qty)::BIGINT')} AS regular_cents FROM gfacts GROUP BY ALL""")
block("gpanel", f"""
SELECT (regexp_extract(f.group_code,'(\\d+)$',1)::INTEGER % 5)::INTEGER AS dept, f.group_code,
  (isoyear(wk_start)*100+weekofyear(wk_start))::INTEGER AS yr_wk,
  qty::DOUBLE AS qty, net/10000.0::DOUBLE AS sales,
  CASE WHEN pct>5*n AND qty_a>=qty_n AND qty_a>=qty_r THEN pct/n::DOUBLE ELSE 0.0::DOUBLE END AS pa_depth,
  CASE WHEN pct>5*n AND qty_n>qty_a AND qty_n>=qty_r THEN pct/n::DOUBLE ELSE 0.0::DOUBLE END AS ar_depth,
  CASE WHEN pct>5*n AND qty_r>qty_a AND qty_r>qty_n THEN pct/n::DOUBLE ELSE 0.0::DOUBLE END AS tr_depth,
  CASE WHEN pct>5*n THEN CASE qty%4 WHEN 0 THEN 'FRONT' WHEN 1 THEN 'BACK' WHEN 2 THEN 'INSIDE' END END
    AS page_location,
  (pct>5*n AND qty_r>qty_a)::INTEGER AS flyer_flag,
  (pct>5*n AND qty_f>qty_o)::INTEGER AS cpp_flag,
  (pct>5*n AND qty%3=0)::INTEGER AS digital_flag,
  (pct>5*n AND n%5=0)::INTEGER AS digest_flag,
  regular_cents/100.0::DOUBLE AS regular_price,
  CASE WHEN kept_qty>0 THEN {half_up('kept_net', '100*kept_qty')}/100.0::DOUBLE ELSE 0.0::DOUBLE END AS live_price,
  (2*kept_n-n)::DOUBLE AS transactions
FROM gfacts f JOIN gprice p ON f.group_code=p.group_code
  AND year(wk_start)=p.y AND quarter(wk_start)=p.q""")
block("cal", """
SELECT (isoyear(d)*100+weekofyear(d))::INTEGER AS yr_wk, d::DATE AS start_date, (d + INTERVAL 6 DAY)::DATE AS end_date
FROM (SELECT unnest(generate_series(date_trunc('week', min(l_shipdate))::TIMESTAMP,
  date_trunc('week', max(l_shipdate))::TIMESTAMP, INTERVAL 7 DAY)) AS d FROM lineitem)""")

BRANDS = """(SELECT DISTINCT p_brand AS focus_group, regexp_extract(p_brand,'(\\d+)$',1)::INTEGER AS k FROM part)"""


def _edges(step: int) -> str:
    return f"""
SELECT focus_group, 'Brand#' || ((k+{step}-1)%25+1)::VARCHAR AS target_group,
  (k%5)::INTEGER AS focus_dept, (((k+{step}-1)%25+1)%5)::INTEGER AS target_dept,
  CASE k%3 WHEN 0 THEN ['cpp_flag','pa_depth'] WHEN 1 THEN ['digital_flag']
    ELSE ['tr_depth','page_front','digest_flag'] END AS promos
FROM {BRANDS}"""


block("cann_edges", _edges(5))
block("halo_edges", _edges(1))
block("pf_edges", f"""
SELECT focus_group, (k%5)::INTEGER AS focus_dept,
  unnest(CASE k%2 WHEN 0 THEN ['cpp_flag_lag_1','pa_depth_lag_2']
    ELSE ['tr_depth_lag_4','digital_flag_lag_1','page_back_lag_3'] END) AS lag
FROM {BRANDS}""")

# --- weeks of the modelling run --------------------------------------------
block("wk_last", "SELECT max(yr_wk) AS w FROM cal")
block("wk_end", """
SELECT min(yr_wk) AS w FROM (SELECT yr_wk FROM cal WHERE yr_wk < (SELECT w FROM wk_last)
  ORDER BY yr_wk DESC LIMIT 12)""")
block("wk_start_", """
SELECT min(yr_wk) AS w FROM (SELECT yr_wk FROM cal WHERE yr_wk < (SELECT w FROM wk_end)
  ORDER BY yr_wk DESC LIMIT 203)""")
block("hcal", """
SELECT yr_wk FROM cal WHERE yr_wk BETWEEN (SELECT w FROM wk_start_) AND (SELECT w FROM wk_end)""")
block("fcal", "SELECT yr_wk FROM cal WHERE yr_wk > (SELECT w FROM wk_end)")
block("hpanel", "SELECT * FROM gpanel WHERE yr_wk IN (SELECT yr_wk FROM hcal)")
block("fpanel", "SELECT * FROM gpanel WHERE yr_wk IN (SELECT yr_wk FROM fcal)")

DEPTH_COLS = ("pa_depth", "ar_depth", "tr_depth")
FLAG_COLS = ("flyer_flag", "cpp_flag", "digital_flag", "digest_flag")


def dense(panel: str, cal: str) -> str:
    zero = ", ".join(f"coalesce({c},0)::DOUBLE AS {c}" for c in
                     ("qty", "sales", "regular_price", "live_price", "transactions"))
    depth = ", ".join(
        f"coalesce(round({c}::DECIMAL(18,6),1),0)::DOUBLE AS {c}" for c in DEPTH_COLS)
    flags = ", ".join(f"coalesce({c},0)::INTEGER AS {c}" for c in FLAG_COLS)
    pages = ", ".join(f"coalesce((page_location='{p.upper()}')::INTEGER,0) AS page_{p}"
                      for p in ("front", "back", "inside"))
    return f"""
SELECT g.dept, g.group_code, c.yr_wk, {zero}, {depth}, {flags}, {pages}
FROM (SELECT DISTINCT dept, group_code FROM {panel}) g CROSS JOIN {cal} c
LEFT JOIN {panel} p ON p.group_code=g.group_code AND p.yr_wk=c.yr_wk"""


def clean(dense_name: str) -> str:
    def filled(c: str) -> str:
        return (f"CASE WHEN {c}=0 THEN avg({c}) OVER (PARTITION BY group_code ORDER BY yr_wk "
                f"ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) ELSE {c} END AS {c}")
    return f"""
SELECT * REPLACE ({filled('regular_price')}, {filled('live_price')},
  CASE WHEN transactions<0 THEN 0.0 ELSE transactions END AS transactions,
  CASE WHEN sales<0 THEN 0.0 ELSE sales END AS sales),
  CASE WHEN qty<0 THEN 0.0 ELSE qty END AS modelled_qty
FROM {dense_name}"""


block("hdense", dense("hpanel", "hcal"))
block("hclean", clean("hdense"))
block("fdense", dense("fpanel", "fcal"))
block("fclean", clean("fdense"))

W = "(PARTITION BY group_code ORDER BY yr_wk)"
block("hlags", "SELECT *, " + ", ".join(
    f"lag({p},{k}) OVER {W} AS {p}_lag_{k}" for k in LAGS for p in PROMOTIONS) + " FROM hclean")
block("hkept", "SELECT h.* REPLACE (" + ", ".join(
    f"""CASE WHEN group_code NOT IN (SELECT focus_group FROM pf_edges)
      OR (group_code, '{c}') IN (SELECT (focus_group, lag) FROM pf_edges) THEN {c} END AS {c}"""
    for c in LAG_COLUMNS) + ") FROM hlags h")
block("hhead", f"""
SELECT * EXCLUDE (rn), (rn-4)::INTEGER AS t FROM
  (SELECT *, row_number() OVER {W} AS rn FROM hkept) WHERE rn > 4""")
block("hslot", """
SELECT *, CASE WHEN count(*) OVER (PARTITION BY group_code) >= 104 THEN ((t-1)%52+1)::INTEGER END AS slot
FROM hhead""")
block("hfirst", "SELECT group_code, min(t) FILTER (modelled_qty>0) AS first_t FROM hslot GROUP BY 1")
# the line by its normal equations
block("hline", """
SELECT group_code, avg(modelled_qty) AS mean_all,
  count(*) FILTER (t>=first_t) AS n,
  avg(t) FILTER (t>=first_t) AS mt, avg(modelled_qty) FILTER (t>=first_t) AS my,
  sum(t*modelled_qty) FILTER (t>=first_t) AS sty, sum(t*t) FILTER (t>=first_t) AS stt, any_value(first_t) AS first_t
FROM hslot JOIN hfirst USING (group_code) GROUP BY 1""")
block("htrend", """
SELECT h.*, first_t, CASE WHEN first_t IS NULL THEN mean_all WHEN t<first_t THEN 0.0
  WHEN n=1 THEN modelled_qty
  ELSE my + (sty-n*mt*my)/(stt-n*mt*mt)*(t-mt) END AS trend
FROM hslot h JOIN hline USING (group_code)""")
ANY_PROMO = "(" + " OR ".join(f"{p}<>0" for p in PROMOTIONS) + ")"
block("hdet", f"SELECT *, modelled_qty-trend AS det, {ANY_PROMO} AS promo FROM htrend")


def center(source: str) -> str:
    return f"""
SELECT group_code, CASE WHEN mad=0 THEN m_all ELSE m END AS center,
  CASE WHEN mad=0 THEN mad_all ELSE mad END AS mad FROM (
  SELECT d.group_code, any_value(c.m) AS m, any_value(c.m_all) AS m_all,
    median(abs(det-c.m)) FILTER (NOT promo) AS mad, median(abs(det-c.m_all)) AS mad_all
  FROM {source} d JOIN (SELECT group_code, median(det) FILTER (NOT promo) AS m, median(det) AS m_all
    FROM {source} GROUP BY 1) c USING (group_code) GROUP BY 1)"""


block("hcenter", center("hdet"))
SHOCK = "(" + ",".join(map(str, SHOCK_WEEKS)) + ")"
block("table_", f"""
SELECT h.* EXCLUDE (det, promo, modelled_qty, first_t),
  (yr_wk IN {SHOCK} AND NOT promo AND coalesce(abs(det-center) > 2*1.5*mad, false))::INTEGER AS repaired,
  CASE WHEN yr_wk IN {SHOCK} AND NOT promo AND coalesce(abs(det-center) > 2*1.5*mad, false)
    THEN center+trend ELSE modelled_qty END AS modelled_qty
FROM hdet h JOIN hcenter USING (group_code)""")

block("base", """
SELECT *, trend + CASE WHEN slot IS NULL THEN 0 ELSE qty*0.05 END AS baseline_qty,
  trend + CASE WHEN slot IS NULL THEN 0
    ELSE avg(modelled_qty-trend) OVER (PARTITION BY group_code, slot) END AS fitted
FROM table_""")
block("results", """
SELECT *, sales-baseline_sales AS lift_sales,
  CASE WHEN baseline_sales>0 THEN (sales-baseline_sales)/baseline_sales ELSE 0 END AS lift_share
FROM (SELECT *, baseline_qty*regular_price AS baseline_sales FROM base)""")

# P(F >= f): the incomplete beta integral by Simpson's rule on 2000 intervals, for d2 > 2
block("ftail", """
SELECT id, f, d1, d2, least(1.0, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END * x/6000
  * CASE WHEN i=0 THEN 0 ELSE exp(lgamma((d1+d2)/2)-lgamma(d1/2)-lgamma(d2/2)
      + (d2/2-1)*ln(x*i/2000.0) + (d1/2-1)*ln(1-x*i/2000.0)) END)) AS p
FROM (SELECT *, d2/(d2+d1*f) AS x FROM fcases), (SELECT unnest(range(2001)) AS i)
GROUP BY ALL""")

block("levels_", """
SELECT dept, group_code, greatest(coalesce(max(baseline_qty) FILTER (rn=1),0),
    coalesce(avg(baseline_qty) FILTER (rn<=12),0)) AS level,
  coalesce(nullif(avg(regular_price),0),10.0) AS price, """ + ", ".join(
    f"coalesce(avg(lift_share) FILTER ({p}>0), 0.10) AS {p}_impact" for p in PROMOS) + """
FROM (SELECT *, row_number() OVER (PARTITION BY group_code ORDER BY yr_wk DESC) AS rn FROM results)
GROUP BY 1, 2""")
block("ahead", """
SELECT dept, group_code, yr_wk, """ + ", ".join(PROMOS) + """, level AS baseline_qty, price AS regular_price,
  level*""" + "*".join(f"(CASE WHEN {p}>0 THEN 1+{p}_impact ELSE 1 END)" for p in PROMOS) + """ AS qty
FROM fclean JOIN levels_ USING (dept, group_code)""")
ORIGINS = 3
block("origins_", f"""
SELECT a.yr_wk AS origin, b.yr_wk AS until FROM (SELECT yr_wk, row_number() OVER (ORDER BY yr_wk DESC) AS n FROM hcal) a
JOIN (SELECT yr_wk, row_number() OVER (ORDER BY yr_wk DESC) AS n FROM hcal) b ON a.n=b.n+12
WHERE a.n IN ({', '.join(str(13 + 4 * i) for i in range(ORIGINS))})""")


def by_origin(name: str) -> str:
    """A block of the chain with the origin beside the group."""
    text = BLOCKS[name].replace("h.* EXCLUDE (det, promo, modelled_qty, first_t)", "h.* EXCLUDE (det, promo, modelled_qty, first_t)")
    text = text.replace("d.group_code,", "d.origin, d.group_code,").replace("USING (group_code)", "USING (origin, group_code)")
    text = text.replace("PARTITION BY group_code", "PARTITION BY origin, group_code").replace("SELECT group_code,", "SELECT origin, group_code,")
    text = text.replace("SELECT dept, group_code,", "SELECT origin, dept, group_code,").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
    text = re.sub(r"GROUP BY 1(?!,)", "GROUP BY 1, 2", text)
    for other in ("hslot", "hfirst", "hline", "htrend", "hdet", "hcenter", "table_", "base", "results"):
        text = re.sub(rf"\b{other}\b", f"o{other}", text)
    return text


block("ohslot", """
SELECT *, CASE WHEN count(*) OVER (PARTITION BY origin, group_code) >= 104 THEN ((t-1)%52+1)::INTEGER END AS slot
FROM hhead JOIN origins_ ON yr_wk <= origin""")
for _name in ("hfirst", "hline", "htrend", "hdet", "hcenter", "table_", "base", "results", "levels_"):
    block("o" + _name, by_origin(_name))
block("oerrors", """
SELECT origin, dept, group_code, yr_wk, modelled_qty AS actual, level*""" + "*".join(
    f"(CASE WHEN {p}>0 THEN 1+{p}_impact ELSE 1 END)" for p in PROMOS) + """ AS forecast
FROM hhead JOIN origins_ ON yr_wk > origin AND yr_wk <= until JOIN olevels_ USING (origin, dept, group_code)""")
block("fcerrors", """
SELECT dept, group_code, count(*) AS n_forecasts, sum(abs(forecast-actual))/nullif(sum(actual), 0) AS forecast_wmape,
  avg(abs(forecast-actual)/actual) FILTER (actual>0) AS forecast_mape FROM oerrors GROUP BY 1, 2""")

ACTIVE = "coalesce(nullif(concat_ws(', ', " + ", ".join(
    f"CASE WHEN {p}>0 THEN '{p}' END" for p in PROMOS) + "), ''), 'No promotions')"

# --- least squares -------------------------------------------------------------
TARGET = 1 << 30


def fit_blocks(name: str, long: str) -> dict[str, str]:
    """Blocks for the least squares of many keys; `long` gives (k, r, i, x): key, row, term number, value without zeros;
    term 0 is 1 in every row, term TARGET is the target (in every row).

    Gauss-Jordan elimination of the sums of products beside an identity, one term a step, a row per term holding its
    sums as a list. Terms that earlier ones span are left out. The block {name} has k, i, coef, std_error, t_value, n,
    dof, r2, rss."""
    v, t, g, s, e, q = (f"{name}_{c}" for c in "vtgseq")
    return {
        v: long,
        t: f"""SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i)::INTEGER AS pos, (count(*) OVER (PARTITION BY k)-1)::INTEGER AS m
          FROM (SELECT DISTINCT k, i FROM {v})""",
        g: f"""SELECT a.k, a.pos, a.i, a.m, list(coalesce(s, 0) ORDER BY b.pos) AS own FROM {t} a JOIN {t} b ON a.k=b.k
          LEFT JOIN (SELECT c.k, c.i, d.i AS j, sum(c.x*d.x) AS s FROM {v} c JOIN {v} d ON c.k=d.k AND c.r=d.r GROUP BY ALL) p
            ON p.k=a.k AND p.i=a.i AND p.j=b.i GROUP BY ALL""",
        s: f"""SELECT 0 AS step, k, pos, i, m, own[pos] AS size, false AS kept,
            own || list_transform(range(1, m+1), lambda j: CASE WHEN j=pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS row FROM {g} WHERE i<>{TARGET}
          UNION ALL SELECT step+1, k, pos, i, m, size, kept OR (pos=step+1 AND usable), CASE WHEN NOT usable THEN row
            WHEN pos=step+1 THEN list_transform(row, lambda x: x/top_row[step+1])
            ELSE list_transform(list_zip(row, top_row), lambda z: z[1]-row[step+1]/top_row[step+1]*z[2]) END
          FROM (SELECT *, top_row[step+1] > 1e-10*top_size AS usable FROM
            (SELECT *, any_value(row) FILTER (pos=step+1) OVER (PARTITION BY k) AS top_row,
              any_value(size) FILTER (pos=step+1) OVER (PARTITION BY k) AS top_size FROM {s} WHERE step<m))""",
        e: f"""SELECT k, i, pos, row[m+1] AS coef, row[m+1+pos] AS inverse FROM {s} WHERE step=m AND kept""",
        q: f"""SELECT y.k, n, n-terms AS dof, rss, 1-rss/nullif(yy-sy*sy/n, 0) AS r2 FROM
          (SELECT k, own[m+1] AS yy, own[1] AS sy FROM {g} WHERE i={TARGET}) y JOIN
          (SELECT k, own[1] AS n FROM {g} WHERE i=0) USING (k) JOIN
          (SELECT e.k, count(*) AS terms, any_value(y.yy)-sum(e.coef*g.own[g.m+1]) AS rss FROM {e} e JOIN {g} g ON g.k=e.k AND g.i=e.i
            JOIN (SELECT k, own[m+1] AS yy FROM {g} WHERE i={TARGET}) y ON y.k=e.k GROUP BY e.k) USING (k)""",
        name: f"""SELECT e.k, e.i, coef, sqrt(inverse*rss/dof) AS std_error, coef/sqrt(inverse*rss/dof) AS t_value,
          n::INTEGER AS n, dof::INTEGER AS dof, r2, rss FROM {e} e JOIN {q} q ON q.k=e.k"""}


# --- holidays: Easter by the method of the anonymous correspondent of 1876 --------
block("hyears", "SELECT DISTINCT y FROM (SELECT unnest([year(start_date), year(end_date)]) AS y FROM cal)")
block("heaster", """
SELECT y, make_date(y, ((h+l-7*m+114)//31)::INTEGER, ((h+l-7*m+114)%31+1)::INTEGER) AS easter FROM
 (SELECT *, (a+11*h+22*l)//451 AS m FROM (SELECT *, (32+2*(b%4)+2*(c//4)-h-c%4)%7 AS l FROM
 (SELECT *, (19*a+b-b//4-((b-(b+8)//25+1)//3)+15)%30 AS h FROM (SELECT y, y%19 AS a, y//100 AS b, y%100 AS c FROM hyears))))""")


def _nth_monday(month: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"({first} + ((8-isodow({first}))%7)::INTEGER + {7 * (n - 1)})::DATE"


HOLIDAY_DAYS = {
    "canada_day": "make_date(y,7,1)", "commonwealth_day": _nth_monday(3, 2), "christmas_day": "make_date(y,12,25)",
    "thanksgiving_day": _nth_monday(10, 2), "groundhog_day": "make_date(y,2,2)", "labor_day": _nth_monday(9, 1),
    "valentines_day": "make_date(y,2,14)", "national_aborginal_day": "make_date(y,6,21)", "st_patricks_day": "make_date(y,3,17)",
    "epiphany_day": "make_date(y,1,6)", "national_tartan_day": "make_date(y,4,6)", "remembrance_day": "make_date(y,11,11)",
    "hlthcr_ad_day": "make_date(y,10,18)", "vimy_ridge_day": "make_date(y,4,9)", "good_friday": "(easter-2)::DATE",
    "new_years": "make_date(y,1,1)", "anniversary_of_the_statue_of_westminister": "make_date(y,12,11)", "halloween": "make_date(y,10,31)"}
block("hdays", " UNION ALL ".join(f"SELECT '{n}' AS holiday, {e} AS day FROM heaster" for n, e in HOLIDAY_DAYS.items()))
block("hweeks", "SELECT yr_wk, " + ", ".join(
    f"coalesce(max((holiday='{n}')::INTEGER), 0) AS {n}" for n in HOLIDAY_DAYS)
    + " FROM cal LEFT JOIN hdays ON day BETWEEN start_date AND end_date GROUP BY yr_wk")

# --- cross features ---------------------------------------------------------------
block("crossdict", """
SELECT target_dept, target_group, kind, focus_dept, focus_group, promo, focus_group || '_' || promo || '_' || upper(kind) || '_PROMO' AS name,
  (row_number() OVER (PARTITION BY target_dept, target_group ORDER BY kind, focus_group, focus_dept, promo)-1)::INTEGER AS feature
FROM (SELECT DISTINCT target_dept, target_group, 'cann' AS kind, focus_dept, focus_group, unnest(promos) AS promo FROM cann_edges
  UNION SELECT DISTINCT target_dept, target_group, 'halo', focus_dept, focus_group, unnest(promos) FROM halo_edges) e
WHERE EXISTS (SELECT 1 FROM hpanel p WHERE p.dept=target_dept AND p.group_code=target_group)
  AND EXISTS (SELECT 1 FROM hpanel p WHERE p.dept=focus_dept AND p.group_code=focus_group)""")
block("crossvals", "SELECT target_dept AS dept, target_group AS group_code, yr_wk, feature, name, CASE promo "
      + " ".join(f"WHEN '{p}' THEN {p}::DOUBLE" for p in PROMOTIONS)
      + """ END AS value FROM crossdict x JOIN hclean c ON c.dept=x.focus_dept AND c.group_code=x.focus_group""")

# --- elasticity --------------------------------------------------------------
block("esrows", """
SELECT upc, store, yr_wk, regular_price, units,
  CASE WHEN instore_promo=0 THEN regular_price ELSE coalesce(retail_price, regular_price) END AS retail_price,
  CASE WHEN instore_promo=0 THEN 'No_Promo'
    WHEN instore_promo=1 AND flyer=0 AND cpp=0 THEN 'Instore_Only'
    WHEN instore_promo=1 AND flyer=1 AND cpp=0 THEN 'Instore_Flyer'
    WHEN instore_promo=1 AND flyer=0 AND cpp=1 THEN 'Instore_CPP'
    WHEN instore_promo=1 AND flyer=1 AND cpp=1 THEN 'Instore_Flyer_CPP'
    ELSE 'Other_Promo' END AS promo_type
FROM panel WHERE regular_price IS NOT NULL AND units>=0 AND sales>=0""")
block("eblocks", """
SELECT *, sum(changed::INTEGER) OVER (PARTITION BY upc, store ORDER BY yr_wk)::INTEGER AS block_id FROM (
  SELECT *, coalesce(promo_type <> lag(promo_type) OVER w
    OR (promo_type='No_Promo' AND regular_price <> lag(regular_price) OVER w), true) AS changed
  FROM esrows WINDOW w AS (PARTITION BY upc, store ORDER BY yr_wk))""")
block("ebounds", """
SELECT upc, store, block_id,
  CASE WHEN count(units)<4 THEN min(units)-1e-9
    WHEN quantile_cont(units,0.75)=quantile_cont(units,0.25) THEN median(units)-1e-9
    ELSE quantile_cont(units,0.25)-1.5*(quantile_cont(units,0.75)-quantile_cont(units,0.25)) END AS lo,
  CASE WHEN count(units)<4 THEN max(units)+1e-9
    WHEN quantile_cont(units,0.75)=quantile_cont(units,0.25) THEN median(units)+1e-9
    ELSE quantile_cont(units,0.75)+1.5*(quantile_cont(units,0.75)-quantile_cont(units,0.25)) END AS hi
FROM eblocks GROUP BY ALL""")
block("estats", """
SELECT upc, store, block_id, any_value(promo_type) AS promo_type, min(yr_wk) AS start_wk, max(yr_wk) AS end_wk,
  median(regular_price) AS regular_price,
  avg(units) FILTER (units BETWEEN lo AND hi) AS avg_units,
  avg(retail_price) FILTER (units BETWEEN lo AND hi) AS avg_retail,
  (count(*) FILTER (units BETWEEN lo AND hi))::INTEGER AS kept_weeks, count(*)::INTEGER AS weeks
FROM eblocks JOIN ebounds USING (upc, store, block_id) GROUP BY ALL""")
# the carried price, unpromoted block by unpromoted block
block("eregular", """
SELECT upc, store, block_id, regular_price,
  row_number() OVER (PARTITION BY upc, store ORDER BY block_id) AS n FROM estats WHERE promo_type='No_Promo'""")
block("ewalk", """
SELECT upc, store, n, block_id, regular_price AS price, false AS spiked FROM eregular WHERE n=1
UNION ALL
SELECT r.upc, r.store, r.n, r.block_id,
  CASE WHEN abs(r.regular_price-w.price)/w.price > 0.5 OR abs(r.regular_price-w.price)/w.price <= 0.05
    THEN w.price ELSE r.regular_price END,
  abs(r.regular_price-w.price)/w.price > 0.5
FROM ewalk w JOIN eregular r ON r.upc=w.upc AND r.store=w.store AND r.n=w.n+1""")
block("esmooth", """
SELECT s.*, coalesce(w.price, s.regular_price) AS price, coalesce(w.spiked, false) AS spiked,
  CASE WHEN w.spiked THEN w.price ELSE s.avg_retail END AS avg_price
FROM estats s LEFT JOIN ewalk w USING (upc, store, block_id)""")
block("eref", """
SELECT b.upc, b.store, b.block_id, max(r.block_id) AS ref_block
FROM esmooth b LEFT JOIN esmooth r ON r.upc=b.upc AND r.store=b.store
  AND r.block_id<b.block_id AND r.promo_type='No_Promo' GROUP BY ALL""")


def _log(a: str, b: str) -> str:
    return f"ln(greatest({a},1e-9)/greatest({b},1e-9))"


block("ereg", f"""
SELECT * FROM (SELECT b.upc, b.store, b.block_id, b.weeks+p.weeks AS weeks,
  {_log('b.avg_units', 'p.avg_units')}/{_log('b.price', 'p.price')} AS value
FROM esmooth b JOIN esmooth p ON p.upc=b.upc AND p.store=b.store AND p.block_id=b.block_id-1
WHERE b.promo_type='No_Promo' AND p.promo_type='No_Promo' AND abs(b.price-p.price)>1e-9
  AND abs({_log('b.price', 'p.price')})>1e-9) WHERE value<0""")
block("epromo", f"""
SELECT * FROM (SELECT b.upc, b.store, b.block_id, r.block_id AS ref_block, b.weeks+r.weeks AS weeks,
  {_log('b.avg_units', 'r.avg_units')}/{_log('b.avg_price', 'r.price')} AS value
FROM esmooth b JOIN eref USING (upc, store, block_id)
JOIN esmooth r ON r.upc=b.upc AND r.store=b.store AND r.block_id=eref.ref_block
WHERE b.promo_type='Instore_Only' AND abs({_log('b.avg_price', 'r.price')})>1e-9) WHERE value<0""")
block("elastref", """
SELECT upc, store, ref_block, value AS e_ref FROM epromo
QUALIFY row_number() OVER (PARTITION BY upc, store, ref_block ORDER BY block_id DESC)=1""")
block("emult", """
SELECT * FROM (SELECT b.upc, b.store, b.block_id, 'M_' || lower(b.promo_type) AS metric, b.weeks+r.weeks AS weeks,
  e_ref, pow(greatest(b.avg_price,1e-9)/greatest(r.price,1e-9), e_ref) AS expected,
  greatest(b.avg_units,1e-9)/greatest(r.avg_units,1e-9) AS lift
FROM esmooth b JOIN eref USING (upc, store, block_id)
JOIN esmooth r ON r.upc=b.upc AND r.store=b.store AND r.block_id=eref.ref_block
JOIN elastref m ON m.upc=b.upc AND m.store=b.store AND m.ref_block=eref.ref_block
WHERE b.promo_type IN ('Instore_Flyer','Instore_CPP','Instore_Flyer_CPP'))
WHERE expected>1e-9 AND expected<'Infinity'::DOUBLE""")
block("emetrics", """
SELECT upc, store, block_id, 'E_regular' AS metric, value, weeks FROM ereg
UNION ALL SELECT upc, store, block_id, 'E_promo', value, weeks FROM epromo
UNION ALL SELECT upc, store, block_id, metric, greatest(1.0, lift/expected), weeks FROM emult""")
