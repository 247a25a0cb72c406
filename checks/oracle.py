"""The same results in SQL for DuckDB, written independently of the Spark plans.

The nine tables are plain views over the star schema, money kept as DECIMAL.
Sums turn to DOUBLE once they are complete, as they do in the Spark plans;
rounding happens in DECIMAL, so that halves go up as they do in Spark.
"""

from __future__ import annotations

import re

from checks.registry import (
    CHECKED_DISTRICTS,
    DISTRICT_RENAMES,
    LEFT_OUT_REGION,
    PAIR,
    QUARTER,
    WHOLE_YEARS,
    YEAR,
    YEARS,
)
from paylens.plans.cases import CASES
from paylens import schemas


def _per_quarter(stamp: str) -> str:
    return f"CAST(year({stamp}) AS INTEGER) AS Year, CAST(quarter({stamp}) AS INTEGER) AS Quarter"


_ORDERS = """orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey"""
_LINES = """lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey"""
_PAID = "count(*) AS Transaction_count, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS Transaction_amount"
_INSURED = "count(*) AS Insurance_count, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS Insurance_amount"
_O, _L = _per_quarter("o_orderdate"), _per_quarter("l_shipdate")

VIEWS = {
    "agg_trans": f"""SELECT n_name AS State, {_O}, o_orderpriority AS Transaction_type, {_PAID}
        FROM {_ORDERS} GROUP BY ALL""",
    "map_trans": f"""SELECT n_name AS State, {_O}, c_mktsegment AS District_name, {_PAID}
        FROM {_ORDERS} GROUP BY ALL""",
    "top_trans": f"""SELECT n_name AS State, CAST(100000 + c_custkey AS VARCHAR) AS Pincode, {_O}, {_PAID}
        FROM {_ORDERS} GROUP BY ALL""",
    "agg_ins": f"""SELECT n_name AS State, {_L}, 'Insurance' AS Insurance_type, {_INSURED}
        FROM {_LINES} WHERE l_returnflag = 'R' GROUP BY ALL""",
    "map_ins": f"""SELECT n_name AS State, {_L}, p_brand AS District_name, {_INSURED}
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL""",
    "top_ins": f"""SELECT n_name AS State, CAST(100000 + s_suppkey AS VARCHAR) AS Pincode, {_L}, {_INSURED}
        FROM {_LINES} WHERE l_returnflag = 'R' GROUP BY ALL""",
    "agg_user": f"""SELECT *, CAST(User_count AS DOUBLE)
            / CAST(sum(User_count) OVER (PARTITION BY State, Year, Quarter) AS DOUBLE)
            AS Percentage_of_users
        FROM (SELECT n_name AS State, {_L}, p_brand AS Brand_name, count(*) AS User_count
            FROM {_LINES} JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "map_user": f"""SELECT n_name AS State, {_O}, c_mktsegment AS District_name,
            count(DISTINCT o_custkey) AS Registered_users, count(*) AS Number_of_app_opens
        FROM {_ORDERS} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
    "top_user": f"""SELECT n_name AS State, CAST(100000 + c_custkey AS VARCHAR) AS Pincode, {_O},
            count(DISTINCT o_orderkey) AS Registered_users
        FROM {_ORDERS} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""",
}

_MONEY = {"Transaction_amount", "Insurance_amount"}


def _query(body: str) -> str:
    """Put the views that ``body`` names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    tail = body.strip()
    if tail.startswith("WITH "):
        return f"WITH {views},\n{tail[5:]}"
    return f"WITH {views}\n{tail}"


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def _round(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def _pct(part: str, whole: str) -> str:
    return f"({_dbl(part)} * 100.0 / nullif({_dbl(whole)}, 0))"


def _change(now: str, before: str) -> str:
    return f"(({_dbl(now)} - {_dbl(before)}) * 100.0 / nullif({_dbl(before)}, 0))"


def _columns(name: str, **changed: str) -> str:
    picked = []
    for column in schemas.column_names(name):
        expr = changed.get(column, _dbl(column) if column in _MONEY else column)
        picked.append(expr if expr == column else f"{expr} AS {column}")
    return ", ".join(picked)


def _yearly(view: str, measure: str, name: str, where: str = "true") -> str:
    """Yearly sum per state with the sum of the previous year on record."""
    return f"""{name} AS (
        SELECT State, Year, now, lag(now) OVER w AS before,
            {_round(_change('now', 'lag(now) OVER w'), 2)} AS pct
        FROM (SELECT State, Year, sum({measure}) AS now FROM {view} WHERE {where} GROUP BY ALL)
        WINDOW w AS (PARTITION BY State ORDER BY Year))"""


_SINCE = YEARS.since
_LOW, _HIGH = YEARS.window
_FIRST, _LAST = YEARS.span
_SLICE = f"Year = {YEAR} AND Quarter = {QUARTER}"

ORACLES: dict[str, str] = {}

# Business questions.

ORACLES["yearly_growth_totals"] = _query(f"""
SELECT b.Year, {_big('b.n')} AS total_transactions, b.v AS transaction_amount,
    (b.n / CAST(a.n AS DOUBLE) - 1.0) * 100.0 AS total_transactions_growth_pct,
    (b.v / a.v - 1.0) * 100.0 AS transaction_amount_growth_pct
FROM (SELECT Year, sum(Transaction_count) AS n, {_dbl('sum(Transaction_amount)')} AS v
      FROM agg_trans GROUP BY Year) b
ASOF LEFT JOIN (SELECT Year, sum(Transaction_count) AS n, {_dbl('sum(Transaction_amount)')} AS v
      FROM agg_trans GROUP BY Year) a ON b.Year > a.Year
WHERE b.Year <> {YEARS.base}
ORDER BY b.Year""")

ORACLES["avg_yoy_growth_extremes"] = _query(f"""
WITH {_yearly('agg_trans', 'Transaction_count', 'yoy')},
seen AS (
    SELECT State FROM yoy WHERE pct IS NOT NULL
    QUALIFY least(row_number() OVER (PARTITION BY Year ORDER BY pct DESC, State),
                  row_number() OVER (PARTITION BY Year ORDER BY pct, State)) <= 3)
SELECT State, coalesce(avg_growth_pct, 0) AS avg_growth_pct FROM (
    SELECT State, {_dbl('sum(CAST(pct AS DECIMAL(18,2)))')} / count(pct) AS avg_growth_pct
    FROM yoy WHERE Year >= {_SINCE} AND State IN (SELECT State FROM seen) GROUP BY State)
ORDER BY avg_growth_pct DESC NULLS LAST, State LIMIT 5""")

ORACLES["declining_growth_trend"] = _query(f"""
WITH {_yearly('agg_trans', 'Transaction_count', 'yoy', f'Year BETWEEN {_LOW} AND {_HIGH}')},
weak AS (SELECT State FROM yoy WHERE Year = {YEARS.target} AND before IS NOT NULL
    ORDER BY pct NULLS FIRST, State LIMIT 5)
SELECT State, Year, pct AS growth_pct FROM yoy
WHERE before IS NOT NULL AND State IN (SELECT State FROM weak) ORDER BY State, Year""")

ORACLES["peak_quarter_spike"] = _query(f"""
WITH steps AS (
    SELECT Year, Quarter, n AS total, lag(n) OVER (ORDER BY Year, Quarter) AS previous
    FROM (SELECT Year, Quarter, {_big('sum(Transaction_count)')} AS n FROM agg_trans
          WHERE Year BETWEEN {_FIRST} AND {_LAST} GROUP BY ALL)),
spikes AS (SELECT *, {_change('total', 'previous')} AS spike FROM steps)
SELECT DISTINCT ON (Year) Year, Quarter AS quarter_with_max_spike, total, previous,
    {_round('spike', 2)} AS spike_pct
FROM spikes ORDER BY Year, spike DESC NULLS LAST, Quarter""")

ORACLES["avg_type_share"] = _query(f"""
WITH parts AS (SELECT Year, Transaction_type, {_dbl('sum(Transaction_amount)')} AS v
    FROM agg_trans GROUP BY ALL),
wholes AS (SELECT Year, {_dbl('sum(Transaction_amount)')} AS w FROM agg_trans GROUP BY ALL)
SELECT Transaction_type, {_round('avg(v * 100.0 / w)', 2)} AS average_share_pct
FROM parts NATURAL JOIN wholes GROUP BY Transaction_type ORDER BY Transaction_type""")

ORACLES["brand_top_bottom"] = _query(f"""
WITH sums AS (SELECT Brand_name, {_big('sum(User_count)')} AS total_users FROM agg_user GROUP BY ALL),
placed AS (SELECT *, (SELECT count(*) FROM sums o WHERE o.total_users > s.total_users) AS above,
    (SELECT count(*) FROM sums o WHERE o.total_users < s.total_users) AS below FROM sums s)
SELECT Brand_name, total_users, CASE WHEN above < 3 THEN 'top' ELSE 'bottom' END AS side
FROM placed WHERE above < 3 OR below < 3 ORDER BY total_users DESC, Brand_name""")

ORACLES["engagement_top_bottom"] = _query(f"""
WITH means AS (SELECT State,
    {_round('sum(Number_of_app_opens) / CAST(count(Number_of_app_opens) AS DOUBLE)', 2)} AS opens,
    {_round('sum(Registered_users) / CAST(count(Registered_users) AS DOUBLE)', 2)} AS users
    FROM map_user GROUP BY State),
rates AS (SELECT State, {_round('opens / nullif(users, 0)', 2)} AS engagement_rate FROM means)
SELECT * FROM (
    (SELECT State, engagement_rate, 'top' AS side FROM rates
     ORDER BY engagement_rate DESC NULLS LAST, State LIMIT 3)
    UNION ALL
    (SELECT State, engagement_rate, 'bottom' AS side FROM rates
     ORDER BY engagement_rate NULLS FIRST, State LIMIT 3))
ORDER BY engagement_rate DESC, State, side DESC""")

ORACLES["quarterly_engagement_extremes"] = _query(f"""
WITH rates AS (SELECT Year, Quarter, {_round(
    f"{_dbl('sum(Number_of_app_opens)')} / nullif({_dbl('sum(Registered_users)')}, 0)", 4
)} AS engagement_rate FROM map_user GROUP BY ALL)
SELECT Year, Quarter, engagement_rate FROM rates r
WHERE Year <> {YEARS.base} AND engagement_rate IN (
    (SELECT max(engagement_rate) FROM rates m WHERE m.Year = r.Year),
    (SELECT min(engagement_rate) FROM rates m WHERE m.Year = r.Year))
ORDER BY Year, engagement_rate, Quarter""")

ORACLES["insurance_yearly_growth"] = _query(f"""
WITH sums AS (SELECT Year, sum(Insurance_count) AS n, sum(Insurance_amount) AS v FROM agg_ins
    WHERE Year BETWEEN {_LOW} AND {_HIGH} GROUP BY Year)
SELECT Year, {_big('n')} AS insurance_count, {_dbl('v')} AS insurance_amount,
    {_round(_change('n', 'lag(n) OVER (ORDER BY Year)'), 2)} AS insurance_count_growth_pct,
    {_round(_change('v', 'lag(v) OVER (ORDER BY Year)'), 2)} AS insurance_amount_growth_pct
FROM sums
QUALIFY lag(n) OVER (ORDER BY Year) IS NOT NULL AND lag(v) OVER (ORDER BY Year) IS NOT NULL
ORDER BY Year""")

_RANGES = f"""WITH sums AS (
    SELECT State, Year, {_dbl('sum(Insurance_amount)')} AS v FROM agg_ins GROUP BY ALL),
ranges AS (SELECT State, (max(v) - min(v)) / 1e7 AS insurance_value_crore FROM sums GROUP BY State)"""

ORACLES["insurance_value_range"] = _query(f"""
{_RANGES}
SELECT * FROM ranges ORDER BY insurance_value_crore DESC NULLS LAST, State LIMIT 5""")

# A state without insurance counts as zero.
ORACLES["pct_difference_of_two"] = _query(f"""
{_RANGES},
pair AS (SELECT
    coalesce(sum(insurance_value_crore) FILTER (WHERE State = '{PAIR[0]}'), 0) AS a,
    coalesce(sum(insurance_value_crore) FILTER (WHERE State = '{PAIR[1]}'), 0) AS b FROM ranges)
SELECT (a - b) * 100.0 / nullif(b, 0) AS pct_difference FROM pair""")

ORACLES["insurance_penetration"] = _query(f"""
WITH paid AS (SELECT State, sum(Transaction_count) AS tn, sum(Transaction_amount) AS tv
    FROM agg_trans GROUP BY State),
insured AS (SELECT State, sum(Insurance_count) AS xn, sum(Insurance_amount) AS xv
    FROM agg_ins GROUP BY State)
SELECT paid.State, {_big('tn')} AS total_transactions, {_dbl('tv')} AS transaction_amount,
    {_big('xn')} AS total_insurances, {_dbl('xv')} AS insurance_amount,
    {_round(_pct('xn', 'tn'), 5)} AS penetration_rate, {_round(_pct('xv', 'tv'), 5)} AS value_share
FROM paid LEFT JOIN insured ON paid.State = insured.State
WHERE {_round(_pct('xn', 'tn'), 5)} IS NOT NULL
ORDER BY penetration_rate, paid.State LIMIT 5""")

def _consistent_growth(last: int | None) -> str:
    years = "true" if last is None else f"Year BETWEEN {YEARS.base} AND {last}"
    return _query(f"""
WITH {_yearly('map_user', 'Registered_users', 'users', years)},
{_yearly('agg_trans', 'Transaction_count', 'txns', years)},
means AS (
    SELECT u.State, {_dbl('sum(CAST(u.pct AS DECIMAL(18,2)))')} / count(u.pct) AS mu,
        {_dbl('sum(CAST(t.pct AS DECIMAL(18,2)))')} / count(t.pct) AS mt
    FROM users u JOIN txns t ON u.State = t.State AND u.Year = t.Year
    WHERE u.before IS NOT NULL AND t.before IS NOT NULL GROUP BY u.State)
SELECT State, {_round('mu', 2)} AS avg_user_growth_pct, {_round('mt', 2)} AS avg_txn_growth_pct
FROM means WHERE mu > 0 AND mt > 0 ORDER BY avg_txn_growth_pct DESC, State LIMIT 10""")


ORACLES["consistent_growth"] = _consistent_growth(None)
ORACLES["consistent_growth_of_whole_years"] = _consistent_growth(WHOLE_YEARS.until)

ORACLES["district_share_top_states"] = _query(f"""
WITH best AS (SELECT State, sum(Number_of_app_opens) AS whole FROM map_user GROUP BY State
    ORDER BY sum(Registered_users) DESC, State LIMIT 3)
SELECT State, District_name, {_big('sum(Number_of_app_opens)')} AS total_app_opens,
    {_round(f"{_dbl('sum(Number_of_app_opens)')} / {_dbl('any_value(whole)')} * 100.0", 2)}
        AS app_open_share_pct,
    CAST(row_number() OVER (PARTITION BY State ORDER BY sum(Registered_users) DESC, District_name)
        AS INTEGER) AS position
FROM map_user JOIN best USING (State) GROUP BY State, District_name
QUALIFY position <= 5 ORDER BY State, position""")

ORACLES["top_states_insurance"] = _query(f"""
SELECT State, {_dbl('sum(Insurance_amount)')} AS total_insurance_amount FROM top_ins
WHERE Year = {YEARS.target} GROUP BY State ORDER BY total_insurance_amount DESC, State LIMIT 3""")

ORACLES["peak_quarter_value"] = _query(f"""
WITH sums AS (SELECT Year, Quarter, {_dbl('sum(Insurance_amount)')} AS total_insurance_amount
    FROM top_ins GROUP BY ALL)
SELECT * FROM sums WHERE (Year, total_insurance_amount) IN
    (SELECT (Year, max(total_insurance_amount)) FROM sums GROUP BY Year) ORDER BY Year, Quarter""")

ORACLES["top_districts_insurance"] = _query(f"""
SELECT District_name, {_dbl('sum(Insurance_amount)')} AS total_insurance_amount FROM map_ins
WHERE Year = {YEARS.target} GROUP BY District_name
ORDER BY total_insurance_amount DESC, District_name LIMIT 5""")

ORACLES["pincode_growth"] = _query(f"""
WITH sums AS (SELECT Pincode, Year, sum(Insurance_count) AS n FROM top_ins GROUP BY ALL)
SELECT b.Pincode, {_big('b.n - a.n')} AS growth_from_prev_year
FROM sums a JOIN sums b ON a.Pincode = b.Pincode AND b.Year - 1 = a.Year
WHERE b.Year = {YEARS.target} ORDER BY growth_from_prev_year DESC, b.Pincode LIMIT 5""")

# Case reports as long rows: the columns that tell rows apart, and the floating ones. A
# report's SQL stands in brackets as a whole.
_REPORT_COLUMNS = {
    "yearly_growth_totals": "Year total_transactions : transaction_amount total_transactions_growth_pct transaction_amount_growth_pct",
    "avg_yoy_growth_extremes": "State : avg_growth_pct",
    "declining_growth_trend": "State Year : growth_pct",
    "peak_quarter_spike": "Year quarter_with_max_spike total previous : spike_pct",
    "avg_type_share": "Transaction_type : average_share_pct",
    "brand_top_bottom": "Brand_name total_users side :",
    "engagement_top_bottom": "State side : engagement_rate",
    "quarterly_engagement_extremes": "Year Quarter : engagement_rate",
    "insurance_yearly_growth": "Year insurance_count : insurance_amount insurance_count_growth_pct insurance_amount_growth_pct",
    "insurance_value_range": "State : insurance_value_crore",
    "insurance_penetration": "State total_transactions total_insurances : transaction_amount insurance_amount penetration_rate value_share",
    "consistent_growth": "State : avg_user_growth_pct avg_txn_growth_pct",
    "district_share_top_states": "State District_name total_app_opens position : app_open_share_pct",
    "top_states_insurance": "State : total_insurance_amount",
    "peak_quarter_value": "Year Quarter : total_insurance_amount",
    "top_districts_insurance": "District_name : total_insurance_amount",
    "pincode_growth": "Pincode growth_from_prev_year :",
}


def _long(report: str, columns: str, sql: str, **changed: str) -> str:
    keys, measures = (part.split() for part in columns.split(":"))
    row_key = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '-')" for k in keys)
    values = {m: changed.get(m, m) for m in measures} | {"row": "CAST(1.0 AS DOUBLE)"}
    return "\nUNION ALL\n".join(
        f"SELECT '{report}' AS report, concat_ws('|', {row_key}) AS row_key,"
        f" '{m}' AS measure, {value} AS value FROM ({sql}) AS r"
        for m, value in values.items()
    )


for _case, _reports in CASES.items():
    ORACLES[f"case_{_case}"] = "\nUNION ALL\n".join(
        _long(q, _REPORT_COLUMNS[q], ORACLES[q]) for q in _reports
    )

# Explorer.

ORACLES["distinct_years"] = _query("SELECT DISTINCT Year FROM map_trans ORDER BY Year")
ORACLES["distinct_quarters"] = _query("SELECT DISTINCT Quarter FROM map_trans ORDER BY Quarter")


def _kpi(view: str, count: str, amount: str, crore: str) -> str:
    return _query(f"""
WITH s AS (SELECT coalesce({_big(f'sum({count})')}, 0) AS total_count,
    coalesce({_dbl(f'sum({amount})')}, 0) AS total_amount FROM {view} WHERE {_SLICE})
SELECT total_count, total_amount,
    CASE WHEN total_count = 0 THEN 0.0::DOUBLE ELSE total_amount / total_count END AS average_value,
    {_big(f'{crore}(total_amount / 1e7)')} AS amount_crore FROM s""")


ORACLES["kpi_transactions"] = _kpi("map_trans", "Transaction_count", "Transaction_amount", "trunc")
ORACLES["kpi_insurance"] = _kpi("map_ins", "Insurance_count", "Insurance_amount", "round")
ORACLES["kpi_users"] = _query(f"""
SELECT {_big('sum(Registered_users)')} AS registered_users,
    {_big('sum(Number_of_app_opens)')} AS app_opens FROM map_user WHERE {_SLICE}""")


def _ranked(view: str, keys: str, value: str, limit: str) -> str:
    order = ", ".join(keys.split(", "))
    return _query(f"""
SELECT {keys}, {_big(f'round(sum({value}), 0)')} AS total_value FROM {view} WHERE {_SLICE}
GROUP BY ALL ORDER BY sum({value}) DESC, {order} {limit}""")


ORACLES["payment_categories"] = _ranked("agg_trans", "Transaction_type", "Transaction_amount", "")
ORACLES["top10_districts"] = _ranked("map_trans", "District_name", "Transaction_amount", "LIMIT 10")
ORACLES["top10_districts_insurance"] = _ranked(
    "map_ins", "District_name", "Insurance_amount", "LIMIT 10"
)
ORACLES["top10_districts_users"] = _ranked(
    "map_user", "District_name", "Registered_users", "LIMIT 10"
)
ORACLES["top10_districts_by_state"] = _ranked(
    "map_trans", "State, District_name", "Transaction_amount", "LIMIT 10"
)
ORACLES["top10_pincodes"] = _ranked("top_trans", "Pincode", "Transaction_amount", "LIMIT 10")
ORACLES["top10_pincodes_insurance"] = _ranked("top_ins", "Pincode", "Insurance_amount", "LIMIT 10")


def _metrics(view: str, amount: str, count: str) -> str:
    return _query(f"""
SELECT State, {_dbl(f'sum({amount})')} AS {amount}, {_big(f'sum({count})')} AS {count},
    {_round(f'avg({_dbl(amount)} / nullif({count}, 0)) + 1e-7', 4)} AS average_value
FROM {view} WHERE {_SLICE} GROUP BY State ORDER BY State""")


def _bounds(view: str, value: str) -> str:
    return _query(f"""
WITH s AS (SELECT State, {_dbl(f'sum({value})')} AS v FROM {view} WHERE {_SLICE} GROUP BY State)
SELECT {_round('quantile_cont(v, 0.05)', 4)} AS vmin, {_round('quantile_cont(v, 0.95)', 4)} AS vmax
FROM s""")


_USER_METRICS = f"""SELECT State, {_big('sum(Registered_users)')} AS Registered_users,
    {_big('sum(Number_of_app_opens)')} AS Number_of_app_opens
FROM map_user WHERE {_SLICE} GROUP BY State"""

ORACLES["state_metrics_trans"] = _metrics("map_trans", "Transaction_amount", "Transaction_count")
ORACLES["state_metrics_ins"] = _metrics("map_ins", "Insurance_amount", "Insurance_count")
ORACLES["state_metrics_users"] = _query(f"{_USER_METRICS} ORDER BY State")
ORACLES["color_bounds_trans"] = _bounds("map_trans", "Transaction_amount")
ORACLES["color_bounds_ins"] = _bounds("map_ins", "Insurance_amount")
ORACLES["color_bounds_users"] = _bounds("map_user", "Registered_users")



def _key_totals(view: str, key: str) -> str:
    return f"SELECT {key}, {_dbl('sum(Transaction_amount)')} AS v FROM {view} GROUP BY {key}"


def _value_bounds(view: str, key: str) -> str:
    return _query(f"""
WITH t AS ({_key_totals(view, key)}),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM t),
p AS (SELECT share, ((SELECT count(*) FROM t) - 1) * share AS pos
    FROM (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) s(share))
SELECT share, CASE WHEN a.v = b.v THEN a.v ELSE (ceil(pos) - pos) * a.v + (pos - floor(pos)) * b.v END AS value
FROM p JOIN o a ON a.i = floor(pos) JOIN o b ON b.i = ceil(pos)""")


def _places(view: str, key: str) -> str:
    return _query(f"""
WITH t AS ({_key_totals(view, key)})
SELECT {key}, v AS total_value, lag(v) OVER (ORDER BY v DESC, {key}) AS value_before,
    {_big('rank() OVER (ORDER BY v DESC)')} AS place FROM t""")


for _by, _view, _key in (("districts", "map_trans", "District_name"), ("pincodes", "top_trans", "Pincode")):
    ORACLES[f"value_bounds_{_by}"] = _value_bounds(_view, _key)
    ORACLES[f"places_of_{_by}"] = _places(_view, _key)
ORACLES["bucketed_pincode_growth"] = ORACLES["pincode_growth"]

_FEATURES = f"""features AS (
    SELECT n_name AS State FROM nation WHERE n_regionkey <> {LEFT_OUT_REGION}
    UNION SELECT r_name FROM region)"""

ORACLES["geo_coverage"] = _query(f"""
WITH m AS ({_USER_METRICS}), {_FEATURES}
SELECT *, State IN (SELECT State FROM features) AS has_feature FROM m ORDER BY State""")
ORACLES["geo_unmatched"] = _query(f"""
WITH m AS ({_USER_METRICS}), {_FEATURES}
SELECT State, 'features' AS missing_in FROM m WHERE State NOT IN (SELECT State FROM features)
UNION ALL
SELECT State, 'metrics' FROM features WHERE State NOT IN (SELECT State FROM m)""")

# The explorer's first view: the last year and the first quarter on record.
_FIRST_VIEW = "Year = 2001 AND Quarter = 1"


def _explored(reports: dict[str, tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        _long(r, columns, ORACLES[name].replace(_SLICE, _FIRST_VIEW), average_value=_round("average_value + 1e-7", 4))
        for r, (name, columns) in reports.items()
    )


_KPI_COLUMNS = "total_count amount_crore : total_amount average_value"
ORACLES["explore_transactions"] = _explored({
    "kpis": ("kpi_transactions", _KPI_COLUMNS),
    "payment_categories": ("payment_categories", "Transaction_type total_value :"),
    "state_metrics": ("state_metrics_trans", "State Transaction_count : Transaction_amount average_value"),
    "top_districts": ("top10_districts", "District_name total_value :"),
    "top_pincodes": ("top10_pincodes", "Pincode total_value :"),
})
ORACLES["explore_insurance"] = _explored({
    "kpis": ("kpi_insurance", _KPI_COLUMNS),
    "state_metrics": ("state_metrics_ins", "State Insurance_count : Insurance_amount average_value"),
    "top_districts": ("top10_districts_insurance", "District_name total_value :"),
    "top_pincodes": ("top10_pincodes_insurance", "Pincode total_value :"),
})
ORACLES["explore_users"] = _explored({
    "kpis": ("kpi_users", "registered_users app_opens :"),
    "state_metrics": ("state_metrics_users", "State Registered_users Number_of_app_opens :"),
    "top_districts": ("top10_districts_users", "District_name total_value :"),
})

# Ingestion and cleaning: documents derived from the tables come back as the tables.


def _slug(column: str) -> str:
    return f"lower(translate({column}, '_ ', '--'))"


def _title(expr: str) -> str:
    words = f"string_split_regex(replace({expr}, '-', ' '), '\\s+')"
    return (
        f"array_to_string(list_transform(list_filter({words}, lambda w: w <> ''), "
        "lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )


_RAW = {
    "State": _slug("State"),
    "Transaction_type": _slug("Transaction_type"),
    "Insurance_type": _slug("Insurance_type"),
    "District_name": "lower(District_name)",
}
_CLEAN = {
    **_RAW,
    "State": _title(_slug("State")),
    "Transaction_type": _title(_slug("Transaction_type")),
    "District_name": _title("lower(District_name)"),
}
_SILENT = "SELECT DISTINCT State, Year, Quarter FROM agg_trans EXCEPT SELECT State, Year, Quarter FROM agg_ins"


def _reported(name: str, changes: dict[str, str]) -> str:
    if name != "map_ins":
        return _query(f"SELECT {_columns(name, **changes)} FROM {name}")
    known = {
        **changes,
        "Insurance_count": "CASE WHEN Insurance_count > 1 THEN Insurance_count END",
        "Insurance_amount": f"CASE WHEN Insurance_count > 1 THEN {_dbl('Insurance_amount')} END",
    }
    return _query(f"""
SELECT {_columns(name, **known)} FROM map_ins
UNION ALL
SELECT {changes['State']}, Year, Quarter, NULL, NULL, NULL FROM ({_SILENT})""")


for _name in schemas.TABLES:
    ORACLES[f"read_{_name}"] = _reported(_name, _RAW)
    ORACLES[f"clean_{_name}"] = _reported(_name, _CLEAN)

ORACLES["read_csv_table"] = _query(f"SELECT {_columns('agg_ins')} FROM agg_ins")
ORACLES["read_parquet_table"] = _query(f"SELECT {_columns('map_ins')} FROM map_ins")
ORACLES["read_table"] = _query(f"SELECT {_columns('map_trans')} FROM map_trans")
ORACLES["read_slice"] = _query(f"SELECT {_columns('map_trans')} FROM map_trans WHERE {_SLICE}")

_DIMENSIONS = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(schemas.column_names(t))} AS column_count FROM {t}"
    for t in schemas.TABLES
)
ORACLES["table_dimensions"] = _query(_DIMENSIONS)


def _summed_up(table: str) -> str:
    columns, keys = schemas.column_names(table), schemas.natural_key(table)
    measures = [f.name for f in schemas.TABLES[table].fields if f.name not in keys]
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns if c in keys)
    check = f"sum(CAST(('0x' || substr(md5(concat_ws('|', {texts})), 1, 8)) AS BIGINT))"
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS row_count, '{m}' AS measure,"
        f" CAST(round(sum(CAST({m} AS DOUBLE)), 2) AS DOUBLE) AS total, {_big(check)} AS keys FROM {table}"
        for m in measures
    )


ORACLES["stored_tables"] = _query("\nUNION ALL ".join(map(_summed_up, schemas.TABLES)))
ORACLES["exported_tables"] = ORACLES["stored_tables"]
ORACLES["catalog_tables"] = ORACLES["stored_tables"]
ORACLES["loaded_dimensions"] = ORACLES["table_dimensions"]
ORACLES["loaded_null_profile"] = _query("\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_big(f'(SELECT count(*) FROM {t} WHERE {c} IS NULL)')} AS null_count"
    for t in schemas.TABLES for c in schemas.column_names(t)
))
for _name in ("agg_trans", "agg_user", "map_ins", "map_user"):
    ORACLES[f"document_files_{_name}"] = ORACLES[f"read_{_name}"]


def _nulls(table: str, column: str) -> str:
    if table != "map_ins":
        counted = f"(SELECT count(*) FROM {table} WHERE {column} IS NULL)"
    elif column in ("State", "Year", "Quarter"):
        counted = "0"
    else:
        counted = f"(SELECT count(*) FROM ({_SILENT}))"
        if column != "District_name":
            counted += " + (SELECT count(*) FROM map_ins WHERE Insurance_count = 1)"
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, {_big(counted)} AS null_count"


ORACLES["null_profile"] = _query(
    "\nUNION ALL ".join(_nulls(t, c) for t in schemas.TABLES for c in schemas.column_names(t))
)

_RENAMED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DISTRICT_RENAMES.items())
ORACLES["standardise_districts"] = _query(
    "SELECT "
    + _columns("map_trans", District_name=f"CASE District_name {_RENAMED} ELSE District_name END")
    + " FROM map_trans"
)
ORACLES["standardise_from_table"] = _query(
    f"SELECT {_columns('agg_trans', State='r_name')} FROM agg_trans"
    " JOIN nation ON n_name = State JOIN region ON n_regionkey = r_regionkey"
)
ORACLES["membership_check"] = _query(
    f"SELECT {_columns('map_trans')} FROM map_trans WHERE District_name IN {CHECKED_DISTRICTS!r}"
)
ORACLES["preview"] = _query(
    f"SELECT {_columns('map_trans')} FROM map_trans"
    f" ORDER BY {', '.join(schemas.natural_key('map_trans'))} LIMIT 5"
)
ORACLES["brands_in_any_case"] = ORACLES["brand_top_bottom"].replace(
    "SELECT Brand_name, total_users, CASE", "SELECT lower(Brand_name) AS Brand_name, total_users, CASE"
)
ORACLES["canonical_pincodes"] = _query(f"SELECT {_columns('top_trans')} FROM top_trans")
# The draw is by a digest of seed and key, which both engines have.
_DRAWN = ", ".join(f"CAST({c} AS VARCHAR)" for c in schemas.natural_key("map_trans"))
ORACLES["random_preview"] = _query(
    f"SELECT {_columns('map_trans')} FROM map_trans"
    f" ORDER BY md5(concat_ws('|', '7', {_DRAWN})), {', '.join(schemas.natural_key('map_trans'))} LIMIT 5"
)
