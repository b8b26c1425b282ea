"""Checking SQL (DuckDB) for the registered queries, written apart from the Spark code.

Recency is worked out here over every calendar day of every customer, and p-values by the exact
series at any size, so that the faster ways the library takes are checked against the plain ones. `fsum` and `favg` stand
for sums and means that are exact down to 2**-56 and rounded once; `spelled_out` puts plain SQL in their place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from liftgauge.catalog.setting import ARMS, METRICS
from liftgauge.params import Cohort, Periods

M = METRICS.all
BUCKETS = METRICS.buckets


def _closing(sql: str, at: int) -> int:
    """Where the bracket that opens at `at` closes."""
    depth = 0
    for place in range(at, len(sql)):
        depth += {"(": 1, ")": -1}.get(sql[place], 0)
        if not depth:
            return place
    raise ValueError(f"a bracket stays open: {sql[at:at + 40]}")


def spelled_out(sql: str) -> str:
    """Sums as whole multiples of 2**-56, put together from a high and a low half, each of which a double holds exactly."""
    while match := re.search(r"\bf(sum|avg)\(", sql):
        end = _closing(sql, match.end() - 1)
        value, after = sql[match.end():end], re.match(r" (FILTER|OVER) \(", sql[end + 1:])
        last = _closing(sql, end + after.end()) if after else end
        clause = sql[end + 1:last + 1]
        total = f"sum(CAST(round_even(({value}) * 72057594037927936e0, 0) AS HUGEINT)){clause}"
        out = f"(CAST({total} // 1099511627776 AS DOUBLE) / 65536e0 + CAST({total} % 1099511627776 AS DOUBLE) / 72057594037927936e0)"
        if match.group(1) == "avg":
            out = f"({out} / nullif(count({value}){clause}, 0))"
        sql = sql[:match.start()] + out + sql[last + 1:]
    return sql


def q(name: str) -> str:
    return f'"{name}"'


def day(value) -> str:
    return f"DATE '{value.isoformat()}'"


def within(column: str, window) -> str:
    return f"{column} BETWEEN {day(window.start)} AND {day(window.end)}"


def period_case(column: str, pre, post) -> str:
    return f"CASE WHEN {within(column, pre)} THEN 'Pre' WHEN {within(column, post)} THEN 'Post' ELSE 'Out' END"


SALES = """sales AS (
  SELECT o_custkey AS CustomerID, o_orderkey AS Transaction_ID, CAST(o_orderdate AS DATE) AS Transaction_Date,
         p_type AS Product_Category, l_quantity AS Quantity, l_extendedprice / l_quantity AS Avg_Price,
         CASE WHEN l_discount >= 0.09 THEN 'Used' ELSE 'Not Used' END AS Coupon_Status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

INITIATIVES = """inits AS (
  SELECT c_custkey AS CustomerID, 'BuyOneGetOne' AS Initiative FROM customer WHERE c_mktsegment = 'BUILDING')"""


def enriched() -> str:
    kept = ", ".join(f"'{b}'" for b in METRICS.kept)
    return f"""enriched AS (
  SELECT *, Quantity * Avg_Price AS Sales, year(Transaction_Date) AS Year, month(Transaction_Date) AS Month,
         CASE WHEN Coupon_Status = 'Used' THEN 1 ELSE 0 END AS Coupons,
         CASE WHEN Product_Category IN ({kept}) THEN Product_Category ELSE 'Other' END AS Product_Category_Grouped
  FROM sales)"""


def pivot() -> str:
    cells = []
    for b in BUCKETS:
        here = f"FILTER (WHERE Product_Category_Grouped = '{b}')"
        cells += [
            f"coalesce(fsum(Quantity) {here}, 0e0) AS {q('Quantity_' + b)}",
            f"coalesce(favg(Avg_Price) {here}, 0e0) AS {q('Avg_Price_' + b)}",
            f"coalesce(fsum(Sales) {here}, 0e0) AS {q('Sales_' + b)}",
            f"coalesce(sum(Coupons) {here}, 0)::DOUBLE AS {q('Coupons_' + b)}",
        ]
    totals = ", ".join(
        " + ".join(q(f"{m}_{b}") for b in BUCKETS) + f" AS {m}_All" for m in ("Quantity", "Sales", "Coupons")
    )
    return f"""cells AS (
  SELECT CustomerID, Transaction_ID, Transaction_Date, Month, Year, {', '.join(cells)}
  FROM enriched GROUP BY ALL),
pivot_all AS (SELECT *, {totals} FROM cells),
pivoted AS (SELECT *, Sales_All / nullif(Quantity_All, 0) AS Price_All FROM pivot_all)"""


def daily() -> str:
    sums = ", ".join(f"fsum({q(m)}) AS {q(m)}" for m in METRICS.additive if m != "Transactions")
    return f"""daily AS MATERIALIZED (
  SELECT CustomerID, Transaction_Date, Month, Year, count(DISTINCT Transaction_ID) AS Transactions,
         favg(Price_All) AS Price_All, {sums}
  FROM pivoted GROUP BY CustomerID, Transaction_Date, Month, Year)"""


FACTS = ",\n".join([SALES, INITIATIVES, enriched(), pivot(), daily()])


def labels(p: Periods, tag: str = "") -> str:
    """dated, coupon_use and labelled; `tag` keeps two sets of periods apart."""
    return f"""dated{tag} AS (
  SELECT *, {period_case('Transaction_Date', p.pre, p.post)} AS Period FROM daily),
coupon_use{tag} AS (
  SELECT CustomerID,
         coalesce(sum(Coupons_All) FILTER (WHERE Period = 'Pre'), 0) AS Pre_Coupons_All,
         coalesce(sum(Coupons_All) FILTER (WHERE Period = 'Post'), 0) AS Post_Coupons_All,
         coalesce(sum(Coupons_All) FILTER (WHERE Period = 'Out'), 0) AS Out_Coupons_All
  FROM dated{tag} GROUP BY CustomerID),
segments{tag} AS (
  SELECT CustomerID, CASE WHEN Pre_Coupons_All <> 0 AND Post_Coupons_All <> 0 THEN 'Promo'
                          WHEN Pre_Coupons_All <> 0 THEN 'PromoPre'
                          WHEN Post_Coupons_All <> 0 THEN 'PromoPost' ELSE 'NoPromo' END AS Promo_Segment
  FROM coupon_use{tag}),
labelled{tag} AS MATERIALIZED (
  SELECT d.*, s.Promo_Segment, coalesce(i.Initiative, 'NoInitiative') AS Initiative
  FROM dated{tag} d JOIN segments{tag} s USING (CustomerID) LEFT JOIN inits i USING (CustomerID))"""


def features(p: Periods, tag: str = "") -> str:
    means = ", ".join(f"favg({q(m)}) AS {q(m)}" for m in M)
    return f"""post_recency{tag} AS (
  SELECT CustomerID, date_diff('day', max(Transaction_Date), {day(p.post_end)}) AS Recency
  FROM labelled{tag} WHERE {within('Transaction_Date', p.lookback)} GROUP BY CustomerID),
pre_players{tag} AS (
  SELECT 'Pre' AS Period, CustomerID, any_value(Promo_Segment) AS Promo_Segment,
         any_value(Initiative) AS Initiative, {means}, count(*) / {p.pre.days}::DOUBLE AS "Frequency%",
         date_diff('day', max(Transaction_Date), {day(p.pre_end)}) AS Recency
  FROM labelled{tag} WHERE Period = 'Pre' GROUP BY CustomerID),
post_players{tag} AS (
  SELECT 'Post' AS Period, CustomerID, any_value(Promo_Segment) AS Promo_Segment,
         any_value(Initiative) AS Initiative, {means}, count(*) / {p.post.days}::DOUBLE AS "Frequency%"
  FROM labelled{tag} WHERE Period = 'Post' GROUP BY CustomerID),
players{tag} AS MATERIALIZED (
  SELECT * FROM pre_players{tag} UNION ALL BY NAME
  SELECT x.*, r.Recency FROM post_players{tag} x JOIN post_recency{tag} r USING (CustomerID))"""


def arms(chosen: Mapping[str, Cohort] = ARMS) -> str:
    rows = ", ".join(f"('{arm}', '{c.promo}', '{c.initiative}')" for arm, c in chosen.items())
    return f"arms AS (SELECT * FROM (VALUES {rows}) AS v(arm, promo, initiative))"


IN_ARM = "(promo = 'All' OR promo = Promo_Segment) AND (arms.initiative = 'All' OR arms.initiative = t.Initiative)"


def days(p: Periods) -> str:
    """armed, calendar, recency and the day table, over `arms`."""
    means = ", ".join(f"favg({q(m)}) AS {q(m)}" for m in M)
    totals = ", ".join(f"fsum({m}) AS {m}_day" for m in METRICS.day_totals)
    pre, post = p.recency
    return f"""armed AS MATERIALIZED (
  SELECT arm, t.* FROM labelled t JOIN arms ON {IN_ARM}),
{calendar('armed', ['arm'], p)},
day_recency AS (
  SELECT arm, Period, Transaction_Date, avg(-date_diff('day', last_seen, Transaction_Date)) AS Recency
  FROM calendar GROUP BY ALL),
day_base AS (
  SELECT arm, Period, Transaction_Date, {means}, count(*) AS ActiveCustomer, {totals}
  FROM armed WHERE Period <> 'Out' GROUP BY ALL),
days AS MATERIALIZED (
  SELECT b.*, b.ActiveCustomer / sum(b.ActiveCustomer) OVER (PARTITION BY arm, Period) AS "ActiveCustomer%", r.Recency
  FROM day_base b LEFT JOIN day_recency r USING (arm, Period, Transaction_Date))"""


def calendar(source: str, keys: list[str], p: Periods) -> str:
    pre, post = p.recency
    ks = "".join(f"{k}, " for k in keys)
    join = ", ".join([*keys, "Period", "CustomerID"])
    return f"""active AS (
  SELECT {ks}CustomerID, Transaction_Date, {period_case('Transaction_Date', pre, post)} AS Period FROM {source}),
seen AS (SELECT * FROM active WHERE Period <> 'Out'),
spans AS (
  SELECT {ks}Period, CustomerID, min(Transaction_Date) AS first_date FROM seen GROUP BY ALL),
all_days AS (
  SELECT {ks}Period, CustomerID,
         unnest(generate_series(first_date, CASE WHEN Period = 'Pre' THEN {day(pre.end)} ELSE {day(post.end)} END,
                                INTERVAL 1 DAY))::DATE AS Transaction_Date
  FROM spans),
calendar AS (
  SELECT a.*, last_value(s.Transaction_Date IGNORE NULLS) OVER (
           PARTITION BY {', '.join('a.' + k for k in [*keys, 'Period', 'CustomerID'])} ORDER BY a.Transaction_Date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_seen
  FROM all_days a LEFT JOIN seen s USING ({join}, Transaction_Date))"""


def series(df: str, t: str) -> str:
    """Two-sided p by the finite cosine series, at any number of degrees of freedom."""
    cos2 = f"({df} / ({df} + {t} * {t}))"
    sin = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    theta = f"atan(abs({t}) / sqrt({df}))"

    def total(last, ratio):
        entry = f"{{'r': ({ratio}) * {cos2}, 't': 1e0, 's': 1e0}}"
        items = f"list_transform(range(1, greatest({last}, 0) + 1), lambda k: {entry})"
        step = "lambda a, e: {'r': 0e0, 't': a.t * e.r, 's': a.s + a.t * e.r}"
        return f"list_reduce({items}, {step}, {{'r': 0e0, 't': 1e0, 's': 1e0}}).s"

    odd = total(f"(({df} - 3) // 2)", "2e0 * k / (2 * k + 1)")
    even = total(f"({df} // 2 - 1)", "(2e0 * k - 1) / (2 * k)")
    return f"""CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN isinf({t}) THEN 0e0
      WHEN {df} = 1 THEN 1 - 2 * {theta} / pi()
      WHEN {df} % 2 = 1 THEN 1 - 2 / pi() * ({theta} + {sin} * sqrt({cos2}) * {odd})
      ELSE 1 - {sin} * {even} END"""


def tests(source: str, keys: list[str], weight: str, plain: list[str], totals: Mapping[str, str], order: list[str],
          change: str, out: str) -> str:
    """Test table `out` of `source`: one branch per metric."""
    ks = ", ".join(keys)
    w = q(weight)
    branches = []
    for position, m in enumerate(order):
        x = q(m)
        if m in totals:
            value, spread, known = f"coalesce(fsum({totals[m]}), 0)", "NULL", "count(*)"
        elif m in plain:
            value, spread, known = f"favg({x})", f"stddev_samp({x})", f"count({x})"
        else:
            value = f"fsum({x} * {w}) / nullif(fsum({w}), 0)"
            spread = f"sqrt(sum({w} * ({x} - c.centre) * ({x} - c.centre)) / nullif(sum({w}), 0))"
            known = f"count({x})"
        centre = f"""(SELECT {ks}, Period, fsum({x} * {w}) / nullif(fsum({w}), 0) AS centre
                      FROM {source} GROUP BY ALL)""" if m not in plain and m not in totals else None
        joined = f"{source} s JOIN {centre} c USING ({ks}, Period)" if centre else f"{source} s"
        branches.append(f"""SELECT {ks}, Period, {position} AS position, '{m}' AS Metrics, {value} AS v,
               {spread} AS spread, count(*) AS n, {known} AS known, {str(m in totals).lower()} AS total
        FROM {joined} GROUP BY {ks}, Period""")
    pairs = f"""SELECT {ks}, position, Metrics, total,
         max(v) FILTER (WHERE Period = 'Pre') AS v_pre, max(v) FILTER (WHERE Period = 'Post') AS v_post,
         max(spread) FILTER (WHERE Period = 'Post') AS spread,
         coalesce(max(n) FILTER (WHERE Period = 'Post'), 0) AS n,
         coalesce(max(known) FILTER (WHERE Period = 'Post'), 0) AS known
       FROM ({' UNION ALL '.join(branches)}) GROUP BY ALL"""
    change_sql = {
        "relative": "(Post / nullif(Pre, 0) - 1) * 100",
        "signed": "(Post - Pre) / nullif(abs(Pre), 0) * 100",
    }[change]
    return f"""{out}_pairs AS (
  SELECT {ks}, position, Metrics, total, n, known, spread,
         CASE WHEN total THEN coalesce(v_pre, 0) ELSE v_pre END AS Pre,
         CASE WHEN total THEN coalesce(v_post, 0) ELSE v_post END AS Post FROM ({pairs})),
{out}_t AS (
  SELECT *, Post - Pre AS Var,
         CASE WHEN Pre = 0 OR Post = 0 THEN 'NA' ELSE format('{{:.2f}}%', {change_sql}) END AS "Var%",
         CASE WHEN total OR known < n OR n < 2 THEN NULL
              WHEN spread <= 1e-12 * abs(Post) THEN CASE WHEN Post - Pre > 1e-12 * abs(Post) THEN 'inf'::DOUBLE
                                                         WHEN Post - Pre < -1e-12 * abs(Post) THEN '-inf'::DOUBLE END
              ELSE (Post - Pre) / (spread / sqrt(n)) END AS t_stat,
         CASE WHEN NOT total THEN n - 1 END AS df FROM {out}_pairs),
{out}_p AS (SELECT *, {series('df', 't_stat')} AS p_value FROM {out}_t),
{out} AS MATERIALIZED (
  SELECT *, CASE WHEN total THEN 'NA' WHEN p_value < 0.05 THEN 'Yes' ELSE 'No' END AS Sign FROM {out}_p)"""


def customer_tests(source: str = "armed_players", keys: list[str] | None = None, out: str = "customer_tests") -> str:
    plain = ["Frequency%", "Recency"]
    return tests(source, keys or ["arm"], "Frequency%", plain, {"Customers_Period": "1"},
                 [*M, *plain, "Customers_Period"], "relative", out)


def day_tests(source: str = "days", keys: list[str] | None = None, out: str = "day_tests") -> str:
    totals = {"DaysCount_Period": "1"} | {f"{m}_Period": f"{m}_day" for m in METRICS.day_totals}
    plain = ["ActiveCustomer", "Recency"]
    return tests(source, keys or ["arm"], "ActiveCustomer%", plain, totals, [*totals, *M, *plain], "signed", out)


ARMED_PLAYERS = f"armed_players AS MATERIALIZED (SELECT arm, t.* FROM players t JOIN arms ON {IN_ARM})"


def result(keys: list[str] | None = None, day_table: str = "day_tests", people: str = "customer_tests",
           out: str = "result") -> str:
    ks = ", ".join(keys or ["arm"])
    order = ", ".join(f"'{m}'" for m in METRICS.report_order)
    place = f"coalesce(nullif(list_position([{order}], Metrics), 0), {len(METRICS.report_order) + 1})"
    columns = f'{ks}, Metrics, Pre, Post, Var, "Var%", Sign'
    return f"""{out} AS MATERIALIZED (
  SELECT {place} AS metric_order, * FROM (
    SELECT {columns} FROM {day_table} UNION ALL
    SELECT {columns} FROM {people} WHERE Metrics IN ('Frequency%', 'Customers_Period')))"""


def real(source: str = "result", out: str = "real_result") -> str:
    lift = "(t.Post / nullif(t.Pre, 0) - 1) - (c.Post / nullif(c.Pre, 0) - 1)"
    return f"""paired AS (
  SELECT t.*, {lift} AS lift, (c.Pre = 0 OR c.Post = 0) AS as_test
  FROM {source} t JOIN {source} c ON t.Metrics = c.Metrics AND t.arm = 'test' AND c.arm = 'control'),
{out} AS (
  SELECT metric_order, Metrics, Pre, CASE WHEN as_test THEN Post ELSE Pre + Pre * lift END AS Post,
         CASE WHEN as_test THEN Var ELSE Pre * lift END AS Var,
         CASE WHEN as_test THEN "Var%" ELSE format('{{:.2f}}%', lift * 100) END AS "Var%", Sign FROM paired)"""


def shares(source: str = "result", keys: str = "arm, ", out: str = "shares") -> str:
    def one(x):
        plain = f"round_even({x} / nullif(total, 0) * 100 * 100, 0) / 100"
        signed = f"100 + round_even({x} / nullif(abs(total), 0) * 100 * 100, 0) / 100"
        return f"""coalesce(CASE WHEN total = 0 AND {x} <> 0 THEN 100e0
                                 WHEN Metrics = 'Recency' THEN {signed} ELSE {plain} END, 0) AS {x}"""

    return f"""with_total AS (
  SELECT *, coalesce(Pre, 0) + coalesce(Post, 0) AS total FROM {source} WHERE Metrics <> 'DaysCount_Period'),
{out} AS (SELECT {keys}metric_order, Metrics, {one('Pre')}, {one('Post')} FROM with_total)"""


def formatted(source: str = "result", keys: str = "arm, ", out: str = "formatted") -> str:
    money = ", ".join(f"'{m}'" for m in METRICS.currency)

    def one(x):
        return f"""CASE WHEN Metrics IN ({money}) THEN '$' || format('{{:,.0f}}', {x})
             WHEN Metrics = 'Frequency%' THEN format('{{:.2f}}%', {x} * 100)
             ELSE format('{{:,.0f}}', {x}) END AS {x}"""

    return f"""{out} AS (
  SELECT {keys}metric_order, Metrics, {one('Pre')}, {one('Post')}, {one('Var')}, "Var%", Sign, Var AS Var2,
         CASE WHEN Sign = 'Yes' AND Var < 0 THEN 'decline' WHEN Sign = 'Yes' AND Var > 0 THEN 'gain' END AS direction
  FROM {source})"""


def proportions() -> str:
    compared = [*M, "ActiveCustomer"]
    means = ", ".join(f"favg({q(m)}) AS {q(m)}" for m in compared)
    ratio = ", ".join(f"coalesce(t.{q(m)} / nullif(c.{q(m)}, 0), 0) AS {q(m)}" for m in compared)
    return f"""last_pre AS (
  SELECT * FROM days WHERE Period = 'Pre'
  QUALIFY row_number() OVER (PARTITION BY arm ORDER BY Transaction_Date DESC) <= 35),
trailing_means AS (SELECT arm, {means} FROM last_pre GROUP BY arm),
proportions AS (
  SELECT {ratio} FROM trailing_means t JOIN trailing_means c ON t.arm = 'test' AND c.arm = 'control')"""


def synthetic_days() -> str:
    scaled = [*METRICS.additive, "ActiveCustomer"]
    scaling = ", ".join(f"d.{q(m)} * f.{q(m)} AS {q(m)}" for m in scaled)
    day_totals = ", ".join(f"{m} * ActiveCustomer AS {m}_day" for m in METRICS.day_totals)
    return f"""scaled AS (
  SELECT d.* REPLACE ({scaling}) FROM days d, proportions f WHERE arm = 'control' AND Period = 'Post'),
synthetic_days AS MATERIALIZED (
  SELECT * FROM days WHERE arm = 'test'
  UNION ALL BY NAME SELECT * REPLACE ('control' AS arm) FROM days WHERE arm = 'test' AND Period = 'Pre'
  UNION ALL BY NAME SELECT * REPLACE ({day_totals}) FROM scaled)"""


def bootstrap(pool: str, key: str, fraction: str, out: str) -> str:
    """Draws by the same rule: number the pool by hash group and key, take number hash(i, 45) mod n."""
    return f"""{out}_numbered AS (
  SELECT *, row_number() OVER (ORDER BY substr(md5({key}::VARCHAR), 1, 3), {key}) - 1 AS row_number FROM {pool}),
{out}_size AS (
  SELECT (SELECT count(*) FROM {pool}) AS n,
         round_even((SELECT {fraction}) * (SELECT count(*) FROM {pool}), 0)::BIGINT AS draws),
{out}_draws AS (SELECT unnest(range(draws)) AS draw, n FROM {out}_size),
{out} AS MATERIALIZED (
  SELECT draw, p.* EXCLUDE (row_number)
  FROM {out}_draws d JOIN {out}_numbered p
    ON p.row_number = ('0x' || substr(md5(d.draw::VARCHAR || '|45'), 1, 15))::BIGINT % d.n)"""


def synthetic_customers(p: Periods) -> str:
    near = p.around_switch()
    fraction = """count(DISTINCT CustomerID) FILTER (WHERE Initiative = 'BuyOneGetOne')::DOUBLE
         / count(DISTINCT CustomerID) FILTER (WHERE Promo_Segment = 'NoPromo' AND Initiative = 'NoInitiative')
         FROM labelled_near WHERE Period = 'Pre'"""
    return f"""{labels(near, '_near')},
control_post AS (SELECT * FROM armed_players WHERE arm = 'control' AND Period = 'Post'),
{bootstrap('control_post', 'CustomerID', fraction, 'redrawn')},
synthetic_customers AS MATERIALIZED (
  SELECT * FROM armed_players WHERE arm = 'test'
  UNION ALL BY NAME SELECT * REPLACE ('control' AS arm) FROM armed_players WHERE arm = 'test' AND Period = 'Pre'
  UNION ALL BY NAME SELECT * EXCLUDE (draw) FROM redrawn)"""


def grid_arms() -> str:
    """Every cohort a user can choose, as arms."""
    return """arms AS (
  SELECT promo || '/' || initiative AS arm, promo, initiative
  FROM (SELECT DISTINCT Promo_Segment AS promo FROM labelled UNION ALL SELECT 'All'),
       (SELECT DISTINCT Initiative AS initiative FROM labelled UNION ALL SELECT 'All'))"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
