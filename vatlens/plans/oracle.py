"""DuckDB SQL equivalents of the driver queries in ``vatlens.plans.registry``.

Each string runs on the pre-registered views (one per test table) and
returns the same column names; doubles are rounded to 6 places like ``_r6``.
"""

from __future__ import annotations

import math

EV = ("SELECT event_id, ts, user_id, event_type, value, "
      "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
EVN = ("SELECT event_id, ts, user_id, event_type, "
       "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, "
       f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE k END AS k FROM ({EV})")
COMPLETE = ("event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND "
            "event_type IS NOT NULL AND value IS NOT NULL AND k IS NOT NULL "
            "AND NOT isnan(value) AND NOT isnan(k)")
LI = ("SELECT l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, "
      "l_tax + 0.0 AS l_tax FROM lineitem")
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SECS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000"


def R(x: str) -> str:
    """Round to 6 places with explicit IEEE steps (same as ``registry.r6``)."""
    return (f"(CASE WHEN abs({x}) < 1e12 THEN floor(({x}) * 1e6 + 0.5) / 1e6 "
            f"ELSE ({x}) END + 0.0)")


SQL: dict[str, str] = {}

SQL["clean_dropna"] = f"""
SELECT event_id, user_id, event_type, {R('value')} AS value, {R('k')} AS k
FROM ({EVN}) e WHERE {COMPLETE}"""

SQL["align_schema"] = f"""
SELECT {R('CAST(o_orderkey AS DOUBLE)')} AS o_orderkey,
       {R('CAST(o_totalprice AS DOUBLE)')} AS o_totalprice,
       {R('TRY_CAST(trim(o_orderpriority) AS DOUBLE)')} AS o_orderpriority,
       CAST(NULL AS DOUBLE) AS missing_col
FROM orders"""

SQL["alignment_report"] = """
WITH cols AS (SELECT column_name, CAST(ordinal_position - 1 AS INTEGER) AS pos
              FROM information_schema.columns WHERE table_name = 'orders'),
exp AS (SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_totalprice'), (2, 'o_orderpriority'),
                              (3, 'missing_col')) t(pos, column_name))
SELECT 'original' AS kind, pos AS position, column_name FROM cols
UNION ALL SELECT 'expected', CAST(pos AS INTEGER), column_name FROM exp
UNION ALL SELECT 'missing', CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER), column_name
          FROM exp WHERE column_name NOT IN (SELECT column_name FROM cols)
UNION ALL SELECT 'extra_dropped', CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER), column_name
          FROM cols WHERE column_name NOT IN (SELECT column_name FROM exp)
                      AND column_name <> 'o_totalprice'"""

SQL["diff_by_run"] = f"""
SELECT event_id, user_id, {R('value - LAG(value) OVER w')} AS value_diff,
       {R('k - LAG(k) OVER w')} AS k_diff
FROM ({EV}) e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

SQL["diff_global"] = f"""
SELECT event_id, {R('value - LAG(value) OVER (ORDER BY ts, event_id)')} AS value_diff
FROM ({EV}) e"""

SQL["diff_after_dropna"] = f"""
SELECT event_id, user_id, {R('value - LAG(value) OVER w')} AS value_diff,
       {R('k - LAG(k) OVER w')} AS k_diff
FROM ({EVN}) e WHERE {COMPLETE}
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

SQL["ratio_safe"] = f"""
SELECT l_orderkey, l_linenumber, {R('l_extendedprice / NULLIF(l_discount, 0)')} AS ratio
FROM lineitem"""

SQL["threshold_flags"] = f"""
SELECT event_id, CAST(COALESCE(value > 100, false) AS INTEGER) AS high_flag,
       CAST(COALESCE(k < 50, false) AS INTEGER) AS low_flag
FROM ({EV}) e"""

ZS = ("CASE WHEN value IS NULL THEN NULL WHEN sd IS NULL OR sd = 0 THEN 0.0 "
      "ELSE (value - m) / sd END")

SQL["zscore_pop"] = f"""
WITH e AS ({EV}), s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM e)
SELECT event_id, {R(ZS)} AS value_z FROM e, s"""

SQL["zscore_by_run"] = f"""
WITH e AS ({EV}),
s AS (SELECT user_id AS u, avg(value) AS m, stddev_pop(value) AS sd FROM e GROUP BY user_id)
SELECT event_id, user_id, {R(ZS)} AS value_z FROM e JOIN s ON e.user_id IS NOT DISTINCT FROM s.u"""

SQL["preprocess_full"] = f"""
WITH c AS (SELECT * FROM ({EV}) e WHERE {COMPLETE}),
d AS (SELECT *, value - LAG(value) OVER w AS value_diff, k - LAG(k) OVER w AS k_diff,
             value / NULLIF(k, 0) AS ratio
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM c)
SELECT event_id, user_id, {R('value')} AS value, {R('k')} AS k, {R('value_diff')} AS value_diff,
       {R('k_diff')} AS k_diff, {R('ratio')} AS ratio, {R(ZS)} AS value_z,
       CAST(COALESCE(value > 100, false) AS INTEGER) AS high_flag,
       CAST(COALESCE(k < 50, false) AS INTEGER) AS low_flag
FROM d, s"""

SQL["fill_median"] = f"""
WITH e AS ({EVN}),
m AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(k, 0.5) AS mk FROM e)
SELECT event_id, {R('COALESCE(value, mv)')} AS value, {R('COALESCE(k, mk)')} AS k FROM e, m"""

SQL["fill_mode"] = """
WITH o AS (SELECT o_orderkey,
                  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
c AS (SELECT p, count(*) AS n FROM o WHERE p IS NOT NULL GROUP BY p),
m AS (SELECT min(p) AS mp FROM c WHERE n = (SELECT max(n) FROM c))
SELECT o_orderkey, COALESCE(p, mp) AS o_orderpriority FROM o, m"""

SQL["dedupe"] = "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"

SQL["duplicate_count"] = """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct,
       CAST(sum(c) - count(*) AS BIGINT) AS n_duplicates FROM g"""

SQL["missing_counts"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM ({EVN}) e"
    for c in ["event_id", "ts", "user_id", "event_type", "value", "k"])

SQL["missing_mask"] = f"""
SELECT event_id, CAST(value IS NULL AS INTEGER) AS value_missing,
       CAST(k IS NULL AS INTEGER) AS k_missing,
       CAST(event_type IS NULL AS INTEGER) AS event_type_missing
FROM ({EVN}) e"""

SQL["valid_target"] = f"""
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"""

SQL["quantile_cutoff"] = f"""
SELECT CAST(trunc(quantile_cont({SECS}, 0.8)) AS BIGINT) AS cutoff FROM events"""

SQL["time_split_counts"] = f"""
WITH e AS (SELECT {SECS} AS t, value FROM events),
c AS (SELECT CAST(trunc(quantile_cont(t, 0.8)) AS BIGINT) AS cut FROM e)
SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(value)')} AS mean_value, 'train' AS side,
       max(cut) AS cutoff FROM e, c WHERE t <= cut
UNION ALL
SELECT CAST(count(*) AS BIGINT), {R('avg(value)')}, 'test', max(cut) FROM e, c
WHERE NOT (t <= cut) OR t IS NULL"""

SQL["describe_numeric"] = "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, {R(f'avg({c})')} AS mean,
       {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min,
       {R(f'quantile_cont({c}, 0.25)')} AS p25, {R(f'quantile_cont({c}, 0.5)')} AS p50,
       {R(f'quantile_cont({c}, 0.75)')} AS p75, {R(f'max({c})')} AS max
FROM ({LI}) li""" for c in LI_NUM)

SQL["kpi_means"] = f"SELECT {R('avg(value)')} AS mean_value, {R('avg(k)')} AS mean_k FROM ({EV}) e"

SQL["group_mean"] = f"""
SELECT event_type, {R('avg(value)')} AS mean_value, {R('avg(k)')} AS mean_k
FROM ({EV}) e WHERE event_type IS NOT NULL GROUP BY event_type"""

SQL["bar_mean"] = f"""
SELECT event_type, {R('avg(value)')} AS mean_value
FROM ({EV}) e WHERE event_type IS NOT NULL GROUP BY event_type"""

SQL["group_count2"] = """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2"""


def _corr_sql() -> str:
    parts = []
    for a in LI_NUM:
        for b in LI_NUM:
            if a == b:
                expr = f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
            else:
                expr = (f"covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)"
                        f" * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(expr)} AS corr FROM ({LI}) li")
    return "\nUNION ALL ".join(parts)


SQL["corr_matrix"] = _corr_sql()


def E(i: str) -> str:
    """Edge i of linspace(lo, hi, nb + 1): i * step + lo, the last one hi (numpy)."""
    return f"(CASE WHEN ({i}) >= (SELECT nb FROM p) THEN hi ELSE ({i}) * ((hi - lo) / (SELECT nb FROM p)) + lo END)"


def _hist_sql(bins_expr: str, source: str, by: str | None = None, extra_cte: str = "",
              rnd=R) -> str:
    keys = f"{by}, " if by else ""
    grid = (f"SELECT DISTINCT {by}, unnest(range(0, (SELECT nb FROM p))) AS bin FROM src"
            if by else "SELECT unnest(range(0, (SELECT nb FROM p))) AS bin")
    return f"""
WITH src AS ({source}), r AS (SELECT min(v) AS lo, max(v) AS hi FROM src){extra_cte},
p AS (SELECT CAST({bins_expr} AS BIGINT) AS nb FROM r),
b0 AS (SELECT {keys}v, lo, hi, CAST(floor(((v - lo) / (hi - lo)) * CAST(nb AS DOUBLE)) AS BIGINT) AS i
       FROM src, r, p WHERE v IS NOT NULL),
b1 AS (SELECT {keys}v, lo, hi, CASE WHEN i = nb THEN nb - 1 ELSE i END AS i FROM b0, p),
b2 AS (SELECT {keys}v, lo, hi, CASE WHEN v < {E('i')} THEN i - 1 ELSE i END AS i FROM b1, p),
b AS (SELECT {keys}CASE WHEN v >= {E('i + 1')} AND i <> nb - 1 THEN i + 1 ELSE i END AS bin FROM b2, p),
c AS (SELECT {keys}bin, count(*) AS n FROM b GROUP BY ALL),
g AS ({grid})
SELECT {"g." + by + ", " if by else ""}CAST(g.bin AS INTEGER) AS bin, {rnd(E('g.bin'))} AS bin_lo,
       {rnd(E('g.bin + 1'))} AS bin_hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.bin = c.bin {"AND g." + by + " = c." + by if by else ""}, r"""


SQL["hist_fixed"] = _hist_sql("30", f"SELECT value AS v FROM ({EV}) e")
SQL["hist_by_class"] = _hist_sql("20", f"SELECT event_type, value AS v FROM ({EV}) e", by="event_type")
SQL["hist_auto"] = _hist_sql(
    "(SELECT CASE WHEN w > 0 THEN GREATEST(1, ceil((hi - lo) / w)) ELSE 1 END FROM a)",
    f"SELECT value AS v FROM ({EV}) e",
    extra_cte=""",
s AS (SELECT count(v) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM src),
a AS (SELECT LEAST(GREATEST(2.0 * iqr * pow(n, -1.0 / 3.0), ((hi - lo) / sqrt(n)) / 2.0),
                   (hi - lo) / (log2(n) + 1.0)) AS w FROM s, r)""")


def _kde_sql(by: str | None) -> str:
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN s2 USING ({by})" if by else ", s2"
    x = "(lo + (hi - lo) / 199 * p)"
    u = f"(({x} - v) / bw)"
    return f"""
WITH e0 AS (SELECT {keys}value AS v FROM ({EV}) q WHERE value IS NOT NULL),
s AS (SELECT {keys}count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM e0 {grp}),
s2 AS (SELECT *, sd * pow(n, -0.2) AS bw FROM s),
e AS (SELECT {keys}avg(v) AS v, count(*) AS w
      FROM (SELECT e0.*, least(floor((v - lo) / ((hi - lo) / 4096)), 4095) AS b FROM e0 {join}) GROUP BY {keys}b),
g AS (SELECT range AS p FROM range(200)),
acc AS (SELECT {keys}p, n, lo, hi, bw, sum(w * exp(-0.5 * {u} * {u})) AS sm
        FROM e {join}, g GROUP BY ALL)
SELECT {keys}CAST(p AS INTEGER) AS point, {R(x)} AS x,
       {R('sm / (n * bw * sqrt(2 * pi()))')} AS density, CAST(n AS BIGINT) AS n FROM acc"""


SQL["kde_curve"] = _kde_sql(None)
SQL["kde_by_class"] = _kde_sql("event_type")

SQL["box_summary"] = f"""
WITH b AS (SELECT l_returnflag, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL),
q AS (SELECT l_returnflag, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b GROUP BY l_returnflag),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q)
SELECT l_returnflag, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, {R('iqr')} AS iqr,
       {R('fence_lo')} AS fence_lo, {R('fence_hi')} AS fence_hi, CAST(count(*) AS BIGINT) AS n,
       {R('min(CASE WHEN v >= fence_lo AND v <= fence_hi THEN v END)')} AS whisker_lo,
       {R('max(CASE WHEN v >= fence_lo AND v <= fence_hi THEN v END)')} AS whisker_hi,
       CAST(sum(CASE WHEN v >= fence_lo AND v <= fence_hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM b JOIN f USING (l_returnflag)
GROUP BY l_returnflag, q1, median, q3, iqr, fence_lo, fence_hi"""

SQL["box_outliers"] = f"""
WITH b AS (SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL),
q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
             quantile_cont(o_totalprice, 0.75) AS q3 FROM b GROUP BY o_orderpriority),
f AS (SELECT o_orderpriority, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT o_orderpriority, o_orderkey, {R('o_totalprice')} AS o_totalprice,
       CASE WHEN o_totalprice < lo THEN 'low' ELSE 'high' END AS side
FROM b JOIN f USING (o_orderpriority) WHERE o_totalprice < lo OR o_totalprice > hi"""

SQL["unpivot_trend"] = f"""
SELECT event_id, 'value' AS metric, {R('value')} AS value FROM ({EV}) e
UNION ALL SELECT event_id, 'k', {R('k')} FROM ({EV}) e"""

SQL["trend_mean"] = f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {R('avg(value)')} AS mean_value,
       CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"""

SQL["pair_points"] = "\nUNION ALL ".join(
    f"SELECT p_partkey AS id, '{a}' AS col_x, '{b}' AS col_y, {R(f'CAST({a} AS DOUBLE)')} AS x, "
    f"{R(f'CAST({b} AS DOUBLE)')} AS y FROM part"
    for a in ["p_size", "p_retailprice", "p_partkey"] for b in ["p_size", "p_retailprice", "p_partkey"]
    if a != b)


def RK(x: str, digits: int = 4) -> str:
    s = f"1e{digits}"
    return f"(CASE WHEN abs({x}) < 1e12 THEN floor(({x}) * {s} + 0.5) / {s} ELSE ({x}) END + 0.0)"


OLS = """ols AS (SELECT regr_intercept(p_retailprice, p_partkey) AS b,
                        regr_slope(p_retailprice, p_partkey) AS w FROM part)"""

SQL["ols_fit"] = f"""
WITH {OLS}
SELECT 'intercept' AS term, {RK('b')} AS coef_raw FROM ols
UNION ALL SELECT 'p_partkey', {RK('w')} FROM ols"""

SQL["ols_score"] = f"""
WITH {OLS}
SELECT p_partkey, {RK('b + w * p_partkey')} AS prediction FROM part, ols"""

SQL["ols_metrics"] = f"""
WITH {OLS}, e AS (SELECT p_retailprice AS y, p_retailprice - (b + w * p_partkey) AS e FROM part, ols)
SELECT CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) = 0 THEN (CASE WHEN sum(e*e) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2,
       {RK('avg(abs(e))')} AS mae, {RK('sqrt(avg(e * e))')} AS rmse FROM e"""

SQL["residual_hist"] = _hist_sql(
    "20", f"WITH {OLS} SELECT p_retailprice - (b + w * p_partkey) AS v FROM part, ols",
    rnd=lambda x: RK(x, 3))

SQL["actual_vs_pred"] = f"""
WITH {OLS}, pts AS (SELECT p_retailprice AS actual, b + w * p_partkey AS predicted FROM part, ols),
lim AS (SELECT LEAST(min(actual), min(predicted)) AS lim_lo,
               GREATEST(max(actual), max(predicted)) AS lim_hi FROM pts)
SELECT {RK('actual')} AS actual, {RK('predicted')} AS predicted, {RK('lim_lo')} AS lim_lo,
       {RK('lim_hi')} AS lim_hi FROM pts, lim"""

HASH5 = "CAST(CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER)"

SQL["hash_split"] = f"""
SELECT o_orderkey, CASE WHEN {HASH5.format(k='o_orderkey')} < 4 THEN 'train' ELSE 'test' END AS split
FROM orders"""

SQL["fold_sizes"] = f"""
SELECT {HASH5.format(k='o_orderkey')} AS fold, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1"""

SQL["block_folds"] = """
SELECT event_id, CAST(NTILE(5) OVER (ORDER BY ts, event_id) - 1 AS INTEGER) AS fold FROM events"""

SQL["cv_scores"] = f"""
WITH p AS (SELECT p_partkey, p_retailprice AS y, {HASH5.format(k='p_partkey')} AS fold FROM part),
f AS (SELECT DISTINCT fold FROM p),
m AS (SELECT f.fold, regr_intercept(p.y, p.p_partkey) AS b, regr_slope(p.y, p.p_partkey) AS w
      FROM f JOIN p ON p.fold <> f.fold GROUP BY f.fold),
e AS (SELECT p.fold, p.y, p.y - (m.b + m.w * p.p_partkey) AS e FROM p JOIN m USING (fold))
SELECT fold, CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2
FROM e GROUP BY fold"""

# Ridge with two standardised features, contiguous folds: closed-form 2 x 2
# solves from per-fold sums (train = total minus fold).
_RIDGE_BASE = """
base AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey AS DOUBLE) AS x2, p_retailprice AS y,
                NTILE(5) OVER (ORDER BY p_partkey) - 1 AS fold FROM part),
st AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM base),
z AS (SELECT fold, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y FROM base, st),
fs AS (SELECT fold, count(*) AS n, sum(z1) AS a1, sum(z2) AS a2, sum(y) AS ay, sum(z1 * z1) AS a11,
              sum(z1 * z2) AS a12, sum(z2 * z2) AS a22, sum(z1 * y) AS a1y, sum(z2 * y) AS a2y,
              sum(y * y) AS ayy FROM z GROUP BY fold),
tot AS (SELECT sum(n) AS n, sum(a1) AS a1, sum(a2) AS a2, sum(ay) AS ay, sum(a11) AS a11,
               sum(a12) AS a12, sum(a22) AS a22, sum(a1y) AS a1y, sum(a2y) AS a2y FROM fs),
tr AS (SELECT f.fold, t.n - f.n AS n, t.a1 - f.a1 AS a1, t.a2 - f.a2 AS a2, t.ay - f.ay AS ay,
              t.a11 - f.a11 AS a11, t.a12 - f.a12 AS a12, t.a22 - f.a22 AS a22,
              t.a1y - f.a1y AS a1y, t.a2y - f.a2y AS a2y FROM fs f, tot t),
al AS (SELECT pow(10, -3 + 0.5 * i) AS alpha FROM range(13) t(i))"""

_CENTRED = """SELECT {key}n, a1 / n AS mz1, a2 / n AS mz2, ay / n AS my,
       a11 - a1 * a1 / n AS c11, a12 - a1 * a2 / n AS c12, a22 - a2 * a2 / n AS c22,
       a1y - a1 * ay / n AS c1y, a2y - a2 * ay / n AS c2y FROM {src}"""

_SOLVE = """SELECT {key}alpha, mz1, mz2, my,
       (c1y * (c22 + alpha) - c12 * c2y) / ((c11 + alpha) * (c22 + alpha) - c12 * c12) AS w1,
       ((c11 + alpha) * c2y - c12 * c1y) / ((c11 + alpha) * (c22 + alpha) - c12 * c12) AS w2
FROM {src}"""

_PATH = f"""{_RIDGE_BASE},
c AS ({_CENTRED.format(key='fold, ', src='tr')}),
sol AS ({_SOLVE.format(key='fold, ', src='c, al')}),
sol2 AS (SELECT *, my - w1 * mz1 - w2 * mz2 AS b FROM sol),
sc AS (SELECT s.alpha, s.fold,
              1 - (f.ayy - 2 * b * f.ay - 2 * w1 * f.a1y - 2 * w2 * f.a2y + f.n * b * b
                   + 2 * b * w1 * f.a1 + 2 * b * w2 * f.a2 + w1 * w1 * f.a11
                   + 2 * w1 * w2 * f.a12 + w2 * w2 * f.a22) / (f.ayy - f.ay * f.ay / f.n) AS r2
       FROM sol2 s JOIN fs f USING (fold)),
path AS (SELECT alpha, avg(r2) AS mean_r2 FROM sc GROUP BY alpha)"""

SQL["ridge_path"] = f"""
WITH {_PATH}
SELECT {RK('alpha')} AS alpha, {RK('mean_r2')} AS mean_r2 FROM path"""

_REFIT = f"""{_PATH},
best AS (SELECT alpha FROM path ORDER BY mean_r2 DESC, alpha ASC LIMIT 1),
ca AS ({_CENTRED.format(key='', src='tot')}),
fin AS ({_SOLVE.format(key='', src='ca, best')}),
fin2 AS (SELECT *, my - w1 * mz1 - w2 * mz2 AS b FROM fin)"""

SQL["ridge_cv_select"] = f"""
WITH {_REFIT}
SELECT 'intercept' AS term, {RK('b')} AS coef, {RK('alpha')} AS alpha FROM fin2
UNION ALL SELECT 'p_size', {RK('w1')}, {RK('alpha')} FROM fin2
UNION ALL SELECT 'p_partkey', {RK('w2')}, {RK('alpha')} FROM fin2"""

SQL["importance_coef"] = f"""
WITH {_REFIT},
imp AS (SELECT 'p_size' AS feature, w1 AS importance FROM fin2
        UNION ALL SELECT 'p_partkey', w2 FROM fin2)
SELECT feature, {RK('importance')} AS importance,
       CAST(row_number() OVER (ORDER BY importance DESC, feature ASC) AS INTEGER) AS rank,
       'coefficient' AS kind FROM imp"""


def FMT(x: str, d: int) -> str:
    """Fixed decimals, half-up on x * 10^d (same as ``scalar.format_fixed``)."""
    s = 10 ** d
    u = f"CAST(floor(abs({x}) * {float(s)} + 0.5) AS BIGINT)"
    return (f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE (CASE WHEN ({x}) < 0 THEN '-' ELSE '' END) || "
            f"CAST({u} // {s} AS VARCHAR) || '.' || lpad(CAST({u} % {s} AS VARCHAR), {d}, '0') END)")


RUNS = f"""
SELECT event_id AS id, 'user_' || CAST(user_id AS VARCHAR) AS username, ts AS timestamp,
       'batch_' || event_type || '.csv' AS file,
       CASE WHEN event_type = 'error' THEN NULL WHEN value > 250 THEN 'Benchmark' ELSE 'Predict' END AS mode,
       CASE WHEN value > 250 THEN value / 490 END AS r2,
       CASE WHEN value > 250 THEN sqrt(value) END AS rmse,
       CASE WHEN NOT (value > 250) AND NOT (event_type = 'signup' AND value < 20) THEN value END AS mean_pred,
       CASE WHEN NOT (value > 250) AND NOT (event_type = 'signup' AND value < 20) THEN CAST(k AS INTEGER) END AS cnt,
       'models\\' || event_type || '/ridge_v' || CAST(user_id % 3 AS VARCHAR) || '.joblib' AS model_name
FROM ({EV}) e"""

BASENAME = "regexp_split_to_array({p}, '[/\\\\]')[-1]"

SQL["history_page"] = f"""
SELECT id, username, {BASENAME.format(p='model_name')} AS model, COALESCE(mode, 'N/A') AS mode
FROM ({RUNS}) r WHERE username = 'user_8'
ORDER BY timestamp DESC, id DESC LIMIT 10 OFFSET 10"""

SQL["history_pages_total"] = f"""
SELECT username, CAST(count(*) AS BIGINT) AS n_runs,
       CAST(GREATEST(1, ceil(count(*) / 10.0)) AS BIGINT) AS n_pages
FROM ({RUNS}) r GROUP BY username"""

SQL["history_summary"] = f"""
SELECT id, {BASENAME.format(p='model_name')} AS model,
       CASE WHEN r2 IS NOT NULL THEN 'R²: ' || {FMT('r2', 3)} || ' | RMSE: ' || {FMT('rmse', 3)}
            WHEN mean_pred IS NOT NULL THEN 'Mean: ' || {FMT('mean_pred', 2)} || ' | Rows: ' || CAST(cnt AS VARCHAR)
            ELSE '' END AS summary,
       COALESCE(mode, 'N/A') AS mode
FROM ({RUNS}) r"""

SQL["history_export"] = f"""
SELECT id, username, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day
FROM ({RUNS}) r WHERE username = 'user_8' ORDER BY timestamp DESC, id DESC LIMIT 1000"""

SQL["run_profile"] = f"SELECT id, username, file, model_name FROM ({RUNS}) r"

SQL["lookup_run"] = f"""
WITH r AS ({RUNS})
SELECT id, username FROM r
WHERE username = 'user_8'
  AND id = (SELECT id FROM r WHERE username = 'user_8' ORDER BY timestamp DESC, id DESC LIMIT 1)"""

OLDNEW = """
o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders),
old AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM o WHERE o_orderdate < TIMESTAMP '1996-01-01'),
new AS (SELECT o_orderkey, o_totalprice + 1.0 AS o_totalprice, 'U' AS o_orderstatus
        FROM o WHERE o_orderdate >= TIMESTAMP '1994-01-01')"""

SQL["upsert_latest"] = f"""
WITH {OLDNEW}
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice, o_orderstatus FROM new
UNION ALL
SELECT o_orderkey, {R('o_totalprice')}, o_orderstatus FROM old
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)"""

SQL["insert_absent"] = f"""
WITH {OLDNEW}
SELECT o_orderkey, {R('o_totalprice')} AS o_totalprice, o_orderstatus FROM old
UNION ALL
SELECT o_orderkey, {R('o_totalprice')}, o_orderstatus FROM new
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)"""

SQL["update_by_key"] = """
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
                        THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders"""

SQL["delete_by_key"] = """
SELECT o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"""

SQL["cascade_delete"] = """
WITH dc AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
dord AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM dc))
SELECT CAST(count(*) AS BIGINT) AS n_rows, 'lineitem' AS table_name FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM dord)
UNION ALL SELECT CAST(count(*) AS BIGINT), 'orders' FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM dc)
UNION ALL SELECT CAST(count(*) AS BIGINT), 'customer' FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM dc)"""

RULES = """
SELECT 'user_' || CAST(c_custkey AS VARCHAR) AS username, c_mktsegment <> 'HOUSEHOLD' AS email_enabled,
       floor(abs(c_acctbal)) / 20.0 AS titer_threshold,
       CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'below' ELSE 'above' END AS condition
FROM customer WHERE c_mktsegment <> 'MACHINERY'"""

SCORED = f"""
SELECT 'user_' || CAST(user_id AS VARCHAR) AS username, user_id, value AS score,
       'runs\\' || CAST(user_id AS VARCHAR) || '/model_ridge.joblib' AS model_path FROM events"""

WITH_RULE = f"""
j AS (SELECT s.*, COALESCE(r.email_enabled, false) AS email_enabled,
             COALESCE(r.titer_threshold, 5.0) AS threshold, COALESCE(r.condition, 'above') AS condition
      FROM ({SCORED}) s LEFT JOIN ({RULES}) r ON s.username = r.username)"""

BEYOND = "(CASE WHEN condition = 'below' THEN {v} < threshold WHEN condition = 'above' THEN {v} > threshold ELSE false END)"

SQL["run_stats"] = f"""
SELECT user_id, CAST(count(value) AS BIGINT) AS n, {R('avg(value)')} AS mean,
       {R('min(value)')} AS min, {R('max(value)')} AS max FROM events GROUP BY user_id"""

SQL["violators"] = f"""
WITH {WITH_RULE}
SELECT username, CAST(count(score) AS BIGINT) AS n,
       CAST(sum(CAST(COALESCE({BEYOND.format(v='score')}, false) AS BIGINT)) AS BIGINT) AS n_violators,
       {R(f"sum(CAST(COALESCE({BEYOND.format(v='score')}, false) AS BIGINT)) * 100.0 / count(score)")} AS pct_violators
FROM j GROUP BY username"""

ALERTS = f"""{WITH_RULE},
a AS (SELECT username, email_enabled, threshold, condition, CAST(count(score) AS BIGINT) AS n,
             avg(score) AS mean, min(score) AS min, max(score) AS max,
             CAST(sum(CAST(COALESCE({BEYOND.format(v='score')}, false) AS BIGINT)) AS BIGINT) AS n_violators,
             max({BASENAME.format(p='model_path')}) AS model
      FROM j GROUP BY username, email_enabled, threshold, condition),
b AS (SELECT *, n_violators * 100.0 / n AS pct_violators,
             email_enabled AND COALESCE({BEYOND.format(v='mean')}, false) AS triggered FROM a)"""

SQL["alert_trigger"] = f"""
WITH {ALERTS}
SELECT username, email_enabled, {R('threshold')} AS threshold, condition, n, {R('mean')} AS mean,
       triggered FROM b"""

SQL["alert_report"] = f"""
WITH {ALERTS}
SELECT username, n, n_violators, {R('pct_violators')} AS pct_violators, {R('mean')} AS mean,
       {R('min')} AS min, {R('max')} AS max, model,
       'Mean ' || upper(condition) || ' ' || {FMT('threshold', 2)} || ': actual ' || {FMT('mean', 2)}
       || '; ' || format('{{:,}}', n_violators) || ' of ' || format('{{:,}}', n) || ' rows ('
       || {FMT('pct_violators', 1)} || '%) beyond; min ' || {FMT('min', 2)} || ', max ' || {FMT('max', 2)}
       AS message
FROM b WHERE triggered"""

SQL["attach_scores"] = f"""
WITH raw AS ({EVN}),
m AS (SELECT regr_intercept(value, k) AS b, regr_slope(value, k) AS w FROM raw WHERE {COMPLETE})
SELECT event_id, {RK('CASE WHEN ' + COMPLETE + ' THEN b + w * k END')} AS prediction FROM raw, m"""

SQL["time_split_eval"] = f"""
WITH c AS (SELECT CAST(trunc(quantile_cont(p_partkey, 0.8)) AS BIGINT) AS cut FROM part),
tr AS (SELECT * FROM part, c WHERE p_partkey <= cut),
te AS (SELECT * FROM part, c WHERE NOT (p_partkey <= cut)),
m AS (SELECT regr_intercept(p_retailprice, p_partkey) AS b, regr_slope(p_retailprice, p_partkey) AS w FROM tr),
e AS (SELECT p_retailprice AS y, p_retailprice - (b + w * p_partkey) AS e, cut FROM te, m)
SELECT CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2,
       {RK('avg(abs(e))')} AS mae, {RK('sqrt(avg(e * e))')} AS rmse, max(cut) AS cutoff FROM e"""

SQL["cv_summary"] = f"""
WITH cv AS ({SQL['cv_scores']})
SELECT {RK('avg(r2)')} AS mean_score, {RK('stddev_pop(r2)')} AS std_score,
       CAST(count(r2) AS BIGINT) AS n_scores FROM cv"""

SQL["history_table"] = f"""
SELECT id AS "ID", model AS "Model", summary AS "Summary", mode AS "Mode"
FROM ({SQL['history_summary']}) h"""

SQL["trend_buckets"] = f"""
WITH e AS ({EV}),
l AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS t, 'value' AS metric, value AS v FROM e
      UNION ALL
      SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M'), 'k', k FROM e)
SELECT t, metric, {R('avg(v)')} AS mean, CAST(count(v) AS BIGINT) AS n FROM l GROUP BY t, metric"""

SQL["batch_union"] = "\nUNION ALL ".join(f"""
SELECT CAST(count(value) AS BIGINT) AS n, {R('avg(value)')} AS mean, {R('min(value)')} AS min,
       {R('max(value)')} AS max, '{b}' AS batch FROM events WHERE event_type = '{b}'""" for b in ["click", "error", "purchase", "signup", "view"])

SQL["python_model_score"] = f"""
SELECT event_id, {RK('2.0 * value + ln(1 + k)')} AS prediction FROM ({EV}) e"""

_SPLIT = f"""
p AS (SELECT *, {HASH5.format(k='p_partkey')} AS b FROM part),
tr AS (SELECT * FROM p WHERE b < 4), te AS (SELECT * FROM p WHERE b >= 4),
m AS (SELECT regr_intercept(p_retailprice, p_partkey) AS b0, regr_slope(p_retailprice, p_partkey) AS w FROM tr)"""

_METRICS = f"""
SELECT CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2,
       {RK('avg(abs(e))')} AS mae, {RK('sqrt(avg(e * e))')} AS rmse FROM e"""

SQL["benchmark_metrics"] = f"""
WITH {_SPLIT},
e AS (SELECT p_retailprice AS y, p_retailprice - (b0 + w * p_partkey) AS e FROM te, m WHERE p_size <> 1)
{_METRICS}"""

SQL["train_metrics"] = f"""
WITH {_SPLIT},
e AS (SELECT p_retailprice AS y, p_retailprice - (b0 + w * p_partkey) AS e FROM tr, m)
{_METRICS}"""

SQL["shape_dtypes"] = """
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
       CASE lower(data_type) WHEN 'varchar' THEN 'string' WHEN 'timestamp' THEN 'timestamp_ntz'
            ELSE lower(data_type) END AS data_type,
       (SELECT CAST(count(*) AS BIGINT) FROM events) AS n_rows
FROM information_schema.columns WHERE table_name = 'events'"""

SQL["feature_schema_rows"] = """
SELECT 'value' AS target, CAST(position AS INTEGER) AS position, feature, dtype,
       (SELECT CAST(count(*) AS BIGINT) FROM events) AS trained_rows, 12 AS trained_cols
FROM (VALUES (0, 'k', 'double'), (1, 'value_diff', 'double'), (2, 'k_diff', 'double'),
             (3, 'ratio', 'double'), (4, 'value_z', 'double'), (5, 'high_flag', 'int'),
             (6, 'low_flag', 'int')) t(position, feature, dtype)"""

SQL["violin_quartiles"] = SQL["box_summary"].replace("l_returnflag", "l_returnflag, l_linestatus") \
    .replace("USING (l_returnflag, l_linestatus)", "USING (l_returnflag, l_linestatus)")

SQL["missing_profile"] = f"""
WITH e AS (SELECT value, k, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER () AS n FROM ({EVN}) q)
SELECT CAST(i * 10 // n AS BIGINT) AS row_bucket, CAST(count(*) AS BIGINT) AS n,
       {R('avg(CAST(value IS NULL AS DOUBLE))')} AS value, {R('avg(CAST(k IS NULL AS DOUBLE))')} AS k
FROM e GROUP BY 1"""

SQL["preview_rows"] = f"""
SELECT event_id, user_id, event_type, {R('value')} AS value, {R('k')} AS k
FROM ({EV}) e ORDER BY event_id LIMIT 20"""

# Ridge with one standardised feature (p_size), alpha chosen by 5-fold
# CV on the training split (folds hashed with a separate seed), refit, scored
# on the test split.
SQL["refit_without_time"] = f"""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y,
                  {HASH5.format(k='p_partkey')} AS b,
                  CAST(CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || 'cv'), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
           FROM part),
tr AS (SELECT * FROM p WHERE b < 4), te AS (SELECT * FROM p WHERE b >= 4),
st AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM tr),
z AS (SELECT fold, (x - mx) / sx AS z, y FROM tr, st),
fs AS (SELECT fold, count(*) AS n, sum(z) AS a1, sum(y) AS ay, sum(z * z) AS a11, sum(z * y) AS a1y,
              sum(y * y) AS ayy FROM z GROUP BY fold),
tot AS (SELECT sum(n) AS n, sum(a1) AS a1, sum(ay) AS ay, sum(a11) AS a11, sum(a1y) AS a1y FROM fs),
trn AS (SELECT f.fold, t.n - f.n AS n, t.a1 - f.a1 AS a1, t.ay - f.ay AS ay, t.a11 - f.a11 AS a11,
               t.a1y - f.a1y AS a1y FROM fs f, tot t),
al AS (SELECT pow(10, -3 + 0.5 * i) AS alpha FROM range(13) t(i)),
sol AS (SELECT fold, alpha, (a1y - a1 * ay / n) / (a11 - a1 * a1 / n + alpha) AS w, a1 / n AS mz, ay / n AS my
        FROM trn, al),
sc AS (SELECT s.alpha, s.fold,
              1 - (f.ayy - 2 * (my - w * mz) * f.ay - 2 * w * f.a1y + f.n * (my - w * mz) * (my - w * mz)
                   + 2 * (my - w * mz) * w * f.a1 + w * w * f.a11) / (f.ayy - f.ay * f.ay / f.n) AS r2
       FROM sol s JOIN fs f USING (fold)),
best AS (SELECT alpha FROM (SELECT alpha, avg(r2) AS m FROM sc GROUP BY alpha) ORDER BY m DESC, alpha ASC LIMIT 1),
fin AS (SELECT (a1y - a1 * ay / n) / (a11 - a1 * a1 / n + alpha) AS w, a1 / n AS mz, ay / n AS my FROM tot, best),
e AS (SELECT te.y, te.y - ((my - w * mz) + w * ((te.x - mx) / sx)) AS e FROM te, fin, st)
{_METRICS}"""

# Flagship: preprocess (complete rows, per-run difference of k) -> median
# imputation of the first difference -> contiguous folds in time order ->
# ridge CV over the 13 alphas with two standardised features -> refit ->
# R² / MAE / RMSE per event type.
_FLAG_BASE = f"""
c0 AS (SELECT * FROM ({EV}) e WHERE {COMPLETE}),
d AS (SELECT event_type, ts, event_id, value AS y, k AS x1,
             k - LAG(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x2raw FROM c0),
med AS (SELECT quantile_cont(x2raw, 0.5) AS md FROM d),
base AS (SELECT event_type, y, x1, COALESCE(x2raw, md) AS x2,
                NTILE(5) OVER (ORDER BY ts, event_id) - 1 AS fold FROM d, med),
st AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM base),
z AS (SELECT fold, event_type, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y FROM base, st),
""" + _RIDGE_BASE[_RIDGE_BASE.index("fs AS"):]

SQL["flagship_two_features"] = f"""
WITH {_REFIT.replace(_RIDGE_BASE, _FLAG_BASE)},
e AS (SELECT z.event_type, z.y, z.y - (b + w1 * z1 + w2 * z2) AS e FROM z, fin2)
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2,
       {RK('avg(abs(e))')} AS mae, {RK('sqrt(avg(e * e))')} AS rmse
FROM e GROUP BY event_type"""


# ------------------------------------------------------------------ keyed changes with versions
SQL["upsert_versions"] = f"""
WITH new AS (SELECT l_orderkey AS o_orderkey, arg_max(l_extendedprice, (l_linenumber, l_extendedprice)) AS price
             FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, {R('price')} AS price FROM new
UNION ALL SELECT o_orderkey, {R('o_totalprice')} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)"""

SQL["update_versions"] = """
WITH ch AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE f END AS o_orderstatus
FROM orders LEFT JOIN ch ON l_orderkey = o_orderkey"""

# ------------------------------------------------------------------ commands
_BATCH = f"""
raw AS (SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
               k IS NOT NULL OR event_id % 13 = 0 AS has_k,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE k END AS k FROM ({EVN}) q),
ok AS (SELECT * FROM raw WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
       AND event_type IS NOT NULL AND value IS NOT NULL AND has_k),
st AS (SELECT {{stats}}),
x AS (SELECT event_id, value, k, value - LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_diff,
             CASE WHEN k <> 0 THEN value / k END AS ratio,
             CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (value - m) / sd END AS value_z FROM ok, st),
p AS (SELECT event_id, value, value_diff,
             3.0 + 1.5 * ((COALESCE(k, 50.0) - 50.0) / 10.0) + -0.5 * ((COALESCE(value_diff, 0.0) - 0.0) / 20.0)
             + 0.25 * ((COALESCE(ratio, 1.0) - 1.0) / 2.0) + 2.0 * ((value_z - 0.0) / 1.0) AS prediction FROM x)"""
_TRAINED = f"avg(value) AS m, stddev_pop(value) AS sd FROM ({EVN}) t WHERE {COMPLETE} AND event_type = 'click'"
_OWN = "avg(value) AS m, stddev_pop(value) AS sd FROM ok"

SQL["predict_model_stats"] = f"""
WITH {_BATCH.format(stats=_TRAINED)} SELECT event_id, {R('prediction')} AS prediction FROM p"""
SQL["predict_batch_stats"] = f"""
WITH {_BATCH.format(stats=_OWN)} SELECT event_id, {R('prediction')} AS prediction FROM p"""
SQL["predict_keep_all"] = f"""
WITH {_BATCH.format(stats=_OWN)}
SELECT raw.event_id, {R('value_diff')} AS value_diff, {R('prediction')} AS prediction
FROM raw LEFT JOIN p ON raw.event_id = p.event_id"""
SQL["benchmark_cmd"] = f"""
WITH {_BATCH.format(stats=_TRAINED)}
SELECT CAST(count(*) AS BIGINT) AS n,
       {RK('1 - sum((value - prediction) * (value - prediction)) / (var_pop(value) * count(*))')} AS r2,
       {RK('avg(abs(value - prediction))')} AS mae,
       {RK('sqrt(avg((value - prediction) * (value - prediction)))')} AS rmse FROM p"""

_TRAIN_FEATURES = {
    "event_id": "CAST(event_id AS DOUBLE)", "k": "k", "value_diff": "value_diff", "k_diff": "k_diff", "ratio": "ratio",
    "value_z": "value_z", "high_flag": "CAST(high_flag AS DOUBLE)", "low_flag": "CAST(low_flag AS DOUBLE)"}
SQL["train_cmd"] = f"""
WITH ok AS (SELECT * FROM ({EVN}) q WHERE {COMPLETE}), st AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM ok),
x AS (SELECT event_id, k, value - LAG(value) OVER w AS value_diff, k - LAG(k) OVER w AS k_diff,
             CASE WHEN k <> 0 THEN value / k END AS ratio, (value - m) / sd AS value_z,
             CAST(value > 100.0 AS INTEGER) AS high_flag, CAST(k < 50.0 AS INTEGER) AS low_flag
      FROM ok, st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""" + "\nUNION ALL ".join(f"""
SELECT '{f}' AS feature, {i} AS position, {R(f'quantile_cont({e}, 0.5)')} AS median,
       CAST(count(*) AS BIGINT) AS n, true AS in_schema FROM x""" for i, (f, e) in enumerate(_TRAIN_FEATURES.items()))

# ------------------------------------------------------------------ NaN, null classes, readers
_NAN = f"SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, k FROM ({EV}) q"
SQL["nan_metrics"] = f"""
SELECT CAST(count(value - k) AS BIGINT) AS n,
       {R('1 - sum((value - k) * (value - k)) / (var_pop(CASE WHEN k IS NOT NULL THEN value END) * count(value - k))')} AS r2,
       {R('avg(abs(value - k))')} AS mae, {R('sqrt(avg((value - k) * (value - k)))')} AS rmse FROM ({_NAN}) e"""
SQL["nan_corr"] = f"""
WITH c AS (SELECT corr(value, k) AS r FROM ({_NAN}) e)
SELECT a AS col_a, b AS col_b, {R('CASE WHEN a = b THEN 1.0 ELSE r END')} AS corr
FROM c, (SELECT unnest(['value', 'k']) AS a), (SELECT unnest(['value', 'k']) AS b)"""
SQL["nan_hist_by_class"] = _hist_sql(
    "20", f"SELECT event_type, value AS v FROM ({_NAN}) e WHERE event_type <> 'error' ", by="event_type")
SQL["fill_median_int"] = f"""
WITH o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN l_linenumber END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, {R('COALESCE(CAST(x AS DOUBLE), (SELECT quantile_cont(x, 0.5) FROM o))')} AS x FROM o"""
SQL["pending_rows"] = "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"
SQL["strip_and_drop"] = "SELECT n_nationkey, n_name FROM nation"
SQL["csv_round_trip"] = f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {R('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer"

# ------------------------------------------------------------------ bootstrap: weights are MD5 parts, so exact
_EDGES = []
_P, _CDF = math.exp(-1.0), 0.0
for _k in range(12):
    _CDF += _P
    _EDGES.append(_CDF)
    _P /= _k + 1
_WEIGHT = "(CASE " + " ".join(f"WHEN u < {e!r} THEN {k}" for k, e in enumerate(_EDGES)) + " ELSE 12 END)"


def _bootstrap_sql(group: str, name: str) -> str:
    a = (1.0 - 0.95) / 2.0
    return f"""
WITH b AS (SELECT {group} AS g, value AS v, event_id FROM ({EV}) q WHERE value IS NOT NULL),
h AS (SELECT g, v, r, md5(event_id || ':' || r || ':42') AS h FROM b, (SELECT unnest(range(250)) AS r)),
u AS (SELECT g, v, 4 * r + p AS r, CAST('0x' || substr(h, 8 * p + 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM h, (SELECT unnest(range(4)) AS p)),
m AS (SELECT g, r, sum({_WEIGHT} * v) / sum({_WEIGHT}) AS m FROM u GROUP BY g, r),
c AS (SELECT g, quantile_cont(m, {a!r}) AS lo, quantile_cont(m, {1.0 - a!r}) AS hi FROM m GROUP BY g)
SELECT g AS {name}, {R('mean')} AS mean, n, {R('lo')} AS ci_lo, {R('hi')} AS ci_hi
FROM c JOIN (SELECT g, avg(v) AS mean, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY g) USING (g)"""


SQL["bootstrap_ci"] = _bootstrap_sql("event_type", "event_type")
SQL["trend_ci"] = _bootstrap_sql("strftime(ts, '%Y-%m-%d')", "t")


SQL["box_outliers_squared"] = """
WITH b AS (SELECT o_orderpriority, o_orderkey, o_totalprice * o_totalprice AS sq FROM orders),
q AS (SELECT o_orderpriority, quantile_cont(sq, 0.25) AS q1, quantile_cont(sq, 0.75) AS q3 FROM b GROUP BY o_orderpriority),
f AS (SELECT o_orderpriority, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT o_orderpriority, o_orderkey, CASE WHEN sq < lo THEN 'low' ELSE 'high' END AS side
FROM b JOIN f USING (o_orderpriority) WHERE sq < lo OR sq > hi"""

SQL["history_next_page"] = f"""
SELECT id, username FROM ({RUNS}) r WHERE username = 'user_8' ORDER BY timestamp DESC, id DESC LIMIT 10 OFFSET 10"""

SQL["alignment_losses"] = """
SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderpriority', 'missing_col']) AS column_name,
       CAST(count(*) AS BIGINT) AS n_rows,
       unnest([0, 0, CAST(count(o_orderpriority) AS BIGINT), CAST(count(*) AS BIGINT)]) AS n_lost FROM orders"""


# L9 with two features: normal equations of each training set, total less fold.
SQL["cv_scores_two_features"] = f"""
WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey AS DOUBLE) AS x2, p_retailprice AS y,
                  {HASH5.format(k='p_partkey')} AS fold FROM part),
f AS (SELECT DISTINCT fold FROM p),
m AS (SELECT f.fold, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS c11, covar_pop(x1, x2) AS c12,
             var_pop(x2) AS c22, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
      FROM f JOIN p ON p.fold <> f.fold GROUP BY f.fold),
s AS (SELECT fold, m1, m2, my, (c1y * c22 - c12 * c2y) / (c11 * c22 - c12 * c12) AS w1,
             (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS w2 FROM m),
e AS (SELECT p.fold, p.y, p.y - (my + w1 * (x1 - m1) + w2 * (x2 - m2)) AS e FROM p JOIN s USING (fold))
SELECT fold, CAST(count(*) AS BIGINT) AS n,
       {RK('CASE WHEN count(*) < 2 THEN NULL ELSE 1 - sum(e * e) / (var_pop(y) * count(*)) END')} AS r2,
       {RK('avg(abs(e))')} AS mae, {RK('sqrt(avg(e * e))')} AS rmse FROM e GROUP BY fold"""


# The ridge model of the training rows, then the test rows permuted by the keyed bijection
# (pairs of an index, one MD5 a round, places beyond the rows sent through again).
def _partner_sql(source: str, x: str, key: str) -> str:
    def word(half: str, turn: int) -> str:
        return f"CAST(('0x' || substr(md5({half} || ':' || rep || ':42:{turn}'), 1, 8)) AS BIGINT)"

    out = f"SELECT i, rep, n, a, b, {x} // b AS l, {x} % b AS r FROM {source}"
    for turn in range(4):
        l, r = (f"(l + {word('r', turn)}) % a AS l", "r") if turn % 2 == 0 else ("l", f"(r + {word('l', turn)}) % b AS r")
        out = f"SELECT i, rep, n, a, b, {l}, {r} FROM ({out}) {key}{turn}"
    return f"SELECT i, rep, n, a, b, l * b + r AS x FROM ({out}) {key}"


_PERM_BASE = _REFIT.replace("""base AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey AS DOUBLE) AS x2, p_retailprice AS y,
                NTILE(5) OVER (ORDER BY p_partkey) - 1 AS fold FROM part)""", f"""
base AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey AS DOUBLE) AS x2, p_retailprice AS y,
                CAST(CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || 'cv'), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
         FROM part WHERE {HASH5.format(k='p_partkey')} < 4)""")

SQL["perm_importance"] = f"""
WITH RECURSIVE {_PERM_BASE},
te AS (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_partkey AS DOUBLE) AS x2, p_retailprice AS y,
              row_number() OVER (ORDER BY CAST(('0x' || substr(md5(p_partkey || ':rows:42'), 1, 15)) AS BIGINT), p_partkey) - 1 AS i
       FROM part WHERE {HASH5.format(k='p_partkey')} >= 4),
size0 AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM te),
size AS (SELECT n, a, (n + a - 1) // a AS b FROM size0),
starts AS (SELECT i, rep, n, a, b FROM te, size, range(10) t(rep)),
walk AS (SELECT * FROM ({_partner_sql('starts', 'i', 's')}) f0
         UNION ALL SELECT * FROM ({_partner_sql('(SELECT * FROM walk WHERE x >= n) again', 'x', 'w')}) f1),
pairs AS (SELECT w.rep, te.y, te.x1, te.x2, d.x1 AS d1, d.x2 AS d2
          FROM walk w JOIN te USING (i) JOIN te d ON d.i = w.x WHERE w.x < w.n),
frames AS (SELECT 'p_size' AS feature, rep, y, d1 AS x1, x2 FROM pairs
           UNION ALL SELECT 'p_partkey', rep, y, x1, d2 FROM pairs
           UNION ALL SELECT '', 0, y, x1, x2 FROM te),
e AS (SELECT feature, rep, y, y - (b + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2) AS e FROM frames, fin2, st),
r2 AS (SELECT feature, rep, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY feature, rep),
drops AS (SELECT q.feature, base.r2 - q.r2 AS d FROM r2 q, (SELECT r2 FROM r2 WHERE feature = '') base WHERE q.feature <> '')
SELECT feature, {R('avg(d)')} AS importance_mean, {R('stddev_pop(d)')} AS importance_std, CAST(count(*) AS BIGINT) AS repeats
FROM drops GROUP BY feature"""


SQL["corr_wide"] = f"""
WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT 'e' || a.i AS col_a, 'e' || b.i AS col_b,
       {R('CASE WHEN a.i = b.i THEN (CASE WHEN stddev_pop(a.v) > 0 THEN 1.0 END) ELSE corr(a.v, b.v) END')} AS corr
FROM l a JOIN l b USING (vec_id) GROUP BY a.i, b.i"""

SQL["trend_pixels"] = f"""
WITH e AS ({EV}),
s AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM e),
p AS (SELECT ts, event_id, value, k,
             CAST(least(floor((epoch_us(ts) - CAST(a AS DOUBLE)) / CAST(z - a AS DOUBLE) * 200), 199) AS INTEGER) AS pixel FROM e, s),
l AS (SELECT 'value' AS metric, pixel, ts, event_id, value AS v FROM p WHERE value IS NOT NULL
      UNION ALL SELECT 'k', pixel, ts, event_id, k FROM p WHERE k IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, pixel ORDER BY ts, event_id) AS f,
             row_number() OVER (PARTITION BY metric, pixel ORDER BY ts DESC, event_id DESC) AS b,
             row_number() OVER (PARTITION BY metric, pixel ORDER BY v, ts, event_id) AS lo,
             row_number() OVER (PARTITION BY metric, pixel ORDER BY v DESC, ts, event_id) AS hi FROM l)
""" + "\nUNION ALL ".join(f"""SELECT metric, pixel, '{role}' AS role, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, {R('v')} AS value
FROM r WHERE {rank} = 1""" for role, rank in (("first", "f"), ("last", "b"), ("lowest", "lo"), ("highest", "hi")))

_SAMPLE = f"""
sample AS (SELECT event_type, event_id, value, k FROM ({EV}) e
           QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':42'), event_id) <= 500)"""

SQL["pair_sample"] = f"""
WITH {_SAMPLE}
SELECT event_type, event_id, 'value' AS col_x, 'k' AS col_y, {R('value')} AS x, {R('k')} AS y FROM sample
UNION ALL SELECT event_type, event_id, 'k', 'value', {R('k')}, {R('value')} FROM sample"""


def _density_sql(source: str, by: list[str], grid: int, cut: float = 0.0, extra: str = "") -> str:
    """A density of ``v`` per group from 4096 bins, drawn ``cut`` bandwidths beyond the data."""
    keys = ", ".join(by)
    x = f"(lo + (hi - lo) / {grid - 1} * p)"
    u = f"(({x} - v) / bw)"
    return f"""
WITH {extra}e0 AS ({source}),
s AS (SELECT {keys}, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo0, max(v) AS hi0 FROM e0 GROUP BY {keys}),
s2 AS (SELECT *, sd * pow(n, -0.2) AS bw FROM s),
s3 AS (SELECT *, lo0 - {cut} * bw AS lo, hi0 + {cut} * bw AS hi FROM s2),
e AS (SELECT {keys}, avg(v) AS v, count(*) AS w
      FROM (SELECT e0.*, least(floor((v - lo0) / ((hi0 - lo0) / 4096)), 4095) AS b FROM e0 JOIN s3 USING ({keys})) GROUP BY {keys}, b),
g AS (SELECT range AS p FROM range({grid})),
acc AS (SELECT {keys}, p, n, lo, hi, bw, sum(w * exp(-0.5 * {u} * {u})) AS sm FROM e JOIN s3 USING ({keys}), g GROUP BY ALL)
SELECT {keys}, CAST(p AS INTEGER) AS point, {R(x)} AS x, {R('sm / (n * bw * sqrt(2 * pi()))')} AS density,
       CAST(n AS BIGINT) AS n FROM acc"""


SQL["violin_density"] = _density_sql("SELECT l_returnflag, l_linestatus, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL",
                                     ["l_returnflag", "l_linestatus"], 100, 2.0)
SQL["pair_diagonal"] = _density_sql("""SELECT event_type, 'value' AS col_x, value AS v FROM sample WHERE value IS NOT NULL
UNION ALL SELECT event_type, 'k', k FROM sample WHERE k IS NOT NULL""", ["event_type", "col_x"], 50, 0.0, _SAMPLE + ",\n")

SQL["run_records"] = f"""
WITH {_SPLIT},
e AS (SELECT 'user_' || (p_size % 3) AS username, p_retailprice AS y, b0 + w * p_partkey AS p FROM te, m)
SELECT username, '2024-05-01 12:30:45' AS at, 'Predict' AS mode, CAST(count(*) AS BIGINT) AS rows, 'te.csv' AS file,
       'models/ols' AS model_name, {RK('avg(p)')} AS mean_pred, CAST(count(p) AS BIGINT) AS scores,
       CAST(NULL AS DOUBLE) AS r2, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse FROM e GROUP BY username
UNION ALL
SELECT 'user_b', '2024-05-01 12:30:45', 'Benchmark', CAST(count(*) AS BIGINT), 'te.csv', 'models/ols', NULL, NULL,
       {RK('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')}, {RK('avg(abs(y - p))')}, {RK('sqrt(avg((y - p) * (y - p)))')} FROM e"""
