"""DuckDB SQL for the library's own queries, put together from named steps.

Least squares are Gauss-Jordan eliminations of the normal equations, folded over the matrix as a nested list.
"""

from __future__ import annotations

#: Starts of the blocks of the fixed bootstrap.
STARTS = [0, 17, 250, 400, 33, 33, 480, 121]

#: Parameters of the network model at which its R2 is compared.
THETA = [0.01, -0.5, 0.1, 0.3, 0.02, 0.2, -0.1]

E_HOUR = "p0 AS (SELECT date_trunc('hour', ts) AS ts, event_type AS asset, avg(value) AS price FROM events WHERE value > 0 GROUP BY ALL)"
L_DAY = """p0 AS (SELECT date_trunc('day', l_shipdate) AS ts, r_name AS asset, avg(l_extendedprice) AS price FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_extendedprice > 0 GROUP BY ALL)"""
B_WEEK = """p0 AS (SELECT date_trunc('week', l_shipdate) AS ts, p_brand AS asset, avg(l_extendedprice) AS price FROM lineitem
  JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 GROUP BY ALL)"""
O_DAY = "SELECT date_trunc('day', o_orderdate) AS ts, o_orderpriority AS asset, avg(o_totalprice) AS price FROM orders WHERE o_totalprice > 0 GROUP BY ALL"

#: From p0: complete timestamps, numbered; returns r(rn, ts, asset, r); assets ord(asset, o) from 0; size(t).
RETURNS = """full_ts AS (SELECT ts FROM p0 GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT asset) FROM p0)),
num AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pn FROM full_ts),
pn AS (SELECT p0.*, num.pn FROM p0 JOIN num USING (ts)),
r AS (SELECT a.pn - 1 AS rn, a.ts, a.asset, ln(a.price / b.price) AS r FROM pn a JOIN pn b ON a.asset = b.asset AND a.pn = b.pn + 1),
ord AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS o FROM (SELECT DISTINCT asset FROM r)),
size AS (SELECT count(DISTINCT rn) AS t FROM r)"""


def chunked(n: int) -> str:
    """rw(w, rn, ts, asset, r): r in n chunks of equal size."""
    return f"""rw AS (SELECT CASE WHEN rn < (t % {n}) * (t // {n} + 1) THEN rn // (t // {n} + 1)
  ELSE t % {n} + (rn - (t % {n}) * (t // {n} + 1)) // greatest(t // {n}, 1) END AS w, r.* FROM r, size)"""


def windowed(size: int) -> str:
    return f"rw AS (SELECT rn // {size} AS w, r.* FROM r, size WHERE rn // {size} < t // {size})"


WHOLE = "rw AS (SELECT 0 AS w, r.* FROM r)"
#: Each pair once, and mirrored, so that ties are equal.
CORR0 = """pair AS MATERIALIZED (SELECT a.asset AS s, b.asset AS t, corr(a.r, b.r) AS rho FROM r a JOIN r b USING (rn) WHERE a.asset < b.asset GROUP BY a.asset, b.asset),
corr AS MATERIALIZED (SELECT s AS src, t AS tgt, rho FROM pair UNION ALL SELECT t, s, rho FROM pair UNION ALL SELECT asset, asset, 1.0 FROM ord)"""


def masked(q: float) -> str:
    """mask(src, tgt, rho) of corr."""
    return f"mask AS (SELECT * FROM corr WHERE abs(rho) > (SELECT quantile_cont(abs(rho), {q}) FROM corr))"


def chunk_masked(lag: int, q: float) -> str:
    """mask(w, src, tgt, rho) of rw's lagged correlations in each w."""
    return f"""wcorr AS (SELECT y.w, x.asset AS src, y.asset AS tgt, corr(x.r, y.r) AS rho FROM rw x JOIN rw y ON x.w = y.w AND y.rn = x.rn + {lag} GROUP BY ALL),
mask AS (SELECT c.* FROM wcorr c JOIN (SELECT w, quantile_cont(abs(rho), {q}) AS cut FROM wcorr GROUP BY w) USING (w) WHERE abs(rho) > cut)"""


ALL_MASK = "amask AS (SELECT DISTINCT w, a.asset AS src, b.asset AS tgt FROM rw, ord a, ord b)"
SAME_MASK = "amask AS (SELECT DISTINCT w, src, tgt FROM rw, mask)"
OWN_MASK = "amask AS (SELECT w, src, tgt FROM mask)"


def solved(lags: list[int]) -> str:
    """sol(w, tgt, lag, src, b) with lag 0 and src 'const' for intercepts; needs rw, ord and amask. design and yy are its inputs."""
    top = max(lags)
    listed = ", ".join(f"({k})" for k in lags)
    return f"""lags(lag) AS (VALUES {listed}),
yy AS (SELECT y.w, y.asset AS tgt, y.rn, y.r AS v FROM rw y WHERE EXISTS (SELECT 1 FROM rw b WHERE b.w = y.w AND b.rn = y.rn - {top} AND b.asset = y.asset)),
terms AS (SELECT w, tgt, lag, src, 1 + row_number() OVER (PARTITION BY w, tgt ORDER BY lag, src) AS i FROM amask, lags
  UNION ALL SELECT DISTINCT w, tgt, 0, 'const', 1 FROM yy),
late AS (SELECT w, asset AS src, lag, rn + lag AS rn, r FROM rw, lags),
design AS (SELECT y.w, y.tgt, y.rn, t.i, x.r AS v FROM yy y JOIN late x ON x.w = y.w AND x.rn = y.rn JOIN terms t ON t.w = y.w AND t.tgt = y.tgt AND t.lag = x.lag AND t.src = x.src
  UNION ALL SELECT w, tgt, rn, 1, 1.0 FROM yy),
gram AS (SELECT a.w, a.tgt, a.i, b.i AS j, sum(a.v * b.v) AS v FROM design a JOIN design b ON a.w = b.w AND a.tgt = b.tgt AND a.rn = b.rn GROUP BY ALL
  UNION ALL SELECT d.w, d.tgt, d.i, 0, sum(d.v * y.v) FROM design d JOIN yy y ON d.w = y.w AND d.tgt = y.tgt AND d.rn = y.rn GROUP BY ALL),
sizes AS (SELECT w, tgt, max(i) AS m FROM terms GROUP BY ALL),
lines AS (SELECT w, tgt, i, list(v ORDER BY CASE WHEN j = 0 THEN 1000000 ELSE j END) AS line FROM gram GROUP BY ALL),
mats AS (SELECT w, tgt, max(i) AS m, list(line ORDER BY i) AS a FROM lines GROUP BY ALL),
done AS (SELECT w, tgt, m, list_reduce(list_prepend(a, list_transform(range(1, m + 1), lambda k: [[k::DOUBLE]])), lambda q, e: list_transform(q, lambda line, i:
  CASE WHEN i = e[1][1] THEN list_transform(line, lambda x: x / line[e[1][1]::BIGINT])
  ELSE list_transform(line, lambda x, j: x - line[e[1][1]::BIGINT] * q[e[1][1]::BIGINT][j] / q[e[1][1]::BIGINT][e[1][1]::BIGINT]) END)) AS a FROM mats),
gj AS (SELECT w, tgt, i, a[i][m + 1] AS v FROM (SELECT w, tgt, m, a, unnest(range(1, m + 1)) AS i FROM done)),
sol AS (SELECT g.w, g.tgt, t.lag, t.src, g.v AS b FROM gj g JOIN terms t ON t.w = g.w AND t.tgt = g.tgt AND t.i = g.i),
coefs AS (SELECT k.w, k.lag, k.src, k.tgt, k.src = 'const' AND k.lag = 0 AS is_const, coalesce(s.b, 0) AS coef
  FROM (SELECT DISTINCT y.w, lag, o.asset AS src, y.tgt FROM (SELECT DISTINCT w, tgt FROM yy) y, ord o, lags UNION ALL SELECT DISTINCT w, 0, 'const', tgt FROM yy) k LEFT JOIN sol s USING (w, tgt, lag, src)),
fitted AS (SELECT d.w, d.tgt, d.rn, y.v AS y, sum(d.v * g.v) AS yhat FROM design d JOIN gj g ON g.w = d.w AND g.tgt = d.tgt AND g.i = d.i
  JOIN yy y ON y.w = d.w AND y.tgt = d.tgt AND y.rn = d.rn GROUP BY ALL),
stats AS (SELECT f.w, f.tgt, count(*) AS n, any_value(m) - 1 AS k, sum((y - yhat) ** 2) AS rss, var_pop(y) * count(*) AS tss FROM fitted f JOIN sizes USING (w, tgt) GROUP BY ALL)"""


def with_(*steps: str) -> str:
    return "WITH " + ",\n".join(steps) + "\n"


def r9(x: str, name: str) -> str:
    return f"round({x}, 9) + 0.0 AS {name}"


COEF = f"src, tgt, is_const, {r9('coef', 'coef')}"
R2 = "1 - rss / CASE WHEN tss > 0 THEN tss ELSE 1 END"


def oracle_sql() -> dict[str, str]:
    hour, day, week = (E_HOUR, RETURNS), (L_DAY, RETURNS), (B_WEEK, RETURNS)
    mask6 = (*hour, CORR0, masked(0.6))
    whole6 = with_(*mask6, WHOLE, SAME_MASK, solved([1]))
    rolling = with_(*mask6, windowed(101), SAME_MASK, solved([1]))
    off = "off_diag AS (SELECT w, src, tgt, CASE WHEN src = tgt THEN 0 ELSE coef END AS coef FROM coefs WHERE NOT is_const)"
    links = "cuts AS (SELECT w, quantile_cont(abs(coef), 0.8) AS cut FROM off_diag WHERE abs(coef) > 1e-6 GROUP BY w)"
    ten = (*day, chunked(10), chunk_masked(1, 0.6), OWN_MASK, solved([1]))
    freq = "freq AS (SELECT src, tgt, avg((coef <> 0)::INT) AS freq, coalesce(avg(abs(coef)) FILTER (WHERE coef <> 0), 0) AS weight FROM coefs WHERE NOT is_const GROUP BY ALL)"
    edges = "edges AS (SELECT src, tgt AS dst, weight FROM freq WHERE freq > 0.35 AND src <> tgt)"
    upper = "up AS (SELECT c.rho FROM corr c JOIN ord a ON c.src = a.asset JOIN ord b ON c.tgt = b.asset WHERE a.o < b.o)"

    def scores(lags: list[int]) -> str:
        return f"""SELECT '{lags}' AS spec, {r9(f'avg(n * ln(rss / n) + (1 + 5 * {len(lags)}) * ln(n))', 'bic')}, {r9(f'avg(n * ln(rss / n) + 2 * (1 + 5 * {len(lags)}))', 'aic')},
  {r9(f'avg({R2})', 'r2_mean')}, {r9(f'median({R2})', 'r2_median')} FROM stats"""

    specs = [[1], [2], [3], [5], [8], [13], [1, 5]]
    all_scores = [f"({with_(*day, WHOLE, ALL_MASK, solved(k))}{scores(k)})" for k in specs]

    def sweep(q: float, n: int) -> str:
        return f"({with_(*day, chunked(n), chunk_masked(1, q), OWN_MASK, solved([1]))}SELECT {n}::BIGINT AS n_chunks, {q}::DOUBLE AS q, {r9(f'avg({R2})', 'r2')}, {r9('avg(k / (n - 1))', 'r2_null')}, {r9(f'avg({R2}) / greatest(avg(k / (n - 1)), 1e-12)', 'ratio')} FROM stats)"

    flat = (E_HOUR.replace("p0 AS", "pe AS"), "p0 AS (SELECT * FROM pe UNION ALL SELECT DISTINCT ts, 'flat', 2.5::DOUBLE FROM pe)", RETURNS)
    flat_corr = CORR0.replace("corr(a.r, b.r)", "CASE WHEN 'flat' IN (a.asset, b.asset) THEN NULL ELSE corr(a.r, b.r) END").replace("asset, asset, 1.0", "asset, asset, CASE WHEN asset <> 'flat' THEN 1.0 END")
    levels = L_DAY.replace("avg(l_extendedprice) AS price", "avg(l_extendedprice) + 1e7 AS price")
    numbered = "r AS (SELECT pn AS rn, ts, asset, price AS r FROM p0 JOIN num USING (ts))"
    as_levels = (levels, *RETURNS.split(",\n")[:2], numbered)

    def sweep_freq(q: float, n: int) -> str:
        return f"({with_(*day, chunked(n), chunk_masked(1, q), OWN_MASK, solved([1]))}SELECT {n}::BIGINT AS n_chunks, {q}::DOUBLE AS q, src, tgt, {r9('avg((coef <> 0)::INT)', 'freq')} FROM coefs WHERE NOT is_const GROUP BY src, tgt)"

    a0, a1, a2, b1, c0, c1, c2 = THETA
    node = "(SELECT sum(freq) FROM freq WHERE src = o.asset) + (SELECT sum(freq) FROM freq WHERE tgt = o.asset)"
    linked = "o.asset IN (SELECT src FROM edges UNION SELECT dst FROM edges)"
    degrees = "(SELECT count(*) FROM edges WHERE dst = o.asset) AS in_degree, (SELECT count(*) FROM edges WHERE src = o.asset) AS out_degree"
    r2_asset = f"r2 AS (SELECT tgt AS asset, CASE WHEN tss > 0 THEN 1 - rss / tss ELSE 0 END AS r2 FROM stats)"
    pooled = "pooled AS (SELECT tgt AS asset, 1 - var_pop(y - yhat) / nullif(var_pop(y), 0) AS r2 FROM fitted GROUP BY ALL)"
    return {
        "log_returns": with_(*hour) + f"SELECT rn, ts, asset, {r9('r', 'r')} FROM r",
        "panel_join_multi": with_(L_DAY.replace("p0 AS", "pa AS"), f"pb AS ({O_DAY})", "p0 AS (SELECT * FROM pa WHERE ts IN (SELECT ts FROM pb) UNION ALL SELECT * FROM pb WHERE ts IN (SELECT ts FROM pa))", RETURNS) + f"SELECT rn, ts, asset, {r9('r', 'r')} FROM r",
        "asset_sectors": """WITH b AS (SELECT DISTINCT p_brand AS asset, substr(p_brand, 7, 1) AS g FROM part),
s AS (SELECT asset, CASE WHEN g = '1' THEN 'Crypto' WHEN g = '2' THEN 'US ETF' WHEN g <> '5' THEN 'group ' || g END AS sector FROM b)
SELECT asset, sector, CASE WHEN sector = 'Crypto' THEN 'crypto' WHEN sector = 'US ETF' THEN 'etf' ELSE 'stock' END AS category, row_number() OVER (ORDER BY coalesce(sector, ''), asset) - 1 AS ord FROM s""",
        "corr_lag0": with_(*hour, CORR0) + f"SELECT src, tgt, {r9('rho', 'rho')} FROM corr",
        "corr_pairwise": with_(*hour, CORR0) + f"SELECT src, tgt, {r9('rho', 'rho')} FROM corr",
        "corr_lagk": with_(*day) + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, x.asset AS src, y.asset AS tgt, {r9('corr(x.r, y.r)', 'rho')} FROM r x JOIN r y ON y.rn = x.rn + {k} GROUP BY ALL" for k in (1, 13)),
        "autocorr1": with_(*day) + f"SELECT x.asset, {r9('corr(x.r, y.r)', 'rho')} FROM r x JOIN r y ON y.rn = x.rn + 1 AND x.asset = y.asset GROUP BY ALL",
        "corr_summary": with_(*week, CORR0, upper) + f"SELECT {r9('avg(abs(rho))', 'mean_abs')}, {r9('stddev_pop(rho)', 'std')}, {r9('max(abs(rho))', 'max_abs')} FROM up",
        "corr_mask": with_(*mask6) + f"SELECT src, tgt, {r9('rho', 'rho')} FROM mask",
        "mask_source_counts": with_(*mask6) + "SELECT tgt, count(*) AS n FROM mask GROUP BY tgt",
        "corr_mask_chunk": with_(*day, chunked(5), chunk_masked(1, 0.6)) + f"SELECT w AS window_id, src, tgt, {r9('rho', 'rho')} FROM mask",
        "var_diag": with_(*day) + f"SELECT x.asset, {r9('regr_slope(y.r, x.r)', 'a')}, {r9('regr_intercept(y.r, x.r)', 'c')}, {r9('regr_r2(y.r, x.r)', 'r2')} FROM r x JOIN r y ON y.rn = x.rn + 1 AND x.asset = y.asset GROUP BY ALL",
        "var_masked": whole6 + f"SELECT {COEF} FROM coefs",
        "var_masked_by_sums": whole6 + f"SELECT {COEF} FROM coefs",
        "var_no_source": with_(*hour, WHOLE, "amask AS (SELECT 0 AS w, '' AS src, '' AS tgt WHERE false)", solved([1])) + f"SELECT {COEF} FROM coefs",
        "var_full_p2": with_(*day, WHOLE, ALL_MASK, solved([1, 2])) + f"SELECT lag::BIGINT AS lag, {COEF} FROM coefs",
        "var_subset": with_(*day, WHOLE, ALL_MASK, solved([1, 5])) + f"SELECT lag::BIGINT AS lag, {COEF} FROM coefs",
        "var_sigma": with_(*day, WHOLE, ALL_MASK, solved([1])) + f"SELECT a.tgt AS a, b.tgt AS b, {r9('sum((a.y - a.yhat) * (b.y - b.yhat)) / (count(*) - 6)', 'sigma')} FROM fitted a JOIN fitted b USING (rn) GROUP BY ALL",
        "coef_norms": with_(*day, WHOLE, ALL_MASK, solved([1])) + f"""SELECT {r9('sqrt(sum(coef ** 2))', 'fro')}, {r9('sqrt(sum(coef ** 2) FILTER (WHERE src = tgt))', 'fro_diag')}, {r9('sqrt(sum(coef ** 2) FILTER (WHERE src <> tgt))', 'fro_off')},
  {r9('avg(abs(coef))', 'mean_abs')}, {r9('max(abs(coef))', 'max_abs')}, {r9('avg((abs(coef) > 0.05)::INT)', 'share_large')} FROM coefs WHERE NOT is_const""",
        "var_predictions": whole6 + f"SELECT rn, tgt, {r9('y', 'y')}, {r9('yhat', 'yhat')} FROM fitted",
        "r2_per_asset": whole6.rstrip() + f",\n{r2_asset}\nSELECT asset, {r9('r2', 'r2')} FROM r2",
        "r2_per_category": whole6.rstrip() + f",\n{r2_asset},\nkinds(asset, category) AS (VALUES ('click', 'web'), ('view', 'web'), ('purchase', 'shop'), ('signup', NULL))\nSELECT category, {r9('avg(r2)', 'r2')} FROM r2 JOIN kinds USING (asset) WHERE category IS NOT NULL GROUP BY ALL",
        "rolling_coefs": rolling + f"SELECT w AS window_id, {COEF} FROM coefs",
        "rolling_windows": with_(*hour, windowed(101)) + "SELECT w AS window_id, min(ts) AS start_ts, max(ts) AS end_ts, count(DISTINCT rn) AS n_rows FROM rw GROUP BY w",
        "rolling_interval": with_(*mask6) + 'SELECT greatest(2 * max(n), 1)::BIGINT AS "interval" FROM (SELECT count(*) AS n FROM mask GROUP BY tgt)',
        "rolling_r2": rolling.rstrip() + f",\n{pooled}\nSELECT asset, {r9('r2', 'r2')} FROM pooled",
        "rolling_r2_total": rolling.rstrip() + f",\n{pooled}\nSELECT {r9('avg(r2)', 'r2')} FROM pooled",
        "activation_freq": rolling.rstrip() + f",\n{off},\n{links}\nSELECT src, tgt, {r9('avg(coalesce(abs(coef) >= cut, false)::INT)', 'freq')} FROM off_diag LEFT JOIN cuts USING (w) GROUP BY ALL",
        "mean_magnitude": rolling.rstrip() + f",\n{off}\nSELECT src, tgt, {r9('avg(coef)', 'magnitude')} FROM off_diag GROUP BY ALL",
        "magnitude_stats": rolling.rstrip() + f",\n{off},\nmag AS (SELECT src, tgt, avg(coef) AS m FROM off_diag GROUP BY ALL)\nSELECT {r9('avg(m)', 'mean')}, {r9('min(m)', 'min')}, {r9('max(m)', 'max')}, count(*) FILTER (WHERE abs(m) < 1e-6) AS n_small FROM mag",
        "sparse_fit_stats": with_(*day, chunked(5), chunk_masked(1, 0.6), OWN_MASK, solved([1])) + f"SELECT w AS window_id, tgt, k::BIGINT AS n_active, {r9(R2, 'r2')}, {r9('k / (n - 1)', 'r2_null')} FROM stats",
        "sparse_fit_full": with_(*day, WHOLE, chunk_masked(13, 0.6), OWN_MASK, solved([13])) + f"SELECT {r9(f'avg({R2})', 'r2')}, {r9('avg(k / (n - 1))', 'r2_null')}, {r9(f'avg({R2}) / greatest(avg(k / (n - 1)), 1e-12)', 'ratio')} FROM stats",
        "sparse_sweep": " UNION ALL ".join(sweep(q, n) for q in (0.55, 0.7) for n in (2, 5)),
        "chunk_freq": with_(*ten, freq) + f"SELECT src, tgt, {r9('freq', 'freq')} FROM freq",
        "freq_hist": with_(*ten, freq) + "SELECT l AS level, count(f.src) AS n_edges FROM range(1, 11) g(l) LEFT JOIN freq f ON round(f.freq * 10) = l AND f.freq > 0 GROUP BY l",
        "lag_scores": " UNION ALL ".join(all_scores),
        "best_lag": f"SELECT * FROM ({' UNION ALL '.join(all_scores[:6])}) ORDER BY bic, spec LIMIT 1",
        "graph_edges": with_(*ten, freq, edges) + f"SELECT src, dst, {r9('weight', 'weight')} FROM edges",
        "graph_nodes": with_(*ten, freq, edges) + f"""SELECT o.asset, 'autre' AS sector, {r9('(SELECT sum(freq) FROM freq WHERE src = o.asset) + (SELECT sum(freq) FROM freq WHERE tgt = o.asset)', 'freq')},
  (SELECT count(*) FROM edges WHERE dst = o.asset) AS in_degree, (SELECT count(*) FROM edges WHERE src = o.asset) AS out_degree
  FROM ord o WHERE o.asset IN (SELECT src FROM edges UNION SELECT dst FROM edges)""",
        "graph_density": with_(*ten, freq, edges) + f"SELECT n AS n_nodes, e AS n_edges, {r9('e / greatest(n * (n - 1), 1)', 'density')} FROM (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)), (SELECT count(*) AS e FROM edges)",
        "graph_sizes": with_(*ten, freq, edges) + f"SELECT src, dst, {r9('weight', 'weight')}, {r9('0.3 + 3.5 * weight / max(weight) OVER ()', 'width')} FROM edges",
        "log_returns_flat": with_(*flat) + f"SELECT rn, ts, asset, {r9('r', 'r')} FROM r",
        "corr_flat": with_(*flat, flat_corr) + f"SELECT src, tgt, {r9('rho', 'rho')} FROM corr",
        "corr_mask_flat": with_(*flat, flat_corr, masked(0.6)) + f"SELECT src, tgt, {r9('rho', 'rho')} FROM mask",
        "corr_levels": with_(*as_levels) + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, x.asset AS src, y.asset AS tgt, {r9('corr(x.r - 1e7, y.r - 1e7)', 'rho')} FROM r x JOIN r y ON y.rn = x.rn + {k} GROUP BY ALL" for k in (0, 1)),
        "several_lag_scores": all_scores[-1],
        "sweep_freq": " UNION ALL ".join(sweep_freq(q, n) for q in (0.55, 0.7) for n in (2, 5)),
        "chunk_freq_by_sums": with_(*ten, freq) + f"SELECT src, tgt, {r9('freq', 'freq')} FROM freq",
        "graph_sectors": with_(*ten, freq, edges) + f"SELECT o.asset, CASE WHEN o.asset < 'AS' THEN 'south' WHEN o.asset > 'EZ' THEN 'east' ELSE 'autre' END AS sector, {r9(node, 'freq')}, {degrees} FROM ord o WHERE {linked}",
        "graph_node_sizes": with_(*ten, freq, edges, f"f AS (SELECT o.asset, {node} AS freq, {degrees} FROM ord o WHERE {linked})") + f"SELECT asset, 'autre' AS sector, {r9('freq', 'freq')}, in_degree, out_degree, {r9('50 + 800 * freq / max(freq) OVER ()', 'size')} FROM f",
        "dynamics_given": with_(*hour, "n AS (SELECT count(*) AS n FROM ord)") + f"""SELECT CASE WHEN x.rn < floor((t - 1) * 0.9) THEN 'train' ELSE 'test' END AS split,
  {r9(f'1 - sum((y.r - ({a0} + {a1} * x.r + {a2} * x.r ** 2 + (1 + {b1} * x.r) * 0.5 * ({c0} + {c1} * z.r + {c2} * z.r ** 2))) ** 2) / (var_pop(y.r) * count(*))', 'r2')}
  FROM r x JOIN ord o USING (asset) JOIN ord p ON p.o = (o.o + 1) % (SELECT n FROM n) JOIN r z ON z.asset = p.asset AND z.rn = x.rn JOIN r y ON y.asset = x.asset AND y.rn = x.rn + 1, size GROUP BY 1""",
        "csv_round_trip": with_(*hour) + f"SELECT rn, ts, asset, {r9('r', 'r')} FROM r",
        "rolling_cached": rolling + f"SELECT w AS window_id, {COEF} FROM coefs",
        "roll_vol": with_(*day) + f"SELECT rn, ts, {r9('avg(sd)', 'vol')} FROM (SELECT rn, ts, CASE WHEN count(r) OVER w = 50 THEN stddev_samp(r) OVER w END AS sd FROM r WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 49 PRECEDING)) GROUP BY ALL",
        "bday_resample": with_(*day, """d AS (SELECT *, date_diff('day', DATE '1970-01-05', ts::DATE) AS g FROM r),
e AS (SELECT *, (g // 7) * 5 + least(g % 7, 4) AS o FROM d), f AS (SELECT *, min(o) OVER () AS o0 FROM e), h AS (SELECT *, (o - o0) // 3 AS bin FROM f),
l AS (SELECT asset, bin, any_value(o0) AS o0, max_by(r, rn) AS v FROM h GROUP BY ALL), c AS (SELECT a.bin, a.asset, a.o0, a.v - b.v AS r FROM l a JOIN l b ON a.asset = b.asset AND a.bin = b.bin + 1)""")
        + f"SELECT (DATE '1970-01-05' + ((any_value(o0) + bin * 3) // 5 * 7 + (any_value(o0) + bin * 3) % 5)::INT)::DATE AS bin_ts, {r9('avg(r)', 'r')} FROM c GROUP BY bin HAVING count(*) = (SELECT count(*) FROM ord)",
        "hist_corr": with_(*week, CORR0, upper, "b AS (SELECT least(floor((rho + 0.2) / (1.2 / 79)), 78)::BIGINT AS bin FROM up WHERE rho BETWEEN -0.2 AND 1.0)")
        + f"SELECT g AS bin, {r9('count(b.bin) / ((SELECT count(*) FROM b) * (1.2 / 79))', 'density')} FROM range(79) t(g) LEFT JOIN b ON b.bin = g GROUP BY g",
        "block_boot_fixed": with_(*hour, f"s(b, start) AS (VALUES {', '.join(f'({i}, {s})' for i, s in enumerate(STARTS))})") + f"SELECT (b * 20 + k)::BIGINT AS rn, asset, {r9('r', 'r')} FROM s, range(20) g(k) JOIN r ON r.rn = start + k",
        "train_test_split": with_(*hour) + "SELECT CASE WHEN rn < floor(t * 0.9) THEN 'train' ELSE 'test' END AS split, count(DISTINCT rn) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r, size GROUP BY ALL",
        "chunk_start_months": with_(*day, chunked(7)) + "SELECT w AS window_id, min_by(ts, rn) AS ts, strftime(min_by(ts, rn), '%Y-%m') AS month FROM rw GROUP BY w",
    }
