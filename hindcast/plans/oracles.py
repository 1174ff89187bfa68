"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

from hindcast.config import RISK, SPLITS, STATE, WEIGHTS
from hindcast.operators.models import RANDOM_SEED
from hindcast.plans.queries import K, SIZE
from hindcast.plans.suites import registry
from hindcast.sources.synthetic import regions_sql

PANEL = f"""
a AS (SELECT l_shipdate::DATE AS date, round(sum(l_extendedprice * (1 - l_discount)), 4) AS px_a FROM lineitem GROUP BY 1),
b AS (SELECT o_orderdate::DATE AS date, round(sum(o_totalprice), 2) AS px_b, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
ab AS (SELECT date, px_a, last_value(px_b IGNORE NULLS) OVER w AS px_b, last_value(n_orders IGNORE NULLS) OVER w AS n_orders FROM a LEFT JOIN b USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, (row_number() OVER w - 1)::BIGINT AS pos, {WEIGHTS[0]}::DOUBLE * (px_a / lag(px_a) OVER w - 1) + {WEIGHTS[1]}::DOUBLE * (px_b / lag(px_b) OVER w - 1) AS ret FROM ab WHERE px_b IS NOT NULL WINDOW w AS (ORDER BY date)),
panel AS (SELECT *, -ret AS loss, -lead(ret) OVER (ORDER BY pos) AS next_loss FROM r)"""
STATES = PANEL + """,
g AS (SELECT *, px_a / lag(px_a) OVER (ORDER BY pos) AS g FROM panel),
state AS (SELECT * EXCLUDE (g), CASE WHEN count(ret) OVER w = 20 THEN stddev_pop(ret) OVER w * sqrt(252) END AS rv20, CASE WHEN count(ret) OVER w = 20 THEN product(g) OVER w - 1 END AS ret20,
  n_orders AS level, n_orders - lag(n_orders, 5) OVER (ORDER BY pos) AS delta5, px_a / px_b AS ratio FROM g WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _windows(z: bool = False) -> str:
    w = f", w0 AS (SELECT pos, date, next_loss, list(ret) OVER (ORDER BY pos ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS w, count(ret) OVER (ORDER BY pos ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS c FROM panel)"
    value = "list_transform(w, lambda x: (x - list_avg(w)) / CASE WHEN list_stddev_pop(w) > 1e-8 THEN list_stddev_pop(w) ELSE 1 END)" if z else "w"
    return w + f", w AS (SELECT pos, date, next_loss, {value} AS w FROM w0 WHERE c = {SIZE})"


def _nn(k: int = K, radius: int = 0, z: bool = False, name: str = "nn", first: bool = True) -> str:
    head = _windows(z) if first else ""
    return head + f""", {name} AS (SELECT q.pos AS t, c.pos AS s, list_distance(q.w, c.w) AS d, c.next_loss AS loss, row_number() OVER (PARTITION BY q.pos ORDER BY list_distance(q.w, c.w), c.pos) AS rank
  FROM w q JOIN w c ON c.pos <= q.pos - {radius} - 1 WHERE q.date >= DATE '{SPLITS.test}' QUALIFY rank <= {k})"""


def _risk(source: str, name: str = "risk") -> str:
    return f""", {name}_q AS (SELECT *, quantile_cont(loss, {RISK.es}) OVER (PARTITION BY t) AS q FROM {source} WHERE loss IS NOT NULL),
{name} AS (SELECT t, count(*)::BIGINT AS n, quantile_cont(loss, {RISK.var}) AS var, avg(loss) FILTER (loss >= q) AS es FROM {name}_q GROUP BY t)"""


PINBALL = f"CASE WHEN next_loss >= var THEN {RISK.var}::DOUBLE * (next_loss - var) ELSE (1 - {RISK.var}::DOUBLE) * (var - next_loss) END"
FZ0 = f"CASE WHEN es > 0 THEN CASE WHEN next_loss > var THEN (next_loss - var) / ((1 - {RISK.es}::DOUBLE) * es) ELSE 0 END + var / es + ln(es) - 1 END"


def _scored(source: str = "risk", name: str = "scored", panel: str = "panel") -> str:
    return f", {name} AS (SELECT f.*, date, next_loss, {PINBALL} AS pinball, {FZ0} AS fz0, (next_loss > var)::INT::DOUBLE AS hit FROM {source} f JOIN {panel} ON t = pos WHERE next_loss IS NOT NULL)"


def _forecasts(before: str) -> str:
    r = lambda c: f"round({c}, 8) + 0.0 AS {c}"
    return f"WITH {before}{_risk('nn')}{_scored()} SELECT t, n, {r('var')}, {r('es')}, date, {r('next_loss')}, {r('pinball')}, {r('fz0')}, hit FROM scored"


def _state_nn(radius: int) -> str:
    """Each coordinate by the moments of the query's eligible history."""
    good = " AND ".join(f"{c} IS NOT NULL" for c in STATE)
    by = f"(ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND {radius + 1} PRECEDING)"
    kept = ", ".join(f"CASE WHEN {good} THEN {c} END AS {c}" for c in STATE)
    moments = ", ".join(f"avg({c}) OVER {by} AS m_{c}, stddev_pop({c}) OVER {by} AS s_{c}" for c in STATE)
    terms = " + ".join(f"power((c.{c} - q.{c}) / CASE WHEN q.s_{c} > 1e-8 THEN q.s_{c} ELSE 1 END, 2)" for c in STATE)
    return f""", v AS (SELECT pos, date, next_loss, {kept} FROM state), m AS (SELECT *, {moments} FROM v),
nn AS (SELECT q.pos AS t, c.pos AS s, c.next_loss AS loss, row_number() OVER (PARTITION BY q.pos ORDER BY {terms}, c.pos) AS rank FROM m q JOIN v c ON c.pos <= q.pos - {radius} - 1 AND c.ratio IS NOT NULL
  WHERE q.date >= DATE '{SPLITS.test}' AND q.ratio IS NOT NULL QUALIFY rank <= {K})"""


def _mahalanobis() -> str:
    """Covariances of the query's eligible history, factored column by column; a distance is that of the solved differences."""
    n, good = len(STATE), " AND ".join(f"{c} IS NOT NULL" for c in STATE)
    by = "(ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    kept = ", ".join(f"CASE WHEN {good} THEN {c} END AS x{i}" for i, c in enumerate(STATE))
    scales = ", ".join(f"CASE WHEN stddev_pop(x{i}) OVER {by} > 1e-8 THEN stddev_pop(x{i}) OVER {by} ELSE 1 END AS s{i}" for i in range(n))
    covs = ", ".join(f"covar_pop(x{i}, x{j}) OVER {by} AS c{i}{j}" for i in range(n) for j in range(i + 1))
    factor = []
    for j in range(n):
        for i in range(j, n):
            a = f"c{i}{j} / (s{i} * s{j})" + (" + 1e-6" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            factor.append(f"sqrt({a}) AS l{i}{j}" if i == j else f"({a}) / l{j}{j} AS l{i}{j}")
    solved = ", ".join(f"((c.x{i} - q.x{i}) / q.s{i}" + "".join(f" - q.l{i}{k} * y{k}" for k in range(i)) + f") / q.l{i}{i} AS y{i}" for i in range(n))
    return f""", v AS (SELECT pos, date, next_loss, {kept} FROM state), m AS (SELECT *, {scales}, {covs} FROM v), f AS (SELECT *, {", ".join(factor)} FROM m WHERE date >= DATE '{SPLITS.test}' AND x0 IS NOT NULL),
y AS (SELECT q.pos AS t, c.pos AS s, c.next_loss AS loss, {solved} FROM f q JOIN v c ON c.pos < q.pos AND c.x0 IS NOT NULL),
nn AS (SELECT t, s, loss, row_number() OVER (PARTITION BY t ORDER BY {" + ".join(f"y{i} * y{i}" for i in range(n))}, s) AS rank FROM y QUALIFY rank <= {K})"""


def _random() -> str:
    """Eligible days by a hash of query and day."""
    good, mask = " AND ".join(f"{c} IS NOT NULL" for c in STATE), "4294967295::UBIGINT"
    return f""", v AS (SELECT pos, date, next_loss FROM state WHERE {good}), h0 AS (SELECT q.pos AS t, c.pos AS s, c.next_loss AS loss, ((q.pos * 2654435761 + c.pos + {RANDOM_SEED}) % 4294967296)::UBIGINT AS h FROM v q JOIN v c ON c.pos < q.pos WHERE q.date >= DATE '{SPLITS.test}'),
h1 AS (SELECT * REPLACE (((xor(h, h >> 16) * 2146121005::UBIGINT) & {mask}) AS h) FROM h0), h2 AS (SELECT * REPLACE (((xor(h, h >> 15) * 2221713035::UBIGINT) & {mask}) AS h) FROM h1),
nn AS (SELECT t, s, loss, row_number() OVER (PARTITION BY t ORDER BY xor(h, h >> 16), s) AS rank FROM h2 QUALIFY rank <= {K})"""


HS = ", known AS (SELECT pos, loss, row_number() OVER (ORDER BY pos) AS i FROM panel WHERE loss IS NOT NULL)"


def _hs(radius: int | None, name: str = "nn") -> str:
    gap = 0 if radius is None else radius + 1
    return f", {name}_at AS (SELECT p.pos AS t, (SELECT max(i) FROM known WHERE known.pos <= p.pos - {gap}) AS i FROM panel p WHERE date >= DATE '{SPLITS.test}'), {name} AS (SELECT t, loss FROM {name}_at a JOIN known k ON k.i <= a.i AND k.i > a.i - 250)"


def _regime(bins: int = 4) -> str:
    by = "OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    edges = ", ".join(f"quantile_cont(rv20, {i / bins}) {by} AS e{i}" for i in range(1, bins))
    label = lambda x: " + ".join(f"(q.e{i} < {x})::INT" for i in range(1, bins))
    return f""", q AS (SELECT pos, date, rv20, {edges} FROM state),
nn AS (SELECT q.pos AS t, s.next_loss AS loss FROM q JOIN state s ON s.pos < q.pos AND s.rv20 IS NOT NULL AND s.next_loss IS NOT NULL AND {label('s.rv20')} = {label('q.rv20')} WHERE q.date >= DATE '{SPLITS.test}')"""


EWMA = f""", known AS (SELECT pos, date, ret, row_number() OVER (ORDER BY pos) AS i FROM panel WHERE ret IS NOT NULL),
sig AS (SELECT k.pos, k.i, ret, f.s AS s FROM known k, (WITH RECURSIVE f AS (
  SELECT 1::BIGINT AS i, (SELECT stddev_pop(ret) FROM known WHERE i <= 20) AS s
  UNION ALL SELECT f.i + 1, sqrt(0.94::DOUBLE * f.s * f.s + (1 - 0.94::DOUBLE) * k.ret * k.ret) FROM f JOIN known k ON k.i = f.i) SELECT * FROM f) f WHERE f.i = k.i),
ewma_at AS (SELECT g.pos AS t, sqrt(0.94::DOUBLE * g.s * g.s + (1 - 0.94::DOUBLE) * g.ret * g.ret) AS ahead FROM sig g JOIN panel USING (pos) WHERE date >= DATE '{SPLITS.test}')"""
EWMA_NN = ", nn AS (SELECT t, -h.ret / h.s * ahead AS loss FROM ewma_at JOIN sig h ON h.pos <= t)"




def _models() -> str:
    parts = [STATES, HS.replace("known", "hs_known")]
    for name, radius in (("rolling_hs", None), ("gap_hs", 125)):
        parts.append(_hs(radius, f"nn_{name}").replace("known", "hs_known") + _risk(f"nn_{name}", f"r_{name}"))
    parts.append(EWMA + EWMA_NN.replace("nn AS", "nn_fhs AS") + _risk("nn_fhs", "r_fhs_ewma"))
    parts.append(_nn(name="nn_window") + _risk("nn_window", "r_window_knn"))
    union = " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM r_{m}" for m in ("rolling_hs", "gap_hs", "fhs_ewma", "window_knn"))
    return "".join(parts) + f", every AS ({union})" + _scored("every", "s")


def _r(cols: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())


Z = ", ".join(f"CASE WHEN count({c}) OVER w >= 60 THEN round(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 6) + 0.0 END AS z_{c}" for c in STATE)
SQL = {
    "daily_panel": f"WITH {PANEL} SELECT pos, date, {_r('px_a px_b n_orders ret loss next_loss')} FROM panel",
    "hourly_panel": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(DISTINCT event_type) AS n_types, "
    + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "view", "purchase", "signup", "error"))
    + ", round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY 1",
    "state_panel": f"WITH {STATES} SELECT pos, {_r(' '.join(STATE))} FROM state",
    "expanding_zscores": f"WITH {STATES} SELECT pos, {Z} FROM state WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "splits": f"WITH {PANEL} SELECT CASE WHEN date >= DATE '{SPLITS.test}' THEN 'test' WHEN date >= DATE '{SPLITS.validation}' THEN 'validation' ELSE 'warmup' END AS split, count(*) AS n, min(date) AS first, max(date) AS last, round(avg(ret), 8) + 0.0 AS mean_ret, round(stddev_samp(ret), 8) + 0.0 AS sd_ret FROM panel GROUP BY 1",
    "window_knn_var": f"WITH {PANEL}{_nn()}{_risk('nn')}{_scored()} SELECT year(date)::BIGINT AS year, count(*) AS n, round(avg(var), 8) + 0.0 AS mean_var, round(avg(es), 8) + 0.0 AS mean_es, round(avg(pinball), 8) + 0.0 AS mean_pinball, round(avg(hit), 8) + 0.0 AS hit_rate FROM scored GROUP BY 1",
    "window_knn_forecasts": _forecasts(PANEL + _nn()),
    "window_knn_radius125": _forecasts(PANEL + _nn(radius=125)),
    "zwindow_knn_forecasts": _forecasts(PANEL + _nn(z=True)),
    "state_knn_forecasts": _forecasts(STATES + _state_nn(0)),
    "state_knn_radius125": _forecasts(STATES + _state_nn(125)),
    "mahalanobis_forecasts": _forecasts(STATES + _mahalanobis()),
    "random_knn_forecasts": _forecasts(STATES + _random()),
    "rolling_hs_forecasts": _forecasts(PANEL + HS + _hs(None)),
    "gap_hs_forecasts": _forecasts(PANEL + HS + _hs(125)),
    "regime_hs_forecasts": _forecasts(STATES + _regime()),
    "fhs_ewma_forecasts": _forecasts(PANEL + EWMA + EWMA_NN),
    "model_summary": f"WITH {_models()} SELECT model, count(*) AS n, round(avg(pinball), 8) + 0.0 AS mean_pinball, round(avg(fz0), 8) + 0.0 AS mean_fz0, round(avg(hit), 8) + 0.0 AS hit_rate, round(avg(var), 8) + 0.0 AS mean_var, round(avg(es), 8) + 0.0 AS mean_es, round(max(pinball), 8) + 0.0 AS worst_pinball, round(avg(n), 8) + 0.0 AS mean_scenarios FROM s GROUP BY model",
    "neighbour_ages": f"WITH {PANEL}{_nn()} SELECT 'all' AS series, round(avg(t - s), 8) + 0.0 AS mean_age, round(quantile_cont((t - s)::DOUBLE, 0.5), 8) + 0.0 AS median_age, round(quantile_cont((t - s)::DOUBLE, 0.05), 8) + 0.0 AS p05_age, round(quantile_cont((t - s)::DOUBLE, 0.95), 8) + 0.0 AS p95_age, min(t - s)::DOUBLE AS min_age FROM nn",
    "age_shares": f"WITH {PANEL}{_nn()} SELECT 'all' AS series, ((t - s > 21)::INT + (t - s > 63)::INT + (t - s > 126)::INT + (t - s > 252)::INT + (t - s > 504)::INT)::BIGINT AS age_bin, count(*) AS n FROM nn GROUP BY 2",
    "neighbour_lists": f"WITH {PANEL}{_nn(5)} SELECT t, string_agg(s::VARCHAR, ';' ORDER BY rank) AS neighbours FROM nn GROUP BY t",
    "cutoff_ties": f"WITH {PANEL}{_nn(K + 1)}, d AS (SELECT t, max(d) FILTER (rank = {K}) AS a, max(d) FILTER (rank = {K + 1}) AS b FROM nn GROUP BY t) SELECT 'all' AS series, count(*) AS n, count(*) FILTER (a = b) AS exact, count(*) FILTER (b - a <= 1e-12 * greatest(1, b)) AS near, round(min(b - a), 6) + 0.0 AS least_gap FROM d WHERE b IS NOT NULL",
    "exclusion_comparison": f"WITH {PANEL}{_nn()}{_risk('nn', 'r0')}{_scored('r0', 's0')}{_nn(radius=125, name='nn5', first=False)}{_risk('nn5', 'r5')}{_scored('r5', 's5')} SELECT count(*) AS n, round(avg(s0.pinball), 8) + 0.0 AS near, round(avg(s5.pinball), 8) + 0.0 AS far, round(avg(s5.pinball - s0.pinball), 8) + 0.0 AS difference, round(avg(s5.var - s0.var), 8) + 0.0 AS var_difference FROM s0 JOIN s5 USING (t)",
    "skipped_forecasts": f"WITH {PANEL}{_windows()} SELECT 'no features or no candidates' AS reason, count(*) AS n, max(p.pos) AS last FROM panel p WHERE p.pos NOT IN (SELECT pos FROM w) OR NOT EXISTS (FROM w c WHERE c.pos <= p.pos - 126)",
    "mutual_information": f"WITH {PANEL}, x AS (SELECT tau, ret AS x, lead(ret, tau) OVER (PARTITION BY tau ORDER BY pos) AS y FROM panel, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS tau) WHERE ret IS NOT NULL), c AS (SELECT tau, least(floor((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 16), 15) AS bx, least(floor((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) * 16), 15) AS b_y FROM x WHERE y IS NOT NULL WINDOW w AS (PARTITION BY tau)), n AS (SELECT tau, bx, b_y, count(*)::DOUBLE AS n FROM c GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY tau) AS al, sum(n) OVER (PARTITION BY tau, bx) AS nx, sum(n) OVER (PARTITION BY tau, b_y) AS ny FROM n) SELECT tau, round(sum(n / al * ln(n * al / (nx * ny))), 8) + 0.0 AS mi FROM m GROUP BY tau",
    "duplicate_checks": f"WITH {PANEL} SELECT count(*) AS n, count(DISTINCT date) AS dates, max(pos) + 1 AS positions, count(*) FILTER (ret IS NULL) AS no_return FROM panel",
    "loss_matrix": f"WITH {_models()} SELECT date, " + ", ".join(f"round(max(pinball) FILTER (model = '{m}'), 8) + 0.0 AS {m}" for m in ("fhs_ewma", "gap_hs", "rolling_hs", "window_knn")) + " FROM s GROUP BY date",
    "shortfall_test": f"WITH {_models()}, x AS (SELECT model, CASE WHEN es > 0 THEN CASE WHEN next_loss > var THEN next_loss / ((1 - {RISK.es}::DOUBLE) * es) ELSE 0 END - 1 END AS x FROM s) SELECT model, count(x) AS n, round(sqrt(count(x)) * avg(x) / stddev_samp(x), 6) + 0.0 AS z2 FROM x GROUP BY model",
    "lineitem_rollup": "SELECT r_name AS region, year(l_shipdate)::BIGINT AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}


def _winners() -> str:
    return f"""WITH {_models()}, f AS (SELECT model, quarter(date)::BIGINT AS fold, avg(pinball) AS mean FROM s GROUP BY 1, 2),
fr AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY mean) AS rank FROM f),
whole AS (SELECT model, avg(mean) AS mean, max(mean) AS worst, avg(rank) AS mean_rank, max(rank)::BIGINT AS worst_rank, count(*) FILTER (rank = 1) AS fold_wins FROM fr GROUP BY model),
lo AS (SELECT a.fold AS out, b.model, avg(b.mean) AS mean FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2),
lw AS (SELECT model, count(*) FILTER (place = 1) AS left_out_wins FROM (SELECT *, row_number() OVER (PARTITION BY out ORDER BY mean, model) AS place FROM lo) GROUP BY model)
SELECT model, {_r('mean worst mean_rank')}, worst_rank, fold_wins, left_out_wins, row_number() OVER (ORDER BY mean, worst, model) = 1 AS winner FROM whole LEFT JOIN lw USING (model)"""


def _coverage(level: float = 0.95) -> str:
    clip = lambda p: f"least(greatest({p}, 1e-12), 1 - 1e-12::DOUBLE)"
    ll = lambda p, yes, no: f"(({yes}) * ln({clip(p)}) + ({no}) * ln(1 - {clip(p)}))"
    pair = ", ".join(f"(count(*) FILTER (before = {a} AND hit = {b}))::DOUBLE AS n{a}{b}" for a in (0, 1) for b in (0, 1))
    tail, share = f"{1 - level!r}::DOUBLE", lambda a, b: f"({a}) / greatest({a} + {b}, 1)"
    ind = f"{ll(share('n01 + n11', 'n00 + n10'), 'n01 + n11', 'n00 + n10')} - {ll(share('n01', 'n00'), 'n01', 'n00')} - {ll(share('n11', 'n10'), 'n11', 'n10')}"
    return f"""WITH {_models()}, h AS (SELECT model, date, hit, lag(hit) OVER w AS before, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY model ORDER BY date)),
spaced AS (SELECT *, CASE WHEN hit = 1 THEN i - last_value(CASE WHEN hit = 1 THEN i END IGNORE NULLS) OVER (PARTITION BY model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM h),
c AS (SELECT model, count(*)::DOUBLE AS n, sum(hit) AS k, count(gap)::DOUBLE AS gaps, sum(gap)::DOUBLE AS days, {pair} FROM spaced GROUP BY model),
x AS (SELECT model, n::BIGINT AS n, k AS hits, greatest(0, -2 * ((n - k) * ln(1 - {tail}) + k * ln({tail}) - {ll('k / n', 'k', 'n - k')})) AS uc, greatest(0, -2 * ({ind})) AS ind,
  CASE WHEN gaps > 0 THEN greatest(0, 2 * ({ll('gaps / days', 'gaps', 'days - gaps')} - {ll(tail, 'gaps', 'days - gaps')})) END AS duration FROM c),
y AS (SELECT *, uc + ind AS cc, exp(-(uc + ind) / 2) AS cc_p FROM x) SELECT model, n, hits, {_r('uc ind cc duration cc_p', 6)} FROM y"""


def _comparison() -> str:
    return f"""WITH {_models()}, d AS (SELECT a.model, a.date, o.pinball - a.pinball AS d FROM s a JOIN s o USING (date) WHERE o.model = 'window_knn' AND a.model <> 'window_knn'),
e AS (SELECT model, d - avg(d) OVER w AS e, count(*) OVER w AS n, avg(d) OVER w AS mean, row_number() OVER (PARTITION BY model ORDER BY date) AS i FROM d WINDOW w AS (PARTITION BY model)),
wide AS (SELECT *, greatest(1, floor(4 * power(n / 100, 2 / 9::DOUBLE))) AS bw FROM e),
v AS (SELECT x.model, max(x.n) AS n, max(x.mean) AS mean, sum(x.e * y.e * CASE WHEN x.i = y.i THEN 1 ELSE 2 * (1 - (x.i - y.i) / (x.bw + 1)) END) / max(x.n) AS variance FROM wide x JOIN wide y ON x.model = y.model AND x.i - y.i BETWEEN 0 AND x.bw GROUP BY x.model),
z AS (SELECT *, mean / sqrt(variance / n) * sqrt((n - 1) / n::DOUBLE) AS dm FROM v) SELECT model, n, {_r('mean variance dm', 6)} FROM z"""


def _holm() -> str:
    """Two-sided normal p-values by Simpson's rule, then Holm's steps."""
    area = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(least(abs(dm), 12) * i / 2000, 2) / 2)))"
    p = f"greatest(0, 1 - 2 / sqrt(2 * pi()) * least(abs(dm), 12) / 6000 * {area})"
    body = _comparison().rpartition(") SELECT ")[0]
    return f"""{body}), p AS (SELECT model, n, mean, variance, dm, {p} AS p FROM z), k AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) AS step FROM p)
SELECT model, n, {_r('mean variance dm', 6)}, {_r('p', 5)}, round(least(1, max(step) OVER (ORDER BY p, model)), 5) + 0.0 AS holm FROM k"""


def _overlap() -> str:
    z = _nn(z=True, name="nz").replace(" w0 AS", " z0 AS").replace("FROM w0", "FROM z0").replace(", w AS (SELECT", ", zw AS (SELECT").replace("FROM w q JOIN w c", "FROM zw q JOIN zw c")
    return f"""WITH {PANEL}{_nn()}{z}, m AS (SELECT t, count(*) AS m FROM nz GROUP BY t),
j AS (SELECT t, count(nz.s) / (count(*) + max(m) - count(nz.s))::DOUBLE AS j FROM nn JOIN m USING (t) LEFT JOIN nz USING (t, s) GROUP BY t)
SELECT count(*) AS n, round(avg(j), 8) + 0.0 AS mean_jaccard, round(quantile_cont(j, 0.5), 8) + 0.0 AS median_jaccard FROM j"""


SQL |= {
    "model_winners": _winners(),
    "coverage_tests": _coverage(),
    "paired_comparison": _comparison(),
    "paired_holm": _holm(),
    "neighbour_overlap": _overlap(),
    "chosen_delay": f"WITH mi AS ({SQL['mutual_information']}), dips AS (SELECT *, mi <= lag(mi) OVER w AND mi <= lead(mi) OVER w AS dip FROM mi WINDOW w AS (ORDER BY tau)) SELECT 'all' AS series, coalesce(min(tau) FILTER (dip), arg_min(tau, mi)) AS tau FROM dips",
}


def _backtest() -> str:
    z = _nn(z=True, name="nz").replace(" w0 AS", " z0 AS").replace("FROM w0", "FROM z0").replace(", w AS (SELECT", ", zw AS (SELECT").replace("FROM w q JOIN w c", "FROM zw q JOIN zw c")
    every = f"""{_models()}{_risk("(SELECT * FROM nn_window WHERE rank <= 20) few", "r_few")}{z}{_risk("nz", "r_z")}"""
    names = {"rolling_hs": "rolling_hs_w250", "gap_hs": "gap_hs_w250_r125", "fhs_ewma": "fhs_ewma_l094", "few": "w_euclidean_l20_k20", "window_knn": "w_euclidean_l20_k50", "z": "wz_euclidean_l20_k50"}
    union = " UNION ALL ".join(f"SELECT *, '{n}' AS configuration FROM r_{m}" for m, n in names.items())
    return f"""WITH {every}, made AS ({union}){_scored('made', 'bt')} SELECT 'test' AS split, configuration, count(*) AS n, {", ".join(f"round(avg({v}), 8) + 0.0 AS {c}" for v, c in (("var", "mean_var"), ("es", "mean_es"), ("hit", "hit_rate"), ("(next_loss > es)::INT", "shortfall_rate"), ("next_loss", "mean_loss"), ("n", "mean_scenarios")))} FROM bt GROUP BY configuration"""


def _skips() -> str:
    made = {
        "rolling_hs_w250": "EXISTS (FROM panel k WHERE k.loss IS NOT NULL AND k.pos <= p.pos)", "gap_hs_w250_r125": "EXISTS (FROM panel k WHERE k.loss IS NOT NULL AND k.pos <= p.pos - 126)", "fhs_ewma_l094": "p.ret IS NOT NULL",
    } | {n: "p.pos IN (SELECT pos FROM w) AND EXISTS (FROM w c WHERE c.pos <= p.pos - 1)" for n in ("w_euclidean_l20_k20", "w_euclidean_l20_k50", "wz_euclidean_l20_k50")}
    union = " UNION ALL ".join(f"SELECT '{n}' AS configuration, date FROM panel p WHERE next_loss IS NOT NULL AND NOT ({how})" for n, how in made.items())
    return f"WITH {PANEL}{_windows()}, gone AS ({union}) SELECT CASE WHEN date >= DATE '{SPLITS.test}' THEN 'test' WHEN date >= DATE '{SPLITS.validation}' THEN 'validation' ELSE 'warmup' END AS split, configuration, 'no features, candidates or losses' AS reason, count(*) AS n FROM gone GROUP BY 1, 2"


SQL |= {
    "score_spread": f"WITH {_models()} SELECT model, count(*) AS n, count(DISTINCT pinball) AS distinct_values, round(avg(pinball), 8) + 0.0 AS mean, round(coalesce(stddev_samp(pinball), 0), 8) + 0.0 AS sd, {', '.join(f'round(quantile_cont(pinball, {p}), 8) + 0.0 AS {c}' for p, c in ((0.05, 'p05'), (0.5, 'p50'), (0.95, 'p95')))}, round(min(pinball), 8) + 0.0 AS least, round(max(pinball), 8) + 0.0 AS greatest FROM s GROUP BY model",
    "backtest_summary": _backtest(),
    "backtest_skips": _skips(),
}


def _folds() -> str:
    before, _, _ = _backtest().partition(" SELECT 'test' AS split")
    rows = ", ".join(f"('{r['configuration_id']}', '{r['method']}', {r['k'] or 'NULL'}, {r['window_length'] or 'NULL'})" for r in registry())
    return before + f""", fo AS (SELECT configuration, year(date)::VARCHAR AS fold, count(*) AS n_forecasts, avg(pinball) AS mean_pinball, avg(hit) AS exceedance_rate, avg(var) AS mean_var, avg(n) AS mean_scenarios, max(pinball) AS worst_pinball FROM bt GROUP BY 1, 2),
reg AS (SELECT * FROM (VALUES {rows}) v(configuration, method, k, window_length)), folds AS (SELECT * FROM reg LEFT JOIN fo USING (configuration))"""


def _finalists() -> str:
    return _folds() + f""", whole AS (SELECT method, configuration, avg(mean_pinball) AS mean_pinball, max(mean_pinball) AS worst_fold, avg(exceedance_rate) AS exceedance_rate, avg(mean_scenarios) AS mean_scenarios, count(DISTINCT fold) AS n_folds FROM folds WHERE fold IS NOT NULL GROUP BY 1, 2)
SELECT method, configuration, {_r('mean_pinball worst_fold exceedance_rate mean_scenarios')}, n_folds FROM whole QUALIFY row_number() OVER (PARTITION BY method ORDER BY whole.mean_pinball, whole.worst_fold, configuration) = 1"""


def _stability() -> str:
    return f"""WITH {_models()}, f AS (SELECT model, quarter(date)::VARCHAR AS fold, avg(pinball) AS mean FROM s GROUP BY 1, 2),
fr AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY mean)::DOUBLE AS rank FROM f),
whole AS (SELECT model, avg(mean) AS mean, avg(rank) AS mean_rank, max(rank) AS worst_rank, stddev_samp(rank) AS sd_rank FROM fr GROUP BY model),
lo AS (SELECT a.fold, b.model, avg(b.mean) AS mean FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON a.fold <> b.fold GROUP BY 1, 2),
tops AS (SELECT 'fold' AS kind, fold, model, mean FROM f UNION ALL SELECT 'all', 'all', model, mean FROM whole UNION ALL SELECT 'without', fold, model, mean FROM lo),
won AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY kind, fold ORDER BY mean, model) = 1)
SELECT kind, fold, model, round(mean, 8) + 0.0 AS mean, NULL::DOUBLE AS mean_rank, NULL::DOUBLE AS worst_rank, NULL::DOUBLE AS sd_rank FROM won
UNION ALL SELECT 'ranks', 'all', model, {_r('mean mean_rank worst_rank sd_rank')} FROM whole"""


def _evaluated() -> str:
    parts = [STATES, HS.replace("known", "hs_known")]
    for name, radius in (("rolling", None), ("gap", 125)):
        parts.append(_hs(radius, f"nn_{name}").replace("known", "hs_known") + _risk(f"nn_{name}", f"r_{name}"))
    parts.append(_nn(name="nn_0") + _risk("nn_0", "r_0") + _nn(radius=125, name="nn_5", first=False) + _risk("nn_5", "r_5"))
    made = [(0, "rolling_hs_w250", "r_rolling"), (125, "rolling_hs_w250", "r_rolling"), (125, "gap_hs_w250_r125", "r_gap"), (0, "w_euclidean_l20_k50", "r_0"), (125, "w_euclidean_l20_k50", "r_5")]
    union = " UNION ALL ".join(f"SELECT *, {r}::BIGINT AS radius, '{c}' AS configuration FROM {t}" for r, c, t in made)
    return f"WITH {''.join(parts)}, every AS ({union})" + _scored("every", "s")


def _means(**columns: str) -> str:
    return ", ".join(f"round({how}, 8) + 0.0 AS {c}" for c, how in columns.items())


def _profile() -> str:
    shares = {f"share_age_le_{c}": f"avg((age <= {c})::INT)" for c in (20, 60, 125, 250)}
    ages = {"mean_age": "avg(age)"} | {f"age_q{round(100 * p):02d}": f"quantile_cont(age, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95)} | shares
    near = lambda n: f"(SELECT t, count(*) FILTER (s >= t - {n})::DOUBLE AS c, count(*) AS k, least({n}, t - {SIZE}) AS m FROM nn WHERE t > {SIZE} GROUP BY t)"
    rows = [f"SELECT '{m}' AS measure, round({how}, 8) + 0.0 AS value FROM ages" for m, how in ages.items()]
    rows += [f"SELECT '{name}_jaccard_recent_{n}', round({f}(c / (k + m - c)), 8) + 0.0 FROM {near(n)}" for n in (100, 250) for name, f in (("mean", "avg"), ("median", "median"))]
    return f"WITH {PANEL}{_nn()}, ages AS (SELECT (t - s)::DOUBLE AS age FROM nn) " + " UNION ALL ".join(rows)


def _verification() -> str:
    checks = {
        "positions are unique": "(SELECT count(*) FROM (SELECT pos FROM panel GROUP BY pos HAVING count(*) > 1))", "dates are unique": "(SELECT count(*) FROM (SELECT date FROM panel GROUP BY date HAVING count(*) > 1))",
        "only the last day lacks a next loss": "(SELECT count(*) FROM panel WHERE next_loss IS NULL AND pos <> (SELECT max(pos) FROM panel))", "neighbours keep their distance": "(SELECT count(*) FROM nn WHERE s > t - 126)",
        "neighbours have whole windows": f"(SELECT count(*) FROM nn WHERE s < {SIZE})", "queries have equally many neighbours": f"(SELECT count(*) FROM (SELECT t FROM nn GROUP BY t HAVING count(*) <> {K}))",
    }
    return f"WITH {PANEL}{_nn(radius=125)}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", {how} AS bad" for n, how in checks.items()) + ') SELECT "check", bad = 0 AS holds, bad FROM c'


SUMMARY = _means(mean_pinball="avg(pinball)", mean_fz0="avg(fz0)", hit_rate="avg(hit)", mean_var="avg(var)", mean_es="avg(es)", worst_pinball="max(pinball)", mean_scenarios="avg(n)")
SQL |= {
    "validation_folds": _folds() + f" SELECT configuration, method, k, window_length, fold, n_forecasts, {_r('mean_pinball exceedance_rate mean_var mean_scenarios worst_pinball')}, CASE WHEN fold IS NULL THEN 'infeasible' ELSE 'completed' END AS status FROM folds",
    "validation_finalists": _finalists(),
    "selection_stability": _stability(),
    "evaluation_summary": f"{_evaluated()} SELECT radius, configuration, count(*) AS n, {SUMMARY} FROM s GROUP BY 1, 2",
    "gap_comparison": f"{_evaluated()} SELECT radius, configuration, count(*) AS n_dates, {_means(mean_pinball='avg(pinball)', exceedance_rate='avg(hit)', mean_var='avg(var)', mean_es='avg(es)')} FROM s WHERE radius > 0 GROUP BY 1, 2",
    "evaluation_matrix": f"{_evaluated()} SELECT radius, date, " + ", ".join(f"round(max(pinball) FILTER (configuration = '{c}'), 8) + 0.0 AS {c}" for c in ("rolling_hs_w250", "gap_hs_w250_r125", "w_euclidean_l20_k50")) + " FROM s GROUP BY 1, 2",
    "neighbour_profile": _profile(),
    "verification": _verification(),
    "synthetic_series": regions_sql(),
}
