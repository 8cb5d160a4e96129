"""DuckDB SQL of the registered queries, written apart from the Spark code."""

from __future__ import annotations

from tideline.functions import stats, text
from tideline.schema import DEFAULT_TAGS, METRICS, THRESHOLDS, WEEKDAYS

SEED = THRESHOLDS.seed
REPS = THRESHOLDS.replicates


def u(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


def n32(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _du(name: str) -> str:
    return u("subject_id", "i", f"'{name}'")


def _dg(name: str) -> str:
    a, b = u("subject_id", "i", f"'{name}'", "'a'"), u("subject_id", "i", f"'{name}'", "'b'")
    return f"round(sqrt(-2 * ln(greatest(1e-12, {a}))) * cos(2 * pi() * {b}), 6)"


def _clamp(e: str) -> str:
    return f"CAST(greatest(-3, least(3, floor({e} + 0.5))) AS INTEGER)"


def mix(x: str, name: str) -> str:
    """Columns that end in ``name``, the mix of ``x``."""
    shift = lambda v: f"(xor({v}, {v} >> 16) * {stats.MIX_FACTOR}) & {stats.MIX_MASK}"
    return f"CAST({x} AS BIGINT) AS {name}_0, {shift(f'{name}_0')} AS {name}_1, {shift(f'{name}_1')} AS {name}_2, xor({name}_2, {name}_2 >> 16) AS {name}"


def seed_of(test: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || {test}), 1, 8) AS BIGINT)"


def _z(c: str) -> str:
    return f"coalesce(round(({c} - avg({c}) OVER y) / nullif(stddev_samp({c}) OVER y, 0), 6), 0.0) AS z_{c}"


#: The orders as diaries of years.
DIARY = f"""
do1 AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price, count(*) AS n, arg_max(o_orderpriority, struct_pack(a := o_totalprice, b := o_orderkey)) AS top FROM orders GROUP BY 1),
dl1 AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax, count(*) AS lines FROM lineitem GROUP BY 1),
dz1 AS (SELECT *, {", ".join(map(_z, ("price", "n", "quantity", "discount", "tax")))} FROM (SELECT *, CAST(year(day) AS VARCHAR) AS subject_id FROM do1 LEFT JOIN dl1 USING (day)) WINDOW y AS (PARTITION BY subject_id)),
dd1 AS (SELECT a.*, CAST(isodow(a.day) >= 6 AS INTEGER) AS we, coalesce(b.z_quantity, 0.0) AS driver FROM dz1 a LEFT JOIN dz1 b ON b.subject_id = a.subject_id AND b.day = a.day - 2),
diary AS (SELECT subject_id, day, {_clamp("round(we - CASE WHEN top = '1-URGENT' THEN 1.4::DOUBLE ELSE 0 END + 0.8::DOUBLE * z_price, 6)")} AS mood, {_clamp("round(0.9::DOUBLE * driver + 0.7::DOUBLE * z_n, 6)")} AS energy, lower(top) AS tag,
  CASE WHEN lines % 11 > 0 THEN round(420 + 55 * z_quantity, 6) END AS sleep_minutes, CASE WHEN lines IS NOT NULL THEN round(250 + 60 * z_discount, 6) END AS screen_minutes, CAST(lines AS DOUBLE) AS unlock_count,
  CASE WHEN z_tax > -1 THEN round(7000 + 2500 * z_tax, 6) END AS steps FROM dd1)"""


def demo() -> str:
    w = "OVER (PARTITION BY subject_id ORDER BY i)"
    return f"""
d0 AS (SELECT subject_id, CAST(i AS INTEGER) AS i, DATE '2026-01-05' + CAST(i AS INTEGER) AS day FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id FROM events), range(121) AS r(i)),
d1 AS (SELECT *, isodow(day) >= 6 AS weekend FROM d0),
d2 AS (SELECT *, CAST(weekend AS INTEGER) AS we, (weekend AND {_du("d1")} < 0.55) OR {_du("d2")} < 0.08 AS drank FROM d1),
d3 AS (SELECT *, CAST(coalesce(lag(drank) {w}, false) AS INTEGER) AS db FROM d2),
d4 AS (SELECT *, round(420 + {_dg("sleep")} * 55 + we * 35 - db * 25, 6) AS sleep_minutes FROM d3),
d5 AS (SELECT *, round(coalesce((lag(sleep_minutes, 2) {w} - 420) / 55, 0.0), 6) AS driver FROM d4),
demo AS (SELECT subject_id, i, day, we, {_clamp(f"round(0.4 * driver + we * 1.0 + 0.8 * {_dg('mood')}, 6)")} AS mood,
  {_clamp(f"round(0.9 * driver - 1.1 * db + 0.7 * {_dg('energy')}, 6)")} AS energy,
  list_filter([CASE WHEN drank THEN 'alcohol' END, CASE WHEN {_du("t1")} < 0.4 THEN 'caffeine' END, CASE WHEN {_du("t2")} < 0.3 THEN 'exercise' END,
    CASE WHEN weekend AND {_du("t3")} < 0.6 THEN 'social contact' END], lambda x: x IS NOT NULL) AS tags,
  sleep_minutes, round(300 + {_dg("screen")} * 80 + we * 60, 6) AS screen_minutes, round(70 + {_dg("social")} * 30, 6) AS social_media_minutes,
  greatest(0.0, round(20 + {_dg("late")} * 15, 6)) AS late_night_screen_minutes, CAST(greatest(0, floor(round(70 + {_dg("unlock")} * 20, 6) + 0.5)) AS INTEGER) AS unlock_count,
  greatest(0.0, round(7000 + {_dg("steps")} * 2500, 6)) AS steps, CASE WHEN {_du("t2")} < 0.3 THEN round(35 + {_dg("exercise")} * 12, 6) ELSE 0.0 END AS exercise_minutes FROM d5)"""


_LONG = " UNION ALL ".join(f"SELECT subject_id, '{k}' AS metric_key, day, {k} AS value FROM diary WHERE {k} IS NOT NULL" for k in ("sleep_minutes", "steps"))


def debt(source: str) -> str:
    """CTEs ``based`` and ``debts`` of a table of (subject_id, day, value)."""
    frame = "OVER (PARTITION BY subject_id ORDER BY day RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND CURRENT ROW)"
    return f"""
based AS (SELECT *, CASE WHEN count(*) {frame.format(27)} >= 7 THEN quantile_cont(value, 0.5) {frame.format(27)} END AS baseline, list(value) {frame.format(2)} AS nights,
  count(*) OVER (PARTITION BY subject_id) AS total FROM {source}),
debts AS (SELECT subject_id, day, list_sum(list_transform(nights, lambda x: greatest(0.0, baseline - x))) AS debt FROM based WHERE total >= 14 AND len(nights) = 3 AND baseline IS NOT NULL)"""


DIARY_INPUT = f"""{DIARY},
outcomes AS (SELECT subject_id, 'mood' AS metric_key, day, CAST(mood AS DOUBLE) AS value FROM diary UNION ALL SELECT subject_id, 'energy', day, CAST(energy AS DOUBLE) FROM diary),
nights_in AS (SELECT subject_id, day, sleep_minutes AS value FROM diary WHERE sleep_minutes IS NOT NULL), {debt("nights_in")},
predictors AS ({_LONG} UNION ALL SELECT subject_id, 'sleep_debt_3d', day, debt FROM debts),
tags AS (SELECT subject_id, tag, day FROM diary)"""


def events_input(by_user: bool, outcome: str, predictor: str) -> str:
    subject = "CAST(user_id AS VARCHAR)" if by_user else "'all'"
    return f"""
ev AS (SELECT {subject} AS subject_id, event_type AS metric_key, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL),
outcomes AS (SELECT * FROM ev WHERE metric_key IN ({outcome})), predictors AS (SELECT * FROM ev WHERE metric_key IN ({predictor}))"""


#: Each user's days: the mean value of events, and their number.
USERS_INPUT = """
ud AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(ts AS DATE) AS day, avg(value) AS mean, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
outcomes AS (SELECT subject_id, 'mean' AS metric_key, day, mean AS value FROM ud), predictors AS (SELECT subject_id, 'count' AS metric_key, day, n AS value FROM ud)"""
EVENTS_INPUT = events_input(False, "'purchase', 'view'", "'click', 'error', 'signup'")


def aligned(name: str = "pairs", a: str = "outcomes", b: str = "predictors") -> str:
    return f"""
{name} AS (SELECT o.subject_id, o.metric_key AS outcome, p.metric_key AS predictor, lag, o.day, o.value AS y, p.value AS x, CAST(isodow(o.day) >= 6 AS INTEGER) AS weekend
  FROM {a} o, {b} p, (VALUES (0), (1), (2), (3)) AS l(lag) WHERE o.subject_id = p.subject_id AND p.day = CAST(o.day - to_days(lag) AS DATE))"""


def adjust(src: str, out: str, keys: str, y: str, res: str, weekend: bool = True) -> str:
    """CTEs that add the residuals ``res`` of ``y`` to ``src``."""
    one = "CASE WHEN nn > 2 AND {s} >= 1e-10 THEN {y} - my - ({c} - {m}) * {t} / {s} ELSE {y} END"
    trend = one.format(y=y, s="stt", c="tr", m="mt", t="sty")
    flat = f"CASE WHEN nn > 1 THEN {y} - my ELSE {y} END"
    if not weekend:
        value = f"CASE WHEN vt THEN {trend} ELSE {flat} END"
    else:
        days = one.format(y=y, s="sww", c="weekend", m="mw", t="swy")
        both = f"CASE WHEN nn > 3 AND det >= 1e-10 * greatest(sww, stt) THEN {y} - my - (swy * stt - sty * swt) / det * (weekend - mw) - (sty * sww - swy * swt) / det * (tr - mt) ELSE {y} END"
        value = f"CASE WHEN vw AND vt THEN {both} WHEN vw THEN {days} WHEN vt THEN {trend} ELSE {flat} END"
    drop = "tr, nn, my, mt, mw, sww, stt, swt, swy, sty, vw, vt, det"
    return f"""
{out}_t AS (SELECT *, avg({y}) OVER (PARTITION BY {keys} ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 14 DAYS FOLLOWING) AS tr FROM {src}),
{out}_m AS (SELECT *, count(*) OVER w AS nn, avg({y}) OVER w AS my, avg(tr) OVER w AS mt, avg(weekend) OVER w AS mw, covar_pop(weekend, weekend) OVER w * count(*) OVER w AS sww,
  covar_pop(tr, tr) OVER w * count(*) OVER w AS stt, covar_pop(weekend, tr) OVER w * count(*) OVER w AS swt, covar_pop(weekend, {y}) OVER w * count(*) OVER w AS swy,
  covar_pop(tr, {y}) OVER w * count(*) OVER w AS sty, coalesce(stddev_samp(weekend) OVER w, 0) > 1e-12 AS vw, coalesce(stddev_samp(tr) OVER w, 0) > 1e-12 AS vt FROM {out}_t WINDOW w AS (PARTITION BY {keys})),
{out}_d AS (SELECT *, sww * stt - swt * swt AS det FROM {out}_m),
{out} AS (SELECT * EXCLUDE ({drop}), round({value}, 9) AS {res} FROM {out}_d)"""


def adjust_many(src: str, out: str, keys: str, y: str, covariates: list[str], res: str) -> str:
    """CTEs that add the residuals ``res`` of ``y`` on any covariates to ``src``, none of them null."""
    w = f"WINDOW w AS (PARTITION BY {keys})"
    centred = ", ".join(f"{c} - avg({c}) OVER w AS r_{c}" for c in [y, *covariates])
    varies = ", ".join(f"coalesce(stddev_samp({c}) OVER w, 0) > 1e-12 AS v_{c}" for c in covariates)
    parts = [f"{out}_0 AS (SELECT *, count(*) OVER w AS nn, {centred}, {varies} FROM {src} {w})"]
    usable = "nn > 1 + " + " + ".join(f"CAST(v_{c} AS INTEGER)" for c in covariates)
    for k, c in enumerate(covariates):
        fits = f"v_{c} AND p_{c} >= 1e-10"
        rest = [y, *covariates[k + 1 :]]
        sums = ", ".join(f"sum(r_{c} * r_{b}) OVER w AS s_{b}" for b in rest)
        less = ", ".join(f"CASE WHEN {fits} THEN r_{b} - s_{b} / p_{c} * r_{c} ELSE r_{b} END AS r_{b}" for b in rest)
        parts.append(f"{out}_{k}s AS (SELECT *, sum(r_{c} * r_{c}) OVER w AS p_{c}, {sums} FROM {out}_{k} {w})")
        parts.append(f"{out}_{k + 1} AS (SELECT * EXCLUDE ({', '.join(f's_{b}, r_{b}' for b in rest)}), {less} FROM {out}_{k}s)")
        usable += f" AND (NOT v_{c} OR p_{c} >= 1e-10)"
    parts.append(f"{out} AS (SELECT *, CASE WHEN {usable} THEN r_{y} ELSE {y} END AS {res} FROM {out}_{len(covariates)})")
    return ",\n".join(parts)


def rank(v: str, keys: str) -> str:
    part = f"PARTITION BY {keys}, " if keys else "PARTITION BY "
    return f"(rank() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY {v}) + (count(*) OVER ({part}{v}) - 1) / 2.0)"


def pearson(x: str, y: str) -> str:
    s = f"sqrt(var_pop({x}) * var_pop({y}))"
    return f"CASE WHEN count(*) >= 3 AND {s} * count(*) > 1e-12 THEN greatest(-1.0, least(1.0, covar_pop({x}, {y}) / nullif({s}, 0))) END"


def fz(r: str) -> str:
    return f"atanh(greatest(-0.999999, least(0.999999, {r})))"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def t_sf(t: str) -> str:
    terms = [1.0]
    for j in range(1, 15):
        terms.append(terms[-1] * (2 * j - 1) / (2 * j))
    th = f"atan(abs({t}) / sqrt(30))"
    half = f"greatest(0.0, (1 - sin({th}) * {horner(f'(cos({th}) * cos({th}))', tuple(terms[::-1]))}) / 2)"
    return f"(CASE WHEN {t} < 0 THEN 1 - {half} ELSE {half} END)"


def ncdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + {stats.ERF_P} * {x}))"
    return f"(0.5 * (1 + sign({z}) * (1 - {horner(t, stats.ERF[::-1])} * {t} * exp(-{x} * {x}))))"


def nquant(p: str) -> str:
    q = f"({p} - 0.5)"
    mid = f"{horner(f'({q} * {q})', stats.MIDDLE_TOP)} * {q} / {horner(f'({q} * {q})', stats.MIDDLE_LOW)}"
    tail = lambda x: f"{horner(f'sqrt(-2 * ln({x}))', stats.TAIL_TOP)} / {horner(f'sqrt(-2 * ln({x}))', stats.TAIL_LOW)}"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} <= 1 - 0.02425 THEN {mid} ELSE -({tail(f'(1 - {p})')}) END)"


def pval(effect: str, sd: str) -> str:
    return f"greatest(0.0, least(1.0, 2 * {t_sf(f'(abs({effect}) / {sd})')}))"


BLOCK = "CAST(greatest(2, least(greatest(2, floor({0} / 2)), floor(cbrt({0}) + 0.5))) AS INTEGER)"
PAIR = "subject_id, outcome, predictor, lag"


def correlations(prefix: str = "c", pairs: str = "pairs", null: bool = True) -> str:
    """CTEs from aligned pairs to ``{prefix}_tests``."""
    p = prefix
    out = f"""
{p}_g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {PAIR}) AS n FROM {pairs}) WHERE n >= CASE WHEN lag = 0 THEN 14 ELSE 21 END),
{adjust(f"{p}_g", f"{p}_y", PAIR, "y", "ry")}, {adjust(f"{p}_y", f"{p}_x", PAIR, "x", "rx")},
{p}_rows AS (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY day) - 1 AS pos, 'corr:' || outcome || ':' || predictor || ':lag' || lag AS test_id FROM {p}_x),
{p}_q AS (SELECT {PAIR}, test_id, {rank("rx", PAIR)} AS qx, {rank("ry", PAIR)} AS qy FROM {p}_rows),
{p}_e AS (SELECT {PAIR}, test_id, CAST(count(*) AS INTEGER) AS n, {pearson("qx", "qy")} AS effect FROM {p}_q GROUP BY ALL)"""
    if not null:
        return out
    by = f"{PAIR}, draw"
    margin = "greatest(3, n // 20)"
    return f"""{out},
{p}_n AS (SELECT DISTINCT {PAIR}, test_id, n FROM {p}_rows WHERE n - 2 * {margin} >= 8),
{p}_k AS (SELECT {PAIR}, n, k AS draw, k FROM (SELECT *, unnest(range({margin}, n - {margin})) AS k FROM {p}_n WHERE n <= {THRESHOLDS.exact_null_days})
  UNION ALL SELECT {PAIR}, n, draw, {margin} + g % (n - 2 * {margin}) FROM (SELECT *, {mix("xor(h0, draw)", "g")} FROM (SELECT *, {seed_of("test_id")} AS h0 FROM {p}_n WHERE n > {THRESHOLDS.exact_null_days}), range({THRESHOLDS.null_samples}) AS d(draw))),
{p}_xs AS (SELECT {PAIR}, list(x ORDER BY pos) AS xs FROM {p}_rows GROUP BY ALL),
{p}_kx AS (SELECT {PAIR}, n, draw, k, xs FROM {p}_k JOIN {p}_xs USING ({PAIR})),
{p}_rot AS (SELECT r.subject_id, r.outcome, r.predictor, r.lag, draw, r.n, r.day, r.weekend, r.ry, xs[(r.pos + k) % r.n + 1] AS x FROM {p}_kx JOIN {p}_rows r USING ({PAIR})),
{adjust(f"{p}_rot", f"{p}_rx", by, "x", "rx")},
{p}_rq AS (SELECT {by}, n, {rank("rx", by)} AS qx, {rank("ry", by)} AS qy FROM {p}_rx),
{p}_rs AS (SELECT {by}, n, {pearson("qx", "qy")} AS r FROM {p}_rq GROUP BY ALL),
{p}_sd AS (SELECT {PAIR}, count(r) AS valid, count(*) AS draws, CASE WHEN n <= {THRESHOLDS.exact_null_days} THEN stddev_pop({fz("r")}) ELSE stddev_samp({fz("r")}) END AS sd FROM {p}_rs GROUP BY {PAIR}, n),
{p}_null AS (SELECT {PAIR}, CASE WHEN 2 * valid >= draws AND sd > 1e-12 THEN sd END AS null_sd FROM {p}_sd),
{p}_tests AS (SELECT *, CASE WHEN starts_with(predictor, 'sleep_debt') THEN 'SLEEP_DEBT' WHEN lag = 0 THEN 'SAME_DAY' ELSE 'LAGGED' END AS kind FROM {p}_e JOIN {p}_null USING ({PAIR}))"""


GROUP = "subject_id, outcome, grp, test_id"


def comparisons(p: str, kind: str) -> str:
    """CTEs to ``{p}_tests`` of tags or weekdays."""
    if kind == "TAG":
        rows = f"""{p}_0 AS (SELECT o.subject_id, o.metric_key AS outcome, o.day, o.value AS y, g.tag AS grp, CAST(t.day IS NOT NULL AS INTEGER) AS inside, CAST(isodow(o.day) >= 6 AS INTEGER) AS weekend,
  'tag:' || o.metric_key || ':' || g.tag AS test_id FROM outcomes o JOIN (SELECT DISTINCT subject_id, tag FROM tags) g USING (subject_id) LEFT JOIN tags t ON t.subject_id = o.subject_id AND t.tag = g.tag AND t.day = o.day)"""
    else:
        names = ", ".join(f"({k}, '{w}')" for k, w in enumerate(WEEKDAYS, 1))
        rows = f"""{p}_0 AS (SELECT subject_id, metric_key AS outcome, day, value AS y, w AS grp, CAST(isodow(day) = k AS INTEGER) AS inside, 0 AS weekend, 'dow:' || metric_key || ':' || upper(w) AS test_id
  FROM outcomes, (VALUES {names}) AS v(k, w))"""
    least = 14 if kind == "TAG" else 42
    s = f"(CASE WHEN stddev_samp({{0}}) > 1e-9 THEN (avg({{0}}) FILTER (inside = 1) - avg({{0}}) FILTER (inside = 0)) / stddev_samp({{0}}) END)"
    by = f"{GROUP}, draw"
    return f"""{rows},
{p}_1 AS (SELECT * EXCLUDE (n_in) FROM (SELECT *, count(*) OVER w AS n, sum(inside) OVER w AS n_in FROM {p}_0 WINDOW w AS (PARTITION BY {GROUP})) WHERE n >= {least} AND n_in >= 4 AND n - n_in >= 4),
{adjust(f"{p}_1", f"{p}_2", GROUP, "y", "ry", kind == "TAG")},
{p}_rows AS (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY day) - 1 AS pos FROM {p}_2),
{p}_e AS (SELECT {GROUP}, CAST(count(*) AS INTEGER) AS n, {s.format("ry")} AS effect, avg(y) FILTER (inside = 1) - avg(y) FILTER (inside = 0) AS raw_difference FROM {p}_rows GROUP BY ALL),
{p}_h AS (SELECT {GROUP}, n, draw, {mix("xor(h0, draw)", "h")} FROM (SELECT DISTINCT {GROUP}, n, {seed_of("test_id")} AS h0 FROM {p}_rows), range(300) AS d(draw)),
{p}_b0 AS (SELECT h.subject_id, h.outcome, h.grp, h.test_id, h.draw, h.n, h, r.pos, r.ry, r.inside, {mix("xor(h, r.pos)", "g")} FROM {p}_h h JOIN {p}_rows r USING ({GROUP})),
{p}_b1 AS (SELECT {by}, n, h, pos, ry, inside, CASE WHEN pos = 0 OR g / 4294967296.0::DOUBLE <= 1.0::DOUBLE / greatest(1, least({BLOCK.format("n")}, greatest(1, n // 2))) THEN 1 ELSE 0 END AS st FROM {p}_b0),
{p}_b2 AS (SELECT *, CAST(sum(st) OVER (PARTITION BY {by} ORDER BY pos) AS BIGINT) AS block FROM {p}_b1),
{p}_b2k AS (SELECT *, {mix("xor(h, block)", "k1")}, {mix("xor(k1, 1)", "k2")} FROM {p}_b2),
{p}_b3 AS (SELECT {by}, ry, row_number() OVER (PARTITION BY {by} ORDER BY k2, block, pos) - 1 AS place FROM {p}_b2k),
{p}_b4 AS (SELECT a.{GROUP.replace(", ", ", a.")}, a.draw, a.ry, b.inside FROM {p}_b3 a JOIN {p}_rows b ON a.test_id = b.test_id AND a.subject_id = b.subject_id AND a.place = b.pos),
{p}_b5 AS (SELECT {by}, {s.format("ry")} AS stat FROM {p}_b4 GROUP BY ALL),
{p}_null AS (SELECT {GROUP}, CASE WHEN count(stat) >= 150 AND stddev_samp(stat) > 1e-12 THEN stddev_samp(stat) END AS null_sd FROM {p}_b5 GROUP BY ALL),
{p}_tests AS (SELECT *, '{kind}' AS kind FROM {p}_e JOIN {p}_null USING ({GROUP}))"""


def scored(source: str) -> str:
    """CTEs to ``scored`` of a table with subject_id, test_id, effect on its scale ``te``, null_sd."""
    return f"""
sc1 AS (SELECT *, {pval("te", "null_sd")} AS p FROM {source} WHERE effect IS NOT NULL AND null_sd IS NOT NULL),
sc2 AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS family, row_number() OVER (PARTITION BY subject_id ORDER BY p) AS k FROM sc1),
sc3 AS (SELECT *, max(CASE WHEN p <= k / family * 0.1 THEN p END) OVER (PARTITION BY subject_id) AS bh FROM sc2),
scored AS (SELECT *, CASE WHEN bh IS NULL OR p > bh THEN NULL WHEN p <= 0.05 / family THEN 'CLEAR' ELSE 'TENTATIVE' END AS confidence,
  CASE WHEN abs(effect) < 0.2 THEN NULL WHEN abs(effect) < 0.35 THEN 'weak' WHEN abs(effect) < 0.55 THEN 'moderate' ELSE 'strong' END AS strength FROM sc3)"""


ALL_TESTS = f"""{DIARY_INPUT}, {aligned()}, {correlations()}, {comparisons("t", "TAG")}, {comparisons("w", "DAY_OF_WEEK")},
everything AS (SELECT subject_id, test_id, kind, outcome, predictor, lag, CAST(NULL AS VARCHAR) AS grp, n, effect, CAST(NULL AS DOUBLE) AS raw_difference, null_sd, {fz("effect")} AS te FROM c_tests
  UNION ALL SELECT subject_id, test_id, kind, outcome, NULL, NULL, grp, n, effect, raw_difference, null_sd, effect FROM t_tests
  UNION ALL SELECT subject_id, test_id, kind, outcome, NULL, NULL, grp, n, effect, raw_difference, null_sd, effect FROM w_tests), {scored("everything")}"""


def boot(rows: str, keep: str, a: str, b: str, reps: int, p: str) -> str:
    """CTE ``{p}_pairs``: block bootstrap of (a, b) over rows of (subject_id, test_id, pos, n)."""
    size = BLOCK.format("n")
    return f"""
{p}_t AS (SELECT DISTINCT subject_id, test_id, n, {size} AS size FROM {rows} WHERE n >= 6 {keep}),
{p}_r AS (SELECT subject_id, test_id, n, size, rep, {mix("xor(h0, rep)", "h")} FROM (SELECT *, {seed_of("test_id")} AS h0 FROM {p}_t), range({reps}) AS r(rep)),
{p}_k AS (SELECT subject_id, test_id, n, size, rep, blk, {mix("xor(h, blk)", "g")} FROM (SELECT *, unnest(range((n + size - 1) // size)) AS blk FROM {p}_r)),
{p}_s AS (SELECT subject_id, test_id, rep, g % (n - size + 1) + j AS src FROM (SELECT *, unnest(range(size)) AS j FROM {p}_k) WHERE blk * size + j < n),
{p}_pairs AS (SELECT s.subject_id, s.test_id, s.rep, r.{a} AS a, r.{b} AS b FROM {p}_s s JOIN {rows} r ON r.subject_id = s.subject_id AND r.test_id = s.test_id AND r.pos = s.src)"""


_SDM = "CASE WHEN stddev_samp(a) > 1e-9 THEN (avg(a) FILTER (b = 1) - avg(a) FILTER (b = 0)) / stddev_samp(a) END"
KEEP = "AND (subject_id, test_id) IN (SELECT (subject_id, test_id) FROM kept)"
_ORDER = ", ".join(f"'{k}'" for k in ("mood", "energy", *[k for k, _, _ in METRICS], "sleep_debt_3d"))
REPORT = f"""{ALL_TESTS},
kept AS (SELECT * FROM scored WHERE confidence IS NOT NULL AND strength IS NOT NULL),
g_rows AS (SELECT subject_id, test_id, pos, n, ry, inside FROM t_rows UNION ALL SELECT subject_id, test_id, pos, n, ry, inside FROM w_rows),
{boot("c_rows", KEEP, "rx", "ry", 1000, "bc")}, {boot("g_rows", KEEP, "ry", "inside", 1000, "bg")},
bq AS (SELECT subject_id, test_id, rep, {rank("a", "subject_id, test_id, rep")} AS qa, {rank("b", "subject_id, test_id, rep")} AS qb FROM bc_pairs),
br AS (SELECT subject_id, test_id, rep, {pearson("qa", "qb")} AS r FROM bq GROUP BY ALL),
bs AS (SELECT subject_id, test_id, {fz("r")} AS s FROM br UNION ALL SELECT subject_id, test_id, s FROM (SELECT subject_id, test_id, rep, {_SDM} AS s FROM bg_pairs GROUP BY ALL)),
se AS (SELECT subject_id, test_id, stddev_samp(s) AS se FROM bs GROUP BY ALL HAVING count(s) >= 500 AND stddev_samp(s) > 1e-12),
{aligned("back0", "predictors", "outcomes")}, back AS (SELECT * FROM back0 WHERE (subject_id, predictor, outcome, lag) IN (SELECT (subject_id, outcome, predictor, lag) FROM kept)), {correlations("v", "back", False)},
rv AS (SELECT subject_id, predictor AS outcome, outcome AS predictor, lag, effect AS reverse FROM v_e WHERE lag > 0),
f1 AS (SELECT k.*, s.se, rv.reverse, te - 1.959963984540054 * se AS lo, te + 1.959963984540054 * se AS hi, abs(effect) * CASE confidence WHEN 'CLEAR' THEN 1.0 ELSE 0.6 END AS score,
  regexp_replace(test_id, '^(.*):lag.*$', '\\1') AS pair, CASE WHEN grp IS NULL THEN 0 WHEN kind = 'TAG' THEN 1 ELSE 2 END AS fam, list_position([{", ".join(f"'{w}'" for w in WEEKDAYS)}], grp) AS wd, list_position([{_ORDER}], k.outcome) AS op, list_position([{_ORDER}], k.predictor) AS pp
  FROM kept k JOIN se s USING (subject_id, test_id) LEFT JOIN rv USING (subject_id, outcome, predictor, lag)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY subject_id, pair ORDER BY score DESC, op, fam, pp NULLS LAST, coalesce(lag, 0), wd NULLS LAST, coalesce(grp, '')) AS nth FROM f1),
f3 AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, op, fam, pp NULLS LAST, coalesce(lag, 0), wd NULLS LAST, coalesce(grp, '')) AS place FROM f2 WHERE nth = 1),
names(k, label) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v, _ in (*METRICS, ("mood", "Mood", ""), ("energy", "Energy", ""), ("sleep_debt_3d", "3-day sleep debt", "")))}),
f4 AS (SELECT f3.*, o.label AS o, p.label AS pl, CASE WHEN grp IS NULL THEN tanh(lo) ELSE lo END AS ci_low, CASE WHEN grp IS NULL THEN tanh(hi) ELSE hi END AS ci_high, CASE WHEN effect >= 0 THEN 'higher' ELSE 'lower' END AS dir
  FROM f3 LEFT JOIN names o ON o.k = outcome LEFT JOIN names p ON p.k = predictor),
f5 AS (SELECT *, CASE kind WHEN 'SAME_DAY' THEN 'Higher ' || lower(pl) || ' goes with ' || dir || ' ' || lower(o) || ' the same day'
  WHEN 'LAGGED' THEN pl || ' ' || CASE WHEN lag = 1 THEN 'the day before' ELSE lag || ' days earlier' END || ' tracks ' || dir || ' ' || lower(o)
  WHEN 'SLEEP_DEBT' THEN 'Accumulated sleep debt tracks ' || dir || ' ' || lower(o) WHEN 'TAG' THEN o || ' runs ' || dir || ' on days tagged "' || grp || '"'
  ELSE o || ' tends to be ' || dir || ' on ' || grp || 's' END AS head FROM f4)
SELECT subject_id, CAST(place AS INTEGER) AS place, test_id, kind, upper(head[1]) || head[2:] AS headline,
  upper(strength[1]) || strength[2:] || CASE WHEN grp IS NULL THEN ' association (rho = ' || printf('%.2f', effect) ELSE ' difference (d = ' || printf('%.2f', effect) || ', about ' || printf('%.2f', abs(raw_difference)) || ' points on the scale' END
  || ', 95% CI ' || printf('%.2f', ci_low) || ' to ' || printf('%.2f', ci_high) || ', over ' || n || ' days). Adjusted for weekday/weekend and slow drift. This is an association in your own data, not evidence of cause.' AS detail,
  round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, confidence, strength,
  array_to_string(list_filter([CASE WHEN confidence = 'TENTATIVE' THEN 'Survives the false-discovery check but not the strictest one, so treat it as a lead rather than a settled finding.' END,
    CASE WHEN n < 30 THEN 'Based on a short history (' || n || ' days); expect this to move.' END,
    CASE WHEN kind IN ('LAGGED', 'SLEEP_DEBT') AND abs(reverse) >= abs(effect) * 0.8 THEN 'The reverse also holds about as strongly (' || o || ' predicts later ' || pl || ' at ' || printf('%.2f', reverse) || '), so which way this runs is unclear.' END],
    lambda x: x IS NOT NULL), ' / ') AS caveats FROM f5"""

ORDERS = "orders_daily AS (SELECT o_orderpriority AS metric_key, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
NIGHTS = f"{DIARY}, nights AS (SELECT subject_id, day, sleep_minutes AS value FROM diary WHERE sleep_minutes IS NOT NULL)"
HOURS = "INTERVAL (CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN -5 ELSE 9 END) HOUR"
CHECK = f"""c AS (SELECT event_id AS id, user_id, ts, ['UTC', 'America/New_York', 'Asia/Tokyo'][user_id % 3 + 1] AS zone_id, CAST(ts + {HOURS} - INTERVAL 4 HOUR AS DATE) AS day,
  CAST(ts + {HOURS} AS DATE) AS sleep_day, {_clamp("(value - 50) / 20")} AS mood, {_clamp("(value - 30) / 15")} AS energy, event_type AS tag,
  CASE WHEN regexp_matches(props, '\\S') THEN props END AS note FROM events),
ct AS (SELECT id AS check_in_id, tag FROM c UNION ALL SELECT id, 'a,b' FROM c WHERE id % 5 = 0),
own AS (SELECT check_in_id AS id, list_sort(list(DISTINCT tag)) AS tags FROM ct GROUP BY 1)"""
_CELL = "CASE WHEN regexp_matches({0}, '[,\"\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
_BOOT = f"""{DIARY}, rows AS (SELECT subject_id, 't:' || subject_id AS test_id, row_number() OVER (PARTITION BY subject_id ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n, sleep_minutes, CAST(energy AS DOUBLE) AS energy FROM diary WHERE sleep_minutes IS NOT NULL), {boot("rows", "", "sleep_minutes", "energy", REPS, "b")},
stats AS (SELECT subject_id, CAST(rep AS INTEGER) AS rep, {pearson("a", "b")} AS r FROM b_pairs GROUP BY ALL)"""
_PAIRS = f"WITH {EVENTS_INPUT}, {aligned('pairs0')}, pairs AS (SELECT subject_id, outcome, predictor, lag, day, weekend, round(y, 9) AS y, round(x, 9) AS x FROM pairs0)"
_STRENGTH = "CASE WHEN abs(effect) < 0.2 THEN NULL WHEN abs(effect) < 0.35 THEN 'weak' WHEN abs(effect) < 0.55 THEN 'moderate' ELSE 'strong' END"
_EVENT_TESTS = f"WITH {EVENTS_INPUT}, {aligned()}, {correlations()}"


def _labels(v: str, labels: tuple[str, ...]) -> str:
    return "CASE " + v + " " + " ".join(f"WHEN {k - 3} THEN '{x}'" for k, x in enumerate(labels[:-1])) + f" ELSE '{labels[-1]}' END"


def oracle_sql() -> dict[str, str]:
    days = ", ".join(f"'{w}'" for w in WEEKDAYS)
    return {
        "daily_mean": f"WITH {EVENTS_INPUT} SELECT subject_id, metric_key, day, round(value, 6) AS value FROM ev",
        "tag_days": "SELECT DISTINCT user_id, event_type AS tag, CAST(ts AS DATE) AS day FROM events",
        "day_boundary": f"WITH {CHECK} SELECT id, day, sleep_day FROM c",
        "unpivot_metrics": f"WITH {DIARY}, long AS ({_LONG} UNION ALL SELECT subject_id, 'screen_minutes', day, screen_minutes FROM diary WHERE screen_minutes IS NOT NULL UNION ALL SELECT subject_id, 'unlock_count', day, unlock_count FROM diary WHERE unlock_count IS NOT NULL) SELECT subject_id, metric_key, day, round(value, 6) AS value FROM long",
        "demo_seed": f"WITH {demo()} SELECT subject_id, i, day, mood, energy, array_to_string(tags, ';') AS tags, round(sleep_minutes, 6) AS sleep_minutes, unlock_count, round(exercise_minutes, 6) AS exercise_minutes FROM demo",
        "lag_align": f"WITH {EVENTS_INPUT}, {aligned()} SELECT outcome, predictor, lag, day, round(y, 6) AS y, round(x, 6) AS x, weekend FROM pairs",
        "weekend_flag": f"SELECT day, isodow(day) >= 6 AS weekend, [{days}][isodow(day)] AS name, CAST(day - DATE '1970-01-01' AS INTEGER) AS epoch_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
        "avg_rank": f"SELECT event_id, {rank('floor(value)', 'event_type')} AS rnk FROM events",
        "pearson": f"{_PAIRS} SELECT outcome, predictor, lag, count(*) AS n, round({pearson('x', 'y')}, 6) AS r FROM pairs GROUP BY ALL",
        "spearman": f"{_PAIRS}, q AS (SELECT *, {rank('x', PAIR)} AS qx, {rank('y', PAIR)} AS qy FROM pairs) SELECT outcome, predictor, lag, CAST(count(*) AS INTEGER) AS n, round({pearson('qx', 'qy')}, 6) AS effect FROM q GROUP BY ALL",
        "group_stats": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0), 6) AS difference, "
        "round((avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0)) / stddev_samp(value), 6) AS d, count(*) FILTER (user_id % 2 = 1) AS n_in, count(*) FILTER (user_id % 2 = 0) AS n_out FROM events GROUP BY 1",
        "centred_mean": f"WITH {ORDERS} SELECT metric_key, day, round(avg(value) OVER (PARTITION BY metric_key ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 14 DAYS FOLLOWING), 6) AS trend FROM orders_daily",
        "trailing_mean": f"WITH {ORDERS}, t AS (SELECT *, avg(value) OVER w AS mean, count(*) OVER w AS n FROM orders_daily WINDOW w AS (PARTITION BY metric_key ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) SELECT metric_key, day, round(mean, 6) AS mean FROM t WHERE n >= 3",
        "sleep_baseline": f"WITH {NIGHTS}, {debt('nights')} SELECT subject_id, day, round(baseline, 6) AS baseline FROM based",
        "sleep_debt": f"WITH {NIGHTS}, {debt('nights')} SELECT subject_id, day, round(debt, 6) AS debt FROM debts",
        "line_segments": "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), b AS (SELECT *, CASE WHEN day - lag(day) OVER w = 1 THEN 0 ELSE 1 END AS x FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, CAST(sum(x) OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS segment_id FROM b",
        "chart_coordinates": f"WITH {ORDERS}, r AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM orders_daily WINDOW w AS (PARTITION BY metric_key)) SELECT metric_key, day, round((day - DATE '1998-10-03') / 89.0, 6) AS cx, "
        "round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS cy FROM r WHERE day BETWEEN DATE '1998-10-03' AND DATE '1998-12-31'",
        "residuals": f"WITH {EVENTS_INPUT}, {aligned()}, {correlations(null=False)} SELECT outcome, predictor, lag, day, round(rx, 6) AS rx, round(ry, 6) AS ry FROM c_rows",
        "residuals_of_many": f"WITH {EVENTS_INPUT}, {aligned()}, aged AS (SELECT *, day - DATE '2020-01-01' AS age FROM pairs), {adjust_many('aged', 'fitted', 'subject_id, outcome, predictor, lag', 'y', ['weekend', 'x', 'age'], 'res')} "
        "SELECT outcome, predictor, lag, day, round(res, 6) AS res FROM fitted",
        "circular_shift": f"WITH {DIARY} SELECT subject_id, CAST((row_number() OVER w - 1 + 3) % count(*) OVER (PARTITION BY subject_id) AS INTEGER) AS pos, mood FROM diary WINDOW w AS (PARTITION BY subject_id ORDER BY day)",
        "block_permute": f"WITH {DIARY}, r AS (SELECT subject_id, 't:' || subject_id AS test_id, row_number() OVER (PARTITION BY subject_id ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n, CAST(energy AS DOUBLE) AS ry FROM diary), "
        f"h AS (SELECT subject_id, n, draw, {mix('xor(h0, draw)', 'h')} FROM (SELECT DISTINCT subject_id, n, {seed_of('test_id')} AS h0 FROM r), range({THRESHOLDS.null_samples}) AS d(draw)), g AS (SELECT h.subject_id, h.n, draw, h, pos, ry, {mix('xor(h, pos)', 'g')} FROM h JOIN r USING (subject_id)), "
        f"b AS (SELECT *, CAST(sum(CASE WHEN pos = 0 OR g / 4294967296.0::DOUBLE <= 1.0::DOUBLE / {BLOCK.format('n')} THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id, draw ORDER BY pos) AS BIGINT) AS block FROM g), k AS (SELECT *, {mix('xor(h, block)', 'k1')}, {mix('xor(k1, 1)', 'k2')} FROM b), "
        "o AS (SELECT subject_id, draw, ry, row_number() OVER (PARTITION BY subject_id, draw ORDER BY k2, block, pos) AS place FROM k) SELECT subject_id, CAST(draw AS INTEGER) AS draw, sum(ry * place) AS weighed FROM o GROUP BY ALL",
        "block_bootstrap": f"WITH {_BOOT} SELECT subject_id, rep, round(r, 6) AS r FROM stats",
        "quantile_ci": f"WITH {_BOOT} SELECT subject_id, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM stats GROUP BY 1",
        "se_interval": f"WITH {_BOOT}, e AS (SELECT subject_id, {fz('avg(r)')} AS m, stddev_samp({fz('r')}) AS se FROM stats GROUP BY 1) SELECT subject_id, round(tanh(m - 1.959963984540054 * se), 6) AS low, round(tanh(m + 1.959963984540054 * se), 6) AS high, "
        f"round(greatest(0.0, least(1.0, 2 * (1 - {ncdf('(abs(m) / se)')}))), 6) AS p FROM e",
        "rotation_null": f"{_EVENT_TESTS} SELECT test_id, n, round(effect, 6) AS effect, round(null_sd, 6) AS null_sd, 'exact' AS null_method FROM c_tests",
        "rotation_null_by_user": f"""WITH {USERS_INPUT}, {aligned()}, {correlations()} SELECT subject_id, test_id, n, round(effect, 6) AS effect, round(null_sd, 6) AS null_sd FROM c_tests""",
        "block_null": f"WITH {DIARY_INPUT}, {comparisons('w', 'DAY_OF_WEEK')} SELECT subject_id, test_id, n, round(effect, 6) AS effect, round(null_sd, 6) AS null_sd FROM w_tests",
        "normal_curve": f"WITH e AS (SELECT event_id, (value - 50) / 25 AS z, (event_id % 997 + 1) / 998.0::DOUBLE AS p, event_id % 500 + 4 AS n FROM events) SELECT event_id, round({ncdf('z')}, 6) AS cdf, round({nquant('p')}, 6) AS quantile, round({t_sf('z')}, 6) AS t_sf, round({fz('(z / 4)')}, 6) AS fz, {BLOCK.format('n')} AS block, CAST(greatest(3, (n - 4) // 20) AS INTEGER) AS margin FROM e",
        "corr_tests": f"{_EVENT_TESTS}, te AS (SELECT *, {fz('effect')} AS te FROM c_tests), {scored('te')} SELECT test_id, kind, n, round(effect, 6) AS effect, round(p, 6) AS p, strength, confidence FROM scored",
        "bh_threshold": "WITH t AS (SELECT user_id, event_id, ((event_id * 7919) % 1000 / 1000.0::DOUBLE) AS v FROM events), p AS (SELECT *, v * v * v AS p FROM t), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS family, row_number() OVER (PARTITION BY user_id ORDER BY p) AS k FROM p), "
        "b AS (SELECT *, max(CASE WHEN p <= k / family * 0.1::DOUBLE THEN p END) OVER (PARTITION BY user_id) AS bh FROM k) SELECT event_id, CAST(family AS INTEGER) AS family, round(bh, 6) AS bh, CASE WHEN bh IS NULL OR p > bh THEN NULL WHEN p <= 0.05::DOUBLE / family THEN 'CLEAR' ELSE 'TENTATIVE' END AS confidence FROM b",
        "tag_tests": f"WITH {DIARY_INPUT}, {comparisons('t', 'TAG')}, te AS (SELECT *, effect AS te FROM t_tests), {scored('te')} SELECT subject_id, test_id, n, round(effect, 6) AS effect, round(raw_difference, 6) AS raw_difference, round(p, 6) AS p, confidence FROM scored",
        "dow_tests": f"WITH {DIARY_INPUT}, {comparisons('w', 'DAY_OF_WEEK')}, te AS (SELECT *, effect AS te FROM w_tests), {scored('te')} SELECT subject_id, test_id, n, round(effect, 6) AS effect, round(raw_difference, 6) AS raw_difference, round(p, 6) AS p, confidence FROM scored",
        "reverse_check": f"WITH {DIARY_INPUT}, {aligned('back', 'predictors', 'outcomes')}, {correlations('v', 'back', False)} SELECT subject_id, predictor AS outcome, outcome AS predictor, lag, round(effect, 6) AS reverse FROM v_e WHERE lag > 0",
        "strength_bands": f"WITH l AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10 - 0.5, 6) AS effect FROM lineitem) SELECT l_orderkey, l_linenumber, {_STRENGTH} AS strength, CASE WHEN effect >= 0 THEN 'higher' ELSE 'lower' END AS direction, round(abs(effect) * CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END, 6) AS score, CASE WHEN l_linenumber = 1 THEN 'the day before' ELSE l_linenumber || ' days earlier' END AS phrase FROM l",
        "dedupe_rank": "SELECT 'corr:' || l_orderkey AS pair, 'corr:' || l_orderkey || ':lag' || arg_max(l_linenumber, struct_pack(a := l_discount, b := -l_linenumber)) AS test_id FROM lineitem GROUP BY l_orderkey",
        "student_t": """WITH e AS (SELECT event_id, (value - 50) / 25 AS t, event_id % 40 + 1 AS df, (event_id % 97 + 1) / 7.0::DOUBLE AS x FROM events),
  a AS (SELECT *, atan(abs(t) / sqrt(df)) AS th, df % 2 AS odd FROM e),
  i AS (SELECT *, CASE WHEN odd = 0 THEN sin(th) * list_sum(list_transform(range(df // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(th), 2 * j)))
    ELSE 2 / pi() * (th + coalesce(sin(th) * cos(th) * list_sum(list_transform(range((df - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j))), 0)) END AS inside FROM a)
  SELECT event_id, round(CASE WHEN t < 0 THEN (1 + inside) / 2 ELSE (1 - inside) / 2 END, 6) AS t_sf, round(lgamma(x), 6) AS ln_gamma FROM i""",
        "pending": f"""WITH {events_input(True, "'purchase', 'view'", "'click', 'error', 'signup'")}, n AS (SELECT subject_id, CAST(max(n) AS INTEGER) AS days FROM (SELECT subject_id, metric_key, count(*) AS n FROM outcomes GROUP BY ALL) GROUP BY 1),
  g(id, label, need) AS (VALUES ('same_day', 'Same-day patterns', 14), ('lagged', 'Effects of previous days', 21), ('day_of_week', 'Day-of-week pattern', 42)),
  a AS (SELECT subject_id, coalesce(days, 0) AS days FROM n FULL JOIN (SELECT DISTINCT subject_id FROM predictors) p USING (subject_id)),
  r AS (SELECT subject_id, id, label, days AS days_available, need AS days_required FROM a, g WHERE days < need UNION ALL SELECT subject_id, 'sleep', 'Sleep effects', 0, 21 FROM a)
  SELECT *, greatest(0, days_required - days_available) AS days_remaining, round(greatest(0.0, least(1.0, days_available / days_required)), 6) AS progress FROM r""",
        "report": f"WITH {REPORT}",
        "report_summary": f"WITH {REPORT.rsplit(chr(10) + 'SELECT subject_id, CAST(place', 1)[0]}, ran AS (SELECT subject_id, CAST(count(*) AS INTEGER) AS tests_run FROM scored GROUP BY 1), got AS (SELECT subject_id, CAST(count(*) FILTER (confidence = 'CLEAR') AS INTEGER) AS clear, CAST(count(*) FILTER (confidence = 'TENTATIVE') AS INTEGER) AS tentative FROM f3 GROUP BY 1) "
        "SELECT subject_id, tests_run, coalesce(clear, 0) AS clear, coalesce(tentative, 0) AS tentative, 0 AS waiting, CASE WHEN coalesce(clear, 0) + coalesce(tentative, 0) = 0 THEN 'Nothing stands out yet' END AS message FROM ran LEFT JOIN got USING (subject_id)",
        "next_reminder": f"WITH {CHECK}, w AS (SELECT id, 21 * 3600000000 - epoch_us(ts + {HOURS}) % 86400000000 AS us FROM c) SELECT id, round((CASE WHEN us > 0 THEN us ELSE us + 86400000000 END) / 60000000.0::DOUBLE, 6) AS minutes FROM w",
        "report_tests": f"WITH {ALL_TESTS} SELECT subject_id, test_id, kind, n, round(effect, 6) AS effect, round(null_sd, 6) AS null_sd, round(p, 6) AS p, CAST(family AS INTEGER) AS family, confidence FROM scored",
        "csv_export": f"WITH {CHECK} SELECT id, concat_ws(',', CAST(day AS VARCHAR), CAST(epoch_us(ts) // 1000 AS VARCHAR), zone_id, CAST(mood AS VARCHAR), CAST(energy AS VARCHAR), {_CELL.format(chr(40) + 'array_to_string(tags, ' + chr(39) + ';' + chr(39) + '))')}, {_CELL.format(chr(40) + 'coalesce(note, ' + chr(39) * 2 + '))')}) AS line FROM c JOIN own USING (id)",
        "json_export": f"WITH {CHECK} SELECT id, CAST(to_json({{'timestampUtc': epoch_us(ts) // 1000, 'zoneId': zone_id, 'localDate': CAST(day AS VARCHAR), 'mood': mood, 'energy': energy, 'note': note, 'tags': tags}}) AS VARCHAR) AS json FROM c JOIN own USING (id)",
        "upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
        "save_check_ins": f"WITH {CHECK} SELECT id, day, CASE WHEN id % 3 = 0 THEN 3 ELSE mood END AS mood, energy, CASE WHEN id % 6 = 0 THEN '  ' WHEN id % 3 = 0 THEN NULL ELSE note END AS note FROM c WHERE id % 2 = 0 OR id % 3 = 0",
        "cascade_delete": f"WITH {CHECK} SELECT id, 'check_in' AS what FROM c WHERE mood >= 0 UNION ALL SELECT check_in_id, ct.tag FROM ct JOIN c ON c.id = check_in_id WHERE mood >= 0",
        "replace_tags": f"WITH {CHECK} SELECT check_in_id, tag FROM ct WHERE check_in_id % 4 <> 1 UNION ALL SELECT DISTINCT check_in_id, 'new' FROM ct WHERE check_in_id % 4 = 1",
        "add_tags": f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {k}, true)' for k, t in enumerate(DEFAULT_TAGS))}) AS t(name, sort_order, enabled) UNION ALL SELECT DISTINCT lower(p_brand), 2147483647, true FROM part",
        "day_count": "SELECT count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows, CAST(max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS INTEGER) AS span FROM events",
        "scale_labels": f"WITH {CHECK} SELECT id, mood, {_labels('mood', text.MOOD)} AS mood_label, {_labels('energy', text.ENERGY)} AS energy_label, CASE WHEN mood > 0 THEN '+' || mood ELSE CAST(mood AS VARCHAR) END AS signed FROM c",
        "format_minutes": "WITH m AS (SELECT event_id, CAST(trunc(value * 7) AS INTEGER) AS t FROM events) SELECT event_id, CASE WHEN t // 60 > 0 THEN (t // 60) || 'h ' || (t % 60) || 'm' ELSE (t % 60) || 'm' END AS minutes FROM m",
        "scan_since": f"WITH {CHECK} SELECT id, day, array_to_string(tags, ';') AS tags FROM c JOIN own USING (id) WHERE day >= DATE '2024-01-20'",
        "last_value": "SELECT user_id, CAST(ts AS DATE) AS day, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
    }
