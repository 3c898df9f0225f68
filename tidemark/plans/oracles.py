"""The queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

TICKS = """ticks AS (SELECT {asset} AS asset, ts, event_id AS seq, 100.0 + value AS bid_price, 100.0 + value + 0.01 * (1 + user_id % 5) AS ask_price,
  CAST(1 + user_id % 7 AS DOUBLE) AS bid_volume, CAST(1 + event_id % 5 AS DOUBLE) AS ask_volume FROM events)"""


def r(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


EP = "CAST(floor(epoch({0})) AS BIGINT) AS {0}"


def at(c: str = "ts") -> str:
    return EP.format(c)


def bars(*, by_type: bool = True, step: str = "1 hour", price: str = "bid_price", name: str = "bars", origin: str = "TIMESTAMP '1970-01-01'") -> str:
    """Common table expressions that end with the enriched bars."""
    return f"""{TICKS.format(asset='event_type' if by_type else "'ALL'")},
raw AS (SELECT asset, time_bucket(INTERVAL {step}, ts, {origin}) + INTERVAL {step} AS ts, arg_min({price}, (ts, seq)) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, (ts, seq)) AS close,
  sum(bid_volume) + sum(ask_volume) AS volume, sum(bid_volume) AS bid_volume, sum(ask_volume) AS ask_volume, avg(ask_price - bid_price) AS spread_mean, max(ask_price - bid_price) AS spread_max,
  arg_max(ask_price - bid_price, (ts, seq)) AS spread_close, arg_max(ask_price, (ts, seq)) AS ask_close, count(*) AS tick_count FROM ticks GROUP BY 1, 2),
{name} AS (SELECT *, ts = min(ts) OVER (PARTITION BY asset) OR ts = max(ts) OVER (PARTITION BY asset) AS is_partial FROM raw)"""


W = "(PARTITION BY asset ORDER BY ts)"


def frame(a: int, b: int) -> str:
    side = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"(PARTITION BY asset ORDER BY ts ROWS BETWEEN {side(a)} AND {side(b)})"


def guarded(f: str, x: str, over: str, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {over} >= {least} THEN {f} OVER {over} END"


def margin(x: str) -> str:
    return f"0.5 + 0.5 * least(greatest(coalesce({x}, 0), 0), 1)"


def cases(*rows: tuple[str, str, str]) -> str:
    """regime and confidence of the first case that holds."""
    label = " ".join(f"WHEN {w} THEN '{name}'" for w, name, _ in rows)
    score = " ".join(f"WHEN {w} THEN {c}" for w, _, c in rows)
    return f"CASE {label} ELSE 'INCONNU' END AS regime, CASE {score} ELSE 0 END AS confidence"


def detector(ctes: str, last: str, measures: dict[str, str] | None = None, pick: str = "regime") -> str:
    """A detector's rows with partial bars masked; measures by kind: r rounded, t time, v as it is."""
    shown = []
    for m, kind in (measures or {}).items():
        x = f"CASE WHEN NOT is_partial THEN {m} END"
        shown.append(r(x, m) if kind == "r" else f"CAST(floor(epoch({x})) AS BIGINT) AS {m}" if kind == "t" else f"{x} AS {m}")
    return f"""WITH RECURSIVE {ctes}
SELECT asset, {at()}, CASE WHEN is_partial THEN 'INCONNU' ELSE {pick} END AS regime, {r('CASE WHEN is_partial THEN 0 ELSE confidence END', 'confidence')}{''.join(', ' + x for x in shown)} FROM {last}"""


TR = f"b0 AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER {W}, close)), abs(low - coalesce(lag(close) OVER {W}, close))) AS tr FROM bars)"


def atr(q: str = "bars") -> str:
    """Expressions that end with ``lab``: labels of the volatility detector, before masking."""
    f = frame(-50, -1)
    return f"""{bars()}, {TR},
b1 AS (SELECT *, avg(tr) OVER {frame(-13, 0)} AS atr, sign(close - lag(close, 20) OVER {W}) AS dir FROM b0),
b2 AS (SELECT *, {guarded('quantile_cont(atr, 0.33)', 'atr', f, 25)} AS lo, {guarded('quantile_cont(atr, 0.67)', 'atr', f, 25)} AS hi FROM b1),
lab AS (SELECT *, {cases(("atr >= hi AND dir > 0", "TENDANCE_HAUSSIERE", margin("(atr - hi) / nullif(hi, 0)")), ("atr >= hi AND dir < 0", "TENDANCE_BAISSIERE", margin("(atr - hi) / nullif(hi, 0)")), ("atr <= lo", "RANGE", margin("(lo - atr) / nullif(lo, 0)")), ("lo IS NOT NULL", "CHOP", "0.5"))} FROM b2)"""


def labelled() -> str:
    """``rows``: hourly bars with the volatility label, null where it doesn't count."""
    return f"""{atr()},
rows AS (SELECT * EXCLUDE (regime, confidence), CASE WHEN NOT is_partial AND regime <> 'INCONNU' THEN regime END AS regime, CASE WHEN is_partial THEN 0 ELSE confidence END AS confidence FROM lab)"""


def episode(label: str = "regime", source: str = "rows") -> str:
    return f"""e0 AS (SELECT *, CASE WHEN {label} IS NULL THEN 0 WHEN lag({label}) OVER {W} = {label} AND ts - lag(ts) OVER {W} = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM {source}),
eps AS (SELECT *, CASE WHEN {label} IS NOT NULL THEN sum(new) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS episode FROM e0)"""


def er() -> str:
    f = frame(-50, -1)
    return f"""{bars()},
b0 AS (SELECT *, abs(close - lag(close) OVER {W}) AS step, sign(close - lag(close, 10) OVER {W}) AS dir, abs(close - lag(close, 10) OVER {W}) AS net FROM bars),
b1 AS (SELECT *, CASE WHEN count(step) OVER {frame(-9, 0)} >= 10 THEN sum(step) OVER {frame(-9, 0)} END AS path FROM b0),
b2 AS (SELECT *, CASE WHEN path > 0 THEN least(greatest(net / path, 0), 1) END AS er FROM b1),
b3 AS (SELECT *, {guarded('quantile_cont(er, 0.4)', 'er', f, 25)} AS lo, {guarded('quantile_cont(er, 0.6)', 'er', f, 25)} AS hi FROM b2),
lab AS (SELECT *, {cases(("er >= hi AND dir > 0", "TENDANCE_HAUSSIERE", margin("(er - hi) / nullif(1 - hi, 0)")), ("er >= hi AND dir < 0", "TENDANCE_BAISSIERE", margin("(er - hi) / nullif(1 - hi, 0)")), ("er >= hi", "CHOP", "0.5"), ("er <= lo", "CHOP", margin("(lo - er) / nullif(lo, 0)")), ("er IS NOT NULL AND lo IS NOT NULL", "RANGE", "0.5"))} FROM b3)"""


def adx(n: int = 7) -> str:
    return f"""{bars()}, {TR},
m AS (SELECT *, row_number() OVER {W} - 1 AS k, high - lag(high) OVER {W} AS up, lag(low) OVER {W} - low AS down FROM b0),
d AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM m),
seed AS (SELECT asset, sum(tr) AS s, sum(pdm) AS p, sum(mdm) AS q FROM d WHERE k BETWEEN 1 AND {n - 1} GROUP BY asset),
rec AS (SELECT asset, CAST({n - 1} AS BIGINT) AS k, s, p, q FROM seed UNION ALL
  SELECT rec.asset, d.k, rec.s + (d.tr - rec.s / {n}), rec.p + (d.pdm - rec.p / {n}), rec.q + (d.mdm - rec.q / {n}) FROM rec JOIN d ON d.asset = rec.asset AND d.k = rec.k + 1),
di AS (SELECT asset, k, CASE WHEN s > 0 THEN 100 * p / s ELSE 0 END AS pdi, CASE WHEN s > 0 THEN 100 * q / s ELSE 0 END AS mdi FROM rec WHERE k >= {n}),
dx AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx FROM di),
first AS (SELECT asset, avg(dx) AS a FROM dx WHERE k BETWEEN {n} AND {2 * n - 1} GROUP BY asset),
wil AS (SELECT asset, CAST({2 * n - 1} AS BIGINT) AS k, a FROM first UNION ALL SELECT wil.asset, dx.k, wil.a + (dx.dx - wil.a) / {n} FROM wil JOIN dx ON dx.asset = wil.asset AND dx.k = wil.k + 1),
j AS (SELECT d.*, dx.pdi, dx.mdi, wil.a AS adx FROM d LEFT JOIN dx ON dx.asset = d.asset AND dx.k = d.k LEFT JOIN wil ON wil.asset = d.asset AND wil.k = d.k),
lab AS (SELECT *, {cases(("adx < 20", "RANGE", margin("(20 - adx) / 20")), ("adx >= 25 AND pdi > mdi", "TENDANCE_HAUSSIERE", margin("(adx - 25) / 75")), ("adx >= 25 AND pdi < mdi", "TENDANCE_BAISSIERE", margin("(adx - 25) / 75")), ("adx IS NOT NULL", "CHOP", "0.5"))} FROM j)"""


RET = f"b0 AS (SELECT *, ln(close / lag(close) OVER {W}) AS ret FROM bars)"


def shannon(f: int = 20, bins: int = 5) -> str:
    return f"""{bars()}, {RET},
b1 AS (SELECT *, list_filter(list(ret) OVER {frame(-(f - 1), 0)}, lambda x: x IS NOT NULL) AS seen, count(*) OVER {frame(-(f - 1), 0)} AS held FROM b0),
b2 AS (SELECT *, list_min(seen) AS lo, list_max(seen) AS hi FROM b1),
b3 AS (SELECT *, list_transform(range({bins}), lambda b: len(list_filter(seen, lambda x: least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) = b)) / len(seen)) AS share FROM b2),
b4 AS (SELECT *, CASE WHEN held = {f} AND len(seen) >= {f // 2} THEN CASE WHEN (hi - lo) / greatest(abs(lo), abs(hi), 1e-12) < 1e-9 THEN 0.0 ELSE list_sum(list_transform(list_filter(share, lambda q: q > 0), lambda q: -q * ln(q))) / ln({bins}.0) END END AS shannon_value FROM b3),
lab AS (SELECT *, {cases(("shannon_value < 0.65", "ORDONNE", margin("1 - shannon_value / 0.65")), ("shannon_value > 0.78", "DESORDRE", margin("(shannon_value - 0.78) / (1 - 0.78)")), ("shannon_value IS NOT NULL", "NEUTRE", "0.5"))} FROM b4)"""


def minkowski() -> str:
    f = frame(-50, -1)
    return f"""{bars()}, {RET},
b1 AS (SELECT *, {guarded('quantile_cont(abs(ret), 0.9)', 'ret', f, 25)} AS c FROM b0),
b2 AS (SELECT *, CASE WHEN c > 0 THEN c * c - ret * ret END AS minkowski_ds2, CASE WHEN c > 0 THEN abs(ret) / c END AS minkowski_beta FROM b1),
lab AS (SELECT *, {cases(("abs(minkowski_ds2) <= 0.01 * c * c", "LIGHTLIKE", "0.5"), ("minkowski_ds2 > 0", "TIMELIKE", margin("abs(minkowski_ds2) / (c * c)")), ("minkowski_ds2 IS NOT NULL", "SPACELIKE", margin("abs(minkowski_ds2) / (c * c)")))} FROM b2)"""


def pca(f: int = 20) -> str:
    w = frame(-f, -1)
    return f"""{bars()},
b0 AS (SELECT *, CAST(row_number() OVER {W} AS DOUBLE) AS t, ln(close) AS lp FROM bars),
b1 AS (SELECT *, count(lp) OVER {w} = {f} AS ready, max(lp) OVER {w} = min(lp) OVER {w} AS flat, covar_pop(t, lp) OVER {w} AS cv, stddev_pop(t) OVER {w} * stddev_pop(lp) OVER {w} AS sp FROM b0),
b2 AS (SELECT *, CASE WHEN ready THEN CASE WHEN flat THEN 0.0 ELSE least(greatest(cv / sp, -1), 1) END END AS pca_direction FROM b1),
b3 AS (SELECT *, CASE WHEN ready THEN CASE WHEN flat THEN 1.0 ELSE (1 + abs(pca_direction)) / 2 END END AS pca_eigen_ratio FROM b2),
b4 AS (SELECT *, pca_eigen_ratio AS pca_variance_ratio FROM b3),
lab AS (SELECT *, {cases(("pca_eigen_ratio > 0.65 AND pca_direction > 0.3", "HAUSSIER", margin("(abs(pca_direction) - 0.3) / 0.7")), ("pca_eigen_ratio > 0.65 AND pca_direction < -0.3", "BAISSIER", margin("(abs(pca_direction) - 0.3) / 0.7")), ("pca_direction IS NOT NULL", "NEUTRE", "0.5"))} FROM b4)"""


def pivots(n: int = 2, source: str = "bars") -> str:
    """``piv``: alternating pivots with the last two values of each kind."""
    a, b = frame(-n, -1), frame(1, n)
    return f"""fr AS (SELECT *, count(*) OVER {a} = {n} AND count(*) OVER {b} = {n} AS inside, greatest(max(high) OVER {a}, max(high) OVER {b}) AS h, least(min(low) OVER {a}, min(low) OVER {b}) AS l FROM {source}),
marks AS (SELECT asset, ts, 0 AS o, 'S' AS kind, high AS value FROM fr WHERE inside AND high > h UNION ALL SELECT asset, ts, 1, 'C', low FROM fr WHERE inside AND low < l),
mk AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY asset ORDER BY ts, o) = kind THEN 0 ELSE 1 END AS new FROM marks),
runs AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY ts, o ROWS UNBOUNDED PRECEDING) AS run FROM mk),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY asset, run ORDER BY CASE WHEN kind = 'S' THEN -value ELSE value END, ts, o) = 1),
lags AS (SELECT *, lag(value, 1) OVER p AS v1, lag(value, 2) OVER p AS v2, lag(value, 3) OVER p AS v3 FROM best WINDOW p AS (PARTITION BY asset ORDER BY ts, o)),
piv AS (SELECT asset, ts, o, CASE WHEN kind = 'S' THEN value ELSE v1 END AS s1, CASE WHEN kind = 'S' THEN v2 ELSE v3 END AS s2, CASE WHEN kind = 'S' THEN v1 ELSE value END AS c1, CASE WHEN kind = 'S' THEN v3 ELSE v2 END AS c2 FROM lags)"""


CARRY = "(PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def structure(source: str) -> str:
    """``lbl``: label and score of pivots against a tolerance of half an ATR."""
    t = "(CASE WHEN coalesce(0.5 * tol_atr, 0.0005) <= 0 THEN 1e-12 ELSE coalesce(0.5 * tol_atr, 0.0005) END)"
    return f"""st AS (SELECT *, {t} AS t, s1 - s2 AS ds, c1 - c2 AS dc FROM {source}),
lbl AS (SELECT *, CASE WHEN ds IS NULL OR dc IS NULL THEN NULL WHEN ds > t AND dc > t THEN 'TENDANCE_HAUSSIERE' WHEN ds < -t AND dc < -t THEN 'TENDANCE_BAISSIERE' WHEN abs(ds) <= t AND abs(dc) <= t THEN 'RANGE' ELSE 'CHOP' END AS label,
  CASE WHEN ds IS NULL OR dc IS NULL THEN NULL WHEN ds > t AND dc > t THEN {margin('(least(ds, dc) - t) / t')} WHEN ds < -t AND dc < -t THEN {margin('(least(-ds, -dc) - t) / t')} WHEN abs(ds) <= t AND abs(dc) <= t THEN 0.5 + 0.5 * (1 - least(greatest(abs(ds), abs(dc)) / t, 1)) ELSE 0.5 END AS score FROM st)"""


def price_action() -> str:
    return f"""{bars()}, {TR},
ba AS (SELECT *, avg(tr) OVER {frame(-13, 0)} AS tol_atr FROM b0), {pivots(2, 'ba')},
pa AS (SELECT piv.*, ba.tol_atr FROM piv JOIN ba USING (asset, ts)), {structure('pa')},
last AS (SELECT * FROM lbl WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset, ts ORDER BY o DESC) = 1),
j AS (SELECT ba.*, last.label, last.score FROM ba LEFT JOIN last USING (asset, ts)),
lab AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER {CARRY}, 'INCONNU') AS regime, coalesce(last_value(score IGNORE NULLS) OVER {CARRY}, 0) AS confidence FROM j)"""


def price_action_causal(n: int = 2) -> str:
    a, b, full = frame(-2 * n, -n - 1), frame(-n + 1, 0), frame(-2 * n, 0)
    return f"""{bars()}, {TR},
ba AS (SELECT *, avg(tr) OVER {frame(-13, 0)} AS tol_atr, CASE WHEN is_partial THEN 0 ELSE 1 END AS good FROM b0),
cf AS (SELECT *, sum(good) OVER {full} = {2 * n + 1} AS whole, lag(high, {n}) OVER {W} AS ch, lag(low, {n}) OVER {W} AS cl, lag(ts, {n}) OVER {W} AS seen_at, greatest(max(high) OVER {a}, max(high) OVER {b}) AS h, least(min(low) OVER {a}, min(low) OVER {b}) AS l FROM ba),
fl AS (SELECT *, coalesce(whole AND ch > h, false) AS p, coalesce(whole AND cl < l, false) AS q FROM cf),
ev AS (SELECT asset, ts, seen_at, tol_atr, CASE WHEN p THEN 'S' ELSE 'C' END AS kind, CASE WHEN p THEN ch ELSE cl END AS value FROM fl WHERE p <> q),
e1 AS (SELECT *, CASE WHEN lag(kind) OVER {W} = kind THEN 0 ELSE 1 END AS new, CASE WHEN kind = 'S' THEN value ELSE -value END AS x FROM ev),
e2 AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e1),
e3 AS (SELECT *, max(x) OVER (PARTITION BY asset, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e2),
e4 AS (SELECT * FROM e3 WHERE before IS NULL OR x > before),
fin AS (SELECT asset, run, max(x) * max(CASE WHEN kind = 'S' THEN 1 ELSE -1 END) AS final FROM e4 GROUP BY asset, run),
lg AS (SELECT *, lag(final, 1) OVER p AS f1, lag(final, 2) OVER p AS f2, lag(final, 3) OVER p AS f3 FROM fin WINDOW p AS (PARTITION BY asset ORDER BY run)),
pa AS (SELECT e4.*, CASE WHEN kind = 'S' THEN value ELSE f1 END AS s1, CASE WHEN kind = 'S' THEN f2 ELSE f3 END AS s2, CASE WHEN kind = 'S' THEN f1 ELSE value END AS c1, CASE WHEN kind = 'S' THEN f3 ELSE f2 END AS c2 FROM e4 JOIN lg USING (asset, run)), {structure('pa')},
j AS (SELECT ba.*, CASE WHEN lbl.ts IS NOT NULL THEN coalesce(lbl.label, 'INCONNU') END AS label, CASE WHEN lbl.ts IS NOT NULL THEN coalesce(lbl.score, 0) END AS score, lbl.seen_at AS pivot_observed_at, lbl.ts AS pivot_confirmed_at, coalesce(lbl.kind, '') AS pivot_kind, coalesce(lbl.before IS NOT NULL AND lbl.ts IS NOT NULL, false) AS pivot_replaces_previous FROM ba LEFT JOIN lbl ON lbl.asset = ba.asset AND lbl.ts = ba.ts),
lab AS (SELECT *, CASE WHEN good = 1 THEN coalesce(last_value(label IGNORE NULLS) OVER {CARRY}, 'INCONNU') ELSE 'INCONNU' END AS regime, CASE WHEN good = 1 THEN coalesce(last_value(score IGNORE NULLS) OVER {CARRY}, 0) ELSE 0 END AS confidence FROM j)"""


def breakout() -> str:
    held = lambda c: f"last_value({c} IGNORE NULLS) OVER {CARRY} AS {c}"
    return f"""{bars()}, {pivots(2)},
last AS (SELECT * FROM piv WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset, ts ORDER BY o DESC) = 1),
j0 AS (SELECT bars.*, s1, s2, c1, c2 FROM bars LEFT JOIN last USING (asset, ts)),
j AS (SELECT * EXCLUDE (s1, s2, c1, c2), {held('s1')}, {held('s2')}, {held('c1')}, {held('c2')} FROM j0),
lab AS (SELECT *, {cases(("s1 > s2 AND c1 > c2 AND close < c2", "MSS_BAISSIER", "0.8"), ("s1 > s2 AND c1 > c2 AND close < c1", "CHOCH_BAISSIER", "0.6"), ("s1 < s2 AND c1 < c2 AND close > s2", "MSS_HAUSSIER", "0.8"), ("s1 < s2 AND c1 < c2 AND close > s1", "CHOCH_HAUSSIER", "0.6"), ("s2 IS NOT NULL AND c2 IS NOT NULL", "NEUTRE", "0.5"))} FROM j)"""


def ofi(f: int = 5) -> str:
    return f"""{bars()},
b0 AS (SELECT *, (ask_volume - bid_volume) / nullif(ask_volume + bid_volume, 0) AS imbalance FROM bars),
b1 AS (SELECT *, {guarded('avg(imbalance)', 'imbalance', frame(-(f - 1), 0), max(1, f // 2))} AS ofi_value FROM b0),
lab AS (SELECT *, {cases(("ofi_value > 0.1", "PRESSION_ACHETEUSE", margin("(abs(ofi_value) - 0.1) / 0.9")), ("ofi_value < -0.1", "PRESSION_VENDEUSE", margin("(abs(ofi_value) - 0.1) / 0.9")), ("ofi_value IS NOT NULL", "EQUILIBRE", "0.5"))} FROM b1)"""


def vpin(size: int = 50, w: int = 5) -> str:
    """Volumes are whole numbers here, so cumulative buckets are exact in units of one."""
    return f"""{bars()},
b0 AS (SELECT *, sum(ask_volume + bid_volume) OVER {CARRY} AS u, sum(abs(ask_volume - bid_volume)) OVER {CARRY} AS d, ask_volume + bid_volume AS v, abs(ask_volume - bid_volume) AS q FROM bars),
edge AS (SELECT b0.asset, k.k, (b0.d - b0.q + (k.k * {size} - (b0.u - b0.v)) * b0.q / b0.v) / {size} AS dk FROM b0, LATERAL (SELECT unnest(range(CAST(floor((b0.u - b0.v) / {size}) AS BIGINT) + 1, CAST(floor(b0.u / {size}) AS BIGINT) + 1)) AS k) k WHERE b0.v > 0),
ends AS (SELECT * FROM edge UNION ALL SELECT DISTINCT asset, 0, 0.0 FROM b0),
b1 AS (SELECT b0.*, CAST(floor(u / {size}) AS BIGINT) AS k FROM b0),
b2 AS (SELECT b1.*, CASE WHEN b1.k >= {w} THEN least(greatest((hi.dk - lo.dk) / {w}, 0), 1) END AS vpin_value FROM b1 LEFT JOIN ends hi ON hi.asset = b1.asset AND hi.k = b1.k LEFT JOIN ends lo ON lo.asset = b1.asset AND lo.k = b1.k - {w}),
lab AS (SELECT *, {cases(("vpin_value < 0.2", "CALME", margin("(0.2 - vpin_value) / 0.2")), ("vpin_value > 0.4", "TOXIQUE", margin("(vpin_value - 0.4) / (1 - 0.4)")), ("vpin_value IS NOT NULL", "NORMAL", "0.5"))} FROM b2)"""


def divergence() -> str:
    m, e = frame(-10, -1), frame(-20, -1)
    return f"""{bars()},
b0 AS (SELECT *, {guarded('quantile_cont(volume, 0.5)', 'volume', m, 5)} AS usual, {guarded('max(close)', 'close', e, 10)} AS top, {guarded('min(close)', 'close', e, 10)} AS bottom FROM bars),
b1 AS (SELECT *, volume / nullif(usual, 0) AS volume_rel, coalesce(close > top, false) AS is_new_high, coalesce(close < bottom, false) AS is_new_low FROM b0),
b2 AS (SELECT *, volume_rel IS NOT NULL AND top IS NOT NULL AND bottom IS NOT NULL AS ready FROM b1),
lab AS (SELECT *, {cases(("ready AND is_new_low AND NOT volume_rel > 1.2", "DIVERGENCE_BAISSIERE", "0.7"), ("ready AND is_new_high AND NOT volume_rel > 1.2", "DIVERGENCE_HAUSSIERE", "0.7"), ("ready AND is_new_low", "CONFIRMATION_BAISSIERE", "0.6"), ("ready AND is_new_high", "CONFIRMATION_HAUSSIERE", "0.6"), ("ready", "NEUTRE", "0.5"))} FROM b2)"""


def renamed(**labels: str) -> str:
    return "CASE regime " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in labels.items()) + " ELSE regime END"


GRID = "grid AS (SELECT asset, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM bars GROUP BY asset), g0 AS (SELECT grid.asset, grid.ts, bars.* EXCLUDE (asset, ts), CASE WHEN bars.ts IS NULL THEN 0 ELSE 1 END AS here, CASE WHEN bars.ts IS NULL OR bars.is_partial THEN 0 ELSE 1 END AS ok FROM grid LEFT JOIN bars ON bars.asset = grid.asset AND bars.ts = grid.ts)"


def targets(k: int = 3) -> str:
    """``tg``: forward targets on the grid; each bar from start to end must be there and whole."""
    ahead, now = frame(1, k), frame(0, k)
    first = lambda col, sign: f"(SELECT arg_min(j, (-({sign}) * v, j)) FROM (VALUES (0, close), " + ", ".join(f"({j}, lead_{col}_{j})" for j in range(1, k + 1)) + ") t(j, v))"
    leads = ", ".join(f"lead({c}, {j}) OVER {W} AS lead_{c}_{j}" for c in ("high", "low") for j in range(1, k + 1))
    whole = f"sum(ok) OVER {now} = {k + 1}"
    return f"""{GRID},
g1 AS (SELECT *, ln(close / lag(close) OVER {W}) AS ret, {leads} FROM g0),
g2 AS (SELECT *, {whole} AS whole, ln(lead(close, {k}) OVER {W} / close) AS r_, stddev_samp(ret) OVER {ahead} AS v_, min(close) OVER {now} / close - 1 AS cmin, max(close) OVER {now} / close - 1 AS cmax, greatest(close, max(high) OVER {ahead}) / close - 1 AS up_, least(close, min(low) OVER {ahead}) / close - 1 AS dn_, lead(ts, {k}) OVER {W} AS end_ FROM g1),
tg AS (SELECT asset, ts, CASE WHEN whole THEN r_ END AS ret_fwd_3, CASE WHEN whole THEN v_ END AS vol_fwd_3, CASE WHEN whole THEN cmin END AS close_min_fwd_3, CASE WHEN whole THEN cmax END AS close_max_fwd_3,
  CASE WHEN whole THEN up_ END AS mfe_long_fwd_3, CASE WHEN whole THEN dn_ END AS mae_long_fwd_3, CASE WHEN whole THEN -dn_ END AS mfe_short_fwd_3, CASE WHEN whole THEN -up_ END AS mae_short_fwd_3,
  CASE WHEN whole THEN {first('high', 1)} END AS time_mfe_long_fwd_3, CASE WHEN whole THEN {first('low', -1)} END AS time_mae_long_fwd_3, CASE WHEN whole THEN end_ END AS ret_fwd_3_end FROM g2 WHERE here = 1)"""


def profile(f: int = 20, bins: int = 10) -> str:
    """Each bar's volume is spread evenly over the bins that it touches; the area goes from the bin that reaches a fifth to that which reaches four fifths."""
    return f"""{bars()},
b0 AS (SELECT *, row_number() OVER {W} AS k, min(low) OVER {frame(-(f - 1), 0)} AS lo, max(high) OVER {frame(-(f - 1), 0)} AS hi FROM bars),
b1 AS (SELECT t.asset, t.ts, t.lo, t.hi, w.high, w.low, greatest(w.volume, 0) AS volume FROM b0 t JOIN b0 w ON w.asset = t.asset AND w.k BETWEEN t.k - {f - 1} AND t.k WHERE t.k >= {f} AND t.hi > t.lo),
b2 AS (SELECT *, least(greatest(CASE WHEN high <= low THEN floor((low - lo) / (hi - lo) * {bins}) ELSE ceil(round((low - lo) / (hi - lo) * {bins}, 9)) - 1 END, 0), {bins - 1}) AS first,
  least(greatest(CASE WHEN high <= low THEN floor((low - lo) / (hi - lo) * {bins}) ELSE ceil(round((high - lo) / (hi - lo) * {bins}, 9)) - 1 END, 0), {bins - 1}) AS last FROM b1),
b3 AS (SELECT asset, ts, any_value(lo) AS lo, any_value(hi) AS hi, j, sum(CASE WHEN j BETWEEN first AND last THEN volume / (last - first + 1) ELSE 0 END) AS held FROM b2, range({bins}) t(j) GROUP BY asset, ts, j),
b4 AS (SELECT *, sum(held) OVER (PARTITION BY asset, ts ORDER BY j ROWS UNBOUNDED PRECEDING) / nullif(sum(held) OVER (PARTITION BY asset, ts), 0) AS share FROM b3),
b5 AS (SELECT asset, ts, lo + (hi - lo) / {bins} * min(j) FILTER (share >= 0.2 - 1e-12) AS va_low, lo + (hi - lo) / {bins} * (min(j) FILTER (share >= 0.8 - 1e-12) + 1) AS va_high FROM b4 GROUP BY asset, ts, lo, hi),
b6 AS (SELECT bars.*, va_low, va_high, CASE WHEN va_low IS NOT NULL THEN CASE WHEN close < va_low THEN close - va_low WHEN close > va_high THEN close - va_high ELSE 0 END END AS distance_va FROM bars LEFT JOIN b5 ON b5.asset = bars.asset AND b5.ts = bars.ts),
lab AS (SELECT *, {cases(("close < va_low", "HORS_ZONE_BASSE", margin("abs(distance_va) / nullif(va_high - va_low, 0)")), ("close > va_high", "HORS_ZONE_HAUTE", margin("abs(distance_va) / nullif(va_high - va_low, 0)")), ("va_low IS NOT NULL", "DANS_ZONE_VALEUR", "0.5"))} FROM b6)"""


STUDY = f"{labelled()}, {targets()}, sr AS (SELECT rows.*, tg.ret_fwd_3, tg.ret_fwd_3_end FROM rows JOIN tg USING (asset, ts))"
#: ``ds``: study rows of three folds, as their bounds follow from 300 rows, a ratio of 0.7, an embargo of 2 and 3 folds.
FOLDS = f"""{STUDY}, nr AS (SELECT *, row_number() OVER {W} - 1 AS k FROM sr), z AS (SELECT CAST(floor(298 / (3 + 0.7 / (1 - 0.7))) AS BIGINT) AS t), y AS (SELECT t, CAST(round(t * 0.7 / (1 - 0.7)) AS BIGINT) AS tr FROM z),
fo AS (SELECT f AS fold, f * t AS train_lo, tr + f * t AS train_hi, tr + 2 + f * t AS test_lo, least(tr + 2 + f * t + t, 300) AS test_hi FROM y, range(3) x(f)),
tb AS (SELECT asset, fold, min(ts) AS begin FROM nr, fo WHERE k >= test_lo AND k < test_hi GROUP BY asset, fold),
ds AS (SELECT nr.*, fo.fold, 'test' AS part FROM nr, fo WHERE k >= test_lo AND k < test_hi UNION ALL SELECT nr.*, fo.fold, 'train' FROM nr, fo JOIN tb ON tb.fold = fo.fold WHERE tb.asset = nr.asset AND k >= train_lo AND k < train_hi AND ret_fwd_3_end < begin)"""
SEG = f"{labelled()}, sg AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS segment_id FROM rows)"
NY = "timezone('America/New_York', timezone('UTC', ts - INTERVAL {0}))"
LOCAL = NY.format("1 hour")
MINUTE = f"(hour({LOCAL}) * 60 + minute({LOCAL}))"
HIGH, LOW = "regime IN ('TENDANCE_HAUSSIERE', 'TENDANCE_BAISSIERE')", "regime = 'RANGE'"

ORACLES: dict[str, str] = {
    "bars_h1": f"WITH {bars()} SELECT asset, {at()}, {rs('open', 'high', 'low', 'close', 'volume', 'bid_volume', 'ask_volume', 'spread_mean', 'spread_max', 'spread_close', 'ask_close')}, tick_count, is_partial FROM bars",
    "bars_mid_m15": f"WITH {bars(by_type=False, step='15 minutes', price='(bid_price + ask_price) / 2')} SELECT asset, {at()}, {rs('open', 'high', 'low', 'close', 'volume')} FROM bars",
    "bars_ask_w1": f"WITH {bars(by_type=False, step='7 days', price='ask_price', origin=chr(84) + 'IMESTAMP ' + chr(39) + '1970-01-05' + chr(39))} SELECT asset, {at()}, {rs('open', 'high', 'low', 'close', 'volume')} FROM bars",
    "bars_gap_filled": f"""WITH {bars()},
gap AS (SELECT *, CAST(epoch(lead(ts) OVER {W}) - epoch(ts) AS BIGINT) - 3600 AS g FROM raw),
flat AS (SELECT asset, ts + k * INTERVAL 1 HOUR AS ts, close, spread_close FROM gap, LATERAL (SELECT unnest(range(1, g // 3600 + 1)) AS k) k WHERE g > 0 AND g <= 7200),
alls AS (SELECT asset, ts, open, high, low, close, volume, spread_mean, tick_count FROM raw UNION ALL SELECT asset, ts, close, close, close, close, 0, spread_close, 0 FROM flat)
SELECT asset, {at()}, {rs('open', 'high', 'low', 'close', 'volume', 'spread_mean')}, tick_count, ts = min(ts) OVER (PARTITION BY asset) OR ts = max(ts) OVER (PARTITION BY asset) AS is_partial FROM alls""",
    "tick_checks": f"""WITH {TICKS.format(asset='event_type')} SELECT count(*) AS n_rows, count_if(ts IS NULL) AS no_time, count_if(bid_price IS NULL OR ask_price IS NULL OR bid_volume IS NULL OR ask_volume IS NULL) AS not_finite,
count_if(bid_price <= 0 OR ask_price <= 0) AS price_not_positive, count_if(bid_volume < 0 OR ask_volume < 0) AS volume_negative, count_if(ask_price < bid_price) AS crossed FROM ticks""",
    "tick_jumps": f"WITH {TICKS.format(asset='event_type')}, m AS (SELECT asset, ts, bid_price, lag(bid_price) OVER (PARTITION BY asset ORDER BY ts, seq) AS b FROM ticks) SELECT asset, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_jumps FROM m WHERE abs(bid_price - b) / b > 0.2 GROUP BY 1, 2",
    "resampled_h4": f"""WITH {bars()},
z AS (SELECT *, time_bucket(INTERVAL 4 HOUR, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '1970-01-01') + INTERVAL 4 HOUR AS e FROM bars),
a AS (SELECT asset, e AS ts, arg_min(open, z.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, z.ts) AS close, sum(volume) AS volume, avg(spread_mean) AS spread_mean, max(spread_max) AS spread_max, arg_max(spread_close, z.ts) AS spread_close, CAST(sum(tick_count) AS BIGINT) AS tick_count, count(*) AS source_count, max(is_partial) AS doubt FROM z GROUP BY asset, e)
SELECT asset, {at()}, {rs('open', 'high', 'low', 'close', 'volume', 'spread_mean', 'spread_max', 'spread_close')}, {r('source_count / 4', 'coverage')}, tick_count, source_count, CAST(4 AS BIGINT) AS expected_count, doubt OR source_count <> 4 AS is_partial FROM a""",
    "missing_bars": f"WITH {bars()}, {GRID} SELECT asset, count(*) AS expected, count_if(here = 0) AS missing FROM g0 GROUP BY asset",
    "validity_mask": f"WITH {labelled()} SELECT asset, count(*) AS n, count(regime) AS n_valid FROM rows GROUP BY asset",
    "context_sessions": f"""WITH {bars()} SELECT asset, {at()}, CASE WHEN {MINUTE} >= 480 AND {MINUTE} < 1020 THEN 'NEW_YORK' WHEN {MINUTE} >= 180 AND {MINUTE} < 480 THEN 'LONDRES' WHEN {MINUTE} >= 1140 OR {MINUTE} < 180 THEN 'ASIE' ELSE 'HORS_SESSION' END AS ctx_session,
CAST(hour({LOCAL}) AS INTEGER) AS ctx_hour_ny, CAST(hour(ts - INTERVAL 1 HOUR) AS INTEGER) AS ctx_hour_utc FROM bars""",
    "context_calendar": f"WITH {bars()} SELECT asset, {at()}, CAST(isodow({LOCAL}) - 1 AS INTEGER) AS ctx_day_of_week, {MINUTE} >= 1005 AND {MINUTE} < 1095 AS ctx_is_rollover, CAST(ts - INTERVAL 1 HOUR AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS ctx_is_holiday FROM bars",
    "context_events": f"""WITH {bars(by_type=False, step='15 minutes')},
ev(t, kind, seq, b, a) AS (VALUES (TIMESTAMP '2024-01-05 13:30:00', 'NFP', 0, 5, 60), (TIMESTAMP '2024-01-11 13:30:00', 'CPI', 1, 5, 60), (TIMESTAMP '2024-01-11 14:00:00', 'OTHER', 2, 5, 60), (TIMESTAMP '2024-01-25 19:00:00', 'FOMC', 3, 15, 120)),
hit AS (SELECT asset, ts, arg_max(kind, seq) AS kind FROM bars JOIN ev ON ts - INTERVAL 15 MINUTE >= t - b * INTERVAL 1 MINUTE AND ts - INTERVAL 15 MINUTE < t + a * INTERVAL 1 MINUTE GROUP BY asset, ts)
SELECT bars.asset, CAST(floor(epoch(bars.ts)) AS BIGINT) AS ts, kind IS NOT NULL AS ctx_in_event, coalesce(kind, '') AS ctx_event_type FROM bars LEFT JOIN hit ON hit.asset = bars.asset AND hit.ts = bars.ts""",
    "session_grid": """WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2024-03-06', TIMESTAMP '2024-03-14', INTERVAL 1 DAY)) AS day),
u AS (SELECT timezone('UTC', timezone('America/New_York', day + INTERVAL 9 HOUR)) AS o FROM d WHERE isodow(day) <= 5 AND day <> TIMESTAMP '2024-03-12')
SELECT CAST(floor(epoch(o + k * INTERVAL 1 HOUR)) AS BIGINT) AS ts FROM u, range(1, 4) t(k)""",
    "uniform_rows": f"""WITH {ofi()}, m AS (SELECT asset, CASE WHEN is_partial THEN 'INCONNU' ELSE regime END AS regime, CASE WHEN is_partial THEN 0 ELSE confidence END AS confidence FROM lab)
SELECT asset, 'ofi' AS method, regime, CAST(CASE regime WHEN 'PRESSION_ACHETEUSE' THEN 0 WHEN 'PRESSION_VENDEUSE' THEN 1 WHEN 'EQUILIBRE' THEN 2 ELSE 3 END AS INTEGER) AS regime_id, 'bar_close' AS availability, count(*) AS n, {r('avg(confidence)', 'confidence')}, count(*) AS n_available FROM m GROUP BY asset, regime""",
    "forward_targets": f"WITH {bars()}, {targets()} SELECT asset, {at()}, {rs('ret_fwd_3', 'vol_fwd_3', 'close_min_fwd_3', 'close_max_fwd_3', 'mfe_long_fwd_3', 'mae_long_fwd_3', 'mfe_short_fwd_3', 'mae_short_fwd_3', 'time_mfe_long_fwd_3', 'time_mae_long_fwd_3')}, {at('ret_fwd_3_end')} FROM tg",
    "rank_correlation": f"""WITH {STUDY}, h AS (SELECT asset, high - low AS x, ret_fwd_3 AS y FROM sr WHERE ret_fwd_3 IS NOT NULL),
k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY x) + (count(*) OVER (PARTITION BY asset, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY asset ORDER BY y) + (count(*) OVER (PARTITION BY asset, y) - 1) / 2 AS ry FROM h)
SELECT asset, count(*) AS n, {r('CASE WHEN count(*) >= 10 THEN corr(rx, ry) END', 'ic')} FROM k GROUP BY asset""",
    "hit_rate": f"WITH {STUDY} SELECT asset, count(*) AS n, {r('CASE WHEN count(*) >= 10 THEN avg(CASE WHEN sign(close - open) = sign(ret_fwd_3) THEN 1.0 ELSE 0.0 END) END', 'hit_rate')} FROM sr WHERE ret_fwd_3 IS NOT NULL AND close <> open GROUP BY asset",
    "modality_statistics": f"""WITH {STUDY}, h AS (SELECT asset, regime AS value, ret_fwd_3 AS y FROM sr WHERE ret_fwd_3 IS NOT NULL AND regime IS NOT NULL),
k AS (SELECT *, count(*) OVER (PARTITION BY asset, y) AS c, rank() OVER (PARTITION BY asset ORDER BY y) AS rk FROM h),
v AS (SELECT DISTINCT asset, value FROM k)
SELECT v.asset, v.value, count_if(k.value = v.value) AS n, count_if(k.value <> v.value) AS n_rest, {r('avg(k.y) FILTER (k.value = v.value)', 'mean')}, {r('avg(k.y) FILTER (k.value <> v.value)', 'mean_rest')}, {r('var_samp(k.y) FILTER (k.value = v.value)', 'var')}, {r('var_samp(k.y) FILTER (k.value <> v.value)', 'var_rest')},
{r('quantile_cont(k.y, 0.5) FILTER (k.value = v.value)', 'median')}, {r('sum(rk + (c - 1) / 2) FILTER (k.value = v.value)', 'rank_sum')}, {r('sum(CAST(c * c - 1 AS DOUBLE))', 'ties')}, count_if(k.value = v.value AND y > 0) AS hits, count_if(k.value <> v.value AND y > 0) AS hits_rest FROM v JOIN k ON k.asset = v.asset GROUP BY v.asset, v.value""",
    "walk_forward": f"WITH {FOLDS} SELECT asset, CAST(fold AS INTEGER) AS fold, part, count(*) AS n, CAST(min(epoch(ts)) AS BIGINT) AS first_ts, CAST(max(epoch(ts)) AS BIGINT) AS last_ts FROM ds GROUP BY asset, fold, part",
    "ic_stability": f"""WITH {FOLDS}, h AS (SELECT asset, fold, high - low AS x, ret_fwd_3 AS y FROM ds WHERE part = 'test' AND ret_fwd_3 IS NOT NULL),
k AS (SELECT asset, fold, rank() OVER (PARTITION BY asset, fold ORDER BY x) + (count(*) OVER (PARTITION BY asset, fold, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY asset, fold ORDER BY y) + (count(*) OVER (PARTITION BY asset, fold, y) - 1) / 2 AS ry FROM h),
i AS (SELECT asset, fold, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS ic FROM k GROUP BY asset, fold)
SELECT asset, count(*) AS folds, {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, {r('min(ic)', 'ic_min')}, {r('max(ic)', 'ic_max')} FROM i GROUP BY asset""",
    "modality_stability": f"""WITH {FOLDS}, h AS (SELECT asset, fold, regime AS value, ret_fwd_3 AS y FROM ds WHERE part = 'test' AND ret_fwd_3 IS NOT NULL AND regime IS NOT NULL),
v AS (SELECT DISTINCT asset, fold, value FROM h), e AS (SELECT v.asset, v.value, avg(y) FILTER (h.value = v.value) - avg(y) FILTER (h.value <> v.value) AS d FROM v JOIN h ON h.asset = v.asset AND h.fold = v.fold GROUP BY v.asset, v.fold, v.value)
SELECT asset, value, count(*) AS folds, count(d) AS estimable, {r('avg(d)', 'mean')}, {r('min(d)', 'min')}, {r('max(d)', 'max')}, count(*) FILTER (d > 0) AS n_up, count(*) FILTER (d < 0) AS n_down, {r('greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) / nullif(count(d), 0)', 'same_sign')} FROM e GROUP BY asset, value""",
    "episode_counts": f"WITH {labelled()}, {episode()} SELECT asset, regime, count(*) AS n, count(DISTINCT episode) AS n_episodes FROM eps WHERE regime IS NOT NULL GROUP BY asset, regime",
    "state_statistics": f"""WITH {labelled()}, a AS (SELECT asset, regime, count(*) AS n, avg(volume) AS mean_vol, avg(close - open) AS mean_ret, stddev_samp(close - open) AS std_ret, avg(high - low) AS mean_range FROM rows WHERE regime IS NOT NULL GROUP BY asset, regime)
SELECT asset, regime, n, {r('100 * n / sum(n) OVER (PARTITION BY asset)', 'share')}, {rs('mean_vol', 'mean_ret', 'std_ret', 'mean_range')} FROM a""",
    "persistence": f"""WITH {labelled()}, {episode()}, l AS (SELECT asset, regime, episode, count(*) AS b FROM eps WHERE regime IS NOT NULL GROUP BY asset, regime, episode)
SELECT asset, regime, count(*) AS n_episodes, {r('avg(b)', 'mean_bars')}, {r('quantile_cont(b, 0.5)', 'median_bars')}, max(b) AS max_bars, {r('quantile_cont(b, 0.25)', 'p25_bars')}, {r('quantile_cont(b, 0.75)', 'p75_bars')} FROM l GROUP BY asset, regime""",
    "transitions": f"""WITH {labelled()}, p AS (SELECT asset, regime AS from_state, lead(regime) OVER {W} AS to_state, lead(ts) OVER {W} - ts AS gap FROM rows),
c AS (SELECT asset, from_state, to_state, count(*) AS n FROM p WHERE gap = INTERVAL 1 HOUR AND from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY ALL)
SELECT *, {r('n / sum(n) OVER (PARTITION BY asset, from_state)', 'probability')} FROM c""",
    "confidence_statistics": f"WITH {labelled()} SELECT asset, regime, count(*) AS n, {r('avg(confidence)', 'mean')}, {r('stddev_samp(confidence)', 'std')}, {r('min(confidence)', 'min')}, {r('max(confidence)', 'max')} FROM rows WHERE regime IS NOT NULL GROUP BY asset, regime",
    "conditional_statistics": f"""WITH {STUDY}, q AS (SELECT * EXCLUDE (regime), CASE WHEN ret_fwd_3 IS NOT NULL THEN regime END AS regime FROM sr), {episode('regime', 'q')}
SELECT asset, regime, count(*) AS n, count(DISTINCT episode) AS n_episodes, {r('avg(ret_fwd_3)', 'mean')}, {r('quantile_cont(ret_fwd_3, 0.5)', 'median')}, {r('stddev_samp(ret_fwd_3)', 'std')}, {r('min(ret_fwd_3)', 'min')}, {r('max(ret_fwd_3)', 'max')} FROM eps WHERE regime IS NOT NULL GROUP BY asset, regime""",
    "daily_shares": f"""WITH {labelled()}, d AS (SELECT asset, make_timestamp(epoch_us(ts) * 12) AS t, regime FROM rows), m AS (SELECT *, strftime(t, '%Y-%m') AS month FROM d),
mm AS (SELECT asset, month, count(DISTINCT CAST(t AS DATE)) AS days FROM m GROUP BY asset, month), k AS (SELECT * FROM mm QUALIFY month <> min(month) OVER (PARTITION BY asset) AND month <> max(month) OVER (PARTITION BY asset) AND days >= 18),
c AS (SELECT m.asset, m.month, m.regime, count(*) AS n FROM m JOIN k ON k.asset = m.asset AND k.month = m.month WHERE m.regime IS NOT NULL GROUP BY ALL)
SELECT *, {r('100 * n / sum(n) OVER (PARTITION BY asset, month)', 'share')} FROM c""",
    "segment_features": f"""WITH {SEG}, s0 AS (SELECT *, ln(close / lag(close) OVER {W}) AS lr FROM sg),
s AS (SELECT asset, segment_id, min(ts) AS debut, max(ts) AS fin, count(*) AS n, arg_max(close, ts) - arg_min(close, ts) AS pente, max(high) - min(low) AS amplitude, stddev_samp(lr) AS vol, avg(atr) AS m FROM s0 GROUP BY asset, segment_id),
w AS (SELECT *, date_diff('hour', debut, fin) + 1 = n AS is_valid FROM s)
SELECT asset, segment_id, {at('debut')}, {at('fin')}, n, is_valid, {r('CASE WHEN is_valid THEN sign(pente) END', 'signe')}, {r('CASE WHEN is_valid THEN pente END', 'pente')}, {r('CASE WHEN is_valid THEN amplitude END', 'amplitude')},
{r('CASE WHEN is_valid THEN CASE WHEN amplitude > 0 THEN least(abs(pente) / amplitude, 1) ELSE 0 END END', 'efficience')}, {r('CASE WHEN is_valid THEN vol END', 'vol')}, {r('CASE WHEN is_valid AND m > 0 THEN pente / m END', 'pente_atr')} FROM w""",
    "segment_purity": f"""WITH {SEG}, c AS (SELECT asset, segment_id, regime, count(*) AS n FROM sg WHERE regime IS NOT NULL GROUP BY ALL)
SELECT asset, segment_id, CAST(sum(n) AS BIGINT) AS total, arg_min(regime, (-n, regime)) AS dominant, {r('max(n) / sum(n)', 'purete')}, count(*) AS n_regimes FROM c GROUP BY asset, segment_id""",
    "overall_purity": f"""WITH {SEG}, c AS (SELECT asset, segment_id, regime, count(*) AS n FROM sg WHERE regime IS NOT NULL GROUP BY ALL), p AS (SELECT asset, segment_id, sum(n) AS total, max(n) AS m, count(*) AS k FROM c GROUP BY asset, segment_id)
SELECT asset, {r('sum(m) / sum(total)', 'purete')}, {r('avg(k)', 'regimes_moyens')}, count(*) AS n_segments FROM p GROUP BY asset""",
    "future_efficiency": f"""WITH {bars()}, s AS (SELECT *, abs(close - lag(close) OVER {W}) AS step FROM bars)
SELECT asset, {at()}, {r(f'CASE WHEN lead(ts, 4) OVER {W} - ts = INTERVAL 4 HOUR AND sum(step) OVER {frame(1, 4)} > 0 THEN abs(lead(close, 4) OVER {W} - close) / sum(step) OVER {frame(1, 4)} END', 'future_efficiency')} FROM s""",
    "separation_score": f"""WITH {labelled()}, h AS (SELECT asset, high - low AS x, {HIGH} AS hi FROM rows WHERE {HIGH} OR {LOW}),
m AS (SELECT asset, count(*) AS n, quantile_cont(x, 0.5) FILTER (hi) AS median_high, quantile_cont(x, 0.5) FILTER (NOT hi) AS median_low FROM h GROUP BY asset)
SELECT asset, n, {rs('median_high', 'median_low')}, {r('CASE WHEN median_high > 0 AND median_low > 0 THEN ln(median_high) - ln(median_low) END', 'score')} FROM m""",
    "stratified_score": f"""WITH {labelled()}, h AS (SELECT asset, hour(ts) // 6 AS quarter, high - low AS x, {HIGH} AS hi FROM rows WHERE {HIGH} OR {LOW}),
m AS (SELECT asset, quarter, least(count_if(hi), count_if(NOT hi)) AS w, quantile_cont(x, 0.5) FILTER (hi) AS a, quantile_cont(x, 0.5) FILTER (NOT hi) AS b FROM h GROUP BY asset, quarter)
SELECT asset, count(*) AS n_strata, {r('sum((ln(a) - ln(b)) * w) / sum(w)', 'score')} FROM m WHERE w >= 5 AND a > 0 AND b > 0 GROUP BY asset""",
    "centred_volatility": f"""WITH {bars()}, {RET}, v AS (SELECT *, {guarded('stddev_samp(ret)', 'ret', frame(-3, 3), 7)} AS realised FROM b0)
SELECT asset, {at()}, {r('realised')}, {r('realised / nullif(quantile_cont(realised, 0.5) OVER (PARTITION BY asset, hour(ts)), 0)', 'deseasonal')} FROM v""",
    "directional_agreement": f"""WITH {labelled()}, m AS (SELECT *, CASE WHEN lead(ts, 2) OVER {W} - ts = INTERVAL 2 HOUR THEN sign(lead(close, 2) OVER {W} - close) END AS mv FROM rows)
SELECT asset, count(*) AS n, {r("avg(CASE WHEN (regime = 'TENDANCE_HAUSSIERE' AND mv > 0) OR (regime = 'TENDANCE_BAISSIERE' AND mv < 0) THEN 1.0 ELSE 0.0 END)", 'agreement')} FROM m WHERE {HIGH} AND mv IS NOT NULL GROUP BY asset""",
    "quantile_thresholds": f"WITH {bars()} SELECT asset, {r('quantile_cont(volume, 0.25)', 'low')}, {r('quantile_cont(volume, 0.9)', 'high')} FROM bars GROUP BY asset",
    "switches": f"WITH {labelled()}, c AS (SELECT asset, ts, lag(regime) OVER {W} <> regime AS c FROM rows) SELECT asset, {r('sum(CAST(c AS BIGINT)) / count(DISTINCT CAST(ts AS DATE))', 'switches_per_day')} FROM c GROUP BY asset",
    "protocol_measures": f"""WITH {labelled()}, {episode()},
q AS (SELECT *, coalesce(abs(close - lag(close) OVER x), 0) AS step, max(close) OVER (PARTITION BY asset, episode ORDER BY ts ROWS UNBOUNDED PRECEDING) - close AS draw, close - min(close) OVER (PARTITION BY asset, episode ORDER BY ts ROWS UNBOUNDED PRECEDING) AS rise FROM eps WHERE episode IS NOT NULL WINDOW x AS (PARTITION BY asset, episode ORDER BY ts)),
a AS (SELECT asset, regime, episode, min(ts) AS debut, max(ts) AS fin, count(*) AS bars, arg_max(close, ts) - arg_min(close, ts) AS net, sum(step) AS path, max(close) - min(close) AS amplitude, max(draw) AS draw, max(rise) AS rise FROM q GROUP BY asset, regime, episode)
SELECT asset, regime, {at('debut')}, {at('fin')}, bars, {rs('net', 'path', 'amplitude')}, {r('abs(net) / nullif(path, 0)', 'regularity')}, {r('CASE WHEN net >= 0 THEN draw ELSE rise END', 'opposite')} FROM a""",
    "atr_volatility_long_frame": detector(atr().replace("event_type AS asset", "'ALL' AS asset").replace("50 PRECEDING", "300 PRECEDING").replace(">= 25", ">= 100"), "lab"),
    "detector_atr_volatility": detector(atr(), "lab"),
    "detector_er_kaufman": detector(er(), "lab"),
    "detector_adx": detector(adx(), "lab"),
    "detector_shannon": detector(shannon(), "lab", {"shannon_value": "r"}),
    "detector_minkowski_causal": detector(minkowski(), "lab", {"minkowski_ds2": "r", "minkowski_beta": "r"}),
    "detector_pca_axis": detector(pca(), "lab", {"pca_direction": "r", "pca_eigen_ratio": "r", "pca_variance_ratio": "r"}),
    "detector_price_action": detector(price_action(), "lab"),
    "detector_price_action_causal": detector(price_action_causal(), "lab", {"pivot_observed_at": "t", "pivot_confirmed_at": "t", "pivot_kind": "v", "pivot_replaces_previous": "v"}),
    "detector_mss_choch": detector(breakout(), "lab"),
    "detector_retrospective_pivot_breakout": detector(breakout(), "lab", pick=renamed(MSS_HAUSSIER="CASSURE_HAUTE_ANCIENNE", MSS_BAISSIER="CASSURE_BASSE_ANCIENNE", CHOCH_HAUSSIER="CASSURE_HAUTE_RECENTE", CHOCH_BAISSIER="CASSURE_BASSE_RECENTE")),
    "detector_ofi": detector(ofi(), "lab", {"ofi_value": "r"}),
    "detector_quote_size_imbalance": detector(ofi().replace("ofi_value", "quote_imbalance"), "lab", {"quote_imbalance": "r"}, renamed(PRESSION_ACHETEUSE="TAILLE_ASK_DOMINANTE", PRESSION_VENDEUSE="TAILLE_BID_DOMINANTE")),
    "detector_vpin": detector(vpin(), "lab", {"vpin_value": "r"}),
    "detector_quote_absolute_imbalance_buckets": detector(vpin().replace("vpin_value", "quote_absolute_imbalance"), "lab", {"quote_absolute_imbalance": "r"}, renamed(CALME="DESEQUILIBRE_FAIBLE", NORMAL="DESEQUILIBRE_MOYEN", TOXIQUE="DESEQUILIBRE_ELEVE")),
    "detector_volume_profile": detector(profile(), "lab", {"va_low": "r", "va_high": "r", "distance_va": "r"}),
    "detector_divergence_pv": detector(divergence(), "lab", {"volume_rel": "r", "is_new_high": "v", "is_new_low": "v"}),
    "bar_checks": f"""WITH {bars()} SELECT asset, count(*) AS n_rows, count_if(open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS not_finite, count_if(least(open, high, low, close) <= 0) AS not_positive,
count_if(high < greatest(open, close, low)) AS high_too_low, count_if(low > least(open, close, high)) AS low_too_high, count_if(volume < 0 OR bid_volume < 0 OR ask_volume < 0) AS bad_volume FROM bars GROUP BY asset""",
    "time_checks": f"WITH {bars()} SELECT asset, count(*) AS n_rows, count_if(ts IS NULL) AS no_time, count(*) - count(DISTINCT ts) AS repeated, count_if(CAST(epoch(ts) AS BIGINT) % 14400 <> 0) AS off_grid FROM bars GROUP BY asset",
    "feature_matrix": f"""WITH a AS (WITH {labelled()} SELECT asset, ts, regime FROM rows), o AS (WITH {ofi()} SELECT asset, ts, CASE WHEN NOT is_partial AND regime <> 'INCONNU' THEN regime END AS regime FROM lab)
SELECT a.asset, CAST(floor(epoch(a.ts)) AS BIGINT) AS ts, a.regime AS atr_volatility__regime, o.regime AS ofi__regime FROM a JOIN o ON a.asset = o.asset AND a.ts = o.ts""",
    "nominal_codes": f"""WITH {labelled()}, n AS (SELECT asset, coalesce(regime, 'INCONNU') AS regime, count(*) AS n FROM rows GROUP BY ALL), k AS (SELECT asset, regime, row_number() OVER (PARTITION BY asset ORDER BY regime) - 1 AS code FROM n WHERE regime <> 'INCONNU')
SELECT n.asset, n.regime, CAST(coalesce(code, -1) AS INTEGER) AS code, n.n FROM n LEFT JOIN k ON k.asset = n.asset AND k.regime = n.regime""",
    "crossed_labels": f"""WITH a AS (WITH {labelled()} SELECT asset, ts, regime FROM rows), e AS (WITH {er()} SELECT asset, ts, CASE WHEN NOT is_partial AND regime <> 'INCONNU' THEN regime END AS regime FROM lab)
SELECT a.regime AS a, e.regime AS b, count(*) AS n FROM a JOIN e ON a.asset = e.asset AND a.ts = e.ts WHERE a.regime IS NOT NULL AND e.regime IS NOT NULL GROUP BY ALL""",
    "clock_baseline": f"""WITH {bars()}, h AS (SELECT asset, high - low AS x, hour({LOCAL}) IN (8, 9, 10, 11) AS hi FROM bars),
m AS (SELECT asset, count(*) AS n, quantile_cont(x, 0.5) FILTER (hi) AS median_high, quantile_cont(x, 0.5) FILTER (NOT hi) AS median_low FROM h GROUP BY asset)
SELECT asset, n, {rs('median_high', 'median_low')}, {r('CASE WHEN median_high > 0 AND median_low > 0 THEN ln(median_high) - ln(median_low) END', 'score')} FROM m""",
}
