"""SQL for the queries of `measures`, for DuckDB."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.stats import Z95, multiplier
from ..functions.text import BUCKETS
from . import sql as S

SMALL, RIGHT, LARGE = BUCKETS
_IN = ", ".join(f"'{b}'" for b in BUCKETS)

HAND = """WITH k AS (SELECT *, trim(human_label) AS human FROM precision_key WHERE trim(human_label) <> '' AND review_id_hash IS NOT NULL),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY review_id_hash ORDER BY parent_asin DESC NULLS LAST, assigned_bucket DESC NULLS LAST, gender DESC NULLS LAST,
        body_half DESC NULLS LAST, human DESC NULLS LAST, review_title DESC NULLS LAST, review_text DESC NULLS LAST) = 1),
st AS (SELECT parent_asin, store FROM parent_store QUALIFY row_number() OVER (PARTITION BY parent_asin ORDER BY added_at DESC, store DESC NULLS LAST) = 1),
hl AS (SELECT one.* EXCLUDE (assigned_bucket), assigned_bucket AS assigned, st.store FROM one LEFT JOIN st ON one.parent_asin = st.parent_asin)"""


def uniform(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0"


def counts(weight: str = "1") -> str:
    return ", ".join(f"sum(CASE WHEN assigned = '{k}' AND CASE WHEN human = 'none' THEN 'true_to_size' ELSE human END = '{j}' THEN {weight} ELSE 0 END) AS c{a}{b}" for a, k in enumerate(BUCKETS) for b, j in enumerate(BUCKETS))


def _w(prevalence: dict[str, float]) -> list[float]:
    total = sum(prevalence.values())
    return [prevalence[b] / total for b in BUCKETS]


def conditional(a: int, b: int) -> str:
    t = f"(c{a}0 + c{a}1 + c{a}2)"
    return f"(CASE WHEN {t} > 0 THEN c{a}{b}::DOUBLE / {t} END)"


def factor() -> tuple[str, str, str]:
    """lambda, residual and lambda_reverse from c00 to c22."""
    w = _w(P.ASSIGNED)
    true = ["(" + " + ".join(f"{w[a]!r} * {conditional(a, b)}" for a in range(3)) + ")" for b in range(3)]
    mean = [f"({w[2]!r} * {conditional(2, b)} - {w[0]!r} * {conditional(0, b)}) / {true[b]}" for b in range(3)]
    ok = " AND ".join(f"{t} > 0" for t in true)
    lam = f"CASE WHEN {ok} THEN ({mean[2]} - {mean[0]}) / 2 END"
    res = f"CASE WHEN {ok} THEN {mean[1]} - ({mean[0]} + {mean[2]}) / 2 END"
    rev = f"(({conditional(2, 2)} - {conditional(2, 0)}) - ({conditional(0, 2)} - {conditional(0, 0)})) / 2"
    return lam, res, f"CASE WHEN {conditional(1, 1)} IS NOT NULL THEN {rev} END"


def p_zero(assigned: dict[str, float]) -> str:
    return " + ".join(f"{w!r} * {conditional(a, 1)}" for a, w in enumerate(_w(assigned)))


def wilson(hits: str, n: str) -> tuple[str, str]:
    z = Z95
    centre, half = f"{hits} / {n} + {z * z!r} / (2 * {n})", f"{z!r} * sqrt({hits} / {n} * (1 - {hits} / {n}) / {n} + {z * z!r} / (4.0 * {n} * {n}))"
    return tuple(f"CASE WHEN {n} = 0 THEN {end} ELSE {pick}({float(end)}, (({centre}) {sign} ({half})) / (1 + {z * z!r} / {n})) END" for end, pick, sign in (("0.0", "greatest", "-"), ("1.0", "least", "+")))


_LAM, _RES, _REV = factor()
_USABLE = "(n - unclear)"
_LOW, _HIGH = wilson("correct", _USABLE)
_SLOW, _SHIGH = wilson("correct", "n")
_BIAS = " ".join(f"WHEN '{g}' THEN res * (({p_zero(P.CELL_ASSIGNED[g, 'upper'])}) - ({p_zero(P.CELL_ASSIGNED[g, 'lower'])}))" for g in ("men", "women"))
_wt = _w(P.ASSIGNED)
_SD = ((_wt[0] + _wt[2]) - (_wt[2] - _wt[0]) ** 2) ** 0.5

_HALF = "CASE corpus WHEN 'closet' THEN CASE category " + " ".join(f"WHEN {S.q(c)} THEN '{h}'" for c, h in P.CORPUS_HALF["closet"].items()) + " ELSE 'unknown' END WHEN 'rentals' THEN CASE " + " ".join(
    f"WHEN category IN ({', '.join(map(S.q, names))}) THEN '{h}'" for h, names in P.CORPUS_HALF["rentals"].items()
) + " ELSE 'unknown' END ELSE 'unknown' END"
_TRUTH = "CASE fit " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.FIT_ANSWERS.items()) + " END"
_PATTERN = "CASE label " + " ".join(f"WHEN '{b}' THEN {S.first_pattern('b', b)}" for b in BUCKETS) + " END"
CORPUS = f"""WITH {S.labelled('fit_corpus', 'review_summary', 'review_text')},
j AS (SELECT corpus, {_TRUTH} AS truth, {_HALF} AS half, CASE WHEN b = '' THEN 'no_text' ELSE label END AS guess, {_PATTERN} AS pattern FROM lab),
s AS (SELECT * FROM j WHERE truth IS NOT NULL AND half IN ('upper', 'lower'))"""
_EACH = f"e AS (SELECT corpus, truth, guess, unnest([{_IN}]) AS bucket FROM s)"
_PR = f"""{CORPUS}, {_EACH}, a AS (SELECT corpus, bucket, sum((truth = bucket AND guess = bucket)::INT) tp, sum((truth <> bucket AND guess = bucket)::INT) fp, sum((truth = bucket AND guess <> bucket)::INT) fn FROM e GROUP BY 1, 2),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) p, coalesce(tp / nullif(tp + fn, 0), 0.0) r FROM a)"""
_TARGET = "CASE truth " + " ".join(f"WHEN '{b}' THEN {v / sum(P.PREDICTED.values())!r}" for b, v in P.PREDICTED.items()) + " END"

CELL = f"{S.FINAL}, ce AS (SELECT gender, half, avg(score) AS mean, count(*) AS n FROM fin GROUP BY 1, 2)"
TAU = "max(mean) FILTER (gender = 'men' AND half = 'upper') - max(mean) FILTER (gender = 'men' AND half = 'lower') - max(mean) FILTER (gender = 'women' AND half = 'upper') + max(mean) FILTER (gender = 'women' AND half = 'lower')"
_X = "(gender = 'men' AND half = 'upper')::INT::DOUBLE"
_ADVICE = "CASE label " + " ".join(f"WHEN '{b}' THEN {S.first_pattern('b', b)} IN ({', '.join(str(k) for k, p in enumerate(P.FIT[b]) if p in P.ADVICE) or '-1'})" for b in BUCKETS) + " END"
_FIRED = "CASE assigned " + " ".join(f"WHEN '{b}' THEN h{k} = 1 AND {S.first_pattern('b', b)} IN ({', '.join(str(i) for i, p in enumerate(P.FIT[b]) if p in P.ADVICE) or '-1'})" for k, b in enumerate(BUCKETS)) + " END"
_X2 = " + ".join(f"CASE WHEN s{k} > 0 THEN (n{k} - sz * s{k}) * (n{k} - sz * s{k}) / (sz * s{k}) ELSE 0.0 END" for k in range(3))
WIN = f"{S.JOINED}, wi AS (SELECT *, coalesce(gradient, 'none') AS g FROM obs WHERE verified AND yr >= {S.WINDOW_FROM})"


def cluster_t(source: str, replicates: int, seed: str, group: str = "'all'") -> str:
    """Common table expressions for the wild bootstrap of `source` (cluster, x, y) by a group: `pv`."""
    key = f"concat_ws('|', '{seed}', r, cluster)" if group == "'all'" else f"concat_ws('|', '{seed}', r, gr, cluster)"
    return f"""
so AS (SELECT {group} AS gr, cluster, x, y FROM {source}),
tot AS (SELECT gr, avg(x) xb, avg(y) yb, count(*) n, count(DISTINCT cluster) g FROM so GROUP BY 1),
cl AS (SELECT gr, cluster, sum((x - xb) * (y - yb)) a, sum(x - xb) b, sum((x - xb) * (x - xb)) c, sum(y - yb) u, any_value(n) n, any_value(g) g FROM so JOIN tot USING (gr) GROUP BY 1, 2),
sx AS (SELECT gr, sum(c) sxx FROM cl GROUP BY 1),
rp AS (SELECT cl.*, sxx, r AS rep, CASE WHEN r = 0 THEN 1.0 WHEN {uniform(key)} < 0.5 THEN 1.0 ELSE -1.0 END AS w FROM cl JOIN sx USING (gr), range({replicates + 1}) t(r)),
be AS (SELECT gr, rep, sum(w * a) / any_value(sxx) beta, sum(w * u) / any_value(n) s FROM rp GROUP BY 1, 2),
me AS (SELECT rp.gr, rp.rep, any_value(beta) beta, any_value(sxx) sxx, any_value(g) g, sum((w * a - s * b - beta * c) ** 2) meat FROM rp JOIN be ON rp.gr = be.gr AND rp.rep = be.rep GROUP BY 1, 2),
ts AS (SELECT gr, rep, beta, g, CASE WHEN g > 1 AND meat > 1e-12 THEN beta / sqrt(g / (g - 1) * meat / (sxx * sxx)) ELSE 0.0 END t FROM me),
z AS (SELECT gr, abs(t) AS t0 FROM ts WHERE rep = 0),
pv AS (SELECT gr AS scenario, max(beta) FILTER (rep = 0) AS beta, max(t) FILTER (rep = 0) AS t, max(g) AS n_clusters, (count(*) FILTER (rep > 0 AND abs(t) >= t0) + 1) / {replicates + 1} AS p FROM ts JOIN z USING (gr) GROUP BY 1)"""


def anova(ctes: str, source: str, value: str) -> str:
    return f"""{ctes}, g AS (SELECT store, count(*) m, avg({value}) a FROM {source} GROUP BY 1), t AS (SELECT avg({value}) ga, sum({value} * {value}) - count(*) * avg({value}) * avg({value}) st, count(*) n FROM {source}),
x AS (SELECT any_value(n) n, count(*) k, sum(m * (a - ga) ** 2) b, any_value(st) st, sum(m * m) mm FROM g, t), y AS (SELECT *, b / (k - 1) msb, (st - b) / (n - k) msw, (n - mm / n) / (k - 1) m0 FROM x)
SELECT n AS n_obs, k AS n_groups, round(b / st, 8) AS eta_squared, round((msb - msw) / (msb + (m0 - 1) * msw), 8) AS icc FROM y"""


def oracle(windows: list, scenarios: list, cells: list[str], m_bar: float, raw: int, response: dict, pools: list, iccs: tuple, cvs: tuple, per_stratum: int, seed: str, many: int) -> dict[str, str]:
    values = lambda rows: ", ".join("(" + ", ".join(S.q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    win = f"wn(window_, {', '.join(cells)}) AS (VALUES {values(windows)})"
    deff = f"(1 + ((cv * cv + 1) * {m_bar} - 1) * icc)"
    sample = f"""{S.JOINED}, el AS (SELECT * FROM obs WHERE {S.IN_BUCKETS} AND yr >= {S.WINDOW_FROM}),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, gender ORDER BY md5('{seed}|' || review_id), review_id::VARCHAR) AS rank FROM el)"""
    return {
        "confusion": f"{HAND} SELECT assigned, human, count(*) AS n FROM hl GROUP BY 1, 2",
        "hand_precision": f"""{HAND}, t AS (SELECT assigned, count(*) n, sum((human = assigned)::INT) correct, sum((human = 'unclear')::INT) unclear, sum((human = 'none')::INT) none_, sum((human IN ({_IN}) AND human <> assigned)::INT) other FROM hl GROUP BY 1),
v AS (SELECT *, coalesce(correct / nullif({_USABLE}, 0), 0.0) prec, {_LOW} low, {_HIGH} high, correct / n strict, {_SLOW} strict_low, {_SHIGH} strict_high FROM t)
SELECT assigned, n, correct, unclear, none_, other, round(prec, 6) AS precision, round(low, 6) AS low, round(high, 6) AS high, round(strict, 6) AS strict, round(strict_low, 6) AS strict_low, round(strict_high, 6) AS strict_high,
CASE WHEN low >= 0.8 THEN 'PASS' WHEN high < 0.8 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM v""",
        "lambdas": f"""{HAND}, gr AS (SELECT 'all' AS grp, * FROM hl UNION ALL SELECT 'gender=' || gender, * FROM hl), cc AS (SELECT grp, {counts()} FROM gr GROUP BY 1), l AS (SELECT grp, {_LAM} AS la, {_RES} AS re, {_REV} AS rv FROM cc)
SELECT grp, round(la, 6) AS lambda, round(re, 6) AS residual, round(rv, 6) AS lambda_reverse, CASE WHEN la > 0 THEN round(0.156 / la, 6) END AS operative FROM l""".replace("AS lambda,", 'AS "lambda",'),
        "lambdas_without_advice": f"""{HAND}, {S.labelled('hl', 'review_title', 'review_text')}, kp AS (SELECT * FROM lab WHERE NOT coalesce({_FIRED}, false)), cc AS (SELECT {counts()} FROM kp)
SELECT round({_LAM}, 6) AS "lambda", round({_RES}, 6) AS residual, round({_REV}, 6) AS lambda_reverse FROM cc""",
        "lambdas_without_advice_by_item": f"""{HAND}, kk AS (SELECT * FROM precision_key WHERE review_id_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id_hash ORDER BY parent_asin DESC NULLS LAST, assigned_bucket DESC NULLS LAST,
        gender DESC NULLS LAST, body_half DESC NULLS LAST, review_title DESC NULLS LAST, review_text DESC NULLS LAST) = 1), k2 AS (SELECT review_id_hash, parent_asin, assigned_bucket AS assigned, review_title, review_text FROM kk),
{S.labelled('k2', 'review_title', 'review_text')}, fi AS (SELECT *, CASE assigned {' '.join(f"WHEN '{b}' THEN h{k} = 1" for k, b in enumerate(BUCKETS))} END AS has, {_FIRED} AS adv FROM lab),
fa AS (SELECT parent_asin, assigned, coalesce(adv, false) AS adv FROM fi WHERE has QUALIFY row_number() OVER (PARTITION BY parent_asin, assigned ORDER BY review_id_hash) = 1),
kp AS (SELECT hl.* FROM hl LEFT JOIN fa ON hl.parent_asin = fa.parent_asin AND hl.assigned = fa.assigned WHERE NOT coalesce(adv, false)), cc AS (SELECT {counts()} FROM kp)
SELECT round({_LAM}, 6) AS "lambda", round({_RES}, 6) AS residual, round({_REV}, 6) AS lambda_reverse FROM cc""",
        "labels_with_key": """WITH h AS (SELECT review_id_hash, max(trim(human_label)) AS human FROM precision_key WHERE trim(human_label) <> '' AND review_id_hash IS NOT NULL GROUP BY 1),
k AS (SELECT review_id_hash, assigned_bucket AS assigned FROM precision_key WHERE review_id_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id_hash ORDER BY parent_asin DESC NULLS LAST, assigned_bucket DESC NULLS LAST) = 1)
SELECT assigned, human, count(*) AS n FROM h JOIN k USING (review_id_hash) GROUP BY 1, 2""",
        "corpus_scale": f"""WITH {S.labelled('review', 'title', 'text')}, n AS (SELECT count(*) AS s FROM review) SELECT label, count(*) AS n, round(66e6 / any_value(s), 4) AS factor, round(count(*) * (66e6 / any_value(s)), 4) AS in_corpus FROM lab, n WHERE {S.IN_BUCKETS} GROUP BY 1""",
        "target_multipliers": f"""WITH {win}, sc(scenario, icc, cv) AS (VALUES {values(scenarios)}), j AS (SELECT *, {deff} AS deff FROM wn, sc)
SELECT window_ AS "window", scenario, round((round({multiplier()!r} * sqrt({' + '.join(f'deff / {c}' for c in cells)}), 6) / 0.2) ** 2, 4) AS times FROM j""",
        "item_blocks": f"""WITH {S.TAXONOMY}, p AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM tax),
bk AS (SELECT 'head' AS bl, * FROM p WHERE pos < 2000 UNION ALL SELECT 'middle', * FROM p WHERE pos >= n // 2 AND pos < n // 2 + 2000 UNION ALL SELECT 'tail', * FROM p WHERE pos >= greatest(floor(n - 2400), 0) AND pos < greatest(floor(n - 2400), 0) + 2000),
r AS (SELECT bl, 100 * avg((gender IN ('men', 'women') AND half IN ('upper', 'lower'))::INT) AS "both", 100 * avg((gender = 'men')::INT) AS men, 100 * avg((gender = 'women')::INT) AS women, 100 * avg((half = 'upper')::INT) AS "upper", 100 * avg((half = 'lower')::INT) AS "lower" FROM bk GROUP BY 1)
{' UNION ALL '.join(f"SELECT '{m}' AS measure, round(max({chr(34)}{m}{chr(34)}) - min({chr(34)}{m}{chr(34)}), 6) AS spread, {t}::DOUBLE AS tolerance, max({chr(34)}{m}{chr(34)}) - min({chr(34)}{m}{chr(34)}) <= {t} AS ok FROM r" for m, t in (('both', 3.0), ('men', 3.0), ('women', 4.0), ('upper', 3.0), ('lower', 2.0)))}""",
        "p_zero": f"{HAND}, cc AS (SELECT {counts()} FROM hl) " + " UNION ALL ".join(f"SELECT '{g}' AS gender, '{h}' AS half, round({p_zero(c)}, 6) AS p0 FROM cc" for (g, h), c in P.CELL_ASSIGNED.items()),
        "residual_bias": f"""{HAND}, cc AS (SELECT gender, {counts()} FROM hl WHERE gender IN ('men', 'women') GROUP BY 1), r AS (SELECT *, {_RES} AS res FROM cc), t AS (SELECT gender, CASE gender {_BIAS} END AS term FROM r)
SELECT round((max(term) FILTER (gender = 'men') - max(term) FILTER (gender = 'women')) / {_SD!r}, 8) AS bias_sd, round(max(term) FILTER (gender = 'men'), 8) AS term_men, round(max(term) FILTER (gender = 'women'), 8) AS term_women FROM t""",
        "lambda_interval": f"""{HAND}, cu AS (SELECT coalesce(store, parent_asin, '') AS u, {counts()} FROM hl GROUP BY 1), nu AS (SELECT *, row_number() OVER (ORDER BY u) - 1 AS pos FROM cu),
g AS (SELECT count(*) g FROM cu), dr AS (SELECT r, floor({uniform("concat_ws('|', '20260814', r, i)")} * g)::INT AS pos FROM g, range(4000) a(r), LATERAL (SELECT unnest(range(g)) AS i)),
sm AS (SELECT r, {', '.join(f'sum(c{a}{b}) AS c{a}{b}' for a in range(3) for b in range(3))} FROM dr JOIN nu USING (pos) GROUP BY 1), la AS (SELECT {_LAM} AS v FROM sm), ok AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS p, count(*) OVER () AS n FROM la WHERE v IS NOT NULL)
SELECT max(n) AS n_valid, round(max(v) FILTER (p = n * 25 // 1000), 6) AS low, round(max(v) FILTER (p = least(n - 1, n * 975 // 1000)), 6) AS high, (SELECT g FROM g) AS n_clusters FROM ok""",
        "truth_prediction": f"{CORPUS} SELECT corpus, half, truth, guess, count(*) AS n FROM s GROUP BY GROUPING SETS ((corpus, half, truth, guess), (corpus, truth, guess), (corpus))",
        "precision_recall": f"{_PR} SELECT corpus, bucket, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM pr",
        "reweighted_precision": f"""{CORPUS}, m AS (SELECT corpus, truth, guess, count(*) n FROM s GROUP BY 1, 2, 3), w AS (SELECT corpus, truth, {_TARGET} / (sum(n) / sum(sum(n)) OVER (PARTITION BY corpus)) w FROM m GROUP BY 1, 2)
SELECT m.corpus, guess AS bucket, round(coalesce(sum(w * n) FILTER (m.truth = guess), 0) / sum(w * n), 6) AS reweighted FROM m JOIN w ON m.corpus = w.corpus AND m.truth = w.truth WHERE guess IN ({_IN}) GROUP BY 1, 2""",
        "recall_by_half": f"""{CORPUS}, a AS (SELECT corpus, truth AS bucket, sum((half = 'upper')::INT) upper_n, sum((half = 'lower')::INT) lower_n, sum((half = 'upper' AND guess = truth)::INT) ut, sum((half = 'lower' AND guess = truth)::INT) lt FROM s GROUP BY 1, 2),
r AS (SELECT *, coalesce(ut / nullif(upper_n, 0), 0.0) u, coalesce(lt / nullif(lower_n, 0), 0.0) l FROM a)
SELECT corpus, bucket, upper_n, lower_n, round(u, 6) AS upper_recall, round(l, 6) AS lower_recall, round((u - l) * 100, 6) AS gap_pp, CASE WHEN abs((u - l) * 100) < 8 THEN 'agree' WHEN abs((u - l) * 100) < 15 THEN 'partial' ELSE 'diverge' END AS band FROM r""",
        "labelled_rate": f"{CORPUS} SELECT corpus, half, count(*) AS n, round(avg((guess IN ({_IN}))::INT), 6) AS labelled FROM s GROUP BY 1, 2",
        "pattern_precision": f"{CORPUS} SELECT guess AS bucket, pattern, count(*) AS n, sum((truth = guess)::INT) AS right, round(avg((truth = guess)::INT), 6) AS precision FROM s WHERE guess IN ({_IN}) GROUP BY 1, 2 HAVING count(*) >= 5".replace("AS right,", 'AS "right",'),
        "score_anova": anova(S.FINAL, "fin", "score"),
        "within_store_gap": f"""{S.FINAL}, g AS (SELECT store, count(*) FILTER (gender = 'men') na, count(*) FILTER (gender = 'women') nb, avg(score) FILTER (gender = 'men') ma, avg(score) FILTER (gender = 'women') mb FROM fin GROUP BY 1),
b AS (SELECT *, ma - mb AS gap, least(na, nb) AS w FROM g WHERE na > 0 AND nb > 0)
SELECT (SELECT count(*) FROM g) AS n_groups, count(*) AS n_both, coalesce(sum(na + nb), 0) AS n_covered, coalesce(sum(na), 0) AS n_a, round(sum(gap * w) / sum(w), 8) AS weighted_gap, round(avg(gap), 8) AS unweighted_gap, count(*) >= 15 AND coalesce(sum(na), 0) >= 30 AS enough FROM b""",
        "wild_bootstrap": f"{S.FINAL}, ob AS (SELECT parent_asin AS cluster, {_X} AS x, score AS y FROM fin), {cluster_t('ob', 399, '0')} SELECT round(beta, 6) AS beta, round(t, 6) AS t, n_clusters, round(p, 6) AS p FROM pv",
        "scenario_bound": f"""{S.FINAL}, pa AS (SELECT DISTINCT parent_asin, asin FROM obs WHERE asin <> ''), many AS (SELECT parent_asin FROM pa GROUP BY 1 HAVING count(*) > {many}),
fm AS (SELECT *, parent_asin IN (SELECT parent_asin FROM many) AS m FROM fin),
ob AS (SELECT 'KEEP' AS scenario, parent_asin AS cluster, {_X} AS x, score AS y FROM fm UNION ALL SELECT 'EXCLUDE', parent_asin, {_X}, score FROM fm WHERE NOT m
UNION ALL SELECT 'SPLIT', CASE WHEN m THEN parent_asin || '/' || coalesce(asin, '') ELSE parent_asin END, {_X}, score FROM fm UNION ALL SELECT 'STORE', store, {_X}, score FROM fm),
{cluster_t('ob', 399, '0', 'scenario')}, b AS (SELECT *, max(p) OVER () AS max_p FROM pv)
SELECT scenario, round(beta, 6) AS beta, round(t, 6) AS t, n_clusters, round(p, 6) AS p, round(max_p, 6) AS max_p, max_p < 0.05 AS claim FROM b""",
        "homogeneity": f"""{S.FINAL}, pa AS (SELECT DISTINCT parent_asin, asin FROM obs WHERE asin <> ''), many AS (SELECT parent_asin FROM pa GROUP BY 1 HAVING count(*) > {many}),
hv AS (SELECT parent_asin FROM fin WHERE parent_asin IN (SELECT parent_asin FROM many) GROUP BY 1 ORDER BY count(*) DESC, parent_asin LIMIT 4),
mm AS (SELECT parent_asin AS gr, asin AS me, {', '.join(f"sum((label = '{b}')::INT) AS n{k}" for k, b in enumerate(BUCKETS))}, count(*) AS sz FROM fin WHERE asin <> '' AND parent_asin IN (SELECT parent_asin FROM hv) GROUP BY 1, 2 HAVING count(*) >= 5),
po AS (SELECT gr, sum(n0) / sum(sz) AS s0, sum(n1) / sum(sz) AS s1, sum(n2) / sum(sz) AS s2, count(*) AS k FROM mm GROUP BY 1), ba AS (SELECT * FROM mm JOIN po USING (gr)),
dr AS (SELECT gr, me, sz, s0, s1, s2, rep, {uniform("concat_ws('|', '20260815', gr, me, rep, draw)")} AS u FROM ba, range(1, 1000) a(rep), LATERAL (SELECT unnest(range(1, sz + 1)) AS draw)),
si AS (SELECT gr, me, rep, sz, s0, s1, s2, sum((u <= s0)::INT) AS n0, sum((u > s0 AND u <= s0 + s1)::INT) AS n1, sum((u > s0 + s1)::INT) AS n2 FROM dr GROUP BY ALL),
ob2 AS (SELECT gr, sum({_X2}) AS x2, any_value(k) AS k FROM ba GROUP BY 1), st2 AS (SELECT gr, rep, sum({_X2}) AS xs FROM si GROUP BY 1, 2)
SELECT ob2.gr AS parent_asin, any_value(k) AS n_members, round(CASE WHEN any_value(k) < 2 THEN 0.0 ELSE any_value(x2) END, 6) AS x2, round(CASE WHEN any_value(k) < 2 THEN 0.0 ELSE any_value(x2) / ((any_value(k) - 1) * 2) END, 6) AS dispersion,
round(CASE WHEN any_value(k) < 2 THEN 1.0 ELSE (count(*) FILTER (xs >= x2 - 1e-9) + 1) / 1000 END, 6) AS p, any_value(k) >= 3 AS testable FROM ob2 JOIN st2 ON ob2.gr = st2.gr GROUP BY 1""",
        "cell_means": f"{CELL} SELECT gender, half, n, round(mean, 8) AS mean FROM ce",
        "tau": f"""{CELL}, sm AS (SELECT parent_asin, gender, half, avg(score) m FROM fin GROUP BY 1, 2, 3), sc AS (SELECT gender, half, avg(m) AS mean FROM sm GROUP BY 1, 2)
SELECT 'review' AS weighting, round({TAU}, 8) AS tau FROM ce UNION ALL SELECT 'style', round({TAU}, 8) FROM sc""",
        "tau_by_year": f"""{S.FINAL}, cy AS (SELECT yr, gender, half, avg(score) AS mean FROM fin GROUP BY 1, 2, 3), ty AS (SELECT yr, {TAU} AS tau FROM cy GROUP BY 1)
SELECT yr, round(tau, 8) AS tau, round((SELECT regr_slope(tau, yr) FROM ty), 8) AS slope FROM ty""",
        "within_person": f"""{S.FINAL}, pp AS (SELECT user_id, gender, avg(score) FILTER (half = 'upper') u, avg(score) FILTER (half = 'lower') l FROM fin WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT gender, count(*) AS n_persons, round(avg(u - l), 8) AS difference FROM pp WHERE u IS NOT NULL AND l IS NOT NULL GROUP BY 1""",
        "calibration": f"{S.JOINED} SELECT parent_asin, count(*) AS n, round(avg(coalesce({_ADVICE}, false)::INT), 8) AS calibration FROM obs WHERE {S.IN_BUCKETS} GROUP BY 1",
        "tau_without_advice": f"""{S.FINAL}, ad AS (SELECT *, coalesce({_ADVICE}, false) AS advice FROM fin), c1 AS (SELECT gender, half, avg(score) AS mean FROM ad GROUP BY 1, 2), c2 AS (SELECT gender, half, avg(score) AS mean FROM ad WHERE NOT advice GROUP BY 1, 2)
SELECT 'folded' AS spec, round({TAU}, 8) AS tau FROM c1 UNION ALL SELECT 'excluded', round({TAU}, 8) FROM c2""",
        "reporting": f"{WIN}, ce AS (SELECT gender, half, count(*) AS n, avg((score IS NOT NULL)::INT) AS mean FROM wi GROUP BY 1, 2) SELECT gender, half, n, round(mean, 8) AS mean, round((SELECT {TAU} FROM ce), 8) AS tau FROM ce",
        "weighted_tau": f"""{WIN}, rt AS (SELECT gender, half, g, avg((score IS NOT NULL)::INT) AS rate FROM wi GROUP BY 1, 2, 3),
ce AS (SELECT w.gender, w.half, sum(score / rate) / sum(1 / rate) AS mean FROM wi w JOIN rt r ON w.gender = r.gender AND w.half = r.half AND w.g = r.g WHERE score IS NOT NULL GROUP BY 1, 2) SELECT round({TAU}, 8) AS tau FROM ce""",
        "tau_bounds": f"""{WIN}, b AS (SELECT gender, half, (gender = 'men') = (half = 'upper') AS plus, avg(coalesce(score, -1)) lo, avg(coalesce(score, 1)) hi FROM wi GROUP BY 1, 2),
c1 AS (SELECT gender, half, CASE WHEN plus THEN lo ELSE hi END AS mean FROM b), c2 AS (SELECT gender, half, CASE WHEN plus THEN hi ELSE lo END AS mean FROM b) SELECT (SELECT round({TAU}, 8) FROM c1) AS low, (SELECT round({TAU}, 8) FROM c2) AS high""",
        "gradient_trend": f"""{S.FINAL}, gt AS (SELECT gender, parent_asin AS cluster, (CASE gradient WHEN 'jeans_trousers' THEN 0 WHEN 'shirt' THEN 1 ELSE 2 END)::DOUBLE AS x, score AS y FROM fin WHERE gradient IS NOT NULL), {cluster_t('gt', 399, '0', 'gender')}
SELECT scenario AS gender, round(beta, 6) AS beta, round(t, 6) AS t, n_clusters, round(p, 6) AS p FROM pv""",
        "interaction": f"""{S.FINAL}, f0 AS (SELECT parent_asin, category AS f, (gender = 'men')::INT::DOUBLE AS m, (half = 'upper')::INT::DOUBLE AS u, {_X} AS i, score AS y FROM fin),
dm AS (SELECT parent_asin, m - avg(m) OVER w AS m, u - avg(u) OVER w AS u, i - avg(i) OVER w AS i, y - avg(y) OVER w AS y FROM f0 WINDOW w AS (PARTITION BY f)),
k1 AS (SELECT sum(m * m) mm, sum(m * u) mu, sum(m * i) mi, sum(m * y) my FROM dm),
um AS (SELECT parent_asin, u - CASE WHEN mm > 1e-9 THEN mu / mm ELSE 0 END * m AS u, i - CASE WHEN mm > 1e-9 THEN mi / mm ELSE 0 END * m AS i, y - CASE WHEN mm > 1e-9 THEN my / mm ELSE 0 END * m AS y FROM dm, k1),
k2 AS (SELECT sum(u * u) uu, sum(u * i) ui, sum(u * y) uy FROM um),
ob AS (SELECT parent_asin AS cluster, i - CASE WHEN uu > 1e-9 THEN ui / uu ELSE 0 END * u AS x, y - CASE WHEN uu > 1e-9 THEN uy / uu ELSE 0 END * u AS y FROM um, k2), {cluster_t('ob', 399, '0')}, ok AS (SELECT sum(x * x) > 1e-9 AS ok FROM ob)
SELECT CASE WHEN ok THEN round(beta, 6) ELSE 0 END AS beta, CASE WHEN ok THEN round(t, 6) ELSE 0 END AS t, n_clusters, CASE WHEN ok THEN round(p, 6) ELSE 1 END AS p FROM pv, ok""",
        "buyer_gender": f"""{S.JOINED}, u AS (SELECT user_id, count(*) FILTER (gender = 'men') m, count(*) FILTER (gender = 'women') w FROM obs WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT CASE WHEN m >= w THEN 'men' ELSE 'women' END AS gender, count(*) AS n_buyers, sum((least(m, w) = 0)::INT) AS n_only FROM u GROUP BY 1""",
        "stratified_sample": f"{sample} SELECT review_id, label, gender, half, item_title, rank FROM rk WHERE rank <= {per_stratum}",
        "blind_sample": f"""{sample} SELECT substr(sha256(coalesce(r.user_id, 'None') || '|' || coalesce(r.asin, 'None') || '|' || coalesce(r.ts_ms::VARCHAR, 'None')), 1, 16) AS review_id_hash, item_title AS product_title,
{S.squash("coalesce(r.title, '')")} AS review_title, {S.squash("coalesce(r.text, '')")} AS review_text FROM rk JOIN review r ON rk.review_id = r.review_id WHERE rank <= {per_stratum}""",
        "sample_frame": f"{sample} SELECT label, gender, count(*) AS eligible, least(count(*), {per_stratum}) AS drawn FROM el GROUP BY 1, 2",
        "label_examples": f"WITH {S.labelled('review', 'title', 'text')} SELECT review_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || review_id), review_id::VARCHAR) AS rank FROM lab WHERE label <> 'none' QUALIFY rank <= 6",
        "distinct_records": "WITH k AS (SELECT concat_ws(chr(31), coalesce(user_id, ''), coalesce(asin, ''), coalesce(ts_ms::VARCHAR, ''), coalesce(title, ''), coalesce(text, '')) AS k FROM review) SELECT count(*) AS n, count(DISTINCT k) AS n_distinct, true AS complete FROM k",
        "block_sample": "WITH p AS (SELECT review_id, row_number() OVER (ORDER BY review_id) - 1 AS pos, count(*) OVER () // 24 AS span FROM review) SELECT review_id, (pos // span)::INT AS block FROM p WHERE pos // span < 24 AND pos % span < 100",
        "block_composition": f"""WITH {S.labelled('review', 'title', 'text')}, p AS (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS pos, count(*) OVER () AS n FROM lab),
bk AS (SELECT 'head' AS bl, * FROM p WHERE pos < 2000 UNION ALL SELECT 'middle', * FROM p WHERE pos >= n // 2 AND pos < n // 2 + 2000 UNION ALL SELECT 'tail', * FROM p WHERE pos >= greatest(floor(n - 2400), 0) AND pos < greatest(floor(n - 2400), 0) + 2000),
r AS (SELECT bl, {', '.join(f"100 * avg((label = '{b}')::INT) AS {b}" for b in BUCKETS)}, 100 * avg(({S.IN_BUCKETS})::INT) AS usable, 100 * avg(coalesce(verified_purchase, false)::INT) AS verified FROM bk GROUP BY 1)
{' UNION ALL '.join(f"SELECT '{m}' AS measure, round(max({m}) - min({m}), 6) AS spread, {t}::DOUBLE AS tolerance, max({m}) - min({m}) <= {t} AS ok FROM r" for m, t in [*((b, 2.0) for b in (*BUCKETS, 'usable')), ('verified', 8.0)])}""",
        "window_power": f"""WITH {win}, sc(scenario, icc, cv) AS (VALUES {values(scenarios)}), j AS (SELECT *, {deff} AS deff FROM wn, sc)
SELECT window_ AS "window", scenario, round(deff::DOUBLE, 6) AS deff, round({multiplier()!r} * sqrt({' + '.join(f'deff / {c}' for c in cells)}), 6) AS mde FROM j""",
        "variance_share": f"WITH {win}, l AS (UNPIVOT wn ON {', '.join(cells)} INTO NAME cell VALUE n) SELECT window_ AS \"window\", cell, n, round((1 / n) / sum(1 / n) OVER (PARTITION BY window_), 6) AS share FROM l",
        "power_scenarios": f"""WITH pl(pool, {', '.join(cells)}) AS (VALUES {values(pools)}), gd(icc, cv) AS (VALUES {values([(i, c) for i in iccs for c in cvs])}), j AS (SELECT *, {deff} AS deff FROM pl, gd)
SELECT pool, icc::DOUBLE AS icc, cv::DOUBLE AS cv, round({multiplier()!r} * sqrt({' + '.join(f'deff / (floor({c} * {raw} + 1e-9) * {response[c]})' for c in cells)}), 6) AS mde, round(4 * deff * {(multiplier() / 0.2) ** 2!r} / 0.55, 6) AS needed FROM j""",
    }
