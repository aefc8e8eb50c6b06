"""DuckDB statements equivalent to the feature-table queries."""

from __future__ import annotations

FEATURES = [f"f_{i:02d}" for i in range(64)]


def _matrix() -> str:
    cells = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)]
    cells[0] = f"CASE WHEN vec_id % 7 <> 0 THEN {cells[0]} END"
    cells[1] = f"CASE WHEN vec_id % 2 <> 0 THEN {cells[1]} END"
    cells[2] = f"CASE WHEN vec_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE {cells[2]} END"
    cells[3] = "CAST(1.0 AS DOUBLE)"
    listed = ", ".join(f"{c} AS f_{i:02d}" for i, c in enumerate(cells))
    return f"m AS MATERIALIZED (SELECT vec_id, {listed}, label FROM embeddings)"


MATRIX = _matrix()
# Infinite values count as missing.
FINITE = f"{MATRIX}, k AS MATERIALIZED (SELECT vec_id, {', '.join(f'CASE WHEN isfinite({f}) THEN {f} END AS {f}' for f in FEATURES)}, label FROM m)"
DOCS = "d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
PRED = """p AS (SELECT vec_id, CAST(label AS VARCHAR) AS truth,
  CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS VARCHAR) AS prediction FROM embeddings)"""


def _r(expression: str, name: str, digits: int = 9) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _rs(columns, digits: int = 9) -> str:
    return ", ".join(_r(c, c, digits) for c in columns)


def _filled(columns, fill: str, digits: int = 9) -> str:
    return ", ".join(_r(f"coalesce({c}, (SELECT {fill.format(c=c)} FROM k))", c, digits) for c in columns)


def _clean(columns, source: str = "k") -> str:
    """Imputed by median, then standardised, with parameters from ``source``."""
    filled = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {source})) AS {c}" for c in columns)
    fit = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in columns)
    return f"""
filled AS MATERIALIZED (SELECT vec_id, label, {filled} FROM k),
fitrows AS MATERIALIZED (SELECT {filled.replace('SELECT vec_id', 'SELECT vec_id')} FROM {source}),
fit AS MATERIALIZED (SELECT {fit} FROM fitrows)"""


def _scaled(columns, digits: int = 6) -> str:
    return ", ".join(_r(f"({c} - mean_{c}) / CASE WHEN sd_{c} < 1e-12 THEN 1 ELSE sd_{c} END", c, digits) for c in columns)


_KEPT = [f for f in FEATURES if f != "f_01"]

SPLIT = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', vec_id))) AS rn,
   count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM src),
sizes AS (SELECT DISTINCT label, n, total, total - CAST(ceil(0.2 * total) AS BIGINT) AS places FROM numbered),
quota AS (SELECT *, (n * places) // total AS base, row_number() OVER (ORDER BY (n * places) % total DESC, label) AS turn FROM sizes),
side AS (SELECT label, n - base - CASE WHEN turn <= places - (SELECT sum(base) FROM quota) THEN 1 ELSE 0 END AS test_rows FROM quota),
split AS MATERIALIZED (SELECT numbered.*, rn <= test_rows AS is_test FROM numbered JOIN side USING (label))"""

REPORT = """
cls AS (SELECT truth AS class FROM p UNION SELECT prediction FROM p),
cnt AS (SELECT class, (SELECT count(*) FROM p WHERE truth = class) AS support, (SELECT count(*) FROM p WHERE prediction = class) AS predicted,
   (SELECT count(*) FROM p WHERE truth = class AND prediction = class) AS hits FROM cls),
pr AS (SELECT class, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
   CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, CAST(support AS DOUBLE) AS support FROM cnt),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""

_MEANS = ", ".join(_r(f"avg({c})", c) for c in ("precision", "recall", "f1")) + ", sum(support) AS support"
_WEIGHTED = ", ".join(_r(f"sum({c} * support) / sum(support)", c) for c in ("precision", "recall", "f1")) + ", sum(support) AS support"
_ACC = ", ".join(_r("avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END)", c) for c in ("precision", "recall", "f1"))


def _imp() -> str:
    parts = []
    for f in FEATURES:
        for learner, expression in (
            ("deviation", f"stddev_pop({f})"), ("range", f"100 * (max({f}) - min({f}))"), ("positive", f"count(CASE WHEN {f} > 0 THEN 1 END)"),
        ):
            parts.append(f"SELECT '{learner}' AS learner, '{f}' AS feature, CAST({expression} AS DOUBLE) AS importance FROM k")
    return f"{FINITE}, imp AS MATERIALIZED ({' UNION ALL '.join(parts)})"


IMPORTANCES = _imp()
_LONG = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(label AS VARCHAR) AS label, label AS code, {f} AS value FROM k WHERE {f} IS NOT NULL"
    for f in FEATURES
)
_EVENTS = "ev AS (SELECT 'value' AS feature, event_type AS label, dense_rank() OVER (ORDER BY event_type) - 1 AS code, value FROM events WHERE value IS NOT NULL)"


def _violin(source: str) -> str:
    quartiles = ", ".join(_r(f"quantile_cont(value, {p})", n, 6) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return f"SELECT feature, label, count(*) AS n, {_r('min(value)', 'low', 6)}, {quartiles}, {_r('max(value)', 'high', 6)} FROM {source} GROUP BY ALL"



def _first_rounds() -> str:
    """Two rounds of three kinds of boosted trees, three levels each, worked out from the table.

    Bins are places among the order statistics at k/31; gradients are whole
    multiples of 2**-24, so that their sums are exact.
    """
    one = 16777216
    long = " UNION ALL ".join(f"SELECT vec_id, CAST({i} AS INTEGER) AS f, {c} AS v FROM m" for i, c in enumerate(FEATURES))
    parts = [
        MATRIX,
        f"lv AS MATERIALIZED ({long})",
        """cuts AS MATERIALIZED (SELECT f, t, row_number() OVER (PARTITION BY f ORDER BY t) - 1 AS cut FROM (
  SELECT DISTINCT f, vs[CAST(ceil(len(vs) * (k / 31.0)) AS INTEGER)] AS t
  FROM (SELECT f, list(v ORDER BY v) FILTER (v IS NOT NULL) AS vs FROM lv GROUP BY f), range(1, 31) AS q(k)))""",
        "x AS MATERIALIZED (SELECT vec_id, lv.f, CAST(count(cut) AS INTEGER) AS bin FROM lv LEFT JOIN cuts ON cuts.f = lv.f AND cuts.t < lv.v GROUP BY ALL)",
        "cols AS (SELECT f, cut FROM range(64) AS a(f), range((SELECT max(cut) + 1 FROM cuts)) AS b(cut))",
        "names AS (SELECT CAST(row_number() OVER (ORDER BY l) - 1 AS INTEGER) AS c, l AS label FROM (SELECT DISTINCT CAST(label AS VARCHAR) AS l FROM m))",
        "y AS MATERIALIZED (SELECT vec_id, c AS own FROM m JOIN names ON CAST(m.label AS VARCHAR) = names.label)",
        """learners(learner, rate, ridge, least) AS (VALUES ('levels', CAST(0.3 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)),
  ('leaves', CAST(0.1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0.001 AS DOUBLE)), ('symmetric', CAST(0.1 AS DOUBLE), CAST(3 AS DOUBLE), CAST(0 AS DOUBLE)))""",
        "s0 AS MATERIALIZED (SELECT vec_id, learner, c, CAST(0 AS DOUBLE) AS score FROM y, learners, names)",
    ]
    for r in range(2):
        parts.append(f"""g{r} AS MATERIALIZED (SELECT vec_id, learner, c, round_even((p - CASE WHEN own = c THEN 1 ELSE 0 END) * {one}, 0) AS g,
  round_even(p * (1 - p) * {one}, 0) AS h FROM (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, learner) AS p FROM (
  SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id, learner)) AS e FROM s{r})) JOIN y USING (vec_id))""")
        parts.append(f"p{r}0 AS (SELECT vec_id, learner, c, 0 AS node FROM g{r})")
        parts.append(f"o{r}0 AS (SELECT learner, c, 0 AS node, true AS open, 1 AS leaves FROM learners, names)")
        for level in range(3):
            n = f"{r}{level}"
            parts += [
                f"""h{n} AS MATERIALIZED (SELECT learner, c, node, f, bin, sum(g) AS g, sum(h) AS h
  FROM g{r} JOIN p{n} USING (vec_id, learner, c) JOIN x USING (vec_id) GROUP BY ALL)""",
                f"t{n} AS MATERIALIZED (SELECT learner, c, node, sum(g) / {one} AS g, sum(h) / {one} AS h, count(*) AS n FROM g{r} JOIN p{n} USING (vec_id, learner, c) GROUP BY ALL)",
                f"""c{n} AS MATERIALIZED (SELECT oo.learner, oo.c, oo.node, cols.f, cols.cut, open, leaves, least, ridge, coalesce(tt.g, 0) AS g, coalesce(tt.h, 0) AS h,
  coalesce(tt.n, 0) AS n, coalesce(sum(hh.g) OVER w, 0) / {one} AS gl, coalesce(sum(hh.h) OVER w, 0) / {one} AS hl
  FROM o{n} AS oo JOIN learners USING (learner) CROSS JOIN cols LEFT JOIN t{n} AS tt ON tt.learner = oo.learner AND tt.c = oo.c AND tt.node = oo.node
  LEFT JOIN h{n} AS hh ON hh.learner = oo.learner AND hh.c = oo.c AND hh.node = oo.node AND hh.f = cols.f AND hh.bin = cols.cut
  WINDOW w AS (PARTITION BY oo.learner, oo.c, oo.node, cols.f ORDER BY cols.cut))""",
                f"""k{n} AS MATERIALIZED (SELECT *, CASE WHEN hl >= least AND h - hl >= least THEN
  gl * gl / (hl + ridge) + (g - gl) * (g - gl) / ((h - hl) + ridge) - g * g / (h + ridge) ELSE 0 END AS gain FROM c{n})""",
                f"""u{n} AS (SELECT *, CASE WHEN learner = 'symmetric' THEN sum(gain) OVER (PARTITION BY learner, c, f, cut ORDER BY node
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE gain END AS worth FROM k{n})""",
                f"b{n} AS (SELECT * FROM u{n} QUALIFY row_number() OVER (PARTITION BY learner, c, node ORDER BY worth DESC, f, cut) = 1)",
                f"""a{n} AS MATERIALIZED (SELECT *, worth > 0 AND open AND (learner <> 'leaves' OR row_number() OVER (PARTITION BY learner, c
  ORDER BY CASE WHEN worth > 0 AND open THEN gain ELSE -1 END DESC, node) <= 6 - leaves) AS split FROM b{n})""",
                f"""p{r}{level + 1} AS MATERIALIZED (SELECT p.vec_id, p.learner, p.c, 2 * p.node + CASE WHEN split AND bin > cut THEN 1 ELSE 0 END AS node
  FROM p{n} AS p JOIN a{n} AS a ON a.learner = p.learner AND a.c = p.c AND a.node = p.node JOIN x ON x.vec_id = p.vec_id AND x.f = a.f)""",
                f"""o{r}{level + 1} AS MATERIALIZED (SELECT learner, c, 2 * node + side AS node, split AS open,
  leaves + sum(CASE WHEN split THEN 1 ELSE 0 END) OVER (PARTITION BY learner, c, side) AS leaves,
  CASE WHEN split THEN CASE side WHEN 0 THEN gl ELSE g - gl END WHEN side = 0 THEN g ELSE 0 END AS g,
  CASE WHEN split THEN CASE side WHEN 0 THEN hl ELSE h - hl END WHEN side = 0 THEN h ELSE 0 END AS h FROM a{n}, range(2) AS s(side))""",
            ]
        parts.append(f"v{r} AS MATERIALIZED (SELECT learner, c, node, CASE WHEN h + ridge > 0 THEN -rate * g / (h + ridge) ELSE 0 END AS value FROM o{r}3 JOIN learners USING (learner))")
        parts.append(f"s{r + 1} AS MATERIALIZED (SELECT vec_id, learner, c, score + value AS score FROM s{r} JOIN p{r}3 USING (vec_id, learner, c) JOIN v{r} USING (learner, c, node))")
    every = " UNION ALL ".join(f"SELECT {r} AS tree, {level} AS level, * FROM a{r}{level} WHERE split" for r in range(2) for level in range(3))
    parts.append(f"nodes AS MATERIALIZED ({every})")
    return ",\n".join(parts)


FIRST_ROUNDS = _first_rounds()
_SHOWN = "learner, CAST(c AS INTEGER) AS class, CAST(tree AS INTEGER) AS tree"
_LARGEST = "arg_min(label, struct_pack(s := -score, c := c)) FILTER (learner = '{0}') AS {0}_prediction"

ORACLE: dict[str, str] = {
    "first_trees": f"WITH {FIRST_ROUNDS} SELECT {_SHOWN}, CAST(level AS INTEGER) AS level, CAST(node AS INTEGER) AS node, "
    f"printf('f_%02d', nodes.f) AS feature, {_r('t', 'threshold', 6)}, "
    "CAST(255 - (((1 << (4 >> level)) - 1) << (node * (8 >> level))) AS VARCHAR) AS kept, "
    f"{_r('gain', 'gain', 6)}, CAST(n AS BIGINT) AS rows FROM nodes JOIN cuts ON cuts.f = nodes.f AND cuts.cut = nodes.cut",
    "first_leaves": f"WITH {FIRST_ROUNDS} SELECT {_SHOWN}, CAST(node AS INTEGER) AS leaf, {_r('value', 'value')} "
    "FROM (SELECT 0 AS tree, * FROM v0 UNION ALL SELECT 1, * FROM v1)",
    "first_predictions": f"WITH {FIRST_ROUNDS} SELECT vec_id, {', '.join(_LARGEST.format(x) for x in ('levels', 'leaves', 'symmetric'))} "
    "FROM s2 JOIN names USING (c) GROUP BY vec_id",
    "first_importances": f"WITH {FIRST_ROUNDS}, e AS (SELECT learner, f, sum(gain) AS total, count(*) AS n FROM nodes GROUP BY ALL), "
    "w AS (SELECT learner, f, coalesce(total / n, 0) AS mean, coalesce(total, 0) AS total, coalesce(n, 0) AS n "
    "FROM learners CROSS JOIN range(64) AS b(f) LEFT JOIN e USING (learner, f)) "
    f"SELECT learner, printf('f_%02d', f) AS feature, "
    + _r("CASE learner WHEN 'levels' THEN mean / sum(mean) OVER (PARTITION BY learner) "
         "WHEN 'symmetric' THEN 100 * total / sum(total) OVER (PARTITION BY learner) ELSE n END", "importance", 6) + " FROM w",
    "importance_totals": "SELECT learner, CAST(63 AS BIGINT) AS features, total, CAST(0 AS DOUBLE) AS of_constant "
    "FROM (VALUES ('levels', CAST(1 AS DOUBLE)), ('leaves', NULL), ('symmetric', CAST(100 AS DOUBLE))) AS t(learner, total)",
    "write_feature_csv": f"WITH {MATRIX} " + " UNION ALL ".join(
        f"SELECT CAST(label AS VARCHAR) AS label, '{c}' AS feature, count(*) AS images, count(CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN 1 END) AS infinite, "
        f"count(*) - count({c}) AS missing, {_r(f'sum(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN {c} END)', 'total', 6)} FROM m GROUP BY label"
        for c in ["vec_id", *FEATURES]
    ),
    "read_feature_csv": f"WITH {FINITE} SELECT vec_id, {_rs(FEATURES)} FROM k",
    "write_report_json": f"WITH {PRED}, {REPORT}, a AS (SELECT {_r('avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM p), "
    f"r AS (SELECT class, {_rs(['precision', 'recall', 'f1'])}, support FROM rep "
    f"UNION ALL SELECT 'macro avg', {_MEANS} FROM rep UNION ALL SELECT 'weighted avg', {_WEIGHTED} FROM rep) SELECT r.*, accuracy FROM r, a",
    "split_target": f"WITH {MATRIX} SELECT vec_id, {', '.join(_r(f, f) for f in FEATURES)} FROM m",
    "label_to_string": "SELECT vec_id, CAST(label AS VARCHAR) AS label FROM embeddings",
    "select_numeric": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "fill_missing_zero": f"WITH {DOCS} SELECT doc_id, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM d",
    "inf_to_null": f"WITH {FINITE} SELECT vec_id, {_rs(FEATURES)} FROM k",
    "keep_available_columns": f"WITH {MATRIX} SELECT vec_id, {_rs(['f_05', 'f_04'])} FROM m",
    "default_features": f"WITH {MATRIX} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS feature, count({f}) AS n, {_r(f'avg({f})', 'mean')} FROM m"
        for i, (n, f) in enumerate((("lbp_9", "f_05"), ("minor_axis_median", "f_06"), ("solidity_mean", "f_04")), 1)
    ),
    "union_records": f"WITH {FINITE} SELECT vec_id, "
    + ", ".join(_r(f"CASE WHEN vec_id % 3 {'<>' if i < 32 else '='} 1 THEN {c} END", c) for i, c in enumerate(FEATURES)) + " FROM k",
    "union_rows": "SELECT c_custkey AS party, c_acctbal AS balance, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
    "images_left_features": f"WITH {MATRIX} SELECT vec_id, CAST(label AS VARCHAR) AS label, "
    + ", ".join(_r(f"CASE WHEN f_00 IS NULL THEN 0 ELSE coalesce({f}, 0) END", f) for f in FEATURES) + " FROM m",
    "missing_profile": f"WITH {FINITE}, gaps AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) - count({f}) AS missing, count(*) AS n FROM k" for f in FEATURES)
    + f") SELECT feature, missing, {_r('missing / n', 'fraction')} FROM gaps WHERE missing > 0 ORDER BY fraction DESC, feature LIMIT 30",
    "missing_profile_documents": f"WITH {DOCS}, gaps AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS n FROM d" for c in ("doc_id", "n_chars", "quality", "toxic"))
    + f") SELECT feature, missing, {_r('missing / n', 'fraction')} FROM gaps WHERE missing > 0",
    "drop_sparse_columns": f"WITH {MATRIX} SELECT vec_id, {_rs(_KEPT)} FROM m",
    "drop_sparse_documents": f"WITH {DOCS} SELECT doc_id, lang, source, n_chars, "
    + ", ".join(_r(f"coalesce({c}, (SELECT median({c}) FROM d))", c, 6) for c in ("quality", "toxic")) + " FROM d",
    "impute": f"WITH {FINITE} SELECT vec_id, {_filled(FEATURES, 'median({c})')} FROM k",
    "impute_ranked_medians": f"WITH {FINITE} SELECT vec_id, {_filled(FEATURES, 'median({c})')} FROM k",
    "impute_mean": f"WITH {FINITE} SELECT vec_id, {_filled(FEATURES, 'avg({c})')} FROM k",
    "impute_most_frequent": f"WITH {DOCS} SELECT doc_id, lang, source, n_chars, "
    + ", ".join(_r(f"coalesce({c}, (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))", c, 6) for c in ("quality", "toxic"))
    + " FROM d",
    "impute_constant": f"WITH {DOCS} SELECT doc_id, lang, source, n_chars, {_r('coalesce(quality, -1)', 'quality', 6)}, {_r('coalesce(toxic, -1)', 'toxic', 6)} FROM d",
    "standardize": "SELECT c_name, c_mktsegment, " + ", ".join(
        _r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c, 6) for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ) + " FROM customer",
    "clean_features": f"WITH {FINITE}, {_clean(_KEPT)} SELECT vec_id, {_scaled(_KEPT)}, CAST(label AS VARCHAR) AS label FROM filled, fit",
    "clean_parameters": f"WITH {FINITE}, {_clean(_KEPT)} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{f}' AS feature, {'true' if f in _KEPT else 'false'} AS kept, "
        + _r(f"(SELECT 1 - count({f}) / count(*) FROM k)", "missing", 6) + ", "
        + (f"{_r(f'(SELECT median({f}) FROM k)', 'fill', 6)}, {_r(f'(SELECT mean_{f} FROM fit)', 'mean', 6)}, "
           + _r(f"(SELECT CASE WHEN sd_{f} < 1e-12 THEN 1 ELSE sd_{f} END FROM fit)", "scale", 6)
           if f in _KEPT else "CAST(NULL AS DOUBLE) AS fill, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS scale")
        for i, f in enumerate(FEATURES)),
    "clean_features_train_fit": f"WITH {FINITE}, src AS (SELECT vec_id, label FROM embeddings), {SPLIT}, "
    "train AS MATERIALIZED (SELECT k.* FROM k JOIN split USING (vec_id) WHERE NOT is_test), "
    f"{_clean(_KEPT, 'train')} SELECT vec_id, {_scaled(_KEPT)}, CAST(label AS VARCHAR) AS label FROM filled, fit",
    "stratified_split": f"WITH src AS (SELECT vec_id, label FROM embeddings), {SPLIT} SELECT vec_id, label, is_test FROM split",
    "stratified_folds": "WITH o AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, md5(concat('42:', vec_id))) AS place FROM embeddings) "
    "SELECT vec_id, label, CAST((place - 1) % 5 AS INTEGER) AS fold FROM o",
    "holdout_score": f"WITH {PRED}, src AS (SELECT vec_id, truth AS label, prediction FROM p), {SPLIT} "
    f"SELECT {_r('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)', 'test_score', 6)}, count(*) AS test_rows FROM split WHERE is_test",
    "align_columns": f"WITH {FINITE} SELECT vec_id, {_rs(list(reversed(_KEPT)))} FROM k",
    "apply_saved_preprocessing": f"WITH {FINITE}, third AS MATERIALIZED (SELECT * FROM k WHERE vec_id % 3 = 0), "
    f"{_clean(_KEPT, 'third')} SELECT vec_id, {_scaled(_KEPT)} FROM filled, fit",
    "per_class_report": f"WITH {PRED}, {REPORT} SELECT class, {_rs(['precision', 'recall', 'f1'])}, support FROM rep",
    "accuracy": f"WITH {PRED} SELECT {_r('avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM p",
    "macro_avg": f"WITH {PRED}, {REPORT} SELECT {_MEANS} FROM rep",
    "weighted_avg": f"WITH {PRED}, {REPORT} SELECT {_WEIGHTED} FROM rep",
    "classification_report": f"WITH {PRED}, {REPORT} SELECT class, {_rs(['precision', 'recall', 'f1'])}, support FROM rep "
    f"UNION ALL SELECT 'accuracy', {_ACC}, CAST(count(*) AS DOUBLE) FROM p "
    f"UNION ALL SELECT 'macro avg', {_MEANS} FROM rep UNION ALL SELECT 'weighted avg', {_WEIGHTED} FROM rep",
    "confusion_matrix": f"WITH {PRED}, {REPORT} SELECT a.class AS truth, b.class AS prediction, "
    "(SELECT count(*) FROM p WHERE truth = a.class AND prediction = b.class) AS n FROM cls a, cls b",
    "importance_name_join": f"WITH {IMPORTANCES} SELECT learner, feature, {_r('importance', 'importance', 6)} FROM imp",
    "average_importance": f"WITH {IMPORTANCES} SELECT feature, {_r('avg(importance)', 'importance', 6)} FROM imp GROUP BY feature",
    "average_importance_normalized": f"WITH {IMPORTANCES}, s AS (SELECT learner, sum(importance) AS t FROM imp GROUP BY learner) "
    f"SELECT feature, {_r('avg(importance / t)', 'importance', 6)} FROM imp JOIN s USING (learner) GROUP BY feature",
    "importance_by_learner": f"WITH {IMPORTANCES}, r AS (SELECT learner, feature, {_r('importance', 'importance', 6)} FROM imp) "
    "SELECT *, CAST(row_number() OVER (PARTITION BY learner ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM r",
    "sort_by_importance": f"WITH {IMPORTANCES} SELECT feature, {_r('avg(importance)', 'importance', 6)} FROM imp GROUP BY feature ORDER BY importance DESC, feature",
    "top_importances": f"WITH {IMPORTANCES}, a AS (SELECT feature, avg(importance) AS importance FROM imp GROUP BY feature ORDER BY 2 DESC, feature LIMIT 10) "
    f"SELECT feature, {_r('importance', 'importance', 6)} FROM a",
    "top_k": "SELECT CAST(o_orderkey AS VARCHAR) AS feature, o_totalprice AS importance FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25",
    "label_codes": "SELECT CAST(label AS VARCHAR) AS label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT label FROM embeddings)",
    "label_codes_text": "SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT event_type AS label FROM events)",
    "distinct_sorted": "SELECT DISTINCT CAST(label AS VARCHAR) AS label FROM embeddings ORDER BY label",
    "trendline": f"WITH {FINITE}, l AS ({_LONG}) SELECT feature, {_r('regr_slope(value, code)', 'slope', 6)}, "
    f"{_r('regr_intercept(value, code)', 'intercept', 6)}, {_r('CASE WHEN max(value) = min(value) THEN 0 ELSE regr_r2(value, code) END', 'r2', 6)} FROM l GROUP BY feature",
    "trend_endpoints": f"WITH {_EVENTS} SELECT feature, CAST(min(code) AS INTEGER) AS x0, CAST(max(code) AS INTEGER) AS x1, "
    f"{_r('regr_slope(value, code) * min(code) + regr_intercept(value, code)', 'y0', 6)}, "
    f"{_r('regr_slope(value, code) * max(code) + regr_intercept(value, code)', 'y1', 6)} FROM ev GROUP BY feature",
    "violin_summary": f"WITH {FINITE}, l AS ({_LONG}) {_violin('l')}",
    "violin_summary_ranked": f"WITH {_EVENTS} {_violin('ev')}",
    "violin_density": f"WITH {_EVENTS}, f AS (SELECT feature, label, count(*) AS n, min(value) AS low, max(value) AS high, "
    "pow(count(*), -0.2) * stddev_samp(value) AS h FROM ev GROUP BY ALL), "
    "g AS (SELECT f.*, CAST(range AS INTEGER) AS step, low - 2 * h + range * (high - low + 4 * h) / 99 AS x FROM f, range(100)) "
    f"SELECT g.feature, g.label, step, {_r('any_value(x)', 'x', 6)}, "
    f"{_r('sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 'density', 6)} "
    "FROM g JOIN ev ON g.label = ev.label GROUP BY g.feature, g.label, step",
    "column_difference": f"WITH {FINITE} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature FROM k HAVING 2 * count({f}) <= count(*)" for f in FEATURES
    ),
    "scalar_feature_names": """WITH l AS (SELECT DISTINCT label FROM embeddings),
        n AS (SELECT label, concat('gabor_f', format('{:.1f}', 0.1 * (1 + label % 2)), '_a', CAST(floor(degrees(label * pi() / 18)) AS INTEGER), '_mean') AS feature FROM l)
        SELECT label, feature, concat('Gabor F', format('{:.1f}', 0.1 * (1 + label % 2)), ' A', split_part(split_part(feature, '_a', 2), '_', 1), ' Mean') AS title,
          concat('Trend (R²=', format('{:.2f}', label / 8.0), ')') AS legend FROM n""",
}
