"""DuckDB statements equivalent to the image queries.

Written from the definitions, on whole tables: components as a reachability
closure, neighbourhoods as self joins, hulls by half planes.
"""

from __future__ import annotations

TILES = """
e AS (SELECT vec_id AS image_id, CAST(label AS VARCHAR) AS label,
             generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v
      FROM embeddings),
g AS MATERIALIZED (SELECT image_id, label, CAST(i AS INTEGER) AS i,
             CAST(least(255, greatest(0, floor((v + 0.5) * 255))) AS INTEGER) AS g FROM e),
px AS MATERIALIZED (SELECT a.image_id, a.label, a.i // 8 AS r, a.i % 8 AS c, b.g AS red, a.g AS green, d.g AS blue,
             (a.g + b.g + d.g) // 3 AS gray
       FROM g a JOIN g b ON a.image_id = b.image_id AND b.i = 63 - a.i
                JOIN g d ON a.image_id = d.image_id AND d.i = (a.i + 16) % 64)"""

OTSU = """
hist AS (SELECT image_id, 'green' AS ch, green AS v, count(*) AS n FROM px GROUP BY ALL
         UNION ALL SELECT image_id, 'red', red, count(*) FROM px GROUP BY ALL),
rng AS (SELECT *, min(v) OVER (PARTITION BY image_id, ch) AS lo, max(v) OVER (PARTITION BY image_id, ch) AS hi
        FROM hist),
binned AS (SELECT image_id, ch, v, n,
             CASE WHEN lo = hi THEN CAST(v AS DOUBLE)
                  ELSE lo + (least(255, ((v - lo) * 256) // (hi - lo)) + 0.5) * (hi - lo) / 256.0 END AS x FROM rng),
splits AS (SELECT a.image_id, a.ch, a.v, any_value(a.x) AS x,
             sum(CASE WHEN b.v <= a.v THEN b.n ELSE 0 END)::DOUBLE AS w1,
             sum(CASE WHEN b.v > a.v THEN b.n ELSE 0 END)::DOUBLE AS w2,
             sum(CASE WHEN b.v <= a.v THEN b.n * b.x ELSE 0 END) AS s1,
             sum(CASE WHEN b.v > a.v THEN b.n * b.x ELSE 0 END) AS s2
           FROM binned a JOIN binned b ON a.image_id = b.image_id AND a.ch = b.ch GROUP BY a.image_id, a.ch, a.v),
scored AS (SELECT *, CASE WHEN w2 > 0 THEN w1 * w2 * (s1 / w1 - s2 / w2) * (s1 / w1 - s2 / w2) ELSE -1 END AS var FROM splits),
pick AS (SELECT image_id, ch, x, row_number() OVER (PARTITION BY image_id, ch ORDER BY var DESC, v) AS rn FROM scored),
thr AS MATERIALIZED (SELECT image_id, max(CASE WHEN ch = 'green' THEN x END) AS green_threshold,
               max(CASE WHEN ch = 'red' THEN x END) AS red_threshold FROM pick WHERE rn = 1 GROUP BY image_id),
mask AS MATERIALIZED (SELECT p.*, green > green_threshold AS green_mask, red > red_threshold AS red_mask
         FROM px p JOIN thr USING (image_id)),
cellmask AS MATERIALIZED (SELECT image_id, r, c FROM mask WHERE green_mask),
nucmask AS MATERIALIZED (SELECT image_id, r, c FROM mask WHERE green_mask AND red_mask)"""


def _components(p: str, mask: str) -> str:
    """Closure over 8-neighbours; ``{p}px`` names each pixel's region by its first pixel."""
    return f"""
{p}reach(image_id, src, dst) AS (
  SELECT image_id, r * 8 + c, r * 8 + c FROM {mask}
  UNION
  SELECT t.image_id, t.src, m.r * 8 + m.c FROM {p}reach t JOIN {mask} m
    ON m.image_id = t.image_id AND abs(m.r - t.dst // 8) <= 1 AND abs(m.c - t.dst % 8) <= 1),
{p}px AS MATERIALIZED (SELECT image_id, CAST(min(src) AS BIGINT) AS region, dst // 8 AS r, dst % 8 AS c
   FROM {p}reach GROUP BY image_id, dst)"""


def _shapes(p: str, mask: str) -> str:
    """Moments, border walk and hull of the regions of ``{p}px``."""
    return f"""
{p}edge AS MATERIALIZED (SELECT a.image_id, a.r, a.c FROM {mask} a LEFT JOIN {mask} b
   ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1
   GROUP BY a.image_id, a.r, a.c HAVING count(b.r) < 4),
{p}code AS (SELECT a.image_id, a.r, a.c,
     1 + 2 * count(CASE WHEN abs(a.r - b.r) + abs(a.c - b.c) = 1 THEN 1 END)
       + 10 * count(CASE WHEN abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1 THEN 1 END) AS code
   FROM {p}edge a LEFT JOIN {p}edge b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1
   GROUP BY a.image_id, a.r, a.c),
{p}walk AS (SELECT x.image_id, x.region, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0::DOUBLE
       WHEN code IN (21, 33) THEN sqrt(2.0) WHEN code IN (13, 23) THEN (1 + sqrt(2.0)) / 2 ELSE 0 END) AS perimeter
   FROM {p}px x LEFT JOIN {p}code k USING (image_id, r, c) GROUP BY ALL),
{p}mom AS (SELECT image_id, region, count(*)::DOUBLE AS area, avg(r) AS centroid_r, avg(c) AS centroid_c,
     min(r)::INTEGER AS min_r, min(c)::INTEGER AS min_c, (max(r) + 1)::INTEGER AS max_r, (max(c) + 1)::INTEGER AS max_c,
     CAST(count(*) * sum(r * r) - sum(r) * sum(r) AS DOUBLE) AS vr, CAST(count(*) * sum(c * c) - sum(c) * sum(c) AS DOUBLE) AS vc,
     CAST(count(*) * sum(r * c) - sum(r) * sum(c) AS DOUBLE) AS vrc FROM {p}px GROUP BY ALL),
{p}eig AS (SELECT *, (vr + vc + sqrt((vr - vc) * (vr - vc) + 4 * vrc * vrc)) / (2 * area * area) AS l1,
     greatest(vr + vc - sqrt((vr - vc) * (vr - vc) + 4 * vrc * vrc), 0) / (2 * area * area) AS l2 FROM {p}mom),
{p}reg AS MATERIALIZED (SELECT m.*, 4 * sqrt(l1) AS major_axis, 4 * sqrt(l2) AS minor_axis,
     CASE WHEN l1 = 0 THEN 0 ELSE sqrt(1 - l2 / l1) END AS eccentricity, w.perimeter,
     CASE WHEN l2 > 0 THEN sqrt(l1) / sqrt(l2) ELSE 0 END AS aspect_ratio,
     CASE WHEN w.perimeter > 0 THEN 4 * pi() * area / (w.perimeter * w.perimeter) ELSE 0 END AS circularity
   FROM {p}eig m JOIN {p}walk w USING (image_id, region))"""


def _hull(p: str) -> str:
    """Solidity: pixel centres on the inner side of every hull edge over the edge midpoints."""
    return f"""
{p}ext AS (SELECT image_id, region, r, min(c) AS a, max(c) AS b FROM {p}px GROUP BY ALL),
{p}pt AS MATERIALIZED (SELECT DISTINCT image_id, region, 2 * r + o.dy AS y, 2 * (CASE o.s WHEN 0 THEN a ELSE b END) + o.dx AS x
   FROM {p}ext, (VALUES (0, -1, 0), (-1, 0, 0), (1, 0, 0), (0, 1, 1), (-1, 0, 1), (1, 0, 1)) AS o(dy, dx, s)),
{p}side AS MATERIALIZED (SELECT a.image_id, a.region, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2
   FROM {p}pt a JOIN {p}pt b ON a.image_id = b.image_id AND a.region = b.region AND (a.y <> b.y OR a.x <> b.x)
   JOIN {p}pt k ON a.image_id = k.image_id AND a.region = k.region
   GROUP BY ALL HAVING min((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) >= 0),
{p}out AS (SELECT DISTINCT s.image_id, s.region, q.i FROM {p}side s, (SELECT range AS i FROM range(64)) q
   WHERE (x2 - x1) * (2 * (q.i // 8) - y1) - (y2 - y1) * (2 * (q.i % 8) - x1) < 0),
{p}sol AS MATERIALIZED (SELECT m.image_id, m.region, m.area / (64 - coalesce(o.n, 0)) AS solidity FROM {p}reg m
   LEFT JOIN (SELECT image_id, region, count(*) AS n FROM {p}out GROUP BY ALL) o USING (image_id, region))"""


NUCLEUS = """
owned AS (SELECT n.*, s.solidity, c.region AS cell FROM nreg n JOIN nsol s USING (image_id, region)
   JOIN cpx c ON c.image_id = n.image_id AND c.r * 8 + c.c = n.region),
top AS (SELECT *, row_number() OVER (PARTITION BY image_id, cell ORDER BY area DESC, region) AS rn FROM owned),
full_cells AS MATERIALIZED (SELECT c.*, s.solidity, coalesce(t.area, 0) AS nucleus_area, coalesce(t.perimeter, 0) AS nucleus_perimeter,
   coalesce(t.major_axis, 0) AS nucleus_major_axis, coalesce(t.minor_axis, 0) AS nucleus_minor_axis,
   coalesce(t.circularity, 0) AS nucleus_circularity, coalesce(t.solidity, 0) AS nucleus_solidity,
   CASE WHEN t.area IS NULL THEN 0 WHEN c.area - t.area > 0 THEN t.area / (c.area - t.area) END AS nc_ratio
   FROM creg c JOIN csol s USING (image_id, region) LEFT JOIN top t ON t.image_id = c.image_id AND t.cell = c.region AND t.rn = 1)"""

CELLS = ",".join([TILES, OTSU, _components("c", "cellmask"), _shapes("c", "cellmask")])
CELLS_HULL = ",".join([CELLS, _hull("c")])
ALL_REGIONS = ",".join([CELLS_HULL, _components("n", "nucmask"), _shapes("n", "nucmask"), _hull("n"), NUCLEUS])

IMAGES = "img AS (SELECT vec_id AS image_id, CAST(label AS VARCHAR) AS label FROM embeddings)"


def _q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


def six(column: str, prefix: str, digits: int = 6, std_digits: int | None = None) -> str:
    x = f"CAST({column} AS DOUBLE)"
    return ", ".join([
        f"CAST(count({column}) AS DOUBLE) AS {prefix}_count",
        _r(f"coalesce(avg({x}), 0)", f"{prefix}_mean", digits),
        _r(f"coalesce(median({x}), 0)", f"{prefix}_median", digits),
        _r(f"coalesce(stddev_pop({x}), 0)", f"{prefix}_std", std_digits or digits),
        _r(f"coalesce(min({x}), 0)", f"{prefix}_min", digits),
        _r(f"coalesce(max({x}), 0)", f"{prefix}_max", digits),
    ])


NEIGHBOURS = """
near AS (SELECT a.image_id, a.region, min(sqrt((a.centroid_r - b.centroid_r) * (a.centroid_r - b.centroid_r)
      + (a.centroid_c - b.centroid_c) * (a.centroid_c - b.centroid_c))) AS d
   FROM creg a JOIN creg b ON a.image_id = b.image_id AND a.region <> b.region GROUP BY ALL),
nn AS (SELECT i.image_id, coalesce(avg(d), 0) AS nn_mean, coalesce(stddev_pop(d), 0) AS nn_std
   FROM img i LEFT JOIN near n ON n.image_id = i.image_id GROUP BY ALL)"""


def _lbp(points: int, radius: float) -> str:
    """Pattern codes by joining the pixel table once per sample corner."""
    reach = "2" if radius > 1 else "1"
    return f"""
turns AS (SELECT k, round(-{radius} * sin(2 * pi() * k / {points}), 5) + 0.0 AS dy,
                 round({radius} * cos(2 * pi() * k / {points}), 5) + 0.0 AS dx
          FROM (SELECT range AS k FROM range({points}))),
spots AS (SELECT p.image_id, p.r, p.c, p.gray, k, p.r + dy AS y, p.c + dx AS x FROM px p, turns),
parts AS (SELECT *, y - floor(y) AS fy, x - floor(x) AS fx FROM spots),
val AS (SELECT s.*, coalesce(a.gray, 0) AS tl, coalesce(b.gray, 0) AS tr, coalesce(d.gray, 0) AS bl, coalesce(e.gray, 0) AS br
   FROM parts s
   LEFT JOIN px a ON a.image_id = s.image_id AND a.r = floor(y) AND a.c = floor(x)
   LEFT JOIN px b ON b.image_id = s.image_id AND b.r = floor(y) AND b.c = ceil(x)
   LEFT JOIN px d ON d.image_id = s.image_id AND d.r = ceil(y) AND d.c = floor(x)
   LEFT JOIN px e ON e.image_id = s.image_id AND e.r = ceil(y) AND e.c = ceil(x)),
bits AS (SELECT image_id, r, c, k, CASE WHEN (1 - fy) * ((1 - fx) * tl + fx * tr) + fy * ((1 - fx) * bl + fx * br) - gray >= 0
         THEN 1 ELSE 0 END AS bit FROM val),
seq AS (SELECT *, lag(bit) OVER (PARTITION BY image_id, r, c ORDER BY k) AS was FROM bits),
lbp AS MATERIALIZED (SELECT image_id, r, c, CAST(CASE WHEN sum(CASE WHEN bit <> was THEN 1 ELSE 0 END) <= 2
       THEN sum(bit) ELSE {points} + 1 END AS INTEGER) AS code FROM seq GROUP BY ALL)"""


def _glcm(levels: int) -> str:
    return f"""
steps(angle, dr, dc) AS (VALUES (0, 0, 1), (45, 1, 1), (90, 1, 0), (135, 1, -1)),
q AS (SELECT image_id, r, c, gray // (256 // {levels}) AS q FROM px),
pair AS (SELECT a.image_id, angle, a.q AS i, b.q AS j FROM q a, steps, q b
   WHERE a.image_id = b.image_id AND b.r = a.r + dr AND b.c = a.c + dc),
both_ways AS (SELECT image_id, angle, i, j FROM pair UNION ALL SELECT image_id, angle, j, i FROM pair),
glcm AS MATERIALIZED (SELECT image_id, angle, i, j, count(*) / sum(count(*)) OVER (PARTITION BY image_id, angle) AS p
   FROM both_ways GROUP BY image_id, angle, i, j),
mid AS (SELECT image_id, angle, sum(p * i) AS mi, sum(p * j) AS mj FROM glcm GROUP BY ALL),
prop AS (SELECT image_id, angle, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity,
     sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * p) AS "ASM",
     CASE WHEN sqrt(sum(p * (i - mi) * (i - mi))) < 1e-15 THEN 1
          ELSE sum(p * (i - mi) * (j - mj)) / sqrt(sum(p * (i - mi) * (i - mi)) * sum(p * (j - mj) * (j - mj))) END AS correlation
   FROM glcm JOIN mid USING (image_id, angle) GROUP BY ALL),
levels AS (SELECT image_id, max(q) >= {levels} AS over FROM q GROUP BY image_id)"""


def _glcm_columns(*properties: str, digits: int = 6) -> str:
    return ", ".join(
        _r(f"CASE WHEN any_value(over) THEN 0 ELSE {f}({p}) END", f"glcm_{p}_{s}", digits)
        for p in properties for s, f in (("mean", "avg"), ("std", "stddev_pop"))
    )


def _glcm_query(*properties: str, levels: int = 64) -> str:
    return _q(
        f"{TILES}, {_glcm(levels)}",
        f"SELECT image_id, {_glcm_columns(*properties)} FROM prop JOIN levels USING (image_id) GROUP BY image_id",
    )


GABOR = """
filt AS (SELECT f, a, a * pi() / 180 AS t, 3 * sqrt(ln(2) / 2) / (pi() * f) AS sigma
   FROM (VALUES (0.1::DOUBLE), (0.2)) AS x(f), (VALUES (0), (45), (90)) AS y(a)),
sized AS (SELECT *, CAST(ceil(greatest(3 * sigma * abs(cos(t)), 3 * sigma * abs(sin(t)), 1)) AS INTEGER) AS reach FROM filt),
taps AS (SELECT f, a, k, exp(-k * k / (2 * sigma * sigma)) / (sqrt(2 * pi()) * sigma) AS env, 2 * pi() * f * k AS ph, t
   FROM sized, (SELECT range AS k FROM range(-40, 41)) WHERE abs(k) <= reach),
fold AS (SELECT f, a, pos, src, sum(env * cos(ph * cos(t))) AS xr, sum(env * sin(ph * cos(t))) AS xi,
     sum(env * cos(ph * sin(t))) AS yr, sum(env * sin(ph * sin(t))) AS yi
   FROM (SELECT *, pos, CASE WHEN m < 8 THEN m ELSE 15 - m END AS src
         FROM (SELECT taps.*, p.range AS pos, ((p.range - k) % 16 + 16) % 16 AS m FROM taps, range(8) p)) GROUP BY f, a, pos, src),
across AS MATERIALIZED (SELECT f, a, image_id, r, pos AS c, sum(gray * xr) AS re, sum(gray * xi) AS im
   FROM px JOIN fold ON px.c = fold.src GROUP BY ALL),
resp AS (SELECT w.f, w.a, image_id, pos AS r, c, sum(re * yr - im * yi) AS re, sum(re * yi + im * yr) AS im
   FROM across w JOIN fold k ON w.f = k.f AND w.a = k.a AND w.r = k.src GROUP BY ALL),
mag AS (SELECT f, a, image_id, avg(sqrt(re * re + im * im)) AS m, stddev_pop(sqrt(re * re + im * im)) AS s FROM resp GROUP BY ALL)"""

_GABOR_COLUMNS = ", ".join(
    _r(f"max(CASE WHEN f = {f} AND a = {a} THEN {v} END)", f'"gabor_f{f}_a{a}_{s}"', 5)
    for f in (0.1, 0.2) for a in (0, 45, 90) for v, s in (("m", "mean"), ("s", "std"))
)

_NUCLEUS = ("area", "perimeter", "major_axis", "minor_axis", "circularity", "solidity")
_CELL = ("area", "perimeter", "major_axis", "minor_axis", "aspect_ratio", "eccentricity", "solidity", "circularity")


def _shape_summary(digits: int) -> str:
    """One aggregate per image; an image without cells stands for one all-zero cell."""
    padded = ", ".join(f"coalesce({m}, 0) AS {m}" for m in _CELL)
    nuclei = ", ".join(f"nucleus_{m}" for m in _NUCLEUS)
    wide = ", ".join(
        [six(m, m, digits) for m in _CELL] + [six(f"nucleus_{m}", f"nucleus_{m}", digits) for m in _NUCLEUS]
        + [six("nc_ratio", "nc_ratio", digits)]
    )
    return f"""(SELECT image_id, {wide} FROM
      (SELECT i.image_id, {padded}, {nuclei}, nc_ratio FROM img i LEFT JOIN full_cells USING (image_id)) GROUP BY image_id)"""


_INTENSITY = """
mean_gray AS (SELECT image_id, avg(gray) AS m FROM px GROUP BY ALL),
mo AS (SELECT image_id, any_value(m) AS m, avg((gray - m) ** 2) AS m2, avg((gray - m) ** 3) AS m3, avg((gray - m) ** 4) AS m4
   FROM px JOIN mean_gray USING (image_id) GROUP BY image_id)"""


def _intensity_columns(digits: int) -> str:
    return ", ".join([
        _r("m", "intensity_mean", digits), _r("sqrt(m2)", "intensity_std", digits),
        _r("CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END", "intensity_skew", digits),
        _r("CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END", "intensity_kurtosis", digits),
    ])


def _lbp_columns(digits: int, points: int = 8) -> str:
    return ", ".join(
        _r(f"count(CASE WHEN code = {k} THEN 1 END) / (count(*) + 1e-6)", f"lbp_{k}", digits) for k in range(points + 2)
    )


_PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")

FEATURES = ",".join([ALL_REGIONS, IMAGES, NEIGHBOURS, _lbp(8, 1.0), _glcm(64), GABOR, _INTENSITY])


def _feature_table(digits: int) -> str:
    return f"""(SELECT i.image_id, i.label, it.* EXCLUDE (image_id), cc.* EXCLUDE (image_id), sh.* EXCLUDE (image_id),
      {_r('nn_mean', 'nn_mean', digits)}, {_r('nn_std', 'nn_std', digits)},
      lb.* EXCLUDE (image_id), gl.* EXCLUDE (image_id), ga.* EXCLUDE (image_id)
    FROM img i
    JOIN (SELECT image_id, {_intensity_columns(digits)} FROM mo) it USING (image_id)
    JOIN (SELECT i.image_id, CAST(count(region) AS DOUBLE) AS cell_count, {_r('count(region) / 64', 'cell_density', digits)}
          FROM img i LEFT JOIN creg USING (image_id) GROUP BY i.image_id) cc USING (image_id)
    JOIN {_shape_summary(digits)} sh USING (image_id)
    JOIN nn USING (image_id)
    JOIN (SELECT image_id, {_lbp_columns(digits)} FROM lbp GROUP BY image_id) lb USING (image_id)
    JOIN (SELECT image_id, {_glcm_columns(*_PROPERTIES, digits=digits)} FROM prop JOIN levels USING (image_id) GROUP BY image_id) gl USING (image_id)
    JOIN (SELECT image_id, {_GABOR_COLUMNS} FROM mag GROUP BY image_id) ga USING (image_id))"""


def _family_query() -> str:
    from tilewright.plans.image_features import FAMILIES

    parts = " UNION ALL ".join(
        f"SELECT '{family}' AS family, {len(names)} AS columns, "
        + _r("avg(" + " + ".join(f'abs("{n}")' for n in names) + ")", "mean_total", 3) + " FROM feat"
        for family, names in FAMILIES.items()
    )
    return _q(FEATURES, f", feat AS MATERIALIZED {_feature_table(12)} {parts}")


_OVERLAY_COUNTS = """
green_red AS (SELECT image_id, any_value(label) AS label, count(*) AS n, count(CASE WHEN green_mask THEN 1 END) AS g,
   count(CASE WHEN green_mask AND red_mask THEN 1 END) AS gr FROM mask GROUP BY image_id)"""

_VALUES = "CAST(unnest(embedding) AS DOUBLE) AS v"

_LABELLED = _q(
    f"{TILES}, {OTSU}, {_components('c', 'cellmask')}",
    "SELECT image_id, r, c, dense_rank() OVER (PARTITION BY image_id ORDER BY region) AS region_id FROM cpx",
)
_NEAREST = _q(f"{CELLS}, {IMAGES}, {NEIGHBOURS}", f"SELECT image_id, {_r('nn_mean', 'nn_mean')}, {_r('nn_std', 'nn_std')} FROM nn")


def _lines(key: str, digits: int) -> str:
    named = {"qty": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    columns = ", ".join(six(column, prefix, digits, min(digits, 5)) for prefix, column in named.items())
    return f"SELECT {key}, {columns} FROM lineitem GROUP BY {key}"


ORACLE: dict[str, str] = {
    "explode_pixels": _q(TILES, "SELECT image_id, r, c, red, green, blue FROM px"),
    "scan_labelled_images": "SELECT vec_id AS image_id, CAST(label AS VARCHAR) AS label, CASE WHEN vec_id % 100 = 7 THEN 0 ELSE 8 END AS h, "
    "CASE WHEN vec_id % 100 = 7 THEN 0 ELSE 8 END AS w, vec_id % 100 <> 7 AS ok FROM embeddings",
    "decode_rgb": _q(TILES, "SELECT image_id, r, c, red, green, blue FROM px WHERE image_id % 100 <> 7"),
    "decode_row_ranges": _q(TILES, "SELECT image_id, r, c, red, green, blue FROM px WHERE image_id % 100 <> 7"),
    "first_image": "SELECT CAST(label AS VARCHAR) AS label, min(vec_id) AS first_image FROM embeddings GROUP BY label",
    "gray_channel": _q(TILES, "SELECT image_id, r, c, gray FROM px"),
    "normalize_channel": _q(
        TILES, f"SELECT image_id, r, c, {_r('red / 255.0', 'red_norm', 9)}, {_r('green / 255.0', 'green_norm', 9)} FROM px"
    ),
    "safe_ratio": _q(CELLS, f"SELECT image_id, region, {_r('aspect_ratio', 'aspect_ratio')}, {_r('circularity', 'circularity')} FROM creg"),
    "flatten_arrays": f"""
        WITH long AS (SELECT vec_id, {_VALUES}, embedding FROM embeddings)
        SELECT vec_id, {six('v', 'emb')},
          {', '.join(_r(f'any_value(embedding[{i + 1}])', f'head_{i}') for i in range(8))},
          CAST(0 AS DOUBLE) AS none_count, CAST(0 AS DOUBLE) AS none_mean, CAST(0 AS DOUBLE) AS none_max,
          CAST(any_value(len(embedding)) AS DOUBLE) AS words_count
        FROM long GROUP BY vec_id""",
    "nc_ratio": _q(ALL_REGIONS, f"SELECT image_id, region, {_r('nc_ratio', 'nc_ratio')} FROM full_cells"),
    "threshold_fixed": _q(
        TILES, "SELECT image_id, r, c, green / 255.0::DOUBLE > 0.2::DOUBLE AS green_mask, red / 255.0::DOUBLE > 0.3::DOUBLE AS red_mask FROM px"
    ),
    "threshold_otsu": _q(f"{TILES}, {OTSU}", "SELECT image_id, r, c, green_mask, red_mask FROM mask"),
    "otsu_thresholds": _q(
        f"{TILES}, {OTSU}",
        f"SELECT image_id, {_r('green_threshold', 'green_threshold', 9)}, {_r('red_threshold', 'red_threshold', 9)} FROM thr",
    ),
    "mask_share_by_label": _q(
        f"{TILES}, {OTSU}, {_OVERLAY_COUNTS}",
        f"SELECT label, count(*) AS images, {_r('avg(g / n)', 'mean_cell_share')}, {_r('avg(gr / n)', 'mean_overlay_share')} "
        "FROM green_red GROUP BY label",
    ),
    "label_components": _LABELLED,
    "label_components_striped": _LABELLED,
    "region_area_centroid_bbox": _q(
        CELLS, f"SELECT image_id, region, area, {_r('centroid_r', 'centroid_r')}, {_r('centroid_c', 'centroid_c')}, "
        "min_r, min_c, max_r, max_c FROM creg"
    ),
    "region_axes": _q(CELLS, f"SELECT image_id, region, {_r('major_axis', 'major_axis')}, {_r('minor_axis', 'minor_axis')} FROM creg"),
    "region_eccentricity": _q(CELLS, f"SELECT image_id, region, {_r('eccentricity', 'eccentricity')} FROM creg"),
    "region_perimeter": _q(CELLS, f"SELECT image_id, region, {_r('perimeter', 'perimeter')} FROM creg"),
    "region_solidity": _q(
        CELLS_HULL, f"SELECT image_id, region, area, {_r('solidity', 'solidity')} FROM creg JOIN csol USING (image_id, region)"
    ),
    "largest_nucleus": _q(
        ALL_REGIONS, "SELECT image_id, region, " + ", ".join(_r(f"nucleus_{m}", f"nucleus_{m}") for m in _NUCLEUS) + " FROM full_cells"
    ),
    "overlay_masks": _q(
        f"{TILES}, {OTSU}, {_components('c', 'cellmask')}",
        "SELECT image_id, region, CAST(count(*) AS DOUBLE) AS area, CAST(count(CASE WHEN red_mask THEN 1 END) AS DOUBLE) AS overlap "
        "FROM cpx JOIN mask USING (image_id, r, c) GROUP BY image_id, region",
    ),
    "nearest_neighbour": _NEAREST,
    "nearest_neighbour_gridded": _NEAREST,
    "pixel_offset_join": _q(
        f"{TILES}, steps(dr, dc) AS (VALUES (0, 1), (1, 1), (1, 0), (1, -1))",
        "SELECT a.image_id, a.r, a.c, a.gray AS here, dr, dc, b.gray AS there FROM px a, steps, px b "
        "WHERE a.image_id = b.image_id AND b.r = a.r + dr AND b.c = a.c + dc",
    ),
    "histogram_threshold_join": _q(
        f"{TILES}, {OTSU}, span AS (SELECT image_id, min(green) AS green_min, max(green) AS green_max FROM px GROUP BY ALL)",
        f"SELECT image_id, r, c, green, green_min, green_max, {_r('green_threshold', 'green_threshold', 9)} "
        "FROM px JOIN span USING (image_id) JOIN thr USING (image_id)",
    ),
    "intensity_stats": _q(f"{TILES}, {_INTENSITY}", f"SELECT image_id, {_intensity_columns(6)} FROM mo"),
    "order_line_summary": _lines("l_orderkey", 7),
    "line_summary_ranked_medians": _lines("l_returnflag", 4),
    "summary_stats_skip_missing": _q(ALL_REGIONS, f"SELECT image_id, {six('nc_ratio', 'nc_ratio')} FROM full_cells GROUP BY image_id"),
    "cell_count_density": _q(
        f"{TILES}, {OTSU}, {_components('c', 'cellmask')}, {IMAGES}",
        f"SELECT i.image_id, CAST(count(DISTINCT region) AS DOUBLE) AS cell_count, {_r('count(DISTINCT region) / 64', 'cell_density')} "
        "FROM img i LEFT JOIN cpx USING (image_id) GROUP BY i.image_id",
    ),
    "cells_by_label": _q(
        f"{CELLS}, {IMAGES}, per_label AS (SELECT label, CAST(count(*) AS DOUBLE) AS images FROM img GROUP BY label)",
        f"SELECT label, {six('area', 'area')}, any_value(images) AS images, {_r('count(*) / any_value(images)', 'cells_per_image')} "
        "FROM creg JOIN img USING (image_id) JOIN per_label USING (label) GROUP BY label",
    ),
    "shape_summary": _q(f"{ALL_REGIONS}, {IMAGES}", f"SELECT * FROM {_shape_summary(6)}"),
    "lbp_codes": _q(f"{TILES}, {_lbp(8, 1.0)}", "SELECT image_id, r, c, code FROM lbp"),
    "lbp_codes_radius_2": _q(f"{TILES}, {_lbp(12, 2.0)}", "SELECT image_id, r, c, code FROM lbp"),
    "lbp_histogram": _q(f"{TILES}, {_lbp(8, 1.0)}", f"SELECT image_id, {_lbp_columns(6)} FROM lbp GROUP BY image_id"),
    "glcm_matrix": _q(
        f"{TILES}, {_glcm(64)}", f"SELECT image_id, angle, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_r('p', 'p', 9)} FROM glcm"
    ),
    "glcm_contrast": _glcm_query("contrast"),
    "glcm_dissimilarity": _glcm_query("dissimilarity"),
    "glcm_homogeneity": _glcm_query("homogeneity"),
    "glcm_energy_asm": _glcm_query("energy", "ASM"),
    "glcm_correlation": _glcm_query("correlation"),
    "glcm_overflow": _glcm_query("contrast", "ASM", levels=52),
    "gabor_stats": _q(f"{TILES}, {GABOR}", f"SELECT image_id, {_GABOR_COLUMNS} FROM mag GROUP BY image_id"),
    "image_features": _q(FEATURES, f"SELECT * FROM {_feature_table(5)}"),
    "feature_families": _family_query(),
}
