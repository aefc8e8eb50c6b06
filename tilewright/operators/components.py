"""Connected components of masks, as horizontal runs.

Each strip turns its mask into runs and joins those that touch inside the
strip. Strips overlap by one row, so a run on the shared row is known to both
neighbours under its own position: an equi-join on that position tells which
strip-level components are the same region, and star contraction over these few
links gives every region its final id. All images advance together.

A region is named by the row-major index of its first pixel, ``r * w + c``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.ranking import number_within
from tilewright.operators.raster import STRIP_PIXELS, rows_per_strip
from tilewright.operators.segment import masked_strips
from tilewright.session import cut_lineage

# Two rows on each side settle the border pixels around a strip's own rows.
HALO = 2

_INT, _LONG = T.IntegerType(), T.LongType()
RUN_FIELDS = {
    "r": _INT, "c0": _INT, "c1": _INT, "comp": _LONG, "host_c0": _INT,
    "p_unit": _INT, "p_diag": _INT, "p_mixed": _INT, "shared": T.BooleanType(),
}
RUN_TYPE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in RUN_FIELDS.items()]))

# How a border pixel with a given neighbour code counts in the perimeter.
PERIMETER_CODES = {"unit": (5, 7, 15, 17, 25, 27), "diag": (21, 33), "mixed": (13, 23)}


def _touching_labels(row, c0, c1, width):
    """Smallest run number among all runs reachable over 8-neighbours."""
    import numpy as np

    pitch = width + 2
    first_key, last_key = row * pitch + c0, row * pitch + c1
    below = (row + 1) * pitch
    lo = np.searchsorted(last_key, below + c0 - 1, "left")
    hi = np.maximum(np.searchsorted(first_key, below + c1 + 1, "right"), lo)
    a = np.repeat(np.arange(len(row)), hi - lo)
    b = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    label = np.arange(len(row))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _perimeter_kinds(mask, first, last):
    """Kind of each border pixel (1 unit, 2 diag, 3 mixed, 0 none) for rows first..last-1."""
    import numpy as np

    lookup = np.zeros(64, dtype=np.int8)
    for number, codes in enumerate(PERIMETER_CODES.values(), start=1):
        lookup[list(codes)] = number
    m = np.pad(mask, 1)
    inner = m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    edge = np.pad((mask & ~inner).astype(np.int8), 1)
    rows = slice(first + 1, last + 1)
    up, down = slice(first, last), slice(first + 2, last + 2)
    mid, left, right = slice(1, -1), slice(None, -2), slice(2, None)
    sides = edge[up, mid] + edge[down, mid] + edge[rows, left] + edge[rows, right]
    corners = edge[up, left] + edge[up, right] + edge[down, left] + edge[down, right]
    return lookup[edge[rows, mid] + 2 * sides + 10 * corners]


def _strip_runs(mask, host, width, top, r0, n_rows):
    """Runs of one strip as columns in RUN_TYPE order; ``host`` is the enclosing mask."""
    import numpy as np

    first, last = max(r0 - 1, 0) - top, r0 - top + n_rows
    kinds = _perimeter_kinds(mask, first, last).ravel()
    band, around = mask[first:last], host[first:last]

    def starts(m):
        found = m.copy()
        found[:, 1:] &= ~m[:, :-1]
        return np.flatnonzero(found)

    ends = band.copy()
    ends[:, :-1] &= ~band[:, 1:]
    s, e = starts(band), np.flatnonzero(ends)
    row, c0, c1 = s // width, s % width, e % width
    r = row + first + top
    label = _touching_labels(row, c0, c1, width)
    comp = (r.astype(np.int64) * width + c0)[label]
    host_starts = starts(around)
    host_c0 = host_starts[np.searchsorted(host_starts, s, "right") - 1] % width
    columns = [r, c0, c1, comp, host_c0]
    for number in (1, 2, 3):
        seen = np.concatenate([[0], np.cumsum(kinds == number)])
        columns.append(seen[e + 1] - seen[s])
    columns.append(r < r0)
    return columns


@F.arrow_udf(RUN_TYPE)
def strip_runs(mask, host, w, top, r0, n_rows):
    """Runs of every strip in an Arrow batch."""
    import numpy as np
    import pyarrow as pa

    bits, host_bits = (x.flatten().to_numpy(zero_copy_only=False).astype(bool) for x in (mask, host))
    cuts = mask.offsets.to_numpy()
    cuts = cuts - cuts[0]
    pieces, lengths = [], []
    for i, (width, first, own, count) in enumerate(zip(*(x.to_pylist() for x in (w, top, r0, n_rows)))):
        part = slice(cuts[i], cuts[i + 1])
        found = _strip_runs(
            bits[part].reshape(-1, width), host_bits[part].reshape(-1, width), width, first, own, count
        )
        pieces.append(found)
        lengths.append(len(found[0]))
    names = list(RUN_FIELDS)
    types = [pa.int32()] * 3 + [pa.int64()] + [pa.int32()] * 4 + [pa.bool_()]
    arrays = [pa.array(np.concatenate(col), type=t) for col, t in zip(zip(*pieces), types)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, names))


def _star_round(edges: DataFrame, where: list[str]) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = edges.select(*where, "u", "v").unionByName(edges.selectExpr(*where, "v AS u", "u AS v"))
    lows = both.groupBy(*where, "u").agg(F.expr("least(min(v), u) AS low"))
    large = (
        both.join(lows, [*where, "u"]).filter("v > u AND v > low").selectExpr(*where, "v AS u", "low AS v").distinct()
    )
    lows = large.groupBy(*where, "u").agg(F.expr("min(v) AS low"))
    rest = large.join(lows, [*where, "u"]).filter("v > low").selectExpr(*where, "v AS u", "low AS v")
    return rest.unionByName(lows.selectExpr(*where, "u", "low AS v")).distinct()


def contract_links(links: DataFrame, where: list[str]) -> DataFrame:
    """Connected components of links (u, v): ``where..., u, root`` for u != root.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    every node hangs on the smallest node of its component. A round emits no
    more edges than it reads and never gathers a node's neighbours. The edge
    table is written after each round, so plans stay short and lost executors
    cost one round.
    """
    edges = links.selectExpr(*where, "greatest(u, v) AS u", "least(u, v) AS v").filter("u > v").distinct()
    edges = cut_lineage(edges, "links")

    def mark(table: DataFrame):
        key = ", ".join([*where, "u", "v"])
        return table.agg(F.expr(f"struct(count(1), sum(CAST(xxhash64({key}) AS DECIMAL(38, 0))))")).first()[0]

    before = mark(edges)
    while before[0]:
        edges = cut_lineage(_star_round(edges, where), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.selectExpr(*where, "u", "v AS root")


def labelled_runs(
    rasters: DataFrame,
    use_otsu: bool = True,
    green_threshold: float = 0.2,
    red_threshold: float = 0.3,
    thresholds: DataFrame | None = None,
    nuclei: bool = True,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Runs of cells (kind 0, green mask) and nuclei (kind 1, green and red).

    Columns ``image_id, w, kind, r, c0, c1, region, host_c0`` and the perimeter
    counts. Two 8-adjacent pixels of a nucleus are both green, hence in the
    same cell, so labelling the overlay needs no loop over cells. ``host_c0``
    is where the enclosing cell run starts on the same row.
    """
    # Number of images and whether any needs more than one strip: image sizes only.
    facts = rasters.agg(
        F.expr("count(1) AS images"), F.expr(f"coalesce(bool_or(ok AND h > {rows_per_strip(strip_pixels)}), false) AS tall")
    ).first()
    strips = masked_strips(
        rasters, use_otsu, green_threshold, red_threshold, HALO, thresholds, strip_pixels, facts["images"]
    )
    shape = ("w", "top", "r0", "n_rows")
    masks = strips.selectExpr("*", "zip_with(green_mask, red_mask, (g, r) -> g AND r) AS overlay")
    found = masks.select(
        "image_id", "w", F.expr("r0 + n_rows - 1 AS last_row"),
        strip_runs("green_mask", "green_mask", *shape).alias("cells"),
        *([strip_runs("overlay", "green_mask", *shape).alias("nuclei")] if nuclei else []),
    )
    kinds = [f"transform({name}, x -> struct({kind} AS kind, x AS x))" for kind, name in enumerate(["cells", "nuclei"])]
    runs = found.selectExpr(
        "image_id", "w", "last_row", f"explode({f'concat({kinds[0]}, {kinds[1]})' if nuclei else kinds[0]}) AS e"
    ).selectExpr("image_id", "w", "last_row", "e.kind", "e.x.*")
    if not facts["tall"]:
        return runs.withColumnRenamed("comp", "region").drop("last_row", "shared")

    runs = cut_lineage(runs, "runs")
    where = ["image_id", "kind"]
    upper = runs.filter("NOT shared AND r = last_row").selectExpr(*where, "r", "c0", "comp AS u")
    lower = runs.filter("shared").selectExpr(*where, "r", "c0", "comp AS v")
    links = upper.join(lower, [*where, "r", "c0"]).filter("u <> v")
    roots = contract_links(links, where).withColumnRenamed("u", "comp")
    return runs.filter("NOT shared").join(roots, [*where, "comp"], "left").selectExpr(
        "image_id", "w", "kind", "r", "c0", "c1",
        "coalesce(root, comp) AS region", "host_c0", "p_unit", "p_diag", "p_mixed",
    )


def region_numbers(runs: DataFrame, rows_per_bucket: int = 64) -> DataFrame:
    """``image_id, kind, region, region_id``: 1..n by first pixel in raster order."""
    heads = runs.filter("r * CAST(w AS BIGINT) + c0 = region").select("image_id", "kind", "r", "region")
    numbered = number_within(heads, ["image_id", "kind"], f"r DIV {rows_per_bucket}", "region", "region_id")
    return numbered.select("image_id", "kind", "region", "region_id")


def label_pixels(runs: DataFrame) -> DataFrame:
    """``image_id, kind, r, c, region_id`` for every pixel of a mask."""
    numbered = runs.join(region_numbers(runs), ["image_id", "kind", "region"])
    return numbered.selectExpr("image_id", "kind", "r", "explode(sequence(c0, c1)) AS c", "region_id")
