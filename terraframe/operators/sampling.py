"""Bilinear sampling of rasters at arbitrary positions, on block tables.

Targets have raster_id, the fractional pixel px, py and the raster's width
and height. Each is joined to the one block that holds its four neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from terraframe.functions.colour import OUTSIDE_GREY
from terraframe.operators.blocks import BLOCK, BLOCK_COLUMNS, join_blocks

_WORK = (
    "__in", "__x", "__y", "__c0", "__r0", "__fx", "__fy", "__w0", "__w1", "__w2", "__w3",
    "__dx", "__dy", "pos",
)


def _placed(targets: DataFrame, inside: str, x: str, y: str) -> DataFrame:
    """Add the corner pixel and the four weights of a position (x, y)."""
    return (
        targets.selectExpr("*", f"coalesce({inside}, false) AS __in", f"{x} AS __x", f"{y} AS __y")
        .selectExpr("*", "cast(floor(__x) AS int) AS __c0", "cast(floor(__y) AS int) AS __r0")
        .selectExpr("*", "__x - __c0 AS __fx", "__y - __r0 AS __fy")
    )


_WEIGHTS = (
    "(1 - __fx) * (1 - __fy) AS __w0",
    "__fx * (1 - __fy) AS __w1",
    "(1 - __fx) * __fy AS __w2",
    "__fx * __fy AS __w3",
)
_CLAMPED_X = "CASE WHEN px IS NOT NULL THEN least(greatest(px, 0D), width - 1D) END"
_CLAMPED_Y = "CASE WHEN py IS NOT NULL THEN least(greatest(py, 0D), height - 1D) END"
# Positions of the four neighbours. Past the raster's last column or row they
# point elsewhere, but there the weight is zero and the value is not used.
_AT = ("pos", "pos + 1", "pos + bw", "pos + bw + 1")


def _values(joined: DataFrame, value: str, positions: tuple[str, ...] = _AT) -> DataFrame:
    return joined.selectExpr(
        "*", *_WEIGHTS, *(f"get({value}, {p}) AS __v{k}" for k, p in enumerate(positions))
    )


def _finish(df: DataFrame, values: list[str]) -> DataFrame:
    return df.drop(*_WORK, *(f"__v{k}" for k in range(4)), *BLOCK_COLUMNS, *values)


def sample_known(
    targets: DataFrame, blocks: DataFrame, value: str = "v", out: str = "sample", size: int = BLOCK
) -> DataFrame:
    """Bilinear over the known neighbours only.

    Half a pixel outside is accepted; unknown neighbours and zero weights are
    left out and the rest renormalised; null if none.
    """
    inside = "px >= -0.5D AND px <= width - 0.5D AND py >= -0.5D AND py <= height - 0.5D"
    ready = _placed(targets, inside, _CLAMPED_X, _CLAMPED_Y)
    joined = _values(join_blocks(ready, blocks, "__r0", "__c0", size), value)
    used = [f"CASE WHEN __v{k} IS NOT NULL AND __w{k} > 0 THEN {{}} ELSE 0D END" for k in range(4)]
    total = " + ".join(u.format(f"__v{k} * __w{k}") for k, u in enumerate(used))
    weight = " + ".join(u.format(f"__w{k}") for k, u in enumerate(used))
    summed = joined.selectExpr("*", f"{total} AS __sum", f"{weight} AS __wsum")
    done = summed.selectExpr("*", f"CASE WHEN __in AND __wsum > 0 THEN __sum / __wsum END AS {out}")
    return _finish(done.drop("__sum", "__wsum"), [value])


def sample_filled(
    targets: DataFrame, blocks: DataFrame, value: str = "filled", out: str = "sample", size: int = BLOCK
) -> DataFrame:
    """Bilinear of a raster without gaps, the position clamped to it."""
    ready = _placed(targets, "true", _CLAMPED_X, _CLAMPED_Y)
    joined = _values(join_blocks(ready, blocks, "__r0", "__c0", size), value)
    total = " + ".join(f"CASE WHEN __w{k} > 0 THEN __v{k} * __w{k} ELSE 0D END" for k in range(4))
    return _finish(joined.selectExpr("*", f"{total} AS {out}"), [value])


def sample_ground(
    targets: DataFrame, blocks: DataFrame, out: str = "ground", size: int = BLOCK
) -> DataFrame:
    """Ground height at points: strictly inside, nearest pixel known, filled bilinear.

    ``blocks`` carries ``v`` (null where unknown) and ``filled``.
    """
    inside = (
        "px >= 0 AND py >= 0 AND px <= width - 1 AND py <= height - 1 AND width >= 2 AND height >= 2"
    )
    ready = (
        targets.selectExpr(
            "*",
            f"coalesce({inside}, false) AS __in",
            "least(cast(floor(px) AS int), width - 2) AS __c0",
            "least(cast(floor(py) AS int), height - 2) AS __r0",
        )
        .selectExpr("*", "px - __c0 AS __fx", "py - __r0 AS __fy")
    )
    joined = _values(join_blocks(ready, blocks, "__r0", "__c0", size), "filled")
    # Inside, the position is not negative and halves round up.
    nearest = "get(v, pos + cast(floor(__fy + 0.5D) AS int) * bw + cast(floor(__fx + 0.5D) AS int))"
    total = " + ".join(f"__v{k} * __w{k}" for k in range(4))
    done = joined.selectExpr("*", f"CASE WHEN __in AND {nearest} IS NOT NULL THEN {total} END AS {out}")
    return _finish(done, ["v", "filled"])


def sample_image(
    targets: DataFrame,
    blocks: DataFrame,
    bands: tuple[str, ...] = ("r", "g", "b"),
    outs: tuple[str, ...] = ("ored", "ogreen", "oblue"),
    size: int = BLOCK,
) -> DataFrame:
    """Bilinear image colour in [0, 1], grey outside; adds ``outside``.

    Inside is ``0 <= px < width``: half a pixel before the first centre is
    outside, up to one pixel past the last is clamped.
    """
    inside = "px >= 0 AND px < width AND py >= 0 AND py < height"
    ready = _placed(targets, inside, "px", "py").selectExpr(
        "*",
        "CASE WHEN __c0 < width - 1 THEN 1 ELSE 0 END AS __dx",
        "CASE WHEN __r0 < height - 1 THEN 1 ELSE 0 END AS __dy",
    )
    joined = join_blocks(ready, blocks, "__r0", "__c0", size).selectExpr("*", *_WEIGHTS)
    positions = ("pos", "pos + __dx", "pos + __dy * bw", "pos + __dy * bw + __dx")
    colours = []
    for band, out in zip(bands, outs, strict=True):
        total = " + ".join(f"get({band}, {p}) / 255D * __w{k}" for k, p in enumerate(positions))
        colours.append(f"CASE WHEN __in THEN {total} ELSE {OUTSIDE_GREY}D END AS {out}")
    return _finish(joined.selectExpr("*", "NOT __in AS outside", *colours), list(bands))


def sample_covered(
    targets: DataFrame, blocks: DataFrame, bands: tuple[str, ...] = ("r", "g", "b"), alpha: str = "a", size: int = BLOCK
) -> DataFrame:
    """Bilinear image colour with coverage: adds the bands and ``alpha`` as bytes.

    Colours are weighted by their pixels' alpha (premultiplied), so a
    transparent neighbour gives none of its colour; neighbours outside the
    image are transparent. Alpha is the weighted coverage; where it is 0 the
    bands are 0 too. Half a pixel outside is accepted, as for values.
    """
    inside = "px >= -0.5D AND px <= width - 0.5D AND py >= -0.5D AND py <= height - 0.5D"

    def shares(axis: str, count: str) -> list[str]:
        # before the first centre the neighbour in front is outside, past the last the one behind
        at, past = f"__{axis}0", f"__f{axis}"
        return [
            f"CASE WHEN {at} < 0 THEN {past} ELSE 1 - {past} END AS __{axis}a",
            f"CASE WHEN {at} < 0 OR {at} + 1 > {count} - 1 THEN 0D ELSE {past} END AS __{axis}b",
        ]

    ready = (
        targets.selectExpr("*", f"coalesce({inside}, false) AS __in")
        .selectExpr("*", "CASE WHEN __in THEN cast(floor(px) AS int) END AS __c0", "CASE WHEN __in THEN cast(floor(py) AS int) END AS __r0")
        .selectExpr("*", "px - __c0 AS __fc", "py - __r0 AS __fr")
        .selectExpr("*", *shares("c", "width"), *shares("r", "height"))
        .selectExpr("*", "greatest(__c0, 0) AS __cc", "greatest(__r0, 0) AS __rr")
    )
    joined = join_blocks(ready, blocks, "__rr", "__cc", size)
    weights = ("__ca * __ra", "__cb * __ra", "__ca * __rb", "__cb * __rb")
    # a weight of 0 may point past the block
    parts = [f"CASE WHEN {w} > 0 THEN {w} * get({alpha}, {p}) ELSE 0D END AS __k{i}" for i, (w, p) in enumerate(zip(weights, _AT, strict=True))]
    covered = joined.selectExpr("*", *parts).selectExpr("*", "__k0 + __k1 + __k2 + __k3 AS __cover")
    mixed = {b: " + ".join(f"CASE WHEN __k{i} > 0 THEN __k{i} * get({b}, {p}) ELSE 0D END" for i, p in enumerate(_AT)) for b in bands}
    colours = [f"CASE WHEN __cover > 0 THEN cast(floor(({m}) / __cover + 0.5D) AS int) ELSE 0 END AS __out_{b}" for b, m in mixed.items()]
    out = covered.selectExpr(*targets.columns, *colours, f"cast(floor(coalesce(__cover, 0D) + 0.5D) AS int) AS __out_{alpha}")
    return out.withColumnsRenamed({f"__out_{b}": b for b in (*bands, alpha)})
