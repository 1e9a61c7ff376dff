"""Synthetic anomalies: donors, boxes, blending, and how separable they are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ArtifactError, ConfigError, DataError
from ..functions import scalar
from .metrics import dice_of
from .prefix import cumulative, numbered, octaves

#: Fixed values of the patch contract.
MIN_FOREGROUND, MIN_CONTRAST, ATTEMPTS, SLACK = 0.5, 0.01, 25, 1e-4


def donor_index(index: Column, draw: Column, n: Column) -> Column:
    """A donor that is not the target: draw among n - 1, one further from the target on."""
    j = F.pmod(draw, n - 1)
    return F.when(j < index, j).otherwise(j + 1)


def donors(items: DataFrame, order: str) -> DataFrame:
    """index and donor of every item, at least two items, numbered by a numeric column without a task that orders all."""
    ranked = numbered(items, order, "index")
    sized = ranked.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("_n"))))
    return sized.withColumn("donor", donor_index(F.col("index"), F.col(order), F.col("_n")).cast("bigint")).drop("_n")


def box_blend(voxels: DataFrame, boxes: Sequence[tuple], healthy: str = "v", donor: str = "donor_v") -> DataFrame:
    """blended and mask: inside boxes (no, z0, z1, y0, y1, x0, x1, alpha) the highest alpha wins, of equal ones the last.

    Boxes of a chunk are a handful, so they are literals of the expression and no join is needed.
    """
    hits = [F.when(F.col("slice_index").between(z0, z1 - 1) & F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1), F.struct(F.lit(float(a)).alias("alpha"), F.lit(no).alias("no"))) for no, z0, z1, y0, y1, x0, x1, a in boxes]
    best = hits[0] if len(hits) == 1 else F.greatest(*hits)
    alpha = F.coalesce(best["alpha"], F.lit(0.0))
    blended = F.when(alpha > 0, (1 - alpha) * F.col(healthy) + alpha * F.col(donor)).otherwise(F.col(healthy))
    return voxels.withColumn("mask", alpha).withColumn("blended", blended)


#: Depth, height and width of a cell of the grid that patches and voxels meet in.
CELL = (4, 8, 8)
AXES = (("slice_index", "z"), ("y", "y"), ("x", "x"))


def patches_by_cell(patches: DataFrame, key: str, cell: Sequence[int] = CELL) -> DataFrame:
    """(key, _cz, _cy, _cx, _boxes): the patches of each cell that they touch, cut to the cell.

    Of patches that are equal inside a cell only the one that wins stays, so a cell holds a bounded number
    (of distinct boxes inside it) however many patches a volume has.
    """
    rows = patches.filter((F.col("z0") < F.col("z1")) & (F.col("y0") < F.col("y1")) & (F.col("x0") < F.col("x1")))
    for (_, axis), size in zip(AXES, cell, strict=True):
        low, high = F.col(f"{axis}0"), F.col(f"{axis}1")
        rows = rows.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))))
        start = F.col(f"_c{axis}") * size
        rows = rows.withColumns({f"_{axis}0": F.greatest(low - start, F.lit(0)).cast("int"), f"_{axis}1": F.least(high - start, F.lit(size)).cast("int")})
    place = [key, "_cz", "_cy", "_cx"]
    edges = [f"_{axis}{side}" for _, axis in AXES for side in (0, 1)]
    winners = rows.groupBy(*place, *edges).agg(F.max(F.struct(F.col("alpha").cast("double").alias("alpha"), "no")).alias("_best"))
    return winners.groupBy(*place).agg(F.collect_list(F.struct("_best", *edges)).alias("_boxes"))


def blend_by_table(voxels: DataFrame, patches: DataFrame, key: str, healthy: str = "v", donor: str = "donor_v", cell: Sequence[int] = CELL) -> DataFrame:
    """The same with a patch table (key, no, z0 ... x1, alpha), which may hold any number of patches a volume.

    Patches and voxels meet in the cells of a grid, so a voxel is held against the patches of its cell
    alone, and the join's keys are cells, of which a hot volume has many. `patch_no` tells the patch that
    won, null where there is none. Empty boxes touch nothing.
    """
    lists = patches_by_cell(patches, key, cell)
    at = {f"_c{axis}": F.floor(F.col(name) / size) for (name, axis), size in zip(AXES, cell, strict=True)}
    joined = voxels.withColumns(at).join(lists, [key, "_cz", "_cy", "_cx"], "left")
    within = {axis: (F.col(name) - F.col(f"_c{axis}") * size).cast("int") for (name, axis), size in zip(AXES, cell, strict=True)}

    def holds(b: Column) -> Column:
        return (within["z"] >= b._z0) & (within["z"] < b._z1) & (within["y"] >= b._y0) & (within["y"] < b._y1) & (within["x"] >= b._x0) & (within["x"] < b._x1)

    best = F.array_max(F.transform(F.filter("_boxes", holds), lambda b: b._best))
    rows = joined.withColumn("_best", best)
    alpha = F.coalesce(F.col("_best.alpha"), F.lit(0.0))
    rows = rows.withColumn("mask", alpha).withColumn("patch_no", F.col("_best.no")).drop("_boxes", "_best", "_cz", "_cy", "_cx")
    return rows.withColumn("blended", F.when(F.col("mask") > 0, (1 - F.col("mask")) * F.col(healthy) + F.col("mask") * F.col(donor)).otherwise(F.col(healthy)))


def corrupted(items: DataFrame, key: str, probability: float, seed: int = 42) -> DataFrame:
    """Whether an item is corrupted at all, from a uniform that depends on seed and item only."""
    return items.withColumn("corrupt", scalar.uniform(F.lit(seed), F.col(key)) <= probability)


def place_box(healthy: np.ndarray, donor: np.ndarray, rng: np.random.Generator, sizes: tuple[int, int], depths: tuple[int, int], alphas: tuple[float, float], threshold: float, aligned: bool = True) -> tuple:
    """One box (z0, z1, y0, y1, x0, x1, alpha): foreground enough and apart from the donor, tried a bounded number of times.

    All corners are drawn at once; the first that passes both tests is taken. Where none does, the last
    with enough foreground is the fallback, the origin where there was none. Unless aligned, the donor's part
    of each attempt lies at a corner of its own; the result ends with that corner.
    """
    low = np.array([depths[0], sizes[0], sizes[0]])
    edge = rng.integers(low, np.minimum([depths[1], sizes[1], sizes[1]], healthy.shape) + 1)
    corners = rng.integers(0, np.array(healthy.shape) - edge + 1, size=(ATTEMPTS, 3))
    sources = corners if aligned else rng.integers(0, np.array(donor.shape) - edge + 1, size=(ATTEMPTS, 3))
    cut = lambda volume, at: np.stack([volume[tuple(map(slice, c, c + edge))] for c in at]).reshape(ATTEMPTS, -1)
    ours, theirs = cut(healthy, corners), cut(donor, sources)
    solid = (ours > threshold).mean(axis=1) >= MIN_FOREGROUND
    apart = solid & (np.abs(ours.mean(axis=1) - theirs.mean(axis=1)) >= MIN_CONTRAST)
    chosen = np.flatnonzero(apart)[:1] if apart.any() else np.flatnonzero(solid)[-1:]
    start, source = (corners[chosen[0]], sources[chosen[0]]) if chosen.size else np.zeros((2, 3), int)
    spans = [int(n) for pair in zip(start, start + edge, strict=True) for n in pair]
    return (*spans, float(rng.uniform(*alphas)), bool(apart.any()), *map(int, source))


def synthetic_boxes(pairs: DataFrame, key: str, shape: tuple[int, int, int], seed: int = 42, epoch: int = 0, sizes: tuple[int, int] = (2, 4), depths: tuple[int, int] = (1, 2), alphas: tuple[float, float] = (0.3, 0.9), n_boxes: tuple[int, int] = (1, 3), threshold: float = 0.0, donor_alignment: str = "same") -> DataFrame:
    """Boxes per (key, healthy, donor) row of flat arrays. Draws are sequential in a row and depend on seed, epoch and key only."""
    if depths[1] > shape[0]:
        raise ConfigError(f"boxes of depth {depths[1]} do not fit a volume of depth {shape[0]}")
    if donor_alignment not in ("same", "random"):
        raise ConfigError(f"donor_alignment is same or random, not {donor_alignment!r}")
    for low, high in (sizes, depths, alphas, n_boxes):
        if low > high:
            raise ConfigError(f"a range must not fall from {low} to {high}")

    def volume(flat) -> np.ndarray:
        x = np.asarray(flat, float)
        if x.size != np.prod(shape):
            raise DataError(f"a volume has {x.size} voxels, wanted {shape}")
        if not (np.isfinite(x).all() and x.min() >= -SLACK and x.max() <= 1 + SLACK):
            raise DataError(f"volumes must lie in [0, 1], not [{x.min()}, {x.max()}]")
        return x.reshape(shape)

    def place(batches):
        for batch in batches:
            rows = []
            for k, a, b in zip(batch[key], batch["healthy"], batch["donor"], strict=True):
                rng = np.random.default_rng(scalar.blake_seed(seed, epoch, int(k)))
                a, b = (volume(x) for x in (a, b))
                rows += [(k, no, *place_box(a, b, rng, sizes, depths, alphas, threshold, donor_alignment == "same")) for no in range(int(rng.integers(n_boxes[0], n_boxes[1] + 1)))]
            yield pd.DataFrame(rows, columns=[key, "no", "z0", "z1", "y0", "y1", "x0", "x1", "alpha", "found", "donor_z", "donor_y", "donor_x"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "healthy", "donor").mapInPandas(place, f"{key} {kind}, no int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, alpha double, found boolean, donor_z int, donor_y int, donor_x int")


def intensity_separability(voxels: DataFrame, truth: Column, value: str = "v", threshold: float = 0.0, cuts: int = 256) -> DataFrame:
    """The best Dice that one intensity cut of either polarity reaches on the foreground; 0 without foreground.

    The cuts are `cuts` evenly spaced quantiles of the foreground, interpolated. How much lies above and below a cut
    follows from the running counts at the value of its lower rank, so counts per distinct value suffice: a cut stands
    on a value if its position falls among that value's ranks, and else between two values.
    """
    v = F.col(value)
    tally = voxels.filter(v > threshold).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(truth).alias("_i"))
    totals = tally.agg(F.sum("_n").alias("_all"), F.sum("_i").alias("_hits")).crossJoin(F.broadcast(voxels.agg(F.count_if(truth).alias("_g"))))
    ranked = cumulative(tally, "_v", ["_n", "_i"], bucket=octaves(F.col("_v"))).crossJoin(F.broadcast(totals))
    k, m, upto, hits = F.lit(cuts - 1), F.greatest(F.col("_all") - 1, F.lit(1)), F.col("_n_upto"), F.col("_i_upto")
    low, high = (upto - F.col("_n")) * k, (upto - 1) * k
    on, after = F.ceil(low / m), F.floor(high / m) + 1
    stands = (on <= k) & (on * m <= high)
    between = (after <= k) & (after * m < upto * k) & (F.col("_all") > 1)
    above = F.when(stands | between, dice_of(F.col("_hits") - hits, F.col("_all") - upto, F.col("_g")))
    below = F.when(stands, dice_of(hits - F.col("_i"), upto - F.col("_n"), F.col("_g")))
    gap = F.when(between, dice_of(hits, upto, F.col("_g")))
    return ranked.agg(F.coalesce(F.max(F.greatest(above, below, gap)), F.lit(0.0)).alias("best_dice"))


def separability_report(scores: DataFrame, bound: float, dice: str = "best_dice") -> DataFrame:
    """Mean and maximum over samples against the bound; no samples give zeros."""
    found = scores.agg(F.count(dice).alias("n_samples"), F.coalesce(F.avg(dice), F.lit(0.0)).alias("mean_dice"), F.coalesce(F.max(dice), F.lit(0.0)).alias("max_dice"))
    return found.withColumn("bound", F.lit(bound)).withColumn("separable", F.greatest("mean_dice", "max_dice") > bound)


def require_inseparable(scores: DataFrame, bound: float, dice: str = "best_dice") -> DataFrame:
    """Raise before any training when one intensity cut finds the synthetic anomalies."""
    found = separability_report(scores, bound, dice).first()
    if found["separable"]:
        raise ArtifactError(f"synthetic anomalies are separable by intensity: mean {found['mean_dice']:.3f}, maximum {found['max_dice']:.3f}, bound {bound:.3f}")
    return scores
