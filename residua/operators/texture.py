"""Texture features per slice.

First-order statistics are aggregates over voxel rows. Co-occurrence and gradients read neighbours
inside a slice row's array, so no voxel joins a voxel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import DataError

#: Row and column steps of the angles 0, 45, 90 and 135 degrees at distance 1.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1))
GLRLM = ("sre", "lre", "gln", "rln", "rp", "lgre", "hgre", "srlge", "srhge", "lrlge", "lrhge")


def first_order(voxels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Moments (population), extrema, percentiles (linear) and energy; skew and kurtosis of a constant are 0."""
    v = F.col(value)
    q = F.percentile(v, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    stats = voxels.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.coalesce(F.skewness(v), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(v), F.lit(0.0)).alias("kurtosis"), q.alias("_q"), F.avg(v * v).alias("energy"),
    )
    named = [F.col("_q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))]
    return stats.select(*keys, "mean", "std", "min", "max", (F.col("max") - F.col("min")).alias("range"), "skew", "kurtosis", *named, (F.col("_q")[3] - F.col("_q")[1]).alias("iqr"), "energy")


def histogram(voxels: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts of equal bins on [0, 1]; the last is closed, values outside are left out."""
    inside = voxels.filter((F.col(value) >= 0) & (F.col(value) <= 1))
    return inside.groupBy(*keys, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy(voxels: DataFrame, keys: Sequence[str], value: str, bins: int = 32) -> DataFrame:
    """Shannon entropy in bits of the histogram; 0 for a group without values inside [0, 1]."""
    inside = F.col(value).between(0, 1)
    binned = voxels.withColumn("bin", F.when(inside, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))))
    hist = binned.groupBy(*keys, "bin").agg(F.count("bin").alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return hist.withColumn("_p", p).groupBy(*keys).agg(F.coalesce(-F.sum(F.col("_p") * F.log2("_p")), F.lit(0.0)).alias("entropy"))


def runs(voxels: DataFrame, keys: Sequence[str], line: Column, along: str, level: str = "q") -> DataFrame:
    """Runs of equal levels along a line: gaps and islands."""
    rows = voxels.withColumn("_line", line)
    whole = F.row_number().over(Window.partitionBy(*keys, "_line").orderBy(along))
    own = F.row_number().over(Window.partitionBy(*keys, "_line", level).orderBy(along))
    return rows.withColumn("_island", whole - own).groupBy(*keys, "_line", level, "_island").agg(F.count(F.lit(1)).alias("length"))


def run_length_features(run_rows: DataFrame, keys: Sequence[str], level: str = "q") -> DataFrame:
    """The eleven descriptors per key; levels count from one."""
    matrix = run_rows.groupBy(*keys, (F.col(level) + 1).cast("double").alias("g"), F.col("length").cast("double").alias("r")).agg(F.count(F.lit(1)).alias("c"))
    by_g = F.sum("c").over(Window.partitionBy(*keys, "g"))
    by_r = F.sum("c").over(Window.partitionBy(*keys, "r"))
    m = matrix.withColumn("_cg", by_g).withColumn("_cr", by_r)
    g, r, c = F.col("g"), F.col("r"), F.col("c")
    n = F.sum("c")
    # Sum over cells of c * (row total) is the sum of squared row totals.
    return m.groupBy(*keys).agg(
        (F.sum(c / (r * r)) / n).alias("sre"), (F.sum(c * r * r) / n).alias("lre"), (F.sum(c * F.col("_cg")) / n).alias("gln"), (F.sum(c * F.col("_cr")) / n).alias("rln"),
        (n / F.sum(c * r)).alias("rp"), (F.sum(c / (g * g)) / n).alias("lgre"), (F.sum(c * g * g) / n).alias("hgre"),
        (F.sum(c / (g * g * r * r)) / n).alias("srlge"), (F.sum(c * g * g / (r * r)) / n).alias("srhge"), (F.sum(c * r * r / (g * g)) / n).alias("lrlge"), (F.sum(c * g * g * r * r) / n).alias("lrhge"),
    )


def glrlm(voxels: DataFrame, keys: Sequence[str], level: str = "q", directions: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Descriptors averaged over directions: rows, columns and both diagonals."""
    lines = {0: (F.col("y"), "x"), 1: (F.col("x") + F.col("y"), "y"), 2: (F.col("x"), "y"), 3: (F.col("x") - F.col("y"), "y")}
    parts = [run_length_features(runs(voxels, keys, *lines[d], level), keys, level) for d in directions]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in GLRLM)) if len(parts) > 1 else union


def line_order(direction: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Voxels of a slice in order of the lines of a direction, and which of them begin a line.

    Diagonals wrap round the slice's sides, so all lines are equally long; where one wraps, another begins.
    """
    place = np.arange(width * height)
    if direction == 0:
        return place, place % width == 0
    line, at = np.divmod(place, height)
    if direction == 2:
        return at * width + line, at == 0
    x = (line + at if direction == 3 else line - at) % width
    return at * width + x, (at == 0) | (x == (0 if direction == 3 else width - 1))


def run_descriptors(levels: np.ndarray, width: int, height: int, direction: int) -> np.ndarray:
    """The eleven descriptors, a row per slice, of slices (n, height * width) of levels: all slices' runs at once."""
    order, begins = line_order(direction, width, height)
    lines = levels[:, order]
    heads = np.concatenate([np.ones((len(lines), 1), bool), lines[:, 1:] != lines[:, :-1]], axis=1) | begins
    at = np.flatnonzero(heads)
    owner, size = at // lines.shape[1], len(lines)
    r, g = np.diff(at, append=lines.size).astype(float), lines.ravel()[at] + 1.0
    total = lambda weights: np.bincount(owner, weights, size)

    def squared_counts(values: np.ndarray) -> np.ndarray:
        top = int(values.max()) + 1
        keys, counts = np.unique(owner * top + values.astype(np.int64), return_counts=True)
        return np.bincount(keys // top, counts.astype(float) ** 2, size)

    n, r2, g2 = np.bincount(owner, minlength=size).astype(float), r * r, g * g
    found = {
        "sre": total(1 / r2), "lre": total(r2), "gln": squared_counts(g), "rln": squared_counts(r), "rp": n * n / total(r), "lgre": total(1 / g2), "hgre": total(g2),
        "srlge": total(1 / (g2 * r2)), "srhge": total(g2 / r2), "lrlge": total(r2 / g2), "lrhge": total(g2 * r2),
    }
    return np.stack([found[name] / n for name in GLRLM], axis=1)


def glrlm_slices(slices: DataFrame, keys: Sequence[str], width: int, height: int, level: str = "q", directions: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """glrlm of slice rows, whose `level` array holds all voxels by row: no voxel rows, no windows and no shuffle.

    The runs of a batch of slices are found together, as places where a level differs from the one
    before it in a line. A slice of another size raises.
    """
    kinds = [slices.schema[k].dataType.simpleString() for k in keys]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keys))
            if (np.diff(held.offsets.to_numpy()) != width * height).any() or held.null_count:
                raise DataError(f"a slice has no {height} by {width} levels")
            levels = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, width * height)
            found = np.mean([run_descriptors(levels, width, height, d) for d in directions], axis=0) if len(levels) else np.zeros((0, len(GLRLM)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c) for c in found.T)], [*keys, *GLRLM])

    schema = ", ".join([*(f"{k} {kind}" for k, kind in zip(keys, kinds, strict=True)), *(f"{n} double" for n in GLRLM)])
    return slices.select(*keys, level).mapInArrow(features, schema)


def cooccurrence(slices: DataFrame, keys: Sequence[str], levels: int, width: int, height: int, quantized: str = "q", steps: Sequence[tuple[int, int]] = STEPS) -> DataFrame:
    """Symmetric counts (direction, i, j, c) per slice row; neighbours come from the same array."""
    def codes_of(d: int, dy: int, dx: int) -> Column:
        """level * levels + neighbour's level, null where the neighbour lies outside."""

        def code(v: Column, p: Column) -> Column:
            inside = (F.floor(p / width) + dy).between(0, height - 1) & (F.pmod(p, F.lit(width)) + dx).between(0, width - 1)
            return F.when(inside, F.lit(d * levels * levels) + v * levels + F.get(F.col(quantized), p + (dy * width + dx)))

        return F.transform(quantized, code)

    parts = [codes_of(d, sign * dy, sign * dx) for d, (dy, dx) in enumerate(steps) for sign in (1, -1)]
    codes = slices.select(*keys, F.explode(F.flatten(F.array(*parts))).alias("_code")).filter("_code is not null")
    counted = codes.groupBy(*keys, "_code").agg(F.count(F.lit(1)).alias("c"))
    within = F.pmod("_code", F.lit(levels * levels))
    return counted.select(*keys, F.floor(F.col("_code") / (levels * levels)).cast("bigint").alias("direction"), F.floor(within / levels).cast("double").alias("i"), F.pmod(within, F.lit(levels)).cast("double").alias("j"), "c")


def cooccurrence_props(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """contrast, dissimilarity, homogeneity, energy, asm and correlation per direction; correlation of a constant is 0."""
    full = [*keys, "direction"]
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*full))
    m = counts.withColumn("p", p)
    i, j, p = F.col("i"), F.col("j"), F.col("p")
    sums = m.groupBy(*full).agg(
        F.sum(p * (i - j) * (i - j)).alias("contrast"), F.sum(p * F.abs(i - j)).alias("dissimilarity"), F.sum(p / (1 + (i - j) * (i - j))).alias("homogeneity"),
        F.sum(p * p).alias("asm"), F.sum(p * i).alias("_mi"), F.sum(p * j).alias("_mj"), F.sum(p * i * i).alias("_ii"), F.sum(p * j * j).alias("_jj"), F.sum(p * i * j).alias("_ij"),
    )
    variance = F.round((F.col("_ii") - F.col("_mi") * F.col("_mi")) * (F.col("_jj") - F.col("_mj") * F.col("_mj")), 12)
    correlation = F.when(variance > 0, (F.col("_ij") - F.col("_mi") * F.col("_mj")) / F.sqrt(variance)).otherwise(0.0)
    return sums.select(*full, "contrast", "dissimilarity", "homogeneity", F.sqrt("asm").alias("energy"), "asm", correlation.alias("correlation"))


def cooccurrence_features(props: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each property over directions."""
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "correlation")
    return props.groupBy(*keys).agg(*(x for n in names for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std"))))


def gradient_interior(slices: DataFrame, keys: Sequence[str], width: int, height: int, pixels: str = "pixels") -> DataFrame:
    """Sobel magnitudes (g) of interior pixels, sqrt((h^2 + v^2) / 2), from neighbours in the same array."""
    a = lambda p: F.get(F.col(pixels), p)

    def magnitude(p: Column) -> Column:
        row = lambda o: a(p + o - 1) + 2 * a(p + o) + a(p + o + 1)
        col = lambda o: a(p + o - width) + 2 * a(p + o) + a(p + o + width)
        h, v = (row(-width) - row(width)) / 4, (col(-1) - col(1)) / 4
        return F.sqrt((h * h + v * v) / 2)

    inner = F.array(*(F.lit(y * width + x) for y in range(1, height - 1) for x in range(1, width - 1))) if width * height <= 4096 else F.filter(
        F.sequence(F.lit(0), F.lit(width * height - 1)), lambda p: F.floor(p / width).between(1, height - 2) & F.pmod(p, F.lit(width)).between(1, width - 2)
    )
    return slices.select(*keys, F.explode(F.transform(inner, magnitude)).alias("g"))


def gradient_features(magnitudes: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = F.col("g")
    return magnitudes.groupBy(*keys).agg(F.avg(g).alias("gradient_mean"), F.stddev_pop(g).alias("gradient_std"), F.max(g).alias("gradient_max"), F.percentile(g, 0.9).alias("gradient_p90"), F.avg(g * g).alias("gradient_energy"))


def sobel(image: np.ndarray) -> np.ndarray:
    """Sobel magnitude with reflected edges."""
    p = np.pad(image, 1, mode="symmetric")
    smooth = lambda m: m[:-2] + 2 * m[1:-1] + m[2:]
    h = (smooth(p[:-2].T) - smooth(p[2:].T)).T / 4
    v = (smooth(p[:, :-2]) - smooth(p[:, 2:])) / 4
    return np.sqrt((h**2 + v**2) / 2)


def sobel_full(slices: DataFrame, key: str, height: int, width: int, pixels: str = "pixels") -> DataFrame:
    """The five gradient features with edges, per slice row; no shuffle."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image in batch[pixels]:
                g = sobel(np.asarray(image, float).reshape(height, width))
                rows.append((g.mean(), g.std(), g.max(), np.percentile(g, 90), (g**2).mean()))
            out = pd.DataFrame(rows, columns=["gradient_mean", "gradient_std", "gradient_max", "gradient_p90", "gradient_energy"])
            out.insert(0, "slice_index", batch["slice_index"].array)
            out.insert(0, key, batch[key].array)
            yield out

    kind = slices.schema[key].dataType.simpleString()
    doubles = ", ".join(f"gradient_{n} double" for n in ("mean", "std", "max", "p90", "energy"))
    return slices.select(key, F.col("slice_index").cast("bigint").alias("slice_index"), pixels).mapInPandas(features, f"{key} {kind}, slice_index bigint, {doubles}")


def sanitize(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite and missing values become 0; n_sanitized tells how many a row had."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    counted = values.withColumn("n_sanitized", sum((bad(c).cast("bigint") for c in columns), F.lit(0).cast("bigint")))
    return counted.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in columns})
