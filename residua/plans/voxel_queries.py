"""Queries over the voxel stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bind, gray_byte, overlay, quantize, r6
from ..operators import depth, metrics, preprocess, reconstruct, runs, slices, synth, texture, thresholds, validate
from . import frames
from .frames import MASK_CUT, VOX_SQL

PERCENTILES, ABSOLUTES = (80.0, 90.0, 95.0, 97.5, 99.0), (0.1, 0.15, 0.2, 0.25)
SLICE_GRID = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
KEYS = ["subject", "slice_index"]
BOXES = ((0, 0, 4, 1, 5, 1, 5, 0.5), (1, 2, 6, 3, 7, 2, 6, 0.8), (2, 3, 8, 0, 4, 4, 8, 0.8))


def test_voxels(spark: SparkSession, d: str) -> DataFrame:
    return frames.full(spark, d).filter("subject >= 7")


def masked(f: DataFrame):
    return thresholds.absolute_mask(F.col("residual"), MASK_CUT), F.col("gt") > 0


def overlap(spark, d):
    f = test_voxels(spark, d)
    return metrics.overlap(f, ["subject"], *masked(f))


def residual(spark, d):
    return test_voxels(spark, d).select("subject", "slice_index", "pos", r6(F.col("residual")).alias("residual"))


def dice(spark, d):
    return overlap(spark, d).select("subject", r6(F.col("dice")).alias("dice"))


def iou(spark, d):
    return overlap(spark, d).select("subject", r6(F.col("iou")).alias("iou"))


def psnr(spark, d):
    return metrics.psnr(test_voxels(spark, d), ["subject"], "v", "recon").select("subject", r6(F.col("psnr_db")).alias("psnr_db"))


def aggregate_metrics(spark, d):
    found = metrics.aggregate_metrics(overlap(spark, d), ["dice", "iou"])
    return found.select("n", *(r6(F.col(c)).alias(c) for c in found.columns[1:]))


def bugcompat(spark, d):
    f = test_voxels(spark, d)
    return metrics.overlap_bugcompat(f, ["subject"], masked(f)[0], F.col("seg"))


def dice_bugcompat(spark, d):
    return bugcompat(spark, d).select("subject", r6(F.col("dice")).alias("dice"))


def iou_bugcompat(spark, d):
    return bugcompat(spark, d).select("subject", r6(F.col("iou")).alias("iou"))


def legacy_last_only(spark, d):
    found = metrics.legacy_last_only(overlap(spark, d), "subject")
    return found.select("last_subject", r6(F.col("reported")).alias("reported"), r6(F.col("true_mean")).alias("true_mean"))


def binarize(spark, d):
    f = frames.full(spark, d)
    return f.groupBy("seg", preprocess.binarize(F.col("seg")).cast("bigint").alias("binary")).agg(F.count(F.lit(1)).alias("n"))


def minmax_volume(spark, d):
    return preprocess.minmax_volume(frames.vox(spark, d)).select(*KEYS, "pos", r6(F.col("scaled")).alias("scaled"))


def crop_box(spark, d):
    return preprocess.crop_box(frames.vox(spark, d), {"y": (2, 6), "x": (1, 7)}).select(*KEYS, "y", "x", r6(F.col("v")).alias("v"))


def resize_bilinear(spark, d):
    v = frames.vox(spark, d)
    parts = [preprocess.resize_bilinear(v, KEYS, 8, out).withColumn("size", F.lit(out).cast("bigint")) for out in (4, 16)]
    return parts[0].unionByName(parts[1]).select("size", *KEYS, "y", "x", r6(F.col("v")).alias("v"))


def resize_nearest(spark, d):
    v = frames.vox(spark, d)
    parts = [preprocess.resize_nearest(v, 8, out).withColumn("size", F.lit(out).cast("bigint")) for out in (4, 16)]
    return parts[0].unionByName(parts[1]).select("size", *KEYS, F.col("y").cast("bigint"), F.col("x").cast("bigint"), r6(F.col("v")).alias("v"))


def pad_depth(spark, d):
    padded = preprocess.pad_depth(frames.slices(spark, d).select(*KEYS))
    return padded.groupBy("subject").agg(F.count(F.lit(1)).alias("depth"), F.count_if("padded").alias("n_padded"))


def chunk_index(spark, d):
    chunk, z = preprocess.chunk_columns(F.col("slice_index"))
    return frames.slices(spark, d).select(*KEYS, chunk.alias("chunk_index"), z.alias("z"))


def chunk_offsets(spark, d):
    return preprocess.chunk_offsets(frames.slices(spark, d))


def locate_chunk(spark, d):
    return preprocess.locate_chunk(chunk_offsets(spark, d), 3).select("subject", F.col("chunk_index").cast("bigint").alias("chunk_index"))


def quantize_levels(spark, d):
    return preprocess.quantize_levels(frames.vox(spark, d), KEYS, 16).select(*KEYS, "pos", "q")


def normalize_slice(spark, d):
    return preprocess.normalize_slices(frames.vox(spark, d), KEYS).select(*KEYS, "pos", r6(F.col("normed")).alias("normed"))


def overlay_blend(spark, d):
    normed = preprocess.normalize_slices(test_voxels(spark, d), KEYS)
    base = gray_byte(F.round("normed", 9))
    return normed.select(*KEYS, "pos", base.alias("gray"), overlay(base, F.col("gt") > 0).alias("blended"))


def validate_range(spark, d):
    found = validate.range_counts(frames.vox(spark, d), "v")
    return found.select("n", "n_below", "n_above", "n_nan", r6(F.col("observed_min")).alias("observed_min"), r6(F.col("observed_max")).alias("observed_max"))


def non_binary_count(spark, d):
    return validate.non_binary_count(frames.full(spark, d), F.col("seg"))


def foreground_slices(spark, d):
    return slices.foreground_slices(frames.vox(spark, d), KEYS, F.col("v") > 0.05).withColumn("foreground_fraction", r6(F.col("foreground_fraction")))


def slice_label(spark, d):
    return slices.slice_label(frames.full(spark, d), KEYS, F.col("gt") > 0)


def slice_counters(spark, d):
    return slices.slice_counters(frames.vox(spark, d), "subject", "slice_index", F.col("v") > 0.05)


def scored_slices(f: DataFrame) -> DataFrame:
    flagged, truth = masked(f)
    return slices.slice_scores(f, KEYS, flagged, F.col("v") > 0.05, truth, min_voxels=5)


def slice_scores(spark, d):
    found = scored_slices(frames.full(spark, d))
    return found.withColumns({c: r6(F.col(c)) for c in ("flagged_fraction", "foreground_fraction")})


def checksums(marked: DataFrame) -> DataFrame:
    return marked.groupBy("subject").agg(F.count_if("flagged").alias("n_flagged"), F.coalesce(F.sum(F.when(F.col("flagged"), F.col("flat"))), F.lit(0)).alias("flat_sum"))


def threshold_absolute(spark, d):
    f = test_voxels(spark, d)
    return checksums(f.withColumn("flagged", masked(f)[0]))


def threshold_percentile(spark, d):
    return checksums(thresholds.percentile_mask(test_voxels(spark, d), "subject", "flat", 95.0))


def threshold_otsu(spark, d):
    return checksums(thresholds.otsu_mask(test_voxels(spark, d), "subject"))


def sweep(spark, d):
    return thresholds.threshold_sweep(frames.full(spark, d).filter("subject in (5, 6)"), "subject", "flat", PERCENTILES, ABSOLUTES)


def threshold_sweep(spark, d):
    return sweep(spark, d).select("strategy", "value", r6(F.col("dice_mean")).alias("dice_mean"), r6(F.col("dice_std")).alias("dice_std"), "n_volumes")


def tnoise_sweep(spark, d):
    """The sweep at three noise levels, which here stretch the residual."""
    noisy = frames.full(spark, d).filter("subject in (5, 6)").withColumn("t_noise", F.explode(F.array(*(F.lit(t).cast("bigint") for t in range(3)))))
    noisy = noisy.withColumn("residual", F.col("residual") * (1 + 0.1 * F.col("t_noise")))
    found = thresholds.threshold_sweep(noisy, "subject", "flat", PERCENTILES, ABSOLUTES, by=["t_noise"])
    return found.select("t_noise", "strategy", "value", r6(F.col("dice_mean")).alias("dice_mean"), r6(F.col("dice_std")).alias("dice_std"), "n_volumes")


def select_operating_point(spark, d):
    return thresholds.select_operating_point(sweep(spark, d)).select("strategy", "value", r6(F.col("dice_mean")).alias("dice_mean"))


def slice_threshold_tuning(spark, d):
    scores = scored_slices(frames.full(spark, d).filter("subject = 6"))
    found = slices.tune_slice_threshold(scores, SLICE_GRID)
    return found.select("threshold", "tp", "fp", "fn", "tn", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


def first_order(spark, d):
    found = texture.first_order(frames.vox(spark, d), KEYS)
    return found.select(*KEYS, *(r6(F.col(c)).alias(c) for c in found.columns[2:]))


def unit_voxels(spark, d):
    return preprocess.minmax_volume(frames.vox(spark, d)).withColumn("scaled", F.round("scaled", 9))


def entropy32(spark, d):
    return texture.entropy(unit_voxels(spark, d), KEYS, "scaled", 32).withColumn("entropy", r6(F.col("entropy")))


def hist20(spark, d):
    return texture.histogram(unit_voxels(spark, d), ["subject"], "scaled", 20)


def glrlm_row(spark, d):
    found = texture.glrlm_slices(level_rows(spark, d), KEYS, 8, 8, directions=(0,))
    return found.select(*KEYS, *(r6(F.col(c)).alias(c) for c in texture.GLRLM))


def glrlm_all(spark, d):
    found = texture.glrlm_slices(level_rows(spark, d), KEYS, 8, 8)
    return found.select(*KEYS, *(r6(F.col(c)).alias(c) for c in texture.GLRLM))


def level_rows(spark, d):
    extrema = F.struct(F.array_min("pixels").alias("lo"), F.array_max("pixels").alias("hi"))
    levels = bind(extrema, lambda e: F.transform("pixels", lambda v: quantize(v, e.lo, e.hi, 8).cast("int")))
    return frames.slices(spark, d).withColumn("q", levels)


def props(spark, d):
    return texture.cooccurrence_props(texture.cooccurrence(level_rows(spark, d), KEYS, 8, 8, 8), KEYS)


def glcm_contrast(spark, d):
    return props(spark, d).filter("direction = 0").select(*KEYS, r6(F.col("contrast")).alias("contrast"))


def glcm_props(spark, d):
    found = texture.cooccurrence_features(props(spark, d), KEYS)
    return found.select(*KEYS, *(r6(F.col(c)).alias(c) for c in found.columns[2:]))


def gradient_energy(spark, d):
    found = texture.gradient_features(texture.gradient_interior(frames.slices(spark, d), KEYS, 8, 8), KEYS)
    return found.select(*KEYS, *(r6(F.col(c)).alias(c) for c in found.columns[2:]))


def sanitize_counts(spark, d):
    per = frames.full(spark, d).groupBy(*KEYS).agg(F.try_divide(F.sum("v"), F.count_if(F.col("seg") == 4)).alias("a"), F.try_divide(F.sum("residual"), F.count_if(F.col("gt") > 0)).alias("b"))
    found = texture.sanitize(per, ["a", "b"])
    return found.select(*KEYS, r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), "n_sanitized")


def feature_rank(spark, d):
    from ..operators import ranks

    gains = frames.vox(spark, d).groupBy("pos").agg(F.round(F.var_pop("v"), 9).alias("gain"))
    return ranks.feature_rank(gains, "pos", "gain").select("pos", r6(F.col("gain")).alias("gain"), F.col("rank").cast("bigint").alias("rank"))


def donor_bijection(spark, d):
    return synth.donors(frames.table(spark, d, "embeddings").select("vec_id"), "vec_id")


def box_blend(spark, d):
    f = test_voxels(spark, d)
    blended = synth.box_blend(f, BOXES, "v", "recon")
    return blended.select(*KEYS, "pos", "mask", r6(F.col("blended")).alias("blended"))


def intensity_separability(spark, d):
    return synth.intensity_separability(test_voxels(spark, d), F.col("gt") > 0, "v", 0.0, 32).select(r6(F.col("best_dice")).alias("best_dice"))


def largest_area(spark, d):
    areas = frames.full(spark, d).groupBy("subject").agg(F.sum("gt").alias("area"))
    return depth.largest_area(areas, "subject", "area")


def depth_nonzero(spark, d):
    return depth.nonzero_depths(frames.vox(spark, d), "subject", "v", 0.3)


def depth_gt_window(spark, d):
    return depth.truth_window(frames.full(spark, d), "subject", F.col("gt") > 0, 16)


def stride_subsample(spark, d):
    return depth.stride_subsample(frames.slices(spark, d).select(*KEYS), "subject", 10)


def total_variation(spark, d):
    from pyspark.sql import Window

    v = frames.vox(spark, d)
    right = F.lead("v").over(Window.partitionBy(*KEYS, "y").orderBy("x"))
    down = F.lead("v").over(Window.partitionBy(*KEYS, "x").orderBy("y"))
    steps = v.withColumn("r", F.abs(right - F.col("v"))).withColumn("b", F.abs(down - F.col("v")))
    return steps.groupBy("subject").agg(r6(F.avg("r") + F.avg("b")).alias("total_variation"))


def multiscale_mse(spark, d):
    found = metrics.multiscale_mse(test_voxels(spark, d), "subject", KEYS, "v", "recon")
    return found.withColumn("multiscale_mse", r6(F.col("multiscale_mse")))


def l2_delta(spark, d):
    return runs.l2_delta(test_voxels(spark, d), ["subject"], "v", "recon").withColumn("l2_delta", r6(F.col("l2_delta")))


def ssim(spark, d):
    means = frames.healthy_means(spark, d)
    recon = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "recon"))), lambda x: x["recon"]).alias("reconstruction"))  # the positions of one slice
    rows = frames.slices(spark, d).filter("subject >= 7").withColumnRenamed("pixels", "original").crossJoin(F.broadcast(recon))
    return metrics.ssim(rows, "subject", 8, 8, window=7)


def sobel_full(spark, d):
    return texture.sobel_full(frames.slices(spark, d), "subject", 8, 8)


def pca_reconstruction(spark, d):
    rows = frames.slices(spark, d)
    mean, components = reconstruct.pca_components(rows.filter("subject <= 6"), 8)
    out = reconstruct.pca_reconstruct(rows.filter("subject >= 7"), KEYS, mean, components)
    error = F.aggregate(F.zip_with("pixels", "reconstruction", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / 64
    return out.select(*KEYS, error.alias("mse"))


def synthetic_boxes(spark, d):
    rows = frames.slices(spark, d).filter("subject <= 6").select(F.col("vec_id"), "subject", F.transform("pixels", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("healthy"))  # volumes lie in [0, 1]
    flat = rows.withColumn("donor", F.reverse("healthy"))
    return synth.synthetic_boxes(flat, "vec_id", (1, 8, 8), depths=(1, 1))


def patch_blend(spark, d):
    """A patch per part, blended into the test subjects by grid cells."""
    part = frames.table(spark, d, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    low = {"z": k % 47, "y": k % 7, "x": n % 7}
    high = {"z": low["z"] + 1 + n % 3, "y": F.least(F.lit(8), low["y"] + 1 + n % 4), "x": F.least(F.lit(8), low["x"] + 1 + k % 5)}
    edges = [c.cast("bigint").alias(f"{a}{i}") for a in "zyx" for i, c in enumerate((low[a], high[a]))]
    patches = part.select((7 + k % 3).alias("subject"), k.alias("no"), *edges, ((k % 90 + 1) / 100).alias("alpha"))
    found = synth.blend_by_table(test_voxels(spark, d), patches, "subject", donor="recon")
    return found.select("subject", "slice_index", "pos", "mask", "patch_no", r6(F.col("blended")).alias("blended"))


def ssim_mse(spark, d):
    """Weighted loss of SSIM and MSE of each test slice and its reconstruction."""
    means = frames.healthy_means(spark, d)
    recon = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "recon"))), lambda x: x["recon"]).alias("reconstruction"))  # the positions of one slice
    rows = frames.slices(spark, d).filter("subject >= 7").withColumnRenamed("pixels", "original").crossJoin(F.broadcast(recon))
    return metrics.ssim_mse_by_slice(rows, KEYS, 8, 8, window=7)


_OVERLAP_SQL = VOX_SQL + """, o AS (
  SELECT subject, sum(CASE WHEN residual > 0.15 AND gt = 1 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN residual > 0.15 THEN 1 ELSE 0 END) AS p, sum(gt) AS g FROM f WHERE subject >= 7 GROUP BY subject
), m AS (
  SELECT subject, CASE WHEN p + g = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * i / (p + g + 1e-6::DOUBLE) END AS dice,
         CASE WHEN p + g - i = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / (p + g - i + 1e-6::DOUBLE) END AS iou FROM o
)
"""
_BUG_SQL = VOX_SQL + """, o AS (
  SELECT subject, sum(CASE WHEN residual > 0.15 THEN seg ELSE 0 END)::DOUBLE AS i, sum(CASE WHEN residual > 0.15 THEN 1 ELSE 0 END)::DOUBLE AS p, sum(seg)::DOUBLE AS g FROM f WHERE subject >= 7 GROUP BY subject
)
"""
_FLAG_SQL = "count(*) FILTER (WHERE flagged) AS n_flagged, coalesce(sum(CASE WHEN flagged THEN flat END), 0)::BIGINT AS flat_sum"
_SWEEP_SQL = VOX_SQL + """, r AS (
  SELECT subject, gt, residual, row_number() OVER (PARTITION BY subject ORDER BY residual DESC, flat) AS rk, count(*) OVER (PARTITION BY subject) AS n FROM f WHERE subject IN (5, 6)
), grid AS (
  SELECT * FROM (VALUES ('percentile', 80.0::DOUBLE), ('percentile', 90.0), ('percentile', 95.0), ('percentile', 97.5), ('percentile', 99.0), ('absolute', 0.1), ('absolute', 0.15), ('absolute', 0.2), ('absolute', 0.25)) AS t(strategy, value)
), s AS (
  SELECT subject, strategy, value, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE hit AND gt = 1) AS i, sum(gt) AS g
  FROM (SELECT *, CASE WHEN strategy = 'percentile' THEN rk <= round_even(n * (100.0 - value) / 100.0, 0) ELSE residual > value END AS hit FROM r, grid) AS x GROUP BY 1, 2, 3
), swept AS (
  SELECT strategy, value, avg(d) AS dice_mean, stddev_pop(d) AS dice_std, count(*) AS n_volumes
  FROM (SELECT strategy, value, CASE WHEN p + g = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * i / (p + g + 1e-6::DOUBLE) END AS d FROM s) AS x GROUP BY 1, 2
)
"""
_NOISE_SQL = VOX_SQL + """, x AS (
  SELECT t_noise, subject, gt, flat, residual * (1 + 0.1::DOUBLE * t_noise) AS residual FROM f, (VALUES (0::BIGINT), (1), (2)) AS t(t_noise) WHERE subject IN (5, 6)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY t_noise, subject ORDER BY residual DESC, flat) AS rk, count(*) OVER (PARTITION BY t_noise, subject) AS n FROM x
), grid AS (
  SELECT * FROM (VALUES ('percentile', 80.0::DOUBLE), ('percentile', 90.0), ('percentile', 95.0), ('percentile', 97.5), ('percentile', 99.0), ('absolute', 0.1), ('absolute', 0.15), ('absolute', 0.2), ('absolute', 0.25)) AS t(strategy, value)
), s AS (
  SELECT t_noise, subject, strategy, value, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE hit AND gt = 1) AS i, sum(gt) AS g
  FROM (SELECT *, CASE WHEN strategy = 'percentile' THEN rk <= round_even(n * (100.0 - value) / 100.0, 0) ELSE residual > value END AS hit FROM r, grid) AS y GROUP BY 1, 2, 3, 4
)
SELECT t_noise, strategy, value, round(avg(d), 6) AS dice_mean, round(stddev_pop(d), 6) + 0.0 AS dice_std, count(*) AS n_volumes
FROM (SELECT t_noise, strategy, value, CASE WHEN p + g = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * i / (p + g + 1e-6::DOUBLE) END AS d FROM s) AS z GROUP BY 1, 2, 3
"""
_SCORES_SQL = """, ss AS (
  SELECT subject, slice_index, count(*) FILTER (WHERE residual > 0.15) AS flagged_voxels, count(*) AS n_voxels, count(*) FILTER (WHERE residual > 0.15)::DOUBLE / count(*) AS flagged_fraction,
         count(*) FILTER (WHERE v > 0.05)::DOUBLE / count(*) AS foreground_fraction, CASE WHEN sum(gt) >= 5 THEN 1 ELSE 0 END AS label
  FROM f GROUP BY 1, 2 HAVING count(*) FILTER (WHERE v > 0.05)::DOUBLE / count(*) > 1e-8
)
"""
_UNIT_SQL = VOX_SQL + ", ext AS (SELECT subject AS s0, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1), u AS (SELECT vox.*, round((v - lo) / (hi - lo + 1e-8::DOUBLE), 9) AS scaled FROM vox JOIN ext ON subject = s0)\n"
_SLICE_EXT = ", ext AS (SELECT subject AS s0, slice_index AS i0, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1, 2)"


def _quant_sql(levels: int) -> str:
    return VOX_SQL + _SLICE_EXT + f", q AS (SELECT subject, slice_index, pos, y, x, CASE WHEN hi > lo THEN round_even((v - lo) / (hi - lo) * {levels - 1}, 0) ELSE 0 END::BIGINT AS q FROM vox JOIN ext ON subject = s0 AND slice_index = i0)\n"


def _glrlm_sql(directions: tuple[int, ...]) -> str:
    lines = {0: ("y", "x"), 1: ("x + y", "y"), 2: ("x", "y"), 3: ("x - y", "y")}
    lined = " UNION ALL ".join(f"SELECT subject, slice_index, {d} AS dir, {lines[d][0]} AS line, {lines[d][1]} AS along, q FROM q" for d in directions)
    names = ", ".join(f"round(avg({n}), 6) AS {n}" for n in texture.GLRLM)
    return _quant_sql(8) + f""", l AS ({lined}),
isl AS (SELECT *, row_number() OVER (PARTITION BY subject, slice_index, dir, line ORDER BY along) - row_number() OVER (PARTITION BY subject, slice_index, dir, line, q ORDER BY along) AS island FROM l),
rl AS (SELECT subject, slice_index, dir, (q + 1)::DOUBLE AS g, count(*)::DOUBLE AS r FROM isl GROUP BY subject, slice_index, dir, line, q, island),
gl AS (SELECT subject, slice_index, dir, sum(c * c) AS gg FROM (SELECT subject, slice_index, dir, g, count(*)::DOUBLE AS c FROM rl GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2, 3),
rr AS (SELECT subject, slice_index, dir, sum(c * c) AS rrs FROM (SELECT subject, slice_index, dir, r, count(*)::DOUBLE AS c FROM rl GROUP BY 1, 2, 3, 4) AS x GROUP BY 1, 2, 3),
e AS (SELECT subject, slice_index, dir, avg(1 / (r * r)) AS sre, avg(r * r) AS lre, count(*) / sum(r) AS rp, count(*)::DOUBLE AS n, avg(1 / (g * g)) AS lgre, avg(g * g) AS hgre,
             avg(1 / (g * g * r * r)) AS srlge, avg(g * g / (r * r)) AS srhge, avg(r * r / (g * g)) AS lrlge, avg(g * g * r * r) AS lrhge FROM rl GROUP BY 1, 2, 3),
all_dirs AS (SELECT e.*, gg / n AS gln, rrs / n AS rln FROM e JOIN gl USING (subject, slice_index, dir) JOIN rr USING (subject, slice_index, dir))
SELECT subject, slice_index, {names} FROM all_dirs GROUP BY 1, 2"""


_GLCM_SQL = _quant_sql(8) + """, steps AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) AS t(dir, dy, dx)),
pairs AS (SELECT a.subject, a.slice_index, dir, a.q::DOUBLE AS i, b.q::DOUBLE AS j FROM q AS a, steps, q AS b WHERE a.subject = b.subject AND a.slice_index = b.slice_index AND b.y = a.y + dy AND b.x = a.x + dx),
both_ways AS (SELECT * FROM pairs UNION ALL SELECT subject, slice_index, dir, j AS i, i AS j FROM pairs),
p AS (SELECT subject, slice_index, dir, i, j, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY subject, slice_index, dir) AS p FROM both_ways GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT subject, slice_index, dir, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm,
             sum(p * i) AS mi, sum(p * j) AS mj, sum(p * i * i) AS ii, sum(p * j * j) AS jj, sum(p * i * j) AS ij FROM p GROUP BY 1, 2, 3),
props AS (SELECT *, sqrt(asm) AS energy, CASE WHEN round((ii - mi * mi) * (jj - mj * mj), 12) > 0 THEN (ij - mi * mj) / sqrt((ii - mi * mi) * (jj - mj * mj)) ELSE 0 END AS correlation FROM s)
"""


def _boxes_sql() -> str:
    hits = " UNION ALL ".join(f"SELECT {no} AS no, {z0} AS z0, {z1} AS z1, {y0} AS y0, {y1} AS y1, {x0} AS x0, {x1} AS x1, {a}::DOUBLE AS alpha" for no, z0, z1, y0, y1, x0, x1, a in BOXES)
    return VOX_SQL + f""", boxes AS ({hits})
SELECT subject, slice_index, pos, coalesce(max(alpha), 0)::DOUBLE AS mask, round(CASE WHEN max(alpha) IS NULL THEN any_value(v) ELSE (1 - max(alpha)) * any_value(v) + max(alpha) * any_value(recon) END, 6) + 0.0 AS blended
FROM f LEFT JOIN boxes ON slice_index >= z0 AND slice_index < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 WHERE subject >= 7 GROUP BY 1, 2, 3"""


def _bilinear_sql() -> str:
    weight = "CASE WHEN ay = floor(sy) AND ay = least(floor(sy) + 1, 7) THEN 1 WHEN ay = floor(sy) THEN 1 - (sy - floor(sy)) WHEN ay = floor(sy) + 1 THEN sy - floor(sy) ELSE 0 END"
    return VOX_SQL + f""", o AS (SELECT size, o, greatest((o + 0.5::DOUBLE) * 8 / size - 0.5::DOUBLE, 0) AS sy FROM (SELECT 4 AS size, unnest(range(4)) AS o UNION ALL SELECT 16 AS size, unnest(range(16)) AS o) AS z),
w AS (SELECT size, o, ay, {weight} AS wt FROM o, (SELECT unnest(range(8)) AS ay) AS a)
SELECT a.size::BIGINT AS size, subject, slice_index, a.o AS y, b.o AS x, round(sum(v * a.wt * b.wt), 6) + 0.0 AS v FROM vox, w AS a, w AS b
WHERE a.size = b.size AND a.ay = vox.y AND b.ay = vox.x AND a.wt > 0 AND b.wt > 0 GROUP BY 1, 2, 3, 4, 5"""


def _multiscale_sql() -> str:
    return VOX_SQL + """, t AS (SELECT * FROM f WHERE subject >= 7),
h AS (SELECT subject, slice_index, avg(v) AS v, avg(recon) AS recon FROM t GROUP BY subject, slice_index, y // 2, x // 2),
k AS (SELECT subject, slice_index, avg(v) AS v, avg(recon) AS recon FROM t WHERE y % 4 IN (1, 2) AND x % 4 IN (1, 2) GROUP BY subject, slice_index, y // 4, x // 4),
e AS (SELECT subject, avg((v - recon) * (v - recon)) AS e FROM t GROUP BY 1 UNION ALL SELECT subject, avg((v - recon) * (v - recon)) AS e FROM h GROUP BY 1 UNION ALL SELECT subject, avg((v - recon) * (v - recon)) AS e FROM k GROUP BY 1)
SELECT subject, round(avg(e), 6) AS multiscale_mse FROM e GROUP BY 1"""


_FIRST_SQL = VOX_SQL + """, b AS (SELECT subject, slice_index, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50,
  quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, avg(v * v) AS energy FROM vox GROUP BY 1, 2),
m AS (SELECT vox.subject, vox.slice_index, avg(pow(v - mean, 3)) AS m3, avg(pow(v - mean, 4)) AS m4 FROM vox JOIN b ON vox.subject = b.subject AND vox.slice_index = b.slice_index GROUP BY 1, 2)
SELECT subject, slice_index, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max, round(max - min, 6) AS range,
  round(CASE WHEN std > 0 THEN m3 / pow(std, 3) ELSE 0 END, 6) + 0.0 AS skew, round(CASE WHEN std > 0 THEN m4 / pow(std, 4) - 3 ELSE 0 END, 6) + 0.0 AS kurtosis,
  round(p05, 6) + 0.0 AS p05, round(p25, 6) + 0.0 AS p25, round(p50, 6) + 0.0 AS p50, round(p75, 6) + 0.0 AS p75, round(p95, 6) + 0.0 AS p95, round(p75 - p25, 6) + 0.0 AS iqr, round(energy, 6) AS energy
FROM b JOIN m USING (subject, slice_index)"""

_SOBEL_SQL = VOX_SQL + """, n AS (SELECT a.subject, a.slice_index, a.pos,
    sum(CASE b.y - a.y WHEN -1 THEN 1 WHEN 1 THEN -1 ELSE 0 END * CASE b.x - a.x WHEN 0 THEN 2 ELSE 1 END * b.v) / 4 AS h,
    sum(CASE b.x - a.x WHEN -1 THEN 1 WHEN 1 THEN -1 ELSE 0 END * CASE b.y - a.y WHEN 0 THEN 2 ELSE 1 END * b.v) / 4 AS w
  FROM vox AS a JOIN vox AS b ON a.subject = b.subject AND a.slice_index = b.slice_index AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
  WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3),
g AS (SELECT subject, slice_index, sqrt((h * h + w * w) / 2) AS g FROM n)
SELECT subject, slice_index, round(avg(g), 6) AS gradient_mean, round(stddev_pop(g), 6) AS gradient_std, round(max(g), 6) AS gradient_max, round(quantile_cont(g, 0.9), 6) AS gradient_p90, round(avg(g * g), 6) AS gradient_energy FROM g GROUP BY 1, 2"""

_SEPARABLE_SQL = VOX_SQL + """, t AS (SELECT v, gt FROM f WHERE subject >= 7), fg AS (SELECT * FROM t WHERE v > 0),
cuts AS (SELECT DISTINCT unnest(quantile_cont(v, list_transform(range(32), lambda i: i / 31.0::DOUBLE))) AS cut FROM fg),
c AS (SELECT cut, count(*) FILTER (WHERE v > cut) AS pa, count(*) FILTER (WHERE v > cut AND gt = 1) AS ia, count(*) FILTER (WHERE v < cut) AS pb, count(*) FILTER (WHERE v < cut AND gt = 1) AS ib, (SELECT sum(gt) FROM t) AS g FROM cuts, fg GROUP BY cut)
SELECT round(max(greatest(CASE WHEN pa + g = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ia / (pa + g + 1e-6::DOUBLE) END, CASE WHEN pb + g = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ib / (pb + g + 1e-6::DOUBLE) END)), 6) AS best_dice FROM c"""

_OTSU_SQL = VOX_SQL + """, t AS (SELECT * FROM f WHERE subject >= 7), ext AS (SELECT subject AS s0, min(residual) AS lo, max(residual) AS hi FROM t GROUP BY 1),
h AS (SELECT subject, lo, hi, least(floor((residual - lo) / ((hi - lo) / 256)), 255) AS bin, count(*)::DOUBLE AS n FROM t JOIN ext ON subject = s0 WHERE hi > lo GROUP BY 1, 2, 3, 4),
c AS (SELECT subject, bin, lo + (hi - lo) / 256 * (bin + 0.5::DOUBLE) AS centre, n / sum(n) OVER (PARTITION BY subject) AS p FROM h),
w AS (SELECT subject, bin, centre, sum(p) OVER k AS wb, sum(p * centre) OVER k AS m, sum(p * centre) OVER (PARTITION BY subject) AS total FROM c WINDOW k AS (PARTITION BY subject ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT subject AS s1, centre, row_number() OVER (PARTITION BY subject ORDER BY round(wb * (1 - wb) * pow(m / wb - (total - m) / (1 - wb), 2), 12) DESC, bin) AS rk FROM w WHERE wb > 1e-12 AND 1 - wb > 1e-12)
SELECT subject, """ + _FLAG_SQL + " FROM (SELECT t.*, coalesce(residual > centre, false) AS flagged FROM t LEFT JOIN b ON subject = s1 AND rk = 1) AS x GROUP BY subject"

ORACLES = {
    "residual": VOX_SQL + "SELECT subject, slice_index, pos, round(residual, 6) + 0.0 AS residual FROM f WHERE subject >= 7",
    "dice": _OVERLAP_SQL + "SELECT subject, round(dice, 6) AS dice FROM m",
    "iou": _OVERLAP_SQL + "SELECT subject, round(iou, 6) AS iou FROM m",
    "psnr": VOX_SQL + "SELECT subject, round(10 * log10(1 / greatest(avg((v - recon) * (v - recon)), 1e-6::DOUBLE)), 6) AS psnr_db FROM f WHERE subject >= 7 GROUP BY 1",
    "aggregate_metrics": _OVERLAP_SQL + "SELECT count(*) AS n, round(avg(dice), 6) AS dice_mean, round(stddev_pop(dice), 6) AS dice_std, round(avg(iou), 6) AS iou_mean, round(stddev_pop(iou), 6) AS iou_std FROM m",
    "dice_bugcompat": _BUG_SQL + "SELECT subject, CASE WHEN p + g = 0 THEN NULL ELSE round(2 * i / (p + g), 6) END AS dice FROM o",
    "iou_bugcompat": _BUG_SQL + "SELECT subject, CASE WHEN p + g - i = 0 THEN NULL ELSE round(i / (p + g - i), 6) + 0.0 END AS iou FROM o",
    "legacy_last_only": _OVERLAP_SQL + "SELECT max(subject) AS last_subject, round(arg_max(dice, subject), 6) AS reported, round(avg(dice), 6) AS true_mean FROM m",
    "binarize": VOX_SQL + "SELECT seg::BIGINT AS seg, CASE WHEN seg > 0 THEN 1 ELSE 0 END::BIGINT AS binary, count(*) AS n FROM f GROUP BY 1, 2",
    "minmax_volume": VOX_SQL + "SELECT subject, slice_index, pos, round((v - lo) / (hi - lo + 1e-8::DOUBLE), 6) + 0.0 AS scaled FROM vox JOIN (SELECT subject AS s0, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1) AS e ON subject = s0",
    "crop_box": VOX_SQL + "SELECT subject, slice_index, y - 2 AS y, x - 1 AS x, round(v, 6) + 0.0 AS v FROM vox WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 7",
    "resize_bilinear": _bilinear_sql(),
    "resize_nearest": VOX_SQL + "SELECT size::BIGINT AS size, subject, slice_index, oy AS y, ox AS x, round(v, 6) + 0.0 AS v FROM vox, (SELECT 4 AS size, unnest(range(4)) AS oy UNION ALL SELECT 16 AS size, unnest(range(16)) AS oy) AS a, (SELECT 4 AS sx, unnest(range(4)) AS ox UNION ALL SELECT 16 AS sx, unnest(range(16)) AS ox) AS b WHERE size = sx AND y = oy * 8 // size AND x = ox * 8 // size",
    "pad_depth": VOX_SQL + "SELECT subject, (ceil(count(*) / 16.0::DOUBLE) * 16)::BIGINT AS depth, (ceil(count(*) / 16.0::DOUBLE) * 16)::BIGINT - count(*) AS n_padded FROM sl GROUP BY 1",
    "chunk_index": VOX_SQL + "SELECT subject, slice_index, slice_index // 16 AS chunk_index, slice_index % 16 AS z FROM sl",
    "locate_chunk": VOX_SQL + ", c AS (SELECT subject, ceil(count(*) / 16.0::DOUBLE)::BIGINT AS n_chunks FROM sl GROUP BY 1), o AS (SELECT subject, n_chunks, coalesce(sum(n_chunks) OVER (ORDER BY subject ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_chunk FROM c) SELECT subject, (3 - first_chunk)::BIGINT AS chunk_index FROM o WHERE first_chunk <= 3 AND first_chunk + n_chunks > 3",
    "chunk_offsets": VOX_SQL + ", c AS (SELECT subject, ceil(count(*) / 16.0::DOUBLE)::BIGINT AS n_chunks FROM sl GROUP BY 1) SELECT subject, n_chunks, coalesce(sum(n_chunks) OVER (ORDER BY subject ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_chunk FROM c",
    "quantize_levels": _quant_sql(16) + "SELECT subject, slice_index, pos, q FROM q",
    "normalize_slice": VOX_SQL + _SLICE_EXT + " SELECT subject, slice_index, pos, round(CASE WHEN hi - lo <= 1e-8 THEN 0 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END, 6) + 0.0 AS normed FROM vox JOIN ext ON subject = s0 AND slice_index = i0",
    "overlay_blend": VOX_SQL + _SLICE_EXT + ", g AS (SELECT subject, slice_index, pos, gt, floor(round(CASE WHEN hi - lo <= 1e-8 THEN 0 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END, 9) * 255) AS b FROM f JOIN ext ON subject = s0 AND slice_index = i0 WHERE subject >= 7) SELECT subject, slice_index, pos, b::BIGINT AS gray, floor(CASE WHEN gt = 1 THEN (1 - 0.45::DOUBLE) * b + 0.45::DOUBLE * 255 ELSE b END)::BIGINT AS blended FROM g",
    "validate_range": VOX_SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE v < 0 AND NOT isnan(v)) AS n_below, count(*) FILTER (WHERE v > 1 AND NOT isnan(v)) AS n_above, count(*) FILTER (WHERE isnan(v)) AS n_nan, round(min(v), 6) AS observed_min, round(max(v), 6) AS observed_max FROM vox",
    "non_binary_count": VOX_SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE seg NOT IN (0, 1)) AS n_non_binary FROM f",
    "foreground_slices": VOX_SQL + "SELECT subject, slice_index, round(count(*) FILTER (WHERE v > 0.05)::DOUBLE / count(*), 6) AS foreground_fraction FROM vox GROUP BY 1, 2 HAVING count(*) FILTER (WHERE v > 0.05) > 0",
    "slice_label": VOX_SQL + "SELECT subject, slice_index, CASE WHEN sum(gt) >= 1 THEN 1 ELSE 0 END::BIGINT AS label FROM f GROUP BY 1, 2",
    "slice_counters": VOX_SQL + ", c AS (SELECT subject, slice_index, count(*) FILTER (WHERE v > 0.05) AS fg FROM vox GROUP BY 1, 2) SELECT count(DISTINCT subject) AS n_volumes, count(*) AS n_seen, count(*) FILTER (WHERE fg = 0) AS n_dropped, count(*) FILTER (WHERE fg > 0) AS n_samples FROM c",
    "slice_scores": VOX_SQL + _SCORES_SQL + "SELECT subject, slice_index, flagged_voxels, n_voxels, round(flagged_fraction, 6) AS flagged_fraction, round(foreground_fraction, 6) AS foreground_fraction, label::BIGINT AS label FROM ss",
    "threshold_absolute": VOX_SQL + "SELECT subject, " + _FLAG_SQL + " FROM (SELECT *, residual > 0.15 AS flagged FROM f WHERE subject >= 7) AS x GROUP BY 1",
    "threshold_percentile": VOX_SQL + "SELECT subject, " + _FLAG_SQL + " FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY residual DESC, flat) <= round_even(count(*) OVER (PARTITION BY subject) * 5.0::DOUBLE / 100, 0) AS flagged FROM f WHERE subject >= 7) AS x GROUP BY 1",
    "threshold_otsu": _OTSU_SQL,
    "threshold_sweep": _SWEEP_SQL + "SELECT strategy, value, round(dice_mean, 6) AS dice_mean, round(dice_std, 6) + 0.0 AS dice_std, n_volumes FROM swept",
    "tnoise_sweep": _NOISE_SQL,
    "select_operating_point": _SWEEP_SQL + "SELECT strategy, value, round(dice_mean, 6) AS dice_mean FROM swept ORDER BY round(swept.dice_mean, 9) DESC, value, strategy LIMIT 1",
    "slice_threshold_tuning": VOX_SQL + _SCORES_SQL + """, c AS (SELECT t.threshold, count(*) FILTER (WHERE flagged_fraction >= t.threshold AND label = 1) AS tp, count(*) FILTER (WHERE flagged_fraction >= t.threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE flagged_fraction < t.threshold AND label = 1) AS fn, count(*) FILTER (WHERE flagged_fraction < t.threshold AND label = 0) AS tn
  FROM ss, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)) AS t(threshold) WHERE subject = 6 GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""",
    "first_order": _FIRST_SQL,
    "entropy32": _UNIT_SQL + ", h AS (SELECT subject, slice_index, least(floor(scaled * 32), 31) AS bin, count(*)::DOUBLE AS n FROM u WHERE scaled BETWEEN 0 AND 1 GROUP BY 1, 2, 3), p AS (SELECT subject, slice_index, n / sum(n) OVER (PARTITION BY subject, slice_index) AS p FROM h) SELECT subject, slice_index, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY 1, 2",
    "hist20": _UNIT_SQL + "SELECT subject, least(floor(scaled * 20), 19)::BIGINT AS bin, count(*) AS n FROM u WHERE scaled BETWEEN 0 AND 1 GROUP BY 1, 2",
    "glrlm_row": _glrlm_sql((0,)),
    "glrlm_all": _glrlm_sql((0, 1, 2, 3)),
    "glcm_contrast": _GLCM_SQL + "SELECT subject, slice_index, round(contrast, 6) AS contrast FROM props WHERE dir = 0",
    "glcm_props": _GLCM_SQL + "SELECT subject, slice_index, " + ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}_mean, round(stddev_pop({n}), 6) + 0.0 AS {n}_std" for n in ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "correlation")) + " FROM props GROUP BY 1, 2",
    "gradient_energy": _SOBEL_SQL,
    "sanitize_counts": VOX_SQL + ", c AS (SELECT subject, slice_index, sum(v) AS sv, count(*) FILTER (WHERE seg = 4) AS n4, sum(residual) AS sr, sum(gt) AS ng FROM f GROUP BY 1, 2) SELECT subject, slice_index, round(CASE WHEN n4 = 0 THEN 0 ELSE sv / n4 END, 6) + 0.0 AS a, round(CASE WHEN ng = 0 THEN 0 ELSE sr / ng END, 6) + 0.0 AS b, (CASE WHEN n4 = 0 THEN 1 ELSE 0 END + CASE WHEN ng = 0 THEN 1 ELSE 0 END)::BIGINT AS n_sanitized FROM c",
    "feature_rank": VOX_SQL + ", g AS (SELECT pos, round(var_pop(v), 9) AS gain FROM vox GROUP BY 1) SELECT pos, round(gain, 6) AS gain, row_number() OVER (ORDER BY g.gain DESC, pos) AS rank FROM g",
    "donor_bijection": "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS index, (SELECT count(*) FROM embeddings) AS n FROM embeddings) SELECT vec_id, index, CASE WHEN vec_id % (n - 1) < index THEN vec_id % (n - 1) ELSE vec_id % (n - 1) + 1 END AS donor FROM r",
    "box_blend": _boxes_sql(),
    "intensity_separability": _SEPARABLE_SQL,
    "largest_area": VOX_SQL + "SELECT subject, area FROM (SELECT subject, sum(gt)::BIGINT AS area FROM f GROUP BY 1) AS a ORDER BY area DESC, subject LIMIT 1",
    "depth_nonzero": VOX_SQL + "SELECT subject, slice_index FROM vox GROUP BY 1, 2 HAVING max(v) > 0.3",
    "depth_gt_window": VOX_SQL + """, a AS (SELECT subject, slice_index, sum(gt) AS area FROM f GROUP BY 1, 2),
c AS (SELECT subject, slice_index AS centre, area, row_number() OVER (PARTITION BY subject ORDER BY area DESC, slice_index) AS rk, max(slice_index) OVER (PARTITION BY subject) + 1 AS depth FROM a),
w AS (SELECT subject, centre, depth, least(depth, greatest(centre - 8, 0) + 16) AS hi FROM c WHERE rk = 1 AND area > 0) SELECT subject, centre, greatest(0, hi - 16) AS lo, hi FROM w""",
    "stride_subsample": VOX_SQL + ", n AS (SELECT subject AS s0, count(*) AS n FROM sl GROUP BY 1), k AS (SELECT DISTINCT s0, CASE WHEN n <= 10 THEN NULL ELSE floor(i * (n / 10.0::DOUBLE)) END AS pick FROM n, (SELECT unnest(range(10)) AS i) AS r) SELECT subject, slice_index FROM sl JOIN k ON subject = s0 AND (pick IS NULL OR slice_index = pick)",
    "total_variation": VOX_SQL + ", s AS (SELECT subject, abs(lead(v) OVER (PARTITION BY subject, slice_index, y ORDER BY x) - v) AS r, abs(lead(v) OVER (PARTITION BY subject, slice_index, x ORDER BY y) - v) AS b FROM vox) SELECT subject, round(avg(r) + avg(b), 6) AS total_variation FROM s GROUP BY 1",
    "multiscale_mse": _multiscale_sql(),
    "patch_blend": VOX_SQL + """, p AS (SELECT 7 + p_partkey % 3 AS s0, p_partkey AS no, p_partkey % 47 AS z0, z0 + 1 + p_size % 3 AS z1, p_partkey % 7 AS y0, least(8, y0 + 1 + p_size % 4) AS y1, p_size % 7 AS x0, least(8, x0 + 1 + p_partkey % 5) AS x1, (p_partkey % 90 + 1) / 100 AS alpha FROM part),
h AS (SELECT subject, slice_index, pos, any_value(v) AS v, any_value(recon) AS recon, coalesce(max(alpha), 0)::DOUBLE AS mask, arg_max(no, (alpha, no)) AS patch_no FROM f LEFT JOIN p ON subject = s0 AND slice_index >= z0 AND slice_index < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1 WHERE subject >= 7 GROUP BY 1, 2, 3)
SELECT subject, slice_index, pos, mask, patch_no, round(CASE WHEN mask > 0 THEN (1 - mask) * v + mask * recon ELSE v END, 6) + 0.0 AS blended FROM h""",
    "l2_delta": VOX_SQL + "SELECT subject, round(sqrt(sum((recon - v) * (recon - v))), 6) AS l2_delta FROM f WHERE subject >= 7 GROUP BY 1",
}
ROWS_ONLY = ("ssim", "ssim_mse", "sobel_full", "pca_reconstruction", "synthetic_boxes")
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
