"""Closed-form values, ties, degenerate inputs and numpy restatements."""

import gzip
import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua import contracts
from residua.functions import scalar
from residua.operators import compare, curves, cv, depth, legacy, metrics, preprocess, ranks, reconstruct, report, runs, slices, synth, texture, thresholds, validate
from residua.sources import artifacts, volumes


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize(
    ("predicted", "truth", "dice", "iou"),
    [((1, 1, 1, 0), (1, 1, 0, 1), 2 / 3, 0.5), ((1, 0), (1, 0), 1, 1), ((1, 0), (0, 1), 0, 0), ((0, 0), (0, 0), 1, 1), ((1, 0), (0, 0), 0, 0)],
)
def test_overlap_closed_forms(spark, predicted, truth, dice, iou):
    frame = spark.createDataFrame([(1, p, t) for p, t in zip(predicted, truth, strict=True)], "k int, p int, t int")
    found = metrics.overlap(frame, ["k"], F.col("p") == 1, F.col("t") == 1).first()
    assert found["dice"] == pytest.approx(dice, abs=1e-6)
    assert found["iou"] == pytest.approx(iou, abs=1e-6)


def test_bugcompat_gives_null_for_nothing(spark):
    frame = spark.createDataFrame([(1, 0, 0)], "k int, p int, t int")
    assert rows(metrics.overlap_bugcompat(frame, ["k"], F.col("p") == 1, F.col("t"))) == [(1, None, None)]


def test_psnr_is_capped(spark):
    frame = spark.createDataFrame([(1, 0.5, 0.5)], "k int, a double, b double")
    assert metrics.psnr(frame, ["k"], "a", "b").first()["psnr_db"] == pytest.approx(60.0)


def test_aggregate_of_one_and_of_none(spark):
    frame = spark.createDataFrame([(0.25,)], "dice double")
    assert rows(metrics.aggregate_metrics(frame, ["dice"])) == [(1, 0.25, 0.0)]
    with pytest.raises(Exception, match="no volumes"):
        metrics.aggregate_metrics(frame.filter("false"), ["dice"]).collect()


@pytest.mark.parametrize("p", [90.0, 95.0, 99.0, 0.0, 100.0])
def test_percentile_flags_exactly_k_with_ties(spark, p):
    rng = np.random.default_rng(0)
    residual = np.zeros(3000)
    residual[rng.choice(3000, 130, replace=False)] = rng.choice([0.5, 0.7], 130)
    frame = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(residual)], "k int, flat int, residual double").repartition(7)
    k = int(np.rint(3000 * (100 - p) / 100))
    wanted = set(np.argsort(-residual, kind="stable")[:k].tolist())
    assert {r["flat"] for r in thresholds.percentile_mask(frame, "k", "flat", p).filter("flagged").collect()} == wanted
    grid = spark.createDataFrame([(1, s, residual[s * 1000 : (s + 1) * 1000].tolist()) for s in (2, 0, 1)], "k int, slice_index long, residual array<double>")
    found = thresholds.percentile_mask_rows(grid, "k", p).orderBy("slice_index").collect()
    assert set(np.flatnonzero(np.concatenate([r["mask"] for r in found])).tolist()) == wanted


def test_absolute_threshold_never_flags_nan(spark):
    frame = spark.createDataFrame([(float("nan"),), (0.2,), (0.1,)], "r double")
    assert frame.filter(thresholds.absolute_mask(F.col("r"), 0.1)).count() == 1


def test_otsu_of_a_constant_and_of_two_modes(spark):
    frame = spark.createDataFrame([("c", 0.5)] * 10 + [("m", 0.1)] * 50 + [("m", 0.9)] * 20, "k string, residual double")
    found = {r["k"]: r["n"] for r in thresholds.otsu_mask(frame, "k").groupBy("k").agg(F.count_if("flagged").alias("n")).collect()}
    assert found == {"c": 0, "m": 20}


def test_sweep_finds_the_engineered_optimum(spark):
    data = [(1, i, 1.0 if i < 50 else (i % 30) / 100, 1 if i < 50 else 0) for i in range(1000)]
    frame = spark.createDataFrame(data, "k int, flat int, residual double, gt int")
    sweep = thresholds.threshold_sweep(frame, "k", "flat", [80.0, 90.0, 95.0, 99.0], [0.05])
    best = thresholds.select_operating_point(sweep).first()
    assert (best["strategy"], best["value"]) == ("percentile", 95.0)
    assert best["dice_mean"] == pytest.approx(1.0, abs=1e-6)
    assert sweep.count() == 5
    with pytest.raises(contracts.ConfigError):
        thresholds.select_operating_point(sweep, "test")


def test_slice_reduction(spark):
    data = []
    for z in range(8):
        for p in range(256):
            inside = z == 3 and p % 16 < 4 and p // 16 < 4
            data.append((1, z, 0.5 if 2 <= z <= 5 else 0.0, inside, z == 3 and p % 16 < 2 and p // 16 < 2))
    frame = spark.createDataFrame(data, "k int, z int, v double, m boolean, g boolean")
    found = slices.slice_scores(frame, ["z"], F.col("m"), F.col("v") > 1e-8, F.col("g")).orderBy("z").collect()
    assert [r["z"] for r in found] == [2, 3, 4, 5]
    assert found[1]["flagged_fraction"] == 16 / 256
    assert [r["label"] for r in found] == [0, 1, 0, 0]


def test_curves_with_ties(spark):
    y, s = [1, 0, 1, 0, 1, 0, 0, 1], [0.9, 0.9, 0.5, 0.5, 0.5, 0.1, 0.1, 0.1]
    found = curves.roc_pr_auc(spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double"), "y", "s").first()
    pairs = [(a, b) for a, ya in zip(s, y, strict=True) if ya for b, yb in zip(s, y, strict=True) if not yb]
    assert found["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs))
    assert found["pr_auc"] == pytest.approx(0.25 * 0.5 + 0.5 * 0.6 + 0.25 * 0.5)
    assert found["n_tied_score_groups"] == 3


def test_constant_scores_give_a_half(spark):
    found = curves.roc_pr_auc(spark.createDataFrame([(i % 2, 0.0) for i in range(6)], "y int, s double"), "y", "s").first()
    assert (found["roc_auc"], found["n_tied_score_groups"]) == (0.5, 1)
    with pytest.raises(contracts.DataError):
        curves.require_two_classes(spark.createDataFrame([(1, 0.0)], "y int, s double"), "y")


@pytest.mark.parametrize(
    ("x", "y", "rho"), [([1, 1, 2, 3], [1, 2, 2, 3], 5 / 6), ([1, 2, 3], [3, 2, 1], -1), ([1, 2], [1, 2], None), ([1, 1, 1], [1, 2, 3], None)]
)
def test_spearman(spark, x, y, rho):
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    found = ranks.spearman(frame, "x", "y").first()["rho"]
    assert found is None if rho is None else found == pytest.approx(rho)


def test_absence_is_not_zero(spark):
    declared = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cells = compare.declared_left_join(declared, spark.createDataFrame([("a", 0.0), ("b", 0.5)], "k string, v double"), ["k"], "v")
    assert sorted(rows(compare.rendered(cells, ["k"], "v"))) == [("a", "0.0000"), ("b", "0.5000"), ("c", "n/a (not evaluated)")]
    assert rows(compare.availability(cells, "v")) == [(3, 2, 1)]
    assert compare.best_cell(cells, "v", [F.col("k")]).first()["k"] == "b"


def test_controls_agree_on_null(spark):
    frame = spark.createDataFrame([("b", 1, None, 0.6), ("a", 1, None, 0.5), ("b", 2, "x", 0.1), ("a", 2, "y", 0.2)], "side string, k int, c string, v double")
    found = rows(compare.controlled_pairs(frame, "side", "b", "a", ["k"], ["c"], "v"))
    assert [(r[0], r[-1]) for r in found] == [(1, "REGRESSION")]


def test_same_samples_guard(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "k int") for r in (range(3), range(4)))
    with pytest.raises(contracts.ArtifactError, match="extra"):
        compare.require_same_samples(a, b, ["k"])
    compare.require_same_samples(a, a, ["k"])


def test_resize_of_a_ramp(spark):
    frame = spark.createDataFrame([(0, y, x, float(x)) for y in range(4) for x in range(4)], "k int, y long, x long, v double")
    found = {r["x"]: r["v"] for r in preprocess.resize_bilinear(frame, ["k"], 4, 2).filter("y = 0").collect()}
    assert found == {0: 0.5, 1: 2.5}
    found = {(r["y"], r["x"]): r["v"] for r in preprocess.resize_nearest(frame, 4, 8).collect()}
    assert found[7, 5] == 2.0 and len(found) == 64


def test_chunks(spark):
    frame = spark.createDataFrame([("s", i) for i in range(20)], "subject string, slice_index long")
    padded = preprocess.pad_depth(frame)
    assert (padded.count(), padded.filter("padded").count()) == (32, 12)
    with pytest.raises(contracts.DataError):
        preprocess.require_whole_chunks(frame)
    offsets = preprocess.chunk_offsets(frame.unionByName(frame.withColumn("subject", F.lit("t"))))
    assert rows(preprocess.locate_chunk(offsets, 3)) == [("t", 1)]
    assert rows(preprocess.locate_chunk(offsets, 4)) == []


def test_minmax_and_quantize_of_a_constant(spark):
    frame = spark.createDataFrame([("s", 0, 2.0), ("s", 0, 2.0)], "subject string, slice_index int, v double")
    assert {r["scaled"] for r in preprocess.minmax_volume(frame).collect()} == {0.0}
    assert {r["scaled"] for r in preprocess.minmax_volume(frame, eps=0.0).collect()} == {None}
    assert {r["q"] for r in preprocess.quantize_levels(frame, ["subject"], 8).collect()} == {0}


def test_half_even_levels(spark):
    frame = spark.createDataFrame([(0.0,), (0.5,), (0.3,), (1.0,)], "v double")
    found = [r[0] for r in frame.select(scalar.quantize(F.col("v"), F.lit(0.0), F.lit(1.0), 6)).collect()]
    assert found == [0, 2, 2, 5]


def test_normalize_guards(spark):
    cell = spark.createDataFrame([(0.5, 0.5, 0.5), (0.5, 0.0, float("inf")), (2.0, 0.0, 1.0), (0.25, 0.0, 0.5)], "v double, lo double, hi double")
    assert [r[0] for r in cell.select(scalar.normalize(F.col("v"), F.col("lo"), F.col("hi"))).collect()] == [0.0, 0.0, 1.0, 0.5]


def _slice_frame(spark, image):
    h, w = image.shape
    return spark.createDataFrame([(0, 0, image.ravel().tolist())], "subject int, slice_index int, pixels array<double>"), h, w


def test_sobel_against_numpy(spark):
    image = np.random.default_rng(1).random((9, 7))
    frame, h, w = _slice_frame(spark, image)
    g = texture.sobel(image)
    inner = sorted(r["g"] for r in texture.gradient_interior(frame, ["subject"], w, h).collect())
    assert np.allclose(inner, np.sort(g[1:-1, 1:-1].ravel()))
    full = texture.sobel_full(frame, "subject", h, w).first()
    assert full["gradient_energy"] == pytest.approx((g**2).mean())
    assert texture.sobel(np.ones((4, 4))).max() == 0


def test_cooccurrence_against_numpy(spark):
    q = np.random.default_rng(2).integers(0, 4, (5, 6))
    frame = spark.createDataFrame([(0, q.ravel().tolist())], "k int, q array<int>")
    found = {(int(r["direction"]), int(r["i"]), int(r["j"])): r["c"] for r in texture.cooccurrence(frame, ["k"], 4, 6, 5).collect()}
    wanted: dict = {}
    for d, (dy, dx) in enumerate(texture.STEPS):
        for y in range(5):
            for x in range(6):
                if 0 <= y + dy < 5 and 0 <= x + dx < 6:
                    a, b = int(q[y, x]), int(q[y + dy, x + dx])
                    for key in ((d, a, b), (d, b, a)):
                        wanted[key] = wanted.get(key, 0) + 1
    assert found == wanted
    flat = spark.createDataFrame([(0, [1] * 30)], "k int, q array<int>")
    constant = texture.cooccurrence_props(texture.cooccurrence(flat, ["k"], 4, 6, 5), ["k"]).first()
    assert (constant["contrast"], constant["correlation"], constant["asm"]) == (0.0, 0.0, 1.0)


def test_run_lengths(spark):
    frame = spark.createDataFrame([(0, 0, x, q) for x, q in enumerate([0, 0, 1, 1, 1, 0])], "k int, y int, x int, q int")
    found = texture.glrlm(frame, ["k"], directions=(0,)).first()
    lengths, grays = np.array([2, 3, 1]), np.array([1, 2, 1])
    assert found["sre"] == pytest.approx((1 / lengths**2).mean())
    assert found["lre"] == pytest.approx((lengths**2).mean())
    assert found["gln"] == pytest.approx((2**2 + 1) / 3)
    assert found["rp"] == pytest.approx(3 / 6)
    assert found["hgre"] == pytest.approx((grays**2).mean())


@pytest.mark.parametrize("height,width", [(5, 7), (7, 5), (1, 6), (6, 1), (4, 4)])
def test_run_lengths_in_the_row_equal_those_of_voxels(spark, height, width):
    rng = np.random.default_rng(height * 10 + width)
    slices = [(k, rng.integers(0, 1 + k % 3, height * width).tolist()) for k in range(6)]
    voxels = [(k, p // width, p % width, v) for k, q in slices for p, v in enumerate(q)]
    wanted = texture.glrlm(spark.createDataFrame(voxels, "k int, y int, x int, q int"), ["k"]).orderBy("k").collect()
    found = texture.glrlm_slices(spark.createDataFrame(slices, "k int, q array<int>"), ["k"], width, height).orderBy("k").collect()
    assert [tuple(r) for r in found] == [pytest.approx(tuple(r)) for r in wanted]
    plan = texture.glrlm_slices(spark.createDataFrame(slices, "k int, q array<int>"), ["k"], width, height)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_entropy_edges(spark):
    frame = spark.createDataFrame([(0, 1.0), (0, 0.0), (0, -0.1), (1, 0.5), (1, 0.5)], "k int, v double")
    assert dict(rows(texture.entropy(frame, ["k"], "v"))) == {0: 1.0, 1: 0.0}


def test_sanitize_counts(spark):
    frame = spark.createDataFrame([(float("nan"), 1.0), (None, float("inf"))], "a double, b double")
    assert rows(texture.sanitize(frame, ["a", "b"])) == [(0.0, 1.0, 1), (0.0, 0.0, 2)]


def test_ssim_of_equal_and_of_small_volumes():
    x = np.random.default_rng(3).random((11, 12, 12))
    assert metrics.ssim_value(x, x) == pytest.approx(1.0)
    assert metrics.ssim_value(x, 1 - x) < 0.5
    with pytest.raises(contracts.DataError):
        metrics.ssim_value(x[:5], x[:5])


def test_split_is_exact_and_seeded(spark):
    ids = [f"sub-{i}" for i in range(20)]
    a, b = (cv.seeded_split(ids, cv.TUMOR_FRACTIONS, seed) for seed in (42, 7))
    assert a == cv.seeded_split(list(reversed(ids)), cv.TUMOR_FRACTIONS, 42) != b
    assert (len(a["val"]), len(a["test"])) == (4, 16)
    with pytest.raises(contracts.ConfigError):
        cv.seeded_split(ids, {"train": 0.5}, 1)
    with pytest.raises(contracts.SplitError):
        cv.verify_split({"train": ["a"]}, {"train": ["b"]})
    frame = cv.hashed_split(spark.createDataFrame([(i,) for i in ids], "k string"), "k", {"train": 0.75, "test": 0.25})
    assert dict(rows(frame.groupBy("split").count())) == {"train": 15, "test": 5}


def test_group_folds(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(f"g{g}", int(rng.random() < 0.2)) for g in range(12) for _ in range(20)], "g string, y int")
    folds = cv.stratified_group_folds(frame, "g", "y")
    joined = frame.join(folds, "g")
    assert cv.group_overlap(joined, "g", "fold").count() == 0
    assert joined.select("fold").distinct().count() == 5
    shares = [r["positive_rate"] for r in cv.fold_metrics(joined, "fold", "g", "y").collect()]
    assert max(shares) - min(shares) < 0.15
    with pytest.raises(Exception, match="no positives"):
        cv.scale_pos_weight(joined.withColumn("y", F.lit(0)), "fold", "y").collect()


def test_leakage_guard(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "k int") for r in (range(3), range(2, 4)))
    with pytest.raises(contracts.LeakageError):
        validate.require_no_leakage(a, b, "k")


def test_range_guard_rejects_nan(spark):
    with pytest.raises(contracts.DataError, match="1 NaN"):
        validate.require_range(spark.createDataFrame([(0.5,), (float("nan"),)], "v double"), "v")


def test_donor_is_another(spark):
    found = rows(synth.donors(spark.createDataFrame([(i * 7,) for i in range(9)], "id int"), "id").select("index", "donor"))
    assert all(i != d and 0 <= d < 9 for i, d in found)


def test_highest_alpha_wins(spark):
    frame = spark.createDataFrame([(0, y, x, 1.0, 0.0) for y in range(4) for x in range(4)], "slice_index int, y int, x int, v double, donor_v double")
    boxes = ((0, 0, 1, 0, 3, 0, 3, 0.2), (1, 0, 1, 2, 4, 2, 4, 0.7))
    found = {(r["y"], r["x"]): (r["mask"], round(r["blended"], 6)) for r in synth.box_blend(frame, boxes).collect()}
    assert found[0, 0] == (0.2, 0.8) and found[2, 2] == (0.7, 0.3) and found[0, 3] == (0.0, 1.0)
    table = spark.createDataFrame([("s", *b) for b in boxes], "k string, no int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, alpha double")
    again = {(r["y"], r["x"]): (r["mask"], round(r["blended"], 6)) for r in synth.blend_by_table(frame.withColumn("k", F.lit("s")), table, "k").collect()}
    assert again == found


def test_boxes_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.random(64).tolist(), rng.random(64).tolist()) for i in range(10)]
    frame = spark.createDataFrame(data, "id long, healthy array<double>, donor array<double>")
    a, b = (sorted(rows(synth.synthetic_boxes(frame.repartition(n), "id", (1, 8, 8), depths=(1, 1)))) for n in (1, 5))
    assert a == b and a
    assert all(0 <= r[4] < r[5] <= 8 and 0 <= r[6] < r[7] <= 8 and 0.3 <= r[8] <= 0.9 for r in a)


def test_separability_against_numpy(spark):
    rng = np.random.default_rng(6)
    v, g = rng.random(400), rng.random(400) < 0.3
    v = v + 0.5 * g
    frame = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(v, g, strict=True)], "v double, g boolean")
    best = 0.0
    for cut in np.quantile(v, np.linspace(0, 1, 32)):
        for mask in (v > cut, v < cut):
            best = max(best, 2 * (mask & g).sum() / (mask.sum() + g.sum() + 1e-6))
    assert synth.intensity_separability(frame, F.col("g"), cuts=32).first()[0] == pytest.approx(best)
    assert synth.intensity_separability(frame.filter("v > 9"), F.col("g"), cuts=32).first()[0] == 0.0


def test_depth_window_is_clamped(spark):
    frame = spark.createDataFrame([("s", z, z == 1) for z in range(10)], "k string, slice_index long, g boolean")
    assert rows(depth.truth_window(frame, "k", F.col("g"), 4)) == [("s", 1, 0, 4)]
    few = depth.stride_subsample(frame.select("k", "slice_index"), "k", 3)
    assert sorted(r["slice_index"] for r in few.collect()) == [int(i * 10 / 3) for i in range(3)]
    one, all_of = frame.filter("g").select("k", "slice_index"), frame.select("k", "slice_index")
    assert depth.with_fallback(one, all_of, "k").count() == 10


def test_best_so_far_skips_missing_scores(spark):
    data = [("m", i, s) for i, s in enumerate([0.1, None, 0.3, 0.2, None, 0.25, 0.1])]
    frame = spark.createDataFrame(data, "m string, e int, s double")
    found = [r["best"] for r in runs.best_so_far(frame, "m", ["e"], "s").orderBy("e").collect()]
    assert found == [0.1, 0.1, 0.3, 0.3, 0.3, 0.3, 0.3]
    assert rows(runs.stopped_at(frame, "m", ["e"], "s", 2)) == [("m", 5)]


def test_reconstructors(spark):
    rng = np.random.default_rng(7)
    basis = rng.random((2, 9))
    data = [(i, (rng.random(2) @ basis).tolist()) for i in range(30)]
    frame = spark.createDataFrame(data, "k long, pixels array<double>")
    mean, components = reconstruct.pca_components(frame, 2)
    found = reconstruct.pca_reconstruct(frame, ["k"], mean, components).collect()
    assert all(np.allclose(r["pixels"], r["reconstruction"]) for r in found)


def test_legacy_path(spark):
    frame = spark.createDataFrame([("s", z, y, x, float(y * x)) for z in range(64, 80) for y in range(6) for x in range(6)], "subject string, slice_index int, y int, x int, v double")
    assert preprocess.crop_box(frame, {"y": (1, 3)}).agg(F.max("y")).first()[0] == 1
    assert legacy.preprocess_legacy(frame, "subject", 6, 6, 2).count() == 16 * 4


def _nifti(array):
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 3, *array.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", header, 70, 16, 32)
    struct.pack_into("<3f", header, 108, 352.0, 2.0, 1.0)
    return bytes(header) + array.astype("<f4").tobytes(order="F")


def test_volume_files(spark, tmp_path):
    a = np.random.default_rng(8).random((4, 5, 6)).astype(np.float32)
    np.save(tmp_path / "sub-1.npy", a[None, None])
    (tmp_path / "B").mkdir()
    (tmp_path / "B" / "B_t2.nii.gz").write_bytes(gzip.compress(_nifti(a)))
    (tmp_path / "B" / "B_t2.nii").write_bytes(_nifti(a))
    found = volumes.read_volumes(spark, str(tmp_path), "*.npy").orderBy("slice_index").collect()
    assert np.allclose([r["pixels"] for r in found], a.reshape(4, -1)) and found[0]["volume_id"] == "sub-1"
    found = volumes.read_volumes(spark, str(tmp_path), "*.nii.gz").orderBy("slice_index").collect()
    assert np.allclose([r["pixels"] for r in found], (a.transpose(2, 0, 1) * 2 + 1).reshape(6, -1))
    files = volumes.volume_files(spark, str(tmp_path), "*.nii*")
    assert [r["path"].endswith("B_t2.nii.gz") for r in volumes.resolve_modality(files, "t2").collect()] == [True]
    with pytest.raises(contracts.DataError):
        volumes.require_modality(volumes.resolve_modality(files, "seg"))
    assert volumes.is_lfs_stub(b"version https://git-lfs.github.com/spec/v1\n")
    with pytest.raises(contracts.DataError):
        volumes.parse_npy(_npy(np.zeros((2, 2))))


def _npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def test_artifacts(spark, tmp_path):
    report.write_manifest(str(tmp_path / "manifest.json"), "mean", "mse", "test", 3, "abc")
    manifest = artifacts.read_json(spark, str(tmp_path / "manifest.json"), contracts.MANIFEST)
    artifacts.require_manifest(manifest, split="test", model="mean")
    with pytest.raises(contracts.ArtifactError, match="split"):
        artifacts.require_manifest(manifest, split="val")
    assert artifacts.read_json(spark, str(tmp_path / "none.json"), contracts.MANIFEST) is None
    table = spark.createDataFrame([("v", 0.5, 0.4, 20.0, 0.9)], contracts.VOLUME_METRICS)
    report.save_csv(table, str(tmp_path / "csv"), table.columns)
    assert artifacts.read_csv(spark, str(tmp_path / "csv"), contracts.VOLUME_METRICS).count() == 1
    with pytest.raises(contracts.ArtifactError):
        report.save_csv(table, str(tmp_path / "x"), ["missing"])
    with pytest.raises(contracts.ArtifactError):
        artifacts.read_csv(spark, str(tmp_path / "csv"), "a string, b double").collect()
    artifacts.save_feature_cache(table, str(tmp_path / "cache"), {"levels": "32", "limit": "10"})
    assert artifacts.feature_cache(spark, str(tmp_path / "cache"), {"levels": "32", "limit": "10"}).count() == 1
    with pytest.raises(contracts.ArtifactError, match="limit"):
        artifacts.feature_cache(spark, str(tmp_path / "cache"), {"levels": "32", "limit": "20"})
    assert artifacts.feature_cache(spark, str(tmp_path / "nowhere"), {}) is None


def test_results_of_the_newest_run(spark, tmp_path):
    frame = spark.createDataFrame([("20260101T000000_000000Z", "a", 1), ("20260201T000000_000000Z", "b", 2)], "run_id string, volume_id string, n int")
    report.save_volumes(frame, str(tmp_path / "results"))
    newest = artifacts.read_results(spark, str(tmp_path / "results"))
    assert [r["volume_id"] for r in newest.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(run_id" in newest._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(contracts.ArtifactError, match="1 stored"):
        artifacts.point_lookup(newest, "a")


def test_splice_and_run_record(tmp_path):
    text = "x\n<!-- b -->\nold\n<!-- e -->\ny"
    once = report.splice(text, "new", "<!-- b -->", "<!-- e -->")
    assert "old" not in once and report.splice(once, "new", "<!-- b -->", "<!-- e -->") == once
    for bad in ("x", text + text, "<!-- e --><!-- b -->"):
        with pytest.raises(contracts.ArtifactError):
            report.splice(bad, "new", "<!-- b -->", "<!-- e -->")
    with pytest.raises(ValueError, match="boom"), report.run_record(str(tmp_path), {}, 1) as record:
        with report.timer(record, "t"):
            raise ValueError("boom")
    written = next(tmp_path.glob("*/run_meta.json")).read_text()
    assert "boom" in written and '"t"' in written


def test_seeds_and_hashes():
    assert scalar.blake_seed(42, 0, 1) == scalar.blake_seed(42, 0, 1) != scalar.blake_seed(42, 1, 1)
    assert 0 <= scalar.blake_seed(1, 2, 3) < 2**63
    assert scalar.canonical_hash({"a": 1, "b": 2}) == scalar.canonical_hash({"b": 2, "a": 1})
    steps = scalar.timesteps(500, 50, 1000)
    assert steps[0] == 500 and steps == sorted(steps, reverse=True) and steps[-1] == 0


def test_aggregate_document(spark):
    frame = spark.createDataFrame([(0.6, 0.5, 20.0, 0.9)] * 2, "dice double, iou double, psnr_db double, ssim double")
    found = report.aggregate_document(metrics.aggregate_metrics(frame, ["dice", "iou", "psnr_db", "ssim"]), 0.5).first()
    assert found["baseline_delta"]["delta"] == pytest.approx(0.1)
    with pytest.raises(contracts.ArtifactError):
        report.aggregate_document(metrics.aggregate_metrics(frame, ["dice"]), 0.5)


def test_stream_scores(spark, tmp_path):
    from residua.streaming.slice_stream import stream_slice_scores

    frame = spark.createDataFrame([("s", 0, [0.1, 0.9, float("nan")]), ("s", 1, [0.0, 0.0, 0.0])], "subject string, slice_index long, residual array<double>")
    frame.write.parquet(str(tmp_path / "in"))
    stream = stream_slice_scores(spark, str(tmp_path / "in"), frame.schema, ["subject", "slice_index"], 0.5)
    query = stream.writeStream.format("memory").queryName("scores").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(rows(spark.sql("SELECT slice_index, flagged_voxels, n_voxels FROM scores"))) == [(0, 1, 3), (1, 0, 3)]


def test_half_present_rows_of_both_sides(spark):
    left, right = (spark.createDataFrame([(i,) for i in ids], "doc_id long") for ids in ([1, 2, 2], [2, 3]))
    assert sorted(tuple(r) for r in compare.half_present(left, right, ["doc_id"]).select("doc_id", "side").collect()) == [(1, "left"), (3, "right")]


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_has_no_curve(spark, label):
    with pytest.raises(Exception, match="both classes"):
        curves.roc_pr_auc(spark.createDataFrame([(label, 0.1), (label, 0.2)], "y int, s double"), "y", "s").collect()


def test_auc_by_key_of_ties_and_of_one_class(spark):
    from residua.operators import curves

    frame = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), (None, 1, 0.2), (None, 0, 0.1)], "k string, y int, s double")
    found = {r["k"]: (r["roc_auc"], r["pr_auc"]) for r in curves.auc_by_key(frame, "k", "y", "s").collect()}
    assert found["a"] == (0.875, pytest.approx(0.5 + 0.5 * 2 / 3)) and found["b"] == (None, None) and found[None] == (1.0, 1.0)


def test_numbered_agrees_with_a_sort(spark):
    from residua.operators import prefix

    frame = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "v int")
    assert all(r["v"] == r["at"] for r in prefix.numbered(frame, "v", "at").collect())
    assert prefix.numbered(frame.limit(0), "v", "at").count() == 0


def test_traced_scorecard(spark):
    from residua.operators import compare

    schema = "metric string, priority int, source string, split_hash string, value double"
    reasons = spark.createDataFrame([("auc", "not run"), ("dice", "not run")], "metric string, na_reason string")
    found = lambda *e: sorted(tuple(r) for r in compare.traced_scorecard(spark.createDataFrame(list(e), schema), reasons).collect())
    assert found(("auc", 0, "own", "h", None), ("auc", 1, "other", None, 0.7)) == [("auc", 0.7, "other", None), ("dice", None, None, "not run")]
    assert [r[1:] for r in found(("auc", 0, "a", "h", 0.7), ("dice", 0, "b", "g", 0.2))] == [(None, None, "sources differ in their splits")] * 2
    with pytest.raises(Exception, match="no source"):
        found(("auc", 0, None, "h", 0.7))


def test_must_match_and_guards(spark):
    from pyspark.sql import functions as F

    from residua.contracts import ArtifactError, DataError
    from residua.operators import compare, synth, validate

    runs_ = spark.createDataFrame([("r1", 3)], "run string, seed int")
    assert [tuple(r) for r in compare.must_match(spark.createDataFrame([("r1", 0.5)], "run string, dice double"), runs_, "run", ["seed"]).collect()] == [("r1", 0.5, 3)]
    with pytest.raises(Exception, match="no run record for r2"):
        compare.must_match(spark.createDataFrame([("r2", 0.5)], "run string, dice double"), runs_, "run", ["seed"]).collect()
    one, two = (spark.createDataFrame([(k, [0] * k)], "k int, a array<int>") for k in (1, 2))
    validate.require_equal_shapes(one, one, ["k"], "a")
    for check in (lambda: validate.require_equal_shapes(one, two, ["k"], "a"), lambda: validate.require_binary(two, F.col("k"))):
        with pytest.raises(DataError):
            check()
    scores = spark.createDataFrame([(0.2,), (0.9,)], "best_dice double")
    synth.require_inseparable(scores, 0.95)
    for check in (lambda: compare.require_complete(one, two, ["k"]), lambda: synth.require_inseparable(scores, 0.5)):
        with pytest.raises(ArtifactError):
            check()


def test_split_is_saved_and_loaded(spark, tmp_path):
    from residua.contracts import ArtifactError
    from residua.operators import report
    from residua.sources import artifacts

    parts = {"healthy": {"train": ["a", "b"], "val": []}, "tumor": {"test": ["c"]}}
    report.save_split(spark, str(tmp_path / "split"), 42, parts)
    assert artifacts.load_split(spark, str(tmp_path / "split")) == (42, parts)
    with pytest.raises(ArtifactError):
        artifacts.load_split(spark, str(tmp_path / "none"))


def test_entropy_without_values_inside_is_zero(spark):
    from residua.operators import texture

    frame = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 0.1), (2, 0.9)], "k int, v double")
    assert sorted(tuple(r) for r in texture.entropy(frame, ["k"], "v").collect()) == [(1, 0.0), (2, 1.0)]


def test_placed_box_lies_inside_and_passes_both_tests():
    import numpy as np

    from residua.operators import synth

    healthy, donor = np.full((4, 9, 7), 0.5), np.full((4, 9, 7), 0.9)
    for seed in range(50):
        z0, z1, y0, y1, x0, x1, alpha, found, *source = synth.place_box(healthy, donor, np.random.default_rng(seed), (2, 4), (1, 2), (0.3, 0.9), 0.0)
        assert source == [z0, y0, x0]
        free = synth.place_box(healthy, donor, np.random.default_rng(seed), (2, 4), (1, 2), (0.3, 0.9), 0.0, aligned=False)
        assert all(0 <= at <= side - (hi - lo) for at, side, lo, hi in zip(free[8:], healthy.shape, free[0:6:2], free[1:6:2], strict=True))
        assert found and 0 <= z0 < z1 <= 4 and 0 <= y0 < y1 <= 9 and 0 <= x0 < x1 <= 7 and 1 <= z1 - z0 <= 2 and 2 <= y1 - y0 <= 4 and 0.3 <= alpha <= 0.9
    assert synth.place_box(healthy * 0, donor, np.random.default_rng(1), (2, 4), (1, 2), (0.3, 0.9), 0.0)[7] is False


def test_best_so_far_over_buckets_agrees_with_a_loop(spark):
    data = [("b" if i % 3 == 0 else None, i, None if i % 7 == 0 else float((i * 37) % 101)) for i in range(1, 400)]
    found = {(r["k"], r["e"]): (r["best"], r["improved"]) for r in runs.best_so_far(spark.createDataFrame(data, "k string, e int, s double"), "k", ["e"], "s").collect()}
    held = {}
    for k, e, s in data:
        earlier = held.get(k)
        if s is not None:
            held[k] = s if earlier is None else max(earlier, s)
        assert found[(k, e)] == (held.get(k), s is not None and (earlier is None or s > earlier))
    assert len(found) == len(data)


def test_ranked_by_agrees_with_a_sort(spark):
    from residua.operators.prefix import ranked_by

    data = [(None if i % 5 == 0 else i % 3, None if i % 11 == 0 else float(i * 7 % 40), i) for i in range(500)]
    found = ranked_by(spark.createDataFrame(data, "k int, v double, i int"), ["k"], "v", [F.col("i")], descending=True).collect()
    for key in {k for k, _, _ in data}:
        wanted = [i for k, v, i in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])) if k == key]
        assert [r["i"] for r in sorted((r for r in found if r["k"] == key), key=lambda r: r["_before"])] == wanted
        assert {r["_all"] for r in found if r["k"] == key} == {len(wanted)}


def test_stopping_place_against_a_loop(spark):
    data = [(k, i, None if i % 9 == 0 else float((i * (13 + k)) % 97 + i // 40)) for k in range(3) for i in range(1, 200)]
    for patience in (1, 7, 60, 500):
        found = {r["k"]: r["e"] for r in runs.stopped_at(spark.createDataFrame(data, "k int, e int, s double"), "k", ["e"], "s", patience).collect()}
        wanted = {}
        for k in range(3):
            best, stale = None, 0
            for _, e, s in (r for r in data if r[0] == k and r[2] is not None):
                best, stale = (s, 0) if best is None or s > best else (best, stale + 1)
                if stale >= patience:
                    wanted[k] = e
                    break
        assert found == wanted


def test_ssim_by_slabs_equals_the_whole(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((23, 9, 8))
    y = np.clip(x + 0.1 * rng.standard_normal(x.shape), 0, 1)
    frame = spark.createDataFrame([("a", i, x[i].ravel().tolist(), y[i].ravel().tolist()) for i in range(23)], "k string, slice_index bigint, original array<double>, reconstruction array<double>")
    for slab in (1, 4, 64):
        assert abs(metrics.ssim(frame, "k", 9, 8, window=5, slab=slab).first()["ssim"] - metrics.ssim_value(x, y, 5)) < 1e-12
    g = np.exp(-((np.arange(5) - 2.0) ** 2) / 4.5)
    w = np.einsum("i,j,k->ijk", g, g, g) / g.sum() ** 3
    places = [(slice(a, a + 5), slice(b, b + 5), slice(c, c + 5)) for a in range(19) for b in range(5) for c in range(4)]
    single = []
    for at in places:
        p, q = x[at], y[at]
        mp, mq = (w * p).sum(), (w * q).sum()
        vp, vq, vpq = (w * p * p).sum() - mp**2, (w * q * q).sum() - mq**2, (w * p * q).sum() - mp * mq
        single.append((2 * mp * mq + 1e-4) * (2 * vpq + 9e-4) / ((mp**2 + mq**2 + 1e-4) * (vp + vq + 9e-4)))
    assert abs(np.mean(single) - metrics.ssim_value(x, y, 5)) < 1e-9
    with pytest.raises(Exception, match="fewer slices"):
        metrics.ssim(frame.filter("slice_index < 4"), "k", 9, 8, window=5).collect()


def test_documents_are_written(spark, tmp_path):
    import json

    from residua.operators import documents

    cells = spark.createDataFrame([("m", "a", 0.5, 20.0, None), ("m", "b", 0.5, 22.25, None), ("n", "a", 0.25, 10.0, None), ("n", "b", None, None, "not evaluated")], "model string, loss string, dice double, psnr_db double, na_reason string")
    documents.save_matrix(cells, str(tmp_path), ["model", "loss"], ["dice", "psnr_db"], "dice", "psnr_db")
    stats = spark.read.json(f"{tmp_path}/matrix.json").select("stats.*").first()
    assert (stats["n_cells"], stats["n_available"], stats["n_pairs"], stats["best_cell_id"]) == (4, 3, 3, "m__a")
    assert stats["rho"] == pytest.approx(0.8660254)
    assert "| n__b | n | b | n/a (not evaluated) |" in (tmp_path / "matrix.md").read_text()
    assert spark.read.option("header", True).csv(f"{tmp_path}/matrix.csv").filter("cell_id = 'm__b'").first()["psnr_db"] == "22.25"
    empty = documents.cell_stats(cells.filter("false"), ["model", "loss"], "dice", "psnr_db").first()
    assert (empty["n_cells"], empty["rho"], empty["best_cell_id"]) == (0, None, None)

    columns = spark.createDataFrame([("classical", False, 0.7, None, None), ("unetr", True, 0.7, 0.4, None)], "key string, localizes boolean, roc_auc double, dice double, na_reason string")
    documents.save_paradigms(columns, str(tmp_path), ["classical", "unetr", "diffusion"], ["roc_auc"], ["dice"], {"n_slices": 9}, "h")
    text = (tmp_path / "paradigms.md").read_text()
    assert "| dice | n/a (no voxel masks) | 0.4000 | n/a (not evaluated) |" in text and "n_slices 9" in text
    assert tuple(documents.paradigm_stats(columns).first()) == (2, 2, "classical", "unetr")

    record = lambda dice, iou, split: spark.createDataFrame([("m", "l", dice, 0.1, iou, 0.1, "r", split)], "model string, loss string, dice_mean double, dice_std double, iou_mean double, iou_std double, run_id string, split_hash string")
    documents.save_before_after(record(0.5, 0.3, "h"), record(0.4, 0.35, "h"), str(tmp_path), ["dice_mean", "iou_mean"], ["split_hash"])
    text = (tmp_path / "before_after.md").read_text()
    assert "| dice_mean | 0.5000 | 0.4000 | -0.1000 | REGRESSION |" in text and "| +0.0500 | ok |" in text
    with pytest.raises(Exception, match="records differ in split_hash"):
        documents.before_after_rows(record(0.5, 0.3, "h"), record(0.4, 0.35, "g"), ["dice_mean"], ["split_hash"]).collect()

    folds = spark.createDataFrame([(0, 4, 1, 0.25, 0.5, 0.5), (1, 4, 3, 0.75, 1.0, None)], "fold int, n_test long, n_test_positive long, positive_rate double, roc_auc double, pr_auc double")
    report.save_json(documents.classical_document(folds, "r", 1, True), f"{tmp_path}/classical.json")
    stored = json.loads(next((tmp_path / "classical.json").glob("part-*")).read_text())
    assert stored["class_balance"] == {"n_positive": 4, "n_negative": 4, "positive_rate": 0.5} and stored["headline"]["roc_auc_std"] == 0.25
    documents.save_importance(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, mean_gain double"), f"{tmp_path}/importance")
    assert {(r["rank"], r["feature"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/importance").collect()} == {("1", "c"), ("2", "a"), ("3", "b")}


def test_presence_and_paths(spark, tmp_path):
    for name in ("full", "bare"):
        (tmp_path / name).mkdir()
    (tmp_path / "full" / "a.npy").write_bytes(b"x")
    audit = volumes.presence_audit(spark, str(tmp_path), [("full", "*.npy"), ("bare", "*.npy"), ("none", "*.npy")])
    assert {r["folder"]: r["state"] for r in audit.collect()} == {"full": "ok", "bare": "empty", "none": "missing"}
    with pytest.raises(contracts.DataError, match="bare.*none"):
        volumes.require_present(audit)
    paths = spark.createDataFrame([("/r/x/a.json",), ("/other/b.json",), ("/rx/c.json",)], "p string")
    assert {r[0] for r in paths.select(volumes.relative_path(F.col("p"), "/r")).collect()} == {"x/a.json", "/other/b.json", "/rx/c.json"}
    order = [r["k"] for r in preprocess.loader_order(spark.range(50).withColumnRenamed("id", "k"), "k", "train", 1).collect()]
    assert sorted(order) == list(range(50)) != order
    assert [r["k"] for r in preprocess.loader_order(spark.range(50).withColumnRenamed("id", "k"), "k", "val", 1).collect()] == list(range(50))


def test_octaves_rise_with_the_value(spark):
    from residua.operators.prefix import octaves

    rng = np.random.default_rng(8)
    values = [float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), *(rng.standard_normal(300) * 10.0 ** rng.integers(-9, 9, 300)).tolist()]
    found = [r["b"] for r in spark.createDataFrame([(v,) for v in sorted(values)], "v double").select("v", octaves(F.col("v")).alias("b")).orderBy("v").collect()]
    assert found == sorted(found) and len(set(found)) > 200
    assert [r[0] for r in spark.createDataFrame([(None,), (float("nan"),)], "v double").select(octaves(F.col("v"))).collect()] == [-(10**9), 10**9]
