"""Guards, losses, files of volumes, and small operators by closed forms."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua import contracts
from residua.functions import scalar
from residua.operators import choose, depth, held, metrics, preprocess, report, runs, thresholds, validate
from residua.sources import artifacts, committed, volume_source, volumes


def test_only_finite_slices_are_rendered(spark):
    frame = spark.createDataFrame([("a", 0, [0.1, 0.2], [1.0]), ("a", 1, [float("nan"), 0.2], [1.0]), ("a", 2, [0.1], [float("-inf")]), ("a", 3, None, [1.0]), ("b", 0, [None, 1.0], [1.0])], "v string, slice_index long, original array<double>, mask array<double>")
    check = lambda *at: validate.require_renderable(frame, ["v", "slice_index"], ["original", "mask"], "v", *at)
    assert check("a", 0).count() == 1
    for at, message in ((("a", 1), "original"), (("a", 2), "mask"), (("a", 3), "original"), (("b", 0), "original"), (("a", 9), "it has 4 slices"), (("c", 0), "it has 0")):
        with pytest.raises(contracts.DataError, match=message):
            check(*at)


def test_results_are_paths_not_models(spark, tmp_path):
    assert validate.require_stored(str(tmp_path), "x") == str(tmp_path) == validate.require_stored(tmp_path, "x")
    for wrong in (spark.range(1), lambda x: x, None):
        with pytest.raises(contracts.ConfigError, match="scores reads stored results"):
            validate.require_stored(wrong, "scores")
    with pytest.raises(contracts.ConfigError):
        artifacts.read_results(spark, spark.range(1))


@pytest.mark.parametrize("p", [0.0, 50.0, 90.0, 99.0, 99.99, 100.0])
@pytest.mark.parametrize("block", [1, 50, 1 << 16])
def test_percentile_of_a_zero_background(spark, monkeypatch, p, block):
    monkeypatch.setattr(thresholds, "BLOCK", block)
    rng = np.random.default_rng(4)
    data = {"zeros": np.zeros(301), "mixed": np.where(rng.random(400) < 0.8, 0.0, rng.random(400)), "close": 1 + rng.integers(0, 9, 200) * 1e-9, "one": np.array([0.5])}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    found = thresholds.percentile_mask(spark.createDataFrame(rows, "k string, flat long, residual double").repartition(4), "k", "flat", p)
    flagged = {k: sorted(r["flat"] for r in found.collect() if r["k"] == k and r["flagged"]) for k in data}
    assert found.count() == len(rows) and found.columns == ["k", "flat", "residual", "flagged"] or set(found.columns) == {"k", "flat", "residual", "flagged"}
    for k, x in data.items():
        n = int(np.rint(len(x) * (100.0 - p) / 100.0))
        assert flagged[k] == sorted(np.argsort(-x, kind="stable")[:n].tolist())


def test_files_appear_together_or_not(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 2}/f{i}", bytes([i])) for i in range(20)], "name string, content binary").repartition(4)
    committed.save_files(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["d0", "d1"] and (tmp_path / "out/d1/f3").read_bytes() == b"\x03"
    with pytest.raises(Exception, match="written twice"):
        committed.save_files(rows.limit(1), str(tmp_path / "out"))
    committed.save_files(rows.limit(1), str(tmp_path / "out"), overwrite=True)
    with pytest.raises(Exception, match="written twice"):
        committed.save_files(rows.union(rows), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="boom"):
        committed.save_files(rows.withColumn("content", F.when(F.col("name") == "d1/f7", F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.col("content"))), str(tmp_path / "broken"))
    assert [x for x in os.listdir(tmp_path / "broken") if not x.startswith(".")] == [] if (tmp_path / "broken").exists() else True
    with pytest.raises(Exception, match="no name of a file"):
        committed.save_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), str(tmp_path / "up"))
    with pytest.raises(Exception, match="files need"):
        committed.save_files(spark.range(1), str(tmp_path / "ids"))


def test_volumes_go_to_files_and_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"s{v}", z, rng.random(12).tolist()) for v in range(3) for z in range(5)]
    frame = spark.createDataFrame(rows, "k string, slice_index int, pixels array<double>").repartition(4)
    committed.save_files(volumes.volumes_as_npy(frame, "k", 3, 4), str(tmp_path / "v"))
    back = {(r["volume_id"], r["slice_index"]): r["pixels"] for r in volume_source.scan_slices(spark, str(tmp_path / "v")).collect()}
    assert back == {(k, z): pytest.approx(p) for k, z, p in rows}
    with pytest.raises(Exception, match="no 4 by 4 pixels"):
        volumes.volumes_as_npy(frame, "k", 4, 4).collect()


def test_weighted_loss(spark):
    rng = np.random.default_rng(6)
    pairs = [(i, *rng.random((2, 9 * 8)).tolist()) for i in range(4)] + [(9, [0.5] * 72, [0.5] * 72)]
    frame = spark.createDataFrame(pairs, "n long, original array<double>, reconstruction array<double>")
    for r in metrics.ssim_mse_by_slice(frame, ["n"], 9, 8, window=7, alpha=0.3).collect():
        a, b = (np.array(x).reshape(9, 8) for x in dict((n, (o, c)) for n, o, c in pairs)[r["n"]])
        assert r["mse"] == pytest.approx(((a - b) ** 2).mean()) and r["ssim"] == pytest.approx(metrics.ssim_value(a, b, 7))
        assert r["loss"] == pytest.approx(0.3 * (1 - r["ssim"]) + 0.7 * r["mse"])
    assert metrics.ssim_mse_by_slice(frame, ["n"], 9, 8, window=7).filter("n = 9").first()["loss"] == pytest.approx(0.0)
    with pytest.raises(contracts.ConfigError):
        metrics.ssim_mse_loss(F.lit(0.0), F.lit(1.0), 1.5)
    batch = pd.DataFrame({"subject": ["s"], "slice_index": [3], "original": [pairs[0][1]], "reconstruction": [pairs[0][2]]})
    found = next(metrics.ssim_arrow(iter([batch]), 9, 8, 7))
    assert found.loc[0, "ssim"] == pytest.approx(metrics.ssim_value(*(np.array(x).reshape(9, 8) for x in pairs[0][1:]), 7)) and found.loc[0, "slice_index"] == 3


def test_axes_scales_and_chunks(spark):
    frame = spark.createDataFrame([("s", 1, 2, 3, 0.5)], "subject string, a int, b int, c int, v double")
    assert preprocess.permute_axes(frame, ["c", "a", "b"]).select("z", "y", "x", "v").first() == (3, 1, 2, 0.5)
    values = spark.createDataFrame([(v,) for v in (-3.0, -1.0, 0.0, 0.25, 1.0, 7.0)], "v double")
    assert [r[0] for r in values.select(scalar.rescale_signed(F.col("v"))).collect()] == [-1.0, -1.0, -1.0, -0.5, 1.0, 1.0]
    assert [r[0] for r in values.select(scalar.rescale_unit(F.col("v"))).collect()] == [0.0, 0.0, 0.5, 0.625, 1.0, 1.0]
    slices = spark.range(40).select(F.col("id").alias("slice_index"))
    chunk, z = preprocess.chunk_columns(F.col("slice_index"))
    again = preprocess.reassemble(slices.select(F.col("slice_index").alias("was"), chunk.alias("chunk_index"), z.alias("z")))
    assert again.filter("slice_index <> was").isEmpty() and again.count() == 40
    assert sorted(r[0] for r in depth.explicit_depths(slices, 3, 6).collect()) == [3, 4, 5, 6]
    epochs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, loss double")
    assert {r["k"]: r["mean_loss"] for r in runs.mean_loss(epochs, "k", "loss").collect()} == {"a": 1.5, "b": None}


def test_thresholds_by_configuration(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("a", 10, float("nan"))], "k string, flat long, residual double").filter("not isnan(residual)")
    flagged = lambda node: sorted(r["flat"] for r in choose.from_config(node)(rows, "k", "flat").filter("flagged").collect())
    assert flagged({"target": "percentile", "params": {"percentile": 80.0}}) == [8, 9]
    assert flagged({"target": "absolute", "params": {"value": 6.5}}) == [7, 8, 9]
    assert flagged({"target": "otsu"}) == sorted(r["flat"] for r in thresholds.otsu_mask(rows, "k").filter("flagged").collect())
    for bad in ({"target": "os.system"}, {"target": "percentile"}, {"target": "absolute", "params": {"value": 1, "voxels": 2}}, {"target": "otsu", "then": 1}, {}):
        with pytest.raises(contracts.ConfigError):
            choose.from_config(bad)


def test_scratch_is_dropped_when_old(spark):
    path = held.scratch_path(spark, "rows")
    spark.range(3).write.parquet(path)
    own = path.removeprefix("file:")
    kept = os.path.join(os.path.dirname(own), "kept-by-hand")
    os.makedirs(kept, exist_ok=True)
    assert os.path.basename(path) not in held.drop_scratch(spark)
    os.utime(own, (1, 1))
    assert os.path.basename(path) in held.drop_scratch(spark)
    assert not os.path.exists(own) and os.path.exists(kept)


def test_settings_are_told_all_at_once():
    good = {"donor_alignment": "same", "selection_mode": "min", "selection_key": "val_loss", "init_from": "x", "other": object()}
    assert validate.require_settings(good) is good
    assert validate.require_settings({"selection_key": "val_dice", "validate_fn": print})
    with pytest.raises(contracts.ConfigError, match="donor_chunk .*'near'; warm_start_from and init_from .*; selection_key='val_dice' needs validate_fn"):
        validate.require_settings({"donor_chunk": "near", "warm_start_from": "a", "init_from": "b", "selection_key": "val_dice"})
    assert validate.frame_size(12.8, 7.2, 100) == (1280, 720)
    for bad in ((1.5, 1.0, 50), (1.01, 1.0, 10), (0.0, 1.0, 10)):
        with pytest.raises(contracts.ConfigError, match="not even"):
            validate.frame_size(*bad)


def test_slices_of_one_size(spark):
    frame = spark.createDataFrame([("a", 8, 8), ("b", 8, 8)], "k string, height int, width int")
    assert validate.require_size(frame, "k", 8, 8) is frame
    with pytest.raises(contracts.DataError, match="'c' has slices of 8 by 9"):
        validate.require_size(frame.union(spark.createDataFrame([("c", 8, 9), ("d", 1, 1)], frame.schema)), "k", 8, 8)
    with pytest.raises(contracts.DataError, match="no slices"):
        validate.require_size(frame.filter("false"), "k", 8, 8)


def test_stored_volume_metrics_mark_context(spark, tmp_path):
    report.save_per_volume(spark.createDataFrame([("v", 0.5, 0.4, 20.0, 0.9)], contracts.VOLUME_METRICS), str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/per_volume.csv")
    assert back.columns == ["volume_id", "dice", "iou", "psnr_db_context_only", "ssim_context_only"] and back.first()["ssim_context_only"] == "0.9"
