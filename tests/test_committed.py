"""Documents and versions: whole, or not there; and what a document must tell."""

import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from residua import contracts
from residua.operators import compare, documents, metrics, report
from residua.sources import artifacts, committed

ROOT = str(Path(__file__).resolve().parent.parent)
KEY = {"split_hash": "h", "levels": "32"}
KILLED = """
import os, signal, sys
from residua.session import local_session
from residua.sources import artifacts, committed
spark = local_session(2, "1g")
committed.publish = lambda *a: os.kill(os.getpid(), signal.SIGKILL)
artifacts.save_feature_cache(spark.range(1000).repartition(5), sys.argv[1], {"split_hash": "new", "levels": "32"})
"""


def test_a_kill_before_the_pointer_moves_leaves_the_old_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    artifacts.save_feature_cache(spark.range(7), path, KEY)
    ended = subprocess.run([sys.executable, "-c", KILLED, path], cwd=ROOT, timeout=200, capture_output=True, check=False)
    assert ended.returncode == -signal.SIGKILL
    assert len(list((tmp_path / "cache/versions").iterdir())) == 2  # the second was written
    assert artifacts.feature_cache(spark, path, KEY).count() == 7
    with pytest.raises(contracts.ArtifactError, match="levels"):
        artifacts.feature_cache(spark, path, KEY | {"levels": "16"})
    artifacts.save_feature_cache(spark.range(9), path, KEY)
    assert artifacts.feature_cache(spark, path, KEY).count() == 9


def test_half_a_version_is_not_published(spark, tmp_path):
    path = str(tmp_path)
    version = committed.save_version(spark.range(3), path)
    (tmp_path / "versions/half").mkdir()
    (tmp_path / "versions/half/part-0.parquet").write_bytes(b"x")
    with pytest.raises(contracts.ArtifactError, match="not written whole"):
        committed.publish(path, "half")
    assert committed.current(path)["version"] == version
    (tmp_path / "versions" / version / "part-stray.parquet").write_bytes(b"left by a lost task")
    assert committed.load_version(spark, path).count() == 3  # only what the pointer names is read
    (tmp_path / "CURRENT").write_text("{")
    with pytest.raises(contracts.ArtifactError, match="malformed"):
        committed.current(path)
    assert committed.load_version(spark, str(tmp_path / "none")) is None


def test_old_versions_go_but_not_young_or_current_ones(spark, tmp_path):
    names = [committed.save_version(spark.range(i + 1), str(tmp_path)) for i in range(4)]
    assert committed.drop_old_versions(str(tmp_path)) == []
    for i, name in enumerate(names):
        os.utime(tmp_path / "versions" / name, (time.time() - 9000 + i,) * 2)
    assert sorted(committed.drop_old_versions(str(tmp_path))) == sorted(names[:2])
    assert committed.load_version(spark, str(tmp_path)).count() == 4
    assert committed.load_version(spark, str(tmp_path)).filter("id = 3").count() == 1


def test_a_document_is_old_until_its_commit(tmp_path):
    path = str(tmp_path / "a.json")
    committed.write_text(path, "old\n")
    writer = committed.DocumentWriter(path, "json", ["a", "b"])
    message = writer.write(iter([Row(a=1, b=[Row(c=float("nan"))])]))
    assert Path(path).read_text() == "old\n"
    writer.abort([message, None])
    assert os.listdir(tmp_path) == ["a.json"]
    message = writer.write(iter([Row(a=None, b=[])]))
    writer.commit([message, committed.Written(None, 0)])
    assert json.loads(Path(path).read_text()) == {"a": None, "b": []} and os.listdir(tmp_path) == ["a.json"]
    two = [writer.write(iter([Row(a=1, b=[])])) for _ in range(2)]
    with pytest.raises(contracts.ArtifactError, match="one task"):
        writer.commit(two)
    assert os.listdir(tmp_path) == ["a.json"]


def test_documents_of_spark(spark, tmp_path):
    frame = spark.createDataFrame([(1, "x,\"y\"\nz", True, None), (2, None, False, 0.1)], "n int, t string, b boolean, d double")
    committed.save_document(frame.repartition(2).orderBy("n"), str(tmp_path / "deep/t.csv"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(frame.schema).csv(str(tmp_path / "deep/t.csv"))
    assert back.collect() == frame.collect()
    committed.save_document(frame.filter("n > 5"), str(tmp_path / "deep/t.csv"), "csv")
    assert (tmp_path / "deep/t.csv").read_text() == "n,t,b,d\n"
    committed.save_document(frame.select(F.struct("*").alias("s"), F.map_from_arrays(F.array(F.lit("k")), F.array("n")).alias("m")), str(tmp_path / "t.json"))
    assert json.loads((tmp_path / "t.json").read_text().splitlines()[1]) == {"s": {"n": 2, "t": None, "b": False, "d": 0.1}, "m": {"k": 2}}
    with pytest.raises(Exception, match="json, csv or text|is one of"):
        committed.save_document(frame, str(tmp_path / "t.bin"), "bin")
    assert sorted(os.listdir(tmp_path)) == ["deep", "t.json"]


def test_a_failing_task_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "d.json")
    committed.write_text(path, "old")
    with pytest.raises(Exception, match="boom"):
        committed.save_document(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.lit("x")).alias("t")), path)
    assert Path(path).read_text() == "old"


def test_feature_keys_name_what_shapes_the_features():
    shaping = {"subject_limit": None, "drop_empty_slices": True, "label_threshold_voxels": 10}
    a = artifacts.feature_key("slice", "h", 42, ["x", "y"], **shaping)
    assert a != artifacts.feature_key("slice", "h", 42, ["x", "y"], **shaping | {"subject_limit": 10})
    assert a == artifacts.feature_key("slice", "h", 42, ["x", "y"], **shaping) and all(isinstance(v, str) for v in a.values())
    with pytest.raises(contracts.ArtifactError, match="subject_limit"):
        artifacts.feature_key("slice", "h", 42, ["x"], drop_empty_slices=True, label_threshold_voxels=1)


def test_aggregates_name_their_run(spark, tmp_path):
    frame = spark.createDataFrame([(0.6, 0.5, 20.0, 0.9)] * 2, "dice double, iou double, psnr_db double, ssim double")
    found = metrics.aggregate_metrics(frame, ["dice", "iou", "psnr_db", "ssim"])
    identity = {"mode": "recon", "model": "unetr", "loss": "mse", "split": "test", "split_hash": "h", "run_id": "r", "results_run_id": None}
    report.save_aggregate(found, 0.5, identity, str(tmp_path))
    stored = json.loads((tmp_path / "aggregate.json").read_text())
    assert stored["cell_id"] == "unetr__mse" and stored["results_run_id"] is None and stored["n_volumes"] == 2
    assert stored["headline"]["dice"] == {"mean": 0.6, "std": 0.0} and stored["baseline_delta"]["delta"] == pytest.approx(0.1) and stored["context_only"]["note"]
    for field in ("split_hash", "loss"):
        with pytest.raises(contracts.ArtifactError, match=field):
            report.aggregate_document(found, 0.5, {k: v for k, v in identity.items() if k != field})
        with pytest.raises(contracts.ArtifactError, match=field):
            report.aggregate_document(found, 0.5, identity | {field: None})


def test_classical_documents_tell_where_they_come_from(spark, tmp_path):
    folds = spark.createDataFrame([(1, 4, 3, 0.75, 1.0, None), (0, 4, 1, 0.25, 0.5, 0.5)], "fold int, n_test long, n_test_positive long, positive_rate double, roc_auc double, pr_auc double")
    sections = {
        "split": {"split": "test", "split_hash": "h"},
        "features": {"feature_hash": "f", "feature_names": ["a", "b"], "label_threshold_voxels": 10, "drop_empty_slices": True},
        "counts": {"n_volumes": 2, "n_slices_seen": 9, "n_slices_dropped": 1, "n_samples": 8},
        "classifier": {"name": "gbt", "params": {"depth": 3}, "scale_pos_weight": [1.0, 3.0]},
    }
    documents.save_classical(folds, str(tmp_path), "r", 42, True, sections)
    stored = json.loads((tmp_path / "classical_metrics.json").read_text())
    assert {name: stored[name] for name in sections} == sections and stored["subject_limit"] is None
    assert stored["class_balance"]["per_fold_positive_rate"] == [0.25, 0.75] and [f["fold"] for f in stored["folds"]] == [0, 1]
    with pytest.raises(contracts.ArtifactError, match="not complete"):
        documents.classical_document(folds, "r", 42, True, sections, subject_limit=10)
    with pytest.raises(contracts.ArtifactError, match="counts.n_samples"):
        documents.classical_document(folds, "r", 42, True, sections | {"counts": {}})


def test_sweep_documents(spark, tmp_path):
    sweep = spark.createDataFrame([("percentile", 95.0, 0.5, 0.1, 3), ("absolute", 0.2, 0.4, 0.1, 3)], "strategy string, value double, dice_mean double, dice_std double, n_volumes long")
    report.save_sweep(sweep, sweep.limit(1), str(tmp_path), "mean", "val")
    assert (tmp_path / "threshold_sweep_mean.csv").read_text().splitlines() == ["strategy,param,value,dice_mean,dice_std,n_volumes,split", "absolute,value,0.2,0.4,0.1,3,val", "percentile,percentile,95.0,0.5,0.1,3,val"]
    assert json.loads((tmp_path / "sweep_summary.json").read_text()) == {"model": "mean", "n_volumes": 3, "split": "val", "best_strategy": "percentile", "best_param": "percentile", "best_value": 95.0, "best_dice_mean": 0.5, "best_dice_std": 0.1}
    noise = sweep.withColumn("t_noise", F.when(F.col("value") > 1, 200).otherwise(100))
    report.sweep_document(noise, noise.filter("t_noise = 200"), str(tmp_path), "val")
    assert (tmp_path / "tnoise_sweep.csv").read_text().startswith("t_noise,strategy,param,value,")
    assert json.loads((tmp_path / "tnoise_selection.json").read_text())["threshold_param"] == "percentile"
    with pytest.raises(Exception, match="no such strategy"):
        report.with_param(sweep.withColumn("strategy", F.lit("best")), "val").collect()


def test_slice_thresholds_stay_on_val(spark, tmp_path):
    tuned = spark.createDataFrame([(0.2, 1, 0, 0, 3, 1.0, 1.0, 1.0)], "threshold double, tp long, fp long, fn long, tn long, precision double, recall double, f1 double")
    documents.save_slice_tuning(tuned, str(tmp_path), "val")
    assert (tmp_path / "val/slice_thresholds.csv").read_text().splitlines()[1].endswith(",val")
    with pytest.raises(contracts.ConfigError):
        documents.save_slice_tuning(tuned, str(tmp_path), "test")


def test_predictions_are_marked_as_of_slices(spark, tmp_path):
    rows = spark.createDataFrame([(0, "v", 1, 1, 0.5)], "fold long, volume_id string, slice_index long, y_true long, y_score double")
    documents.save_predictions(rows, str(tmp_path / "oof"))
    assert artifacts.read_csv(spark, str(tmp_path / "oof"), contracts.OOF_PREDICTION).first()["granularity"] == "slice-level"


def test_a_required_override_that_is_missing_raises(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "k string, seg int")
    labels = spark.createDataFrame([("a", 1)], "k string, own int")
    found = compare.label_override(rows, labels, "k", "own", F.col("seg"))
    assert sorted((r["k"], r["label"]) for r in found.collect()) == [("a", 1), ("b", 1)]
    with pytest.raises(Exception, match="no label override for b"):
        compare.label_override(rows, labels, "k", "own", F.col("seg"), required=True).collect()
    whole = labels.union(spark.createDataFrame([("b", 0)], labels.schema))
    assert sorted((r["k"], r["label"]) for r in compare.label_override(rows, whole, "k", "own", F.col("seg"), required=True).collect()) == [("a", 1), ("b", 0)]


def test_newest_run_holds_a_file(spark, tmp_path):
    for name, files, at in (("old", ["part-0"], 100), ("new", ["part-0", "part-1"], 900), ("bare", [], 2000), ("other", ["log.txt"], 3000)):
        (tmp_path / "runs" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "runs" / name / f).write_bytes(b"x")
            os.utime(tmp_path / "runs" / name / f, (at, at))
    root = str(tmp_path / "runs")
    assert artifacts.newest_run(spark, root) == "new" and artifacts.newest_run(spark, root, run_id="old") == "old"
    assert artifacts.newest_run(spark, root, "*.txt") == "other"
    for bad in ({"run_id": "bare"}, {"run_id": "none"}, {"glob": "*.pt"}):
        with pytest.raises(contracts.ArtifactError):
            artifacts.newest_run(spark, root, **bad)
    with pytest.raises(contracts.ArtifactError):
        artifacts.newest_run(spark, str(tmp_path / "nowhere"))


def test_summaries_come_from_stored_documents(spark, tmp_path):
    with pytest.raises(contracts.ArtifactError, match="no aggregate.json"):
        documents.save_aggregate_summary(str(tmp_path))
    frame = spark.createDataFrame([(0.6, 0.5, 20.0, 0.9)], "dice double, iou double, psnr_db double, ssim double")
    identity = {"mode": "recon", "model": "unetr", "loss": "mse", "split": "test", "split_hash": "h", "run_id": "r", "results_run_id": "s"}
    report.save_aggregate(metrics.aggregate_metrics(frame, ["dice", "iou", "psnr_db", "ssim"]), 0.65, identity, str(tmp_path))
    documents.save_aggregate_summary(str(tmp_path))
    text = (tmp_path / "summary.md").read_text()
    assert text.startswith("# unetr__mse\n") and "| dice | 0.6000 | 0.0000 |" in text and "published 0.6500: -0.0500." in text
    assert text.index("| dice |") < text.index("## Context only") < text.index("| psnr_db | 20.00 |")
    (tmp_path / "aggregate.json").write_text("{}")
    with pytest.raises(contracts.ArtifactError, match="lacks"):
        documents.save_aggregate_summary(str(tmp_path))
    (tmp_path / "classical_metrics.json").write_text("[")
    with pytest.raises(contracts.ArtifactError, match="malformed"):
        documents.save_classical_summary(str(tmp_path))
    folds = spark.createDataFrame([(0, 4, 1, 0.25, 0.5, 0.5)], "fold int, n_test long, n_test_positive long, positive_rate double, roc_auc double, pr_auc double")
    sections = {name: dict.fromkeys(fields, 8) for name, fields in documents.SECTIONS.items()}
    documents.save_classical(folds, str(tmp_path), "r", 42, False, sections, subject_limit=3)
    documents.save_classical_summary(str(tmp_path))
    text = (tmp_path / "summary.md").read_text()
    assert "8 samples, 1 positive (0.2500)" in text and "not complete" in text and "| pr_auc | 0.5000 | 0.0000 | 0.2500 |" in text


def test_scorecard_block_and_small_documents(spark, tmp_path):
    card = spark.createDataFrame([("b", None, None, "not measured"), ("a", 0.5, "a.json", None), ("c", None, "c.json", None)], "metric string, value double, source string, na_reason string")
    block = documents.scorecard_block(card, None)
    assert "| a | 0.5000 |\n| b | n/a (not measured) |\n| c | n/a (not recorded) |" in block and block.endswith("1 of 3 metrics have a value; split n/a; from a.json.")
    assert documents.scorecard_block(card, "h") in report.splice("x <!-- b --> <!-- e --> y", documents.scorecard_block(card, "h"), "<!-- b -->", "<!-- e -->")
    scores = spark.createDataFrame([("v", 1, 3, 16, 0.1875, 0.5, 1, "more")], f"{contracts.SLICE_SCORE}, extra string")
    documents.save_slice_scores(scores, str(tmp_path))
    assert artifacts.read_csv(spark, f"{tmp_path}/slice_scores.csv", contracts.SLICE_SCORE).first()["flagged_voxels"] == 3
    documents.save_legacy(spark.createDataFrame([(0.5, 3)], "dice double, n int"), str(tmp_path), "r", "m", "l")
    assert json.loads((tmp_path / "legacy_compat.json").read_text()) == {"dice": 0.5, "n": 3, "run_id": "r", "model": "m", "loss": "l"}
    with pytest.raises(contracts.ArtifactError, match="one row"):
        documents.save_legacy(card, str(tmp_path), "r", "m", "l")


@pytest.mark.parametrize("parts", [1, 9])
def test_offsets_and_ranks_of_many_keys(spark, parts):
    from residua.operators import preprocess, ranks

    depths = {f"sub-{i:04d}": 1 + i * 7 % 40 for i in range(300)}
    slices = spark.createDataFrame([(k, z) for k, d in depths.items() for z in range(d)], "subject string, slice_index long").repartition(parts)
    at, wanted = 0, {}
    for k in sorted(depths):
        n = -(-depths[k] // 16)
        wanted[k] = (n, at)
        at += n
    assert {r["subject"]: (r["n_chunks"], r["first_chunk"]) for r in preprocess.chunk_offsets(slices).collect()} == wanted
    gains = [(f"f{i}", None if i == 7 else (i * 13 % 50) / 10) for i in range(200)]
    found = [r["name"] for r in ranks.feature_rank(spark.createDataFrame(gains, "name string, gain double").repartition(parts), "name", "gain").orderBy("rank").collect()]
    assert found == [n for n, g in sorted(gains, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
