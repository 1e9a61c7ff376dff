"""Streams of epochs, batches of an epoch, saved models, and many patches."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from residua import contracts
from residua.operators import batches, runs, synth
from residua.sources import models
from residua.streaming import early_stopping

MADE = {"epoch": 3, "selection_key": "val_dice", "selection_value": 0.5, "val_loss": None, "git_sha": "abc", "seed": 42, "split_hash": "h", "synth": {"alpha": 0.5}, "train": {}}
EPOCHS = "run string, at timestamp, epoch long, score double"


def epochs_of(rng):
    rows = []
    for run in range(6):
        score = 0.0
        for epoch in range(25):
            score += rng.choice([0.1, 0.1, -0.1, 0.0])
            rows.append((f"r{run}", 60 * epoch + run, epoch, rng.choice([score, score, score, None])))
    return rows


@pytest.mark.parametrize("patience,seed,mode", [(2, 1, "max"), (4, 2, "max"), (3, 3, "min")])
def test_stream_of_shuffled_epochs_stops_as_the_batch(spark, tmp_path, patience, seed, mode):
    rng = random.Random(seed)
    rows = epochs_of(rng)
    frame = lambda own: spark.createDataFrame(own, "run string, s long, epoch long, score double").select("run", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "epoch", "score")
    # Epochs come up to ten minutes late, some of them twice, in several files.
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 500))
    late = [x for r in late for x in ([r, r] if rng.random() < 0.2 else [r])]
    cut = len(late) // 4
    for i in range(4):
        frame(late[i * cut : (i + 1) * cut if i < 3 else None]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame([("last", 10**6, 0, None)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EPOCHS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"stops_{patience}"
    query = early_stopping.stream_stops(stream, "run", "at", "epoch", "score", patience, mode=mode).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    found = {(r["run"], r["epoch"]) for r in spark.table(name).collect()}
    judged = frame(rows).withColumn("score", F.col("score") * (1 if mode == "max" else -1))
    wanted = {(r["run"], r["epoch"]) for r in runs.stopped_at(judged, "run", ["at", "epoch"], "score", patience).collect()}
    assert found == wanted and len(found) > 0
    assert spark.table(name).count() == len(found)


def test_stream_needs_patience_and_its_store(spark, tmp_path):
    stream = spark.readStream.schema(EPOCHS).parquet(str(tmp_path))
    with pytest.raises(contracts.ConfigError, match="patience"):
        early_stopping.stream_stops(stream, "run", "at", "epoch", "score", 0)


@pytest.mark.parametrize("split", ["train", "val"])
def test_batches_do_not_depend_on_partitions(spark, split):
    rng = random.Random(4)
    keys = rng.sample([f"case_training_{i:03d}" for i in range(400)], 103)
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, n int")
    found = [{r["k"]: (r["batch"], r["place"]) for r in batches.epoch_batches(frame.repartition(p), "k", split, 4).collect()} for p in (1, 16)]
    assert found[0] == found[1]
    order = sorted(found[0], key=found[0].get)
    assert sorted(found[0].values()) == [(i // 4, i % 4) for i in range(103)]
    assert (order == sorted(keys)) == (split != "train")
    if split == "train":
        again = {r["k"]: (r["batch"], r["place"]) for r in batches.epoch_batches(frame, "k", split, 4, epoch=1).collect()}
        assert again != found[0] and again.keys() == found[0].keys()


def test_batches_of_numbers_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(i * 3 - 20,) for i in range(30)] + [(None,)], "k long")
    found = sorted((r["batch"], r["place"], r["k"]) for r in batches.epoch_batches(frame.repartition(5), "k", "test", 7).filter("k is not null").collect())
    assert [k for *_, k in found] == [i * 3 - 20 for i in range(30)] and found[0][:2] == (0, 1)
    for split in ("train", "val"):
        assert batches.epoch_batches(frame.filter("false"), "k", split, 7).count() == 0
        assert batches.epoch_batches(spark.createDataFrame([(k,) for k in ["é", "a", "", "a"]], "k string"), "k", split, 2).count() == 4
    with pytest.raises(contracts.ConfigError):
        batches.epoch_batches(frame, "k", "all", 7)
    with pytest.raises(contracts.ConfigError):
        batches.epoch_batches(frame, "k", "val", 0)


def test_first_batch_is_checked(spark):
    data = [(f"v{i}", z, [0.5] * 4) for i in range(4) for z in range(2)]
    schema = "k string, slice_index int, pixels array<float>"
    frame = spark.createDataFrame(data, schema)
    numbered = batches.epoch_batches(frame.select("k").distinct(), "k", "val", 2)
    assert batches.require_first_batch(frame, numbered, "k", "pixels", 2, 4) is numbered
    for bad, message in (((("v1", 1, [0.5] * 3)), "pixels"), (("v1", 1, [0.5, 2.0, 0.5, 0.5]), r"\[0.0, 1.0\]"), (("v0", 1, [0.5, float("nan"), 0.5, 0.5]), "NaN")):
        broken = spark.createDataFrame([r for r in data if r[:2] != bad[:2]] + [bad], schema)
        with pytest.raises(contracts.DataError, match=message):
            batches.require_first_batch(broken, numbered, "k", "pixels", 2, 4)
    later = spark.createDataFrame([r for r in data if r[0] != "v3"] + [("v3", 0, [9.0])], schema)
    assert batches.require_first_batch(later, numbered, "k", "pixels", 2, 4) is numbered
    with pytest.raises(contracts.DataError, match="array<float>"):
        batches.require_first_batch(frame.withColumn("pixels", F.col("pixels").cast("array<double>")), numbered, "k", "pixels", 2, 4)


def test_trees_are_saved_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), float(i % 7 > 3)) for i in range(60)], "a double, y double")
    data = VectorAssembler(inputCols=["a"], outputCol="f").transform(rows)
    model = GBTClassifier(featuresCol="f", labelCol="y", maxIter=2, seed=1).fit(data)
    path = str(tmp_path / "model")
    models.save_model(model, path, MADE)
    again, told = models.load_model(GBTClassificationModel, path, split_hash="h")
    assert told == MADE and again.transform(data).select("probability").collect() == model.transform(data).select("probability").collect()
    with pytest.raises(contracts.ArtifactError, match="split_hash"):
        models.load_model(GBTClassificationModel, path, split_hash="other")
    with pytest.raises(contracts.ArtifactError, match="wanted .*LogisticRegressionModel"):
        models.load_model(LogisticRegressionModel, path)
    with pytest.raises(contracts.ArtifactError, match="lacks or adds .'extra', 'seed'"):
        models.save_model(model, path, {k: v for k, v in MADE.items() if k != "seed"} | {"extra": 1})
    with pytest.raises(contracts.ArtifactError, match="no model"):
        models.load_model(GBTClassificationModel, str(tmp_path / "none"))
    for content, message in ((b"version https://git-lfs.github.com/spec/v1\noid x\n", "stub"), (b"\x93NUMPY", "foreign"), (b'{"version": "x"}', "foreign")):
        (tmp_path / "model/MODEL").write_bytes(content)
        with pytest.raises(contracts.ArtifactError, match=message):
            models.load_model(GBTClassificationModel, path)


def test_components_are_saved_and_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    mean, parts, path = rng.standard_normal(30), rng.standard_normal((30, 4)), str(tmp_path / "pca")
    models.save_components(spark, mean, parts, path, MADE)
    found = models.load_components(spark, path, pixels=30, k=4, seed=42)
    assert np.array_equal(found[0], mean) and np.array_equal(found[1], parts) and found[2] == MADE
    for wanted in ({"k": 5}, {"pixels": 29}, {"seed": 1}):
        with pytest.raises(contracts.ArtifactError):
            models.load_components(spark, path, **wanted)
    with pytest.raises(contracts.ArtifactError, match="no components"):
        models.load_components(spark, str(tmp_path / "none"))
    with pytest.raises(contracts.ArtifactError, match="does not fit"):
        models.save_components(spark, mean[:5], parts, path, MADE)


def test_ten_thousand_patches_a_volume(spark):
    rng = np.random.default_rng(6)
    shape, n = (12, 20, 20), 10_000
    low = np.stack([rng.integers(0, s, n) for s in shape], axis=1)
    high = np.minimum(low + rng.integers(0, 6, (n, 3)), shape)  # some are empty
    alpha = rng.integers(1, 90, n) / 100
    wanted, number = np.zeros(shape), np.full(shape, -1)
    for no in range(n):
        box = tuple(slice(a, b) for a, b in zip(low[no], high[no], strict=True))
        over = alpha[no] >= wanted[box]
        wanted[box], number[box] = np.where(over, alpha[no], wanted[box]), np.where(over, no, number[box])
    rows = [("s", no, *(int(x) for pair in zip(low[no], high[no], strict=True) for x in pair), float(alpha[no])) for no in range(n)]
    patches = spark.createDataFrame(rows, "k string, no int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, alpha double")
    voxels = spark.createDataFrame([(k, z, y, x, 1.0, 0.0) for k in ("s", "t") for z in range(12) for y in range(20) for x in range(20)], "k string, slice_index long, y long, x long, v double, donor_v double")
    for cell in ((4, 8, 8), (3, 5, 7)):
        for r in synth.blend_by_table(voxels, patches, "k", cell=cell).collect():
            if r["k"] == "t":
                assert (r["mask"], r["patch_no"], r["blended"]) == (0.0, None, 1.0)
            else:
                at = r["slice_index"], r["y"], r["x"]
                assert r["mask"] == wanted[at] and (r["patch_no"] if r["patch_no"] is not None else -1) == number[at] and r["blended"] == pytest.approx(1 - wanted[at])
    many = patches.withColumn("no", F.col("no") * 0 + 7).limit(1).crossJoin(spark.range(5000)).drop("id")  # the same box over and over
    assert synth.patches_by_cell(many, "k").agg(F.max(F.size("_boxes"))).first()[0] == 1


def test_corruption_depends_on_seed_and_item_alone(spark):
    items = spark.range(4000)
    found = {r["id"]: r["corrupt"] for r in synth.corrupted(items, "id", 0.3).collect()}
    assert found == {r["id"]: r["corrupt"] for r in synth.corrupted(items.repartition(7), "id", 0.3).collect()}
    assert 1000 < sum(found.values()) < 1400
    assert {r["corrupt"] for r in synth.corrupted(items, "id", 1.0).collect()} == {True}
