"""Folds by profiles, cross-validation over one held frame, components by blocks."""

import random

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from residua import contracts
from residua.operators import cv, held, reconstruct


def spread_of(profiles, quotas):
    """Sum over classes of the deviation of the folds' shares."""
    counts = np.array([[p[c] for p in profiles] for c in (0, 1)]) @ np.array(quotas)
    shares = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    return shares.std(axis=1).sum()


def one_by_one(profiles, n_folds, rng):
    """The greedy choice over every single group."""
    groups = [p for p in profiles for _ in range(p[2])]
    rng.shuffle(groups)
    groups.sort(key=lambda p: -abs(p[0] - p[1]))
    totals = np.maximum(1, [sum(p[c] for p in groups) for c in (0, 1)])
    counts = np.zeros((n_folds, 2))
    for p in groups:
        after = (counts[None] + np.eye(n_folds)[:, :, None] * [p[0], p[1]]) / totals
        fold = min(range(n_folds), key=lambda f: (round(after.std(axis=1).sum(axis=1)[f], 12), counts[f].sum(), f))
        counts[fold] += p[:2]
    return (counts / totals).std(axis=0).sum()


@pytest.mark.parametrize("seed", range(10))
def test_quotas_spread_as_evenly_as_single_groups(seed):
    rng = random.Random(seed)
    profiles = sorted({(rng.randint(0, 9), rng.randint(0, 4)) for _ in range(12)})
    profiles = [(a, b, rng.choice([1, 2, 7, 60, 300])) for a, b in profiles]
    quotas = cv.fold_quotas(profiles, 5)
    assert [sum(q) for q in quotas] == [m for *_, m in profiles] and min(min(q) for q in quotas) >= 0
    # The loop's own spread depends on how it shuffles groups of equal difference.
    assert spread_of(profiles, quotas) <= max(one_by_one(profiles, 5, rng) for _ in range(6)) + 1e-3


def test_quotas_do_not_take_a_step_per_group():
    quotas = cv.fold_quotas([(20, 3, 10**12 + 3), (5, 5, 10**11)], 5)
    assert [sum(q) for q in quotas] == [10**12 + 3, 10**11] and max(quotas[0]) - min(quotas[0]) <= 1


@pytest.mark.parametrize("parts", [1, 16])
def test_folds_of_a_hot_profile(spark, parts):
    rng = random.Random(3)
    sizes = [(20, 2)] * 300 + [(rng.randint(1, 30), rng.randint(0, 9)) for _ in range(200)]
    rows = [(g, y) for g, (a, b) in enumerate(sizes) for y in [0] * a + [1] * b]
    frame = spark.createDataFrame(rows, "g long, y int").repartition(parts)
    folds = {r["g"]: r["fold"] for r in cv.stratified_group_folds(frame, "g", "y").collect()}
    assert set(folds) == set(range(500)) and set(folds.values()) == set(range(5))
    positives = [sum(sizes[g][1] for g, f in folds.items() if f == k) for k in range(5)]
    totals = [sum(sum(sizes[g]) for g, f in folds.items() if f == k) for k in range(5)]
    assert max(positives) - min(positives) <= 6 and max(totals) - min(totals) <= 40
    assert sum(folds.values()) == test_folds_of_a_hot_profile.__dict__.setdefault("same", sum(folds.values()))
    other = {r["g"]: r["fold"] for r in cv.stratified_group_folds(frame, "g", "y", seed=7).collect()}
    assert other != folds
    with pytest.raises(contracts.DataError, match="5 folds"):
        cv.stratified_group_folds(frame.filter("g < 3"), "g", "y")


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((240, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(240) > 0.4).astype(int)
    return spark.createDataFrame([(i, i % 4, int(y[i]), *map(float, x[i])) for i in range(240)], "id long, fold int, y int, a double, b double, c double")


def test_cross_validation_reads_its_input_once(spark, samples, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    counted = samples.mapInArrow(count, samples.schema)
    scored = cv.boosted_oof(counted, ["a", "b", "c"], "y", "fold", ["id"], max_iter=3)
    found = {r["id"]: r["y_score"] for r in scored.collect()}
    assert read.value == 240 and len(found) == 240
    assert not counted.storageLevel.useMemory and "InMemoryTableScan" not in scored._jdf.queryExecution().executedPlan().toString()
    assembled = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_f").transform(samples)
    weights = {r[0]: r[1] for r in cv.scale_pos_weight(samples, "fold", "y").collect()}
    for f in range(4):
        train = assembled.filter(F.col("fold") != f).select("_f", F.col("y").cast("double").alias("_y"), F.when(F.col("y") == 1, weights[f]).otherwise(1.0).alias("_w"))
        model = GBTClassifier(featuresCol="_f", labelCol="_y", weightCol="_w", maxIter=3, maxDepth=3, seed=42).fit(train)
        for r in model.transform(assembled.filter(F.col("fold") == f)).select("id", vector_to_array("probability")[1].alias("p")).collect():
            assert found[r["id"]] == pytest.approx(r["p"], abs=1e-9)


def test_held_frames_are_released(spark):
    frame = spark.range(50).withColumn("k", F.col("id") % 10)
    with held.held(frame, StorageLevel.DISK_ONLY) as kept:
        assert kept.count() == 50 and frame.storageLevel.useDisk
    assert not frame.storageLevel.useDisk
    with pytest.raises(ValueError, match="x"), held.held(frame) as kept:
        raise ValueError("x")
    assert not frame.storageLevel.useMemory


@pytest.mark.parametrize("rate", [0.0, 0.5, 1.0])
def test_a_share_of_volumes_is_made_once(spark, rate):
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame([(f"v{i}", i) for i in range(200)] + [(None, 0)], "v string, n int")
    frame = source.mapInArrow(work, source.schema)
    kept_keys = source.filter(F.coalesce(F.pmod(F.xxhash64(F.lit(42), "v"), F.lit(1 << 20)) < round(rate * (1 << 20)), F.lit(False))).count()
    with held.held_share(frame, "v", rate) as rows:
        for _ in range(3):
            assert sorted((r["v"] or "", r["n"]) for r in rows.collect()) == sorted((r["v"] or "", r["n"]) for r in source.collect())
    # Each epoch passes over the source for what is not kept; only the first for what is.
    assert abs(kept_keys - 200 * rate) < 30 and (made.value == 3 * 201 + 201 or rate in (0.0, 1.0))
    with pytest.raises(contracts.ConfigError):
        held.held_share(frame, "v", 1.5).__enter__()


def angle(a, b):
    """Sine of the largest angle between two subspaces."""
    a, b = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(b - a @ (a.T @ b), 2)


def test_components_of_full_slices(spark):
    rng, n, side, k = np.random.default_rng(7), 60, 128, 5
    factors = rng.standard_normal((n, 12)) * (0.7 ** np.arange(12)) * 3
    data = factors @ rng.standard_normal((12, side * side)) + 0.01 * rng.standard_normal((n, side * side)) + 4
    frame = spark.createDataFrame([(row.tolist(),) for row in data], "pixels array<double>").repartition(6)
    mean, found = reconstruct.pca_components(frame, k)
    assert np.abs(mean - data.mean(axis=0)).max() < 1e-9
    wanted = np.linalg.svd(data - data.mean(axis=0), full_matrices=False)[2][:k].T
    assert found.shape == (side * side, k) and angle(found, wanted) < 1e-6
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-9


def test_components_equal_those_of_the_covariance(spark):
    rng = np.random.default_rng(9)
    data = rng.standard_normal((200, 24)) * np.linspace(3, 0.1, 24)
    frame = spark.createDataFrame([(row.tolist(),) for row in data], "pixels array<double>")
    model = PCA(k=6, inputCol="v", outputCol="p").fit(frame.select(array_to_vector("pixels").alias("v"))).pc.toArray()
    _, found = reconstruct.pca_components(frame, 6)
    assert angle(found, model) < 1e-6
    assert np.abs(np.abs((found * model).sum(axis=0)) - 1).max() < 1e-6


def test_components_of_few_dimensions(spark):
    data = [[1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0], [3.0, 6.0, 9.0, 12.0]]
    mean, found = reconstruct.pca_components(spark.createDataFrame([(r,) for r in data], "pixels array<double>"), 3)
    assert mean.tolist() == [2.0, 4.0, 6.0, 8.0] and found.shape == (4, 3)
    assert np.abs(found[:, 0] - np.array([1, 2, 3, 4]) / np.sqrt(30)).max() < 1e-9
    same = spark.createDataFrame([([1.0, 1.0],)] * 3, "pixels array<double>")
    assert reconstruct.pca_components(same, 1)[1].shape == (2, 1)
    with pytest.raises(contracts.DataError):
        reconstruct.pca_components(same.filter("false"), 1)
    with pytest.raises(contracts.ConfigError):
        reconstruct.pca_components(same, 3)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_blocks_are_added_in_a_tree(spark, fan_in):
    data = np.random.default_rng(1).standard_normal((100, 7))
    frame = spark.createDataFrame([(row.tolist(),) for row in data], "pixels array<double>").repartition(23)
    assert np.allclose(reconstruct.summed_blocks(frame, lambda x: (x.T @ x).ravel(), 7, fan_in=fan_in).reshape(7, 7), data.T @ data)
    with pytest.raises(Exception, match="no 5 pixels"):
        reconstruct.summed_blocks(frame, lambda x: x.sum(axis=0), 5)
