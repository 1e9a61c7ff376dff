"""Splits and grouped cross-validation."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import accumulate
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ConfigError, DataError, SplitError
from .held import held, materialized
from .prefix import ranked_by

#: Train, val and test shares of the healthy and the tumour data set.
HEALTHY_FRACTIONS = {"train": 0.85, "val": 0.15}
TUMOR_FRACTIONS = {"val": 0.2, "test": 0.8}


def seeded_split(ids: Sequence[str], fractions: dict[str, float], seed: int) -> dict[str, list[str]]:
    """Sorted ids, shuffled with the seed, cut at rounded shares; the last split takes the rest. Ids are subjects, so few."""
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ConfigError(f"shares must sum to 1, not {sum(fractions.values())}")
    order = sorted(ids)
    random.Random(seed).shuffle(order)  # fixed value: these draws over the sorted ids
    sizes = [round(share * len(order)) for share in fractions.values()][:-1]
    ends = [min(n, len(order)) for n in accumulate(sizes)] + [len(order)]
    return {name: sorted(order[a:b]) for name, a, b in zip(fractions, [0, *ends], ends, strict=False)}


def both_splits(healthy: Sequence[str], tumor: Sequence[str], seed: int) -> dict[str, dict[str, list[str]]]:
    """The split of the healthy and of the tumour data set, from one seed."""
    return {"healthy": seeded_split(healthy, HEALTHY_FRACTIONS, seed), "tumor": seeded_split(tumor, TUMOR_FRACTIONS, seed)}


def verify_split(recorded: dict, fresh: dict, override: bool = False) -> dict:
    """The recorded split if it equals the fresh one, the fresh one on override; else an error that names the parts."""
    if recorded == fresh:
        return recorded
    if override:
        return fresh
    raise SplitError(f"recorded split differs in {sorted(k for k in recorded.keys() | fresh.keys() if recorded.get(k) != fresh.get(k))}")


def hashed_split(rows: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Exact shares of any number of keys: ranks in order of a seeded hash, cut as above (`split`, one row per key).

    Ranks come from counts of hash prefixes, so no task orders all keys.
    """
    keys = rows.select(key).distinct().withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256))
    n = keys.count()
    cuts, at = [], 0
    names = list(fractions)
    for name in names[:-1]:
        at += round(fractions[name] * n)
        cuts.append((name, at))
    prefixed = keys.withColumn("_p", F.substring("_h", 1, 4))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = prefixed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = prefixed.join(F.broadcast(starts), "_p").withColumn("_rank", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_start"))
    split = F.lit(names[-1])
    for name, cut in reversed(cuts):
        split = F.when(F.col("_rank") <= cut, name).otherwise(split)
    return ranked.select(key, split.alias("split"))


#: Groups of one profile that are placed one by one for each fold, before the rest is dealt evenly.
GREEDY_ROUNDS = 8


def fold_quotas(profiles: Sequence[tuple[int, int, int]], n_folds: int) -> list[list[int]]:
    """How many of the groups of each profile (zeros, ones, number of groups) go to each fold.

    Profiles come largest difference first. A group goes to the fold after which the classes' shares
    vary least, of equal ones to the one with fewer rows, then the first. Only a few rounds of each
    profile are placed so; an even deal of the rest changes no difference between folds. So the work
    depends on the number of profiles, not of groups.
    """
    order = sorted(range(len(profiles)), key=lambda i: (-abs(profiles[i][0] - profiles[i][1]), -sum(profiles[i][:2]), profiles[i]))
    totals = np.maximum(1, [sum(p[c] * p[2] for p in profiles) for c in (0, 1)])
    held, quotas = np.zeros((n_folds, 2)), [[0] * n_folds for _ in profiles]
    for i in order:
        zeros, ones, groups = profiles[i]
        even = max(0, groups // n_folds - GREEDY_ROUNDS)
        for _ in range(groups - even * n_folds):
            # after[f] are the shares of all folds when fold f gets the group
            after = (held[None] + np.eye(n_folds)[:, :, None] * [zeros, ones]) / totals
            spread = after.std(axis=1).sum(axis=1).round(12)
            fold = min(range(n_folds), key=lambda f: (spread[f], held[f].sum(), f))
            held[fold] += zeros, ones
            quotas[i][fold] += 1
        held += np.array([zeros, ones]) * even
        quotas[i] = [q + even for q in quotas[i]]
    return quotas


def stratified_group_folds(groups: DataFrame, group: str, label: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): groups whole in one fold, class shares even.

    Groups with equal class counts are interchangeable. So only the distinct counts come to the driver,
    with how many groups have them (a row per profile, however many groups there are); it sets how many
    of each go to each fold. The groups of a profile are dealt in order of a seeded hash of the group, in
    ranks by buckets, so no task orders a profile that a third of all groups share.
    """
    counts = groups.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1"))
    profiles = sorted((r["_n0"], r["_n1"], r["m"]) for r in counts.groupBy("_n0", "_n1").agg(F.count(F.lit(1)).alias("m")).collect())
    if (total := sum(m for *_, m in profiles)) < n_folds:
        raise DataError(f"{n_folds} folds need as many groups, not {total}")
    ends = [(n0, n1, list(accumulate(q))) for (n0, n1, _), q in zip(profiles, fold_quotas(profiles, n_folds), strict=True)]
    plan = groups.sparkSession.createDataFrame(ends, "_n0 bigint, _n1 bigint, _ends array<bigint>")
    hashed = counts.withColumn("_h", F.xxhash64(F.lit(seed), F.col(group).cast("string")))
    ranked = ranked_by(hashed, ["_n0", "_n1"], "_h", [F.col(group)], bucket=F.shiftright("_h", 54))
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("_before"))).cast("bigint")
    return ranked.join(plan, ["_n0", "_n1"]).select(group, fold.alias("fold"))


def group_overlap(samples: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    return samples.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).filter("n_folds > 1")


def fold_metrics(samples: DataFrame, fold: str, group: str, label: str) -> DataFrame:
    """Sizes, subjects, positives and baselines of each fold's test part, and the sizes of its train part."""
    one = F.count_if(F.col(label) == 1)
    n = F.count(F.lit(1))
    test = samples.groupBy(fold).agg(n.alias("n_test"), F.count_distinct(group).alias("n_test_groups"), one.alias("n_test_positive"), (one / n).alias("positive_rate"))
    total = samples.agg(n.alias("_n"), F.count_distinct(group).alias("_g"))
    joined = test.crossJoin(F.broadcast(total))  # one row
    return joined.select(
        fold, (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test", (F.col("_g") - F.col("n_test_groups")).alias("n_train_groups"), "n_test_groups", "n_test_positive", "positive_rate",
        F.col("positive_rate").alias("pr_auc_prevalence_baseline"), F.lit(0.5).alias("roc_auc_majority_baseline"),
    )


def scale_pos_weight(samples: DataFrame, fold: str, label: str) -> DataFrame:
    """Negatives over positives of the other folds; a fold without training positives raises when read."""
    per = samples.groupBy(fold).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    total = per.agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    p, n = F.col("_tp") - F.col("_p"), F.col("_tn") - F.col("_n")
    weight = F.when(p == 0, F.raise_error(F.lit("no positives to train on")).cast("double")).otherwise(F.try_divide(n, p))
    return per.crossJoin(F.broadcast(total)).select(fold, weight.alias("scale_pos_weight"))


def boosted_oof(samples: DataFrame, features: Sequence[str], label: str, fold: str, keep: Sequence[str], max_iter: int = 20, max_depth: int = 3, seed: int = 42, parallel: int = 4, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Out-of-fold scores of gradient-boosted trees, a fit per fold on the others, weighted by class.

    Samples are read and assembled once, held at the storage level while folds are fitted `parallel` at a
    time, and released; what is returned is the scores, checkpointed.
    """
    columns = list(dict.fromkeys([*keep, fold, label]))
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(samples).select("_features", *columns)
    with held(assembled, level) as rows:
        weights = {r[0]: r[1] for r in scale_pos_weight(rows, fold, label).collect()}
        folds = sorted(weights)

        def fit(f: object) -> GBTClassificationModel:
            train = rows.filter(F.col(fold) != f).withColumn("_w", F.when(F.col(label) == 1, float(weights[f])).otherwise(1.0)).withColumn("_label", F.col(label).cast("double"))
            return GBTClassifier(featuresCol="_features", labelCol="_label", weightCol="_w", maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(train)

        with ThreadPool(max(1, min(parallel, len(folds)))) as pool:
            models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), folds)
        parts = []
        for f, model in zip(folds, models, strict=True):
            scored = model.transform(rows.filter(F.col(fold) == f))
            parts.append(scored.select(*keep, fold, F.col(label).cast("bigint").alias("y_true"), vector_to_array("probability")[1].alias("y_score")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return materialized(out)
