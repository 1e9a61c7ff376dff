"""Queries over scored samples, run records, cells and the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import r6
from ..operators import batches, compare, curves, cv, documents, preprocess, ranks, runs, slices, validate
from ..operators.held import scratch_path
from ..sources import volume_source, volumes
from ..sources.committed import save_files
from . import frames
from .frames import CELL_SQL, RUN_SQL, SCR_SQL, VOX_SQL

FRACTIONS = {"train": 0.7, "val": 0.1, "test": 0.2}


def rounded(frame, *columns):
    return frame.withColumns({c: r6(F.col(c)) for c in columns})


def precision_recall_f1(spark, d):
    found = slices.confusion(frames.scr(spark, d), F.col("y") == 1, F.col("score") >= 500)
    return rounded(found, "precision", "recall", "f1")


def roc_pr_auc(spark, d):
    return rounded(curves.roc_pr_auc(frames.scr(spark, d), "y", "score_t"), "roc_auc", "pr_auc", "prevalence")


def points(spark, d):
    return rounded(curves.curve_points(frames.scr(spark, d), "y", "score_t"), "fpr", "tpr", "precision")


def roc_points(spark, d):
    return points(spark, d).select("threshold", "fpr", "tpr")


def pr_points(spark, d):
    return points(spark, d).select("threshold", F.col("tpr").alias("recall"), "precision")


def prevalence(spark, d):
    return rounded(curves.prevalence(frames.scr(spark, d), "y"), "rate")


def fold_metrics(spark, d):
    return rounded(cv.fold_metrics(frames.scr(spark, d), "fold", "grp", "y"), "positive_rate", "pr_auc_prevalence_baseline")


def cv_group_overlap(spark, d):
    return cv.group_overlap(frames.scr(spark, d), "grp", "fold")


def scale_pos_weight(spark, d):
    return rounded(cv.scale_pos_weight(frames.scr(spark, d), "fold", "y"), "scale_pos_weight")


def gbt_oof(spark, d):
    samples = frames.scr(spark, d)
    return cv.boosted_oof(samples, ["score", "score_t"], "y", "fold", ["doc_id", "grp"], max_iter=5)


def by_supplier(spark, d):
    items = frames.table(spark, d, "lineitem")
    return items.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_extendedprice"), 2).alias("b"), F.lit(1.0).alias("one"))


def spearman(spark, d):
    return rounded(ranks.spearman(by_supplier(spark, d), "a", "b"), "rho")


def spearman_null_on_constant(spark, d):
    return rounded(ranks.spearman(by_supplier(spark, d), "a", "one"), "rho")


def cells(spark, d):
    declared, observed = frames.cell(spark, d)
    return compare.declared_left_join(declared, observed, ["brand", "flag"], "score")


def matrix_left_join(spark, d):
    return cells(spark, d)


def render_na(spark, d):
    return compare.rendered(cells(spark, d), ["brand", "flag"], "score")


def availability_stats(spark, d):
    return compare.availability(cells(spark, d), "score")


def best_cell(spark, d):
    return compare.best_cell(cells(spark, d), "score", [F.col("brand"), F.col("flag")]).select(scalar.cell_id(F.col("brand"), F.col("flag")).alias("cell"), "score")


def matrix_invalid_cells(spark, d):
    return compare.invalid_cells(cells(spark, d), F.col("score") >= 0.05).select("brand", "flag", "score")


def duplicate_keys(spark, d):
    return compare.duplicate_keys(frames.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def sample_missing(spark, d):
    return compare.sample_difference(frames.table(spark, d, "documents"), frames.table(spark, d, "labels"), ["doc_id"])


def sample_extra(spark, d):
    return compare.sample_difference(frames.table(spark, d, "labels"), frames.table(spark, d, "documents"), ["doc_id"])


def label_disagreement(spark, d):
    labels = frames.table(spark, d, "labels")
    left = labels.select("doc_id", F.col("quality").cast("bigint").alias("label"))
    right = labels.select("doc_id", (1 - F.col("toxic")).cast("bigint").alias("other"))
    return compare.label_disagreement(left, right, ["doc_id"], "label", "other")


def half_present(spark, d):
    return compare.half_present(frames.table(spark, d, "documents"), frames.table(spark, d, "labels"), ["doc_id"])


def split_hash_agreement(spark, d):
    return compare.split_hash_agreement(frames.run(spark, d), "model", F.col("config"))


def label_override(spark, d):
    found = compare.label_override(frames.table(spark, d, "documents"), frames.table(spark, d, "labels"), "doc_id", "quality", F.lit(-1))
    return found.select("doc_id", F.col("label").cast("bigint").alias("label"))


def before_after_delta(spark, d):
    items = frames.table(spark, d, "lineitem").join(frames.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    per = items.groupBy(F.col("s_nationkey").alias("nation"), F.col("l_returnflag").alias("flag_value")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    per = per.withColumn("config", F.lit(None).cast("string"))  # a control that is null on both sides agrees
    found = compare.controlled_pairs(per, "flag_value", "A", "R", ["nation"], ["config"], "score")
    return rounded(found, "delta").select(F.col("nation").cast("bigint").alias("nation"), "before", "after", "delta", "flag")


def latest_run(spark, d):
    return runs.newest(frames.run(spark, d), "stamp", "run", ["model"])


def newest_matching_run(spark, d):
    return rounded(runs.newest(frames.run(spark, d), "stamp", "run", ["model"], F.col("metric") > 100, ["metric"]), "metric")


def json_dotted_get(spark, d):
    config = F.col("config")
    return frames.run(spark, d).select("run", scalar.dotted_get(config, "k").cast("bigint").alias("k"), scalar.dotted_get(config, "data.split").alias("missing"))


def timing_rollup(spark, d):
    return rounded(runs.timing_rollup(frames.run(spark, d), "model", "metric"), "total_seconds", "seconds_per_unit", "hours")


def best_so_far(spark, d):
    found = runs.best_so_far(frames.run(spark, d), "model", ["stamp", "run"], "metric")
    return rounded(found.select("model", "run", "best", "improved"), "best")


def scorecard(spark, d):
    samples = frames.scr(spark, d)
    declared = cells(spark, d)
    sources = [
        ("roc_auc", curves.roc_pr_auc(samples, "y", "score_t"), "roc_auc"),
        ("prevalence", curves.prevalence(samples, "y"), "rate"),
        ("recall", slices.confusion(samples, F.col("y") == 1, F.col("score") >= 500), "recall"),
        ("spearman", ranks.spearman(by_supplier(spark, d), "a", "b"), "rho"),
        ("cells_available", compare.availability(declared, "score"), "n_available"),
        ("synthetic", declared.filter("flag = 'none'").agg(F.max("score").alias("score")), "score"),
    ]
    return rounded(compare.scorecard(spark.range(1).select(F.lit("headline").alias("cell")), sources), "value")


def fold_auc(spark, d):
    return rounded(curves.auc_by_key(frames.scr(spark, d), "fold", "y", "score_t"), "roc_auc", "pr_auc")


def mean_importance(spark, d):
    items = frames.table(spark, d, "lineitem")
    gains = items.groupBy(F.col("l_partkey").alias("feature"), F.col("l_linenumber").alias("fold")).agg(F.round(F.avg("l_discount"), 6).alias("gain"))
    return rounded(ranks.mean_importance(gains), "mean_gain")


def run_meta_join(spark, d):
    records = frames.run(spark, d)
    newest = runs.newest(records, "stamp", "run", ["model"])
    return rounded(compare.must_match(newest, records, "run", ["config", "metric"]), "metric")


def stopped_at(spark, d):
    return runs.stopped_at(frames.run(spark, d), "model", ["stamp", "run"], "metric", 5).select("model", "run")


def scorecard_sources(spark, d):
    """Each metric's first source that has a value; the classical file is absent, so its AUC comes from the other table."""
    samples = frames.scr(spark, d)
    found = (
        ("roc_auc", 0, "classical.json", spark.range(1).select(F.lit(None).cast("double").alias("value"))),
        ("roc_auc", 1, "paradigm.json", curves.roc_pr_auc(samples, "y", "score_t").select(F.col("roc_auc").alias("value"))),
        ("recall", 0, "slices.json", slices.confusion(samples, F.col("y") == 1, F.col("score") >= 500).select(F.col("recall").alias("value"))),
        ("cells", 0, "matrix.json", compare.availability(cells(spark, d), "score").select(F.col("n_available").cast("double").alias("value"))),
    )
    entries = compare.union_rows(*(f.select(F.lit(m).alias("metric"), F.lit(p).alias("priority"), F.lit(s).alias("source"), F.lit("h").alias("split_hash"), "value") for m, p, s, f in found))
    reasons = spark.createDataFrame([(m, f"{m} was not measured") for m in ("roc_auc", "recall", "cells", "noise")], "metric string, na_reason string")
    return rounded(compare.traced_scorecard(entries, reasons), "value")


def grid(spark, d):
    """Cells with a score and a context value: mean discount and quantity of a brand's returned, kept and open items."""
    items = frames.table(spark, d, "lineitem").join(frames.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    observed = items.groupBy(F.col("p_brand").alias("brand"), F.col("l_returnflag").alias("flag")).agg(F.round(F.avg("l_discount"), 6).alias("dice"), F.round(F.avg("l_quantity"), 6).alias("psnr_db"))
    return compare.declared_left_join(frames.cell(spark, d)[0], observed, ["brand", "flag"], "dice")


def matrix_document(spark, d):
    return documents.shown_cells(grid(spark, d), ["brand", "flag"], ["dice", "psnr_db"])


def matrix_stats(spark, d):
    return rounded(documents.cell_stats(grid(spark, d), ["brand", "flag"], "dice", "psnr_db"), "rho")


def paradigms(spark, d):
    """Two scores of the samples as two paradigms; the third was not evaluated."""
    samples = frames.scr(spark, d)
    coarse = curves.roc_pr_auc(samples, "y", "score_t").select("roc_auc", "pr_auc", F.lit(None).cast("double").alias("dice"))
    fine = curves.roc_pr_auc(samples, "y", "score").select("roc_auc", "pr_auc").crossJoin(slices.confusion(samples, F.col("y") == 1, F.col("score") >= 500).select(F.col("f1").alias("dice")))
    absent = spark.range(1).select(*(F.lit(None).cast("double").alias(c) for c in ("roc_auc", "pr_auc", "dice")))
    named = ((coarse, "classical", False, None), (fine, "unetr", True, None), (absent, "diffusion", True, "no weights"))
    return compare.union_rows(*(f.select(F.lit(k).alias("key"), F.lit(loc).alias("localizes"), F.lit(why).cast("string").alias("na_reason"), "*") for f, k, loc, why in named))


def paradigm_document(spark, d):
    return documents.paradigm_rows(paradigms(spark, d), ["classical", "unetr", "diffusion"], ["roc_auc", "pr_auc"], ["dice"])


def paradigm_stats(spark, d):
    return documents.paradigm_stats(paradigms(spark, d))


def ordered_digest(spark, d):
    return runs.ordered_digest(frames.run(spark, d).withColumn("hour", F.date_format("stamp", "yyyy-MM-dd HH")), ["model", "hour"], "run")


def content_hash(spark, d):
    return frames.run(spark, d).select("run", F.sha2(F.concat_ws("|", F.col("model"), F.col("config")), 256).alias("digest"))


def item_seed(spark, d):
    return frames.run(spark, d).select("run", scalar.item_seed(F.lit(42), F.lit(0), F.col("run")).alias("seed"))


def split_counts(spark, d):
    split = cv.hashed_split(frames.table(spark, d, "documents"), "doc_id", FRACTIONS)
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def hashed_split(spark, d):
    return cv.hashed_split(frames.table(spark, d, "documents"), "doc_id", FRACTIONS)


def split_leakage(spark, d):
    split = hashed_split(spark, d)
    return validate.split_leakage(split.filter("split = 'train'"), split.filter("split = 'test'"), "doc_id")


def set_except(spark, d):
    return compare.set_except(frames.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), frames.table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


def set_intersect(spark, d):
    return compare.set_intersect(frames.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), frames.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


def union_rows(spark, d):
    a = frames.table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return compare.union_rows(a, frames.table(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))


def sorted_limit(spark, d):
    return frames.table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def top_k_per_group(spark, d):
    items = frames.table(spark, d, "orders")
    found = ranks.top_k_per_group(items, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
    return found.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("rank").cast("bigint").alias("rank"))


def view_model_comparison(spark, d):
    """Archived design: three-way join with a JSON path and a filter."""
    orders, customer, nation = (frames.table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("o_orderstatus = 'F'")
    return rounded(joined.groupBy(F.col("n_name").alias("model"), F.col("c_mktsegment").alias("loss")).agg(F.avg("o_totalprice").alias("mean_score"), F.count(F.lit(1)).alias("n")), "mean_score")


def view_volume_detail(spark, d):
    """Archived design: five inner joins and one left join."""
    t = {n: frames.table(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")}
    joined = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"].filter("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    )
    return joined.groupBy(F.col("r_name").alias("region"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("n_rich"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("revenue"))


def view_union_pipelines(spark, d):
    """Archived design: a join and UNION ALL of two pipelines with casts."""
    deep = frames.scr(spark, d).groupBy("grp").agg(F.avg("score").alias("value")).select(F.lit("deep").alias("pipeline"), "grp", "value")
    classical = frames.scr(spark, d).groupBy("grp").agg(F.avg(F.col("y").cast("double")).alias("value")).select(F.lit("classical").alias("pipeline"), "grp", "value")
    return rounded(deep.unionByName(classical), "value")


def filter_metric_range(spark, d):
    """Archived design: list records whose metric lies in a range."""
    return rounded(frames.run(spark, d).filter("metric between 50 and 120").select("run", "model", "metric"), "metric")


def chunk_files(spark, d):
    """The embeddings' subjects in volumes of 16 slices, as .npy files in the shared folder: its path."""
    rows = frames.slices(spark, d)
    chunk, _ = preprocess.chunk_columns(F.col("slice_index"))
    named = rows.select(F.format_string("s%d_c%d", "subject", chunk).alias("volume_id"), F.pmod("slice_index", F.lit(16)).alias("slice_index"), "pixels")
    path = scratch_path(spark, "volumes")
    save_files(volumes.volumes_as_npy(named, "volume_id", 8, 8), path)
    return path


def binary_scan(spark, d):
    """File name and length of volumes made from the embeddings: a scan that reads no contents."""
    return volumes.volume_files(spark, chunk_files(spark, d), "*.npy").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def volume_headers(spark, d):
    """Depth and shape of those volumes, from headers alone."""
    return volume_source.scan_headers(spark, chunk_files(spark, d))


def volume_slices(spark, d):
    """Their slices 2 to 5, by byte ranges, and the mean of each."""
    rows = volume_source.scan_slices(spark, chunk_files(spark, d)).filter("slice_index between 2 and 5")
    total = F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rows.select("volume_id", "slice_index", "height", "width", scalar.r6(total / 64).alias("mean"))


def group_folds(spark, d):
    """The sources of labelled documents in five folds with even shares of both classes, and what each holds."""
    samples = frames.scr(spark, d)
    folds = cv.stratified_group_folds(samples.select("grp", "y"), "grp", "y")
    return folds.join(samples.groupBy("grp").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")), "grp").select("grp", "fold", "n0", "n1")


def epoch_batches(spark, d):
    """Embeddings in batches of 8 as validation reads them."""
    return batches.epoch_batches(frames.table(spark, d, "embeddings").select("vec_id"), "vec_id", "val", 8)


_CONFUSION = "sum(CASE WHEN score >= 500 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN score >= 500 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN score < 500 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN score < 500 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS tn"
_CURVE_SQL = SCR_SQL + """, g AS (SELECT score_t AS threshold, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM scr GROUP BY 1),
c AS (SELECT threshold, sum(p) OVER k AS tp, sum(n) OVER k AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g WINDOW k AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT threshold, tp, fp, fp::DOUBLE / nn AS fpr, tp::DOUBLE / np AS tpr, tp::DOUBLE / (tp + fp) AS prec FROM c),
lagged AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS fpr0, coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS tpr0 FROM pts)
"""
_SUPPLIER = "WITH s AS (SELECT l_suppkey, sum(l_quantity) AS a, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM s)\n"
_SPLIT_SQL = """WITH k AS (SELECT doc_id, sha256('42:' || doc_id::VARCHAR) AS h FROM (SELECT DISTINCT doc_id FROM documents) AS x), r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rk, count(*) OVER () AS n FROM k),
sp AS (SELECT doc_id, CASE WHEN rk <= round_even(0.7::DOUBLE * n, 0) THEN 'train' WHEN rk <= round_even(0.7::DOUBLE * n, 0) + round_even(0.1::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM r)
"""
_GRID = """WITH declared AS (SELECT brand, flag FROM (SELECT DISTINCT p_brand AS brand FROM part) AS b, (VALUES ('A'), ('N'), ('R'), ('X')) AS t(flag)),
observed AS (SELECT p_brand AS brand, l_returnflag AS flag, round(avg(l_discount), 6) AS dice, round(avg(l_quantity), 6) AS psnr_db FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
cells AS (SELECT d.brand, d.flag, dice, psnr_db FROM declared AS d LEFT JOIN observed AS o ON d.brand = o.brand AND d.flag = o.flag)
"""
_AREAS = "SELECT sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc, sum((tpr - tpr0) * prec) AS pr FROM lagged"
_PARADIGMS = f"""WITH a AS ({_CURVE_SQL}{_AREAS}), b AS ({_CURVE_SQL.replace("score_t AS threshold", "score AS threshold")}{_AREAS}),
f AS ({SCR_SQL}, c AS (SELECT {_CONFUSION} FROM scr) SELECT 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS dice FROM c)
"""

ORACLES = {
    "precision_recall_f1": SCR_SQL + ", c AS (SELECT " + _CONFUSION + " FROM scr) SELECT tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "roc_pr_auc": _CURVE_SQL + "SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS roc_auc, round(sum((tpr - tpr0) * prec), 6) AS pr_auc, (max(tp) + max(fp))::BIGINT AS n, max(tp)::BIGINT AS n_positive, round(max(tp)::DOUBLE / (max(tp) + max(fp)), 6) AS prevalence, count(*) AS n_tied_score_groups FROM lagged",
    "roc_points": _CURVE_SQL + "SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts",
    "pr_points": _CURVE_SQL + "SELECT threshold, round(tpr, 6) AS recall, round(prec, 6) AS precision FROM pts",
    "prevalence": SCR_SQL + "SELECT count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg(y), 6) AS rate FROM scr",
    "fold_metrics": SCR_SQL + ", t AS (SELECT count(*) AS n, count(DISTINCT grp) AS g FROM scr) SELECT fold, any_value(t.n) - count(*) AS n_train, count(*) AS n_test, any_value(t.g) - count(DISTINCT grp) AS n_train_groups, count(DISTINCT grp) AS n_test_groups, sum(y)::BIGINT AS n_test_positive, round(avg(y), 6) AS positive_rate, round(avg(y), 6) AS pr_auc_prevalence_baseline, 0.5::DOUBLE AS roc_auc_majority_baseline FROM scr, t GROUP BY fold",
    "cv_group_overlap": SCR_SQL + "SELECT grp, count(DISTINCT fold) AS n_folds FROM scr GROUP BY 1 HAVING count(DISTINCT fold) > 1",
    "scale_pos_weight": SCR_SQL + ", p AS (SELECT fold, sum(y) AS p, sum(1 - y) AS n FROM scr GROUP BY 1) SELECT fold, round(((SELECT sum(n) FROM p) - n)::DOUBLE / ((SELECT sum(p) FROM p) - p), 6) AS scale_pos_weight FROM p",
    "spearman": _SUPPLIER + "SELECT count(*) AS n, round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6) AS rho FROM r",
    "spearman_null_on_constant": "SELECT count(DISTINCT l_suppkey) AS n, CAST(NULL AS DOUBLE) AS rho FROM lineitem",
    "matrix_left_join": CELL_SQL + "SELECT * FROM cells",
    "render_na": CELL_SQL + "SELECT brand, flag, coalesce(printf('%.4f', score), 'n/a (' || na_reason || ')') AS rendered FROM cells",
    "availability_stats": CELL_SQL + "SELECT count(*) AS n_total, count(score) AS n_available, count(*) FILTER (WHERE score IS NULL) AS n_missing FROM cells",
    "best_cell": CELL_SQL + "SELECT brand || '__' || flag AS cell, score FROM cells WHERE score IS NOT NULL ORDER BY score DESC, brand, flag LIMIT 1",
    "matrix_invalid_cells": CELL_SQL + "SELECT brand, flag, score FROM cells WHERE NOT coalesce(score >= 0.05, false)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "sample_missing": "SELECT doc_id FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id)",
    "sample_extra": "SELECT doc_id FROM labels AS l WHERE NOT EXISTS (SELECT 1 FROM documents AS d WHERE l.doc_id = d.doc_id)",
    "label_disagreement": "SELECT doc_id, quality::BIGINT AS label, (1 - toxic)::BIGINT AS other FROM labels WHERE quality <> 1 - toxic",
    "half_present": "WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM d FULL JOIN l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    "split_hash_agreement": RUN_SQL + "SELECT model, count(DISTINCT config) AS n_hashes, count(DISTINCT config) <= 1 AS agrees FROM run GROUP BY 1",
    "label_override": "SELECT d.doc_id, coalesce(quality, -1)::BIGINT AS label FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id",
    "before_after_delta": "WITH p AS (SELECT s_nationkey AS nation, l_returnflag AS f, round(avg(l_discount), 6) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT b.nation::BIGINT AS nation, b.score AS before, a.score AS after, round(a.score - b.score, 6) + 0.0 AS delta, CASE WHEN a.score - b.score < 0 THEN 'REGRESSION' ELSE 'ok' END AS flag FROM p AS b JOIN p AS a ON a.nation = b.nation WHERE b.f = 'A' AND a.f = 'R'",
    "latest_run": RUN_SQL + "SELECT model, run FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stamp DESC, run DESC) AS rk FROM run) AS x WHERE rk = 1",
    "newest_matching_run": RUN_SQL + "SELECT model, run, round(metric, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stamp DESC, run DESC) AS rk FROM run WHERE metric > 100) AS x WHERE rk = 1",
    "json_dotted_get": RUN_SQL + "SELECT run, CAST(json_extract_string(config, '$.k') AS BIGINT) AS k, json_extract_string(config, '$.data.split') AS missing FROM run",
    "timing_rollup": RUN_SQL + "SELECT model, round(sum(metric), 6) AS total_seconds, round(avg(metric), 6) AS seconds_per_unit, round(sum(metric) / 3600, 6) AS hours FROM run GROUP BY 1",
    "best_so_far": RUN_SQL + ", b AS (SELECT model, run, metric, max(metric) OVER (PARTITION BY model ORDER BY stamp, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM run) SELECT model, run, round(greatest(coalesce(earlier, metric), metric), 6) AS best, coalesce(metric > earlier, true) AS improved FROM b",
    "scorecard": _CURVE_SQL + ", conf AS (SELECT " + _CONFUSION + " FROM scr), " + _SUPPLIER.removeprefix("WITH ").rstrip() + ", " + CELL_SQL.strip().removeprefix("WITH ") + """
SELECT 'roc_auc' AS metric, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS value, CAST(NULL AS VARCHAR) AS na_reason FROM lagged
UNION ALL SELECT 'prevalence', round(avg(y), 6), NULL FROM scr UNION ALL SELECT 'recall', round(tp::DOUBLE / (tp + fn), 6), NULL FROM conf
UNION ALL SELECT 'spearman', round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6), NULL FROM r UNION ALL SELECT 'cells_available', count(score)::DOUBLE, NULL FROM cells
UNION ALL SELECT 'synthetic', NULL, 'source is missing'""",
    "fold_auc": SCR_SQL + """, g AS (SELECT fold, score_t AS s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM scr GROUP BY 1, 2),
c AS (SELECT fold, p, n, sum(p) OVER k AS tp, sum(n) OVER k AS fp, sum(p) OVER (PARTITION BY fold) AS np, sum(n) OVER (PARTITION BY fold) AS nn FROM g WINDOW k AS (PARTITION BY fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT fold, CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN round(sum((n::DOUBLE / nn) * (tp + tp - p) / np / 2), 6) END AS roc_auc, CASE WHEN any_value(np) > 0 AND any_value(nn) > 0 THEN round(sum(p::DOUBLE / np * tp / (tp + fp)), 6) END AS pr_auc FROM c GROUP BY 1""",
    "mean_importance": "WITH g AS (SELECT l_partkey AS feature, l_linenumber AS fold, round(avg(l_discount), 6) AS gain FROM lineitem GROUP BY 1, 2) SELECT feature, round(sum(gain) / (SELECT count(DISTINCT fold) FROM g), 6) AS mean_gain FROM g GROUP BY 1",
    "run_meta_join": RUN_SQL + "SELECT model, run, config, round(metric, 6) AS metric FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stamp DESC, run DESC) AS rk FROM run) AS x WHERE rk = 1",
    "stopped_at": RUN_SQL + """, b AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY model ORDER BY stamp, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM run WHERE metric IS NOT NULL),
i AS (SELECT *, count(*) FILTER (WHERE improved) OVER (PARTITION BY model ORDER BY stamp, run ROWS UNBOUNDED PRECEDING) AS island FROM b),
s AS (SELECT *, count(*) FILTER (WHERE NOT improved) OVER (PARTITION BY model, island ORDER BY stamp, run ROWS UNBOUNDED PRECEDING) AS stale FROM i)
SELECT model, run FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY stamp, run) AS rk FROM s WHERE stale >= 5) AS x WHERE rk = 1""",
    "scorecard_sources": _CURVE_SQL + ", conf AS (SELECT " + _CONFUSION + " FROM scr), " + CELL_SQL.strip().removeprefix("WITH ") + """
SELECT 'roc_auc' AS metric, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 6) AS value, 'paradigm.json' AS source, CAST(NULL AS VARCHAR) AS na_reason FROM lagged
UNION ALL SELECT 'recall', round(tp::DOUBLE / (tp + fn), 6), 'slices.json', NULL FROM conf UNION ALL SELECT 'cells', count(score)::DOUBLE, 'matrix.json', NULL FROM cells
UNION ALL SELECT 'noise', NULL, NULL, 'noise was not measured'""",
    "matrix_document": _GRID + "SELECT brand || '__' || flag AS cell_id, brand, flag, coalesce(printf('%.4f', dice), 'n/a (not evaluated)') AS dice, coalesce(printf('%.2f', psnr_db), 'n/a (not evaluated)') AS psnr_db, CASE WHEN dice IS NULL THEN 'not evaluated' ELSE '' END AS na_reason FROM cells",
    "matrix_stats": _GRID + """, k AS (SELECT rank() OVER (ORDER BY dice) + (count(*) OVER (PARTITION BY dice) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY psnr_db) + (count(*) OVER (PARTITION BY psnr_db) - 1) / 2.0::DOUBLE AS rb FROM cells WHERE dice IS NOT NULL AND psnr_db IS NOT NULL),
b AS (SELECT brand || '__' || flag AS best_cell_id, dice AS best_score FROM cells WHERE dice IS NOT NULL ORDER BY dice DESC, brand, flag LIMIT 1), r AS (SELECT count(*) AS n_pairs, round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 6) AS rho FROM k)
SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(dice) FROM cells) AS n_available, n_pairs, rho, best_cell_id, best_score FROM r, b""",
    "paradigm_document": _PARADIGMS + """SELECT 'roc_auc' AS metric, printf('%.4f', a.roc) AS classical, printf('%.4f', b.roc) AS unetr, 'n/a (no weights)' AS diffusion FROM a, b
UNION ALL SELECT 'pr_auc', printf('%.4f', a.pr), printf('%.4f', b.pr), 'n/a (no weights)' FROM a, b UNION ALL SELECT 'dice', 'n/a (no voxel masks)', printf('%.4f', dice), 'n/a (no weights)' FROM f""",
    "paradigm_stats": _PARADIGMS + "SELECT 3::BIGINT AS n_columns, 2::BIGINT AS n_available, CASE WHEN a.roc >= b.roc THEN 'classical' ELSE 'unetr' END AS best_roc_auc_key, 'unetr' AS best_dice_key FROM a, b",
    "ordered_digest": RUN_SQL + "SELECT model, strftime(stamp, '%Y-%m-%d %H') AS hour, sha256(string_agg(run::VARCHAR, ',' ORDER BY run)) AS digest FROM run GROUP BY 1, 2",
    "content_hash": RUN_SQL + "SELECT run, sha256(model || '|' || config) AS digest FROM run",
    "split_counts": _SPLIT_SQL + "SELECT split, count(*) AS n FROM sp GROUP BY 1",
    "hashed_split": _SPLIT_SQL + "SELECT doc_id, split FROM sp",
    "split_leakage": "SELECT doc_id FROM documents WHERE false",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "union_rows": "SELECT 'customer' AS side, c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier",
    "sorted_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "top_k_per_group": "SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) AS x WHERE rank <= 5",
    "view_model_comparison": "SELECT n_name AS model, c_mktsegment AS loss, round(avg(o_totalprice), 6) AS mean_score, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1, 2",
    "view_volume_detail": "SELECT r_name AS region, p_brand AS brand, count(*) AS n, count(s_suppkey) AS n_rich, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 6) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) AS s ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "view_union_pipelines": SCR_SQL + "SELECT 'deep' AS pipeline, grp, round(avg(score), 6) AS value FROM scr GROUP BY 2 UNION ALL SELECT 'classical', grp, round(avg(y), 6) FROM scr GROUP BY 2",
    "filter_metric_range": RUN_SQL + "SELECT run, model, round(metric, 6) AS metric FROM run WHERE metric BETWEEN 50 AND 120",
}
_CHUNKS = VOX_SQL + ", c AS (SELECT 's' || subject || '_c' || slice_index // 16 AS volume_id, slice_index % 16 AS z, embedding FROM sl)"
ORACLES |= {
    "binary_scan": _CHUNKS + " SELECT volume_id || '.npy' AS file, 128 + 4 * 64 * count(*) AS length FROM c GROUP BY volume_id",
    "volume_headers": _CHUNKS + " SELECT volume_id, count(*) AS depth, 8::INTEGER AS height, 8::INTEGER AS width, 1::BIGINT AS n_chunks, 'float32' AS dtype, 128::BIGINT AS bytes_read FROM c GROUP BY volume_id",
    "volume_slices": _CHUNKS + " SELECT volume_id, z AS slice_index, 8::INTEGER AS height, 8::INTEGER AS width, round(list_sum(list_transform(embedding, lambda v: v::FLOAT::DOUBLE)) / 64, 6) + 0.0 AS mean FROM c WHERE z BETWEEN 2 AND 5",
    "epoch_batches": "SELECT vec_id, n // 8 AS batch, n % 8 AS place FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) AS x",
}
ROWS_ONLY = ("gbt_oof", "item_seed", "group_folds")
QUERIES = {name: globals()[name] for name in (*ORACLES, *ROWS_ONLY)}
