"""Documents of comparison: the grid of models and losses, paradigms side by side, before and after.

JSON keeps full precision and nulls; CSV and Markdown show rounded numbers, or n/a with the reason.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import SLICE_SCORE, ArtifactError, ConfigError
from ..functions import scalar
from . import compare, ranks
from ..sources.committed import read_file, save_document, write_text
from .held import materialized
from .report import markdown_table, save_csv, save_report

#: Places shown of each metric, and the column heads of the stored tables.
PLACES = {"dice": 4, "iou": 4, "psnr_db": 2, "ssim": 4, "roc_auc": 4, "pr_auc": 4, "f1_at_tuned_threshold": 4}
PREDICTIONS = ("granularity", "fold", "volume_id", "slice_index", "y_true", "y_score")
IMPORTANCE = ("granularity", "rank", "feature", "mean_gain")
BEFORE_AFTER = ("cell", "model", "loss", "dice_mean", "dice_std", "iou_mean", "iou_std", "run_id")
SLICE_LEVEL = "slice-level"


def shown_cells(cells: DataFrame, keys: Sequence[str], values: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """A row per cell: cell_id, the keys, each value as it is shown, na_reason (empty where there is none), and carried columns."""
    texts = (scalar.render_na(F.col(v), F.coalesce("na_reason", F.lit("not recorded")), PLACES[v]).alias(v) for v in values)
    return cells.select(F.concat_ws("__", *keys).alias("cell_id"), *keys, *texts, F.coalesce("na_reason", F.lit("")).alias("na_reason"), *carry)


def cell_stats(cells: DataFrame, keys: Sequence[str], score: str, context: str) -> DataFrame:
    """One row: how many cells there are and have a score, the best, and Spearman's rho of score and context.

    Of equal scores the first by the keys is the best; without scores it is null, and rho with fewer than three pairs.
    """
    cells = materialized(cells)
    counted = compare.availability(cells, score).select(F.col("n_total").alias("n_cells"), "n_available")
    rho = ranks.spearman(cells, context, score, declared=True).select(F.col("n").alias("n_pairs"), "rho")
    best = compare.best_cell(cells, score, [F.col(k) for k in keys]).select(F.concat_ws("__", *keys).alias("best_cell_id"), F.col(score).alias("best_score"))
    return counted.crossJoin(F.broadcast(rho)).join(F.broadcast(best), F.lit(True), "left")


def matrix_document(cells: DataFrame, keys: Sequence[str], score: str, context: str) -> DataFrame:
    """One row: `cells` in order of the keys, as declared, thus few, and their `stats`."""
    entry = F.struct(*keys, *(c for c in cells.columns if c not in keys), F.col(score).isNotNull().alias("available"))
    listed = cells.agg(F.sort_array(F.collect_list(entry)).alias("cells"))
    stats = cell_stats(cells, keys, score, context)
    return listed.crossJoin(F.broadcast(stats.select(F.struct(*stats.columns).alias("stats"))))


def save_matrix(cells: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], score: str, context: str, carry: Sequence[str] = ()) -> None:
    """matrix.csv, matrix.json and matrix.md, a file each; all in the file system of the path."""
    shown = shown_cells(cells, keys, values, carry)
    save_report(shown.orderBy(*keys), f"{path}/matrix.csv", shown.columns)
    save_document(matrix_document(cells, keys, score, context), f"{path}/matrix.json")
    found = cell_stats(cells, keys, score, context).first()
    rho = "n/a (fewer than 3 pairs or a constant side)" if found["rho"] is None else f"{found['rho']:.4f}"
    notes = [f"Spearman's rho of {context} and {score}: {rho}, {found['n_pairs']} pairs.", f"{found['n_available']} of {found['n_cells']} cells have a value."]
    save_markdown(f"{path}/matrix.md", "Models and losses", shown.orderBy(*keys), [f"{', '.join(v for v in values if v in ('psnr_db', 'ssim'))}: context only.", *notes])


def save_markdown(path: str, title: str, rows: DataFrame, notes: Sequence[str] = ()) -> None:
    write_text(path, "\n\n".join([f"# {title}", markdown_table(rows), *notes]) + "\n")


def paradigm_rows(columns: DataFrame, names: Sequence[str], slice_metrics: Sequence[str], voxel_metrics: Sequence[str]) -> DataFrame:
    """metric and one text per paradigm in `names`. columns: key, localizes, na_reason and the metrics, a row per paradigm.

    A paradigm that gives no voxel masks has no voxel metrics, and the text says so; a name without a row is not evaluated.
    """
    absent = F.coalesce("na_reason", F.lit("not recorded"))
    texts = [F.struct(F.lit(m).alias("metric"), scalar.render_na(F.col(m), absent, PLACES[m]).alias("shown")) for m in slice_metrics]
    for m in voxel_metrics:
        value = F.when(F.col("localizes"), F.col(m))
        texts.append(F.struct(F.lit(m).alias("metric"), scalar.render_na(value, F.when(F.col("localizes"), absent).otherwise("no voxel masks"), PLACES[m]).alias("shown")))
    long = columns.select("key", F.inline(F.array(*texts)))
    wide = long.groupBy("metric").pivot("key", list(names)).agg(F.first("shown"))
    return wide.fillna("n/a (not evaluated)", list(names))


def paradigm_stats(columns: DataFrame, slice_score: str = "roc_auc", voxel_score: str = "dice") -> DataFrame:
    """One row: columns in all and available, and the best key by slice and by voxel score; ties by key, null without scores."""
    voxel = F.when(F.col("localizes"), F.col(voxel_score))
    best = lambda v: F.min_by("key", F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col("key"))))
    found = F.col(slice_score).isNotNull() | voxel.isNotNull()
    return columns.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(found).alias("n_available"), best(F.col(slice_score)).alias(f"best_{slice_score}_key"), best(voxel).alias(f"best_{voxel_score}_key"))


def save_paradigms(columns: DataFrame, path: str, names: Sequence[str], slice_metrics: Sequence[str], voxel_metrics: Sequence[str], sample: Mapping[str, int], split_hash: str) -> None:
    """paradigms.csv, .json and .md; sample holds the counts that all columns share."""
    metrics = [*slice_metrics, *voxel_metrics]
    texts = [scalar.render_na(F.col(m), F.coalesce("na_reason", F.lit("not recorded")), PLACES[m]).alias(m) for m in metrics]
    shown = columns.select("key", "localizes", *texts, F.coalesce("na_reason", F.lit("")).alias("na_reason"))
    save_report(shown.orderBy("key"), f"{path}/paradigms.csv", shown.columns)
    listed = columns.agg(F.sort_array(F.collect_list(F.struct("key", *(c for c in columns.columns if c != "key")))).alias("columns"))  # a row per paradigm
    stats = paradigm_stats(columns)
    document = listed.crossJoin(F.broadcast(stats.select(F.struct(*stats.columns).alias("stats"))))
    counts = F.struct(*(F.lit(v).alias(k) for k, v in sample.items()))
    save_document(document.withColumn("sample", counts).withColumn("split_hash", F.lit(split_hash)), f"{path}/paradigms.json")
    counted = ", ".join(f"{k} {v}" for k, v in sample.items())
    save_markdown(f"{path}/paradigms.md", "Paradigms", paradigm_rows(columns, names, slice_metrics, voxel_metrics), [f"Split {split_hash}; {counted}.", "Slice and voxel metrics measure different things and are not compared with each other."])


def before_after_rows(before: DataFrame, after: DataFrame, metrics: Sequence[str], agree: Sequence[str]) -> DataFrame:
    """metric, before, after, delta, flag of two one-row records; they must agree in `agree`, or reading fails. A fall stays, flagged."""
    left = before.select(*(F.col(c).alias(f"_b_{c}") for c in (*metrics, *agree)))
    pair = left.crossJoin(F.broadcast(after.select(*metrics, *agree)))
    differs = F.concat_ws(", ", *(F.when(~F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in agree))
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_b_{m}").alias("before"), F.col(m).alias("after")) for m in metrics))
    checked = F.when(differs != "", F.raise_error(F.concat(F.lit("records differ in "), differs)).cast(pair.select(entries).schema[0].dataType)).otherwise(entries)
    delta = F.col("after") - F.col("before")
    return pair.select(F.inline(checked)).withColumn("delta", delta).withColumn("flag", F.when(delta < 0, "REGRESSION").otherwise("ok"))


def save_before_after(before: DataFrame, after: DataFrame, path: str, metrics: Sequence[str], agree: Sequence[str]) -> None:
    """before_after.md with signed deltas, before_after.csv with both records."""
    found = before_after_rows(before, after, metrics, agree)
    signed = F.format_string("%+.4f", "delta")
    save_markdown(f"{path}/before_after.md", "Before and after", found.select("metric", *(F.format_string("%.4f", c).alias(c) for c in ("before", "after")), signed.alias("delta"), "flag"))
    both = before.withColumn("cell", F.lit("before")).unionByName(after.withColumn("cell", F.lit("after")))
    save_report(both, f"{path}/before_after.csv", BEFORE_AFTER)


def save_predictions(rows: DataFrame, path: str) -> None:
    """Out-of-fold scores, marked as of slices."""
    save_csv(rows.withColumn("granularity", F.lit(SLICE_LEVEL)), path, PREDICTIONS)


def save_importance(importance: DataFrame, path: str) -> None:
    """feature and mean_gain with their ranks."""
    save_csv(ranks.feature_rank(importance, "feature", "mean_gain").withColumn("granularity", F.lit(SLICE_LEVEL)), path, IMPORTANCE)


#: The sections of the document of a classical run, and what they must tell.
SECTIONS = {
    "split": ("split", "split_hash"),
    "features": ("feature_hash", "feature_names", "label_threshold_voxels", "drop_empty_slices"),
    "counts": ("n_volumes", "n_slices_seen", "n_slices_dropped", "n_samples"),
    "classifier": ("name", "params", "scale_pos_weight"),
}


def classical_document(folds: DataFrame, run_id: str, seed: int, complete: bool, sections: Mapping[str, Mapping[str, object]] | None = None, subject_limit: int | None = None) -> DataFrame:
    """One row from fold rows (fold, n_test, n_test_positive, positive_rate, roc_auc, pr_auc): provenance, balance, headline, baselines, folds.

    `sections`, which a stored document needs, must hold all of SECTIONS. A run over a limited number of subjects is never complete.
    """
    needed = ["fold", "n_test", "n_test_positive", "positive_rate", "roc_auc", "pr_auc"]
    missing = [c for c in needed if c not in folds.columns] + [f"{name}.{c}" for name, fields in SECTIONS.items() for c in fields if sections is not None and c not in sections.get(name, {})]
    if missing:
        raise ArtifactError(f"the document lacks {missing}")
    if complete and subject_limit is not None:
        raise ArtifactError(f"a run limited to {subject_limit} subjects is not complete")
    positive, n = F.sum("n_test_positive"), F.sum("n_test")
    rates = F.transform(F.sort_array(F.collect_list(F.struct("fold", "positive_rate"))), lambda x: x.positive_rate)  # a row per fold
    balance = F.struct(positive.alias("n_positive"), (n - positive).alias("n_negative"), F.try_divide(positive, n).alias("positive_rate"), *([] if sections is None else [rates.alias("per_fold_positive_rate")]))
    spread = [f(F.col(c)).alias(f"{c}_{name}") for c in ("roc_auc", "pr_auc") for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    baselines = F.struct(F.lit(0.5).alias("roc_auc_majority"), F.avg("positive_rate").alias("pr_auc_prevalence_mean"))
    listed = F.sort_array(F.collect_list(F.struct(*needed)))
    found = folds.agg(balance.alias("class_balance"), F.struct(*spread).alias("headline"), baselines.alias("baselines"), listed.alias("folds"))
    told = [F.lit(subject_limit).cast("bigint").alias("subject_limit")]
    for name in SECTIONS if sections is not None else ():
        text = F.lit(json.dumps(dict(sections[name]), sort_keys=True))
        told.append(F.from_json(text, F.schema_of_json(text)).alias(name))
    return found.select(F.lit(SLICE_LEVEL).alias("granularity"), F.lit(run_id).alias("run_id"), F.lit(seed).alias("seed"), F.lit(complete).alias("complete"), *told, "*")


def save_classical(folds: DataFrame, path: str, run_id: str, seed: int, complete: bool, sections: Mapping[str, Mapping[str, object]], subject_limit: int | None = None) -> None:
    """classical_metrics.json of a run."""
    save_document(classical_document(folds, run_id, seed, complete, sections, subject_limit), f"{path}/classical_metrics.json")


def save_slice_tuning(tuned: DataFrame, path: str, split: str) -> None:
    """Thresholds tried on validation slices, in a folder that no test result shares."""
    if split != "val":
        raise ConfigError(f"thresholds are chosen on val, not on {split}")
    save_report(tuned.withColumn("split", F.lit(split)).orderBy("threshold"), f"{path}/val/slice_thresholds.csv", ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "split"])


def save_slice_scores(rows: DataFrame, path: str) -> None:
    """slice_scores.csv with the stored columns of slice scores, a row per slice, as Spark writes it."""
    save_csv(rows, f"{path}/slice_scores.csv", rows.sparkSession.createDataFrame([], SLICE_SCORE).columns)


def save_legacy(found: DataFrame, path: str, run_id: str, model: str, loss: str) -> None:
    """legacy_compat.json: the one row of the old protocol's result, with the run, model and loss that it is of."""
    named = found.select("*", *(F.lit(v).alias(k) for k, v in (("run_id", run_id), ("model", model), ("loss", loss))))
    if named.count() != 1:
        raise ArtifactError("the result of the old protocol is one row")
    save_document(named, f"{path}/legacy_compat.json")


def _stored(path: str, name: str) -> dict:
    """A stored document; absent and malformed ones are errors."""
    content = read_file(f"{path}/{name}")
    if content is None:
        raise ArtifactError(f"no {name} at {path}")
    try:
        return json.loads(content)
    except ValueError as error:
        raise ArtifactError(f"malformed {name} at {path}: {error}") from error


def _table(head: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def _number(value: float | None, places: int, signed: bool = False) -> str:
    return "n/a" if value is None else f"{value:{'+' if signed else ''}.{places}f}"


def save_aggregate_summary(path: str) -> None:
    """summary.md beside a stored aggregate.json, from that document alone: headline and context apart, the change signed."""
    held = _stored(path, "aggregate.json")
    spread = lambda part: _table(["metric", "mean", "deviation"], [[m, *(_number(held[part][m][s], PLACES[m]) for s in ("mean", "std"))] for m in sorted(PLACES) if m in held[part]])
    try:
        delta = held["baseline_delta"]
        told = ", ".join(f"{name} {held[name]}" for name in ("mode", "split", "n_volumes", "split_hash", "run_id", "results_run_id"))
        change = f"Dice {_number(delta['corrected'], 4)}, published {_number(delta['published'], 4)}: {_number(delta['delta'], 4, signed=True)}."
        parts = [f"# {held['cell_id']}", told, "## Headline", spread("headline"), change, "## Context only", spread("context_only"), held["context_only"]["note"]]
    except KeyError as missing:
        raise ArtifactError(f"aggregate.json at {path} lacks {missing}") from missing
    write_text(f"{path}/summary.md", "\n\n".join(parts) + "\n")


def save_classical_summary(path: str) -> None:
    """summary.md beside a stored classical_metrics.json, from that document alone."""
    held = _stored(path, "classical_metrics.json")
    try:
        balance, headline, floor = held["class_balance"], held["headline"], held["baselines"]
        rows = [[m, _number(headline[f"{m}_mean"], 4), _number(headline[f"{m}_std"], 4), _number(f, 4)] for m, f in (("roc_auc", floor["roc_auc_majority"]), ("pr_auc", floor["pr_auc_prevalence_mean"]))]
        counts = f"{held['counts']['n_samples']} samples, {balance['n_positive']} positive ({_number(balance['positive_rate'], 4)}); run {held['run_id']}, split {held['split']['split_hash']}" + ("." if held["complete"] else "; not complete.")
        parts = [f"# Classical baseline, {held['granularity']}", counts, _table(["metric", "mean of folds", "deviation", "without skill"], rows)]
    except KeyError as missing:
        raise ArtifactError(f"classical_metrics.json at {path} lacks {missing}") from missing
    write_text(f"{path}/summary.md", "\n\n".join(parts) + "\n")


def scorecard_block(card: DataFrame, split_hash: str | None) -> str:
    """The Markdown of a scorecard (metric, value, source, na_reason), to be put between the markers of a page; rows are metrics, thus few."""
    rows = card.orderBy("metric").collect()
    shown = [[r["metric"], _number(r["value"], 4) if r["value"] is not None else f"n/a ({r['na_reason'] or 'not recorded'})"] for r in rows]
    sources = sorted({r["source"] for r in rows if r["value"] is not None and r["source"]})
    counted = f"{sum(r['value'] is not None for r in rows)} of {len(rows)} metrics have a value; split {split_hash or 'n/a'}; from {', '.join(sources) or 'no file'}."
    return f"{_table(['metric', 'value'], shown)}\n\n{counted}"
