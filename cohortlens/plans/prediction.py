"""Train and compare models over feature sets; explain the best."""

from __future__ import annotations

import functools
import logging
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import boosting as bo, evaluate as ev, explain as ex, select as sel, train as tr
from ..operators.features import vector_names
from ..operators.ranking import stratified_split
from ..session import materialize

log = logging.getLogger(__name__)

# Names used in settings and the feature sets they stand for.
FEATURE_KEYS = {
    "tfidf": "tfidf",
    "topic_distribution": "topic_lda",
    "structured": "structured",
    "combined": "combined",
    "text_stats": "text_stats",
    "embeddings": "embeddings",
}


def prediction_grid(
    spark: SparkSession,
    feature_sets: dict[str, DataFrame],
    labels: DataFrame,
    row_id: str = "doc_id",
    label: str = "label",
    models: list[str] | None = None,
    feature_types: list[str] | None = None,
    test_size: float = 0.2,
    val_size: float = 0.1,
    selection: dict | None = None,
    tuning: dict | None = None,
    params: dict[str, dict] | None = None,
    cv_folds: int = 5,
    metric: str = "roc_auc",
    seed: int = 42,
) -> dict:
    """``labels`` is (row_id, label).  Per feature set: split, select on the training
    rows, then per model tune, train, evaluate on test, find the threshold on
    validation, rank importances; cross-validate each set's best model; mark the best
    by ``metric``.

    The boosted models of all sets grow in shared passes, the others are fitted side by
    side.  All models score one table, from which every metric comes in one grouped pass.
    """
    models = models or tr.MODEL_NAMES
    feature_types = feature_types or ["tfidf", "topic_distribution", "structured", "combined"]
    params = params or {}
    split = materialize(
        stratified_split(labels.select(row_id, label), label, [row_id], test_size, val_size, seed)
        .select(row_id, label, "split"),
        "split",
    )
    names_of, selected, tuned, tables, held = {}, {}, {}, {}, []
    for kind in feature_types:
        frame = feature_sets.get(FEATURE_KEYS.get(kind, kind))
        if frame is None:
            log.warning("feature set %s is missing, skipped", kind)
            continue
        names = vector_names(frame)
        data = frame.join(split, row_id)
        if selection and kind in selection.get("apply_to", ["tfidf", "combined"]):
            options = {k: v for k, v in selection.items() if k not in ("apply_to", "method")}
            try:
                out = sel.select_features(
                    data.where(F.col("split") == "train"), label, selection.get("method", "univariate"), **options
                )
                data = sel.apply_selection(data, out["indices"], names=names)
                names, selected[kind] = out["names"], out
            except (KeyError, TypeError, ValueError) as error:  # bad settings: all features are used
                log.warning("selection failed on %s: %s", kind, error)
        tables[kind], names_of[kind] = data.persist(), names
        held.append(tables[kind])

    chosen = {}
    for kind, data in tables.items():
        for name in models:
            chosen[(name, kind)] = params.get(name)
            if tuning is not None:
                train = data.where(F.col("split") == "train")
                best, value = tr.tune(name, train, label, [row_id], seed=seed, **tuning)
                tuned[(name, kind)] = {"params": best, "cv_score": value}
                chosen[(name, kind)] = {**(params.get(name) or {}), **best}
    fitted = _fit_all(tables, models, chosen, label, row_id, seed)

    scored = None
    for (name, kind), model in fitted.items():
        rows = tables[kind].where(F.col("split") != "train")
        part = tr.score(model, rows, [row_id, label, "split"]).withColumns(
            {"model": F.lit(name), "feature_type": F.lit(kind)}
        )
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("none of the feature sets is there")
    scored = materialize(scored, "scores")
    keys = ["model", "feature_type"]
    order = F.create_map(*[F.lit(x) for i, (n, k) in enumerate(fitted) for x in (f"{n}/{k}", i)])
    tests = ev.binary_metrics(scored.where(F.col("split") == "test"), keys, label)
    cuts = ev.best_threshold(scored.where(F.col("split") == "val"), keys, label)
    results = materialize(
        tests.join(cuts, keys, "left").select(
            order[F.concat_ws("/", *keys)].alias("seq"), *keys, *ev.METRICS,
            F.col("threshold").alias("optimal_threshold"), F.col("value").alias("f1_at_optimal"),
        ),
        "results",
    )
    importances = {
        key: ev.top_importance(tr.feature_importance(model, names_of[key[1]], spark))
        for key, model in fitted.items()
    }

    def validated(row):
        raw = feature_sets[FEATURE_KEYS.get(row["feature_type"], row["feature_type"])]
        _, summary = tr.cross_validate(
            row["model"], raw.join(split, row_id), label, [row_id], cv_folds,
            params=params.get(row["model"]), seed=seed,
        )
        return summary.withColumn("feature_type", F.lit(row["feature_type"]))

    best_rows = ev.best_row(results, ["feature_type"], metric).orderBy("feature_type").collect()  # one per set
    with ThreadPool(len(best_rows)) as pool:
        summaries = functools.reduce(DataFrame.unionByName, pool.map(validated, best_rows))
    top = ev.best_row(results, [], metric).first()
    for data in held:
        data.unpersist()
    return {
        "results": results,
        "scores": scored,
        "models": fitted,
        "best": (top["model"], top["feature_type"]) if top else None,
        "importances": importances,
        "cross_validation": summaries,
        "selection": selected,
        "tuned": tuned,
        "tables": tables,
        "names": names_of,
    }


def _fit_all(tables: dict, models: list[str], chosen: dict, label: str, row_id: str, seed: int) -> dict:
    """Every (model, feature set), boosted ones together, the rest in threads."""
    kinds, fits, keys = list(tables), [], []
    boosted = []
    for number, kind in enumerate(kinds):
        train = tables[kind].where(F.col("split") == "train")
        ratio = tr.positive_weight({k[0]: n for k, n in tr.class_sizes(train, label).items()})
        weight = F.when(F.col("split") != "train", 0.0).when(F.col(label) == 1, ratio).otherwise(1.0)
        boosted.append(tables[kind].withColumns({tr.WEIGHT: weight, "_held": (F.col("split") == "val").cast("int")}))
        for name in models:
            if name in tr.BOOSTED:
                settings = tr.boosted_settings(name, chosen[(name, kind)], True, seed)
                fits.append(bo.Fit(settings, tr.WEIGHT, "_held" if settings.patience else None, number))
                keys.append((name, kind))

    def fit(task: tuple[str, str]):
        name, kind = task
        train = tables[kind].where(F.col("split") == "train")
        return tr.train_model(name, train, label, params=chosen[task], seed=seed)

    others = [(name, kind) for kind in kinds for name in models if name not in tr.BOOSTED]
    with ThreadPool(len(others) + 1) as pool:
        rest = pool.map_async(fit, others)
        found = dict(zip(keys, bo.fit_many(boosted, label, [row_id], fits))) if fits else {}
        found |= dict(zip(others, rest.get()))
    return {(name, kind): found[(name, kind)] for kind in kinds for name in models}


def explain_best(grid: dict, row_id: str = "doc_id", top_n: int = 20, n_rows: int = 3) -> dict:
    """Contributions of the best model on its test rows: every row, the global
    ranking and the rows with the largest sums."""
    kind = grid["best"][1]
    data, names = grid["tables"][kind], grid["names"][kind]
    model = grid["models"][grid["best"]]
    test = data.where(F.col("split") == "test")
    train = data.where(F.col("split") == "train")
    table = ex.contributions(model, test, train, row_id)
    largest = ex.largest_total(table, row_id, n_rows)
    shown = table.join(F.broadcast(largest.select(row_id)), row_id, "left_semi")
    return {
        "contributions": table,
        "global_importance": ex.global_importance(table, names, top_n),
        "local": ex.local_explanations(shown, names, row_id),
    }
