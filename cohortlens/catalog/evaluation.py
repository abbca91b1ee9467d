"""Scored rows: metrics, curves, thresholds, result tables, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions.numeric import safe_double
from ..operators import evaluate as ev, fairness as fr
from .common import r6, sales, scored, sql_r6, table, with_scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- bands -----------------------------------------------------------------------


@query(
    "p13_risk_band",
    with_scored(
        """SELECT row_id, CAST(y_prob >= 0.5 AS INTEGER) AS predicted_label,
           CASE WHEN y_prob < 0.3 THEN 'low' WHEN y_prob < 0.6 THEN 'moderate' ELSE 'high' END
             AS risk_level FROM scored"""
    ),
)
def p13(spark, d):
    return scored(spark, d).select(
        "row_id",
        bands.predicted_label(F.col("y_prob")).alias("predicted_label"),
        bands.risk_band(F.col("y_prob")).alias("risk_level"),
    )


@query(
    "p14_direction",
    """SELECT event_id, CASE WHEN value - 20 > 0 THEN 'increases risk' ELSE 'decreases risk' END
       AS direction FROM events""",
)
def p14(spark, d):
    return table(spark, d, "events").select(
        "event_id", bands.direction(F.col("value") - 20).alias("direction")
    )


@query(
    "p17_safe_double",
    """SELECT event_id, coalesce(CASE WHEN abs(v) <= 1e300 THEN v END, 0) AS v FROM (
         SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type
           WHEN event_id % 5 = 1 THEN 'NaN' WHEN event_id % 5 = 2 THEN 'Infinity'
           WHEN event_id % 5 = 3 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)""",
)
def p17(spark, d):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.col("event_type")).when(k == 1, "NaN").when(k == 2, "Infinity")
        .when(k == 4, F.col("value").cast("string"))
    )
    return table(spark, d, "events").select("event_id", safe_double(raw).alias("v"))


# --- metrics ----------------------------------------------------------------------

_CONFUSION = """
cc AS (SELECT {keys}, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
  count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM {source} GROUP BY {keys}),
cr AS (SELECT *, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr,
  CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END AS fnr,
  (tp + fp) / (tp + fp + fn + tn)::DOUBLE AS selection_rate FROM cc)
"""
_AREAS = """
vt AS (SELECT {keys}, y_prob AS v, sum(y_true)::DOUBLE AS p, sum(1 - y_true)::DOUBLE AS n
       FROM {source} GROUP BY {keys}, y_prob),
cu AS (SELECT *, sum(p) OVER (PARTITION BY {keys}) AS tp_all, sum(n) OVER (PARTITION BY {keys}) AS tn_all,
       sum(p) OVER w AS cp, sum(n) OVER w AS cn
       FROM vt WINDOW w AS (PARTITION BY {keys} ORDER BY v DESC)),
ar AS (SELECT {keys}, CASE WHEN max(tp_all) > 0 AND max(tn_all) > 0
         THEN sum(n * (cp - p) + n * p / 2) / (max(tp_all) * max(tn_all)) ELSE 0 END AS roc_auc,
       CASE WHEN max(tp_all) > 0 AND max(tn_all) > 0
         THEN sum(p * cp / (cp + cn)) / max(tp_all) ELSE 0 END AS pr_auc FROM cu GROUP BY {keys})
"""


def _metrics_sql(keys: str, source: str = "scored") -> str:
    return (
        _CONFUSION.format(keys=keys, source=source)
        + ","
        + _AREAS.format(keys=keys, source=source)
    )


def _r4(name: str) -> str:
    return f"round_even({name}, 4) + 0 AS {name}"


@query(
    "a16_confusion_counts",
    with_scored(
        f""", all_rows AS (SELECT 1 AS k, * FROM scored),
        {_CONFUSION.format(keys="k", source="all_rows")}
        SELECT tp, fp, fn, tn, accuracy, precision, recall, f1 FROM cr"""
    ),
)
def a16(spark, d):
    out = ev.confusion_rates(ev.confusion_counts(scored(spark, d), []))
    return out.select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


@query(
    "m9_binary_metrics",
    with_scored(
        f""", {_metrics_sql("fold")} SELECT fold, {", ".join(_r4(m) for m in ev.METRICS)},
        tp, fp, fn, tn FROM cr JOIN ar USING (fold)"""
    ),
)
def m9(spark, d):
    return ev.binary_metrics(scored(spark, d), ["fold"])


_SALES = """sales AS (SELECT l_returnflag AS grp, l_extendedprice AS y_prob,
  CAST(l_linestatus = 'F' AS INTEGER) AS y_true FROM lineitem)"""


@query(
    "m9_areas_large",
    f"""WITH {_SALES}, {_AREAS.format(keys="grp", source="sales")}
        SELECT grp, {sql_r6('roc_auc')} AS roc_auc, {sql_r6('pr_auc')} AS pr_auc FROM ar""",
)
def m9_large(spark, d):
    from ..operators.ranking import label_totals, rank_sums

    out = rank_sums(label_totals(sales(spark, d), ["grp"], "value", "outcome"), ["grp"])
    return out.select("grp", r6(F.col("roc_auc")).alias("roc_auc"), r6(F.col("pr_auc")).alias("pr_auc"))


@query(
    "m10_roc_points",
    f"""WITH {_SALES}, {_AREAS.format(keys="grp", source="sales")},
    nx AS (SELECT *, lead(p) OVER w AS np, lead(n) OVER w AS nn FROM cu
           WINDOW w AS (PARTITION BY grp ORDER BY v DESC))
    SELECT grp, v AS threshold, cn / tn_all AS fpr, cp / tp_all AS tpr
    FROM nx WHERE np IS NULL OR np <> p OR nn <> n
    UNION ALL SELECT DISTINCT grp, 'Infinity'::DOUBLE, 0, 0 FROM sales""",
)
def m10_roc(spark, d):
    return ev.roc_points(sales(spark, d), ["grp"], "outcome", "value", lone_ends=False)


@query(
    "m10_pr_points",
    f"""WITH {_SALES}, {_AREAS.format(keys="grp", source="sales")}
    SELECT grp, v AS threshold, cp / (cp + cn) AS precision, cp / tp_all AS recall
    FROM cu UNION ALL SELECT DISTINCT grp, 'Infinity'::DOUBLE, 1, 0 FROM sales""",
)
def m10_pr(spark, d):
    return ev.pr_points(sales(spark, d), ["grp"], "outcome", "value", lone_ends=False)


_THRESHOLDS = """, th AS (SELECT i / 100.0::DOUBLE AS t FROM range(10, 91) r(i)),
sc AS (SELECT fold, t, count(*) FILTER (y_true = 1 AND y_prob >= t)::DOUBLE AS tp,
  count(*) FILTER (y_true = 0 AND y_prob >= t)::DOUBLE AS fp,
  count(*) FILTER (y_true = 1 AND y_prob < t)::DOUBLE AS fn,
  count(*) FILTER (y_true = 0 AND y_prob < t)::DOUBLE AS tn FROM scored, th GROUP BY 1, 2),
g AS (SELECT fold, t, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  tp / (tp + fn) + tn / (tn + fp) - 1 AS youden FROM sc)"""


def _best_threshold_sql(metric: str) -> str:
    return with_scored(
        f"""{_THRESHOLDS} SELECT fold,
          CASE WHEN {metric} > 0 THEN t ELSE 0.5 END AS threshold,
          CASE WHEN {metric} > 0 THEN round_even({metric}, 4) + 0 ELSE 0 END AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {metric} DESC, t) AS r FROM g) WHERE r = 1"""
    )


@query("m11_best_threshold_f1", _best_threshold_sql("f1"))
def m11_f1(spark, d):
    return ev.best_threshold(scored(spark, d), ["fold"], metric="f1")


@query("m11_best_threshold_youden", _best_threshold_sql("youden"))
def m11_youden(spark, d):
    return ev.best_threshold(scored(spark, d), ["fold"], metric="youden")


@query(
    "m11_threshold_grid",
    with_scored(f"{_THRESHOLDS} SELECT fold, t AS threshold, f1 AS value FROM g"),
)
def m11_grid(spark, d):
    return ev.threshold_scores(scored(spark, d), ["fold"])


# --- result tables: one row per (language, fold) of the scored rows -----------------


def results(spark, d):
    out = ev.binary_metrics(scored(spark, d), ["lang", "fold"])
    order = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang"))
    return out.select(
        (order * 3 + F.col("fold")).cast("int").alias("seq"),
        F.col("lang").alias("model"),
        F.concat(F.lit("set"), F.col("fold")).alias("feature_type"),
        *ev.METRICS,
    )


_RESULTS = f""", {_metrics_sql("lang, fold")},
results AS (SELECT CAST(CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END * 3 + fold
    AS INTEGER) AS seq, lang AS model, 'set' || fold AS feature_type,
  {", ".join(_r4(m) for m in ev.METRICS)} FROM cr JOIN ar USING (lang, fold))"""


def with_results(body: str) -> str:
    return with_scored(_RESULTS + body)


@query(
    "a8_metric_pivot",
    with_results(
        f""" SELECT model, {", ".join(
            sql_r6(f"coalesce(avg(roc_auc) FILTER (feature_type = 'set{i}'), 0)") + f" AS set{i}"
            for i in range(3))} FROM results GROUP BY model"""
    ),
)
def a8(spark, d):
    wide = ev.metric_pivot(results(spark, d), ["set0", "set1", "set2"], missing=0.0)
    return wide.select("model", *[r6(F.col(f"set{i}")).alias(f"set{i}") for i in range(3)])


@query(
    "a9_best_rows",
    with_results(
        """ SELECT 'model' AS scope, model, feature_type, roc_auc FROM (SELECT *, row_number() OVER
          (PARTITION BY model ORDER BY roc_auc DESC, seq) AS r FROM results) WHERE r = 1
        UNION ALL SELECT 'feature_type', model, feature_type, roc_auc FROM (SELECT *, row_number() OVER
          (PARTITION BY feature_type ORDER BY roc_auc DESC, seq) AS r FROM results) WHERE r = 1
        UNION ALL SELECT * FROM (SELECT 'overall', model, feature_type, roc_auc FROM results
          ORDER BY roc_auc DESC, seq LIMIT 1)"""
    ),
)
def a9(spark, d):
    table_ = results(spark, d)
    parts = [
        ev.best_row(table_, by).select(F.lit(name).alias("scope"), "model", "feature_type", "roc_auc")
        for name, by in (("model", ["model"]), ("feature_type", ["feature_type"]), ("overall", []))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a12_fold_summary",
    with_results(
        f""" SELECT model, count(*) AS n_folds, {", ".join(
            f"round_even(avg({m}), 4) + 0 AS {m}_mean, round_even(stddev_samp({m}), 4) + 0 AS {m}_std"
            for m in ("f1", "roc_auc", "pr_auc"))} FROM results GROUP BY model"""
    ),
)
def a12(spark, d):
    return ev.fold_summary(results(spark, d), ["model"])


@query(
    "m12_fold_metrics",
    with_scored(
        f""", {_metrics_sql("fold")} SELECT fold, {", ".join(f"{sql_r6(m)} AS {m}" for m in ("f1", "roc_auc", "pr_auc"))}
        FROM cr JOIN ar USING (fold)"""
    ),
)
def m12(spark, d):
    out = ev.binary_metrics(scored(spark, d), ["fold"], digits=None)
    return out.select("fold", *[r6(F.col(m)).alias(m) for m in ("f1", "roc_auc", "pr_auc")])


@query(
    "k6_filtered_results",
    with_results(
        """ SELECT model, feature_type, roc_auc FROM results
           WHERE model IN ('en', 'fr') AND feature_type IN ('set0', 'set2') ORDER BY roc_auc DESC"""
    ),
)
def k6(spark, d):
    kept = ev.filter_results(results(spark, d), ["en", "fr"], ["set0", "set2"])
    return kept.select("model", "feature_type", "roc_auc")


@query(
    "k3_top_importance",
    f"""SELECT feature, {sql_r6('importance')} AS importance, {sql_r6('abs(importance)')} AS abs_importance
        FROM (SELECT event_type || user_id AS feature, sum(value) - 400 AS importance FROM events GROUP BY 1)
        ORDER BY abs(importance) DESC, feature LIMIT 30""",
)
def k3(spark, d):
    weights = table(spark, d, "events").groupBy(
        F.concat("event_type", F.col("user_id").cast("string")).alias("feature")
    ).agg((F.sum("value") - 400).alias("importance"))
    out = ev.top_importance(weights, 30)
    return out.select(
        "feature", r6(F.col("importance")).alias("importance"),
        r6(F.col("abs_importance")).alias("abs_importance"),
    )


# --- fairness -------------------------------------------------------------------------

_GROUPS = """, long AS (SELECT y_true, y_pred, 'lang' AS attribute, lang AS grp FROM scored
  UNION ALL SELECT y_true, y_pred, 'source', source FROM scored WHERE source IS NOT NULL),
""" + _CONFUSION.format(keys="attribute, grp", source="long")
_GAPS = """,
gaps AS (SELECT attribute, max(selection_rate) - min(selection_rate) AS dp,
  greatest(max(recall) - min(recall), max(fpr) - min(fpr)) AS eo,
  max(fpr) - min(fpr) AS fprd, max(fnr) - min(fnr) AS fnrd FROM cr GROUP BY attribute),
dis AS (SELECT attribute, round_even(dp, 4) + 0 AS demographic_parity_difference,
  round_even(eo, 4) + 0 AS equalized_odds_difference, round_even(fprd, 4) + 0 AS fpr_difference,
  round_even(fnrd, 4) + 0 AS fnr_difference FROM gaps),
dl AS (UNPIVOT dis ON demographic_parity_difference, equalized_odds_difference, fpr_difference,
  fnr_difference INTO NAME metric VALUE value)"""
ATTRIBUTES = ["lang", "source", "not_a_column"]


def counts(spark, d):
    return fr.group_counts(scored(spark, d), ATTRIBUTES)


@query(
    "a17_group_counts",
    with_scored(_GROUPS + ' SELECT attribute, grp AS "group", tp, fp, fn, tn FROM cr'),
)
def a17(spark, d):
    return counts(spark, d)


@query(
    "g1_group_metrics",
    with_scored(
        _GROUPS
        + f""" SELECT attribute, grp AS "group", tp + fp + fn + tn AS n_samples,
          round_even((tp + fn) / (tp + fp + fn + tn)::DOUBLE, 4) + 0 AS positive_rate,
          {", ".join(_r4(m) for m in fr.GROUP_METRICS)} FROM cr"""
    ),
)
def g1(spark, d):
    return fr.group_metrics(counts(spark, d))


@query("g2_disparities", with_scored(_GROUPS + _GAPS + " SELECT * FROM dis"))
def g2(spark, d):
    return fr.disparities(counts(spark, d))


@query(
    "g3_fairness_audit",
    with_scored(
        _GROUPS + _GAPS
        + """ SELECT attribute, metric, value, CASE WHEN abs(value) < 0.05 THEN 'low'
          WHEN abs(value) < 0.1 THEN 'moderate' ELSE 'high' END AS level, abs(value) > 0.1 AS flagged FROM dl"""
    ),
)
def g3(spark, d):
    return fr.fairness_audit(scored(spark, d), ATTRIBUTES)["summary"]


@query(
    "p15_disparity_level",
    """SELECT event_id, CASE WHEN abs(value / 500) < 0.05 THEN 'low' WHEN abs(value / 500) < 0.1
       THEN 'moderate' ELSE 'high' END AS level, abs(value / 500) > 0.1 AS flagged FROM events""",
)
def p15(spark, d):
    v = F.col("value") / 500
    return table(spark, d, "events").select(
        "event_id", bands.disparity_level(v).alias("level"), bands.disparity_flag(v).alias("flagged")
    )


@query(
    "a13_largest_disparity",
    with_scored(
        _GROUPS + _GAPS
        + """ SELECT attribute, greatest(demographic_parity_difference, equalized_odds_difference,
          fpr_difference, fnr_difference) AS largest FROM dis"""
    ),
)
def a13(spark, d):
    return fr.largest_disparity(fr.disparities(counts(spark, d)))
