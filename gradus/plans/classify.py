"""Classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import classify
from gradus.plans.registry import Registry
from gradus.plans.tables import items, scored, sql

REGISTRY = Registry()
query = REGISTRY.query

REPORT = """report AS (SELECT model, class, sum(ref * n)::BIGINT AS support, sum((1 - ref) * n)::BIGINT AS predicted,
    sum(CASE WHEN ref = 1 AND hit THEN n ELSE 0 END)::BIGINT AS tp FROM (
      SELECT model, label AS class, 1 AS ref, label = pred AS hit, count(*) AS n FROM scored GROUP BY ALL
      UNION ALL SELECT model, pred, 0, label = pred, count(*) FROM scored GROUP BY ALL) GROUP BY model, class)"""
METRICS = """metrics AS (SELECT *, coalesce(tp / nullif(predicted::DOUBLE, 0), 0) AS precision, coalesce(tp / nullif(support::DOUBLE, 0), 0) AS recall,
    coalesce(2 * tp / nullif((support + predicted)::DOUBLE, 0), 0) AS f1 FROM report)"""


@query(
    sql(
        """recall AS (SELECT model, lang, label, avg(correct)::DOUBLE AS recall FROM scored GROUP BY ALL)""",
        """SELECT model, lang, avg(recall) AS balanced_accuracy, count(*) AS n_labels,
        100 * CASE WHEN count(*) = 1 THEN 0 ELSE greatest((avg(recall) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)), 0) END AS normalized_accuracy
        FROM recall GROUP BY model, lang""",
    ),
    "balanced_accuracy normalized_accuracy",
)
def mc_balanced_accuracy(spark, sf_dir):
    return classify.balanced_accuracy(scored(spark, sf_dir), ["model", "lang"])


@query(
    sql(
        """recall AS (SELECT model, lang, label, avg(correct)::DOUBLE AS recall FROM scored GROUP BY ALL)""",
        """by_lang AS (SELECT model, lang, 100 * CASE WHEN count(*) = 1 THEN 0 ELSE greatest((avg(recall) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)), 0) END AS score
        FROM recall GROUP BY model, lang)""",
        "SELECT model, avg(score) AS overall FROM by_lang GROUP BY model",
    ),
    "overall",
)
def mc_overall(spark, sf_dir):
    """Normalised balanced accuracy per language, then the mean of languages, for each model."""
    by_lang = classify.balanced_accuracy(scored(spark, sf_dir), ["model", "lang"])
    return by_lang.groupBy("model").agg(F.avg("normalized_accuracy").alias("overall"))


@query(sql(REPORT, METRICS, "SELECT model, avg(f1) AS macro_f1 FROM metrics GROUP BY model"), "macro_f1")
def mc_macro_f1(spark, sf_dir):
    return classify.macro_f1(scored(spark, sf_dir), ["model"])


@query(
    sql(
        REPORT,
        METRICS,
        "nulls AS (SELECT model, avg((pred = 'null')::INT) AS null_share, count_if(pred = 'null')::BIGINT AS null_count FROM scored GROUP BY model)",
        """SELECT m.model, avg(f1) AS label_f1, any_value(null_share) AS null_share, any_value(null_count) AS null_count,
        avg(f1) * (1 - any_value(null_share)) AS null_weighted_f1 FROM metrics m JOIN nulls USING (model) WHERE support > 0 GROUP BY m.model""",
    ),
    "label_f1 null_share null_weighted_f1",
)
def mc_null_weighted_f1(spark, sf_dir):
    return classify.null_weighted_f1(scored(spark, sf_dir), ["model"])


@query(sql("SELECT model, label, pred, count(*) AS n FROM scored GROUP BY ALL"))
def mc_confusion_matrix(spark, sf_dir):
    return classify.confusion(scored(spark, sf_dir), ["model"])


@query(sql(REPORT, METRICS, "SELECT model, class, support, precision, recall, f1 FROM metrics"), "precision recall f1")
def mc_class_report(spark, sf_dir):
    return classify.class_report(scored(spark, sf_dir), ["model"])


@query(
    sql(
        REPORT,
        METRICS,
        """SELECT model, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
        sum(precision * support) / sum(support)::DOUBLE AS weighted_precision, sum(recall * support) / sum(support)::DOUBLE AS weighted_recall,
        sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1 FROM metrics GROUP BY model""",
    ),
    "macro_precision macro_recall macro_f1 weighted_precision weighted_recall weighted_f1",
)
def mc_class_averages(spark, sf_dir):
    return classify.class_averages(scored(spark, sf_dir), ["model"])


@query(
    sql(
        """f AS (SELECT model, 'all' AS facet, 'all' AS value, label, correct FROM scored UNION ALL SELECT model, 'lang', lang, label, correct FROM scored
        UNION ALL SELECT model, 'competency', competency, label, correct FROM scored)""",
        """SELECT model, facet, value, avg(recall) AS balanced_accuracy FROM (SELECT model, facet, value, label, avg(correct)::DOUBLE AS recall FROM f GROUP BY ALL)
        GROUP BY model, facet, value""",
    ),
    "balanced_accuracy",
)
def mc_subgroup_accuracy(spark, sf_dir):
    return classify.subgroup_accuracy(scored(spark, sf_dir), ["model"], ["lang", "competency"])


@query(
    sql(
        """f AS (SELECT model, 'all' AS facet, 'all' AS value, label, pred FROM scored UNION ALL SELECT model, 'lang', lang, label, pred FROM scored UNION ALL SELECT model, 'competency', competency, label, pred FROM scored)""",
        "s AS (SELECT model, facet, value, label AS class, count(*) AS support, 0 AS predicted, count_if(label = pred) AS tp FROM f GROUP BY ALL UNION ALL SELECT model, facet, value, pred, 0, count(*), 0 FROM f GROUP BY ALL)",
        "SELECT model, facet, value, avg(f1) AS macro_f1 FROM (SELECT model, facet, value, class, 2 * sum(tp) / (sum(support) + sum(predicted))::DOUBLE AS f1 FROM s GROUP BY ALL) GROUP BY ALL",
    ),
    "macro_f1",
)
def mc_subgroup_macro_f1(spark, sf_dir):
    return classify.subgroup_macro_f1(scored(spark, sf_dir), ["model"], ["lang", "competency"])


@query(sql("SELECT item_id, model, run, pred, correct FROM scored"))
def mc_item_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("item_id", "model", "run", "pred", "correct")


@query(sql("SELECT model, avg((pred = label)::INT)::DOUBLE AS exact_match, count_if(pred = 'null')::BIGINT AS null_count FROM scored GROUP BY model"), "exact_match")
def mc_exact_match(spark, sf_dir):
    """Strict string equality, and how many responses named no label."""
    rows = scored(spark, sf_dir)
    return rows.groupBy("model").agg(F.avg("correct").alias("exact_match"), F.count_if(F.col("pred") == "null").alias("null_count"))


@query(sql("SELECT lang, label, count(*) AS n FROM items GROUP BY ALL"))
def item_counts(spark, sf_dir):
    return items(spark, sf_dir).groupBy("lang", "label").agg(F.count("*").alias("n"))
