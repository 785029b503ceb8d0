"""The four analysis stages over one long table of all datasets.

rows: dataset, commit_id, date, label and feature columns. Every stage returns its tables by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import CLASSIC_METRICS, concept_of, family_of
from gleaner.operators import model, ranking, rollup, scores, timeline

SEED = 20260505
REPORTED = ("gmean", "recall0", "recall1", "mcc", "f1")
#: Feature sets of stage 4, each the classic metrics and a group of others. Halstead counts that differ by case
#: only are called eta1, eta2 (distinct) and total1, total2.
CATEGORIES = {
    "kamei_14": (),
    "kamei_method_cc": (
        "current_method_cc_mean",
        "current_method_cc_max",
        "current_method_cc_min",
        "current_method_cc_std",
    ),
    "kamei_method_structure": (
        "current_method_nargs_mean",
        "current_method_nargs_max",
        "current_method_nargs_min",
        "current_method_nargs_std",
        "current_method_nexits_mean",
        "current_method_nexits_max",
        "current_method_nexits_min",
        "current_method_nexits_std",
    ),
    "kamei_halstead": (
        "current_method_halstead_eta1_mean",
        "current_method_halstead_eta1_max",
        "current_method_halstead_eta1_min",
        "current_method_halstead_eta1_std",
        "current_method_halstead_eta2_mean",
        "current_method_halstead_eta2_max",
        "current_method_halstead_eta2_min",
        "current_method_halstead_eta2_std",
        "current_method_halstead_total1_mean",
        "current_method_halstead_total1_max",
        "current_method_halstead_total1_min",
        "current_method_halstead_total1_std",
        "current_method_halstead_total2_mean",
        "current_method_halstead_total2_max",
        "current_method_halstead_total2_min",
        "current_method_halstead_total2_std",
        "current_method_halstead_length_mean",
        "current_method_halstead_length_max",
        "current_method_halstead_length_min",
        "current_method_halstead_length_std",
        "current_method_halstead_vocabulary_mean",
        "current_method_halstead_vocabulary_max",
        "current_method_halstead_vocabulary_min",
        "current_method_halstead_vocabulary_std",
        "current_method_halstead_volume_mean",
        "current_method_halstead_volume_max",
        "current_method_halstead_volume_min",
        "current_method_halstead_volume_std",
        "current_method_halstead_difficulty_mean",
        "current_method_halstead_difficulty_max",
        "current_method_halstead_difficulty_min",
        "current_method_halstead_difficulty_std",
        "current_method_halstead_effort_mean",
        "current_method_halstead_effort_max",
        "current_method_halstead_effort_min",
        "current_method_halstead_effort_std",
        "current_method_halstead_bugs_mean",
        "current_method_halstead_bugs_max",
        "current_method_halstead_bugs_min",
        "current_method_halstead_bugs_std",
        "current_method_halstead_time_mean",
        "current_method_halstead_time_max",
        "current_method_halstead_time_min",
        "current_method_halstead_time_std",
    ),
    "kamei_file_metrics": (
        "current_file_cloc_mean",
        "current_file_cloc_max",
        "current_file_cloc_min",
        "current_file_cloc_std",
        "current_file_mi_mean",
        "current_file_mi_max",
        "current_file_mi_min",
        "current_file_mi_std",
        "current_file_nom_mean",
        "current_file_nom_max",
        "current_file_nom_min",
        "current_file_nom_std",
    ),
    "kamei_coupling": (
        "current_method_in_coupling_mean",
        "current_method_in_coupling_max",
        "current_method_in_coupling_min",
        "current_method_in_coupling_std",
        "current_method_out_coupling_mean",
        "current_method_out_coupling_max",
        "current_method_out_coupling_min",
        "current_method_out_coupling_std",
    ),
    "kamei_global_var": (
        "current_method_global_var_count_mean",
        "current_method_global_var_count_max",
        "current_method_global_var_count_min",
        "current_method_global_var_count_std",
    ),
    "kamei_commit_stats": (
        "modified_method_count_current",
        "current_new_file_count",
        "current_new_file_ratio",
    ),
}


def category_features(name: str) -> list[str]:
    return [*CLASSIC_METRICS, *CATEGORIES[name]]


def long_form(rows: DataFrame, features: list[str]) -> DataFrame:
    """(dataset, y, feature, x)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return rows.select("dataset", F.col("label").alias("y"), F.explode(pairs).alias("p")).select("dataset", "y", "p.feature", "p.x")


def univariate(rows: DataFrame, features: list[str], methods: tuple[str, ...] = ("spearman", "mutual_info", "kendall")) -> dict[str, DataFrame]:
    """Stage 1: scores by method, pooled to concepts, clustered into ranks, and their consensus."""
    scorer = {"spearman": scores.spearman, "mutual_info": scores.mutual_information, "kendall": scores.kendall}
    unknown = [m for m in methods if m not in scorer]
    if unknown:
        raise ValueError(f"unknown score: {unknown}")
    data = long_form(rows, features)
    ranks: dict[str, DataFrame] = {}
    for m in methods:
        pooled = rollup.max_pool(scorer[m](data, ["dataset", "feature"]).withColumn("concept", concept_of(F.col("feature"))), ["dataset", "concept"])
        ranks[m] = ranking.rank_clusters(pooled.withColumn("method", F.lit(m)), ["method"])
    every = None
    for r in ranks.values():
        every = r if every is None else every.unionByName(r)
    consensus = ranking.consensus(every).withColumn("feature_family", family_of(F.col("concept")))
    wide = every.groupBy("concept").pivot("method", list(methods)).agg(F.first("rank"))
    return {f"npsk_ranks_{m}": r for m, r in ranks.items()} | {"consensus_ranking": wide.join(consensus, "concept").orderBy("consensus_rank", F.asc_nulls_last("rank_std"), "concept"), "all_concept_npsk_ranks_long": every}


def _modelled(rows: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame, list]:
    """(cells of the windows that are used, persisted; all windows; those used)."""
    numbered = model.assembled(timeline.numbered(rows), features).select("dataset", "commit_id", "date", "label", "idx", "features").persist()
    records = timeline.records(numbered, timeline.windows(numbered)).orderBy("dataset", "window_id").persist()
    wins = [w for w in records.collect() if w.used_for_modeling]  # a handful of windows a dataset
    cells = model.sliced(numbered, wins).persist()
    cells.count()
    numbered.unpersist()
    return cells, records, wins


def forest(rows: DataFrame, features: list[str], bootstraps: int = 20, points: list[dict] | None = None) -> dict[str, DataFrame]:
    """Stage 2: per window tune, then fit on bootstraps; importances ranked by dataset and over datasets."""
    points, spark = points or model.grid(), rows.sparkSession
    cells, records, wins = _modelled(rows, features)
    seeds = [SEED + w.window_id for w in wins]
    picked = model.tune(cells, wins, seeds, points, len(features))
    wanted = [
        (w.dataset, w.window_id, 0, b, True, model.tries(point["features"], len(features)), [point["leaf"]], [point["trees"]], seed * 1000 + b)
        for w, seed, point in zip(wins, seeds, picked, strict=True)
        for b in range(1, bootstraps + 1)
    ]
    mdi, performance = [], []
    for r in model.evaluate(model.fit(cells, wanted)) if wanted else ():
        mdi += [(r.dataset, r.window_id, r.repeat, f, x) for f, x in zip(features, r.importance, strict=True)]
        performance.append((r.dataset, r.window_id, r.repeat, *[r[m] for m in model.METRICS]))
    tuned = [(w.dataset, w.window_id, point["trees"], point["features"], point["leaf"]) for w, point in zip(wins, picked, strict=True)]
    cells.unpersist()
    if not mdi:
        raise ValueError("no window has both classes in its training and test slices")
    imp = spark.createDataFrame(mdi, "dataset string, window_id long, bootstrap_id int, feature string, importance double")
    out = {
        "time_windows": records,
        "tuned_params": spark.createDataFrame(tuned, "dataset string, window_id long, trees int, features string, leaf int"),
        "window_performance": spark.createDataFrame(performance, "dataset string, window_id long, bootstrap_id int, " + ", ".join(f"{m} double" for m in model.METRICS)),
    }
    for scheme, concept in (("grouped", concept_of(F.col("feature"))), ("raw", F.col("feature"))):
        pooled = rollup.sum_importance(imp.withColumn("concept", concept), ["dataset", "window_id", "bootstrap_id", "concept"])
        local = ranking.rank_clusters(pooled, ["dataset"], value="importance").persist()
        meta = ranking.rank_clusters(local.withColumn("all", F.lit("all")), ["all"], value="rank", higher_is_better=False)
        meta = meta.select("concept", F.col("rank").alias("meta_mdi_npsk_rank"), F.col("cluster").alias("meta_mdi_npsk_cluster"))
        table = ranking.rank_table(local, meta).withColumn("feature_family", family_of(F.col("concept")))
        out |= {
            f"{scheme}_mdi": pooled,
            f"{scheme}_local_npsk_ranks": local,
            f"{scheme}_top_rank_frequency": ranking.top_rank_frequency(local).orderBy(F.desc("rank1_frequency"), "mean_rank"),
            f"{scheme}_meta_npsk_ranks": meta,
            f"{scheme}_mdi_npsk_ranks": table.orderBy(F.asc_nulls_last("meta_mdi_npsk_rank"), "mean_rank", "concept"),
            f"{scheme}_rank_long": ranking.rank_long(local, meta.select("concept", F.col("meta_mdi_npsk_rank").alias("rank"))),
        }
    return out


def _sets(rows: DataFrame, sets: dict[str, list[str]], repeats: int, points: list[dict], steps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    missing = {f for fs in sets.values() for f in fs} - set(rows.columns)
    if missing:
        raise ValueError(f"missing features: {sorted(missing)}")
    done, records = [], None
    for name, features in sets.items():
        cells, records, wins = _modelled(rows, features)
        seeds = [SEED + w.window_id + 100 * steps[name] for w in wins]
        wanted = [
            (w.dataset, w.window_id, 0, r, False, model.tries(point["features"], len(features)), [point["leaf"]], [point["trees"]], seed + r)
            for w, seed, point in zip(wins, seeds, model.tune(cells, wins, seeds, points, len(features)), strict=True)
            for r in range(1, repeats + 1)
        ]
        for r in model.evaluate(model.fit(cells, wanted)) if wanted else ():
            done.append((name, r.dataset, r.window_id, r.repeat, len(features), *[r[m] for m in REPORTED]))
        cells.unpersist()
    schema = "experiment string, dataset string, window_id long, repeat int, selected_feature_count int, " + ", ".join(f"{m} double" for m in REPORTED)
    return rows.sparkSession.createDataFrame(done, schema), records


def _summaries(prefix: str, performance: DataFrame, records: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    means = performance.groupBy("dataset", "experiment").agg(*[F.avg(m).alias(m) for m in REPORTED])
    return (
        {f"{prefix}_performance": performance, f"{prefix}_performance_summary": rollup.performance_summary(performance, ["dataset", "experiment"], list(REPORTED)), f"{prefix}_time_windows": records, f"{prefix}_dataset_metric_means": means}
        | {f"{prefix}_{m}_matrix": rollup.metric_matrix(means, "dataset", "experiment", names, m) for m in REPORTED}
        | {f"{prefix}_median_across_datasets": rollup.median_across(means, ["experiment"], list(REPORTED))}
    )


def top_k(rows: DataFrame, ranks: DataFrame, percents: tuple[int, ...] = tuple(range(10, 101, 10)), repeats: int = 5, points: list[dict] | None = None, baseline: list[str] | None = None) -> dict[str, DataFrame]:
    """Stage 3: the classic features against the best k per cent of rank groups. ranks: concept, meta_mdi_npsk_rank, mean_rank."""
    usable = ranks.filter(F.col("concept").isin(*rows.columns))
    if usable.filter(F.col("meta_mdi_npsk_rank").isNull()).count():
        raise ValueError("features without a meta rank")
    chosen = ranking.top_groups(usable.withColumnRenamed("concept", "feature"), list(percents), "meta_mdi_npsk_rank").persist()
    sets = {"baseline": baseline if baseline is not None else [c for c in CLASSIC_METRICS if c in rows.columns]}
    for r in chosen.groupBy("topk_percent").agg(F.sort_array(F.collect_list("feature")).alias("f")).orderBy("topk_percent").collect():  # ten rows
        sets[f"top_{r.topk_percent}"] = list(r.f)
    sets = {k: v for k, v in sets.items() if v}
    steps = {k: int(k.removeprefix("top_")) if k != "baseline" else 0 for k in sets}  # seeds move by per cent
    performance, records = _sets(rows, sets, repeats, points or model.grid(), steps)
    final = ranking.final_rank(usable, ["meta_mdi_npsk_rank", "mean_rank", "concept"])
    return {"topk_global_feature_ranking": final, "stage3_selected_features": chosen} | _summaries("topk", performance, records, list(sets))


def categories(rows: DataFrame, sets: dict[str, list[str]] | None = None, repeats: int = 5, points: list[dict] | None = None) -> dict[str, DataFrame]:
    """Stage 4: classic features with one group of new ones at a time."""
    sets = sets or {k: category_features(k) for k in CATEGORIES}
    performance, records = _sets(rows, sets, repeats, points or model.grid(), {k: i for i, k in enumerate(sets)})
    rows_ = [(k, i, f) for k, fs in sets.items() for i, f in enumerate(fs, 1)]
    return {"stage4_selected_features": rows.sparkSession.createDataFrame(rows_, "experiment string, position int, feature string")} | _summaries("stage4", performance, records, list(sets))
