"""Scoring and all reports of one observation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegrade.operators import statistics as S
from sitegrade.operators.scoring import final_scores, platform_count, stamp_analysis
from sitegrade.operators.summary import header_counts, summarize, summarize_all
from sitegrade.plans import charts, tables
from sitegrade.policy import DEFAULT_POLICY, Policy
from sitegrade.sources.readers import read_scores
from sitegrade.sources.writers import write_region_scores, write_scores, write_worst


def build_reports(
    worst_summary: DataFrame, all_summary: DataFrame, policy: Policy = DEFAULT_POLICY
) -> dict[str, DataFrame]:
    """Every report data set by name, from the summaries of the two score tables."""
    adoption = S.adoption_stats(worst_summary, policy)
    inconsistency = S.inconsistency_stats(worst_summary)
    versions = S.http_version_stats(worst_summary)
    return {
        "inconsistency_stats": inconsistency,
        "inconsistency_table": tables.inconsistency_table(inconsistency),
        "dot_chart_data": charts.dot_chart_data(inconsistency),
        "http_version_stats": versions,
        "http_version_table": tables.http_version_table(versions),
        "bar_chart_data": charts.bar_chart_data(versions),
        "adoption_stats": adoption,
        "adoption_table": tables.adoption_table(adoption, policy=policy),
        "weak_table": tables.adoption_table(adoption, weak=True, policy=policy),
        "heatmap_data": charts.heatmap_data(adoption, policy),
        "radar_data": charts.radar_data(S.adoption_stats(all_summary, policy), policy),
        "region_score_table": tables.region_score_table(S.region_scores(worst_summary)),
    }


def run_reports(
    spark: SparkSession,
    observations: DataFrame,
    out: str,
    policy: Policy = DEFAULT_POLICY,
) -> dict[str, str]:
    """Score, then write every report below ``out``. Returns report name -> path.

    The observations, the score tables and the two summaries are written and read back. So the work up
    to them runs once, however the observations come about (scoring reads them three times), and
    a lost executor never repeats more than one step.
    """
    scores, worst, cut = f"{out}/scores", f"{out}/worst_scores", f"{out}/observations"
    observations.write.mode("overwrite").parquet(cut)
    stored = spark.read.schema(observations.schema).parquet(cut)
    n_platforms = platform_count(stored).first().n_platforms
    scored = final_scores(stored, policy, n_platforms)
    write_scores(stamp_analysis(scored), scores, policy)
    write_worst(read_scores(spark, scores, policy), worst, policy)

    summaries = {}
    for name, path, summary in (
        ("worst", worst, lambda df: summarize_all(df, policy)),
        ("all", scores, lambda df: summarize(df, header_counts(policy))),
    ):
        target = f"{out}/summary_{name}"
        summary(read_scores(spark, path, policy)).write.mode("overwrite").parquet(target)
        summaries[name] = spark.read.parquet(target)

    written = {"scores": scores, "worst_scores": worst}
    for name, report in build_reports(summaries["worst"], summaries["all"], policy).items():
        written[name] = f"{out}/reports/{name}"
        report.coalesce(1).write.mode("overwrite").parquet(written[name])
    written["region_scores"] = f"{out}/region_scores"
    write_region_scores(S.region_scores(summaries["worst"]), written["region_scores"])
    return written
