"""Creative advice: score, profile routing, refusals. Scores are recomputed from stored features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import text as tx
from plateworks.functions.arrays import first_match


def points(value: Column, table: dict[str, int]) -> Column:
    return first_match([(value == k, F.lit(v)) for k, v in table.items()], F.lit(None).cast("int"))


def commercial_score(features: Column) -> Column:
    cases = F.coalesce(F.size(features["commercial_use_cases"]), F.lit(0))
    return (points(features["composition"], fixed.COMPOSITION_POINTS) + points(features["demand"], fixed.DEMAND_POINTS)
            + points(features["uniqueness"], fixed.UNIQUENESS_POINTS)
            + F.least(cases * fixed.USE_CASE_POINTS, F.lit(fixed.USE_CASE_MAX_POINTS))).cast("bigint")


def potential(score: Column) -> Column:
    return F.when(score >= fixed.POTENTIAL_HIGH_FROM, "high").when(score >= fixed.POTENTIAL_MEDIUM_FROM, "medium").when(score.isNotNull(), "low")


def summary(slots: DataFrame) -> DataFrame:
    """slots(asset_id, creative_advised) -> reviewed, profile, score, potential, recommendation."""
    advised = F.col("creative_advised")
    score = commercial_score(advised["features"])
    return slots.select("asset_id", advised.isNotNull().alias("reviewed"), advised["profile"]["name"].alias("profile"), score.alias("score"),
                        potential(score).alias("potential"), advised["features"]["recommendation"].alias("recommendation"))


def profile_scores(subject: Column, title: Column, keywords: Column) -> dict[str, Column]:
    """Terms in subject or title weigh three, terms in the keywords one."""
    main = tx.fold(F.concat_ws(" . ", subject, title))
    words = tx.fold(F.concat_ws(" . ", keywords))
    return {name: (3 * tx.count_terms(main, terms) + tx.count_terms(words, terms)).cast("bigint") for name, terms in fixed.ROUTE_TERMS.items()}


def best_profile(scores: dict[str, Column]) -> Column:
    """Highest score; ties prefer the default, then the declared order; no hits, the default."""
    default = fixed.DEFAULT_CREATIVE_PROFILE
    ranked = F.array_sort(F.array(*[F.struct((-score).alias("worst"), F.lit(int(name != default)).alias("other"), F.lit(i).alias("order"), F.lit(name).alias("name"))
                                    for i, (name, score) in enumerate(scores.items())]))
    top = ranked[0]
    return F.when(top["worst"] < 0, top["name"]).otherwise(default)


def refusal(personal_document: Column) -> Column:
    """Why a review is refused without an event, or null (state columns of the stages)."""
    upstream = F.coalesce(*[F.when(F.col(f"{s}_status") != "current", s) for s in fixed.REQUIRED_STAGES], F.lit(None).cast("string"))
    return first_match([
        (F.col("vision") != "done", "VISION_MISSING"), (personal_document, "PERSONAL_DOCUMENT"),
        (F.col("creative_review_status") == "not_applicable", "CREATIVE_NOT_APPLICABLE"),
        (upstream.isNotNull(), F.concat(F.lit("UPSTREAM_NOT_CURRENT:"), upstream))], F.lit(None).cast("string"))


def previous_profile(advised: Column) -> Column:
    """auto stays auto, an explicit choice keeps its name, otherwise the default (null)."""
    mode = advised["profile"]["selection"]["mode"]
    return F.when(mode == "auto", "auto").when(mode == "explicit", advised["profile"]["name"])
