"""Accuracy of the automatic decisions against manual reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.operators.ordered import top_per_key

# Judgments, and the acceptance gates of a review round.
OK, NG, CHECK, OPEN = "OK", "NG", "要確認", "未確認"
JUDGMENTS = (OK, NG, CHECK, OPEN)
MINIMUM_SAMPLE = 30
PHONE_GATE, PRECISION_GATE = 0.95, 0.90
RATED_FIELDS = {
    "company_name_judgment": "company_name_accuracy",
    "store_name_judgment": "store_name_accuracy",
    "phone_judgment": "phone_accuracy",
    "address_judgment": "address_accuracy",
    "industry_judgment": "industry_accuracy",
}


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Newest review of each url."""
    return top_per_key(reviews, ["url"], [F.desc("id")])


def reviewed_scores(reviews: DataFrame, pages: DataFrame, scoring: DataFrame) -> DataFrame:
    """Latest reviews with the score of every page whose url or final url was reviewed.

    The either-or condition is the union of two equi-joins over page keys, with a page that matches on
    both sides counted once. A review may match several pages and then appears once for each.
    """
    latest = latest_reviews(reviews)
    addresses = pages.select(
        F.col("id").alias("page_id"),
        F.explode(F.array_distinct(F.array("url", "final_url"))).alias("url"),
    ).filter(F.col("url").isNotNull())
    # Inner joins first: the reviews are the small side, so the page and score tables need no shuffle.
    hits = addresses.join(latest.select("url", "id"), "url").select("id", "page_id")
    flags = scoring.select("page_id", "is_official", "is_business_target", "review_required")
    scored = flags.join(hits.select("page_id").distinct(), "page_id")
    return latest.join(hits.join(scored, "page_id", "left"), "id", "left")


def _share(hits: Column, total: Column) -> Column:
    return F.try_divide(hits, total)


def _rate(field: str, eligible: Column | None = None) -> Column:
    on = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    judged = F.col(field).isin(OK, NG) & on
    return _share(F.count_if((F.col(field) == OK) & on), F.count_if(judged))


def review_accuracy(joined: DataFrame) -> DataFrame:
    """One row of accuracy rates, precisions and error counts; a rate without a sample is NULL."""
    rates = [_rate(field).alias(name) for field, name in RATED_FIELDS.items()]
    target, judged = F.col("is_business_target"), F.col("business_target_judgment")
    return joined.agg(
        F.count("*").alias("review_count"),
        *rates,
        _rate("official_site_judgment", F.col("is_official")).alias("official_precision"),
        _rate("business_target_judgment", target).alias("business_precision"),
        F.count_if(target & (judged == NG)).alias("false_positive_count"),
        F.count_if(~target & (judged == OK)).alias("false_negative_count"),
        _share(F.count_if("review_required"), F.count("*")).alias("review_required_rate"),
        (F.count("*") >= MINIMUM_SAMPLE).alias("statistically_sufficient"),
    )


def acceptance(accuracy: DataFrame) -> DataFrame:
    """Go or no-go of a review round."""
    good = (
        (F.col("phone_accuracy") >= PHONE_GATE)
        & (F.col("official_precision") >= PRECISION_GATE)
        & (F.col("business_precision") >= PRECISION_GATE)
        & F.col("statistically_sufficient")
    )
    return accuracy.withColumn("accepted", F.coalesce(good, F.lit(False)))
