"""Export snapshot and live report from the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from firmlens.operators.export import category_rows, deduplicate, export_base, orphan_errors
from firmlens.operators.report import (
    LIVE_SHEETS,
    audit_scan,
    candidate_rows,
    exclusion_rows,
    live_summary,
    search_rows,
)
from firmlens.operators.review import review_accuracy, reviewed_scores
from firmlens.session import cut_lineage
from firmlens.sinks.exports import publish_sheets, write_review_template
from firmlens.sinks.manifest import Version


@dataclass(frozen=True)
class Store:
    """The stored tables an export or report reads."""

    conditions: DataFrame
    queries: DataFrame
    results: DataFrame
    pages: DataFrame
    companies: DataFrame
    addresses: DataFrame
    phones: DataFrame
    scoring: DataFrame
    errors: DataFrame
    progress: DataFrame


def export_snapshot(store: Store) -> tuple[DataFrame, DataFrame]:
    """Annotated export rows and the errors without a page."""
    base = export_base(
        store.results, store.queries, store.conditions, store.pages, store.companies,
        store.addresses, store.phones, store.scoring, store.errors,
    )
    return deduplicate(base), orphan_errors(store.errors, store.progress)


def live_sheets(
    store: Store,
    annotated: DataFrame,
    orphans: DataFrame,
    http_audit: DataFrame,
    provider_audit: DataFrame,
    reviews: DataFrame,
    runs: DataFrame,
    generated_at: Column,
    run_id: str = "",
    provider_run_id: str = "",
) -> dict[str, DataFrame]:
    """The eight named report partitions, all from one written snapshot."""
    annotated, orphans = cut_lineage(annotated), cut_lineage(orphans)
    accuracy = review_accuracy(reviewed_scores(reviews, store.pages, store.scoring))
    frames = (
        candidate_rows(category_rows(annotated, orphans, "business_targets")),
        candidate_rows(annotated.filter("review_required")),
        exclusion_rows(store.results, store.queries, store.pages, store.scoring),
        audit_scan(http_audit, run_id),
        audit_scan(provider_audit, provider_run_id),
        search_rows(store.results, store.queries),
        candidate_rows(category_rows(annotated, orphans, "errors")),
        live_summary(
            annotated, store.results, store.queries, store.conditions, store.pages, http_audit,
            provider_audit, runs, accuracy, generated_at, run_id, provider_run_id,
        ),
    )
    return dict(zip(LIVE_SHEETS, frames))


def publish_live_report(sheets: dict[str, DataFrame], template: DataFrame, folder: str, review_path: str) -> Version:
    """Publish the eight sheets as one version and write the review template unless one is already there."""
    published = publish_sheets({name: sheets[name] for name in LIVE_SHEETS}, folder)
    write_review_template(template, review_path)
    return published
