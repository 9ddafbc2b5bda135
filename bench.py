"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from leadloom.plans import catalogue
from leadloom.session import builder

HEADLINE = (
    "ranked_register", "lead_score_parts", "requirement_score", "cap_candidates", "per_city_buyers", "search_with_counts", "weekly_price_moves", "price_series_dense", "best_price_per_commodity",
    "orders_by_product", "match_order_to_lead", "dedupe_prices", "webhook_daily", "digest_deliveries", "event_idempotency", "message_sessions", "budget_admission", "find_phones", "find_emails", "html_text",
    "page_links", "url_hygiene", "keyword_match", "proximity_pairs", "weekly_report_sets", "entity_resolution_fold",
    "matched_items", "robots_hosts", "late_failures", "opening_outcomes", "weekly_report", "status_register", "order_loop_leads", "diversify_ties",
    "entity_resolution_links", "digest_by_city", "digest_full_sheets", "bundle_files_verified", "latest_events", "pdf_texts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = builder(cores, int(cores)).config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(catalogue.QUERIES)
    names = list(HEADLINE)
    try:
        from leadloom.llm import queries as corpus
    except ImportError:
        corpus = None
    if corpus and os.environ.get("BENCH_CORPUS", "1") == "1":
        queries |= corpus.QUERIES
        names += sorted(corpus.QUERIES)
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the JVM's readers
    took: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
