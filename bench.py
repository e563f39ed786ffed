"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "talk_pairs_report", "event_pairs", "merged_turns", "rebuilt_texts", "capped_pairs", "length_features",
    "kept_votes", "majority_labels", "ordered_votes", "running_votes", "convergence", "split_coverage",
    "pairwise_kappa", "kappa_summary_by_study", "agreement_report", "majority_kappa", "vote_alpha", "fleiss_first_three",
    "stop_points", "stop_report", "bootstrap_reliability", "token_weights", "zip_sums", "pairwise_jaccard",
    "unitising_alpha", "mean_cosine", "macro_scores", "review_counts", "quota_sample", "weighted_split",
    "parsed_answers", "answer_weights", "prompts", "name_map", "anonymised_lists", "rerun_plan", "packed_studies",
    "long_annotations", "labels_with_comments", "stream_stops",
]


def main() -> None:
    from turnwise.catalog import QUERIES
    from turnwise.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
