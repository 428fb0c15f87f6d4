"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query is planned and run to a sink that discards rows. The tables are first copied
into as many files as there are cores, as a large table would be; that is no part of
the queries' times, and stated as copy_sec.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexfit.plans.workload import QUERIES  # noqa: E402
from lexfit.session import build_session  # noqa: E402

HEADLINE = [
    "store_write", "store_append", "store_stream", "page_archive", "extract_links", "strip_tags",
    "address_resolve", "dedupe_first", "title_blocklist", "language_detect", "extract_emails",
    "section_tasks", "section_benefits", "clean_text", "tokenize", "lemmatize", "stem_snowball",
    "stem_cistem", "stem_vocabulary", "remove_stopwords", "term_counts", "corpus_vocabulary",
    "cosine_tasks", "jaccard_tasks", "matched_tasks", "rank_average", "rank_agreement",
    "total_score", "select_eligible", "outbox", "jaccard_ranking", "fit_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    source, folder = folder, tempfile.mkdtemp(prefix="bench-")
    start = time.perf_counter()
    for name in sorted(os.listdir(source)):
        spark.read.parquet(f"{source}/{name}").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/{name}")
    copied = round(time.perf_counter() - start, 3)
    QUERIES["store_scan"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "copy_sec": copied,
                "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
