"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cohortlab.plans import queries
from cohortlab.session import local_session

HEADLINE = (
    "group_metrics", "robustness_summary", "running_group_metrics", "ema_group_loss", "pearson_and_spearman",
    "sample_split", "basic_tokenize", "corpus_vocab", "wordpiece", "tokenize", "encode_dataset", "chunk_plan",
    "make_pairs", "mask_tokens", "full_batches", "transfer_average", "prune_magnitude", "quantize_static",
    "read_corpus", "stream_windowed_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    known, seconds = queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
