"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexivane.plans import catalog  # noqa: E402
from lexivane.session import local_session  # noqa: E402

HEADLINE = [
    "corpus_long",
    "split_three_way",
    "vocabulary_top",
    "rank_table",
    "token_frequencies",
    "sif_sweep",
    "doc_vectors",
    "pair_distance",
    "bm25_pair",
    "bm25_topk",
    "knn_topk",
    "knn_docs",
    "knn_cells",
    "rrf",
    "rerank",
    "recall_bm25",
    "classification_metrics",
    "sweep_accuracy",
    "pca_2d",
    "token_arrows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores, memory=os.environ.get("BENCH_MEMORY", "16g"))
    catalog.QUERIES["first_rows"](spark, sf_dir).count()  # starts the JVM's code and the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = Path(sf_dir).name.removeprefix("sf")
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
