"""Times headline queries and prints one JSON line. BENCH_SF_DIR: tables; BENCH_CPUS: local cores."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from strandloom import session

HEADLINE = [
    "iv_overlap_inner", "iv_overlap_semi", "iv_merge", "iv_complement", "iv_tiles_background", "iv_distal_domain_laglead", "cs_pileup", "cs_islands",
    "cs_presence_matrix", "en_hypergeom", "en_by_label", "en_top_peaks_per_annot", "ct_detectable", "ct_most_detected", "ct_size_factor_top", "ct_ttest_stats",
    "ct_mwu_stats", "ct_category_norm", "co_spearman_pairs", "gr_knn_exact", "gr_dice", "sv_km_curve", "gw_allele_flip", "gw_block_sums", "mk_half_datasets", "mk_upset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local_session(cpus, 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    from strandloom.plans import catalogue

    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
