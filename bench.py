"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from rolesift.plans.catalogue import QUERIES
from rolesift.session import local_session

HEADLINE = ["doc_fingerprint", "term_score_capped", "clone_collapse", "rank_unseen", "latest_state_per_key", "repost_signals", "html_strip_tags", "ats_link_extract"]

if __name__ == "__main__":
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Once unmeasured, so that no query pays for the start of the JVM and of code generation.
    QUERIES[HEADLINE[0]](spark, folder).limit(1000).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
