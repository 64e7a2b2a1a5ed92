"""One moving mean for each source over all its runs."""

import math
from collections import defaultdict

from eventloom import catalog
from eventloom.plans.views import view


def test_event_ewma_never_starts_anew(spark, sf_dir):
    runs, means = defaultdict(list), {}
    for r in view(spark, sf_dir, "ingest_run").where("source_id is not null").collect():
        runs[r["source_id"]].append((r["started_at"], r["id"], r["events_found"]))
    for source, own in runs.items():
        for _, _, n in sorted(own):
            means[source] = float(n) if source not in means else 0.7 * means[source] + 0.3 * n
    found = catalog.queries()["event_ewma"](spark, sf_dir).collect()
    assert len(found) == len(means)
    assert all(math.isclose(r["ewma"], means[r["source_id"]], abs_tol=2e-6) for r in found)
