"""Similar events where nearly all of them share one category."""

from datetime import datetime, timedelta

from eventloom.operators import search

NOW = datetime(1998, 1, 1)


def tables(spark):
    events = [(k, "draft" if k % 4 == 3 else "published", k % 9 == 0, NOW + timedelta(hours=k * 7 % 50 - 5)) for k in range(400)]
    slugs = [(k, s) for k in range(400) for s in {"hot", f"s{k % 40}", f"t{k % 7}"} if s != "hot" or k % 10]
    return events, slugs, spark.createDataFrame(events, "id long, status string, is_cancelled boolean, start_datetime timestamp_ntz"), spark.createDataFrame(slugs, "event_id long, slug string")


def test_hot_category(spark):
    events, slugs, e, c = tables(spark)
    of = {}
    for k, s in slugs:
        of.setdefault(k, set()).add(s)
    shown = [(t, k) for k, status, off, t in events if status == "published" and not off and t >= NOW]
    want = {(i, o, r + 1) for i in of for r, (_, o) in enumerate(sorted(x for x in shown if x[1] != i and of[i] & of[x[1]])[:4])}
    found = search.similar(e, c, str(NOW))
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_hot_category_is_dealt(spark):
    _, _, e, c = tables(spark)
    plan = search.similar(e, c, str(NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and plan.count("Window [") == 1
