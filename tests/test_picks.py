"""Picks from groups: many groups travel in one batch, with nulls and ties as before."""

from eventloom.operators import scoring

SHAPE = "g long, id long, total double, price_type string, price_min double, is_indoor boolean, slugs array<string>, place string"


def rows(spark):
    many = [(g, 10 * g + k, float(k % 2), "paid", None if k % 3 else 1.0, None if k == 2 else k % 2 == 0, ["a"] if k < 3 else ["b"], "p") for g in range(3000) for k in range(4)]
    return spark.createDataFrame([*many, (None, 7, None, None, None, None, [], None), (None, 6, None, None, None, True, ["a"], None)], SHAPE)


def test_groups_share_batches(spark):
    d = rows(spark)
    for made in (scoring.varied(d, "g"), scoring.optimise(d, "g", 60.0, 4, 2), scoring.rerank(d, "g")):
        assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_picks(spark):
    d = rows(spark)
    of = lambda made, g: [tuple(r)[1:] for r in made.collect() if r["g"] == g]
    varied, best = scoring.varied(d, "g"), scoring.optimise(d, "g", 60.0, 4, 2)
    assert varied.count() == 3 * 3000 + 2
    assert of(varied, 5) == [(51, 1), (53, 2), (50, 3)] and of(varied, None) == [(6, 1), (7, 2)]
    assert of(best, 5) == [(51, "main", 1), (53, "main", 2), (50, "main", 3)]
    assert of(best, None) == [(6, "main", 1), (7, "main", 2)]
