"""Day plans: hard constraints, budgets, selection, plan B and the plan that stands in for an AI's."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import scoring, search
from eventloom.plans.scoring import TIPS, near
from eventloom.plans.views import CATALOG_NOW, ctes, view
from eventloom.session import table

AGES, BUDGET = [4, 7], 60.0
FITS = f"coalesce(age_min, 0) <= {max(AGES)} AND CASE WHEN coalesce(age_max, 0) = 0 THEN 99 ELSE age_max END >= {min(AGES)} AND coalesce(price_min, 0) <= {BUDGET}"


def candidates(spark, d):
    """Events that suit the children and the budget."""
    c = view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("id") == F.col("event_id"), "left")
    top = F.coalesce(F.nullif("age_max", F.lit(0)), F.lit(99))
    return c.where((F.coalesce("age_min", F.lit(0)) <= max(AGES)) & (top >= min(AGES)) & (F.coalesce("price_min", F.lit(0)) <= BUDGET))


@register("plan_constraints", ctes("catalog", "scores") + f"SELECT id, row_number() OVER (ORDER BY NOT coalesce(is_indoor, false), coalesce(relevance, 0) DESC, id) AS rank FROM catalog LEFT JOIN scores ON event_id = id WHERE {FITS} ORDER BY rank LIMIT 20")
def plan_constraints(spark, d):
    """The 20 best events for a rainy day: indoor ones first."""
    from pyspark.sql import Window

    penalty, best = ~F.coalesce("is_indoor", F.lit(False)), F.coalesce("relevance", F.lit(0))
    top = candidates(spark, d).orderBy(penalty.asc(), best.desc(), "id").limit(20).select("id", penalty.alias("p"), best.alias("b"))
    return top.select("id", F.row_number().over(Window.orderBy("p", F.desc("b"), "id")).alias("rank"))


@register("plan_outdoor", ctes("catalog", "scores") + f"SELECT id FROM catalog LEFT JOIN scores ON event_id = id WHERE {FITS} AND is_outdoor")
def plan_outdoor(spark, d):
    return candidates(spark, d).where("is_outdoor").select("id")


@register("budget_filter", ctes("catalog") + "SELECT id, (price_type = 'free') AS at_zero, (price_type = 'free' OR coalesce(price_min <> 0 AND price_min <= 15, false)) AS at_30 FROM catalog")
def budget_filter(spark, d):
    """Which events a plan without money and one of 30 may hold."""
    free, low = F.col("price_type") == "free", F.col("price_min")
    return view(spark, d, "catalog").select("id", free.alias("at_zero"), (free | F.coalesce((low != 0) & (low <= 15), F.lit(False))).alias("at_30"))


@register("plan_scores", TIPS + f"SELECT id, round(CASE WHEN event_id IS NULL THEN 50 ELSE CASE WHEN coalesce(family_fit, 0) = 0 THEN 50 ELSE family_fit END * CAST(0.3 AS DOUBLE) + CASE WHEN coalesce(stressfree, 0) = 0 THEN 50 ELSE stressfree END * CAST(0.2 AS DOUBLE) + CASE WHEN coalesce(quality, 0) = 0 THEN 50 ELSE quality END * CAST(0.1 AS DOUBLE) END - coalesce(km, 10) * 2 + CASE WHEN price_type = 'free' THEN 15 WHEN price_min <> 0 AND price_min <= {BUDGET / 4} THEN 10 ELSE 0 END + 5 * (" + " + ".join(f"CASE WHEN {a} BETWEEN coalesce(age_min, 0) AND coalesce(age_max, 18) THEN 1 ELSE 0 END" for a in AGES) + "), 4) + 0.0 AS score FROM near")
def plan_scores(spark, d):
    return near(spark, d).select("id", F.round(scoring.plan_score(BUDGET, AGES), 4).alias("score"))


@register("plan_optimise")
def plan_optimise(spark, d):
    """Main plan and plan B for each provider, from its 30 best events. tests/test_planning.py has a plain version."""
    x = near(spark, d).where(search.displayable(CATALOG_NOW)).withColumn("total", F.round(scoring.plan_score(BUDGET, AGES), 6))
    best = search.first_per(x, "provider_id", [F.desc("total"), F.asc("id")], 30).drop("rank")
    slugs = view(spark, d, "event_category").groupBy(F.col("event_id").alias("kid")).agg(F.array_sort(F.collect_list("slug")).alias("slugs"))
    y = best.join(slugs, F.col("kid") == F.col("id"), "left").select("provider_id", "id", "total", "price_type", "price_min", "is_indoor", F.coalesce("slugs", F.array()).alias("slugs"))
    return scoring.optimise(y, "provider_id", BUDGET, len(AGES) + 2, len(AGES))


#: What the stand-in plan suggests by time of day, weather and age group.
SUGGESTIONS = [
    ("morning", "indoor", "toddler", "ZKM Medienmuseum"), ("morning", "indoor", "child", "Naturkundemuseum"), ("morning", "indoor", "teen", "ZKM Spieleausstellung"), ("morning", "outdoor", "toddler", "Zoo Karlsruhe"), ("morning", "outdoor", "child", "Günther-Klotz-Anlage"), ("morning", "outdoor", "teen", "Turmbergbahn"),
    ("afternoon", "indoor", "toddler", "Indoor-Spielplatz"), ("afternoon", "indoor", "child", "Badisches Landesmuseum"), ("afternoon", "indoor", "teen", "Europabad"), ("afternoon", "outdoor", "toddler", "Schlossgarten"), ("afternoon", "outdoor", "child", "Alter Flugplatz"), ("afternoon", "outdoor", "teen", "Kletterpark Durlach"),
]
SLOTS = [("morning", "10:00", "11:30", 90), ("lunch", "12:00", "13:00", 60), ("afternoon", "14:00", "16:00", 120)]
TIPS_TEXT = ["Denke an Wickeltasche und Snacks für die Kleinen", "Sonnencreme und Wasser nicht vergessen", "Plant genug Pausen ein - Kinder brauchen Zeit zum Verarbeiten", "Fahrt mit dem ÖPNV? Die KVV-App zeigt Live-Verbindungen"]
_values = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


@register("fallback_plan", f"WITH s AS (SELECT * FROM (VALUES {_values(SUGGESTIONS)}) t(part, weather, age_group, title)), slots AS (SELECT * FROM (VALUES {_values(SLOTS)}) t(part, starts, ends, minutes)), f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 15 < 4 THEN 'toddler' WHEN c_custkey % 15 <= 10 THEN 'child' ELSE 'teen' END AS age_group, CASE WHEN c_custkey % 2 = 0 THEN 'indoor' ELSE 'outdoor' END AS weather FROM customer) SELECT f.id, slots.part, starts, ends, minutes, CASE WHEN slots.part = 'lunch' THEN 'Mittagspause' ELSE title END AS title FROM f CROSS JOIN slots LEFT JOIN s ON s.part = slots.part AND s.weather = f.weather AND s.age_group = f.age_group")
def fallback_plan(spark, d):
    """The plan of each family when no AI answers: suggestions by age group and weather around a lunch break."""
    k = F.col("c_custkey")
    families = table(spark, d, "customer").select(k.alias("id"), F.when(k % 15 < 4, "toddler").when(k % 15 <= 10, "child").otherwise("teen").alias("age_group"), F.when(k % 2 == 0, "indoor").otherwise("outdoor").alias("weather"))
    slots = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).alias("starts"), F.lit(b).alias("ends"), F.lit(m).alias("minutes")) for p, a, b, m in SLOTS])
    listed = spark.createDataFrame(SUGGESTIONS, "part string, weather string, age_group string, title string")
    each = families.select("id", "age_group", "weather", F.inline(slots))
    return each.join(F.broadcast(listed), ["part", "weather", "age_group"], "left").select("id", "part", "starts", "ends", "minutes", F.when(F.col("part") == "lunch", "Mittagspause").otherwise(F.col("title")).alias("title"))


@register("plan_tips", ctes("catalog") + f"SELECT provider_id, concat_ws('|', CASE WHEN bool_or(coalesce(age_min, 9) < 3) THEN '{TIPS_TEXT[0]}' END, CASE WHEN bool_or(is_outdoor) THEN '{TIPS_TEXT[1]}' END, CASE WHEN count(*) > 2 THEN '{TIPS_TEXT[2]}' END, '{TIPS_TEXT[3]}') AS tips FROM catalog GROUP BY provider_id")
def plan_tips(spark, d):
    """Tips for each provider's plan: small children, outdoor events, many events, and the way there."""
    small, out = F.some(F.coalesce("age_min", F.lit(9)) < 3), F.some("is_outdoor")
    return view(spark, d, "catalog").groupBy("provider_id").agg(F.concat_ws("|", F.when(small, TIPS_TEXT[0]), F.when(out, TIPS_TEXT[1]), F.when(F.count("*") > 2, TIPS_TEXT[2]), F.lit(TIPS_TEXT[3])).alias("tips"))
