"""What a model's answer leaves of an event's own district and contacts."""

from pyspark.sql import functions as F

from eventloom.operators import canonical

NAMES = ["location_district", "contact_email", "contact_phone", "organizer_website"]


def test_own_values_stay(spark):
    rows = [  # id, model, loc_conf, contact_conf, address, ai_address, own district, ai district, own contacts, ai contacts -> district, contact
        (1, "m1", 0.5, 0.5, "Langer Weg 12, 76131 Karlsruhe", "", "Ost", "West", "own", "new", "Ost", "own"), (2, "m1", 0.9, 0.9, "Langer Weg 12, 76131 Karlsruhe", "", "Ost", "West", "own", " new ", "Ost", "new"),
        (3, "m1", 0.9, 0.9, "", "Ring 5", "Ost", "West", "own", " ", "West", "own"), (4, "m1", 0.9, 0.7, "Langer Weg 12, 76131 Karlsruhe", "", None, "West", None, "new", "West", "new"),
        (5, "fallback", 0.9, 0.9, "", "Ring 5", "Ost", "West", "own", "new", "Ost", "own"), (6, "m1", 0.6, 0.6, "", "Ring 5", None, "West", None, "new", None, None), (7, "m1", 0.9, 0.9, "", "Ring 5", "Ost", None, "own", None, "Ost", "own"),
    ]
    x = spark.createDataFrame([r[:10] for r in rows], "id int, model string, loc_conf double, contact_conf double, address string, ai_address string, location_district string, ai_district string, c string, ai string")
    for name, offered in (("contact_email", "ai_email"), ("contact_phone", "ai_phone"), ("organizer_website", "ai_website")):
        x = x.withColumn(name, F.col("c")).withColumn(offered, F.col("ai"))
    blank = {c: "double" for c in ("dt_conf", "price_conf", "confidence", "price_min", "ai_price_min")} | {c: "timestamp_ntz" for c in ("start_at", "end_at", "ai_start", "ai_end")} | {c: "int" for c in ("fit", "age_min", "age_max", "ai_age_min", "ai_age_max")} | {c: "string" for c in ("price_type", "ai_price_type")}
    x = x.select("*", F.lit(True).alias("has_ai"), *[F.lit(None).cast(k).alias(c) for c, k in blank.items()])
    got = {r.id: [r[n] for n in NAMES] for r in canonical.apply_ai(x, "1998-01-01").collect()}
    assert got == {r[0]: [r[10], r[11], r[11], r[11]] for r in rows}
