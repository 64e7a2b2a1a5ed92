"""The whole normaliser, and dates of any form."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import freedates
from eventloom.operators import normalise
from eventloom.plans.views import CATALOG_NOW, ctes, view

#: An event's own start with an hour and a minute, written in ten ways by its id; what a reader of free-form dates makes of them.
MOMENT = "moment AS (SELECT id, id % 10 AS form, start_datetime + make_interval(0, 0, 0, 0, CAST(id % 24 AS INT), CAST(id % 60 AS INT)) AS t FROM {catalog})"
FORMS = """CASE form WHEN 0 THEN date_format(t, 'dd.MM.yyyy HH:mm') WHEN 1 THEN date_format(t, 'yyyy-MM-dd') WHEN 2 THEN date_format(t, 'MMM d, yyyy h:mm a') WHEN 3 THEN date_format(t, 'EEEE, d MMMM yyyy HH:mm')
    WHEN 4 THEN date_format(t, "yyyyMMdd'T'HHmmss") WHEN 5 THEN concat(date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00') WHEN 6 THEN date_format(t, 'd.M.yy') WHEN 7 THEN 'siehe Text' WHEN 8 THEN date_format(t, 'HH:mm') ELSE date_format(t, 'MMMM yyyy') END"""
READ = f"""moment AS (SELECT id, id % 10 AS form, start_datetime + to_hours(CAST(id % 24 AS INT)) + to_minutes(CAST(id % 60 AS INT)) AS t FROM catalog),
    day AS (SELECT id, form, t, CASE WHEN form IN (0, 6) AND day(t) <= 12 THEN make_timestamp(year(t), day(t), month(t), 0, 0, 0) ELSE date_trunc('day', t) END AS d, t - date_trunc('day', t) AS c FROM moment),
    written AS (SELECT id, form, CASE form WHEN 0 THEN d + c WHEN 1 THEN d WHEN 6 THEN d WHEN 7 THEN NULL WHEN 8 THEN TIMESTAMP '{CATALOG_NOW}' + c WHEN 9 THEN date_trunc('month', t) ELSE t END AS written FROM day)"""


@register("free_dates", ctes("catalog", more=READ) + "SELECT id, written, CASE WHEN form = 5 THEN written - INTERVAL 2 HOUR ELSE timezone('Europe/Berlin', written) AT TIME ZONE 'UTC' END AS instant FROM written")
def free_dates(spark, d):
    """Dates in ten usual forms, as written and in UTC; a day of at most 12 before a month in numbers is taken for the month."""
    x = spark.sql(f"WITH {MOMENT} SELECT id, {FORMS} AS text FROM moment", catalog=view(spark, d, "catalog"))
    return freedates.with_any_date(x, "text", CATALOG_NOW).select("id", F.col("read").alias("written"), "instant")


def raw_events(spark, d):
    """Event texts with the other fields that a source may tell, each for some of them."""
    k = F.col("id")
    some = lambda n, of, value: F.when(k % n == of, value)
    day = F.concat((k % 28 + 1).cast("string"), F.lit("."), (k % 12 + 1).cast("string"), F.lit(".2026"))
    return view(spark, d, "event_text").select(
        "id", F.concat(F.lit("Fest <b>"), k % 7, F.lit("</b>  im Park "), F.repeat(F.lit("x"), (k % 9 * 30).cast("int"))).alias("title"), F.when(k % 6 != 5, F.col("description")).alias("description"), F.col("description").alias("summary"),
        F.when(k % 5 < 2, day).when(k % 5 == 2, F.concat(day, F.lit(" 18:15"))).when(k % 5 == 3, "kein Datum").alias("start_datetime"), some(4, 1, day).alias("end_datetime"), some(5, 4, F.concat(day, F.lit("T10:00Z"))).alias("dtstart"),
        some(9, 3, F.lit("Feb 3, 2026")).alias("registration_deadline"),
        F.when(k % 6 == 0, "Prinz-Max-Palais, Karlstr. 10, 76133 Karlsruhe").when(k % 6 == 1, "Siehe  Beschreibung").when(k % 6 == 2, "Tollhaus").when(k % 6 == 3, "Alter Schlachthof 35, 76131 Karlsruhe-Ost").alias("location"),
        some(8, 2, F.lit("Saal")).alias("venue_name"), some(7, 1, F.lit("Ettlingen")).alias("city"), some(14, 1, F.lit("76275")).alias("postal_code"), some(3, 1, F.lit("49.01")).alias("lat"), some(3, 1, F.lit("acht")).alias("lng"),
        F.when(k % 11 == 0, "paid").when(k % 11 == 1, "teuer").when(k % 11 == 2, "free").alias("price_type"), some(7, 2, F.lit("9.5")).alias("price"), some(13, 4, F.lit("20")).alias("price_max"), some(17, 0, F.lit('{"adult": 1}')).alias("price_details"),
        some(19, 3, F.lit("available")).alias("availability_status"), some(4, 0, F.lit("3.9")).alias("age_min"), some(8, 0, F.lit("10")).alias("age_max"), some(10, 3, F.lit(False)).alias("is_indoor"),
        F.when(k % 12 == 0, "Englisch").when(k % 12 == 1, "Klingonisch").alias("language"), some(9, 1, F.lit("120 Plätze")).alias("capacity"), some(10, 1, F.lit(False)).alias("spots_limited"),
        F.when(k % 4 == 0, "www.haus.de/karten").when(k % 4 == 1, "https://veranstaltungskalender.de/1").alias("url"), some(9, 0, F.lit(" a@b.de ")).alias("email"), some(9, 1, F.lit("Tel. 0721 / 12-3")).alias("phone"),
        F.when(k % 3 == 0, F.array(F.lit("ftp://x"), F.concat(F.lit("https://i/"), k))).alias("image_urls"), F.concat(F.lit("https://s/"), k).alias("source_url"),
    )


@register("normalize_source_event")
def normalize_source_event(spark, d):
    """All fields of the normaliser over whole event texts; forty columns, compared with a plain version in tests/test_normalise.py."""
    return normalise.normalised(raw_events(spark, d), "2026-03-29 09:00:00")
