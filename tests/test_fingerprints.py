"""The deduplication fingerprint against a plain version."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.functions import fingerprint as fp
from eventloom.plans.views import view


def plain_geohash(lat, lng, precision=8):
    """By halving the ranges of longitude and latitude by turns."""
    if lat is None or lng is None:
        return ""
    ranges, point, out, value = [[-180.0, 180.0], [-90.0, 90.0]], (lng, lat), "", 0
    for k in range(5 * precision):
        low, high = ranges[k % 2]
        middle, upper = (low + high) / 2, point[k % 2] >= (low + high) / 2
        ranges[k % 2] = [middle, high] if upper else [low, middle]
        value = value * 2 + upper
        if k % 5 == 4:
            out, value = out + "0123456789bcdefghjkmnpqrstuvwxyz"[value], 0
    return out


def plain_fingerprint(title, start, lat, lng):
    t = re.sub(r"\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}|\d{1,2}:\d{2}", "", title.lower())
    words = [w for w in re.sub(r"[^a-z0-9_äöüß\s]", "", t).split() if w not in fp.STOP_WORDS]
    key = "|".join([" ".join(words), start.strftime("%Y-%m-%dT%H") if start else "", plain_geohash(lat, lng)])
    return hashlib.sha256(key.encode()).hexdigest()[:32]


def test_query(spark, sf_dir):
    rows = {r["id"]: r for r in view(spark, sf_dir, "catalog").select("id", "title", F.date_format("start_datetime", "yyyy-MM-dd HH:mm:ss").alias("at"), "lat", "lng").collect()}
    got = dict(catalog.queries()["fingerprint_dedup"](spark, sf_dir).collect())
    assert set(got) == set(rows)
    for k, r in rows.items():
        start = r["at"] and datetime.datetime.strptime(r["at"], "%Y-%m-%d %H:%M:%S")
        assert got[k] == (plain_fingerprint(r["title"], start, r["lat"], r["lng"]) if r["title"] is not None else None), r


def test_hard_titles(spark):
    r = random.Random(6)
    pieces = ["Der", "die", "und", "Konzert", "12.05.2024", "1.1.24", "2024", "19:30", "Uhr", "für", "Straße", "ÄÖÜ", "!", "-", "the", "a", "", "  ", "x_y", "20245", "\t", "é", "😀"]
    rows = []
    for k in range(1500):
        start = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(500_000)) if r.random() < 0.9 else None
        lat, lng = (r.uniform(-90, 90), r.uniform(-180, 180)) if r.random() < 0.8 else r.choice([(None, 8.4), (49.0, None), (0.0, 0.0), (90.0, 180.0), (-90.0, -180.0)])
        rows.append((k, " ".join(r.choices(pieces, k=r.randrange(8))), start and start.strftime("%Y-%m-%d %H:%M:%S"), lat, lng))
    df = spark.createDataFrame(rows, "k int, title string, at string, lat double, lng double")
    got = dict(df.select("k", fp.fp_dedup(F.col("title"), F.to_timestamp("at"), F.col("lat"), F.col("lng"))).collect())
    for k, title, at, lat, lng in rows:
        assert got[k] == plain_fingerprint(title, at and datetime.datetime.strptime(at, "%Y-%m-%d %H:%M:%S"), lat, lng), (title, at, lat, lng)
