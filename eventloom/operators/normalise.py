"""The normaliser as a whole: from the texts that a source gave for an event to its typed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import fields as E
from eventloom.functions import text as T
from eventloom.functions.freedates import with_any_date

#: Known price types, and names of languages with their code.
PRICE_TYPES = ["free", "paid", "range", "unknown", "donation"]
LANGUAGES = {"deutsch": "de", "german": "de", "de": "de", "englisch": "en", "english": "en", "en": "en", "französisch": "fr", "french": "fr", "fr": "fr", "türkisch": "tr", "turkish": "tr", "tr": "tr"}
PLACE = r"([0-9]{5})\s+([A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß\s-]+)"


def _clock_patched(x: DataFrame, now: str, zone: str) -> DataFrame:
    """x with `start` and `end` as instants: a day without a time takes the time that the description tells, as a day that is
    missing altogether is today. A time keeps the distance from UTC of the day that it is put on."""
    today = F.lit(now).cast("timestamp")
    local = F.from_utc_timestamp(today, zone)
    since = lambda t: t - F.date_trunc("day", t)
    zero = lambda name: F.col(f"__{name}_at") - since(F.col(f"__{name}_read"))  # noqa: E731  the start of a written day
    base = F.coalesce(zero("start"), (today - since(local)).cast("timestamp_ntz"))
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n)
    bare = lambda name: (F.hour(f"__{name}_read") == 0) & (F.minute(f"__{name}_read") == 0)
    start, ending = F.col("__clock.start"), F.col("__clock.ending")
    first = F.when(start.isNull(), F.col("__start_at")).when(F.col("__start_at").isNull(), base + minutes(start)).when(bare("start"), zero("start") + minutes(start)).otherwise(F.col("__start_at"))
    last = F.when(ending.isNull(), F.col("__end_at")).when(F.col("__end_at").isNull(), base + minutes(ending)).when(bare("end"), zero("end") + minutes(ending % 1440)).otherwise(F.col("__end_at"))
    return x.withColumns({"start_datetime": first, "end_datetime": last})


def normalised(raw: DataFrame, now: str, zone: str = "Europe/Berlin") -> DataFrame:
    """One row a row of raw: `id` and all fields of the normaliser. Times are instants in UTC.

    raw has texts, any of which may be null, empty or missing as a column: title, description or summary, start_datetime or
    dtstart, end_datetime or dtend, registration_deadline, location_address or location, location_lat or lat, location_lng or lng,
    venue_name or location_name, city, postal_code, price_type, price_min or price, price_max, price_details, availability_status,
    age_min, age_max, language, capacity, recurrence_rule or rrule, transit_stop, booking_url or url, contact_email or email,
    contact_phone or phone, source_url; booleans is_indoor, is_outdoor, spots_limited, has_parking; an array image_urls. What a
    source tells goes before what its text tells. Dates are read by with_any_date; what can't be read as a date or a number is
    null. An empty or missing title is an empty text. Repeated rows give repeated rows; extra columns are ignored."""
    has = set(raw.columns)
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in has], F.lit(None).cast("string"))
    flag = lambda n: F.col(n).cast("boolean") if n in has else F.lit(None).cast("boolean")
    number = lambda *names: text(*names).try_cast("double")
    said = {
        "title": T.display_title(F.coalesce(text("title"), F.lit(""))), "__description": text("description", "summary"), "__own": text("description"), "__heading": text("title"),
        "__start": text("start_datetime", "dtstart"), "__end": text("end_datetime", "dtend"), "__deadline": text("registration_deadline"), "__address": T.address(text("location_address", "location")),
        "__venue": text("venue_name", "location_name"), "__city": text("city"), "__postal": text("postal_code"), "__price_type": text("price_type"), "__price_min": number("price_min", "price"),
        "price_max": number("price_max"), "price_details": text("price_details"), "__availability": text("availability_status"), "__age_min": number("age_min").try_cast("int"), "__age_max": number("age_max").try_cast("int"),
        "__indoor": flag("is_indoor"), "__outdoor": flag("is_outdoor"), "__language": text("language"), "capacity": number("capacity").try_cast("int"), "__limited": flag("spots_limited"),
        "__recurrence": text("recurrence_rule", "rrule"), "transit_stop": text("transit_stop"), "__parking": flag("has_parking"), "__url": text("booking_url", "url"), "__email": text("contact_email", "email"),
        "__phone": text("contact_phone", "phone"), "source_url": text("source_url"), "location_lat": number("location_lat", "lat"), "location_lng": number("location_lng", "lng"),
        "__images": F.col("image_urls").cast("array<string>") if "image_urls" in has else F.array().cast("array<string>"),
    }
    x = raw.select("id", *[c.alias(n) for n, c in said.items()])
    for name in ("start", "end", "deadline"):
        x = with_any_date(x, f"__{name}", now, zone).withColumnsRenamed({"read": f"__{name}_read", "instant": f"__{name}_at"})
    x = x.withColumns({
        "__t": F.coalesce(F.lower("__description"), F.lit("")), "__priced": F.lower(F.concat_ws(" ", F.coalesce("__heading", F.lit("")), F.coalesce("__own", F.lit("")))),
        "__titled": F.lower(F.concat_ws(" ", "title", F.coalesce("__description", F.lit("")))),
    })
    t, all_text = F.col("__t"), F.col("__titled")
    # each text is searched once, in a stage of its own
    x = x.withColumns({"__clock": T.time_of_day(t), "__ages": T.age_range(all_text), "__amount": T.amount(F.col("__priced"), r"([0-9]+(?:[,.][0-9]{2})?)\s*(?:€|euro|eur)")})
    x = _clock_patched(x, now, zone)
    x = x.withColumns({"__gratis": T.has_any(F.col("__priced"), T.FREE) | T.has_any(F.col("__priced"), T.DONATION), "__split": E.split_venue(F.col("__address"), F.col("__venue"))})
    x = x.withColumns({"__kind": _price_kind(), "__place_code": T.part(F.col("__address"), PLACE), "__place": F.trim(T.part(F.col("__address"), PLACE, 2))})
    searched = F.col("__price_min").isNull() & (F.col("__kind") != "free")
    flags = T.flags(t)
    both = F.col("__indoor").isNotNull() | F.col("__outdoor").isNotNull()
    places = T.flags(all_text)
    aged = F.col("__age_min").isNotNull() & F.col("__age_max").isNotNull()
    found = F.col("__ages.low").isNotNull()
    named = F.col("__city").isNotNull() & F.col("__postal").isNotNull()
    contacts = T.contacts(F.coalesce("__own", F.lit("")))
    prices = T.price_details(t)
    clean = T.squeeze(F.regexp_replace("__description", "<[^>]+>", " "))
    link = E.normal_url(F.col("__url"))
    codes = F.create_map(*[F.lit(c) for pair in LANGUAGES.items() for c in pair])
    given = F.col("price_details").isNotNull()
    detail = lambda name: F.when(~given, prices[name])
    x = x.withColumns({"__adult": detail("adult"), "__child": detail("child"), "__family": detail("family"), "__donation": ~given & prices["donation"]})
    return x.select(
        "id", "title", F.nullif(T.short_description(F.col("__description")), F.lit("")).alias("description_short"), F.when(F.length(clean) > 500, clean).alias("description_long"),
        "start_datetime", "end_datetime", F.col("__deadline_at").alias("registration_deadline"),
        F.col("__split.address").alias("location_address"), F.col("__split.venue").alias("venue_name"), "location_lat", "location_lng",
        F.coalesce("__city", F.when(~named, F.col("__place"))).alias("city"), F.coalesce("__postal", F.when(~named, F.col("__place_code"))).alias("postal_code"),
        F.when(searched & F.col("__amount").isNotNull(), "paid").otherwise(F.col("__kind")).alias("price_type"),
        F.coalesce("__price_min", F.when(F.col("__kind") == "free", 0.0).otherwise(F.col("__amount"))).alias("price_min"), "price_max",
        "price_details", F.col("__adult").alias("price_adult"), F.col("__child").alias("price_child"), F.col("__family").alias("price_family"),
        F.when(F.col("__donation"), "donation").alias("price_mode"), F.when(F.coalesce("__adult", "__child", "__family").isNotNull() | F.col("__donation"), "EUR").alias("price_currency"),
        F.coalesce("__availability", T.availability(t)).alias("availability_status"),
        F.when(~aged & found, F.col("__ages.low")).otherwise(F.col("__age_min")).alias("age_min"), F.when(~aged & found, F.col("__ages.high")).otherwise(F.col("__age_max")).alias("age_max"),
        F.when(both, F.col("__indoor")).otherwise(places["indoor"]).alias("is_indoor"), F.when(both, F.col("__outdoor")).otherwise(places["outdoor"]).alias("is_outdoor"),
        F.when(F.col("__language").isNotNull(), F.coalesce(F.try_element_at(codes, F.lower("__language")), F.col("__language"))).otherwise(flags["language"]).alias("language"),
        "capacity", F.coalesce("__limited", flags["limited"]).alias("spots_limited"), F.coalesce("__recurrence", flags["recurrence"]).alias("recurrence_rule"), "transit_stop",
        F.coalesce("__parking", flags["parking"]).alias("has_parking"), F.when(~E.is_aggregator(link), link).alias("booking_url"),
        F.coalesce(F.substring(F.trim("__email"), 1, 200), F.when(F.col("__email").isNull(), contacts["email"])).alias("contact_email"),
        F.when(F.col("__phone").isNull(), contacts["phone"]).otherwise(F.nullif(F.substring(F.trim(F.regexp_replace("__phone", r"[^0-9+\s()-]", "")), 1, 50), F.lit(""))).alias("contact_phone"),
        F.coalesce(E.images(F.col("__images")), F.array().cast("array<string>")).alias("image_urls"), "source_url",
    )


def _price_kind() -> Column:
    """The price type before an amount in the text is looked for."""
    told = F.coalesce(F.when(F.col("__price_type").isin(PRICE_TYPES), F.col("__price_type")), F.lit("unknown"))
    return F.when(told != "unknown", told).when(F.col("__gratis"), "free").when(F.col("__price_min").isNotNull(), "paid").otherwise("unknown")
