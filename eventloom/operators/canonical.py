"""The canonical event: creation from a candidate, ingest, AI results, edits, revisions and moves, as projections and joins.

Truth values follow the rules of the tables' writers: an empty text and a zero coordinate or age count as missing, a zero
price does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scoring import yes

#: Confidence from which AI values count, price kinds, fields that an ingest updates, that an editor may set,
#: and whose fill status is kept.
SURE = 0.7
PRICE_TYPES = ["free", "paid", "range", "unknown", "donation"]
INGEST_FIELDS = ["description_short", "description_long", "location_address", "location_district", "price_type", "price_min", "price_max", "booking_url", "contact_email", "contact_phone"]
FILL_STATUS = ["location_address", "start_datetime", "end_datetime", "ai_summary_short"]
ADDRESS_PLACEHOLDER = r"(?i)^(?:siehe\s+beschreibung|s\.\s*beschreibung|siehe\s+text|s\.\s*text|siehe\s+veranstalter|siehe\s+website|siehe\s+homepage|siehe\s+details|entnehmen\s+sie|siehe\s+veranstaltungsseite)$"
CITY_ONLY = r"(?i)^(karlsruhe|ka-?|stadt\s*karlsruhe)$"

some = lambda c: F.nullif(F.col(c), F.lit(""))  # noqa: E731  an empty text is missing
nonzero = lambda c: F.nullif(F.col(c), F.lit(0))  # noqa: E731  and so is zero


def sure(confidence: str) -> Column:
    """Whether an AI value's confidence suffices."""
    return yes(F.col(confidence) >= SURE)


def create(candidates: DataFrame) -> DataFrame:
    """(id, source_type, the canonical fields): the candidate's own value first, then the AI's where it is sure."""
    named = sure("venue_conf") & some("ai_venue").isNotNull()
    known = F.when(F.col("price_type").isin(PRICE_TYPES), F.col("price_type")).otherwise("unknown")
    derived = F.when((known == "unknown") & F.col("price_min").isNotNull(), F.when(F.col("price_min") == 0, "free").otherwise("paid")).otherwise(known)
    x = candidates.withColumn("__kind", derived)
    asks = (F.col("price_min").isNull() | (F.col("__kind") == "unknown")) & some("ai_price_type").isNotNull() & sure("price_conf")
    gift, paid = asks & F.col("ai_price_type").isin("free", "donation"), asks & F.col("ai_price_min").isNotNull()
    from_place = F.when(sure("loc_conf"), some("ai_address"))
    return x.select(
        "id", "source_type", "title", F.nullif(F.substring("description", 1, 500), F.lit("")).alias("description_short"), some("description").alias("description_long"),
        F.coalesce("start_at", F.when(sure("dt_conf"), F.col("ai_start"))).alias("start_datetime"), F.coalesce("end_at", F.when(sure("dt_conf"), F.col("ai_end"))).alias("end_datetime"),
        F.coalesce(some("address"), from_place, F.when(named, some("ai_line"))).alias("location_address"), F.when(some("address").isNull() & from_place.isNotNull(), some("ai_district")).alias("location_district"),
        F.coalesce(nonzero("lat"), nonzero("geo_lat")).alias("location_lat"), F.coalesce(nonzero("lng"), nonzero("geo_lng")).alias("location_lng"), F.coalesce(some("venue_name"), F.when(named, F.col("ai_venue"))).alias("venue_name"),
        F.coalesce(some("city"), F.when(named, some("ai_city"))).alias("city"), F.coalesce(some("postal_code"), F.when(named, some("ai_postal"))).alias("postal_code"), F.lit("DE").alias("country_code"),
        F.when(gift, F.lit(0.0)).when(paid, F.col("ai_price_min")).otherwise(F.col("price_min")).alias("price_min"), F.when(paid & ~gift, F.coalesce("ai_price_max", "price_max")).otherwise(F.col("price_max")).alias("price_max"),
        F.when(gift, F.col("ai_price_type")).when(paid, "paid").otherwise(F.col("__kind")).alias("price_type"),
        F.coalesce(nonzero("age_min"), nonzero("ai_age_min")).alias("age_min"), F.coalesce(nonzero("age_max"), nonzero("ai_age_max")).alias("age_max"), (yes(F.col("is_indoor")) | yes(F.col("ai_indoor"))).alias("is_indoor"), yes(F.col("is_outdoor")).alias("is_outdoor"),
        some("booking_url").alias("booking_url"), F.coalesce(some("availability_status"), F.when(yes(F.col("ai_cancelled")), "cancelled")).alias("availability_status"),
    )


def provenance(candidates: DataFrame) -> DataFrame:
    """(id, provenance map, fill status map) of new events: where each filled field comes from, and how sure the AI's are."""
    c = candidates
    made = create(c).drop("source_type").withColumnRenamed("id", "__id")
    kind = F.when(F.col("price_type").isin(PRICE_TYPES), F.col("price_type")).otherwise("unknown")
    final = F.when((kind == "unknown") & F.col("price_min").isNotNull(), F.when(F.col("price_min") == 0, "free").otherwise("paid")).otherwise(kind)
    asks = (F.col("price_min").isNull() | (final == "unknown")) & some("ai_price_type").isNotNull() & sure("price_conf")
    became = F.when(asks & (F.col("ai_price_type").isin("free", "donation") | F.col("ai_price_min").isNotNull()), "known").otherwise(final)
    priced = F.col("has_ai") & sure("price_conf") & (F.col("price_min").isNull() | (became == "unknown"))
    by_ai = {
        "venue_name": sure("venue_conf") & some("venue_name").isNull() & some("ai_venue").isNotNull(), "city": sure("venue_conf") & some("city").isNull() & some("ai_city").isNotNull(),
        "postal_code": sure("venue_conf") & some("postal_code").isNull() & some("ai_postal").isNotNull(), "price_min": priced, "price_type": priced,
        "location_address": some("address").isNull() & ((sure("venue_conf") & some("ai_line").isNotNull()) | some("ai_address").isNotNull()),
        "start_datetime": sure("dt_conf") & F.col("start_at").isNull() & F.col("ai_start").isNotNull(), "end_datetime": sure("dt_conf") & F.col("end_at").isNull() & F.col("ai_end").isNotNull(),
    }
    marked = c.select("id", "source_type", "venue_conf", "dt_conf", *[(F.col("has_ai") & rule).alias(f"__{n}") for n, rule in by_ai.items()]).join(made, F.col("id") == F.col("__id"))
    fields = [n for n in made.columns if n != "__id"]
    source = lambda n: F.when(F.col(f"__{n}"), "ai").otherwise(F.col("source_type")) if n in by_ai else F.col("source_type")
    own = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), source(n).alias("v"))) for n in fields]))
    confidence = {"location_address": F.coalesce("venue_conf", F.lit(SURE)), "start_datetime": F.coalesce("dt_conf", F.lit(SURE)), "end_datetime": F.coalesce("dt_conf", F.lit(SURE))}
    state = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit("filled:"), source(n))).otherwise("missing") if n in fields else F.lit("missing")
    told = lambda n: F.concat(state(n), F.when(F.col(f"__{n}"), F.concat(F.lit("@"), F.round(confidence[n], 3).cast("string"))).otherwise("")) if n in confidence else state(n)
    return marked.select("id", F.map_from_entries(own).alias("provenance"), F.create_map(*[x for n in FILL_STATUS for x in (F.lit(n), told(n))]).alias("fill_status"))


def ingest_update(existing: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """(id, action, n_fields, the fields): what an event of the same source and fingerprint becomes. A field is taken where it is
    given, not locked, and the source's priority number is not larger."""
    may = F.col("new_priority") <= F.col("priority")
    take = {f: may & F.col(f"new_{f}").isNotNull() & ~F.array_contains("locked", f) for f in fields}
    x = existing.join(incoming.select("id", *[F.col(c).alias(f"new_{c}") for c in ["priority", *fields]]), "id")
    count = sum((yes(t).cast("int") for t in take.values()), F.lit(0))
    return x.select("id", F.when(count > 0, "updated").otherwise("skipped").alias("action"), count.alias("n_fields"), *[F.when(yes(t), F.col(f"new_{f}")).otherwise(F.col(f)).alias(f) for f, t in take.items()])


def status_from_scores(fit: Column, confidence: Column) -> Column:
    """The status that an AI's scores give an event."""
    return F.when(yes(fit < 30), "rejected").when(yes((confidence >= 0.8) & (fit >= 50)), "published").otherwise("pending_review")


def apply_ai(events: DataFrame, now: str) -> DataFrame:
    """(id, the fields that an AI result sets): events with the result's columns beside them. A result from the fallback model
    changes nothing but sends the event back to the queue. An event's own location_district, contact_email, contact_phone,
    organizer_website and organizer_directions, where events has such columns, stay when the result tells none (ai_district, ai_email, ai_phone, ai_website,
    ai_directions) or isn't sure of it; a known district changes only together with the address. Phone, website and directions are among the fields only
    where events has their ai_ column."""
    fallback = F.col("model") == "fallback"
    starts = F.coalesce("start_at", F.when(sure("dt_conf"), F.col("ai_start")))
    scored = status_from_scores(F.col("fit"), F.col("confidence"))
    guarded = F.when((scored == "published") & starts.isNull(), "incomplete").when((scored == "published") & (starts < F.lit(now).cast("timestamp_ntz")), "archived").otherwise(scored)
    current, offered = F.trim(F.coalesce("address", F.lit(""))), F.trim(F.coalesce("ai_address", F.lit("")))
    vague = (current == "") | (F.length(current) < 20) | current.rlike(CITY_ONLY)
    fit = sure("loc_conf") & (offered != "") & ~F.trim(F.regexp_replace(offered, r"\s+", " ")).rlike(ADDRESS_PLACEHOLDER)
    real = offered.rlike("[0-9]") | offered.contains(",")
    price = sure("price_conf") & some("ai_price_type").isNotNull() & (F.col("price_type").isNull() | (F.col("price_type") == "unknown"))
    own = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    told = lambda c: F.when(sure("contact_conf"), F.nullif(F.trim(c), F.lit("")))
    contact = lambda name, c: F.when(fallback, own(name)).otherwise(F.coalesce(told(c), own(name))).alias(name)
    more = {"contact_phone": "ai_phone", "organizer_website": "ai_website", "organizer_directions": "ai_directions"}
    keep = lambda column, value: F.when(fallback, F.col(column)).otherwise(value)
    mine = F.nullif(own("location_district"), F.lit(""))
    moved = yes(vague & fit & real) | mine.isNull()
    district = F.when(fallback, own("location_district")).otherwise(F.coalesce(F.when(moved & sure("loc_conf"), some("ai_district")), own("location_district")))
    return events.where("has_ai").select(
        "id", F.when(fallback, "pending_ai").otherwise(guarded).alias("status"), keep("start_at", starts).alias("start_datetime"), keep("end_at", F.coalesce("end_at", F.when(sure("dt_conf"), F.col("ai_end")))).alias("end_datetime"),
        keep("address", F.when(vague & fit & real, offered).otherwise(F.col("address"))).alias("location_address"), district.alias("location_district"),
        keep("price_type", F.when(price, F.lower("ai_price_type")).otherwise(F.col("price_type"))).alias("price_type"),
        keep("price_min", F.when(price & F.col("ai_price_min").isNotNull(), F.col("ai_price_min")).when(price & (F.col("ai_price_type") == "free"), 0.0).otherwise(F.col("price_min"))).alias("price_min"),
        keep("age_min", F.coalesce("ai_age_min", "age_min")).alias("age_min"), keep("age_max", F.coalesce("ai_age_max", "age_max")).alias("age_max"), contact("contact_email", "ai_email"), *[contact(n, c) for n, c in more.items() if c in events.columns],
    )


def override(events: DataFrame, edits: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with the edited values, a revision row for each edit): edits are (id, field, value, user_id, reason) with at most
    one for an event; fields that may not be set are refused (no revision)."""
    allowed = edits.where(F.col("field").isin(fields)).withColumnRenamed("id", "__id")
    x = events.join(allowed, F.col("id") == F.col("__id"), "left")
    parsed = lambda f: F.nullif(F.col("value"), F.lit("")).try_cast(events.schema[f].dataType)
    out = x.select(*[F.when(F.col("field") == c, parsed(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in events.columns], F.when(F.col("field").isNotNull(), F.concat(F.lit("manual:"), F.col("field"))).alias("provenance"))
    old = F.coalesce(*[F.when(F.col("field") == f, F.col(f).cast("string")) for f in fields])
    log = x.where("field is not null").select("id", "field", old.alias("old_value"), "value", "user_id", F.nullif("reason", F.lit("")).alias("reason"))
    return out, log


def review(revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """revisions (id, event_id, field, new_value, status) with the status that decisions (id, decision) give them: only pending
    ones change; `applied` tells whose value goes into its event, `error` what was refused."""
    x = revisions.join(decisions.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    pending = F.col("status") == "pending"
    new = F.when(pending & (F.col("decision") == "approve"), "approved").when(pending & (F.col("decision") == "reject"), "rejected").otherwise(F.col("status"))
    applied = pending & yes(F.col("decision") == "approve")
    error = F.when(F.col("decision").isNotNull() & ~pending, F.concat(F.lit("already "), F.col("status")))
    return x.select(*[F.col(c) for c in revisions.columns if c != "status"], new.alias("status"), applied.alias("applied"), error.alias("error"))


def reschedule(events: DataFrame, moves: DataFrame) -> DataFrame:
    """events with moved ones cancelled and linked, and their copies on the new dates, to be reviewed. moves: (id, new_id,
    new_start, new_end, reason)."""
    x = events.join(moves.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    moved = F.col("__id").isNotNull()
    change = {
        "status": F.when(moved, "cancelled").otherwise(F.col("status")), "is_cancelled": moved | F.col("is_cancelled"), "rescheduled_to": F.when(moved, F.col("new_id")).otherwise(F.col("rescheduled_to")),
        "cancellation_reason": F.when(moved, F.coalesce(F.nullif("reason", F.lit("")), F.lit("Rescheduled"))), "previous_start": F.when(moved, F.col("start_datetime")),
    }
    fresh = {
        "id": F.col("new_id"), "status": F.lit("pending_review"), "is_cancelled": F.lit(False), "rescheduled_to": F.lit(None).cast(events.schema["rescheduled_to"].dataType), "start_datetime": F.col("new_start"),
        "end_datetime": F.coalesce("new_end", "end_datetime"), "cancellation_reason": F.lit(None).cast("string"), "previous_start": F.lit(None).cast(events.schema["start_datetime"].dataType),
    }
    columns = [*events.columns, "cancellation_reason", "previous_start"]
    take = lambda rule: [rule.get(c, F.col(c) if c in events.columns else None).alias(c) for c in columns]
    return x.select(*take(change)).union(x.where(moved).select(*take(fresh)))


def run_update(runs: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """runs with updates (id, new_status, new_found, needs_attention, finish): a final status sets the end, a failure asks for attention."""
    x = runs.join(updates.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    final, at = F.col("new_status").isin("success", "partial", "failed"), F.lit(now).cast("timestamp_ntz")
    ended = F.when(F.col("finish").isNotNull(), F.when(F.col("finish") == "now", at).otherwise(F.col("finish").try_cast("timestamp_ntz"))).when(yes(final), at)
    return x.select("id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_found", "events_found").alias("events_found"), ended.alias("finished_at"), F.coalesce("needs_attention", F.when(yes(F.col("new_status") == "failed"), True)).alias("needs_attention"))


def insert_missing(rows: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """rows and those offered whose key is not there yet, each key once (of several, the smallest row)."""
    first = offered.groupBy(*keys).agg(F.min(F.struct(*offered.columns)).alias("r")).select("r.*")
    return rows.unionByName(first.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns))


def upsert(rows: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """rows with the values of those offered under the same key, and the new ones."""
    o = offered.select(F.col(key), F.struct(*offered.columns).alias("__new"))
    x = rows.select(F.col(key), F.struct(*rows.columns).alias("__old")).join(o, key, "full")
    return x.select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in rows.columns if c != key])
