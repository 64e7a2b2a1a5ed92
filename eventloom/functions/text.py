"""German event text: normalising, extraction, PII redaction and rules, as built-in column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values below: keyword lists and patterns, in the order that decides.
FREE = ["kostenlos", "kostenfrei", "gratis", "umsonst", "eintritt frei", "freier eintritt", "ohne eintritt", "kein eintritt", "ohne kosten", "0 euro", "0€", "0,00", "for free"]
DONATION = ["auf spendenbasis", "spende erbeten", "pay what you want", "gegen spende", "hutsammlung", "freiwilliger beitrag", "spendendose", "wertschätzung", "pay what you can", "freiwillige spende"]
DONATION_MODE = ["spendenbasis", "spende erbeten", "pay what you want", "gegen spende", "hutsammlung", "freiwilliger beitrag"]
AVAILABILITY = [
    ("cancelled", ["abgesagt", "entfällt", "cancelled", "fällt aus", "findet nicht statt"]),
    ("postponed", ["verschoben", "postponed", "neuer termin"]),
    ("sold_out", ["ausverkauft", "sold out", "keine tickets", "restlos vergriffen"]),
    ("waitlist", ["warteliste", "waitlist", "warte-liste"]),
    ("registration_required", ["anmeldung erforderlich", "anmeldung nötig", "voranmeldung", "registrierung erforderlich", "nur mit anmeldung"]),
    ("available", ["tickets verfügbar", "tickets erhältlich", "jetzt buchen", "noch plätze frei", "restplätze"]),
]
INDOOR = ["indoor", "drinnen", "halle", "museum", "theater", "kino"]
OUTDOOR = ["outdoor", "draußen", "garten", "park", "wald", "spielplatz"]
ENGLISH, GERMAN = ["auf englisch", "in englisch", "english", "in english"], ["auf deutsch", "in deutsch", "auf deutscher sprache"]
LIMITED = ["begrenzte plätze", "begrenzte teilnehmerzahl", "limited spots", "nur noch wenige plätze", "max. teilnehmer", "maximale teilnehmerzahl"]
PARKING, NO_PARKING = ["parkplätze vorhanden", "parkplätze verfügbar", "kostenlose parkplätze", "parkhaus", "tiefgarage", "parkmöglichkeiten"], ["keine parkplätze", "kein parkplatz"]
RECURRENCE = [
    ("jeden montag", "jeden Montag"), ("jeden dienstag", "jeden Dienstag"), ("jeden mittwoch", "jeden Mittwoch"), ("jeden donnerstag", "jeden Donnerstag"), ("jeden freitag", "jeden Freitag"), ("jeden samstag", "jeden Samstag"), ("jeden sonntag", "jeden Sonntag"),
    ("täglich", "täglich"), ("jeden tag", "täglich"), ("wöchentlich", "wöchentlich"), ("monatlich", "monatlich"),
]
HARD = ["erotik", "strip", "nightclub", "bordell", "poker", "casino", "glücksspiel", "18+", "ab 18", "nur erwachsene", "adults only", "fkk"]
SOFT = ["singles", "single-party", "speed dating", "senioren", "seniorentreff", "rentner", "business", "b2b", "networking", "geschäftlich", "unternehmer", "bier", "wein", "cocktail", "spirituosen", "whisky", "craft beer", "stammtisch", "after work", "afterwork", "firmenfeier", "firmenevent", "corporate", "meditation für erwachsene", "yoga für erwachsene", "blutspende", "impfaktion"]
INCLUDE = ["kinder", "kids", "kind", "familie", "familien", "family", "jugend", "jugendliche", "teen", "baby", "kleinkind", "säugling", "eltern", "mutter", "vater", "mama", "papa", "schüler", "schulkind", "kindergarten", "kita", "kindertheater", "kinderkino", "kindermuseum", "kinderworkshop", "kinderkurs", "ferienprogramm", "ferienbetreuung", "spielplatz", "spielen", "vorlesestunde", "bilderbuchkino", "bastelnachmittag", "kinderflohmarkt", "kinderfest", "kinderfasching", "familiensonntag", "familientag", "krabbeln", "krabbelgruppe"]
CATEGORIES = {
    "museum": ["museum", "ausstellung", "galerie"], "zoo": ["zoo", "tierpark", "tiergarten", "aquarium", "wildpark"], "spielplatz": ["spielplatz", "spielen", "hüpfburg", "klettern"],
    "theater": ["kindertheater", "puppentheater", "marionettentheater"], "natur": ["wald", "natur", "wandern", "bauernhof", "garten"], "sport": ["schwimmen", "fußball", "turnen", "tanzen", "sport"],
    "kreativ": ["basteln", "malen", "kreativ", "werkstatt", "töpfern"], "musik": ["musikschule", "kinderchor", "musikalische früherziehung"], "bibliothek": ["bibliothek", "bücherei", "vorlesen", "lesung"],
}
EMAIL = r"[\w.-]+@[\w.-]+\.\w{2,}"
PII = [
    ("EMAIL", r"\b[\w.-]+@[\w.-]+\.\w{2,}\b"), ("PHONE_DE", r"\b(?:\+49|0049|0)\s?[\d\s/()-]{6,}\b"), ("PHONE_INTL", r"\b\+\d{1,3}\s?[\d\s/()-]{6,}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}\s?(?:[\dA-Z]{4}\s?){3,5}[\dA-Z]{0,4}\b"), ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
]
POSTAL, STREET = r"\b\d{5}\b", r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.|weg|platz|gasse|allee)\s+\d+[a-z]?\b"
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
ADDRESS_PLACEHOLDERS = ["siehe beschreibung", "s. beschreibung", "siehe text", "s. text", "siehe oben", "siehe unten", "siehe veranstalter", "siehe website", "siehe homepage", "s. u.", "siehe details", "details siehe", "s. d.", "siehe angaben", "entnehmen sie", "siehe veranstaltungsseite", "siehe eventbeschreibung", "s. b.", "siehe oben / unten"]


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether any word is part of the text."""
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_hit(text: Column, words: list[str]) -> Column:
    """The first word of the list that is part of the text; a chain of tests that compiles, unlike a lambda."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def hit_count(text: Column, words: list[str]) -> Column:
    """How many words of the list are part of the text."""
    return functools.reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern's first match, empty where they take no part, as an array; without a match its only entry is empty. A text
    is searched once: the second search starts where the first one found the match. For groups of digits or letters."""
    found = F.regexp_extract(text, f"(?s)(?:{pattern}).*", 0)
    return F.split(F.regexp_replace(found, f"(?s)^(?:{pattern}).*", "|".join(f"${k}" for k in range(1, n + 1))), r"\|")


def whole(groups_: Column, k: int) -> Column:
    """A group as a whole number; null if it is empty, not there or too large."""
    return F.when(F.get(groups_, F.lit(k)) != "", F.get(groups_, F.lit(k)).try_cast("int"))


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_query(text: Column) -> Column:
    """A search term's normal form: lower case, single blanks, at most 120 characters."""
    return F.substring(squeeze(F.lower(text)), 1, 120)


def display_title(text: Column) -> Column:
    """Without tags, at most 200 characters."""
    t = squeeze(F.regexp_replace(text, "<[^>]+>", ""))
    return F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 197), F.lit("..."))).otherwise(t)


def short_description(text: Column) -> Column:
    """At most 500 characters, cut after a full stop or at a blank beyond the 300th."""

    def cut(t, s):
        last = lambda c: F.length(s) - F.instr(F.reverse(s), c)  # noqa: E731  from 0; the length if there is none
        stop, blank = last("."), last(" ")
        return F.when((F.instr(s, ".") > 0) & (stop > 300), s.substr(F.lit(1), stop + 1)).when((F.instr(s, " ") > 0) & (blank > 300), F.concat(s.substr(F.lit(1), blank), F.lit("..."))).otherwise(F.concat(F.substring(t, 1, 497), F.lit("...")))

    short = lambda t: F.when(F.length(t) <= 500, t).otherwise(once(F.substring(t, 1, 500), lambda s: cut(t, s)))
    return once(squeeze(F.regexp_replace(text, "<[^>]+>", " ")), short)


def address(text: Column) -> Column:
    """Squeezed, at most 300 characters; null for phrases that only stand in for an address."""
    t = F.substring(squeeze(text), 1, 300)
    return F.when((t != "") & ~F.lower(t).isin(ADDRESS_PLACEHOLDERS), t)


def is_street(text: Column) -> Column:
    """A postal code, or a street ending with a number."""
    return text.rlike(r"(?:^|[^0-9A-Za-z_])[0-9]{5}(?:$|[^0-9A-Za-z_])") | F.lower(text).rlike(r"(?:str\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer)\s*[0-9]+")


def amount(text: Column, pattern: str) -> Column:
    """A price of a pattern's first group."""
    return once(F.regexp_extract(text, pattern, 1), lambda m: F.when(m != "", F.replace(m, F.lit(","), F.lit(".")).try_cast("double")))


def price(text: Column) -> Column:
    """struct(type, min) from a lower-case text: free words, donations (free too), then an amount in euros."""
    free = has_any(text, FREE) | has_any(text, DONATION)
    told = lambda kind, least: F.struct(F.lit(kind).alias("type"), F.lit(least).cast("double").alias("min"))
    paid = lambda value: F.when(value.isNotNull(), F.struct(F.lit("paid").alias("type"), value.alias("min"))).otherwise(told("unknown", None))
    return F.when(free, told("free", 0.0)).otherwise(once(amount(text, r"([0-9]+(?:[,.][0-9]{2})?)\s*(?:€|euro|eur)"), paid))


def price_details(text: Column) -> dict[str, Column]:
    """Adult, child and family prices and donation mode."""
    tail = r"[:\s]*([0-9]+(?:[,.][0-9]{2})?)\s*(?:€|euro)"
    return {"adult": amount(text, "erwachsene" + tail), "child": amount(text, "kind(?:er)?" + tail), "family": amount(text, "familien?(?:karte|ticket)?" + tail), "donation": has_any(text, DONATION_MODE)}


def age_range(text: Column, strict: bool = False) -> Column:
    """struct(low, high). The range's separator is one character of the class, so that 'x bis y' is read as 'bis y';
    strict reads it as a range."""
    years = r"\s*(?:jahren?|j\.?)"
    span = r"([0-9]+)\s*(?:[-–]|bis)\s*([0-9]+)" + years if strict else r"([0-9]+)\s*[-–bis]\s*([0-9]+)" + years
    pair = lambda a, b: F.struct(F.lit(a).cast("int").alias("low"), F.lit(b).cast("int").alias("high"))
    upto = lambda u: F.when(u.isNotNull(), pair(0, u)).otherwise(pair(None, None))
    since = lambda low: F.when(low.isNotNull(), pair(low, 99)).otherwise(once(whole(groups(text, r"bis\s*([0-9]+)" + years, 1), 0), upto))
    ranged = lambda g: F.when(whole(g, 0).isNotNull(), pair(whole(g, 0), whole(g, 1))).otherwise(once(whole(groups(text, r"ab\s*([0-9]+)" + years, 1), 0), since))
    return once(groups(text, span, 2), ranged)


def first_of(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The name of the first entry that has a word in the text."""
    return F.coalesce(*[F.when(has_any(text, words), F.lit(name)) for name, words in table])


def availability(text: Column) -> Column:
    """Booking status by precedence."""
    return first_of(text, AVAILABILITY)


def flags(text: Column) -> dict[str, Column]:
    """Indoor, outdoor, language, limited places, recurrence, parking."""
    only = lambda words: F.when(has_any(text, words), True)
    return {
        "indoor": only(INDOOR), "outdoor": only(OUTDOOR), "language": F.when(has_any(text, ENGLISH), "en").otherwise("de"), "limited": only(LIMITED),
        "recurrence": first_of(text, [(name, [word]) for word, name in RECURRENCE]), "parking": F.when(has_any(text, PARKING), True).when(has_any(text, NO_PARKING), False),
    }


def contacts(text: Column) -> dict[str, Column]:
    """The first e-mail address, and a phone number by three patterns in order."""
    tail = r"[\s/-]?[0-9]{2,4}[\s/-]?[0-9]{2,6}"
    first = lambda pattern: once(F.regexp_extract(text, pattern, 1), lambda m: F.when(m != "", m))
    phone = F.coalesce(first(r"(\+49[\s/-]?[0-9]{2,4}" + tail + ")"), first("(0[0-9]{2,4}" + tail + ")"), first(r"(\(0[0-9]{2,4}\)" + tail + ")"))
    email = F.when(text.contains("@"), first(r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,})"))
    return {"email": email, "phone": F.substring(F.trim(phone), 1, 50)}


def time_of_day(text: Column) -> Column:
    """struct(start, ending) in minutes of the day from a lower-case text; six patterns in order, hours from 6 to 23. A range
    that ends before it starts ends on the next day."""
    clock, word = r"([0-9]{1,2})(?:[:.]\s*([0-9]{2}))?", r"(?:uhr|h)"
    span = r"(?=[vz0-9])(?:(?:von|zwischen)\s+)?" + clock + r"\s*" + word + r"?\s*(?:bis|und|[-–])\s*" + clock + r"\s*" + word + "?"
    # a look at one character first rules out most places of a text
    edge, done = lambda first: f"(?=[{first}])(?<![a-z0-9_äöüß])", r"(?:$|[^a-z0-9_äöüß])"
    made = lambda a, b: F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("ending"))

    def minutes(g, k, least=6):
        """Hour and minute from the k-th group on, as minutes of the day."""
        h, m = whole(g, k), F.coalesce(whole(g, k + 1), F.lit(0))
        return F.when(h.between(least, 23) & m.between(0, 59), h * 60 + m)

    def tried(t, patterns):
        """The first pattern that tells a time; each is searched for only if those before it tell none."""
        if not patterns:
            day = groups(t, edge("vnam") + "(vormittag|nachmittag|abend|morgens)s?" + done, 1)
            return once(F.get(day, F.lit(0)), lambda d: made(F.when(d == "vormittag", 600).when(d == "nachmittag", 840).when(d == "abend", 1140).when(d == "morgens", 540), None))
        (pattern, told), *rest = patterns
        return once(once(groups(t, pattern, 2), lambda g: minutes(g, 0)), lambda at: F.when(at.isNotNull(), told(at)).otherwise(tried(t, rest)))

    starts, ends = lambda at: made(at, None), lambda at: made(None, at)
    single = [
        (r"(?=[ug])(?:um|gegen)\s*" + clock + r"\s*" + word, starts), (edge("a") + r"ab\s+" + clock + r"\s*" + word + done, starts),
        (edge("b") + r"bis\s+" + clock + r"\s*" + word + done, ends), (edge("0-9") + clock + r"\s*uhr" + done, starts),
    ]
    both = lambda t: once(groups(t, span, 4), lambda g: F.struct(minutes(g, 0).alias("a"), minutes(g, 2, 0).alias("b")))
    later = lambda p: made(p["a"], F.when(p["b"] <= p["a"], p["b"] + 1440).otherwise(p["b"]))
    return once(text, lambda t: once(both(t), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), later(p)).otherwise(tried(t, single))))


#: What a text must hold for a pattern to match at all: cheap to look for, without word boundaries.
_NEEDS = {
    "EMAIL": "@", "PHONE_DE": r"(?:\+49|0)[\p{Nd}\s\p{Z}/()-]{6}", "PHONE_INTL": r"\+\p{Nd}", "IBAN": r"\p{L}{2}\p{Nd}{2}", "CREDIT_CARD": r"\p{Nd}{4}[\s\p{Z}-]?\p{Nd}{4}",
    "POSTAL": r"\p{Nd}{5}", "STREET_DE": r"(?iu)(?:straße|str\.|weg|platz|gasse|allee)[\s\p{Z}]+\p{Nd}",
}


def redact(text: Column) -> Column:
    """Patterns replaced one after the other."""
    for name, pattern in PII:
        text = _replaced(text, name, pattern)
    return text


def redact_streets(redacted: Column) -> Column:
    """The aggressive form of a text that is redacted already."""
    return _replaced(redacted, "STREET_DE", STREET)


def _replaced(text: Column, name: str, pattern: str) -> Column:
    needed = text.contains("@") if name == "EMAIL" else text.rlike(_NEEDS[name])
    return F.when(needed, F.regexp_replace(text, f"(?iU){pattern}", f"[{name}_REDACTED]")).otherwise(text)


def has_pii(text: Column) -> Column:
    """Whether any pattern occurs, postal codes included."""
    found = [text.rlike(_NEEDS[name]) & text.rlike(f"(?iU){pattern}") for name, pattern in [("POSTAL", POSTAL), *PII, ("STREET_DE", STREET)]]
    return functools.reduce(lambda a, b: a | b, found)


def rule_filter(texts: DataFrame, column: str) -> DataFrame:
    """texts with (relevant, confidence, reason, n_hard, n_soft, n_include, categories) of the keyword rules on a lower-case column."""
    t = F.col(column)
    number = lambda p, g=1: part(t, p, g).try_cast("int")
    years = r"\s*(?:jahren?|j\.?)"
    lists = {"hard": HARD, "soft": SOFT, "include": INCLUDE}
    x = texts.withColumns(
        {f"__{n}": first_hit(t, w) for n, w in lists.items()} | {f"n_{n}": hit_count(t, w) for n, w in lists.items()}
        | {"categories": categories(t), "__top": number(r"([0-9]+)\s*[-–]\s*([0-9]+)" + years, 1), "__low": number(r"ab\s*([0-9]+)" + years)}
        | {"__plus": number(r"(?:^|[^0-9A-Za-z_])([0-9]{1,2})\s*\+"), "__months": number(r"ab\s*([0-9]{1,2})\s*(?:monate?n?|mon\.?)")}
    )
    hard, soft, inc = (F.col(f"__{n}") for n in lists)
    result = lambda r, c, why: F.struct(F.lit(r).cast("boolean").alias("relevant"), F.lit(c).cast("double").alias("confidence"), why.alias("reason"))
    say = F.lit
    rule = (
        F.when(hard.isNotNull(), result(False, 0.98, F.concat(F.lit("hard:"), hard)))
        .when(soft.isNotNull() & inc.isNull(), result(False, 0.8, F.concat(F.lit("soft:"), soft)))
        .when(soft.isNotNull(), result(None, 0.5, say("conflict")))
        .when(inc.isNotNull(), result(True, 0.9, F.concat(F.lit("include:"), inc)))
        .when(F.size("categories") > 0, result(True, 0.8, say("category")))
        .when(F.col("__top") <= 14, result(True, 0.85, say("age_range"))).when(F.col("__low") >= 16, result(False, 0.8, say("age_from"))).when(F.col("__low") <= 6, result(True, 0.9, say("age_from")))
        .when(F.col("__plus") <= 14, result(True, 0.85, say("age_plus"))).when(F.col("__months").isNotNull(), result(True, 0.95, say("months"))).otherwise(result(None, 0.0, say("none")))
    )
    kept = [*texts.columns, "__rule.relevant", "__rule.confidence", "__rule.reason", "n_hard", "n_soft", "n_include", "categories"]
    return x.withColumn("__rule", rule).select(*kept)


def categories(text: Column) -> Column:
    """Category names with a keyword in the text, sorted."""
    return F.sort_array(F.array_compact(F.array(*[F.when(has_any(text, w), F.lit(n)) for n, w in CATEGORIES.items()])))


def german_address(text: Column) -> Column:
    """Street, postal code and city in one line."""
    street = r"([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]*(?:straße|str\.|weg|platz|gasse|allee|ring|damm|ufer)\s*[0-9]+[a-z]?)\s*,\s*([0-9]{5})\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+)"
    return F.when(part(text, street, 2).isNotNull(), F.concat(part(text, street, 1), F.lit(", "), part(text, street, 2), F.lit(" "), part(text, street, 3)))


#: What is taken out of a user's text, and how lines begin that are dropped.
PROMPT_MARKERS = ["```", '"""', "'''", "###", "---", "==="]
PROMPT_ORDERS = ["system:", "user:", "assistant:", "ignore", "forget", "new instruction"]


def sanitize_prompt(text: Column, most: int = 4000) -> Column:
    """A user text for a prompt: capped, printable characters, line ends and tabs only, without markers and lines that give
    orders, no white space at its ends."""
    out = F.regexp_replace(F.substring(text, 1, most), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]", "")
    for marker in PROMPT_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    bare = lambda line: F.lower(F.ltrim(F.translate(line, "\t", " ")))
    keep = lambda line: ~functools.reduce(lambda a, b: a | b, [bare(line).startswith(o) for o in PROMPT_ORDERS])
    return F.coalesce(F.btrim(F.array_join(F.filter(F.split(out, "\n"), keep), "\n"), F.lit(" \n\t")), F.lit(""))
