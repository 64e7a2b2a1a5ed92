"""What web pages show and declare, read from their trees inside Arrow-batched functions."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from eventloom.session import ship_package  # noqa: F401  callers ship the package first
from eventloom.sources.tree import Node, hidden, parse, select

#: Event types.
EVENT_TYPES = {"Event", "MusicEvent", "TheaterEvent", "SportsEvent", "ChildrensEvent", "Festival", "ExhibitionEvent", "EducationEvent", "SocialEvent", "CourseInstance"}
#: Fixed value: how much text of a page a language model gets.
MOST_TEXT = 12_000


def text_of(value) -> str | None:
    """A JSON-LD value as a text: of lists the first, of objects their value or name."""
    for _ in range(64):  # a value may be wrapped more than once
        if isinstance(value, list):
            value = value[0] if value else None
        elif isinstance(value, dict):
            value = value.get("@value", value.get("name"))
        else:
            break
    if value is None or isinstance(value, (list, dict)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _first(value):
    """The first of a list, or the value itself, if it is an object."""
    value = value[0] if isinstance(value, list) and value else value
    return value if isinstance(value, dict) else {}


def number_of(value) -> float | None:
    """A price or coordinate, a comma taken for a point; none where it can't be read or isn't finite."""
    try:
        found = float(text_of(value).replace(",", "."))
    except (AttributeError, ValueError):
        return None
    return found if math.isfinite(found) else None


def _events(value):
    """Event objects of a JSON-LD value, in order: of lists, graphs and single objects, nested as deeply as they like."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, list):
            left += reversed(value)
        elif isinstance(value, dict):
            kind = value.get("@type")
            kind = kind[0] if isinstance(kind, list) and kind else kind
            if isinstance(kind, str) and kind in EVENT_TYPES:
                yield value
            left.append(value.get("@graph", []))


FIELDS = ["title", "description", "start", "ending", "place", "address", "url", "image", "organizer", "currency", "price", "lat", "lng", "source"]
_NUMBERS = ("lat", "lng")


def declared(root: Node) -> list[dict]:
    """Events that a page declares: JSON-LD first, microdata if there is none. What has no title is no event."""
    found = []
    for script in select(root, 'script[type="application/ld+json"]'):
        try:
            blocks = list(_events(json.loads("".join(script.page.texts[script.page.first[script.i] : script.page.last[script.i]]))))
        except (ValueError, RecursionError):
            continue
        found += [_from_json(e) for e in blocks]
    found = [e for e in found if e["title"]]
    if found:
        return found
    page = root.page
    for i in range(1, len(page.tag)):
        kind = page.attrs[i].get("itemtype", "")
        if "schema.org/" in kind and any(f"schema.org/{t}" in kind for t in EVENT_TYPES):
            event = _from_markup(root.page.node(i))
            if event["title"]:
                found.append(event)
    return found


def _from_json(e: dict) -> dict:
    place, offers = e.get("location"), e.get("offers")
    whole = _first(place)
    address = whole.get("address")
    if isinstance(address, dict):
        address = ", ".join(t for t in (text_of(address.get(k)) for k in ("streetAddress", "postalCode", "addressLocality")) if t) or None
    geo, offer = _first(whole.get("geo")), _first(offers)
    image = e.get("image")
    image = image[0] if isinstance(image, list) and image else image
    return {
        "title": text_of(e.get("name")) or text_of(e.get("headline")), "description": text_of(e.get("description")), "start": text_of(e.get("startDate")), "ending": text_of(e.get("endDate")),
        "place": text_of(whole.get("name")) if whole else text_of(place), "address": text_of(address) if whole else text_of(place), "url": text_of(e.get("url")),
        "image": text_of(image.get("url")) if isinstance(image, dict) else text_of(image), "organizer": text_of(e.get("organizer")),
        "price": text_of(offer.get("price")), "currency": (text_of(offer.get("priceCurrency")) or "EUR") if offer else None,
        "lat": number_of(geo.get("latitude")), "lng": number_of(geo.get("longitude")), "source": "json-ld",
    }


def _from_markup(item: Node) -> dict:
    """The first property of each name inside an element, by its content, its time or its text."""
    names = {"title": "name", "description": "description", "start": "startDate", "ending": "endDate", "place": "location", "address": "address", "url": "url", "image": "image", "price": "price"}
    seen: dict[str, Node] = {}
    for n in item.walk():
        if "itemprop" in n.attrs:
            seen.setdefault(n.attrs["itemprop"], n)
    out = dict.fromkeys(FIELDS) | {"source": "microdata"}
    for field, prop in names.items():
        if n := seen.get(prop):
            out[field] = n.attrs.get("content") or n.attrs.get("datetime") or n.text() or None
    return out


_EVENT = ArrayType(StructType([StructField(n, StringType()) for n in ("title", "start", "ending", "place", "price", "source")]))


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """What a reader sees: line by line, without noisy elements and consent boxes, MOST_TEXT characters at most."""
    return html.map(lambda h: re.sub(r"\n{3,}", "\n\n", "\n".join(parse(h).strings(hidden)))[:MOST_TEXT])


@F.pandas_udf(_EVENT)
def structured_events(html: pd.Series) -> pd.Series:
    """The main fields of the events that a page declares."""
    return html.map(lambda h: [{n: e[n] for n in _EVENT.elementType.names} for e in declared(parse(h))])


@F.pandas_udf(ArrayType(StructType([StructField(n, DoubleType() if n in _NUMBERS else StringType()) for n in FIELDS])))
def declared_events(html: pd.Series) -> pd.Series:
    """All fields of the events that a page declares."""
    return html.map(lambda h: declared(parse(h)))


def page_title(html: Column) -> Column:
    """The heading, else og:title, else the title up to its first separator."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""))
    og = F.nullif(F.trim(F.regexp_extract(html, "(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)", 1)), F.lit(""))
    head = F.trim(F.regexp_extract(inner("title"), r"(?s)^(.*?)(?:\s*[|–—-]\s*|$)", 1))
    return F.when(F.length(inner("h1")) > 3, inner("h1")).when(og.isNotNull(), og).when(F.length(head) > 3, head)
