"""Fields of web pages by their markup, read from flat page trees inside Arrow batches.

What needs the tree (visible text, labelled places, descriptions, configured selectors) is read once for each page in Python;
dates, addresses and prices are then found by column expressions in the engine.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dates, text as T
from eventloom.session import ship_package
from eventloom.sources.html import page_title
from eventloom.sources.tree import Node, hidden, holders, parse, select

#: Labels of places, what such labels look like in running text, containers of descriptions.
PLACE_LABELS = {"ort", "ort:", "veranstaltungsort", "veranstaltungsort:", "spielort", "spielort:", "location", "location:", "wo", "wo:", "wo?", "adresse", "adresse:", "anfahrt", "anfahrt:", "treffpunkt", "treffpunkt:", "venue", "venue:"}
PLACE_TEXT = re.compile(r"(?:Ort|Veranstaltungsort|Location|Spielort|Spielstätte|Wo|Adresse|Anfahrt|Treffpunkt|Venue|Wo\?)\s*[:]\s*(.+)", re.I)
PLACE_ARIA = ("ort", "veranstaltungsort", "location", "venue", "adresse")
DESCRIPTION_BOXES = [".vevent", "#description", ".event-detail", ".event-content", ".event-description", "article.event", '[itemtype*="Event"]', ".detail-contents"]
#: field -> confidence of what the heuristics find.
CONFIDENCE = {"title": 0.70, "start_datetime": 0.70, "end_datetime": 0.65, "location_address": 0.75, "location_name": 0.65, "image": 0.70, "description": 0.60}
CONFIGURED = 0.95


def _is_label(node: Node) -> bool:
    return node.length() < 32 and node.text().lower() in PLACE_LABELS


def location_name(root: Node, visible: str) -> str | None:
    """The place's name: by a label in the text, beside a label's element, in a table row, by aria labels."""
    m = PLACE_TEXT.search(visible)
    if m and 0 < len(m[1].strip()) <= 200:
        return m[1].strip()
    for n in root.walk():
        if n.tag in ("dt", "th", "label", "strong", "b", "span") and _is_label(n):
            for beside in (n.next(), n.parent.next() if n.parent else None):
                if beside and beside.length() > 2:
                    return beside.text(most=200)
    for row in select(root, "table tr"):
        cells = []
        for c in row.walk():
            if c.tag in ("td", "th"):
                cells.append(c)
                if len(cells) == 2:
                    break
        if len(cells) == 2 and _is_label(cells[0]) and cells[1].length() > 2:
            return cells[1].text(most=200)
    for n in root.walk():
        if n.attrs and any(w in n.attrs.get("aria-label", "").lower() for w in PLACE_ARIA) and n.length() > 2:
            return n.text(most=200)
    return None


def description(root: Node) -> str | None:
    """An event's text: its container, else the paragraphs of the main part, else a long description in the head."""
    for css in DESCRIPTION_BOXES:
        for box in select(root, css, 1):
            if box.length(1) > 50:
                return box.text("\n", 8000)
    main = next((n for tag in ("main", "article", "body") for n in select(root, tag, 1)), None)
    if main is not None:
        told = "\n".join(p.text(most=8000) for p in select(main, "p") if p.length() > 10)
        if len(told) > 50:
            return told[:8000]
    for css in ('meta[property="og:description"]', 'meta[name="description"]'):
        for n in select(root, css, 1):
            if len(n.attrs.get("content", "").strip()) > 80:
                return n.attrs["content"].strip()[:8000]
    return None


def og_image(root: Node) -> str | None:
    """The page's own image, if its link is whole."""
    url = next((n.attrs.get("content", "").strip() for n in select(root, 'meta[property="og:image"]', 1)), "")
    return url if url.startswith(("http://", "https://")) else None


def value_of(node: Node, attr: str) -> str:
    """An element's text or one of its attributes."""
    if attr in ("text", ""):
        return node.text(" ")
    return node.attrs.get(attr, "").strip()


def configured(root: Node, fields: dict[str, tuple[list[str], str]], base: str = "") -> dict[str, tuple[str, str]]:
    """field -> (value, selector): the first selector of each field that finds something; image links are made whole."""
    found = {}
    for field, (selectors, attr) in fields.items():
        for css in selectors:
            value = next((value_of(n, attr) for n in select(root, css, 1)), "")
            if value:
                found[field] = (urljoin(base, value) if field in ("image", "image_url") and base else value, css)
                break
    return found


#: The default selectors of an event list, and which attribute a field comes from first.
LIST = {"title": "h2, h3, .title", "date": ".date, time", "description": ".description, p", "link": "a", "image": "img", "location_name": '.location, .venue, [itemprop="name"]', "location_address": '.address, [itemprop="address"]'}
LIST_ATTRIBUTES = {"date": ["datetime"], "link": ["href"], "image": ["src", "data-src"], "location_address": ["content"]}


def list_rows(root: Node, base: str, items: str = ".event", selectors: dict[str, str] | None = None) -> list[dict]:
    """One dictionary for each element of a list that has a title."""
    out = []
    for item in select(root, items):
        row = {}
        for field, css in (LIST | (selectors or {})).items():
            node = next(iter(select(item, css, 1)), None)
            if node is None:
                continue
            given = next((node.attrs[a] for a in LIST_ATTRIBUTES.get(field, []) if node.attrs.get(a)), None)
            row[field] = (given if field in ("link", "image") else given or node.text()) or None
            if field in ("link", "image") and row[field]:
                row[field] = urljoin(base, row[field])
        if row.get("title"):
            out.append(row)
    return out


def suggest(root: Node, value: str) -> str | None:
    """A selector for the smallest, innermost element whose text or content holds a value: its id, else a property, else classes, else a
    path of tags, the first that finds no other element before it."""
    if not value or not (held := holders(root, value)):
        return None
    node = min(reversed(held), key=lambda h: h[0])[1]
    tries = [f"#{node.attrs['id']}"] if node.attrs.get("id") else []
    tries += [f'[itemprop="{node.attrs["itemprop"]}"]'] if node.attrs.get("itemprop") else []
    classes = node.attrs.get("class", "").split()
    tries += [f"{node.tag}.{c}" for c in classes] + (["{}.{}".format(node.tag, ".".join(classes))] if len(classes) > 1 else [])
    for css in tries:
        if select(root, css, 1) == [node]:
            return css
    path, at = [], node
    while at is not None and at.tag:
        path.insert(0, at.tag)
        if select(root, " ".join(path), 1) == [node]:
            return " ".join(path)
        at = at.parent
    return None


_PARTS = "visible string, location_name string, image string, description string"


def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without their html, with what only the tree tells: visible text, place, image, description."""
    ship_package(pages.sparkSession)
    kept = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            rows = []
            for h in batch.column(html).to_pylist():
                root = parse(h)
                visible = re.sub(r"\n{3,}", "\n\n", "\n".join(root.strings(hidden)))
                rows.append((visible, location_name(root, visible), og_image(root), description(root)))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c, pa.string()) for c in columns]], [*kept, "visible", "location_name", "image", "description"])

    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept], _PARTS])
    return pages.mapInArrow(run, schema)


def heuristics(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, field, value, confidence): what the heuristics find on pages with 30 characters of text at least."""
    titled = pages.select(key, html, page_title(F.col(html)).alias("title"))
    x = dates.with_datetime(page_parts(titled, html), "visible", extended=True).where(F.length("visible") >= 30)
    x = x.withColumns({"start_datetime": F.date_format("starts", "yyyy-MM-dd'T'HH:mm:ss"), "end_datetime": F.date_format("ends", "yyyy-MM-dd'T'HH:mm:ss"), "location_address": T.german_address(F.col("visible"))})
    entry = lambda n, c: F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.lit(c).alias("confidence"))
    return x.select(key, F.inline(F.array(*[entry(n, c) for n, c in CONFIDENCE.items()]))).where("value is not null")


def from_selectors(pages: DataFrame, key: str, fields: dict[str, tuple[list[str], str]], html: str = "html", base: str = "") -> DataFrame:
    """(key, field, value, confidence, evidence) by configured selectors; dates that can't be read are left out."""
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [(k, f, v, css) for k, h in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()) for f, (v, css) in configured(parse(h), fields, base).items()]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(key).type), *[pa.array(c, pa.string()) for c in columns[1:]]], [key, "field", "value", "css"])

    x = dates.with_formats(pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, field string, value string, css string"), "value")
    timed = F.col("field").isin("start_datetime", "end_datetime")
    value = F.when(timed, F.date_format("parsed", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("value"))
    return x.select(key, "field", value.alias("value"), F.lit(CONFIGURED).alias("confidence"), F.concat(F.lit("css:"), "css").alias("evidence")).where("value is not null")


def event_lists(pages: DataFrame, key: str, base: str, html: str = "html", items: str = ".event") -> DataFrame:
    """(key, title, date, description, link, image, location_name, location_address) of every element of a page's event list."""
    ship_package(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    names = list(LIST)

    def run(batches):
        for batch in batches:
            rows = [(k, *[r.get(n) for n in names]) for k, h in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist()) for r in list_rows(parse(h), base, items)]
            columns = list(zip(*rows)) or [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(key).type), *[pa.array(c, pa.string()) for c in columns[1:]]], [key, *names])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} string" for n in names))
