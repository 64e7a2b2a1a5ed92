"""Answers of language models: the JSON in a reply, read strictly, and what is wrong with it by a schema table.

All of it are column expressions over VARIANT values, so nothing leaves the engine.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import once

#: What age ratings there are.
RATINGS = ["0+", "3+", "6+", "10+", "13+", "16+", "18+"]
#: Fixed value: JSON's blanks.
_BLANKS = " \t\r\n"


def strict_json(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else, else null (also for null and for objects with a repeated key).

    The engine's parser stops at the end of the first value and ignores the rest. So the text is put into an object before a key that it
    can't know, its own digest: what follows the value then breaks the object, ends it before that key, or adds a third key.
    """
    key = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"'), key, F.lit('":1}')))
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    alone = lambda v: once(keys(v), lambda k: (F.size(k) == 2) & F.array_contains(k, key))
    return once(whole, lambda v: F.when(alone(v), F.try_variant_get(v, "$.value", "variant")))


def balanced(text: Column, opening: str, closing: str) -> Column:
    """From the first opening character to the closing one that balances it, counted without regard to quotes; null if none does."""
    tail = F.substr(text, F.nullif(F.locate(opening, text), F.lit(0)))
    opens = lambda part: F.length(part) - F.length(F.replace(part, F.lit(opening), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))

    def step(state, part):
        """One more part of the text, up to a closing character."""
        depth = state["depth"] + opens(part) - 1
        after = F.struct(depth.alias("depth"), (state["length"] + F.length(part) + 1).alias("length"), (depth == 0).alias("done"))
        return F.when(state["done"], state).otherwise(after)

    parts = F.split(tail, "\\" + closing)
    end = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    return F.when(end["done"], F.substr(tail, F.lit(1), end["length"]))


def lenient_json(text: Column) -> Column:
    """The JSON of a reply, without blanks around it: the whole text, else the first fenced block, else the first balanced braces, else
    the first balanced brackets, whichever is strictly JSON first; null if none is."""
    fenced = F.regexp_extract(text, r"(?sU)```(?:json)?[\s\x1c-\x1f]*\n?(.*?)\n?```", 1)
    good = lambda c: F.when(strict_json(c).isNotNull(), F.btrim(c, F.lit(_BLANKS)))
    return F.coalesce(good(text), good(fenced), good(balanced(text, "{", "}")), good(balanced(text, "[", "]")))


@dataclass(frozen=True)
class Rule:
    """What a value may be: its kinds, its range, its greatest length or size, its allowed texts, the rule of its items, the rules of its
    fields and which of them must be there. `label` is what problems call it, else its field's name."""

    kinds: str
    low: float | None = None
    high: float | None = None
    most: int | None = None
    values: tuple = ()
    items: Rule | None = None
    fields: dict = field(default_factory=dict)
    required: tuple = ()
    label: str = ""


_AGE, _SHARE = Rule("integer null", 0, 99), Rule("number", 0, 1)
_SCORE, _TEXT = Rule("integer", 0, 100), Rule("string null")
_YES = Rule("boolean")

#: The schemas of the three kinds of answers.
CLASSIFICATION = Rule("object", required=("categories",), fields={
    "categories": Rule("array", most=5, items=Rule("string")),
    "is_family_friendly": _YES,
    "age_min": _AGE,
    "age_max": _AGE,
    "is_indoor": Rule("boolean null"),
    "is_outdoor": Rule("boolean null"),
    "confidence": _SHARE,
    "age_rating": Rule("string", values=tuple(RATINGS)),
    "age_fit_buckets": Rule("object", fields={b: _SCORE for b in ("0_2", "3_5", "6_9", "10_12", "13_15")}),
    "ai_summary_short": Rule("string null", most=300, label="summary"),
    "ai_summary_highlights": Rule("array", most=5, items=Rule("string"), label="highlights"),
    "ai_fit_blurb": Rule("string null", most=150, label="blurb"),
    "summary_confidence": _SHARE,
    "flags": Rule("object", fields={"sensitive_content": _YES, "needs_escalation": _YES}),
    "extracted_start_datetime": _TEXT,
    "extracted_end_datetime": _TEXT,
    "extracted_location_address": _TEXT,
    "extracted_location_district": _TEXT,
    "datetime_confidence": _SHARE,
    "location_confidence": _SHARE,
})
SCORING = Rule("object", required=("relevance_score", "quality_score", "family_fit_score"), fields={
    "relevance_score": _SCORE,
    "quality_score": _SCORE,
    "family_fit_score": _SCORE,
    "stressfree_score": Rule("integer null", 0, 100),
    "fun_score": Rule("integer null", 0, 100),
    "reasoning": Rule("object string null"),
})
PLAN = Rule("object", required=("main_plan",), fields={
    "main_plan": Rule("array", items=Rule("object", required=("event_title", "slot_type", "start_time"), fields={
        "event_id": _TEXT,
        "event_title": Rule("string"),
        "slot_type": Rule("string", values=("activity", "break", "travel")),
        "start_time": Rule("string"),
        "end_time": Rule("string"),
        "duration_minutes": Rule("integer", 0),
        "notes": _TEXT,
    })),
    "plan_b": Rule("array", items=Rule("object")),
    "estimated_cost": Rule("number", 0),
    "tips": Rule("array", items=Rule("string")),
})

_NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_KINDS = {"string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "number": _NUMBERS, "integer": _NUMBERS, "array": "^ARRAY", "object": "^OBJECT"}


def _kind_is(value: Column, schema: Column, kind: str) -> Column:
    """Whether a VARIANT of a schema (a text) is of a kind; whole numbers are integers however they are written."""
    fits = schema.rlike(_KINDS[kind])
    if kind == "integer":
        return fits & once(F.try_variant_get(value, "$", "double"), lambda number: number == F.rint(number))
    return fits


def _any(conditions) -> Column:
    """Whether any condition holds; unknown ones don't."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _names(found: list[tuple[str, Column]]) -> Column:
    """The names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in found]))


def _read(value: Column, use) -> Column:
    """use(value, its schema), both computed once."""
    return once(F.struct(value.alias("v"), F.schema_of_variant(value).alias("s")), lambda h: use(h["v"], h["s"]))


def _fields(value: Column, is_object: Column, rule: Rule, prefix: str) -> list[Column]:
    """The names of the problems of each field of an object."""

    def each(key: str, inner: Rule) -> Column:
        name = prefix + (inner.label or key)
        lack = _names([(f"{name}_missing", is_object)]) if key in rule.required else F.array().cast("array<string>")
        return once(F.when(is_object, F.try_variant_get(value, f"$['{key}']", "variant")), lambda held: F.when(held.isNull(), lack).otherwise(broken(held, inner, name)))

    return [each(key, inner) for key, inner in rule.fields.items()]


def broken(value: Column, rule: Rule, name: str) -> Column:
    """The names of the problems that a VARIANT, which is there, has by a rule. Each value is read and its kind found once."""

    def found(v: Column, s: Column) -> Column:
        own = [(f"{name}_type", ~_any(_kind_is(v, s, k) for k in rule.kinds.split()))]
        if rule.low is not None or rule.high is not None:
            ends = [(rule.low, Column.__lt__), (rule.high, Column.__gt__)]
            outside = lambda n: _any(beyond(n, F.lit(float(end))) for end, beyond in ends if end is not None)
            own.append((f"{name}_range", _kind_is(v, s, "number") & once(F.try_variant_get(v, "$", "double"), outside)))
        text = F.when(_kind_is(v, s, "string"), F.try_variant_get(v, "$", "string"))
        listed = F.when(_kind_is(v, s, "array"), F.try_variant_get(v, "$", "array<variant>"))
        if rule.most is not None:
            own.append((f"{name}_too_many", F.size(listed) > rule.most) if rule.kinds.startswith("array") else (f"{name}_long", F.length(text) > rule.most))
        if rule.values:
            own.append((f"{name}_enum", ~text.isin(*rule.values)))
        if rule.items:
            bad = lambda x: F.coalesce(F.size(broken(x, rule.items, "item")) > 0, F.lit(False))
            own.append((f"{name}_items", F.exists(listed, bad)))
        inside = _fields(v, F.coalesce(_kind_is(v, s, "object"), F.lit(False)), rule, f"{name}_") if rule.fields else []
        return F.concat(_names(own), *inside)

    return _read(value, found)


def problems(answer: Column, schema: Rule = CLASSIFICATION) -> Column:
    """What is wrong with a JSON answer (a text) by a schema: an array of names in the schema's order, empty for a valid answer.

    A text that isn't strictly a JSON object is `no_object` and lacks all that is required.
    """

    def found(v: Column, s: Column) -> Column:
        """The names for one parsed answer."""
        lack = [(f"{inner.label or key}_missing", F.lit(True)) for key, inner in schema.fields.items() if key in schema.required]
        return F.when(F.coalesce(_kind_is(v, s, "object"), F.lit(False)), F.concat(*_fields(v, F.lit(True), schema, ""))).otherwise(_names([("no_object", F.lit(True)), *lack]))

    return _read(strict_json(answer), found)
