"""JSON of replies and problems of answers, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.functions import answers as A


def parsed(text):
    """json.loads, or ... where it fails."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return ...


def plain_reply(text):
    """The JSON value that a reply holds, or ...: the whole, the first fenced block, the first balanced braces, then brackets."""
    tries = [text]
    if m := re.search(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.S):
        tries.append(m[1])
    for a, b in ("{}", "[]"):
        depth, start = 0, text.find(a)
        for i in range(start, len(text)) if start >= 0 else ():
            depth += (text[i] == a) - (text[i] == b)
            if depth == 0:
                tries.append(text[start : i + 1])
                break
    return next((v for t in tries if (v := parsed(t)) is not ...), ...)


PIECES = ['{"a": 1}', "{", "}", "[", "]", "[1, 2]", '"', '{"a": "}"}', "```", "```json\n", "\n", " ", "Sure: ", "null", "3", "ü", '{"b": [1, {"c": 2}]}', ",", ":"]


def test_replies(spark):
    r = random.Random(3)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 7))) for _ in range(5000)] + ['Sure: {"a": 1} and {"b": 2}', '{"a":1} trailing }', "{" * 500 + "}" * 500 + "x", '1, "x": 2', '1}, "y": {"z": 2', '{"a": "😀}"} [1]']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    got = {k: v for k, v in df.select("k", A.lenient_json(F.col("t"))).collect()}
    for k, t in enumerate(texts):
        want = plain_reply(t)
        assert (parsed(got[k]) if got[k] is not None else ...) == want, t
        assert got[k] is None or got[k] in t and got[k] == got[k].strip(" \t\r\n")
    assert sum(v is not None for v in got.values()) > 1000
    assert spark.createDataFrame([(None,)], "t string").select(A.lenient_json(F.col("t"))).first()[0] is None


def is_kind(v, kind):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v), "array": isinstance(v, list), "object": isinstance(v, dict)}[kind]


def valid(v, rule):
    """Whether a parsed value meets a rule."""
    if not any(is_kind(v, k) for k in rule.kinds.split()):
        return False
    if is_kind(v, "number") and (rule.low is not None and v < rule.low or rule.high is not None and v > rule.high):
        return False
    if isinstance(v, (str, list)) and rule.most is not None and len(v) > rule.most:
        return False
    if rule.values and isinstance(v, str) and v not in rule.values:
        return False
    if isinstance(v, list) and rule.items and not all(valid(x, rule.items) for x in v):
        return False
    return not isinstance(v, dict) or set(rule.required) <= set(v) and all(valid(v[k], r) for k, r in rule.fields.items() if k in v)


GOOD = {
    "CLASSIFICATION": {
        "categories": ["a", "b"], "is_family_friendly": True, "age_min": 3, "age_max": None, "is_indoor": None, "confidence": 0.5, "age_rating": "6+", "age_fit_buckets": {"0_2": 5, "13_15": 100},
        "ai_summary_short": "s" * 300, "ai_summary_highlights": ["x"], "ai_fit_blurb": None, "summary_confidence": 1, "flags": {"sensitive_content": False}, "extracted_end_datetime": None, "datetime_confidence": 0, "other": [1],
    },
    "SCORING": {"relevance_score": 5, "quality_score": 100, "family_fit_score": 0, "stressfree_score": None, "fun_score": 7.0, "reasoning": {"why": 1}},
    "PLAN": {
        "main_plan": [{"event_id": None, "event_title": "t", "slot_type": "travel", "start_time": "9", "duration_minutes": 30}, {"event_title": "u", "slot_type": "break", "start_time": "10", "notes": None}],
        "plan_b": [{}], "estimated_cost": 0.0, "tips": ["go"],
    },
}
ODD = [None, True, -1, 0, 1, 3.5, 99, 99.0, 100, 101, 1e3, 12345678901234567890, "", "6+", "activity", "s" * 151, "s" * 301, "😀" * 150, [], [1], ["a"] * 5, ["a"] * 6, {}, {"0_2": 900}, [[]], [{}]]


def mutated(r, value):
    """A value with one place changed, removed or left."""
    value = json.loads(json.dumps(value))
    at = value
    while True:
        keys = list(at) if isinstance(at, dict) else list(range(len(at)))
        if not keys:
            return value
        key = r.choice(keys)
        if isinstance(at[key], (dict, list)) and at[key] and r.random() < 0.6:
            at = at[key]
            continue
        if r.random() < 0.15:
            del at[key]
        else:
            at[key] = r.choice(ODD)
        return value


@pytest.mark.parametrize("name", sorted(GOOD))
def test_schemas(spark, name):
    r, schema = random.Random(name), getattr(A, name)
    values = [GOOD[name]]
    for _ in range(3500):
        v = GOOD[name]
        for _ in range(r.choice([1, 1, 2])):
            v = mutated(r, v)
        values.append(v)
    values += [None, [], 1, "x", {}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").repartition(4)
    got = {k: p for k, p in df.select("k", A.problems(F.col("t"), schema)).collect()}
    for k, v in enumerate(values):
        assert (got[k] == []) == valid(v, schema), (v, got[k])
    assert 500 < sum(p == [] for p in got.values()) < 3400


def test_refused(spark):
    cases = {
        '{"categories": [], "age_min": 3.5}': ["age_min_type"],
        '{"categories": [], "confidence": "high"}': ["confidence_type"],
        '{"categories": [], "age_fit_buckets": {"0_2": 900}}': ["age_fit_buckets_0_2_range"],
        '{"categories": [1, 2]}': ["categories_items"],
        '{"categories": [], "datetime_confidence": 7}': ["datetime_confidence_range"],
        '{"categories": []} x': ["no_object", "categories_missing"],
        '{"categories": [], "categories": []}': ["no_object", "categories_missing"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert dict(df.select("t", A.problems(F.col("t"))).collect()) == cases
    assert spark.createDataFrame([(None,)], "t string").select(A.problems(F.col("t"))).first()[0] == ["no_object", "categories_missing"]
