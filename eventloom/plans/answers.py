"""Answers of language models against their three schemas: answers put together from the rows of orders, each field in every kind of state.

A field's value is one of a list by a column of the row, an empty one leaves the field out. The SQL states each rule by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import answers as A
from eventloom.plans.fields import made

#: States of a whole number, of a share and of lists, objects and texts.
WHOLE = ["5", "0", "100", "101", "-1", "3.5", "7.0", '"8"', "null", "true", "[1]", "", "12"]
SHARE = ["0.5", "0", "1", "1.01", "-0.5", '"high"', "null", "false", ""]
CATEGORIES = ["[]", '["a","b"]', '["a",1]', '["a","b","c","d","e","f"]', '"a"', "null", ""]
FLAGS = ['{"sensitive_content": true}', '{"sensitive_content": 1}', "[]", "{}", ""]
RATING = ['"6+"', '"7+"', "null", "6", "", '"18+"']
REASONING = ['"because"', '{"a": 1}', "null", "3", "[1]", "", "true"]
SLOT = ['"activity"', '"nap"', "3", "", '"travel"', '"break"', "null"]
START = ['"10:00"', "", "null", '"11:30"', "9"]
TIPS = ['["a"]', '["a",1]', '"x"', "null", "", "[]"]
PLAN_B = ['[{"a": 1}]', '[1]', "[]", "", "{}", "null"]

_NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def _state(states: list[str], by: str) -> str:
    """One of some states by a whole number."""
    return f"split_part('{'|'.join(states)}', '|', CAST({by} % {len(states)} AS INT) + 1)"


def _answers(fields: dict[str, tuple[list[str], str]], more: str = "''") -> str:
    """A CTE of one answer for each order: fields by their states, and what another expression adds."""
    cut = ", ".join(f"{_state(states, by)} AS f{k}" for k, (states, by) in enumerate(fields.values()))
    parts = ", ".join(f"CASE WHEN f{k} = '' THEN '' ELSE concat(', \"{name}\": ', f{k}) END" for k, name in enumerate(fields))
    numbers = "n AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(floor(o_totalprice) AS INT) AS p, CAST(floor(o_totalprice * 10) AS INT) AS q FROM orders)"
    return f"{numbers}, f AS (SELECT id, c, p, q, {cut} FROM n), answers AS (SELECT id, concat('{{\"v\": 1', {parts}, {more}, '}}') AS answer FROM f)"


def _type(path: str) -> str:
    return f"json_type(answer, '$.{path}')"


def _number(path: str) -> str:
    return f"TRY_CAST(json_extract_string(answer, '$.{path}') AS DOUBLE)"


def _integer(path: str) -> str:
    return f"({_type(path)} IN ('UBIGINT', 'BIGINT') OR ({_type(path)} = 'DOUBLE' AND {_number(path)} = floor({_number(path)})))"


def _missing(path: str, name: str) -> str:
    return f"CASE WHEN {_type(path)} IS NULL THEN '{name}_missing' END"


def _not(path: str, name: str, fits: str) -> str:
    return f"CASE WHEN {_type(path)} IS NOT NULL AND NOT ({fits}) THEN '{name}_type' END"


def _outside(path: str, name: str, high: float) -> str:
    return f"CASE WHEN {_type(path)} IN {_NUMBERS} AND NOT {_number(path)} BETWEEN 0 AND {high} THEN '{name}_range' END"


def _query(ctes: str, checks: list[str]) -> str:
    return f"WITH {ctes} SELECT id, concat_ws(',', {', '.join(checks)}) AS problems FROM answers"


CLASSIFIED = _answers({
    "categories": (CATEGORIES, "id"), "age_min": (WHOLE, "c"), "confidence": (SHARE, "p"), "age_rating": (RATING, "q"),
    "flags": (FLAGS, "(id + p)"), "datetime_confidence": (SHARE, "(c + p)"),
}, more=f"concat(', \"age_fit_buckets\": {{\"0_2\": ', CASE WHEN {_state(WHOLE, 'q')} = '' THEN '1' ELSE {_state(WHOLE, 'q')} END, '}}')")
_BUCKET = "age_fit_buckets.\"0_2\""


@register("classification_answers", _query(CLASSIFIED, [
    _missing("categories", "categories"), _not("categories", "categories", f"{_type('categories')} = 'ARRAY'"),
    "CASE WHEN json_array_length(answer, '$.categories') > 5 THEN 'categories_too_many' END",
    f"CASE WHEN {_type('categories')} = 'ARRAY' AND len(list_filter(json_extract(answer, '$.categories[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'categories_items' END",
    _not("age_min", "age_min", f"{_integer('age_min')} OR {_type('age_min')} = 'NULL'"), _outside("age_min", "age_min", 99),
    _not("confidence", "confidence", f"{_type('confidence')} IN {_NUMBERS}"), _outside("confidence", "confidence", 1),
    _not("age_rating", "age_rating", f"{_type('age_rating')} = 'VARCHAR'"),
    f"CASE WHEN {_type('age_rating')} = 'VARCHAR' AND json_extract_string(answer, '$.age_rating') NOT IN ('0+', '3+', '6+', '10+', '13+', '16+', '18+') THEN 'age_rating_enum' END",
    _not(_BUCKET, "age_fit_buckets_0_2", _integer(_BUCKET)), _outside(_BUCKET, "age_fit_buckets_0_2", 100),
    _not("flags", "flags", f"{_type('flags')} = 'OBJECT'"), _not("flags.sensitive_content", "flags_sensitive_content", f"{_type('flags.sensitive_content')} = 'BOOLEAN'"),
    _not("datetime_confidence", "datetime_confidence", f"{_type('datetime_confidence')} IN {_NUMBERS}"), _outside("datetime_confidence", "datetime_confidence", 1),
]))
def classification_answers(spark, d):
    return made(spark, d, CLASSIFIED, "answers").select("id", F.array_join(A.problems(F.col("answer"), A.CLASSIFICATION), ",").alias("problems"))


SCORED = _answers({
    "relevance_score": (WHOLE, "id"), "quality_score": (WHOLE, "c"), "family_fit_score": (WHOLE, "p"), "fun_score": (WHOLE, "q"), "reasoning": (REASONING, "(id + c)"),
})


@register("scoring_answers", _query(SCORED, [
    *[c for n in ("relevance_score", "quality_score", "family_fit_score") for c in (_missing(n, n), _not(n, n, _integer(n)), _outside(n, n, 100))],
    _not("fun_score", "fun_score", f"{_integer('fun_score')} OR {_type('fun_score')} = 'NULL'"), _outside("fun_score", "fun_score", 100),
    _not("reasoning", "reasoning", f"{_type('reasoning')} IN ('OBJECT', 'VARCHAR', 'NULL')"),
]))
def scoring_answers(spark, d):
    return made(spark, d, SCORED, "answers").select("id", F.array_join(A.problems(F.col("answer"), A.SCORING), ",").alias("problems"))


_STOP = (
    "concat('{\"event_title\": \"t\", \"slot_type\": \"activity\", \"start_time\": \"9:00\"}, {\"event_title\": \"u\"', "
    f"CASE WHEN {_state(SLOT, 'c')} = '' THEN '' ELSE concat(', \"slot_type\": ', {_state(SLOT, 'c')}) END, "
    f"CASE WHEN {_state(START, 'p')} = '' THEN '' ELSE concat(', \"start_time\": ', {_state(START, 'p')}) END, "
    f"CASE WHEN {_state(WHOLE, 'q')} = '' THEN '' ELSE concat(', \"duration_minutes\": ', {_state(WHOLE, 'q')}) END, '}}')"
)
_STOPS = f"CASE id % 13 WHEN 0 THEN '' WHEN 1 THEN ', \"main_plan\": {{}}' WHEN 2 THEN ', \"main_plan\": [1]' ELSE concat(', \"main_plan\": [', {_STOP}, ']') END"
PLANNED = _answers({"plan_b": (PLAN_B, "(c + q)"), "estimated_cost": (SHARE, "(p + id)"), "tips": (TIPS, "(id + c)")}, more=_STOPS)
_ITEM = "main_plan[1]"
_BAD_STOP = (
    f"{_type('main_plan[0]')} <> 'OBJECT' OR {_type(_ITEM)} IS NOT NULL AND (coalesce({_type(_ITEM + '.slot_type')}, '') <> 'VARCHAR' OR "
    f"json_extract_string(answer, '$.{_ITEM}.slot_type') NOT IN ('activity', 'break', 'travel') OR coalesce({_type(_ITEM + '.start_time')}, '') <> 'VARCHAR' OR "
    f"{_type(_ITEM + '.duration_minutes')} IS NOT NULL AND NOT ({_integer(_ITEM + '.duration_minutes')} AND {_number(_ITEM + '.duration_minutes')} >= 0))"
)


@register("plan_answers", _query(PLANNED, [
    _missing("main_plan", "main_plan"), _not("main_plan", "main_plan", f"{_type('main_plan')} = 'ARRAY'"),
    f"CASE WHEN {_type('main_plan')} = 'ARRAY' AND ({_BAD_STOP}) THEN 'main_plan_items' END",
    _not("plan_b", "plan_b", f"{_type('plan_b')} = 'ARRAY'"), f"CASE WHEN {_type('plan_b')} = 'ARRAY' AND {_type('plan_b[0]')} <> 'OBJECT' THEN 'plan_b_items' END",
    _not("estimated_cost", "estimated_cost", f"{_type('estimated_cost')} IN {_NUMBERS}"), f"CASE WHEN {_type('estimated_cost')} IN {_NUMBERS} AND {_number('estimated_cost')} < 0 THEN 'estimated_cost_range' END",
    _not("tips", "tips", f"{_type('tips')} = 'ARRAY'"), f"CASE WHEN {_type('tips')} = 'ARRAY' AND {_type('tips[1]')} <> 'VARCHAR' THEN 'tips_items' END",
]))
def plan_answers(spark, d):
    return made(spark, d, PLANNED, "answers").select("id", F.array_join(A.problems(F.col("answer"), A.PLAN), ",").alias("problems"))
