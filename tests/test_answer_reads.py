"""A field of an answer is read once."""

from pyspark.sql import functions as F

from eventloom.functions import answers as A


def test_reads(spark):
    d = spark.createDataFrame([('{"age_min": 3}',)], "answer string")
    rule = A.Rule("object", required=("age_min",), fields={"age_min": A.Rule("integer null", 0, 99)})
    plan = d.select(A.problems(F.col("answer"), rule).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['age_min']") == 1


def test_nested_and_absent(spark):
    texts = ['{"categories": []}', '{"categories": ["a", 1], "flags": {"sensitive_content": 1}, "age_min": 100.5}', "[1]", '{"age_fit_buckets": {"0_2": 101}}', '{"categories": null, "flags": null}', None]
    found = [r["p"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, answer string").orderBy("k").select(A.problems(F.col("answer")).alias("p")).collect()]
    assert found == [
        [], ["categories_items", "age_min_type", "age_min_range", "flags_sensitive_content_type"], ["no_object", "categories_missing"],
        ["categories_missing", "age_fit_buckets_0_2_range"], ["categories_type", "flags_type"], ["no_object", "categories_missing"],
    ]
