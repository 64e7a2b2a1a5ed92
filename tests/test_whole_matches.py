"""Every event is matched with all earlier ones; trees and cycles of any depth are walked to their end."""

import difflib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.functions.fingerprint import dedup_title
from eventloom.operators import hierarchy
from eventloom.plans.views import view


def test_fuzzy_match_takes_all_events(spark, sf_dir, tmp_path):
    orders = pq.read_table(f"{sf_dir}/orders.parquet").slice(0, 40)
    keys = [*range(1, 21), *range(501, 521)]  # titles repeat after 500
    for name, values in (("o_orderkey", keys), ("o_orderdate", [orders.column("o_orderdate")[0].as_py()] * 40), ("o_orderpriority", ["5-LOW"] * 40)):
        at = orders.column_names.index(name)
        orders = orders.set_column(at, name, pa.array(values, orders.schema.field(at).type))
    pq.write_table(orders, tmp_path / "orders.parquet")
    rows = view(spark, str(tmp_path), "catalog").select("id", dedup_title(F.col("title")).alias("t")).collect()
    want = {}
    for r in rows:
        for o in sorted(rows, key=lambda o: o["id"]):
            x, y = set(r["t"].split(" ")), set(o["t"].split(" "))
            if o["id"] < r["id"] and 0.6 * difflib.SequenceMatcher(None, r["t"], o["t"]).ratio() + 0.4 * len(x & y) / len(x | y) > 0.85:
                want[r["id"]] = o["id"]
                break
    found = {r["id"]: r["matched"] for r in catalog.queries()["fuzzy_match"](spark, str(tmp_path)).collect()}
    assert found == want and any(i % 3 for i in want)


def test_deep_trees_and_long_cycles(spark):
    n = 23
    ring = spark.createDataFrame([(str(k), str((k + 1) % n)) for k in range(n)] + [("tail", "0")], "id string, parent_id string")
    assert {r["id"] for r in hierarchy.on_cycle(ring).collect()} == {str(k) for k in range(n)}
    with pytest.raises(ValueError):
        hierarchy.ancestors(ring, most=5)
