"""The contract's rules, on URLs that only the longest fitting rule decides."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from eventloom.llm import queries

#: (url, rule, verdict)
URLS = [
    ("http://casino.net/de/8", "net/de/", "allow"), ("http://b.Example.NET/de/8\r\nx", "example.net/de/8", "block"), ("http://example.net/de/80?x", "example.net/de/8", "block"),
    ("http://example.net/de/7", "net/de/", "allow"), ("http://myexample.net/de/8", "net/de/", "allow"), ("http://poker.com/en/", "com/en/", "block"),
    ("http://a.example.com/en/7#x", "example.com/en/7", "allow"), ("http://example.com/en/6", "com/en/", "block"), ("http://org/es/1", "org/es/", "block"),
]


def test_rules_of_the_contract(spark, tmp_path):
    pq.write_table(pa.table({"page_id": pa.array(range(len(URLS)), pa.int64()), "url": [u for u, _, _ in URLS], "html": [""] * len(URLS)}), tmp_path / "pages.parquet")
    found = queries.queries()["op3_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [(rule, verdict) for _, rule, verdict in URLS]
