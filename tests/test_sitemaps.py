"""Nested sitemaps against a plain walk, and addresses of all spellings against the standard library."""

import ipaddress
import random
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from eventloom.sources import feeds


def plain_walk(start, documents, most):
    """Pages in order of discovery, the maps opened first in, first out."""
    seen, queue, pages = {start}, [start], []
    while queue and len(pages) < most:
        for loc in documents.get(queue.pop(0), []):
            if loc in seen:
                continue
            if loc.endswith(".xml") and "sitemap" in loc.lower():
                seen.add(loc)
                queue.append(loc)
            elif re.search(feeds.EVENT_PATHS, urlparse(loc).path.lower()):
                seen.add(loc)
                pages.append(loc)
    return pages[:most]


def test_walk(spark):
    r = random.Random(2)
    docs = {}
    for site in "abc":
        name = lambda k: f"https://{site}/sitemap{k}.xml"  # noqa: B023, E731
        for k in range(25):
            docs[name(k)] = [r.choice([name(r.randrange(30)), name(k), name(0), f"https://{site}/event/{r.randrange(60)}?a=1&b", f"https://{site}/other/{r.randrange(9)}", f"https://{site}/feed.xml"]) for _ in range(r.randrange(12))]
        for k in range(6):
            docs[name(k)] = [*docs[name(k)], name(k + 1), name(max(k - 1, 0)), f"https://{site}/Termine/{k}"]  # nested six deep, with loops
    rows = [(a, "<x:urlset xmlns:x='s'>" + "".join(f"<x:loc> {u.replace('&', '&amp;')}\n</x:loc>" if r.random() < 0.5 else f"<x:loc><![CDATA[{u}]]></x:loc>" for u in us) + "</x:urlset>") for a, us in docs.items()]
    documents = spark.createDataFrame([*rows, rows[0], (None, "<loc>x</loc>"), ("https://n/sitemap.xml", None)], "address string, body string")
    starts = spark.createDataFrame([(s, f"https://{s}/sitemap0.xml") for s in "abc"] + [("n", "https://n/sitemap.xml"), ("z", None), ("y", "https://y/none.xml")], "site string, address string")
    for most in (200, 7):
        got = sorted(feeds.walk_sitemaps(starts, documents, most).collect())
        want = sorted((s, k + 1, u) for s in "abc" for k, u in enumerate(plain_walk(f"https://{s}/sitemap0.xml", docs, most)))
        assert [tuple(g) for g in got] == want and len(want) > 15
    assert feeds.walk_sitemaps(starts.where("false"), documents).count() == 0


BLOCKED = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")]


def test_addresses(spark):
    r = random.Random(4)
    texts = ["::1", "0:0:0:0:0:0:0:1", "::0001", "::", "1::", "::ffff:10.0.0.1", "::ffff:0a00:1", "::ffff:8.8.8.8", "::10.0.0.1", "fe80::", "fec0::1", "fc00::1", "fdff:1::2", "fb00::1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::1", "12345::", ":::1", "::1.2.3.256", ":1", "1:2:3:4:5:6:7::"]
    for _ in range(2000):
        bits = r.choice([r.getrandbits(128), r.getrandbits(16), r.getrandbits(128) & r.getrandbits(128) & r.getrandbits(128), 0xFFFF << 32 | r.getrandbits(32), 0xFE80 << 112 | r.getrandbits(20), 0xFD << 120])
        groups = [f"{bits:032x}"[k : k + 4] for k in range(0, 32, 4)]
        texts.append(r.choice([ipaddress.IPv6Address(bits).compressed, ":".join(groups), ":".join(groups).upper(), ":".join(g.lstrip("0") or "0" for g in groups)]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", feeds.ipv6_digits(F.col("t")), feeds.unsafe_url(F.concat(F.lit("http://["), "t", F.lit("]:80/")))).collect()
    for t, digits, reason in got:
        try:
            a = ipaddress.IPv6Address(t)
        except ValueError:
            assert digits is None, t
            continue
        assert digits == f"{int(a):032x}", t
        inside = a.ipv4_mapped or (ipaddress.IPv4Address(int(a)) if 1 << 16 <= int(a) < 1 << 32 else a)
        assert reason == ("address" if any(inside in n for n in BLOCKED if n.version == inside.version) else None), t
