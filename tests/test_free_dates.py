"""Free-form dates against a reader of such dates that is installed here."""

import itertools
import random
import warnings
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from eventloom.functions import freedates

NOW = datetime(2026, 3, 31, 10, 0)
reader = pytest.importorskip("dateutil.parser")


def plain(text):
    """(as written, as UTC) or nulls."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = reader.parse(text, default=NOW.replace(hour=0))
    except Exception:
        return None, None
    if got.tzinfo is not None:
        return got.replace(tzinfo=None), got.astimezone(UTC).replace(tzinfo=None)
    return got, got.replace(tzinfo=ZoneInfo("Europe/Berlin"), fold=1).astimezone(UTC).replace(tzinfo=None)


def texts():
    r = random.Random(4)
    days = ["14.02.2026", "5.3.2026", "2026-02-14", "2026/2/14", "2/14/2026", "14/2/26", "02-03-04", "14 Feb 2026", "Feb 14, 2026", "14. February 2026", "2026 Feb 14", "14-Feb-26", "Feb-14-2026", "99 Feb 14", "Feb 99 14", "14 Feb 99"]
    days += ["20260214", "260214", "Feb 2026", "2026-02", "02/2026", "14 Feb", "Feb 14", "Sat, 14 Feb 2026", "Saturday", "Wed", "14th of February 2026", "31.02.2026", "30.02.2026", "2026", "14", "February", "99-01", "01-13", "14.02.", "0.1.2026", "1.1.68", "1.1.80", "1.1.1900", "29.2.2024", "29.2.2023"]
    times = ["", " 19:30", "T19:30:15", " 19:30:15.25", " 7:05 pm", " 7 pm", " 12 am", " 12:30 am", " 13 pm", " 19h", " 19h30", " 19h 30m", " 24:00", " 23:60", " at 19:30", " 19", " 1930", "T193015", " 0:00"]
    zones = ["", "Z", " UTC", "+01:00", "-0500", " +02:00", " GMT", " GMT+3", " CET", "+1"]
    out = ["".join(x) for x in itertools.product(days, times)]
    out += ["".join(x) for x in itertools.product(days[:6], times[1:5], zones)]
    out += ["202602141930", "20260214193015", "20260214T1930", "19:30", "19:30 14-02-2026", "25.10.2026 02:30", "25.10.2026 03:00", "SEPT 5 2026 10:00", "MAY 5 2026"]
    out += ["morgen", "siehe Text", "14. Februar 2026", "5. März 2026, 19:30 Uhr", "", " ", "2026-13-01", "1 2 3 4", "Feb Mar 2026", "2026 2027 1", "10:00 - 12:00", "ab 14.02.2026", "14.02", "Mon Tue", "x" * 10000, "14,02,2026"]
    r.shuffle(out)
    return sorted(set(out))


def test_against_a_reader(spark):
    rows = texts()
    got = freedates.with_any_date(spark.createDataFrame(list(enumerate(rows)), "id int, t string"), "t", NOW.isoformat(" ")).collect()
    assert len(got) == len(rows)
    bad = [(rows[x.id][:40], (x.read, x.instant), plain(rows[x.id])) for x in got if (x.read, x.instant) != plain(rows[x.id])]
    assert not bad, (len(bad), len(rows), bad[:60])
    assert sum(x.read is not None for x in got) > len(rows) / 3


def test_edges(spark):
    """An hour that doesn't come, two times, nulls, the end of February from the day before March."""
    rows = ["29.03.2026 02:30", "10:00 12:00", None, "Feb 2026", "february 2024 7pm", "Sunday 14.02.2026"]
    got = freedates.with_any_date(spark.createDataFrame(list(enumerate(rows)), "id int, t string"), "t", NOW.isoformat(" ")).orderBy("id").collect()
    assert got[0].read == datetime(2026, 3, 29, 2, 30) and got[0].instant == datetime(2026, 3, 29, 1, 30)
    assert got[1].read is None and got[2].read is None and got[2].instant is None
    assert [x.read for x in got[3:]] == [datetime(2026, 2, 28), datetime(2024, 2, 29, 19), datetime(2026, 2, 14)]
    empty = spark.createDataFrame([], "t string, n int")
    assert freedates.with_any_date(empty, "t", NOW.isoformat(" ")).count() == 0
