"""The query catalogue, by theme."""

from eventloom.plans import aggregates, answers, canonical, dates, editing, fields, merges, merging, more, normals, planning, replays, scoring, searching, sourcing, streams, texts  # noqa: F401
