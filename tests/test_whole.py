"""Queries that give all rows, beside those that give a part."""

from tessella.plans import QUERIES
from tessella.sources.views import Views


def test_whole_walk_and_queue(spark, small):
    v = Views(spark, small)
    walked = {r.path: r["rank"] for r in QUERIES["walk_paths"](spark, small).collect()}
    paths = sorted((r.path for r in v.files().select("path").collect()), key=lambda p: [x.encode() for x in p.split("/")])
    assert len(paths) > 50 and walked == {p: n for n, p in enumerate(paths, 1)}
    queue = sorted(QUERIES["stream_order"](spark, small).collect(), key=lambda r: r["rank"])
    assert len(queue) == v.pending().count() > 25 and [r["rank"] for r in queue] == list(range(1, len(queue) + 1))
    assert [(r.id, r.priority) for r in queue[:25]] == [(r.id, r.priority) for r in QUERIES["stream_queue"](spark, small).collect()]


def test_all_peers_and_manifests(spark, small):
    v = Views(spark, small)
    present = {r.session_id for r in QUERIES["peer_ttl"](spark, small).collect()}
    every = {r.session_id for r in v.sessions().collect()}
    assert {s % 2 for s in present} == {0, 1} and present < every
    assert sorted(r.path for r in QUERIES["manifest_entries"](spark, small).collect()) == sorted(r.path for r in v.files().collect())
