"""Queries over the whole catalog: every folder, every source and the longest text."""

import base64

import pytest

from tests.conftest import DATA
from treelake.plans import contents, mutations, registry, scans, stores  # noqa: F401
from treelake.sources.catalog import Catalog

EVERY = ["s14_range_read_all", "s16_suffix_read_all", "f11_encodings_all", "f13_fnv", "d16_object_hash_all", "m02_append_all", "m04_truncate_all"]
FILLED = ["s15_stream_read_all", "m22_flush_extents_all", "m23_chunks_all", "m24_chunk_store_all"]
FOUND = ["d35_chunk_range_all", "g02_grep_lines_all", "g07_grep_invert_all"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["path"]: r["content"] for r in Catalog(spark, DATA).contents.select("path", "content").collect()}


@pytest.mark.parametrize("name", EVERY + FILLED + FOUND)
def test_sees_all_contents(name, spark, texts):
    paths = {r["path"] for r in registry.QUERIES[name](spark, DATA).select("path").collect()}
    if name in EVERY:
        assert paths == set(texts)
    elif name in FILLED:
        assert paths == {p for p, t in texts.items() if t}
    else:
        want = {
            "d": lambda t: len(t.encode()) > 512,
            "g02": lambda t: "tha" in t or "the" in t,
            "g07": lambda t: t and any("e" not in line for line in t.split("\n")),
        }[name[: 1 if name[0] == "d" else 3]]
        assert paths == {p for p, t in texts.items() if want(t)}
    assert len({p.rsplit("/", 2)[0] for p in paths if p.startswith("/docs/")}) > 1


def test_encodes_whole_contents(spark, texts):
    rows = registry.QUERIES["f11_encodings_all"](spark, DATA).collect()
    assert all(r["hexa"] == texts[r["path"]].encode().hex() for r in rows)
    assert all(r["b64"] == base64.b64encode(texts[r["path"]].encode()).decode() for r in rows)


def test_fnv_of_longest(spark, texts):
    longest = max((p for p in texts if p.startswith("/docs/")), key=lambda p: len(texts[p]))
    want = 0xCBF29CE484222325
    for b in texts[longest].encode():
        want = (want ^ b) * 0x100000001B3 % 2**64
    got = registry.QUERIES["f13_fnv"](spark, DATA).where(f"path = '{longest}'").first()["fnv"]
    assert (int(got, 16) if isinstance(got, str) else int(got) % 2**64) == want


def test_orders_have_all_rows(spark):
    c = Catalog(spark, DATA)
    paths = [r["path"] for r in registry.QUERIES["t02_find_order_all"](spark, DATA).collect()]
    assert len(paths) == c.files.count() > 100 and paths[0] == "/" and set(paths) == {r["path"] for r in c.files.select("path").collect()}
    events = [(-r["priority"], r["event_id"]) for r in registry.QUERIES["t10_event_priority_all"](spark, DATA).collect()]
    assert len(events) == c.watch_events.count() > 100 and events == sorted(events)
