"""Tiered objects, extents, branch rules, links, flags, locale order, and sequential rules on streams."""

import random

import pytest
from pyspark.sql import functions as F

from treelake.functions import extents
from treelake.operators import branching, changes, find, tiering
from treelake.operators.storage import TierConfig
from treelake.streaming import sequential

OBJECTS = "key string, tier string, size long, access_count long, last_access_at long"
FILES = "id long, path string, name string, parent string, depth int, type string, size long, mtime long"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def files(spark):
    entries = [("/", "directory"), ("/d", "directory"), ("/d/a.txt", "file"), ("/d/.h", "directory"), ("/d/.h/x", "file"), ("/d/e", "directory"), ("/d/e/f.json", "file"), ("/d/e/g", "directory"), ("/d/e/g/deep", "file")]
    return spark.createDataFrame([(k, p, p.rsplit("/", 1)[-1] or "/", None if p == "/" else p.rsplit("/", 1)[0] or "/", 0 if p == "/" else p.count("/"), t, 10 if t == "file" else 0, 0) for k, (p, t) in enumerate(entries)], FILES)


def test_tiers(spark):
    held = spark.createDataFrame([("a", "cold", 5, 9, 0), ("a", "warm", 6, 0, 90), ("b", "hot", 1, 0, 0), ("c", "cold", 7, 6, 0), ("c", "cold", 7, 6, 0)], OBJECTS)
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("x",), (None,)], "key string")
    config = TierConfig(hot_age_ms=50, warm_age_ms=200)
    out = tiering.read(held, asked, 100, config)
    assert rows(out, "key") == [(None, 1, None, None, False, "ENOENT"), ("a", 2, "hot", "warm", True, None), ("b", 1, "hot", None, False, None), ("c", 1, "warm", "cold", True, None), ("x", 1, None, None, False, "ENOENT")]
    # The promoted copy leaves its tier; a colder copy of the same key stays.
    assert rows(tiering.after_reads(held, out, 100), "key", "tier") == [("a", "cold", 5, 9, 0), ("a", "hot", 6, 2, 100), ("b", "hot", 1, 1, 100), ("c", "warm", 7, 7, 100)]
    wanted = spark.createDataFrame([("a", "cold"), ("b", "hot"), ("c", "warm"), ("x", "cold"), ("b", None)], "key string, target string")
    assert rows(tiering.demote(held, wanted), "key", "error") == [("a", "cold", "warm", True, None), ("b", "hot", None, False, "EINVAL"), ("b", "hot", None, False, "EINVAL"), ("c", "cold", None, False, None), ("x", None, None, False, "ENOENT")]
    # A demoted copy replaces the one that was there.
    assert rows(tiering.settle(held, tiering.demote(held, wanted.where("key = 'a'"))).where("key = 'a'"), "key") == [("a", "cold", 6, 0, 90)]
    assert rows(tiering.promote(held, wanted), "key", "error") == [("a", "warm", None, False, "EINVAL"), ("b", "hot", None, False, None), ("b", "hot", None, False, "EINVAL"), ("c", "warm", "cold", True, None), ("x", None, None, False, "EINVAL")]
    pair = spark.createDataFrame([("a", "b")], "source string, dest string")
    assert rows(tiering.move(held, pair, 7).where("key < 'c'"), "key", "tier") == [("a", "cold", 5, 9, 0), ("b", "hot", 1, 0, 0), ("b", "warm", 6, 0, 7)]
    nothing = held.where("false")
    assert tiering.read(nothing, asked, 1, config).where("error = 'ENOENT'").count() == 5 and tiering.delete(nothing, asked).count() == 0


def test_extents_round_trip(spark):
    rnd = random.Random(1)
    cases = [[], [0], [7], [8], [0, 1, 9, 17], list(range(40))]
    pages = [{s: rnd.randbytes(16) for s in c} for c in cases]
    df = spark.createDataFrame([(k, [(s, d) for s, d in random.Random(k).sample(sorted(p.items()), len(p))]) for k, p in enumerate(pages)], "k int, pages array<struct<slot:int,data:binary>>")
    built = df.select("k", extents.build(F.col("pages"), 16).alias("data"))
    data = {r["k"]: bytes(r["data"]) for r in built.collect()}
    stored = spark.createDataFrame([(k, bytearray(x)) for k, x in data.items()], "k int, data binary")
    x = F.col("data")
    got = stored.select("k", extents.present(x).alias("slots"), *(extents.page(x, F.lit(s)).alias(f"p{s}") for s in (0, 8, 17, 99)), extents.header(x).alias("h")).collect()
    for r in got:
        p = pages[r["k"]]
        assert r["slots"] == sorted(p) and r["h"]["page_count"] == (max(p) + 1 if p else 0) and r["h"]["extent_size"] == 16 * len(p)
        assert all((None if r[f"p{s}"] is None else bytes(r[f"p{s}"])) == p.get(s) for s in (0, 8, 17, 99))
    bad = [(100 + k, None if x is None else bytearray(x)) for k, x in enumerate([None, b"", data[3][:-1], b"\1" + data[3][1:], data[3][:4] + b"\2" + data[3][5:], data[3][:-1] + bytes([data[3][-1] ^ 1])])]
    all_rows = stored.unionByName(spark.createDataFrame(bad, "k int, data binary"))
    assert {r["k"]: r["valid"] for r in extents.validate(all_rows).collect()} == {k: True for k in data} | {k: False for k, _ in bad}
    assert spark.createDataFrame(bad[:2], "k int, data binary").where(extents.header(x).isNotNull()).count() == 0


def test_branch_rules(spark):
    branches = spark.createDataFrame([("main", None), ("dev", "main"), ("old", "main")], "name string, parent string")
    held = spark.createDataFrame([("main", "f", 1, False, 10), ("dev", "f", 0, True, 11), ("dev", "g", 2, False, 12)], "branch string, file_id string, size long, deleted boolean, commit long")
    assert branching.switch(branches, "dev") == "dev" == branching.checkout(branches, held, 12)
    assert branching.checkout(branches, held, "main") == "main"
    for call in (lambda: branching.switch(branches, "no"), lambda: branching.checkout(branches, held, 99), lambda: branching.drop(branches, held, "main", "dev"), lambda: branching.drop(branches, held, "dev", "dev")):
        with pytest.raises(ValueError):
            call()
    left, kept = branching.drop(branches, held, "dev", "main")
    assert rows(left.select("name"), "name") == [("main",), ("old",)] and rows(kept.select("branch"), "branch") == [("main",)]
    edits = spark.createDataFrame([("old", "f", 5, False), ("dev", "f", 6, False), ("dev", "g", 7, True), ("dev", "h", 8, True), ("dev", "i", 9, False)], "branch string, file_id string, size long, deleted boolean")
    dirty = branching.write(held, branches, edits)
    assert rows(dirty, "branch", "file_id") == [("dev", "f", 6, False, True, False, None), ("dev", "g", 0, True, True, False, 12), ("dev", "i", 9, False, False, False, None), ("old", "f", 5, False, False, True, 10)]
    assert rows(branching.commit(dirty), "branch") == [("dev", 3, 15, 1), ("old", 1, 5, 0)]
    assert branching.discard(dirty, edits.where("branch = 'dev'")).count() == 1 and branching.discard(dirty).count() == 0


def test_links_flags_and_fetch(spark, files):
    asked = spark.createDataFrame([(1, "/d/n", "wx", 3), (2, "/d/n", "ax", 4), (3, "/d/a.txt", "a", 5), (4, "/", "w", 1), (5, "/d/a.txt/x", "w", 1), (6, None, "w", 1), (7, "/d/m", None, 1)], "seq int, path string, flag string, size long")
    assert [(r["seq"], r["status"], r["size"]) for r in changes.write_status(files, asked).orderBy("seq").collect()] == [(1, "ok", 3), (2, "EEXIST", None), (3, "ok", 15), (4, "EISDIR", None), (5, "ENOENT", None), (6, "ENOENT", None), (7, "EINVAL", None)]
    links = spark.createDataFrame([(1, "/d/a.txt", "/d/l"), (2, "/d/a.txt", "/d/l2"), (3, "/d", "/d/l3"), (4, "/no", "/d/l4"), (5, "/d/a.txt", "/d/l")], "seq int, existing string, path string")
    assert [(r["status"], r["nlink"]) for r in changes.hard_links(files, links).orderBy("seq").collect()] == [("ok", 3), ("ok", 3), ("EPERM", None), ("ENOENT", None), ("EEXIST", None)]
    contents = spark.createDataFrame([("/d/a.txt", "A"), ("/d/e/f.json", "{}")], "path string, content string")
    got = find.fetch(files, contents, spark.createDataFrame([("/d",), ("/d/e/f.json",), ("/x",), (None,)], "path string"))
    assert sorted((r["resource"] or "", r["path"] or "", r["level"], r["content_type"], r["content"], r["error"]) for r in got.where("level IS NOT NULL").collect()) == [
        ("/d", "/d", 0, None, None, None), ("/d", "/d/a.txt", 1, None, None, None), ("/d", "/d/e", 1, None, None, None), ("/d", "/d/e/f.json", 2, None, None, None), ("/d", "/d/e/g", 2, None, None, None),
        ("/d/e/f.json", "/d/e/f.json", 0, "application/json", "{}", None),
    ]
    assert got.where("error = 'ENOENT'").count() == 2


def test_pages_of_a_listing(spark):
    keys = spark.createDataFrame([(f"k{n:02}",) for n in range(7)], "key string")
    seen, after, more = [], None, True
    while more:
        page, after, more = find.list_page(keys, "key", "k", 3, after)
        seen += [r["key"] for r in page.collect()]
    assert seen == [f"k{n:02}" for n in range(7)] and after is None


def test_locale_order(spark):
    names = ["b", "B", "a", ".y", "A", "_x", "1"]
    df = spark.createDataFrame([(f"/{n}", n, "/", "file", 0, 0, 1) for n in names], "path string, name string, parent string, type string, size long, mtime long, depth int")
    want = ["_x", ".y", "1", "a", "A", "b", "B"]
    assert [r["name"] for r in find.readdir(df, "/").collect()] == want
    assert [r["path"] for r in find.find(df, find.Find()).collect()] == ["/" + n for n in want]
    assert [r["name"] for r in find.list_directory(df, "/", hidden=True).collect()] == want
    assert [r["name"] for r in find.tree(df, "/", hidden=True).collect()] == want


@pytest.mark.parametrize(("rule", "key", "value"), [(sequential.capped_burst(60, 200), "path", None), (sequential.count_or_time(100, 2), "user_id", "path"), (sequential.sliding_limit(4, 200, 2, 30), "user_id", None)])
def test_streams_equal_batches(spark, tmp_path, rule, key, value):
    rnd = random.Random(3)
    events = [(k, k % 3, f"/p{rnd.randrange(4)}", 1_700_000_000_000 + k * 7 + rnd.randrange(7)) for k in range(150)]
    df = spark.createDataFrame(events, "event_id long, user_id long, path string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    for k in range(3):  # a micro-batch each
        df.where(F.col("event_id").between(k * 50, k * 50 + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sequential.apply_stream(stream, rule, key, value).writeStream.format("memory").queryName(f"s_{rule.added}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: r[rule.added] for r in spark.table(f"s_{rule.added}").collect()}
    want = {r["event_id"]: r[rule.added] for r in sequential.apply(df, rule, key, value).collect()}
    assert got == want and len(want) == 150 and len(set(want.values())) > 1
