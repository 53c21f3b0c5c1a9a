import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelake.functions import paths, scalars
from treelake.operators import changes, find, grep, sparse
from treelake.streaming import watch


def test_paths():
    assert paths.normalize("/a//b/../c/./") == "/a/c"
    assert paths.normalize("../a") == "../a"
    assert paths.normalize("") == "."
    assert paths.join("/a", "../b") == "/b"
    assert paths.resolve("a", "/b", "c") == "/b/c"
    assert paths.relative("/a/b", "/a/c/d") == "../c/d"
    assert paths.is_within("/a/b", "/a") and not paths.is_within("/ab", "/a")
    assert paths.has_traversal("a/../b")


@pytest.mark.parametrize(("path", "code"), [("", "EMPTY"), (" ", "EMPTY"), ("a\0", "NULL_BYTE"), ("a%00", "NULL_BYTE"), ("..", "DOT_NAME"), (" a", "EDGE_SPACE"), ("a\x07b", "CONTROL"), ("a/../../b", "TRAVERSAL"), ("a/b", None)])
def test_validate(path, code):
    assert paths.validate(path) == code


def test_column_paths(spark):
    df = spark.createDataFrame([("/",), ("/a",), ("/a/b.tar.gz",), ("/a/.x",)], "p string")
    p = F.col("p")
    got = df.select(paths.dirname(p), paths.extname(p), paths.depth(p), paths.ancestors(p)).collect()
    assert [tuple(r) for r in got] == [("/", "", 0, []), ("/", "", 1, ["/"]), ("/a", ".gz", 2, ["/", "/a"]), ("/a", "", 2, ["/", "/a"])]


def test_sizes_and_ages():
    assert scalars.parse_size("+10K") == (">", 10240)
    assert scalars.parse_size("5") == ("=", 5)
    assert scalars.parse_age("-7d") == ("newer", 7 * scalars.DAY)
    assert scalars.parse_age("2M") == ("about", 60 * scalars.DAY)
    for bad in ("7H", "x", ""):
        with pytest.raises(ValueError, match="bad"):
            scalars.parse_age(bad)


def test_modes(spark):
    df = spark.createDataFrame([(0o644, "file"), (0o700, "directory")], "m int, t string")
    m, t = F.col("m"), F.col("t")
    got = df.select(scalars.chmod("u=rwx,go-r", m, t), scalars.chmod("a+X", m, t), scalars.chmod("755", m, t), scalars.chmod("u+s,o+t", m, t), scalars.mode_text(m)).collect()
    assert [tuple(r) for r in got] == [(0o700, 0o644, 0o755, 0o5644, "rw-r--r--"), (0o700, 0o711, 0o755, 0o5700, "rwx------")]
    with pytest.raises(ValueError, match="bad"):
        scalars.chmod("z+r", m, t)


def test_bytes(spark):
    df = spark.createDataFrame([(b"",), (b"a",), (b"foobar",), (None,)], "c binary")
    got = [r[0] for r in df.select(scalars.fnv1a64("c")).collect()]
    assert got == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8", None]
    back = df.select("c", scalars.inflate(scalars.deflate("c")).alias("d")).collect()
    assert all(r["c"] == r["d"] for r in back)
    assert [r[0] for r in spark.createDataFrame([("12",), ("ab",)], "s string").select(scalars.inode(F.col("s"))).collect()] == [12, 97 * 31 + 98]


def test_grep_columns(spark):
    df = spark.createDataFrame([("/a", "x ab ab\nnone\nab"), ("/b", "")], "path string, content string")
    got = [(r["line"], r["column"], r["match"]) for r in grep.grep(df, grep.Grep("ab", literal=True)).orderBy("line", "column").collect()]
    assert got == [(1, 3, "ab"), (1, 6, "ab"), (3, 1, "ab")]
    r = grep.grep(df, grep.Grep("none", before=1, after=5)).first()
    assert (r["before"], r["after"]) == (["x ab ab"], ["ab"])
    word = grep.grep(df, grep.Grep("a|b", word=True))
    assert word.count() == 0


def test_links(spark):
    chain = [(f"/l{k}", f"/l{k + 1}") for k in range(45)] + [("/x", "/x"), ("/y", "/end")]
    got = {r["path"]: r for r in find.resolve_links(spark.createDataFrame(chain, "path string, target string")).collect()}
    assert got["/y"]["target"] == "/end" and got["/x"]["error"] == "ELOOP"
    assert got["/l5"]["target"] == "/l45" and got["/l5"]["hops"] == 40
    assert got["/l4"]["error"] == "ELOOP"


def test_errors(spark):
    files = spark.createDataFrame([("/", "directory"), ("/a", "directory"), ("/a/b", "file")], "path string, type string").withColumn("parent", paths.dirname(F.col("path")))
    for call, code in ((lambda: changes.remove(files, "/z"), "ENOENT"), (lambda: changes.remove(files, "/a"), "ENOTEMPTY"), (lambda: changes.rename(files, "/a", "/a/c"), "EINVAL")):
        with pytest.raises(changes.FsError) as e:
            call()
        assert e.value.code == code
    assert changes.remove(files, "/z", force=True).count() == 3


def test_cone_refuses_globs():
    with pytest.raises(ValueError, match="cone"):
        sparse.cone(["a/*"], F.lit("x"))


def test_cursor():
    assert find.decode_cursor(find.encode_cursor(30)) == 30
    assert find.decode_cursor("junk") == 0 and find.decode_cursor(None) == 0


def test_rate_limit_is_sequential(spark):
    rows = [(k, k % 2, 1_700_000_000_000 + k * 10) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["event_id"]: r["allowed"] for r in watch.rate_limit(df, most=5, per_ms=200, burst=2, burst_ms=50).collect()}
    want, kept = {}, {0: [], 1: []}
    for k, u, t in rows:
        kept[u] = [x for x in kept[u] if x > t - 200]
        want[k] = len(kept[u]) < 5 and sum(x > t - 50 for x in kept[u]) < 2
        if want[k]:
            kept[u].append(t)
    assert got == want


def test_fold(spark):
    df = spark.createDataFrame([(["create", "modify"],), (["create", "delete"],), (["delete", "create", "modify"],), (["modify", "rename", "modify"],)], "t array<string>")
    assert [r[0] for r in df.select(watch.fold(F.col("t"))).collect()] == ["create", "delete", "create", "rename"]


def test_snapshots(spark, tmp_path):
    from treelake.sources import snapshots

    for n in (3, 5):
        snapshots.commit(spark.range(n), str(tmp_path / "t"))
        assert snapshots.read(spark, str(tmp_path / "t")).count() == n


def test_stored_catalog_prunes(spark, tmp_path):
    from treelake.sources import snapshots
    from treelake.sources.catalog import Catalog

    from tests.conftest import DATA

    c, folder = Catalog(spark, DATA), str(tmp_path)
    snapshots.store(c.files, c.contents, folder)
    files = snapshots.read(spark, f"{folder}/files")
    assert files.count() == c.files.count()
    for df, pushed in (
        (find.by_path(files, "/web/3.html"), "EqualTo(path,/web/3.html)"),
        (find.readdir(files, "/docs/src2", recursive=True), "StringStartsWith(path,/docs/src2/)"),
        (find.glob(files, ["web/*.html"]), "StringStartsWith(path,/web/)"),
        (find.find(files, find.Find("/chat")), "StringStartsWith(path,/chat/)"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan and "content" not in plan, plan
    assert sorted(find.glob(files, ["web/*.html"]).collect()) == sorted(find.glob(c.files, ["web/*.html"]).collect())


def test_eviction_takes_the_oldest(spark):
    from treelake.operators import storage

    rows = [(f"p{k:03}", "warm" if k % 4 else "hot", (k * 37) % 50) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_key string, tier string, last_access_at long").repartition(7)
    warm = sorted((at, key) for key, tier, at in rows if tier == "warm")
    for most, go in ((300, 300 - 210), (100, 300 - 70), (320, 300 - 224), (400, 0)):
        assert {r["page_key"] for r in storage.evict(pages, most).collect()} == {key for _, key in warm[:go]}
    assert storage.evict(pages.where("false"), 10).count() == 0


def test_batches_equal_the_fold(spark):
    kinds = ["create", "delete", "modify", "rename", None]
    rows = [(k // 2, kinds[(k * k * 7 + k // 3) % 5], f"/p{k % 7}", 1_700_000_000_000 + (k // 4) * 90_000) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, type string, path string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "type"))), lambda x: x["type"])
    want = df.groupBy(F.window("ts", "10 minutes")["start"].alias("w"), "path").agg(watch.fold(types).alias("t"), F.count("*").alias("n"))
    got = watch.batch(df, "10 minutes").select("window", "path", "type", "events")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_stream_batches(spark, tmp_path):
    rows = [(k, "create" if k % 3 == 0 else "modify", f"/p{k % 2}", 1_700_000_000_000 + k * 60_000) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id long, type string, path string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    df.write.parquet(str(tmp_path / "in"))
    stream = watch.stream_batches(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "10 minutes")
    q = stream.writeStream.format("memory").queryName("batches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("batches").collect()) == sorted(watch.batch(df, "10 minutes").collect())


def test_sequential_batches(spark):
    import random

    from treelake.streaming import sequential

    rnd = random.Random(0)
    rows = [(k, k % 3, f"/p{rnd.randrange(4)}", 1_700_000_000_000 + k * rnd.choice([5, 10, 40])) for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, path string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r["event_id"]: r["batch"] for r in sequential.count_or_time_batches(df, 100, 2).collect()}
    burst = {r["event_id"]: r["burst"] for r in sequential.capped_bursts(df, 60, 200).collect()}
    for key, result, close in ((1, got, lambda t, o, last, held: t - o >= 100 or len(held) >= 2), (2, burst, lambda t, o, last, held: t - last >= 60 or t - o >= 200)):
        for value in {r[key] for r in rows}:
            opened, last, held, n = None, None, set(), -1
            for r in sorted((r for r in rows if r[key] == value), key=lambda r: (r[3], r[0])):
                if opened is None or close(r[3], opened, last, held):
                    opened, held, n = r[3], set(), n + 1
                held.add(r[2])
                last = r[3]
                assert result[r[0]] == n


def test_existence_filter(spark):
    from treelake.operators import storage

    held = storage.existence_filter(spark.range(2000).selectExpr("concat('k', id) AS k"), "k", 2000)
    asked = spark.range(6000).selectExpr("concat('k', id) AS k", "id")
    rows = {r["id"]: r["may_exist"] for r in storage.may_exist(asked, "k", held).collect()}
    assert all(rows[k] for k in range(2000))
    assert sum(rows[k] for k in range(2000, 6000)) < 4000 * 0.03


def test_existence_filter_sends_each_key_once(spark):
    """Neither positions nor partial bitmaps travel, so that what is shuffled grows as the keys do, whatever the filter's size."""
    from treelake.operators import storage

    def sent(n):
        held = storage.existence_filter(spark.range(0, n, 1, 16).selectExpr("concat('k', id) AS k"), "k", n)
        asked = spark.range(0, 3 * n, 1, 16).selectExpr("concat('k', id) AS k", "id")
        row = storage.may_exist(asked, "k", held).selectExpr(f"count_if(id < {n} AND NOT may_exist)", f"count_if(id >= {n} AND may_exist)", "count(*)").first()
        assert row[0] == 0 and row[1] < 2 * n * 0.013 and row[2] == 3 * n
        return shuffled(spark)

    shuffled(spark)
    records, size = sent(20_000)
    more, larger = sent(200_000)
    assert records <= 4.1 * 20_000 and more <= 4.1 * 200_000 and larger < 11 * size


_COUNTED = set()


def shuffled(spark):
    """(records, bytes) written to shuffles since the last call."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    new = [s for s in map(stages.apply, range(stages.size())) if s.stageId() not in _COUNTED]
    _COUNTED.update(s.stageId() for s in new)
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def test_existence_filter_edges(spark):
    """Null keys are neither held nor found, asked copies stay, names with dots and columns of any type pass; nothing held gives nothing."""
    from treelake.operators import storage

    keys = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "k string")
    asked = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("", 3), ("zz", 4)], "k string, `x.y` int")
    for rate in (0.5, 0.01, 1e-9):
        got = storage.may_exist(asked, "k", storage.existence_filter(keys, "k", 3, rate))
        assert got.columns == ["k", "x.y", "may_exist"]
        assert sorted(tuple(r) for r in got.where("k <> 'zz' OR k IS NULL").collect() if r[0] is not None) == [("", 3, True), ("a", 1, True), ("a", 1, True)]
        assert [r["may_exist"] for r in got.where("k IS NULL").collect()] == [None]
    none = storage.may_exist(asked, "k", storage.existence_filter(keys.where("false"), "k", 0))
    assert sorted((r["x.y"], r["may_exist"]) for r in none.collect()) == [(1, False), (1, False), (2, None), (3, False), (4, False)]


PARTS = st.lists(st.sampled_from(["a", "..", ".", "", " ", "b c", "%00", "\\0", "\t", "é", "　", "x" * 50]), max_size=8)


def test_problem_equals_validate(spark):
    from treelake.functions import paths

    seen = set()

    @settings(max_examples=400, deadline=None, database=None, derandomize=True)
    @given(PARTS, st.booleans())
    def collect(parts, rooted):
        seen.add("/" * rooted + "/".join(parts))

    collect()
    rows = spark.createDataFrame([(p,) for p in sorted(seen)], "p string").select("p", paths.problem(F.col("p")).alias("x")).collect()
    assert len(rows) > 100 and {r["p"]: r["x"] for r in rows} == {p: paths.validate(p) for p in seen}


def test_fixed_settings_of_tiers():
    from treelake.operators.storage import PRESETS

    day = 86_400_000
    got = {k: (c.hot_max, c.warm_max, c.policy, c.promote_accesses, c.promote_age_ms // day, c.hot_age_ms // day, c.warm_age_ms // day) for k, c in PRESETS.items()}
    assert got == {"aggressive": (5 << 20, 200 << 20, "aggressive", 1, 30, 7, 90), "balanced": (1 << 20, 100 << 20, "on-access", 1, 7, 1, 30), "conservative": (256 << 10, 50 << 20, "none", 10, 1, 1, 7)}


def test_branch_changes_are_checked(spark):
    from treelake.operators import branching

    rows = spark.createDataFrame([("main", None, 1, False), ("dev", "main", 2, True)], "name string, parent string, updated_at long, is_archived boolean")
    for wrong in (lambda: branching.create(rows, "dev", "main", 3), lambda: branching.create(rows, "x", "none", 3), lambda: branching.rename(rows, "none", "x", 3), lambda: branching.rename(rows, "dev", "main", 3), lambda: branching.archive(rows, "none", 3), lambda: branching.delete(rows, "main")):
        with pytest.raises(ValueError):
            wrong()
    assert [r["name"] for r in branching.listing(rows).collect()] == ["main"]
    assert [r["name"] for r in branching.listing(rows, archived=True).collect()] == ["dev", "main"]


def test_grep_columns_context_and_limits(spark):
    Grep, search = grep.Grep, grep.grep

    text = "\n".join(["ab ab", "", "xéab", "ab" * 50, "end"])
    df = spark.createDataFrame([("/a", text), ("/b", ""), ("/c", None)], "path string, content string")
    got = [(r["line"], r["column"], r["match"], r["before"], r["after"]) for r in search(df, Grep("ab", literal=True, before=1, after=1)).collect()]
    want = [(n, m.start() + 1, "ab", lines[max(0, n - 2) : n - 1], lines[n : n + 1]) for lines in [text.split("\n")] for n, line in enumerate(lines, 1) for m in re.finditer("ab", line)]
    assert got == want
    assert [r["column"] for r in search(df, Grep("ab", max_count=3)).collect()] == [1, 4, 3]
    assert "Exchange" not in search(df, Grep("ab", max_count=3))._jdf.queryExecution().executedPlan().toString()
    assert [(r["line"], r["match"]) for r in search(df, Grep("ab", invert=True)).collect()] == [(2, ""), (5, "")]
