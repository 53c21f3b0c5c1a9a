"""Operators without SQL, held against plain Python."""

import zlib

from pyspark.sql import functions as F

from tests.conftest import DATA
from treelake.functions import scalars
from treelake.operators import find, storage
from treelake.sources import snapshots
from treelake.sources.catalog import Catalog
from treelake.streaming import watch


def test_compression_stats(spark):
    contents = Catalog(spark, DATA).contents
    texts = [r["content"].encode() for r in contents.collect() if r["content"] is not None]
    small = [len(t) if len(t) < 1024 else min(len(t), len(zlib.compress(t))) for t in texts]
    got = storage.compression_stats(contents).first()
    assert (got["original"], got["compressed"]) == (sum(map(len, texts)), sum(small))
    assert got["compressed"] < got["original"] and got["ratio"] == sum(small) / sum(map(len, texts))


def test_iterate_and_draw(spark):
    rows = [("/", "/", "directory", 0, 0), ("/a", "a", "file", 1, 5), ("/b", "b", "directory", 1, 0), ("/b/c", "c", "file", 2, 7)]
    files = spark.createDataFrame(rows, "path string, name string, type string, level int, size long")
    assert [r["path"] for r in find.iterate(files.orderBy("path"))] == ["/", "/a", "/b", "/b/c"]
    drawn = find.render_tree(find.tree(files).collect(), sizes=True)
    assert drawn.split("\n") == ["/", "├── b/", "│   └── c (7B)", "└── a (5B)"]


def test_object_paths_round_trip(spark):
    df = spark.createDataFrame([("0123abcd",)], "h string")
    assert df.select(scalars.hash_of_object_path(scalars.object_path(F.col("h")))).first()[0] == "0123abcd"


def test_binary_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"\x00\x01")
    (tmp_path / "y.txt").write_bytes(b"y")
    got = snapshots.binary_files(spark, str(tmp_path), "*.bin").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["size"], bytes(r["content"])) for r in got] == [("x.bin", 2, b"\x00\x01")]


def test_glob_of_a_stream(spark, tmp_path):
    files = Catalog(spark, DATA).files
    files.write.parquet(str(tmp_path / "in"))
    stream = find.glob(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), ["web/*5.html"], ordered=False)
    stream.writeStream.format("memory").queryName("globbed").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("globbed").collect()) == sorted(find.glob(files, ["web/*5.html"]).collect())


def test_accepted_subscriptions(spark):
    rows = [("a", "/x", 1), ("a", "/x/", 2), ("a", "//y", 3), ("a", "/z", 4), ("b", "/z", 5)]
    asked = spark.createDataFrame(rows, "connection string, pattern string, at long")
    got = {tuple(r) for r in watch.accepted(asked, "at", 2).collect()}
    assert got == {("a", "/x", 1), ("a", "/y", 3), ("b", "/z", 5)}
    assert watch.accepted(asked, "at", 0).count() == 4
    assert watch.accepted(asked.where("false"), "at").count() == 0
