"""Each stage of the pipeline against a plain version, and what the stages promise."""

import collections

from tests.llm.test_corpus import brute_components

import corpus_pipeline
from treelake.llm import toxicity
from treelake.llm._spark import table, written

DATA = "/root/testdata/sf0.01"  # has secrets, copies and toxic documents


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    from pyspark.sql import functions as F

    machine = toxicity.train(docs, table(spark, DATA, "labels"), lambda i: F.lit(True))
    for (_, stage), step in zip(corpus_pipeline.STAGES, ("toxic", "copies", "secrets", "mix", "bpe")):
        out = written(stage(spark, docs, DATA), "test-stage")
        now = {r["doc_id"]: r for r in out.collect()}
        if step != "bpe":
            assert out.columns == names
        if step == "toxic":
            assert set(now) == {i for i, r in rows.items() if machine.scores([r["text"]])[0] < toxicity.THRESHOLD}
            assert len(now) > 0.8 * len(rows)
        elif step == "copies":
            group = brute_components([(i, r["text"]) for i, r in rows.items()], 5, 80, 100)
            assert set(now) == {i for i, (_, c) in group.items() if i == c}
            assert all(now[i] == rows[i] for i in now)
        elif step == "secrets":
            assert set(now) == set(rows)
            assert all(r["n_chars"] == len(r["text"]) for r in now.values())
            assert any(now[i]["text"] != rows[i]["text"] for i in now) and "AKIA" not in "".join(r["text"] for r in now.values())
        elif step == "mix":
            assert set(now) <= set(rows)
        else:
            assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r["doc_id"] for r in docs.collect())
            assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in now.values())
        rows, docs = now, out
