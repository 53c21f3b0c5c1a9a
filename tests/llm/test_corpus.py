"""Operators that learn or compare over a corpus."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from treelake.llm import fingerprint, hmm, jaccard, langid, mixing, queries, toxicity
from treelake.llm._arrow import lower_ascii
from treelake.llm.components import components

SF = "/root/testdata/sf0.1"  # enough labels to learn each language from
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


# Fingerprints


def test_op2_edits_and_likeness(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in queries.op2_fingerprint(spark, DATA).collect()}
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4)) if w}
    off = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), __import__("hashlib").sha256(edited.encode()).hexdigest())
        a, b, n = shingles(t), shingles(edited), shingles(after)
        off += [abs(r["near_edited"] - len(a & b) / len(a | b)), abs(r["near_next"] - len(a & n) / len(a | n))]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean(off) < 0.02 and max(off) < 0.25


def test_equal_texts_have_equal_fingerprints(edge):
    rows = fingerprint.fingerprints(edge).collect()
    assert len(rows) == edge.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[5] == by[6] and by[1] == by[2] == by[7] == {"f:"}


def test_sketch_merges_and_contains(spark):
    w = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(" ".join(w[:1000]), " ".join(w), " ".join(w[3000:]))], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_sketch(df, F.col(c), f"s{c}")
    a, b, c = (F.col(f"s{x}") for x in "abc")
    r = df.select(fingerprint.containment(a, b).alias("in"), fingerprint.containment(b, a).alias("of"), fingerprint.jaccard(a, c).alias("none"), (fingerprint.merge(a, b) == b).alias("merged")).first()
    assert r["in"] > 0.99 and 0.2 < r["of"] < 0.3 and r["none"] == 0 and r["merged"]


def test_next_of_edges(spark, edge):
    out = fingerprint.edited_fingerprints(edge).collect()
    assert len(out) == edge.count()
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(edge.limit(0)).count() == 0


def test_next_over_many_blocks(spark):
    df = spark.range(0, 3000, 3).selectExpr("id * 7 AS k", "concat('t', id) AS t")
    rows = {r["k"]: r["next_t"] for r in fingerprint.with_next(df.withColumn("h", F.xxhash64("t")), "k", "h", ["t"]).collect()}
    assert len(rows) == 1000
    assert all(rows[k * 21] == f"t{(k + 1) % 1000 * 3}" for k in range(1000))


def test_next_of_one_frequent_id(spark):
    """Two ids hold nearly all rows: their ties are dealt to many blocks, in one order over all."""
    df = spark.range(4000).selectExpr("CASE WHEN id % 100 = 0 THEN id WHEN id % 2 = 0 THEN -5 ELSE 2000 END AS k", "concat('t', id) AS t").withColumn("h", F.xxhash64("t"))
    got = fingerprint.with_next(df, "k", "h", ["t"]).collect()
    order = sorted((r["k"], r["h"], r["t"]) for r in df.collect())
    want = {t: order[(j + 1) % len(order)][2] for j, (_, _, t) in enumerate(order)}
    assert len(got) == 4000 and {r["t"]: r["next_t"] for r in got} == want


def test_likeness_of_repetitive_and_short_texts(spark):
    """Few shingles in many words, and sizes about the least sample."""
    rnd = random.Random(2)
    texts = [f"{w} " * 100 for w in ("alpha", "beta", "gamma", "delta")] + ["alpha " * 100, "x y " * 80, "y x " * 70, "one two", "", None]
    texts += [" ".join(f"w{k}" for k in range(a, a + n)) for n in (60, 64, 68, 70, 90, 130, 260, 400) for a in (0, n // 3)]
    texts += [" ".join(rnd.choices("abc", k=300)) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    for r in fingerprint.edited_fingerprints(df).collect():
        a, b = sets[r["doc_id"]], sets[(r["doc_id"] + 1) % len(sets)]
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_next"] - true) < (0.2 if max(len(a), len(b)) > 64 else 1e-12), r["doc_id"]


def test_merged_sketch_is_that_of_the_united_set(spark):
    df = spark.createDataFrame([("p q r s t " * 3, " ".join(f"v{k}" for k in range(50))), (" ".join(f"u{k}" for k in range(300)), "u1 u2 u3 u4 u5 u6"), ("", "a b")], "a string, b string")
    for c, e in (("a", F.col("a")), ("b", F.col("b"))):
        df = fingerprint.with_sketch(df, e, f"s{c}", shingle=1)
    df = fingerprint.with_sketch(df, F.concat_ws(" ", "a", "b"), "both", shingle=1)
    assert all(r[0] for r in df.select(fingerprint.merge(F.col("sa"), F.col("sb")) == F.col("both")).collect())


# Mixing


def test_op4_equals_sql(spark, duck):
    df = queries.op4_mixing(spark, DATA)
    got = sorted(str((r["doc_id"], r["source"], r["tokens"], r["weight"], r["pass"], r["order"])) for r in df.collect())
    assert got == sorted(map(str, duck.execute(queries.OP4_SQL).fetchall()))


def test_mixing_meets_its_targets(spark):
    rows = [(k, "w " * 10, "big" if k % 3 else f"s{k % 7}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = collections.Counter(r[2] for r in rows)
    out = mixing.mix(df, entropy=0.95, repeats=2.0).collect()
    taken = collections.Counter(r["source"] for r in out)
    assert all(taken[s] <= 2 * share[s] for s in share)
    total = sum(taken.values())
    assert abs(total - len(rows)) <= len(share)
    weight = {r["source"]: r["weight"] for r in out}
    assert all(abs(taken[s] / total - weight[s]) < 0.01 for s in share)
    assert min(taken[s] / share[s] for s in share if s != "big") > 1 > taken["big"] / share["big"]
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert entropy >= 0.95 * math.log(len(share)) - 1e-4 or max(taken[s] / share[s] for s in share) > 1.98
    # Each pass takes a document at most once.
    assert max(collections.Counter((r["doc_id"], r["pass"]) for r in out).values()) == 1


def test_mixed_rows_agree_with_mix(spark, edge):
    taken = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix(edge).collect())
    rows = mixing.mixed_rows(edge)
    assert rows.columns == edge.columns
    assert collections.Counter((r["doc_id"], r["source"]) for r in rows.collect()) == taken
    assert mixing.mix(edge.limit(0)).count() == 0
    assert mixing.mix(edge, budget=0).count() == 0


# Language model


def test_op3_base_scores(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    texts = sum(not held(i) for i, _ in rows)
    n, v = sum(counts.values()) + texts, len(counts) + 1
    better = []
    for r in queries.op3_hmm(spark, DATA).collect():
        ws = words(dict(rows)[r["doc_id"]])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((texts + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        if r["held_out"]:
            better.append(r["score"] - r["base_score"])
    assert sum(better) > 0


def test_forward_recursion_equals_all_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model.random(rng.integers(0, 50, hmm.CLASSES).astype(float))
    sequence = np.array([3, 9000, 17, hmm.END], np.int32)
    total = 0.0
    for path in np.ndindex(*[hmm.STATES] * len(sequence)):
        p = model.start[path[0]]
        for t, s in enumerate(path):
            p *= model.emit[sequence[t], s] * (model.move[path[t - 1], s] if t else 1)
        total += p
    assert abs(model.log10([sequence])[0] - math.log10(total)) < 1e-9


def test_training_raises_likelihood():
    rng = np.random.default_rng(1)
    sequences = [np.append(rng.integers(0, 40, n) + (100 if k % 2 else 0), hmm.END).astype(np.int32) for k, n in enumerate(rng.integers(1, 60, 40))]
    totals = np.bincount(np.concatenate(sequences), minlength=hmm.CLASSES).astype(float)
    model, last = hmm.Model.random(totals), -1e18
    for _ in range(6):
        now = model.log10(sequences).sum()
        assert now > last
        last = now
        starts, moves, emits = model.expected(sequences)
        assert abs(emits.sum() - sum(map(len, sequences))) < 1e-6
        assert abs(starts.sum() - len(sequences)) < 1e-6 and abs(moves.sum() - sum(len(s) - 1 for s in sequences)) < 1e-6
        model = hmm.Model.estimated((starts, moves, emits), totals, strength=1.0)


def test_words_of_the_model_are_the_patterns_words_at_less_cost():
    import time

    odd = ["", " ", "A\x0bB\x0cc\r\nD\te", "x\x1cy\x1dz\x1e\x1f", "n\x85b\xa0c\u2003d\u3000e", "\x00\x00 Z", "ÉCOLE Straße \u212aELVIN \U0001d400 İi", None]
    for t in odd:
        assert [w.decode() for w in hmm.words_of(None if t is None else t.encode())] == words(t)
    rnd = random.Random(6)
    text = " ".join(rnd.choices(["Größe", "naïve", "The", "of", "élève", "Data"], k=400_000))
    data, began = text.encode(), time.process_time()
    want = words(text)
    middle = time.process_time()
    got = hmm.words_of(data)
    assert time.process_time() - middle < (middle - began) / 2
    assert [w.decode() for w in got] == want and len(want) == 400_000


def test_hmm_scores_bytes_that_are_no_text(spark):
    """Strings of a table may hold bytes that aren't UTF-8: they are words as any other."""
    df = spark.createDataFrame([(k, b"a b \xff\xfe c" if k % 2 else b"a a b") for k in range(12)], "doc_id long, text binary")
    rows = hmm.score(df.selectExpr("doc_id", "CAST(text AS string) AS text"), F.lit(False)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in rows} == {k: (5, 5) if k % 2 else (4, 4) for k in range(12)}
    assert all(r["score"] < 0 for r in rows)


def test_hmm_edges(edge):
    rows = hmm.score(edge, F.col("doc_id") == 6).collect()
    assert len(rows) == edge.count()
    assert all(r["score"] < 0 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["n_tokens"] == 1
    assert hmm.score(edge.limit(0), F.lit(False)).count() == 0
    nothing = hmm.score(edge, F.lit(True)).collect()
    assert all(r["base_score"] == 0 for r in nothing)


# Toxicity


def test_op6_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op6_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right / len(rows) > 0.97


def test_machine_learns_pairs():
    """Neither term is toxic alone, both together are."""
    rnd = random.Random(0)
    texts, labels = [], []
    for _ in range(2000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(["alpha"] * a + ["omega"] * b + rnd.choices(["one", "two", "six"], k=3)))
        labels.append(float(a and b))
    machine = toxicity.fit([np.array(sorted(toxicity.terms(t)), np.int64) for t in texts], np.array(labels))
    assert [s >= 0.3 for s in machine.scores(["alpha one", "omega two", "alpha omega", "", None])] == [False, False, True, False, False]


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 0), (5, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    machine = toxicity.train(edge, labels, lambda i: F.lit(True))
    rows = toxicity.score(edge, machine, F.lit(False)).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.train(edge, labels.limit(0), lambda i: F.lit(True))
    assert toxicity.keep_clean(edge, none).count() == edge.count()
    assert toxicity.score(edge.limit(0), none, F.lit(False)).count() == 0


# Language identification


def test_op8_held_out(spark, docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op8_langid(spark, DATA).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bb"]
    p = langid.Pieces(pieces)
    table = langid.normal(np.random.default_rng(0).random((len(pieces) + 2, 2)))

    def brute(text, lang):
        if not text:
            return 1.0
        out = table[-1, lang] * brute(text[1:], lang)
        return out + sum(table[k, lang] * brute(text[len(x) :], lang) for k, x in enumerate(pieces) if text.startswith(x))

    some = ["a", "ab", "abb", "zab", "bbabab", "漢a"]
    got = langid.word_scores(p, table, some)
    for w, row in zip(some, got):
        assert np.allclose(row, [math.log(brute("▁" + w, k)) for k in range(2)])
    long = langid.word_scores(p, table, ["ab" * 5000])
    assert np.isfinite(long).all()
    # Expected counts are the derivative of the log-likelihood.
    counts = langid.expected_counts(p, table[:, 0], some, np.ones(len(some)))
    for k in range(len(pieces)):
        moved = table.copy()
        moved[k, 0] *= 1 + 1e-6
        slope = (langid.word_scores(p, moved, some)[:, 0].sum() - got[:, 0].sum()) / 1e-6
        assert abs(slope - counts[k]) < 1e-3


def test_langid_edges(edge):
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(edge, F.lit(False)).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= rows and len(rows) >= 7
    assert {r["lang_pred"] for r in langid.identify(edge, F.lit(True)).collect()} == {"und"}
    assert langid.identify(edge.limit(0), F.lit(False)).count() == 0


# Jaccard join


def brute_components(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    for i in sorted(sets):
        for j, n in collections.Counter(j for g in sets[i] for j in lists[g] if j > i).items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("size", "num", "leaf"), [(3, 90, 256), (2, 60, 2), (5, 80, 3)])
def test_join_equals_brute_force(spark, size, num, leaf):
    rnd = random.Random(size)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [rnd.choices(vocabulary, k=rnd.choice([4, 12, 30, 60])) for _ in range(12)]
    passage = rnd.choices(vocabulary, k=25)
    rows = []
    for i in range(400):
        b = list(rnd.choice(base)) if rnd.random() < 0.7 else rnd.choices(vocabulary, k=rnd.randrange(0, 40))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if b:
                b[rnd.randrange(len(b))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(b + passage if rnd.random() < 0.3 else b)))
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a  B"), (504, "x")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), size=size, num=num, leaf=leaf).collect()}
    assert got == brute_components(rows, size, num, 100)


def test_op9_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_jaccard(spark, DATA).collect()}
    assert got == brute_components(rows, 3, 90, 100)


@pytest.mark.parametrize("leaf", [4, 1024])
def test_all_links_equal_brute_force(spark, leaf):
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(5, 50, 5)] + [" ".join(base)] * 3 + ["other words of a text", "other words of a text", "", None]
    rows = list(enumerate(texts, 1))
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if (w := words(t)) else frozenset() for i, t in rows}
    near = lambda a, b: a and b and 10 * len(a & b) >= 8 * len(a | b)
    first = {i: min(j for j in sets if sets[j] == s) if s else None for i, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"]): (r["class_id"], r["n_links"]) for r in jaccard.link_counts(df, size=3, num=80, leaf=leaf).collect()}
    assert got == {i: (first[i], sum(bool(near(s, t)) for j, t in sets.items() if j != i)) for i, s in sets.items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in set(first.values()) - {None} for b in set(first.values()) - {None} if a < b and near(sets[a], sets[b])}
    found = {(r["a"], r["b"]): r["similarity"] for r in jaccard.links(df, size=3, num=80, leaf=leaf).collect()}
    assert len(want) > len({x for p in want for x in p}) and found == pytest.approx(want)


def test_join_edges(edge):
    assert {r["n_links"] for r in jaccard.link_counts(edge, size=2, num=80).collect()} == {0, 1}
    rows = jaccard.link(edge, size=2, num=80).collect()
    assert len(rows) == edge.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 2), (None, None), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8)}
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "7", "8", "None"]
    assert jaccard.link(edge.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize(("num", "leaf", "elements"), [(80, 4096, 1 << 21), (90, 8, 1 << 21), (80, 4096, 300), (70, 16, 300)])
def test_large_cells_equal_brute_force(spark, num, leaf, elements):
    """A ball of near copies, chains of small edits and boilerplate, with limits that send them through pivots and blocks."""
    rnd = random.Random(num + leaf)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            w[rnd.randrange(60)] = f"e{rnd.randrange(200)}"
        rows.append((i, " ".join(w[: rnd.choice([60, 60, 58, 52])])))
    chain = [f"c{k}" for k in range(80)]
    for i in range(100, 160):
        rows.append((i, " ".join(chain)))
        chain = [*chain[2:], f"d{i}", f"f{i}"]
    for i in range(200, 260):
        rows.append((i, " ".join(base[:20] + [f"u{i}x{k}" for k in range(rnd.choice([3, 10, 30]))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.Join(df.selectExpr("doc_id AS i", "text AS t"), 2, num, 100, leaf, elements).run()
    assert {r["i"]: (r["n"], r["component"]) for r in out.collect()} == brute_components(rows, 2, num, 100)


def test_sets_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e"), (2, "p q r s t"), (3, "a b c d e"), (3, "p q r s t")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_one_of_each_repeated_id_stays(spark):
    rows = [(1, "z y x", 1, {"k": 1}), (1, "a b c", 2, {"k": 2}), (1, "a b c", 1, {"k": 3}), (2, "A  b c", 7, None), (None, "a b c", 1, None), (None, "a b c", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `i.j` int, m map<string, int>")
    got = jaccard.keep_one(df.repartition(5)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([rows[2], rows[4], rows[5]], key=str)


def test_counts_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, 700, 41, 40, 3, 300)]
    model = hmm.Model.random(np.bincount(np.concatenate(sequences), minlength=hmm.CLASSES).astype(float))
    whole, scores = model.expected(sequences), model.log10(sequences)
    for cells in (1, 64, 333):
        monkeypatch.setattr(hmm, "CELLS", cells)
        monkeypatch.setattr(hmm, "SCORE_CELLS", cells)
        assert all(np.allclose(x, y) for x, y in zip(whole, model.expected(sequences))) and np.allclose(scores, model.log10(sequences))


def test_one_very_long_text_among_short_ones():
    import time
    import tracemalloc

    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 50, 3).astype(np.int32) for _ in range(5000)] + [rng.integers(0, 50, 300_000).astype(np.int32)]
    model = hmm.Model.random(np.ones(hmm.CLASSES))
    tracemalloc.start()
    began = time.time()
    model.log10(sequences)
    model.expected(sequences)
    assert time.time() - began < 120 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_op3_scores_equal_a_plain_model(spark, monkeypatch):
    """With few classes of their own and a short lookup table, so that rare words go through the join."""
    monkeypatch.setattr(hmm, "LOOKUP", 12)
    seen = []
    estimated = hmm.Model.estimated.__func__
    monkeypatch.setattr(hmm.Model, "estimated", classmethod(lambda cls, *a, **k: seen.append(estimated(cls, *a, **k)) or seen[-1]))
    rnd = random.Random(9)
    texts = [" ".join(rnd.choices([f"w{k}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=rnd.randrange(0, 30))) for _ in range(80)] + ["new words here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in hmm.score(df, F.col("doc_id") % 5 == 2).collect()}
    counts = collections.Counter(w for i, t in enumerate(texts) if i % 5 != 2 for w in words(t))
    first = min(12, len(counts))
    cut = sorted(counts.values(), reverse=True)[first - 1] if first < len(counts) else 0
    top = {w for w in counts if sum(c >= counts[w] for c in counts.values()) <= first or not cut}
    own = {w: k for k, w in enumerate(sorted(top, key=lambda w: (-counts[w], w)))}
    model = seen[-1]
    mass = collections.Counter()
    for w, c in counts.items():
        if w not in own:
            mass[hmm.bucket(w)] += c + 1
    for i, t in enumerate(texts):
        total, a = 0.0, None
        for w in [*words(t), None]:
            k = hmm.END if w is None else own.get(w, hmm.bucket(w) if w not in own else 0)
            a = (model.start if a is None else a @ model.move) * model.emit[k]
            if w is not None and w not in own:
                total += math.log10((counts[w] + 1) / (mass[k] + 1))
            total += math.log10(a.sum())
            a = a / a.sum()
        assert abs(got[i] - total) < 1e-6, i


def test_op8_equals_a_plain_model(spark, monkeypatch, tmp_path):
    """Prediction and score of the query's path against sums over all segmentations, with white space and capitals beyond ASCII."""
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "bb", "ß", "ab" * 10]
    monkeypatch.setattr(langid, "read_pieces", lambda path: pieces)
    rnd = random.Random(3)
    rows = [(k, "  　"[k % 3].join("".join(rnd.choices("abAB", [3, 1 + 2 * (k % 2), 1, 1], k=rnd.randrange(1, 6))) for _ in range(6)), "xy"[k % 2]) for k in range(60)]
    rows += [(100, "ab" * 30 + "ẞ", None), (101, "1 2", "x"), (102, None, "x"), (None, "ab", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("doc_id") % 4 == 2).collect()}
    langs, table = langid.train(df.where("doc_id IS NULL OR doc_id % 4 <> 2"), "text", "lang", pieces)

    def likelihood(word, lang):
        text, sums = "▁" + word, [1.0]
        for j in range(1, len(text) + 1):
            sums.append(sums[-1] * table[-1, lang] + sum(sums[j - len(x)] * table[k, lang] for k, x in enumerate(pieces) if text[:j].endswith(x)))
        return math.log(sums[-1])

    for i, t, _ in rows:
        ws = (t or "").lower().split() if any(map(str.isalpha, t or "")) else []
        if not ws:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        z = np.array([sum(likelihood(w, k) for w in ws) for k in range(len(langs))])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == langs[int(z.argmax())] and abs(got[i]["score"] - p.max()) < 1e-9
    assert got[None]["held_out"] is False


def test_one_long_run_is_scored_in_little_time_and_memory():
    import time
    import tracemalloc

    p = langid.Pieces(langid.read_pieces())
    table = langid.normal(np.random.default_rng(0).random((p.n + 2, 5)))
    run = "".join(random.Random(1).choices("語言文字中国日本tha", k=100_000))
    tracemalloc.start()
    began = time.time()
    one = langid.word_scores(p, table, [run, "a"])
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    halves = langid.word_scores(p, table, [run[:1000]])
    assert np.isfinite(one).all() and (halves > one[0]).all()


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b])
def test_training_finds_pairs(spark, rule):
    """Two words, each as often toxic as not for exclusive or, through the choice of terms and the fit."""
    rnd = random.Random(1)
    texts, labels = [], []
    for k in range(2000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append((k, " ".join(["alpha"] * a + ["omega"] * b + rnd.choices([f"noise{x:c}" for x in range(97, 123)], k=8))))
        labels.append((k, int(bool(rule(a, b)))))
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, marks, lambda i: i < 1500)
    got = machine.scores([t for _, t in texts])
    assert np.mean([(s >= 0.3) == bool(y) for s, (k, y) in zip(got, labels) if k >= 1500]) > 0.97


def test_score_is_the_sum_over_pairs(spark):
    """Against a naive double loop, for texts through the query's path; and which rows were learned from."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    may = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    machine = toxicity.train(docs, labels, lambda i: F.crc32(i.cast("string").cast("binary")) % 4 != 2)
    rows = docs.orderBy("doc_id").limit(40).collect()
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine, queries.remainder(4) == 2).collect()}
    for r in rows:
        at = sorted({machine.index[h] for h in toxicity.terms(r["text"]) if h in machine.index})
        z = machine.bias + sum(machine.weights[k] for k in at) + sum(machine.factors[j] @ machine.factors[k] for n, j in enumerate(at) for k in at[n + 1 :])
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert got[r["doc_id"]]["held_out"] == (not may(r["doc_id"]))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, turned, lambda i: F.crc32(i.cast("string").cast("binary")) % 4 != 2)
    assert again.bias == machine.bias and np.array_equal(again.weights, machine.weights) and again.index == machine.index


def test_contrasts_equal_one_pair_at_a_time():
    rng = np.random.default_rng(6)
    x, y = (rng.random((400, 6)) < 0.5).astype(np.float32), np.zeros(400)
    y[(x[:, 1] != x[:, 4])] = 1
    a, b, z = toxicity.pair_contrasts(x, y)
    assert (a[0], b[0]) == (1, 4)
    share = {(p, q): ((y[(x[:, 1] == p) & (x[:, 4] == q)]).sum() + 0.5, ((x[:, 1] == p) & (x[:, 4] == q)).sum() + 1) for p in (0, 1) for q in (0, 1)}
    contrast = sum((1 if p == q else -1) * k / m for (p, q), (k, m) in share.items())
    assert abs(z[0] / (contrast**2 / sum(k / m * (1 - k / m) / m for k, m in share.values())) - 1) < 1e-4
