"""Operators on pairs and whole conversations, and the pipeline, against brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webstrata.llm import near_vectors, oracles, parity_join, quotes
from webstrata.llm.components import components
from webstrata.llm.shingles import shingle_sets


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, 7), (3, 900), (900, 3)] + [(5000, k) for k in range(4000, 4100)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(40)]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest(nodes, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((60, 16))
        many = base[0] + rng.normal(0, 0.25, (700, 16))
        rows += [(v.tolist(), label) for v in np.concatenate([base, base[:20] + rng.normal(0, 0.3, (20, 16)), many, np.repeat(base[1:2], 300, axis=0)])]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), ([1.0] * 16, None), ([1.0] * 8, 0), ([1.0] * 16, 0), ([2.0] * 16, 0)]
    data = [(k, v, label, k, 0) for k, (v, label) in enumerate(rows)] + [(None, [1.0] * 16, 0, 0, 0), (2, rows[2][0], 0, 2, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rep long, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    usable = [(k, np.array(v, np.float32).astype(float), label) for k, (v, label) in enumerate(rows)
              if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, u, x) in enumerate(usable):
        for j, w, y in usable[a + 1:]:
            if x == y and len(u) == len(w) and u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.93:
                links.append((i, j))
    counts = np.bincount(np.array(links).ravel(), minlength=len(rows))
    roots = smallest(range(len(rows)), links)
    assert {k: got[k] for k in range(len(rows))} == {k: (counts[k], roots[k], roots[k] == k) for k in range(len(rows))} and got[None] == (0, None, False)
    assert near_vectors.near_vectors(df).count() == len(data) and near_vectors.near_vectors(df.limit(0)).count() == 0


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def linked(a, b):
    return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)


def corpus():
    """Copies, near copies at all distances, short texts, and passages that unrelated texts share."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, out = text(60), []
    for n in (1, 4, 5, 6, 9, 12, 30, 80, 200, 450, 900):
        base = text(n)
        out += [" ".join(base), " ".join(base).upper(), "\n ".join(base)]
        for changes in range(1, 30):
            new = list(base)
            for _ in range(changes):
                k = rng.randrange(len(new) + 1)
                new[k:k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
            out.append(" ".join(new))
    for k in range(60):
        body = text(rng.randint(10, 60))
        out.append(" ".join(body[:5] + passage + body[5:]))
    out += [None, "", " \n", "a b", "A  B", "one " * 3000, "one " * 3000 + "two"]
    base = text(150)
    for _ in range(80):  # a large group whose members are no copies of one another
        new = list(base)
        for k in rng.sample(range(150), 3):
            new[k] = rng.choice(words)
        out.append(" ".join(new))
    return out


def expected_components(texts):
    sets = [plain_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and linked(sets[i], sets[j])]
    return sets, smallest(range(len(sets)), links)


def test_parity_join(spark):
    texts = corpus()
    sets, roots = expected_components(texts)
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, texts[0], 1, 2), (0, texts[0], 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, segment long, rep long").repartition(4)
    got = parity_join.parity_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), roots[r.doc_id])
    kept = parity_join.kept(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(roots.values()), None], key=str)
    assert parity_join.parity_components(df.limit(0)).count() == 0 and parity_join.kept(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_segments_of_similar_sets_meet(seed):
    """The pigeonhole holds for random sets, sizes and lists of common shingles, empty segments included."""
    rng = np.random.default_rng(seed)
    with np.errstate(over="ignore"):
        for _ in range(150):
            n = int(rng.integers(1, 400))
            both = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
            share = rng.uniform(0, 0.25)
            a = np.sort(rng.choice(both, max(1, int(n * (1 - share * rng.random()))), replace=False))
            b = np.unique(np.concatenate([rng.permutation(a)[:max(1, int(len(a) * (1 - share * rng.random())))], rng.choice(both, int(rng.integers(0, max(1, int(n * share)) + 1)))]))
            common = np.sort(rng.choice(both, int(rng.integers(0, len(both)))))
            if parity_join.similar_sets(a, b):
                assert set(parity_join.segments(a, common).tolist()) & set(parity_join.segments(b, common).tolist())
                size = min(len(parity_join.bit_sketch(a)), len(parity_join.bit_sketch(b)))
                apart = parity_join.folded_sketch(parity_join.bit_sketch(a), size) ^ parity_join.folded_sketch(parity_join.bit_sketch(b), size)
                assert np.bitwise_count(apart).sum() <= len(np.setxor1d(a, b))


def test_shingles():
    texts = ["A b c d e F", "a b c d e f", "a b c d", "", "  ", "a b c d e a b c d e"]
    with np.errstate(over="ignore"):
        sets = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts] and (sets[0] == sets[1]).all()


MESSAGES = [
    (1, 0, "a", "First message here, quite long.\nSecond line of the first message.\n\nAnother paragraph."),
    (1, 1, "b", "On Monday a wrote:\n> First message here, quite long.\n> Second   line of the first message.\n\nI agree with that."),
    (1, 2, "c", "Unrelated topic starts here now."),
    (1, 3, "a", "b wrote:\n> I agree with that.\n>> First message here, quite long.\n>> Second line of the first message.\nThanks."),
    (1, 4, "d", "> Another paragraph.\r\nNice one"), (1, 5, "e", ">> nothing known\nhello"), (1, 6, "e", "> second LINE of the first message.\nok"),
    (1, 7, "f", " > > I agree with that.\n\n>Thanks.\n"), (2, 0, "a", None), (2, 1, "b", ""), (None, 1, "x", "> First message here, quite long."),
    (2, None, "b", "hm"), (2, 1, "b", ""), (2, 2, None, "line\n" * 3000 + "> hm")]


def test_quotes_agree_with_sql(spark):
    columns = ["conv_id", "turn", "role", "text"]
    df = spark.createDataFrame([(*m, 5) for m in MESSAGES], "conv_id long, turn long, role string, text string, n long")
    got = quotes.conversations_in_reply_order(df)
    conversations = pd.DataFrame(MESSAGES, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841  read by name
    want = duckdb.connect().execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.QUOTE_LINKS})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    by_turn = {r.turn: r for r in got.where("conv_id = 1").collect()}
    assert [by_turn[t].reply_to for t in range(8)] == [None, 0, None, 1, 0, None, 0, 3] and by_turn[7].depth == 3 and by_turn[3].text == "Thanks."
    assert quotes.conversations_in_reply_order(df.limit(0)).count() == 0


def test_long_reply_chains(spark):
    rows = [(1, k, "a", (f"> message number {k - 1} of this chain\n" if k else "") + f"message number {k} of this chain") for k in range(70)]
    got = {r.turn: r for r in quotes.conversations_in_reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[k].depth, got[k].thread, got[k].position) == (k, 0, k) for k in range(70))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    words = ["the", "house", "of", "people", "and", "this", "thing", "with", "that", "other", "place", "where", "they", "went", "before"]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", "s", "ing", "ed"]) for _ in range(120))
    good = [text() for _ in range(40)]
    junk = [" ".join(w + " $$$###" for w in text().split()) for _ in range(20)]
    near = [g.replace(" the ", " a ", 1) for g in good[:10]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(good + junk + near + [good[0], None, "", "short text"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    _, roots = expected_components([t for _, t, *_ in rows])
    want = {roots[k] for k in range(40)} | {roots[k] for k in range(60, 71)}
    assert {r.doc_id for r in left.collect()} == want and not want & set(range(40, 60))
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).where("NOT whole").count() == 0


def test_rows_that_repeat_an_id_are_told_apart(spark):
    words = lambda x, n=60: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, words("a")), (1, words("b")), (2, words("b") + " more"), (3, words("c")), (3, words("c")), (4, words("a")), (5, ""), (5, None), (6, words("c") + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("mine"))
    got = Counter((r.doc_id, r.component_id) for r in parity_join.parity_components(docs).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 3): 2, (4, 1): 1, (5, 5): 2, (6, 3): 1}
    kept = parity_join.kept(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "")[:2]) for r in kept.collect()) == {(1, "a0"): 1, (1, "b0"): 1, (3, "c0"): 1, (5, ""): 1}


def test_short_quotes_of_longer_paragraphs_are_linked(spark):
    said = "I lost my key.\nWhere is it?\nTell me."
    rows = [(1, 0, "user", said), (1, 1, "user", "Nothing to say."), (1, 2, "user", "> Where is it?\n\nOn the table.")]
    got = {r.turn: r for r in quotes.conversations_in_reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].reply_to == 0 and got[2].thread == 0 and got[2].n_linked == 1 and got[1].reply_to is None


def test_common_shingles_are_counted_over_all_documents(spark):
    passage = lambda k: " ".join(f"p{k}x{j}" for j in range(5))
    # of 2,000 documents the first twenty passages stand in 60, the share asked for, the others in 59
    texts = [" ".join([f"own{d}"] + [passage(k) + f" gap{d}k{k}" for k in range(40) if d % 33 == 0 and d // 33 < (60 if k < 20 else 59)]) for d in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with np.errstate(over="ignore"):
        wanted = sorted(int(shingle_sets([passage(k).encode()])[0][0]) for k in range(20))
        common, mean = parity_join.common_shingles(docs, 100)
        sizes = [len(x) for x in shingle_sets([t.encode() for t in texts])]
    assert [int(x) for x in common] == wanted
    assert mean == pytest.approx(sum(sizes) / len(sizes))


def test_copies_count_as_common_and_all_common_shingles_are_listed(spark):
    passage = lambda k: " ".join(f"p{k}x{j}" for j in range(5))
    # copies of one document, which only together reach the share asked for; half of the rows hold many common shingles each
    long = " ".join(passage(k) for k in range(110_000))
    texts = [" ".join(["copied", passage(0), passage(1)])] * 3 + ["", None, long + " a"] + [long] * 2 + ["one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    with np.errstate(over="ignore"):
        common, mean = parity_join.common_shingles(docs)
        sets = shingle_sets([(t or "").encode() for t in texts])
    times = Counter(int(x) for s in sets for x in s)
    assert len(common) > 500_000 and [int(x) for x in common] == sorted(x for x, n in times.items() if n >= parity_join.SHARED_BY)
    assert mean == pytest.approx(np.mean([len(s) for s in sets]))
