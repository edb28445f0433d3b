import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estima.llm import jaccard as jc

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_set(text, width):
    words = [] if not text else text.encode().translate(LOWER).split()
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def plain_components(rows, width, percent):
    """All pairs, united."""
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed):
    """Groups of edited copies, some copied from copies, some edited too much for a link."""
    r = random.Random(seed)
    words, rows = [f"w{k}" for k in range(2000)], []
    for _ in range(10):
        base = [r.choice(words) for _ in range(int(np.exp(r.uniform(0.5, 6))))]
        for c in range(r.choice([1, 2, 3, 15, 50])):
            text = list(base)
            for _ in range(int(r.random() ** 2 * len(base) * 0.08)):
                k, what = r.randrange(len(text)), r.random()
                if what < 0.5:
                    text[k] = r.choice(words)
                elif what < 0.75 and len(text) > 1:
                    del text[k]
                else:
                    text.insert(k, r.choice(words))
            rows.append((len(rows) * 3 % 7919, r.choice([" ", "\n", "\t "]).join(text)))
            if c % 9 == 4:
                base = text
    return rows + [(8000, None), (8001, ""), (8002, " \n"), (8003, "One two"), (8004, "one TWO"), (8005, "É two"), (8006, "é two")]


@pytest.mark.parametrize("seed, width, percent", [(0, 3, 90), (1, 5, 80), (2, 3, 90), (3, 5, 80), (4, 2, 60)])
def test_against_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    got = jc.join_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert sorted(map(tuple, got.collect())) == plain_components(rows, width, percent)


def test_repeated_rows_extra_columns_and_a_very_long_text(spark):
    long = " ".join(f"x{i % 977}y{i}" for i in range(60_000))
    rows = [(5, long, 1), (4, long + " end", 2), (9, "a b c d", 3), (9, "a b c d", 3), (2, "A B C D", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted(map(tuple, jc.join_components(df).collect()))
    assert got == [(2, 2, 2), (4, 59999, 4), (5, 59998, 4), (9, 2, 2), (9, 2, 2)]
    kept = jc.keep_one(df, 3, 90)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jc.join_components(df).count() == 0 and jc.keep_one(df).count() == 0


def test_unlike_texts_of_one_id_count_each(spark):
    a, b, c = ("a b c d e f g h", "q r s t u v w x", "k l m n o p k l")
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (3, b, 3), (4, c, 4), (4, "i j i j x y z", 5), (4, c, 4), (4, None, 6), (5, c, 7), (6, a, 8), (6, a, 9), (7, "own words of seven only", 10), (7, "own words of seven only", 10)]
    kept = jc.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int"), 3, 90)
    assert kept.columns == ["doc_id", "text", "row"] and sorted(r["row"] for r in kept.collect()) == [0, 2, 4, 5, 6, 10]


def test_texts_without_words_all_stay(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, None), (3, None)], "doc_id long, text string")
    assert jc.keep_one(df).count() == 4


@given(st.integers(1, 400), st.sampled_from([50, 80, 90, 95]), st.integers(0, 60), st.integers(0, 60), st.integers(0, 1 << 30))
@settings(max_examples=500, deadline=None)
def test_linked_sets_share_a_signature(n, percent, gone, more, seed):
    rng = np.random.default_rng(seed)
    items = np.unique(rng.integers(0, 1 << 62, n + more).astype(np.uint64))
    a = np.sort(items[:n])
    b = np.sort(np.concatenate([rng.permutation(items[:n])[min(gone, n - 1) :], items[n:]]))
    common = len(np.intersect1d(a, b))
    if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
        told = [jc.signatures(s, percent) for s in (a, b)]
        assert len(np.intersect1d(told[0][0], told[1][0])) >= max(told[0][1], told[1][1]) >= 1
        for s, (found, _) in zip((a, b), told, strict=True):
            assert len(found) <= jc.signature_count(len(s), percent)


@given(st.integers(1, 600), st.integers(0, 300), st.integers(0, 300), st.integers(0, 1 << 30))
@settings(max_examples=200, deadline=None)
def test_sketches_never_tell_more_than_the_difference(n, gone, more, seed):
    rng = np.random.default_rng(seed)
    items = np.unique(rng.integers(0, 1 << 62, n + more).astype(np.uint64))
    a, b = items[:n], np.concatenate([items[min(gone, n - 1) : n], items[n:]])
    assert jc.cells_apart(jc.sketch_of(a, 80), jc.sketch_of(b, 80)) <= len(np.setxor1d(a, b))


@given(st.lists(st.text(alphabet="aAbB \n\té ", max_size=30), max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_shingles_count_like_the_definition(texts, width):
    sets = jc.shingle_sets([t.encode() for t in texts], width)
    assert [len(s) for s in sets] == [len(plain_set(t, width)) for t in texts]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("ab \n", k=5000)).encode()
    whole = jc.shingle_sets([text], 3)[0]
    monkeypatch.setattr(jc, "PIECE", 40)
    assert np.array_equal(jc.shingle_sets([text], 3)[0], whole)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in jc.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("medium, many", [(0, 0), (0, 10**6), (8, 30), (10**6, 0)])
def test_small_caps_on_broadcast_and_bitmap_change_nothing(spark, monkeypatch, medium, many):
    rows = corpus(7)
    monkeypatch.setattr(jc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jc, "MOST_BITS", 16)
    monkeypatch.setattr(jc, "SEEN", 5)
    monkeypatch.setattr(jc, "HELD", 300)
    monkeypatch.setattr(jc, "BLOB", 3)
    monkeypatch.setattr(jc, "PART", 50)
    monkeypatch.setattr(jc, "MEDIUM", medium)
    monkeypatch.setattr(jc, "MANY", many)
    monkeypatch.setattr(jc, "PAGE", 7)
    got = jc.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain_components(rows, 3, 90)
