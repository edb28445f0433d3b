from collections import Counter

import pytest

from estima.llm.mixing import mix_sources, mixed

SCHEMA = "doc_id long, text string, source string, n_chars long, mix_size string, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, "clash", "x") for i, t, s in rows], SCHEMA)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Excess over the caps is dealt again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(600):
        source = ["a", "b", "c", "d", None, "é", "Z", ""][i % 8 if i % 3 else 0]
        out.append((i, " ".join(["w"] * (i * 7919 % 40)), source))
    return out + [(900, None, "a"), (901, "", "b"), (902, " \t\n", "c"), (903, "one", "lone"), (905, None, "void"), (3, out[3][1], out[3][2]), (3, out[3][1], out[3][2])]


def test_targets_and_nearness(spark, rows):
    got = mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"] * (3 if r["doc_id"] == 3 else 1))
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = plain_targets(dict(sizes))
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert all(r["source_size"] == sizes[r["source"]] for r in got)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(spark, rows):
    one = sorted(map(str, mix_sources(frame(spark, rows)).collect()))
    two = sorted(map(str, mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()))
    assert one == two


def test_larger_budgets_take_supersets(spark, rows):
    takes = [{(r["doc_id"], r["source"]): r["copies"] for r in mix_sources(frame(spark, rows), weights=(1,), share=x).collect()} for x in (0.3, 0.6, 1.0)]
    for less, more in zip(takes, takes[1:], strict=False):
        assert all(more[k] >= n for k, n in less.items())


def test_rows_repeat_as_often_as_taken(spark, rows):
    df = frame(spark, rows)
    got = Counter(r["doc_id"] for r in mixed(df).collect())
    want = Counter()
    for r in mix_sources(df).collect():
        want[r["doc_id"]] += r["copies"]
    assert got == +want and mixed(df).columns == df.columns
    assert mixed(df).where("mix_size <> 'clash' or extra <> 'x'").count() == 0


def test_empty_tables_and_texts(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    got = mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in got] == [(0, 0, 0.0)] * 2


def test_null_ids_and_a_very_long_text(spark):
    got = mix_sources(frame(spark, [(None, "a b", "s"), (None, "a b", "s"), (1, "x " * 500_000, "t")])).collect()
    assert len(got) == 3 and max(r["size"] for r in got) == 500_000
