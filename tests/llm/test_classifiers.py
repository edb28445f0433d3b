import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from estima.llm import langid, toxicity
from estima.llm.queries import op3_toxicity, op10_language_id

WORDS = "the of and this with plain kind morning letter paper window garden quiet water bread stone field".split()
BAD = "vexlout grumbix snarvel".split()


def toxic_corpus(n=400):
    r, rows, labels = random.Random(4), [], []
    for i in range(n):
        words = r.choices(WORDS, k=r.randint(5, 80))
        bad = i % 4 == 0
        for _ in range(r.randint(1, 12) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(BAD).capitalize() + r.choice(["", "!"]))
        rows.append((i, " ".join(words), "clash"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(1000, None, "x"), (1001, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, toxicity string")
    table = spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, table, toxicity.fit(docs, table)


def test_toxic_documents_are_found(toxic):
    docs, _, model = toxic
    got = {r["doc_id"]: r for r in toxicity.grade_documents(docs, model).collect()}
    unseen = [r for i, r in got.items() if i < 1000 and i % 2 and i % 3]
    assert sum(r["rejected"] == (r["doc_id"] % 4 == 0) for r in unseen) >= 0.97 * len(unseen)
    assert sum(r["rejected"] for i, r in got.items() if i < 1000 and i % 4 == 0) >= 97
    assert not got[1000]["rejected"] and not got[1001]["rejected"]
    assert all(0 <= r["severity"] <= 3 and 0 <= r["toxicity"] <= 1 for r in got.values())
    assert got[1000]["severity"] == got[1001]["severity"] == 0


def test_severity_grows_with_what_is_told(toxic):
    _, _, model = toxic
    scores = model.above(toxicity._scores(model, ["plain paper", "plain vexlout", "vexlout grumbix", "vexlout grumbix snarvel"])).sum(1)
    assert (np.diff(scores) > 0).all()


def test_keep_clean(toxic):
    docs, _, model = toxic
    kept = toxicity.keep_clean(docs, model)
    want = [r["doc_id"] for r in toxicity.grade_documents(docs, model).where("not rejected").collect()]
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_probabilities_are_cumulative(toxic):
    model = toxic[2]
    assert (np.diff(model.thresholds) > 0).all()
    above = model.above(np.linspace(-5, 40, 50))
    assert (np.diff(above, axis=1) <= 0).all() and (np.diff(above, axis=0) >= 0).all()


def test_ordinal_fit_recovers_weights():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (6000, 3)).astype(np.float32)
    latent = x @ np.array([2.0, 1.0, 0.0]) + rng.logistic(size=6000)
    w, cuts = toxicity.fit_ordinal(x, np.searchsorted([1.0, 3.0], latent), 3)
    assert np.allclose(w, [2, 1, 0], atol=0.25) and np.allclose(cuts, [1, 3], atol=0.25)


def test_pieces_of_long_texts_give_the_same_features(monkeypatch):
    text = " ".join(random.Random(2).choices(WORDS + ["Éa", "中文字"], k=400))
    whole = toxicity.features_of(text)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert np.array_equal(toxicity.features_of(text), whole)
    grams = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "PIECE", 37)
    assert np.array_equal(np.sort(np.concatenate(list(langid.buckets(text)))), grams)


def test_without_labels_nothing_is_rejected(spark, toxic):
    docs, table, _ = toxic
    model = toxicity.fit(docs, table.where("false"))
    assert toxicity.grade_documents(docs, model).where("rejected or severity > 0").count() == 0
    assert toxicity.grade_documents(docs.where("false"), model).count() == 0


def test_the_sample_is_bounded(toxic):
    docs, table, _ = toxic
    rows = toxicity.sample_labelled(docs, table, most=40)
    assert len(rows) <= 40 and rows["toxic"].sum() <= 20 and rows["doc_id"].is_unique


def test_toxicity_on_the_documents(spark, sf):
    got = op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = got.join(labels, "doc_id").groupBy("toxic").agg({"rejected": "max"}).collect()
    hits = got.join(labels, "doc_id").selectExpr("avg(double(rejected = (toxic = 1)))").first()[0]
    assert len(r) == 2 and hits > 0.97


LANGUAGES = {"xa": "oua liri mento elle quare", "xb": "schorn untz keit berg ein", "xc": "the ning ould with ther"}


def language_rows(n=300):
    r, rows = random.Random(5), []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        syllables = LANGUAGES[lang].split()
        rows.append((i, " ".join("".join(r.choices(syllables, k=2)) for _ in range(r.randint(3, 60))), lang, "s"))
    return rows


def test_languages(spark):
    rows = [*language_rows(), (900, None, "xa", "s"), (901, "", "xa", "s"), (902, "123 --- 456", "xb", "s"), (903, "schornkeit", None, None), (None, "liri", "xa", "s"), (3, "liriliri", "xa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs.select("doc_id", "text", "score"), model).collect()
    assert len(got) == len(rows)
    want = {(i, t): lang for i, t, lang, _ in rows}
    for r in got:
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 900}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "xb"]
    held = [(i, t, lang) for i, t, lang, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    predicted = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(held) > 30 and np.mean([predicted[i] == lang for i, _, lang in held]) > 0.98 and want


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_scores_against_a_plain_sum(spark):
    docs = spark.createDataFrame(language_rows(60), "doc_id long, text string, lang string, source string")
    m = langid.fit(docs)
    text = "Liri, ould 7 schorn"
    words = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = m.prior.copy()
    for n in langid.SIZES:
        for i in range(len(words) - n + 1):
            if n > 1 or words[i] != " ":
                cp = np.array([ord(c) for c in words[i : i + n]], np.uint32)
                total += m.matrix[int(toxicity.gram_hashes(cp, n, langid.BITS)[0])]
    p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    assert m.predict(text) == (m.languages[int(p.argmax())], pytest.approx(p.max(), rel=1e-4))


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0)]
    assert langid.identify(docs.where("false"), langid.fit(docs.where("false"))).count() == 0


def test_languages_of_the_documents(spark):
    d = "/root/testdata/sf0.01"
    got = op10_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").selectExpr("avg(double(lang = lang_pred))").first()[0] > 0.97


@functools.cache
def plain_hash(gram, bits):
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)


def plain_letters(text):
    return " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "


def plain_features(text):
    """Grams of four and five characters with a space at an end at most."""
    t = plain_letters(text or "")
    return {plain_hash(t[i : i + n], toxicity.BITS) for n in (4, 5) for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1]} if text else set()


def test_toxicity_against_a_plain_version(spark, sf):
    """The query again, from its texts and labels: features, which of them tell, and what they say; the fit's weights are taken over."""
    docs, labels = ([r.asDict() for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t in ("documents", "labels"))
    own = {r["doc_id"]: plain_features(r["text"]) for r in docs}
    toxic = {}
    for r in labels:
        if r["doc_id"] in own and r["toxic"] is not None:
            toxic[r["doc_id"]] = max(toxic.get(r["doc_id"], 0), r["toxic"])
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    n = Counter(toxic.values())
    assert len(toxic) <= toxicity.LABELLED and n[0] and n[1]
    count = [Counter(f for i, k in toxic.items() if k == kind for f in own[i]) for kind in (0, 1)]
    telling = {}
    for f in set(count[0]) | set(count[1]):
        a, b, both = (count[0][f] + 0.5) / (n[0] + 1), (count[1][f] + 0.5) / (n[1] + 1), count[0][f] + count[1][f]
        pooled = (both + 1) / (len(toxic) + 2)
        z = (b - a) / (pooled * (1 - pooled) * (1 / n[0] + 1 / n[1])) ** 0.5
        if both >= 4 and b >= 4 * a and z > 2:
            telling[f] = z
    chosen = {int(f) for f in np.flatnonzero(model.keep >= 0)}
    assert len(chosen) == min(len(telling), toxicity.FEATURES) and chosen <= set(telling)
    assert min(telling[f] for f in chosen) >= max([z for f, z in telling.items() if f not in chosen], default=0) - 1e-9
    got = {r["doc_id"]: r for r in op3_toxicity(spark, sf).collect()}
    assert set(got) == set(own)
    for i, found in own.items():
        score = sum(model.weights[model.keep[f]] for f in found if model.keep[f] >= 0)
        above = [1 / (1 + np.exp(t - score)) if found else 0.0 for t in model.thresholds]
        assert got[i]["toxicity"] == pytest.approx(above[0], abs=1e-6) and got[i]["severity"] == pytest.approx(sum(above), abs=1e-6)
        assert got[i]["rejected"] == (got[i]["toxicity"] >= 0.5)


def test_language_id_against_a_plain_version(spark, sf):
    """The query again: counts of all grams of the rows that aren't held out, smoothed, summed gram by gram."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        t = " " + " ".join(plain_letters(text).split()) + " "
        return Counter(plain_hash(t[i : i + n], langid.BITS) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1) if t[i : i + n] != " ")

    own = {r["doc_id"]: grams(r["text"] or "") for r in rows}
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    languages = sorted({r["lang"] for r in learned})
    n_docs = Counter(r["lang"] for r in learned)
    assert max(n_docs.values()) <= langid.PER_LANGUAGE  # so every one is counted
    counts = np.full((1 << langid.BITS, len(languages)), 0.5)
    for r in learned:
        for h, n in own[r["doc_id"]].items():
            counts[h, languages.index(r["lang"])] += n
    logs, prior = np.log(counts / counts.sum(0)), np.log(np.array([n_docs[x] for x in languages]) / len(learned))
    got = {r["doc_id"]: r for r in op10_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (g["lang_pred"], g["score"]) == ("und", 0)
            continue
        total = prior + sum(n * logs[h] for h, n in own[r["doc_id"]].items())
        assert g["lang_pred"] == languages[int(total.argmax())]
        assert g["score"] == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-2)
