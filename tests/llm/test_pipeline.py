from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from estima.llm import queries, toxicity
from estima.llm.common import table
from estima.llm.mixing import mix_sources
from tests.llm.test_jaccard import plain_components
from tests.llm.test_secret_scan import spans_of
from estima.llm.secret_scan import BASE_RULES, MORE_RULES

SF = "/root/testdata/sf0.01"


def test_stages_and_their_columns(spark):
    docs = table(spark, SF, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_against_a_plain_version(spark):
    """Each stage again in plain Python; toxicity, a fitted model, is asked for its decisions."""
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.grade_documents(docs, model).where("rejected").collect()}
    assert bad
    left = [(i, rows[i]["text"]) for i in rows if i not in bad]
    kept = [i for i, n, c in plain_components(left, 5, 80) if i == c or n == 0]
    assert len(kept) < len(left)
    texts = {}
    rules = BASE_RULES + MORE_RULES
    for i, spans in zip(kept, spans_of([rows[i]["text"] for i in kept], rules), strict=True):
        out, done = "", 0
        for a, _, b in spans:
            if a >= done:
                out += rows[i]["text"][done:a] + "[secret]"
            done = max(done, b)
        texts[i] = out + (rows[i]["text"] or "")[done:]
    again = spark.createDataFrame([(i, texts[i], rows[i]["source"]) for i in kept], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(again).collect()}
    reference = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter({i: n for i, n in copies.items() if n})
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == want
    for r in got:
        assert r["ids"] == reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_queries_have_their_names():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_duckdb(spark, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in want)


LONG = "plain words of a very long text that goes on " * 20_000
ODD = [
    (1, "one text of some seven words here", "s"), (1, "one text of some seven words here", "s"), (2, "One text of some seven words here", "s"),
    (3, None, "s"), (4, "", "s"), (None, "a row without an id, kept as it is", None), (5, LONG, "s"), (6, LONG, "t"), (7, "tie tie tie tie tie tie", "t"),
    (8, "here is password=hunter2hunter2 in the text", None), (9, " \t\n ", "t"), (10, "two", "t"), (11, "é中文🙂 <|endoftext|> " * 3, "t"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, copies int, ids string, toxicity double, mix_row string, node long, tags map<string,int>"


def odd_tables(spark, path, rows):
    docs = [(i, t, None, s, len(t or ""), 7, "x", 0.5, None, 3, {"a": 1}) for i, t, s in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and long texts, copies, repeated rows and columns named like those that the stages make."""
    d = odd_tables(spark, tmp_path, ODD)
    docs = table(spark, d, "documents")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(seen[0], key=key) == sorted([x[:2] for x in ODD], key=key)  # without toxic labels nothing is rejected
    # of the copies the smallest id stays, once; rows without words, and without an id, stay
    assert [i for i, _ in sorted(seen[1], key=key)] == [1, 3, 4, 5, 7, 8, 9, 10, 11, None]
    assert dict(seen[2])[8] == "here is [secret] in the text" and dict(seen[2])[3] is None
    assert not {3, 4, 9} & {i for i, _ in seen[3]} and {i for i, _ in seen[3]} <= {i for i, _ in seen[2]}  # the mix takes no empty text
    reference = Tokenizer.from_file(queries.tokenizer_path())
    got = corpus_pipeline.run(spark, d).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in seen[3])
    texts = dict(seen[2])
    assert all(r["ids"] == reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in got)


def test_an_empty_table(spark, tmp_path):
    got = corpus_pipeline.run(spark, odd_tables(spark, tmp_path, []))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and got.collect() == []
