import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from estima.llm import bpe
from estima.llm.queries import op4_bpe_round_trip, tokenizer_path

ALPHABET = [*"abcdeIt's'  \n\t 123.,!?-", "é", "ß", "中", "😀", "'ll", "'re", " ", " ", "Ⅷ", "   ", "\r\n", "<|endoftext|>", "<|end", "́", "\0", "👩‍👩"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("bits, least, most", [(1, 3, 16384), (2, 3, 16384), (5, 8, 64), (30, 4, 40), (10, 256, 16384)])
def test_chunks_give_the_tokenizers_ids(monkeypatch, reference, bits, least, most):
    """Small chunks make many joins; chunks are cut anywhere, in words, in white space, beside contractions."""
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "LEAST", least)
    monkeypatch.setattr(bpe, "MOST", most)
    store, rng = bpe.ChunkStore(bpe.codec(tokenizer_path())), random.Random(bits)
    for _ in range(1500):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 150)))
        want = reference.encode(text, add_special_tokens=False).ids
        assert store.encode(text).tolist() == want
        assert store.codec.decode(want) == reference.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 50_000, "ab " * 30_000, "\n" * 40_000, "x" * 20_000 + " " * 20_000 + "é" * 20_000, "1" * 40_000, "don't " * 9_000, "中" * 20_000])
def test_long_and_repetitive(reference, text):
    store = bpe.ChunkStore(bpe.codec(tokenizer_path()))
    assert store.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(spark, sf):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r["text"] and len(r["text"]) > 4000]
    store = bpe.ChunkStore(bpe.codec(tokenizer_path()))
    for t in texts:
        store.encode(t)
    encoded = store.encoded
    for t in texts:
        store.encode(f"A new beginning. {t}")
    assert store.encoded - encoded <= 0.5 * store.reused  # the cuts find each other again


def test_store_stays_within_its_bound():
    store = bpe.ChunkStore(bpe.codec(tokenizer_path()), most=100_000)
    rng = random.Random(1)
    for _ in range(50):
        store.encode("".join(rng.choices("abcdefgh ", k=5000)))
    assert store.held <= 100_000


def test_cut_points_depend_on_content_only():
    data = np.frombuffer(random.Random(2).randbytes(50_000).translate(bytes(97 + i % 26 for i in range(256))), np.uint8)
    whole, moved = set(bpe.cut_points(data).tolist()), {int(x) - 777 for x in bpe.cut_points(np.concatenate([data[:777], data]))}
    assert len(whole & moved) >= 0.8 * len(whole)
    assert bpe.cut_points(data[:0]).tolist() == [] and bpe.cut_points(data[:5]).tolist() == [5]


def test_operator_edges(spark, reference):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello <|endoftext|> world", "z"), (3, "Hello <|endoftext|> world", "z"), (None, "é" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode_documents(bpe.encode_documents(df, tokenizer_path()), tokenizer_path()).collect()
    assert len(got) == 5
    for r in got:
        assert r["ids"] == reference.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.encode_documents(df.limit(0), tokenizer_path()).count() == 0


def test_query_against_the_library(spark, sf, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op4_bpe_round_trip(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
