"""Ids and texts against the tokenizers library."""

import os
import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from haptrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "aaaaaaaaaaaaaaaa aaaa aaa", "The quick brown fox isn't they'll 'S 's ſ", "x<|endoftext|> y<|endoftext|><|endoftext|>",
    "a\x1cb \x85 c\x00", "日本語 ünïcödé 🤦🏼‍♂️   z᠎", "1234567 89,0.1   ", "   leading", "tab\t\ttab \t x", "<|endoftext", "éé́éé" * 50, "z" * 20_000,
]


def _random_texts():
    rng = random.Random(3)
    letters = "abcdehinorst  '\n\t.,!?0123éß中🙂<|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(60)] + ["".join(rng.choice("ab ") for _ in range(3000))]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_match_the_library(spark, library):
    texts = TEXTS + _random_texts()
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert list(row["ids"]) == expected
        assert row["decoded"] == library.decode(expected, skip_special_tokens=False) == (texts[row["doc_id"]] or "")


def test_batches_do_not_change_ids(library, monkeypatch):
    vocab = bpe.vocabulary(PATH)
    texts = [t or "" for t in TEXTS] + _random_texts()
    for name, small in (("SLICE_CHARS", 300), ("SLICE_WORDS", 7), ("MERGE_BYTES", 40), ("POOL_WORDS", 50)):
        monkeypatch.setattr(bpe, name, small)
    for text, ids in zip(texts, bpe.encode_texts(texts, vocab), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_and_empty_tables(spark, library):
    vocab = bpe.vocabulary(PATH)
    ids = library.encode("日", add_special_tokens=False).ids
    assert bpe.decode_ids(ids[:1], vocab) == library.decode(ids[:1], skip_special_tokens=False)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(nothing, PATH).first()["decoded"] == ""


def test_memory_is_bounded(library):
    """All-different words in short texts, and one text of 50 MB: a worker's peak is its pool, or a few times the ids."""
    script = """
import random, resource, sys
from haptrace.llm import bpe
vocab = bpe.vocabulary(sys.argv[1])
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
rng = random.Random(5)
many = lambda n: "".join(f" {rng.getrandbits(64):x}" for _ in range(n))
texts = [many(200) for _ in range(2500)]
before = peak()
pool = bpe.Pool(vocab)
ids = bpe.encode_texts(texts, vocab, pool)
short = peak() - before
assert all(bpe.restores(t, x, vocab) for t, x in zip(texts, ids))
text = many(100_000) * 30
before = peak()
ids = bpe.encode_texts([text], vocab, pool)[0]
assert bpe.restores(text, ids, vocab)
print(short, peak() - before, len(text) >> 20, len(ids) * 4 >> 20)
"""
    root = str(Path(__file__).resolve().parents[2])
    found = subprocess.run([sys.executable, "-c", script, PATH], capture_output=True, text=True, cwd=root, check=True, env={**os.environ, "PYTHONPATH": root})
    short, long, chars, ids = map(int, found.stdout.split())
    assert short < 250 and chars > 45 and long < 6 * ids


def test_a_long_word_is_cut_where_no_token_reaches(library, monkeypatch):
    monkeypatch.setattr(bpe, "MERGE_BYTES", 64)
    vocab = bpe.vocabulary(PATH)
    rng = random.Random(6)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "qzxjkvw", "z"):
        text = "".join(rng.choice(letters) for _ in range(4000))
        assert bpe.encode_texts([text], vocab)[0].tolist() == library.encode(text, add_special_tokens=False).ids
