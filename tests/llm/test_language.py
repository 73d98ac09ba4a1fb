"""Windows, accuracy on held-out rows and odd texts."""

import zlib

import numpy as np
import pytest

from haptrace.llm import catalog, langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    return catalog.language_network(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy_of_the_query(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = catalog.QUERIES["op6_langid"](spark, SF).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_windows_cover_the_whole_text():
    texts = [b"", b"a", bytes(range(1, 256)) * 9, b"x" * langid.WINDOW, b"y" * (langid.WINDOW + 1)]
    cut, owner, sizes = langid.windows(texts)
    for n, text in enumerate(texts):
        rows = cut[owner == n]
        assert b"".join(r[:k].tobytes() for r, k in zip(rows[:, : langid.WINDOW], sizes[owner == n])) == text
        for place, row in enumerate(rows):
            follows = text[(place + 1) * langid.WINDOW:][: 3]
            assert row[langid.WINDOW:].tobytes() == follows.ljust(3, b"\0")


def test_tables_equal_the_network(network):
    rng = np.random.default_rng(0)
    cut = rng.integers(0, 256, (5, langid.WINDOW + 3)).astype(np.uint8)
    pooled = []
    for w, f in network.filters.items():
        found = sum(network.embedding[cut[:, j: j + langid.WINDOW]] @ f[j] for j in range(w))
        pooled.append(found.max(axis=1))
    logits = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.dense + network.offset
    plain = logits - np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - logits.max(axis=1, keepdims=True)
    assert np.allclose(langid.Predictor(network).log_chances(cut), plain, atol=0.05)


def test_odd_texts_and_clashing_columns(spark, network):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, " 12 !? \n", 5), (4, "é", 5), (5, "The thing and the other are in the house " * 9000, 5), (None, "der die und das nicht", 5)],
        "doc_id long, text string, score int")
    rows = {r["doc_id"]: r for r in langid.predict(docs, network).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[4]["lang_pred"] in network.languages and rows[5]["lang_pred"] == "en"
    kept = langid.keep_known(docs, network)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} >= {5}
    assert langid.predict(docs.limit(0), network).collect() == []


def test_training_without_rows_knows_nothing(spark):
    empty = spark.createDataFrame([(1, None, "en"), (None, "text", "en"), (2, "text", None)], "doc_id long, text string, lang string")
    network = langid.fit(empty)
    assert network.languages == []
    assert {r["lang_pred"] for r in langid.predict(empty, network).collect()} == {"und"}
