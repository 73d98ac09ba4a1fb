"""Messages against sums over all tag sequences, and what is learnt from labelled rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from haptrace.llm import catalog, toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_match_all_sequences(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 3, 8, 0, 2, 9])
    emission = rng.normal(size=lengths.sum()) * 2
    transitions, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    found = toxicity.marginals(*toxicity.Chain(lengths).run(emission, transitions, start))
    at = 0
    for n in lengths:
        own = emission[at: at + n]
        total, hit = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(e for e, t in zip(own, tags) if t) + (start[tags[0]] if n else 0) + sum(transitions[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            hit += weight * np.array(tags)
        assert np.allclose(found[at: at + n], hit / total)
        at += n


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(3, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile", "zork" + rng.choice(words)]))
        rows.append((" ".join(text), int(toxic)))
    return toxicity.fit(rows)


def test_spans_and_scores(spark, field):
    texts = {1: "a tale of rain and a vile one", 2: "rain and stone", 3: "", 4: None, 5: "ßé zorkunseen, on " + "rain tone " * 5000 + "VILE", 6: "12 ?!"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "vile", "x")], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, field).collect()}
    cut = {i: [texts[i][s["start"]: s["end"]] for s in rows[i]["toxic_spans"]] for i in (1, 2, 5)}
    assert cut == {1: ["vile"], 2: [], 5: ["zorkunseen", "VILE"]}
    assert rows[1]["score"] > 0.5 and rows[5]["score"] > 0.5 and rows[None]["score"] > 0.5
    assert rows[2]["score"] < 0.5 and rows[3]["score"] == rows[4]["score"] == rows[6]["score"] < 0.5
    assert toxicity.score(docs.limit(0), field).collect() == []


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (1, 0)], [(1, None), (None, 1)], [(1, 1)], [(1, 0), (2, 1)]):
        field = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, field).collect())


def test_query_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = catalog.QUERIES["op1_toxicity"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) >= 0.95 and sum(p > y for p, y in held) <= 1
