"""Raking against a plain loop, shares of the sample, odd rows."""

import re

import numpy as np
import pytest

from haptrace.llm import catalog, mixing

SF = "/root/testdata/sf0.01"


def _plain_topic(text):
    for name, pattern in mixing.TOPICS:
        if re.search(pattern, text):
            return name
    return mixing.PROSE


def _plain_weights(rows, targets, keep):
    """rows: (classes, tokens); one margin after the other, by dictionaries."""
    margins = targets.margins()
    named = [tuple(c if c in m else mixing.OTHER for c, m in zip(classes, margins)) for classes, _ in rows]
    cells = {}
    for key, (_, n) in zip(named, rows):
        cells[key] = cells.get(key, 0) + n
    total = sum(cells.values())
    wanted, most = [], keep * total
    for m, shares in enumerate(margins):
        have = {c: sum(n for k, n in cells.items() if k[m] == c) for c in shares}
        alive = {c: s for c, s in shares.items() if have[c] > 0}
        alive = {c: s / sum(alive.values()) for c, s in alive.items()}
        wanted.append(alive)
        most = min([most, *(have[c] / s for c, s in alive.items())])
    weight = {k: most / total for k in cells}
    for _ in range(3000):
        for m, shares in enumerate(wanted):
            for c, s in shares.items():
                now = sum(n * min(1, weight[k]) for k, n in cells.items() if k[m] == c)
                for k in cells:
                    if k[m] == c and now > 0:
                        weight[k] *= s * most / now
    return {k: min(1, w) for k, w in weight.items()}, named


def test_query_matches_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in catalog.QUERIES["op8_mixing"](spark, SF).collect()}
    assert len(found) == len(rows)
    plain = [((r["source"], r["lang"], _plain_topic(r["text"])), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in rows]
    weights, named = _plain_weights(plain, catalog.TARGETS, mixing.KEEP)
    for r, (classes, n), key in zip(rows, plain, named):
        got = found[r["doc_id"]]
        assert (got["topic"], got["n_tokens"]) == (classes[2], n)
        assert got["probability"] == pytest.approx(weights[key], abs=1e-5)
    share = np.mean([r["sampled"] for r in found.values()])
    assert share == pytest.approx(np.mean([r["probability"] for r in found.values()]), abs=0.05)


def test_margins_hold_in_expectation():
    rng = np.random.default_rng(1)
    cells = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = rng.uniform(50, 100, len(cells)) * np.where(cells[:, 0] == 0, 8, 1)
    margins = [np.array([0.25] * 4), np.array([0.4, 0.3, 0.3]), np.array([0.5, 0.5])]
    weights, miss = mixing.rake(cells, tokens, margins, 0.3)
    assert miss < 1e-8 and weights.max() <= 1
    for m, shares in enumerate(margins):
        got = np.bincount(cells[:, m], tokens * weights)
        assert np.allclose(got / got.sum(), shares)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, 1), (1, None, None, None, 1), (None, "a b", "src0", "en", 2), (None, "a b", "src0", "en", 2), (3, "", "zz", "xx", 3)],
        "doc_id long, text string, source string, lang string, topic int")
    found = mixing.mix(docs, catalog.TARGETS).collect()
    assert len(found) == 5 and sorted(r["n_tokens"] for r in found) == [0, 0, 0, 2, 2]
    assert len({r["sampled"] for r in found if r["n_tokens"] == 2}) == 1
    assert mixing.keep_mixed(docs, catalog.TARGETS).schema == docs.schema
    assert mixing.mix(docs.limit(0), catalog.TARGETS).collect() == []
    assert mixing.keep_mixed(docs.limit(0), catalog.TARGETS).collect() == []


def test_a_few_odd_rows_do_not_shrink_the_whole(spark):
    targets = mixing.Targets(source={"a": 0.5, "b": 0.5}, lang={"en": 0.6, "fr": 0.4}, topic={"prose": 1.0})
    text = "some plain words " * 20
    rows = [(i, text, "ab"[i % 2], "en" if i % 10 < 6 else "fr") for i in range(1000)]
    docs = spark.createDataFrame([*rows, (1000, text, "a", None), (1001, text, None, "en"), (1002, text, "z", "fr")],
                                 "doc_id long, text string, source string, lang string")
    found = mixing.mix(docs, targets).collect()
    kept = sum(r["n_tokens"] * r["probability"] for r in found) / sum(r["n_tokens"] for r in found)
    assert kept == pytest.approx(mixing.KEEP, abs=1e-6)
    assert found[0]["margin_error"] < 1e-6


def test_a_large_other_class_gets_its_target():
    cells = np.array([(0, 0), (1, 0), (0, 1), (1, 1)])
    tokens = np.array([30.0, 30.0, 25.0, 15.0])
    margins = [np.array([0.9, 0.1]), np.array([0.8, 0.2])]
    weights, miss = mixing.rake(cells, tokens, margins, 0.3, other=True)
    assert miss < 1e-8
    for m, shares in enumerate(margins):
        assert np.allclose(np.bincount(cells[:, m], tokens * weights), shares * 30)
