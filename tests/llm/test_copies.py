"""Exact and near copies against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from haptrace.llm import exact_dedup, simhash
from haptrace.llm.blocks import merged
from haptrace.llm.components import components

WORDS = [f"w{i}" for i in range(60)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "a", "A", "a b", "a  b\n", "ab", " ", "x y"]
    base = [_text(rng, 80) for _ in range(12)] + [_text(rng, 4000)]
    for t in base:
        texts += [t, t, t.replace(" ", "  ", 3), t.upper(), t + " w1", t.replace("w3", "w4", 1)]
    texts += [base[0]] * 40
    near = base[1].split()
    for i in range(60):
        copy = list(near)
        copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3, texts[k], "en", f"s{k % 3}", k) for i, k in enumerate(order)]


SCHEMA = "doc_id long, text string, lang string, component_id string, kept int"


def _plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(ids, links):
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def test_exact_copies_match_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in exact_dedup.find_copies(docs).collect()}
    assert len(found) == len(rows)
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    for r in rows:
        group = [q for q in rows if norm[q[0]] == norm[r[0]]]
        keep = min(group, key=lambda q: (-len(q[1] or ""), q[0]))[0]
        got = found[r[0]]
        assert (got["keep_id"], got["group_size"], got["kept"]) == (keep, len(group), keep == r[0])
        assert got["text_sha256"] == hashlib.sha256(norm[r[0]].encode()).hexdigest()
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_exact_copies_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "t"), (1, "t"), (1, "t"), (None, "t"), (None, "u"), (None, "u"), (2, None)], "doc_id long, text string")
    found = exact_dedup.find_copies(docs).collect()
    assert sum(r["kept"] for r in found) == 3 and len(found) == 7
    assert {r["keep_id"] for r in found if r["group_size"] == 4} == {1}
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact_dedup.keep_one(docs).collect()) == [(0, "u"), (1, "t"), (2, "")]


def test_copies_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for result in (exact_dedup.find_copies(docs), exact_dedup.keep_one(docs), simhash.near_copies(docs), simhash.keep_one(docs)):
        assert result.collect() == []


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_near_copies_match_brute_force(spark, rows, block_rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in simhash.near_copies(docs, block_rows=block_rows).collect()}
    prints = {r[0]: _plain_print(r[1]) for r in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in found.items()} == _plain_components(ids, links)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found.values()}


def test_near_copies_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "A b  c d"), (None, "other words stand here"), (7, None)], "doc_id long, text string")
    found = sorted((r["fingerprint"], r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect() if r["doc_id"])
    assert [r[1:] for r in found] == [(7, 7), (5, 5)] or [r[1:] for r in found] == [(5, 5), (7, 7)]
    assert len(simhash.keep_one(docs).collect()) == 3


def test_all_links_survive_the_pivot_table(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.append(x)
        for bits in (1, 2, 3, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            prints.append(y)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    links = simhash.class_links(spark.createDataFrame(signed, "fp long, rep long"), block_rows=3)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    expected = _plain_components(range(len(prints)), pairs)
    assert {i: found.get(i, i) for i in range(len(prints))} == expected


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(3, 3), (900, 901), (901, 900)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e} - {3}
    expected = _plain_components(nodes, [e for e in edges if e[0] != 3])
    assert {n: found.get(n, n) for n in nodes} == expected
    import numpy as np
    assert merged(3, np.array([0, 1]), np.array([1, 2]), np.array([9, 8, 7])).tolist() == [7, 7, 7]


def test_any_white_space_between_words_counts_the_same():
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 300):
        words = [rng.choice(WORDS) for _ in range(n)]
        plain = _plain_print(" ".join(words))
        for space in "\t\n\v\f\r ":
            assert simhash.fingerprint(space.join(words)) == plain
        for _ in range(20):
            mixed = "".join(w + "".join(rng.choices("\t\n\v\f\r ", k=rng.randint(1, 3))) for w in words)
            assert simhash.fingerprint(rng.choice(["", "\n", " \t"]) + mixed) == plain


def test_given_documents_match_the_plain_print(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert simhash.fingerprint(r["text"]) == _plain_print(r["text"])


def test_line_breaks_do_not_hide_near_copies(spark):
    rng = random.Random(4)
    words = [rng.choice(WORDS) for _ in range(50)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words)), (3, "\r\n\t".join(words))], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_copies(docs).collect()} == {1}
    assert [r["doc_id"] for r in simhash.keep_one(docs).collect()] == [1]


def test_one_row_stays_of_each_component(spark):
    """Ids that repeat with near or far texts, null ids, and rows that agree in all columns."""
    base = [f"w{n}" for n in range(400)]
    near = " ".join([*base[:-1], "other"])
    far = " ".join(f"v{n}" for n in range(60))
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(near)).bit_count() <= 3
    rows = [(1, " ".join(base), "a"), (1, near, "b"), (1, near, "b"), (None, far, "c"), (None, far, "c"), (None, far, "d"), (1, "quite another text", "e"), (2, near, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert len(kept) == 3 and len(set(kept)) == 3 and {r[1] for r in kept if r[0] is None} == {far}
    assert (1, "quite another text", "e") in kept
    found = simhash.near_copies(docs).collect()
    assert len(found) == len(rows) and {r["component_id"] for r in found} == {1, None}


def test_the_pivot_table_discards_pairs():
    """In one bucket of unrelated fingerprints nearly all pairs go before the fingerprints are compared, and no link does."""
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 63, size=600, dtype=np.uint64)
    fps[300:] = fps[:300] ^ np.uint64(5)
    table = simhash.distance_table(fps, simhash.reference_fingerprints())
    order = np.argsort(table[:, 0], kind="stable")
    frame = pd.DataFrame({"key": 1, "lo": 0, "hi": 0, "side": 0, "fp": fps[order].view(np.int64), "first": table[order, 0].astype(np.int32),
                          "table": [r.tobytes() for r in table[order]]})
    met = [(i, j) for a, b in simhash.surviving_pairs(frame, ["key", "lo", "hi"], 3) for i, j in zip(a.tolist(), b.tolist())]
    linked = {(i, j) for i, j in met if int(fps[order][i] ^ fps[order][j]).bit_count() <= 3}
    assert len(linked) == 300 and len(met) < 0.01 * 600 * 599 / 2
