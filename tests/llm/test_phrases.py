"""Collocations against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from haptrace.llm import catalog, phrases

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(" ".join(words[i:i + m]) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if a >= least and " " in p}
        cover = Counter()
        for phrase, a in candidates.items():
            words = phrase.split(" ")
            for inner in (" ".join(words[:2]), " ".join(words[1:])) if len(words) == 3 else ():
                cover[inner] = max(cover[inner], a)
        found = []
        for phrase, a in candidates.items():
            if phrase in cover and 100 * cover[phrase] >= 50 * a:
                continue
            words = phrase.split(" ")
            cuts = [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]
            score, k = min((1_000_000 * a * a // (c[x] * c[y]), k) for k, (x, y) in enumerate(cuts))
            found.append((-score, -a, phrase.encode(), c[cuts[k][0]], c[cuts[k][1]]))
        out += [(lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


SMALL = {"chunk_tokens": 300, "chunk_words": 90, "slice_bytes": 50, "tile": 4, "bits": 1 << 20}


def odd_rows():
    rng = np.random.default_rng(3)
    word = lambda: str(rng.choice(["The", "the", "of", "a\x00", "é", "中", "x" * 40, "und"]))
    gap = lambda: str(rng.choice([" ", "\t", "  ", " \t ", ", ", "\n", "\x0b", ".", " ! "]))
    text = lambda n: "".join(word() + gap() for _ in range(n))
    rows = [(lang, text(60)) for lang in ("en", None, "und", "a lang") for _ in range(12)]
    # Texts without an end of a piece, of one word alone, of separators alone; repeated rows.
    return rows + [("en", "to be " * 5000), ("en", "y" * 5000), ("en", " .,\t\n" * 100), ("en", ""), ("en", None), (None, None)] + [("fr", "l'été à la mer")] * 30


@pytest.mark.parametrize("layout", [{}, SMALL])
def test_odd_rows(spark, layout):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, rank int").repartition(3)
    assert rows_of(phrases.collocations(table, **layout)) == plain(rows)
    assert phrases.collocations(table.filter("false"), **layout).collect() == []


@pytest.mark.parametrize("layout", [{}, SMALL | {"chunk_tokens": 5000, "chunk_words": 4000}])
def test_query_matches_plain_counts(spark, layout):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = plain([(r["lang"], r["text"]) for r in docs.collect()])
    assert rows_of(phrases.collocations(docs, **layout)) == expected
    assert layout or rows_of(catalog.QUERIES["op13_phrases"](spark, SF)) == expected


@pytest.mark.parametrize("most", [1, 40, 5000])
def test_tiles_count_like_a_list(most):
    rng = np.random.default_rng(most)
    left, right = (np.minimum(rng.geometric(0.02, 20_000), most) - 1 for _ in range(2))
    a, b, counts = phrases.count_pairs(left, right, most, most, tile=8)
    assert dict(zip(zip(a.tolist(), b.tolist()), counts.tolist())) == Counter(zip(left.tolist(), right.tolist()))


def test_long_phrases(spark):
    docs = spark.createDataFrame([("en", "one two three four five six")] * 12 + [("en", "two three four")] * 3, "lang string, text string")
    found = phrases.collocations(docs, max_words=5)
    assert {r["phrase"]: r["a"] for r in found.collect()} == {"one two three four five": 12, "two three four five six": 12}
