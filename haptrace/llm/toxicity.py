"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field tags every word of a text as clean or toxic. A word's features are itself, its beginnings
and its ending; neighbouring tags are tied by transition weights. Only documents carry labels, so
words are labelled first: a feature whose documents are toxic far beyond chance (binomial tail
under ``MARKER_CHANCE``) marks the words that have it in toxic documents; all words of clean documents
are clean. The field is then trained by the gradient of its log-likelihood, and its marginals, by
forward and backward passes over the whole text, give the offsets (marginal of 0.5 or more) and the
document's features: expected number of toxic words, chance of at least one, largest marginal.
A logistic curve over these, fitted on documents that the field was not trained on, gives the score.

Training uses a bounded sample of labelled rows: about ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` rows drawn by a
hash of the id, of at most ``SAMPLE_CHARS`` characters each; of near copies (same least word hash and
label) one is used. Scoring reads all of every text; long texts are cut into chunks whose transfer
matrices are multiplied, which is exact.

Defined results
* A null or empty text has no span and the score of a text without toxic words.
* Ids with contradicting or null labels are not learnt from; with no toxic or no clean row in the
  sample every score is the share of toxic rows (0 without any row).
* Repeated rows get equal results; an empty table gives an empty result; result columns replace
  those of the same name, other columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 9000
SAMPLE_CHARS = 12_000
FIELD_CLEAN = 1500
MARKER_CHANCE = 1e-5
MARKER_SHARE = 0.8
EPOCHS = 40
CHUNK = 64
BATCH_CHARS = 4_000_000
PREFIXES = (3, 4, 5, 6, 7)
# Features that an unseen word of a family still has; half of the words are trained with these alone.
GENERAL = "345"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Field:
    """Weights of features (for the toxic tag), transitions [from, to], start, and the score's curve."""

    weights: dict[str, float]
    transitions: np.ndarray
    start: np.ndarray
    curve: np.ndarray
    share: float = 0.0


def word_features(word: str) -> list[str]:
    word = word.lower()
    return [f"={word}", *(f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k), f"-{word[-4:]}"]


class Chain:
    """Forward-backward over many sequences of two tags at once, by chunks of fixed length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.chunks = -(-lengths // CHUNK)
        total = int(self.chunks.sum())
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, dtype=np.int64)
        self.first_chunk = np.concatenate([[0], np.cumsum(self.chunks)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths)), self.chunks)
        rank = np.arange(total) - self.first_chunk[owner]
        place = rank[:, None] * CHUNK + np.arange(CHUNK)
        self.real = (place < lengths[owner][:, None]).T
        self.at = np.where(self.real, (begin[owner][:, None] + place).T, 0)
        self.heads = self.first_chunk[lengths > 0]
        self.total = int(lengths.sum())

    def run(self, emission: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward and backward messages, flat, (tokens, 2)."""
        step = np.exp(transitions)
        push = np.exp(np.clip(emission, -30, 30))
        rows = self.at.shape[1]
        matrices = []
        for t in range(CHUNK):
            real, e = self.real[t], push[self.at[t]] if self.total else np.ones(rows)
            m = [np.where(real, step[0, 0], 1.0), np.where(real, step[0, 1] * e, 0.0), np.where(real, step[1, 0], 0.0), np.where(real, step[1, 1] * e, 1.0)]
            if t == 0 and len(self.heads):
                h = self.heads
                m[0][h] = m[2][h] = np.exp(start[0])
                m[1][h] = m[3][h] = np.exp(start[1]) * e[h]
            matrices.append(m)
        p = [np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)]
        for a, b, c, d in matrices:
            p = [p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d]
            scale = 1 / (p[0] + p[1] + p[2] + p[3])
            p = [x * scale for x in p]
        into, out = self._carry(p)
        forward, backward = np.zeros((self.total, 2)), np.zeros((self.total, 2))
        x, y = into
        for t, (a, b, c, d) in enumerate(matrices):
            x, y = x * a + y * c, x * b + y * d
            scale = 1 / (x + y)
            x, y = x * scale, y * scale
            forward[self.at[t][self.real[t]]] = np.stack([x[self.real[t]], y[self.real[t]]], axis=1)
        x, y = out
        for t in range(CHUNK - 1, -1, -1):
            backward[self.at[t][self.real[t]]] = np.stack([x[self.real[t]], y[self.real[t]]], axis=1)
            a, b, c, d = matrices[t]
            x, y = a * x + b * y, c * x + d * y
            scale = 1 / (x + y)
            x, y = x * scale, y * scale
        return forward, backward

    def _carry(self, p: list[np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Messages that enter each chunk from the left and from the right."""
        rows = len(p[0])
        left, right = np.ones((2, rows)) * 0.5, np.ones((2, rows)) * 0.5
        longest = int(self.chunks.max()) if len(self.chunks) else 0
        order = np.argsort(-self.chunks, kind="stable")
        counts = self.chunks[order]
        for r in range(longest - 1):
            at = self.first_chunk[order[: np.searchsorted(-counts, -(r + 1), side="left")]] + r
            x, y = left[0, at] * p[0][at] + left[1, at] * p[2][at], left[0, at] * p[1][at] + left[1, at] * p[3][at]
            left[0, at + 1], left[1, at + 1] = x / (x + y), y / (x + y)
        for r in range(longest - 1, 0, -1):
            at = self.first_chunk[order[: np.searchsorted(-counts, -r, side="left")]] + r
            x, y = p[0][at] * right[0, at] + p[1][at] * right[1, at], p[2][at] * right[0, at] + p[3][at] * right[1, at]
            right[0, at - 1], right[1, at - 1] = x / (x + y), y / (x + y)
        return (left[0], left[1]), (right[0], right[1])


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


class Tagger:
    """The field applied to batches of texts."""

    def __init__(self, field: Field):
        self.field = field

    def emissions(self, words: list[str]) -> np.ndarray:
        get = self.field.weights.get
        return np.array([sum(get(f, 0.0) for f in word_features(w)) for w in words])

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, expected toxic words, and the offsets of each text's toxic words."""
        number: dict[str, int] = {}
        codes = []
        for text in texts:
            words = WORD.findall(text or "")
            for w in words:
                if w not in number:
                    number[w] = len(number)
            codes.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32)
        emission = self.emissions(list(number))[flat] if len(flat) else np.zeros(0)
        chance = marginals(*Chain(lengths).run(emission, self.field.transitions, self.field.start)) if len(flat) else np.zeros(0)
        features = document_features(chance, lengths)
        scores = curve_scores(self.field, features)
        spans: list[list[tuple[int, int]]] = []
        ends = np.cumsum(lengths)
        for text, end, n in zip(texts, ends.tolist(), lengths.tolist()):
            toxic = np.flatnonzero(chance[end - n: end] >= 0.5)
            if len(toxic):
                wanted = set(toxic.tolist())
                spans.append([m.span() for i, m in enumerate(WORD.finditer(text)) if i in wanted])
            else:
                spans.append([])
        return scores, features[:, 0], spans


def document_features(chance: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, 3): expected toxic words, -log of the chance of none, largest marginal."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(lengths)
    largest = np.zeros(n)
    np.maximum.at(largest, owner, chance)
    none = -np.log1p(-np.minimum(chance, 1 - 1e-9))
    return np.stack([np.bincount(owner, chance, minlength=n), np.bincount(owner, none, minlength=n), largest], axis=1)


def _inputs(features: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(features), 1)), np.log1p(features[:, :1]), np.log1p(features[:, 1:2]), features[:, 2:]], axis=1)


def curve_scores(field: Field, features: np.ndarray) -> np.ndarray:
    if not len(field.curve):
        return np.full(len(features), field.share)
    return 1 / (1 + np.exp(-np.clip(_inputs(features) @ field.curve, -30, 30)))


def _tail(hits: np.ndarray, total: np.ndarray, share: float) -> np.ndarray:
    """Chance of ``hits`` or more toxic documents among ``total`` at this share; an upper bound by the geometric tail."""
    log_choose = np.array([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for k, n in zip(hits, total)])
    first = log_choose + hits * np.log(share) + (total - hits) * np.log1p(-share)
    ratio = np.minimum((total - hits) / (hits + 1) * share / (1 - share), 0.999)
    return np.exp(first) / (1 - ratio)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> Field:
    """From (text, label) rows."""
    rows = _without_copies(rows)
    toxic = sum(y for _, y in rows)
    share = toxic / len(rows) if rows else 0.0
    blank = Field({}, np.zeros((2, 2)), np.array([0.0, -5.0]), np.zeros(0), share)
    if not 0 < toxic < len(rows):
        return blank
    number: dict[str, int] = {}
    words: dict[str, int] = {}
    of_word: list[list[int]] = []
    codes = []
    for text, _ in rows:
        found = WORD.findall(text)
        for w in found:
            if w not in words:
                words[w] = len(words)
                of_word.append([number.setdefault(f, len(number)) for f in word_features(w)])
        codes.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
    width = 2 + len(PREFIXES)
    table = np.full((len(of_word), width), len(number), dtype=np.int64)
    for i, found in enumerate(of_word):
        table[i, : len(found)] = found
    held = np.zeros((2, len(number) + 1))
    for code, (_, y) in zip(codes, rows):
        held[y][np.unique(table[code])] += 1
    hits, total = held[1], held.sum(axis=0)
    likely = np.flatnonzero((hits[:-1] >= 3) & (hits[:-1] >= MARKER_SHARE * total[:-1]))
    marker = np.zeros(len(number) + 1, dtype=bool)
    marker[likely[_tail(hits[likely], total[likely], share) < MARKER_CHANCE]] = True
    marked = marker[table].any(axis=1)
    tags = [marked[c] & (y == 1) for c, (_, y) in zip(codes, rows)]
    # Even rows train the field, odd ones the curve; toxic documents without a marked word teach the field nothing.
    training = [i for i, (_, y) in enumerate(rows) if i % 2 == 0 and (not y or tags[i].any())]
    clean = [i for i in training if not rows[i][1]][:FIELD_CLEAN]
    training = [i for i in training if rows[i][1]] + clean
    if not any(tags[i].any() for i in training):
        return blank
    kept = np.flatnonzero(total[:-1] >= 2)
    renumber = np.full(len(number) + 1, len(kept), dtype=np.int64)
    renumber[kept] = np.arange(len(kept))
    table = renumber[table]
    names = list(number)
    general = np.array([names[k][0] in GENERAL for k in kept] + [False])
    weights, transitions, start = _train([codes[i] for i in training], [tags[i] for i in training], table, general, epochs)
    field = Field({names[k]: float(w) for k, w in zip(kept, weights) if abs(w) > 1e-3}, transitions, start, np.zeros(0), share)
    emission = np.append(weights, 0.0)[table].sum(axis=1)
    judged = [i for i in range(len(rows)) if i % 2] or list(range(len(rows)))
    lengths = np.array([len(codes[i]) for i in judged], dtype=np.int64)
    flat = np.concatenate([codes[i] for i in judged])
    chance = marginals(*Chain(lengths).run(emission[flat], transitions, start))
    field.curve = _curve(_inputs(document_features(chance, lengths)), np.array([rows[i][1] for i in judged]))
    return field


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    seen, out = set(), []
    for text, y in rows:
        key = (y, min((zlib.crc32(w.encode("utf-8", "surrogatepass")) * 2654435761 % (1 << 32) for w in set(WORD.findall(text))), default=0))
        if key not in seen:
            seen.add(key)
            out.append((text, y))
    return out


def _train(codes: list[np.ndarray], tags: list[np.ndarray], table: np.ndarray, general: np.ndarray, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the field's penalised log-likelihood."""
    size = len(general) - 1
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    every = np.concatenate(codes)
    table = np.concatenate([table, np.where(general[table], table, size)])
    every = every + np.random.default_rng(7).integers(0, 2, len(every)) * (len(table) // 2)
    used, flat = np.unique(every, return_inverse=True)
    table = table[used]
    y = np.concatenate(tags).astype(np.int64)
    chain = Chain(lengths)
    heads = (np.cumsum(lengths) - lengths)[lengths > 0]
    later = np.ones(len(y), dtype=bool)
    later[heads] = False
    later = np.flatnonzero(later)
    seen = np.bincount(y[later - 1] * 2 + y[later], minlength=4).reshape(2, 2)
    seen_first = np.bincount(y[heads], minlength=2)
    value = {"w": np.zeros(size + 1), "t": np.array([[0.0, -4.0], [0.0, -1.0]]), "s": np.array([0.0, -4.0])}
    first, second = ({k: np.zeros_like(v) for k, v in value.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        by_word = value["w"][table].sum(axis=1)
        emission = by_word[flat]
        forward, backward = chain.run(emission, value["t"], value["s"])
        chance = marginals(forward, backward)
        after = backward[later] * np.stack([np.ones(len(later)), np.exp(np.clip(emission[later], -30, 30))], axis=1)
        pairs = forward[later - 1][:, :, None] * np.exp(value["t"])[None] * after[:, None, :]
        expected = (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        expected_first = np.array([(1 - chance[heads]).sum(), chance[heads].sum()])
        miss = np.bincount(flat, y - chance, minlength=len(table))
        slope = {"w": np.bincount(table.ravel(), np.repeat(miss, table.shape[1]), minlength=size + 1) - 0.05 * value["w"],
                 "t": seen - expected - 0.01 * value["t"], "s": seen_first - expected_first - 0.01 * value["s"]}
        slope["w"][size] = 0
        for k in value:
            first[k] = 0.9 * first[k] + 0.1 * slope[k]
            second[k] = 0.99 * second[k] + 0.01 * slope[k] ** 2
            value[k] = value[k] + 0.2 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return value["w"][:size], value["t"], value["s"]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic curve by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic: int, clean: int) -> list[tuple[str, int]]:
    """(text, label) of about so many rows of each label, in a fixed order."""
    sure = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    sure = sure.filter(F.col("y") == F.col("z")).select(F.col(id_col).alias("__id"), "y")
    counts = {r["y"]: r["count"] for r in sure.groupBy("y").count().collect()}
    chance = F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.when(F.col("y") == 1, toxic / max(1, counts.get(1, 0))).otherwise(clean / max(1, counts.get(0, 0)))
    chosen = sure.withColumn("c", chance).filter(F.col("c") < limit)
    # About toxic + clean narrow rows at most, whatever the table's size.
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    rows = found.filter(F.length("text") <= SAMPLE_CHARS).select("c", "text", "y").collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["c"], r["text"]))]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    return fit(sample(docs, labels, id_col, text_col, label_col, SAMPLE_TOXIC, SAMPLE_CLEAN))


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with score, toxic_words (expected) and toxic_spans (offsets in code points, end exclusive)."""
    results = ("score", "toxic_words", "toxic_spans")
    kept = [c for c in docs.columns if c != text_col and c not in results] + [text_col]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType()).add("toxic_words", T.DoubleType()).add("toxic_spans", span)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            for piece in _bounded(batch):
                scores, expected, spans = tagger.tag(piece.column(len(kept) - 1).to_pylist())
                spans = [[{"start": s, "end": e} for s, e in found] for found in spans]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores), pa.array(expected), pa.array(spans, kind)], names=[*kept, *results])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from haptrace.llm.bpe import bounded

    return bounded(batch, batch.num_columns - 1, BATCH_CHARS)
