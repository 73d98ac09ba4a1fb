"""Language of a text by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length that cover all of it. The network embeds
bytes, runs filters of several widths over a window, takes the maximum of each filter over the
window and ends in a softmax over the languages. It is trained in numpy, with Adam, on windows of a
bounded sample of labelled rows: about ``sample_docs`` rows in all, shared evenly between the
languages and chosen by a hash of the id, and at most ``sample_windows`` windows of a row. For
prediction the filters are unrolled into tables over byte pairs, so that a window costs two
look-ups a byte. The log-probabilities of a text's windows are averaged, weighted by their bytes.

Defined results
* ``und`` with score 0: a null text, or one without a letter.
* Otherwise the language with the highest score (of equal ones the first by name) and its
  probability, 0 to 1. With a single learned language that one has score 1; with none all is ``und``.
* Rows are independent: repeated rows get equal results, an empty table an empty result. Only
  ``text_col`` is read for a prediction; result columns replace those of the same name, others stay.
* A row takes part in training only if text, language and id are not null and the text has a letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WINDOW = 256
FILTERS = {2: 8, 3: 12, 4: 12}
EMBEDDING = 8
SAMPLE_DOCS = 2400
SAMPLE_WINDOWS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
MIN_SCORE = 0.5
BLOCK_WINDOWS = 64
# Bytes of text in one go, if no single text is longer.
BATCH_BYTES = 4_000_000
_LETTER = re.compile(r"[A-Za-z]")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width and place in the filter, what each byte adds."""
        return {w: [self.embedding @ f[j] for j in range(w)] for w, f in self.filters.items()}


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (with the first bytes that follow), the text of each, and its bytes."""
    widest = max(FILTERS)
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW + widest * len(texts) + widest, dtype=np.uint8)
    starts, at = [], 0
    for text, count in zip(texts, counts.tolist()):
        flat[at: at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        starts.append(at + WINDOW * np.arange(count))
        at += count * WINDOW + widest
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = np.concatenate(starts)
    place = begin - np.repeat([s[0] for s in starts], counts)
    sizes = np.minimum(WINDOW, np.array([len(t) for t in texts])[owner] - place)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW + widest - 1)[begin], owner, sizes


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def train(samples: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit on windows of WINDOW + widest - 1 bytes; labels index ``languages``."""
    rng = np.random.default_rng(seed)
    total = sum(FILTERS.values())
    names = ["embedding", "bias", "dense", "offset", *FILTERS]
    value = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)), "bias": np.zeros(total),
        "dense": rng.normal(0, 0.3, (total, len(languages))), "offset": np.zeros(len(languages)),
    } | {w: rng.normal(0, 0.5 / w, (w, EMBEDDING, n)) for w, n in FILTERS.items()}
    first, second = ({k: np.zeros_like(value[k]) for k in names} for _ in range(2))
    weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(languages))) / len(languages)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            part = order[at: at + BATCH]
            x, y = samples[part], labels[part]
            tables = {w: [value["embedding"] @ value[w][j] for j in range(w)] for w in FILTERS}
            pooled, peaks = [], {}
            for w in FILTERS:
                found = sum(tables[w][j].astype(np.float32)[x[:, j: j + WINDOW]] for j in range(w))
                peaks[w] = found.argmax(axis=1)
                pooled.append(np.take_along_axis(found, peaks[w][:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(pooled, axis=1) + value["bias"]
            hidden = np.maximum(raw, 0)
            logits = hidden @ value["dense"] + value["offset"]
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = chance
            error[np.arange(len(y)), y] -= 1
            error *= weight[y][:, None] / len(y)
            back = error @ value["dense"].T * (raw > 0)
            slope = {"dense": hidden.T @ error + 1e-4 * value["dense"], "offset": error.sum(axis=0), "bias": back.sum(axis=0), "embedding": np.zeros((256, EMBEDDING))}
            at_filter = 0
            for w, n in FILTERS.items():
                own = back[:, at_filter: at_filter + n]
                at_filter += n
                slope[w] = np.zeros_like(value[w])
                for j in range(w):
                    byte = np.take_along_axis(x, peaks[w] + j, axis=1)
                    table = np.zeros((256, n))
                    np.add.at(table, (byte, np.broadcast_to(np.arange(n), byte.shape)), own)
                    slope[w][j] = value["embedding"].T @ table
                    slope["embedding"] += table @ value[w][j].T
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slope[k]
                second[k] = 0.999 * second[k] + 0.001 * slope[k] ** 2
                value[k] = value[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, value["embedding"], {w: value[w] for w in FILTERS}, value["bias"], value["dense"], value["offset"])


class Predictor:
    """The network unrolled over byte pairs, in 16-bit steps.

    A filter of width 2 is one look-up of the pair at its place; widths 3 and 4 add one of the pair two bytes on.
    """

    def __init__(self, network: Network):
        self.network = network
        tables = network.tables()
        most = sum(max(np.abs(t).max() for ts in tables.values() for t in [ts[j] for j in range(min(k + 1, len(ts)))][-1:]) for k in range(max(FILTERS)))
        self.scale = 32000 / max(most, 1e-9)
        near = [(ts[0][:, None, :] + ts[1][None, :, :]).reshape(65536, -1) for ts in tables.values()]
        far = [(ts[2][:, None, :] + (ts[3][None, :, :] if w > 3 else 0)) + np.zeros((256, 256, 1)) for w, ts in tables.items() if w > 2]
        self.near = np.rint(np.concatenate(near, axis=1) * self.scale).astype(np.int16)
        self.far = np.rint(np.concatenate([f.reshape(65536, -1) for f in far], axis=1) * self.scale).astype(np.int16)

    def log_chances(self, cut: np.ndarray) -> np.ndarray:
        out = []
        short = self.near.shape[1] - self.far.shape[1]
        for at in range(0, len(cut), BLOCK_WINDOWS):
            block = cut[at: at + BLOCK_WINDOWS].astype(np.uint16)
            pairs = block[:, :-1] << 8 | block[:, 1:]
            found = self.near[pairs[:, :WINDOW]]
            found[:, :, short:] += self.far[pairs[:, 2: WINDOW + 2]]
            out.append(found.max(axis=1))
        net = self.network
        hidden = np.maximum(np.concatenate(out) / self.scale + net.bias, 0)
        logits = hidden @ net.dense + net.offset
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        meant = [i for i, t in enumerate(texts) if has_letter(t)]
        if not meant or not self.network.languages:
            return names, scores
        cut, owner, sizes = windows([texts[i].encode("utf-8", "surrogatepass") for i in meant])
        chances = self.log_chances(cut) * sizes[:, None]
        total, weight = np.zeros((len(meant), chances.shape[1])), np.zeros(len(meant))
        np.add.at(total, owner, chances)
        np.add.at(weight, owner, sizes)
        mean = total / weight[:, None]
        mean = np.exp(mean - mean.max(axis=1, keepdims=True))
        mean /= mean.sum(axis=1, keepdims=True)
        best = mean.argmax(axis=1)
        for n, i in enumerate(meant):
            names[i], scores[i] = self.network.languages[best[n]], mean[n, best[n]]
        return names, scores


def sample(labelled: DataFrame, id_col: str, text_col: str, label_col: str, docs: int, chosen_windows: int) -> list:
    """(label, window) rows of about ``docs`` documents, evenly from the labels."""
    usable = labelled.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    if not counts:
        return []
    share = docs / len(counts)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, share / n))])
    chosen = usable.filter((chance < limit[F.col(label_col)]) & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    rows, _, sizes = windows([text.encode("utf-8", "surrogatepass")])
                    for i in np.unique(np.linspace(0, len(rows) - 1, chosen_windows).astype(int)):
                        if sizes[i] >= WINDOW // 8 or i == 0:
                            labels.append(label)
                            found.append(rows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(found, pa.binary())], names=["label", "window"])

    return chosen.mapInArrow(cut, "label string, window binary").collect()


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, epochs: int = EPOCHS) -> Network:
    rows = sorted((r["label"], bytes(r["window"])) for r in sample(labelled, id_col, text_col, label_col, sample_docs, sample_windows))
    languages = sorted({label for label, _ in rows})
    samples = np.frombuffer(b"".join(w for _, w in rows), dtype=np.uint8).reshape(len(rows), WINDOW + max(FILTERS) - 1)
    labels = np.array([languages.index(label) for label, _ in rows], dtype=np.int64)
    return train(samples, labels, languages, epochs)


def predict(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    results = ("lang_pred", "score")
    kept = [c for c in docs.columns if c not in results]
    schema = T.StructType([docs.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    text_at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(network)
        for batch in batches:
            names, scores, part, size = [], [], [], 0
            for text in batch.column(text_at):
                text = text.as_py()
                if part and size + len(text or "") > BATCH_BYTES:
                    n, s = predictor.predict(part)
                    names, scores, part, size = names + n, scores + [s], [], 0
                part.append(text)
                size += len(text or "")
            n, s = predictor.predict(part)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names + n, pa.string()), pa.array(np.concatenate([*scores, s]))], names=[*kept, *results])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def keep_known(docs: DataFrame, network: Network, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``min_score``, with their own columns."""
    columns = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(text_col).alias("__text"))
    told = predict(work, network, "__text").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return told.select(*[F.col("__row").getField(c).alias(c) for c in columns])
