"""Byte-level BPE by a pair occurrence index.

The distinct new words of a slice of text lie in one flat array of symbols, linked to their
neighbours inside the word. An index maps every adjacent pair that has a rank to all its
positions. Ranks are taken in ascending order from a heap of the active ones; a rank merges all its
positions at once, leftmost first where occurrences overlap, and only the pairs on either side of
a merge are entered anew. The words' ids are kept for the slices to come and put together in the order of the texts.

Vocabulary, merges and added tokens come from a ``tokenizer.json`` (``path``); byte-level models
without normaliser, prefix space, dropout, word marks or added tokens with strip flags are read,
others are refused. The file's content is a setting of fixed size; each Python worker reads it once.

Memory of a task: the texts and ids of ``SLICE_CHARS`` characters or of one longer text, the words of
one slice (also inside a text), a pool of at most ``POOL_WORDS`` words or ``POOL_CHARS`` characters, and
about 60 bytes per byte of words merged at once: ``MERGE_BYTES``, or one longer word that holds no
pair of bytes at which it may be cut.

Defined results: null counts as the empty text, which has no ids; a null id array decodes to the
empty text; ids outside the vocabulary raise, and bytes that are no UTF-8 decode to U+FFFD. Rows
are independent, so repeated rows, empty tables and further columns (kept, but for the result
columns of the same name) need no care.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

# The published word pattern of byte-level BPE, and the same for texts of ASCII alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
# Characters of text that are split and encoded together, also inside a longer text.
SLICE_CHARS = 2_000_000
# Words of a longer text that are split at once.
SLICE_WORDS = 400_000
# Bytes of different words that are merged together, if no single word is longer.
MERGE_BYTES = 1_000_000
# Words whose ids are kept for the next slices.
POOL_WORDS = 250_000
POOL_CHARS = 6_000_000


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte to the byte: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, spec: dict):
        import regex

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        plain = (
            model["type"] == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t[k] for t in spec["added_tokens"] for k in flags)
        )
        if not plain:
            raise ValueError("only plain byte-level BPE is read")
        ids, symbols = model["vocab"], byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: bytes(symbols[c] for c in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.of_byte = np.zeros(256, dtype=np.int64)
        for symbol, byte in symbols.items():
            self.of_byte[byte] = ids[symbol]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges])
        self.right = np.array([ids[b] for _, b in merges])
        self.into = np.array([ids[a + b] for a, b in merges])
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        longest = sorted(self.added, key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, longest))) if longest else None
        # Pairs of bytes that stand side by side in some token; no merge reaches across any other pair.
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in self.texts.values():
            raw = np.frombuffer(token, dtype=np.uint8)
            self.joined[raw[:-1], raw[1:]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def split(self, text: str) -> list[str]:
        """Words, and added tokens as they stand."""
        return [word for part in self.splits(text) for word in part]

    def splits(self, text: str) -> Iterator[list[str]]:
        """The same in lists, of bounded length if the text is long."""
        pattern = self.ascii_words if text.isascii() else self.words
        special = self.specials is not None and any(t in text for t in self.added)
        if len(text) <= SLICE_CHARS and not special:
            yield pattern.findall(text)
            return
        start = 0
        for found in self.specials.finditer(text) if special else ():
            yield from _listed(pattern, text[start:found.start()])
            yield [found.group()]
            start = found.end()
        yield from _listed(pattern, text[start:] if start else text)


def _listed(pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= SLICE_CHARS:
        yield pattern.findall(text)
        return
    words = pattern.finditer(text)
    while part := [m.group() for m in islice(words, SLICE_WORDS)]:
        yield part


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(json.load(file))


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word begins in it."""
    sizes = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    symbol = vocab.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
    n = len(symbol)
    ends = np.cumsum(sizes)
    # Neighbours inside the word; position n stands for none.
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n
    before[ends - sizes] = n
    symbol = np.append(symbol, np.int32(-1))
    alive = np.ones(n + 1, dtype=bool)
    alive[n] = False
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[after[at] != n]
        found = vocab.ranks(symbol[at], symbol[after[at]])
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        heads = found[np.concatenate([[0], cuts])].tolist() if len(found) else []
        for rank, part in zip(heads, np.split(at, cuts)):
            if rank not in places:
                places[rank] = []
                heapq.heappush(active, rank)
            places[rank].append(part)

    for first in range(0, n, MERGE_BYTES):
        enter(np.arange(first, min(n, first + MERGE_BYTES), dtype=np.int32))
    while active:
        rank = heapq.heappop(active)
        held = places.pop(rank)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        left, right, into = vocab.left[rank], vocab.right[rank], vocab.into[rank]
        at = at[alive[at] & (symbol[at] == left) & (symbol[after[at]] == right)]
        if left == right and len(at) > 1:
            at = _leftmost(at, after)
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = into
        alive[gone] = False
        follows = after[gone]
        after[at] = follows
        inside = follows != n
        before[follows[inside]] = at[inside]
        heads = before[at]
        enter(np.unique(np.concatenate([at, heads[heads != n]])))
    kept = np.cumsum(alive[:n])
    starts = np.concatenate([[0], kept[ends - 1]]) if len(words) else np.zeros(1, dtype=np.int64)
    return symbol[:n][alive[:n]], starts


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences every second one, from the left."""
    at = np.sort(at)
    chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
    heads = np.flatnonzero(~chained)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    return at[place % 2 == 0]


class Pool:
    """Ids of the words met so far, in one array, with the place of each word."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        if len(self.number) > POOL_WORDS or self.chars > POOL_CHARS:
            self.clear()
        number = self.number
        known = len(number)
        for word in words:
            if word not in number:
                number[word] = len(number)
        if len(number) > known:
            self._learn(list(islice(number, known, None)))
        at = np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))
        sizes = self.length[at]
        shift = np.repeat(self.begin[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(len(shift))], sizes

    def _learn(self, words: list[str]) -> None:
        flats, lengths = [self.flat], [self.length]
        part: list[bytes] = []
        size = 0

        def merge() -> None:
            nonlocal part, size
            flat, starts = merge_words(part, self.vocab)
            flats.append(flat)
            lengths.append(np.diff(starts))
            part, size = [], 0

        for word in words:
            self.chars += len(word)
            if word in self.vocab.added:
                merge()
                flats.append(np.array([self.vocab.added[word]], dtype=np.int32))
                lengths.append(np.ones(1, dtype=np.int64))
                continue
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > MERGE_BYTES:
                merge()
                pieces = [merge_words([p], self.vocab)[0] for p in _cut(raw, self.vocab)]
                flats += pieces
                lengths.append(np.array([sum(map(len, pieces))], dtype=np.int64))
                continue
            if part and size + len(raw) > MERGE_BYTES:
                merge()
            part.append(raw)
            size += len(raw)
        merge()
        self.flat, self.length = np.concatenate(flats), np.concatenate(lengths)
        self.begin = np.cumsum(self.length) - self.length


def _cut(raw: bytes, vocab: Vocabulary) -> Iterator[bytes]:
    """A long word in pieces of about MERGE_BYTES, cut where no token reaches across."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    start = 0
    while start < len(raw):
        end = min(len(raw), start + MERGE_BYTES)
        while end < len(raw):
            some = slice(end - 1, end - 1 + MERGE_BYTES)
            free = np.flatnonzero(~vocab.joined[whole[some][:-1], whole[some][1:]])
            if len(free):
                end += int(free[0])
                break
            end = min(len(raw), end + MERGE_BYTES - 1)
        yield raw[start:end]
        start = end


def encode_texts(texts: list[str | None], vocab: Vocabulary, pool: Pool | None = None) -> list[np.ndarray]:
    """Ids of each text."""
    pool = pool or Pool(vocab)
    out: list[np.ndarray] = []
    words: list[str] = []
    counts: list[int] = []
    size = 0

    def together() -> None:
        nonlocal words, counts, size
        ids, sizes = pool.ids(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
        out.extend(ids[a:b] for a, b in zip(ends[:-1], ends[1:]))
        words, counts, size = [], [], 0

    for text in texts:
        text = text or ""
        if size + len(text) > SLICE_CHARS:
            together()
        if len(text) > SLICE_CHARS:
            parts = [pool.ids(part)[0] for part in vocab.splits(text)]
            out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32))
            continue
        found = vocab.split(text)
        words += found
        counts.append(len(found))
        size += len(text)
    together()
    return out


def decoded_bytes(ids: np.ndarray | list[int], vocab: Vocabulary) -> Iterator[bytes]:
    """Bytes of the ids, a bounded number of ids at a time."""
    for at in range(0, len(ids), SLICE_WORDS):
        part = ids[at:at + SLICE_WORDS]
        yield b"".join(map(vocab.texts.__getitem__, part.tolist() if isinstance(part, np.ndarray) else part))


def decoded_parts(ids: np.ndarray | list[int], vocab: Vocabulary) -> Iterator[str]:
    """The decoded text in parts."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for part in decoded_bytes(ids, vocab):
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def decode_ids(ids: np.ndarray | list[int], vocab: Vocabulary) -> str:
    return "".join(decoded_parts(ids, vocab))


def restores(text: str | None, ids: np.ndarray, vocab: Vocabulary) -> bool:
    """Whether the ids decode to the text's bytes."""
    view, at = memoryview((text or "").encode("utf-8", "surrogatepass")), 0
    for part in decoded_bytes(ids, vocab):
        if view[at:at + len(part)] != part:
            return False
        at += len(part)
    return at == len(view)


def id_arrays(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    values = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", restored_col: str | None = None) -> DataFrame:
    """``docs`` with an array of ids, and whether it decodes to the text if ``restored_col`` names a column for that."""
    kept = [c for c in docs.columns if c not in (ids_col, restored_col)]
    names = [*kept, ids_col] + ([restored_col] if restored_col else [])
    schema = T.StructType([docs.schema[c] for c in kept]).add(ids_col, T.ArrayType(T.IntegerType()))
    if restored_col:
        schema = schema.add(restored_col, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        pool = Pool(vocab)
        for batch in batches:
            for piece in bounded(batch, kept.index(text_col)):
                texts = piece.column(kept.index(text_col)).to_pylist()
                found = encode_texts(texts, vocab, pool)
                more = [pa.array([restores(t, x, vocab) for t, x in zip(texts, found)], pa.bool_())] if restored_col else []
                yield pa.RecordBatch.from_arrays([*piece.columns, id_arrays(found), *more], names=names)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of each id array."""
    kept = [c for c in coded.columns if c != out_col]
    schema = T.StructType([coded.schema[c] for c in kept]).add(out_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode_ids(x.values.to_numpy() if x.is_valid else [], vocab) for x in batch.column(kept.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, out_col])

    return coded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, text_at: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``chars`` bytes at most, if no single text is longer."""
    sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0)))
    start = 0
    while start < batch.num_rows:
        spent = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, spent + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end
