"""Collocated phrases by direct-address tiling.

A task numbers the words of a chunk of tokens by falling frequency, so that the common ones get the
small numbers. Pairs of neighbours fall into square tiles of those numbers: a tile that is at least
half as full as its table is counted by ``bincount`` on a dense table, the others together as a sorted
coordinate list. Frequent pairs are ranked anew by frequency and stand for a word in the next round:
pair and following word make the triples, in the same tiles. The chunks' counts are summed by Spark;
a task holds one chunk, bounded in tokens and in different words, at any length of text.

A phrase of m words can only be frequent if both its parts of m - 1 words are. So each round is
given a bitmap of fixed size with the hashes of the frequent shorter phrases; a false hit costs a
row that is dropped after summing, none is lost, and a full bitmap only stops saving.

Defined results
* A-Z is lowered; ``[.,;:!?\\x0A-\\x0D]`` ends a piece; words are ``[^\\x20\\x09]+`` inside a piece, whatever else they hold.
* A null text is empty, a null language is ``und``, and joins the rows that say so.
* Repeated rows count each time. Ties in score go to the more frequent, then to the smaller phrase by bytes.
* Empty tables and texts give no rows; other columns are ignored.
* Counts are exact up to 2^63; scores up to counts of 10^15 (38 decimal digits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from haptrace.session import cut_lineage

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
# A chunk ends with the slice that reaches one of these.
CHUNK_TOKENS = 2_000_000
CHUNK_WORDS = 300_000
SLICE_BYTES = 1 << 20
TILE = 512
FILTER_BITS = 1 << 26
FILTER_PART = 1 << 19
EMIT_ROWS = 200_000
# Parts of a language that are ranked on their own before its best are.
SPREAD = 16

# Bytes: A-Z lowered, ends of pieces to line feeds, tabs to spaces.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c) for c in range(256))
BREAK, NOTHING = 0, 1


class Numbering(dict):
    """Number of each word by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Tokens of one language, BREAK between pieces."""

    def __init__(self, start: np.ndarray | None = None, words: list[bytes] | None = None):
        self.numbers = Numbering({b"\n": BREAK, b"": NOTHING})
        self.parts: list[np.ndarray] = []
        self.size = 0
        if start is not None:
            self.parts.append(np.fromiter((self.numbers[words[i]] for i in start), np.int32, len(start)))

    def add(self, raw: bytes) -> None:
        found = raw.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(ids[ids != NOTHING])
        self.size += len(self.parts[-1])

    def end(self) -> None:
        self.parts.append(np.array([BREAK], np.int32))


def slices(raw: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The folded text in slices that begin at a separator."""
    start = 0
    while start < len(raw):
        end = len(raw)
        if start + size < end:
            space = raw.find(b" ", start + size)
            space = end if space < 0 else space
            line = raw.find(b"\n", start + size, space)
            end = space if line < 0 else line
        yield raw[start:end]
        start = end


def count_pairs(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (left, right) with counts; ids are ranks, so the first tiles are the full ones."""
    across = -(-n_right // tile)
    place = (left // tile) * across + right // tile
    filled = np.bincount(place, minlength=max(1, across * -(-n_left // tile))) if across * (n_left // tile + 1) <= 4 * len(left) + 1024 else None
    if filled is None:
        # More tiles than pairs: only the first rows of tiles can be full enough to pay for a table.
        rows = max(1, (4 * len(left)) // max(1, across))
        inside = left < rows * tile
        filled = np.bincount(place[inside], minlength=1)
    dense = np.flatnonzero(filled * 2 >= tile * tile)
    table_of = np.full(len(filled) + 1, -1, dtype=np.int64)
    table_of[dense] = np.arange(len(dense))
    table = table_of[np.minimum(place, len(filled))]
    direct = table >= 0
    cells = np.bincount(table[direct] * tile * tile + (left[direct] % tile) * tile + right[direct] % tile)
    hit = np.flatnonzero(cells)
    tiles, inner = dense[hit // (tile * tile)] if len(hit) else hit, hit % (tile * tile)
    codes, counts = _runs(left[~direct] * n_right + right[~direct])
    return (np.concatenate([(tiles // across) * tile + inner // tile, codes // max(1, n_right)]),
            np.concatenate([(tiles % across) * tile + inner % tile, codes % max(1, n_right)]),
            np.concatenate([cells[hit], counts]))


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a coordinate list and their counts, by sorting."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def _ranked(counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each number by falling count, -1 for those not kept, and the number of each rank."""
    order = np.flatnonzero(keep)
    order = order[np.argsort(-counts[order], kind="stable")]
    rank = np.full(len(counts), -1, dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank, order


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang)
    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def longer_hash(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    mixed = shorter * np.uint64(0x9E3779B97F4A7C15) + last
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


class Filter:
    """Bitmap of phrase hashes, without false misses."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(8 * len(self.bits))
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def chunk_counts(lang: bytes, chunk: Chunk, order: int, filters: list[Filter], tile: int = TILE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of ``order`` words in a chunk with counts; ``filters[m]`` holds the frequent phrases of m + 1 words."""
    words = list(chunk.numbers)
    seq = np.concatenate(chunk.parts) if chunk.parts else np.zeros(0, np.int32)
    seen = np.bincount(seq, minlength=len(words))
    plain = np.arange(len(words)) > NOTHING
    texts = pa.array(words, pa.binary())
    if order == 1:
        kept = np.flatnonzero(plain & (seen > 0))
        yield texts.take(pa.array(kept)), seen[kept]
        return
    hashes = word_hashes(lang, words)
    rank, numbers = _ranked(seen, plain & filters[0].has(hashes))
    texts, hashes = texts.take(pa.array(numbers)), hashes[numbers]
    word = rank[seq]
    # Symbol that ends a phrase of the present length at its first token; words, then pairs, ...
    symbol, symbols, symbol_hashes = word, texts, hashes
    for length in range(2, order + 1):
        left, right = symbol[: max(0, len(seq) - length + 1)], word[length - 1:]
        if length > 2:
            # Both shorter parts must be frequent: the one that begins here and the one that begins next.
            meant = np.flatnonzero((left >= 0) & (symbol[1: len(left) + 1] >= 0))
        else:
            meant = np.flatnonzero((left >= 0) & (right >= 0))
        if length == order:
            a, b, counts = count_pairs(left[meant], right[meant], max(1, len(symbols)), max(1, len(texts)), tile)
            for at in range(0, len(a), EMIT_ROWS):
                some = slice(at, at + EMIT_ROWS)
                yield pc.binary_join_element_wise(symbols.take(pa.array(a[some])), texts.take(pa.array(b[some])), b" "), counts[some]
            return
        codes = left[meant] * len(texts) + right[meant]
        different, where = np.unique(codes, return_inverse=True)
        a, b = different // max(1, len(texts)), different % max(1, len(texts))
        joined = longer_hash(symbol_hashes[a], hashes[b])
        again, order_of = _ranked(np.bincount(where, minlength=len(different)), filters[length - 1].has(joined))
        a, b = a[order_of], b[order_of]
        symbols = pc.binary_join_element_wise(symbols.take(pa.array(a)), texts.take(pa.array(b)), b" ")
        symbol_hashes = joined[order_of]
        symbol = np.full(len(seq), -1, dtype=np.int64)
        symbol[meant] = again[where]


def phrase_counts(docs: DataFrame, order: int, filters: list, lang_col: str, text_col: str,
                  chunk_tokens: int = CHUNK_TOKENS, chunk_words: int = CHUNK_WORDS, slice_bytes: int = SLICE_BYTES, tile: int = TILE) -> DataFrame:
    """(lang, phrase, f) of all phrases of ``order`` words whose parts pass the filters; at order 1 also all words of a language under a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Chunk] = {}
        tokens = words = 0
        loaded = [Filter(f.value) for f in filters]

        def flush(going_on: bytes | None = None) -> Iterator[pa.RecordBatch]:
            for lang, chunk in held.items():
                total = 0
                for texts, counts in chunk_counts(lang, chunk, order, loaded, tile):
                    total += int(counts.sum())
                    yield rows(lang, texts.cast(pa.string()), counts)
                if order == 1 and total:
                    yield rows(lang, pa.array([None], pa.string()), [total])
            ahead = None
            if going_on is not None and order > 1:
                # A text goes on: its last words may begin a phrase that the next slice ends.
                tail = np.concatenate(held[going_on].parts[-order - 1:])[1 - order:]
                ahead = Chunk(tail, list(held[going_on].numbers))
            held.clear()
            if ahead is not None:
                held[going_on] = ahead

        def rows(lang: bytes, texts: pa.Array, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(texts), pa.string()), texts, pa.array(counts, pa.int64())],
                                              names=["lang", "phrase", "f"])

        for batch in batches:
            langs = batch.column(0).cast(pa.binary())
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(langs, texts):
                lang = lang.as_py()
                for part in slices((text.as_py() or b"").translate(_FOLD), slice_bytes):
                    chunk = held.setdefault(lang, Chunk())
                    had = chunk.size, len(chunk.numbers)
                    chunk.add(part)
                    tokens, words = tokens + chunk.size - had[0], words + len(chunk.numbers) - had[1]
                    if tokens >= chunk_tokens or words >= chunk_words:
                        yield from flush(lang)
                        tokens = words = 0
                if lang in held:
                    held[lang].end()
        yield from flush()

    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = picked.mapInArrow(run, "lang string, phrase string, f bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_filter(frequent: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of (lang, phrase); tasks set bits in one of fixed size, parts of it are united by Spark."""
    part_bytes = min(FILTER_PART, bits) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                hashes = word_hashes(lang, phrase.split(b" "))
                value = hashes[:1]
                for last in hashes[1:]:
                    value = longer_hash(value, np.array([last]))
                at = int(value[0]) % bits
                own[at >> 3] |= 1 << (at & 7)
        parts = own.reshape(-1, part_bytes)
        hit = np.flatnonzero(parts.any(axis=1))
        for n in hit.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([parts[n].tobytes()], pa.binary())], names=["part", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = -1, np.zeros(part_bytes, np.uint8)
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != at:
                    if at >= 0:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])
                    at, own = part, np.zeros(part_bytes, np.uint8)
                own |= np.frombuffer(raw.as_py(), np.uint8)
        if at >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])

    marked = frequent.select("lang", "phrase").mapInArrow(mark, "part int, bits binary")
    united = marked.repartition("part").sortWithinPartitions("part").mapInArrow(unite, "part int, bits binary")
    whole = np.zeros((bits // 8 // part_bytes, part_bytes), np.uint8)
    for row in united.collect():  # at most the bitmap itself, bits / 8 bytes
        whole[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.reshape(-1)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                     bits: int = FILTER_BITS, **layout) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... words found at least ``min_count`` times, and (lang, n)."""
    tables, filters, totals = [], [], None
    for order in range(1, max_words + 1):
        counted = phrase_counts(docs, order, list(filters), lang_col, text_col, **layout)
        kept = cut_lineage(counted.filter((F.col("f") >= min_count) | F.col("phrase").isNull()))
        if order == 1:
            totals = kept.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
            kept = kept.filter(F.col("phrase").isNotNull())
        tables.append(kept)
        if order < max_words:
            filters.append(docs.sparkSession.sparkContext.broadcast(frequent_filter(kept, bits)))
    return tables, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP, share: int = 50, **layout) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase scores as its lowest cut, floor(10^6 a^2 / (l r)); one that lies inside a longer candidate
    with at least ``share`` percent of its own count is dropped.
    """
    tables, totals = frequent_phrases(docs, lang_col, text_col, min_count, max_words, **layout)
    parts = tables[0]
    for table in tables[1:-1]:
        parts = parts.union(table)
    scored = []
    for length in range(2, max_words + 1):
        found = tables[length - 1].withColumnRenamed("f", "a").withColumn("__w", F.split("phrase", " "))
        cuts = None
        for k in range(1, length):
            first = F.array_join(F.slice("__w", 1, k), " ")
            rest = F.array_join(F.slice("__w", k + 1, length - k), " ")
            cut = found.select("lang", "phrase", "a", first.alias("__first"), rest.alias("__rest"), F.lit(k).alias("k"))
            cuts = cut if cuts is None else cuts.union(cut)
        left = parts.select("lang", F.col("phrase").alias("__first"), F.col("f").alias("l"))
        right = parts.select("lang", F.col("phrase").alias("__rest"), F.col("f").alias("r"))
        joined = cuts.join(left, ["lang", "__first"]).join(right, ["lang", "__rest"])
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        joined = joined.withColumn("__top", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a"))).withColumn("__low", wide("l") * wide("r"))
        joined = joined.withColumn("score", F.expr("__top div __low").cast("long"))
        best = joined.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
        best = best.select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")
        if length < max_words:
            inside = [tables[longer - 1].select("lang", F.col("f").alias("__a"), F.explode(_inner(longer, length)).alias("phrase")) for longer in range(length + 1, max_words + 1)]
            cover = inside[0]
            for more in inside[1:]:
                cover = cover.union(more)
            cover = cover.groupBy("lang", "phrase").agg(F.max("__a").alias("__a"))
            best = best.join(cover, ["lang", "phrase"], "left").filter(F.col("__a").isNull() | (F.col("__a") * 100 < F.col("a") * share)).drop("__a")
        scored.append(best)
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of SPREAD parts of a language first, so that the last sort has at most SPREAD * top rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    ahead = every.withColumn("__part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inner(longer: int, length: int):
    words = F.split("phrase", " ")
    return F.array(*[F.array_join(F.slice(words, at, length), " ") for at in range(1, longer - length + 2)])
