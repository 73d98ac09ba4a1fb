"""SimHash near copies, with pivot distance tables.

Fingerprint: words of ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z, shingles of three words joined by a
space (repeats count), XXH64 with seed 42 of each; a bit is 1 if it is set in over half the hashes.

Two fingerprints link when they differ in at most ``max_bits`` bits. Equal fingerprints are one
class, so copies are never paired. Next to its fingerprint a class has its row of the pivot table: the
Hamming distances to the reference fingerprints, computed once and carried along. By the
triangle inequality two classes that differ by more than max_bits in any coordinate cannot link.
Classes meet in buckets of equal bits: the 64 bits are cut into 2 * max_bits blocks, and classes
within max_bits agree in at least half of the blocks whole, so some choice of max_bits blocks puts them
into one bucket (no link is lost). A bucket is sorted by the first coordinate, and a class meets only those within max_bits
of it there; the other coordinates discard further pairs, and the survivors are verified on the fingerprints.
A large bucket is cut into blocks of rows that meet pairwise in different tasks. A task returns
one link per class to the smallest class it reaches, not its pairs.

Defined results
* null text counts as the empty text; a text without a word has fingerprint zero, which links like
  any other; one or two words make one shingle.
* Repeated rows and equal fingerprints are one class; the smallest id names a component. Rows with
  a null id take part under a hash of their text; a component of such rows alone has a null name.
* An empty table gives an empty result; further columns are ignored by ``near_copies`` and kept by ``keep_one``.
* Ids are whole numbers below 2^62. ``keep_one`` keeps one row of a component: of the smallest id, then of the
  smallest hash of the text, then of the smallest hash of the whole row; rows that agree in all columns are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from haptrace.llm.blocks import BLOCK_ROWS, merged, paired_blocks, run_pairs, whole_groups
from haptrace.llm.components import components
from haptrace.session import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
REFERENCES = 24
HASHES_AT_ONCE = 50_000
NO_ID = 1 << 62


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text; memory beside the text is bounded by a block of hashes."""
    from xxhash import xxh64_intdigest

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~space
    first[1:] &= space[:-1]
    n = int(first.sum())
    if not n:
        return 0
    # One gap between words: white space stays, as a space, if a word follows it directly and another came before.
    kept = ~space
    kept[:-1] |= first[1:]
    kept[: int(np.argmax(~space))] = False
    flat = raw[kept]
    gaps = np.flatnonzero(space[kept])
    flat[gaps] = 32
    flat = flat.tobytes()
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(flat)]])
    if n > words:
        starts, ends = starts[: n - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        block = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([xxh64_intdigest(flat[s:e], SEED) for s, e in zip(starts[block].tolist(), ends[block].tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "mark", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp): the fingerprint as a signed long, with a hash of the text; a null id is replaced as ``row_key`` says."""
    picked = docs.select(row_key(id_col, text_col).alias("id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprint_batches, "id bigint, mark bigint, fp bigint")


def text_mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def row_key(id_col: str, text_col: str) -> Column:
    """The id, or for a null id a number from NO_ID on that depends on the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text_col), F.lit(NO_ID >> 1)))


def _bits(block: int, blocks: int) -> tuple[int, int]:
    low, high = 64 * block // blocks, 64 * (block + 1) // blocks
    return low, high - low


def bucket_keys(fp: Column, max_bits: int) -> Column:
    """One key per choice of max_bits of 2 * max_bits blocks: the number of the choice above the bits."""
    blocks = 2 * max_bits
    keys = []
    for number, choice in enumerate(combinations(range(blocks), blocks - max_bits)):
        key, width = F.lit(number).cast("long"), 0
        for block in choice:
            low, size = _bits(block, blocks)
            part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1))
            key, width = F.shiftleft(key, size).bitwiseOR(part), width + size
        keys.append(key)
    return F.array(*keys)


def reference_fingerprints(count: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints drawn by a fixed seed; random ones lie about 32 bits from everything and from each other."""
    return np.random.default_rng(20240607).integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.arange(count, dtype=np.uint64) % np.uint64(2)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Rows: fingerprints, columns: references; Hamming distances."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.uint8)


def with_distances(classes: DataFrame, references: np.ndarray) -> DataFrame:
    """Adds the row of the pivot table (``table``, a byte a reference) and its first coordinate (``first``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distance_table(np.array(batch.column("fp")).view(np.uint64), references)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in found], pa.binary()), pa.array(found[:, 0].astype(np.int32))],
                                             names=[*batch.schema.names, "table", "first"])

    return classes.select("fp", "rep", "least").mapInArrow(run, "fp bigint, rep bigint, least bigint, table binary, first int")


def surviving_pairs(frame: pd.DataFrame, keys: list[str], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket that no coordinate of the pivot table discards; the bucket is sorted by ``first``."""
    table = np.frombuffer(b"".join(frame["table"]), dtype=np.uint8).reshape(len(frame), -1).T.astype(np.int8)
    for i, j in run_pairs(frame, keys, frame["first"].to_numpy(), max_bits):
        for coordinates in table[1:]:
            near = np.abs(coordinates[i] - coordinates[j]) <= max_bits
            i, j = i[near], j[near]
            if not len(i):
                break
        if len(i):
            yield i, j


def _links(max_bits: int):
    keys = ["key", "lo", "hi"]

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            names, fps = frame["rep"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
            left, right = [], []
            for i, j in surviving_pairs(frame, keys, max_bits):
                same = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
                left.append(i[same])
                right.append(j[same])
            if left:
                low = merged(len(names), np.concatenate(left), np.concatenate(right), names)
                hung = low != names
                yield pd.DataFrame({"a": names[hung], "b": low[hung]}).drop_duplicates()

    return link


def class_links(classes: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) links that join all classes (fp, rep) within max_bits, by their names ``rep``."""
    if "table" not in classes.columns:
        classes = with_distances(classes.withColumn("least", F.col("rep")), reference_fingerprints())
    spread = classes.select("fp", "rep", "table", "first", F.explode(bucket_keys(F.col("fp"), max_bits)).alias("key"))
    cells = paired_blocks(spread, ["key"], "fp", block_rows)
    dealt = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "first")
    return dealt.mapInPandas(_links(max_bits), "a bigint, b bigint")


def _components(docs: DataFrame, id_col: str, text_col: str, max_bits: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, mark, fp) of every row, with row keys for ids, and (fp, least, component) of every class; a class is named by its fingerprint, as ids may repeat."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(with_distances(marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.col("fp")), reference_fingerprints()))
    joined = components(class_links(classes, max_bits, block_rows))
    return marked, classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id."""
    named = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    marked, classes = _components(docs, id_col, text_col, max_bits, block_rows)
    names = classes.groupBy("component").agg(F.min("least").alias("name"))
    return marked.join(classes.join(names, "component").select("fp", "name"), "fp").select(
        named("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named("name").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component."""
    marked, classes = _components(docs, id_col, text_col, max_bits, BLOCK_ROWS)
    per_class = marked.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("head"))
    heads = per_class.join(classes, "fp").groupBy("component").agg(F.min("head").alias("head")).select(
        F.col("head.id").alias("__key"), F.col("head.mark").alias("__mark"))
    keyed = docs.withColumn("__key", row_key(id_col, text_col)).withColumn("__mark", text_mark(text_col))
    kept = keyed.join(heads, ["__key", "__mark"], "left_semi")
    plain = [F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]
    rows = W.partitionBy("__key", "__mark").orderBy(F.xxhash64(*plain))
    return kept.withColumn("__place", F.row_number().over(rows)).filter("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
