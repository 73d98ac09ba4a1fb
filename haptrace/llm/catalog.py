"""Queries of the operators on documents, pages and embeddings, and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from haptrace.llm import bpe, exact_dedup, html_tree, langid, mixing, phrases, pivots, repair, secrets, simhash, toxicity, voronoi, warc

# The mixture that the query and the pipeline aim at.
TARGETS = mixing.Targets(
    source={f"src{i}": 0.05 for i in range(20)}, lang={"en": 0.58, "fr": 0.16, "de": 0.16, "es": 0.10},
    topic={"prose": 0.74, "symbols": 0.11, "table": 0.05, "notice": 0.05, "contact": 0.05})
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_code, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), s AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_code DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM s
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str, path: str = BPE_FILE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encode, decode and digest a slice at a time, so that ids and texts need not leave the task."""
        vocab = bpe.vocabulary(path)
        pool = bpe.Pool(vocab)
        decimals = [str(i) for i in range(max(vocab.texts) + 1)]

        def digests(ids: np.ndarray) -> tuple[str, str]:
            told, read = hashlib.sha256(), hashlib.sha256()
            for at in range(0, len(ids), bpe.SLICE_WORDS):
                part = ",".join(map(decimals.__getitem__, ids[at:at + bpe.SLICE_WORDS].tolist()))
                told.update(("," if at else "").encode() + part.encode())
            for text in bpe.decoded_parts(ids, vocab):
                read.update(text.encode())
            return told.hexdigest(), read.hexdigest()

        for batch in batches:
            for piece in bpe.bounded(batch, 1):
                found = bpe.encode_texts(piece.column(1).to_pylist(), vocab, pool)
                told, read = zip(*map(digests, found))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(told, pa.string()), pa.array(read, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def language_network(docs: DataFrame) -> langid.Network:
    """Fitted on the rows of ``docs`` outside the held-out fold."""
    return langid.fit(docs.filter(langid.fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))


@query("op6_langid")
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs.select("doc_id", "text"), language_network(docs))
    return told.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), TARGETS)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


@query("op4_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), h AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM p
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < head THEN head END AS refers_to
FROM h
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = warc.with_roles(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    archives = warc.write(roles, warc.shared_folder(spark, "warc"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_pivots")
def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_copies(table(spark, sf_dir, "embeddings"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("findings")
    count = lambda kind: F.size(secrets.of_kinds(spans, kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE],
        F.sha2(secrets.joined(secrets.of_kinds(spans, *secrets.BASE)), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda x: x["owners"] >= secrets.WIDE_OWNERS)).cast("long").alias("n_copied"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.train(docs.select("doc_id", "text"), labels.filter(langid.fold("doc_id", 5) != 0))
    found = toxicity.score(docs.select("doc_id", "text"), field)
    offsets = F.array_join(F.transform("toxic_spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        offsets.alias("offsets"))


@query("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_tree.fit(html_tree.sample(pages, "page_id", "html"))
    return html_tree.extract(pages.select("page_id", "url", "html"), model)


@query("op11_voronoi", """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.z) = len(c.z) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op11_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op12_repair")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query("op13_phrases", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d
), g AS (
  SELECT lang, 1 AS m, unnest(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[i:i], ' '))) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM p
), f AS (
  SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, f AS a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM f WHERE m >= 2 AND f >= 10
  UNION ALL SELECT lang, m, phrase, f, 2, array_to_string(w[1:2], ' '), w[3] FROM f WHERE m = 3 AND f >= 10
), s AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, h.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s
), cover AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, f AS a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM f WHERE m = 3 AND f >= 10
  ) GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN cover c ON b.lang = c.lang AND b.phrase = c.phrase
  WHERE b.place = 1 AND (c.a IS NULL OR 100 * c.a < 50 * b.a)
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000
""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
