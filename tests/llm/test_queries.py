"""Registered queries against the libraries or brute force, on whole small tables."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from haptrace.llm import catalog

SF = "/root/testdata/sf0.001"


def _texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe_digests(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = _texts(spark)
    found = catalog.QUERIES["op9_bpe"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
