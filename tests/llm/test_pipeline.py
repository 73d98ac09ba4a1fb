"""The pipeline's rows against brute force over the stages' decisions."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from haptrace.llm import catalog, langid, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_rows_match_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    predictor = langid.Predictor(catalog.language_network(docs))
    names, scores = predictor.predict([r["text"] for r in rows.values()])
    left = [i for i, n, s in zip(rows, names, scores) if n != "und" and s >= langid.MIN_SCORE]
    best = {}
    for i in left:
        text = rows[i]["text"]
        norm = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[norm] = min(best.get(norm, (1, 0)), (-len(text), i))
    left = sorted(i for _, i in best.values())
    prints = {i: simhash.fingerprint(rows[i]["text"]) for i in left}
    group = {i: i for i in left}
    for _ in left:
        for a in left:
            for b in left:
                if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[i]] == group[i] for i in left):
            break
    left = {i for i in left if group[i] == i}
    mixed = mixing.mix(docs.filter(docs.doc_id.isin(list(left))), catalog.TARGETS).filter("sampled")
    left = {r["doc_id"] for r in mixed.collect()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in found} == left and len(found) == len(left)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in found:
        assert r["round_trip"] and list(r["token_ids"]) == library.encode(r["text"], add_special_tokens=False).ids == list(r["token_ids"])
        assert r["n_tokens"] == len(r["token_ids"])


def test_every_stage_takes_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, score int"
    odd = [(None, None, None, None, None, "x", 1), (1, "", "en", "src0", 0, "x", 1), (2, "The the and of", None, "src1", 5, None, None),
           (2, "The the and of", None, "src1", 5, None, None), (3, "der die und das", "de", None, None, None, 1), (4, "word " * 30_000, "en", "src3", 1, None, 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, SF)
            assert name == "tokens" or result.columns == docs.columns
            assert len(result.collect()) <= len(rows)
