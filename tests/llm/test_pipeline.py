"""The pipeline against its stages done by hand on plain Python rows."""

from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import line_dedup, pii, quality, simhash


def by_hand(spark, folder):
    rows = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train_line_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if quality.judge(r["text"], model)[-1]]
    hosts = Counter(r["source"] for r in rows)
    holders = Counter()
    for r in rows:
        holders.update({(r["source"], line) for line in (r["text"] or "").split("\n") if line.strip()})
    for r in rows:
        if r["text"] is not None:
            lines = r["text"].split("\n")
            r["text"] = "\n".join(
                x
                for x in lines
                if not x.strip()
                or holders[r["source"], x] < line_dedup.MIN_PAGES
                or holders[r["source"], x] <= line_dedup.BOILERPLATE_RATIO * hosts[r["source"]]
            )
    prints = {r["doc_id"]: simhash.simhash(r["text"]) for r in rows}
    groups: list[set] = []
    for d, own in prints.items():
        near = [g for g in groups if any((own ^ prints[o]).bit_count() <= 3 for o in g)]
        groups = [g for g in groups if g not in near] + [{d}.union(*near)]
    kept = [min(g) for g in groups]
    rows = [r for r in rows if r["doc_id"] in set(kept)]
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    tagger = pii.fit(table)
    _, spans = pii.spans_of([r["text"] for r in rows], tagger)
    return {r["doc_id"]: pii.mask(r["text"], s) if s else r["text"] for r, s in zip(rows, spans)}


def test_pipeline_equals_its_stages_by_hand(spark, real):
    want = by_hand(spark, real)
    found = corpus_pipeline.run(spark, real).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    got = Counter()
    for r in found:
        assert r.doc_tokens == tokens[r.doc_id]
        got[r.doc_id] += r.length
    assert got == tokens


def test_stages_return_the_columns_of_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.collect()


def test_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
