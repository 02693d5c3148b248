"""run() against plain versions of its stages, and that stages keep what they should."""

from __future__ import annotations

import re
import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from twinlake.llm.queries import mixing_settings


def test_run_against_plain_stages(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    items = list(pd.read_parquet(f"{sf}/benchmark.parquet").itertuples(index=False, name=None))
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert labels.quality.sum() < 5 * 100  # too few for a bound of one per cent, so only the base rule rejects
    text = docs.text.to_dict()
    text = {d: t for d, t in text.items() if not brute.quality(t)[5]}
    text = _one_each(text)
    dirty = brute.contamination(text, [(str(i), t) for i, t in items])
    text = {d: t for d, t in text.items() if not dirty[d][4]}
    domains = ("web", "reference", "forum")
    rows = [(d, domains[int(re.search(r"(\d+)$", docs.source[d])[1]) % 3], docs.lang[d], docs.source[d], len(brute.WORD.findall(t))) for d, t in text.items()]
    s = mixing_settings()
    copies = brute.mix(rows, s["weights"], s["budget_percent"], s["epochs"], s["seed"])
    encode, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(copies):
        ids = [*encode.encode(text[d], add_special_tokens=False).ids, 2]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == want


def _one_each(text: dict) -> dict:
    found = brute.links(text)
    return {d: t for d, t in text.items() if found[d][1] == d}


def test_stages_pass_columns_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "row")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.join(docs, "doc_id", "left_anti").count() == 0


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
