import os
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_ops import slow_components, slow_print
from tidemark.llm import bpe, mixing, quality_rules, secret_scan, sentencepiece_codec


def staged(spark, df, tmp_path):
    """Each stage's output, written and read again as the next one's input."""
    out = [df]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "/nowhere").write.parquet(str(tmp_path / str(k)))
        out.append(spark.read.parquet(str(tmp_path / str(k))))
    return out


def test_stages_by_brute_force(spark, docs, tmp_path):
    start, good, unique, clean, mixed, coded = staged(spark, docs, tmp_path)
    for df in (good, unique, clean, mixed):
        assert df.columns == docs.columns
    kept = {r.doc_id for r in quality_rules.apply_rules(docs.select("doc_id", "text")).where("kept").collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(kept)
    prints = [(r.doc_id, slow_print(r.text)) for r in good.collect()]
    want = slow_components(prints)
    assert Counter(r.doc_id for r in unique.collect()) == Counter(set(want.values()))
    texts = {r.doc_id: r.text for r in unique.collect()}
    novelty = secret_scan.measure(bpe.default_path(), secret_scan.mine(unique))
    for r in clean.collect():
        assert r.text == secret_scan.mask(texts[r.doc_id], secret_scan.with_copies(texts[r.doc_id], secret_scan.scan(texts[r.doc_id], novelty))) and r.n_chars == len(r.text)
        assert not secret_scan.base_spans(r.text)
    copies = {(r.source, r.doc_id): r.copies for r in mixing.mix_copies(mixing.sized(clean)).collect()}
    assert Counter((r.source, r.doc_id) for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})
    codec = sentencepiece_codec.codec(sentencepiece_codec.default_path())
    after = {r.doc_id: r.text for r in mixed.collect()}
    rows = coded.collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert r.exact and codec.decode(np.array(r.ids)) == after[r.doc_id]


def test_every_stage_takes_tricky_rows(spark, tricky, nothing):
    for df in (tricky, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, "/nowhere").count() >= 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(root, "tidemark")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                assert not re.search(r"^\s*(from|import) .*\bllm\b", open(os.path.join(folder, name)).read(), re.M)


def test_stages_keep_columns_of_any_name_and_type(spark, tricky):
    odd = tricky.withColumns({"a.b": F.col("n_words"), "c.d e": F.lit("x"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "_1": F.array(F.col("_row"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/nowhere")
        assert out.columns == odd.columns
        assert all(r["a.b"] == r["n_words"] and r["m"] == {"k": r["doc_id"]} and r["_1"] == [r["_row"]] for r in out.collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, odd, "/nowhere")
    assert {"a.b", "c.d e", "m", "_1"} <= set(coded.columns) and all(r["m"] == {"k": r["doc_id"]} for r in coded.collect())
