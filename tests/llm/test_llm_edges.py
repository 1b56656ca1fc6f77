"""Every operator and pipeline stage on nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelane.llm import backoff, forest, mixing, multiset, notices, pages, pieces, quality, secret_scan, simple8b
from wavelane.llm.common import own_path

EXTRA = ["label", "size", "a", "b", "block", "rank", "copies", "kept", "row", "q_text", "secret_spans", "component_id", "which", "held_out", "k", "p"]
SYLLABLES = "mi la ro ten va sul be".split()
PROSE = " ".join(f"the {a}{b}n and {b}{a} of" for a in SYLLABLES for b in SYLLABLES) + ". "


@pytest.fixture(scope="module")
def messy(spark):
    long = " ".join(f"word{i}x the" for i in range(30000))
    texts = [(1, PROSE), (1, PROSE), (2, None), (None, PROSE[60:]), (3, ""), (4, " \n\t "), (5, long), (6, "a"), (None, None), (7, "x" * 50000), (8, PROSE + "tail"), (9, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff " + PROSE)]
    rows = [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or "")) + (k,) * len(EXTRA) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in EXTRA))


def operators(spark):
    file = public_tokenizers.path

    def blocks(docs):
        path = own_path(spark, "test")
        simple8b.write(docs, path, file("byte_bpe_50k.json"), 2)
        return simple8b.read(spark, path)

    return {
        "mix": mixing.mix, "secrets": secret_scan.scan, "blocks": blocks, "multiset": multiset.compare, "notices": notices.scan, "quality": quality.judge,
        "pieces": lambda d: pieces.sample(d, file("piece_bpe_32k.model")), "scores": lambda d: backoff.scores(d, backoff.seventh_held_out()), "forest": forest.components,
    }


@pytest.mark.parametrize("name", ["mix", "secrets", "blocks", "multiset", "notices", "quality", "pieces", "scores", "forest"])
def test_operators_keep_every_row(spark, messy, name):
    run = operators(spark)[name]
    out = run(messy).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in messy.select("doc_id").collect())
    assert run(messy.limit(0)).collect() == []


def test_stages_on_messy_and_empty_documents(spark, messy):
    for docs in (messy, messy.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "unused")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), out.schema)
            else:
                assert all(r.lossless for r in out.collect())


def test_stages_take_effect(spark, messy):
    kept = {r.doc_id for r in corpus_pipeline.good(spark, messy, "").collect()}
    assert {1, 8} <= kept and not kept & {2, 3, 4, 6, 7}
    single = corpus_pipeline.distinct(spark, messy, "").groupBy("doc_id").count().filter("doc_id is not null").collect()
    assert all(r["count"] == 1 for r in single) and 8 not in {r.doc_id for r in single}
    safe = {r.doc_id: r for r in corpus_pipeline.safe(spark, messy, "").collect()}
    assert safe[9].text.startswith("[assign]") and "24be" not in safe[9].text and safe[9].n_chars == len(safe[9].text)
    assert safe[2].text is None and safe[8].text == PROSE + "tail"


def test_pages_edges(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (2, "v", "<p>" + "word " * 60000, 3), (3, "w", "<article><p>A &amp; b</p></article><script>x", 4)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = pages.extract(table).collect()
    assert len(out) == 5 and {r.page_id: r.text for r in out if r.page_id} == {1: "", 2: " ".join(["word"] * 60000), 3: "A & b"}
    assert all(r.n_chars == len(r.text) for r in out)
    assert pages.extract(table.limit(0)).collect() == []
    assert pages.extract(table.withColumn("page_id", F.lit(None).cast("bigint"))).count() == 5
