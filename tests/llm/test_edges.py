"""Every operator on odd rows: nulls, empty and long texts, ties, repeats, empty tables, and columns with the operators' own names."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from xsfactor.llm import cover_tree, jaccard_join, packing, piece_encoding, pii, quality_classifier, quality_rules, sharding, toxicity, warc

LONG = "word " * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog " * 8, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
    (5, LONG, "en", "a", 1), (5, LONG, "en", "a", 1), (None, "no id here at all", "en", None, 3), (7, "one two", "en", "c", 7), (8, "one two", "de", "c", 7),
    (9, "mail x.y@example.com or 4111 1111 1111 1111", "en", "a", 9), (10, "é\u0000퟿\U0001f600 <|endoftext|> ▁", "fr", "b", 9),
]
OWN = ["n_words", "score", "kept", "row", "host", "shard", "size", "slot", "old_shard", "component_id", "n", "fp", "vec", "k", "task", "nth", "_pii", "id", "y", "first", "e", "w", "cell"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("own") for c in OWN})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, 0), (9, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(params=["rows", "none"])
def docs(request, spark):
    return table(spark, ROWS if request.param == "rows" else [])


def same_rows(out, docs):
    assert out.columns == docs.columns
    assert out.count() == docs.count()


def test_encoding(docs):
    got = piece_encoding.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).toPandas()
    assert len(got) == docs.count()
    assert (got[got.doc_id.isin([2, 3])].n_tokens == 1).all()


def test_join(docs):
    got = jaccard_join.join(docs, 3, 90).toPandas()
    assert len(got) == docs.count()
    if len(got):
        at = got.dropna(subset=["doc_id"]).groupby("doc_id").component_id.first()
        assert at[7] == at[8] == 7 and at[2] == 2 and at[3] == 3 and at[4] == 4
        assert got[got.doc_id.isna()].component_id.isna().all()
        n = got.dropna(subset=["doc_id"]).groupby("doc_id").n_shingles.first()
        assert (n[2], n[3], n[4], n[5], n[7]) == (0, 0, 0, 1, 1)
        kept = jaccard_join.one_of_each(docs, 3, 90)
        assert kept.columns == docs.columns
        assert sorted(kept.where("doc_id is not null").toPandas().doc_id) == [1, 2, 3, 4, 5, 7, 9, 10]
        assert kept.where("doc_id is null").count() == 1


def test_pii(docs):
    out = pii.pseudonymise(docs, "key")
    same_rows(out, docs)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    if texts:
        assert texts[2] is None and texts[3] == "" and "4111" not in texts[9][-15:] and "x.y@" not in texts[9]
        assert texts[1] == ROWS[0][1] and texts[5] == LONG


def test_toxicity(docs, spark):
    model = toxicity.fit(docs, labels(spark), ~toxicity.held_out())
    got = docs.select("doc_id", toxicity.scored(F.col("text"), model).alias("score")).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert toxicity.clean_documents(docs, model).columns == docs.columns


def test_warc(spark):
    page = "<p>" + "x" * 120
    rows = [(1, "u", page), (2, None, page), (3, "u\r\nv", None), (4, "u", "short"), (5, "u", "short"), (None, "u", page), (2, None, page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("first", "d", "p", "path")})
    got = warc.read(warc.write(pages), payloads=True).toPandas()
    kinds = sorted((int(r.page_id) if r.page_id == r.page_id else 0, r.record_type) for r in got.itertuples())
    assert kinds == [(0, "response"), (1, "response"), (2, "revisit"), (2, "revisit"), (3, "response"), (4, "response"), (5, "response")]
    assert got[got.page_id == 3].payload_bytes.item() == 0 and (got[got.page_id == 2].refers_to == 1).all()
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_sharding(docs):
    placed, touched = sharding.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(3)), 3, 4)
    out = sharding.rewrite(placed, touched, 4).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_quality_classifier(docs, spark):
    model, scale = quality_classifier.fit(docs, labels(spark), ~quality_classifier.held_out())
    got = quality_classifier.score(docs, model, scale).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()


def test_quality_rules(docs):
    got = quality_rules.judge(docs).toPandas()
    assert len(got) == docs.count()
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_packing(docs):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    assert (got.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert (got[got.doc_id.isin([2, 3])].doc_tokens == 1).all()
    if not docs.isEmpty():
        assert got.length.sum() == got[got.start == 0].doc_tokens.sum()


def test_cover_tree(spark):
    nan, v = float("nan"), [1.0, 0.0]
    rows = [(1, v), (2, v), (2, v), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, v), (8, [0.99, 0.1]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in OWN})
    got = cover_tree.join(df, 0.9).toPandas()
    assert len(got) == len(rows)
    n = got.dropna(subset=["vec_id"]).groupby("vec_id").agg({"n_links": "first", "component_id": "first"})
    assert n.n_links.to_dict() == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2, 9: 0}
    assert n.component_id[8] == 1 and n.component_id[7] == 7
    assert cover_tree.join(df.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("own", [[], [*OWN, "_word", "_mask", "_at", "_marked", "_row", "_id", "p", "found", "h", "host_rejected", "y"]])
def test_stages_keep_columns(spark, tmp_path, own):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs = docs.withColumns({c: F.lit("own") for c in own}) if own else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert all(r[c] == "own" for r in out.collect() for c in own), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert pieces.count() >= len(rows)
