"""Every operator on nulls, empty and long texts, repeated rows, an empty table and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, brown, dedup, licenses, media, minhash, packing, quality, simhash, suffix, toxicity
from tests.llm.cases import SCHEMA, rows

CLASHING = ["part", "head", "chunk", "f", "y", "score", "place", "train", "kept", "ids", "data", "rest", "n_bytes", "component_id", "stats", "notes", "length", "tag"]


def labels(spark):
    own = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows())]
    return spark.createDataFrame([(a, b, int(c)) for a, b, c in own], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "brown": lambda s, d: brown.score(d),
    "bpe": lambda s, d: bpe.encode(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "licenses": lambda s, d: licenses.scan(d),
    "simhash": lambda s, d: simhash.groups(d),
    "suffix": lambda s, d: suffix.cut(d),
    "minhash": lambda s, d: minhash.fingerprints(d),
    "near_duplicates": lambda s, d: minhash.near_duplicates(d),
    "media": lambda s, d: media.digest(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame(rows(), SCHEMA)
    for name in CLASHING:
        own = own.withColumn(name, F.lit("clash"))
    return own


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, name):
    out = OPERATORS[name](spark, docs).select("doc_id").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing_edges(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(docs, path).collect()
    assert {str(r["doc_id"]) for r in out} == {str(r[0]) for r in rows()}
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).collect() == []


@pytest.mark.parametrize("stage", ["quality", "toxicity", "simhash", "suffix"])
def test_stages_keep_columns(spark, docs, stage):
    step = {"quality": lambda d: quality.keep_good(d, labels(spark)), "toxicity": lambda d: toxicity.drop_toxic(d, labels(spark)), "simhash": dedup.one_of_each, "suffix": suffix.without_repeats}[stage]
    out = step(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert set(r["kept"] for r in out.collect()) == {"clash"}
    assert step(docs.limit(0)).collect() == []


def test_labels_without_rows(spark, docs):
    none = labels(spark).limit(0)
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert {round(r["score"], 6) for r in toxicity.classify(docs, none).collect()} == {toxicity.PRIOR[0] / toxicity.PRIOR[1]}
