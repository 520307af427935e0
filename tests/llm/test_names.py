"""All operators on tables whose further columns have the names that operators use."""

import pytest
from pyspark.sql import functions as F

from spanveil.llm import extract, licenses, linedup, maxent, mixing, nearcopy, pieces, pii, quality
from tests.llm import data

CLASHES = ["_text", "_key", "_id", "_tid", "_rid", "_removed", "_ids", "_mix_size", "_MIX_key", "coded_text", "coded_key", "line_key", "line_rid", "line_removed", "line_text", "copy_text", "copy_tid", "copy_least", "a.b", "rank", "block", "size"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = data.odd(spark, extra=False)
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])


def _kept(rows):
    """Further columns come out as they went in."""
    for r in rows:
        for c in CLASHES:
            assert r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}"


def test_operators_that_pass_columns_on(spark, clashing):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert set(CLASHES) < set(clashing.columns)
    _kept(quality.keep(clashing, quality.train(clashing, labels)).collect())
    clean = linedup.clean(clashing).collect()
    _kept(clean)
    one = nearcopy.keep_one(clashing).collect()
    _kept(one)
    assert {r["doc_id"] for r in one} >= {1, 7, 8, 9, 11, 12, 13, None}
    texts = {r[0]: r[1] for r in data.odd_rows()}
    assert all(r["text"] == texts[r["doc_id"]] for r in one)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    _kept(mixed.collect())
    coded = pieces.encode(clashing, proof="ok")
    _kept(coded.collect())
    back = pieces.decode(coded.drop("text"))
    _kept(back.collect())
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(a, b) for a, b, *_ in data.odd_rows()}


def test_operators_that_do_not(spark, clashing):
    n = clashing.count()
    for rows in (pii.find(clashing), licenses.scan(clashing), nearcopy.report(clashing), linedup.report(clashing), mixing.assign(clashing), maxent.score(clashing)):
        assert len(rows.collect()) == n
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in CLASHES])
    assert len(extract.extract(pages, extract.train(pages)).collect()) == n
