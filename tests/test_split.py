"""Exact-size split properties and top-k."""

import pytest

from tessera.operators import split as S


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")


@pytest.mark.parametrize("ratio", [0.9, 0.995, 0.5, 0.0, 1.0])
def test_exact_split_properties(spark, docs, ratio):
    n = docs.count()
    train, test = S.exact_split(docs, "doc_id", ratio, seed=42)
    tr, te = {r.doc_id for r in train.collect()}, {r.doc_id for r in test.collect()}
    assert len(tr) == int(n * ratio) and len(tr) + len(te) == n and not (tr & te)
    tr2, _ = S.exact_split(docs.repartition(7), "doc_id", ratio, seed=42)
    assert {r.doc_id for r in tr2.collect()} == tr


def test_split_refinement_levels(spark, docs):
    # one hex digit a round forces several prefix-refinement rounds
    n = docs.count()
    k = int(n * 0.37)
    ranked = sorted(r.h for r in docs.select(S.split_hash("doc_id", 3).alias("h")).collect())
    assert ranked[k - 1] == S.split_boundary(docs, "doc_id", k, seed=3, digits=1) == S.split_boundary(docs, "doc_id", k, seed=3)


def test_split_on_repeated_keys(spark):
    with pytest.raises(ValueError, match="share the key"):
        S.exact_split(spark.createDataFrame([(1,)] * 10, "k long"), "k", 0.5)


def test_split_of_a_computed_input(spark, docs):
    lab = S.label_split(docs.where("n_chars % 2 = 0").selectExpr("doc_id * 2 as k"), "k", 0.7)
    n = lab.count()
    assert lab.where("split = 'train'").count() == int(n * 0.7)


def test_label_split_and_summary(spark, docs):
    lab = S.label_split(docs, "doc_id", 0.9)
    got = {r.split: r.rows for r in S.split_summary(lab, "split", "n_chars").collect()}
    n = docs.count()
    assert got["train"] == int(n * 0.9) and got["test"] == n - int(n * 0.9)


def test_shortest_and_remainder(spark, docs):
    top = S.shortest_n(docs, "n_chars", "doc_id", 10).collect()
    allrows = sorted(docs.collect(), key=lambda r: (r.n_chars, r.doc_id))
    assert [r.doc_id for r in top] == [r.doc_id for r in allrows[:10]]
    train, test = S.shortest_split(docs, "n_chars", "doc_id", 10)
    assert train.count() == docs.count() - 10
    assert not ({r.doc_id for r in train.collect()} & {r.doc_id for r in test.collect()})


def test_point_lookup(spark, docs):
    from tessera.operators.compare import number_rows
    numbered = number_rows(docs, ["n_chars", "doc_id"], "problem_number", partitions=3)
    assert S.point_lookup(numbered, 0).count() == 1
    top = S.numbered_top(docs, ["n_chars", "doc_id"], 10)
    assert [S.point_lookup(top, k).first().doc_id for k in (0, 9)] == [S.point_lookup(numbered, k).first().doc_id for k in (0, 9)]
    for table, index in ((numbered, 10_000), (top, 10)):
        with pytest.raises(Exception, match=f"Invalid index {index}"):
            S.point_lookup(table, index).collect()
    with pytest.raises(IndexError):
        S.point_lookup(numbered, -1)
