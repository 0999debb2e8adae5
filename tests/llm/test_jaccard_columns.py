"""One row of each group of copies keeps all columns of its caller, whatever their names."""

from tidemark.llm import jaccard


def test_columns_named_like_inner_ones(spark):
    rows = [(1, "a b c d e", 77, "mine", 5), (2, "a b c d e", 78, "other", 6), (3, None, 79, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int, __class string, __kept int")
    got = jaccard.one_per_component(docs)
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
