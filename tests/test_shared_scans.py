"""Documents are read once for all queries that one scan can hold."""

from pyspark.sql import functions as F

from crewcast.operators import retrieval


def counted(spark, df, column):
    """df, whose column passes a function that counts its rows, and the count."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(value):
        seen.add(1)
        return value

    return df.withColumn(column, count.asNondeterministic()(F.col(column))), seen


def test_documents_are_read_once_for_many_blocks(spark):
    documents = spark.createDataFrame([(n, None, f"red {n}", None, [1.0, float(n)]) for n in range(50)], "id bigint, title string, content string, consultant_name string, content_vector array<double>")
    queries = spark.createDataFrame([(n, f"red {n}", [1.0, 2.0]) for n in range(12)], "query_id bigint, query string, query_vector array<double>")
    documents, seen = counted(spark, documents, "content")
    by_block = retrieval.keyword_search(documents, queries, top_k=3, block_rows=5).collect()
    assert seen.value == 50
    assert sorted(by_block) == sorted(retrieval.keyword_search(documents, queries, top_k=3).collect())
    near = retrieval.vector_search(documents, queries, dimensions=2, block_rows=5).collect()
    assert sorted(near) == sorted(retrieval.vector_search(documents, queries, dimensions=2).collect())


def test_queries_beyond_a_scan_take_several(spark, monkeypatch):
    documents = spark.createDataFrame([(n, None, f"red {n}", None) for n in range(50)], "id bigint, title string, content string, consultant_name string")
    queries = spark.createDataFrame([(n, f"red {n}") for n in range(12)], "query_id bigint, query string")
    one = retrieval.keyword_search(documents, queries, top_k=3).collect()
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 5)
    documents, seen = counted(spark, documents, "content")
    assert sorted(retrieval.keyword_search(documents, queries, top_k=3, block_rows=2).collect()) == sorted(one)
    # Scans hold whole blocks: two of two rows each.
    assert seen.value == 150


def test_repeated_ids_in_different_blocks_are_ranked_apart(spark):
    documents = spark.createDataFrame([(n, None, f"red {n}", None, [1.0, float(n)]) for n in range(9)], "id bigint, title string, content string, consultant_name string, content_vector array<double>")
    queries = spark.createDataFrame([(1, "red", [1.0, 2.0])] * 4, "query_id bigint, query string, query_vector array<double>").coalesce(1)
    ranks = [r["rank"] for r in retrieval.keyword_search(documents, queries, top_k=3, block_rows=2).collect()]
    assert sorted(ranks) == [1, 1, 2, 2, 3, 3]
    assert retrieval.vector_search(documents, queries, dimensions=2, block_rows=2).count() == 36
