import numpy as np
import pytest

from crewcast.operators import retrieval
from crewcast.operators.filters import equality_filter

DOCS = [
    ("d1", "Jane profile", "Jane has Azure architecture experience.", "Jane", "profile"),
    ("d2", None, "azure azure AZURE", None, "profile"),
    ("d3", "Spark notes", "Apache Spark and Azure Databricks", "Ann", "notes"),
    ("d4", "", "nothing here", "Bob", "notes"),
    ("d5", "été", "l'été à Nice", "Zoë", "notes"),
]
QUERIES = [("q1", "Azure experience  azure"), ("q2", "spark"), ("q3", "zzz"), ("q4", "ÉTÉ a"), ("q5", "  ")]


def brute_force(docs, queries):
    found = []
    for query_id, query in queries:
        for doc_id, title, content, name, _ in docs:
            text = f"{title or ''} {content} {name or ''}".lower()
            score = sum(word in text for word in set(query.lower().split()))
            if score:
                found.append((query_id, doc_id, score))
    return sorted(found)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(DOCS, "id string, title string, content string, consultant_name string, source_type string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


@pytest.mark.parametrize("bound", [retrieval.BLOCK_ROWS, 2])
def test_keyword_scores_on_both_routes(documents, queries, bound):
    scored = retrieval.keyword_search(documents, queries, block_rows=bound)
    assert sorted((r.query_id, r.id, r.score) for r in scored.collect()) == brute_force(DOCS, QUERIES)


def test_keyword_without_automaton(documents, queries, monkeypatch):
    vocabulary = retrieval._Vocabulary([["azure", "a"], ["spark"]])
    vocabulary.automaton = None
    assert vocabulary.scores("spark on azure").tolist() == [2, 1]
    assert vocabulary.scores("").tolist() == [0, 0]


def test_keyword_routes_agree_on_larger_data(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(200)]
    docs = [(f"d{n:03}", "", " ".join(rng.choice(words, 12)), "", "x") for n in range(300)]
    asked = [(f"q{n}", " ".join(rng.choice(words, 4))) for n in range(20)]
    documents = spark.createDataFrame(docs, "id string, title string, content string, consultant_name string, source_type string")
    queries = spark.createDataFrame(asked, "query_id string, query string")
    results = []
    for bound in (retrieval.BLOCK_ROWS, 2):
        found = retrieval.keyword_search(documents, queries, top_k=7, block_rows=bound)
        results.append(sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect()))
    expected = {}
    for query_id, doc_id, score in brute_force(docs, asked):
        expected.setdefault(query_id, []).append((-score, doc_id))
    best = sorted((q, n, d, -s) for q, hits in expected.items() for n, (s, d) in enumerate(sorted(hits)[:7], 1))
    assert results[0] == results[1] == best


def test_top_k_and_filters(documents, queries):
    best = retrieval.keyword_search(documents, queries, top_k=1, filters={"source_type": "notes", "id": None})
    assert sorted((r.query_id, r.id, r.rank) for r in best.collect()) == [("q1", "d3", 1), ("q2", "d3", 1), ("q4", "d3", 1)]
    with pytest.raises(ValueError, match="top_k must be greater than zero"):
        retrieval.keyword_search(documents, queries, top_k=0)


def vectors(spark, count, queries):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(count, 8)).astype(np.float32)
    docs[5] = docs[4]  # a tie, decided by id
    docs[6] = 0
    asked = rng.normal(size=(queries, 8)).astype(np.float32)
    asked[0] = docs[4]
    left = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in enumerate(docs)], "id bigint, content_vector array<float>")
    right = spark.createDataFrame([(f"q{n:02}", [float(v) for v in row]) for n, row in enumerate(asked)], "query_id string, query_vector array<float>")
    return docs, asked, left, right


@pytest.mark.parametrize("bound", [retrieval.BLOCK_ROWS, 3])
def test_vector_search_in_one_and_many_blocks(spark, bound):
    docs, asked, left, right = vectors(spark, 150, 10)
    found = retrieval.vector_search(left, right, dimensions=8, block_rows=bound)
    ours = sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect())
    expected = []
    for n, q in enumerate(asked.astype(float)):
        scores = []
        for doc_id, d in enumerate(docs.astype(float)):
            norm = np.linalg.norm(d) * np.linalg.norm(q)
            scores.append((-round(float(d @ q / norm), 6) if norm else 0.0, doc_id))
        expected += [(f"q{n:02}", rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:30], 1)]
    assert [(q, r, d) for q, r, d, _ in ours] == [(q, r, d) for q, r, d, _ in sorted(expected)]
    assert np.allclose([o[3] for o in ours], [e[3] for e in sorted(expected)], atol=1.1e-6)
    assert [(r, d) for q, r, d, _ in ours if q == "q00"][:2] == [(1, 4), (2, 5)]


def test_vector_dimensions_are_checked(spark):
    _, _, left, right = vectors(spark, 20, 2)
    with pytest.raises(Exception, match="expected vectors of 9 numbers"):
        retrieval.vector_search(left, right, dimensions=9).collect()


def test_best_keeps_ties_across_compactions(monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 10)
    best = retrieval._Best(["q"], 3)
    for start in range(0, 60, 6):
        best.add(np.ones((6, 1)), np.arange(59 - start, 53 - start, -1))
    assert best.rows()["id"].tolist() == [0, 1, 2]


def test_best_per_person(spark):
    hits = spark.createDataFrame(
        [
            ("q", "d1", 0.5, 1, "7", "Jane"), ("q", "d2", 0.9, 2, "7", "Jane D."),
            ("q", "d3", None, 3, None, " ANN "), ("q", "d4", 0.0, 4, "", "ann"),
            ("q", "d5", 0.1, 5, None, None), ("q", "d6", 0.1, 6, None, None),
        ],
        "query_id string, id string, score double, rank int, consultant_id string, consultant_name string",
    )
    best = retrieval.best_per_person(hits).orderBy("position").collect()
    assert [(r.id, r.position) for r in best] == [("d2", 1), ("d3", 3), ("d5", 5), ("d6", 6)]


def test_document_context(spark):
    df = spark.createDataFrame([("Jane", "7", "T", None, "Overview", "Text")], "consultant_name string, consultant_id string, title string, source_file string, sheet_name string, content string")
    assert df.select(retrieval.document_context(df)).first()[0] == (
        "Consultant: Jane\nConsultant ID: 7\nTitle: T\nSheet: Overview\nContent:\nText"
    )


def test_equality_filter(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (None, None, None)], "n int, s string, b boolean")

    def kept(filters):
        return [r.n for r in df.filter(equality_filter(df, filters)).collect()]

    assert kept({"s": ["a", "b"]}) == [1, 2] and kept({"b": True}) == [1] and kept({"n": 2, "s": "b"}) == [2]
    assert kept({"s": [], "n": None}) == [1, 2, None] and kept(None) == [1, 2, None]


def test_hybrid_needs_no_vector(spark):
    docs = spark.createDataFrame([("a", "t", "spark", "", [1.0, 0.0]), ("b", "t", "spark sql", "", None)], "id string, title string, content string, consultant_name string, content_vector array<float>")
    asked = spark.createDataFrame([("q", "sql spark", [1.0, 0.0])], "query_id string, query string, query_vector array<float>")
    found = retrieval.hybrid_search(docs, asked, dimensions=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [("a", round(1 / 62 + 1 / 61, 6)), ("b", round(1 / 61, 6))]


def test_documents_of_many_files_stay_in_place(spark, tmp_path):
    rows = [(f"d{n}", "", f"word{n % 7} text", "", "x", [float(n % 5), 1.0]) for n in range(64)]
    schema = "id string, title string, content string, consultant_name string, source_type string, content_vector array<float>"
    spark.createDataFrame(rows, schema).repartition(16).write.parquet(str(tmp_path / "docs"))
    documents = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([("q", "word3", [1.0, 0.0])], "query_id string, query string, query_vector array<float>")
    for found in (retrieval.keyword_search(documents, queries, top_k=3), retrieval.vector_search(documents, queries, dimensions=2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("MapInPandas") :]
        assert "Exchange" not in below and "FileScan" in below
    assert [r.id for r in retrieval.keyword_search(documents, queries, top_k=3).orderBy("rank").collect()] == ["d10", "d17", "d24"]
