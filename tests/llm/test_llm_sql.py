"""The SQL of the queries against their rows, on small tables with copies, repeated passages, nulls and empty texts."""

import random

import pytest

from graphloom.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = prose(120), prose(120)
    texts = [prose(rng.randint(1, 150)) for _ in range(20)] + [base, base, base.upper(), base + " more", "x " + base]
    texts += [prose(30) + " " + passage + prose(20), passage + prose(40), "ab" * 600, None, "", " \t", "one", "One"]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    first = [rng.gauss(0, 1) for _ in range(16)]
    vectors = [first, [x + rng.gauss(0, 0.2) for x in first], [2 * x for x in first], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, first[:8]] + [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op2_repeated_passages", "op3_embedding_dedup", "op8_minhash_dedup"])
def test_sql_gives_the_rows_of_the_query(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    with duckdb.connect() as con:
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want) and len({r[1] for r in rows}) > 1
