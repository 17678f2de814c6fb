"""The registered queries over the test tables, and every operator over awkward ones."""

import os
import shutil
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

from findloom.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, con, name):
    query, sql = llm.queries()[name], llm.oracle_sql().get(name)
    if sql is None:
        table = "pages" if name.startswith(("op2_", "op9_")) else "documents"
        n = spark.read.parquet(f"{SF}/{table}.parquet").count()
        got = query(spark, SF).count()
        assert got >= n if name.startswith("op10_") else got == n
    else:
        assert oracle.compare(spark, con, query, sql, SF)[1] == ""
    spark.catalog.clearCache()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
    whole = corpus_pipeline.run(spark, SF)
    assert whole.agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


CLASHING = ["row_key", "t", "own", "spans", "row", "words", "places", "fp", "id", "host", "key", "digest", "start", "h", "label", "kept"]


@pytest.fixture(scope="module", params=["empty", "nulls"])
def odd_tables(spark, request, tmp_path_factory):
    """Tables without rows, and tables of nulls, repeats and a very long text, all with clashing columns."""
    root = tmp_path_factory.mktemp(request.param)
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = {
        "documents": [(0, None), (1, ""), (1, ""), (2, "some words here"), (2, "some words here"), (None, "lost id"), (None, None), (3, long), (4, long), (5, " \n\t"), (6, "\u0000 ok é")],
        "pages": [(0, None, None), (1, "", ""), (1, "", ""), (2, "http://a.b/c", "<p>x"), (None, "http://a.b/d", "<p>y"), (4, "nonsense", "<p>x"), (5, "http://", long)],
        "labels": [(0, None, None), (None, 1, 0), (2, 1, 0), (2, 1, 0), (5, 0, 1), (3, 0, None)],
        "benchmark": [(0, None), (1, ""), (None, "some words here"), (3, "some words here"), (3, "some words here")],
        "conversations": [(0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (None, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 2, "user", long)],
    }
    schema = {"conversations": "conv_id long, turn int, role string, text string", "documents": "doc_id long, text string", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, s in schema.items():
        df = spark.createDataFrame(rows[name] if request.param == "nulls" else [], s)
        if name == "documents":
            df = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
        for c in CLASHING if name != "labels" else ["url", "label"]:
            df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{root}/{name}.parquet")
    yield request.param, str(root)
    shutil.rmtree(root)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_odd_tables(spark, odd_tables, name):
    kind, root = odd_tables
    got = llm.queries()[name](spark, root).collect()
    if name.startswith("op11_"):
        assert bool(got) == (kind == "nulls")
        return
    table = "pages" if name.startswith(("op1_", "op2_", "op9_")) else "documents"
    n = spark.read.parquet(f"{root}/{table}.parquet").count()
    assert len(got) >= n if name.startswith("op10_") else len(got) == n
    spark.catalog.clearCache()


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_tables(spark, odd_tables, stage):
    _, root = odd_tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    out = llm.STAGES[stage][1](spark, docs, root)
    assert out.columns == docs.columns
    assert all(r[c] == "clash" for r in out.collect() for c in CLASHING)
    spark.catalog.clearCache()


def test_the_rest_does_not_need_this_package():
    here = Path(__file__).parents[2]
    for path in here.glob("findloom/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert not os.path.exists(here / "findloom/llm/data")
