"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from hingeworks.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_returns_every_document(spark, sf, name):
    if name == "op11_spelling_variants":
        pytest.skip("a row a word")
    table = {"op5_nearest_neighbours": None, "op8_url_filter": "pages"}.get(name, "documents")
    n = entry.queries()[name](spark, sf).count()
    assert n == (spark.read.parquet(f"{sf}/{table}.parquet").count() if table else 50)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[k] for k in sorted(r.asDict()))) for r in entry.queries()[name](spark, sf).collect()]
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] and sizes[4] == sizes[5] > 0
    assert docs.where("not round_trip").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in docs.collect())
