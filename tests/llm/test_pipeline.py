"""The pipeline's stages and its registration."""

import importlib

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import queries

from .conftest import sentence, table
from .test_texts import check_packing, toxic_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path, odd_rows):
    import random

    rng = random.Random(2)
    rows = [r[:3] for r in toxic_rows(200)] + [(1000 + i, t, s) for i, t, s in odd_rows]
    common, passage = sentence(rng, 12), sentence(rng, 30)
    rows += [(2000 + i, sentence(rng, 40) + "\n" + common, f"site{i % 20}") for i in range(40)]
    rows += [(3000, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40), "a")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[3]) for r in toxic_rows(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert not any(w in (t or "") for t in seen["toxicity"].values() for w in ("worthless", "disgusting"))
    assert sum(common in (t or "") for i, t in seen["line_dedup"].items() if i >= 2000) == 1
    assert 1004 in seen["ngram_jaccard"] and not {1005, 1006} & set(seen["ngram_jaccard"])
    assert passage not in seen["decontaminate"][3000]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 2048)


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and importlib.import_module("corpus_pipeline").ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())
