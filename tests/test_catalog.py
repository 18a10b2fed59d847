"""Catalogue queries with SQL give DuckDB's rows; the others run and keep their promises."""

import duckdb
import pytest

from wordflow import catalog
from wordflow.plans import inspect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    want = db.sql(catalog.ORACLES[name])
    got = [plain(tuple(r)) for r in catalog.QUERIES[name](spark, SF).select(*want.columns).collect()]
    assert sorted(got, key=str) == sorted((plain(r) for r in want.fetchall()), key=str)


def test_suggestions_are_words_of_the_lexicon(spark):
    lex = {r.word for r in catalog.docs_lexicon(spark, SF).collect()}
    for name in ("suggest_ranked", "suggest_legacy", "symspell_slate"):
        rows = catalog.QUERIES[name](spark, SF).collect()
        assert rows and all(r.word in lex and r.query not in lex for r in rows)
        assert all(1 <= r["rank"] <= 5 for r in rows) and len({(r.query, r["rank"]) for r in rows}) == len(rows)


def test_keyboard_candidates_are_two_operations_away(spark):
    from wordflow.operators.candidates import _keyboard_once, keyboard_round

    one = spark.createDataFrame([("helo", "helo"), ("a-b", "a-b"), ("é", "é")], "query string, variant string")
    rows = keyboard_round(one).collect()
    for q in ("helo", "a-b", "é"):
        assert {r.variant for r in rows if r.query == q} == _keyboard_once(q)


def test_plans_have_no_nested_loops(spark):
    for name in ("edit_candidates", "symspell_slate", "ngram_candidates", "osa_within_1", "semantic_neighbors", "typo_rescored", "hit_at_k", "edit_sweep_hits", "two_part_compounds", "latency_stats", "bucket_oov", "phonetic_candidates"):
        assert inspect.quadratic_nodes(catalog.QUERIES[name](spark, SF)) == []


def test_scans_read_only_what_they_use(spark):
    assert inspect.read_columns(catalog.token_counts_by_lang(spark, SF)) == ["lang", "text"]
    assert inspect.exchanges(catalog.token_counts_by_lang(spark, SF)) == 1
    assert inspect.exchanges(catalog.content_digest(spark, SF)) == 0
