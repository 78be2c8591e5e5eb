"""Searches through the trigram index give what the scan gives."""

from __future__ import annotations

import pytest

from fieldbeat.functions.columns import clean_name
from fieldbeat.operators import merchants, text_index
from fieldbeat.operators.scope import Caller
from tests.small import AS_OF, MODEL

ADMIN = Caller("u01", "Admin")


@pytest.fixture(scope="module")
def indexed(spark, make_tables, tmp_path_factory):
    tables = make_tables(**MODEL)
    path = str(tmp_path_factory.mktemp("index") / "postings")
    text_index.write_index(tables.merchants, path)
    return tables, text_index.read_index(spark, path)


@pytest.mark.parametrize("text", [
    "store", "STORE", "a_s", "100%", "Beta_Store", "Alpha", "lpha goods", "zzz", "", "a", "st", "Alp%re", "\\%", "100\\% st",
    "KimK", "İst", "store "])
def test_same_results(indexed, text):
    tables, index = indexed
    few = text_index.candidates(tables, index, text)
    want = merchants.search_merchants(tables, text, ADMIN, AS_OF).collect()
    assert merchants.search_merchants(few, text, ADMIN, AS_OF).collect() == want
    named = text_index.candidates(tables, index, clean_name(text), ("merchant_name",))
    assert merchants.find_merchant(named, text, ADMIN).collect() == merchants.find_merchant(tables, text, ADMIN).collect()
    assert few.merchants.columns == tables.merchants.columns


def test_pattern_grams():
    assert text_index.pattern_grams("%Store%") == ["ore", "sto", "tor"]
    assert text_index.pattern_grams("%a_cd%") == text_index.pattern_grams("%%") == []
    assert text_index.pattern_grams(r"%a\_b\%c%") == ["_b%", "a_b", "b%c"]
    assert text_index.pattern_grams("%caféteria%") == ["caf", "eri", "ria", "ter"]


def test_postings(make_df, rows_of):
    table = make_df("id string, merchant_name string, area string", [
        {"id": "m01", "merchant_name": "AbcAbc", "area": "x"}, {"id": "m02"}, {"id": "m03", "merchant_name": "ab"}])
    got = rows_of(text_index.postings(table, ("merchant_name", "area")), "gram", "field", "id")
    assert sorted(got) == [(g, "merchant_name", "m01") for g in ("abc", "bca", "cab")]


def test_a_search_reads_its_own_postings_only(indexed):
    tables, index = indexed
    plan = text_index.candidates(tables, index, "store").merchants._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [ore,sto,tor])" in plan
    short = text_index.candidates(tables, index, "st")
    assert short is tables
