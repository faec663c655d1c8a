"""Trigram searches and laid-out pages give what the plain forms give."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thali.operators import listings, pages, text_search
from thali.sources.tables import load_tables


@pytest.fixture(scope="module")
def t(spark):
    return load_tables(spark, SF_SMALL)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def people(spark, t):
    odd = [(-1, "50%_off Deals", "+91 99", None), (-2, None, None, None), (-3, "\u00c4nne \u00d6Z", "", "anne@x.org"), (-4, "ab", "a_b", "a\\b@x.org"), (-5, "aXb", "abc", "ABC@X.ORG")]
    more = spark.createDataFrame(odd, "id long, full_name string, phone string, email string")
    return t["users"].select("id", "full_name", "phone", "email").unionByName(more).cache()


@pytest.mark.parametrize("text", ["er#0000001", "ER#00000", "50%_off", "50%off", "%", "_", "a_b", "ab", "a", "", None, "\u00e4nne", "\u00f6z", "x.o%g", "a\\\\b", "99", "no such one"])
def test_indexed_search_equals_the_plain_one(spark, people, scratch, text):
    index = text_search.TextIndex(spark, os.path.join(scratch, "i"), "id")
    if text and text_search.grams_of(spark, text):
        index.build(people, text_search.customer_texts())
    assert rows(index.search(people, text, listings.search_customers)) == rows(listings.search_customers(people, text))


def test_many_found_rows_are_joined(spark, people, scratch, monkeypatch):
    monkeypatch.setattr(text_search, "KEYS_LISTED", 3)
    index = text_search.TextIndex(spark, os.path.join(scratch, "i"), "id").build(people, text_search.customer_texts())
    assert rows(index.search(people, "user1", listings.search_customers)) == rows(listings.search_customers(people, "user1"))


def test_a_search_reads_postings_and_keys(spark, t, scratch):
    path = os.path.join(scratch, "orders")
    t["orders"].write.parquet(path)
    orders = spark.read.parquet(path)
    index = text_search.TextIndex(spark, os.path.join(scratch, "i"), "order_id").build(orders, text_search.order_texts())
    found = index.candidates("user12@")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and plan.count("FileScan parquet") == 1 and path not in plan
    plan = index.search(orders, "user12@", listings.search_orders)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\(order_id", plan) and "Join" not in plan


def test_pages_equal_offsets(spark, t, scratch):
    listing = listings.orders_listing(t["orders"], t["order_items"], t["payments"])
    sort = listings._listing_sort()
    laid = pages.PagedListing(spark, os.path.join(scratch, "l")).lay_out(listing, sort, ranges=7)
    assert len(laid.directory()) == 7
    total, last = laid.counts()
    assert total == listing.count() and last == -(-total // 20)
    whole = [tuple(r) for r in listing.orderBy(*sort).collect()]
    for page in (1, 2, last // 2, last - 1, last, last + 1):
        out = laid.page(page, sort)
        assert [tuple(r) for r in out.collect()] == whole[20 * page - 20:20 * page]
        assert len({re.search("_range=([0-9]+)", f)[1] for f in out.inputFiles()}) <= 2
    with pytest.raises(ValueError):
        laid.page(0, sort)


def test_pages_of_ties_and_of_nothing(spark, scratch):
    sort = [F.col("k").desc_nulls_first(), F.col("id").asc()]
    ties = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"))
    laid = pages.PagedListing(spark, os.path.join(scratch, "a")).lay_out(ties, sort, ranges=5)
    want = [tuple(r) for r in ties.orderBy(*sort).collect()]
    assert [tuple(r) for p in range(1, 16) for r in laid.page(p, sort).collect()] == want
    none = pages.PagedListing(spark, os.path.join(scratch, "b")).lay_out(ties.limit(0), sort)
    assert none.counts() == (0, 0) and none.page(1, sort).collect() == []
