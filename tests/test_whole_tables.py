"""Queries cover every row, as their SQL does: neither has the filters that once cut them down."""

import duckdb
import pytest

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.001"


def whole(name, table, cut):
    sql = registered.oracle_sql()[name]
    assert cut.strip() not in sql
    with duckdb.connect() as db:
        for t in (table, "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        return sorted(db.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["span_mask", "combine_masks", "confidence_unmask", "masked_counts", "unmask_loop"])
def test_masks_cover_every_customer(spark, name):
    got = sorted(tuple(r) for r in registered.queries()[name](spark, SF_DIR).collect())
    assert got == whole(name, "customer", " WHERE c_custkey < 50")


def test_code_lookup_covers_every_line(spark):
    got = sorted(tuple(r) for r in registered.queries()["code_lookup"](spark, SF_DIR).collect())
    assert got == whole("code_lookup", "lineitem", " WHERE l_linenumber = 1")


def test_spans_cover_every_codebook(spark):
    got = sorted(tuple(r) for r in registered.queries()["span_by_item"](spark, SF_DIR).collect())
    assert got == whole("span_by_item", "customer", " WHERE codebook < 2") and len(got) == 150 * 9 * 100
