"""Portfolio sources and sinks (S1-S3): parquet round trip, load-or-derive, row ingestion."""

from creditspark.sources.portfolio import (
    PORTFOLIO_COLUMNS,
    PORTFOLIO_SCHEMA,
    derive_portfolio,
    ingest_rows,
    load_or_derive,
    read_portfolio,
    write_portfolio,
)

from conftest import SF_SMALL


def test_parquet_round_trip(spark, tmp_path):
    built = derive_portfolio(spark, SF_SMALL).select(*PORTFOLIO_COLUMNS)
    path = write_portfolio(built, str(tmp_path / "portfolio"))
    back = read_portfolio(spark, path)
    assert back.schema == PORTFOLIO_SCHEMA
    assert back.count() == built.count()
    assert back.exceptAll(built).count() == 0 and built.exceptAll(back).count() == 0


def test_partitioned_write_reads_back_whole(spark, tmp_path):
    built = derive_portfolio(spark, SF_SMALL).select(*PORTFOLIO_COLUMNS)
    path = write_portfolio(built, str(tmp_path / "by_term"), partition_by=["loan_term_months"])
    back = read_portfolio(spark, path)
    assert back.exceptAll(built).count() == 0 and built.exceptAll(back).count() == 0


def test_load_or_derive(spark, tmp_path):
    derived = load_or_derive(spark, str(tmp_path / "missing"), SF_SMALL)
    assert "segment" in derived.columns  # derived from the tables: carries the extra columns
    path = write_portfolio(derived.select(*PORTFOLIO_COLUMNS), str(tmp_path / "present"))
    loaded = load_or_derive(spark, path, SF_SMALL)
    assert loaded.columns == PORTFOLIO_COLUMNS
    assert loaded.count() == derived.count()


def test_ingest_forms_agree(spark):
    rows = [{"application_id": 1, "pd": 0.05, "loan_amount": 10000.0},
            {"application_id": 2, "pd": 0.30, "loan_amount": 2500.0}]
    cols = {"application_id": [1, 2], "pd": [0.05, 0.30], "loan_amount": [10000.0, 2500.0]}
    a = ingest_rows(spark, rows)
    b = ingest_rows(spark, cols)
    assert a.schema == b.schema
    assert sorted(a.collect()) == sorted(b.collect())
