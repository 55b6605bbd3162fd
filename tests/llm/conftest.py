import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tablework.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def docs_and_items():
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    return docs, items


@pytest.fixture(scope="session")
def labelled():
    return duckdb.sql(f"""SELECT d.doc_id, d.text, l.quality, l.toxic
        FROM '/root/testdata/sf0.01/documents.parquet' d
        JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id) ORDER BY doc_id""").fetchall()
