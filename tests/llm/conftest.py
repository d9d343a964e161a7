import duckdb
import pytest

from tablescope.llm.queries import ORACLES, QUERIES
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def corpus(spark, tmp_path):
    """Write rows of (doc_id, text) as a documents table and read it again."""

    def make(rows, extra="", files=3):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        path = f"{tmp_path}/{extra or 'set'}"
        df.repartition(files).write.parquet(f"{path}/documents.parquet")
        return path

    return make


def run(spark, name, sf_dir=SF001):
    return QUERIES[name](spark, sf_dir)


def same_as_sql(spark, name, sf_dir=SF001, tables=("documents",)):
    """Rows of the query against rows of its SQL, in any order."""
    con = duckdb.connect()
    import os

    for t in tables:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    want = con.execute(ORACLES[name]).fetchall()
    names = [c[0] for c in con.description]
    df = run(spark, name, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
