"""Every query with SQL against DuckDB, as the driver compares them, on the tables that it uses and on the smallest."""

import duckdb
import pytest

from terralith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Cheap queries run on both sizes; those that write files or fit cameras run on one.
FOLDERS = ("/root/testdata/sf0.01", "/root/testdata/sf0.001")
ONCE = ("fit_exterior", "fit_frame", "scan_heads", "scan_raster", "scan_glob", "write_tiles", "rpc_yaml", "orthorectify", "sharpen_images")


@pytest.fixture(scope="module")
def connections():
    out = {}
    for folder in FOLDERS:
        out[folder] = duckdb.connect()
        for t in TABLES:
            out[folder].execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return out


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connections, name, folder):
    if name in ONCE and folder != FOLDERS[0]:
        pytest.skip("runs on one size")
    got = catalog.queries()[name](spark, folder).toPandas()
    sql = catalog.oracle_sql().get(name)
    assert sql, "every query of the engine has SQL"
    want = connections[folder].execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
