"""Every query that has a SQL twin against it, on the smallest tables."""

import glob
import os

import pytest

from codeloom import queries

DATA = "/root/testdata/sf0.001"


def tidy(rows):
    def cell(x):
        if isinstance(x, float):
            return round(x, 6)
        return repr(x)

    return sorted(tuple(str(cell(x)) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the standard tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect(config={"threads": 2})
    for path in glob.glob(DATA + "/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = db.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    assert tidy(tuple(r[c] for c in columns) for r in got.collect()) == tidy(db.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())
