"""The training-data queries against their SQL twins on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ridgewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    got = sorted((tuple(map(plain, row)) for row in df.select(*columns).collect()), key=repr)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[k]) for k in order) for row in found.fetchall()), key=repr)
