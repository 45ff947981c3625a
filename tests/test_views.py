"""The shared test views equal their SQL twins (the oracle's arithmetic)."""

import duckdb
import pytest

from geomart.plans import views as V

PAIRS = {
    "pt": (V.pt, V.PT_SQL),
    "area": (V.area, V.AREA_SQL),
    "ser": (V.ser, V.SER_SQL),
    "taq": (V.taq, V.TAQ_SQL),
    "edge": (V.edge, V.EDGE_SQL),
    "cal": (V.cal, V.CAL_SQL),
    "calx": (V.calx, V.CALX_SQL),
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_view_matches_sql(spark, sf_small, name):
    build, cte = PAIRS[name]
    sdf = build(spark, sf_small)
    cols = sorted(sdf.columns)
    got = sorted((tuple(r[c] for c in cols) for r in sdf.collect()), key=repr)
    con = duckdb.connect()
    for t in ["customer", "nation", "region", "orders", "lineitem", "supplier"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    cur = con.execute(V.with_ctes(cte) + f"SELECT {', '.join(cols)} FROM {name}")
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    assert got == want
