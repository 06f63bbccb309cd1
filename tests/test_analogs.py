"""Each query over the star-schema tables against its SQL in DuckDB."""

import math
import os

import pandas as pd
import pytest

from stowline.plans import analogs, replays

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("module, name", [(m, n) for m in (analogs, replays) for n in sorted(m.SQL)])
def test_query_equals_sql(spark, module, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = module.QUERIES[name](spark, DATA).toPandas(), con.sql(module.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_ages_count_fractions_of_a_second(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    times = "('2024-01-10 12:00:00.5'), ('2024-01-10 12:00:00'), ('2024-01-10 11:59:59.999999'), ('2024-01-21 00:00:00.000001'), ('2024-01-20 23:59:59.999999')"
    props = "concat('{\"k\": ', row_number() OVER () % 12, '}')"
    con.sql(f"COPY (SELECT row_number() OVER () AS event_id, cast(t AS TIMESTAMP) AS ts, cast(1 AS BIGINT) AS user_id, 'view' AS event_type, 1.0 AS value, {props} AS props FROM (VALUES {times}) v(t)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(replays.QUERIES["holding_scores"](spark, str(tmp_path)).toPandas()) == rows(con.sql(replays.SQL["holding_scores"]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["correlate_fold", "parse_moves"])
def test_request_numbers_beyond_32_bits(spark, tmp_path, name):
    """Orders of a table so large that the lines' request numbers need more than 32 bits; SQL's own INTEGER can't hold them."""
    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (l_orderkey + 53850000 * (l_orderkey % 2) AS l_orderkey) FROM '{DATA}/lineitem.parquet' WHERE l_orderkey < 50) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got, want = analogs.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(analogs.SQL[name].replace("AS INTEGER) AS request_no", "AS BIGINT) AS request_no")).df()
    assert want["line_offset"].max() > 2**32
    assert rows(got) == rows(want)
