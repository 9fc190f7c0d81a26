import datetime

import duckdb
import pytest
from logquarry.plans import queries
from logquarry.plans.queries import QUERIES


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Small tables with the names and types that the queries read."""
    d = str(tmp_path_factory.mktemp("tables"))
    con = duckdb.connect()
    start = "TIMESTAMP '2024-01-01 00:00:11.172425'"
    makers = {
        "events": f"SELECT i AS event_id, {start} + to_microseconds(CAST(i * 977777777 AS BIGINT)) AS ts, i * 37 % 11 AS user_id, ['error','view','click'][1 + i % 3] AS event_type, CAST(round(i * 1.37, 2) AS DOUBLE) AS value, '{{\"k\": ' || i || '}}' AS props FROM range(900) t(i)",
        "orders": f"SELECT i AS o_orderkey, i % 40 + 450 AS o_custkey, 'O' AS o_orderstatus, CAST(i * 3.25 AS DOUBLE) AS o_totalprice, {start} AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(60) t(i)",
        "customer": "SELECT i AS c_custkey, 'Customer ' || i AS c_name, CAST(i AS INT) AS c_nationkey, CAST(1.5 * i AS DOUBLE) AS c_acctbal, 'X' AS c_mktsegment FROM range(20) t(i)",
        "supplier": "SELECT i AS s_suppkey, 'S' AS s_name, CAST(1 AS INT) AS s_nationkey, CAST(1 AS DOUBLE) AS s_acctbal FROM range(1, 20) t(i)",
        "nation": "SELECT CAST(i AS INT) AS n_nationkey, 'N' || i AS n_name, CAST(i % 3 AS INT) AS n_regionkey FROM range(9) t(i)",
    }
    for name, sql in makers.items():
        con.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return d, con


def plain(rows, columns):
    def one(v):
        return v.isoformat() if isinstance(v, datetime.datetime) else float(v) if type(v).__name__ == "Decimal" else v

    order = sorted(columns)
    return sorted(repr([one(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_as_sql(spark, tables, name):
    d, con = tables
    query, sql = QUERIES[name]
    got = query(spark, d)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_all_events_are_expanded(spark, tmp_path):
    spark.range(2500).selectExpr("id AS event_id", "'click' AS event_type", "id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.xml for r in QUERIES["template_expand_all"][0](spark, str(tmp_path)).collect()}
    assert got == {k: f"<Event><Type>click</Type><User>{k % 7}</User></Event>" for k in range(2500)}


def test_dropping_sound_chunks_is_noticed(spark, tables, monkeypatch):
    monkeypatch.setattr(queries.rec, "valid_chunks", lambda chunks: chunks.where("chunk_index < 0"))
    assert queries.crc_drop_corrupt_chunk(spark, tables[0]).first().damaged_kept > 0
