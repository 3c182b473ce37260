"""Lines as larger tables have them: nodes of one customer at one place."""

import datetime
import random

import pytest

from __spark_entry__ import oracle_sql, queries
from gaugeloom.operators import lines

from . import oracle


def test_merged_lines_of_nodes_at_one_place(spark, tmp_path):
    """Places of orders repeat after 997,000 keys, as they do in larger tables; orders are told apart by their keys."""
    day = datetime.datetime(2024, 1, 1)
    keys = [(1, [10, 11, 12, 997_010, 997_012, 997_013, 997_014]), (2, [20, 21, 22, 23, 24, 25, 997_020]), (3, [30, 31, 997_030, 997_031, 997_032, 997_033, 997_034]), (8, list(range(50, 62)))]
    rows = [(k, c, "O", 1.0, day, "x") for c, own in keys for k in own]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"c{c}", 1, 0.0, "S") for c, _ in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = oracle.connect(str(tmp_path))
    for name in ("merged_lines", "named_street_component"):
        assert not oracle.difference(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name])


@pytest.mark.parametrize("share", [20_000, 60])
def test_crossings_are_made_in_blocks(spark, monkeypatch, share):
    """Blocks of many segments are split into pairs of shares; pairs aren't rows of a join. Against all pairs."""
    monkeypatch.setattr(lines, "SHARE", share)
    rnd = random.Random(8)
    told = [(i, [(rnd.gauss(0, 0.2 if i % 2 else 5), rnd.gauss(0, 0.2 if i % 2 else 5)) for _ in range(5)]) for i in range(80)]
    v = spark.createDataFrame([(i, k, *p) for i, own in told for k, p in enumerate(own)], "line_id long, seq int, x double, y double")
    df = lines.segment_crossings(v)
    assert "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.a, r.b, r.a_seq, r.b_seq) for r in df.collect())
    want = []
    for i, p in told:
        for j, q in told[i + 1 :]:
            for m in range(4):
                for n in range(4):
                    (ax, ay), (bx, by) = (tuple(o[k + 1][z] - o[k][z] for z in (0, 1)) for o, k in ((p, m), (q, n)))
                    qx, qy, turn = q[n][0] - p[m][0], q[n][1] - p[m][1], ax * by - ay * bx
                    if 0 <= (qx * by - qy * bx) / turn <= 1 and 0 <= (qx * ay - qy * ax) / turn <= 1:
                        want.append((i, j, m, n))
    assert got == sorted(want)
