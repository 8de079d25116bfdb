import datetime as dt
import hashlib
import os
import random
import shutil
from bisect import bisect_right
from decimal import Decimal
from itertools import accumulate

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from lastleg.operators.resample import weighted_resample
from lastleg.operators.selection import exact_quantile
from lastleg.plans import etl
from lastleg.plans.warehouse import warehouse
from lastleg.sources import tables


@pytest.fixture(scope="module")
def values(spark):
    """Groups of many values, of one value, with a hot value at a rank, of two values, and without one."""
    rng = random.Random(1)
    many = [rng.lognormvariate(0, 3) for _ in range(3000)] + [5.0] * 1500 + [-1.0] * 100
    groups = {"many": many, "few": many[:501], "one": [7.0] * 2000, None: many[1000:2250], "two": [1.0] * 250 + [2.0] * 250, "none": [None]}
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(6)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95])
@pytest.mark.parametrize("sort_rows", [50, 1_000_000])
def test_selection_equals_sorting(values, share, sort_rows):
    got = {r["g"]: r["value"] for r in exact_quantile(values, "v", share, ("g",), sort_rows=sort_rows).collect()}
    groups = {}
    for r in values.where("v IS NOT NULL").collect():
        groups.setdefault(r["g"], []).append(r["v"])
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        vs.sort()
        at = share * (len(vs) - 1)
        low, part = int(at), at - int(at)
        want = vs[low] if part == 0 else (1 - part) * vs[low] + part * vs[low + 1]
        assert got[g] == pytest.approx(want, rel=1e-12)


def test_selection_without_groups_or_values(spark, values):
    assert exact_quantile(values, "v", 0.5, sort_rows=100).collect()[0]["value"] == values.agg(F.median("v")).first()[0]
    assert exact_quantile(values.where("g = 'none'"), "v", 0.5).collect() == []


def test_resample_equals_a_walk_along_the_line(spark):
    """One row holds a third of all weight; rows without weight are never drawn."""
    rows = [(f"k{i}", 25_000 if i == 7 else i % 50 if i % 11 else None) for i in range(2000)] + [(None, 5), ("n", -3)]
    got = weighted_resample(spark.createDataFrame(rows, "id string, w long"), "id", "w", 4000).collect()
    total = sum(w for k, w in rows if k and w and w > 0)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    line = sorted(((w * 1000 <= total, md5(k) + k, k, w) for k, w in rows if k and w and w > 0))
    ends = list(accumulate(x[3] for x in line))
    want = {i: line[bisect_right(ends, int(md5(str(i))[:14], 16) % total)][2] for i in range(4000)}
    assert len(got) == 4000 and {r["draw"]: r["id"] for r in got} == want
    assert weighted_resample(spark.createDataFrame([("a", 0)], "id string, w long"), "id", "w", 5).collect() == []


def test_update_writes_changed_days_alone(spark, make_orders, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1 + i, 12)
    rows = [dict(order_id=f"ORD{i}", created_at=day(i % 6)) for i in range(30)]
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")

    def files():
        top = f"{out}/orders_enriched.parquet"
        return {d: {(f, os.stat(f"{top}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{top}/{d}")} for d in os.listdir(top) if "=" in d}

    def update(orders, compare=False):
        tables.write_table(make_orders(*orders), raw, "orders")
        before = files() if os.path.isdir(out) else {}
        found = etl.update(spark, raw, out)
        full = etl.run(spark, raw, str(tmp_path / f"full{len(orders)}")) if compare else {}
        for name in ("orders_enriched", "city_daily_kpis") if compare else ():
            a, b = found[name], full[name].select(*found[name].columns)
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        after = files()
        return {d for d in before.keys() | after.keys() if before.get(d) != after.get(d)}

    assert len(update(rows)) == 6
    assert update(rows) == set()
    rows[8]["status"] = "delayed"
    assert len(update(rows)) == 1
    assert len(update([r for r in rows if r["created_at"] != day(5)], compare=True)) == 1
    rows[3]["congestion_factor"] = Decimal("1.900")  # moves the mean of a city and hour that all days share
    assert len(update(rows, compare=True)) == 6


def test_changed_files_are_noticed(spark, tmp_path):
    for name in ("lineitem", "orders", "supplier", "customer", "events"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path)
    folder = str(tmp_path)
    first = warehouse(spark, folder)
    rows = first.deliveries.count()
    assert warehouse(spark, folder) is first
    lines = pq.read_table(f"{folder}/lineitem.parquet")
    pq.write_table(lines.slice(0, 1000), f"{folder}/lineitem.parquet")
    assert warehouse(spark, folder).deliveries.count() < rows
