"""Snapshots as intervals: any day comes back, and only changes are stored."""

import datetime as dt
import random

from lonja.operators import history

DAY = dt.date(2024, 1, 1)
CELLS = "item string, store string, qty int"


def at(n):
    return DAY + dt.timedelta(days=n)


def test_any_day_can_be_read_back(spark, rows, tmp_path):
    rnd = random.Random(3)
    frame = lambda cells: spark.createDataFrame([(*k, q) for k, q in cells.items()], CELLS)
    cells = {(i, s): rnd.choice([1, 2, None]) for i in "abcdefgh" for s in ("1", None)}
    days = {0: dict(cells)}
    open_rows, ended = history.first_intervals(frame(cells), at(0)), []
    for n in (1, 2, 5, 6):
        for key in rnd.sample(sorted(cells, key=repr), 3):
            cells[key] = rnd.choice([3, 4, None])
        cells.pop(rnd.choice(sorted(cells, key=repr)))
        cells[f"new{n}", None] = n
        days[n] = dict(cells)
        for step in range(2):  # the same snapshot twice
            gone, open_rows = history.next_intervals(open_rows, frame(cells), at(n), ["item", "store"])
            open_rows.write.parquet(str(tmp_path / f"open-{n}-{step}"))
            gone.write.parquet(str(tmp_path / f"gone-{n}-{step}"))
            open_rows, gone = spark.read.parquet(str(tmp_path / f"open-{n}-{step}")), spark.read.parquet(str(tmp_path / f"gone-{n}-{step}"))
            ended.append(gone)
            assert not step or gone.count() == 0
    whole = open_rows
    for x in ended:
        whole = whole.unionByName(x)
    for n in range(9):
        held = days[max(d for d in days if d <= n)]
        assert rows(history.as_of(whole, at(n))) == sorted([(*k, q) for k, q in held.items()], key=repr), n
    assert rows(history.as_of(whole, at(-1))) == []
    # 16 cells at first, then at most 3 changed, 1 closed and 1 new a day
    assert whole.count() <= 16 + 4 * (3 + 1)


def test_an_unchanged_snapshot_stores_nothing(spark, rows):
    cells = spark.createDataFrame([("a", "1", 1), ("b", None, None)], CELLS)
    first = history.first_intervals(cells, at(0))
    gone, lasting = history.next_intervals(first, cells, at(9), ["item", "store"])
    assert rows(gone) == [] and rows(lasting) == rows(first)
    gone, lasting = history.next_intervals(first, cells.limit(0), at(9), ["item", "store"])
    assert rows(lasting) == [] and rows(gone) == [("a", "1", 1, at(0), at(9)), ("b", None, None, at(0), at(9))]


def test_a_history_computes_the_stock_once(spark, monkeypatch):
    from lonja.catalog import analyses
    from lonja.sources.tpch import tpch_star

    plans, write = [], analyses.written

    def watched(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(analyses, "written", watched)
    analyses._history(tpch_star(spark, "/root/testdata/sf0.001"))
    assert sum("lineitem.parquet" in x for x in plans) == 1 and len(plans) == 3


def test_one_pass_gives_what_ends_and_what_lasts(spark, rows):
    before = history.first_intervals(spark.createDataFrame([("a", "1", 1), ("b", None, 2), ("c", "1", None)], CELLS), at(0))
    today = spark.createDataFrame([("a", "1", 5), ("c", "1", None), ("d", None, 4)], CELLS)
    found = history.changed_intervals(before, today, at(3), ["item", "store"])
    assert rows(found) == sorted([("a", "1", 1, at(0), at(3)), ("a", "1", 5, at(3), None), ("b", None, 2, at(0), at(3)),
                                  ("c", "1", None, at(0), None), ("d", None, 4, at(3), None)], key=repr)
