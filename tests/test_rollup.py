"""A roll-up kept from changed rows equals one computed from all rows, and reads none of the old ones."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lonja.operators import publish
from lonja.plans import home
from lonja.sources.star import FrameStar

AS_OF = dt.date(2024, 3, 20)
TICKETS = "ticket_id long, store string, sale_date date, net decimal(15,2), is_sale boolean"


def random_tickets(rnd, ids):
    from decimal import Decimal

    return {i: (i, rnd.choice("ABC"), AS_OF - dt.timedelta(days=rnd.choice([0, 1, 2, 5, 30, 31, 60, 366])), Decimal(rnd.randint(100, 9999)) / 100, rnd.random() < 0.8)
            for i in ids}


def test_random_changes(spark, rows, tmp_path):
    rnd = random.Random(5)
    frame = lambda data: spark.createDataFrame(list(data), TICKETS)
    stores = spark.createDataFrame([(x, None, None) for x in "ABC"], "store string, name string, town string")
    star = lambda data: FrameStar(spark, {"tickets": frame(data), "stores": stores})
    roll = home.store_days()
    table = publish.stored_table(spark, str(tmp_path / "days"), home.STORE_DAYS_SCHEMA, ["store", "sale_date"], partition="month")
    held = random_tickets(rnd, range(120))
    some = star(held.values())
    table.replace(roll.build(home.with_month(some, some.tickets)))
    for batch in (1, 2, 3):
        changed = rnd.sample(sorted(held), 30)
        old = [held[i] for i in changed]
        for i in changed[:15]:
            del held[i]
        held |= random_tickets(rnd, changed[15:]) | random_tickets(rnd, range(1000 * batch, 1000 * batch + 10))
        new = [held[i] for i in [*changed[15:], *range(1000 * batch, 1000 * batch + 10)]]
        now = star(held.values())
        delta = roll.delta(home.with_month(now, frame(old)), home.with_month(now, frame(new)), batch)
        roll.maintain(table, delta)
        files = sorted((tmp_path / "days").rglob("*.parquet"))
        roll.maintain(table, delta)  # a batch that runs again writes nothing
        assert sorted((tmp_path / "days").rglob("*.parquet")) == files
        days = home.kept_days(table)
        full = home.daily(now).where("tickets > 0 OR returns > 0")
        assert rows(days.select(*full.columns)) == rows(full)
        assert rows(home.scorecard(now, AS_OF, days)) == rows(home.scorecard(now, AS_OF))
        assert rows(home.last_sales(now, days)) == rows(home.last_sales(now))
        assert rows(home.store_streaks(now, AS_OF, days=days)) == rows(home.store_streaks(now, AS_OF))
    # the store's newest sales go: the last sale falls back
    gone = [t for t in held.values() if t[1] == "A" and t[4] and t[2] > AS_OF - dt.timedelta(days=30)]
    roll.maintain(table, roll.delta(home.with_month(now, frame(gone)), home.with_month(now, frame([])), 4))
    last = dict(rows(home.last_sales(now, home.kept_days(table))))
    assert last["A"] == max(t[2] for t in held.values() if t[1] == "A" and t[4] and t not in gone)


def test_no_old_ticket_is_read(spark, rows, tmp_path):
    path, cells = str(tmp_path / "tickets"), str(tmp_path / "cells")
    spark.createDataFrame(list(random_tickets(random.Random(1), range(50)).values()), TICKETS).write.parquet(path)
    stores = spark.createDataFrame([(x, None, None) for x in "ABC"], "store string, name string, town string")
    star = FrameStar(spark, {"tickets": spark.read.parquet(path), "stores": stores})
    roll = home.store_days()
    table = publish.stored_table(spark, cells, home.STORE_DAYS_SCHEMA, ["store", "sale_date"], partition="month")
    table.replace(roll.build(home.with_month(star, star.tickets)))
    days = home.kept_days(table)
    for df in (home.scorecard(star, AS_OF, days), home.last_sales(star, days), home.store_streaks(star, AS_OF, days=days),
               home.return_outliers(star, AS_OF, days=days).select("store")):
        assert not any(f.startswith("file:" + path) or path + "/" in f for f in df.inputFiles()) and df.inputFiles()
    old = home.with_month(star, star.tickets.where("ticket_id = 7"))
    one = table.read_for(roll.delta(old, old.limit(0), 1).select(*table.schema.names))
    assert {m for (m,) in one.select("month").distinct().collect()} == {m for (m,) in old.select("month").collect()}
