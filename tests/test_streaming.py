"""Streams over folders of small files: late rows, replay and state across batches."""

import datetime as dt
import random

from orderlens.operators import serving
from orderlens.operators import state as st
from orderlens.streaming import carts, feeds

from .test_state import LOG, cart_log, fold

SCHEMA = "event_id long, ts timestamp, cust_id long, item_id long, event_type string, source string, quantity int, price double"


def write_batches(spark, folder, schema, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p={n}"))


def events(spark, folder, schema=SCHEMA):
    parsed = spark.createDataFrame([], schema).schema
    return feeds.file_stream(spark, f"{folder}/*", "*.parquet", parsed)


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_are_dropped_past_the_watermark(spark, tmp_path):
    first = [(1, at(1, 1), 1, 1, "purchase", "s", 2, 5.0), (2, at(5, 1), 1, 1, "purchase", "s", 1, 5.0)]
    more = [(4, at(5, 2), 1, 1, "purchase", "s", 1, 5.0)]
    late = [(3, at(1, 2), 1, 1, "purchase", "s", 9, 5.0)]  # two batches on: the watermark is in force
    last = [(5, at(9, 1), 1, 1, "purchase", "s", 1, 5.0)]
    write_batches(spark, tmp_path, SCHEMA, [first, more, late, last])
    out = feeds.drain(feeds.live_sales_trend(events(spark, tmp_path)), "late")
    got = {r.window_start.day: r.quantity for r in out.collect()}
    assert got[1] == 2 and got[5] == 2  # the late row of day 1 is gone, the one of day 5 counts


def test_cart_lines_across_batches(spark, tmp_path):
    rows = cart_log(60)
    write_batches(spark, tmp_path, LOG.replace("timestamp_ntz", "timestamp"), [rows[:20], rows[20:40], rows[40:]])
    log = events(spark, tmp_path, LOG.replace("timestamp_ntz", "timestamp")).select(
        "cust_id", "item_id", "ts", "event_id", "action", "quantity")
    got = feeds.latest_lines(feeds.drain(feeds.live_cart_changes(log), "carts")).collect()
    assert {(r.cart_item_id, r.cust_id, r.item_id, r.quantity, r.status) for r in got} == {
        (x[0], x[1], x[2], x[3], x[6]) for x in fold(rows)}
    assert st.CLOSING == ("sold", "not_sold", "delete")


ACTIONS = "event_id long, ts timestamp, cust_id long, item_id long, action string, quantity int"


def minute(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def lines_of(spark, folder, batches, checkpoint=None, **options):
    write_batches(spark, folder, ACTIONS, batches)
    stream = carts.live_cart_changes(events(spark, folder, ACTIONS), **options)
    rows = feeds.latest_lines(feeds.drain(stream, "carts", checkpoint=checkpoint)).collect()
    return {(r.cart_item_id, r.cust_id, r.item_id, r.quantity, r.status) for r in rows}


def state(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def test_late_and_out_of_order_actions(spark, tmp_path):
    """An add that comes after its sale, and before it in time, moves the line; one past the watermark does not count."""
    batches = [[(2, minute(100), 1, 5, "add", 2), (3, minute(110), 1, 5, "sold", 0), (9, minute(100), 2, 7, "add", 1)],
               [(1, minute(90), 1, 5, "add", 4), (4, minute(95), 1, 5, "set_quantity", 3)],  # out of order, within two hours
               [(6, minute(400), 2, 7, "add", 1)], [(7, minute(401), 2, 8, "add", 1)],
               [(5, minute(120), 1, 5, "add", 8), (8, minute(402), 2, 8, "delete", 0)]]  # the first is too late
    got = lines_of(spark, tmp_path, batches)
    assert got == {(1, 1, 5, 5, "sold"), (9, 2, 7, 2, "in_cart")}


def test_state_goes_with_the_cart(spark, tmp_path):
    batches = [[(1, minute(0), 1, 5, "add", 2), (2, minute(1), 1, 5, "sold", 0), (3, minute(2), 2, 6, "add", 1)],
               [(4, minute(500), 3, 7, "add", 1)], [(5, minute(501), 3, 7, "add", 1)]]
    checkpoint = str(tmp_path / "cp")
    lines_of(spark, tmp_path / "in", batches, checkpoint)
    held = {r.key.cust_id for r in state(spark, checkpoint, "lines").collect()}
    assert held == {2}  # 1 has closed its line, 3 waits for the watermark
    assert {r.key.cust_id for r in state(spark, checkpoint, "counter").collect()} == {2, 3}


def test_idle_lines_expire(spark, tmp_path):
    batches = [[(1, minute(0), 1, 5, "add", 2), (2, minute(300), 1, 6, "add", 1)], [(3, minute(700), 2, 7, "add", 1)], [(4, minute(701), 2, 7, "add", 1)]]
    got = lines_of(spark, tmp_path, batches, idle="8 hours")
    assert got == {(1, 1, 5, 2, "expired"), (2, 1, 6, 1, "in_cart"), (3, 2, 7, 2, "in_cart")}


def test_helper_equals_the_batch_form_per_add_and_replays(spark, tmp_path):
    """Every add of four batches against ``serving.cart_helper`` for the cart of that moment; then once more into the same folder."""
    r = random.Random(6)
    log, t = [], 0
    for e in range(80):
        t += r.randint(1, 40)
        log.append((e, minute(t), r.randint(1, 3), r.randint(1, 8), r.choice(["add", "add", "add", "sold", "delete", "set_quantity"]), r.randint(1, 4)))
    write_batches(spark, tmp_path / "in", ACTIONS, [log[:20], log[20:45], log[45:50], log[50:]])
    pairs = spark.createDataFrame([(a, b, r.randint(10, 90) / 10, 0.1, r.random()) for a in range(1, 9) for b in range(1, 15) if a != b and r.random() < 0.5],
                                  "product_a long, product_b long, lift double, support_ab double, confidence double")
    kinds = ["private_brand_upgrade", "competitor_conversion"]
    equivalents = spark.createDataFrame([(a, 20 + a + k, kinds[k], r.randint(-40, 10) / 100, r.randint(0, 1)) for a in range(1, 9) for k in (0, 1)],
                                        "original_item long, equivalent_item long, match_type string, price_delta_pct double, is_price_improvement int")
    items = spark.range(40).selectExpr("id AS item_id", "concat('item ', id) AS item_dsc", "concat('f', id % 3) AS family")
    stock = items.selectExpr("item_id", "item_id * 2 AS units")
    tables = pairs, equivalents, items, stock
    rows, open_items = [], {}
    for e, _, c, i, action, _ in log:
        cart = open_items.setdefault(c, [])
        if action == "add" and i not in cart:
            cart.append(i)
        elif action in ("sold", "delete") and i in cart:
            cart.remove(i)
        if action == "add":
            rows += [(e, x) for x in cart]
    want = serving.cart_helper(spark.createDataFrame(rows, "cust_id long, item_id long"), *tables).collect()
    want = sorted((x.cust_id, x.kind, x.position, x.cart_item, x.item_id, x.lift, x.savings_pct, x.units) for x in want)
    for run in ("a", "b"):
        feeds.live_cart_helper(events(spark, tmp_path / "in", ACTIONS), *tables, str(tmp_path / "out"), str(tmp_path / f"cp-{run}"))
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert sorted((x.event_id, x.kind, x.position, x.cart_item, x.item_id, x.lift, x.savings_pct, x.units) for x in got) == want
    assert {x[1] for x in want} == {"complement", "brand_upgrade", "conversion"}
