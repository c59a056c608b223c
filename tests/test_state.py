"""Folds over the logs against plain Python on random logs with one hot key."""

import datetime as dt
import random

from orderlens.operators import state as st

T0 = dt.datetime(2024, 1, 1)
LOG = ("cust_id long, item_id long, ts timestamp_ntz, event_id long, action string, quantity int, price double, source string, "
       "seller_id long")


def cart_log(n, seed=4):
    r = random.Random(seed)
    rows, t = [], T0
    for e in range(n):
        t += dt.timedelta(minutes=r.randint(1, 900))
        key = (1, 1) if r.random() < 0.5 else (r.randint(1, 3), r.randint(1, 4))
        action = r.choice(["add", "add", "set_quantity", "sold", "not_sold", "delete"])
        rows.append((*key, t, e, action, r.randint(1, 9), float(e), f"s{e % 3}", e % 7))
    return rows


def fold(rows):
    open_lines, out = {}, []
    for c, i, ts, e, action, q, price, source, _ in rows:
        line = open_lines.get((c, i))
        if line is None:
            if action == "add":
                open_lines[c, i] = {"id": e, "key": (c, i), "q": q, "price": price, "source": source, "status": "in_cart"}
        elif action == "add":
            line["q"] += q
        elif action == "set_quantity":
            line["q"] = q
        else:
            line["status"] = action
            out.append(open_lines.pop((c, i)))
    out += open_lines.values()
    return {(x["id"], *x["key"], x["q"], x["price"], x["source"], x["status"]) for x in out if x["status"] != "delete"}


def test_cart_state(spark):
    rows = cart_log(400)
    got = st.cart_state(spark.createDataFrame(rows, LOG)).collect()
    assert {(r.cart_item_id, r.cust_id, r.item_id, r.quantity, r.unit_price, r.source, r.status) for r in got} == fold(rows)


def test_resolved_lines_do_not_change(spark):
    day = lambda d: T0 + dt.timedelta(days=d)
    rows = [(1, 1, day(0), 1, "add", 2, 5.0, "manual", 1), (1, 1, day(1), 2, "add", 3, 5.0, "manual", 1),
            (1, 1, day(2), 3, "sold", 0, 0.0, "manual", 1), (1, 1, day(3), 4, "add", 7, 6.0, "manual", 1),
            (1, 1, day(4), 5, "delete", 0, 0.0, "manual", 1), (1, 1, day(5), 6, "delete", 0, 0.0, "manual", 1)]
    got = st.cart_state(spark.createDataFrame(rows, LOG)).collect()
    assert [(r.cart_item_id, r.quantity, r.status) for r in got] == [(1, 5, "sold")]


def test_rejection_stack(spark):
    r = random.Random(8)
    rows, t = [], T0
    for e in range(300):
        t += dt.timedelta(minutes=r.randint(1, 700))
        rows.append((r.choice([1, 1, 2]), 1, t, e, r.choice(["shown", "rejected"]), f"src{e}", "other"))
    want, pending = set(), {}
    for c, i, ts, e, kind, source, _ in rows:
        stack = pending.setdefault((c, i), [])
        if kind == "shown":
            stack.append(e)
        elif stack:
            want.add((stack.pop(), "rejected", 1))
        else:
            want.add((e, "rejected", 0))
    want |= {(e, "pending", 1) for stack in pending.values() for e in stack}
    df = spark.createDataFrame(rows, "cust_id long, item_id long, ts timestamp_ntz, event_id long, kind string, source string, reason string")
    got = {(x.event_id, x.outcome, x.was_pending) for x in st.rejection_resolution(df).collect()}
    assert got == want


def test_unknown_reason_is_not_a_rejection(spark):
    df = spark.createDataFrame([(1, 1, T0, 1, "rejected", "s", "because")],
                               "cust_id long, item_id long, ts timestamp_ntz, event_id long, kind string, source string, reason string")
    assert st.rejection_resolution(df).count() == 0


def test_assignment_reasons(spark):
    day = lambda d: T0 + dt.timedelta(days=d)
    rows = [(1, 5, day(0), 1), (1, 5, day(1), 2), (1, 6, day(2), 3), (1, None, day(3), 4), (1, None, day(4), 5), (1, 7, day(5), 6)]
    h = st.assignment_history(spark.createDataFrame(rows, "cust_id long, new_seller_id long, ts timestamp_ntz, event_id long"))
    assert [(r.history_id, r.change_reason) for r in h.orderBy("changed_at").collect()] == [
        (1, "admin_assign"), (3, "admin_reassign"), (4, "admin_unassign"), (6, "admin_assign")]
    assert [(r.cust_id, r.seller_id) for r in st.current_assignment(h).collect()] == [(1, 7)]
