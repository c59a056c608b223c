"""The derived tables over role tables of any origin, with default parameters."""

import datetime as dt
import random
from dataclasses import replace

from orderlens.functions.skew import salted_join
from orderlens.params import EngineParams, ModelParams, PairParams, ProductParams
from orderlens.plans import model
from orderlens.plans.model import Model


def role_tables(spark):
    r = random.Random(1)
    customers = [(c, f"C{c}", r.choice(["PO", "LTC", "HC"]), f"S{c % 3}", f"Spec {c % 3}", "NY", "S", "A") for c in range(60)]
    items = [(i, f"GLOVE NITRILE {i}", f"F{i % 4}", f"K{i % 2}", "B", f"Sup{i % 3}", i % 2, 0, 5.0 + i) for i in range(12)]
    sales = [(o, n, o % 60, r.randrange(12), 1, float(r.randint(1, 4)), 10.0 * r.randint(1, 9),
              dt.date(2025, 1, 1) + dt.timedelta(days=o % 400), "FY1" if o % 400 < 200 else "FY2", 0)
             for o in range(900) for n in (1, 2)]
    return (spark.createDataFrame(sales, "order_id long, line_no int, cust_id long, item_id long, supplier_id long, qty double, amount double, "
                                         "order_date date, fy string, is_return int"),
            spark.createDataFrame(customers, "cust_id long, cust_name string, market string, specialty string, specialty_dsc string, "
                                             "state string, cust_type string, cust_class string"),
            spark.createDataFrame(items, "item_id long, item_dsc string, family string, category string, brand string, supplier string, "
                                         "is_private_brand int, is_discontinued int, list_price double"))


def test_defaults_serve_any_role_tables(spark):
    m = Model(*role_tables(spark))
    assert m.params == ModelParams()
    assert {x.market_clean for x in m.segments.select("market_clean").distinct().collect()} <= {"PO", "LTC", "HC", "OTHER"}
    assert m.features.count() == 60
    assert m.cooccurrence.schema is not None and m.recommendations().count() >= 0


def test_parameters_reach_the_tables(spark):
    few = replace(ModelParams(), markets=("PO",), pairs=PairParams(min_buyers=2, min_together=2, min_support=0.0, min_lift=0.0),
                  products=ProductParams(min_buyers=2))
    m = Model(*role_tables(spark), params=few)
    assert {x.market_clean for x in m.segments.select("market_clean").distinct().collect()} <= {"PO", "OTHER"}
    assert m.cooccurrence.count() > 0


def test_salted_join_equals_a_plain_one(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(500)], "id long, k string")
    lookup = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "k string, v int")
    for how in ("inner", "left"):
        got = salted_join(rows, lookup, ["k"], ["id"], how, salts=7)
        want = rows.join(lookup, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_signals_by_slices_of_the_customers_are_the_same(spark, monkeypatch):
    few = replace(ModelParams(), pairs=PairParams(min_buyers=2, min_together=2, min_support=0.0, min_lift=0.0), products=ProductParams(min_buyers=2),
                  engine=replace(EngineParams(), min_buyers=2, recency_months=1000.0), excluded_families=())
    m = Model(*role_tables(spark), params=few)
    m.prepare()
    monkeypatch.setattr(model, "CUSTOMERS", 25)  # three slices of the 60 customers
    total = 0
    for name in ("item_similarity", "lapsed_recovery"):
        got = m._stored_signal(name)
        rows = sorted(map(str, got.collect()))
        assert rows == sorted(map(str, m.signal(name).collect()))
        assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 3  # a folder for each slice
        total += len(rows)
    assert total > 0
