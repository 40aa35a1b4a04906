"""Small deterministic inputs modelled on the reference's test fixtures."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np


def sales_small(n_days=60, products=("P1", "P2"), start=dt.date(2026, 1, 1)):
    rows = []
    for pid in products:
        for i in range(n_days):
            rows.append((1, pid, start + dt.timedelta(days=i), max(0.0, 50 + 10 * math.sin(i / 7) + 0.2 * i), 0))
    return rows


SALES_SCHEMA = "company_id int, product_id string, sale_date date, quantity double, promotion int"


def sales_model(n_days=400, products=("P1", "P2", "P3"), seed=7):
    rng = np.random.default_rng(seed)
    start = dt.date(2025, 1, 1)
    rows = []
    for pid in products:
        base = rng.uniform(40, 120)
        for i in range(n_days):
            d = start + dt.timedelta(days=i)
            wf = 1 + 0.2 * math.sin(2 * math.pi * (d.weekday() / 7))
            q = max(0.0, base * wf * (1 + 0.0003 * i) + rng.normal(0, base * 0.1))
            rows.append((1, pid, d, float(q), 0))
    return rows


SHIP_SCHEMA = ("company_id int, shipment_key string, product_id int, supplier_id long, origin string, "
               "destination string, carrier string, transport_mode string, distance_km double, weight_kg double, "
               "quantity double, order_date date, planned_delivery date, actual_delivery date, "
               "l_orderkey long, l_linenumber int, l_partkey long")


def shipments_small(n=10, delayed_every=3):
    rows = []
    for i in range(n):
        od = dt.date(2026, 1, 1) + dt.timedelta(days=i * 10)
        planned = od + dt.timedelta(days=7)
        actual = planned + dt.timedelta(days=5 if i % delayed_every == 0 else 0)
        rows.append((1, f"S{i}", 1, 1, "Mumbai", "Delhi", "CarrierX", "road", 1400.0, 500.0, 100.0, od, planned,
                     actual, i, 1, 1))
    return rows


SUPPLIER_SCHEMA = ("company_id int, supplier_id long, name string, lead_time_days double, reliability double, "
                   "cost_index double, defect_rate double")


def shipments_model(n=300, seed=5):
    rng = np.random.default_rng(seed)
    sups = [(1, 0.95, 5), (2, 0.75, 10), (3, 0.55, 15)]
    routes = [("Mumbai", "Delhi", 1400.0), ("Chennai", "Bengaluru", 350.0)]
    rows = []
    od = dt.date(2025, 1, 1)
    for i in range(n):
        sid, rel, lead = sups[i % 3]
        o, dst, dist = routes[i % 2]
        od = od + dt.timedelta(days=int(rng.integers(1, 4)))
        planned = od + dt.timedelta(days=lead)
        delayed = rng.random() < 1 - rel
        dd = int(rng.exponential(3)) + 1 if delayed else 0
        rows.append((1, f"S{i}", (i % 5) + 1, sid, o, dst, f"Carrier{(i % 3) + 1}", ["road", "air", "sea"][i % 3],
                     dist, float(rng.uniform(100, 2000)), float(rng.uniform(50, 500)), od, planned,
                     planned + dt.timedelta(days=dd), i, 1, 1))
    suppliers = [(1, s, f"Sup{s}", float(lead), rel, 1.0, 0.0) for s, rel, lead in sups]
    return rows, suppliers
