import datetime as dt
from decimal import Decimal

import duckdb
import pytest

from lastleg.session import build_session, release_stages
from lastleg.sources import schemas

DATA = "/root/testdata/sf0.001"
GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    release_stages(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


BASE_ORDER = {
    "order_id": "ORD1", "created_at": dt.datetime(2024, 1, 1, 12, 0), "city": "Mumbai", "dark_store_id": "DS1",
    "rider_id": "R1", "order_type": "express", "sla_minutes": 30, "delivery_distance_km": Decimal("2.00"),
    "actual_delivery_min": Decimal("20.0"), "prep_time_min": 5, "travel_time_min": Decimal("15.0"), "is_late": 0,
    "delay_minutes": Decimal("0.0"), "weather_delay_min": Decimal("0.0"), "congestion_factor": Decimal("1.200"),
    "route_efficiency_score": Decimal("1.000"), "is_peak_hour": 1, "delivery_lat": Decimal("19.000000"),
    "delivery_lon": Decimal("72.000000"), "total_cost_inr": Decimal("40.00"), "customer_rating": Decimal("4.5"),
    "attempt_count": 1, "status": "on_time", "hour_of_day": 12, "day_of_week": 0, "month": 1, "is_weekend": 0,
}


@pytest.fixture(scope="session")
def make_orders(spark):
    """Orders from a base row and overrides per row."""
    def make(*overrides, drop=()):
        rows = []
        for i, o in enumerate(overrides):
            row = {**BASE_ORDER, "order_id": f"ORD{i}", **o}
            rows.append(tuple(row[f.name] for f in schemas.ORDERS.fields))
        return spark.createDataFrame(rows, schemas.ORDERS.schema()).drop(*drop)
    return make
