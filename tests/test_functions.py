import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from lastleg.functions import dates, numeric as N, text
from lastleg import settings


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


TIES = [0.125, 1.005, 0.285, 1.115, 2.5, 3.5, -0.125, 15.25, 15.35, 0.35, 2.675, 1e-9, 0.0]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_np_round_is_array_rounding(spark, n):
    assert column(spark, TIES, N.np_round("x", n)) == [float(np.round(np.float64(v), n)) for v in TIES]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_py_round_is_scalar_rounding(spark, n):
    values = TIES + [k / 1000 for k in range(-2000, 2000, 5)]
    assert column(spark, values, N.py_round("x", n)) == [round(v, n) for v in values]


@hsettings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=50))
def test_rounding_property(spark, values):
    assert column(spark, values, N.py_round("x", 2)) == [round(v, 2) for v in values]
    assert column(spark, values, N.np_round("x", 3)) == [float(np.round(np.float64(v), 3)) for v in values]


def test_fixed_text_matches_format(spark):
    values = [15.25, 15.35, 0.5, 1.5, 2.5, 99.95, 1.005]
    assert column(spark, values, text.fixed("x", 1)) == [f"{v:.1f}" for v in values]
    assert column(spark, values, text.fixed("x", 0)) == [f"{v:.0f}" for v in values]


def test_dec_round_is_half_away_from_zero(spark):
    assert column(spark, [0.125, -0.125, 2.5], N.dec_round("x", 2)) == [0.13, -0.13, 2.5]


def test_clip_keeps_null(spark):
    assert column(spark, [None, -1.0, 0.5, 9.0], N.clip("x", 0.0, 1.0)) == [None, 0.0, 0.5, 1.0]


def test_ratio_of_zero_is_null(spark):
    assert column(spark, [0.0, 2.0], N.ratio(F.lit(1.0), F.col("x"))) == [None, 0.5]


def test_averages_skip_nulls_and_ignore_row_order(spark, make_orders):
    df = make_orders({"customer_rating": None}, {}, {"customer_rating": None})
    assert df.agg(N.exact_avg("customer_rating")).first()[0] == 4.5
    assert df.where("false").agg(N.exact_avg("customer_rating"), N.total("is_late")).first() == (None, 0)


def test_weekday_and_week(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS t").select(dates.weekday0("t"), F.weekofyear("t")).first()
    assert tuple(row) == (0, 1)


def test_hour_weights(spark):
    got = {r[0]: r[1] for r in spark.range(24).select(F.col("id"), dates.hour_weight(F.col("id"))).collect()}
    assert [got[h] for h in (0, 5, 6, 8, 10, 11, 13, 14, 17, 18, 20, 21, 23)] == [
        0.3, 0.3, 1.0, 1.5, 1.0, 2.8, 2.8, 1.2, 1.0, 3.2, 3.2, 1.8, 0.3]


def test_cycle(spark):
    sin, cos = dates.cycle("id", 24)
    for r in spark.range(24).select("id", sin, cos).collect():
        assert math.isclose(r[1], math.sin(2 * math.pi * r[0] / 24), abs_tol=1e-12)
        assert math.isclose(r[2], math.cos(2 * math.pi * r[0] / 24), abs_tol=1e-12)


def test_texts(spark):
    row = spark.range(1).select(
        text.display_number(F.lit(None).cast("double")), text.display_number(F.lit(float("nan"))),
        text.display_number(F.lit(1234567), integer=True), text.display_number(F.lit(3.14159), 2, "m"),
        text.title_case(F.lit("sla_breach")), text.percent(F.lit(0.938), 0),
        text.zone_label(F.lit(12.97), F.lit(77.59)), text.padded_id("R", F.lit(12345678), 6), text.padded_id("R", F.lit(7), 6),
    ).first()
    assert tuple(row) == ("—", "—", "1,234,567", "3.14m", "Sla Breach", "94%", "12.97°N / 77.59°E", "R12345678", "R000007")


def test_peak_hours(spark):
    peak = [r[0] for r in spark.range(24).select(dates.is_peak("id")).collect()]
    assert [h for h in range(24) if peak[h]] == [11, 12, 13, 14, 18, 19, 20, 21]
    assert settings.PEAK_HIGHLIGHT_HOURS == [12, 13, 19, 20]
