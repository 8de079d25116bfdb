"""DuckDB side of the delivery tables: common table expressions over the given tables."""

from __future__ import annotations

from lastleg import settings
from lastleg.sources.schemas import ORDERS

_NAMES = list(settings.CITIES)
_LAT = [round(c[0] * 1_000_000) for c in settings.CITIES.values()]
_LON = [round(c[1] * 1_000_000) for c in settings.CITIES.values()]


def by_nation(key: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"CASE {key} % 8 {cases} END"


def dec(expression: str, digits: int, type_: str) -> str:
    return f"CAST(CAST({expression} AS DOUBLE) / CAST({10**digits} AS DOUBLE) AS {type_})"


DELIVERIES = f"""
d_base AS (
  SELECT l.l_orderkey AS ok, l.l_partkey AS pk, l.l_suppkey AS sk, CAST(l.l_linenumber AS BIGINT) AS ln,
         l.l_returnflag AS rf, o.o_custkey AS ck, s.s_nationkey AS nk,
         date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) % 540 AS dd,
         CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS prio
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
), d_keys AS (
  SELECT *, (pk*7919 + sk*104729 + ok*31) % 86400 AS sec,
         ((pk*7919 + sk*104729 + ok*31) % 86400) // 3600 AS hr,
         (pk*7 + ok*13 + ln*101) % 1000 AS kd, (ok*17 + ln*131 + pk*3) % 801 AS kc,
         (pk*29 + ok*11 + ln*7) % 100 AS kw, (pk*41 + ok*5 + ln*3) % 121 AS kn,
         (pk*61 + ok*23 + ln*19) % 50 AS kf, (pk*37 + ok*43 + ln*47) % 400 AS kr,
         (pk*53 + ok*59 + ln*67) % 160001 AS ka, (pk*71 + ok*73 + ln*79) % 160001 AS ko,
         CASE WHEN prio < 3 THEN 30 WHEN prio < 5 THEN 60 ELSE 120 END AS sla,
         3 + (pk*13 + ln) % 15 AS prep
  FROM d_base
), d_vals AS (
  SELECT *, (hr BETWEEN 11 AND 14 OR hr BETWEEN 18 AND 21) AS peak, 30 + (kd*kd*1170)//1000000 AS dist_h,
         CASE WHEN kw < 12 THEN 12 + kn%5 WHEN kw < 18 THEN 28 + kn%5 WHEN kw < 21 THEN 8 + kn%5
              WHEN kw < 23 THEN 45 + kn%5 ELSE kn%5 END AS wx
  FROM d_keys
), d_more AS (
  SELECT *, CASE WHEN peak THEN ((1000 + kc)*13)//10 ELSE 1000 + kc END AS cong,
         CASE WHEN peak THEN ((1000 + greatest(kr-250, 0))*(105 + kr%31))//100 ELSE 1000 + greatest(kr-250, 0) END AS eff,
         CASE WHEN peak THEN ((2500 + (dist_h*35)//10)*125)//100 ELSE 2500 + (dist_h*35)//10 END + (kr*5)//2 AS cost
  FROM d_vals
), d_act AS (
  SELECT *, least(greatest((dist_h*cong*24)//100000 + prep*10 + wx*10 + kn - 60, 50), 1800) AS act,
         TIMESTAMP '2023-01-01 00:00:00' + to_seconds(CAST(dd*86400 + sec AS BIGINT)) AS created_at
  FROM d_more
), d_late AS (SELECT *, (act > sla*10 OR kf = 0) AS late FROM d_act),
d_deliveries AS (
  SELECT 'ORD' || lpad(CAST(ok*10 + ln AS VARCHAR), 9, '0') AS order_id, created_at,
         {by_nation('nk', _NAMES)} AS city,
         'DS' || lpad(CAST(CASE WHEN sk % 10 = 9 THEN sk - 1 ELSE sk END AS VARCHAR), 4, '0') AS dark_store_id,
         'R' || lpad(CAST(CASE WHEN ck % 40 = 1 THEN ck + 900000 ELSE ck END AS VARCHAR), 6, '0') AS rider_id,
         CASE WHEN prio < 3 THEN 'express' WHEN prio < 5 THEN 'standard' ELSE 'scheduled' END AS order_type,
         CAST(sla AS BIGINT) AS sla_minutes,
         {dec('dist_h', 2, 'DECIMAL(6,2)')} AS delivery_distance_km,
         {dec('act', 1, 'DECIMAL(7,1)')} AS actual_delivery_min,
         prep AS prep_time_min,
         {dec('act - prep*10', 1, 'DECIMAL(7,1)')} AS travel_time_min,
         CAST(late AS BIGINT) AS is_late,
         {dec('CASE WHEN late THEN greatest(act - sla*10, 0) ELSE 0 END', 1, 'DECIMAL(6,1)')} AS delay_minutes,
         CAST(wx AS DECIMAL(5,1)) AS weather_delay_min,
         {dec('cong', 3, 'DECIMAL(5,3)')} AS congestion_factor,
         {dec('eff', 3, 'DECIMAL(5,3)')} AS route_efficiency_score,
         CAST(peak AS BIGINT) AS is_peak_hour,
         {dec(f"{by_nation('nk', _LAT)} + (sk*7001)%300001 - 150000 + ka - 80000", 6, 'DECIMAL(9,6)')} AS delivery_lat,
         {dec(f"{by_nation('nk', _LON)} + (sk*9001)%300001 - 150000 + ko - 80000", 6, 'DECIMAL(9,6)')} AS delivery_lon,
         {dec('cost', 2, 'DECIMAL(8,2)')} AS total_cost_inr,
         {dec("CASE WHEN rf = 'N' AND kf = 7 THEN NULL WHEN late THEN 10 + kr%26 ELSE 35 + kr%16 END", 1, 'DECIMAL(3,1)')} AS customer_rating,
         CAST(CASE WHEN kn < 106 THEN 1 WHEN kn < 118 THEN 2 ELSE 3 END AS BIGINT) AS attempt_count,
         CASE WHEN kf = 1 THEN 'failed' WHEN late THEN 'late' ELSE 'on_time' END AS status,
         CAST(hour(created_at) AS BIGINT) AS hour_of_day, CAST(isodow(created_at) - 1 AS BIGINT) AS day_of_week,
         CAST(month(created_at) AS BIGINT) AS month, CAST(isodow(created_at) >= 6 AS BIGINT) AS is_weekend
  FROM d_late
), d_orders AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY created_at, dark_store_id, rider_id,
      actual_delivery_min, delivery_lat, delivery_lon, total_cost_inr, prep_time_min) AS rn
    FROM d_deliveries) WHERE rn = 1
)"""

DIMENSIONS = f"""
d_riders AS (
  SELECT 'R' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS rider_id,
         'DS' || lpad(CAST(c_custkey % 10 AS VARCHAR), 4, '0') AS assigned_store,
         {by_nation('c_nationkey', _NAMES)} AS city,
         1 + (c_custkey*37) % 59 AS experience_months,
         CASE WHEN c_custkey%20 < 11 THEN '2W-Petrol' WHEN c_custkey%20 < 16 THEN '2W-EV'
              WHEN c_custkey%20 < 18 THEN 'Cycle' ELSE '3W-EV' END AS vehicle_type,
         CASE WHEN c_custkey%7 < 2 THEN 'Morning' WHEN c_custkey%7 < 3 THEN 'Afternoon'
              WHEN c_custkey%7 < 5 THEN 'Evening' WHEN c_custkey%7 < 6 THEN 'Night' ELSE 'Full-Day' END AS shift_type,
         {dec('320 + (c_custkey*91) % 181', 2, 'DECIMAL(3,2)')} AS rating,
         c_custkey % 25 >= 3 AS is_active,
         {dec('400 + (c_custkey*53) % 601', 3, 'DECIMAL(5,3)')} AS base_efficiency_score
  FROM customer
), d_stores AS (
  SELECT 'DS' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS store_id,
         {by_nation('s_nationkey', _NAMES)} AS city,
         {dec(f"{by_nation('s_nationkey', _LAT)} + (s_suppkey*7001)%300001 - 150000", 6, 'DECIMAL(9,6)')} AS latitude,
         {dec(f"{by_nation('s_nationkey', _LON)} + (s_suppkey*9001)%300001 - 150000", 6, 'DECIMAL(9,6)')} AS longitude,
         300 + (s_suppkey*97) % 400 AS max_capacity,
         {dec('25 + (s_suppkey*13) % 56', 1, 'DECIMAL(4,1)')} AS zone_coverage_km,
         CASE WHEN s_suppkey%5 < 2 THEN 'Tier-1' WHEN s_suppkey%5 < 4 THEN 'Tier-2' ELSE 'Tier-3' END AS tier
  FROM supplier
), d_readings AS (
  SELECT event_id, event_type,
         date_trunc('hour', TIMESTAMP '2023-01-01 00:00:00' + to_microseconds(CAST((epoch_us(ts) - 1704067200000000)*18 AS BIGINT))) AS hr
  FROM events
), d_weather AS (
  SELECT hr AS "timestamp", condition,
         CASE condition WHEN 'clear' THEN 0 WHEN 'rain' THEN 12 WHEN 'heavy_rain' THEN 28 WHEN 'storm' THEN 45 END + event_id % 5
           AS delay_impact_min
  FROM (
    SELECT *, CASE event_type WHEN 'error' THEN 'heavy_rain' WHEN 'signup' THEN 'rain' WHEN 'purchase' THEN 'storm' ELSE 'clear' END AS condition,
           row_number() OVER (PARTITION BY hr ORDER BY event_id DESC) AS rn
    FROM d_readings) WHERE rn = 1
), d_cities AS (
  SELECT * FROM (VALUES {', '.join(f"('{n}', CAST({c[0]} AS DOUBLE), CAST({c[1]} AS DOUBLE), {i})" for i, (n, c) in enumerate(settings.CITIES.items()))})
    AS t(city_name, latitude, longitude, idx)
)"""

ORDER_COLUMNS = [f.name for f in ORDERS.fields]
ORDER_DECIMALS = [f.name for f in ORDERS.fields if f.type.startswith("DECIMAL")]
