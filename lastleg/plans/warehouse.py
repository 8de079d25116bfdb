"""The delivery tables of one data folder, built on demand.

The lines behind ``deliveries``, ``orders`` and ``orders_enriched`` have many consumers. They are written once
per session to the shared folder and read from there; everything else is a lazy DataFrame. Until the orders are
written, narrow lines travel in place of deliveries, which are a function of them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lastleg.ml import train
from lastleg.operators import features, quality, rollups
from lastleg.operators.filters import DAY_COLUMN
from lastleg.plans import views
from lastleg.session import deal, files_state, on_release, prepare, stage
from lastleg.sources import star_adapter


def source_state(spark: SparkSession, data_dir: str) -> tuple:
    """What the files behind the tables look like: another state means that stored tables are out of date."""
    return files_state(spark, [f"{data_dir.rstrip('/')}/{name}.parquet" for name in star_adapter.SOURCES])


class Warehouse:
    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = prepare(spark)
        self.data_dir = data_dir.rstrip("/")
        self.source = source_state(spark, data_dir)
        self.models: dict[str, train.Trained] = {}

    @staticmethod
    def _by_day(df: DataFrame, name: str) -> DataFrame:
        """Stored with one folder per day, so relative date filters open the newest only."""
        return stage(df.withColumn(DAY_COLUMN, F.to_date("created_at")), name, folders_by=DAY_COLUMN)

    @cached_property
    def _joined(self) -> DataFrame:
        return star_adapter.delivery_lines(self.spark, self.data_dir)

    @cached_property
    def lines(self) -> DataFrame:
        """The lines of all deliveries: joined once, for all quality reports."""
        return stage(self._joined, "lines")

    @property
    def deliveries(self) -> DataFrame:
        """Raw deliveries, with repeated order ids."""
        return star_adapter.deliveries(self.lines)

    @property
    def deliveries_in_order(self) -> DataFrame:
        """Raw deliveries, sorted by order id and tie-break. Lines are dealt by ranges of order ids; the tie-break is derived where they arrive."""
        lines = self.lines
        ranged = star_adapter.deliveries(lines, *lines.columns).select(*lines.columns, "order_id").repartitionByRange("order_id")
        keyed = star_adapter.deliveries(ranged.select(*lines.columns), *lines.columns)
        return star_adapter.deliveries(keyed.sortWithinPartitions("order_id", *quality.ORDER_TIE_BREAK).select(*lines.columns))

    @property
    def dealt_lines(self) -> DataFrame:
        """The line of the first delivery of each order id, dealt and sorted by day."""
        lines = self.__dict__.get("lines", self._joined)
        keyed = quality.require_orders({"orders": star_adapter.deliveries(lines, *lines.columns)})
        first = quality.keep_first(keyed.select(*lines.columns, "order_id", *quality.ORDER_TIE_BREAK))
        dated = first.select(*lines.columns, F.to_date("created_at").alias(DAY_COLUMN))
        return dated.hint("rebalance", DAY_COLUMN).sortWithinPartitions(DAY_COLUMN)

    @cached_property
    def orders(self) -> DataFrame:
        """The first delivery of each order id."""
        return stage(star_adapter.deliveries(self.dealt_lines, DAY_COLUMN), "orders", folders_by=DAY_COLUMN, dealt=True)

    @property
    def order_ids(self) -> DataFrame:
        """The id of every order. Which of its deliveries is the first one doesn't matter here: keys are joined, and nothing is stored by day."""
        if "orders" in self.__dict__:
            return self.orders.select("order_id")
        return star_adapter.order_ids(self.spark, self.data_dir).distinct()

    @cached_property
    def riders(self) -> DataFrame:
        return star_adapter.riders(self.spark, self.data_dir)

    @cached_property
    def stores(self) -> DataFrame:
        return star_adapter.dark_stores(self.spark, self.data_dir)

    @cached_property
    def weather(self) -> DataFrame:
        return star_adapter.weather(self.spark, self.data_dir)

    @cached_property
    def cities(self) -> DataFrame:
        return star_adapter.dim_cities(self.spark)

    @cached_property
    def enriched(self) -> DataFrame:
        return self._by_day(features.engineer(self.orders, self.riders), "orders_enriched")

    @property
    def risk_scored(self) -> DataFrame:
        """Orders with their risk score, which needs no lookup: its readers leave the enriched orders alone."""
        return self.orders.withColumn("late_risk_score", features.late_risk_score())

    @property
    def store_totals(self) -> DataFrame:
        """Order counts and capacities by store for the KPIs, which don't look at the peak load of the enriched orders."""
        return rollups.store_performance(self.orders, self.stores).drop("peak_load")

    @cached_property
    def model_inputs(self) -> DataFrame:
        """What models read of the enriched orders. Where these aren't stored already, its columns alone are derived, joined and stored, day by day as the orders lie."""
        if "enriched" in self.__dict__:
            return self.enriched.select(*train.INPUTS)
        return stage(features.engineer(self.orders, self.riders).select(*train.INPUTS), "model_inputs")

    @cached_property
    def model_table(self) -> train.ModelTable:
        return train.model_table(self.model_inputs)

    @cached_property
    def city_daily(self) -> DataFrame:
        return rollups.city_daily_kpis(self.orders)

    @cached_property
    def rider_performance(self) -> DataFrame:
        return rollups.rider_performance(self.orders)

    @cached_property
    def store_performance(self) -> DataFrame:
        rows = features.per_rider_row(self.orders, self.riders)
        return rollups.store_performance(rows, self.stores, day_counts=features.store_day_counts(self.orders))

    @cached_property
    def hourly_stress(self) -> DataFrame:
        return rollups.hourly_stress(self.orders)

    @property
    def raw(self) -> dict[str, DataFrame]:
        """The raw tables by their schema name."""
        return {
            "orders": self.deliveries, "riders": self.riders, "dark_stores": self.stores,
            "weather": self.weather, "dim_cities": self.cities,
        }

    @property
    def spoiled(self) -> dict[str, DataFrame]:
        """The raw tables with wrong and missing values in them."""
        return star_adapter.with_violations(self.raw)

    def view(self, name: str) -> DataFrame:
        return views.view(self.spark, name, orders=self.orders, riders=self.riders, stores=self.stores)


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, data_dir: str) -> Warehouse:
    """The warehouse of a folder, shared by all queries of one Spark application until files of the folder change."""
    key = (spark.sparkContext.applicationId, data_dir.rstrip("/"))
    if key not in _open or _open[key].source != source_state(spark, data_dir):
        _open[key] = Warehouse(spark, data_dir)
    deal(spark, _open[key].source[1])
    return _open[key]


def refresh(spark: SparkSession, data_dir: str) -> Warehouse:
    """A new warehouse, whether files of the folder have changed or not."""
    _open.pop((spark.sparkContext.applicationId, data_dir.rstrip("/")), None)
    return warehouse(spark, data_dir)


def _forget(application: str) -> None:
    for key in [k for k in _open if k[0] == application]:
        del _open[key]


on_release(_forget)
