"""The whole batch run: bronze load, models in dependency order, checks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lamina.functions.numbers import BANDS
from lamina.operators.checks import Check, assert_checks, run_checks
from lamina.operators.conform import conform
from lamina.operators.incremental import append_incremental, delete_insert, merge_upsert
from lamina.plans.employees import dim_employee, fct_department_summary, stg_employees
from lamina.plans.feed import EXECUTION_DATE, feed_columns, normalize_feed, raw_feed
from lamina.schemas import RAW_EMPLOYEES
from lamina.sources.table import Snapshot, Table

# The departments that the silver table may name.
DEPARTMENTS = ("ENGINEERING", "MARKETING", "SALES", "HR", "FINANCE", "OPERATIONS")


@dataclass(frozen=True)
class Model:
    """A stored table: its name in the program, its stored name, layer and key."""

    name: str
    layer: str
    target: str = ""
    key: str = ""
    needs: tuple[str, ...] = ()

    @property
    def folder(self) -> str:
        return f"{self.layer}/{self.target or self.name}"


# In dependency order.
MODELS = {
    m.name: m
    for m in (
        Model("raw_employees", "bronze"),
        Model("stg_employees", "silver", needs=("raw_employees",)),
        Model("dim_employee", "gold", needs=("stg_employees",)),
        Model("fct_department_summary", "gold", needs=("stg_employees",)),
        Model("raw_feed", "bronze", target="raw_data"),
        Model("replaced_feed", "silver", target="del_ins", key="emp_id", needs=("raw_feed",)),
        Model("merged_feed", "silver", target="merge_ins", key="emp_id", needs=("raw_feed",)),
        Model("appended_feed", "gold", target="inc_ap", needs=("merged_feed",)),
    )
}


def employee_checks(departments: Sequence[str] = DEPARTMENTS) -> list[Check]:
    """The sixteen assertions on the employee tables."""
    stg, dim, fct = "stg_employees", "dim_employee", "fct_department_summary"
    return [
        Check("unique", stg, "employee_id"),
        Check("not_null", stg, "employee_id"),
        Check("unique", stg, "email"),
        Check("not_null", stg, "email"),
        Check("not_null", stg, "salary"),
        Check("not_null", stg, "department"),
        Check("accepted_values", stg, "department", tuple(departments)),
        Check("not_null", stg, "hire_date"),
        Check("unique", dim, "employee_sk"),
        Check("not_null", dim, "employee_sk"),
        Check("not_null", dim, "full_name"),
        Check("accepted_values", dim, "salary_band", BANDS),
        Check("unique", fct, "department"),
        Check("not_null", fct, "department"),
        Check("not_null", fct, "employee_count"),
        Check("not_null", fct, "avg_salary"),
    ]


def write_table(df: DataFrame, target: Table, publish: bool = True) -> Snapshot:
    """Rebuild the whole table from ``df``."""
    return target.overwrite(df, publish)


def overwrite_load(df: DataFrame, target: Table, schema=RAW_EMPLOYEES, publish: bool = True) -> Snapshot:
    """Bronze load: cast to the declared columns and replace what was there."""
    return target.overwrite(conform(df, schema), publish)


class Warehouse:
    """The stored tables below one folder, by model name.

    With ``publish=False`` what is built stays invisible to others until
    ``publish()``, while this object already reads it. Null and value checks to ``watch`` are
    counted by the job that writes their table, and need no scan of their own later.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        buckets: int | None = None,
        publish: bool = True,
        watch: Sequence[Check] = (),
    ):
        self.spark = spark
        self.base = base.rstrip("/")
        self.buckets = buckets
        self.live = publish
        self.built: dict[str, Snapshot] = {}
        self.watch = [c for c in watch if c.test in ("not_null", "accepted_values")]
        self.seen: dict[Check, int] = {}

    def table(self, name: str) -> Table:
        model = MODELS[name]
        return Table(self.spark, f"{self.base}/{model.folder}", model.key, self.buckets)

    def read(self, name: str) -> DataFrame:
        """A model's stored rows, never its plan."""
        return self.table(name).read(None if self.live else self.built.get(name))

    def load(self, raw_df: DataFrame) -> None:
        """Replace the raw employees."""
        self.built["raw_employees"] = overwrite_load(raw_df, self.table("raw_employees"), publish=self.live)

    def build(
        self,
        name: str,
        run_ts: datetime | str,
        execution_date: str = EXECUTION_DATE,
        feed_df: DataFrame | None = None,
    ) -> None:
        """Build one model from the stored ones before it."""
        target, live = self.table(name), self.live
        if name == "raw_feed":
            made = self._rebuilt(name, raw_feed(self.spark) if feed_df is None else feed_df)
        elif name == "stg_employees":
            made = self._rebuilt(name, stg_employees(self.read("raw_employees"), run_ts))
        elif name == "dim_employee":
            made = self._rebuilt(name, dim_employee(self.read("stg_employees"), run_ts))
        elif name == "fct_department_summary":
            made = self._rebuilt(name, fct_department_summary(self.read("stg_employees"), run_ts))
        elif name == "replaced_feed":
            made = delete_insert(normalize_feed(self.read("raw_feed")), target, live)
        elif name == "merged_feed":
            made = merge_upsert(normalize_feed(self.read("raw_feed")), target, live)
        elif name == "appended_feed":
            rows = feed_columns(self.read("merged_feed"))
            made = append_incremental(rows, target, "record_date", execution_date, publish=live)
        else:
            raise KeyError(f"no model {name!r} to build")
        self.built[name] = made

    def build_all(
        self,
        run_ts: datetime | str,
        execution_date: str = EXECUTION_DATE,
        feed_df: DataFrame | None = None,
        threads: int = 1,
    ) -> None:
        """Build every model after those that it needs, up to ``threads`` of them side by side.

        Once one fails no other is begun, the running ones are cancelled, and its error is raised.
        """
        pending = {name: set(model.needs) - {"raw_employees"} for name, model in MODELS.items() if name != "raw_employees"}
        tag, context = f"models-{uuid.uuid4().hex}", self.spark.sparkContext
        running: dict[Future, str] = {}
        failed: BaseException | None = None

        def one(name: str) -> None:
            context.addJobTag(tag)
            try:
                self.build(name, run_ts, execution_date, feed_df)
            finally:
                context.removeJobTag(tag)

        with ThreadPoolExecutor(threads) as pool:
            while pending or running:
                for name in [n for n, needs in pending.items() if not needs][: threads - len(running)]:
                    del pending[name]
                    running[pool.submit(one, name)] = name
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(future)
                    if future.exception() is None:
                        for needs in pending.values():
                            needs.discard(name)
                    elif failed is None:
                        failed = future.exception()
                        pending.clear()
                        context.cancelJobsWithTag(tag)
        if failed is not None:
            raise failed

    def _rebuilt(self, name: str, df: DataFrame) -> Snapshot:
        """Rebuild a model's table, counting what its watched checks look for on the way."""
        own = [c for c in self.watch if c.model == name]
        for check in own:
            self.seen.pop(check, None)
        if not own:
            return write_table(df, self.table(name), self.live)
        counts = []
        for n, check in enumerate(own):
            c = F.col(check.column)
            broken = c.isNull() if check.test == "not_null" else ~c.isin(list(check.values))
            counts.append(F.count_if(broken).alias(f"broken_{n}"))
        observation = Observation()
        made = write_table(df.observe(observation, *counts), self.table(name), self.live)
        for n, check in enumerate(own):
            found = observation.get.get(f"broken_{n}")
            # Rows outside of a list are not yet the different values that the check counts.
            if found == 0 or found and check.test == "not_null":
                self.seen[check] = found
        return made

    def check(self, checks: Sequence[Check]) -> DataFrame:
        """Run the checks that no write has answered, once; the result holds one row per check."""
        rest = [c for c in checks if c not in self.seen]
        tables = {model: self.read(model) for model in dict.fromkeys(t for c in rest for t in c.tables)}
        found = run_checks(tables, rest)
        seen = [(c, self.seen[c]) for c in checks if c in self.seen]
        rows = [(c.test, c.model, c.column, n, "fail" if n else "pass") for c, n in seen]
        return self.spark.createDataFrame([*rows, *map(tuple, found.collect())], found.schema)

    def publish(self) -> None:
        """Show what was built with ``publish=False``: all tables, or none if another run came first.

        Every table's state is looked at before the first switch. A run that publishes
        between that look and the last switch still stops the rest; the error then says
        which tables were switched.
        """
        built = {name: self.built[name] for name in MODELS if name in self.built}
        for name, snapshot in built.items():
            now = self.table(name).snapshot()
            if (now.number if now else 0) != snapshot.number - 1:
                raise FileExistsError(f"{name} was written by another run; nothing was published")
        switched: list[str] = []
        for name, snapshot in built.items():
            try:
                self.table(name).publish(snapshot)
            except FileExistsError as other:
                raise FileExistsError(f"{other}; already published: {', '.join(switched) or 'none'}") from other
            switched.append(name)

    def expire(self, keep: int) -> None:
        for name in self.built:
            self.table(name).expire(keep)


def run_pipeline(
    spark: SparkSession,
    raw_df: DataFrame,
    base: str,
    run_ts: datetime | str,
    execution_date: str = EXECUTION_DATE,
    feed_df: DataFrame | None = None,
    checks: Sequence[Check] | None = None,
    publish_after_checks: bool = False,
    buckets: int | None = None,
    keep: int | None = None,
    threads: int = 4,
) -> DataFrame | None:
    """Load bronze, build every model from the stored ones before it, then check.

    Returns the checks' result. A step that raises stops the later ones. The gold
    tables are already visible when the checks run; with ``publish_after_checks``
    every table keeps its former content until all checks have passed. ``keep``
    states of each table stay readable; the files of older ones are deleted at the
    end of a run that passed. Models that do not need each other are built side by side, up
    to ``threads`` at a time.
    """
    wanted = employee_checks() if checks is None else list(checks)
    warehouse = Warehouse(spark, base, buckets, publish=not publish_after_checks, watch=wanted)
    warehouse.load(raw_df)
    warehouse.build_all(run_ts, execution_date, feed_df, threads)
    result = warehouse.check(wanted) if wanted else None
    if result is not None:
        assert_checks(result)
    if publish_after_checks:
        warehouse.publish()
    if keep is not None:
        warehouse.expire(keep)
    return result
