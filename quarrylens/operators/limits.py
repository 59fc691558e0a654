"""Work within a time limit: jobs run under a tag of their own and are cancelled by a timer."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.operators.sqltext import read_only

#: Seconds for a table, and for all.
PER_TABLE, IN_ALL = 5.0, 60.0


class OutOfTime(Exception):
    pass


def within(spark: SparkSession, seconds: float, action: Callable):
    """What the action returns, or OutOfTime after so many seconds; its jobs are then cancelled, others run on."""
    context, tag, late = spark.sparkContext, f"within-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        while not over.wait(0.05):  # a job may start just after others were cancelled
            context.cancelJobsWithTag(tag)

    over = threading.Event()
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as error:
        if late.is_set():
            raise OutOfTime(f"more than {seconds} s") from error
        raise
    finally:
        over.set()
        timer.cancel()
        context.removeJobTag(tag)


def counts_within(spark: SparkSession, tables: dict[str, DataFrame], known: dict[str, int] | None = None, per_table: float = PER_TABLE, in_all: float = IN_ALL) -> tuple[DataFrame, DataFrame]:
    """table_name and row_count of every table, and warnings (kind, n).

    Known counts stand as they are and are not counted again. A count that takes too long, or fails, is null and a warning
    (`time`, or the error's class); tables that the whole time does not reach are null and warned of as `skipped`."""
    end, rows, warnings = time.monotonic() + in_all, [], {}
    for name, df in tables.items():
        count, left = (known or {}).get(name), end - time.monotonic()
        if count is None:
            try:
                if left <= 0:
                    warnings["skipped"] = warnings.get("skipped", 0) + 1
                else:
                    count = within(spark, min(per_table, left), df.count)
            except OutOfTime:
                warnings["time"] = warnings.get("time", 0) + 1
            except Exception as error:  # noqa: BLE001 a table that cannot be read is a warning, not the end
                kind = type(error).__name__
                warnings[kind] = warnings.get(kind, 0) + 1
        rows.append((name, count))
    return spark.createDataFrame(rows, "table_name string, row_count long"), spark.createDataFrame(sorted(warnings.items()), "kind string, n long")


def select_within(spark: SparkSession, sql: str, args: dict | None = None, most: int = 1000, seconds: float = 30.0) -> tuple[list, bool]:
    """The first `most` rows of one read-only statement and whether there are more, or OutOfTime. Binds are named parameters; `most` bounds what the driver gets."""
    if not read_only(sql):
        raise ValueError("only one SELECT statement without writing or locking words is taken")
    rows = within(spark, seconds, lambda: spark.sql(sql, args=args or {}).limit(most + 1).collect())
    return rows[:most], len(rows) > most
