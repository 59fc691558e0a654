"""Log statements restored from rows: pairing by thread, values by type, warnings; many ranges against one pass in order."""

import random
import re

from quarrylens.sources import log_sql

CASES = [
    ("select * from t where a = ? and b = ?", "it's(String), null", "select * from t where a = 'it''s' and b = NULL", None),
    ("x ?", "5(Integer)", "x 5", None),
    ("q ? '?' \"a?\" ?", "a, b(String), 2024-01-01 10:00:00.0(Timestamp)", "q 'a, b' '?' \"a?\" '2024-01-01 10:00:00.0'", None),
    ("n ? ? ?", "12, x, -1.5", "n 12 'x' -1.5", None),
    ("b ?", "true(java.lang.Boolean)", "b true", None),
    ("two ? ?", "1(Integer)", "two ? ?", "count"),
    ("none", "", "none", None),
    ("one ?", None, "one ?", "parameters"),
    ("none at all", None, "none at all", None),
    ("open ? 'it''s ?", "(String)", "open '' 'it''s ?", None),
    ("e ? ?", ", 1(Long)", "e '' 1", "either"),
    ("n ?", "null", "n NULL", None),
    ("n ?", "nullable(String)", "n 'nullable'", None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "thread string, seq long, line string")


def test_values(spark):
    rows = []
    for k, (sql, parameters, _, _) in enumerate(CASES):
        rows.append((f"t{k}", 1, f"10:00 DEBUG ==>  Preparing: {sql} "))
        rows.append((f"t{k}", 2, "other line"))
        if parameters is not None:
            rows.append((f"t{k}", 3, f"10:00 DEBUG ==> Parameters: {parameters}"))
    got = {r.thread: (r.restored, r.warning) for r in log_sql.restored(frame(spark, rows)).collect()}
    for k, (_, _, want, warning) in enumerate(CASES):
        if warning != "either":
            assert got[f"t{k}"] == (want, warning), CASES[k]


def test_pairing_in_order(spark):
    """Threads that are woven into each other, one of them most of the log, over many ranges."""
    rnd = random.Random(1)
    rows, want, last = [], {}, {}
    for seq in range(3000):
        thread = rnd.choice(["hot"] * 6 + ["a", "b"])
        kind = rnd.random()
        if kind < 0.3:
            rows.append((thread, seq, f"Preparing: s{seq} ?"))
            want[thread, seq] = None
            last[thread] = seq
        elif kind < 0.6:
            rows.append((thread, seq, f"Parameters: {seq}(Integer)"))
            if thread in last and want[thread, last[thread]] is None:
                want[thread, last[thread]] = seq
        else:
            rows.append((thread, seq, None if kind < 0.7 else "noise"))
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.thread, r.seq): r.restored for r in log_sql.restored(frame(spark, rows).repartition(7)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(t, s): f"s{s} {v if v is not None else '?'}" for (t, s), v in want.items()}


def test_nothing(spark):
    assert log_sql.restored(frame(spark, [])).count() == 0
    assert log_sql.restored(frame(spark, [("a", 1, "Parameters: 1(Integer)"), ("a", 2, None)])).count() == 0
    assert not re.search("pandas|mapInArrow|udf", open(log_sql.__file__).read())
