"""What large tables need: plans that keep found rows where they are, and even work whatever the file's splits."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stacksift.operators import imports
from stacksift.plans import registry
from stacksift.streaming import skips

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_edition_pairs_of_many_rows_of_a_title(spark, monkeypatch):
    monkeypatch.setattr(imports, "CELL_ROWS", 4, raising=False)
    rows = [(i, ["red bolt 1", "red bolt 2", "hot ring 1", "new anvil"][i % 4], "v", f"p{i % 2}" if i % 5 else None, f"i{i // 8}") for i in range(60)] + [(7, "new anvil", "v", "p1", "i0"), (61, "red bolt 1", None, "p1", "i0")]
    df = spark.createDataFrame(rows, "id long, title string, volume string, publisher string, prefix string")
    made = imports.edition_pairs(df, "title", F.array("publisher", "prefix"))
    same = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    want = Counter()
    for a, b in ((a, b) for a in rows for b in rows if a[0] < b[0]):
        if len(a[1]) == len(b[1]) and a[2] == b[2] == "v" and ((a[3] and a[3] == b[3]) or a[4] == b[4]) and same(a[1], b[1]) >= 0.6:
            want[(a[0], b[0], round(same(a[1], b[1]), 6))] += 1
    assert Counter(tuple(r) for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # pairs are not shuffled


@pytest.mark.parametrize("name", ["name_notes", "name_kinds", "merge_ratios", "resplit_additions", "credit_people", "credit_lines"])
def test_lines_of_a_small_file_are_dealt_to_all_tasks(spark, name):
    """Costly expressions run on even partitions, and none is copied into filters or into its own branches."""
    made = registry.queries()[name](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange RoundRobinPartitioning" in plan
    assert made._jdf.queryExecution().optimizedPlan().toString().count("EndsWith") <= 4


@pytest.mark.parametrize("name", ["credit_people", "credit_lines"])
def test_lines_go_to_the_table_function_in_batches(spark, name):
    """The table function on Arrow works line by line, which took half of these queries' time."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


class _Store:
    """State and timers of one key, with the messages that a processor sends to them."""

    def __init__(self):
        self.value, self.days, self.timers, self.sent = None, {}, [], []

    def __getattr__(self, name):
        def send(*args):
            self.sent.append(name)
            return getattr(self, f"_{name}")(*args)

        return send

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815
    _exists = lambda self: self.value is not None
    _get = lambda self: self.value
    _update = lambda self, value: setattr(self, "value", value)
    _containsKey = lambda self, day: day in self.days  # noqa: E731, N815
    _getValue = lambda self, day: self.days[day]  # noqa: E731, N815
    _updateValue = lambda self, day, n: self.days.update({day: n})  # noqa: E731, N815
    _listTimers = lambda self: iter(self.timers)  # noqa: E731, N815
    _deleteTimer = lambda self, t: self.timers.remove(t)  # noqa: E731, N815
    _registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815

    def _clear(self):
        self.value = None
        self.days.clear()


def test_a_new_key_sends_few_messages_to_the_state_store():
    day = lambda d: pd.Timestamp(f"2024-01-{d:02d} 10:00:00")
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["attempt", "at", "outcome"])])
    store = _Store()
    made = skips._Skips("user_id", 7)
    made.init(store)
    (out,) = made.handleInputRows((5,), batch((3, day(9), "bad"), (1, day(1), "ok"), (2, day(1), "ok")), None)
    assert out[["attempt", "decision", "times"]].values.tolist() == [[1, "ok", 0], [2, "ok", 0], [3, "failed", 1]]
    assert store.sent == ["get", "update", "updateValue", "registerTimer"]
    failed = datetime.date(2024, 1, 9)
    assert store.value == (failed, failed, 1) and store.days == {(failed,): (1,)} and len(store.timers) == 1
    (out,) = made.handleInputRows((5,), batch((4, day(10), "ok"), (5, day(20), "bad"), (6, day(28), "error"), (7, day(29), "ok")), None)
    assert out["decision"].tolist() == ["skipped", "failed", "error", "ok"] and out["attempt"].tolist() == [4, 5, 6, 7]
    assert store.value is None and store.days == {} and store.timers == []
