"""Action blocks count once, and what they change is written in one step or not at all."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import blocks
from ledgerleaf.sources import commits

SHAPES = {
    "threads": "thread_id long, status string, phase string, active_turn long, last_turn long",
    "turns": f"turn_id long, thread_id long, status string, phase string, worker string, beat long, tokens long, error {blocks.ERROR}, completed_at long",
    "calls": f"call_id long, turn_id long, status string, beat long, tokens long, error {blocks.ERROR}, completed_at long",
    "tools": "tool_id string, thread_id long, turn_id long, call_id long, item_seq long, tool string, arguments string, status string, worker string, beat long, error string, completed_at long",
    "items": "thread_id long, seq long, item_type string, role string, content_text string",
}


def state(spark, **rows):
    return blocks.Runtime(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SHAPES.items()})


def start(spark):
    turn = lambda i, thread, phase="executing_model": (i, thread, "active", phase, "w", 5, None, None, None)
    return state(
        spark,
        threads=[(1, "running", "executing", 10, None), (2, "running", "executing", 20, None)],
        turns=[turn(10, 1), turn(20, 2), turn(30, 3, "executing_tools")],
        calls=[(100, 10, "running", 5, None, None, None), (200, 20, "running", 5, None, None, None), (201, 20, "completed", None, None, None, None), (300, 30, "running", 5, None, None, None)],
        items=[(1, 1, "message", "user", "q"), (1, 2, "message", "user", "r")],
    )


def told(spark):
    responses = spark.createDataFrame([(100, 7), (201, 9), (300, 9), (999, 9)], "call_id long, tokens long")
    outputs = spark.createDataFrame([(100, 1, "message", None, "a"), (100, 2, "tool_call", "search", "{}"), (201, 1, "message", None, "late"), (300, 1, "message", None, "early")], "call_id long, ord int, item_type string, tool string, body string")
    return responses, outputs


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_a_response_counts_once(spark):
    one = blocks.succeed(start(spark), *told(spark), 50)
    two = blocks.succeed(one, *told(spark), 60)
    for got in (one, two):
        assert rows(got.items, "thread_id", "seq", "content_text") == [(1, 1, "q"), (1, 2, "r"), (1, 3, "a"), (1, 4, "{}")]
        assert rows(got.tools, "tool_id", "turn_id", "item_seq", "status") == [("100:2", 10, 4, "requested")]
        assert rows(got.turns, "turn_id", "phase", "tokens") == [(10, "executing_tools", 7), (20, "executing_model", None), (30, "executing_tools", None)]
        assert rows(got.calls, "call_id", "status", "completed_at")[0] == (100, "completed", 50)


def test_failure_and_the_end_of_turns(spark):
    failures = spark.createDataFrame([(200, "gone")], "call_id long, message string")
    got = blocks.finish(blocks.fail(start(spark), failures, 50), 51)
    assert rows(got.turns.where("turn_id = 20"), "status", "phase", "worker", "error.message", "completed_at") == [("failed", "failed", None, "gone", 51)]
    assert rows(got.threads, "thread_id", "status", "phase", "active_turn", "last_turn") == [(1, "running", "executing", 10, None), (2, "active", "idle", None, 20)]


def test_a_thread_goes_back_to_one_turn(spark):
    """Two stale calls of a turn, a thread on another turn, a fresh call, one without a heartbeat."""
    tool = lambda i, thread, turn, beat, status="running": (i, thread, turn, None, None, "t" + i, "{}", status, "w", beat, None, None)
    turn = lambda i, thread, status="active": (i, thread, status, "executing_tools", "w", 5, None, None, None)
    s = state(
        spark,
        threads=[(1, "active", "idle", None, None), (2, "running", "executing", 99, None), (3, "running", "executing", 30, None)],
        turns=[turn(10, 1), turn(11, 1), turn(20, 2), turn(30, 3)],
        tools=[tool("b", 1, 10, 3), tool("a", 1, 10, 4), tool("c", 1, 11, 5), tool("d", 2, 20, 1), tool("e", 3, 30, 100), tool("f", 3, 30, None), tool("g", 3, 30, 1, "completed")],
    )
    got = blocks.fail_stale_turns(s, 50, 60, "stale")
    assert rows(got.tools, "tool_id", "status", "worker", "completed_at")[:4] == [("a", "running", "w", None), ("b", "failed", None, 60), ("c", "running", "w", None), ("d", "running", "w", None)]
    assert rows(got.turns, "turn_id", "status", "phase", "error.tool") == [(10, "active", "failed", "tb"), (11, "active", "executing_tools", None), (20, "active", "executing_tools", None), (30, "active", "executing_tools", None)]
    assert rows(got.threads, "thread_id", "status", "phase", "active_turn") == [(1, "running", "failed", 10), (2, "running", "executing", 99), (3, "running", "executing", 30)]
    assert {r.tool_id for r in blocks.fail_stale_tools(s.tools, 50, 60, "stale").where("status = 'failed'").collect()} == {"a", "b", "c", "d"}


def write(store, got, was, batch):
    new = got.items.join(was.items.select("thread_id", "seq"), ["thread_id", "seq"], "left_anti").select(*got.items.columns)
    return store.commit("loop", batch, replaced={"calls": got.calls, "turns": got.turns}, appended={"items": new, "tools": got.tools.join(was.tools.select("tool_id"), "tool_id", "left_anti").select(*got.tools.columns)})


def test_all_tables_or_none(spark, tmp_path, monkeypatch):
    store, first = commits.Store(spark, str(tmp_path)), start(spark)
    assert store.commit("setup", 0, replaced={"calls": first.calls, "turns": first.turns, "tools": first.tools, "items": first.items, "threads": first.threads})
    was = blocks.Runtime(**store.read())
    got = blocks.succeed(was, *told(spark), 50)
    whole, seen = commits.Store.stage, []

    def stops(self, name, df):
        seen.append(name)
        if len(seen) == 3:
            raise RuntimeError("executor gone")
        return whole(self, name, df)

    monkeypatch.setattr(commits.Store, "stage", stops)
    with pytest.raises(RuntimeError, match="gone"):
        write(store, got, was, 1)
    monkeypatch.setattr(commits.Store, "stage", whole)
    now = store.read()
    assert now["items"].count() == 2 and now["calls"].where("status = 'completed'").count() == 1 and store.version()[0] == 1
    assert write(store, got, was, 1) and not write(store, got, was, 1) and not write(store, got, was, 0)
    now = store.read()
    assert now["items"].count() == 4 and now["tools"].count() == 1 and now["turns"].where("phase = 'executing_tools'").count() == 2
    again = blocks.Runtime(**now)
    assert write(store, blocks.succeed(again, *told(spark), 70), again, 2)
    assert store.read()["items"].count() == 4 and rows(store.read()["calls"], "call_id", "completed_at")[0] == (100, 50)
    folders = store.version()[1]["tables"]["items"]["folders"]
    store.compact("items")
    assert len(folders) == 3 and len(store.version()[1]["tables"]["items"]["folders"]) == 1 and store.sweep() > 0
    assert rows(store.read()["items"], "seq", "content_text") == [(1, "q"), (2, "r"), (3, "a"), (4, "{}")] and commits.Store(spark, str(tmp_path)).version()[0] == 4


def test_the_slower_writer_is_told(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path))
    store.commit("a", 0, replaced={"t": spark.range(3)})
    n, content = store.version()
    store.commit("b", 0, appended={"t": spark.range(3, 5)})
    with pytest.raises(commits.Conflict):
        store._publish(n + 1, content)
    assert store.read()["t"].agg(F.sum("id")).first()[0] == 10 and store.read(content)["t"].count() == 3
    assert commits.Store(spark, str(tmp_path / "none")).read() == {}
