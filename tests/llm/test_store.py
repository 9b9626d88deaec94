import threading

import pytest

from marquee.llm.store import Scope, fresh_path, written


def test_scopes_of_two_runs_in_threads(spark):
    """Each run deletes its own tables, though both make theirs in turn; a table outside any scope stays."""
    free = written(spark.range(3), "free")
    turns, found = threading.Barrier(2, timeout=120), {}

    def run(name, n):
        with Scope() as own:
            first = written(spark.range(n), name)
            turns.wait()
            second = written(spark.range(n), name)
        turns.wait()
        if name == "a":
            own.clear(spark)
            assert own.tables == []
        turns.wait()
        found[name] = own, first, second

    threads = [threading.Thread(target=run, args=x) for x in (("a", 5), ("b", 7))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    own, first, second = found["b"]
    assert first.count() == second.count() == 7 and free.count() == 3 and len(own.tables) == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FILE_NOT_EXIST"):
        found["a"][1].count()
    own.clear(spark)


def test_scopes_nest(spark):
    with Scope() as outer:
        a = fresh_path(spark, "a")
        with Scope() as inner:
            b = fresh_path(spark, "b")
        c = fresh_path(spark, "c")
    assert (outer.tables, inner.tables) == ([a, c], [b])
