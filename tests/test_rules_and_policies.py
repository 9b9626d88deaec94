import random

import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import policies


def first_match(path, rules):
    if path is None:
        return None
    for _, prefix, to in sorted(rules):
        if path.startswith(prefix):
            return to + path[len(prefix):]
    return path


def test_rules_like_the_first_match(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice(["a", "b", "/", "é", "\U0010ffff"]) for _ in range(rnd.randrange(n)))
    paths = [None, "", *[word(9) for _ in range(300)]]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "item_id long, path string")
    for n in (1, 2, 7, 300):
        numbers = rnd.sample(range(1000), n)
        rules = [(k, word(6), f"<{k}>") for k in numbers]
        got = {r.item_id: r.resolved for r in table.select("item_id", S.resolve_by_rules(F.col("path"), rules).alias("resolved")).collect()}
        assert got == {i: first_match(p, rules) for i, p in enumerate(paths)}
        joined = S.resolve_by_table(table.where("path <> ''"), spark.createDataFrame([r for r in rules if r[1]] or [(0, "none", "")], "ordinal long, prefix string, replacement string"))
        assert {r.item_id: r.resolved for r in joined.collect()} == {i: first_match(p, [r for r in rules if r[1]]) for i, p in enumerate(paths) if p}
    assert table.select(S.resolve_by_rules(F.col("path"), []).alias("path")).collect() == table.select("path").collect()
    plan = table.select(S.resolve_by_rules(F.col("path"), rules).alias("r"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="resolve_by_table"):
        S.resolve_by_rules(F.col("path"), [(k, f"p{k}", "") for k in range(S.MOST_RULES + 1)])


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_rules_of_one_prefix_count_once(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_SHARED", most)
    rules = [(k, p, f"<{k}>") for k in range(40) for p in ("/a", "/a/b", "/c")] + [(50, "/a/b/long", "<long>"), (-1, "/a/b/c", "<c>")]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(["/a/b/c", "/a", "/a/b/long/x", "/d"])], "item_id long, path string")
    kept = S.first_rules(spark.createDataFrame(rules, "ordinal long, prefix string, replacement string"))
    assert {tuple(r) for r in kept.collect()} == {(0, "/a", "<0>"), (0, "/a/b", "<0>"), (0, "/c", "<0>"), (50, "/a/b/long", "<long>"), (-1, "/a/b/c", "<c>")}
    found = {r.path: r.resolved for r in S.resolve_by_table(table, spark.createDataFrame(rules, "ordinal long, prefix string, replacement string")).collect()}
    assert found == {"/a/b/c": "<c>", "/a": "<0>", "/a/b/long/x": "<0>/b/long/x", "/d": "/d"}


def rows(state):
    return {r.user_id: (r.folders, r.seq) for r in state.collect()}


def test_changes_twice_in_pieces_and_replayed(spark, tmp_path):
    users = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, None)], "user_id long, enabled_folders array<string>")
    state = policies.initial_state(users)
    kind = "user_id long, new_folders array<string>"
    steps = [[(1, ["a"]), (9, ["unknown"])], [(1, []), (2, ["c", "d"])], [(2, ["e"]), (3, ["f"])]]
    path = str(tmp_path / "log")
    assert rows(policies.apply_changes(state, policies.read_changes(spark, path))) == {1: (["a", "b"], 0), 2: (["c"], 0), 3: (None, 0)}
    for seq, step in enumerate(steps, 1):
        for _ in range(2):  # a run that is repeated
            policies.append_changes(policies.as_changes(spark.createDataFrame(step, kind), "r", seq), path)
    log = policies.read_changes(spark, path)
    assert log.count() == 6
    expected = [{1: (["a", "b"], 0), 2: (["c"], 0), 3: (None, 0)}, {1: (["a"], 1), 2: (["c"], 0), 3: (None, 0)}, {1: ([], 2), 2: (["c", "d"], 2), 3: (None, 0)}, {1: ([], 2), 2: (["e"], 3), 3: (["f"], 3)}]
    for until, want in enumerate(expected):
        assert rows(policies.apply_changes(state, log, until)) == want
    for pieces in ([log, log], [log.where("seq = 1"), log], [log.where("seq <= 2"), log.where("seq >= 2"), log.where("seq = 1")], [log.unionByName(log)]):
        now = state
        for piece in pieces:
            now = policies.apply_changes(now, piece)
        assert rows(now) == expected[-1]
    assert {r.seq for r in policies.read_changes(spark, path, 1, 2).collect()} == {2}
