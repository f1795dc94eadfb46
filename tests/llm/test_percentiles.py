import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import percentiles as module
from pulseloom.llm.percentiles import Buffers, build_rollups, build_sketches, merge_sketches, percentiles

PS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def check(rows, values, size, fan):
    ordered = np.sort(values)
    for row in rows:
        n = len(values)
        assert row["n"] == n
        low, high = np.searchsorted(ordered, row["value"], "left"), np.searchsorted(ordered, row["value"], "right")
        wanted = row["p"] * n
        assert low - 1 <= wanted + row["rank_error"] and high + 1 >= wanted - row["rank_error"]
        levels = max(1, np.ceil(np.log(max(n / size, 2)) / np.log(fan)) + 1)
        assert row["rank_error"] <= n * levels / (2 * size) * 2 + fan**levels


@pytest.mark.parametrize("size,fan", [(8, 2), (16, 4), (64, 16)])
def test_error_keeps_its_bound(spark, size, fan):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 20_000), np.full(3_000, 7.0)])
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    merged = merge_sketches(build_sketches(df, [], "v", size=size, fan=fan), [], size=size, fan=fan)
    rows = percentiles(merged, [], PS, size=size, fan=fan).collect()
    assert len(rows) == len(PS) and rows[0]["rank_error"] > 0
    check(rows, values, size, fan)
    assert merged.select(F.sum(F.size("values"))).first()[0] < 25 * size * fan


def test_partial_results_combine(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i % 3}", "ab"[i % 2], float(v)) for i, v in enumerate(rng.normal(0, 1, 6_000))]
    df = spark.createDataFrame(rows, "day string, g string, v double")
    by_day = [merge_sketches(build_sketches(df.where(F.col("day") == d), ["day", "g"], "v", size=32, fan=4), ["day", "g"], size=32, fan=4) for d in ("d0", "d1", "d2")]
    whole = by_day[0].union(by_day[1]).union(by_day[2])
    got = percentiles(merge_sketches(whole, ["g"], size=32, fan=4), ["g"], PS, size=32, fan=4).collect()
    for g in "ab":
        check([r for r in got if r["g"] == g], np.array([v for _, k, v in rows if k == g]), 32, 4)


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), (None, 9.0)], "g string, v double")
    got = {(r["g"], r["p"]): (r["value"], r["rank_error"]) for r in percentiles(build_sketches(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert got == {("a", 0.5): (2.0, 0), ("b", 0.5): (5.0, 0), (None, 0.5): (9.0, 0)}


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert percentiles(merge_sketches(build_sketches(empty, ["g"], "v"), ["g"]), ["g"], PS).collect() == []
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (nan, 1.0), (nan, 3.0), (None, None), (1.0, float("inf"))], "g double, v double").withColumns({"level": F.lit(1), "values": F.lit("x")})
    got = {(None if r["g"] != r["g"] else r["g"]): (r["n"], r["value"]) for r in percentiles(build_sketches(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert got == {None: (2, 1.0), 1.0: (1, float("inf"))}


def test_buffers_are_deterministic_and_keep_counts():
    rng = np.random.default_rng(5)
    x = rng.normal(size=10_000)
    one, two = Buffers(16, 4), Buffers(16, 4)
    one.add_values(x)
    for part in np.array_split(x, 77):
        two.add_values(part)
    weigh = lambda b: sum(len(v) * 4 ** max(level, 0) for level, _, v in b.rows())
    assert weigh(one) == weigh(two) == len(x)
    assert [v.tolist() for _, _, v in one.rows()] == [v.tolist() for _, _, v in two.rows()]


def test_rollups_in_one_pass_hand_on_few_buffers_and_combine_in_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i % 40}" if i % 3 else "hot", float(i % 4) if i % 7 else None, float(v)) for i, v in enumerate(rng.gamma(2, 1, 24_000))]
    df = spark.createDataFrame(rows, "r string, s double, v double").repartition(64)
    made = build_rollups(df, {"r": ["r"], "s": ["s"], "all": []}, "v", size=8, fan=4)
    assert 256 < made.where("kind = 'all'").count() <= 64 * (3 * 6 + 1)  # tasks x (fan - 1) x levels, not values
    got = percentiles(made, ["kind", "r", "s"], PS, size=8, fan=4, part_buffers=256).collect()
    groups = {("all", None, None): [v for _, _, v in rows]}
    for r, s, v in rows:
        groups.setdefault(("r", r, None), []).append(v)
        groups.setdefault(("s", None, s), []).append(v)
    assert {(x["kind"], x["r"], x["s"]) for x in got} == set(groups)
    for key, values in groups.items():
        check([x for x in got if (x["kind"], x["r"], x["s"]) == key], np.array(values), 8, 4)


def test_parts_that_would_not_get_fewer_are_refused(spark):
    with pytest.raises(ValueError):
        merge_sketches(build_sketches(spark.createDataFrame([(1.0,)], "v double"), [], "v", fan=16), [], fan=16, part_buffers=100)


def test_a_task_hands_on_before_it_holds_too_much(spark, monkeypatch):
    monkeypatch.setattr(module, "TASK_VALUES", 200)
    rows = [(f"g{i % 30}", float(i)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "g string, v double").coalesce(1)
    got = percentiles(build_sketches(df, ["g"], "v", size=16, fan=4), ["g"], [0.5], size=16, fan=4).collect()
    assert {r["g"]: r["n"] for r in got} == {f"g{i}": 100 for i in range(30)}
