"""Distinct counts by bitmaps against counts of sets."""

from itertools import product

from crewcast.operators.head_counts import bitmaps, numbered_keys, rolled_up

SETS = (("day", "team"), ("team",), ("day",), ())


def counted(rows, sets=SETS):
    people = {}
    for key, day, team in rows:
        if key is None:
            continue
        for columns in sets:
            group = (day if "day" in columns else None, team if "team" in columns else None, ",".join(columns))
            people.setdefault(group, set()).add(key)
    return {group: len(keys) for group, keys in people.items()}


def as_dict(df):
    rows = df.collect()
    result = {(r["day"], r["team"], r["grouped_by"]): r["people"] for r in rows}
    assert len(result) == len(rows)
    return result


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, day int, team string")


def test_counts_with_nulls_repeats_and_keys_in_several_groups(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("b", None, "x"), (None, 1, "z"), ("", 2, "x")]
    df = table(spark, rows)
    numbers = numbered_keys(df, "key", ("team",))
    assert sorted(r["_number"] for r in numbers.collect()) == [1, 2, 3]
    assert as_dict(rolled_up(bitmaps(df, numbers, "key", ("day", "team")), SETS, "people")) == counted(rows)


def test_empty_table_gives_no_groups(spark):
    df = table(spark, [])
    assert rolled_up(bitmaps(df, numbered_keys(df, "key"), "key", ("day", "team")), SETS, "people").collect() == []


def test_keys_of_many_buckets_and_one_group_with_most_of_them(spark):
    df = spark.range(100_000).selectExpr(
        "cast(id AS string) AS key", "cast(id % 3 AS int) AS day", "if(id % 4 = 0, 'rare', 'hot') AS team"
    )
    df = df.unionByName(df)
    table = bitmaps(df, numbered_keys(df, "key", ("team",)), "key", ("day", "team"))
    assert table.filter("day = 0").count() <= 6  # neighbours in number: four buckets in all, one shared by both teams
    result = as_dict(rolled_up(table, SETS, "people"))
    assert result[(None, None, "")] == 100_000
    assert result[(None, "hot", "team")] == 75_000
    assert result[(0, None, "day")] == 33_334


def test_bitmaps_of_two_parts_merge_to_those_of_the_whole(spark):
    rows = [(str(k), d, t) for k, d, t in product(range(40), range(3), "xy") if (k * 7 + d) % 5 and (k + len(t)) % 3]
    df = table(spark, rows)
    numbers = numbered_keys(df, "key")
    parts = [bitmaps(df.filter(f"day % 2 = {n}"), numbers, "key", ("day", "team")) for n in (0, 1)]
    parts.append(parts[0])  # what was counted already changes nothing
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert as_dict(rolled_up(merged, SETS, "people")) == counted(rows)


def test_rows_of_a_bitmap_are_spread(spark):
    rows = [(f"k{n % 50}", n % 3, "a") for n in range(300)] * 2
    data = table(spark, rows)
    bits = bitmaps(data, numbered_keys(data, "key"), "key", ("day", "team"))
    plan = bits._jdf.queryExecution().executedPlan().toString()
    # By the key and by the group, over a number of tasks that is not fitted to the bytes moved.
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert as_dict(rolled_up(bits, SETS, "people")) == counted(rows)
