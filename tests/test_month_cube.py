"""The cube against the one-plan summary, on made-up sightings with checklists of several months, and its merges."""

import contextlib
import datetime as dt
import io
import random

from gridsurvey import fixtures as fx
from gridsurvey.operators import month_cube
from gridsurvey.operators.season import summarize_all_seasons
from gridsurvey.session import scratch_path
from gridsurvey.sources.writers import open_bucketed, write_bucketed

SCHEMA = ("checklist_id string, pba3_block string, common_name string, observer_id string, breeding_rank int, observation_date date, "
          "observation_month string, observation_datetime timestamp_ntz, duration_minutes double, effort_distance_km double, "
          "longitude double, latitude double")


def made_up(seed, n=600):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        c = r.randrange(n // 5)
        # Every eighth checklist lies in several months and places.
        day = dt.date(2020 + c % 2, 1 + (c * 5 + (r.randrange(3) if c % 8 == 0 else 0)) % 12, 1 + c % 28)
        start = None if r.random() < 0.1 else dt.datetime.combine(day, dt.time(c % 24, r.randrange(3)))
        rows.append((f"S{c}", None if c % 11 == 0 else f"B{c % 7}", r.choice([None, *"abcdefgh"]), r.choice([None, "o1", "o2,o3", "o3,o1", "o4"]),
                     r.choice([None, 0, 1, 2, 3, 4, 4, 2, 1]), day, day.strftime("%b"), start,
                     r.choice([None, 5.0, 30.0, 61.5]), r.choice([None, 0.5, 2.0]), -80.0 + (k % 3 if c % 8 == 0 else c % 3), 40.0))
    return rows


def shown(df):
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return [tuple(map(plain, x)) for x in v] if isinstance(v, list) else v
    return sorted((str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()))


def nocturnal(spark):
    return spark.createDataFrame([("a",), ("c",), ("zz",)], "common_name string")


def test_cube_equals_summary(spark):
    x = spark.createDataFrame(made_up(1), SCHEMA).repartition(3)
    cube = month_cube.build_cube(x)
    assert cube.several.count() > 0
    assert shown(month_cube.seasons_of_cube(cube, nocturnal(spark))) == shown(summarize_all_seasons(x, nocturnal(spark)))
    only = {"Spring": ["Mar", "Apr", "May"]}
    assert shown(month_cube.seasons_of_cube(cube, nocturnal(spark), only)) == shown(
        summarize_all_seasons(x, nocturnal(spark), seasons=only))
    empty = month_cube.build_cube(x.limit(0))
    assert month_cube.seasons_of_cube(empty, nocturnal(spark)).count() == 0


def test_ids_are_dense_and_stay(spark):
    some = month_cube.dense_ids(spark.createDataFrame([(v,) for v in ["b", "a", None, "a"]], "v string"))
    first = {r.v: r.id for r in some.collect()}
    assert sorted(first.values()) == [0, 1, 2]
    more = month_cube.dense_ids(spark.createDataFrame([(f"n{k}",) for k in range(500)] + [("a",), (None,)], "v string"), some)
    second = {r.v: r.id for r in more.collect()}
    assert sorted(second.values()) == list(range(503)) and all(second[v] == i for v, i in first.items())


def stored(spark, cube):
    """The cube written and read back, as a refresh keeps it."""
    from dataclasses import fields, replace

    tables = {}
    for f in fields(cube):
        path = scratch_path(spark, f.name)
        getattr(cube, f.name).write.parquet(path)
        tables[f.name] = spark.read.parquet(path)
    return replace(cube, **tables)


def test_late_month_is_merged(spark):
    rows = made_up(2)
    june = dt.date(2020, 6, 1)
    late = [r for r in rows if r[5].replace(day=1) == june]
    assert late and len({r[0] for r in late} & {r[0] for r in rows if r not in late}) > 0  # some of its checklists lie in other months, too
    before = spark.createDataFrame([r for r in rows if r not in late], SCHEMA)
    late += [("S-new", "B1", "new species", "new observer", 4, june, "Jun", None, 7.0, 1.0, -80.0, 40.0)]
    after = before.unionByName(spark.createDataFrame(late, SCHEMA))
    old = stored(spark, month_cube.build_cube(before))
    months = month_cube.changed_months(after, [june], old)
    new = month_cube.build_cube(month_cube.changed_rows(after, months), species_ids=old.species_ids, observer_ids=old.observer_ids)
    merged = month_cube.merge_cubes(old, new)
    assert shown(month_cube.seasons_of_cube(merged, nocturnal(spark))) == shown(summarize_all_seasons(after, nocturnal(spark)))
    touched = {r[0] for r in new.species.select("month_start").distinct().collect()}
    assert june in touched and len(touched - {june}) > 0 and touched == set(months)
    assert len({r[0] for r in old.species.select("month_start").distinct().collect()} - touched) > 8
    # and taken out again
    merged = stored(spark, merged)
    months = month_cube.changed_months(before, [june], merged)
    gone = month_cube.without_months(merged, [june])
    undone = month_cube.merge_cubes(gone, month_cube.build_cube(month_cube.changed_rows(before, months), species_ids=merged.species_ids, observer_ids=merged.observer_ids))
    assert shown(month_cube.seasons_of_cube(undone, nocturnal(spark))) == shown(summarize_all_seasons(before, nocturnal(spark)))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_buckets_save_the_exchanges_of_checklists(spark, small):
    path = scratch_path(spark, "buckets")
    x = write_bucketed(fx.sightings(spark, small), path, "checklist_id", 4)
    cube = month_cube.build_cube(x)
    text = plan(cube.effort)
    exchanges = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning")]
    assert len(exchanges) == 1 and "checklist_id" not in exchanges[0], exchanges
    again = open_bucketed(spark, path, "checklist_id", 4)
    assert sorted(map(str, again.collect())) == sorted(map(str, x.collect()))
    assert plan(month_cube.build_cube(again).effort).count("Arguments: hashpartitioning") == 1


def test_observers_are_read_once(spark):
    """Observer ids and sets come from the kept observers of the cells, not from the sightings again."""
    path = scratch_path(spark, "made_up")
    spark.createDataFrame(made_up(5, 60), SCHEMA).write.parquet(path)
    reading = []

    def keep(name, df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        if path.rsplit("/", 1)[1] in out.getvalue():
            reading.append(name)
        df.write.parquet(kept := scratch_path(spark, name))
        return spark.read.schema(df.schema).parquet(kept)

    month_cube.build_cube(spark.read.parquet(path), keep=keep)
    assert [name for name in reading if "observer" in name] == ["cell_observers"]
