"""Packs on disk, samples that merge, measured preferences."""

import json
import math
import os
import random
import tarfile
import uuid

import pytest

from melisma.operators import measured as M
from melisma.operators import sampling as S
from melisma.sources import archives as A


@pytest.fixture
def pack(spark, tmp_path):
    A.registered(spark)
    rows = [(f"d{k % 7}/{'long name ' * (k % 3 * 8)}é{k}.bin", random.Random(k).randbytes(k * 97 % 3000)) for k in range(120)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, A.SCHEMA).repartition(4).write.format("pack").mode("append").save(path)
    return path, rows


def read(spark, path, **options):
    return sorted((r.name, bytes(r.content)) for r in spark.read.format("pack").options(**options).load(path).collect())


def test_what_is_written_is_read_in_several_tasks(spark, pack):
    path, rows = pack
    assert read(spark, path) == sorted(rows)
    df = spark.read.format("pack").option("split", 5000).load(path)
    assert df.rdd.getNumPartitions() > 8 and sorted((r.name, bytes(r.content)) for r in df.collect()) == sorted(rows)
    with tarfile.open(os.path.join(path, next(f for f in os.listdir(path) if f.endswith(".tar")))) as t:  # any tar reads it
        assert {m.name for m in t} <= {n for n, _ in rows}


def test_appends_add_archives_and_leftovers_are_no_part(spark, pack):
    path, rows = pack
    with open(os.path.join(path, uuid.uuid4().hex + ".tar"), "wb") as f:  # of a task that failed
        f.write(b"x" * 512)
    more = [("more/a", b"1"), ("more/b", b"")]
    spark.createDataFrame(more, A.SCHEMA).write.format("pack").mode("append").save(path)
    assert read(spark, path) == sorted(rows + more)
    spark.createDataFrame(more, A.SCHEMA).write.format("pack").mode("overwrite").save(path)
    assert read(spark, path) == more
    spark.createDataFrame([], A.SCHEMA).write.format("pack").mode("overwrite").save(path)
    assert read(spark, path) == []


def test_damage_is_found(spark, pack):
    path, _ = pack
    name = next(a for a in A.read_index(path) if a["members"] > 5)["archive"]
    file, members = os.path.join(path, name), os.path.join(path, name + ".members")
    good, listed = open(file, "rb").read(), open(members, "rb").read()
    line = next(x for x in map(json.loads, listed.split(b"\n")) if x[3] > 10)
    for at, what in ((line[1] + line[2] + 3, "is damaged"), (line[1], "header")):
        bad = bytearray(good)
        bad[at] ^= 1
        open(file, "wb").write(bad)
        with pytest.raises(Exception, match=what):
            read(spark, path)
    open(file, "wb").write(good[: line[1] + line[2] + 5])
    with pytest.raises(Exception, match="ends within"):
        read(spark, path)
    open(file, "wb").write(good)
    open(members, "wb").write(listed + b" ")
    with pytest.raises(Exception, match="member list"):
        read(spark, path)
    open(members, "wb").write(listed)
    assert len(read(spark, path)) == 120
    os.remove(os.path.join(path, A.INDEX))
    with pytest.raises(Exception, match="no pack"):
        read(spark, path)


def test_members_stay_within_their_folder(spark, tmp_path):
    assert all(map(A.safe, ("a", "a/b.c", "é/..x"))) and not any(map(A.safe, ("", "/a", "../a", "a/../b", "a//b", "a\\b", "a/.", "a\0")))
    A.registered(spark)
    with pytest.raises(Exception, match="can't be named"):
        spark.createDataFrame([("../x", b"1")], A.SCHEMA).write.format("pack").mode("append").save(str(tmp_path / "q"))


def test_the_merge_of_parts_is_the_sample_of_the_whole(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, 1.0, 5.0, 40.0]) if k % 11 else None, rng.randint(0, 3)) for k in range(400)] + [(3, 90.0, 0), (3, 2.0, 2)]
    df = spark.createDataFrame(rows, "k int, w double, part int").repartition(5)
    whole = [(r.k, r.w, r.priority) for r in S.bottom_k(df, "k", "w", 25, 9).collect()]
    assert len(whole) == 26 and len({k for k, *_ in whole}) == 26 and all(w > 0 for _, w, _ in whole)
    parts = [S.bottom_k(df.filter(f"part = {p}"), "k", "w", 25, 9) for p in range(4)]
    assert sorted((r.k, r.w, r.priority) for r in S.merged(parts, "k", "w", 25).collect()) == sorted(whole)
    twice = [S.merged(parts[:2], "k", "w", 25), S.merged(parts[2:], "k", "w", 25)]
    assert sorted((r.k, r.w, r.priority) for r in S.merged(twice, "k", "w", 25).collect()) == sorted(whole)
    grouped = S.bottom_k(df, "k", "w", 25, 9, ["part"]).collect()
    assert sorted((r.k, r.priority) for r in grouped if r.part == 1) == sorted((r.k, r.priority) for r in parts[1].collect())


def test_what_a_sample_stands_for(spark):
    df = spark.createDataFrame([(k, float(1 + k % 9)) for k in range(3000)], "k int, w double")
    errors = []
    for seed in range(6):
        got = S.weighted(S.bottom_k(df, "k", "w", 400, seed), "k", "w", 400).collect()
        assert len(got) == 400
        errors.append(sum(r.stands_for for r in got) / 3000 - 1)
    assert abs(sum(errors) / 6) < 0.06 and max(map(abs, errors)) < 0.2
    few = S.weighted(S.bottom_k(df.limit(10), "k", "w", 400), "k", "w", 400).collect()
    assert len(few) == 10 and all(r.stands_for == 1.0 for r in few)
    assert S.bottom_k(df.limit(0), "k", "w", 5).count() == 0


def test_measured_preferences(spark):
    tracks = spark.createDataFrame([(1, {"bpm": 60.0, "energy": 0.2}), (2, {"bpm": 100.0, "energy": None}), (3, {"energy": 0.9}), (4, {}), (5, {"bpm": 140.0, "energy": 0.5})], "id int, measures map<string,double>")
    wishes = spark.createDataFrame([("a", "slow", True), ("a", "relaxing", True), ("b", "slow", False), ("c", "unheard", True), ("d", "slow", True), ("d", "relaxing", True)], "request string, phrase string, wanted boolean")
    got = {(r.request, r.id): (r.preference, r.measured, r.missing, r.rank) for r in M.preferences(wishes, tracks, M.rules(spark), 3).collect()}
    assert got["a", 1] == (1.0, 2, 0, 1) and got["a", 2] == (0.5, 1, 1, 2) and got["a", 5] == (0.25, 2, 0, 3)
    assert {k[1]: v for k, v in got.items() if k[0] == "d"} == {k[1]: v for k, v in got.items() if k[0] == "a"}
    assert [i for _, i in sorted((v[3], k[1]) for k, v in got.items() if k[0] == "b")] == [5, 2, 1] and got["b", 5][0] == 1.0 and not any(k[0] == "c" for k in got)
    assert math.isclose(got["b", 2][0], 0.5)
