import os
import threading

import pytest

from lodestar.sources import upsert

SCHEMA = "k long, v string"


def rows(spark, path):
    return sorted(map(tuple, upsert.read(spark, path).select("k", "v").collect()), key=str)


def frame(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


@pytest.fixture
def path(spark, tmp_path):
    at = str(tmp_path / "table")
    upsert.upsert(frame(spark, (1, "a"), (2, "b"), (3, "c")), at, ["k"], buckets=8)
    return at


class Killed(BaseException):
    pass


@pytest.mark.parametrize("step", ["materialize", "_write", "_claim", "link", "after data", "after claim"])
def test_a_writer_that_dies_loses_nothing(spark, path, monkeypatch, step):
    write, claim = upsert._write, upsert._claim

    def die(*_):
        raise Killed

    def late(f):
        def run(*given):
            f(*given)
            raise Killed

        return run

    if step == "link":
        monkeypatch.setattr(os, "link", die)
    elif step.startswith("after"):
        name, f = ("_write", write) if step == "after data" else ("_claim", claim)
        monkeypatch.setattr(upsert, name, late(f))
    else:
        monkeypatch.setattr(upsert, step, die)
    with pytest.raises(Killed):
        upsert.upsert(frame(spark, (2, "x"), (4, "d")), path, ["k"])
    monkeypatch.undo()
    assert rows(spark, path) == ([(1, "a"), (2, "x"), (3, "c"), (4, "d")] if step == "after claim" else [(1, "a"), (2, "b"), (3, "c")])
    upsert.upsert(frame(spark, (3, "y")), path, ["k"])
    assert (3, "y") in rows(spark, path) and len(rows(spark, path)) == (4 if step == "after claim" else 3)


def test_of_two_writers_one_retries(spark, path, monkeypatch):
    claim, tries = upsert._claim, []

    def contested(*given):
        tries.append(given[2])
        if len(tries) == 1:  # another writer comes first
            monkeypatch.setattr(upsert, "_claim", claim)
            upsert.upsert(frame(spark, (2, "first"), (5, "e")), path, ["k"])
            monkeypatch.setattr(upsert, "_claim", contested)
        return claim(*given)

    monkeypatch.setattr(upsert, "_claim", contested)
    upsert.upsert(frame(spark, (2, "second"), (6, "f")), path, ["k"])
    assert tries == [2, 3]
    assert rows(spark, path) == [(1, "a"), (2, "second"), (3, "c"), (5, "e"), (6, "f")]
    assert sorted(map(tuple, upsert.read(spark, path, 2).collect())) == [(1, "a"), (2, "first"), (3, "c"), (5, "e")]


def test_writers_side_by_side(spark, path):
    failed = []

    def work(n):
        try:
            upsert.upsert(frame(spark, (10 + n, str(n)), (1, str(n))), path, ["k"])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    all_ = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    for t in all_:
        t.start()
    for t in all_:
        t.join()
    assert not failed and upsert.version(spark, path).number == 4
    got = rows(spark, path)
    assert len(got) == 6 and {k for k, _ in got} == {1, 2, 3, 10, 11, 12}


def test_equal_keys_of_a_batch_leave_one_row(spark, path):
    upsert.upsert(frame(spark, (2, "y"), (2, "x"), (2, "y"), (None, "n"), (None, "m")), path, ["k"], order="v")
    assert rows(spark, path) == [(1, "a"), (2, "y"), (3, "c"), (None, "n")]
    upsert.upsert(frame(spark, (None, "o")), path, ["k"])
    assert rows(spark, path)[-1] == (None, "o") and len(rows(spark, path)) == 4


def test_untouched_buckets_stay(spark, path):
    before = upsert.version(spark, path)
    upsert.upsert(frame(spark, (2, "x")), path, ["k"])
    after = upsert.version(spark, path)
    changed = {b for b in after.folders if before.folders.get(b) != after.folders[b]}
    assert len(changed) == 1 and len(after.folders) == len(before.folders)
    upsert.upsert(frame(spark), path, ["k"])
    assert upsert.version(spark, path).folders == after.folders


def test_odd_tables(spark, tmp_path, path):
    at = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        upsert.read(spark, at)
    assert upsert.current(spark, at) is None
    upsert.upsert(frame(spark), at, ["k"])
    assert rows(spark, at) == [] and spark.read.parquet(upsert.current(spark, at)).columns == ["k", "v"]
    upsert.upsert(frame(spark, (1, "a")), at, ["k"])
    assert rows(spark, at) == [(1, "a")]
    with pytest.raises(ValueError):
        upsert.upsert(spark.createDataFrame([(1, 2)], "k long, other long"), at, ["k"])
    odd = spark.createDataFrame([(1, "x", {"a": 1}), (1, "x", {"a": 1})], "`a.b` long, `Bucket` string, m map<string,int>")
    upsert.upsert(odd, str(tmp_path / "odd"), ["a.b"])
    upsert.upsert(odd, str(tmp_path / "odd"), ["a.b"])
    assert upsert.read(spark, str(tmp_path / "odd")).collect()[0].asDict() == {"a.b": 1, "Bucket": "x", "m": {"a": 1}}


def test_vacuum_keeps_what_versions_name(spark, path):
    for n in range(3):
        upsert.upsert(frame(spark, (2, str(n))), path, ["k"])
    want = rows(spark, path)
    assert upsert.vacuum(spark, path, keep=1) == 3
    assert rows(spark, path) == want and upsert.version(spark, path, 1) is None


def test_elsewhere_a_rename_that_may_not_overwrite_claims(spark, path, monkeypatch):
    class Other:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(self.system, name)

    hadoop = upsert._hadoop
    monkeypatch.setattr(upsert, "_hadoop", lambda spark, p: (Other(hadoop(spark, p)[0]), hadoop(spark, p)[1]))
    assert not upsert._claim(spark, f"file://{path}", 1, "{}")
    upsert.upsert(frame(spark, (2, "x")), f"file://{path}", ["k"])
    assert rows(spark, path) == [(1, "a"), (2, "x"), (3, "c")] and upsert.version(spark, path).number == 2
