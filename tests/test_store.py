"""The keyed store: changes by bucket, manifests, files that are unfit; estimates as a stream against a table."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from fundlattice.sources.store import Conflict, KeyedStore
from fundlattice.streaming import estimates

FUND = "code string, name string, units double"


def rows(df):
    return {r["code"]: (r["name"], r["units"]) for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/funds", FUND, buckets=5)


def test_changes_by_key(spark, store):
    assert store.read().count() == 0
    store.upsert(spark.createDataFrame([(f"{k:06d}", "a", float(k)) for k in range(40)], FUND))
    store.upsert(spark.createDataFrame([("000003", "b", 1.0, 2), ("000003", "c", 2.0, 1), ("900000", "new", None, 1)], FUND + ", ord int"), order="ord")
    found = rows(store.read())
    assert len(found) == 41 and found["000003"] == ("b", 1.0) and found["900000"] == ("new", None) and found["000004"] == ("a", 4.0)
    absent = store.delete(spark.createDataFrame([("000003",), ("777777",), (None,), ("777777",)], "code string"))
    assert [r["code"] for r in absent.collect()] == ["777777"]
    assert "000003" not in rows(store.read()) and len(rows(store.read(2))) == 41  # the table as it was
    assert rows(store.lookup(spark.createDataFrame([("000005",), ("1",)], "code string"))) == {"000005": ("a", 5.0)}
    assert store.vacuum() >= 1 and len(rows(store.read())) == 40
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(None, "x", 1.0)], FUND))


def test_only_buckets_that_are_hit_are_written(spark, store):
    store.upsert(spark.createDataFrame([(f"{k:06d}", "a", 1.0) for k in range(100)], FUND))
    _, before = store.manifest()
    store.upsert(spark.createDataFrame([("000007", "b", 1.0)], FUND))
    _, after = store.manifest()
    assert len(before) == 5 and sum(before[b] != after[b] for b in before) == 1


def test_a_writer_that_dies_changes_nothing(spark, store, monkeypatch):
    store.upsert(spark.createDataFrame([("000001", "a", 1.0)], FUND))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame([("000001", "b", 2.0)], FUND))
    assert rows(store.read()) == {"000001": ("a", 1.0)} and store.vacuum() == 1
    store.upsert(spark.createDataFrame([("000001", "c", 3.0)], FUND))
    assert rows(store.read()) == {"000001": ("c", 3.0)}


def test_of_two_writers_one_wins(spark, store):
    store.upsert(spark.createDataFrame([("000001", "a", 1.0)], FUND))
    number, folders = store.manifest()
    store._commit(number + 1, folders)
    with pytest.raises(Conflict):
        store._commit(number + 1, {})
    assert rows(store.read()) == {"000001": ("a", 1.0)}


def test_unfit_files_and_items_are_set_aside(spark, store, tmp_path):
    assert store.load_json(f"file://{tmp_path}/missing").count() == 0
    folder = tmp_path / "in"
    folder.mkdir()
    good = [{"code": "000001", "name": "x", "units": 1}, {"code": "000001", "name": "y", "units": 2}, {"code": "abc"}, "text", {"name": "no code"}, {"code": " 12345 "}]
    (folder / "a.json").write_text(json.dumps({"funds": good}))
    (folder / "b.json").write_text('{"funds": [{"code"')
    (folder / "c.json").write_text('{"other": 1}')
    unfit = store.load_json(f"file://{folder}").collect()
    assert rows(store.read()) == {"000001": ("y", 2.0), "12345": (None, None)}
    assert sorted(r["source"].rsplit("/", 1)[1] for r in unfit) == ["a.json"] * 3 + ["b.json", "c.json"]
    assert any('{"funds": [{"code"' in r["record"] for r in unfit)


def readings(seed=1):
    """Late, repeated and unordered readings of five codes, over three weeks."""
    r, out = random.Random(seed), []
    for k in range(5):
        for day in range(1, 22):
            if r.random() < 0.7:
                out.append((f"c{k}", datetime.datetime(2024, 3, day, r.randint(9, 14), r.randint(0, 59)), "estimate", r.random()))
            if r.random() < 0.4 and day < 18 + k % 3:
                out.append((f"c{k}", datetime.datetime(2024, 3, day, 20), "official", r.random()))
    out += [("c1", datetime.datetime(2024, 3, 21, 8), "official", 5.0), (None, datetime.datetime(2024, 3, 1), "estimate", 1.0), ("c2", None, "estimate", 1.0), ("c2", datetime.datetime(2024, 3, 2), "other", 1.0), ("c3", datetime.datetime(2024, 3, 2), "official", None)]
    out += r.sample(out, 10)
    r.shuffle(out)
    return out


def run(spark, folder, place, seen, late="60 days", stands=60 * 86_400_000):
    stream = spark.readStream.schema(estimates.READINGS).option("maxFilesPerTrigger", 1).json(str(folder))
    keep = lambda df, n: seen.update({r["code"]: tuple(r) for r in df.collect()})
    query = estimates.follow(stream, late, stands).writeStream.outputMode("update").option("checkpointLocation", f"file://{place}").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def put(folder, name, part):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"code": c, "at": t.isoformat() if t else None, "kind": k, "value": v}) for c, t, k, v in part))


def test_the_stream_ends_where_the_table_does(spark, tmp_path):
    """Also if it is stopped and goes on from its checkpoint."""
    data, seen = readings(), {}
    half = len(data) // 2
    put(tmp_path / "in", "1.json", data[: half // 2])
    put(tmp_path / "in", "2.json", data[half // 2 : half])
    run(spark, tmp_path / "in", tmp_path / "state", seen)
    put(tmp_path / "in", "3.json", data[half:])
    run(spark, tmp_path / "in", tmp_path / "state", seen)
    want = {r["code"]: tuple(r) for r in estimates.current_values(spark.createDataFrame(data, estimates.READINGS)).collect()}
    assert seen == want and {v[2] for v in want.values()} == {"estimate", "official"}


def test_an_old_estimate_goes_by_its_timer(spark, tmp_path):
    day, seen = lambda d: datetime.datetime(2024, 3, d, 12), {}
    put(tmp_path / "in", "1.json", [("a", day(1), "official", 1.0), ("a", day(2), "estimate", 2.0), ("b", day(3), "estimate", 3.0)])
    run(spark, tmp_path / "in", tmp_path / "state", seen, "1 day", 5 * 86_400_000)
    assert seen["a"][2:] == ("estimate", 2.0)
    put(tmp_path / "in", "2.json", [("b", day(20), "estimate", 4.0)])
    run(spark, tmp_path / "in", tmp_path / "state", seen, "1 day", 5 * 86_400_000)
    assert seen["a"][2:] == ("official", 1.0) and seen["b"][2:] == ("estimate", 4.0)
