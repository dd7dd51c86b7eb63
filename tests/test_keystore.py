"""The store of keys: filters, buckets, exactness."""

from veriscope.sources import keystore
from veriscope.sources.keystore import KeyStore


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_stored_keys_and_filters(spark, tmp_path):
    store = KeyStore.create(spark, str(tmp_path / "s"), expected=9_000, buckets=4)
    assert store.stored(keys(spark, ["a", None])).count() == 0
    store.add(keys(spark, [f"u{i}" for i in range(3000)] + [None, "u1"]))
    store.add(keys(spark, [f"v{i}" for i in range(50)]))
    store = KeyStore.open(spark, str(tmp_path / "s"))
    want = keys(spark, [f"u{i}" for i in range(0, 6000, 7)] + ["v3", "v3", "w", "", None])
    got = {r["key"] for r in store.stored(want).collect()}
    assert got == {f"u{i}" for i in range(0, 3000, 7)} | {"v3"}
    may = store.maybe(keys(spark, [f"x{i}" for i in range(2000)])).count()
    assert may < 60  # few keys pass in vain
    before = sorted((r["slot"], bytes(r["bits"])) for r in store.filters().collect())
    store.merge_filters()
    assert sorted((r["slot"], bytes(r["bits"])) for r in store.filters().collect()) == before and len(before) == 3


def test_filter_far_too_small(spark, tmp_path, monkeypatch):
    store = KeyStore.create(spark, str(tmp_path / "s"), expected=1, buckets=4)
    store.add(keys(spark, [f"u{i}" for i in range(60_000)]))
    new = keys(spark, [f"x{i}" for i in range(1500)] + ["u5", "u59999"])
    assert store.maybe(new).count() > 1400  # one slot of 32,768 bits holds nothing back
    assert {r["key"] for r in store.stored(new).collect()} == {"u5", "u59999"}


def test_store_is_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keystore, "NAMED_KEYS", 10)
    store = KeyStore.create(spark, str(tmp_path / "s"), buckets=6)
    store.add(keys(spark, [f"u{i}" for i in range(5000)]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = store.stored(keys(spark, [f"u{i}" for i in range(0, 9000, 3)]))
        assert many.count() == 1667
        plan = many._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        scan = next(i for i, line in enumerate(plan.splitlines()) if "Bucketed: true" in line)
        between = plan.splitlines()[:scan]
        join = max(i for i, line in enumerate(between) if "SortMergeJoin" in line)
        assert not any("Exchange" in line for line in between[join:]) and "BroadcastExchange" not in plan
        few = store.stored(keys(spark, ["u1", "x"]))
        assert few.count() == 1 and "SelectedBucketsCount: 1 out of 6" in few._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
