import pytest
import random

from lexoria.operators.changes import apply_changes, live

SCHEMA = "user_id long, word string, updated_at timestamp, seq long, deleted int, note string, _nth int, state string"


def brute(rows):
    best = {}
    for u, w, t, s, d, note, *_ in rows:
        if u is None or w is None or t is None:
            continue
        rank = (-t.timestamp(), s if s is not None else 1 << 63, -(d or 0))
        if (u, w) not in best or rank < best[u, w][0]:
            best[u, w] = (rank, s, d)
    return {(u, w, s, d) for (u, w), (_, s, d) in best.items()}


def feed(n, seed, users=5, hot=0.0):
    import datetime as dt

    r = random.Random(seed)
    rows = []
    for i in range(n):
        u = 1 if r.random() < hot else r.randrange(users)
        w = r.choice(["a", "A", "ă", "a ", "", None, "z" * 3000])
        t = r.choice([None, *(dt.datetime(2024, 1, 1, 0, 0, k) for k in range(4))])
        rows.append((u if r.random() > 0.02 else None, w, t, r.choice([None, i, i // 2]), r.choice([0, 1, None]), "n", 1, "x"))
    return rows + r.sample(rows, n // 3)


def test_against_brute_force_in_any_order(spark):
    for seed in range(3):
        rows = feed(300, seed, hot=0.4)
        # rows of one key, clock and seq must agree on what they say: make them
        said = {}
        rows = [(*x[:4], said.setdefault((x[0], x[1], x[2], x[3]), x[4]), *x[5:]) for x in rows]
        random.Random(seed).shuffle(rows)
        got = apply_changes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        assert {(x.user_id, x.word, x.seq, x.deleted) for x in got} == brute(rows)
        assert len(got) == len({(x.user_id, x.word) for x in got})


def test_state_keeps_tombstones_and_takes_late_changes(spark):
    import datetime as dt

    t = lambda k: dt.datetime(2024, 1, 1, 0, 0, k)
    first = apply_changes(spark.createDataFrame([(1, "a", t(2), 5, 1, None, 0, ""), (1, "b", t(1), 6, 0, None, 0, "")], SCHEMA))
    late = spark.createDataFrame([(1, "a", t(1), 4, 0, None, 0, ""), (1, "b", t(1), 2, 1, None, 0, "")], SCHEMA)
    both = apply_changes(late, base=first)
    assert {(x.word, x.seq, x.deleted) for x in both.collect()} == {("a", 5, 1), ("b", 2, 1)}
    assert live(both).count() == 0


def test_payload_prefers_the_delivery_with_the_note(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", t, 1, 0, None, 0, ""), (1, "a", t, 1, 0, "kept", 0, "")]
    assert [x.note for x in apply_changes(spark.createDataFrame(rows, SCHEMA), payload=["note"]).collect()] == ["kept"]


def test_empty_feed(spark):
    assert apply_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_local_state_is_handed_on_in_portions(spark, monkeypatch):
    from lexoria.operators import changes

    rows = [(i % 7, f"w{i % 50}", i, i, i % 3 % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, word string, updated_at long, seq long, deleted int").repartition(3)
    want = sorted(map(tuple, changes.apply_changes(df).collect()))
    monkeypatch.setattr(changes, "LOCAL_BYTES", 100)
    monkeypatch.setattr(changes, "BYTES_PER_BUCKET", 5_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        assert changes._buckets(df) > 4
        assert sorted(map(tuple, changes.apply_changes(df).collect())) == want and len(want) == 350
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from lexoria.plans import runtime

    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, _lexoria_shipped=True)
    with pytest.raises(ValueError):
        runtime.shared_dir(SimpleNamespace(conf=conf, sparkContext=sc))
