import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import iso_day, key_of
from ledgerloom.operators.asknown import as_known_join
from ledgerloom.operators.orphans import existence, orphan_references

D0 = dt.date(2024, 1, 1)
VERSIONS = "k string, ord int, cents long, a date, b date, known date, v int"


def join(events, versions):
    return as_known_join(events, versions, {"k": "k"}, iso_day(F.col("d")), ["id"], "a", "b", "known", "ord", ["ord", "cents"])


def day(rng, none=0.15):
    return None if rng.random() < none else D0 + dt.timedelta(rng.randrange(400))


def test_as_known_join_equals_brute_force(spark):
    rng = random.Random(1)
    versions = [(rng.choice(["x", "y", None]), i, rng.randrange(1000), day(rng), day(rng), day(rng, 0.05), 1) for i in range(60)]
    events = [(i, rng.choice(["x", "y", "z", None]), None if rng.random() < 0.05 else (D0 + dt.timedelta(rng.randrange(-60, 600))).isoformat()) for i in range(800)]
    want = {}
    for i, k, d in events:
        if k is None or d is None:
            continue
        t = dt.date.fromisoformat(d)
        ok = [v for v in versions if v[0] == k and v[5] and v[5] <= t and (v[3] is None or v[3] <= t) and (v[4] is None or v[4] >= t)]
        if ok:
            best = max(ok, key=lambda v: (v[5], v[1]))
            want[i] = (best[1], best[2])
    got = join(spark.createDataFrame(events, "id long, k string, d string"), spark.createDataFrame(versions, VERSIONS)).collect()
    assert {r.id: (r.ord, r.cents) for r in got} == want and len(got) == len(want) > 200


def test_as_known_join_of_odd_rows(spark):
    e = spark.createDataFrame([(1, "x", "2024-13-01", 0), (2, "x", "2024-6-8", 0), (2, "x", "2024-6-8", 0), (3, "x", " 2024-06-08", 0), (4, "x", "2025-02-30", 0), (None, "x", "2024-06-08", 0)], "id long, k string, d string, __period int")
    v = spark.createDataFrame([("x", 0, 5, None, None, D0, 1), ("x", 1, 6, None, None, D0, 1)], VERSIONS)
    assert sorted((r.id or 0, r.ord) for r in join(e, v).collect()) == [(0, 1), (2, 1), (2, 1)]
    assert join(e, v.limit(0)).count() == 0 and join(e.limit(0), v).count() == 0


def test_iso_day(spark):
    texts = ["2024-6-8", "2024-06-08", "2024", "2025-02-30", "20240608", " 2024-06-08", "0000-00-00", "2024-06-08x", None, "2024-02-29", "24-06-08"]
    got = [str(r.d) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(iso_day(F.col("t")).alias("d")).collect()]
    assert got == ["2024-06-08", "2024-06-08", *["None"] * 7, "2024-02-29", "None"]


T0 = dt.datetime(2024, 1, 1)


def moment(rng, none=0.0):
    return None if rng.random() < none else T0 + dt.timedelta(hours=rng.randrange(200))


def test_orphans_equal_brute_force(spark):
    rng = random.Random(2)
    parents = [(rng.choice(["A", "b ", " c", None, "D", "E"]), moment(rng), moment(rng, 0.4)) for _ in range(40)]
    children = [(i % 250 if i % 17 else None, rng.choice(["a", "B", "C", "d", "zz", " ", None]), moment(rng)) for i in range(400)]
    low, high = dt.datetime.min, dt.datetime.max
    norm = lambda s: (s or "").strip().upper() or None
    recs = {}
    for k, ref, t in children:
        if norm(ref):
            recs[(k, norm(ref))] = min(recs.get((k, norm(ref)), high), t)
    want = set()
    for (k, ref), t in recs.items():
        rows = [(a or low, d or high) for p, a, d in parents if norm(p) == ref]
        if any(a <= t < d for a, d in rows):
            continue
        want.add((k, ref, "missing" if not rows else "deleted" if any(a <= t for a, _ in rows) else "late", t))
    c = spark.createDataFrame(children, "k long, ref string, loaded_at timestamp_ntz").withColumn("key", F.lit(1)).withColumn("t", F.lit(2))
    p = spark.createDataFrame(parents, "p string, loaded_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("start", F.lit(3))
    got = orphan_references(c, p, F.col("k"), key_of(F.col("ref")), key_of(F.col("p"))).collect()
    assert {(r.src_key and int(r.src_key), r.ref_key, r.orphan_kind, r.loaded) if r.src_key else (None, r.ref_key, r.orphan_kind, r.loaded) for r in got} == {(k, *x) for k, *x in want}
    assert len(got) == len(want) and {x[2] for x in want} == {"missing", "deleted", "late"}
    assert orphan_references(c.limit(0), p, F.col("k"), key_of(F.col("ref")), key_of(F.col("p"))).count() == 0
    none = orphan_references(c, p.limit(0), F.col("k"), key_of(F.col("ref")), key_of(F.col("p"))).collect()
    assert {r.orphan_kind for r in none} == {"missing"} and len(none) == len(recs)


def test_existence_is_disjoint(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), moment(rng), moment(rng, 0.02)) for _ in range(300)]
    got = existence(spark.createDataFrame(rows, "k string, l timestamp_ntz, d timestamp_ntz"), F.col("k"), "l", "d").collect()
    for k in "ab":
        spans = sorted((r.start, r.end) for r in got if r.key == k)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        for h in range(0, 220, 3):
            t = T0 + dt.timedelta(hours=h, minutes=1)
            alive = any(a <= t and (d is None or d > t) for x, a, d in rows if x == k)
            assert alive == any(a <= t < b for a, b in spans)
