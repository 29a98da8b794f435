import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import functions as C
from tidemark import plans
from tidemark.operators import apply as A
from tidemark.operators import checks, graph, progress, states
from tidemark.streaming import apply_stream, deduplicated, latest_snapshot

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["apl14_latest_syncpoints", "agg3_recovery_horizon", "flt4_receiver_dedup", "apl1_apl2_apl3_apply", "apl2_apl3_conflicts", "jn6_apl15_as_of", "apl11_referee_grant", "win7_syncpoint_emission", "gr3_clique_test", "gr4_gr5_maximum_clique", "agg8_vote_tally", "apl22_dml_flag", "jn8_anti", "prj3_row_value_in", "win6_str6_barriers", "agg10_agg11_decision", "sf8_xstate", "apl18_difference", "flt13_node_status", "gr7_generation_switch", "str2_receiver_mode", "apl7_failure_action", "udf5_statement_as_text", "h25_prepared", "h26_session", "h26_sliding", "h27_udtf"])
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert rows(df) == sorted(map(tuple, want), key=repr)


def test_referee_golden(spark):
    asked = [("winner", 1, 1, 7), ("winner", 2, 1, 9), ("winner", 3, 2, 4), ("winner", 4, 2, 10), ("winner", 5, None, None), ("winner", 6, 2, 11)]
    got = A.grant(spark.createDataFrame(asked, "key string, seq long, node_id int, gen_num long")).orderBy("seq").collect()
    assert [r.granted for r in got] == [True, True, False, False, False, True]
    assert [(r.holder, r.holder_gen) for r in got] == [(1, 7), (1, 9), (1, 9), (1, 9), (None, None), (2, 11)]


def test_sequence_golden(spark):
    got = spark.range(1, 4).select(C.sequence_restart(F.lit(100), F.col("id"), F.lit(3)).alias("v")).collect()
    assert sorted(r.v for r in got) == [100, 104, 105]


def test_sparse_id_golden(spark):
    assert C.free_id(spark.createDataFrame([(2,), (4,), (5,)], "id int")).first().id == 1


def test_null_is_equal_and_counts_matter(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(checks.difference(a, b)) == [("2", "x", 2, 1)]
    assert checks.check_query(lambda n: a, ["1", "2"])
    assert not checks.check_query(lambda n: a if n == "1" else b, ["1", "2"])
    with pytest.raises(ValueError):
        checks.check_query(lambda n: a, ["1"])


def brute(base, log):
    state, conflicts = dict(base), []
    for lsn, op, key, value, changed in sorted(log):
        if op == "0":
            state, conflicts = {}, []
        elif op == "I":
            if key in state:
                conflicts.append(lsn)
            state[key] = value
        elif op == "U":
            if key not in state:
                conflicts.append(lsn)
            elif changed:
                state[key] = value
        elif state.pop(key, "gone") == "gone":
            conflicts.append(lsn)
    return state, conflicts


@pytest.mark.parametrize("seed", range(4))
def test_apply_equals_one_by_one(spark, seed):
    r = random.Random(seed)
    base = [(k, float(k)) for k in range(6)]
    here, log = {k for k, _ in base}, []
    for lsn in range(1, 60):  # no conflicts, so the order of failures does not matter
        k = r.randrange(10)
        op = r.choice("UD") if k in here else "I"
        here = here | {k} if op == "I" else here - {k} if op == "D" else here
        log.append((lsn, op, k, None if r.random() < 0.2 else float(lsn), r.random() < 0.7))
    if seed == 3:
        log.append((60, "0", None, None, None))
        log.append((61, "I", 3, 1.5, True))
    got, conflicts = A.apply_changes(spark.createDataFrame(base, "key int, value double"), spark.createDataFrame(log, "lsn long, op string, key int, value double, changed boolean"))
    want, bad = brute(base, log)
    assert rows(got) == sorted(want.items(), key=repr)
    assert conflicts.count() == len(bad) == 0


@pytest.mark.parametrize("seed", range(3))
def test_conflicts_equal_one_by_one(spark, seed):
    r = random.Random(seed)
    base = [(k, float(k)) for k in range(4)]
    log = [(lsn, r.choice("IUUD"), r.randrange(8), float(lsn), True) for lsn in range(1, 80)]
    got, conflicts = A.apply_changes(spark.createDataFrame(base, "key int, value double"), spark.createDataFrame(log, "lsn long, op string, key int, value double, changed boolean"))
    want, bad = brute(base, log)
    assert rows(got) == sorted(want.items(), key=repr) and bad
    assert sorted(x.lsn for x in conflicts.collect()) == bad


def test_updates_and_deletes_of_a_missing_row_conflict_each_time(spark):
    log = [(1, "U", 7, 1.0, True), (2, "U", 7, 2.0, True), (3, "D", 7, None, None), (4, "I", 7, 4.0, True), (5, "D", 7, None, None), (6, "D", 7, None, None)]
    none = spark.createDataFrame([], "key int, value double")
    got, conflicts = A.apply_changes(none, spark.createDataFrame(log, "lsn long, op string, key int, value double, changed boolean"))
    assert got.count() == 0 and sorted(x.lsn for x in conflicts.collect()) == [1, 2, 3, 6]


def test_not_in_follows_sql(spark):
    from tidemark.operators import filters

    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = lambda *v: spark.createDataFrame([(i,) for i in v], "y int")
    got = lambda *v: rows(filters.not_in(left, "x", right(*v), "y"))
    assert got(2) == [(1,)] and got(2, None) == [] and got() == sorted([(1,), (2,), (None,)], key=repr)


def test_election_needs_every_member_polled(spark):
    from tidemark.operators import consensus

    own = spark.createDataFrame([(5, 1, 7, 3), (6, 1, 7, 3), (7, 1, 7, 1), (8, 1, 7, 3)], "gen_num long, me int, members long, last_online_in long")
    replies = spark.createDataFrame([(5, 2, True, 3), (5, 3, False, 9), (6, 2, True, 4), (7, 2, False, 9), (7, 3, False, 9), (9, 2, True, 1)], "gen_num long, voter int, vote_ok boolean, last_online_in long")
    # quorum and all polled; one member silent; all refused; nobody answered
    assert rows(consensus.tally(replies, own, 3)) == sorted([(5, 2, 3, 3, True), (6, 2, 4, 2, False), (7, 1, 1, 1, False), (8, 1, 3, 1, False)], key=repr)


def test_cleanup_drops_points_of_gone_origins(spark):
    points = spark.createDataFrame([(1, 2, 10, 1), (1, 2, 90, 1), (1, 4, 90, 1), (2, 4, 90, 1), (1, 3, 5, 1)], "receiver int, origin int, origin_lsn long, receiver_lsn long")
    bounds = spark.createDataFrame([(2, 50, 40), (3, 50, None)], "origin int, kept_ep long, kept_ap long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert rows(progress.cleanup(points, bounds, nodes, 1)) == sorted([(1, 2, 90, 1), (2, 4, 90, 1), (1, 3, 5, 1)], key=repr)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_segments_on_two_levels(spark, width):
    from tidemark.operators import filters

    r = random.Random(width)
    log = [(r.choice(["a", "b", None]), at, r.random() < 0.3) for at in range(-40, 60)]
    got = filters.segments(spark.createDataFrame(log, "o string, lsn long, stop boolean"), "o", "lsn", F.col("stop"), width)
    want = [(o, at, stop, sum(s for k, p, s in log if k == o and p <= at)) for o, at, stop in log]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_as_of_on_two_levels(spark, width):
    r = random.Random(width)
    left = [(r.choice(["a", "b", None]), r.randrange(-50, 200)) for _ in range(200)]
    right = [(r.choice(["a", None]), r.randrange(-50, 200), r.randrange(1000)) for _ in range(60)]
    got = progress.as_of(spark.createDataFrame(left, "k string, at long"), spark.createDataFrame(right, "k string, pos long, v int"), ["k"], "at", "pos", ["v"], width)
    want = [(k, at, max(((p, v) for kk, p, v in right if kk == k and p <= at), default=(0, None))[1]) for k, at in left]
    assert rows(got) == sorted(want, key=repr)


def test_strict_apply_raises(spark):
    base = spark.createDataFrame([(1, 1.0)], "key int, value double")
    log = spark.createDataFrame([(1, "D", 2, None, None)], "lsn long, op string, key int, value double, changed boolean")
    with pytest.raises(A.Conflict):
        A.apply_changes(base, log, "strict")


def test_keyless_multiplicity(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "v int")
    assert rows(A.apply_keyless(t(1, 1, None), t(2, None), t(1, None))) == [(1,), (2,), (None,)]


def test_as_of_without_match_is_null(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, t int, v string")
    assert rows(progress.as_of(left, right, ["k"], "t", "t", ["v"])) == sorted([(1, 5, "b"), (1, 1, None), (2, 9, None)], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_clique_equals_brute_force(spark, seed):
    r = random.Random(seed)
    n = 6
    e = [(a, b) for a, b in itertools.permutations(range(1, n + 1), 2) if r.random() < 0.75]
    got = graph.maximum_clique(spark.createDataFrame(e, "a int, b int"), spark.range(1, n + 1).select(F.col("id").cast("int").alias("id"))).first()
    best = max((len(s), -sum(1 << v - 1 for v in s)) for k in range(1, n + 1) for s in itertools.combinations(range(1, n + 1), k) if all((a, b) in e for a, b in itertools.permutations(s, 2)))
    assert (got.size, -got.mask) == best


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(0,), (1 << 40,), (123456789012,)], "n long")
    assert all(r.n == r.m for r in df.select("n", C.lsn_number(C.lsn_text(F.col("n"))).cast("long").alias("m")).collect())
    r = spark.range(1).select(C.mask_text(F.lit(5)).alias("t"), C.mask_nodes(F.lit(5)).alias("n"), C.gid_part(F.lit("no"), 1).alias("g")).first()
    assert (r.t, r.n, r.g) == ("101", [1, 3], None)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    log = [(i, 1, "I" if i <= 5 else "U", i % 5, float(i), i % 3 > 0) for i in range(1, 21)]
    schema = "lsn long, origin int, op string, key int, value double, changed boolean"
    for part in (log[:10], log[10:] + log[12:14]):  # the last two are delivered twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = apply_stream(stream, str(tmp_path / "snap"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = A.apply_changes(spark.createDataFrame([], "key int, value double"), spark.createDataFrame(log, schema))[0]
    assert rows(latest_snapshot(spark, str(tmp_path / "snap"))) == rows(want)


def test_delivered_again_in_a_later_batch_changes_nothing(spark, tmp_path):
    """A delete and the insert before it come again; the row stays deleted, without conflicts."""
    schema = "lsn long, origin int, op string, key int, value double, changed boolean"
    log = [(1, 1, "I", 1, 1.0, True), (2, 1, "I", 2, 2.0, True), (3, 1, "D", 1, None, False)]
    for part in (log, log[:1] + [(4, 1, "U", 2, 9.0, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    apply_stream(stream, str(tmp_path / "snap"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(latest_snapshot(spark, str(tmp_path / "snap"))) == [(2, 9.0)]
    assert rows(latest_snapshot(spark, str(tmp_path / "snap"), part="positions")) == [(1, 4)]
    assert spark.read.parquet(str(tmp_path / "snap" / "conflicts")).count() == 0


def test_dedup_state_is_dropped_behind_the_watermark(spark, tmp_path):
    schema = "origin int, lsn long, ts timestamp"
    for k, part in enumerate(([(1, 1, 0), (1, 1, 1)], [(1, 2, 7200)], [(1, 3, 7300), (1, 2, 7200)])):
        df = spark.createDataFrame(part, "origin int, lsn long, s long").selectExpr("origin", "lsn", "timestamp_seconds(s) AS ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "1 hour")
    q = stream.writeStream.format("memory").queryName("deduplicated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert rows(spark.table("deduplicated").select("origin", "lsn")) == [(1, 1), (1, 2), (1, 3)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_generation_rules(spark):
    """me, seen, gen, members, configured, donors, last vote: what a member becomes."""
    cases = [
        ((1, 5, 5, 7, 7, 1, 5), "same"), ((3, 1, 2, 3, 7, 1, 2), "dead"), ((1, 1, 2, 1, 7, 1, 2), "dead"), ((1, 1, 2, 1, 3, 1, 2), "online"),
        ((1, 1, 2, 3, 7, 1, 3), "dead"), ((1, 1, 2, 3, 7, 1, 1), "online"), ((2, 1, 2, 3, 7, 1, 2), "recovery"),
    ]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "me long, seen long, gen long, members long, configured long, donors long, vote long, want string")
    got = df.select("want", states.switched(*[F.col(c) for c in df.columns[:-1]]).alias("got"))
    assert got.where("want <> got").count() == 0


def whole(spark, duck, name):
    """A query over all events equals its SQL; its rows."""
    df = plans.queries()[name](spark, SF)
    got = rows(df)
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(tuple, want), key=repr)
    return got


def test_emission_covers_every_change(spark, duck):
    assert len(whole(spark, duck, "win7_syncpoint_emission")) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]


@pytest.mark.parametrize("step", [1, 3, 40])
def test_emission_equals_brute_force(spark, step):
    rnd = random.Random(step)
    log = [("dense", p) for p in range(-90, 900 * step // 2, 1 + step // 7)] + [("far", 10**6 * i + i % 3) for i in range(9)] + [("few", 1), ("gone", None)]
    log += [(None, rnd.randrange(5000)) for _ in range(700)] + [("hot", 77)] * 50 + [("hot", rnd.randrange(400 * step)) for _ in range(300)]
    want = []
    for by in {b for b, _ in log}:
        last = 0
        for at in sorted(p for b, p in log if b == by and p is not None):
            want.append((by, at, at - last >= step))
            last = at if at - last >= step else last
    rnd.shuffle(log)
    got = progress.emit_every(spark.createDataFrame(log, "origin string, lsn long"), "origin", "lsn", step)
    assert got.columns == ["origin", "at", "emit"] and rows(got) == sorted(want, key=repr)


def test_grant_decides_every_request(spark, duck):
    assert len(whole(spark, duck, "apl11_referee_grant")) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_grant_equals_brute_force(spark):
    rnd = random.Random(7)
    asked = [(rnd.choice(["a", "b", None]), rnd.randrange(150), rnd.choice([1, 1, 2, 3, None]), rnd.choice([None, *range(9)])) for _ in range(400)]
    first = lambda x: (x is not None, x or 0)
    want, held = [], {}
    for key, seq, node, gen in sorted(asked, key=lambda r: (r[1], first(r[2]), first(r[3]))):
        now = held.get(key)
        ok = node is not None and (now is None or (now[0] == node and None not in (gen, now[1]) and gen > now[1]))
        held[key] = None if node is None else (node, gen) if ok else now
        want.append((key, seq, ok, *(held[key] or (None, None))))
    got = A.grant(spark.createDataFrame(asked, "key string, seq long, node_id int, gen_num long"))
    assert got.columns == ["key", "seq", "granted", "holder", "holder_gen"] and rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["apl14_latest_syncpoints", "jn1_jn2_left_theta_pairs", "agg3_recovery_horizon", "agg4_oldest_syncpoint", "srt3_multi_key", "apl8_apl9_insert_absent", "apl13_syncpoint_cleanup", "str9_retention"])
def test_points_of_every_event(spark, duck, name):
    whole(spark, duck, name)


def test_as_of_translates_every_change(spark, duck):
    assert len(whole(spark, duck, "jn6_apl15_as_of")) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
