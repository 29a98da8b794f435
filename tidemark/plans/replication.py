"""Queries of the change-stream operators over inputs derived, by integer arithmetic,
from the relational tables; each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as C
from ..operators import apply as A
from ..operators import checks, consensus, filters, graph, progress, states
from ..sources import broadcast_table, decode_row, encode_row, event_changes, message_kind, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The derived inputs, as SQL.
_CH = """changes AS (SELECT event_id + 1 AS lsn, event_id // 4 AS gid, user_id % 3 + 1 AS origin,
    CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op, user_id AS key, value,
    event_type <> 'view' AS changed, event_type AS rel_name FROM events)"""
_NODES = "nodes AS (SELECT (n_nationkey + 1)::INT AS id FROM nation WHERE n_nationkey < 3)"
_PTS = """points AS (SELECT r.id AS receiver, (e.user_id % 3 + 1)::INT AS origin, e.event_id + 1 AS origin_lsn, (e.event_id + 1) * 10 + r.id AS receiver_lsn
    FROM events e JOIN nodes r ON r.id <> e.user_id % 3 + 1)"""
_VOTES = """votes AS (SELECT e.event_id AS gid, n.id AS node_id, (e.event_id + n.id) % 7 <> 0 AS prepared, (e.event_id * n.id) % 5 < 3 AS precommitted,
    1 + (e.event_id + n.id) % 2 AS ballot, (e.event_id * n.id) % 3 AS acc_ballot, n.id AS acc_node,
    CASE WHEN (e.event_id + n.id) % 4 < 2 THEN 'precommitted' ELSE 'preaborted' END AS status FROM events e CROSS JOIN nodes n)"""
_EDGES = """nodes AS (SELECT (n_nationkey + 1)::INT AS id FROM nation WHERE n_nationkey < 8),
    edges AS (SELECT x.id AS a, y.id AS b FROM nodes x, nodes y WHERE x.id <> y.id AND (x.id * y.id) % 5 <> 0 AND (x.id + 2 * y.id) % 7 <> 0)"""


def _nodes(spark, d, n=3):
    return table(spark, d, "nation").where(f"n_nationkey < {n}").select((F.col("n_nationkey") + 1).alias("id"))


def _points(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3 + 1).cast("int").alias("origin"), (F.col("event_id") + 1).alias("origin_lsn"))
    return e.join(_nodes(spark, d).select(F.col("id").alias("receiver")), F.expr("receiver <> origin")).withColumn("receiver_lsn", F.col("origin_lsn") * 10 + F.col("receiver"))


def _votes(spark, d):
    e, n = table(spark, d, "events"), _nodes(spark, d)
    x = F.expr
    return e.crossJoin(F.broadcast(n)).select(F.col("event_id").alias("gid"), F.col("id").alias("node_id"), x("(event_id + id) % 7 <> 0").alias("prepared"), x("(event_id * id) % 5 < 3").alias("precommitted"), x("1 + (event_id + id) % 2").alias("ballot"), x("(event_id * id) % 3").alias("acc_ballot"), F.col("id").alias("acc_node"), x("case when (event_id + id) % 4 < 2 then 'precommitted' else 'preaborted' end").alias("status"))


def _edges(spark, d):
    n = _nodes(spark, d, 8)
    return n.select(F.col("id").alias("a")).join(n.select(F.col("id").alias("b")), F.expr("a <> b and (a * b) % 5 <> 0 and (a + 2 * b) % 7 <> 0")), n


_FACTS = """facts AS (SELECT event_id AS id, event_id % 3 + 1 AS me, event_id % 5 AS seen, event_id % 7 + 1 AS gen, event_id % 8 AS members, CASE WHEN event_id % 11 < 4 THEN 3 ELSE 7 END AS configured,
    event_id % 8 & event_id // 8 % 8 AS donors, event_id // 3 % 8 AS last_vote, event_id // 5 % 8 AS last_online_in, event_id // 7 % 5 - 1 AS receive, event_id // 2 % 16 AS clique, event_id % 13 = 0 AS electing FROM events)"""


def _facts(spark, d):
    x = "event_id % 8 & event_id div 8 % 8 AS donors, event_id div 3 % 8 AS last_vote, event_id div 5 % 8 AS last_online_in, event_id div 7 % 5 - 1 AS receive, event_id div 2 % 16 AS clique, event_id % 13 = 0 AS electing"
    y = "event_id AS id, event_id % 3 + 1 AS me, event_id % 5 AS seen, event_id % 7 + 1 AS gen, event_id % 8 AS members, CASE WHEN event_id % 11 < 4 THEN 3L ELSE 7L END AS configured"
    return table(spark, d, "events").selectExpr(*y.split(", "), *x.split(", "))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- sources -----------------------------------------------------------------


@query("src2_decode_changes", f"WITH {_CH} SELECT lsn, gid, origin, op, key, value, changed, rel_name FROM changes WHERE rel_name NOT IN ('click')")
def _(spark, d):
    local = spark.createDataFrame([("click",)], "rel_name string")
    return filters.drop_local(event_changes(spark, d), local, ["rel_name"]).select("lsn", "gid", "origin", "op", "key", "value", "changed", "rel_name")


@query("src3_terminal_events", "SELECT event_id // 4 AS gid, max(event_id) + 1 AS lsn, CASE max(event_id) // 4 % 3 WHEN 0 THEN 'COMMIT_PREPARED' WHEN 1 THEN 'ABORT_PREPARED' ELSE 'PREPARE' END AS event FROM events GROUP BY event_id // 4")
def terminal(spark, d):
    c = event_changes(spark, d).groupBy("gid").agg(F.max("lsn").alias("lsn"))
    return c.withColumn("event", F.when(F.col("gid") % 3 == 0, "COMMIT_PREPARED").when(F.col("gid") % 3 == 1, "ABORT_PREPARED").otherwise("PREPARE"))


@query("src4_message_kinds", "SELECT event_id AS id, CASE substr('LDCVENTSX', (event_id % 9 + 1)::INT, 1) WHEN 'L' THEN 'local' WHEN 'D' THEN 'ddl_begin' WHEN 'C' THEN 'ddl_concurrent' WHEN 'V' THEN 'ddl_ordered' WHEN 'E' THEN 'ddl_end' WHEN 'N' THEN 'sequence' WHEN 'T' THEN 'table' WHEN 'S' THEN 'syncpoint' ELSE 'message' END AS kind FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), message_kind(F.expr("substr('LDCVENTSX', cast(event_id % 9 + 1 as int), 1)")).alias("kind"))


@query("src5_broadcast_table", "SELECT NULL::INT AS r_regionkey, NULL AS r_name, '0' AS op UNION ALL SELECT r_regionkey, r_name, 'I' FROM region")
def _(spark, d):
    return broadcast_table(table(spark, d, "region"))


@query("src6_caught_up", f"WITH {_CH} SELECT origin, max(lsn) AS last_lsn, max(lsn) >= (SELECT max(lsn) FROM changes) AS caught_up FROM changes GROUP BY origin")
def _(spark, d):
    c = event_changes(spark, d)
    end = c.agg(F.max("lsn").alias("end"))
    return c.groupBy("origin").agg(F.max("lsn").alias("last_lsn")).crossJoin(F.broadcast(end)).select("origin", "last_lsn", (F.col("last_lsn") >= F.col("end")).alias("caught_up"))


@query("src7_encode_row", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'u' WHEN o_orderpriority IS NULL THEN 'n' ELSE 't' END AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS cell FROM orders")
def _(spark, d):
    e = encode_row(table(spark, d, "orders"), ["o_orderpriority"], {"o_orderpriority": "o_orderkey % 7 = 0"})
    return e.select("o_orderkey", F.col("tuple")[0]["kind"].alias("kind"), F.col("tuple")[0]["text"].alias("cell"))


@query("src8_decode_row", "SELECT o_orderkey, o_orderkey % 7 <> 0 AS was_sent, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    e = encode_row(o, ["o_custkey"], {"o_custkey": "o_orderkey % 7 = 0"}).drop("o_custkey")
    g = decode_row(e, T.StructType([T.StructField("o_custkey", T.LongType())]))
    return g.select("o_orderkey", F.col("o_custkey").isNotNull().alias("was_sent"), F.col("o_custkey.v").alias("o_custkey"))


@query("src9_applied_set", f"WITH {_CH} SELECT DISTINCT origin, lsn FROM changes WHERE lsn > 500 AND origin IN (1, 2)")
def _(spark, d):
    return event_changes(spark, d).where("lsn > 500 and origin in (1, 2)").select("origin", "lsn").distinct()


@query("src10_logged_status", "WITH g AS (SELECT DISTINCT event_id // 3 AS gid FROM events), e AS (SELECT event_id // 4 AS gid, CASE event_id // 4 % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'aborted' END AS s FROM events GROUP BY ALL) SELECT g.gid, coalesce(e.s, 'notfound') AS status FROM g LEFT JOIN e ON g.gid = e.gid")
def _(spark, d):
    gids = table(spark, d, "events").select(F.expr("event_id div 3").alias("gid")).distinct()
    return consensus.logged_status(gids, terminal(spark, d))


@query("src13_series", "SELECT r AS id, r % 53 AS a, r % 59 AS b FROM range(1, 1001) t(r)")
def _(spark, d):
    return spark.range(1, 1001).select("id", (F.col("id") % 53).alias("a"), (F.col("id") % 59).alias("b"))


@query("snk4_feedback", f"WITH {_CH} SELECT origin, max(lsn) AS horizon FROM changes GROUP BY origin")
def _(spark, d):
    return event_changes(spark, d).groupBy("origin").agg(F.max("lsn").alias("horizon"))


# --- filters -----------------------------------------------------------------

ORACLES["flt1_local_tables"] = f"WITH {_CH} SELECT lsn, op, key FROM changes WHERE rel_name NOT IN ('view', 'signup')"


@query("flt1_local_tables", ORACLES["flt1_local_tables"])
def _(spark, d):
    local = spark.createDataFrame([("view",), ("signup",)], "rel_name string")
    return filters.drop_local(event_changes(spark, d), local, ["rel_name"]).select("lsn", "op", "key")


@query("flt2_origin", f"WITH {_CH} SELECT lsn, origin, op FROM changes WHERE origin = 2")
def _(spark, d):
    return filters.own_or_recovery(event_changes(spark, d), 2, False).select("lsn", "origin", "op")


@query("flt4_receiver_dedup", f"""WITH {_CH}, p AS (SELECT 1 AS origin, 200 AS pos, 5 AS l UNION ALL SELECT 2, 300, 7 UNION ALL SELECT 3, 0, 0)
    SELECT lsn, CASE WHEN p.l IS NULL THEN 'unknown_origin' WHEN p.l = 0 THEN 'no_position' WHEN c.origin = 2 THEN 'own' WHEN tx <= p.pos THEN 'before_syncpoint' WHEN tx % 5 = 0 THEN 'already_applied' END AS skip
    FROM (SELECT *, CASE WHEN origin = 1 THEN lsn + 1 ELSE lsn END AS tx FROM changes) c LEFT JOIN p USING (origin)""")
def _(spark, d):
    c = event_changes(spark, d).select("lsn", "origin", (F.col("lsn") + 1).alias("end_lsn"))
    p = spark.createDataFrame([(1, 200, 5), (2, 300, 7), (3, 0, 0)], "origin long, origin_lsn long, local_lsn long")
    done = c.select(F.col("origin").alias("node_id"), F.col("end_lsn").alias("origin_lsn")).where("origin_lsn % 5 = 0").unionByName(c.select(F.col("origin").alias("node_id"), F.col("lsn").alias("origin_lsn")).where("origin_lsn % 5 = 0"))
    return filters.skip_reason(c, p, done, 2, 1).select("lsn", "skip")


@query("flt5_no_aborts", "SELECT event_id // 4 AS gid FROM events GROUP BY 1 HAVING event_id // 4 % 3 <> 1")
def _(spark, d):
    return terminal(spark, d).where("event <> 'ABORT_PREPARED'").select("gid")


_DDL = "CASE event_id % 8 WHEN 1 THEN 'D' WHEN 4 THEN 'E' END"


@query("flt6_ddl_suppression", f"""SELECT lsn FROM (SELECT event_id AS lsn, {_DDL} AS prefix, last_value({_DDL} IGNORE NULLS) OVER (PARTITION BY event_id // 8 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS inside FROM events)
    WHERE prefix IS NOT NULL OR inside IS NULL OR inside <> 'D'""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.expr("event_id div 8").alias("gid"), F.expr(_DDL).alias("prefix"))
    return filters.suppress_ddl(e).select("lsn")


@query("flt7_relation_headers", f"WITH {_CH} SELECT lsn, coalesce(rel_name <> lag(rel_name) OVER (PARTITION BY gid ORDER BY lsn), true) AS header FROM changes")
def _(spark, d):
    return filters.relation_headers(event_changes(spark, d)).select("lsn", "header")


@query("flt8_first_precommits", f"WITH {_NODES}, {_VOTES} SELECT gid, node_id FROM votes WHERE ballot = 1 AND acc_ballot = 1 AND status = 'precommitted'")
def _(spark, d):
    v = _votes(spark, d)
    same = (C.term(F.col("ballot"), F.lit(0)) == C.term(F.lit(1).cast("long"), F.lit(0))) & (F.col("acc_ballot") == 1)
    return v.where(same & (F.col("status") == "precommitted")).select("gid", "node_id")


@query("flt9_epoch", "SELECT event_id AS id, CASE WHEN event_id % 5 > 2 THEN 'fatal' WHEN event_id % 5 < 2 AND event_id % 2 = 0 THEN 'refuse' ELSE 'apply' END AS action FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("gen"), F.when(F.col("event_id") % 2 == 0, "normal").otherwise("recovery").alias("mode"))
    return e.select("id", F.when(F.col("gen") > 2, "fatal").when((F.col("gen") < 2) & (F.col("mode") == "normal"), "refuse").otherwise("apply").alias("action"))


@query("flt10_voter_eligible", f"WITH {_NODES}, {_VOTES} SELECT gid, node_id, ballot > acc_ballot AND prepared AS eligible FROM votes")
def _(spark, d):
    return _votes(spark, d).select("gid", "node_id", ((F.col("ballot") > F.col("acc_ballot")) & F.col("prepared")).alias("eligible"))


@query("flt11_masks", "SELECT p_partkey AS id, bit_count(m)::INT AS members, (m & ~85) = 0 AS inside, CASE WHEN m = 0 THEN '' ELSE reverse(ltrim(bin(m), '0')) END AS text FROM (SELECT p_partkey, p_partkey % 256 AS m FROM part)")
def _(spark, d):
    m = F.col("p_partkey") % 256
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.bit_count(m).alias("members"), C.submask(m, F.lit(85)).alias("inside"), C.mask_text(m).alias("text"))


@query("flt12_referee_generation", "SELECT p_partkey AS id, bit_count(p_partkey % 16) = 1 AND bit_count(p_partkey % 7) = 2 AS referee FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.bit_count(F.col("p_partkey") % 16) == 1) & (F.bit_count(F.col("p_partkey") % 7) == 2)).alias("referee"))


@query(
    "flt13_node_status",
    f"""WITH {_FACTS}, s AS (SELECT *, CASE WHEN last_online_in = gen THEN 'online'
        WHEN (members >> (me - 1)) & 1 = 1 AND bit_count(members) >= bit_count(configured) // 2 + 1 AND gen = last_vote THEN 'recovery' ELSE 'dead' END AS state FROM facts)
    SELECT id, CASE WHEN state = 'dead' AND receive = 0 THEN 'disabled' WHEN state = 'dead' THEN 'catchup' WHEN (members & ~clique) <> 0 OR electing THEN 'isolated' ELSE state END AS status FROM s""",
)
def _(spark, d):
    c = F.col
    state = states.state_in_generation(c("me"), c("gen"), c("members"), c("configured"), c("last_online_in"), c("last_vote"))
    return _facts(spark, d).select("id", states.status(state, c("receive"), c("members"), c("clique"), c("electing")).alias("status"))


@query("prj1_expand_struct", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.struct(*n.columns).alias("s")).select("s.*")


@query("prj2_case_coalesce", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS a, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, (SELECT min(c_custkey) FROM customer)) AS b FROM orders")
def _(spark, d):
    least = table(spark, d, "customer").agg(F.min("c_custkey").alias("m"))
    a = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    return table(spark, d, "orders").crossJoin(F.broadcast(least)).select("o_orderkey", a.alias("a"), F.coalesce(a, F.col("m")).alias("b"))


@query("prj3_row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(spark, d):
    li, o, s = (table(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    keys = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    kept = li.join(keys, ["l_orderkey", "l_linenumber"], "left_semi")
    return filters.not_in(kept, "l_suppkey", s.where("s_acctbal < 0"), "s_suppkey").select("l_orderkey", "l_linenumber")


@query("prj4_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^Customer#0*[0-9]*7$') AND c_mktsegment NOT LIKE 'AUTO%'")
def _(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").rlike("^Customer#0*[0-9]*7$") & ~F.col("c_mktsegment").like("AUTO%")).select("c_custkey")


# --- joins, aggregates, progress ------------------------------------------------

_LATEST = """SELECT o.id AS origin, r.id AS receiver, coalesce(max(p.origin_lsn), 0) AS origin_lsn, coalesce(max(p.receiver_lsn), 0) AS receiver_lsn
    FROM nodes o JOIN nodes r ON o.id <> r.id LEFT JOIN points p ON p.origin = o.id AND p.receiver = r.id GROUP BY o.id, r.id"""


@query("apl14_latest_syncpoints", f"WITH {_NODES}, {_PTS} {_LATEST}")
def _(spark, d):
    return progress.latest(_points(spark, d), _nodes(spark, d))


QUERIES["jn1_jn2_left_theta_pairs"], ORACLES["jn1_jn2_left_theta_pairs"] = QUERIES["apl14_latest_syncpoints"], ORACLES["apl14_latest_syncpoints"]


@query("jn3_left_join_ordered", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey").orderBy("c_custkey", F.col("o_orderkey").asc_nulls_last())


@query("jn4_inner", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def _(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name")


@query("jn5_one_row_function", "SELECT n_nationkey FROM nation, (SELECT max(r_regionkey) AS m FROM region) WHERE n_nationkey > m")
def _(spark, d):
    one = table(spark, d, "region").agg(F.max("r_regionkey").alias("m"))
    return table(spark, d, "nation").join(F.broadcast(one), F.expr("n_nationkey > m")).select("n_nationkey")


_ASOF = """SELECT w.lsn, w.origin, p.receiver_lsn FROM changes w
    ASOF LEFT JOIN (SELECT * FROM points WHERE receiver = 1) p ON p.origin = w.origin AND w.lsn >= p.origin_lsn"""


@query("jn6_apl15_as_of", f"WITH {_CH}, {_NODES}, {_PTS} {_ASOF}")
def _(spark, d):
    left = event_changes(spark, d).select("lsn", F.col("origin").cast("int").alias("origin"))
    return progress.as_of(left, _points(spark, d).where("receiver = 1"), ["origin"], "lsn", "origin_lsn", ["receiver_lsn"]).withColumn("origin", F.col("origin").cast("long"))


@query("jn7_semi_delete", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal < 0"), F.expr("o_custkey = c_custkey"), "left_semi").select("o_orderkey")


@query("jn8_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return filters.not_in(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey").select("c_custkey")


@query("jn9_keyless_lookup", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("jn10_applied_membership", f"WITH {_CH} SELECT lsn FROM changes WHERE NOT (lsn % 5 = 0 AND origin = 1)")
def _(spark, d):
    c = event_changes(spark, d)
    return c.join(c.where("lsn % 5 = 0 and origin = 1").select("origin", "lsn"), ["origin", "lsn"], "left_anti").select("lsn")


@query("jn11_update_from", "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS comment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.expr("o_custkey = c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("comment"))


@query("agg1_apl23_free_id", "SELECT min(r)::INT AS id FROM (SELECT r FROM range(1, 17) t(r) EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0)")
def _(spark, d):
    return C.free_id(table(spark, d, "nation").where("n_nationkey % 3 <> 0").select("n_nationkey"))


@query("agg2_max_id", f"WITH {_NODES} SELECT max(id) AS id FROM nodes")
def _(spark, d):
    return _nodes(spark, d).agg(F.max("id").alias("id"))


@query("agg3_recovery_horizon", f"""WITH {_NODES}, {_PTS}, latest AS ({_LATEST}), asked AS (SELECT l.*, n.id AS sender FROM latest l JOIN nodes n ON n.id <> l.receiver WHERE l.origin_lsn > 0)
    SELECT sender, min(CASE WHEN origin = sender THEN origin_lsn ELSE coalesce((SELECT max(p.receiver_lsn) FROM points p WHERE p.origin = asked.origin AND p.receiver = asked.sender AND p.origin_lsn <= asked.origin_lsn), 0) END) AS horizon
    FROM asked GROUP BY sender""")
def _(spark, d):
    return progress.horizons(_points(spark, d), _nodes(spark, d))


@query("agg4_oldest_syncpoint", f"WITH {_NODES}, {_PTS} SELECT origin, min(origin_lsn) AS origin_lsn FROM points GROUP BY origin")
def _(spark, d):
    return _points(spark, d).groupBy("origin").agg(F.min("origin_lsn").alias("origin_lsn"))


@query("agg5_win1_latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("e"))
    return e.select("user_id", "e.event_id", "e.event_type")


@query("agg6_checksum", "SELECT md5('(' || string_agg(n_nationkey || ', ' || n_name, '),(' ORDER BY n_nationkey) || ')') AS checksum FROM nation")
def _(spark, d):
    return checks.checksum(table(spark, d, "nation"), ["n_nationkey"], ["n_nationkey", "n_name"])


@query("agg7_totals", "SELECT count(*) AS n, count(o_custkey) AS c, sum(o_custkey)::BIGINT AS s, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count("o_custkey").alias("c"), F.sum("o_custkey").alias("s"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))


@query("agg8_vote_tally", f"""WITH {_NODES}, {_VOTES}, polled AS (SELECT gid, node_id, prepared OR node_id = 1 AS ok, gid * node_id % 4 AS online FROM votes WHERE node_id = 1 OR (gid + 2 * node_id) % 5 <> 0),
    best AS (SELECT *, max(online) FILTER (ok) OVER (PARTITION BY gid) AS m FROM polled)
    SELECT gid AS gen_num, count(*) FILTER (ok) AS votes, max(m) AS last_online_in, bit_or(CASE WHEN ok AND online = m THEN (1 << (node_id - 1))::BIGINT ELSE 0 END) AS donors,
    count(*) FILTER (ok) >= 2 AND count(*) = 3 AS won FROM best GROUP BY gid""")
def _(spark, d):
    v = _votes(spark, d).select(F.col("gid").alias("gen_num"), F.col("node_id").alias("voter"), F.col("prepared").alias("vote_ok"), F.expr("gid * node_id % 4").alias("last_online_in"))
    replies = v.where("voter <> 1 and (gen_num + 2 * voter) % 5 <> 0")
    own = v.where("voter = 1").select("gen_num", F.col("voter").alias("me"), F.lit(7).cast("long").alias("members"), "last_online_in")
    return consensus.tally(replies, own, 3)


@query("agg9_quorum", "SELECT v.r AS votes, n.r AS nodes, v.r >= n.r // 2 + 1 AS ok FROM range(0, 17) v(r), range(1, 17) n(r)")
def _(spark, d):
    return spark.range(17).select(F.col("id").alias("votes")).crossJoin(spark.range(1, 17).select(F.col("id").alias("nodes"))).withColumn("ok", C.quorum(F.col("votes"), F.col("nodes")))


@query("agg10_agg11_decision", f"""WITH {_NODES}, {_VOTES}, t AS (SELECT gid, max(ballot) AS ballot, max({{'a': acc_ballot, 'n': acc_node, 's': status}}) AS acc FROM votes GROUP BY gid),
    g AS (SELECT v.gid, count(*) FILTER (v.ballot = t.ballot) AS agreeing FROM votes v JOIN t USING (gid) GROUP BY v.gid)
    SELECT gid, ballot, agreeing, CASE WHEN agreeing < 2 THEN 'wait' WHEN acc.a > 0 AND acc.s = 'precommitted' THEN 'precommit' ELSE 'preabort' END AS decree, (SELECT max(ballot) + 1 FROM votes) AS next_ballot FROM t JOIN g USING (gid)""")
def _(spark, d):
    return consensus.decide(_votes(spark, d), 3)


@query("agg12_commit_outcome", f"""WITH {_NODES}, {_VOTES} SELECT gid, prepared, precommitted, CASE WHEN prepared < 3 THEN 'abort' WHEN precommitted >= 2 THEN 'commit' ELSE 'open' END AS outcome
    FROM (SELECT gid, count(*) FILTER (prepared) AS prepared, count(*) FILTER (precommitted) AS precommitted FROM votes GROUP BY gid)""")
def _(spark, d):
    return consensus.commit_outcome(_votes(spark, d), 3)


@query("agg13_gather", "SELECT user_id AS request, event_type AS sender, min(event_id) AS at_, min_by(value, event_id) AS body FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("sender"), F.col("event_id").alias("at"), F.col("value").alias("body"))
    return consensus.gathered(e).withColumnRenamed("at", "at_")


@query("agg14_most_advanced", "SELECT event_id // 10 AS round, max(event_id % 4) AS gen, min_by(user_id, -(event_id % 4) * 1000000 + user_id) AS donor FROM events GROUP BY ALL")
def _(spark, d):
    e = table(spark, d, "events").select(F.expr("event_id div 10").alias("round"), (F.col("event_id") % 4).alias("gen"), F.col("user_id").alias("node_id"))
    return consensus.most_advanced(e, "round")


@query("agg15_online_set", f"WITH {_NODES}, {_VOTES} SELECT gid, bit_or((1 << (node_id - 1))::BIGINT) AS online FROM votes WHERE prepared GROUP BY gid")
def _(spark, d):
    return _votes(spark, d).where("prepared").groupBy("gid").agg(F.bit_or(C.mask_bit(F.col("node_id"))).alias("online"))


@query("agg16_client_stats", "SELECT event_type AS kind, max(value) AS max_latency, count(*) FILTER (value > 50) AS slow, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("value").alias("max_latency"), F.count_if(F.col("value") > 50).alias("slow"), F.count(F.lit(1)).alias("n"))


@query("agg17_records_per_txn", f"WITH {_CH} SELECT gid, count(*) AS n FROM changes GROUP BY gid")
def _(spark, d):
    return event_changes(spark, d).groupBy("gid").agg(F.count(F.lit(1)).alias("n"))


@query("agg18_state_vector", f"WITH {_CH} SELECT origin, max(lsn) AS lsn FROM changes GROUP BY origin")
def _(spark, d):
    return event_changes(spark, d).groupBy("origin").agg(F.max("lsn").alias("lsn"))


@query("agg19_array_round_trip", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def _(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("l")).select("n_regionkey", F.inline("l"))


# --- order-sensitive dataflow -----------------------------------------------------


@query("win2_last_writer", f"WITH {_CH} SELECT key, lsn, op FROM changes QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1")
def _(spark, d):
    return event_changes(spark, d).groupBy("key").agg(F.max(F.struct("lsn", "op")).alias("m")).select("key", "m.lsn", "m.op")


@query("win3_carry_forward", f"WITH {_CH} SELECT lsn, last_value(CASE WHEN changed THEN value END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS value FROM changes")
def _(spark, d):
    w = Window.partitionBy("key").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return event_changes(spark, d).select("lsn", F.last(F.when(F.col("changed"), F.struct("value")), ignorenulls=True).over(w)["value"].alias("value"))


QUERIES["win4_ddl_flag"], ORACLES["win4_ddl_flag"] = QUERIES["flt6_ddl_suppression"], ORACLES["flt6_ddl_suppression"]
QUERIES["win5_relation_elision"], ORACLES["win5_relation_elision"] = QUERIES["flt7_relation_headers"], ORACLES["flt7_relation_headers"]


@query("win6_str6_barriers", f"WITH {_CH} SELECT lsn, sum(CASE WHEN lsn % 25 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY lsn)::BIGINT AS segment FROM changes")
def _(spark, d):
    return filters.segments(event_changes(spark, d), "origin", "lsn", F.col("lsn") % 25 == 0).select("lsn", "segment")


@query("win7_syncpoint_emission", f"""WITH RECURSIVE {_CH}, s AS (SELECT origin, lsn, row_number() OVER (PARTITION BY origin ORDER BY lsn) AS i FROM changes),
    f AS (SELECT origin, lsn, i, lsn >= 40 AS emit, CASE WHEN lsn >= 40 THEN lsn ELSE 0 END AS mark FROM s WHERE i = 1
    UNION ALL SELECT s.origin, s.lsn, s.i, s.lsn - f.mark >= 40, CASE WHEN s.lsn - f.mark >= 40 THEN s.lsn ELSE f.mark END FROM f JOIN s ON s.origin = f.origin AND s.i = f.i + 1)
    SELECT origin, lsn, emit FROM f""")
def _(spark, d):
    out = progress.emit_every(event_changes(spark, d), "origin", "lsn", 40)
    return out.select("origin", F.col("at").alias("lsn"), "emit")


@query("win8_order_check", f"WITH {_CH} SELECT origin, bool_and(ok) AS ordered FROM (SELECT origin, coalesce(lsn > lag(lsn) OVER (PARTITION BY origin ORDER BY gid, lsn), true) AS ok FROM changes) GROUP BY origin")
def _(spark, d):
    w = Window.partitionBy("origin").orderBy("gid", "lsn")
    return event_changes(spark, d).withColumn("ok", F.coalesce(F.col("lsn") > F.lag("lsn").over(w), F.lit(True))).groupBy("origin").agg(F.bool_and("ok").alias("ordered"))


@query("srt1_order", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")


@query("srt2_top_one", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(1)


@query("srt3_multi_key", f"WITH {_NODES}, {_PTS} SELECT * FROM points ORDER BY origin, receiver, origin_lsn")
def _(spark, d):
    return _points(spark, d).orderBy("origin", "receiver", "origin_lsn")


@query("srt5_numeric_text", "SELECT p_partkey::VARCHAR AS xid FROM part ORDER BY xid::BIGINT")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("xid")).orderBy(F.col("xid").cast("long"))


@query("set1_except", "SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def _(spark, d):
    return table(spark, d, "nation").select("n_regionkey").subtract(table(spark, d, "region").where("r_regionkey > 2").select("r_regionkey"))


@query("set2_added_removed", "SELECT n_nationkey AS id, 'added' AS what FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 'removed' FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 <> 0")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    now, was = n.where("id % 2 = 0"), n.where("id % 3 = 0")
    return now.join(was, "id", "left_anti").withColumn("what", F.lit("added")).unionByName(was.join(now, "id", "left_anti").withColumn("what", F.lit("removed")))


@query("set3_mask_algebra", "SELECT p_partkey AS id, (a & b) AS both_, (a | b) AS either, (a & ~b) AS only FROM (SELECT p_partkey, p_partkey % 64 AS a, p_partkey % 37 AS b FROM part)")
def _(spark, d):
    a, b = F.col("p_partkey") % 64, F.col("p_partkey") % 37
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), a.bitwiseAND(b).alias("both_"), a.bitwiseOR(b).alias("either"), a.bitwiseAND(F.bitwise_not(b)).alias("only"))


QUERIES["set4_snapshot_union"], ORACLES["set4_snapshot_union"] = QUERIES["src5_broadcast_table"], ORACLES["src5_broadcast_table"]

# --- scalar functions ------------------------------------------------------------


@query("sf1_text", "SELECT n_nationkey, strpos(n_name, 'A')::INT AS p, 'n-' || n_nationkey || '/' || n_name AS f FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.instr("n_name", "A").alias("p"), F.format_string("n-%s/%s", F.col("n_nationkey"), F.col("n_name")).alias("f"))


@query("sf2_md5", "SELECT o_orderkey, md5(o_orderkey::VARCHAR || o_orderpriority) AS m FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.md5(F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority").cast("binary")).alias("m"))


@query("sf3_integer_arithmetic", "SELECT o_orderkey, (o_orderkey - 50) % 7 AS m, o_orderkey // 7 AS q FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") - 50) % 7).alias("m"), F.expr("o_orderkey div 7").alias("q"))


@query("sf4_lsn_text", "SELECT o_orderkey, printf('%X', (o_orderkey * 1000003 // 4294967296)::BIGINT) || '/' || printf('%X', (o_orderkey * 1000003 % 4294967296)::BIGINT) AS t, o_orderkey * 1000003 AS back FROM orders")
def _(spark, d):
    t = C.lsn_text(F.col("o_orderkey") * 1000003)
    return table(spark, d, "orders").select("o_orderkey", t.alias("t"), C.lsn_number(t).cast("long").alias("back"))


@query("sf5_json", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sf7_gid", "SELECT o_orderkey, 'MTM-' || (o_custkey % 16) || '-' || o_orderkey || '-' || (o_orderkey % 9) AS gid, o_custkey % 16 AS node, o_orderkey AS xid, o_orderkey % 9 AS gen FROM orders")
def _(spark, d):
    g = C.gid(F.col("o_custkey") % 16, F.col("o_orderkey"), F.col("o_orderkey") % 9)
    return table(spark, d, "orders").select("o_orderkey", g.alias("gid"), *[C.gid_part(g, i).alias(n) for i, n in ((1, "node"), (2, "xid"), (3, "gen"))])


@query("sf8_xstate", "SELECT o_orderkey, '1-' || (o_custkey % 16) || '-' || o_orderkey || '-' || printf('%x', o_orderkey % 300) || '-' || printf('%x', o_custkey % 64) || '-pc-' || (o_orderkey % 4) || ':1-' || (o_orderkey % 3) || ':2' AS state, o_orderkey % 300 AS gen, o_orderkey % 3 AS acc_ballot FROM orders")
def _(spark, d):
    c = F.col
    s = C.xstate_text(coordinator=c("o_custkey") % 16, xid=c("o_orderkey"), gen=c("o_orderkey") % 300, configured=c("o_custkey") % 64, status=F.lit("pc"), prop_ballot=c("o_orderkey") % 4, prop_node=F.lit(1), acc_ballot=c("o_orderkey") % 3, acc_node=F.lit(2))
    p = C.xstate_parts(s)
    return table(spark, d, "orders").select("o_orderkey", s.alias("state"), p["gen"].alias("gen"), p["acc_ballot"].alias("acc_ballot"))


@query("sf9_increasing_time", "SELECT event_id, max(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", (F.max(F.col("event_id") % 50).over(w) + F.row_number().over(w)).alias("t"))


@query("sf10_load_columns", "SELECT r % 53 AS a, r % 59 AS b, repeat('x', 5) AS t FROM range(1, 2001) x(r)")
def _(spark, d):
    return spark.range(1, 2001).select((F.col("id") % 53).alias("a"), (F.col("id") % 59).alias("b"), F.repeat(F.lit("x"), 5).alias("t"))


@query("sf11_term_order", f"WITH {_NODES}, {_VOTES} SELECT gid, max(ballot * 100 + node_id) // 100 AS ballot, max(ballot * 100 + node_id) % 100 AS node_id FROM votes GROUP BY gid")
def _(spark, d):
    return _votes(spark, d).groupBy("gid").agg(F.max(C.term(F.col("ballot"), F.col("node_id").cast("long"))).alias("t")).select("gid", "t.ballot", "t.node_id")


@query("sf12_hex_segment", "SELECT o_orderkey, ('0x' || printf('%x', o_orderkey))::BIGINT // 16 AS seg FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("cast(conv(hex(o_orderkey), 16, 10) as long) div 16").alias("seg"))


@query("sf13_guc_name", "SELECT c_custkey, translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.guc_name(F.col("c_mktsegment")).alias("name"))


# --- apply ------------------------------------------------------------------------

_BASE = "base AS (SELECT DISTINCT user_id AS key, 0.0::DOUBLE AS value FROM events WHERE user_id % 2 = 0)"
_APPLY = f"""WITH {_CH}, {_BASE}, log AS (SELECT key, lsn, op, value, changed FROM changes UNION ALL SELECT key, 0, 'B', value, true FROM base),
    st AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('I', 'B') THEN true WHEN op = 'D' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS here, sum(CASE WHEN op IN ('I', 'D', 'B') THEN 1 ELSE 0 END) OVER w AS run FROM log WINDOW w AS (PARTITION BY key ORDER BY lsn))"""


def _base(spark, d):
    return table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("key"), F.lit(0.0).alias("value")).distinct()


@query("apl1_apl2_apl3_apply", _APPLY + """, last AS (SELECT key, run, op FROM st QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)
    SELECT s.key, max_by(s.value, s.lsn) FILTER (s.changed OR s.op IN ('I', 'B')) AS value FROM st s JOIN last l ON s.key = l.key AND s.run = l.run
    GROUP BY s.key HAVING min_by(s.op, s.lsn) IN ('I', 'B')""")
def _(spark, d):
    return A.apply_changes(_base(spark, d), event_changes(spark, d))[0]


@query("apl2_apl3_conflicts", _APPLY + """ SELECT lsn, op, key, CASE WHEN op = 'U' THEN 'update of a missing row' WHEN op = 'D' THEN 'delete of a missing row' ELSE 'insert of a present row' END AS conflict
    FROM st WHERE (op IN ('U', 'D') AND NOT here) OR (op = 'I' AND here)""")
def _(spark, d):
    return A.apply_changes(_base(spark, d), event_changes(spark, d))[1]


@query("apl4_truncate", f"""WITH {_CH} SELECT key, max_by(value, lsn) AS value FROM changes WHERE lsn > 500 AND op = 'I' GROUP BY key""")
def _(spark, d):
    c = event_changes(spark, d).where("op = 'I'")
    cut = c.limit(1).select(F.lit(500).cast("long").alias("lsn"), *[F.lit(None).cast(t).alias(n) for n, t in c.dtypes if n not in ("lsn", "op")], F.lit("0").alias("op"))
    return A.apply_changes(_base(spark, d), c.unionByName(cut))[0]


@query("apl5_sequence_advance", "SELECT p_brand AS name, max(p_size)::BIGINT AS last_value FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").cast("long").alias("last_value"))


@query("apl6_outcome", "SELECT event_id // 4 AS gid, CASE event_id // 4 % 3 WHEN 0 THEN 'committed' WHEN 1 THEN 'aborted' ELSE 'notfound' END AS status FROM events GROUP BY ALL")
def _(spark, d):
    t = terminal(spark, d)
    return consensus.logged_status(t.select("gid"), t)


@query("apl8_apl9_insert_absent", f"WITH {_NODES}, {_PTS} SELECT DISTINCT receiver, origin, origin_lsn FROM points")
def _(spark, d):
    p = _points(spark, d).select("receiver", "origin", "origin_lsn")
    return A.insert_absent(p.where("origin_lsn % 200 = 1"), p, ["receiver", "origin", "origin_lsn"])


@query("apl10_upsert", "SELECT coalesce(o.uid, n.uid) AS uid, CASE WHEN o.uid IS NOT NULL AND n.uid IS NOT NULL THEN o.total + n.total ELSE coalesce(n.total, o.total) END AS total FROM (SELECT user_id AS uid, count(*) AS total FROM events WHERE event_id % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT user_id AS uid, count(*) AS total FROM events WHERE event_id % 2 = 1 GROUP BY 1) n ON o.uid = n.uid")
def _(spark, d):
    t = lambda k: table(spark, d, "events").where(f"event_id % 2 = {k}").groupBy(F.col("user_id").alias("uid")).agg(F.count(F.lit(1)).alias("total"))
    return A.upsert(t(0), t(1), ["uid"], {"total": lambda old, new: old + new})


@query("apl11_referee_grant", """WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, (event_id % 2 + 1)::INT AS node_id, event_id % 11 AS gen_num, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT key, seq, i, true AS granted, node_id AS holder, gen_num AS holder_gen FROM r WHERE i = 1
    UNION ALL SELECT r.key, r.seq, r.i, r.node_id = f.holder AND r.gen_num > f.holder_gen, f.holder, CASE WHEN r.node_id = f.holder AND r.gen_num > f.holder_gen THEN r.gen_num ELSE f.holder_gen END FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1)
    SELECT key, seq, granted, holder, holder_gen FROM f""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 + 1).alias("node_id"), (F.col("event_id") % 11).alias("gen_num"))
    return A.grant(e)


@query("apl12_referee_clear", "SELECT event_id AS id FROM events WHERE event_id % 11 < 4 OR (event_id % 2 + 1 = 1 AND event_id % 11 <= 7)")
def _(spark, d):
    return table(spark, d, "events").where((F.col("event_id") % 11 < 4) | ((F.col("event_id") % 2 + 1 == 1) & (F.col("event_id") % 11 <= 7))).select(F.col("event_id").alias("id"))


@query("apl13_syncpoint_cleanup", f"""WITH {_NODES}, {_PTS}, b AS (SELECT 2 AS origin, 500 AS ep, 400 AS ap UNION ALL SELECT 3, 600, NULL)
    SELECT p.* FROM points p LEFT JOIN b USING (origin) WHERE NOT (p.receiver = 1 AND (p.origin NOT IN (SELECT id FROM nodes WHERE id < 3) OR coalesce(p.origin_lsn < ep AND p.origin_lsn < ap, false)))""")
def _(spark, d):
    bounds = spark.createDataFrame([(2, 500, 400), (3, 600, None)], "origin int, kept_ep long, kept_ap long")
    return progress.cleanup(_points(spark, d), bounds, _nodes(spark, d).where("id < 3"), 1)


@query("apl16_restride", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN p_partkey ELSE (p_partkey // 3 + 1) * 3 + 2 END AS last_value FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.sequence_restart(F.col("p_partkey"), F.lit(2), F.lit(3)).alias("last_value"))


@query("apl17_strided_sequence", "SELECT n AS node, n + k * 3 AS value FROM range(1, 4) a(n), range(0, 100) b(k)")
def _(spark, d):
    return spark.range(1, 4).select(F.col("id").alias("node")).crossJoin(spark.range(100).select(F.col("id").alias("k"))).select("node", (F.col("node") + F.col("k") * 3).alias("value"))


@query("apl18_difference", "SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN k THEN CASE o_orderkey WHEN 8 THEN NULL ELSE o_orderstatus END ELSE o_orderstatus END AS o_orderstatus, (NOT k)::BIGINT AS n_a, k::BIGINT AS n_b FROM orders, (SELECT unnest([true, false]) AS k) WHERE o_orderkey = 8 OR (o_orderkey = 16 AND NOT k)")
def _(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = a.where("o_orderkey <> 16").withColumn("o_orderstatus", F.when(F.col("o_orderkey") != 8, F.col("o_orderstatus")))
    return checks.difference(a, b)


@query("apl19_local_registration", "SELECT DISTINCT event_type AS rel_name FROM events WHERE event_type LIKE '%i%'")
def _(spark, d):
    t = table(spark, d, "events").select(F.col("event_type").alias("rel_name")).distinct()
    return A.insert_absent(t.limit(0), t.where("rel_name like '%i%'"), ["rel_name"])


@query("apl22_dml_flag", f"WITH {_CH} SELECT gid, bool_or(op IN ('I', 'U', 'D') AND rel_name NOT IN ('signup', 'view')) AS contains_dml FROM changes GROUP BY gid")
def _(spark, d):
    return event_changes(spark, d).groupBy("gid").agg(F.bool_or(F.col("op").isin("I", "U", "D") & ~F.col("rel_name").isin("signup", "view")).alias("contains_dml"))


@query("apl24_node_list", "SELECT p_partkey AS id, (SELECT list(i ORDER BY i)::INT[] FROM range(1, 17) t(i) WHERE (p_partkey % 65536 >> (i - 1)::INT) & 1 = 1)::VARCHAR AS nodes FROM part WHERE p_partkey % 65536 > 0")
def _(spark, d):
    n = C.mask_nodes(F.col("p_partkey") % 65536)
    return table(spark, d, "part").where("p_partkey % 65536 > 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(n.cast("array<string>"), ", "), F.lit("]")).alias("nodes"))


@query("apl25_ping", "SELECT event_id // 5 AS round, count(DISTINCT event_id // 7) = 1 AS agree FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.expr("event_id div 5").alias("round")).agg((F.count_distinct(F.expr("event_id div 7")) == 1).alias("agree"))


# --- membership --------------------------------------------------------------------


@query("gr1_gr2_mutual_edges", f"WITH {_EDGES} SELECT x.a, x.b FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a")
def _(spark, d):
    return graph.mutual(_edges(spark, d)[0])


_ADJ = f"{_EDGES}, adj AS (SELECT id AS node, ((1 << (id - 1)) | coalesce((SELECT bit_or(1 << (x.b - 1)) FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a WHERE x.a = id), 0))::BIGINT AS mask FROM nodes)"


@query("gr2_adjacency", f"WITH {_ADJ} SELECT node, mask FROM adj")
def _(spark, d):
    return graph.adjacency(*_edges(spark, d))


@query("gr3_clique_test", f"WITH {_ADJ} SELECT m.r AS mask, NOT EXISTS (SELECT 1 FROM adj WHERE m.r & (1 << (node - 1)) <> 0 AND m.r & ~adj.mask <> 0) AS clique FROM range(1, 256) m(r)")
def _(spark, d):
    adjacent = graph.neighbours(*_edges(spark, d))
    return spark.range(1, 256).select(F.col("id").alias("mask"), graph.is_clique(F.col("id"), adjacent).alias("clique"))


@query("gr4_gr5_maximum_clique", f"WITH {_ADJ}, c AS (SELECT m.r AS mask FROM range(1, 256) m(r) WHERE NOT EXISTS (SELECT 1 FROM adj WHERE m.r & (1 << (node - 1)) <> 0 AND m.r & ~adj.mask <> 0)) SELECT mask, bit_count(mask)::INT AS size FROM c ORDER BY bit_count(mask) DESC, mask LIMIT 1")
def _(spark, d):
    return graph.maximum_clique(*_edges(spark, d))


@query("gr6_candidate", "SELECT event_id AS id, ((event_id % 256) & (event_id % 201)) | (1 << (event_id % 8)::INT)::BIGINT AS members, event_id % 17 + 1 AS gen_num FROM events")
def _(spark, d):
    me = F.pow(F.lit(2), F.col("event_id") % 8).cast("long")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 256).bitwiseAND(F.col("event_id") % 201).bitwiseOR(me).alias("members"), (F.col("event_id") % 17 + 1).alias("gen_num"))


@query(
    "gr7_generation_switch",
    f"""WITH {_FACTS}, s AS (SELECT *, CASE WHEN seen >= gen THEN 'same'
        WHEN (members >> (me - 1)) & 1 = 0 OR last_vote > gen OR (bit_count(members) < bit_count(configured) // 2 + 1 AND NOT (bit_count(members) = 1 AND bit_count(configured) = 2)) THEN 'dead'
        WHEN (donors >> (me - 1)) & 1 = 1 THEN 'online' ELSE 'recovery' END AS state FROM facts)
    SELECT id, state, CASE state WHEN 'dead' THEN 0 WHEN 'online' THEN -1 WHEN 'recovery' THEN CASE WHEN donors & 1 = 1 THEN 1 WHEN donors & 2 = 2 THEN 2 WHEN donors & 4 = 4 THEN 3 END END AS receives FROM s""",
)
def _(spark, d):
    c = F.col
    state = states.switched(c("me"), c("seen"), c("gen"), c("members"), c("configured"), c("donors"), c("last_vote"))
    return _facts(spark, d).withColumn("state", state).select("id", "state", states.receives_from(c("state"), c("donors")).alias("receives"))


@query("str2_receiver_mode", f"WITH {_FACTS} SELECT id, CASE WHEN receive = -1 THEN 'normal' WHEN receive > 0 AND receive = me THEN 'recovery' ELSE 'disabled' END AS mode FROM facts")
def _(spark, d):
    return _facts(spark, d).select("id", states.receiver_mode(F.col("receive"), F.col("me")).alias("mode"))


@query(
    "apl7_failure_action",
    """SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'ignore' WHEN event_id % 2 = 0 THEN 'abort' ELSE 'refuse' END
        WHEN event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 THEN 'stop' ELSE 'refuse' END AS action FROM events""",
)
def _(spark, d):
    x = F.expr
    mode = F.when(x("event_id % 2 = 0"), "recovery").otherwise("normal")
    action = states.on_failure(mode, x("event_id % 3 <> 0"), x("event_id % 5 = 0"), x("event_id % 7 = 0"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), action.alias("action"))


#: Statements by event_id % 6, and whether they call a listed function.
CALLS = [("SELECT lo_create(7)", True), ("SELECT LO_UNLINK (oid) FROM t", True), ("EXPLAIN SELECT lo_create(7)", False), ("SELECT 'lo_create(7)' FROM t", False), ("SELECT my_lo_create(7)", False), ("SELECT public.set_auto('t', true)", True)]
_LISTED = ["lo_create", "lo_unlink", "public.set_auto"]


@query("udf5_statement_as_text", "SELECT event_id, (event_id % 6)::INT IN (" + ", ".join(str(i) for i, (_, hit) in enumerate(CALLS) if hit) + ") AS as_text FROM events")
def _(spark, d):
    text = F.array(*[F.lit(t) for t, _ in CALLS])[(F.col("event_id") % len(CALLS)).cast("int")]
    return table(spark, d, "events").select("event_id", states.calls_listed(text, _LISTED).alias("as_text"))


@query("gr8_referee_election", "SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'both' WHEN event_id % 4 > 0 AND event_id % 3 = 0 THEN 'granted' ELSE 'wait' END AS result FROM events")
def _(spark, d):
    up = F.col("event_id") % 4
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(up == 3, "both").when((up > 0) & (F.col("event_id") % 3 == 0), "granted").otherwise("wait").alias("result"))


# --- streaming semantics in batch ----------------------------------------------------


@query("str3_dedup_by_position", f"WITH {_CH} SELECT origin, lsn, op FROM changes")
def _(spark, d):
    from ..streaming import deduplicated

    c = event_changes(spark, d)
    return deduplicated(c.unionByName(c.where("lsn % 3 = 0"))).select("origin", "lsn", "op")


@query("str4_transactions", f"WITH {_CH} SELECT gid, string_agg(op, '' ORDER BY lsn) AS ops FROM changes GROUP BY gid")
def _(spark, d):
    return event_changes(spark, d).groupBy("gid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lsn", "op"))), lambda x: x["op"]), "").alias("ops"))


@query("str7_heartbeat_gaps", "SELECT event_id, user_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) WHERE gap > INTERVAL 2 HOURS")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, d, "events").withColumn("before", F.lag("ts").over(w)).where(F.col("ts") > F.col("before") + F.expr("interval 2 hours")).select("event_id", "user_id")


@query("str8_freshness", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 HOURS")
def _(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts >= now - interval 10 hours").select("event_id")


@query("str9_retention", f"WITH {_NODES}, {_PTS} SELECT origin, min(m) AS keep_from FROM (SELECT origin, receiver, max(origin_lsn) AS m FROM points GROUP BY ALL) GROUP BY origin")
def _(spark, d):
    return _points(spark, d).groupBy("origin", "receiver").agg(F.max("origin_lsn").alias("m")).groupBy("origin").agg(F.min("m").alias("keep_from"))


#: Which statements replicate, and how.
STATEMENTS = {
    "CREATE TABLE": "tx", "ALTER TABLE": "tx", "DROP TABLE": "tx", "TRUNCATE": "tx", "CREATE INDEX": "tx", "CREATE INDEX CONCURRENTLY": "forbidden", "DROP INDEX CONCURRENTLY": "forbidden",
    "VACUUM": "skip", "COPY": "dml", "BEGIN": "skip", "COMMIT": "skip", "COMMIT AND CHAIN": "forbidden", "SAVEPOINT": "skip", "FETCH": "skip", "LISTEN": "skip", "CHECKPOINT": "skip", "CREATE DATABASE": "nontx", "CREATE TABLESPACE": "nontx", "SET": "session",
}


@query("apl21_statement_classes", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in STATEMENTS.items()) + ") t(tag, class)")
def _(spark, d):
    return spark.createDataFrame(list(STATEMENTS.items()), "tag string, class string")
