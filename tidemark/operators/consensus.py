"""Votes: commit tallies, term decisions, elections, node status. All are grouped
aggregates over vote rows and case expressions; nothing is asked of a live node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quorum


def commit_outcome(votes: DataFrame, nodes: int) -> DataFrame:
    """votes (gid, node_id, prepared, precommitted): commit needs every member's prepare
    and a majority's pre-commit; short of the first it aborts, of the second it is open."""
    t = votes.groupBy("gid").agg(F.count_if("prepared").alias("prepared"), F.count_if("precommitted").alias("precommitted"))
    return t.withColumn("outcome", F.when(F.col("prepared") < nodes, "abort").when(quorum(F.col("precommitted"), F.lit(nodes)), "commit").otherwise("open"))


def decide(votes: DataFrame, nodes: int) -> DataFrame:
    """votes (gid, node_id, ballot, acc_ballot, acc_node, status): with a majority at the
    highest proposal, the status accepted at the highest term is proposed: pre-commit
    only if it is that vote's value, else pre-abort. The next ballot is above all of any
    transaction."""
    top = votes.groupBy("gid").agg(F.max("ballot").alias("ballot"), F.max(F.struct("acc_ballot", "acc_node", "status")).alias("acc"))
    agreed = votes.join(top.select("gid", F.col("ballot").alias("_b")), "gid").groupBy("gid").agg(F.count_if(F.col("ballot") == F.col("_b")).alias("agreeing"))
    decree = F.when(~quorum(F.col("agreeing"), F.lit(nodes)), "wait").when((F.col("acc.acc_ballot") > 0) & (F.col("acc.status") == "precommitted"), "precommit").otherwise("preabort")
    after = votes.agg((F.max("ballot") + 1).alias("next_ballot"))  # one row
    return top.join(agreed, "gid").select("gid", "ballot", "agreeing", decree.alias("decree")).crossJoin(F.broadcast(after))


def tally(replies: DataFrame, candidates: DataFrame, nodes: int) -> DataFrame:
    """replies (gen_num, voter, vote_ok, last_online_in) to candidates (gen_num, me,
    members, last_online_in): votes with the candidate's own, the donors (those in the
    latest generation among the voters, itself included) and whether the election is won:
    by a quorum, and only if every other member of the generation has answered."""
    bit = lambda c: F.pow(F.lit(2), F.col(c) - 1).cast("long")
    own = candidates.select("gen_num", F.col("me").alias("voter"), F.lit(True).alias("vote_ok"), "last_online_in", "members")
    asked = replies.join(candidates.select("gen_num"), "gen_num", "left_semi")
    every = own.unionByName(asked.select("gen_num", "voter", "vote_ok", "last_online_in").withColumn("members", F.lit(None).cast("long")))
    best = every.withColumn("_m", F.max(F.when(F.col("vote_ok"), F.col("last_online_in"))).over(Window.partitionBy("gen_num")))
    donor = F.when(F.col("vote_ok") & (F.col("last_online_in") == F.col("_m")), bit("voter")).otherwise(F.lit(0).cast("long"))
    t = best.groupBy("gen_num").agg(F.count_if("vote_ok").alias("votes"), F.max("_m").alias("last_online_in"), F.bit_or(donor).alias("donors"), F.bit_or(bit("voter")).alias("_polled"), F.max("members").alias("_members"))
    polled = F.col("_members").bitwiseAND(F.bitwise_not("_polled")) == 0
    return t.select("gen_num", "votes", "last_online_in", "donors", (quorum(F.col("votes"), F.lit(nodes)) & polled).alias("won"))


def logged_status(gids: DataFrame, log: DataFrame) -> DataFrame:
    """What the log says became of each transaction: committed, aborted or notfound."""
    end = log.where(F.col("event").isin("COMMIT_PREPARED", "ABORT_PREPARED")).groupBy("gid").agg(F.max(F.struct("lsn", "event")).alias("e"))
    return gids.join(end, "gid", "left").select("gid", F.when(F.col("e.event") == "COMMIT_PREPARED", "committed").when(F.col("e.event") == "ABORT_PREPARED", "aborted").otherwise("notfound").alias("status"))


def most_advanced(nodes: DataFrame, by: str) -> DataFrame:
    """Per group the node in the highest generation; of equals the smallest id."""
    return nodes.groupBy(by).agg(F.max(F.struct("gen", (-F.col("node_id")).alias("neg"))).alias("m")).select(by, F.col("m.gen").alias("gen"), (-F.col("m.neg")).alias("donor"))


def gathered(replies: DataFrame) -> DataFrame:
    """The first reply of each sender to each request."""
    return replies.groupBy("request", "sender").agg(F.min(F.struct("at", "body")).alias("r")).select("request", "sender", F.col("r.at").alias("at"), F.col("r.body").alias("body"))
