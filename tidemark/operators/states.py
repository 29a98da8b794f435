"""Decision rules of a member: generation switches, status, receiver modes, what a failed
apply leads to, and which statements travel as text. Column expressions over rows of
facts, so that a log of any length is decided in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import quorum

#: The modes of a receiver that are no donor's number.
DISABLED, NORMAL = 0, -1


def _has(mask: Column, node: Column) -> Column:
    """Whether node 1, 2, ... is in a mask."""
    return mask.bitwiseAND(F.pow(F.lit(2), node - 1).cast("long")) != 0


def _viable(members: Column, configured: Column) -> Column:
    return quorum(F.bit_count(members), F.bit_count(configured))


def by_referee(members: Column, configured: Column) -> Column:
    """One member of two configured: granted by the referee, without a quorum."""
    return (F.bit_count(members) == 1) & (F.bit_count(configured) == 2)


def switched(me: Column, current: Column, gen: Column, members: Column, configured: Column, donors: Column, last_vote: Column) -> Column:
    """What a member becomes on news of a generation: 'same' where it is no newer than
    the current one; 'dead' outside it, without a quorum (but for the referee's) or where
    a later one was voted for; 'online' as a donor; else 'recovery'."""
    dead = ~_has(members, me) | (~_viable(members, configured) & ~by_referee(members, configured)) | (last_vote > gen)
    return F.when(current >= gen, "same").when(dead, "dead").when(_has(donors, me), "online").otherwise("recovery")


def receives_from(state: Column, donors: Column) -> Column:
    """The receive mode after a switch: none, all origins, or the first donor's number."""
    first = F.round(F.log2(donors.bitwiseAND(-donors))).cast("int") + 1
    return F.when(state == "dead", DISABLED).when(state == "online", NORMAL).when(state == "recovery", first)


def receiver_mode(receive: Column, node: Column) -> Column:
    """How the receiver from a node works: only the donor's recovers, the others wait."""
    return F.when(receive == DISABLED, "disabled").when(receive == NORMAL, "normal").when(receive == node, "recovery").otherwise("disabled")


def state_in_generation(me: Column, gen: Column, members: Column, configured: Column, last_online_in: Column, last_vote: Column) -> Column:
    """'online' in it, 'recovery' where that can still come, else 'dead'."""
    hope = _has(members, me) & _viable(members, configured) & (gen == last_vote)
    return F.when(last_online_in == gen, "online").when(hope, "recovery").otherwise("dead")


def status(state: Column, receive: Column, members: Column, clique: Column, electing: Column) -> Column:
    """What a user is told: a dead node is disabled, or catching up where it receives; a
    living one is isolated while it misses members or an election runs."""
    apart = (members.bitwiseAND(F.bitwise_not(clique)) != 0) | electing
    return F.when((state == "dead") & (receive == DISABLED), "disabled").when(state == "dead", "catchup").when(apart, "isolated").otherwise(state)


def on_failure(mode: Column, in_transaction: Column, plain_commit: Column, nontx_ddl: Column) -> Column:
    """What a failed apply leads to: 'stop' in recovery, outside a transaction and for
    one already committed at its origin, but DDL that is no part of a transaction may
    fail ('ignore'); else the transaction is undone, with a negative answer in normal mode
    ('refuse', else 'abort')."""
    stop = ((mode == "recovery") | ~in_transaction | plain_commit) & ~nontx_ddl
    return F.when(stop, "stop").when(~in_transaction, "ignore").when(mode == "normal", "refuse").otherwise("abort")


def calls_listed(statement: Column, names: list[str]) -> Column:
    """Whether a statement calls one of the functions, with or without its schema, and is
    no EXPLAIN: it then travels as text. Names in string literals or comments don't count."""
    plain = F.regexp_replace(statement, r"'(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/", " ")
    listed = "|".join(n.lower().replace(".", r"\s*\.\s*") for n in names)
    called = F.lower(plain).rlike(rf"(?<![\w$])(?:{listed})\s*\(") if names else F.lit(False)
    return F.coalesce(called & ~F.lower(F.ltrim(plain)).startswith("explain"), F.lit(False))
