"""Text and number codecs as expressions of built-in functions, so they stay in
generated code and reach the scan. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A log position is unsigned; 0/0 means "nothing".
LSN = "decimal(20,0)"
XSTATE = r"^1-(\d+)-(\d+)-([0-9A-Fa-f]+)-([0-9A-Fa-f]+)-(in|pc|pa|cm|ab)-(\d+):(\d+)-(\d+):(\d+)$"
XSTATE_FIELDS = ("coordinator", "xid", "gen", "configured", "status", "prop_ballot", "prop_node", "acc_ballot", "acc_node")


def lsn_text(lsn: Column) -> Column:
    """A position as high/low halves in upper-case hex."""
    high = F.floor(lsn.cast(LSN) / F.lit(1 << 32)).cast("long")
    return F.concat(F.hex(high), F.lit("/"), F.hex((lsn.cast(LSN) - high.cast(LSN) * F.lit(1 << 32)).cast("long")))


def lsn_number(text: Column) -> Column:
    """The position that high/low text stands for."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast(LSN)
    return (half(1) * F.lit(1 << 32).cast(LSN) + half(2)).cast(LSN)


def mask_bit(node: Column) -> Column:
    """The mask of one node: node i is bit i - 1."""
    return F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), node - 1).cast("long")


def mask_nodes(mask: Column) -> Column:
    """The nodes of a mask (16 at most), ascending."""
    return F.filter(F.sequence(F.lit(1), F.lit(16)), lambda i: F.floor(mask / F.pow(F.lit(2.0), i - 1)).cast("long") % 2 == 1)


def mask_text(mask: Column) -> Column:
    """Bits from the first node on, trailing zeros cut: 5 is '101', 0 is ''."""
    return F.when(mask == 0, F.lit("")).otherwise(F.reverse(F.bin(mask)))


def submask(inner: Column, outer: Column) -> Column:
    return inner.bitwiseAND(F.bitwise_not(outer)) == 0


def quorum(votes: Column, nodes: Column) -> Column:
    """More than half of the nodes."""
    return votes >= F.floor(nodes / 2) + 1


def gid(node: Column, xid: Column, gen: Column) -> Column:
    return F.concat_ws("-", F.lit("MTM"), node.cast("string"), xid.cast("string"), gen.cast("string"))


def gid_part(text: Column, part: int) -> Column:
    """Node (1), transaction (2) or generation (3) of a transaction id; null if it is none."""
    got = F.regexp_extract(text, r"^MTM-(\d+)-(\d+)-(\d+)$", part)
    return F.when(got != "", got.cast("long"))


def term(ballot: Column, node: Column) -> Column:
    """Structs compare field by field, as terms do."""
    return F.struct(ballot.alias("ballot"), node.alias("node_id"))


def xstate_text(**c: Column) -> Column:
    s = lambda k: c[k].cast("string")
    return F.concat(F.lit("1-"), s("coordinator"), F.lit("-"), s("xid"), F.lit("-"), F.lower(F.hex(c["gen"])), F.lit("-"), F.lower(F.hex(c["configured"])), F.lit("-"), c["status"], F.lit("-"), s("prop_ballot"), F.lit(":"), s("prop_node"), F.lit("-"), s("acc_ballot"), F.lit(":"), s("acc_node"))


def xstate_parts(text: Column) -> dict[str, Column]:
    """The nine fields of a transaction state; null where the text is none."""
    out = {}
    for i, name in enumerate(XSTATE_FIELDS, 1):
        got = F.regexp_extract(text, XSTATE, i)
        value = F.conv(got, 16, 10).cast("long") if name in ("gen", "configured") else got if name == "status" else got.cast("long")
        out[name] = F.when(got != "", value)
    return out


def guc_name(name: Column) -> Column:
    """A setting's name with only ASCII letters lowered."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sequence_restart(last: Column, node: Column, nodes: Column) -> Column:
    """Where a sequence goes on when it strides by the largest node id: where it is, if
    it is on this node's stride, else the next stride's place."""
    return F.when(last % nodes == node % nodes, last).otherwise((F.floor(last / nodes) + 1) * nodes + node)


def free_id(used) -> object:
    """DataFrame of ids to one row `id`: the least of 1..16 that is not used."""
    spark = used.sparkSession
    return spark.range(1, 17).select(F.col("id").cast("int").alias("id")).join(used.select(F.col(used.columns[0]).cast("int").alias("_u")), F.col("id") == F.col("_u"), "left_anti").agg(F.min("id").alias("id"))
