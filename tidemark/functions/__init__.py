"""Column functions: log positions, node masks, transaction ids and states."""

from .codecs import (
    free_id,
    gid,
    gid_part,
    guc_name,
    lsn_number,
    lsn_text,
    mask_bit,
    mask_nodes,
    mask_text,
    quorum,
    sequence_restart,
    submask,
    term,
    xstate_parts,
    xstate_text,
)

__all__ = [n for n in dir() if not n.startswith("_") and n != "codecs"]
