"""Every operator run over the driver's tables, beside the SQL that must give the same rows."""

from . import chats, comparing, curation, mixing, reports, similar, sources_sinks, streams, whole_jobs  # noqa: F401
from .registry import ORACLE, QUERIES

# Columns the SQL gives as INTEGER; the queries give every integer as bigint.
_NARROW = {
    "to_layout": ["seq_len"],
    "parse_tool_calls": ["turn"],
    "next_prompts": ["k"],
    "generate": ["k"],
    "length_bands": ["band"],
    "threshold_table": ["threshold"],
    "clip_keep_rate": ["clip"],
    "exclude_keys": ["l_linenumber"],
    "exclude_ranges": ["l_linenumber"],
    "attach_source": ["quality", "toxic"],
    "shards_to_budget": ["shard"],
    "balance_groups": ["shard"],
    "parse_metrics": ["position"],
    "log_anomalies": ["missing_keys"],
    "knn_join": ["query", "label"],
    "round_robin_dedup": ["round"],
    "similar_subset": ["round"],
    "read_union": ["label"],
    "manifest": ["seed", "seq_length"],
}
for _name, _columns in _NARROW.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"

__all__ = ["ORACLE", "QUERIES"]
