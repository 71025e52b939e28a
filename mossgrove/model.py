"""Schemas and parameters."""

from __future__ import annotations

from dataclasses import dataclass

FILES = "source string, content string, mtime timestamp, length bigint"
CHUNKS = "id string, source string, heading string, heading_level int, content string, start_line int, end_line int, content_hash string, trunk_distance int, indexed_at timestamp, embedding array<float>"
TASKS = "type string, path string, parent string, priority int, queued_at string, status string, error string, id string"
ACTIONS = "array<struct<action:string,target:string,direction:string,reason:string>>"
JUDGMENT = "struct<seeing:string,verdict:string,direction:string,reason:string>"
AUDIT = "timestamp string, operation string, path string, entity string, session_id string, error string"
METRICS = "timestamp string, event string, judge_tokens_in bigint, judge_tokens_out bigint, executor_tokens_in bigint, executor_tokens_out bigint, total_tokens_in bigint, total_tokens_out bigint, total_cost_usd double, cost_usd double, elapsed_ms bigint, verdict string"
BLOCKS = "array<struct<type:string,text:string,name:string,input:string,content:string>>"

# Directories of captures, which are never rewritten
LEAF_PREFIXES = ("sources/", "heartbeat/artifacts/", "events/", "journal/", "days/", "episodes/", "notes/", "mirrors/", "inbox/")
# Files that are promoted, never rewritten (more by parameter)
PROTECTED_FILES = ("MEMORY.md", "identity.md", "manifest.md", "mind.md")
# What a briefing is read from, in order (more by parameter)
IDENTITY_FILES = ("identity.md", "mind/mind.md", "mind/desires/beliefs.md", "mind/desires/values.md", "mind/desires/desires.md", "mind/practices/practices.md", "open-threads/open-threads.md")
# Text files that a source directory is read from
SOURCE_EXTENSIONS = ("md", "txt", "py", "rs", "go", "js", "ts", "yml", "yaml", "toml", "json")


@dataclass(frozen=True)
class Params:
    """Tunable values of retrieval, clustering and limits."""

    vector_weight: float = 0.5
    text_weight: float = 0.3
    trunk_weight: float = 0.2
    candidates: int = 20
    top_k: int = 5
    route_top_k: int = 10
    k1: float = 1.2
    b: float = 0.75
    metric: str = "l2"
    cluster_threshold: float = 0.7
    concept_floor: float = 0.5
    cascade_depth: int = 5
    source_chars: int = 50_000
    cluster_chars: int = 40_000
    briefing_chars: int = 5_000
    dimension: int = 384
    leaf_prefixes: tuple[str, ...] = LEAF_PREFIXES
    protected: tuple[str, ...] = PROTECTED_FILES
    identity: tuple[str, ...] = IDENTITY_FILES
