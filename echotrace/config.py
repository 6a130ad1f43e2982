"""Settings, their defaults and the ranges that they are held to."""

from __future__ import annotations

from collections.abc import Mapping
from types import SimpleNamespace
from typing import Any

from echotrace.functions.urls import TRACKING

#: name: (default, kind, least, most).  Kinds: whole and number are cut to their range and fall back to the default where they are neither;
#: switch reads texts such as "yes"; raw is taken as it is; listed must be a list.  Fixed values
SETTINGS: dict[str, tuple[Any, str, float | None, float | None]] = {
    "blocked_groups": ([], "listed", None, None),
    "embedding_provider_id": ("", "raw", None, None),
    "image_search_semantic_enabled": (True, "switch", None, None),
    "image_search_semantic_threshold": (0.55, "number", 0, 1),
    "image_search_fuzzy_threshold": (0.65, "number", 0, 1),
    "vision_provider_id": ("", "raw", None, None),
    "judge_provider_id": ("", "raw", None, None),
    "enable_llm_judge": (True, "truth", None, None),
    "judge_context_window_seconds": (600, "whole", 60, 86400),
    "judge_context_max_messages": (12, "whole", 4, 40),
    "similarity_threshold": (0.95, "raw", None, None),
    "image_hash_threshold": (0.90, "raw", None, None),
    "min_unique_senders": (3, "raw", None, None),
    "cooldown_seconds": (3600, "raw", None, None),
    "data_retention_days": (7, "raw", None, None),
    "forward_max_depth": (3, "whole", 1, 5),
    "forward_max_fetches": (8, "whole", 1, 20),
    "forward_fetch_timeout": (10, "whole", 1, 30),
    "forward_max_nodes": (100, "whole", 1, 500),
    "forward_max_segments": (500, "whole", 1, 2000),
    "forward_max_chars": (12000, "whole", 500, 50000),
    "forward_min_visible_chars": (20, "whole", 1, 200),
    "forward_sender_text_match": (True, "switch", None, None),
    "forward_debug_log": (False, "switch", None, None),
    "url_only_exact_match": (True, "switch", None, None),
    "url_tracking_params": (list(TRACKING), "listed", None, None),
    "video_duplicate_enabled": (True, "switch", None, None),
    "video_max_analyze_size_mb": (100, "whole", 1, 2048),
    "video_frame_hash_threshold": (0.90, "number", 0.5, 1),
    "ffmpeg_path": ("ffmpeg", "raw", None, None),
    "video_debug_log": (False, "switch", None, None),
    "vision_prompt": ("", "raw", None, None),
    "judge_prompt": ("", "raw", None, None),
    "ignore_regex": ([], "listed", None, None),
    "min_text_length": (3, "raw", None, None),
    "auto_filter_commands": (True, "truth", None, None),
}
_YES = ("1", "true", "yes", "on")


def _read(value: Any, default: Any, kind: str, least: float | None, most: float | None) -> Any:
    match kind:
        case "switch":
            return value.strip().lower() in _YES if isinstance(value, str) else bool(value)
        case "truth":
            return bool(value)
        case "listed":
            return list(value) if isinstance(value, list | tuple) else default
        case "whole" | "number":
            try:
                value = int(value) if kind == "whole" else float(value)
            except (TypeError, ValueError, OverflowError):
                value = default
            return min(max(value, least), most) if value == value else default
    return value


def settings(given: Mapping[str, Any] | None = None) -> SimpleNamespace:
    """All settings as attributes; names that aren't settings raise."""
    given = dict(given or {})
    if unknown := sorted(given.keys() - SETTINGS.keys()):
        raise KeyError(f"no such settings: {', '.join(unknown)}")
    out = SimpleNamespace(**{name: _read(given.get(name, how[0]), *how) for name, how in SETTINGS.items()})
    out.blocked_groups = [str(x) for x in out.blocked_groups]
    out.url_tracking_params = tuple(t for x in out.url_tracking_params if (t := str(x).strip().lower()))
    return out
