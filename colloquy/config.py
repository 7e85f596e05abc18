"""Settings of the transcript operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Patterns of interjections; categories and patterns are tried in this order.
INTERJECTION_PATTERNS: dict[str, list[str]] = {
    "acknowledgment": [
        "yeah", "yea", "yep", "yup", "yes", "uh-huh", "uh huh", "uhuh", "mm-hmm", "mm hmm", "mmhmm", "mhm", "mm", "hmm", "hm",
        "right", "okay", "ok", "sure", "gotcha", "got it", "i see", "i know", "true", "exactly", "absolutely", "definitely", "totally", "for sure",
    ],
    "question": ["what", "why", "how", "really", "huh", "pardon", "sorry", "excuse me", "come again"],
    "reaction": [
        "wow", "oh", "ah", "whoa", "nice", "cool", "interesting", "amazing", "great", "awesome", "no way", "seriously", "oh my", "oh god", "oh no",
    ],
}


@dataclass(frozen=True)
class TurnConfig:
    """``max_seconds`` and ``max_words`` of an interjection; ``merge_gap``: seconds that one speaker's turn may pause."""

    max_seconds: float = 2.0
    max_words: int = 5
    merge_gap: float = 3.0
    patterns: dict[str, list[str]] = field(default_factory=lambda: INTERJECTION_PATTERNS)


@dataclass(frozen=True)
class VadConfig:
    micro_pause: float = 0.5
    thinking_pause: float = 2.0
    boundary: float = 5.0
    disfluency: float = 0.5
    disfluency_context: float = 1.0
    short: float = 3.0
    max_seconds: float = 30.0
    split_gap: float = 0.6
    full_gap: float = 1.0
    min_piece: float = 5.0
    max_splits: int = 3


REDACTED = "[REDACTED]"
