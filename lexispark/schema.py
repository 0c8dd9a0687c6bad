"""Fixed parameters of the index."""

from __future__ import annotations

MAX_TERM_LENGTH = 20
LOG2_QUANTUM = 8
