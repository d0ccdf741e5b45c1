"""Default system prompts of an answering model; callers pass their own in their place."""

from __future__ import annotations

DATA_SYSTEM = "Answer from the rows given. Name figures exactly and say what they don't tell."
SEARCH_SYSTEM = "Answer from the entries found, in the language of the question."
CHAT_SYSTEM = "Answer briefly and clearly, in the language of the question."
