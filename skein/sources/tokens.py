"""Token streams."""

from __future__ import annotations


class Tokens:
    """Kinds of tokens, their places in the text, and the places of comments."""

    __slots__ = ("text", "kinds", "starts", "ends", "comments")

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.comments: list[tuple[int, int]] = []

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]
