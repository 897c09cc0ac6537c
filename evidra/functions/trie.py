"""A token trie over phrases, walked once per document inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

TOKEN = re.compile(r"[^\W_]+")  # letters and digits of any script


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def build(phrases: Iterable[str]) -> tuple[list[dict], dict[int, list[int]]]:
    """(children by token for each node, numbers of the phrases that end at a node). Nodes are numbered, so a long phrase nests nothing;
    phrases without a token are left out."""
    nodes, ends = [{}], {}
    for number, phrase in enumerate(phrases):
        at = 0
        want = tokens(phrase)
        for token in want:
            step = nodes[at].get(token)
            if step is None:
                step = nodes[at][token] = len(nodes)
                nodes.append({})
            at = step
        if want:
            ends.setdefault(at, []).append(number)
    return nodes, ends


def found(nodes: list[dict], ends: dict[int, list[int]], said: list[str]) -> set[int]:
    """The phrases whose tokens occur one after the other in ``said``."""
    out: set[int] = set()
    root, last = nodes[0], len(said)
    for i, token in enumerate(said):
        at = root.get(token)
        j = i + 1
        while at is not None:
            if at in ends:
                out.update(ends[at])
            if j == last:
                break
            at = nodes[at].get(said[j])
            j += 1
    return out


class Spelled:
    """Whether a text holds a phrase in its exact spelling, as a whole word; a pattern per phrase is made once."""

    def __init__(self):
        self.patterns: dict[str, re.Pattern] = {}

    def __call__(self, phrase: str, text: str) -> bool:
        pattern = self.patterns.get(phrase)
        if pattern is None:
            pattern = self.patterns[phrase] = re.compile(r"(?<!\w)" + re.escape(phrase) + r"(?!\w)")
        return pattern.search(text) is not None
