"""Splitting texts into pre-tokens, each distinct stretch of text once.

A single space between two characters that aren't white space always starts a
pre-token, so a text is first cut there; the stretches between repeat often,
and only distinct ones go through the pattern.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import regex

# The characters of Unicode's White_Space.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

ODD_SPACES = re.compile(f" (?:[{WHITE_SPACE}]|(?<=[{WHITE_SPACE}] ))")
CUT = re.compile(f"(?<=[^{WHITE_SPACE}]) (?=[^{WHITE_SPACE}])")


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with white space spelled out, as libraries differ on what it is."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(spelled)


def stretches(text: str) -> list[str]:
    """``text`` cut before each single space; all but the first lack that space."""
    return CUT.split(text) if ODD_SPACES.search(text) else text.split(" ")


class _Stretches(dict):
    """Numbers of stretches; one that is new is cut into pre-tokens when it is first asked for."""

    def __init__(self, splitter: Splitter, space: str):
        self.space, self.find, self.pieces, self.flat, self.ends = space, splitter.find, splitter.pieces, splitter.flat, splitter.ends

    def __missing__(self, stretch: str) -> int:
        space, flat, pieces = self.space, self.flat, self.pieces
        if space and stretch.isalpha():
            flat.append(pieces[space + stretch])
        elif space and stretch[-1:] in (".", ",") and stretch[:-1].isalpha():
            flat.append(pieces[space + stretch[:-1]])
            flat.append(pieces[stretch[-1]])
        else:
            flat.extend(map(pieces.__getitem__, self.find(space + stretch)))
        self[stretch] = number = len(self.ends) - 1
        self.ends.append(len(flat))
        return number


class Splitter:
    """Numbers distinct pre-tokens from 0 in order of appearance."""

    def __init__(self, pattern: str):
        self.find = compiled(pattern).findall
        self.pieces: dict[str, int] = defaultdict()
        self.pieces.default_factory = self.pieces.__len__
        # The pre-tokens of all stretches one after another, and their ends; numbers of those with and without a space before.
        self.flat, self.ends = array("i"), array("q", [0])
        self.spaced, self.first = _Stretches(self, " "), _Stretches(self, "")

    def __len__(self) -> int:
        return len(self.ends) - 1

    def split(self, text: str) -> list[int]:
        """Numbers of the stretches of ``text``, for gather()."""
        first, *rest = stretches(text)
        return [self.first[first], *map(self.spaced.__getitem__, rest)]

    def offsets(self, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The pre-tokens of the stretches from ``start`` on, and where each stretch's begin."""
        ends = np.array(self.ends[start:], dtype=np.int64)
        return np.array(self.flat[ends[0] :], dtype=np.int32), ends - ends[0]


def gather(codes: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """flat[begins[c]:begins[c + 1]] of each code c, one after another."""
    lengths = (begins[1:] - begins[:-1])[codes]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return flat[at + np.repeat(begins[codes] - (ends - lengths), lengths)]
