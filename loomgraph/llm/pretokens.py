"""Splitting a text by a tokenizer's pattern, and what a worker keeps from task to task."""

from __future__ import annotations

import gc
import re
import threading
from collections.abc import Callable
from functools import lru_cache
from typing import Any

import regex

from .common import give_back

#: The usual pattern of byte-level BPE, and the same for texts of the characters in SAFE only, where `re` has all it takes.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
SAFE = f"\t\n\r -~{_LETTER}¡«»¿×÷–—‘’“”…"
_unsafe = re.compile(f"[^{SAFE}]").search
_quick = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+").findall


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    full = regex.compile(pattern).findall
    if pattern != USUAL:
        return full
    return lambda text: full(text) if _unsafe(text) else _quick(text)


class Recent(dict):
    """A mapping that keeps what was met in the last one or two times `bound` new entries, in two generations."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def recall(self, key: str) -> bytes | None:
        """An entry of the older generation, which counts as new again."""
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def renew(self) -> None:
        """Between texts: with the younger generation full, the older one is given up."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


#: Seconds without a task after which a worker gives its tables up: Spark keeps idle workers, and other stages need their memory.
IDLE = 8.0


class Kept:
    """What make() made last, until it is given up."""

    def __init__(self, make: Callable[..., Any]):
        self.make, self.lock, self.timer = make, threading.Lock(), None
        self.of, self.held, self.users = None, None, 0

    def take(self, *of: Any) -> Any:
        with self.lock:
            if self.timer:
                self.timer.cancel()
            self.users += 1
            if self.held is None or self.of != of:
                self.of, self.held = of, None
                self.held = self.make(*of)
            return self.held

    def rest(self) -> None:
        """To be called once for each take(), when its task is over."""
        with self.lock:
            self.users -= 1
            if not self.users:
                self.timer = threading.Timer(IDLE, self._drop)
                self.timer.daemon = True
                self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            if not self.users:
                self.held = None
                gc.collect()
                give_back()
