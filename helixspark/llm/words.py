"""Words of texts in Python, with the meaning of WORD in .common."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space of str.split() beyond that of WORD.
_MORE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: What workers keep for each operator, and which of them ran last.
_clear: dict[str, Callable[[], object]] = {}
_running: list[str] = []


def remembers(operator: str, clear: Callable[[], object]) -> None:
    """clear empties what an operator keeps in a worker between batches."""
    _clear[operator] = clear


def turn_of(operator: str) -> None:
    """Call when an operator starts on a batch: a worker keeps what one operator remembers, not what all do."""
    if _running != [operator]:
        for name, clear in _clear.items():
            if name != operator:
                clear()
        _running[:] = [operator]
        give_back()


def give_back() -> None:
    """Return freed memory to the system, which other workers of the machine need, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _MORE.search(text) else text.split()


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together, each whole."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part
