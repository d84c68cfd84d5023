"""A worker's bounded memory of the ids of strings it has encoded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST_STRINGS = 1_000_000
MOST_CHARS = 16_000_000


class Known(dict):
    """String to number. A string not met before gets the next number and waits to be encoded."""

    def __init__(self, strings: list[str], prefix: str):
        super().__init__()
        self.strings, self.prefix = strings, prefix

    def __missing__(self, part: str) -> int:
        self.strings.append(self.prefix + part)
        self[part] = number = len(self.strings) - 1
        return number


class Memory:
    """Ids by string number, emptied when it holds too many strings or characters."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.strings: list[str] = []
        self.maps: dict[str, Known] = {}
        self.ids, self.begins, self.sizes = np.zeros(0, "uint32"), np.zeros(0, "int64"), np.zeros(0, "int64")
        self.chars = 0

    def forget_if_full(self) -> None:
        if len(self.strings) > MOST_STRINGS or self.chars > MOST_CHARS:
            self.forget()

    def known(self, prefix: str) -> Known:
        """The map whose strings stand for `prefix` and themselves."""
        if prefix not in self.maps:
            self.maps[prefix] = Known(self.strings, prefix)
        return self.maps[prefix]

    def learn(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        """Encode what waits: `encode` gives all ids one after another and their number per string."""
        new = self.strings[len(self.sizes):]
        if new:
            ids, sizes = encode(new)
            self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids.astype("uint32")])
            self.chars += sum(map(len, new))

    def gather(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given by their strings' numbers, and the number of ids of each text."""
        flat = np.concatenate(numbers) if numbers else np.zeros(0, "int64")
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[flat] - (ends - sizes), sizes)
        before = np.concatenate([[0], ends])
        bounds = before[np.concatenate([[0], np.cumsum([len(n) for n in numbers], dtype="int64")])]
        return self.ids[at], np.diff(bounds)
