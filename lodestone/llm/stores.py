"""Ids of the parts of texts, which a worker remembers while it runs a task, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Longer parts are never kept.
LONGEST = 64
#: What an entry takes besides its characters and bytes: two objects' heads and a place in the table.
ENTRY = 200
#: Characters of parts looked up together.
GROUP = 1 << 20


class Store:
    """The bytes that ``make`` gives for parts, made for all new parts of a group of texts at once.

    What is remembered has two generations of ``max_bytes`` together. When the younger has a
    third of that, it becomes the older (with up to two thirds, as a group goes in whole; a
    larger one is dropped); entries of the older that are asked for move to the younger, the
    rest goes with the next change.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], max_bytes: int = 24 << 20):
        self.make, self.third = make, max_bytes // 3
        self.forget()

    def forget(self) -> None:
        """Leave nothing behind for the worker's next task."""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For each list of parts their bytes, one after another."""
        young, old = self.young, self.old
        new, long = [], []
        for part in set().union(*lists).difference(young):
            if (got := old.get(part)) is None:
                new.append(part)
            else:
                young[part] = got
                self.size += len(part) + len(got) + ENTRY
        for part, got in zip(new, self.make(new), strict=True):
            young[part] = got
            if len(part) > LONGEST:
                long.append(part)
            else:
                self.size += len(part) + len(got) + ENTRY
        get = young.__getitem__
        out = [b"".join(map(get, parts)) for parts in lists]
        for part in long:
            del young[part]
        if self.size > self.third:
            self.old, self.young, self.size = young if self.size <= 2 * self.third else {}, {}, 0
        return out

    def texts(self, texts: Iterable[Iterable[list[str] | bytes]]) -> list[bytes]:
        """The bytes of texts that come as sections, each a list of parts or bytes that are known already."""
        done: list[list[bytes]] = []
        held: list[list[str]] = []
        places: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            for (i, j), got in zip(places, self.joined(held), strict=True):
                done[i][j] = got
            held.clear()
            places.clear()

        for i, sections in enumerate(texts):
            done.append([])
            for section in sections:
                if isinstance(section, bytes):
                    done[i].append(section)
                    continue
                places.append((i, len(done[i])))
                done[i].append(b"")
                held.append(section)
                size += sum(map(len, section))
                if size >= GROUP:
                    flush()
                    size = 0
        flush()
        return [b"".join(d) for d in done]
