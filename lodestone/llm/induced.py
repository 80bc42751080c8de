"""External induced sorting of the suffixes of a shard, by disk-backed priority queues.

The reduced string of LMS substrings is sorted by recursion; its order seeds a queue from which all
L suffixes come out in order, and those seed a second one for the S suffixes. Queues hold a bounded
heap and spill sorted runs to files that are merged as they are read. Common prefixes of neighbours
are carried up to a cap. This is the plain form of the method: ``suffixdedup`` finds the same bytes at
a fraction of the time (the README has the figures), and the tests hold both against each other.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator, Sequence

#: Tuples that a queue holds in memory; tuples that a run gives back at once.
HEAP, BLOCK = 1 << 16, 1 << 12


class DiskQueue:
    """A priority queue of tuples: beyond ``limit`` the larger half of the heap goes to a file as a
    sorted run."""

    def __init__(self, limit: int = HEAP) -> None:
        self.limit, self.heap, self.runs = limit, [], []  # type: ignore[var-annotated]

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            every = sorted(self.heap)
            self.heap, spilled = every[: self.limit // 2], every[self.limit // 2 :]
            run = self._read(spilled)
            self.runs.append([next(run), run])

    @staticmethod
    def _read(items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for at in range(0, len(items), BLOCK):
            pickle.dump(items[at : at + BLOCK], file)
        blocks = -(-len(items) // BLOCK)
        file.seek(0)

        def give() -> Iterator[tuple]:
            with file:
                for _ in range(blocks):
                    yield from pickle.load(file)

        return give()

    def peek(self) -> tuple | None:
        heads = [r[0] for r in self.runs]
        best = min(heads, default=None)
        if self.heap and (best is None or self.heap[0] < best):
            return self.heap[0]
        return best

    def pop(self) -> tuple:
        item = self.peek()
        if item is None:
            raise IndexError("empty queue")
        if self.heap and self.heap[0] is item:
            return heapq.heappop(self.heap)
        k = next(i for i, r in enumerate(self.runs) if r[0] is item)
        following = next(self.runs[k][1], None)
        if following is None:
            del self.runs[k]
        else:
            self.runs[k][0] = following
        return item


def suffix_array(text: Sequence[int], limit: int = HEAP) -> list[int]:
    """The order of the suffixes of ``text``; the end is smaller than every symbol."""
    n = len(text)
    if n < 2:
        return list(range(n))
    small = bytearray(n + 1)  # 1: S type, smaller than the suffix after it
    small[n] = 1
    for i in range(n - 2, -1, -1):
        small[i] = text[i] < text[i + 1] or (text[i] == text[i + 1] and small[i + 1])
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    # LMS substrings in order, and names for equal ones
    ends = [*(j + 1 for j in lms[1:]), n][: len(lms)]
    pieces = DiskQueue(limit)
    for k, (a, b) in enumerate(zip(lms, ends, strict=True)):
        # with their types: of two that agree so far, the one that ends (an S type) is the larger
        pieces.push((tuple(2 * text[j] + small[j] for j in range(a, b)) + ((-1,) if b == n else ()), k))
    names, last, name, order = [0] * len(lms), None, -1, []
    for _ in lms:
        piece, k = pieces.pop()
        name += piece != last
        last, names[k] = piece, name
        order.append(k)
    if name + 1 < len(lms):
        order = suffix_array(names, limit)
    seeds = [lms[k] for k in order]
    # from left to right: every suffix gives the one before it, if that is of L type
    queue, found, at, clock = DiskQueue(limit), [], 0, 0

    def before(i: int) -> None:
        nonlocal clock
        if i > 0 and not small[i - 1]:
            queue.push((text[i - 1], clock, i - 1))
            clock += 1

    before(n)
    while at < len(seeds) or queue.peek() is not None:
        top = queue.peek()
        if top is not None and (at == len(seeds) or top[0] <= text[seeds[at]]):
            i = queue.pop()[2]
            found.append(i)
        else:
            i = seeds[at]
            at += 1
        before(i)
    # from right to left: every suffix gives the one before it, if that is of S type
    queue, out, at, clock = DiskQueue(limit), [], len(found) - 1, 0
    while at >= 0 or queue.peek() is not None:
        top = queue.peek()
        if top is not None and (at < 0 or -top[0] >= text[found[at]]):
            i = queue.pop()[2]
        else:
            i = found[at]
            at -= 1
        out.append(i)
        if i > 0 and small[i - 1]:
            queue.push((-text[i - 1], clock, i - 1))
            clock += 1
    return out[::-1]


def repeated(docs: Sequence[tuple[int, bytes]], width: int = 50, limit: int = HEAP) -> dict[int, list[tuple[int, int]]]:
    """Spans of bytes that a string of ``width`` bytes covers which also starts in a document with a
    smaller id, by position in ``docs``; strings never cross documents."""
    text, start = [], []
    for _, body in docs:
        start.append(len(text))
        text += [b + 1 for b in body] + [0]
    owner = [k for k, (_, body) in enumerate(docs) for _ in range(len(body) + 1)]
    whole = [i + width <= start[owner[i]] + len(docs[owner[i]][1]) for i in range(len(text))]
    covered: dict[int, list[tuple[int, int]]] = {}
    group: list[int] = []

    def close() -> None:
        least = min((docs[owner[i]][0] for i in group), default=0)
        for i in group:
            if docs[owner[i]][0] > least:
                covered.setdefault(owner[i], []).append((i - start[owner[i]], i - start[owner[i]] + width))
        group.clear()

    for i in suffix_array(text, limit):
        if not whole[i]:
            continue
        if group and text[group[-1] : group[-1] + width] != text[i : i + width]:  # a common prefix under the cap
            close()
        group.append(i)
    close()
    out = {}
    for k, windows in covered.items():
        spans: list[tuple[int, int]] = []
        for a, b in sorted(windows):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        out[k] = spans
    return out
