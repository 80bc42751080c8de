"""Edit-aware token counts.

A document is a row of pre-tokens in leaves of a segment tree; each node holds the characters and
tokens below it. An edit re-splits the text from the last pre-token it can influence until the
boundaries are the old ones again, encodes only the pre-tokens made new there, and corrects the
sums on the path to the root. Trees are kept in a table (text, lengths and counts of the pre-tokens),
so later edits pay for themselves only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut, map_batches, python_batches, text_of
from lodestone.llm.bpe import Codec, load_codec

#: Pre-tokens of a leaf when the tree is built, and those at which the tree is built anew.
LEAF, FULL = 64, 512
Edit = tuple[int, int, str]

#: Edits of the default source: each match is replaced.
REDACTIONS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "<email>"),
    (re.compile(r"https?://[^\s<>\"]+"), "<url>"),
    (re.compile(r"\d{4,}"), "<number>"),
)
#: What a text holds if such a match occurs; the pattern is not tried on other texts.
SIGNS = {"<email>": "@", "<url>": "://"}


class TokenTree:
    """Counts of one document. ``encoded`` is the number of pre-tokens encoded so far."""

    def __init__(self, text: str, codec: Codec) -> None:
        self.codec, self.encoded = codec, 0
        self._build([(p, self._count(p)) for p in codec.split(text)])

    @classmethod
    def kept(cls, text: str, lens: Sequence[int], counts: Sequence[int], codec: Codec) -> TokenTree:
        """The tree of a row of the table: nothing is split or encoded."""
        out = cls.__new__(cls)
        out.codec, out.encoded = codec, 0
        ends = list(accumulate(lens))
        out._build([(text[e - n : e], c) for n, e, c in zip(lens, ends, counts, strict=True)])
        return out

    def pieces(self) -> list[tuple[str, int]]:
        return [x for leaf in self.leaves for x in leaf]

    def _count(self, piece: str) -> int:
        self.encoded += 1
        return len(self.codec.pieces[piece])

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k in range(len(self.leaves)):
            self._leaf_sums(k)
        for k in range(self.width - 1, 0, -1):
            self._pull(k)

    def _leaf_sums(self, k: int) -> None:
        self.chars[self.width + k] = sum(len(p) for p, _ in self.leaves[k])
        self.tokens[self.width + k] = sum(n for _, n in self.leaves[k])

    def _pull(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _update(self, k: int) -> None:
        self._leaf_sums(k)
        k = (self.width + k) // 2
        while k:
            self._pull(k)
            k //= 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of character ``at`` and the characters before that leaf."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if at >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return min(k - self.width, len(self.leaves) - 1), before if k - self.width < len(self.leaves) else self.n_chars - self.chars[self.width + len(self.leaves) - 1]

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters at ``start``; positions beyond the end are moved to it."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(start + length, self.n_chars))
        # matches look one character ahead, so those that end at start - 1 or later may change
        a, at = self._find(max(0, start - 2))
        lead, i = at, 0
        while i < len(self.leaves[a]) and lead + len(self.leaves[a][i][0]) < start - 1:
            lead += len(self.leaves[a][i][0])
            i += 1
        b, j, far = a, i, lead  # the next old pre-token to take in, and where it starts
        taken: list[str] = []

        def take(upto: int) -> None:
            nonlocal b, j, far
            while far < upto or (far == upto and j < 0):
                while j >= len(self.leaves[b]):
                    if b + 1 >= len(self.leaves):
                        return
                    b, j = b + 1, 0
                taken.append(self.leaves[b][j][0])
                far += len(taken[-1])
                j += 1

        take(end)
        room = 64
        while True:
            take(end + room)
            old = "".join(taken)
            last = far >= self.n_chars
            new = old[: start - lead] + insert + old[end - lead :]
            shift = len(insert) - (end - start)
            bounds, x = {}, lead
            for k, p in enumerate(taken):
                bounds[x] = k
                x += len(p)
            pieces, x, rest = [], 0, None
            for p in self.codec.split(new):
                was = x + lead - shift
                if x >= start - lead + len(insert) and was >= end and was in bounds and x > 0:
                    rest = bounds[was]
                    break
                if not last and x + len(p) > len(new) - 2:
                    break  # may go on beyond what has been read
                pieces.append(p)
                x += len(p)
            else:
                if last:
                    rest = len(taken)
            if rest is not None:
                break
            room *= 2
        # counts of old pre-tokens after the point where the boundaries meet stay
        counts, la, lj = [], a, i
        for _ in taken:
            while lj >= len(self.leaves[la]):
                la, lj = la + 1, 0
            counts.append(self.leaves[la][lj])
            lj += 1
        made = [(p, self._count(p)) for p in pieces] + counts[rest:]
        tail = self.leaves[b][j:]
        self.leaves[a] = self.leaves[a][:i] + made + tail
        self._update(a)
        for k in range(a + 1, b + 1):
            self.leaves[k] = []
            self._update(k)
        if len(self.leaves[a]) > FULL:
            self._build([x for leaf in self.leaves for x in leaf])


def redactions(text: str) -> list[Edit]:
    """Edits that mask addresses, links and long numbers, the last first so positions hold."""
    found: list[Edit] = []
    end = 0
    spans = sorted((m.start(), m.end(), by) for pattern, by in REDACTIONS if SIGNS.get(by, "") in text for m in pattern.finditer(text))
    for a, b, by in spans:
        if a >= end:
            found.append((a, b - a, by))
            end = b
    return found[::-1]


STATE = "doc_id long, text string, lens array<int>, counts array<int>"


def _lists(values: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(values), np.int32, int(ends[-1]))))


def keep(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, text, lens, counts: the trees' leaves, for each row. Null text is empty."""
    python_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = load_codec(path, pattern)
        split = [codec.split(t.as_py()) for t in batch.column(1)]
        counts = [list(map(len, map(codec.pieces.__getitem__, pieces))) for pieces in split]
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists([list(map(len, p)) for p in split]), _lists(counts)], names=["doc_id", "text", "lens", "counts"])

    return map_batches(docs.select("doc_id", text_of(docs, text).alias("text")), run, STATE)


FIGURES = "n_tokens_before long, n_edits long, n_tokens long, n_encoded long"


def update(state: DataFrame, path: str, pattern: str, edits: DataFrame | None = None, edits_of: Callable[[str], list[Edit]] = redactions, whole: bool = True) -> DataFrame:
    """The table after edits, with n_tokens_before, n_edits, n_tokens, n_encoded for each row; unless
    ``whole``, only doc_id, these figures and n_pretokens, and no trees leave the workers.

    ``edits``: doc_id and edits array<struct<start:int,length:int,insert:string>>, applied in order, one
    row a document; without it they are ``edits_of(text)``. Null or no edits leave a row as it is;
    ``n_encoded`` counts the pre-tokens encoded for the edits."""
    python_batches(state.sparkSession)
    listed_apart = edits is not None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = load_codec(path, pattern)
        texts, lens, counts, out = batch.column(1).to_pylist(), batch.column(2), batch.column(3), []
        given = batch.column(4).to_pylist() if listed_apart else [None] * batch.num_rows
        new_lens, new_counts = [], []
        for k, (t, listed) in enumerate(zip(texts, given, strict=True)):
            own = [(e["start"], e["length"], e["insert"] or "") for e in listed or []] if listed_apart else edits_of(t)
            n, c = lens[k].values.to_numpy(), counts[k].values.to_numpy()
            before, seen = int(c.sum()), 0
            after, size = before, len(n)
            if own:
                tree = TokenTree.kept(t, n.tolist(), c.tolist(), codec)
                for e in own:
                    tree.edit(*e)
                after, size, seen = tree.n_tokens, sum(map(len, tree.leaves)), tree.encoded
                if whole:
                    texts[k], pieces = tree.text(), tree.pieces()
                    n, c = [len(p) for p, _ in pieces], [x for _, x in pieces]
            if whole:
                new_lens.append(n)
                new_counts.append(c)
            out.append((before, len(own), after, seen, size))
        figures = [pa.array([r[i] for r in out], pa.int64()) for i in range(5)]
        names = ["n_tokens_before", "n_edits", "n_tokens", "n_encoded"]
        if whole:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), _lists(new_lens), _lists(new_counts), *figures[:4]], names=["doc_id", "text", "lens", "counts", *names])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures], names=["doc_id", *names, "n_pretokens"])

    rows = state.select("doc_id", "text", "lens", "counts")
    if edits is not None:
        rows = rows.join(edits.select("doc_id", "edits"), "doc_id", "left")
    return map_batches(rows, run, f"{STATE}, {FIGURES}" if whole else f"doc_id long, {FIGURES}, n_pretokens long")


def count_after_edits(docs: DataFrame, path: str, pattern: str, edits_of: Callable[[str], list[Edit]] | None = redactions, text: str = "text") -> DataFrame:
    """doc_id, n_tokens_before, n_edits, n_tokens, n_pretokens, n_encoded for each row.

    The trees are written to the shared folder and edited from there. Edits come from
    ``edits_of(text)`` or, where that is None, from the column ``edits``, by doc_id. Null text is
    empty, null edits are none; other columns are ignored."""
    state = cut(keep(docs, path, pattern, text), "token-trees", compression="zstd")
    done = update(state, path, pattern, docs.select("doc_id", "edits").dropDuplicates(["doc_id"]) if edits_of is None else None, edits_of or redactions, whole=False)
    return done.select("doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_pretokens", "n_encoded")
