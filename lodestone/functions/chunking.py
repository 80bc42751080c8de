"""Chunks of about a token budget with overlap; headings are hard boundaries."""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a chunk, carried over from the one before, at most, and of a tail that stays alone.
TARGET, OVERLAP, LONGEST, SHORTEST = 512, 64, 768, 48
#: Rows of a Python batch, and characters of chunks after which a batch of them is given out.
BATCH_ROWS, GIVEN_CHARS = 512, 1 << 20
_WIDE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.MULTILINE)
_BREAK = re.compile(r"\n\s*\n")


def estimate(text: str) -> int:
    if not text:
        return 0
    wide = len(_WIDE.findall(text))
    return max(1, round(0.72 * wide + 0.28 * (len(text) - wide)))


class Ruler:
    """Token estimates of any part of a text from running counts of wide characters."""

    def __init__(self, text: str) -> None:
        self.n, self.wide = len(text), array("q", accumulate((m is not None for m in map(_WIDE.match, text)), initial=0))

    def tokens(self, a: int, b: int) -> int:
        wide = self.wide[b] - self.wide[a]
        return max(1, round(0.72 * wide + 0.28 * (b - a - wide))) if b > a else 0

    def end(self, a: int, budget: int) -> int:
        """The largest end at which the part from ``a`` stays in the budget."""
        return a + bisect.bisect_right(range(a + 1, self.n + 1), budget, key=lambda b: self.tokens(a, b))

    def back(self, a: int, b: int, budget: int) -> int:
        """The smallest start, not before ``a``, at which the part up to ``b`` stays in the budget."""
        return b - bisect.bisect_right(range(1, b - a + 1), budget, key=lambda n: self.tokens(b - n, b))


def sections(text: str) -> list[tuple[str, int, int]]:
    """(heading path, start, end) of the parts that headings divide, without white space around;
    all of a text without headings."""
    found = list(_HEADING.finditer(text))
    if not found:
        return [("", 0, len(text))]
    out, path = [("", 0, found[0].start())], []
    for m, end in zip(found, [*(n.start() for n in found[1:]), len(text)], strict=True):
        path = [p for p in path if p[0] < len(m[1])] if not path or path[-1][0] >= len(m[1]) else path
        path.append((len(m[1]), m[2].strip()))
        out.append((" > ".join(t for _, t in path), m.start(), end))
    trimmed = []
    for heading, a, b in out:
        body = text[a:b]
        if body.strip():
            trimmed.append((heading, a + len(body) - len(body.lstrip()), a + len(body.rstrip())))
    return trimmed


def split_text(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(heading path, start, end, body) of each chunk. A rest that fits the longest size is one
    chunk; others end at the target size, or at the next paragraph if that fits the longest size,
    and the next starts OVERLAP tokens before. A last chunk under SHORTEST tokens joins the one
    before it under the same heading."""
    out: list[tuple[str, int, int, str]] = []
    for heading, first, stop in sections(text):
        body = text[first:stop]
        ruler, at = Ruler(body), 0
        while at < len(body):
            last = ruler.tokens(at, len(body)) <= LONGEST
            end = len(body)
            if not last:
                end = ruler.end(at, TARGET)
                gap = _BREAK.search(body, end)
                if gap and ruler.tokens(at, gap.start()) <= LONGEST:
                    end = gap.start()
            part = body[at:end]
            if part.strip():
                lead = at + len(part) - len(part.lstrip())
                out.append((heading, first + lead, first + lead + len(part.strip()), part.strip()))
            if last or end >= len(body):
                break
            at += max(1, ruler.back(at, end, OVERLAP) - at)
    if len(out) > 1 and out[-1][0] == out[-2][0] and estimate(out[-1][3]) < SHORTEST:
        out[-2:] = [(out[-2][0], out[-2][1], out[-1][2], f"{out[-2][3]}\n{out[-1][3]}")]
    yield from out


_COLUMNS = {"seq_no": pa.int64(), "heading_path": pa.string(), "char_start": pa.int64(), "char_end": pa.int64(), "body": pa.string(), "n_tokens": pa.int64()}


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> chunks, in batches of about GIVEN_CHARS characters at most."""

    def given(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        own = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *own], names=[batch.schema.names[0], *_COLUMNS])

    for batch in batches:
        at, rows, size = [], [], 0
        for k, s in enumerate(batch.column(1)):
            for i, (h, a, b, body) in enumerate(split_text(s.as_py())):
                at.append(k)
                rows.append((i, h, a, b, body, estimate(body)))
                size += len(body)
                if size >= GIVEN_CHARS:
                    yield given(batch, at, rows)
                    at, rows, size = [], [], 0
        if rows:
            yield given(batch, at, rows)


def chunk(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq_no, heading_path, char_start, char_end, body, n_tokens; null text has no chunk. A worker
    holds a batch of texts, the chunks of one of them, and GIVEN_CHARS characters of the others'."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, seq_no long, heading_path string, char_start long, char_end long, body string, n_tokens long"
    return docs.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(chunk_batches, schema)
