"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with every run of other characters than letters and digits as one
space. An item of n characters may differ by k = RATE * n edits: of its k + 1 pieces one is then found unchanged. An
automaton finds all pieces in one pass over a text; around each hit Myers' bit-parallel algorithm gives the least edit
distance between the item and any part of the text there, and up to k it is a find.

The items go to the tasks in blocks of a bounded size; more blocks are more passes over the documents.

Defined cases: null or empty texts hold nothing; null or empty items, and such of neither letters nor digits, are found
nowhere; items too short for the budget of one edit (of fewer than 15 characters) have to occur unchanged, as whole
words; items that repeat are found each; one without an id is found with a null item_id; repeated rows give the same
finds; very long texts are searched whole, in the one pass of each block; empty tables give no rows or no finds; columns other than text and those to keep are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

#: Edits allowed for each character of an item.
RATE = 0.07
#: Characters of the items that one pass over the documents looks for.
BLOCK = 8_000_000

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


class Pattern:
    """An item, ready for Myers' algorithm."""

    def __init__(self, item_id, text: str):
        self.item_id, self.text = item_id, text
        self.k = int(RATE * len(text))
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        n = len(self.text)
        if self.k == 0:
            yield 1, f" {self.text} "  # whole words; texts are searched with a space at either end
            return
        cuts = [n * i // (self.k + 1) for i in range(self.k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield -a, self.text[a:b]

    def distance(self, text: str) -> int:
        """The least edit distance between the item and any part of text."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best = m
        for c in text:
            eq = self.places.get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = (down | ~(xh | up)) & full
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                best = min(best, score)
            ph <<= 1
            up = (mh << 1 | ~(xv | ph)) & full
            down = ph & xv
        return best


class Finder:
    def __init__(self, items: list[tuple[int, str]]):
        self.patterns = [Pattern(i, t) for i, t in items if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for p, pattern in enumerate(self.patterns):
            for shift, piece in pattern.pieces():
                at.setdefault(piece, []).append((p, shift))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def finds(self, text: str | None) -> list[tuple[int, int]]:
        """(item, distance) of every item that the text holds, by item."""
        if not self.patterns:
            return []
        text = f" {normal(text)} "
        best: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for last, (size, uses) in self.automaton.iter(text):
            for p, shift in uses:
                start = last + 1 - size + shift  # where the item would begin
                if (p, start) in seen or best.get(p) == 0:
                    continue
                seen.add((p, start))
                pattern = self.patterns[p]
                if pattern.k == 0:
                    best[p] = 0
                    continue
                d = pattern.distance(text[max(0, start - pattern.k) : start + len(pattern.text) + pattern.k])
                if d <= pattern.k and d < best.get(p, d + 1):
                    best[p] = d
        return sorted(((self.patterns[p].item_id, d) for p, d in best.items()), key=lambda f: (f[0] is not None, f))


FINDS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))
_FIND = pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])


def find_items(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """The columns to keep, finds array<struct<item_id, distance>> by item. docs: text and those; items: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block))

    def pass_over(rows: DataFrame, b: int) -> DataFrame:
        found = [(r.item_id, normal(r.text)) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(found)  # about `block` characters
        schema = T.StructType([*rows.schema.fields, T.StructField(f"finds_{b}", FINDS)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value)
            for batch in batches:
                got = [[{"item_id": i, "distance": d} for i, d in finder.finds(t.as_py())] for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(_FIND))], names=schema.names)

        return rows.mapInArrow(run, schema)

    # what is kept stays apart, so that no name of it clashes
    rows = docs.select("text", F.struct(*keep).alias("kept"))
    for b in range(n_blocks):
        rows = pass_over(rows, b)
    return rows.select("kept.*", F.sort_array(F.concat(*(f"finds_{b}" for b in range(n_blocks)))).alias("finds"))
