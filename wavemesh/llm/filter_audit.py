"""Filter interaction audit: what each filter takes, alone and after others, in every order of application.

A document fails some of the filters, which makes a mask of bits. The first filters look at the text alone; the last one
fails a document whose text a smaller doc_id has too. For it, rows are range-sorted by the text's fingerprint, the full
text and doc_id: every task walks its range once, compares each row with its predecessor and looks at the texts on the
way. Ranges are cut by fingerprint and doc_id, so that a group of copies of any size is dealt over tasks and no text is
sampled to the driver. A group that reaches over a border is settled from what each task says of the texts of its first
and last fingerprint: the least doc_id of a text over all tasks decides for the rows of the first fingerprint, whatever
lies between. What leaves the tasks is a narrow row per document. Labels are joined to these, and rows become additive
counters per part and mask; all orders are read off the counters, at most 2^filters rows a part.

Defined cases: null texts count as empty ones and null sources as the empty part; a null doc_id has no smaller one and is
none, so its row never fails the last filter; rows that share doc_id and text don't make each other fail; labels that
repeat a doc_id say yes where any of them does, and rows that share a doc_id share its labels; very long texts are held
one batch at a time; no rows give no rows; other columns are ignored, whatever their names. doc_id is an integer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, stored

NAMES = "ABCDE"
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: str) -> int:
    """Bits of the filters that look at one text: A too few words, B too few distinct ones, C too many capitals, D marks."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    few = len(words) < 50
    repeated = 100 * len(set(words)) < 65 * len(words)
    capitals = 100 * (len(data) - len(data.translate(None, _UPPER))) > 5 * len(text)
    marks = len(data.translate(None, _MARKS)) < len(data)
    return few | repeated << 1 | capitals << 2 | marks << 3


class Walk:
    """A walk along rows sorted by fingerprint, text and doc_id. first: whether the walk is still in the range's first
    fingerprint; nth: the place of the row's text among those of its fingerprint; least: the least doc_id of that text."""

    def __init__(self) -> None:
        self.print, self.text, self.least, self.nth, self.first = None, None, None, -1, True
        self.texts: list[tuple[str, int | None]] = []

    def step(self, fingerprint: tuple[int, int], text: str, doc_id: int | None) -> list[tuple[tuple[int, int], int, str, int | None]]:
        """Takes the next row; returns what is known of the texts of the first fingerprint once that is over."""
        over = []
        if fingerprint != self.print:
            if self.print is not None and self.first:
                over, self.first = self.known(), False
            self.print, self.text, self.nth, self.texts = fingerprint, None, -1, []
        if text != self.text:
            self.text, self.least, self.nth = text, None, self.nth + 1
            self.texts.append((text, None))
        if doc_id is not None and self.least is None:  # null ids come first, then the least
            self.least = doc_id
            self.texts[-1] = (text, doc_id)
        return over

    def known(self) -> list[tuple[tuple[int, int], int, str, int | None]]:
        """Fingerprint, place (-1 if it isn't the range's first fingerprint), text and least doc_id of the texts met."""
        return [(self.print, n if self.first else -1, text, least) for n, (text, least) in enumerate(self.texts)]


WALKED = "doc_id long, part string, mask int, range int, nth int, p1 long, p2 long, text string, least long"
_FIELDS = [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), ("nth", pa.int32()), ("p1", pa.int64()), ("p2", pa.int64()), ("text", pa.string()), ("least", pa.int64())]


def _walked(mask_of: Callable[[str], int], repeated: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, here, last, last_mask = Walk(), TaskContext.get().partitionId(), None, 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        def said(texts: list[tuple]) -> list[tuple]:
            return [(None, None, None, here, nth, *fingerprint, text, least) for fingerprint, nth, text, least in texts]

        for b in batches:
            rows = []
            for p1, p2, text, doc_id, part in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "text", "doc_id", "part")), strict=True):
                rows += said(walk.step((p1, p2), text, doc_id))
                if text != last:
                    last, last_mask = text, mask_of(text)
                again = repeated if doc_id is not None and walk.least < doc_id else 0
                # rows of the first fingerprint are settled later: they say which text of which range is theirs
                rows.append((doc_id, part, last_mask | again, here, walk.nth, None, None, None, None) if walk.first else (doc_id, part, last_mask | again, None, None, None, None, None, None))
            yield batch(rows)
        yield batch(said(walk.known()))

    return run


def masks(docs: DataFrame, mask_of: Callable[[str], int] = text_mask, names: str = NAMES) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, text, source). Bit i of a mask belongs to names[i]; mask_of says
    the bits of all filters but the last, which is that of repeated texts."""
    bit = 1 << len(names) - 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("p1"), F.xxhash64(F.lit("again"), "text").alias("p2"))
    ranges = rows.repartitionByRange("p1", "p2", "doc_id").sortWithinPartitions("p1", "p2", "text", "doc_id")
    with batches_of(docs.sparkSession, 256):
        walked = stored(ranges.select("p1", "p2", "text", "doc_id", "part").mapInArrow(_walked(mask_of, bit), WALKED), "audit-walked")
    # a text or two for each range, without regard to how many rows a group has
    said = walked.where("text IS NOT NULL").select("range", "nth", "p1", "p2", "text", "least")
    over_all = said.groupBy("p1", "p2", "text").agg(F.min("least").alias("first"), F.count_distinct("range").alias("ranges")).where("ranges > 1")
    settled = stored(said.where("nth >= 0").join(over_all, ["p1", "p2", "text"]).select("range", "nth", "first").distinct(), "audit-borders")
    own = walked.where("text IS NULL")
    plain, first = own.where("nth IS NULL").select("doc_id", "part", "mask"), own.where("nth IS NOT NULL")
    again = F.when(F.col("first") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask"))
    return plain.unionByName(first.join(settled, ["range", "nth"], "left").select("doc_id", "part", again.alias("mask")))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic. labels: doc_id, quality, toxic."""
    each = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs"))
    yes = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = lambda c: F.sum(F.col("docs") * F.coalesce(c, F.lit(0))).alias(c)
    return each.join(yes, "doc_id", "left").groupBy("part", "mask").agg(F.sum("docs").alias("docs"), counted("good"), counted("toxic"))


def interactions(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """A row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = []
    for order in permutations(range(len(names))):
        said = "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            before, own = sum(1 << j for j in order[: step - 1]), 1 << i
            for mask in range(1 << len(names)):
                fails, earlier = bool(mask & own), bool(mask & before)
                # of all orders, those in which this filter is the first of a mask's to come
                share = math.factorial(len(names)) // mask.bit_count() if fails else 0
                rows.append((said, step, mask, int(not fails and not earlier), int(fails and not earlier), int(fails and earlier), int(mask == own), share))
    # of fixed size: orders by steps by masks
    plan = counts.sparkSession.createDataFrame(pa.table(dict(zip(("filter_order", "step", "mask", "k", "r", "d", "u", "s"), map(pa.array, zip(*rows, strict=True)), strict=True))))
    plan = plan.select("filter_order", F.col("step").cast("int").alias("step"), F.col("mask").cast("int").alias("mask"), "k", "r", "d", "u", "s")
    total = lambda count, flag, name: F.sum(F.col(count) * F.col(flag)).alias(name)
    return counts.join(F.broadcast(plan), "mask").groupBy("part", "filter_order", "step").agg(
        total("docs", "k", "kept"), total("docs", "r", "removed"), total("docs", "d", "redundant"), total("docs", "u", "unique_fails"), total("good", "r", "good_lost"), total("toxic", "r", "toxic_lost"), total("docs", "s", "shapley")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the filters A to E over docs, by source."""
    return interactions(stored(counters(masks(docs), labels), "audit-counters"))
