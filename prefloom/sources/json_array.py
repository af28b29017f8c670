"""JSON arrays of objects, read in splits.

A JSON array is one document, but it can be cut at any closing brace: Spark's text source reads
it with ``}`` as the line separator, so a file of any size is many splits, whatever its line breaks.
What a split lacks is its state: whether it begins inside a string, and how deep.

1. Every split is scanned once and reports, for both possible string states, its change of depth,
   and whether its number of quotes is odd.
2. Prefix sums over the splits of a file (a row per split) give every split its true state.
3. Every split is scanned again from its state and gives its whole objects and the pieces of
   objects that cross its edges. Pieces meet by the number of their object; whole objects are
   not moved.

Objects are numbered by the split they begin in, so ``ord`` is the position in (file, array)
order. Anything but one array of objects per file stops the read: a value that is not an object, text after
the array, a missing or extra comma, a control character in a string, an unclosed
string or brace.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.sources.sinks import persist

#: splits up to which their states (about 100 bytes each) are sent to every task; beyond it the
#: text meets them by a shuffle
STATES_SENT = 100_000
_QUOTE, _BACK, _COMMA = b'"'[0], b"\\"[0], b","[0]
_OPEN, _CLOSE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_OPEN[[123, 91]] = _CLOSE[[125, 93]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True
_BATCH = 4 << 20
_NAME = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*\Z')
_LONGEST_NAME = 1 << 12


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that open or close a string: not after an odd run of backslashes."""
    quote = data == _QUOTE
    back = np.flatnonzero(data == _BACK)
    if len(back):
        first = np.r_[True, back[1:] != back[:-1] + 1]
        start = np.repeat(back[first], np.diff(np.r_[np.flatnonzero(first), len(back)]))
        odd = back[(back - start) % 2 == 0]  # this backslash escapes the byte behind it
        odd = odd[odd + 1 < len(data)]
        quote[odd + 1] = False
    return quote


def _inside(quote: np.ndarray, start: bool) -> np.ndarray:
    """Per byte, whether it lies in a string (its opening quote does, its closing one does not)."""
    return (np.cumsum(quote) + start) % 2 == 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, block, further columns), bytes) of the fragments in order, at most about
    ``_BATCH`` bytes at a time; every fragment with its closing brace."""
    for b in batches:
        keys = list(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True))
        held, size, now = [], 0, None
        for key, text in zip(keys, b.column(0), strict=True):
            if held and (key != now or size > _BATCH):
                yield now, b"}".join(held) + b"}"
                held, size = [], 0
            now = key
            held.append(text.as_py().encode())
            size += len(held[-1])
        if held:
            yield now, b"}".join(held) + b"}"


_SPLITS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("odd", pa.bool_()), ("outside", pa.int64()), ("within", pa.int64()), ("bytes", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, size, odd, outside, within, bytes) per split."""
    found: dict[tuple, list] = {}
    for key, chunk in _chunks(batches):
        data = np.frombuffer(chunk, dtype=np.uint8)
        odd, outside, within, size = found.setdefault(key, [False, 0, 0, 0])
        quote = _quotes(data)
        inside = _inside(quote, odd)
        step = _OPEN[data].astype(np.int64) - _CLOSE[data]
        found[key] = [bool((int(quote.sum()) + odd) % 2), outside + int(step[~inside].sum()), within + int(step[inside].sum()), size + len(chunk)]
    rows = [dict(zip(_SPLITS.names, [*k, *v], strict=True)) for k, v in found.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=_SPLITS)


_OUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("i", pa.int64()), ("kind", pa.int8()), ("value", pa.string()), ("label", pa.bool_())])
_WHOLE, _PIECE, _SUMMARY = 0, 1, 2


class _Split:
    """The objects of one split, fed chunk by chunk. Without a ``key`` the file is the array: it is
    depth 1, its objects 2. With one, the array is that member of an object: depth 2, its objects 3."""

    def __init__(self, key: str | None, file: str, block: int, inside: bool, depth: int, last: bool, braced: bool):
        self.key, self.base = key, 1 if key is None else 2
        self.file, self.block, self.inside, self.depth, self.last, self.braced = file, block, inside, depth, last, braced
        self.objects, self.closed = 0, depth == 0 and block > 0
        self.first = self.latest = None  # marks between objects: 0 a comma, 1 an object's begin
        self.label = None  # whether the member that is open is the wanted one; None: as the split before ends
        self.leading = depth > self.base  # begins inside an object
        self.rest: list[bytes] = []  # of the object that is open
        self.rows: list[dict] = []
        self.held = b""

    def wrong(self, what: str) -> ValueError:
        return ValueError(f"{self.file}: {what} (split at byte {self.block})")

    def _row(self, i: int, kind: int, value: bytes, label: bool | None) -> None:
        self.rows.append({"file": self.file, "block": self.block, "i": i, "kind": kind, "value": value.decode(), "label": label})

    def feed(self, chunk: bytes) -> list[dict]:
        if self.block == 0 and self.held == b"" and chunk.startswith(b"\xef\xbb\xbf"):
            chunk = chunk[3:]
        chunk, self.held = self.held + chunk, b"}"  # the last brace waits: a file's last fragment may have none
        self._take(chunk[:-1])
        rows, self.rows = self.rows, []
        return rows

    def _take(self, chunk: bytes) -> None:
        data = np.frombuffer(chunk, dtype=np.uint8)
        if not len(data):
            return
        quote = _quotes(data)
        inside = _inside(quote, self.inside)
        if (inside & (data < 32)).any():
            raise self.wrong("control character in a string")
        step = (_OPEN[data].astype(np.int64) - _CLOSE[data]) * ~inside
        after = self.depth + np.cumsum(step)
        before = after - step
        begins = np.flatnonzero((step > 0) & (before == self.base))
        ends = np.flatnonzero((step < 0) & (after == self.base))
        if self.key is None:
            self._check(data, quote, inside, step, before, after, begins, ends)
            labels = [True] * len(begins)
        else:
            labels = self._labels(chunk, data, step, before, begins)
        open_ = self.depth > self.base
        at, now = 0, self.open_label if open_ and not self.leading else None
        for end in ends:
            if not open_:
                k = int(np.searchsorted(begins, end)) - 1
                at, now = begins[k], labels[k]
            self._close(b"".join([*self.rest, chunk[at : end + 1]]), now)
            self.rest, open_, at = [], False, end + 1
        if after[-1] > self.base:
            if not open_:
                at, self.open_label = begins[-1], labels[-1]
            self.rest.append(chunk[at:])
        self.inside, self.depth = bool(inside[-1]), int(after[-1])

    def _labels(self, chunk: bytes, data: np.ndarray, step: np.ndarray, before: np.ndarray, begins: np.ndarray) -> list[bool | None]:
        """For every object that begins whether it is in the wanted array. A member's name is in the
        fragment in which its array begins: no brace stands between them."""
        members = np.flatnonzero((step > 0) & (before == 1))
        wanted = [bool(data[m] == 91 and (name := _NAME.search(chunk, max(0, m - _LONGEST_NAME), m)) and json.loads(name[1]) == self.key) for m in members]
        seen = [self.label, *wanted]
        out = [seen[k] if data[b] == 123 else False for k, b in zip(np.searchsorted(members, begins), begins, strict=True)]
        self.label = seen[-1]
        return out

    def _check(self, data, quote, inside, step, before, after, begins, ends) -> None:
        """The rules of an array of objects."""
        top = (np.minimum(before, after) <= 1) & ~inside & ~quote  # between objects, their braces included
        outer = np.flatnonzero((step != 0) & (np.minimum(before, after) == 0))
        if (after < 0).any() or (data[begins] != 123).any() or (data[ends] != 125).any() or (data[outer] != np.where(step[outer] > 0, 91, 93)).any() or (before[0] == 0 and self.closed and len(outer)):
            raise self.wrong("not one array of objects")
        if len(outer):
            self.closed = bool(after[outer[-1]] == 0)
            if (step[outer] > 0).sum() > 1:
                raise self.wrong("more than one array")
        other = top & (step == 0) & ~_BLANK[data]
        comma = other & (data == _COMMA) & (before == 1)
        if (other & ~comma).any() or (quote & (np.minimum(before, after) <= 1)).any():
            raise self.wrong("a value that is not an object")
        # objects and commas must alternate, here and (``_check_marks``) from split to split
        marks = np.sort(np.concatenate([np.flatnonzero(comma) * 2, begins * 2 + 1])) % 2
        if not len(marks):
            return
        if (marks[1:] == marks[:-1]).any() or self.latest == marks[0]:
            raise self.wrong("missing or extra comma")
        self.first = int(marks[0]) if self.first is None else self.first
        self.latest = int(marks[-1])

    def _close(self, value: bytes, label: bool | None) -> None:
        if self.leading:
            self._row(-1, _PIECE, value, None)
            self.leading = False
        else:
            self._row(self.objects, _WHOLE, value, label)
            self.objects += 1

    def finish(self) -> list[dict]:
        """The rows left at the split's end, and its summary (``i``: objects that begin here)."""
        if not self.last or self.braced:
            self._take(self.held)
        if self.last and (self.depth != 0 or self.inside):
            raise self.wrong("ends inside the array")
        if self.depth > self.base:
            self._row(-1 if self.leading else self.objects, _PIECE, b"".join(self.rest), None if self.leading else self.open_label)
            self.objects += not self.leading
        self._row(self.objects, _SUMMARY, json.dumps([self.first, self.latest]).encode(), self.label)
        rows, self.rows = self.rows, []
        return rows


def _objects(key: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, now = None, None
        for place, chunk in _chunks(batches):
            if place != now:
                if split is not None:
                    yield pa.RecordBatch.from_pylist(split.finish(), schema=_OUT)
                split, now = _Split(key, *place), place
            yield pa.RecordBatch.from_pylist(split.feed(chunk), schema=_OUT)
        if split is not None:
            yield pa.RecordBatch.from_pylist(split.finish(), schema=_OUT)

    return run


def array_objects(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(file, ord, value): the objects of the array file or files at ``path`` as JSON text; with a
    ``key``, those of the arrays of that name in files that hold one object each. ``ord`` numbers
    the array's objects (with a ``key``, all objects at that depth)."""
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    scanned = text.mapInArrow(_scan, "file string, block long, size long, odd boolean, outside long, within long, bytes long")
    text = text.drop("size")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    states = scanned.withColumn("inside", odd).withColumn("step", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    states = states.select("file", "block", "inside", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
                           F.lead("block").over(by_file).isNull().alias("last"),
                           # whether the file ends with the brace that its last fragment is given
                           (F.sum("bytes").over(Window.partitionBy("file")) == F.col("size")).alias("braced"))
    states = persist(states, "array-splits")
    if states.count() <= STATES_SENT:
        text = text.join(F.broadcast(states), ["file", "block"])
    else:
        text = text.withColumn("at", F.monotonically_increasing_id()).join(states, ["file", "block"])
        text = text.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    text = text.select("value", "file", "block", "inside", "depth", "last", "braced")
    rows = persist(text.mapInArrow(_objects(key), "file string, block long, i long, kind byte, value string, label boolean"), "array-objects")

    splits = rows.where(F.col("kind") == _SUMMARY)
    whole = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    carried = F.last("label", ignorenulls=True).over(before)
    starts = persist(splits.select("file", "block", F.coalesce(F.sum("i").over(whole), F.lit(0)).alias("base"), carried.alias("carried")), "array-starts")
    _check_splits(splits, states)
    placed = rows.where(F.col("kind") != _SUMMARY).join(starts, ["file", "block"]).withColumn("ord", F.col("base") + F.col("i"))
    placed = placed.withColumn("label", F.coalesce("label", "carried", F.lit(key is None)))
    pieces = placed.where(F.col("kind") == _PIECE).groupBy("file", "ord").agg(  # the pieces of one object
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "").alias("value"),
        F.min_by("label", "block").alias("label"))
    found = placed.where(F.col("kind") == _WHOLE).select("file", "ord", "value", "label").unionByName(pieces)
    return found.where("label").drop("label")


def _check_splits(splits: DataFrame, states: DataFrame) -> None:
    """Over all splits of a file: as many splits as were scanned first, objects and commas in turn."""
    marks = F.from_json("value", "array<int>")
    by_file = Window.partitionBy("file").orderBy("block")
    x = splits.select("file", "block", marks[0].alias("first"), marks[1].alias("last"))
    x = x.where("first IS NOT NULL").withColumn("previous", F.lag("last", 1, 0).over(by_file))  # 0 comma, 1 object
    x = x.withColumn("end", F.lead("first").over(by_file).isNull())
    bad = x.where((F.col("first") == F.col("previous")) | (F.col("end") & (F.col("last") == 0))).select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: missing or extra comma")
    if splits.count() != states.count():
        raise ValueError("the input changed while it was read")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of a JSON array as rows with ``ord``. Without a schema it is inferred from all of them."""
    rows = array_objects(spark, path)
    if schema is None:
        from prefloom.session import scratch_path

        lines = scratch_path(spark, "array-lines")
        rows.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(lines)  # no string holds a line break
        schema = spark.read.option("mode", "FAILFAST").json(lines).schema
    return rows.select("ord", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("ord", "r.*")
