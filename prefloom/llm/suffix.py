"""Substring deduplication: bytes of a document covered by a 50-byte string that also starts
in a document with a smaller id are removed.

Equal strings of ``LENGTH`` bytes are found bucket by bucket through a sample of the positions that is
computed first. No suffix order is built: hashes of strings are grouped instead, and the sample is not a
positional difference cover but one chosen by content, which needs far fewer records to move (README,
"Substring deduplication", with the figures):

* Cover: a suffix's head (its first 50 bytes) holds 27 grams of 24 bytes; the one with the
  least hash is its sample. Equal heads choose the same sample, so every tie is seen at it;
  about one position in 14 is a sample. Neighbouring suffixes with one sample are a run, whose
  content (at most 76 bytes) is determined by its first and last head and its length.
* Pass 1 looks at runs: every part of the table sends its distinct runs, bucketed by sample, as packed columns; a
  bucket is grouped in one task. A run whose content starts in a smaller document is removed as a whole
  (the long ties). A sample that only one document holds, or that always has the same run,
  needs nothing more. A part sends few runs of one sample (``_few``): a phrase with many neighbourhoods
  does not fill its bucket.
* Pass 2 looks at single heads, only those of samples that occur with different runs: the edges of
  repeated passages. Their buckets follow from the heads themselves, so that the many neighbourhoods of
  one phrase are spread over all of them.
* Pass 3 removes what either pass found.

A part sends one entry for a string however often it holds it, so copies and passages that a
third of all documents share are a few entries a part. A bucket tells strings apart by 40 and 48
bits of hashes, a part looks its own up by 64 bits of both.

Defined results: a null text is empty; texts under ``LENGTH`` bytes lose nothing; rows
repeated under one id do not remove each other; a null id comes after all others (and does not
remove from other nulls); a text of over a megabyte is scanned in pieces that overlap by 49 bytes, so a
task holds the text, its marks and the strings of one piece; empty tables give empty results; other
columns are not read, so none can clash. Answers that a task cannot see stop the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import lean, qualified, released
from prefloom.llm.words import _BYTE, mix, slices
from prefloom.session import scratch_path

LENGTH = 50
GRAM = 24
PART_ROWS = 1 << 12
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 128
_SLICE = 1 << 16
#: bytes of a long text scanned at a time; strings a part's task holds before it sends them
_PIECE = 1 << 20
_HELD = 1 << 21
#: strings of a bucket that its task sorts at a time
_SORTED = 1 << 20
#: runs of one sample that a part sends, and the content of the entry for those above them
_KINDS = 64
_MORE = np.uint64(1 << 48)
_LAST = np.iinfo(np.int64).max
_U = np.uint64
_SPREAD = _U(0xA0761D6478BD642F)


def _gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every 24-byte and every 50-byte string (polynomials, joined by doubling)."""
    ladder, power = [_BYTE[data]], [_U(0x9E3779B97F4A7C15)]
    for k in range(5):
        h, n = ladder[-1], 1 << k
        ladder.append(h[:-n] + h[n:] * power[-1])
        power.append(power[-1] * power[-1])

    def joined(sizes: tuple[int, ...]) -> np.ndarray:
        n, total, at, p = len(data) - sum(1 << s for s in sizes) + 1, None, 0, _U(1)
        for s in sizes:
            part = ladder[s][at : at + n] * p
            total = part if total is None else total + part
            at, p = at + (1 << s), p * power[s]
        return total

    return joined((4, 3)), joined((5, 4, 1))


class Runs:
    """Runs of neighbouring suffix heads with one sample, for a slice of texts: ``lo`` first
    head (byte position in the slice), ``n`` heads, ``text`` index, ``sample`` and ``content``
    keys; ``heads`` a hash of every head, not yet mixed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        none = np.empty(0, dtype=np.int64)
        self.lo = self.n = self.text = none
        self.sample = self.content = self.heads = none.view(_U)
        if len(data) < LENGTH:
            return
        with np.errstate(over="ignore"):
            grams, heads = _gram_hashes(data)
        bits = _U(max(1, int(len(grams)).bit_length()))
        mask = (_U(1) << bits) - _U(1)
        grams = (grams ^ (grams >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        key = (grams & ~mask) | np.arange(len(grams), dtype=_U)
        width, have = LENGTH - GRAM + 1, 1
        while have < width:  # minimum over `have` grams, doubled up to the window
            step = min(have, width - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        at = (key & mask).astype(np.int64)
        valid = np.ones(len(at), dtype=bool)  # heads that stay inside their text
        for k in range(1, LENGTH):
            edge = offsets[1:] - k
            valid[edge[(edge >= 0) & (edge < len(at))]] = False
        i = np.flatnonzero(valid)
        if not len(i):
            return
        new = np.r_[True, (at[i[1:]] != at[i[:-1]]) | (i[1:] != i[:-1] + 1)]
        first = np.flatnonzero(new)
        self.n = np.diff(np.r_[first, len(i)])
        self.lo = i[first]
        self.heads = heads
        self.text = np.searchsorted(offsets, self.lo, "right") - 1
        self.sample = mix(grams[at[self.lo]]) >> _U(24)  # mixed again: least hashes are all small, and buckets are ranges
        first, last = mix(heads[self.lo]), mix(heads[self.lo + self.n - 1])
        self.content = mix(first * _U(0xD6E8FEB86659FD93) + last + self.n.astype(_U)) >> _U(16)

    def expanded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, head position, bucket key, head key) of the single heads of the chosen runs. The
        bucket follows from the head itself: the heads of one sample are spread over all buckets."""
        run = np.repeat(which, self.n[which])
        inside = np.arange(len(run)) - np.repeat(np.cumsum(self.n[which]) - self.n[which], self.n[which])
        at = self.lo[run] + inside
        head = mix(self.heads[at])
        return run, at, mix(head ^ _SPREAD) >> _U(24), head >> _U(16)


def _key(sample: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(sample * _U(0x9E3779B97F4A7C15) ^ content)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 8-byte integers, their bytes regrouped by significance and compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).reshape(-1).view(_U) for p in raw]


def _distinct(sample, content, ids):
    """Distinct (sample, content) in the order of the sample, with least and largest id."""
    order = np.lexsort((content, sample))
    s, c, d = sample[order], content[order], ids[order]
    at = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]) if len(s) else np.empty(0, dtype=np.int64)
    return s[at], c[at], np.minimum.reduceat(d, at) if len(at) else d, np.maximum.reduceat(d, at) if len(at) else d


def _few(sample, content, lo, hi):
    """At most ``_KINDS`` distinct runs of a sample, those of least content. One entry stands for the others,
    with the least and largest id of all: more tell a bucket only that the sample is mixed, which it then is,
    and the heads of runs that were not sent are seen in pass 2."""
    at = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]]) if len(sample) else np.empty(0, dtype=np.int64)
    count = np.diff(np.r_[at, len(sample)])
    many = count > _KINDS
    if not many.any():
        return sample, content, lo, hi
    least, largest = np.minimum.reduceat(lo, at)[many], np.maximum.reduceat(hi, at)[many]
    mark = at[many] + _KINDS
    content[mark], lo[mark], hi[mark] = _MORE, least, largest
    keep = np.arange(len(sample)) - np.repeat(at, count) <= _KINDS
    return sample[keep], content[keep], lo[keep], hi[keep]


def _blocks(part: int, found: list[tuple], buckets: int, few: bool) -> Iterator[pa.RecordBatch]:
    """The distinct strings of a part, packed by bucket."""
    if not found:
        return
    s, c, lo, hi = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
    if few:
        s, c, lo, hi = _few(s, c, lo, hi)
    bucket = (s * _U(buckets)) >> _U(40)
    ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=_U))
    rows = []
    for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if y > x:
            delta = np.diff(s[x:y], prepend=_U(0))
            cols = [delta, c[x:y], lo[x:y].view(_U), (hi[x:y] - lo[x:y]).view(_U)]
            rows.append({"bucket": b, "part": part, "n": int(y - x), "data": _pack(cols)})
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("n", pa.int32()), ("data", pa.binary())]))


def _told(columns: list[list[np.ndarray]]) -> Iterator[dict]:
    """What each part must know about its own of these strings, which are all that the table has of their samples."""
    s, c, lo, hi, part = (np.concatenate(columns.pop(0)) for _ in range(5))
    lo, hi = lo.view(np.int64), hi.view(np.int64)
    hi += lo
    order = np.lexsort((c, s))
    s, c, lo, hi, part = s[order], c[order], lo[order], hi[order], part[order]
    new_s = np.r_[True, s[1:] != s[:-1]]
    new = new_s | np.r_[True, c[1:] != c[:-1]]
    at, at_s = np.flatnonzero(new), np.flatnonzero(new_s)
    spread = lambda v, starts: np.repeat(v, np.diff(np.r_[starts, len(s)]))
    first = spread(np.minimum.reduceat(lo, at), at)
    mixed = spread((np.add.reduceat(new.astype(np.int64), at_s) > 1) & (np.minimum.reduceat(lo, at_s) < np.maximum.reduceat(hi, at_s)), at_s)
    tell = (first < hi) | mixed
    order = np.flatnonzero(tell)[np.argsort(part[tell], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else []
    for x, y in zip(bounds, [*bounds[1:], len(order)], strict=False):
        i = order[x:y]
        data = _pack([_key(s[i], c[i]), first[i].view(_U), mixed[i].astype(_U) + (c[i] == _MORE)])
        yield {"part": int(part[i[0]]), "n": len(i), "data": data}


def _sort_bucket(table: pa.Table, buckets: int) -> pa.Table:
    """All parts' strings of one bucket, ``_SORTED`` at a time: what each part must know about its own."""
    bucket, total, rows = table.column("bucket")[0].as_py(), pc.sum(table.column("n")).as_py(), []
    ranges = -(-total // _SORTED)  # of the bucket's samples
    ends = [-(-((bucket * ranges + k) << 40) // (buckets * ranges)) for k in range(ranges + 1)]
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for b in table.to_batches():
            for part, n, data in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("data"), strict=True):
                own = _unpack(data.as_buffer(), n, 4)
                own[0] = np.cumsum(own[0], dtype=_U)
                x, y = np.searchsorted(own[0], np.array([low, high], dtype=_U))
                for to, v in zip(cols, own, strict=False):
                    to.append(v if y - x == n else v[x:y].copy())
                cols[4].append(np.full(y - x, part))
        if any(map(len, cols[0])):
            rows += _told(cols)
    released()
    return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("n", pa.int32()), ("data", pa.binary())]))


def _answers(blocks: DataFrame, name: str, buckets: int) -> str:
    """Sort every bucket; the answers are written in a folder per part."""
    told = blocks.groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, buckets), "part long, n int, data binary")
    path = scratch_path(blocks.sparkSession, name)
    told.repartition("part").write.partitionBy("part").parquet(path)
    return qualified(blocks.sparkSession, path)


def _opened(folder: str):
    """(file system, path) of a folder named by a qualified URI."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class _Known:
    """A part's answers: sorted keys with the first id and whether the sample is mixed; keys of the entries
    for runs that were not sent."""

    def __init__(self, folder: str, part: int):
        from pyarrow import fs
        from pyarrow import parquet as pq

        cols: list[list[np.ndarray]] = [[], [], []]
        system, inner = _opened(folder)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            # a part may have no answers, but their folder is always there: no answers at all would remove nothing
            raise FileNotFoundError(f"{folder} is not visible to this task: spark.checkpoint.dir must be a folder that all tasks can open")
        found = system.get_file_info(fs.FileSelector(f"{inner}/part={part}", allow_not_found=True))
        for info in found:
            if info.base_name.endswith(".parquet"):
                for batch in pq.ParquetFile(system.open_input_file(info.path)).iter_batches(64, columns=["n", "data"]):
                    for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        for x, v in zip(cols, _unpack(data, n, 3), strict=True):
                            x.append(v)
        keys, first, mixed = (np.concatenate(x) if x else np.empty(0, dtype=_U) for x in cols)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, mixed = keys[order], first[order].view(np.int64), mixed[order]
        self.mixed, self.more = mixed > 0, self.keys[mixed > 1]

    def look(self, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts in a smaller document, sample is mixed) of each key."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known & (self.first[at] < ids), known & self.mixed[at]

    def look_runs(self, r: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of each run; one that was not sent is known to have a mixed sample only."""
        gone, mixed = self.look(_key(r.sample, r.content), ids)
        if len(self.more) and len(ids):
            keys = _key(r.sample, _MORE)
            mixed |= self.more[np.minimum(np.searchsorted(self.more, keys), len(self.more) - 1)] == keys
        return gone, mixed


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of (part, id, text) cut where the part changes."""
    for b in batches:
        part = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                yield int(part[x]), b.slice(x, y - x)


class _Slice(NamedTuple):
    """Some whole texts, or a piece of one long text from byte ``start`` on, which overlaps the next
    piece by a byte less than a string's length: every string is in exactly one piece."""

    row: int
    start: int
    whole: np.ndarray  # all bytes of the texts
    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    runs: Runs


def _scanned(b: pa.RecordBatch) -> Iterator[_Slice]:
    """Every slice of a batch of (part, id, text)."""
    ids = b.column(1).fill_null(_LAST).to_numpy()
    for row, data, offsets in slices(b.column(2), _SLICE):
        own = ids[row : row + len(offsets) - 1]
        if len(data) <= _PIECE:
            yield _Slice(row, 0, data, data, offsets, own, Runs(data, offsets))
            continue
        for at in range(0, len(data) - LENGTH + 1, _PIECE):  # only a single text is longer than a slice
            piece = data[at : at + _PIECE + LENGTH - 1]
            ends = np.array([0, len(piece)])
            yield _Slice(row, at, data, piece, ends, own, Runs(piece, ends))


def _sent(batches, found_in, buckets: int, few: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of what ``found_in(part, slice)`` finds: one a part and bucket, more where a part's texts
    are so long that it would hold over ``_HELD`` strings."""
    part, found, held = None, [], 0
    for now, b in _by_part(batches):
        if now != part:
            yield from _blocks(part, found, buckets, few)
            part, found, held = now, [], 0
        for s in _scanned(b):
            found.append(found_in(now, s))
            held += len(found[-1][0])
            if held > _HELD:
                yield from _blocks(part, found, buckets, few)
                found, held = [], 0
    yield from _blocks(part, found, buckets, few)


@lean
def _first_pass(batches, buckets: int):
    yield from _sent(batches, lambda _, s: (s.runs.sample, s.runs.content, s.ids[s.runs.text]), buckets, few=True)


@lean
def _second_pass(batches, buckets: int, runs_path: str):
    last: list = [None, None]

    def heads(part: int, s: _Slice) -> tuple:
        if last[0] != part:
            last[:] = part, _Known(runs_path, part)
        r, own = s.runs, s.ids[s.runs.text]
        gone, mixed = last[1].look_runs(r, own)
        run, _, place, head = r.expanded(np.flatnonzero(mixed & ~gone))
        return place, head, own[run]

    yield from _sent(batches, heads, buckets)


@lean
def _last_pass(batches, runs_path: str, heads_path: str, schema: pa.Schema):
    part, runs, heads, before = None, None, None, None

    def row(id_, data: np.ndarray, hit: np.ndarray) -> dict:
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].view(np.int8)))
        spans = [{"start": int(p), "end": int(q)} for p, q in zip(edge[::2], edge[1::2], strict=True)]
        return {"id": id_, "n_bytes": len(data), "spans": spans, "kept": (data[~hit] if spans else data).tobytes()}

    for now, b in _by_part(batches):
        if now != part:
            part, runs, heads = now, _Known(runs_path, now), _Known(heads_path, now)
        for s in _scanned(b):
            r, own = s.runs, s.ids[s.runs.text]
            gone, mixed = runs.look_runs(r, own)
            run, at, place, head = r.expanded(np.flatnonzero(mixed & ~gone))
            single, _ = heads.look(_key(place, head), own[run])
            cover = np.zeros(len(s.data) + 1, dtype=np.int64)
            np.add.at(cover, r.lo[gone], 1)
            np.add.at(cover, r.lo[gone] + r.n[gone] - 1 + LENGTH, -1)
            np.add.at(cover, at[single], 1)
            np.add.at(cover, at[single] + LENGTH, -1)
            hit = np.cumsum(cover)[:-1] > 0
            if len(s.data) == len(s.whole):
                rows = [row(b.column(1)[s.row + k].as_py(), s.data[x:y], hit[x:y]) for k, (x, y) in enumerate(zip(s.offsets[:-1], s.offsets[1:], strict=True))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                continue
            before = np.zeros(len(s.whole), dtype=bool) if s.start == 0 else before
            before[s.start : s.start + len(s.data)] |= hit
            if s.start + _PIECE > len(s.whole) - LENGTH:  # the text's last piece
                yield pa.RecordBatch.from_pylist([row(b.column(1)[s.row].as_py(), s.whole, before)], schema=schema)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """(id, n_bytes, spans of removed bytes, kept bytes) of every document."""
    part = F.floor(F.monotonically_increasing_id() / F.lit(part_rows)).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # written once: a row's part must be the same in every pass
    path = scratch_path(docs.sparkSession, "parts")
    src.select(part.alias("part"), "id", "text").write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema("part long, id long, text string").parquet(path)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    block = "bucket int, part long, n int, data binary"
    runs_path = _answers(rows.mapInArrow(lambda it: _first_pass(it, buckets), block), "runs", buckets)
    heads_path = _answers(rows.mapInArrow(lambda it: _second_pass(it, buckets, runs_path), block), "heads", buckets)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    out = rows.mapInArrow(lambda it: _last_pass(it, runs_path, heads_path, schema), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    """op8: digest columns of whole ``documents``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed_spans(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
