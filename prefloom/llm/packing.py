"""Best-fit packing of token sequences, planned on the length histogram.

1. Each document's ids are cut into pieces of at most ``capacity`` tokens (only longer
   documents are cut). Lengths, checksums and keys are written to the shared folder.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the corpus. The
   driver runs best-fit decreasing over its *counts*: sequences of equal free space are
   handled as one range, so the plan is a list of (length, first rank, sequences, ...) ranges.
3. A piece's rank within its length (two-level, no task holds a whole length) is looked up in
   the plan: that gives its sequence and offset.

The plan is broadcast. Its size does not depend on the corpus: every length splits at most
one range and opens at most two, so at most 3 * capacity ranges of sequences exist, and a sequence
holds at most sqrt(2 * capacity) distinct lengths (64 for 2048).

Defined results: a null or empty text is one piece of length 1 (the end id); repeated rows
and repeated or null ids are packed row by row; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import held, lean, two_level_rank, written

CAPACITY = 2048
#: texts of these characters only are cut at white space, and every part is tokenized once per
#: worker: the tokenizer's words never hold white space, and for these characters its
#: normalisation is lower-casing. Everything else, and texts that may hold a special token,
#: go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ÿ]*")
# fixed value: the tokenizer's own word pattern
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CACHE_ENTRIES = 400_000  # in each of two generations


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order,
    for the code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class _Encoder:
    """The tokenizer of a file, with the ids of parts and words seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is used again moves up

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the tokenizer's pattern."""
        if (ids := self.known.get(word)) is None:
            if (ids := self.older.get(word)) is not None:
                self.known[word] = ids
                return ids
            own = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.known[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(own)])
        return ids

    def plain(self, text: str) -> bytes:
        if len(self.known) > _CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        parts = text.lower().split()
        for p in [p for p in parts if p not in known]:
            if p in older:
                known[p] = older[p]
            elif p.isalpha():  # letters only: one word
                self._word(p)
            else:
                known[p] = b"".join(map(self._word, _WORDS.findall(p)))
        return b"".join(map(known.__getitem__, parts))


def token_bytes(texts: list[str | None], path: str, end_id: int = 0) -> Iterator[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit integers."""
    encoder = held(("encoder", path), lambda: _Encoder(path))
    end = end_id.to_bytes(4, "little")
    for text in texts:
        text = text or ""
        if "<|" in text or not _PLAIN.fullmatch(text):
            yield encoder.whole(text) + end
        else:
            yield encoder.plain(text) + end


def pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32), and with ``ids`` the piece's ids as bytes."""
    key_field = f"`{key}` {dict(docs.dtypes)[key]}"
    step = 4 * capacity

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            rows: list[list] = [[], [], [], [], [], []]
            for i, buf in enumerate(token_bytes(b.column(text_col).to_pylist(), tokenizer_path)):
                for k, at in enumerate(range(0, len(buf), step)):
                    part = buf[at : at + step]
                    for col, v in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None), strict=True):
                        col.append(v)
            cols = [b.column(key).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
            cols += [pa.array(c, pa.int64()) for c in rows[2:5]] + ([pa.array(rows[5], pa.binary())] if ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"{key_field}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    names = [key, "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    return docs.select(key, text_col).mapInArrow(run, schema)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, ranks, pieces per sequence,
    first sequence, offset). Ranks ``first + i`` of a length go to sequence ``first sequence
    + i // per`` at ``offset + (i % per) * length``."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first sequence, sequences)
    sizes: list[int] = []  # the keys of free, sorted
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                bisect.insort(sizes, space)
                free[space] = []
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):  # the tightest sequences that fit
                space = sizes[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    sizes.pop(at)
            else:
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = space // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, per, first, capacity - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # one sequence takes fewer than it could
                plan.append((length, rank, left, left, first + full, capacity - space))
                put(space - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(space, first + full, n - full)
    return plan


def place(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a written table of pieces with a column ``salt``) with sequence_id and offset."""
    sc = cut.sparkSession.sparkContext
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most `capacity` rows
    plan = np.array(best_fit_plan(histogram, capacity) or np.empty((0, 6)), dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    known = sc.broadcast(plan)
    buckets = F.floor(F.sqrt("n")).cast("long") + 1
    bucketed = cut.join(F.broadcast(counts.select("length", buckets.alias("_buckets"))), "length")
    bucketed = bucketed.withColumn("_b", F.pmod("salt", "_buckets")).drop("_buckets")
    ranked = two_level_rank(bucketed, ["length"], "_b", ["salt", key, "piece"], "_rank").drop("_b", "salt")
    own = [f for f in ranked.schema.fields if f.name != "_rank"]

    @lean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = known.value
        bits = np.int64(48)
        starts = (rows[:, 0] << bits) | rows[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "_rank"))
            row = rows[np.searchsorted(starts, (length << bits) | rank, "right") - 1]
            i = rank - row[:, 1]
            sequence, offset = row[:, 4] + i // row[:, 3], row[:, 5] + (i % row[:, 3]) * length
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in own], pa.array(sequence), pa.array(offset)],
                                             names=[*[f.name for f in own], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its place: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, tokenizer_path, key, text_col, capacity)
    # the salt only spreads rows over buckets; writing it makes it the same in every later read
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)))
    return place(written(salted, "pieces"), key, capacity)


def sequences(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, its tokens, and the key, offset and
    length of every piece in it. A group is one sequence, at most ``capacity`` tokens."""
    cut = pieces(docs, tokenizer_path, key, text_col, capacity, ids=True)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)))
    placed = place(written(salted, "piece-ids"), key, capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(key).alias("key"), "piece", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("p"))
    hexes = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    words = F.transform(F.sequence(F.lit(0), (F.length(hexes) / 8 - 1).cast("int")), lambda i: F.substring(hexes, i * 8 + 1, F.lit(8)))
    little = lambda w: F.conv(F.concat(*[F.substring(w, a, 2) for a in (7, 5, 3, 1)]), 16, 10).cast("int")
    return grouped.select("sequence_id", F.transform(words, little).alias("tokens"),
                          F.transform("p", lambda x: F.struct(x["key"].alias("key"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    """op1: whole ``documents`` in sequences of at most 2048 tokens."""
    return pack(docs, default_tokenizer())
