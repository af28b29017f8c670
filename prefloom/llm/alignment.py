"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentencepiece model (B)
cover the same bytes.

A encodes a space and the text, B the text (it adds the space itself). Byte offsets at which a token of
each ends cut both sequences into groups; the tokens that end there are linked. A pair's
count is the number of its links in the corpus; its best partners are a B id's highest counts.

1. Coarse cuts: A's tokens have character offsets, and so have B's (``offset_mapping``: the spans
   that older sentencepiece releases give by the immutable proto, which the installed one no longer has). Where all
   characters of a part are single bytes these are the tokens' byte ends.
2. Refinement: a part with multibyte characters, which byte-level and byte-fallback tokens may
   split, takes its ends from the decoded bytes of the tokens. The joined bytes of both are
   compared with the text; a text that one of them changes has no tokens.
3. Texts are cut before a space that follows anything but white space: A's word pattern always
   begins a word there, and no merge of B crosses it if no piece has a space after
   another character (looked up in the vocabulary; otherwise texts go whole). Every distinct
   part is aligned once per worker (``_CACHE_ENTRIES``, two generations), with the marks at its
   end apart if no piece of B joins a letter with a mark (A's pattern never does).
4. Each document keeps its distinct pairs with their number, in a table in the shared folder.
   Pairs are counted over all documents from it, and counts come back to the documents in
   blocks of at most ``BLOCK`` pairs, each broadcast, used and released before the next.

Defined results: null and empty texts, and texts whose joined bytes differ, have zeros and no hash; very
long texts are aligned whole, part by part, with their tokens' ids in memory; rows repeated under
one id, and null ids, stay rows of their own and each count; an empty table gives an empty one. Other columns
are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import held, lean, written

#: pairs of ids in one broadcast block (24 bytes each)
BLOCK = 1 << 21
_CACHE_ENTRIES = 500_000  # in each of two generations
_ROWS = 256
_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= .)", re.S)
_SPACE = "▁"
_MARKS = "!#$%&()*,./:;?|-"
#: a part that ends in ASCII marks after an ASCII or Latin letter, and pieces that would join the two
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_TAILED = re.compile(rf"(.*[{_LETTERS}])([{re.escape(_MARKS)}]{{1,8}})", re.S)
_MIXED = re.compile(rf"[{_LETTERS}][{re.escape(_MARKS)}]")
_TOGETHER = 5000


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order,
    for the code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, the bytes of their ids, and the parts aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        letters = _byte_of()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.is_byte = [self.b.is_byte(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte else p.replace(_SPACE, " ").encode() for p, byte in zip(names, self.is_byte, strict=True)]
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in names)
        self.marks = self.cuts and not any(_MIXED.search(p) for p, byte in zip(names, self.is_byte, strict=True) if not byte)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.tails: dict[str, tuple | None] = {}

    def _ends(self, ids: np.ndarray, sizes: np.ndarray, part: np.ndarray, spans: list[int], plain: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Byte ends of the tokens of consecutive parts: the spans where all characters are single
        bytes, elsewhere refined by the decoded bytes."""
        return np.where(plain[part], base[part] + np.array(spans, dtype=np.int64), np.cumsum(sizes[ids]))

    def encoded(self, parts: list[str]) -> list[tuple | None]:
        """(tokens of A, tokens of B, groups, links, their number) of every part, given without the space
        it begins with; None where a tokenizer changes its bytes."""
        texts = [" " + p for p in parts]
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        of_b = self.b.encode(parts, return_type="offset_mapping", num_threads=1)
        own_a, own_b, raw = [e.ids for e in of_a], [e["ids"] for e in of_b], [t.encode() for t in texts]
        good = [b"".join([self.bytes_a[i] for i in x]) == r and b"".join([self.bytes_b[i] for i in y]) == r for x, y, r in zip(own_a, own_b, raw, strict=True)]
        if not all(good):
            kept = iter(self.encoded([p for p, g in zip(parts, good, strict=True) if g])) if any(good) else None
            return [next(kept) if g else None for g in good]
        n_a, n_b = [len(x) for x in own_a], [len(y) for y in own_b]
        ids_a, ids_b = (np.array(list(chain.from_iterable(x)), dtype=np.int64) for x in (own_a, own_b))
        part_a, part_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
        stop = np.cumsum([len(r) for r in raw])
        base = np.r_[0, stop[:-1]]
        plain = np.array([t.isascii() for t in texts])
        ends_a = self._ends(ids_a, self.sizes_a, part_a, [e for x in of_a for _, e in x.offsets], plain, base)
        ends_b = self._ends(ids_b, self.sizes_b, part_b, [e + 1 for x in of_b for _, e in x["offsets"]], plain, base)
        ends, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)

        links = ids_a[at_a] * self.size_b + ids_b[at_b]
        upto = np.r_[0, np.searchsorted(ends, stop, "right")]  # groups before each part's end
        data = links.tobytes()
        # every token's text with what follows it, A's before B's in each group
        group = [np.searchsorted(at, np.arange(len(ids))) for at, ids in ((at_a, ids_a), (at_b, ids_b))]
        after = [np.zeros(len(ids), dtype=np.int64) for ids in (ids_a, ids_b)]
        after[0][at_a] = 1
        after[1][at_b] = 2
        after[1][at_b[upto[1:] - 1]] = 3
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        mark = [",", "|", ";", "\n"]
        pieces = [f"{i}{mark[m]}" for i, m in zip(np.concatenate([ids_a, ids_b])[order].tolist(), np.concatenate(after)[order].tolist(), strict=True)]
        groups = "".join(pieces).encode().split(b"\n")
        cut = upto.tolist()
        return [(a, b, g, data[8 * x : 8 * y], y - x) for a, b, g, x, y in zip(n_a, n_b, groups, cut, cut[1:], strict=False)]

    def parts(self, text: str) -> list[str]:
        """The text's parts, each without the space it begins with."""
        if not self.cuts:
            return [text]
        if text[:1] != " " and text[-1:] != " " and not _ODD.search(text):
            return text.split(" ")
        return [p[1:] for p in _CUT.split(" " + text)]

    def _with_tail(self, core: tuple | None, tail: str) -> tuple | None:
        """A part from its core, which ends in a letter, and the marks after it: neither tokenizer
        joins a letter with a mark."""
        if tail not in self.tails:
            if (found := self.encoded(["a" + tail])[0]) is not None:  # without the group of its first letter
                n_a, n_b, groups, links, n = found
                found = (n_a - 1, n_b - 1, groups.partition(b";")[2], links[8:], n - 1)
            self.tails[tail] = found
        end = self.tails[tail]
        return core and end and (core[0] + end[0], core[1] + end[1], core[2] + b";" + end[2], core[3] + end[3], core[4] + end[4])

    def learn(self, parts: set[str]) -> None:
        """Align the parts that are not known yet."""
        if len(self.known) > _CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new, tailed = set(), []
        for p in parts:
            if p in known:
                continue
            if p in older:
                known[p] = older[p]
            elif self.marks and (m := _TAILED.fullmatch(p)):
                tailed.append((p, m[1], m[2]))
                if m[1] not in known:
                    if m[1] in older:
                        known[m[1]] = older[m[1]]
                    else:
                        new.add(m[1])
            else:
                new.add(p)
        new = list(new)
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            known.update(zip(some, self.encoded(some), strict=True))
        for p, core, tail in tailed:
            known[p] = self._with_tail(known[core], tail)

    def aligned(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """The parts' alignments of every text, None for a text without tokens."""
        parts = [self.parts(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        known, out = self.known, []
        for text, own in zip(texts, parts, strict=True):
            found = [known[p] for p in own]
            if None in found:  # decided by the whole text
                whole = self.encoded([text])[0]
                found = [] if whole is None else [whole]
            out.append(found or None)
        return out


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def aligned_documents(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) per row, and with ``groups`` the
    groups themselves; a pair is A's id times B's vocabulary size plus B's id."""
    empty = (0, 0, b"", b"", 0)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("aligner", paths), lambda: Aligner(*paths))
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            rows, texts, pairs, times = [], [], [], []
            for found in aligner.aligned(b.column(1).to_pylist()):
                n_a, n_b, own, links, n = zip(*(found or [empty]), strict=True)
                own = b";".join(own)
                pair, time = np.unique(np.frombuffer(b"".join(links), dtype=np.int64), return_counts=True)
                rows.append((sum(n_a), sum(n_b), sum(n), sum(n), hashlib.sha256(own).hexdigest() if found else ""))
                texts.append(own)
                pairs.append(pair)
                times.append(time)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            cols = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]] + [pa.array([r[4] for r in rows], pa.string())]
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int64))) for x in (pairs, times)]
            out = [b.column(0), *cols, *lists, *([pa.array(texts, pa.binary()).cast(pa.string())] if groups else [])]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"id long, {_COUNTS}, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * groups
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * groups]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of a batch, and where each row's begin (with the end)."""
    pairs, times = b.column(b.schema.get_field_index("pairs")), b.column(b.schema.get_field_index("times"))
    ends = pairs.offsets.to_numpy()
    return pairs.flatten().to_numpy(), times.flatten().to_numpy(), ends - ends[0]


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of every pair in all documents, and whether no other pair of its B
    id has more."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

        for b in batches:
            pair, times, _ = _flat(b)
            both, at = np.unique(np.concatenate([keys, pair]), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, at, np.concatenate([sums, times]))
            keys, sums = both, total
            if len(keys) > BLOCK:
                yield counted()
                keys, sums = keys[:0], sums[:0]
        yield counted()

    n = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = written(n, "pair-counts")
    b = F.pmod("pair", F.lit(size_b))
    most = n.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most one row per id of B
    return n.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum in place of its pairs."""
    spark = aligned.sparkSession
    counts = written(counts, "pair-ranks")
    blocks = max(1, -(-counts.count() // BLOCK))
    out = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        block = counts if blocks == 1 else counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)
        t = block.toArrow()  # about BLOCK rows
        keys = t.column("pair").to_numpy()
        order = np.argsort(keys)
        known = spark.sparkContext.broadcast((keys[order], t.column("n").to_numpy()[order], t.column("best").to_numpy()[order]))

        @lean
        def add(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            keys, n, best = known.value
            for b in batches:
                pair, times, ends = _flat(b)
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
                at, times = at[hit], times[hit]
                upto = np.concatenate([[0], np.cumsum(hit)])[ends]
                sums = [np.concatenate([[0], np.cumsum(x)])[upto] for x in (times * best[at], times * n[at])]
                names = b.schema.names
                for name, s in zip(("n_best", "count_sum"), sums, strict=True):
                    i = names.index(name)
                    b = b.set_column(i, name, pa.array(b.column(i).to_numpy() + np.diff(s)))
                yield b

        out = out.mapInArrow(add, out.schema)
        if k + 1 < blocks:
            out = written(out, "alignment-block")
            known.unpersist()
    return out.drop("pairs", "times")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """Alignment of every row of ``docs``: counts, best links, count sums, hash (and ``groups``)."""
    import sentencepiece

    paths = paths or default_paths()
    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    aligned = written(aligned_documents(docs, paths, id_col, text_col, groups), "alignments")
    out = with_counts(aligned, pair_counts(aligned, size_b)).withColumnRenamed("id", id_col)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)


def query(docs: DataFrame) -> DataFrame:
    """op11: alignment of whole ``documents``."""
    return align(docs)
