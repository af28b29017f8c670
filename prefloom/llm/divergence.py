"""Source divergence audit: how the term distributions of the sources of a language differ.

Terms are runs of letters (every character beyond ASCII counts as one), A-Z lowered. A language
keeps its terms with ``least_docs`` documents; V is their number. A (language, source) group, or
the language itself, gives a kept term with ``count`` occurrences the share
p = 1 + floor(1e9 * (count + 5) / (N + 5 V)), N its occurrences of kept terms. Two sources differ
by the sum of abs(p - q) over all kept terms; a term marks a source by p - q against its language.

1. Tasks count their texts' terms by group and give counts on as they grow; one aggregation adds
   them, another finds the kept terms. Terms get ids in the order of frequency, so that
   neighbouring ids have similar counts.
2. Count-level bitmaps: a table holds, per (group, count), the set of term ids with that count, as
   64-bit words (``block`` = id / 64). A group has few levels in a block.
3. For two groups, AND and population count of the words of a block give the number of terms in
   each joint cell (count in the one, count in the other). Each cell is multiplied by its abs(p - q).
4. Cells with a zero are the complement: terms at level c of the one less those that met a level
   of the other. With z the share of count 0, a pair's value is
   V |z1 - z2| + sum over levels n1 (|p1 - z2| - |z1 - z2|) + the same from the other side
   + sum over joint cells n (|p1 - p2| - |p1 - z2| - |z1 - p2| + |z1 - z2|),
   so only cells without a zero are ever joined.

All sums are of whole numbers; shares are divided as 38-digit decimals. Nothing is gathered by
group or language: levels meet within a block, which has at most 64 rows a group, and the best
terms of a group are limited on the map side before they are moved.

Defined results: null text, language and source are read as ''; every row is a document of its own, also
under a repeated or null id; an empty text, or one without terms, still makes its group occur; very long texts are
counted whole, each with its words in memory; a language without kept terms has pair
values of 0 and no terms; a group alone in its language has no pairs; ties go by the item's UTF-8
bytes; an empty table gives no rows. Columns but the three named are not read, so none can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import lean, root_buckets, two_level_rank, written

LEAST_DOCS = 30
PRIOR = 5
UNIT = 1_000_000_000
TOP = 50
#: entries a task holds before it gives its counts on
_HELD_TERMS = 400_000
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SCHEMA = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs) of ``docs`` (lang, source, text), without nulls."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in seen.items():
                words = list(n)
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([n[w] for w in part], pa.int64()), pa.array([in_docs[w] for w in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(k) for k in range(3)), strict=True):
                n, in_docs = seen.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                words = terms(text.as_py())
                n.update(words)
                in_docs.update(set(words))
                if sum(len(x) for x, _ in seen.values()) > _HELD_TERMS:
                    yield from counted()
        yield from counted()

    parts = docs.mapInArrow(run, _SCHEMA)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, exactly; null without kept terms."""
    over = (count + PRIOR).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = (total + PRIOR * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", over, under) + 1)


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, id): kept terms with ids by falling frequency, gapless from 0."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = written(kept.drop("docs"), "kept-terms")
    # classes of frequency, each in parts by a hash: no task ranks a whole language
    parts = root_buckets(kept.count()) // 8 + 1
    falling = -F.floor(16 * F.log2(F.col("total").cast("double")))
    kept = kept.withColumn("bucket", falling * parts + F.pmod(F.xxhash64("term"), F.lit(parts)))
    return two_level_rank(kept, ["lang"], "bucket", [F.desc("total"), F.asc("term")], "id").drop("bucket")


def levels(counts: DataFrame) -> DataFrame:
    """The bitmaps: (lang, block, source, n, bits) of ``counts`` (lang, source, id, n)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    return counts.groupBy("lang", F.shiftright("id", 6).alias("block"), "source", "n").agg(F.bit_or(bit).alias("bits"))


def pair_values(levels: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language; ``levels`` (lang, block,
    source, p, z, bits) and ``groups`` (lang, source, z, v)."""
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    x, y = levels.alias("x"), levels.alias("y")
    cells = x.join(y.hint("merge"), ["lang", "block"]).filter("x.source < y.source").select(
        "lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.bit_count(F.col("x.bits").bitwiseAND(F.col("y.bits"))).cast("long").alias("n"),
        (gap("x.p", "y.p") - gap("x.p", "y.z") - gap("x.z", "y.p") + gap("x.z", "y.z")).alias("f"))
    cells = cells.filter("n > 0").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * F.col("f")).alias("value"))
    cells = written(cells, "joint-cells")

    sizes = levels.groupBy("lang", "source", "p", "z").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other"))
    alone = written(sizes, "level-sizes").join(others, "lang").filter("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("n") * (gap("p", "other") - gap("z", "other"))).alias("value"))
    pairs = groups.select("lang", "source", "z", "v").join(others, "lang").filter("source <> item")
    none = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * gap("z", "other"), F.lit(0)).alias("value"))
    a, b = F.col("a"), F.col("b")
    both = [cells.select("lang", s.alias("source"), t.alias("item"), "value") for s, t in ((a, b), (b, a))]
    turned = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    every = none.union(alone).union(turned).union(both[0]).union(both[1])
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' with every other source of the
    language, part 'term' with the ``top`` terms that mark the source."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counts = written(term_counts(docs), "term-counts")
    kept = written(_kept(counts, least_docs), "term-ids")
    # none of these tables has a proven bound; as written tables their joins can be split where a key is hot
    own = counts.select("lang", "source", "term", "n").join(kept.hint("merge"), ["lang", "term"])
    own = written(own, "kept-counts")

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["v", "lang_n", "group_n"])
    groups = written(groups.withColumn("z", _share(F.lit(0).cast("long"), F.col("group_n"), F.col("v"))), "groups")

    bits = levels(own).join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_n"), F.col("v")))
    bits = written(bits.select("lang", "block", "source", "p", "z", "bits"), "level-bitmaps")
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pair_values(bits, groups).withColumn("rank", best)

    marks = own.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (_share(F.col("n"), F.col("group_n"), F.col("v")) - _share(F.col("total"), F.col("lang_n"), F.col("v"))).alias("value"))
    marks = marks.filter("value > 0").withColumn("rank", best).filter(F.col("rank") <= top)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").union(out(marks, "term"))


def query(docs: DataFrame) -> DataFrame:
    """op13: divergence of all sources of ``documents``."""
    return audit(docs)


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, doc, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS total FROM o GROUP BY lang, t HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS c FROM o JOIN k USING (lang, t) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.t, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (coalesce(n.n, 0) + 5 * l.v)::HUGEINT AS p,
             1 + (1000000000 * (k.total + 5)::HUGEINT) // (l.n + 5 * l.v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', t, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
