"""Near-duplicate records with small edits, by anchor-point covering (problem 6).

A record's fingerprint is a word of min-hash symbols over the integers modulo 2^32, cut into
blocks of ``span`` symbols. The anchors of a block are the code words of the single
parity-check code of that length: all words whose symbols add up to 0. It is a maximum
distance separable code of covering radius 1, since replacing any one symbol gives a code
word, and each word lies within the radius of exactly ``span`` anchors. A block is replicated
to all of them. The threshold of a block is one symbol: of two blocks that differ in at most
one, replacing that symbol gives a code word within the radius of both, so they meet. (With so
many values a symbol, replicating within radius plus threshold would mean 2^32 anchors; that
the radius is enough for a threshold as large as the radius is what the code is chosen for.)
Records that meet in any block are compared on a 96-bit sketch there, survivors on a wider
one and then exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import words
from siltstone.runtime import settle

SYMBOLS = 32
MIX = 0x85EBCA6B  # odd; a sketch's bits must not follow from the size of a minimum
#: One in each eight bits.
_BYTES = 0x0101010101010101


def _shingles(offsets: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words of each list, and the lists' bounds in them."""
    sizes = np.maximum(np.diff(offsets) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - offsets[:-1], sizes)
    mixed = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            mixed = (mixed ^ hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return mixed, bounds


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signatures(width: int, symbols: int, seed: int):
    """Arrow batches with ``_words`` (word hashes) to batches with ``_symbols`` (32 bits each) and
    ``_sketch``, ``_more``: three bits of each symbol, two planes in a long and one in an int."""
    draw = np.random.default_rng(seed).integers(1, 2**63, (2, symbols), dtype=np.int64).view(np.uint64)
    factors, shifts = draw[0] | np.uint64(1), draw[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, hashes = _lists(batch.column("_words"))
            mixed, bounds = _shingles(offsets, hashes, width)
            some = np.flatnonzero(np.diff(bounds))
            out = np.empty((len(some), symbols), np.uint32)
            if len(some):
                with np.errstate(over="ignore"):
                    for k in range(symbols):
                        out[:, k] = np.minimum.reduceat((mixed * factors[k] + shifts[k]) >> np.uint64(32), bounds[:-1][some])
            planes = [np.packbits((out * np.uint32(MIX) >> np.uint32(31 - i)).astype(np.uint8) & 1, axis=1).view(np.uint32).ravel() for i in range(3)]
            sketch = planes[0].astype(np.uint64) << np.uint64(32) | planes[1]
            kept = batch.take(pa.array(some)).drop_columns(["_words"])
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * symbols), pa.array(out.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sketch.view(np.int64)), pa.array(planes[2].view(np.int32)), each], names=[*kept.schema.names, "_sketch", "_more", "_symbols"]
            )

    return run


def _similarities(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("_words_a", "_words_b"):
                offsets, hashes = _lists(batch.column(name))
                sides.append(_shingles(offsets, hashes, width))
            (left, lb), (right, rb) = sides
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                a, b = np.unique(left[lb[i] : lb[i + 1]]), np.unique(right[rb[i] : rb[i + 1]])
                both = len(np.intersect1d(a, b, assume_unique=True))
                out[i] = both / max(1, len(a) + len(b) - both)
            kept = batch.drop_columns(["_words_a", "_words_b"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out)], names=[*kept.schema.names, "similarity"])

    return run


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _anchors(symbols: Column, blocks: int, span: int) -> Column:
    """The code words within radius 1 of each block: one symbol replaced so that the sum is 0."""
    out = []
    for b in range(blocks):
        word = [symbols[b * span + i].cast("long") for i in range(span)]
        total = sum(word[1:], word[0])
        for i in range(span):
            near = [((x - total) if j == i else x).bitwiseAND(F.lit(0xFFFFFFFF)) for j, x in enumerate(word)]
            out.append(F.xxhash64(F.lit(b), *near))
    return F.array(*out)


def agreement(a: Column, more_a: Column, b: Column, more_b: Column) -> Column:
    """Of the 32 three-bit symbols of two sketches, how many are equal."""
    two = a.bitwiseXOR(b)
    differs = two.bitwiseOR(F.shiftrightunsigned(two, 32)).bitwiseOR(more_a.bitwiseXOR(more_b).cast("long"))
    return F.lit(SYMBOLS) - F.bit_count(differs.bitwiseAND(F.lit(0xFFFFFFFF)))


def wide_sketch(symbols: Column) -> Column:
    """Eight bits of each of the 32 symbols, in four longs."""
    bits = [F.shiftrightunsigned(symbols[i].cast("long") * MIX, 16).bitwiseAND(F.lit(0xFF)) for i in range(SYMBOLS)]
    longs = []
    for i in range(0, SYMBOLS, 8):
        packed = bits[i]
        for j in range(1, 8):
            packed = packed.bitwiseOR(F.shiftleft(bits[i + j], 8 * j))
        longs.append(packed)
    return F.array(*longs)


def wide_agreement(a: Column, b: Column) -> Column:
    """Of the 32 eight-bit symbols of two wide sketches, how many are equal."""
    out = F.lit(SYMBOLS)
    for i in range(SYMBOLS // 8):
        differs = a[i].bitwiseXOR(b[i])
        for step in (4, 2, 1):
            differs = differs.bitwiseOR(F.shiftrightunsigned(differs, step))
        out = out - F.bit_count(differs.bitwiseAND(F.lit(_BYTES)))
    return out


def enough(threshold: float, bits: int, span: int, deviations: float) -> int:
    """Symbols of ``bits`` bits that must agree: some standard deviations below the expectation
    for a pair at the threshold that met at an anchor, of which ``span - 1`` agree anyway."""
    p = threshold + (1 - threshold) / 2**bits
    free = SYMBOLS - span + 1
    return int(np.floor(span - 1 + free * p - deviations * np.sqrt(free * p * (1 - p))))


def _meeting(rows: DataFrame, key: str, item: str, alike: Column, cell_rows: int, detect: int = 16, most_broadcast: int = 1_000_000) -> DataFrame:
    """Pairs a, b of rows of different ``item`` with the same ``key`` for which ``alike`` holds, each once, in either order.

    Keys with over ``cell_rows`` rows are found on the items of one in ``detect`` hashes (a key
    just above may be missed, which costs time alone). Their rows are dealt to parts of about
    that size, and each two parts, or a part with itself, meet in a cell: a task's share of a
    hot key is ``cell_rows`` squared, however many rows it has, and a row is copied once a part.
    """
    some = rows.where(F.pmod(F.xxhash64(F.lit(detect), item), F.lit(detect)) == 0)
    size = F.count("*") * detect
    hot = settle(some.groupBy(key).agg(size.alias("_size")).where(F.col("_size") > cell_rows).select(key, F.ceil(F.col("_size") / cell_rows).cast("int").alias("_parts")), "hot")
    many = hot.count()  # at most rows / cell_rows
    if not many:
        a, b = rows.alias("a"), rows.alias("b")
        return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")) & alike)
    parts = rows.join(F.broadcast(hot) if many <= most_broadcast else hot, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = parts.withColumn("_part", F.pmod(F.xxhash64(item), F.col("_parts")).cast("int"))
    a = dealt.withColumn("_i", F.col("_part")).withColumn("_j", F.explode(F.sequence("_part", F.col("_parts") - 1))).alias("a")
    b = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), "_part"))).withColumn("_j", F.col("_part")).alias("b")
    # within a part both orders meet, between two parts only one
    once = (F.col(f"a.{item}") < F.col(f"b.{item}")) | ((F.col("a._i") < F.col("a._j")) & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & once & alike)


def near_duplicates(
    records: DataFrame,
    *,
    id_col: str,
    text_col: str,
    keep: list[str] | None = None,
    width: int = 5,
    threshold: float = 0.8,
    blocks: int = 7,
    span: int = 4,
    cell_rows: int = 4096,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records whose sets of ``width`` words have a Jaccard similarity of ``threshold``.

    ``members``: id, the ``keep`` columns and ``class_id``; records with the same words in the
    same order form one class (by a 64-bit hash of them, which unequal texts share by chance
    only among billions), so that a text repeated in a third of all rows is compared once. ``links``: class_a < class_b with their exact ``similarity``; no pair within a class
    is put out (it is 1). Copies are never expanded into pairs here.

    A pair at the threshold of 0.6 meets at an anchor with probability 0.989 with 7 blocks of
    4 (0.65: 0.997; 0.7: over 0.999) and passes the sketches with 0.995 (0.999; 1); both grow
    with the similarity. ``blocks`` and ``span`` trade that against the replication,
    blocks x span anchors a record. No bucket is capped and no partner is dropped: an anchor
    with over ``cell_rows`` fingerprints, as that of a template with many variants, is split
    into parts of that size, and every two parts are compared by a task of their own.

    Null texts and texts of fewer than ``width`` words have no fingerprint and take no part.
    Repeated rows give repeated members, ties do not arise, an empty table gives empty
    results, and very long texts are read whole. Input columns other than the named ones are
    not touched, whatever their names.
    """
    if blocks * span > SYMBOLS:
        raise ValueError(f"at most {SYMBOLS} symbols")
    coarse, fine = enough(threshold, 3, span, 3.0), enough(threshold, 8, span, 3.0)
    keep = keep or []
    base = records.where(F.col(text_col).isNotNull()).select(F.col(id_col), *keep, F.col(text_col).alias("_text"), F.xxhash64(id_col, text_col).alias("_row"))
    hashed = base.withColumn("_words", _word_hashes(F.col("_text"))).withColumn("class_id", F.xxhash64("_words"))
    narrow = hashed.select(id_col, *keep, "_row", "class_id", "_words")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    signed = settle(narrow.mapInArrow(_signatures(width, SYMBOLS, seed), f"{kinds}, _sketch long, _more int, _symbols array<int>"), "fingerprints")
    members = signed.select(id_col, *keep, "class_id")

    # fingerprints, not records, are replicated: copies and texts with equal ones go once
    prints = signed.groupBy("_sketch", "_more").agg(F.first("_symbols").alias("_symbols"))
    sent = prints.select("_sketch", "_more", F.explode(_anchors(F.col("_symbols"), blocks, span)).alias("_anchor"))
    alike = agreement(F.col("a._sketch"), F.col("a._more"), F.col("b._sketch"), F.col("b._more")) >= coarse
    met = _meeting(sent, "_anchor", "_sketch", alike, cell_rows)
    met = met.select(F.least("a._sketch", "b._sketch").alias("_sa"), F.greatest("a._sketch", "b._sketch").alias("_sb")).distinct()
    one = F.min_by(F.struct("_sketch", "_row", wide_sketch(F.col("_symbols")).alias("_wide")), "_row")
    classes = settle(signed.groupBy("class_id").agg(one.alias("_c")).select("class_id", "_c.*"), "classes")
    # classes behind the fingerprints; those with the same first planes meet without an anchor
    behind = classes.select("_sketch", "class_id", "_wide")
    close = wide_agreement(F.col("a._wide"), F.col("b._wide")) >= fine
    same = _meeting(behind, "_sketch", "class_id", close, cell_rows).select(F.col("a.class_id").alias("_ca"), F.col("b.class_id").alias("_cb"))
    across = met.join(behind.alias("a"), F.col("_sa") == F.col("a._sketch")).join(behind.alias("b"), F.col("_sb") == F.col("b._sketch")).where(close)
    pairs = across.select(F.col("a.class_id").alias("_ca"), F.col("b.class_id").alias("_cb")).unionByName(same)
    pairs = settle(pairs.select(F.least("_ca", "_cb").alias("class_a"), F.greatest("_ca", "_cb").alias("class_b")), "met")
    involved = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    chosen = settle(classes.select("class_id", "_row").join(involved, "class_id", "left_semi"), "chosen")  # two longs a class, so that texts may stay where they are
    texts = chosen.join(base.select("_row", "_text"), "_row").select("class_id", "_text").dropDuplicates(["class_id"])
    both = (
        pairs.join(texts.select(F.col("class_id").alias("class_a"), F.col("_text").alias("_text_a")), "class_a")
        .join(texts.select(F.col("class_id").alias("class_b"), F.col("_text").alias("_text_b")), "class_b")
        .select("class_a", "class_b", _word_hashes(F.col("_text_a")).alias("_words_a"), _word_hashes(F.col("_text_b")).alias("_words_b"))
    )
    links = both.mapInArrow(_similarities(width), "class_a long, class_b long, similarity double").where(F.col("similarity") >= threshold)
    return members, settle(links, "links")


def duplicate_pairs(members: DataFrame, links: DataFrame, *, id_col: str, apart: str) -> DataFrame:
    """The pairs of records (``<id>_a`` < ``<id>_b``) of different ``apart`` behind the links, copies included."""
    sides = links.select("class_a", "class_b")
    a = members.select(F.col("class_id").alias("class_a"), F.col(id_col).alias("_ia"), F.col(apart).alias("_da")).distinct()
    b = members.select(F.col("class_id").alias("class_b"), F.col(id_col).alias("_ib"), F.col(apart).alias("_db")).distinct()
    across = sides.join(a, "class_a").join(b, "class_b")
    within = a.join(b.withColumnRenamed("class_b", "class_a"), "class_a").where(F.col("_ia") < F.col("_ib"))
    pairs = across.select("_ia", "_da", "_ib", "_db").unionByName(within.select("_ia", "_da", "_ib", "_db"))
    return (
        pairs.where((F.col("_da") != F.col("_db")) & (F.col("_ia") != F.col("_ib")))
        .select(F.least("_ia", "_ib").alias(f"{id_col}_a"), F.greatest("_ia", "_ib").alias(f"{id_col}_b"))
        .distinct()
    )
