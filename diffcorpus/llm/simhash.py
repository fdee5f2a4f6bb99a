"""SimHash near-duplicates: pigeonhole blocks on 64-bit fingerprints, then components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .components import connected_components
from .stages import stage, unused

SEED = 42
#: A fingerprint is split where it holds more than one of this many parts of all rows, so fewer than this many are.
PARTS = 1000


def _fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """Signed 64-bit fingerprint per text; a bit is set when set in over half of the shingle hashes."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, text in enumerate(texts):
        ws = text.lower().split()  # bytes: A-Z only, ASCII white space only
        if len(ws) > shingle:
            got = [digest(join(g), SEED) for g in zip(*(ws[k:] for k in range(shingle)))]
        else:
            got = [digest(join(ws), SEED)] if ws else []
        hashes += got
        sizes[i] = len(got)
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.int64)
    raw = np.array(hashes, dtype=np.uint64)
    begin = (np.cumsum(sizes) - sizes)[full]
    for byte in range(8):
        part = ((raw >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        bits = np.unpackbits(part[:, None], axis=1, bitorder="little").astype(np.int32)
        over = 2 * np.add.reduceat(bits, begin, axis=0) > sizes[full, None]
        out[full] |= np.packbits(over, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc, fp)`` per row: the SimHash of the whole text as a signed long.

    Words are the ASCII-white-space tokens of the text with A-Z lower-cased.
    Fewer words than ``shingle`` make one shingle; no words (or a null text)
    make fingerprint zero.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.batches(source, "text", 1 << 22):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc"), pa.array(_fingerprints(texts, shingle))], names=["doc", "fp"])

    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc {src.schema['doc'].dataType.simpleString()}, fp long")


def block_masks(max_bits: int, blocks: int) -> list[int]:
    """Bit masks, one for each choice of ``blocks - max_bits`` blocks of the 64 bits, as signed longs.

    Two fingerprints within ``max_bits`` bits differ in at most that many
    blocks, so they agree on all bits of at least one of the masks.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    whole = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(whole[i] for i in pick) for pick in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(fps: DataFrame, max_bits: int = 2, blocks: int = 6) -> DataFrame:
    """Pairs ``(a, b)``, ``a > b``, of distinct fingerprints with at most ``max_bits`` differing bits.

    ``fps(fp)`` holds distinct values.  Every fingerprint goes into one bucket
    for each mask (15 of 42 bits or more by default); the self join on
    ``(mask, kept bits)`` verifies the Hamming distance and yields a pair at
    the first mask that it shares only.  Sort-merge, so a crowded bucket is
    streamed and AQE may split it; nothing is capped.
    """
    masks = block_masks(max_bits, blocks)
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("e"),
    ).select("fp", "e.m", "e.k")
    x, y = keyed.alias("x"), keyed.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    first = F.lit(True)
    for i, m in enumerate(masks[:-1]):
        first = first & ((F.col("x.m") <= i) | (diff.bitwiseAND(F.lit(m)) != 0))
    same = (F.col("x.m") == F.col("y.m")) & (F.col("x.k") == F.col("y.k"))
    return x.join(y, same & (F.col("x.fp") > F.col("y.fp")) & (F.bit_count(diff) <= max_bits) & first).select(
        F.col("x.fp").alias("a"), F.col("y.fp").alias("b")
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, blocks: int = 6
) -> DataFrame:
    """``(doc, fp, component)`` per row of ``docs``; component: the smallest id linked, directly or by a chain.

    Equal fingerprints collapse to one representative before any pair is made,
    so a group of copies of any size costs one row.  A null id keeps its row
    and never becomes a component id: the component is null when no linked row
    has an id.  Repeated ids and rows stay as they are; extra columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc").alias("least"), F.count("*").alias("rows")), "classes")
    roots = connected_components(close_pairs(classes.select("fp"), max_bits, blocks))
    linked = roots.select(F.col("node").alias("fp"), "root").join(classes, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    # every fingerprint with its component: its own least id unless it is linked
    named = classes.join(linked.select("fp", "root").join(smallest, "root").select("fp", "component"), "fp", "left").select(
        "fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")
    )
    return _spread_join(marked, named, classes).select("doc", "fp", "component")


def _spread_join(marked: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """``marked`` joined with ``named`` on ``fp``; the rows of a crowded fingerprint go to many tasks.

    A fingerprint with more than one of ``PARTS`` parts of all rows is cut into
    pieces of about that size, and its row of ``named`` is repeated for each.
    Fewer than ``PARTS`` fingerprints can be that crowded, so their table is
    broadcast whatever the size of ``marked``.
    """
    total = classes.agg(F.sum("rows")).first()[0] or 0
    pieces = F.ceil(F.col("rows") * PARTS / F.lit(max(total, 1))).cast("int")
    crowded = classes.where(F.col("rows") * PARTS > total).select("fp", pieces.alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int"), F.lit(0))
    dealt = marked.join(F.broadcast(crowded), "fp", "left").select("doc", "fp", piece.alias("piece"))
    repeated = named.join(F.broadcast(crowded), "fp", "left").select("fp", "component", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece"))
    return dealt.join(repeated, ["fp", "piece"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one, the first by id (null ids last) and row key.

    Rows get a key of their own, written with a copy of ``docs`` so that it
    holds for every later read; so neither repeated nor null ids take a row
    with them or keep one.  Null texts count as empty, and empty texts are
    alike.  All columns pass through, whatever their names; an empty table
    stays empty.
    """
    key = unused(docs, "_simhash_row")
    keyed = stage(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    named = keyed.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("doc"), F.col(text_col).alias("text"))
    found = simhash_components(named, "doc", "text", shingle, max_bits)
    losers = found.where("doc.row <> component.row").select(F.col("doc.row").alias(key))
    return keyed.join(losers, key, "left_anti").select(*docs.columns)
