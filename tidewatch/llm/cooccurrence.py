"""Items that appear together: pair counts by a blocked Gram matrix, and lift over chance.

Baskets are rows of a binary sparse matrix X whose columns are the items; the counts of all pairs are
X'X. Every task cuts its records into record blocks, holds each as compressed sparse rows that are split into item
blocks X_I, and sums the transpose-products X_I'X_J tile by tile; a tile that is well filled is multiplied as a dense
matrix, any other row by row. Where the items are so many that tiles would be all but empty, a record block is multiplied
basket by basket without tiles. What a task holds follows the entries of its record block, not the number of items. Spark adds the tiles of all record blocks and normalises the counts by
the marginals. A basket that is too wide for one row is cut into item blocks beforehand and its products are spread over tasks.
Items that can't reach the thresholds (bounds that follow from the marginals alone) are removed first, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_hot_cold
from ..session import cut_lineage, parallelism

#: Columns of an item block; a tile has BLOCK x BLOCK counts. A code is block * BLOCK_CODES + column.
BLOCK = 1024
BLOCK_CODES = 1 << 24
#: Items up to which a basket is one row; wider ones are taken block pair by block pair.
WIDE = 2048
#: Entries of a record block, and pairs that are expanded at a time.
RECORD_BLOCK, CHUNK = 1_000_000, 4_000_000
#: A tile is multiplied as dense matrices if row by row it has more than 1/DENSE as many products.
DENSE = 64
#: A record block is multiplied tile by tile if a tile has at least so many products on average; else basket by basket, so many pairs at a time.
TILE_WORK, EXPAND = 1024, 500_000


class RecordBlock:
    """Compressed sparse rows of some baskets, split into item blocks."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """``codes`` of all baskets one after the other, and the ``sizes`` of the baskets."""
        self.n = len(sizes)
        rows = np.repeat(np.arange(self.n), sizes)
        blocks = len(np.unique(codes // BLOCK_CODES))
        self.tiled = int((sizes.astype(np.int64) * (sizes - 1) // 2).sum()) >= TILE_WORK * (blocks * (blocks + 1) // 2)
        if not self.tiled:
            order = np.lexsort((codes, rows))
            #: Every entry's code, and the number of entries after it in its basket.
            self.codes, self.after = codes[order], np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) - 1
            return
        order = np.argsort(codes // BLOCK_CODES * self.n + rows, kind="stable")
        codes, rows = codes[order], rows[order]
        starts = np.unique(codes // BLOCK_CODES, return_index=True)[1]
        #: By item block: the rows that occur, where each begins, the row of every entry, the columns that occur, and every entry's place among them.
        self.parts = []
        for lo, hi in zip(starts, [*starts[1:], len(codes)]):
            columns, local = np.unique(codes[lo:hi], return_inverse=True)
            present, pointer = np.unique(rows[lo:hi], return_index=True)
            self.parts.append((present, np.append(pointer, hi - lo), rows[lo:hi], columns, local))

    def products(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, count) of the upper triangle of X'X, a < b; a pair may come several times."""
        if not self.tiled:
            yield from self._by_baskets()
            return
        for i, left in enumerate(self.parts):
            for j in range(i, len(self.parts)):
                yield from self._tile(left, self.parts[j], i == j)

    def _by_baskets(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        names, local = np.unique(self.codes, return_inverse=True)
        for lo, hi in _chunks(self.after, EXPAND):
            n = self.after[lo:hi]
            key = np.repeat(local[lo:hi] * len(names), n) + local[np.repeat(np.arange(lo, hi) + 1, n) + _within(n)]
            keys, counts = np.unique(key, return_counts=True)
            yield names[keys // len(names)], names[keys % len(names)], counts

    def _tile(self, left, right, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        present, pointer, _, names, second = right
        _, _, rows, mine, first = left
        at = np.minimum(np.searchsorted(present, rows), len(present) - 1)
        begin, partners = pointer[at], np.where(present[at] == rows, pointer[at + 1] - pointer[at], 0)
        total = int(partners.sum())
        if not total:
            return
        shape = (len(mine), len(names))
        cells = shape[0] * shape[1]

        def named(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = mine[keys // shape[1]], names[keys % shape[1]]
            keep = a < b if same else slice(None)
            return a[keep], b[keep], counts[keep]

        if total * DENSE > self.n * cells and self.n * max(shape) <= CHUNK:
            x, y = np.zeros((self.n, shape[0]), np.float32), np.zeros((self.n, shape[1]), np.float32)
            x[rows, first], y[right[2], second] = 1, 1
            tile = (x.T @ y).ravel()
            keys = np.flatnonzero(tile)
            yield named(keys, tile[keys].astype(np.int64))
            return
        for lo, hi in _chunks(partners, CHUNK):
            n = partners[lo:hi]
            key = np.repeat(first[lo:hi].astype(np.int64) * shape[1], n) + second[np.repeat(begin[lo:hi], n) + _within(n)]
            if cells <= 4 * len(key):
                tile = np.bincount(key, minlength=cells)
                keys = np.flatnonzero(tile)
                yield named(keys, tile[keys])
            else:
                yield named(*np.unique(key, return_counts=True))


def _chunks(products: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries that have ``most`` products together, or are a single entry."""
    ends = np.cumsum(products)
    lo = 0
    while lo < len(products):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each of ``n``, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper triangle of X'X of the record blocks of a task (``items``: arrays of codes)."""
    codes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for a, b, n in RecordBlock(np.concatenate(codes), np.concatenate(sizes)).products():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    for batch in batches:
        column = batch.column(0)
        codes.append(column.flatten().to_numpy())
        sizes.append(np.diff(column.offsets.to_numpy()))
        entries += len(codes[-1])
        if entries >= RECORD_BLOCK:
            yield from flush()
            codes, sizes, entries = [], [], 0
    if entries:
        yield from flush()


def _gram_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Products of block pairs (``left``, ``right``) of wide baskets; within a block, above the diagonal."""
    for batch in batches:
        for left, right, same in zip(batch["left"], batch["right"], batch["same"]):
            a, b = np.meshgrid(np.asarray(left), np.asarray(right), indexing="ij")
            keep = a < b if same else np.ones(a.shape, bool)
            yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "n": 1})


def lift(together: str, n_a: str, n_b: str, n_baskets: str) -> Column:
    """How many times as often as by chance; in floating point, so that counts of any size have a product."""
    return F.col(together).cast("double") * F.col(n_baskets).cast("double") / (F.col(n_a).cast("double") * F.col(n_b).cast("double"))


def normalise(counted: DataFrame, min_together: int, min_lift: float) -> DataFrame:
    """Adds ``lift`` to (together, n_a, n_b, n_baskets) and keeps the pairs that reach both thresholds."""
    double = lambda c: F.col(c).cast("double")
    # A product on either side, exact below 2**53, so that a pair that just reaches the threshold isn't lost to a quotient.
    reached = double("together") * double("n_baskets") >= min_lift * (double("n_a") * double("n_b"))
    return counted.where(F.col("together") >= min_together).where(reached).withColumn("lift", lift("together", "n_a", "n_b", "n_baskets"))


def pair_counts(links: DataFrame, basket: str, item: str, min_together: int, min_lift: float) -> DataFrame:
    """item_a < item_b (string order), ``together``, ``n_a``, ``n_b``, ``n_baskets`` and ``lift``.

    Only pairs with together >= min_together and lift = together * n_baskets / (n_a * n_b) >=
    min_lift. A basket counts an item once however often it is repeated; rows with a null basket or item
    are ignored; n_baskets counts baskets with any item. An empty table gives no pairs. Counts may be as large as a bigint holds.
    """
    facts = links.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    facts = cut_lineage(facts)
    widths = cut_lineage(facts.groupBy("basket").agg(F.count(F.lit(1)).alias("width")))
    n_baskets = widths.count()
    wide = widths.where(F.col("width") > WIDE).select("basket")
    any_wide = not wide.isEmpty()
    marginals = facts.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # together <= min(n_a, n_b), so lift <= n_baskets / max(n_a, n_b).
    possible = cut_lineage(marginals.where((F.col("n") >= min_together) & (F.col("n").cast("double") * min_lift <= float(n_baskets))))
    in_block = Window.partitionBy("block").orderBy("item")
    blocks = max(1, possible.count() // (BLOCK // 2))
    indexed = possible.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    indexed = cut_lineage(indexed.withColumn("code", F.col("block") * BLOCK_CODES + F.row_number().over(in_block)).select("item", "n", "block", "code"))

    coded = join_hot_cold(facts, indexed, "item", "n", ["code"]).select("basket", "code")
    coded = cut_lineage(coded) if any_wide else coded
    ordinary = coded.join(wide, "basket", "left_anti") if any_wide else coded
    rows = ordinary.groupBy("basket").agg(F.collect_list("code").alias("items")).where("size(items) > 1").select("items")
    schema = "a bigint, b bigint, n bigint"
    gram = rows.mapInArrow(_gram, schema)
    if any_wide:
        cut = cut_lineage(coded.join(wide, "basket", "left_semi").groupBy("basket", F.floor(F.col("code") / BLOCK_CODES).alias("block")).agg(F.collect_list("code").alias("codes")))
        left = cut.select("basket", F.col("block").alias("i"), F.col("codes").alias("left"))
        right = cut.select("basket", F.col("block").alias("j"), F.col("codes").alias("right"))
        tiles = left.join(right, "basket").where("i <= j").repartition(parallelism(links.sparkSession), "basket", "i", "j").select("left", "right", (F.col("i") == F.col("j")).alias("same"))
        gram = gram.unionByName(tiles.mapInPandas(_gram_of_blocks, schema))
    counted = gram.groupBy("a", "b").agg(F.sum("n").alias("together")).where(F.col("together") >= min_together)

    side = lambda s: indexed.select(F.col("code").alias(s), F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    named = counted.join(side("a"), "a").join(side("b"), "b").withColumn("n_baskets", F.lit(n_baskets).cast("bigint"))
    swap = F.col("item_a") > F.col("item_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return normalise(named, min_together, min_lift).select(
        pick("item_a", "item_b").alias("item_a"), pick("item_b", "item_a").alias("item_b"), "together", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n_baskets", "lift"
    )


def npmi(pairs: DataFrame) -> DataFrame:
    """Adds ``npmi``: log2(lift) / -log2(together / n_baskets), within ±1; 1 or 0 where every basket has both."""
    share = F.col("together") / F.col("n_baskets")
    value = F.when(share >= 1, F.when(F.col("lift") >= 1, 1.0).otherwise(0.0)).otherwise(F.log2("lift") / -F.log2(share))
    return pairs.withColumn("npmi", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
