"""Spelling variants: words that one inserted, deleted or replaced character turns into a far more frequent one.

Two words are near if their common prefix and common suffix together reach the longer one's length less one.
If the longer word has L characters and the common prefix ends in the range [low, high), both words share
their first ``low`` and their last ``L - high`` characters. So a word goes into a *block* for each range of a
division of [0, L): once for words as long as the longer one, once for those one shorter. Every near pair
meets in the one block whose range its prefix ends in. Ranges begin as halves; a block of more than
``BLOCK_WORDS`` words is divided at the middle of its range, down to single places, where a block holds no
more words than there are characters.

Inside a task, blocks are padded matrices of code points, compared as dense tiles one column at a time: from
the left for the prefixes, from the right for the suffixes. Tasks send on a word's count of near words and
the best one, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bidscope.session import stage

# Fixed values of the contract.
RUN = "[a-zÀ-ÿ]+"  # after A-Z became lower case
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # how many times more frequent a form is
ALTERED = 31  # one in so many runs of a document loses a character

BLOCK_WORDS = 512  # words of a block; beyond, its range is divided
TILE = 256  # rows of a tile
TILE_CELLS = 1 << 18  # pairs that are compared at a time
HELD_ROWS = 1 << 16  # rows that a task gathers before it compares
COUNTED_WORDS = 1 << 18  # different words that a task counts before it sends them on


# --- words and their counts


def altered(run: str, doc_id: int | None) -> str:
    """The run, without one character where the checksum of document and run says so; a null doc_id alters none."""
    h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % ALTERED == 0 else run


def vocabulary(docs: DataFrame, alter: bool = True, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all whole texts that are long and frequent enough.

    Null and empty texts hold no words; repeated rows count again; other columns are left out. Tasks add up
    before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                # lower() of bytes changes A-Z alone
                own = Counter(w for w in find((text.as_py() or "").encode().lower().decode()) if len(w) >= least_length)
                if alter:
                    i = doc_id.as_py()
                    for w, n in own.items():
                        counts[altered(w, i)] += n
                else:
                    counts.update(own)
                if len(counts) >= COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    long_enough = found.filter(F.char_length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- near words


def _blocked(words: DataFrame) -> DataFrame:
    """Rows of words with their block: the longer length, the range and what is shared by all words of it."""
    after = F.col("longest") - F.col("high")
    shared: list[Column] = [F.expr("substr(word, 1, low)"), F.when(after > 0, F.expr("right(word, longest - high)")).otherwise("")]
    return words.withColumn("block", F.xxhash64("longest", "low", "high", *shared))


def _first_blocks(words: DataFrame) -> DataFrame:
    length = F.char_length("word")
    lengths = F.explode(F.array(length, length + 1)).alias("longest")
    rows = words.select("word", "n", lengths)
    halves = F.array(
        F.struct(F.lit(0).alias("low"), F.expr("longest div 2").cast("int").alias("high")),
        F.struct(F.expr("longest div 2").cast("int").alias("low"), F.col("longest").alias("high")),
    )
    return _blocked(rows.select("word", "n", "longest", F.inline(halves)).filter("low < high"))


def _divided(rows: DataFrame) -> DataFrame:
    middle = F.expr("(low + high) div 2").cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
    )
    return _blocked(rows.select("word", "n", "longest", F.inline(halves)))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of ``a`` with every row of ``b``, for stacks of matrices."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    out = np.zeros(alive.shape, np.int32 if a.shape[2] > 250 else np.uint8)
    for c in range(a.shape[2]):
        alive &= a[:, :, None, c] == b[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


class _Matrix:
    """Padded code points of words of ``longest`` or one less characters, aligned left, and right in reverse."""

    def __init__(self, words: list[str], longest: int) -> None:
        points = np.array([*words, ""], dtype=f"U{longest}").view(np.uint32).reshape(len(words) + 1, longest)
        points = points.astype(np.uint8) if points.max(initial=0) < 256 else points
        self.full = np.array([len(w) == longest for w in words] + [False])
        self.left, right = points, points.copy()
        right[~self.full, 1:], right[~self.full, 0] = points[~self.full, :-1], 0
        self.right = right[:, ::-1]
        self.longest = longest

    def near(self, a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of near pairs out of stacks of row numbers ``a`` and ``b`` (-1: none) with the prefix ending in the range."""
        prefix = _common(self.left[a], self.left[b])
        suffix = _common(self.right[a], self.right[b])
        hit = (prefix.astype(np.int32) + suffix >= self.longest - 1) & (prefix >= low) & (prefix < high)
        hit &= (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (self.full[a][:, :, None] | self.full[b][:, None, :])
        g, i, j = np.nonzero(hit)
        return a[g, i], b[g, j]


def _block_tiles(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stacks of row numbers to compare: blocks of about the same size together, large ones as pairs of tiles."""
    side = 2
    while side <= TILE:
        chosen = np.flatnonzero((sizes > side // 2) & (sizes <= side) & (sizes > 1))
        step = max(1, TILE_CELLS // side**2)
        for at in range(0, len(chosen), step):
            own = chosen[at : at + step]
            rows = starts[own][:, None] + np.arange(side)
            rows = np.where(np.arange(side) < sizes[own][:, None], rows, -1)
            yield rows, rows
        side *= 2
    for block in np.flatnonzero(sizes > TILE):
        tiles = [np.arange(x, min(x + TILE, starts[block] + sizes[block])) for x in range(starts[block], starts[block] + sizes[block], TILE)]
        for a in tiles:
            for b in tiles:
                yield a[None], b[None]


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares whole blocks of rows in order of length, range, block and word."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        number = {x: np.asarray(rows[x]) for x in ("longest", "low", "high", "block", "n")}
        new = np.ones(len(rows), bool)
        kinds = np.ones(len(rows), bool)
        kinds[1:] = np.any([np.diff(number[x]) != 0 for x in ("longest", "low", "high")], axis=0)
        new[1:] = kinds[1:] | (np.diff(number["block"]) != 0)
        edges = np.append(np.flatnonzero(kinds), len(rows))
        for first, last in zip(edges[:-1], edges[1:]):
            words = rows["word"].slice(first, last - first).to_pylist()
            n = number["n"][first:last]
            starts = np.flatnonzero(new[first:last])
            sizes = np.diff(np.append(starts, len(words)))
            longest, low, high = (int(number[x][first]) for x in ("longest", "low", "high"))
            matrix = _Matrix(words, longest)
            pairs = [matrix.near(a, b, low, high) for a, b in _block_tiles(starts, sizes)]
            if not pairs:
                continue
            a, b = (np.concatenate(x) for x in zip(*pairs))
            if not len(a):
                continue
            order = np.lexsort((b, -n[b], a))  # rows are in order of words
            a, b = a[order], b[order]
            at = np.flatnonzero(np.append(True, np.diff(a) != 0))
            columns = [[words[i] for i in a[at]], np.diff(np.append(at, len(a))), n[b[at]], [words[i] for i in b[at]]]
            yield pa.record_batch([pa.array(x) for x in columns], names=["word", "n_near", "best_n", "best"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < HELD_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        block = np.asarray(rows["block"])
        turn = np.flatnonzero(np.diff(block) != 0)  # the last block may go on
        if len(turn):
            yield from found(rows.slice(0, int(turn[-1]) + 1))
            held = rows.slice(int(turn[-1]) + 1).to_batches()
            size = sum(map(len, held))
    if held:
        yield from found(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """For ``word, n`` with unequal words: of each word that has near words their number, and the most frequent
    one (of equals the smallest in code-point order) with its count: ``word, n_near, best_n, best``."""
    rows = _first_blocks(words)
    ready: list[DataFrame] = []
    while True:
        sizes = rows.filter("high - low > 1").groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        large = stage(sizes.filter(F.col("size") > BLOCK_WORDS).select("block"), "large-blocks")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, "block", "left_anti"))
        rows = stage(_divided(rows.join(large, "block", "left_semi")), "divided-blocks")
    order = ["longest", "low", "high", "block", "word"]
    every = ready[0].select(*order, "n")
    for more in ready[1:]:
        every = every.unionByName(more.select(*order, "n"))
    found = every.repartition(F.col("block")).sortWithinPartitions(*order).mapInArrow(_compared, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.word").alias("best")
    )


# --- forms and roots


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where following ``word, form`` ends. Every step doubles the distance."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = stage(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots", (now,))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For ``word, n`` with unequal words: ``word, n, n_near, form, form_n, root``.

    ``form`` is the most frequent near word if it is at least ``ratio`` (more than 1) times as frequent, else
    null; ``root`` the last one of following forms, the word itself where there is none.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words)
    often = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"),
    )
    joined = stage(joined, "near-words")
    roots = _roots(joined.filter("form is not null"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame) -> DataFrame:
    """The spelling variants of all words of the documents; see ``vocabulary`` and ``variants``."""
    return variants(vocabulary(docs)).select("word", "form", "root", "n", "n_near", "form_n")
