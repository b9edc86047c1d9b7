"""Similarity join on word shingles by T-occurrence search (DivideSkip).

Two texts link when their sets of five-word shingles agree in at least 80 of 100. Then both hold a number
of keys from each other's smallest hashes, so that

1. every document lists its smallest hashes, and learns in one pass by key which of them occur again;
2. documents with fewer such keys than any partner must share drop out; of the others' keys the most
   frequent ones are set aside, as many as the required number allows;
3. documents of like size that meet under a remaining key form a block around one of them, the same for
   most keys of a group, and each block is searched exactly: short inverted lists are merged for
   candidates, long ones are probed by binary search.

A block joins documents that are already connected only once, so copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidscope.llm import hashing
from bidscope.llm.repeats import NO_ID
from bidscope.llm.rows import packed, unpacked
from bidscope.session import stage

WORDS = 5
SIMILAR = 80  # of 100
EXTRA = 10  # keys listed beyond what one shared key needs: a tenth of the set
BLOCK_SHINGLES = 1 << 21  # shingles of a block that is searched at a time
PROBED = 8  # up to so many documents are compared directly, without inverted lists
OPEN_DOCS = 1 << 20  # documents of one key that a task holds


def _least(n: int | np.ndarray) -> int | np.ndarray:
    """Shingles that a set of n must share with any similar one."""
    return -(-SIMILAR * n // 100)


def _extra(n: int | np.ndarray) -> int | np.ndarray:
    """Listed keys that two similar sets share at least, if the smaller one has n."""
    return 1 + n // EXTRA


def _linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= SIMILAR * (a + b - common)


# --- shingles


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of concatenated texts, text by text in ascending order, and where each begins.

    Words are lower-cased for A-Z. Fewer than five words count as one shingle; no word, no shingle.
    """
    lower = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    starts, ends, bounds = hashing.words(lower, offsets)
    n_texts = len(offsets) - 1
    prefix = hashing.PrefixHash(hashing.word_hashes(lower, starts, ends))
    words = np.diff(bounds)
    count = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    text = np.repeat(np.arange(n_texts), count)
    first = np.repeat(np.cumsum(count) - count, count)
    at = bounds[:-1][text] + np.arange(len(text)) - first
    size = np.minimum(words, WORDS)[text]
    hashes = hashing.mix(prefix.of(at, at + size) + size.astype(np.uint64))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(n_texts + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _documents(docs: DataFrame) -> DataFrame:
    """``_doc, _text``: a number for every row; rows of an id that repeats or is missing are told apart by
    their text, and rows equal in both are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    counts = docs.select(doc.alias("_doc")).groupBy("_doc").agg(F.count(F.lit(1)).alias("_n"))
    unclear = not counts.filter((F.col("_n") > 1) | (F.col("_doc") == NO_ID)).isEmpty()
    own = F.xxhash64(doc, text) if unclear else doc
    return docs.select("*", own.alias("_doc"), doc.alias("_id"), text.alias("_text"))


_POSTED = "key bigint, doc bigint, n int, s1 bigint, s2 bigint, id bigint, lists boolean"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (``n`` set) and one per listed key; of equal sets in a batch one lists its keys."""
    for batch in batches:
        ids, docs = (np.asarray(batch[c], dtype=np.int64) for c in ("_id", "_doc"))
        seen: set[tuple[int, int, int]] = set()
        for row, end, data, offsets in hashing.slices(batch["_text"]):
            hashes, bounds = shingles(data, offsets)
            n = np.diff(bounds)
            s1, s2 = _sums(hashes, bounds), _sums(hashing.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds)
            sets = list(zip(n.tolist(), s1.tolist(), s2.tolist()))
            fresh = np.array([not (x in seen or seen.add(x)) for x in sets], bool)
            listed = np.where(fresh & (n > 0), n - _least(n) + _extra(n), 0)
            listed = np.minimum(listed, n)
            doc = docs[row:end]
            at = np.repeat(bounds[:-1], listed) + np.arange(listed.sum()) - np.repeat(np.cumsum(listed) - listed, listed)
            keys, owner = hashes[at].view(np.int64), np.repeat(doc, listed)
            own = hashing.mix(doc.view(np.uint64)).view(np.int64)
            k, d = len(keys), len(doc)
            none = np.arange(d + k) >= d  # rows of keys have no facts about the document
            facts = ((n, pa.int32()), (s1.view(np.int64), pa.int64()), (s2.view(np.int64), pa.int64()), (ids[row:end], pa.int64()), (listed > 0, pa.bool_()))
            columns = [pa.array(np.concatenate([x, np.zeros(k, x.dtype)]), t, mask=none) for x, t in facts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own, keys])), pa.array(np.concatenate([doc, owner])), *columns],
                names=["key", "doc", "n", "s1", "s2", "id", "lists"],
            )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows in order of key; passes the documents' rows on, and the keys of two documents or more.

    ``n`` of a key's rows becomes its number of documents. Only the rows of one key are held; a key with
    more than ``OPEN_DOCS`` goes on a stretch at a time and counts as ``OPEN_DOCS + 1`` throughout.
    """
    held: pa.Table | None = None
    frequent: int | None = None

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, is_doc = np.asarray(rows["key"]), np.asarray(rows["n"].is_valid())
        posted = np.flatnonzero(~is_doc)
        _, which, counts = np.unique(key[posted], return_inverse=True, return_counts=True)
        number = counts[which]
        if frequent is not None:
            number = np.where(key[posted] == frequent, OPEN_DOCS + 1, number)
        docs = rows.filter(pa.array(is_doc)).combine_chunks()
        yield from docs.set_column(0, "key", pa.nulls(len(docs), pa.int64())).to_batches()
        again = rows.take(pa.array(posted[number > 1])).combine_chunks()
        yield from again.set_column(2, "n", pa.array(number[number > 1], pa.int32())).to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key = np.asarray(rows["key"])
        last = int(np.flatnonzero(np.append(True, np.diff(key) != 0))[-1]) if len(key) else 0
        if not last and len(key) > OPEN_DOCS:
            last, frequent = len(key), int(key[0])
        if last:
            yield from out(rows.slice(0, last))
            rows = rows.slice(last)
        held = rows
    if held is not None and len(held):
        yield from out(held)


# --- routes and blocks


def _band(n: np.ndarray) -> np.ndarray:
    """Sizes that can link are in the same band or in neighbouring ones; bands are a little wider than
    the ratio, so that rounding does not matter."""
    return np.floor(np.log(n) / np.log(100 / SIMILAR + 1e-9)).astype(np.int32)


_ROUTE = "key bigint, band int, upper boolean, rank bigint, doc bigint, n int"


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys under which a document looks for partners: its repeated keys, rarest first, without the most
    frequent ones that the required number of shared keys lets it set aside.

    Each key comes twice: with the document's band, and as an upper document with the band below.
    """
    for batch in batches:
        keys, docs, sizes = [], [], []
        for doc, n, found in zip(*(batch[c].to_pylist() for c in ("doc", "n", "keys"))):
            listed = min(n, n - _least(n) + _extra(n))
            need = min(listed, int(_extra(_least(n))))
            once = listed - len(found)
            wanted = listed - need + 1 - once  # keys that occur once come first and find nobody
            if wanted > 0:
                ranked = sorted((k["n"], k["key"]) for k in found)[:wanted]
                keys += [key for _, key in ranked]
                docs += [doc] * len(ranked)
                sizes += [n] * len(ranked)
        key, doc, n = np.array(keys, np.int64), np.array(docs, np.int64), np.array(sizes, np.int32)
        rank, band = hashing.mix(doc.view(np.uint64)).view(np.int64), _band(np.maximum(n, 1))
        for upper in (False, True):
            columns = [key, band - upper, np.full(len(key), upper), rank, doc, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "band", "upper", "rank", "doc", "n"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams routes in order of (key, band, upper, rank, doc) and yields (block, doc, n).

    The document of a band with the smallest rank names the block. Ranks are the same under every key, so
    a group of near copies ends up in few blocks. Upper documents without one of the band itself have
    met under their own band.
    """
    group, leader, alone = None, None, None
    for batch in batches:
        rows: set[tuple[int, int, int]] = set()
        for key, band, upper, doc, n in zip(*(batch[c].to_pylist() for c in ("key", "band", "upper", "doc", "n"))):
            if (key, band) != group:
                group, leader, alone = (key, band), (None if upper else doc), (doc, doc, n)
                continue
            if leader is not None:
                rows |= {(leader, doc, n)} if alone is None else {alone, (leader, doc, n)}
                alone = None
        found = list(rows)
        kinds = (pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names=["block", "doc", "n"])


# --- searching a block


class Block:
    """Sets of some documents with inverted lists, searched for linked pairs that join components."""

    def __init__(self, docs: list[int], texts: list[bytes], settled: list[bool]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes, bounds = shingles(data, np.cumsum([0, *map(len, texts)]))
        order = np.argsort(np.diff(bounds), kind="stable")  # by size, so that partners are near
        self.docs = [docs[i] for i in order]
        self.sets = [hashes[bounds[i] : bounds[i + 1]] for i in order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        owner = np.repeat(np.arange(len(docs)), self.sizes)
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        by_key = np.lexsort((owner, flat))
        keys, owner = flat[by_key], owner[by_key]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.keys = keys[new]
        self.begin = np.append(np.flatnonzero(new), len(keys))
        self.owner = owner
        self.parent = list(range(len(docs)))
        known = [k for k, i in enumerate(order) if settled[i]]
        for k in known:  # documents that are known to be connected
            self.parent[k] = known[0]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _common(self, i: int, j: int) -> int:
        """Size of the intersection: the smaller set is probed in the larger by binary search."""
        a, b = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum())

    def candidates(self, i: int, low: int, high: int) -> np.ndarray:
        """Documents low..high-1 that may share T shingles with i, by DivideSkip.

        Of i's inverted lists the T - 1 longest are set aside; whoever shares T must be in one of the
        rest, which are merged with their numbers of occurrences. What the long lists can add decides
        who stays a candidate.
        """
        at = np.searchsorted(self.keys, self.sets[i])
        begin, end = self.begin[at], self.begin[at + 1]
        least = int(_least(self.sizes[i]))
        by_length = np.argsort(end - begin, kind="stable")
        short = by_length[: len(by_length) - (least - 1)]
        merged = np.sort(np.concatenate([self.owner[begin[k] : end[k]] for k in short]))
        found, counts = np.unique(merged[(merged >= low) & (merged < high)], return_counts=True)
        return found[counts + least - 1 >= _least(np.maximum(self.sizes[found], self.sizes[i]))]

    def links(self) -> Iterator[tuple[int, int]]:
        """Linked pairs that connect what was not connected; every link's ends are connected in the end."""
        for i in range(len(self.sets) - 1):
            n = int(self.sizes[i])
            if not n:
                continue
            high = int(np.searchsorted(self.sizes, 100 * n // SIMILAR, side="right"))
            root = self.root(i)
            others = [j for j in range(i + 1, high) if self.root(j) != root]
            if len(others) > PROBED:
                others = self.candidates(i, i + 1, high).tolist()
            for j in others:
                a, b = self.root(i), self.root(j)
                if a != b and _linked(self._common(i, j), n, int(self.sizes[j])):
                    self.parent[max(a, b)] = min(a, b)
                    yield self.docs[i], self.docs[j]


_EDGE = "a bigint, b bigint"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (block, doc, text, settled) in order of block and searches each block."""
    block, docs, texts, settled = None, [], [], []

    def found() -> pa.RecordBatch:
        edges = list(Block(docs, texts, settled).links())
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for b, doc, text, s in zip(*(batch[c] for c in ("block", "doc", "text", "settled"))):
            if b.as_py() != block:
                if len(docs) > 1:
                    yield found()
                block, docs, texts, settled = b.as_py(), [], [], []
            docs.append(doc.as_py())
            texts.append(text.as_py().encode())
            settled.append(s.as_py())
    if len(docs) > 1:
        yield found()


def _search(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges found in blocks of (block, doc, settled)."""
    # Texts always move by a shuffle: how many documents are in blocks is not known beforehand.
    rows = texts.join(members.hint("shuffle_merge"), "doc").select("block", "doc", "text", "settled")
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block", "doc")
    return rows.mapInArrow(_searched, _EDGE)


def _large_blocks(members: DataFrame, sizes: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of blocks with more than ``BLOCK_SHINGLES``.

    They are dealt into parts, each with the block's first document, and searched part by part. Documents
    that are still not connected to the first one then meet every part, in pieces; the others need not
    meet each other again.
    """
    half = BLOCK_SHINGLES // 2
    rows = members.join(sizes, "block").withColumn("parts", F.ceil(F.col("size") / half).cast("int"))
    rows = stage(rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")), "large-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_each")
    first = rows.filter("doc = block").select("block", each("parts"), "doc")
    dealt = rows.select("block", F.col("part").alias("_each"), "doc").unionByName(first)
    dealt = dealt.select(F.xxhash64("block", "_each").alias("block"), "doc").distinct()
    near = stage(_search(dealt.withColumn("settled", F.lit(False)), texts), "part-edges")
    found = components(edges.unionByName(near))
    rows = _with_component(rows, found)
    heads = rows.filter("doc = block").select("block", F.col("component").alias("head"))
    rows = stage(rows.join(heads, "block").withColumn("settled", F.col("component") == F.col("head")), "part-components")
    left = rows.filter(~F.col("settled"))
    if left.isEmpty():
        return near
    pieces = left.groupBy("block").agg(F.ceil(F.sum("n") / half).cast("int").alias("pieces"))
    rows = rows.join(pieces, "block")
    piece = F.pmod(F.xxhash64("doc", F.lit(7)), F.col("pieces")).cast("int")
    parts = rows.select("block", each("pieces"), "part", "doc", "settled")
    rest = rows.filter(~F.col("settled")).select("block", piece.alias("_piece"), each("parts"), "doc", "settled")
    cells = parts.unionByName(rest.select("block", F.col("_piece").alias("_each"), F.col("_each").alias("part"), "doc", "settled"))
    cells = cells.select(F.xxhash64("block", "_each", "part", F.lit(1)).alias("block"), "doc", "settled").distinct()
    return near.unionByName(stage(_search(cells, texts), "cell-edges"))


# --- components


def components(edges: DataFrame) -> DataFrame:
    """``doc, component`` of all documents with edges: the smallest document each can reach.

    Large-star and small-star steps in turn: every neighbour of a document is hooked to the smallest one
    around it, until nothing changes. The number of rounds grows with the logarithm of a component's
    size, no document ever has all edges of its component in one place, and only counts reach the driver.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = stage(edges.select(high, low).filter("a <> b").distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.select(mark).first()[0]
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("_m").alias("b"))
        now = stage(small.filter("a <> b").distinct(), "edges", replaces=(now,))
        before, seen = seen, now.select(mark).first()[0]
        if seen == before:
            return now.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("doc"), F.col("b").alias("component")).distinct()
            )


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "doc", "left").withColumn("component", F.coalesce("component", "doc"))


# --- the join


def similar_sets(docs: DataFrame) -> DataFrame:
    """``_doc, _id, n_shingles, component_id, _component`` per row of documents with ``_doc, _id, _text``;
    the last tells components apart whose smallest documents have the same id."""
    posted = docs.select("_id", "_doc", "_text").mapInArrow(_listed, _POSTED)
    rows = stage(posted.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_repeated, _POSTED), "postings")
    facts = rows.filter("key is null")
    same = ["n", "s1", "s2"]
    # Of equal sets the smallest document that lists keys stands for all.
    classes = facts.filter("n > 0").groupBy(*same).agg(F.min(F.when(F.col("lists"), F.col("doc"))).alias("rep"), F.min("id").alias("least"))
    classes = stage(classes, "classes")
    keys = rows.filter("key is not null").groupBy("doc").agg(F.collect_list(F.struct("n", "key")).alias("keys"))
    reps = classes.select(F.col("rep").alias("doc"), "n")
    routes = reps.join(keys, "doc").select("doc", "n", "keys").mapInArrow(_routed, _ROUTE)
    routes = routes.repartition(F.col("key")).sortWithinPartitions("key", "band", "upper", "rank", "doc")
    members = stage(routes.mapInArrow(_blocked, "block bigint, doc bigint, n int").distinct(), "blocks")
    sizes = members.groupBy("block").agg(F.sum("n").alias("size"))
    sizes = stage(sizes.filter(F.col("size") > BLOCK_SHINGLES), "block-sizes")
    texts = docs.select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    large = not sizes.isEmpty()
    usual = members.join(sizes, "block", "left_anti") if large else members
    edges = stage(_search(usual.withColumn("settled", F.lit(False)), texts), "links")
    if large:
        edges = edges.unionByName(_large_blocks(members, sizes, texts, edges))
    found = _with_component(classes.select(F.col("rep").alias("doc"), *same, "least"), components(edges))
    whole = found.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = found.join(whole, "component").select(*same, "component_id", "component")
    joined = facts.select("doc", "id", *same).join(labels, same, "left")
    return joined.select(
        F.col("doc").alias("_doc"),
        F.col("id").alias("_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component", "doc").alias("_component"),
    )


def _visible(column: str, kind: str) -> F.Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).cast(kind)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest document it reaches over links.

    Null and empty texts have no shingles and stand alone. Rows that repeat an id are documents of
    their own unless their texts are equal; a missing id is smaller than all others and null in the
    result. Other columns are left out; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = similar_sets(_documents(docs.select("doc_id", "text")))
    return found.select(_visible("_id", kind).alias("doc_id"), "n_shingles", _visible("component_id", kind).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, of which one of each component stays: the one with the smallest id.

    Documents without words are linked with nothing and all stay, but for rows that repeat one.
    """
    keep = ["doc_id", "text"]
    rows = _documents(packed(docs, keep))
    found = similar_sets(rows)
    best = F.min(F.struct("_id", "_doc")).alias("_best")
    chosen = found.groupBy("_component").agg(best).select(F.col("_best._doc").alias("_doc"))
    kept = rows.join(chosen, "_doc", "left_semi")
    if not found.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_doc"])
    return unpacked(kept.select(*keep, "_rest"), docs.columns, keep)
