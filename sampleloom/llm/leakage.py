"""Evaluation passages inside a training corpus: CGK embedding, bit-sampling LSH over windows, exact verification.

A passage is `passage` consecutive words of an item (letters and digits in lower case, invisible characters left out).
All windows of that many words, of items and of documents, are embedded: the CGK walk turns edit distance between windows
into Hamming distance (every step copies the current word and moves on or not by a random bit of that word and step), and
each of `repetitions` tables keys the windows by a sample of `bits` positions of its own walk. Windows that are equal
have equal embeddings and meet in every table; windows with edits meet in some table with the recall measured in the
tests. Document windows with more than max_edits words that no item has are left out before: they can't match.

Candidates are verified exactly, within the same task: the passage must have a word edit distance of at most max_edits to
a stretch of the document that begins within max_edits words of the window (with max_edits 0: be equal to the window).

Items are the query set: their keys are sent to the workers in blocks of at most BLOCK_WORDS words, one pass over the
documents for each block, so what is broadcast has a fixed bound. Documents are never collected; nothing is shuffled but
the found pairs. Null or short texts (under `passage` words; documents may be shorter by max_edits) hold and give nothing.
Repeated items each count by their id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most words of items sent to the workers at once (about 16 bytes a word and table).
BLOCK_WORDS = 500_000
#: Most document words embedded at once in a worker, and most candidates verified at once.
CHUNK_WORDS = 400_000
CHUNK_PAIRS = 200_000
_INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff\u00ad]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((_INVISIBLE.sub("", text) if not text.isascii() else text).lower()) if text else []


class Embedding:
    """`repetitions` independent CGK walks over windows of `width` words, each sampled at `bits` positions."""

    def __init__(self, width: int, repetitions: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width = width
        steps = 3 * width
        self.moves = [rng.integers(0, 2**63, (steps, 2), dtype=np.uint64) | np.uint64(1) for _ in range(repetitions)]
        # the first position is the first word, whatever the walk; sampled positions lie where a walk is still inside
        self.samples = [np.sort(rng.choice(np.arange(1, 2 * width), min(bits, 2 * width - 1), replace=False)) for _ in range(repetitions)]
        self.mix = rng.integers(0, 2**63, steps, dtype=np.uint64) | np.uint64(1)

    def keys(self, codes: np.ndarray, starts: np.ndarray, r: int) -> np.ndarray:
        """A 64-bit key of each window of table r. codes: word codes, with `width` spare ones (0) at the end."""
        at = starts.copy()
        end = starts + self.width
        moves, sampled = self.moves[r], set(self.samples[r].tolist())
        key = np.zeros(len(starts), np.uint64)
        for step in range(max(sampled) + 1):
            word = np.where(at < end, codes[np.minimum(at, end - 1)], np.uint64(0))
            if step in sampled:
                key = (key ^ word) * self.mix[step]
                key ^= key >> np.uint64(29)
            a, b = moves[step]
            at = at + (((word * a + b) >> np.uint64(61)) & np.uint64(1)).astype(at.dtype)
        return key


class ItemIndex:
    """The windows of a block of items by table and key."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int, repetitions: int, bits: int):
        self.passage = passage
        self.embedding = Embedding(passage, repetitions, bits)
        items = [(i, w) for i, w in items if len(w) >= passage]
        self.item_ids = np.array([i for i, _ in items], np.int64)
        self.vocabulary: dict[str, int] = {}
        for _, w in items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)  # 0: a word of no item
        self.words = np.array([self.vocabulary[x] for _, w in items for x in w] + [0] * passage, np.int32)
        sizes = np.array([len(w) for _, w in items], np.int64)
        windows = sizes - passage + 1
        first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        self.start = (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first, windows)).astype(np.int64)
        self.tables = []
        for r in range(repetitions):
            keys = self.embedding.keys(self.codes(self.words), self.start, r)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order.astype(np.int32)))

    @staticmethod
    def codes(words: np.ndarray) -> np.ndarray:
        """64-bit codes of word numbers, 0 for 0."""
        return words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def state(self) -> dict:
        """Plain values only, for a broadcast; `of` is its inverse."""
        return self.__dict__ | {"embedding": self.embedding.__dict__}

    @classmethod
    def of(cls, state: dict) -> ItemIndex:
        index, embedding = cls.__new__(cls), Embedding.__new__(Embedding)
        embedding.__dict__.update(state["embedding"])
        index.__dict__.update(state | {"embedding": embedding})
        return index

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in starts, item windows) that share a key, table after table; a pair may come from several tables."""
        codes = self.codes(words)
        for r, (keys, order) in enumerate(self.tables):
            if not len(keys):
                continue
            ours = self.embedding.keys(codes, starts, r)
            low = np.searchsorted(keys, ours)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == ours)
            low = low[hit]
            times = np.searchsorted(keys, ours[hit], "right") - low
            upto = np.cumsum(times)
            begin = 0
            while begin < len(hit):  # in parts of a bounded number of pairs (one window's pairs at least)
                stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CHUNK_PAIRS, "right")))
                n = times[begin:stop]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(hit[begin:stop], n), order[np.repeat(low[begin:stop], n) + inside]
                begin = stop

    def near(self, words: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, window: np.ndarray, most: int) -> np.ndarray:
        """Whether item window has at most `most` word edits to a stretch of words around starts, within [low, high)."""
        part = self.words[self.start[window][:, None] + np.arange(self.passage)]
        if not most:
            return (words[starts[:, None] + np.arange(self.passage)] == part).all(axis=1)
        at = starts[:, None] + np.arange(-most, self.passage + most)
        near = np.where((at >= low[:, None]) & (at < high[:, None]), words[np.clip(at, 0, len(words) - 1)], -1)
        # edit distance with a free begin and end in the stretch, all pairs at once
        row = np.zeros((len(starts), near.shape[1] + 1), np.int16)
        for k in range(self.passage):
            differs = (near != part[:, k : k + 1]).astype(np.int16)
            new = np.empty_like(row)
            new[:, 0] = k + 1
            cost = np.minimum(row[:, :-1] + differs, row[:, 1:] + 1)
            for j in range(near.shape[1]):
                new[:, j + 1] = np.minimum(cost[:, j], new[:, j] + 1)
            row = new
        return row.min(axis=1) <= most


def _search(shared, max_edits: int):
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex.of(shared.value)
        number_of, width = index.vocabulary.get, index.passage
        ids, parts, size = [], [], 0

        def found() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], np.int64)
            first = np.cumsum(sizes) - sizes
            words = np.array([c for p in parts for c in p] + [0] * (width + max_edits), np.int32)
            # every place a window of a document can begin; with edits it may run over the document's end
            windows = np.maximum(sizes - width + 1 + max_edits, 0)
            doc = np.repeat(np.arange(len(parts)), windows)
            starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[doc]
            unknown = np.concatenate([[0], np.cumsum(words == 0)])
            known = unknown[np.minimum(starts + width, first[doc] + sizes[doc])] - unknown[starts] <= max_edits
            starts, doc = starts[known], doc[known]
            n, pairs = max(1, len(index.item_ids)), np.array([], np.int64)  # a pair of document and item as one number
            for at, window in index.candidates(words, starts) if len(starts) else ():
                pair = doc[at] * n + index.owner[window]
                open_ = ~np.isin(pair, pairs)  # what is found needs no further look
                at, window, pair = at[open_], window[open_], pair[open_]
                d = doc[at]
                ok = index.near(words, starts[at], first[d], first[d] + sizes[d], window, max_edits)
                pairs = np.union1d(pairs, pair[ok])
            return pa.record_batch([pa.array(np.array(ids, np.int64)[pairs // n]), pa.array(index.item_ids[pairs % n] if len(pairs) else [], pa.int64())], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if doc is None or len(words) < width - max_edits:
                    continue
                ids.append(doc)
                parts.append([number_of(x, 0) for x in words])
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield found()
                    ids, parts, size = [], [], 0
        if ids:
            yield found()

    return run


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    rows = items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        block.append((row["i"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", passage: int = 12, max_edits: int = 0, repetitions: int | None = None, bits: int | None = None) -> DataFrame:
    """(doc, item): the document holds a passage of the item, once per pair.

    Without edits two tables of six positions find all, equal windows having equal embeddings. With max_edits fewer
    positions are sampled and 12 tables find 0.98 of the passages with two edits (tests).
    """
    repetitions = repetitions or (2 if not max_edits else 12)
    bits = bits or (6 if not max_edits else 3)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    result = None
    for block in _blocks(items, item, text):
        index = ItemIndex(block, passage, repetitions, bits)
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(index.state()), max_edits), "doc long, item long")
        result = found if result is None else result.unionByName(found)
    return result.distinct().select(F.col("doc").alias(doc), F.col("item").alias(item))


def leak_report(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", benchmark: str = "benchmark", held_out: str = "held_out", **options) -> DataFrame:
    """Per benchmark and held-out part: items, items that leaked, documents that hold one."""
    pairs = leaked_items(docs, items, doc, item, **options)
    named = items.select(F.col(item).alias("item"), F.col(benchmark).alias("benchmark"), F.col(held_out).alias("held_out")).distinct()
    hit = named.join(pairs.select(F.col(doc).alias("doc"), F.col(item).alias("item")), "item", "left")
    return hit.groupBy("benchmark", "held_out").agg(F.countDistinct("item").alias("n_items"), F.countDistinct(F.when(F.col("doc").isNotNull(), F.col("item"))).alias("n_leaked"), F.countDistinct("doc").alias("n_documents"))
