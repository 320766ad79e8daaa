"""Mixture-controlled packing of tokenised documents into fixed windows.

The documents of a source form one token queue. Deficit round robin serves the queues: every
round each source that still has tokens earns its share of one window, hands over the whole
tokens of its credit, and carries the fraction into the next round. Served this way, what a
source has given after r rounds is ``min(size, floor(weight * V(r)))``, where V is the time at
which all sources together have given r windows. So any task can tell the deficits with which
any round starts, and no round waits for another: the tasks need only the token totals per
source and the tokens of the same source that lie in earlier parts of the input.

The rounds follow one another in one stream, which is cut every ``length`` tokens. A round
differs from a window by less than one token for each source, so every sequence has the target
proportions to within that. By default the weights are the token totals, so that all queues
end together and every sequence is a picture of the whole; with other weights the queues that
have run dry leave their share to the rest. Only the rest after the last full sequence is
shorter: it is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import scratch_path
from histomesh.llm.words import pieces as byte_ranges
from histomesh.llm.words import utf8

BROADCAST_OFFSETS = 500_000
#: A letter run with punctuation behind it; between the two the tokenizer always cuts.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-;=?@\\[-`{}~]*)\\Z")


class WordTokens:
    """Ids of white-space-separated words, each word tokenised once as long as it is remembered.

    For tokenizers that drop white space and never look across it: the ids of a text are those of
    its words, one after another. Unknown words go through the tokenizer together. Runs of
    letters or of punctuation are told apart by the tokens that end a word, if the vocabulary
    marks those and their number is right; others by one of the tokenizer's special tokens.
    """

    def __init__(self, path: str, mark: str, most: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.most, self.known = most, {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str], plain: bool) -> dict[str, bytes]:
        found = {}
        joined = [w for w in words if self.mark not in w]
        for w in words:
            if self.mark in w:
                found[w] = self._ids(w).tobytes()
        for k in range(0, len(joined), 2000):
            some = joined[k : k + 2000]
            ids = self._ids(" ".join(some)) if plain else None
            ends = np.flatnonzero(self.closes[ids]) + 1 if plain else ()
            gap = 0
            if len(ends) != len(some):
                ids, gap = self._ids(self.mark.join(some)), 1
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                found[w] = raw[4 * at : 4 * end]
                at = end + gap
        return found

    def of(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of distinct words."""
        known = self.known
        found = list(map(known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        split, runs, others = [], set(), set()
        for k in missing:
            plain = _PLAIN.match(words[k])
            if plain:
                a, b = plain[1].lower(), plain[2]
                if a not in known:
                    runs.add(a)
                if b not in known:
                    runs.add(b)
            else:
                a, b = words[k], ""
                others.add(a)
            split.append((a, b))
        new = self._learn(list(runs), True) | self._learn(list(others), False)
        if len(known) + len(new) <= self.most:
            known |= new
            new = known
        for k, (a, b) in zip(missing, split, strict=True):
            ids = new[a] if a in new else known[a]
            found[k] = ids + (new[b] if b in new else known[b]) if b else ids
        return found


@lru_cache(maxsize=2)
def _words(path: str, mark: str, most: int) -> WordTokens:
    return WordTokens(path, mark, most)


def _tokenise(path: str, mark: str, end_id: int, remembered: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, queued = _words(path, mark, remembered), TaskContext.get().partitionId(), {}
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for row, to in byte_ranges(offsets, step):
                rows = batch.slice(row, to - row)
                split = pc.ascii_split_whitespace(rows.column(2))
                counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
                coded = split.flatten().dictionary_encode()
                codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                known = tokens.of(words)
                sizes = np.array([len(k) // 4 for k in known], np.int64)
                flat = np.frombuffer(b"".join(known), "<u4")
                first = np.concatenate(([0], np.cumsum(sizes)))
                each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
                until = np.concatenate(([0], np.cumsum(each)))
                ids = flat[np.repeat(first[codes] - until[:-1], each) + np.arange(until[-1])] if len(codes) else flat
                word_at = np.concatenate(([0], np.cumsum(counts)))
                lengths = np.diff(until[word_at]) + 1
                ends = np.cumsum(lengths)
                whole = np.full(ends[-1], end_id, "<u4")
                inner = np.ones(len(whole), bool)
                inner[ends - 1] = False
                whole[inner] = ids
                kind = "<u2" if tokens.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                raw, width = whole.astype(kind).tobytes(), int(kind[2])
                begins = ends - lengths
                before = []
                for source, n in zip(rows.column(1).to_pylist(), lengths.tolist(), strict=True):
                    before.append(queued.get(source, 0))
                    queued[source] = before[-1] + n
                data = [raw[width * a : width * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * len(data), pa.int64()), pa.array(before, pa.int64()), pa.array(lengths), pa.array([width] * len(data), pa.int32()), pa.array(data, pa.binary())],
                    ["id", "source", "part", "before", "n", "width", "ids"],
                )

    return run


class Rounds:
    """Deficit round robin in closed form over sources with ``sizes`` and whole-number ``weights``."""

    def __init__(self, sizes: list[int], weights: list[int], length: int):
        self.sizes, self.weights, self.length, self.total = sizes, weights, length, sum(sizes)
        order = sorted(range(len(sizes)), key=lambda s: Fraction(sizes[s], weights[s]))
        gone, active = 0, sum(weights)
        self.until, self.phases = [], []
        for s in order:
            self.phases.append((gone, active))
            self.until.append(gone + active * Fraction(sizes[s], weights[s]))
            gone, active = gone + sizes[s], active - weights[s]
        self.after = lru_cache(maxsize=4096)(self._after)

    def _after(self, r: int) -> tuple[list[int], list[int]]:
        """Tokens each source has given after ``r`` rounds, and their running sums."""
        given = r * self.length
        if given >= self.total:
            served = self.sizes
        else:
            gone, active = self.phases[bisect_right(self.until, given)]
            served = [min(n, w * (given - gone) // active) for n, w in zip(self.sizes, self.weights, strict=True)]
        sums = [0]
        for n in served:
            sums.append(sums[-1] + n)
        return served, sums

    def round_of(self, s: int, token: int) -> int:
        """The round in which source ``s`` gives its token number ``token``."""
        low, high = 0, -(-self.total // self.length)
        while low < high:
            middle = (low + high) // 2
            if self.after(middle + 1)[0][s] > token:
                high = middle
            else:
                low = middle + 1
        return low

    def stretches(self, s: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(first token, end, place in the stream of the first) for tokens of source ``s``."""
        r = self.round_of(s, start)
        while start < end:
            (_, now), (served, then) = self.after(r), self.after(r + 1)
            to = min(end, served[s])
            if to > start:
                yield start, to, then[s] + now[-1] - now[s + 1] + start
                start = to
            r += 1


def cuts_of_rest(total: int, length: int) -> list[int]:
    """Ends, in the stream, of the sequences behind the last full one: powers of two."""
    at, found = total - total % length, []
    for bit in reversed(range(length.bit_length())):
        if (total % length) >> bit & 1:
            at += 1 << bit
            found.append(at)
    return found


def _place(names: list, sizes: list[int], weights: list[int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, index = Rounds(sizes, weights, length), {name: k for k, name in enumerate(names)}
        full = rounds.total // length
        rest = cuts_of_rest(rounds.total, length)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                out = [[] for _ in range(7)]
                each = zip(*(rows.column(k).to_pylist() for k in range(1, 6)), strict=True)
                for row, (source, begin, n, width, raw) in enumerate(each):
                    data = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                    for start, end, place in rounds.stretches(index[source], begin, begin + n):
                        while start < end:
                            sequence = place // length
                            if sequence < full:
                                first, last = sequence * length, (sequence + 1) * length
                            else:
                                k = bisect_right(rest, place)
                                sequence, first, last = full + k, rest[k - 1] if k else full * length, rest[k]
                            m = min(end - start, last - place)
                            a = start - begin
                            for column, value in zip(out, (row, a, m, n, sequence, place - first, data[4 * a : 4 * (a + m)]), strict=True):
                                column.append(value)
                            start, place = start + m, place + m
                ids = rows.column(0).take(pa.array(out[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, pa.int64()) for c in out[1:6]), pa.array(out[6], pa.binary())],
                    ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    length: int = 4096,
    end_id: int = 2,
    mark: str = "<|startoftext|>",
    weights: dict[str | None, int] | None = None,
    remembered: int = 200_000,
    step: int = 2 << 20,
) -> DataFrame:
    """Pieces of the documents' token lists, placed in sequences of ``length`` tokens.

    ``tokenizer`` is the path of a tokenizer file that drops white space; ``mark`` one of its
    special tokens; ``weights`` whole numbers by source (by default the token totals). A task
    works through ``step`` bytes of text at a time and remembers the ids of ``remembered`` words:
    more of both costs memory and saves time, and changes no result.
    Null texts are empty and still give ``end_id``; a null source is a source of its own, last in
    order; null or repeated keys are packed row by row. A long text is cut wherever a round or a
    sequence ends. An empty table gives no rows. The number of sources is taken to be small
    beside the number of documents: their totals reach the driver and every task.
    Returns key, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    path = scratch_path(spark, "tokens")
    shape = f"id {kind}, source string, part long, before long, n long, width int, ids binary"
    rows.mapInArrow(_tokenise(tokenizer, mark, end_id, remembered, step), shape).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    totals = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    sizes = [totals[s] for s in names]
    shares = [(weights or totals)[s] for s in names]
    if parts.count() <= BROADCAST_OFFSETS:
        starts = F.broadcast(starts)
    queued = tokens.join(starts, (tokens["part"] == starts["p"]) & tokens["source"].eqNullSafe(starts["s"]))
    queued = queued.select("id", "source", (F.col("base") + F.col("before")).alias("begin"), "n", "width", "ids")
    shape = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return queued.mapInArrow(_place(names, sizes, shares, length), shape).withColumnRenamed("id", key)
