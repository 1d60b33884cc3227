"""Runs: stretches of consecutive words that repeat with a period, found with suffix automata.

The end positions of a state of a text's suffix automaton are where the state's longest string ends. They are the union of those of the
states whose suffix links lead to it, so ordered sets are merged up the links, the smaller into the larger. Positions that become
neighbours in a state of length n have equal words before them, n at least; if their distance d is no larger than n, the last 2d words
are a square of period d. Every square of a primitive word becomes known that way, as its two halves' ends are neighbours where they
meet. Squares are extended to both sides as far as the period holds, which gives the runs.

Words that lie in no run are cut out first: in a run of four periods each word stands four times. What is left between cuts is cut
again while that shortens it, and only the remaining fragments need automata. Cutting works on the arrays of many texts together.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has this many periods and words at least.
PERIODS, WORDS = 4, 6
#: Rounds of cutting. More rounds only spare automata; they change no result.
ROUNDS = 8
#: Positions in a block of an ordered set, twice at most.
BLOCK = 512
#: Words of the texts that are cut together; a longer text is alone.
TOGETHER = 500_000


class Ends:
    """An ordered set of end positions, in blocks of bounded size."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, end: int):
        self.blocks, self.firsts, self.size = [[end]], [end], 1

    def add(self, end: int) -> tuple[int, int]:
        """Put a new position in; returns its neighbours, or itself where it has none."""
        k = max(bisect(self.firsts, end) - 1, 0)
        block = self.blocks[k]
        i = bisect(block, end)
        before = block[i - 1] if i else end
        after = block[i] if i < len(block) else self.firsts[k + 1] if k + 1 < len(self.firsts) else end
        block.insert(i, end)
        self.size += 1
        if not i:
            self.firsts[k] = end
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = block[:BLOCK], block[BLOCK:]
            self.firsts.insert(k + 1, block[BLOCK])
        return before, after


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton of a text: the longest string's length, the suffix link, and the end of the prefix
    that it stands for, or -1."""
    lengths, links, follow, ends, last = [0], [-1], [{}], [-1], 0
    for end, code in enumerate(codes):
        state, at = len(lengths), last
        lengths.append(end + 1)
        links.append(0)
        follow.append({})
        ends.append(end)
        while at >= 0 and code not in follow[at]:
            follow[at][code] = state
            at = links[at]
        if at >= 0:
            target = follow[at][code]
            if lengths[target] > lengths[at] + 1:
                split = len(lengths)
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                follow.append(follow[target].copy())
                ends.append(-1)
                links[target] = split
                while at >= 0 and follow[at].get(code) == target:
                    follow[at][code] = split
                    at = links[at]
                target = split
            links[state] = target
        last = state
    return lengths, links, ends


def squares(codes: list[int]) -> Iterator[tuple[int, int]]:
    """(period, end) of squares, among them one in each run of two periods or more."""
    lengths, links, ends = automaton(codes)
    sets: list[Ends | None] = [None] * len(lengths)
    for state in np.argsort(-np.array(lengths), kind="stable").tolist()[:-1]:
        own, end, up = sets[state], ends[state], links[state]
        sets[state] = None
        if own is None:
            own = Ends(end)
        elif end >= 0:
            yield from joined(own, end, lengths[state])
        if not up:  # only the empty string is common beyond
            continue
        other = sets[up]
        if other is not None:
            if other.size > own.size:
                own, other = other, own
            for block in other.blocks:
                for position in block:
                    yield from joined(own, position, lengths[up])
        sets[up] = own


def joined(ends: Ends, end: int, length: int) -> Iterator[tuple[int, int]]:
    """The squares that a new position of a state shows with its neighbours."""
    before, after = ends.add(end)
    if 0 < end - before <= length:
        yield end - before, end
    if 0 < after - end <= length:
        yield after - end, after


def agreeing(codes: np.ndarray, start: int, period: int, step: int) -> int:
    """How many words on from ``start``, forward or backward (``step`` 1 or -1), equal the word a period earlier."""
    found, size = 0, 16
    limit = len(codes) - start if step > 0 else start - period + 1
    while found < limit:
        size = min(2 * size, limit - found)
        at = start + found if step > 0 else start - found - size + 1
        differ = np.flatnonzero(codes[at : at + size] != codes[at - period : at - period + size])
        if len(differ):
            return found + int(differ[0] if step > 0 else size - 1 - differ[-1])
        found += size
    return found


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a text, by start and period."""
    found: dict[tuple[int, int], int] = {}
    period, stop = 0, 0
    for square, end in sorted(set(squares(codes.tolist()))):
        if square == period and end < stop:
            continue
        period = square
        stop = end + 1 + agreeing(codes, end + 1, period, 1)
        start = end - agreeing(codes, end, period, -1) + 1 - period
        if stop - start >= max(WORDS, PERIODS * period):
            found.setdefault((start, stop), period)  # periods ascend, so the smallest of a stretch stays
    return sorted((start, stop - start, period) for (start, stop), period in found.items())


def fragments(codes: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of what is left of many texts between words that lie in no run; ``texts`` numbers each word's text."""
    at, part, words = np.arange(len(codes)), texts, int(codes.max(initial=0)) + 1
    for _ in range(ROUNDS):
        _, which, counts = np.unique(part * words + codes[at], return_inverse=True, return_counts=True)
        kept = counts[which] >= PERIODS
        if kept.all():
            break
        at, part = at[kept], part[kept]
        new = np.append(True, (np.diff(at) > 1) | (np.diff(part) != 0))[: len(at)]
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= WORDS
        at, part = at[long], part[long]
    edges = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(part) != 0))[: len(at)])
    for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=False):
        yield int(at[start]), int(at[stop - 1]) + 1


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin, then their number. Words are parted by any of \\x20 and \\x09 to \\x0D."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return words.filter(real), before[bounds]


def runs_and_rest(texts: pa.Array) -> tuple[list[list[tuple[int, int, int]]], pa.Array, np.ndarray]:
    """Each text's runs, its words without those that repeat the first period of a run joined by spaces, and its number of words."""
    words, bounds = split(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    kept = np.ones(len(codes), bool)
    for start, stop in fragments(codes, text_of):
        text = int(text_of[start])
        for first, length, period in runs_of(codes[start:stop]):
            found[text].append((start + first - int(bounds[text]), length, period))
            kept[start + first + period : start + first + length] = False
    offsets = np.append(0, np.cumsum(kept))[bounds]
    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), " ")
    return found, rest, np.diff(bounds)


def _found(batches: Iterator[pa.RecordBatch], position: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(position)), 0).to_numpy(zero_copy_only=False)) // (4 * TOGETHER)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), whole.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            batch = whole.slice(start, stop - start)
            found, rest, n_words = runs_and_rest(batch.column(position))
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in sorted(of)] for of in found], kind)
            columns = [*batch.columns, runs, rest, pa.array(n_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "runs", "collapsed", "n_words"])


def find_runs(documents: DataFrame) -> DataFrame:
    """``documents`` (text) plus runs, collapsed and n_words.

    Words are numbered from 0 and parted by any of \\x20 and \\x09 to \\x0D. A run is a stretch of at least four periods and six words whose
    words a period apart are equal, the period being its smallest, that no word beside it extends. ``runs`` lists (start, length,
    period) by start and period; ``collapsed`` has the words that no run contains beyond its first period, joined by one space. A null
    or empty text has no words, no runs and an empty ``collapsed``. Rows are kept one for one; other columns pass through, but those
    already named like the added ones are replaced. An empty table gives no rows.
    """
    kept = documents.drop("runs", "collapsed", "n_words")
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    added = [T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType()), T.StructField("n_words", T.LongType())]
    return kept.mapInArrow(partial(_found, position=kept.columns.index("text")), T.StructType([*kept.schema.fields, *added]))


def repeating(documents: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by h = crc32 of its decimal id, repeats: with n words, g = h / 10 and a = g % n, words
    from a on are the first 1 + (n - a) / (3 + g % 8) of them over and over. A null id counts as an empty one."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each document: its longest run, of equal ones
    the first, then that of the smallest period, and SHA-256 of all runs, one ``start,length,period`` a line, and of ``collapsed``."""
    found = find_runs(documents.select("doc_id", "text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.longest")
    return told.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
