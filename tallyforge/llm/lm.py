"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Counting: each task turns its texts into distinct bigrams with counts and deals them out by the context's hash, or by the bigram's
where the context is frequent, so that no shard holds all of a hot one; a shard merges what it gets and writes the sorted 64-bit bigram
hashes with their counts to the shared folder. What it knows of each context (its total and how
many of its bigrams occur once, twice, more often) and of each word (its distinct predecessors) is dealt out by word in the same
way, and those shards write sorted word tables. Hot words and contexts are summed in the task that meets them, so each arrives as
one number per task. A shard is one file a table, and each shard goes to a partition of its own. Scoring: workers map shard files, a
bounded number at a time, and look up sorted batches of hashes; mapped pages are shared and may be dropped, so memory stays bounded
however large the model is. Every training text is counted whole and nothing is pruned.
"""

from __future__ import annotations

import json
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallyforge.llm.common import Scratch

#: Tokens that a counting task holds before it deals them out, and tokens of a scoring batch.
HELD, BATCH = 1_600_000, 300_000
#: Text bytes that a shard stands for, and the fewest shards.
SHARD_BYTES, FEWEST_BITS = 12 << 20, 4
#: Texts in which frequent contexts are looked for.
SAMPLE = 2_000
#: Words that a task remembers, and files that a task maps at a time.
MEMORY, MAPS = 200_000, 2_000
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Words:
    """A task's memory of words' hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def new(self, word: bytes) -> int:
        if len(self.known) >= MEMORY:
            self.known.clear()
        made = _xxh(word)
        if len(word) <= 64:
            self.known[word] = made
        return made

    def of(self, text: str | None) -> list[int]:
        """Hashes of the text's words and of the end; white space is ASCII, A-Z lower-cased."""
        known = self.known.get
        words = (text or "").encode("utf-8", "replace").lower().split()
        return [known(w) or self.new(w) for w in words] + [END]


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


#: No word holds a line feed.
END, BEGIN = _xxh(b"\n"), _xxh(b"\n\n")


def before(numbers: np.ndarray) -> np.ndarray:
    """Each token's predecessor; a text's first token follows the begin."""
    previous = np.empty_like(numbers)
    previous[0] = BEGIN
    previous[1:] = np.where(numbers[:-1] == np.uint64(END), np.uint64(BEGIN), numbers[:-1])
    return previous


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Bigram hashes from the words' hashes."""
    x = (context * P) ^ (word + Q)
    x = (x ^ (x >> np.uint64(31))) * Q
    return x ^ (x >> np.uint64(29))


def small(numbers: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for those that follow, in full, after them."""
    return np.minimum(numbers, 255).astype(np.uint8).tobytes() + numbers[numbers >= 255].astype(np.int64).tobytes()


def read_small(data: bytes, n: int) -> np.ndarray:
    found = np.frombuffer(data, np.uint8, n).astype(np.int64)
    found[found == 255] = np.frombuffer(data, np.int64, -1, n)
    return found


def hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def spelled(context: np.ndarray, word: np.ndarray) -> tuple[bytes, bytes]:
    """Bigrams as the sorted hashes they use, and places among these: all contexts', then all words'."""
    names, at = np.unique(np.concatenate([context, word]), return_inverse=True)
    return names.tobytes(), at.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32).tobytes()


def read_spelled(names: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    known = hashes(names)
    at = np.frombuffer(places, np.uint16 if len(known) <= 1 << 16 else np.uint32)
    return known[at[: len(at) // 2]], known[at[len(at) // 2 :]]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the values' sums for each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


PARTS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), *((c, pa.binary()) for c in "abcde")])
SCHEMA = "kind string, shard int, a binary, b binary, c binary, d binary, e binary"


def cut(kind: str, shards: np.ndarray, packed: Callable) -> Iterator[tuple]:
    """Rows (kind, shard, packed columns) of entries whose shard numbers rise; ``packed`` gives the columns of a range of entries."""
    starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
    for start, end in zip(starts, [*starts[1:], len(shards)], strict=True):
        columns = packed(slice(start, end))
        yield (kind, int(shards[start]), *columns, *[b""] * (5 - len(columns)))


def dealt_by(context: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What decides about each bigram's shard."""
    if not len(hot):
        return context
    return np.where(hot[np.minimum(np.searchsorted(hot, context), len(hot) - 1)] == context, keys, context)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PARTS, strict=True)], schema=PARTS)


def count(batches: Iterator[pa.RecordBatch], bits: int, hot: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Bigram and word counts of a task's texts, dealt to shards after every ``most`` tokens."""

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        numbers = np.concatenate(held)
        context = before(numbers)
        keys = pair(context, numbers)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts, first = np.diff(np.append(starts, len(keys))), order[starts]
        shards = shard_of(dealt_by(context[first], keys[starts], hot), bits)
        order = np.argsort(shards, kind="stable")
        context, word, counts, shards = context[first][order], numbers[first][order], counts[order], shards[order]
        rows = list(cut("pair", shards, lambda r: (*spelled(context[r], word[r]), small(counts[r]))))
        found, times = np.unique(numbers, return_counts=True)
        rows += cut("word", shard_of(found, bits), lambda r: (found[r].tobytes(), small(times[r])))
        return as_batch(rows)

    words = Words()
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(np.array(words.of(text), np.uint64))
            n += len(held[-1])
            if n >= most:
                yield dealt(held)
                held, n = [], 0
    if held:
        yield dealt(held)


def keep(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Write columns to one file, with a line at its start that says where each is. The file gets its final name in one step; a task
    that runs again writes the same."""
    os.makedirs(folder, exist_ok=True)
    sizes = np.array([len(x) * x.itemsize + -len(x) * x.itemsize % 8 for x in columns.values()])
    heads = [[name, x.dtype.str, len(x), int(at)] for (name, x), at in zip(columns.items(), np.cumsum(sizes) - sizes, strict=True)]
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    rough = f"{folder}/.{name}-{os.getpid()}-{np.random.default_rng().integers(1 << 40)}"
    with open(rough, "wb") as file:
        file.write(head)
        for x in columns.values():
            file.write(x.tobytes() + bytes(-len(x) * x.itemsize % 8))
    os.replace(rough, f"{folder}/{name}")


def mapped(path: str) -> dict[str, np.ndarray]:
    """The columns of a file that ``keep`` wrote, as views of its mapped bytes; none if it does not exist."""
    if not os.path.exists(path):
        return {}
    data = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as file:
        head = file.readline()
    return {name: data[len(head) + at :][: n * np.dtype(kind).itemsize].view(kind) for name, kind, n, at in json.loads(head)}


def of_counts(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]


def merge_pairs(frame: pd.DataFrame, folder: str, bits: int) -> pd.DataFrame:
    """Merge a shard of bigrams, write it, and pass on what it knows of contexts, words and counts; merge a shard of words."""
    shard = int(frame["shard"].iloc[0])
    rows = []
    words = frame[frame["kind"] == "word"]
    if len(words):
        parts = [hashes(x) for x in words["a"]]
        found, times = summed(np.concatenate(parts), np.concatenate([read_small(x, len(p)) for x, p in zip(words["b"], parts, strict=True)]))
        rows.append(("word", shard, found.tobytes(), small(times), b"", b"", b""))
    pairs = frame[frame["kind"] == "pair"]
    if len(pairs):
        parts = [read_spelled(a, b) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
        context, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.concatenate([read_small(x, len(p[0])) for x, p in zip(pairs["c"], parts, strict=True)])
        keys = pair(context, word)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.add.reduceat(counts[order], starts)
        keys, order = keys[starts], order[starts]
        context, word = context[order], word[order]
        large = times >= 255
        keep(folder, f"pair-{shard}", {"key": keys, "count": np.minimum(times, 255).astype(np.uint8), "large": keys[large], "large_count": times[large]})
        rows.append(("stats", -1, of_counts(times).astype(np.int64).tobytes(), b"", b"", b"", b""))
        found, *held = summed(context, times, (times == 1).astype(np.int64), (times == 2).astype(np.int64), (times > 2).astype(np.int64))
        rows += cut("context", shard_of(found, bits), lambda r: (found[r].tobytes(), *(small(x[r]) for x in held)))
        names, preceded = summed(word, np.ones(len(word), np.int64))
        rows += cut("preceded", shard_of(names, bits), lambda r: (names[r].tobytes(), small(preceded[r])))
    return pd.DataFrame(rows, columns=PARTS.names)


SUMS = ["tokens", "words", "pairs", "names", "n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4"]


def merge_words(frame: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Merge a word shard's counts, predecessors and contexts, write them, and return its share of the sums. Shard -1 holds the
    bigram shards' counts of counts (m1 to m4)."""
    shard = int(frame["shard"].iloc[0])
    if shard < 0:
        return pd.DataFrame([[0] * 8 + np.sum([np.frombuffer(x, np.int64) for x in frame["a"]], 0).tolist()], columns=SUMS)
    parts = {kind: some for kind, some in frame.groupby("kind")}

    def merged(kind: str, columns: str) -> tuple[np.ndarray, ...]:
        if kind not in parts:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in columns)
        names = [hashes(x) for x in parts[kind]["a"]]
        counts = [np.concatenate([read_small(x, len(n)) for x, n in zip(parts[kind][c], names, strict=True)]) for c in columns]
        return summed(np.concatenate(names), *counts)

    words, times = merged("word", "b")
    names, preceded = merged("preceded", "b")
    contexts, total, *held = merged("context", "bcde")
    columns = {"word": words, "times": times, "name": names, "preceded": preceded, "context": contexts, "total": total}
    keep(folder, f"word-{shard}", columns | {c: x.astype(np.uint32) for c, x in zip(("once", "twice", "more"), held, strict=True)})
    ones, twos, threes, fours = map(int, of_counts(preceded))
    return pd.DataFrame([[int(times.sum()), len(words), int(preceded.sum()), len(names), ones, twos, threes, fours, 0, 0, 0, 0]], columns=SUMS)


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The modified Kneser-Ney discounts of counts 1, 2, and 3 or more; 0.5, 1 and 1.5 where the counts of counts give none that
    are above 0 and below the count, as in tiny corpora."""
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return [0.5, 1.0, 1.5]


class Model:
    """Where the shard files are, and the sums that all lookups share."""

    def __init__(self, folder: str, bits: int, hot: np.ndarray, high: list[float], low: list[float], sums: dict[str, int]):
        self.hot, self.most_maps = hot, MAPS
        self.folder, self.bits, self.high, self.low, self.sums = folder, bits, high, low, sums
        self.maps: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
        spared = low[0] * sums["n1"] + low[1] * sums["n2"] + low[2] * (sums["names"] - sums["n1"] - sums["n2"])
        self.floor = (spared / sums["pairs"] if sums["pairs"] else 1.0) / (sums["words"] + 1)

    def __getstate__(self):
        return self.__dict__ | {"maps": OrderedDict()}

    def map(self, name: str) -> dict[str, np.ndarray]:
        """A file's columns. The file that has not been used for longest is let go."""
        if name not in self.maps:
            while len(self.maps) >= self.most_maps:
                self.maps.popitem(last=False)
            self.maps[name] = mapped(f"{self.folder}/{name}")
        self.maps.move_to_end(name)
        return self.maps[name]

    def look_up(self, keys: np.ndarray, table: str, key: str, columns: list[str], shards: np.ndarray | None = None) -> list[np.ndarray]:
        """Values of keys in a table's columns, 0 where it lacks the key. Keys are sorted by shard, and within one."""
        found = [np.zeros(len(keys)) for _ in columns]
        shards = shard_of(keys, self.bits) if shards is None else shards
        starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            stored = self.map(f"{table}-{shards[start]}")
            if key not in stored or not len(stored[key]):
                continue
            some = keys[start:end]
            at = np.minimum(np.searchsorted(stored[key], some), len(stored[key]) - 1)
            there = np.flatnonzero(stored[key][at] == some)
            for out, column in zip(found, columns, strict=True):
                out[start + there] = stored[column][at[there]]
        return found

    @staticmethod
    def discount(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
        return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]

    def per_token(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether training has it, base log10 and model log10."""
        words, which = np.unique(numbers, return_inverse=True)
        (times,) = self.look_up(words, "word", "word", ["times"])
        (preceded,) = self.look_up(words, "word", "name", ["preceded"])
        lower = self.floor + (preceded - self.discount(preceded, self.low)) / max(self.sums["pairs"], 1)
        base = np.log10((times + 0.5) / (self.sums["tokens"] + 0.5 * (self.sums["words"] + 1)))
        contexts, of_context = np.unique(before(numbers), return_inverse=True)
        total, *held = self.look_up(contexts, "word", "context", ["total", "once", "twice", "more"])
        spare = np.where(total > 0, sum(d * n for d, n in zip(self.high, held, strict=True)) / np.maximum(total, 1), 1.0)
        keys = pair(contexts[of_context], words[which])
        shards = shard_of(dealt_by(contexts, np.zeros(0, np.uint64), self.hot[:0]), self.bits)[of_context]
        shards = np.where(np.isin(contexts, self.hot)[of_context], shard_of(keys, self.bits), shards)
        order = np.lexsort((keys, shards))
        met = np.empty(len(keys))
        met[order] = self.counts_of(keys[order], shards[order])
        chance = (met - self.discount(met, self.high)) / np.maximum(total, 1)[of_context] + spare[of_context] * lower[which]
        return times[which] > 0, base[which], np.log10(np.maximum(chance, 1e-300))

    def counts_of(self, keys: np.ndarray, shards: np.ndarray) -> np.ndarray:
        (met,) = self.look_up(keys, "pair", "key", ["count"], shards)
        large = np.flatnonzero(met == 255)
        if len(large):
            (met[large],) = self.look_up(keys[large], "pair", "large", ["large_count"], shards[large])
        return met


def by_shard(batches: Iterator[pa.RecordBatch], merge: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply ``merge`` to the rows of each shard of a partition, which are sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column(1).to_numpy()
        starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
        for start, end in zip(starts, [*starts[1:], len(shards)], strict=True):
            if held and held[0].column(1)[0].as_py() != shards[start]:
                yield merge(pa.Table.from_batches(held).to_pandas())
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield merge(pa.Table.from_batches(held).to_pandas())


def merged(rows: DataFrame, shards: int, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: pa.Schema) -> DataFrame:
    """``merge`` of each shard's rows. Every shard has a partition of its own, and what goes with none (-1) has one more."""
    dealt = rows.repartitionById(shards + 1, F.col("shard") + 1).sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in by_shard(batches, merge):
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    return dealt.mapInArrow(run, from_arrow_schema(schema))


def frequent_contexts(texts: DataFrame, rows: int, shards: int, scratch: Scratch) -> np.ndarray:
    """Sorted hashes of contexts that make more than a shard's share of a sample's tokens, fewer than there are shards; the begin is always one. The choice
    spreads the work and changes no result."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found, times = np.unique(np.array([w for t in batch.column(0).to_pylist() for w in words.of(t)], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["word", "n"])

    turn = F.pmod(F.xxhash64(F.col(texts.columns[0])), F.lit(1_000_000))
    counted = texts.filter(turn < int(1_000_000 * min(1.0, SAMPLE / max(1, rows)))).mapInArrow(counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted, "sampled")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = [r.word for r in counted.filter(F.col("n") * shards > total).select("word").collect()]
    return np.unique(np.append(np.array(found, np.int64).view(np.uint64), np.array([BEGIN], np.uint64)))


def train(texts: DataFrame, scratch: Scratch, text: str = "text") -> Model:
    """Count the column ``text`` (null: empty) of all rows and write the model to the shared folder, which must be mounted."""
    volume, rows = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    bits = max(FEWEST_BITS, int(np.ceil(np.log2(max(1, volume / SHARD_BYTES)))))
    folder = scratch.posix("model")

    most, hot = HELD, frequent_contexts(texts.select(text), rows, 1 << bits, scratch)

    def counted(batches):
        return count(batches, bits, hot, most)

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        return merge_pairs(frame, folder, bits)

    def words(frame: pd.DataFrame) -> pd.DataFrame:
        return merge_words(frame, folder)

    of_pairs = merged(texts.select(text).mapInArrow(counted, SCHEMA), 1 << bits, pairs, PARTS)
    sums = merged(of_pairs, 1 << bits, words, pa.schema([(c, pa.int64()) for c in SUMS]))
    totals = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).first().asDict()
    high, low = (discounts_of(*(totals[f"{c}{k}"] for k in range(1, 5))) for c in "mn")
    return Model(folder, bits, hot, high, low, totals)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` plus n_tokens, n_known, base_score and score of the column ``text``.

    A null or empty text is one end token. The end counts as a token. Rows are kept one for one; columns already named like the added
    ones are replaced. A model of no texts gives every token the chance 1.
    """
    made = ["n_tokens", "n_known", "base_score", "score"]
    kept = documents.drop(*made)
    position = kept.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def told(rows: pa.RecordBatch, held: list[int], lengths: list[int]) -> pa.RecordBatch:
        known, base, chance = shared.value.per_token(np.array(held, np.uint64))
        starts = np.append(0, np.cumsum(lengths)[:-1])
        columns = [pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(chance, starts))]
        return pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            held, lengths, start = [], [], 0
            for i, text in enumerate(batch.column(position).to_pylist()):
                some = words.of(text)
                held += some
                lengths.append(len(some))
                if len(held) >= BATCH or i == batch.num_rows - 1:
                    yield told(batch.slice(start, i + 1 - start), held, lengths)
                    held, lengths, start = [], [], i + 1

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_tokens long, n_known long, base_score double, score double"])
    return kept.mapInArrow(run, schema)
