"""Byte-level BPE encoding and decoding with forced boundaries.

A merge only ever joins bytes that stand side by side inside the token it makes. A byte pair that occurs inside no token of
the vocabulary is therefore a certain cut: no token spans it. Texts are cut there and between pre-tokens, the fragments are encoded
on their own, and the ids are concatenated. Cutting, recognising known fragments and laying out ids work on the arrays of many texts
at once; only a fragment that the task's bounded table lacks is encoded by the library's model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import frugal

#: Slots of a task's table of known fragments, and ids that it may hold before it starts anew.
SLOTS_BITS, POOL = 19, 1 << 21
#: Characters of the texts that are encoded together; a longer text is encoded alone.
CHARACTERS = 1 << 19
#: Code points whose kinds are learnt together.
BLOCK = 1024
LETTER, NUMBER, OTHER, WHITE, UNKNOWN = range(5)
#: Endings that an apostrophe and these letters make a pre-token of their own.
SHORT, LONG = ["s", "t", "m", "d"], ["re", "ve", "ll"]

MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Decoder:
    """The bytes of each id, one after another in an array."""

    def __init__(self, path: str):
        self.letters = byte_alphabet()
        of_letter = {c: b for b, c in self.letters.items()}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.bytes_of: dict[int, bytes] = {i: bytes(map(of_letter.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.lengths = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.lengths[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ``ids``; ``counts`` says how many ids each has."""
        lengths = self.lengths[ids]
        data = self.data[runs(self.starts[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


class Codec(Decoder):
    """A task's encoder, which can also decode."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        added = self.added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.forced = np.ones(1 << 16, bool)
        for i, token in self.bytes_of.items():
            if i not in added.values() and len(token) > 1:
                pairs = np.frombuffer(token, np.uint8).astype(np.int64)
                self.forced[pairs[:-1] << 8 | pairs[1:]] = False
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        slots = 1 << SLOTS_BITS
        self.words, self.sizes = np.zeros((2, slots), np.uint64), np.zeros(slots, np.uint8)
        self.at, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """Whether the library's pre-tokenizer takes each code point as a letter, a number, white space or something else."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            for block in np.unique(points[kinds == UNKNOWN] // BLOCK).tolist():
                some = [c for c in range(block * BLOCK, (block + 1) * BLOCK) if not 0xD800 <= c < 0xE000]
                self.kinds[some] = WHITE
                for kind, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                    asked = "\n".join(f"{like}{chr(c)}{like}" for c in some)
                    whole = {a for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(asked) if b - a == 3}
                    self.kinds[[c for i, c in enumerate(some) if 4 * i in whole]] = kind
            kinds = self.kinds[points]
        return kinds

    def pretokens(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in texts that stand one after another; ``first`` marks their first code points and the end.

        Runs of one kind are pre-tokens. Of white space before something else, the last character stands apart, and joins what follows if
        it is a blank. An apostrophe that nothing precedes in its pre-token may take some letters along.
        """
        kinds = self.kinds_of(points)
        begins = first[:-1].copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        white = kinds == WHITE
        last = white & ~first[1:]
        last[:-1] &= ~white[1:]
        begins |= last
        begins[1:] &= ~(last & (points == ord(" ")))[:-1]
        at = np.flatnonzero(begins & (points == ord("'")))
        if len(at):
            after = np.append(points, [0, 0])
            ended = np.append(first, [True, True])
            a, b = np.where(ended[at + 1], 0, after[at + 1]), np.where(ended[at + 1] | ended[at + 2], 0, after[at + 2])
            short = np.isin(a, list(map(ord, SHORT)))
            long = np.any([(a == ord(x)) & (b == ord(y)) for x, y in LONG], axis=0)
            begins[at[short | long] + 1] = False
            following = np.append(at[short] + 2, at[long] + 3)
            begins[following[following < len(points)]] = True
        return begins

    def remember(self, ids: list[int]) -> int:
        """Put a fragment's ids into the pool; where they are."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32))
        self.pool[at : self.used] = ids
        return at

    def fragment(self, data: bytes) -> list[int]:
        return [t.id for t in self.tokenize("".join([self.letters[b] for b in data]))]

    def fragments(self, data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each fragment of ``data`` are, and how many. Fragments of up to 16 bytes are looked up as two
        numbers in a table in which a later fragment may take an earlier one's slot; each new one is encoded once."""
        if self.used > POOL:
            self.sizes[:], self.used = 0, 0
        overlapping = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))
        sizes = np.minimum(lengths, 17)
        low = overlapping[starts] & MASKS[np.minimum(sizes, 8)]
        high = overlapping[np.minimum(starts + 8, len(data))] & MASKS[np.clip(sizes - 8, 0, 8)]
        mixed = (low * P ^ (high + sizes.astype(np.uint64)) * Q) * P
        slots = ((mixed ^ mixed >> np.uint64(32)) * Q >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        at, count = self.at[slots], self.count[slots]
        known = (self.sizes[slots] == sizes) & (self.words[0][slots] == low) & (self.words[1][slots] == high) & (sizes <= 16)
        fresh: dict[bytes, tuple[int, int]] = {}
        for k in np.flatnonzero(~known).tolist():
            piece = data[starts[k] : starts[k] + lengths[k]]
            found = fresh.get(piece)
            if found is None:
                ids = self.fragment(piece)
                found = fresh[piece] = self.remember(ids), len(ids)
                if len(piece) <= 16:
                    slot = slots[k]
                    self.words[0][slot], self.words[1][slot], self.sizes[slot] = low[k], high[k], sizes[k]
                    self.at[slot], self.count[slot] = found
            at[k], count[k] = found
        return at.astype(np.int64), count.astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if self.split_added and any(map(self.split_added.search, texts)):
            parts = [self.split_added.split(t) for t in texts]
            plain = [p for some in parts for p in some if p not in self.added]
            ids, counts = self.encode(plain)
            pieces, at = iter(np.split(ids, np.cumsum(counts)[:-1])), []
            for some in parts:
                at.append(np.concatenate([np.array([self.added[p]], np.int32) if p in self.added else next(pieces) for p in some]))
            return np.concatenate(at), np.array(list(map(len, at)), np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(list(map(len, texts)))
        first = np.zeros(len(points) + 1, bool)
        first[np.append(0, ends)] = True
        data = joined.encode("utf-8")
        octets = np.frombuffer(data, np.uint8)
        at = np.append(np.flatnonzero(octets & 0xC0 != 0x80), len(octets))
        cuts = np.zeros(len(octets), bool)
        cuts[at[:-1][self.pretokens(points, first)]] = True
        cuts[1:] |= self.forced[octets[:-1].astype(np.int64) << 8 | octets[1:]]
        starts = np.flatnonzero(cuts)
        where, count = self.fragments(data, starts, np.diff(np.append(starts, len(octets))))
        before = np.append(0, np.cumsum(count))[np.searchsorted(starts, at[np.append(0, ends)])]
        return self.pool[runs(where, count)], np.diff(before)


def chunks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHARACTERS together, of one row at least."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > CHARACTERS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _mapped(df: DataFrame, source: str, targets: list[T.StructField], weight: Callable, made: Callable) -> DataFrame:
    """``df`` with the columns ``targets`` made from ``source`` in a worker, some rows at a time. Columns of these names are replaced.

    ``made()`` gives a task its function from values to arrays; what that holds ends with the task.
    """
    names = [t.name for t in targets]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *targets])
    position = df.columns.index(source)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for whole in batches:
            each = each or made()
            columns = [whole.column(whole.schema.get_field_index(c)) for c in kept]
            weights = weight(whole.column(position)).fill_null(0).to_pylist()
            for start, end in chunks(weights):
                arrays = each(whole.column(position).slice(start, end - start))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in columns), *arrays], [*kept, *names])

    return df.mapInArrow(run, schema)


def _listed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids, pa.int32()))


def _width(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.binary_length(column)


def _count(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.list_value_length(column)


def _ids_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType(), False))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the whole text's token ids, as the tokenizers library gives them without special tokens added.

    The string of an added token inside a text becomes that token, as in the library. Null and empty texts give an empty list.
    Every row is kept, repeated rows too; a column already named ``ids`` is replaced. Column names must be distinct.
    """

    def made():
        codec = Codec(vocabulary)
        return lambda column: [_listed(*codec.encode([t or "" for t in column.to_pylist()]))]

    return _mapped(df, text, [_ids_field(ids)], _width, made)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the ids' text, special tokens kept; bytes that are not UTF-8 become U+FFFD. Null ids give an empty text."""

    def made():
        decoder = Decoder(vocabulary)
        return lambda column: [pa.array(decoder.decode(column.flatten().to_numpy(), _count(column).fill_null(0).to_numpy()), pa.string())]

    return _mapped(df, ids, [T.StructField(text, T.StringType())], _count, made)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of the ids it made, in one pass over the rows."""

    def made():
        codec = Codec(vocabulary)

        def each(column: pa.Array) -> list[pa.Array]:
            found, counts = codec.encode([t or "" for t in column.to_pylist()])
            return [_listed(found, counts), pa.array(codec.decode(found, counts), pa.string())]

        return each

    return _mapped(df, text, [_ids_field(ids), T.StructField(decoded, T.StringType())], _width, made)


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = round_trip(documents.select("doc_id", "text"), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
