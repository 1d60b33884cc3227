"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton, which accepts every substring of the sample. A text
is parsed greedily into the longest phrases that the automaton accepts; the fewer phrases it needs, the nearer the language.
Phrases are normalised as c * log2(N) / n, with N the sample's length and n the text's, so samples of unequal length compare.
Texts are parsed whole. So that many steps are taken together, a text is cut into segments that step side by side; a segment
starts in the state that the characters before it most often lead to, and steps again from the right one where that was wrong.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import Scratch

#: Bounds of a language's sample of rows: about so many are drawn by a hash, and of these, whole texts are taken in the hash's order until they
#: have so many characters. No bound depends on the number of languages.
DOCUMENTS, LETTERS = 150, 80_000
#: Values of the hash that rows are drawn by.
DRAWS = 1 << 50
#: Characters of a segment, and of the one before it from which its first state is guessed; neither changes a result.
SEGMENT, WARM = 256, 48
#: Segments that step together.
LANES = 8192


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The suffix automaton of a sequence, packed."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return _packed(following, width)


def _packed(following: list[dict[int, int]], width: int) -> np.ndarray:
    """Arcs in one array, so that memory grows with the arcs and not with the alphabet. A state is a number of its own; its arc for
    a code stands at state + code, as the state (upper 32 bits) and the one it leads to (lower). The root is 0. Unused slots hold -1."""
    size = sum(map(len, following)) * 3 // 2 + 2
    base, used, taken = [0] * len(following), bytearray(size), bytearray(size + width)
    draw = random.Random(0).random
    for state in [0, *sorted(range(1, len(following)), key=lambda x: -len(following[x]))]:
        codes, at = following[state], 0
        while used[at] or any(taken[at + c] for c in codes):
            at = int(draw() * size)
        base[state], used[at] = at, 1
        for c in codes:
            taken[at + c] = 1
    slots = np.full(size + width, -1, np.int64)
    for state, arcs in enumerate(following):
        for c, to in arcs.items():
            slots[base[state] + c] = base[state] << 32 | base[to]
    return slots


class Alphabet:
    """Codes: 0 for a run of non-letters, 1 to n for the letters of all samples, n + 1 for letters of none, n + 2 for padding."""

    def __init__(self, letters: str):
        self.letters = letters
        self.other, self.padding = len(letters) + 1, len(letters) + 2
        self.width = len(letters) + 3
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def table(self) -> np.ndarray:
        if self._table is None:
            code = {c: i for i, c in enumerate(self.letters, 1)}
            self._table = np.zeros(0x110000, np.int32)
            for point in range(0x110000):
                if (c := chr(point)).isalpha():
                    self._table[point] = code.get(c.lower(), self.other)
        return self._table

    def codes(self, text: str) -> np.ndarray:
        """The text's codes; runs of non-letters count as one, and none stands at the ends."""
        found = self.table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not found.any():
            return found[:0]
        first, last = np.flatnonzero(found)[[0, -1]]
        found = found[first : last + 1]
        return found[(found != 0) | np.append(True, found[:-1] != 0)]


class Parser:
    """One language's automaton with steps that never fail: a missing arc opens a phrase, which counts, and leads to where the root
    would go. A letter that the sample lacks is a phrase of its own; it leads to a state without arcs, in which texts also start."""

    def __init__(self, language: str, letters: int, slots: np.ndarray, alphabet: Alphabet):
        self.language, self.log_letters, self.padding = language, float(np.log2(max(letters, 2))), alphabet.padding
        self.start = len(slots)
        self.slots = np.append(slots, np.full(alphabet.width, -1, np.int64))
        root = slots[: alphabet.width]
        self.root = np.where(root >> 32 == 0, root & 0xFFFFFFFF, self.start)

    def step(self, lanes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after each lane of (steps x lanes) codes, and the phrases that opened in it."""
        count = np.zeros(lanes.shape[1], np.int32)
        for row in lanes:
            arc = self.slots.take(state + row)
            missed = arc >> 32 != state
            count += missed
            state = np.where(missed, self.root.take(row), arc & 0xFFFFFFFF)
        return state, count

    def phrases(self, lanes: np.ndarray, goes_on: np.ndarray, state: int | None = None) -> tuple[np.ndarray, int]:
        """Phrases that open in each lane, and the last lane's last state. ``goes_on`` marks lanes that continue the lane before them; for
        the first lane ``state`` says where that ended. Padding stands at the end only."""
        begin = np.full(lanes.shape[1], self.start, np.int64)
        if goes_on[0]:
            begin[0] = state
        later = np.flatnonzero(goes_on[1:]) + 1
        if len(later):
            begin[later], _ = self.step(np.ascontiguousarray(lanes[-WARM:, later - 1]), np.zeros(len(later), np.int64))
        end, count = self.step(lanes, begin)
        while True:
            wrong = later[begin[later] != end[later - 1]]
            if not len(wrong):
                return count - (lanes == self.padding).sum(axis=0, dtype=np.int32), int(end[-1])
            begin[wrong] = end[wrong - 1]
            end[wrong], count[wrong] = self.step(np.ascontiguousarray(lanes[:, wrong]), begin[wrong])


class Model:
    def __init__(self, alphabet: Alphabet, parsers: list[Parser]):
        self.alphabet, self.parsers = alphabet, sorted(parsers, key=lambda p: p.language)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score for each text: ``und`` and 0 without a letter, else the runner-up's share of both measures."""
        languages, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.parsers:
            return languages, scores
        start = 0
        while start < len(texts):
            owners, pieces, lengths, end = [], [], {}, start
            while end < len(texts) and (len(pieces) < LANES or end == start):
                codes = self.alphabet.codes(texts[end] or "")
                lengths[end] = len(codes)
                for at in range(0, len(codes), SEGMENT):
                    owners.append(end)
                    pieces.append(codes[at : at + SEGMENT])
                end += 1
            if pieces:
                total = np.zeros((len(self.parsers), end - start))
                states: list[int | None] = [None] * len(self.parsers)
                same = np.append(False, np.diff(owners) == 0)
                for first in range(0, len(pieces), LANES):
                    some = pieces[first : first + LANES]
                    lanes = np.full((len(some), SEGMENT), self.alphabet.padding, np.int32)
                    for i, piece in enumerate(some):
                        lanes[i, : len(piece)] = piece
                    lanes = np.ascontiguousarray(lanes.T)
                    at = np.array(owners[first : first + LANES]) - start
                    for k, parser in enumerate(self.parsers):
                        opened, states[k] = parser.phrases(lanes, same[first : first + LANES], states[k])
                        total[k] += np.bincount(at, opened, minlength=end - start)
                total *= np.array([[p.log_letters] for p in self.parsers])
                for i in range(start, end):
                    if lengths[i]:
                        order = np.argsort(total[:, i - start], kind="stable")
                        best = total[order[0], i - start]
                        languages[i] = self.parsers[order[0]].language
                        scores[i] = 1.0 if len(order) == 1 else float(total[order[1], i - start] / (best + total[order[1], i - start]))
            start = end
        return languages, scores


def _letters(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"letters": ["".join(sorted(c for c in set().union(*frame["piece"]) if c.isalpha()))]})


def _build(frame: pd.DataFrame, alphabet: Alphabet) -> pd.DataFrame:
    text = " ".join(frame.sort_values("turn", kind="stable")["piece"])
    codes = alphabet.codes(text)
    table = automaton(codes.tolist(), alphabet.width)
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "letters": [len(codes)], "arcs": [table.tobytes()]})


def train(labelled: DataFrame, scratch: Scratch) -> Model:
    """Learn from (doc_id, text, lang); rows with a null text or lang are left out.

    The sample is bounded in rows: of each language about ``DOCUMENTS``, drawn by a hash, and of these as many as hold ``LETTERS``
    characters, the last one whole too. A text that is longer than that alone is taken only after all others. What is taken is
    learnt whole. There is one row per language in what reaches the driver.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    turn = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(6))
    drawn = rows.join(F.broadcast(counts), "lang").filter(F.pmod(turn, F.lit(DRAWS)) * F.col("n").cast("double") < F.lit(float(DRAWS) * DOCUMENTS))
    words = drawn.select("lang", turn.alias("turn"), F.trim(F.regexp_replace(F.lower("text"), r"\P{L}+", " ")).alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.length("piece") > LETTERS, "turn", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0))
    sample = scratch.write(words.withColumn("before", before).filter(F.col("before") < LETTERS).drop("before"), "sample")
    spelled = sample.groupBy("lang").applyInPandas(_letters, "letters string").collect()
    alphabet = Alphabet("".join(sorted(set().union(*(r.letters for r in spelled)))))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return _build(frame, alphabet)

    built = sample.groupBy("lang").applyInPandas(build, "lang string, letters long, arcs binary").collect()
    return Model(alphabet, [Parser(r.lang, r.letters, np.frombuffer(r.arcs, np.int64), alphabet) for r in built])


def _predictions(batches: Iterator[pa.RecordBatch], position: int, model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            languages, scores = model.value.predict(batch.column(position).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` plus lang_pred and score. Without any learned language all is ``und``. At equal measures the first language
    by name wins. Rows are kept one for one; columns already named like the added ones are replaced."""
    kept = documents.drop("lang_pred", "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(partial(_predictions, position=kept.columns.index("text"), model=shared), schema)
