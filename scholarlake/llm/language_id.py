"""Operator 10: language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is
built. A text is parsed greedily into the longest phrases that occur in that sample;
the language that needs the fewest normalised phrases wins: a phrase is worth the
logarithm of the sample's length, as a longer sample holds longer phrases of any
language. The automaton is kept as sorted (state, letter) keys with (next state, phrase
begun), over the letters of the language's own sample, all of them. A worker spreads the
most frequent letters of a language into a dense table, so that parsing runs in lockstep
over many pieces of text with numpy gathers; rarer letters are looked up among the keys.
Long texts are parsed in pieces of ``PIECE`` characters, whose parses are then joined as
if the text had been parsed in one.

Every lang value is learned; they are broadcast in groups of ``GROUP`` languages. Every
document is scored whole.

Defined results: null text or a text without letters is ``und`` with score 0; with no
labelled text every document is ``und``; equal phrase counts go to the smaller language
name; a null doc_id is held out of nothing (its fold is null and reads as false) and is
not learned from; repeated rows are scored each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_remainder, materialize, near, read_table

PIECE = 1024
LANES = 4096
#: About so many characters are parsed at a time.
BATCH_CHARS = 4 << 20
#: Languages in one broadcast (some 2 MB each).
GROUP = 64
#: Bytes of dense tables that a worker holds; those of further languages are spread anew for each batch.
DENSE_BYTES = 128 << 20


def letters_only(text: str) -> str:
    """Lower case; every run of other characters than letters, and the marks that combine with them, is one space. Empty without a letter."""
    text = text.lower()
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    there = set(text)
    if not any(c.isalpha() for c in there):
        return ""
    return " ".join(text.translate({ord(c): " " for c in there if not (c.isalpha() or unicodedata.category(c)[0] == "M")}).split())


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


class Automaton:
    """Suffix automaton of ``codes``, built online."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class Language:
    """One language's automaton: sorted keys state * (letters + 1) + letter, and steps 2 * next state + phrase ended.

    Letters are numbered within the language: the ``dense`` most frequent, then one
    number for every letter that its sample lacks, then the rarer ones.
    """

    def __init__(self, text: str, codes: dict[str, int], letters: int):
        counts: dict[str, int] = {}
        for c in text:
            counts[c] = counts.get(c, 0) + 1
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        self.dense = min(letters, len(alphabet))
        own = {c: i + (i >= self.dense) for i, c in enumerate(alphabet)}
        self.span = len(alphabet) + 1
        self.own = np.full(len(codes) + 1, self.dense, np.int32)
        for c, i in own.items():
            self.own[codes[c]] = i
        automaton = Automaton([own[c] for c in text])
        self.states = len(automaton.next)
        ways = np.array([(s * self.span + c, 2 * t + (s == 0)) for s, to in enumerate(automaton.next) for c, t in to.items()], np.int64).reshape(-1, 2)
        ways = ways[np.argsort(ways[:, 0])]  # at the root no phrase is open, so any letter starts one
        self.keys, self.steps = np.ascontiguousarray(ways[:, 0]), ways[:, 1].astype(np.int32)

    @property
    def rare(self) -> bool:
        return self.span > self.dense + 1

    def table(self) -> np.ndarray:
        """Steps by state * (dense + 1) + letter, for the dense letters and unknown ones."""
        state, letter = np.divmod(self.keys, self.span)
        some = letter < self.dense
        table = np.empty((self.states, self.dense + 1), np.int32)
        # no way on: a phrase ends and the letter starts the next one; an unknown one is a phrase
        table[:] = np.append(self.steps[some & (state == 0)], 1)
        table[state[some], letter[some]] = self.steps[some]
        return table.reshape(-1)

    def look_up(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Steps for letters that the sample holds."""
        key = state.astype(np.int64) * self.span + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at = np.where(self.keys[at] == key, at, np.searchsorted(self.keys, letter))
        return self.steps[at]


    def advance(self, table: np.ndarray, state: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Steps (2 * next state + phrase begun) from states by letters of the common alphabet."""
        width = self.dense + 1
        own = self.own[letters]
        if self.rare and len(rare := np.flatnonzero(own >= width)):
            step = table[state * width + np.minimum(own, self.dense)]
            step[rare] = self.look_up(state[rare], own[rare])
            return step
        return table[state * width + own]

    def parse(self, table: np.ndarray, grid: np.ndarray, lengths: np.ndarray):
        """(phrases begun, last state, steps by letter) of lanes that start at the root; lanes are sorted, the longest first."""
        active = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # lanes still running at each step
        state, ended = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
        path = np.zeros(grid.shape, np.int32)
        for i in range(len(grid)):
            m = active[i]
            step = self.advance(table, state[:m], grid[i, :m])
            path[i, :m] = step
            ended[:m] += step & 1
            state[:m] = step >> 1
        return ended, state, path

    def resume(self, table: np.ndarray, grid: np.ndarray, lengths: np.ndarray, state: np.ndarray, held: np.ndarray):
        """(change of phrases, last state, steps) of lanes that go on from ``state``, where ``held`` are their steps so far."""
        change, path = np.zeros(len(lengths), np.int64), held.copy()
        last = held[lengths - 1, np.arange(len(lengths))] >> 1
        going, state = np.arange(len(lengths)), state.copy()
        for i in range(len(grid)):
            going = going[lengths[going] > i]
            if not len(going):
                break
            step = self.advance(table, state[going], grid[i, going])
            change[going] += (step & 1) - (held[i, going] & 1)
            path[i, going] = step
            state[going] = step >> 1
            last[going] = np.where(lengths[going] == i + 1, step >> 1, last[going])
            going = going[step >> 1 != held[i, going] >> 1]  # the others agree from here on
        return change, last, path


class Model:
    """Languages, the letters of all their samples, and their automata."""

    def __init__(self, texts: dict[str, str], letters: int = 95):
        self.languages = sorted(texts)
        counts: dict[str, int] = {}
        for text in texts.values():
            for c in text:
                counts[c] = counts.get(c, 0) + 1
        alphabet = sorted(counts, key=lambda c: (-counts[c], c))
        self.codes = {c: i for i, c in enumerate(alphabet)}
        self.lookup = np.full(0x110000, len(alphabet), np.int32)  # the last code is any other letter
        for c, i in self.codes.items():
            self.lookup[ord(c)] = i
        self.parts = [Language(texts[language], self.codes, letters) for language in self.languages]
        self.worth = np.array([np.log2(len(texts[language]) + 1) for language in self.languages])
        self.spread: dict[int, np.ndarray] = {}

    @property
    def roots(self) -> list[int]:
        """Number of states before each language's root."""
        return np.cumsum([0, *[p.states for p in self.parts]])[:-1].tolist()

    @property
    def table(self) -> np.ndarray:
        """Keys and steps of all languages."""
        return np.concatenate([np.stack([p.keys, p.steps]) for p in self.parts], axis=1) if self.parts else np.empty((2, 0), np.int64)

    def share(self, spark_context):
        """A function for the workers that returns the model, broadcast in groups of languages."""
        frame = Model.__new__(Model)
        frame.__dict__ |= self.__dict__ | {"parts": [], "spread": {}}
        held = [spark_context.broadcast(x) for x in [frame, *[self.parts[at : at + GROUP] for at in range(0, len(self.parts), GROUP)]]]

        def whole() -> Model:
            model = held[0].value
            model.parts = [part for group in held[1:] for part in group.value]
            return model

        return whole

    def dense(self, g: int) -> np.ndarray:
        if g in self.spread:
            return self.spread[g]
        table = self.parts[g].table()
        if sum(t.nbytes for t in self.spread.values()) + table.nbytes <= DENSE_BYTES:
            self.spread[g] = table
        return table

    def encode(self, text: str) -> np.ndarray:
        return self.lookup[np.frombuffer(letters_only(text).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language.

        Texts are cut into pieces that are parsed in lockstep, each from the root. Then the
        parse of a piece is taken up from the state in which the piece before it ended, as
        far as it differs: once both are in one state they agree for good. A piece whose
        last state changes so sends the next one round again.
        """
        out = np.zeros((len(coded), len(self.parts)), np.int64)
        pieces = [(k, at, min(PIECE, len(x) - at)) for k, x in enumerate(coded) for at in range(0, len(x), PIECE)]
        lengths = np.array([n for *_, n in pieces], np.int64)
        owner = np.array([k for k, *_ in pieces], np.int64)
        later = np.array([at > 0 for _, at, _ in pieces], bool)  # behind another piece of its text
        followed = np.r_[later[1:], False] if len(pieces) else later
        slot = np.cumsum(later) - 1
        letters = np.zeros((int(later.sum()), PIECE), np.int32)  # of the later pieces, and below their steps
        for n in np.flatnonzero(later).tolist():
            k, at, size = pieces[n]
            letters[slot[n], :size] = coded[k][at : at + size]
        order = np.argsort(-lengths, kind="stable")
        blocks = [(order[at : at + LANES], self.grid(coded, pieces, order[at : at + LANES])) for at in range(0, len(order), LANES)]
        for g, part in enumerate(self.parts):
            table = self.dense(g)
            ended, last = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
            steps = np.zeros_like(letters)
            for members, grid in blocks:
                ended[members], last[members], path = part.parse(table, grid, lengths[members])
                steps[slot[members[later[members]]], : len(grid)] = path[:, later[members]].T
            due = np.flatnonzero(later)
            while len(due):
                again = []
                for at in range(0, len(due), LANES):
                    some = due[at : at + LANES]
                    longest = int(lengths[some].max())
                    change, state, path = part.resume(table, letters[slot[some], :longest].T, lengths[some], last[some - 1], steps[slot[some], :longest].T)
                    ended[some] += change
                    steps[slot[some], :longest] = path.T
                    again.append(some[(state != last[some]) & followed[some]] + 1)
                    last[some] = state
                due = np.concatenate(again)
            np.add.at(out[:, g], owner, ended)
        return out

    @staticmethod
    def grid(coded: list[np.ndarray], pieces: list[tuple[int, int, int]], members: np.ndarray) -> np.ndarray:
        """Letters by step and lane; the longest piece comes first."""
        grid = np.zeros((pieces[members[0]][2], len(members)), np.int32)
        for lane, m in enumerate(members.tolist()):
            k, at, n = pieces[m]
            grid[:n, lane] = coded[k][at : at + n]
        return grid

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        coded = [self.encode(t or "") for t in texts]
        if not self.languages:
            return ["und"] * len(coded), np.zeros(len(coded))
        # phrases, each worth the logarithm of the sample's length, so that a longer sample is no advantage
        counts = self.phrases(coded) * self.worth
        sizes = np.array([max(len(c), 1) for c in coded])
        rate = counts / sizes[:, None]
        best = np.round(counts, 6).argmin(axis=1)
        # a softmax of code lengths, tempered by text size
        odds = np.exp(-(rate - rate.min(axis=1, keepdims=True)) * np.minimum(sizes, 200)[:, None] / self.worth.mean())
        score = 1 / odds.sum(axis=1)
        empty = np.array([len(c) == 0 for c in coded])
        return ["und" if e else self.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)], np.where(empty, 0.0, score)


def fit(labelled: DataFrame, sample_chars: int = 40_000, sample_docs: int = 400, model_chars: int = 8_000_000) -> Model:
    """Learn from (doc_id, text, lang), every lang value.

    A language's sample is ``sample_chars`` letters and spaces of at most ``sample_docs``
    documents, the first in hash order; with many languages it is smaller, as all samples
    together are at most ``model_chars`` (some 60 bytes each in the broadcast model). What
    reaches the driver is at most four times that.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = materialize(usable.groupBy("lang").count(), "languages")
    languages = counts.count()
    chars = max(200, min(sample_chars, model_chars // max(languages, 1)))
    # the first in hash order lie below this share of all hashes, so a hot language is cut before it is ranked
    share = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * F.col("count") < 4 * sample_docs + 100
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    first = usable.join(near(languages)(counts), "lang").filter(share)
    first = first.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample_docs)
    # of each only what the sample can still hold
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(4 * chars) - before
    rows = first.withColumn("_room", room).filter("_room > 0").select("lang", "_r", F.left("text", F.col("_room").cast("int")).alias("text"))
    texts: dict[str, str] = {}
    for r in rows.orderBy("lang", "_r").toLocalIterator():  # one partition at a time
        held = texts.get(r["lang"], "")
        if len(held) < chars:
            texts[r["lang"]] = (held + " " + letters_only(r["text"]))[:chars]
    return Model({k: v for k, v in texts.items() if v.strip()})


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    shared = model.share(docs.sparkSession.sparkContext)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared()
        for batch in batches:
            size = batch["text"].str.len().fillna(0).astype(np.int64).to_numpy()
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff((np.cumsum(size) - size) // BATCH_CHARS)) + 1):
                part = batch.iloc[rows]
                names, score = model.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": names, "score": score})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_remainder("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
