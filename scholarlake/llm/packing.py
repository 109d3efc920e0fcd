"""Operator 3: mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. In a round a queue is served its
quantum, a fixed share of ``window_sequences`` * ``seq_len`` tokens (by default its share
of the corpus, else by ``shares``). What a quantum leaves as a fraction is the queue's
deficit and is carried to the next round. As quanta are constant, the state of the
round-robin before round k is closed-form: a queue of t tokens and quantum a / rounds has
been served min(t, floor(k * a / rounds)) tokens. So no task depends on another's run:
windows and partitions carry deficits through that formula alone. A queue that has run
dry is passed over, and rounds go on until all are. The stream is then cut every
``seq_len`` tokens, so that only the last sequence needs padding.

However many sources there are, each has its own queue: beyond ``FAN`` sources the queues
are the leaves of a tree of round-robins, where a node's queue is what the round-robin of
its children serves. A document meets the totals along its own path only.

Tokens are served in the order of a hash-blocked prefix sum, which splits a queue with a
third of all rows; there is a block per ``block_tokens`` tokens, ``blocks`` at least, so that
what one task sorts does not grow. The mixture holds per window: inside one, each queue's
quantum is one run.

Defined results: a null text is an empty document (its end token is packed); null
source is a source of its own; rows with a repeated or null doc_id are packed each; the
strings of the tokenizer's special tokens are what the tokenizer makes of them; other
columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

CACHE_WORDS = 1_500_000
#: Signs that end a word; a run of them behind a letter or digit is a token of its own or several.
ENDINGS = ".,;:!?%*$&#"
#: Letters below this code point are letters to every version of the tokenizer's pattern.
PLAIN = "\u0500"
#: Texts are encoded in slices of about so many bytes.
SLICE_BYTES = 8 << 20
#: Queues that one round-robin serves.
FAN = 64
#: Paths of sources are broadcast up to so many bytes; beyond it they are shuffled.
BROADCAST_BYTES = 64 << 20


def byte_letters() -> dict[int, int]:
    """The letters that byte-level tokenizers write for bytes: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(others)}


BYTES = byte_letters()


class Chunks:
    """The ids of chunks of text, as bytes, learned as they come.

    A chunk starts at a single space (not written), at a line feed, or at the start of a
    text (marked by a zero character). The byte-level pattern never joins a character to
    one before a single space or line feed, so the ids of a text are those of its chunks,
    unless white space touches a chunk's edge; such a chunk has no ids, and its text is
    encoded as a whole. A chunk of plain letters is one word of the tokenizer's model;
    others are encoded in one call, joined by line feeds (a token of its own between two
    non-space characters).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.whole("\n")
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, letters: str) -> bytes:
        """The ids of one word of letters, with a space before it or none."""
        mapped = letters.encode().decode("latin-1").translate(BYTES)
        return np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()

    def learn(self, new: list[str]) -> None:
        """Words are learned apart from the signs behind them, as there are far fewer."""
        cores = [c.rstrip(ENDINGS) for c in new]
        split = [(c, core, "\0" + c[len(core) :]) for c, core in zip(new, cores, strict=True) if len(core) < len(c) and core[-1:].isalnum()]
        apart = {c for c, _, _ in split}
        parts = [c for c in new if c not in apart] + [x for _, core, tail in split for x in (core, tail)]
        self._learn([c for c in dict.fromkeys(parts) if c not in self.known])
        known = self.known
        for c, core, tail in split:
            known[c] = known[core] + known[tail] if known[core] is not None else None

    def _learn(self, new: list[str]) -> None:
        others = []
        for c in new:
            lead = c[:1]
            bare = c[1:] if lead in ("\0", "\n") else c
            if bare.isalpha() and max(bare) < PLAIN:
                self.known[c] = self.word(bare) if lead == "\0" else self.feed + self.word(bare) if lead == "\n" else self.word(" " + bare)
            elif not bare or bare[0].isspace() or bare[-1].isspace():
                self.known[c] = None
            else:
                others.append((c, bare if bare is not c else " " + bare))
        if not others:
            return
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(text for _, text in others)], add_special_tokens=False)[0].ids, self.dtype)
        edges = np.flatnonzero(ids == np.frombuffer(self.feed, self.dtype)[0]) if len(self.feed) == ids.itemsize else ids[:0]
        if len(edges) == len(others) - 1:
            bounds = [-1, *edges.tolist(), len(ids)]
            parts = [ids[a + 1 : b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        else:  # a chunk holds another kind of line feed
            parts = [self.whole(text) for _, text in others]
        for (c, _), part in zip(others, parts, strict=True):
            self.known[c] = self.feed + part if c[0] == "\n" else part

    def encode(self, texts: pa.Array, end: bytes) -> tuple[bytes, np.ndarray]:
        """(ids of all texts, each followed by ``end``; bytes of each)."""
        odd = pc.match_substring(texts, "\0")
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        marked = pc.binary_join_element_wise(pa.scalar("\0", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type))
        split = pc.split_pattern(marked, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        ids = np.array([*map(self.known.__getitem__, words), end, b""], object)[:-1]
        lengths = np.array([-1 if x is None else len(x) for x in ids])
        bounds = split.offsets.to_numpy().astype(np.int64)
        code = coded.indices.to_numpy()
        odd = odd.to_numpy(zero_copy_only=False) | (np.minimum.reduceat(lengths[code], bounds[:-1]) < 0)
        if odd.any():
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            first = np.zeros(len(code), bool)
            first[bounds[:-1]] = True
            # an odd text counts as one chunk
            at, keep = np.flatnonzero(odd), ~odd[doc] | first
            ids = np.concatenate([ids, np.array([*(self.whole(texts[int(i)].as_py()) for i in at), b""], object)[:-1]])
            lengths = np.array([-1 if x is None else len(x) for x in ids])
            code = code.astype(np.int64)
            code[bounds[:-1][at]] = len(words) + 1 + np.arange(len(at))
            code = code[keep]
            bounds = np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(texts)))]
        code = np.insert(code, bounds[1:], len(words))  # the end of each text
        starts = bounds[:-1] + np.arange(len(texts))
        return b"".join(ids[code].tolist()), np.add.reduceat(lengths[code], starts)


@lru_cache(maxsize=4)
def tokenizer_at(path: str) -> Chunks:
    return Chunks(path)


def encode_column(texts: pa.Array, path: str, end_id: int) -> tuple[pa.Array, np.ndarray]:
    """(ids of each text and the end token as little-endian bytes, number of ids); null is empty."""
    chunks = tokenizer_at(path)
    end = np.array([end_id], chunks.dtype).tobytes()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    slices = (np.cumsum(size) - size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
    parts = [chunks.encode(texts.slice(a, b - a), end) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    ids = b"".join(p for p, _ in parts)
    n = np.concatenate([np.empty(0, np.int64), *(x for _, x in parts)]).astype(np.int64)
    bounds = np.r_[0, np.cumsum(n)].astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
    return held.cast(pa.binary()), n // chunks.dtype.itemsize


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, n_tokens, ids): whole texts, with the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = encode_column(batch.column("text"), path, end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), ids], names=["doc_id", "source", "n_tokens", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


def queue_paths(sums: DataFrame, sources: int) -> DataFrame:
    """(source, path): from the queue up to the stream, the place among its siblings and their (tokens, allotments), as JSON.

    ``sums`` has a row per source: source, n (tokens), allot.
    """
    levels = 0 if sources <= FAN else math.ceil(math.log(2 * sources / FAN, FAN))
    nodes = sums.withColumn("node", F.pmod(F.xxhash64("source"), F.lit(FAN**levels))).withColumn("name", F.struct(F.col("source").isNull(), "source"))
    siblings = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("name", "n", "allot"))).alias("all"))
    step = lambda at, all_: F.struct((at - 1).alias("at"), F.transform(all_, lambda x: x["n"]).alias("n"), F.transform(all_, lambda x: x["allot"]).alias("a"))
    place = F.array_position(F.transform("all", lambda x: x["name"]), F.col("name"))
    paths = nodes.join(siblings, "node").select("source", "node", F.array(step(place, F.col("all"))).alias("path"))
    tokens = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.sum("allot").alias("allot"))
    for _ in range(levels):
        up = tokens.withColumn("parent", F.floor(F.col("node") / FAN))
        siblings = up.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "n", "allot"))).alias("all"))
        steps = up.join(siblings, "parent").select("node", "parent", step(F.array_position(F.transform("all", lambda x: x["node"]), F.col("node")), F.col("all")).alias("step"))
        paths = paths.join(steps, "node").select("source", F.col("parent").alias("node"), F.concat("path", F.array("step")).alias("path"))
        tokens = up.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n"), F.sum("allot").alias("allot"))
    return paths.select("source", F.to_json("path").alias("path"))


@lru_cache(maxsize=4096)
def parsed(path: str) -> list[tuple[int, list[int], list[int]]]:
    """Per level: place, siblings' tokens and allotments."""
    return [(s["at"], s["n"], s["a"]) for s in json.loads(path)]


def through(segments: list[tuple[int, int, int]], at: int, tokens: list[int], allot: list[int], rounds: int) -> list[tuple[int, int, int]]:
    """Segments (start, length, place in queue ``at``) as segments of what the round-robin serves."""
    out = []
    own, quantum = tokens[at], allot[at]
    for start, n, q in segments:
        while n:
            k = ((q + 1) * rounds - 1) // quantum  # the round that serves this token
            served = [min(t, k * a // rounds) for t, a in zip(tokens, allot, strict=True)]
            after = [min(t, (k + 1) * a // rounds) for t, a in zip(tokens[: at + 1], allot, strict=False)]
            place = sum(served) + sum(after[:at]) - sum(served[:at]) + q - served[at]
            take = min(n, min(own, after[at]) - q)
            if out and out[-1][0] + out[-1][1] == start and out[-1][2] + out[-1][1] == place:
                out[-1] = (out[-1][0], out[-1][1] + take, out[-1][2])
            else:
                out.append((start, take, place))
            start, n, q = start + take, n - take, q + take
    return out


def pieces_of(q: int, n: int, path: list, rounds: int, seq_len: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document that starts at token q of its queue."""
    segments = [(0, n, q)]
    for level in path:
        segments = through(segments, *level, rounds)
    for start, length, place in segments:
        while length:
            take = min(length, seq_len - place % seq_len)
            yield start, take, place // seq_len, place % seq_len
            start, length, place = start + take, length - take, place + take


PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, window_sequences: int = 64,
    blocks: int = 64, block_tokens: int = 1 << 22, shares: Mapping[str | None, float] | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence; its ids too, if asked.

    ``shares`` are target proportions of sources; sources that it leaves out keep their
    corpus share. A queue with a target above its tokens runs dry early.
    """
    tokens = materialize(tokenize(docs, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    allot = F.col("n")
    sums = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    if shares:
        named = sums.filter(F.coalesce(F.col("source").isin([s for s in shares if s is not None]), F.lit(None in shares)))
        scale = (named.agg(F.sum("n")).first()[0] or 0) / sum(shares.values())
        for source, share in shares.items():
            allot = F.when(F.col("source").eqNullSafe(F.lit(source)), F.greatest(F.lit(1), F.round(F.lit(share * scale)).cast("long"))).otherwise(allot)
    sums = materialize(sums.withColumn("allot", allot), "queues")
    count, grand = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rounds = max(1, -(-grand // (window_sequences * seq_len)))  # alike at every level of the tree, so that each window holds all
    paths = queue_paths(sums, count)
    if count * FAN * 40 <= BROADCAST_BYTES:
        paths = F.broadcast(paths)

    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    # the ids travel once: the sort that numbers a queue's tokens carries them
    cells = tokens.withColumn("queue", queue).withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32("ids"), "row"), F.lit(max(blocks, -(-grand // block_tokens)))))
    starts = cells.groupBy("queue", "block", "source").agg(F.sum("n_tokens").alias("n"))
    starts = starts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.withColumnRenamed("source", "own")
    starts = starts.join(paths, starts["own"].eqNullSafe(paths["source"])).select("queue", "block", "base", "path")
    order = Window.partitionBy("queue", "block").orderBy("doc_id", "n_tokens", F.crc32("ids"), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(starts, ["queue", "block"])
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizer_at(tokenizer_path).dtype
        for batch in batches:
            rows = []
            for doc_id, source, n, ids, path, q in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "ids", "path", "q")), strict=True):
                wide = np.frombuffer(ids, dtype).astype("<u4")
                for start, length, sequence, offset in pieces_of(q, n, parsed(path), rounds, seq_len):
                    part = wide[start : start + length]
                    rows.append((doc_id, source, start, length, zlib.crc32(part), n, sequence, offset) + ((part.astype("i4").tolist(),) if with_ids else ()))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return placed.select("doc_id", "source", "n_tokens", "ids", "path", (F.col("base") + F.col("within")).alias("q")).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return pack(docs, default_tokenizer())
