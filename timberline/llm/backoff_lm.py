"""Language-model scores by a weighted backoff automaton.

Words that were seen are states; a state's arcs are the bigrams seen after it and its failure arc leads to the empty
context at the price of the smoothing. The model is never gathered: texts are dealt into blocks, each block asks for
the counts of the n-grams that its texts hold, counts are summed by n-gram hash, and each block gets back the part of the
automaton that its texts can reach. All that moves are hashes and counts, in proportion to the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.minhash import _C1, WordHashes, _mix
from timberline.session import stored

#: Characters of text per block: what one task holds at a time.
BLOCK_CHARS = 20_000_000
#: Weight of the shorter context, as a number of imagined tokens after each context.
PRIOR = 20.0
#: Stands for the end of a text and, as a context, for its start. No word holds a line end.
_END = b"\n"


def held_out(doc_id: Column) -> Column:
    """Texts that the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(before + _C1) ^ word)


# ---- blocks of encoded texts -----------------------------------------------------------------------------------


def encoded_blocks(docs: DataFrame, doc_id: str, text: str, block_chars: int) -> DataFrame:
    """A row per block of texts: ``block``, the texts' ids and sizes, their words as numbers, and the words' hashes.

    A block holds about ``block_chars`` characters, or one longer text. Its name is drawn when it is made, and the rows
    are stored before anything refers to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        known = WordHashes()
        ids, held, sizes, hashes, chars = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
            cells = [uuid.uuid4().hex, ids, held, sizes, sum(sizes), _packed(words), _squeezed(numbers, len(words))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names=names)

        for batch in batches:
            for key, out, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (body.as_py() or "").encode().lower()
                words = raw.split()
                words.append(_END)
                ids.append(key)
                held.append(out)
                sizes.append(len(words))
                hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                chars += len(raw)
                if chars >= block_chars:
                    yield block()
                    ids, held, sizes, hashes, chars = [], [], [], [], 0
        if ids:
            yield block()

    names = ["block", "doc_ids", "held", "sizes", "n_tokens", "words", "numbers"]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(F.col(doc_id)).alias("held"), text).mapInArrow(
        run, "block string, doc_ids array<bigint>, held array<boolean>, sizes array<int>, n_tokens bigint, words binary, numbers binary"
    )


def _squeezed(numbers: np.ndarray, size: int) -> bytes:
    """Word numbers, compressed: words in order of their frequency, so that most ranks are small, in planes of one byte."""
    by_count = np.argsort(-np.bincount(numbers, minlength=size), kind="stable").astype("<u4")
    rank = np.empty(size, np.uint32)
    rank[by_count] = np.arange(size, dtype=np.uint32)
    planes = np.ascontiguousarray(rank[numbers].astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(by_count.tobytes() + planes.tobytes(), 1)


def _restored(raw: bytes, size: int) -> np.ndarray:
    plain = np.frombuffer(zlib.decompress(raw), np.uint8)
    ranks = np.ascontiguousarray(plain[4 * size :].reshape(4, -1).T).view("<u4").reshape(-1)
    return plain[: 4 * size].view("<u4")[ranks].astype(np.int64)


class Block:
    """The texts of a block: ``numbers`` of all tokens in a row, ``words`` by number, and the block's distinct bigrams."""

    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.words = _unpacked(row["words"])
        self.numbers = _restored(row["numbers"], len(self.words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.end = int(self.numbers[-1])
        before = np.empty_like(self.numbers)
        before[1:] = self.numbers[:-1]
        before[self.starts] = self.end
        #: Distinct bigrams as before * V + word, in that order, and each token's place among them.
        self.pairs, self.pair_of = np.unique(before * len(self.words) + self.numbers, return_inverse=True)

    def bigram_hashes(self) -> np.ndarray:
        return _bigrams(self.words[self.pairs // len(self.words)], self.words[self.pairs % len(self.words)])

    def learned(self) -> np.ndarray:
        return ~np.repeat(self.held, self.sizes)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as six bytes of difference each, or eight where a difference is larger."""
    steps = np.diff(keys, prepend=np.uint64(0))
    wide = np.ascontiguousarray(steps).astype("<u8").view(np.uint8).reshape(-1, 8)
    # The first step is the key itself and keeps all its bytes in front.
    if len(steps) and not wide[1:, 6:].any():
        return b"6" + wide[0].tobytes() + wide[1:, :6].tobytes()
    return b"8" + wide.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1)
    if raw[:1] == b"6":
        wide = np.zeros(((len(body) - 8) // 6 + 1, 8), np.uint8)
        wide[0] = body[:8]
        wide[1:, :6] = body[8:].reshape(-1, 6)
        body = wide.reshape(-1)
    return np.cumsum(np.ascontiguousarray(body).view("<u8"), dtype=np.uint64)


def _deal(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of ``keys`` per shard, each in order of the keys; a shard is a range of hashes."""
    order = np.argsort(keys)
    shard = ((keys[order] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.split(order, np.searchsorted(shard, np.arange(1, shards, dtype=np.uint64)))


def asked_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """``shard, block, kind, keys, counts``: each block's distinct words (kind 1) and bigrams (2), with their counts in texts learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row)
                learned = b.learned()
                words = np.bincount(b.numbers[learned], minlength=len(b.words))
                pairs = np.bincount(b.pair_of[learned], minlength=len(b.pairs))
                out = []
                for kind, keys, counts in ((1, b.words, words), (2, b.bigram_hashes(), pairs)):
                    for shard, at in enumerate(_deal(keys, shards)):
                        if len(at):
                            out.append((shard, row["block"], kind, _packed(keys[at]), counts[at].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["shard", "block", "kind", "keys", "counts"],
                )

    return blocks.mapInArrow(run, "shard int, block string, kind int, keys binary, counts binary")


def summed(asked: DataFrame) -> DataFrame:
    """``block, kind, shard, totals, n_distinct, n_tokens``: for each question the whole corpus's counts, in the question's order.

    ``n_distinct`` and ``n_tokens`` (words learned from) stand on one row of each shard.
    """

    def run(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("kind")[0].as_py(), rows.column("shard")[0].as_py()
        keys = [_unpacked(k) for k in rows.column("keys").to_pylist()]
        counts = [np.frombuffer(c, "<u4") for c in rows.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, np.concatenate(counts).astype(np.float64), len(distinct)).astype(np.int64)
        out, begin = [], 0
        for k in keys:
            out.append(totals[at[begin : begin + len(k)]].astype("<u4").tobytes())
            begin += len(k)
        first = [kind == 1 and k == 0 for k in range(len(keys))]
        return pa.table(
            {
                "block": rows.column("block"),
                "kind": pa.array([kind] * len(keys), pa.int32()),
                "shard": pa.array([shard] * len(keys), pa.int32()),
                "totals": pa.array(out, pa.binary()),
                "n_distinct": pa.array([int((totals > 0).sum()) if x else 0 for x in first], pa.int64()),
                "n_tokens": pa.array([int(totals.sum()) if x else 0 for x in first], pa.int64()),
            }
        )

    return asked.groupBy("shard", "kind").applyInArrow(run, "block string, kind int, shard int, totals binary, n_distinct bigint, n_tokens bigint")


# ---- the automaton ---------------------------------------------------------------------------------------------


class Automaton:
    """States: 0 is the empty context, 1 + w the context of word w. Arcs carry log10 weights and lead to the state of their word.

    ``arcs`` are sorted ``state * words + word`` with ``weights``; each state has a failure arc to state 0 with weight ``fail``; the
    empty context has an arc for every word (``root``).
    """

    def __init__(self, words: int, arcs: np.ndarray, weights: np.ndarray, fail: np.ndarray, root: np.ndarray):
        self.words, self.arcs, self.weights, self.fail, self.root = words, arcs, weights, fail, root

    def step(self, states: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading one word in each state, and the weights of the arcs taken."""
        key = states * self.words + word
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        seen = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
        weight = np.where(seen, self.weights[at] if len(self.arcs) else 0.0, self.fail[states] + self.root[word])
        return word + 1, weight

    def traverse(self, numbers: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
        """Log-probability of each text: all texts are read from left to right together, one word at a time."""
        total = np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        state = np.full(len(sizes), begin, np.int64)
        ends = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for t, live in enumerate(ends.tolist()):
            who = order[:live]
            state[who], weight = self.step(state[who], numbers[starts[who] + t])
            total[who] += weight
        return total


def automaton_of(block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int, prior: float) -> tuple[Automaton, np.ndarray]:
    """The part of the automaton that the block can reach, and the base log-probability of each word.

    p(w) = (c + 0.5) / (N + 0.5 (V + 1)); p(w | u) = (c(u w) + prior p(w)) / (c(u) + prior), whose second part is the failure arc's.
    """
    size = len(block.words)
    base = (words + 0.5) / (n + 0.5 * (v + 1))
    # As a context the end of a text stands for the start of the next: as often as texts end.
    room = words.astype(np.float64) + prior
    seen = pairs > 0
    before, word = block.pairs[seen] // size, block.pairs[seen] % size
    weights = np.log10((pairs[seen] + prior * base[word]) / room[before])
    fail = np.concatenate([[0.0], np.log10(prior / room)])
    return Automaton(size, (before + 1) * size + word, weights, fail, np.log10(base)), np.log10(base)


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR, block_chars: int = BLOCK_CHARS, shards: int | None = None
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are the words (A-Z lower-cased) and one end. Texts that are not ``held_out`` are learned from. A null or empty text is its end
    alone. Rows that repeat an id are scored one by one, and learned from as often as they stand there; a null id is learned from.
    Other columns are ignored. With nothing to learn from, every token has the smoothing's share alone. Ties cannot arise.
    """
    blocks = stored(encoded_blocks(docs, doc_id, text, block_chars), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # Questions of some tens of MB per shard, however large the corpus.
    shards = shards or max(8, math.ceil(size / 4_000_000))
    answers = stored(summed(asked_counts(blocks, shards)), "answers")
    n, v = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow}, schema=arrow)
        block, totals = Block(rows[0]), {}
        told = {(k, s): x for k, s, x in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "totals")))}
        for kind, keys in ((1, block.words), (2, block.bigram_hashes())):
            totals[kind] = np.zeros(len(keys), np.int64)
            for shard, at in enumerate(_deal(keys, shards)):
                if len(at):
                    totals[kind][at] = np.frombuffer(told[kind, shard], "<u4")
        machine, base = automaton_of(block, totals[1], totals[2], n, v, prior)
        sums = lambda x: np.add.reduceat(x[block.numbers], block.starts)
        return pa.table(
            [
                pa.array(block.doc_ids, pa.int64()),
                pa.array(block.held),
                pa.array(block.sizes),
                pa.array(sums((totals[1] > 0).astype(np.int64))),
                pa.array(np.full(len(block.sizes), n, np.int64)),
                pa.array(sums(base)),
                pa.array(machine.traverse(block.numbers, block.starts, block.sizes, block.end + 1)),
            ],
            schema=arrow,
        )

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    arrow = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])))
    told = answers.select("block", "kind", "shard", "totals")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
