"""Best-fit packing by minimum bin slack.

The plan needs only how many pieces there are of each length: at most ``capacity`` counts, whatever the corpus. Per
bin, a subset-sum over bitsets finds the fullest combination of lengths that are left; it is taken as often
as the counts allow. Pieces then find their bin by their rank among pieces of the same length. Ranks
come from counts per stored part, so no task sees all pieces of a length and no text is shuffled.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import giving_back, table
from timberline.session import stored

CAPACITY = 2048
#: Encoded words kept per Python worker: two generations of about this many. They stay when a task ends, beside whatever runs next.
CACHE_WORDS = 100_000
#: Characters whose words are looked up together.
CHUNK_CHARS = 2_000_000
_MARKS = ".,;:!?#*$%&"
#: Latin and Cyrillic letters: a byte-level pre-tokenizer keeps a run of them, and the blank before it, in one piece.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481]+")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


# ---- token ids -------------------------------------------------------------------------------------------------


class WordCache:
    """Token ids of texts, encoded word by word with a cache.

    A byte-level pre-tokenizer never joins a word with what follows the next single blank or line end, so lines of printable
    words may be cut at their blanks. A text with any other white space, or one that names a special token, is encoded as a
    whole. New words of letters alone are one piece each and go to the tokenizer's model as they are; other new words are encoded many at a
    time, as lines of one text. ``tests/llm`` holds the ids against those of whole texts.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.line_end = self._encode("\n")
        self.model = self._model()
        self.most = most
        #: Ids of words at the start of a line and after a blank: two generations each, so that frequent words stay.
        self.new, self.old = ({}, {}), ({}, {})
        self.tails: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _model(self):
        """The model, if what it is given are runs of letters as they stand."""
        from tokenizers import models, pre_tokenizers

        kind = self.encoder.pre_tokenizer
        if not isinstance(kind, pre_tokenizers.ByteLevel) or not isinstance(self.encoder.model, models.BPE):
            return None
        told = json.loads(kind.__getstate__())
        if self.encoder.normalizer or self.encoder.truncation or self.encoder.padding or any(told.get(k) != v for k, v in _BYTE_LEVEL.items()):
            return None
        #: The same alphabet of bytes, without looking for pieces.
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return self.encoder.model

    def _pieces(self, words: list[str], spaced: int) -> Iterator[tuple[str, bytes]]:
        """Words that are one piece each, with their ids."""
        model, of = self.model.tokenize, attrgetter("id")
        between = self.level.pre_tokenize_str("\n")[0][0]
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            letters = self.level.pre_tokenize_str("\n".join([" " + w for w in some] if spaced else some))[0][0]
            for w, piece in zip(some, letters.split(between)):
                yield w, array("I", map(of, model(piece))).tobytes()

    def _may_be_cut(self, text: str) -> bool:
        """Lines of printable words with one blank between them, and no special token."""
        if not text or len(self.line_end) != 4 or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in self.special):
            return False
        return not any(s in text for s in ("  ", "\n\n", " \n", "\n ")) and text.replace("\n", "").isprintable()

    def _fill(self, wanted: set[str], spaced: int) -> None:
        """Ids of words not met before."""
        new, old = self.new[spaced], self.old[spaced]
        bare = []
        for w in wanted.difference(new):
            ids = old.get(w)
            if ids is None:
                bare.append(w)
            else:
                new[w] = ids
        if self.model:
            plain = list(filter(_LETTERS.fullmatch, bare))
            new.update(self._pieces(plain, spaced))
            bare = [w for w in bare if not _LETTERS.fullmatch(w)] if len(plain) < len(bare) else []
        end = int.from_bytes(self.line_end, "little")
        for k in range(0, len(bare), 1000):
            some = bare[k : k + 1000]
            ids = self._encode("\n".join([" " + w for w in some] if spaced else some))
            ends = np.flatnonzero(np.frombuffer(ids, "<u4") == end) * 4
            for w, a, b in zip(some, [0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)]):
                new[w] = ids[a:b]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids per word. One that begins with a line end stands at the start of a line and has the line end's id first, others have their blank."""
        for k in (0, 1):
            if len(self.new[k]) > self.most:
                self.old = tuple(self.new[i] if i == k else self.old[i] for i in (0, 1))
                self.new = tuple({} if i == k else self.new[i] for i in (0, 1))
        self._fill({w for w in words if w[0] != "\n"}, 1)
        self._fill({w[1:] for w in words if w[0] == "\n"}, 0)
        first, rest, end = *self.new, self.line_end
        return [rest[w] if w[0] != "\n" else end + first[w[1:]] for w in words]

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            ids = self.tails[marks] = self._encode(marks)
        return ids

    def _distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has. Marks at a word's end are a token run of their own, so the bare words are looked up."""
        cores = pc.utf8_rtrim(words, characters=_MARKS)
        tailed = np.flatnonzero(pc.not_equal(pc.binary_length(cores), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        cores = cores.dictionary_encode()
        bare, core = _strings(cores.dictionary), cores.indices.to_numpy().astype(np.int64)
        sound = np.fromiter((w[-1:].isalnum() for w in bare), bool, len(bare))
        # What ends in neither letter nor digit before its marks is looked up as it is.
        whole, tailed = tailed[~sound[core[tailed]]], tailed[sound[core[tailed]]]
        core[whole] = np.arange(len(whole)) + len(bare)
        bare += _strings(words.take(pa.array(whole)))
        used, core = np.unique(core, return_inverse=True)
        bare = [bare[k] for k in used.tolist()]
        marks = [w[len(bare[k]) :] for w, k in zip(_strings(words.take(pa.array(tailed))), core[tailed].tolist())]
        ends = {m: len(bare) + 1 + k for k, m in enumerate(dict.fromkeys(marks))}
        table = [*self._ids_of(bare), b"", *map(self._tail, ends)]
        # Each word is two parts: the bare word and its marks, or the empty part between the two kinds.
        parts = np.full((len(words), 2), len(bare), np.int64)
        parts[:, 0] = core
        parts[tailed, 1] = [ends[m] for m in marks]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        return _chosen(np.frombuffer(b"".join(table), "<u4"), sizes, parts.ravel()), sizes[parts].sum(axis=1)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, per text."""
        may = [self._may_be_cut(t) for t in texts]
        lines = "".join("\n" + t for t, ok in zip(texts, may) if ok)
        if not lines:
            return list(map(self._encode, texts))
        words = pc.split_pattern(pa.array([lines.replace("\n", " \n")[1:]], pa.string()), " ").flatten().dictionary_encode()
        at, (flat, sizes) = words.indices.to_numpy(), self._distinct(words.dictionary)
        ids = _chosen(flat, sizes, at)
        # Before each text's first word there is a line end too many.
        counts = [t.count(" ") + t.count("\n") + 1 for t, ok in zip(texts, may) if ok]
        ends = np.cumsum(sizes[at])[np.cumsum(counts) - 1].tolist()
        cut = (ids[a + 1 : b].tobytes() for a, b in zip([0, *ends], ends))
        return [next(cut) if ok else self._encode(t) for t, ok in zip(texts, may)]


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _chosen(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The stretches ``rows`` of ``flat``, whose stretches have ``sizes``, one behind the other."""
    n, begins = sizes[rows], np.cumsum(sizes) - sizes
    ends = np.cumsum(n)
    return flat[np.repeat(begins[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """The cache of this Python worker: Spark keeps workers, so later tasks find the words of earlier ones."""
    return WordCache(path)


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """``start, length, crc32`` of each piece; only the first is shorter than ``capacity``."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, doc_id: str, text: str, end_id: int, with_ids: bool) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, nth`` and ``ids`` if asked for.

    ``part`` names the task and ``nth`` counts the task's pieces of the same length; both hold once the rows are stored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache, seen = TaskContext.get().partitionId(), word_cache(tokenizer), np.zeros(capacity + 1, np.int64)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids_of):
                chunk, size, begin = [], 0, at
                while at < len(ids_of) and size < CHUNK_CHARS:
                    chunk.append(texts[at].as_py() or "")
                    size += len(chunk[-1])
                    at += 1
                out = []
                for key, ids in zip(ids_of[begin:at], cache.ids(chunk)):
                    ids += end
                    for k, (start, length, crc) in enumerate(cut_pieces(ids, capacity)):
                        row = (key, k, start, length, crc, part, int(seen[length]))
                        out.append(row + ((np.frombuffer(ids[4 * start : 4 * (start + length)], "<u4").tolist(),) if with_ids else ()))
                        seen[length] += 1
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names
    return docs.select(doc_id, text).mapInArrow(lambda batches: giving_back(run(batches)), schema)


# ---- the plan --------------------------------------------------------------------------------------------------


def fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The combination with the least slack that holds the longest length left: length -> how many.

    Bit k of a bitset says that k can be filled. Lengths enter from the longest, each up to as often as it is left, by
    powers of two; the search ends as soon as the bin can be full. Among equally full bins the longer lengths win.
    """
    longest = int(lengths[0])
    room = capacity - longest
    full, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, n in zip(lengths.tolist(), left.tolist()):
        if length > room or reach >> room & 1:
            continue
        copies, k = min(n - (length == longest), room // length), 1
        while copies > 0:
            k = min(k, copies)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & full
            copies -= k
            k *= 2
    at, taken = reach.bit_length() - 1, {longest: 1}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows ``length, first rank, end rank, pieces per bin, first bin, offset in the bin``, and the number of bins.

    Pieces of one row fill its bins in order of their rank.
    """
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    left = np.array([counts[int(x)] for x in lengths], np.int64)
    used, bins, rows = dict.fromkeys(counts, 0), 0, []
    while len(lengths):
        taken = fullest(lengths, left, capacity)
        times = min(int(n) // taken[int(x)] for x, n in zip(lengths, left) if int(x) in taken)
        offset = 0
        for length, k in taken.items():
            rows.append((length, used[length], used[length] + k * times, k, bins, offset))
            used[length] += k * times
            left[lengths == length] -= k * times
            offset += k * length
        bins += times
        lengths, left = lengths[left > 0], left[left > 0]
    return np.array(sorted(rows), np.int64).reshape(-1, 6), bins


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and ``ids`` if asked for.

    A document is its text's token ids and ``end_id``. Only documents longer than ``capacity`` are cut, and only their first
    piece is shorter than that. A null or empty text is one piece, the end id alone. Rows that repeat an id
    are documents of their own; a null id stays null. Other columns are ignored. Ties between pieces of a
    length go by stored part and order in it, which decides nothing but the neighbours. No rows: no sequences.

    ``tokenizer`` is a path that every executor can open.
    """
    pieces = stored(tokenized_pieces(docs, tokenizer, capacity, doc_id, text, end_id, with_ids), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = stored(per_part.withColumn("rank_from", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    counts = {int(r[0]): int(r[1]) for r in per_part.groupBy("length").agg(F.sum("n")).collect()}
    rows, _ = plan_bins(counts, capacity)
    # The counts grow with the number of parts, so they are never broadcast.
    ranked = pieces.join(per_part.select("part", "length", "rank_from").hint("merge"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank_from") + F.col("nth"))
    starts = {int(x): rows[rows[:, 0] == x] for x in np.unique(rows[:, 0])}

    own = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for x in np.unique(length):
                here, of = length == x, starts[int(x)]
                row = of[np.searchsorted(of[:, 1], rank[here], side="right") - 1]
                nth = rank[here] - row[:, 1]
                sequence[here] = row[:, 4] + nth // row[:, 3]
                offset[here] = row[:, 5] + nth % row[:, 3] * x
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*own).schema)
    return ranked.select(*own, "rank").mapInArrow(place, kinds + ", sequence_id bigint, offset bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
