"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata of the words, and windows that tell quotation from abuse.

Terms are learned from labelled texts. A word of a text is an automaton that accepts everything within one or two edits; it walks the
trie, and what both accept is a hit. The words around a hit say whether somebody is abused or only quoted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import table
from timberline.llm.textstats import groups_of
from timberline.llm.trees import Forest, boost
from timberline.session import stored

#: Labelled texts the lexicon, the context and the trees are learned from, at most; and the terms kept, at most.
SAMPLE_ROWS = 20_000
MOST_TERMS = 2_000
#: Words whose weight near a hit is kept, at most, and by this likelihood ratio.
MOST_CONTEXT, CONTEXT_RATIO = 1_000, 20.0
#: A term stands in at least so many toxic texts of the sample and this part of them, and mostly in such.
LEAST_TEXTS, LEAST_PART, LEAST_SHARE = 4, 0.005, 0.6
#: Words before and after a hit that are looked at.
WINDOW = 8
#: Distinct words a task keeps its findings of, before it starts anew.
CACHED_WORDS = 300_000
# Quotation marks, and English words that report what somebody said.
_OPENING, _CLOSING = "\"“„«‘‹", "\"”“»’›"
REPORTING = frozenset("said says say saying called calls call calling wrote writes write quote quoted quotes quoting term word words phrase tweeted posted reported replied".split())
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‹›…–—¿¡"


def edits_allowed(length: int) -> int:
    """Short terms are only found as they are: one edit makes too many other words of them."""
    return 0 if length < 5 else 1 if length < 10 else 2


# ---- automaton and trie ------------------------------------------------------------------------------------------


class Trie:
    """Terms by their letters: ``children`` has the next nodes by letter, ``term`` the term that ends at a node, ``sizes`` the shortest and longest term below."""

    def __init__(self, terms: dict[str, str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.sizes: list[tuple[int, int]] = [(1 << 30, 0)]
        for letters, term in terms.items():
            node, n = 0, len(term)
            for letter in letters:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.sizes.append((n, n))
                node = self.children[node][letter]
                self.sizes[node] = (min(self.sizes[node][0], n), max(self.sizes[node][1], n))
            self.term[node] = term

    def node(self, letters: str) -> int | None:
        at: int | None = 0
        for letter in letters:
            at = self.children[at].get(letter)
            if at is None:
                return None
        return at


class Automaton:
    """All strings within one or two edits (insert, delete, replace) of a word.

    A state has a number for each count of edits, whose bits are the prefixes of the word that so many edits can have made of what was read.
    Bits that a lesser count has are in the greater ones as well. A state without bits leads nowhere.
    """

    def __init__(self, word: str, most: int):
        self.size, self.most = len(word), most
        self.places: dict[str, int] = {}
        for k, letter in enumerate(word):
            self.places[letter] = self.places.get(letter, 0) | 2 << k
        self.last = 1 << len(word)
        self.inside = 2 * self.last - 1
        self.start = (1, 3 & self.inside, 7 & self.inside)

    def step(self, state: tuple[int, int, int], letter: str) -> tuple[int, int, int] | None:
        here = self.places.get(letter, 0)
        none, one, two = state
        a = none << 1 & here
        b = (one << 1 & here | none | none << 1 | a << 1) & self.inside
        if self.most == 1:
            return (a, b, 0) if b else None
        c = (two << 1 & here | one | one << 1 | b << 1) & self.inside
        return (a, b, c) if c else None

    def edits(self, state: tuple[int, int, int]) -> int:
        """The edits after which the whole word may be read, 3 for none."""
        return next((k for k in range(self.most + 1) if state[k] & self.last), 3)

    def matches(self, trie: Trie, root: int = 0, read: int = 0) -> Iterator[tuple[str, int]]:
        """Terms below ``root`` whose letters from there on the automaton accepts, with the edits; ``read`` letters were read before."""
        size, most = self.size + read, self.most
        children, sizes, terms = trie.children, trie.sizes, trie.term
        todo = [(root, self.start)]
        while todo:
            node, state = todo.pop()
            term = terms[node]
            if term is not None:
                edits = self.edits(state)
                if edits <= most:
                    yield term, edits
            for letter, child in children[node].items():
                least, longest = sizes[child]
                if least <= size + most and longest >= size - most:
                    after = self.step(state, letter)
                    if after is not None:
                        todo.append((child, after))


class Near:
    """Terms that may be met with up to ``most`` edits, in a trie from their first letter on and one from their last.

    Whatever is within one edit of a term keeps one of its halves, and within two one of its thirds. So a word walks
    a trie as it is up to the end of such a piece, and only what comes after is left to the automaton.
    """

    def __init__(self, terms: list[str], most: int):
        self.most = most
        self.forward, self.backward = Trie({t: t for t in terms}), Trie({t[::-1]: t for t in terms})
        self.lengths = (min(map(len, terms), default=0) - most, max(map(len, terms), default=-1) + most)
        self.first: dict[int, dict[str, int]] = {}
        self.last: dict[int, dict[str, int]] = {}
        self.middle: dict[int, set[str]] = {}
        for term in terms:
            cut = len(term) // (most + 1)
            tail = len(term) - cut * most
            self.first.setdefault(cut, {})[term[:cut]] = self.forward.node(term[:cut])
            self.last.setdefault(tail, {})[term[-tail:]] = self.backward.node(term[::-1][:tail])
            if most == 2:
                self.middle.setdefault(cut, set()).add(term[cut : 2 * cut])

    def matches(self, word: str) -> Iterator[tuple[str, int]]:
        """Terms and their edits; a term may come twice."""
        if not self.lengths[0] <= len(word) <= self.lengths[1]:
            return
        for size, nodes in self.first.items():
            root = nodes.get(word[:size])
            if root is not None:
                yield from Automaton(word[size:], self.most).matches(self.forward, root, size)
        for size, nodes in self.last.items():
            root = nodes.get(word[-size:])
            if root is not None:
                yield from Automaton(word[:-size][::-1], self.most).matches(self.backward, root, size)
        # Two edits may leave the middle third only, moved by one letter at most.
        if any(word[k : k + size] in some for size, some in self.middle.items() for k in (size - 1, size, size + 1)):
            yield from Automaton(word, self.most).matches(self.forward)


@dataclass
class Lexicon:
    """Terms with their severity."""

    severity: dict[str, float]

    def __post_init__(self):
        self.levels = [Near([t for t in sorted(self.severity) if edits_allowed(len(t)) == most], most) for most in (1, 2)]

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term of a word and its edits; of equally near ones the gravest."""
        if word in self.severity:
            return word, 0
        if len(word) < 4:
            return None
        best = min(((edits, -self.severity[term], term) for level in self.levels for term, edits in level.matches(word)), default=None)
        return best and (best[2], best[0])


def bare(token: str) -> str:
    """A word without the marks at its ends, in lower case."""
    return token.strip(_EDGES).lower()


# ---- windows and statistics -----------------------------------------------------------------------------------


def quoted(tokens: list[str], at: int, window: int = WINDOW) -> bool:
    """A quotation opens at the word or in the window before it and closes at it or in the window after it."""
    for k in range(at, max(at - window, 0) - 1, -1):
        if tokens[k][:1] and tokens[k][0] in _OPENING:
            return any(tokens[j].rstrip(".,;:!?")[-1:] and tokens[j].rstrip(".,;:!?")[-1] in _CLOSING for j in range(at, min(at + window, len(tokens) - 1) + 1))
        if k < at and tokens[k].rstrip(".,;:!?")[-1:] and tokens[k].rstrip(".,;:!?")[-1] in _CLOSING:
            return False
    return False


@dataclass
class Context:
    """Weights of words near a hit. The score of a window lies between 0, quotation, and 1, abuse."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 1.0

    def score(self, tokens: list[str], at: int, window: int = WINDOW) -> float:
        near = {bare(t) for t in tokens[max(at - window, 0) : at] + tokens[at + 1 : at + 1 + window]}
        told = sum(self.weights.get(w, 0.0) for w in near)
        reported = not near.isdisjoint(REPORTING)
        marks = quoted(tokens, at, window)
        margin = self.bias + max(-2.0, min(2.0, told)) - 2.0 * marks - 1.0 * reported - 1.5 * (marks and reported)
        return 1 / (1 + math.exp(-margin))


FEATURES = ("abuse", "most_abuse", "near_abuse", "hits", "near_hits", "quoted_share", "density")


@dataclass
class Model:
    lexicon: Lexicon
    context: Context
    forest: Forest | None = None

    def hits(self, tokens: list[str], known: dict[str, tuple[str, int] | None]) -> list[tuple[int, str, int]]:
        """``place, term, edits`` of the words that the lexicon knows or nearly knows. ``known`` keeps findings from text to text."""
        found = {}
        for token in set(tokens):
            if token not in known:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                word = bare(token)
                known[token] = self.lexicon.find(word) if word else None
            if known[token]:
                found[token] = known[token]
        return [(k, *found[t]) for k, t in enumerate(tokens) if t in found] if found else []

    def features(self, text: str, known: dict[str, tuple[str, int] | None]) -> tuple[float, ...]:
        tokens = text.split()
        exact, near, windows = [], [], []
        for place, term, edits in self.hits(tokens, known):
            window = self.context.score(tokens, place)
            windows.append(window)
            (near if edits else exact).append(self.lexicon.severity[term] * window / (1 + edits))
        if not windows:
            return (0.0,) * len(FEATURES)
        return (
            sum(exact), max(exact, default=0.0), sum(near), float(len(exact)), float(len(near)),
            sum(w < 0.5 for w in windows) / len(windows), 100 * (sum(exact) + sum(near)) / len(tokens),
        )


# ---- learning -------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, label: str = "toxic") -> DataFrame:
    """``doc_id, toxic, text`` of at most ``most`` labelled texts outside :func:`held_out`, the first by hash of their id.

    One text per id, the least, and of labels that repeat an id the largest, so that rows are bounded as ids are.
    """
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col(label).cast("int").alias("_y")).dropna()
    chosen = chosen.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    met = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return met.groupBy("doc_id").agg(F.max("_y").alias("toxic"), F.min("text").alias("text"))


def learn_terms(sample: DataFrame, most: int = MOST_TERMS) -> Lexicon:
    """Words that mark toxic texts of ``sample`` and do so by more than chance; the severity of a term grows with the odds that its text is toxic."""
    sizes = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in sizes}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Lexicon({})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in groups_of(batch, 1):
                out = []
                for toxic, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts):
                    tokens = [bare(t) for t in text.split()]
                    first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))
                    out += [(toxic, w, zlib.crc32(" ".join(tokens[max(k - 1, 0) : k + 2]).encode())) for w, k in first.items() if len(w) >= 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.string(), pa.int64()))], names=["toxic", "word", "beside"])

    # Words that stand beside the same words count once: texts that are copies of each other are no more than one.
    seen = sample.select("toxic", "text").mapInArrow(words, "toxic int, word string, beside bigint").distinct()
    a, b = F.col("bad").cast("double"), F.col("good").cast("double")
    told = seen.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    half = lambda x, total, of: F.when(x > 0, x * F.log(x / ((a + b) * of / total))).otherwise(0.0)
    ratio = 2 * (half(a, float(bad + good), float(bad)) + half(b, float(bad + good), float(good)))
    told = stored(told.filter(a + b >= LEAST_TEXTS).withColumn("ratio", ratio), "words")
    # By chance, less than one of all words has a likelihood ratio of that much.
    least = 2 * math.log(max(told.count(), 1))
    kept = told.filter((a >= max(LEAST_TEXTS, LEAST_PART * bad)) & (a / (a + b) >= LEAST_SHARE) & (F.col("ratio") >= least))
    rows = kept.orderBy(F.desc("ratio"), "word").limit(most).collect()
    odds = {r["word"]: math.log((r["bad"] + 0.5) / (r["good"] + 0.5) * (good + 1) / (bad + 1)) for r in rows}
    top = max(odds.values(), default=1.0)
    return Lexicon({word: max(v, 0.1) / top for word, v in odds.items()})


def learn_context(windows: pd.DataFrame) -> Context:
    """Weights of the words near hits, from ``toxic, word, n``: how much rather they stand near hits of toxic texts than near others.

    Words that might stand there by chance have none, and those seen seldom are drawn to it.
    """
    total = {int(y): float(v) for y, v in windows.groupby("toxic")["n"].sum().items()}
    bad, good = total.get(1, 0.0), total.get(0, 0.0)
    if not bad or not good:
        return Context()
    counts = windows.pivot_table(index="word", columns="toxic", values="n", fill_value=0.0, aggfunc="sum")
    a, b = counts[1], counts[0]
    ratio = 2 * sum(x * np.log(np.maximum(x, 1e-9) / ((a + b) * of / (bad + good))) for x, of in ((a, bad), (b, good)))
    shrink = 20.0
    odds = np.log((a + shrink * bad / (bad + good)) / (b + shrink * good / (bad + good)) * good / bad)
    kept = ratio[ratio >= CONTEXT_RATIO].sort_values(ascending=False).index[:MOST_CONTEXT]
    return Context({w: float(odds[w]) for w in kept})


def _windows(sample: DataFrame, model: Model) -> pd.DataFrame:
    """How often each word stands near hits, by label; made in tasks and summed before it comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, int] | None] = {}
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"]):
                tokens = text.split()
                for place, _, _ in model.hits(tokens, known):
                    near = {bare(t) for t in tokens[max(place - WINDOW, 0) : place] + tokens[place + 1 : place + 1 + WINDOW]}
                    rows += [(toxic, w) for w in near if w and w not in model.lexicon.severity]
            yield pd.DataFrame(rows, columns=["toxic", "word"])

    counted = sample.select("toxic", "text").mapInPandas(run, "toxic int, word string").groupBy("toxic", "word").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Words seen near a few hits only tell nothing; what is left is bounded by the sample's hits.
    return counted.filter("n >= 8").toPandas()


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Lexicon, context and trees from at most ``most`` labelled texts. Without labels of both kinds nothing is toxic."""
    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism
    sample = stored(labelled_texts(docs, labels, most).repartition(parts, "doc_id"), "labelled")
    model = Model(learn_terms(sample), Context())
    if not model.lexicon.severity:
        return model
    model.context = learn_context(_windows(sample, model))
    found = with_features(sample.withColumnRenamed("toxic", "label"), model, ["doc_id", "label"]).select("doc_id", "label", *FEATURES).toPandas().sort_values(["doc_id"])
    # More abuse never lowers the score.
    rises = np.array([1, 1, 1, 1, 0, -1, 1])
    model.forest = boost(found[list(FEATURES)].to_numpy(np.float64), found["label"].to_numpy(np.float64), depth=3, direction=rises)
    return model


# ---- scoring --------------------------------------------------------------------------------------------------


def with_features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with ``FEATURES`` and ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*[docs.schema[c] for c in keep], *[StructField(c, DoubleType()) for c in (*FEATURES, "score")]])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for begin, end, texts in groups_of(batch, len(keep)):
                x = np.array([model.features(t, known) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
                score = model.forest.score(x) if model.forest else np.zeros(len(x))
                columns = [*[batch.column(k).slice(begin, end - begin) for k in range(len(keep))], *map(pa.array, x.T), pa.array(score)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def judge_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``).

    A null or empty text has no hits. Rows that repeat an id are scored one by one, a null id stays null and is not held out. Other columns are
    ignored. Texts of any length are read whole. ``predicted`` is 1 from ``threshold`` on. An empty table gives an empty table.
    """
    scored = with_features(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def find_hits(docs: DataFrame, model: Model) -> DataFrame:
    """Every hit: ``doc_id, place`` (word number from 0) ``, word, term, edits, quoted, window_score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    rest = "place bigint, word string, term string, edits int, quoted boolean, window_score double"
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(rest).fields])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for begin, end, texts in groups_of(batch, 1):
                rows = []
                for doc_id, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), texts):
                    tokens = text.split()
                    rows += [
                        {"doc_id": doc_id, "place": k, "word": tokens[k], "term": term, "edits": edits, "quoted": quoted(tokens, k), "window_score": model.context.score(tokens, k)}
                        for k, term, edits in model.hits(tokens, known)
                    ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
