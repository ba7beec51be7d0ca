"""Near-duplicates by SuperMinHash: signatures, banding, verification on full shingle sets, union-find grouping.

Documents with equal sets are one class, and only classes are compared. Within a bucket each class is first compared
with the bucket's two leaders, which is linear; only where that leaves a bucket in several components are its
remaining pairs weighed, block by block inside tasks, and only the links found leave those tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import giving_back, table
from timberline.llm.components import components
from timberline.llm.textstats import groups_of
from timberline.session import small_side, stored

SHINGLE = 5
#: A pair at a similarity of 0.75 shares no band once in 190,000 times (0.684 to the power of 32).
ROWS, BANDS = 4, 32
WIDTH = ROWS * BANDS
#: Signature shares under this are not verified: nearly four standard deviations below the limit.
LIKELY = 0.6
#: Rows per side of a block of pairs.
BLOCK = 1024

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit permutation of each value."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[str], known: WordHashes) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its five-word shingles, A-Z lower-cased.

    Fewer words are one shingle; no words, no shingle.
    """
    out = []
    for text in texts:
        words = text.encode().lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        wide = min(SHINGLE, len(h))
        acc = np.full(len(h) - wide + 1, wide, np.uint64)
        for k in range(wide):
            acc = _mix(acc * _C1 + h[k : len(h) - wide + 1 + k])
        out.append(np.unique(acc))
    return out


def super_minhash(sets: list[np.ndarray], width: int = WIDTH) -> np.ndarray:
    """SuperMinHash signatures, one row of ``width`` values per set; rows of empty sets are infinite.

    Each element walks a random permutation of the positions: at step j it offers j plus a random fraction to the
    j-th position of its permutation. Offers only grow, so a set is done as soon as all its values are below the
    next step, mostly after two or three steps. All elements of all sets take a step together.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * width, np.inf)
    seeds = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = np.broadcast_to(np.arange(width, dtype=np.uint16 if width > 256 else np.uint8), (len(seeds), width)).copy()
    for j in range(width):
        if not len(seeds):
            break
        draw = _mix(seeds + np.uint64((j + 1) * int(_C1) % 2**64))
        share = (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(width - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(seeds))
        spot = place[rows, pick].astype(np.int64)
        place[rows, pick] = place[:, j]
        np.minimum.at(out, owner * width + spot, j + share)
        going = out.reshape(-1, width).max(axis=1) >= j + 1
        stay = going[owner]
        if not stay.all():
            seeds, owner, place = seeds[stay], owner[stay], place[stay]
    return out.reshape(-1, width)


def lanes(values: np.ndarray) -> np.ndarray:
    """Sixteen bits per signature value; four of them are a band's key."""
    return (_mix(np.ascontiguousarray(values).view(np.uint64)) >> np.uint64(48)).astype("<u2")


def _binary(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def set_names(sets: list[np.ndarray]) -> list[list[int]]:
    """Two 64-bit sums per set, over differently mixed elements."""
    return [[int(_mix(s ^ c).sum(dtype=np.uint64).view(np.int64)) for s in sets] for c in (_C2, _C3)]


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, h1, h2`` (a 128-bit name of the set) and ``bands``, null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for begin, end, texts in groups_of(batch, 1, 500_000):
                sets = shingle_sets(texts, known)
                bands = lanes(super_minhash(sets)).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(x, pa.int64()) for x in set_names(sets)],
                        pa.array([b if len(s) else None for s, b in zip(sets, bands)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(
        lambda batches: giving_back(run(batches)), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"
    )


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal lanes of rows of bands."""
    return (np.ascontiguousarray(a).view("<u2") == np.ascontiguousarray(b).view("<u2")).mean(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def likely_pairs(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Of ``a, b`` those whose sizes allow the similarity and whose signatures are alike."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _alike(_matrix(batch.column("bands_a")), _matrix(batch.column("bands_b"))) >= LIKELY
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "bands_a", "bands_b").mapInArrow(run, "a bigint, b bigint").distinct()


def class_of() -> Column:
    """A 64-bit name of a class of equal sets, from the set's 128-bit name and size; null for empty sets."""
    return F.when(F.col("n_shingles") > 0, F.xxhash64("h1", "h2", "n_shingles"))


def shingles_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``cls, shingles`` of the classes in ``wanted`` (``cls``), made again from the texts of their ids and stored.

    The texts are scanned, not shuffled, while the list of ids is small (measured). An id may have several texts; each names its own class.
    """
    ids = classes.join(wanted.distinct(), "cls", "left_semi").select(F.col("rep").alias("_id")).distinct()
    found = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).join(small_side(ids, 16), F.col("doc_id") == F.col("_id"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for _, _, texts in groups_of(batch, 1, 500_000):
                sets = shingle_sets(texts, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(x, pa.int64()) for x in set_names(sets)],
                        pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                    ],
                    names=["n_shingles", "h1", "h2", "shingles"],
                )

    sets = found.select("doc_id", text).mapInArrow(lambda batches: giving_back(make(batches)), "n_shingles bigint, h1 bigint, h2 bigint, shingles binary")
    return stored(sets.select(class_of().alias("cls"), "shingles").filter("cls is not null").dropDuplicates(["cls"]), "sets")


def _similar(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= hundredths * (len(a) + len(b) - both)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """Of ``a, b`` those whose full shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    sets = shingles_of(wanted, classes, docs, doc_id, text)
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"set_{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("set_a"), batch.column("set_b"))
            ok = [_similar(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), round(100 * similarity)) for a, b in both]
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a bigint, b bigint")


def contracted(links: DataFrame) -> DataFrame:
    """Links with each task's own reduced by union-find to one edge per node, before they are merged across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        edges = [(x, root(x)) for x in parent if root(x) != x]
        for k in range(0, len(edges), 100_000):
            part = edges[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in part], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return links.select("a", "b").mapInArrow(run, "u bigint, v bigint")


def remaining_links(members: DataFrame, classes: DataFrame, groups: DataFrame, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """Links ``a, b`` between components that share a bucket which the leaders left divided.

    ``members`` has ``band, key, cls`` of buckets of four and more. Large buckets are dealt in blocks: each row meets each block of its
    bucket in a task of its own, so that no task holds a bucket. A task weighs signatures first, takes a pair up in the first band that it
    shares and verifies it on the full sets unless its own links already join the two; only links leave it, at most one per row.
    """
    told = members.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    told = stored(told, "told")
    divided = told.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    divided = divided.filter("lo <> hi").select("band", "key", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    rows = told.join(divided, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = stored(rows, "divided")
    sets = shingles_of(rows.select("cls"), classes, docs, doc_id, text)
    known = classes.join(sets, "cls").select("cls", "bands", "shingles")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.join(known, "cls").select(
        "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "component", "bands", "shingles"
    )
    hundredths = round(100 * similarity)

    def weigh(rows: pa.Table) -> pa.Table:
        band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
        block, cls, part = (rows.column(c).to_numpy() for c in ("block", "cls", "component"))
        bands = _matrix(rows.column("bands").combine_chunks())
        sig = np.ascontiguousarray(bands).view("<u2")
        full = rows.column("shingles").combine_chunks()
        own = [np.frombuffer(full[x].as_buffer(), "<u8") for x in range(len(full))]
        size = np.array([len(x) for x in own])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = []
        for x in left:
            far = right[(part[right] != part[x]) & ((cls[right] > cls[x]) | (i != j))]
            far = far[100 * np.minimum(size[far], size[x]) >= hundredths * np.maximum(size[far], size[x])]
            far = far[(bands[far] == bands[x]).argmax(axis=1) == band]
            for y in far[(sig[far] == sig[x]).mean(axis=1) >= LIKELY]:
                a, b = root(int(part[x])), root(int(part[y]))
                if a != b and _similar(own[x], own[y], hundredths):
                    parent[max(a, b)] = min(a, b)
                    links.append((int(cls[x]), int(cls[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(weigh, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, similarity: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents link whose sets of five-word shingles have at least ``similarity`` of their union in common; ``component_id`` is
    the smallest id reachable over links, and the document with that id is ``kept``. Null and empty texts have no shingles, link with
    nothing and are kept. Rows that repeat an id are one document: their texts join one component. A null id takes part in no link of its own
    text but shares the component of an equal set; where there is none its component is null and it is kept. Ties go to the smaller id.
    Other columns are ignored.
    """
    sigs = stored(signatures(docs, doc_id, text).withColumn("cls", class_of()), "signatures")
    named = sigs.select("doc_id", "n_shingles", "cls")
    reps = stored(named.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
    firsts = reps.select(F.col("rep").alias("_rep"), F.col("cls").alias("_cls")).filter("_rep is not null")
    classes = sigs.join(firsts, (F.col("doc_id") == F.col("_rep")) & (F.col("cls") == F.col("_cls")))
    classes = classes.select("cls", F.col("_rep").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    classes = stored(classes, "classes").dropDuplicates(["cls"])

    banded = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    led = banded.groupBy("band", "key").agg(F.min("cls").alias("first"), F.max("cls").alias("last"), F.count(F.lit(1)).alias("k"))
    members = stored(banded.join(led.filter("k > 1"), ["band", "key"]), "members")
    to_leaders = members.select("cls", F.explode(F.array("first", "last")).alias("leader")).filter("cls <> leader")
    pairs = to_leaders.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    pairs = stored(likely_pairs(pairs, classes, similarity), "leaders")
    links = verified(pairs, classes, docs, doc_id, text, similarity)
    # An id that stands on several classes (rows that repeat it) links them.
    spans = named.filter("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("last"))
    spans = spans.filter("a <> last").select("doc_id", "a")
    shared = named.join(small_side(spans, 16), "doc_id").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    links = stored(links.union(shared), "links")
    groups = stored(components(contracted(links)), "groups")

    more = remaining_links(members.filter("k > 3").select("band", "key", "cls"), classes, groups, docs, doc_id, text, similarity)
    more = stored(more, "more")
    if not more.isEmpty():
        # What is known already comes in as one edge per class.
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")
        groups = stored(components(contracted(more.union(known))), "groups")
    # From classes to the smallest id that a component has.
    placed = stored(reps.join(groups.withColumnRenamed("node", "cls"), "cls"), "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    label = reps.join(placed.join(least, "component").select("cls", "least"), "cls", "left")
    component = F.coalesce("least", "rep", "doc_id")
    return named.join(label.select("cls", "rep", "least"), "cls", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
