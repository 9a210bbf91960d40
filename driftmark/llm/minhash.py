"""Near duplicates: dart-throwing weighted MinHash, banding, exact verification.

A text is a multiset of five-word shingles (or, with ``weighted=False``, a set);
a shingle's weight is how often the text holds it. Each shingle
owns a Poisson process of darts on the plane of weight and rank, fixed by
hashes of the shingle alone: unit-wide strips of weight, each cut into regions
of doubling rank that hold Poisson-many darts. A text throws the darts of its
elements' weights, each dart falls on one of ``COORDINATES`` coordinates, and
the earliest of each coordinate is kept. A long text looks at few regions of
each shingle, so its cost is about one hash a shingle. Two texts agree on a
coordinate with the probability of their weighted Jaccard similarity, and that
same similarity, over all strips of both texts, decides each link.

Texts are read once, in Arrow batches: words are cut and hashed in arrays over
the bytes, and what later steps need of a row (its id, two hashes of all its
words, its bands) is written. Only texts that meet another are read again, one
copy each.

Classes are the connected components of the texts linked by a similarity of
at least ``threshold``:

1. texts with equal words collapse to the smallest id before anything else, so
   copies cost one partial aggregation, however many there are;
2. bands of coordinates make buckets. In each bucket of two or more the member
   that meets most others leads, a star instead of all pairs, and each other
   member's similarity to the leader is computed exactly, from all strips of both;
3. in buckets of more than one class, shingles that few of the members hold name
   the pairs that could be similar, and members that need such shingles are done.
   Of the others, those outside their bucket's largest class lead, ever more at a
   time, until each bucket is one class: no link between classes that banding
   found is lost. Sketches of 512 bits rule out most pairs before they are listed,
   by a bound that holds for every pair;
4. components come from label passing with pointer jumping. Links, labels and
   shingles stay distributed; every table between rounds is in the shared folder.

Edge cases: a null or blank text has no words and is a class of its own; a text
of one to four words is one shingle, so only copies meet it; rows that repeat an
id are all kept, in the class of their text; rows of null id are compared too
(the class of copies is the smallest id there is, null if there is none);
extra columns are not read, except by ``deduplicate``, which passes all through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import BROADCAST_BYTES, column, free, mapped, scope, text_of, written
from driftmark.llm.common import columns as columns_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
#: Regions of a strip: rank 0 to 1/64, then doubling up to 1, then one a unit.
FIRST = 2.0**-6
#: Up to so many links, one bounded task finds the components; beyond, label passing does.
SMALL_LINKS = 200_000
#: A shingle of at most so many texts is rare.
RARE = 12
#: Words of 64 bits that sketch which elements a text has.
SKETCH = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Regions of doubling rank below 1: (from, width).
STEPS = [(0.0, FIRST)] + [(FIRST * 2**k, FIRST * 2**k) for k in range(6)]


def _counts(width: float) -> np.ndarray:
    """Poisson's distribution function for a region's width."""
    return np.exp(-width) * np.cumsum(np.cumprod(np.r_[1.0, width / np.arange(1, 16)]))


def _throw(key: np.ndarray, element: np.ndarray, base: np.ndarray, region: np.ndarray, start: np.ndarray, width: float, coordinates: int) -> None:
    """Throw the darts of one region of each element; ``base`` is where its text's coordinates begin."""
    seed = mix(element + (region.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    table = _counts(width)
    u = _unit(seed)
    at = np.flatnonzero(u > table[0])
    for j in range(1, 16):
        if not len(at):
            break
        dart = mix(seed[at] + np.uint64((0xD1B54A32D192ED03 * j) & 0xFFFFFFFFFFFFFFFF))
        # one hash gives the coordinate (high bits), the rank within the region (low bits) and a name
        place = base[at] + ((dart >> np.uint64(40)) * np.uint64(coordinates) >> np.uint64(24)).astype(np.int64)
        rank = (start if np.isscalar(start) else start[at]) + width * ((dart & np.uint64(0xFFFFFFFFFF)).astype(np.float64) * 2.0**-40)
        # positive doubles sort like their bits; bits of the seed settle ties
        np.minimum.at(key, place, (rank.view(np.uint64) & ~np.uint64(0xFFFF)) | (seed[at] & np.uint64(0xFFFF)))
        at = at[u[at] > table[j]]


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, (n, coordinates); all ones where a text has no element.

    ``elements`` are 64-bit hashes of unit-weight strips, ``owner`` their texts'
    places. Equal elements of one text throw the same darts, which changes nothing.
    A text looks at whole regions up to its horizon, so every dart it keeps is
    the earliest of its coordinate; while a coordinate is empty, the horizon doubles.
    """
    weight = np.bincount(owner, minlength=n)
    key = np.full(n * coordinates, ~np.uint64(0))
    done = np.zeros(n)
    want = np.where(weight > 0, coordinates * (np.log(coordinates) + 1) / np.maximum(weight, 1), 0.0)
    while len(elements):
        for k, (start, width) in enumerate(STEPS):
            look = (done <= start) & (want > start)
            if look.all():
                e, o = elements, owner
            elif look.any():
                live = look[owner]
                e, o = elements[live], owner[live]
            else:
                continue
            _throw(key, e, o * coordinates, np.full(1, k), start, width, coordinates)
        # beyond rank 1 each unit is a region: all of a text's regions at once
        low, high = np.maximum(np.ceil(done), 1), np.ceil(want)
        many = np.maximum(high - low, 0).astype(np.int64)[owner]
        heavy = np.flatnonzero(many)
        for at in range(0, len(heavy), 20_000):
            some = heavy[at : at + 20_000]
            times = many[some]
            which = np.repeat(some, times)
            unit = low[owner[which]] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            _throw(key, elements[which], owner[which] * coordinates, unit + len(STEPS), unit, 1.0, coordinates)
        done = want
        empty = (key.reshape(n, coordinates) == ~np.uint64(0)).any(axis=1) & (weight > 0)
        want = np.where(empty, 2 * done, done)
        keep = empty[owner]
        elements, owner = elements[keep], owner[keep]
    return key.reshape(n, coordinates)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLACES = 64
_BYTES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(_PLACES, 256)
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 20


def _piece_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of ``data``; a word ends at white space and before each of ``begins``."""
    gap = _SPACE[data]
    first = np.empty(len(data), bool)
    first[:1] = True
    first[1:] = gap[:-1]
    first[begins] = True
    first &= ~gap
    at = np.flatnonzero(~gap)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    head = np.flatnonzero(first[at])
    size = np.diff(np.r_[head, len(at)])
    place = at - np.repeat(starts, size)
    term = _BYTES[place & (_PLACES - 1), data[at]]
    if size.max() > _PLACES:
        term ^= (place >> 6).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(np.add.reduceat(term, head) + size.astype(np.uint64)), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin."""
    texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not _SPACE[data[to]]:  # a piece ends where a word does
            to += 1
        lo, hi = np.searchsorted(offsets, [at, to])
        h, first = _piece_hashes(data[at:to], offsets[lo:hi] - at)
        hashes.append(h)
        starts.append(first + at)
        at = to
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(starts, offsets)


def text_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole sequence of words."""
    size = np.diff(offsets)
    place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], size)).astype(np.uint64)
    out = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.r_[np.uint64(0), np.cumsum(mix(hashes + place * np.uint64(odd)), dtype=np.uint64)]
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64) * np.uint64(odd)).view(np.int64))
    return out[0], out[1]


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Elements and owners of texts given as runs of word hashes.

    Weighted, the n-th strip of a shingle's weight is an element of its own, so a
    text has as many elements as shingles and none twice.
    """
    size = np.diff(offsets)
    n = len(size)
    h = mix(hashes.view(np.uint64))
    total = len(h)
    owner_of_word = np.repeat(np.arange(n), size)
    place = np.arange(total) - offsets[:-1][owner_of_word]
    span = np.minimum(size, SHINGLE)
    starts = np.flatnonzero(place <= (size - span)[owner_of_word])
    owner = owner_of_word[starts]
    e = np.zeros(len(starts), np.uint64)
    for j in range(SHINGLE):
        nxt = mix(e * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(starts + j, total - 1)] + np.uint64(j + 1)) if total else e
        e = nxt if (span >= SHINGLE).all() else np.where(j < span[owner], nxt, e)
    if weighted and len(e):
        key = mix(e + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            near = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            some = np.flatnonzero(twice[near] == key)
            rank = np.lexsort((some, key[some]))
            k = key[some][rank]
            same = np.r_[False, k[1:] == k[:-1]]
            run = np.arange(len(k)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
            strip = np.empty(len(k), np.uint64)
            strip[rank] = run.astype(np.uint64)
            e[some] = np.where(strip > 0, mix(e[some] + strip * np.uint64(0xC2B2AE3D27D4EB4F)), e[some])
    return e, owner


def band_hashes(key: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(key), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + key[:, r::rows][:, :bands])
    return mix(out + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``PIECE`` bytes; a longer text is a run of its own."""
    size = np.cumsum(np.r_[0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, min(len(texts), at + 4000, int(np.searchsorted(size, size[at] + PIECE, side="right")) - 1))
        yield at, to
        at = to


def _lists(values: np.ndarray, count: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(values), mask=pa.array(null))


def _sign(weighted: bool):
    """The last column, a text, gives k1, k2 and bands: null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, to in _parts(texts):
                h, offsets = word_hashes(texts.slice(at, to - at))
                k1, k2 = text_keys(h, offsets)
                e, owner = shingle_hashes(h, offsets, weighted)
                null = np.diff(offsets) == 0
                bands = band_hashes(signatures(e, owner, to - at))[~null]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in batch.columns[:-1]), pa.array(k1, mask=null), pa.array(k2, mask=null), _lists(bands.reshape(-1), np.where(null, 0, BANDS), null)],
                    names=[*batch.schema.names[:-1], "k1", "k2", "bands"],
                )

    return run


def _elements(weighted: bool):
    """The last column, a text, gives k1, k2, the elements that similarity counts, and a sketch of them: the bits that they hash to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, to in _parts(texts):
                h, offsets = word_hashes(texts.slice(at, to - at))
                k1, k2 = text_keys(h, offsets)
                e, owner = shingle_hashes(h, offsets, weighted)
                if not weighted and len(e):
                    order = np.lexsort((e, owner))
                    e, owner = e[order], owner[order]
                    new = np.r_[True, (e[1:] != e[:-1]) | (owner[1:] != owner[:-1])]
                    e, owner = e[new], owner[new]
                null = np.diff(offsets) == 0
                lists = _lists(e.view(np.int64), np.bincount(owner, minlength=to - at), null)
                bits = np.zeros((to - at) * SKETCH, np.uint64)
                np.bitwise_or.at(bits, owner * SKETCH + (e >> np.uint64(6) & np.uint64(SKETCH - 1)).astype(np.int64), np.uint64(1) << (e & np.uint64(63)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, SKETCH), pa.int32()), pa.array(bits.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), pa.array(k1, mask=null), pa.array(k2, mask=null), sketch, lists], names=[*batch.schema.names[:-1], "k1", "k2", "bits", "s"])

    return run


def _mapped(rows: DataFrame, function, *lists: str) -> DataFrame:
    """``rows``, whose last column is a text, with k1, k2 and ``lists`` instead of it."""
    return mapped(rows, function, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *[T.StructField(x, T.ArrayType(T.LongType())) for x in lists])


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "label": pa.array([root(x) for x in nodes], pa.int64())})


def components(links: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it reaches."""
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if links.count() <= small:
        return written(links.repartition(1).mapInArrow(_union_find, "node long, label long"), "labels")
    both = links.union(links.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        least = written(labels.join(near, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("old")), "labels")
        # pointer jumping: a label's own label
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(least.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def _links(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, from all elements of both.

    Elements are the largest table here: where the counted pairs are few enough to
    be broadcast, those of a stay where they are and of b only the wanted texts move.
    """
    pairs = written(pairs, "pairs")
    few = pairs.count() * 32 <= BROADCAST_BYTES
    x, y = shingles.select(F.col("node").alias("a"), F.col("s").alias("x")), shingles.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # sizes alone rule out most unlike pairs before any set is built
    near = (F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y"))) & (both >= threshold * (F.size("x") + F.size("y") - both))
    if few:
        y = y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    return x.join(F.broadcast(pairs) if few else pairs, "a").join(y, "b").where(near).select("a", "b")


def _reach(common: Column, sizes: Column, threshold: float) -> Column:
    """Whether sets of ``sizes`` together can be similar enough with ``common`` elements in common."""
    return (1 + threshold) * common + 1e-6 >= threshold * sizes


def _within(sizes: tuple[Column, Column], bits: tuple[Column, Column], threshold: float) -> Column:
    """Whether sketches let two texts be similar: an element on a bit that the other lacks is none of the other's."""
    apart = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(SKETCH)), F.lit(0))
    common = F.least(sizes[0] - apart(*bits), sizes[1] - apart(*bits[::-1]))
    return _reach(common, sizes[0] + sizes[1], threshold)


def _rare(members: DataFrame, labels: DataFrame, shingles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that rare shingles speak for, and (node, size, bits, common) of the members' texts.

    A shingle of 2 to ``RARE`` member texts is rare, one of more is common. Two texts
    have at most the rare shingles that they are seen to share and the fewer of
    their common ones in common. Pairs of different classes that share a rare
    shingle and stay within that bound are listed; a pair that shares none can
    only be similar if the common shingles of both suffice.
    """
    some = members.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    some = written(some, "asked")
    hint = F.broadcast if some.count() * 32 <= BROADCAST_BYTES else lambda x: x
    some = written(shingles.join(hint(some), "node").select("node", "label", F.size("s").alias("size"), "bits", "s"), "some")
    tokens = some.select("node", "label", "size", F.explode("s").alias("t"))
    seen = tokens.groupBy("t").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    seen = written(seen.where(F.col("c") <= RARE), "seen")
    held = tokens.join(seen.where("c > 1").select("t"), "t").groupBy("t").agg(F.collect_list(F.struct("node", "label", "size")).alias("held"))
    held = written(held, "held")  # at most RARE texts a shingle
    few = seen.where("c = 1").groupBy("node").agg(F.count("*").alias("few")).union(held.select(F.explode("held.node").alias("node")).groupBy("node").agg(F.count("*").alias("few")))
    few = few.groupBy("node").agg(F.sum("few").alias("few"))
    sizes = written(some.select("node", "size", "bits").join(few, "node", "left").select("node", "size", "bits", (F.col("size") - F.coalesce("few", F.lit(0))).alias("common")), "sizes")
    couples = F.flatten(F.transform("held", lambda x: F.transform(F.filter("held", lambda y: (y["node"] > x["node"]) & (y["label"] != x["label"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), (x["size"] + y["size"]).alias("sizes")))))
    met = held.select(F.explode(couples).alias("p")).groupBy("p.a", "p.b", "p.sizes").agg(F.count("*").alias("n"))
    of = lambda name: sizes.select(F.col("node").alias(name), F.col("common").alias(f"c{name}"))
    pairs = met.join(of("a"), "a").join(of("b"), "b").where(_reach(F.col("n") + F.least("ca", "cb"), F.col("sizes"), threshold))
    return pairs.select("a", "b"), sizes


def _stubborn(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Members (band, node, size, bits, common) whose common shingles alone could make them similar to a co-member."""
    sized = written(members.join(sizes, "node"), "sized")
    least = sized.groupBy("band").agg(F.min("size").alias("least"))
    # what is similar to a text is not smaller than its share of it
    smallest = F.greatest(F.col("least"), F.ceil(threshold * F.col("size") - 1e-6))
    return sized.join(least, "band").where(_reach(F.col("common"), F.col("size") + smallest, threshold)).drop("least")


def classes(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, weighted: bool = True, carry: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (carry, id, k1, k2), distinct texts (node, k1, k2, id: the smallest, n: their rows) and (node, label) of those that are not alone."""
    with scope(df.sparkSession):
        number = column(df, "doc_id").cast("long").alias("id")
        signed = _mapped(df.select(*(carry or []), number, text_of(df, text).alias("text")), _sign(weighted), "bands")
        signed = written(signed, "signed", keep=True)
        # equal texts have equal bands: any of them will do
        nodes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", keep=True)
        filed = nodes.select("node", F.explode("bands").alias("band"))
        lot = F.xxhash64("band", "node")
        shared = written(filed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        members = written(filed.join(shared, "band"), "members")
        # the text that meets most others leads: in a group of edited copies that is the one nearest to their origin
        met = members.groupBy("node").agg(F.sum("n").alias("met"))
        members = written(members.join(met, "node").select("band", "node", F.struct("met", lot.alias("lot"), "node").alias("rank")), "members")
        heads = written(members.groupBy("band").agg(F.max("rank")["node"].alias("head")), "heads")
        members = written(members.join(heads, "band").select("band", "node", "rank", (F.col("node") == F.col("head")).alias("led"), "head"), "members")
        asked = members.select("node").distinct().join(nodes.select("node", "k1", "k2", "id"), "node")
        asked = written(asked, "asked")
        hint = F.broadcast if asked.count() * 64 <= BROADCAST_BYTES else lambda x: x
        # one copy of each text is read again, by its smallest id; other texts of that id fall to the keys
        reread = df.select(number, text_of(df, text).alias("text"))
        ids = asked.select(F.col("id").alias("asked")).distinct()
        reread = reread.join(hint(ids), F.col("id").eqNullSafe(F.col("asked")), "left_semi").select("text")
        shingles = _mapped(reread, _elements(weighted), "bits", "s").join(hint(asked.select("node", "k1", "k2")), ["k1", "k2"]).groupBy("node").agg(F.first("s").alias("s"), F.first("bits").alias("bits"))
        shingles = written(shingles, "shingles")
        links = written(_links(members.where("not led").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), shingles, threshold), "links")
        labels = components(links)
        # what is left: buckets that hold more than one class, without the leaders, who have met all others
        now = members.join(labels, "node", "left").select("band", "node", "led", F.coalesce("label", "node").alias("label"))
        mixed = written(now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band"), "mixed")
        members = written(now.where("not led").join(mixed, "band").select("band", "node"), "members")
        pairs, sizes = _rare(members, labels, shingles, threshold)
        links = written(links.union(_links(pairs, shingles, threshold)), "links")
        labels = components(links)
        members = written(_stubborn(members, sizes, threshold), "members")
        leaders = 1
        while True:
            leaders *= 4
            now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            # the largest class of a bucket has nothing to ask of itself: only members of the others lead
            each = now.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
            mixed = written(each.where("n > most.n").select("band", F.col("most.label").alias("most"), (F.col("n") - F.col("most.n")).alias("n")), "mixed")
            if mixed.isEmpty():
                break
            chosen = (F.col("label") != F.col("most")) & (F.pmod(F.xxhash64("band", "node", F.lit(leaders)), F.col("n")) < leaders)
            now = written(now.join(mixed, "band").select("band", "node", "size", "bits", "common", "label", chosen.alias("leads")), "members")
            heads = now.where("leads").select("band", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("common").alias("cb"), F.col("bits").alias("bb"))
            able = _reach(F.least("common", "cb"), F.col("size") + F.col("sb"), threshold) & _within((F.col("size"), F.col("sb")), (F.col("bits"), F.col("bb")), threshold)
            pairs = now.join(heads, "band").where((F.col("label") != F.col("lb")) & (~F.col("leads") | (F.col("node") < F.col("b"))) & able).select(F.col("node").alias("a"), "b").distinct()
            links = written(links.union(_links(pairs, shingles, threshold)), "links")
            labels = components(links)
            members = now.where("not leads").select("band", "node", "size", "bits", "common")
        return signed.drop("bands"), nodes.select("node", "k1", "k2", "id", "n"), written(labels, "labels", keep=True)


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, k1, k2, id) of the texts that are not alone: copied ones, or linked ones."""
    return nodes.join(labels, "node", "left").where("label is not null or n > 1").select("k1", "k2", "id", F.coalesce("label", "node").alias("label"))


def near_duplicates(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id (the class's smallest id), class_texts (its distinct texts)."""
    with scope(df.sparkSession):
        signed, nodes, labels = classes(df, text, threshold, weighted)
        named = written(_named(nodes, labels), "named")
        least = named.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_texts"))
        named = written(named.join(least, "label").select("k1", "k2", "class_id", "class_texts"), "classes")
        alone = F.col("class_texts").isNull()
        out = signed.join(named, ["k1", "k2"], "left").select(
            F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1).cast("long")).alias("class_texts")
        )
        return written(out, "near", keep=True)


def with_cluster(df: DataFrame, columns: list[Column], text: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """``columns`` of each row of ``df`` and ``cluster``: one number for each near-duplicate class, the least word hash in it; null without words.

    The columns ride along when the texts are read, and may not be called id, k1, k2, bands or cluster.
    """
    signed, nodes, labels = classes(df, text, threshold, weighted, columns)
    named = written(_named(nodes, labels), "named")
    least = named.groupBy("label").agg(F.min("k1").alias("cluster"))
    named = written(named.join(least, "label").select("k1", "k2", "cluster"), "clusters")
    out = signed.join(named, ["k1", "k2"], "left").withColumn("cluster", F.coalesce("cluster", "k1"))
    return out.drop("id", "k1", "k2")


def deduplicate(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """``df`` with one row of each class left: that of the smallest id; texts without words all stay.

    A row whose id no other row has is found by its id alone. Ids that rows share
    (and null) say too little; of those rows the texts are hashed again.
    """
    signed, nodes, labels = classes(df, text, threshold, weighted)
    named = nodes.join(labels, "node", "left").select("k1", "k2", "id", F.coalesce("label", "node").alias("label"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    kept = written(named.groupBy("label").agg(best.alias("best")).select("best.id", "best.k1", "best.k2"), "kept")
    shared = written(signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "shared")
    lone = kept.select("id").unionByName(signed.where("k1 is null").select("id")).where("id is not null").join(shared, "id", "left_anti")
    lone = written(lone.select(F.col("id").alias("kept_id")), "lone")
    hint = F.broadcast if lone.count() * 16 <= BROADCAST_BYTES else lambda x: x
    number = column(df, "doc_id").cast("long")
    out = df.join(hint(lone), number == F.col("kept_id"), "left_semi")
    if shared.isEmpty():
        return out
    place, k1, k2, held, t = free(df, "place", "k1", "k2", "held", "text_again")
    rows = df.join(shared.select(F.col("id").alias("shared_id")), number.eqNullSafe(F.col("shared_id")), "left_semi")
    rows = rows.select(*columns_of(rows), column(rows, "doc_id").cast("long").alias(place), text_of(rows, text).alias(t))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at, to in _parts(texts):
                h, offsets = word_hashes(texts.slice(at, to - at))
                null = np.diff(offsets) == 0
                keys = [pa.array(k, mask=null) for k in text_keys(h, offsets)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), *keys], names=[*batch.schema.names[:-1], k1, k2])

    rows = mapped(rows, again, T.StructField(k1, T.LongType()), T.StructField(k2, T.LongType()))
    wanted = kept.select(F.col("id").alias(held), F.col("k1").alias(k1 + "w"), F.col("k2").alias(k2 + "w"))
    same = (F.col(k1) == F.col(k1 + "w")) & (F.col(k2) == F.col(k2 + "w")) & F.col(place).eqNullSafe(F.col(held))
    chosen = rows.join(wanted, same, "left_semi").dropDuplicates([k1, k2, place]).unionByName(rows.where(F.col(k1).isNull()))
    return out.unionByName(chosen.select(*columns_of(chosen, df.columns)))
