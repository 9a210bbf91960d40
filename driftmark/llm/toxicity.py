"""Toxicity: a support vector machine over gap-weighted subsequence kernels.

Two strings are compared by the subsequences of ``ORDER`` letters they have in
common, each weighed by ``DECAY`` to the length it spans in both, over the root
of both strings' kernels with themselves: a value from 0 to 1 that inserted,
left-out and replaced characters only shrink. A sentence is the set of its parts
(below), and the kernel of two sentences is the sum, over all pairs of their
parts, of the strings' value to the power of ``POWER``: a sum of powers of a
kernel, so a kernel again. Nothing is cut off or skipped: every part of a sentence
counts with every landmark.

Nyström's map over landmark strings z gives a sentence the features
K(z, z')^(-1/2) K(., z), and a linear machine with squared hinge loss is trained
on them, from labelled sentences and from copies of the toxic ones whose telling
parts have one or two characters inserted or one replaced. Landmarks are strings
inside words of toxic sentences that tell them from clean ones, chosen greedily
until each toxic sentence is covered.

The parts of a sentence are the windows of its distinct words in lower case,
reduced to letters and digits, between a mark of their start and one of their end;
words of four or more letters set apart by white space are joined and added. A
word of up to ``CHUNK`` characters is one window; a longer one stands for its
windows of ``CHUNK``, ``STEP`` apart and one at its end, so what surrounds an
insult in a word costs little, and no task holds strings of unbounded size.

Training reads a bounded sample of labelled rows (``Config.sample`` a class,
the first by a hash of the id) and nothing but texts and labels. Scoring is a
narrow map over whole texts.

Edge cases: a null or empty text has no parts and gets the machine's score for
none; a part with fewer than ``ORDER`` characters, marks included, has the value
0 with everything; repeated rows score alike; rows without a label, or whose
label is neither 0 nor 1, are not trained on; with labels of one class only, or
no word that tells the classes apart, every score is the rate of toxic labels
(no labels: 0); extra columns pass through, whatever their names, and the
operator's own replace any of the same name.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import column, columns, free, mapped

ORDER, DECAY, POWER = 4, 0.8, 3
CHUNK, STEP = 14, 6
#: Parts whose values a task remembers; beyond, it starts anew, which changes no score.
KNOWN_PARTS = 60_000
#: Strings whose kernels are taken at a time.
BLOCK, ROWS = 8192, 768
#: Texts read at a time, which share the work on words they have in common, and about how many bytes of them.
TEXTS, TEXT_BYTES = 512, 2 << 20


@dataclass(frozen=True)
class Config:
    sample: int = 1200  # labelled rows of each class
    landmarks: int = 32
    shortest: int = 5  # characters of a landmark, marks included
    longest: int = 10
    cover: int = 3  # landmarks wanted in each toxic sentence
    chance: float = 0.01  # words that may pass for telling by chance, in all
    confusable: int = 1  # parts of clean sentences that join the landmarks for each of them
    altered: int = 1  # altered copies of each toxic sentence
    altered_cost: float = 0.2  # what an error on such a copy counts
    penalty: float = 1e-3


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    rate: float | None = None  # set where nothing could be learned

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of rows of kernel values with the landmarks; the weights hold Nyström's root."""
        if self.rate is not None:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -30, 30)))


def normalise(token: str) -> str:
    """The letters and digits of a word between a mark of its start and one of its end."""
    return f"<{token if token.isalnum() else ''.join(filter(str.isalnum, token))}>"


def sentence_words(text: str) -> set[str]:
    """Distinct raw words of a text, with spelled-out words joined."""
    tokens = text.lower().split()
    words = set(tokens)
    if len([w for w in words if len(w) == 1]) >= 3:
        run: list[str] = []
        for t in [*tokens, ".."]:
            if len(t) == 1 and t.isalnum():
                run.append(t)
            else:
                if len(run) >= 4:
                    words.add("".join(run))
                run = []
    return words


def windows(word: str) -> list[str]:
    return [word] if len(word) <= CHUNK else [word[s : s + CHUNK] for s in (*range(0, len(word) - CHUNK, STEP), len(word) - CHUNK)]


def parts(text: str) -> set[str]:
    return {x for w in sentence_words(text) for x in windows(normalise(w))}


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for n in {len(w) for w in words}:
        at = [i for i, w in enumerate(words) if len(w) == n]
        if n:
            out[at, :n] = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(at), n)
    return out


class Marks:
    """Strings of like length, laid out for the kernels of many words at a time.

    A common subsequence is a chain of cells (i, j) where letter i of a word is
    letter j of a mark, and its weight is that of its last cell, DECAY^(i + j), over
    that of its first. So chains of each length are plain sums over the cells before:
    over rows as they come, over columns by products with a triangle, each too
    small to start threads of its own.
    """

    def __init__(self, marks: list[str]):
        codes = _codes(marks, max(map(len, marks)))
        self.shape = codes.shape
        self.letters = np.unique(codes[codes > 0])
        self.table = np.zeros((len(self.letters) + 1, codes.size), np.float32)
        for k, letter in enumerate(self.letters, 1):
            self.table[k] = (codes == letter).reshape(-1)
        self.before = np.triu(np.ones((codes.shape[1],) * 2, np.float32), 1)
        self.last = np.tile(DECAY ** np.arange(codes.shape[1], dtype=np.float32), len(marks))
        # what a letter alone adds to the chains of one cell
        self.ones = ((self.table / self.last).reshape(len(self.table), *codes.shape) @ self.before).reshape(self.table.shape)

    def kernels(self, words: np.ndarray) -> np.ndarray:
        """(words, marks) of rows of codes; 0 pads and matches nothing.

        Words that begin alike share the work on what they have in common: letters
        that no mark has are all one letter here, and rows go in order.
        """
        place = np.minimum(np.searchsorted(self.letters, words), len(self.letters) - 1)
        place = np.where(self.letters[place] == words, place + 1, 0).astype(np.uint8 if len(self.letters) < 255 else np.int32)
        rows, back = np.unique(np.ascontiguousarray(place).view(f"V{place.shape[1] * place.itemsize}").reshape(-1), return_inverse=True)
        rows = rows.view(place.dtype).reshape(-1, place.shape[1])
        out = np.concatenate([self._chains(rows[at : at + ROWS]) for at in range(0, len(rows), ROWS)]) if len(rows) else np.zeros((0, self.shape[0]), np.float32)
        return out[back] * np.float32(DECAY**2)

    def _chains(self, rows: np.ndarray) -> np.ndarray:
        n, width, last = len(rows), self.shape[1], rows.shape[1] - 1
        # where each row first differs from the one before
        first = np.r_[0, (rows[1:] != rows[:-1]).argmax(1)] if n else np.zeros(0, int)
        node, chains = np.zeros(n, np.int64), [np.zeros((1, len(self.last)), np.float32)] * ORDER
        for i in range(last + 1):
            new = first <= i
            at = np.flatnonzero(new)
            letter, parent = rows[at, i], node[at]
            here = self.table[letter]
            low = max(0, ORDER - 1 - (last - i))  # shorter chains than this find too few letters to come to ORDER
            now = [c[parent] if k >= low - 1 else c for k, c in enumerate(chains)]
            step = here * now[-2]
            step *= np.float32(DECAY**i)
            now[-1] += step
            for k in range(min(ORDER - 2, i), max(low, 1) - 1, -1):  # the longest first: it needs the rows before this one
                np.multiply(here, now[k - 1], out=step)
                now[k] += (step.reshape(len(at), -1, width) @ self.before).reshape(step.shape)
            if low == 0:
                np.multiply(self.ones[letter], np.float32(DECAY**-i), out=step)
                now[0] += step
            node, chains = np.cumsum(new) - 1, now
        return (chains[-1].reshape(len(chains[-1]), -1, width) @ self.last[:width])[node]


def own_kernel(words: np.ndarray) -> np.ndarray:
    """The kernel of every row of codes with itself."""
    w, size = np.ascontiguousarray(words.T), words.shape[1]
    decay, twice, zero = np.float32(DECAY), np.float32(DECAY**2), np.zeros(len(words), np.float32)
    rows = [[zero + 1] * (size + 1)] + [[zero] * (size + 1) for _ in range(ORDER - 1)]
    out = np.zeros(len(words), np.float32)
    for i in range(size):
        run, now = [zero] * ORDER, [[zero + 1] * (size + 1)] + [[zero] * (size + 1) for _ in range(ORDER - 1)]
        for j in range(size):
            met = ((w[i] == w[j]) & (w[i] != 0)).astype(np.float32)
            out += met * rows[ORDER - 1][j]
            met *= twice
            for k in range(1, ORDER):
                run[k] = decay * run[k] + met * rows[k - 1][j]
                now[k][j + 1] = decay * rows[k][j + 1] + run[k]
        rows = now
    return out * twice


class Kernel:
    """Values of strings with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.groups = []
        for low, high in ((0, 7), (7, 10**6)):
            at = [i for i, z in enumerate(landmarks) if low < len(z) <= high]
            if at:
                own = own_kernel(_codes([landmarks[i] for i in at], max(len(landmarks[i]) for i in at)))
                self.groups.append((at, Marks([landmarks[i] for i in at]), np.where(own > 0, np.sqrt(own), 1)))

    def values(self, words: list[str]) -> np.ndarray:
        """(words, landmarks), to the power of ``POWER``."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.where(size >= ORDER, size, 0)
        for width in np.unique(widths[widths > 0]).tolist():
            places = np.flatnonzero(widths == width)
            for at in range(0, len(places), BLOCK):
                some = places[at : at + BLOCK].tolist()
                codes = _codes([words[k] for k in some], width)
                own = np.sqrt(own_kernel(codes))
                for at_marks, marks, root in self.groups:
                    value = marks.kernels(codes) / (np.where(own > 0, own, 1)[:, None] * root)
                    out[np.ix_(some, at_marks)] = np.minimum(value, 1) ** POWER
        return out


class Sentences:
    """Kernel values of sentences with landmarks; remembers the parts it has seen, up to a bound."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}  # a raw word's parts
        self.known: dict[str, int] = {}  # a part's row
        self.held = np.zeros((0, len(self.kernel.landmarks)), np.float32)

    def features(self, texts: list[str]) -> np.ndarray:
        """Parts of words that several of the texts have are remembered, those of others only here."""
        sets = [sentence_words(t) for t in texts]
        if len(self.known) > KNOWN_PARTS:
            self._forget()
        seen = Counter(itertools.chain.from_iterable(sets))

        def parts_of(w: str, at: dict[str, int]) -> tuple[int, ...]:
            x = normalise(w)
            return (at.setdefault(x, len(at)),) if len(x) <= CHUNK else tuple([at.setdefault(y, len(at)) for y in windows(x)])

        now, once = {}, []
        for w, n in seen.items():
            found = self.words.get(w)
            if found is not None:
                now[w] = found
            elif n > 1:
                now[w] = self.words[w] = parts_of(w, self.known)
            else:
                once.append(w)
        lasting, known = len(self.known), dict(self.known)
        for w in once:
            now[w] = parts_of(w, known)
        held = np.concatenate([self.held, self.kernel.values(list(itertools.islice(known, len(self.held), None)))])
        self.held = held[:lasting].copy()
        out = np.zeros((len(texts), len(self.kernel.landmarks)))
        for row, some in enumerate(sets):
            if some:
                ids = np.fromiter(itertools.chain.from_iterable(map(now.__getitem__, some)), np.int64)
                out[row] = held[np.unique(ids)].sum(0, dtype=np.float64)
        return out


def _ratio(n: int, size: int, against: int, other: int) -> float:
    """The log-likelihood ratio of two counts being of unlike rates, twice."""
    both = (n + against) / (size + other)
    term = lambda k, of, p: k * math.log(k / (of * p)) if k else 0.0
    return 2 * sum(term(k, of, both) + term(of - k, of, 1 - both) for k, of in ((n, size), (against, other)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], config: Config) -> list[str]:
    """Strings that cover the toxic sentences and keep off the clean ones, greedily.

    A string tells the classes apart if its likelihood ratio stands out of those
    that so many strings would reach by chance. A chosen one grows by a character
    as long as nine in ten of its sentences still hold it.
    """
    nt, nc, size = max(1, len(toxic)), max(1, len(clean)), config.shortest
    grams = lambda s: {w[i : i + size] for w in s for i in range(len(w) - size + 1)}
    seen: Counter = Counter()
    for s in toxic:
        seen.update(grams(s))
    seen = Counter({g: n for g, n in seen.items() if n > 1})
    against: Counter = Counter()
    for s in clean:
        against.update(grams(s) & seen.keys())
    least = 2 * math.log(len(seen) / config.chance) if seen else 0.0
    score = {g: math.log((n + 0.1) / (nt + 0.2) * (nc + 0.2) / (against[g] + 0.1)) for g, n in seen.items() if n / nt > against[g] / nc and _ratio(n, nt, against[g], nc) > least}
    held: dict[str, list[int]] = defaultdict(list)
    for d, s in enumerate(toxic):
        for g in grams(s) & score.keys():
            held[g].append(d)
    seen.clear()
    against.clear()
    cover = [0] * len(toxic)
    chosen: list[str] = []
    gain = lambda g: score[g] * sum(0.1 ** cover[d] for d in held[g])
    heap = [(-gain(g), g) for g in sorted(score)]
    heapq.heapify(heap)
    near = lambda a, b: any(a[i : i + size - 1] in b for i in range(2))
    while heap and len(chosen) < config.landmarks and min(cover) < config.cover:
        _, best = heapq.heappop(heap)
        if any(near(best, z) for z in chosen):
            continue
        now = gain(best)  # gains only fall: the first that keeps its place is the largest
        if heap and (-now, best) > heap[0]:
            heapq.heappush(heap, (-now, best))
            continue
        if now < 0.02 * nt:
            break
        holders = held[best]
        while len(best) < config.longest:
            longer: Counter = Counter()
            for d in holders:
                longer.update({x for w in toxic[d] if best in w for i in range(len(w) - len(best) + 1) if w.startswith(best, i) for x in (w[max(0, i - 1) : i + len(best)], w[i : i + len(best) + 1]) if len(x) > len(best)})
            x, n = min(longer.items(), key=lambda e: (-e[1], e[0]), default=("", 0))
            if n < 0.9 * len(holders):
                break
            best = x
        if any(z.strip("<>") in best or best.strip("<>") in z for z in chosen):  # it grew into what another landmark tells already
            continue
        chosen.append(best)
        for d in holders:
            cover[d] += 1
    return chosen


def confusable(marks: list[str], clean: list[set[str]], each: int) -> list[str]:
    """For each landmark the parts that bring clean sentences closest to it, all sentences together."""
    counts = Counter(w for s in clean for w in s)
    words = sorted(w for w in counts if not any(z in w for z in marks))
    out: list[str] = []
    total = Kernel(marks).values(words) * np.array([counts[w] for w in words], np.float32)[:, None] if words else np.zeros((0, len(marks)))
    for z in range(len(marks) if len(words) else 0):
        out += [words[i] for i in np.argsort(-total[:, z], kind="stable")[:each] if words[i] not in out]
    return out


def alter(word: str, rng: np.random.Generator) -> str:
    """A marked word with one or two letters inserted, or one replaced."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    kind = int(rng.integers(3))
    for _ in range(max(kind, 1)):
        at = int(rng.integers(2, len(word) - 1))
        word = word[:at] + letters[int(rng.integers(36))] + word[at + (kind == 0) :]
    return word


def train(texts: list[str], labels: list[int], config: Config = Config()) -> Model:  # noqa: B008
    if len(set(labels)) < 2:
        return Model(rate=float(np.mean(labels)) if labels else 0.0)
    one: dict[str, str] = {}  # a word is held once, however many sentences have it
    sets = [{one.setdefault(w, w) for w in parts(t)} for t in texts]
    del one
    toxic = [s for s, v in zip(sets, labels, strict=True) if v == 1]
    clean = [s for s, v in zip(sets, labels, strict=True) if v != 1]
    marks = choose_landmarks(toxic, clean, config)
    if not marks:
        return Model(rate=float(np.mean(labels)))
    telling = list(marks)
    marks += confusable(telling, clean, config.confusable)
    reader, rng = Sentences(marks), np.random.default_rng(5)
    x = np.concatenate([reader.features(texts[at : at + 100]) for at in range(0, len(texts), 100)])
    # altered copies differ from their sentence in the telling parts alone
    told = [sorted(w for w in s if any(z in w for z in telling)) if v == 1 else [] for s, v in zip(sets, labels, strict=True)]
    made, said = [], []
    for hit, row, v in zip(told, x, labels, strict=True):
        if hit:
            plain = reader.kernel.values(hit).sum(0, dtype=np.float64)
            for _ in range(config.altered):
                made.append(row - plain + reader.kernel.values([alter(w, rng) for w in hit]).sum(0, dtype=np.float64))
                said.append(1.0 if v == 1 else -1.0)
    y = np.array([1.0 if v == 1 else -1.0 for v in labels])
    del reader, sets
    x, y = np.vstack([x, *([np.array(made)] if made else [])]), np.r_[y, said]
    gram = Kernel(marks).values(marks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    f = np.hstack([x @ root, np.ones((len(x), 1))])
    cost = np.where(y > 0, math.sqrt((y < 0).sum() / (y > 0).sum()), 1.0)
    cost[len(labels) :] *= config.altered_cost
    w, ridge = np.zeros(f.shape[1]), config.penalty * len(y) * np.eye(f.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(50):  # Newton's method on the squared hinge
        on = y * (f @ w) < 1
        g = f[on] * cost[on, None]
        new = np.linalg.solve(g.T @ f[on] + ridge, g.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    margin = f @ w
    # Platt's scaling
    slope, shift = 4.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        target = np.where(y > 0, 1 - 1e-3, 1e-3)
        g = np.array([(cost * (p - target) * margin).sum() + 0.01 * (slope - 4), (cost * (p - target)).sum()])
        h = cost * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[(h * margin * margin).sum() + 0.01, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(m, g), -2, 2)
        slope = max(slope, 0.5)
    return Model(marks, root @ w[:-1], float(w[-1]), float(slope), float(shift))


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:  # noqa: B008
    """Train on labelled rows whose CRC-32 of the id is not divisible by 5."""
    kept = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, "toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    kept = kept.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [kept.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(config.sample).collect() for v in (1, 0)]
    ids = [(r.doc_id, r.toxic) for side in picked for r in side]
    if not ids:
        return Model(rate=0.0)
    # at most 2 * sample ids: a bounded broadcast
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return train([r.text or "" for r in rows], [r.toxic for r in rows], config)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of up to ``TEXTS`` texts and about ``TEXT_BYTES`` bytes; a longer text is a run of its own."""
    size = np.cumsum(np.r_[0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, min(len(texts), at + TEXTS, int(np.searchsorted(size, size[at] + TEXT_BYTES, side="right")) - 1))
        yield at, to
        at = to


def _scorer(model: Model, whole: bool = False):
    """Rows with a score instead of their last column, a text; ``whole``: behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Sentences(model.landmarks)  # for this task alone: what later stages run in the worker finds its memory free
        for batch in batches:
            for at, to in _runs(batch.column(batch.num_columns - 1)):  # small batches go back, whatever the columns hold
                part = batch.slice(at, to - at)
                score = model.probability(reader.features([t or "" for t in part.column(part.num_columns - 1).to_pylist()]))
                n = part.num_columns - (not whole)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(score, pa.float64())], names=[*part.schema.names[:n], "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``score`` and ``predicted``."""
    keep = [c for c in keep or docs.columns if c.lower() not in ("score", "predicted")]
    value = T.StructField("score", T.DoubleType())
    (said,) = free(docs, "said")
    if keep.count(text) == 1 and dict(docs.dtypes).get(text) == "string":  # a text that is kept travels once
        rows = docs.select(*columns(docs, [c for c in keep if c != text]), column(docs, text).alias(said))
        out = mapped(rows, _scorer(model, whole=True), T.StructField(said, T.StringType()), value)
        out = out.select(*[column(out, said).alias(text) if c == text else column(out, c) for c in keep], "score")
    else:
        rows = docs.select(*columns(docs, keep), column(docs, text).cast("string").alias(said))
        out = mapped(rows, _scorer(model), value)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
