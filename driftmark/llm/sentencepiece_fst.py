"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file. The normaliser rewrites the longest
match of the model's character map at each place, joins white space if the model
says so, and adds the dummy prefix and white space marks. The lexicon is a trie of
pieces whose arcs emit ids with weights. The byte fallback has an arc for every
letter without a piece of its own, which emits the letter's bytes, or the unknown
id where the model has no bytes; neighbouring unknown ids are one. A text is
composed with them and the shortest path in the tropical semiring (minus, plus) is
its encoding.

For a unigram model an arc weighs minus its piece's score, a fallback arc the worst
score's and a penalty, and a user-defined piece less than anything it could be cut
into. A byte-pair model cuts user-defined pieces out first. It
ranks merges, which no sum of piece weights can express; there the lexicon is
composed with an acceptor over pairs of neighbouring pieces, whose arcs weigh 0
where merging the two pieces' letters ends in just these two pieces and infinity
elsewhere. A sequence of pieces is the byte-pair encoding of its text exactly if
each neighbouring pair is, so the shortest path is that encoding, and the only
one of finite weight. The acceptor's arcs are made when first met.

Composition works on whole batches: texts are cut where no piece can cross, each
distinct cut is encoded once, and the search runs over all new cuts at a time, a
position at a time, in arrays. What a worker remembers of cuts is bounded.

Edge cases: null texts have null ids, empty texts no ids; letters outside the
vocabulary become byte pieces (or the unknown id, if the model has no bytes);
decoding restores the normalised text except for U+2581, which is the white space
mark itself, for unknown ids, and for ids that are no valid UTF-8, which give
U+FFFD; repeated rows are encoded alike; extra columns pass through, whatever their
names, and the operator's own replace any of the same name. Models that put white
space marks behind words are refused.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import column, columns, free, mapped

MARK = "▁"
KNOWN_CUTS = 500_000
PAIR_SLOTS = 1 << 21
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


#: What a fallback arc weighs more than the worst piece.
PENALTY = 10.0


def read_charsmap(blob: bytes) -> dict[str, str]:
    """The rewriting rules in a model's character map: a double array of the sources' bytes, then the targets."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    step = lambda u: (u >> 10) << ((u & 512) >> 6)
    base, names = np.array([step(units[0])]), [b""]
    out: dict[str, str] = {}
    labels = np.arange(1, 256)
    while len(base):
        at = base[:, None] ^ labels
        fits = (at < len(units)) & ((units[np.minimum(at, len(units) - 1)] & 0x800000FF) == labels)
        parent, c = np.nonzero(fits)
        here = at[parent, c]
        unit = units[here]
        base = here ^ step(unit)
        names = [names[p] + bytes([x + 1]) for p, x in zip(parent.tolist(), c.tolist(), strict=True)]
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            start = int(units[base[k]] & 0x7FFFFFFF)
            out[names[k].decode()] = targets[start : targets.index(b"\0", start)].decode()
    return out


def _any_of(letters: set[str]) -> str:
    return f"[{''.join(re.escape(c) for c in sorted(letters))}]" if letters else "(?!)"


class Normaliser:
    """Longest matches of rules are rewritten; user-defined pieces stay as they are; white space is joined or kept."""

    def __init__(self, charsmap: bytes = b"", collapse: bool = False, keep: list[str] = []):  # noqa: B006
        self.rules, self.collapse = read_charsmap(charsmap), collapse
        self.longest = max(map(len, self.rules), default=0)
        self.keep = re.compile("|".join(re.escape(x) for x in sorted(keep, key=lambda x: (-len(x), x)))) if keep else None
        many = [k for k in self.rules if len(k) > 1]
        alone = _any_of({k for k in self.rules if len(k) == 1})
        begun = f"{_any_of({k[0] for k in many})}(?={_any_of({k[1] for k in many})})"
        self.active = re.compile(f"{begun}|{alone}", re.S) if self.rules else None

    def _rewrite(self, text: str) -> str:
        if self.active is None or self.active.search(text) is None:
            return text
        out, at = [], 0
        while m := self.active.search(text, at):
            out.append(text[at : m.start()])
            at = m.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if text[at : at + n] in self.rules:
                    out.append(self.rules[text[at : at + n]])
                    at += n
                    break
            else:
                out.append(text[at])
                at += 1
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.keep is None:
            text = self._rewrite(text)
        else:
            out, at = [], 0
            for m in self.keep.finditer(text):
                out += [self._rewrite(text[at : m.start()]), m[0]]
                at = m.end()
            text = "".join([*out, self._rewrite(text[at:])])
        return re.sub(" +", " ", text).strip(" ") if self.collapse else text


class Lexicon:
    """The compiled machines."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, add_prefix: bool = True, charsmap: bytes = b"", collapse: bool = False):
        self.pieces, self.bpe, self.add_prefix, self.collapse = pieces, bpe, add_prefix, collapse
        user = [p[0] for p in pieces if p[2] == USER]
        self.plain = Normaliser(charsmap, collapse, user)
        self.frozen = self.plain.keep if bpe else None
        if bpe and any(p[2] == UNUSED for p in pieces):
            raise ValueError("byte-pair models with unused pieces are not compiled")
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.rank = {p[0]: (p[1], i) for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)}
        normal = [p[1] for p in pieces if p[2] == NORMAL] or [0.0]
        worth = lambda p: len(p[0].encode()) * np.float32(max(normal)) - np.float32(0.1) if p[2] == USER else np.float32(p[1])
        self.weight = np.array([-worth(p) for p in pieces], np.float32)
        self.penalty = np.float32(-(np.float32(min(normal)) - np.float32(PENALTY)))
        long = [p for p in self.rank if len(p) > 1 and not (bpe and p in user)]
        inner = set("".join(long))
        lone = [c for c in inner if c not in self.rank]
        if bpe and lone:
            raise ValueError(f"letters without a piece of their own: {lone[:5]!r}")
        # cuts: single letters that no longer piece holds, and before each run of marks
        self.letters = {c: k + 1 for k, c in enumerate(sorted(inner))}
        body = "".join(re.escape(c) for c in sorted(inner - {MARK}))
        crossing = any(MARK in p.lstrip(MARK) for p in long)
        word = f"[{body}{MARK}]+" if crossing else f"{MARK}*[{body}]+|{MARK}+"
        self.cut = re.compile(f"{word}|." if body else ".", re.S)
        self.by_word = not crossing
        self._trie()
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)
        self.cuts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.bytes_of = [self._bytes(p) for p in pieces]

    @staticmethod
    def _bytes(piece: tuple[str, float, int]) -> bytes:
        if piece[2] == BYTE:
            return bytes([int(piece[0][3:5], 16)])
        if piece[2] == CONTROL:
            return b""
        if piece[2] == UNKNOWN:
            return " ⁇ ".encode()
        return piece[0].replace(MARK, " ").encode()

    def _trie(self) -> None:
        nodes: dict[str, int] = {"": 1}
        for p in self.rank:
            if all(c in self.letters for c in p):
                for n in range(1, len(p) + 1):
                    nodes.setdefault(p[:n], len(nodes) + 1)
        self.longest = max((len(p) for p in nodes), default=1)
        self.own = np.array([False] + [c in self.rank for c in sorted(self.letters)])
        self.next = np.zeros((len(nodes) + 1, len(self.letters) + 1), np.int32)
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        for p, k in nodes.items():
            if p:
                self.next[nodes[p[:-1]], self.letters[p[-1]]] = k
                if p in self.rank:
                    self.piece[k] = self.rank[p][1]

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-ranked pair first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] > best):
                    best, at = r[0], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the acceptor has an arc from ``left`` (-1: the start) to ``right``."""
        key = (left.astype(np.int64) + 1) * len(self.pieces) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self.pair_fits[slot]
        missed = np.flatnonzero(self.pair_key[slot] != key)
        if len(missed):
            keys, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            told = np.zeros(len(keys), bool)
            for n, m in enumerate(missed[first]):
                a = "" if left[m] < 0 else self.pieces[left[m]][0]
                b = self.pieces[right[m]][0]
                told[n] = self.merge(a + b) == ([a, b] if a else [b])
            out[missed] = told[back]
            self.pair_key[slot[missed[first]]] = keys
            # two pairs may share a slot: the one that stays writes its own answer
            stays = self.pair_key[slot[missed[first]]] == keys
            self.pair_fits[slot[missed[first]][stays]] = told[stays]
        return out

    def shortest_paths(self, segments: list[str]) -> list[np.ndarray]:
        """Ids along the shortest path of each segment, all of letters that pieces hold; -2 - letter for a fallback arc."""
        out: list = [None] * len(segments)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by_size.setdefault(len(s), []).append(i)
        for size, all_places in by_size.items():
            for at in range(0, len(all_places), 20_000):
                places = all_places[at : at + 20_000]
                for i, ids in zip(places, self._search([segments[i] for i in places], size), strict=True):
                    out[i] = ids
        return out

    def _search(self, segments: list[str], size: int) -> list[np.ndarray]:
        n = len(segments)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).reshape(n, size)
        found, code = np.unique(points, return_inverse=True)
        code = np.array([self.letters.get(chr(c), 0) for c in found], np.int32)[code.reshape(n, size)]
        cost = np.full((size + 1, n), np.inf, np.float32)
        last = np.full((size + 1, n), -1, np.int32)
        back = np.zeros((size + 1, n), np.int32)
        cost[0] = 0
        for i in range(size):
            rows = np.flatnonzero(np.isfinite(cost[i]))
            node = np.ones(len(rows), np.int32)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                node = self.next[node, code[rows, j - 1]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                arc = np.flatnonzero(piece >= 0)
                r, p = rows[arc], piece[arc]
                if self.bpe:
                    ok = self.fits(last[i, r], p)
                    r, p = r[ok], p[ok]
                    total = np.zeros(len(r), np.float32)
                else:
                    total = cost[i, r] + self.weight[p]
                    ok = total < cost[j, r]
                    r, p, total = r[ok], p[ok], total[ok]
                cost[j, r], last[j, r], back[j, r] = total, p, i
            if not self.bpe:  # the fallback, where the letter is no piece
                rows = np.flatnonzero(np.isfinite(cost[i]) & ~self.own[code[:, i]])
                total = cost[i, rows] + self.penalty
                ok = total < cost[i + 1, rows]
                rows, total = rows[ok], total[ok]
                cost[i + 1, rows], last[i + 1, rows], back[i + 1, rows] = total, -2 - points[rows, i].astype(np.int32), i
        # read the paths backwards, all at a time
        ids = np.zeros((size, n), np.int32)
        count = np.zeros(n, np.int64)
        at = np.full(n, size)
        rows = np.arange(n)
        while len(rows):
            ids[size - 1 - count[rows], rows] = last[at[rows], rows]
            count[rows] += 1
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [ids[size - c :, k] for k, c in enumerate(count)]

    def fallback(self, letter: str) -> bytes:
        if letter in self.rank:
            return np.int32(self.rank[letter][1]).tobytes()
        if self.byte:
            return np.array([self.byte[b] for b in letter.encode("utf-8", "surrogatepass")], np.int32).tobytes()
        return np.int32(self.unknown).tobytes()

    def resolved(self, ids: np.ndarray) -> bytes:
        """A path's ids with its fallback arcs written out."""
        if (ids >= -1).all():
            return ids.tobytes()
        return b"".join(np.int32(i).tobytes() if i >= -1 else self.fallback(chr(-2 - i)) for i in ids.tolist())

    def normalise(self, text: str) -> str:
        text = self.plain(text)
        return (MARK if self.add_prefix and text else "") + text.replace(" ", MARK)

    def chunks(self, text: str) -> list[str]:
        """Parts that no piece crosses; a part may still hold lone letters."""
        text = self.plain(text)
        if not text:
            return []
        if self.frozen is not None and (self.frozen.search(text) or self.frozen.search(text.replace(" ", MARK))):
            text = (MARK if self.add_prefix else "") + text.replace(" ", MARK)
            out, at = [], 0
            for m in self.frozen.finditer(text):
                out += [*self.cut.findall(text[at : m.start()]), m[0]]
                at = m.end()
            return [*out, *self.cut.findall(text[at:])]
        if self.by_word and self.add_prefix and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return (MARK + text.replace(" ", " " + MARK)).split(" ")
        return self.cut.findall((MARK if self.add_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        parts = [self.chunks(t) for t in texts]
        if len(self.known) > KNOWN_CUTS:
            self.known.clear()
            self.cuts.clear()
        new = list(set().union(*parts) - self.known.keys()) if parts else []
        inner = [self.cut.findall(c) if self.frozen is None or not self.frozen.fullmatch(c) else [c] for c in new]
        segments = list({s for cut in inner for s in cut} - self.cuts.keys())
        lone = [s for s in segments if (len(s) == 1 and s not in self.letters) or (self.frozen is not None and self.frozen.fullmatch(s))]
        for s in lone:
            self.cuts[s] = self.fallback(s)
        known = [s for s in segments if s not in self.cuts]
        for s, ids in zip(known, self.shortest_paths(known), strict=True):
            self.cuts[s] = ids.tobytes() if self.bpe else self.resolved(ids)
        for c, cut in zip(new, inner, strict=True):
            self.known[c] = self.cuts[cut[0]] if len(cut) == 1 else b"".join([self.cuts[s] for s in cut])
        get = self.known.__getitem__
        found = [b"".join(map(get, p)) for p in parts]
        if self.byte:
            return found
        once = []
        for x in found:  # a run of unknown letters is one
            ids = np.frombuffer(x, np.int32)
            odd = ids == self.unknown
            twice = odd[1:] & odd[:-1]
            once.append(ids[np.r_[True, ~twice]].tobytes() if twice.any() else x)
        return once

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if (self.add_prefix or self.collapse) and text[:1] == " " else text


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool, bool, bytes, bool]:
    """Pieces (text, score, type), whether it is a byte-pair model, the dummy prefix, the character map, and whether white space is joined."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with white space marks before words are compiled")
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and byte-pair models are compiled")
    return [(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == 2, n.add_dummy_prefix, n.precompiled_charsmap, n.remove_extra_whitespaces


def _lexicon(model: tuple) -> Lexicon:
    """A worker compiles a model once, for all its tasks."""
    kept = sys.__dict__.setdefault("_driftmark_lexicon", {})
    key = hash((tuple(model[0]), *model[1:]))
    if key not in kept:
        kept.clear()
        kept[key] = Lexicon(*model)
    return kept[key]


def _encoder(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _lexicon(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.num_columns - 1)
                ids = fst.encode([t or "" for t in texts.to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "ids"])

    return run


def _decoder(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _lexicon(model)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            texts = [None if null else fst.decode(values[a:b]) for a, b, null in zip(offsets[:-1], offsets[1:], lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    return run


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids``."""
    rows = df.select(*columns(df, [c for c in df.columns if c.lower() != "ids"]), column(df, text).cast("string").alias(free(df, "text")[0]))
    return mapped(rows, _encoder(read_model(model_path)), T.StructField("ids", T.ArrayType(T.IntegerType(), False)))


def decode(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``."""
    rows = df.select(*columns(df, [c for c in df.columns if c.lower() != "decoded"]), column(df, ids).cast("array<int>").alias(free(df, "ids")[0]))
    return mapped(rows, _decoder(read_model(model_path)), T.StructField("decoded", T.StringType()))


def round_trip(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``df`` without the text, with ``ids``, ``n_tokens`` and whether decoding gives the text back."""
    model = read_model(model_path)
    held = [c for c in df.columns if c.lower() not in ("ids", "n_tokens", "same", text.lower())]
    rows = df.select(*columns(df, held), column(df, text).cast("string").alias(free(df, "text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, encoder = _lexicon(model), _encoder(model)
        for batch in batches:
            at = 0
            for part in encoder(iter([batch])):
                lists, texts = part.column(part.num_columns - 1), batch.column(batch.num_columns - 1).slice(at, part.num_rows).to_pylist()
                at += part.num_rows
                offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
                same = [None if t is None else fst.decode(values[a:b]) == fst.plain(t).replace(MARK, " ") for a, b, t in zip(offsets[:-1], offsets[1:], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(same, pa.bool_())], names=[*part.schema.names, "same"])

    out = mapped(rows, run, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("same", T.BooleanType()))
    return out.withColumn("n_tokens", F.size("ids"))
