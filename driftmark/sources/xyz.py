"""XYZ trajectories as Spark data sources: ``ipi_xyz`` and ``extxyz``, and their writer.

A frame is a count line, a comment line and one line an atom. Files are cut into
byte ranges; a task finds the first frame that starts in its range by looking for
a count line that its comment, so many atom lines and another count line follow.
Frame numbers need the counts of the ranges before, so ``read_ipi`` and
``read_extxyz`` count the frames of each range in a Spark job first; the driver
sees one row a range, never the files. The counts may be kept beside the data as
Parquet and are valid while the file's size and time are unchanged. Filters on
``frame`` prune ranges, and stop a task at the last frame that is wanted. Without
counts (``spark.read.format`` alone) each file is one partition.

Options: ``stride`` (step of frame k without a Step: k * stride, 50 by default),
``run``, ``track``, ``range_bytes`` (64 MiB), ``index_dir``, ``columns`` (those to
parse of symbols, positions, forces, energy, comment; all by default),
``positions_only`` (no forces), ``frame_start``, ``frame_end`` and ``frame_stride``
(a strided scan of [start, end)). Paths are a file, a folder or a glob; beads
number the sorted matches.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from driftmark.schema import FRAMES

STEP, BEAD = re.compile(r"Step:\s*(\d+)"), re.compile(r"Bead:\s*(\d+)")
_PAIR = re.compile(r"""([A-Za-z_][\w\-]*)=(?:"((?:[^"\\]|\\.)*)"|'([^']*)'|\{([^}]*)\}|(\S+))""")
RANGE_BYTES = 64 << 20
#: Counts of so many ranges travel as an option; more go through a file in the shared folder.
INLINE_RANGES = 2000


@dataclass
class Frame:
    offset: int
    n_atoms: int
    comment: str


def _is_count(line: bytes) -> bool:
    return line.strip().isdigit()


def _synchronised(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines with their offsets, from the first frame that starts at ``at`` or later."""

    def lines(at: int) -> Iterator[tuple[int, bytes]]:
        while line := f.readline():
            yield at, line
            at += len(line)

    if at == 0:
        f.seek(0)
        yield from lines(0)
        return
    f.seek(at - 1)
    at += len(f.readline()) - 1
    rest, held = lines(at), []

    def line(k: int) -> bytes | None:
        while len(held) <= k:
            more = next(rest, None)
            if more is None:
                return None
            held.append(more)
        return held[k][1]

    while (first := line(0)) is not None:
        if _is_count(first):
            n = int(first)
            atoms = all((x := line(k)) is not None and len(x.split()) >= 4 for k in range(2, n + 2))
            after = n + 2
            while atoms and (x := line(after)) is not None and not x.strip():
                after += 1
            if atoms and ((x := line(after)) is None or _is_count(x)):
                yield from held
                yield from rest
                return
        held.pop(0)


def frames_between(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes, list[bytes]]]:
    """(offset, atoms, comment, atom lines) of the frames that start in [start, end); blank lines between frames are skipped."""
    with open(path, "rb", buffering=1 << 20) as f:
        rest, number = _synchronised(f, start), 0
        for at, line in rest:
            if end is not None and at >= end:
                return
            if not line.strip():
                continue
            try:
                n = int(line)
            except ValueError:
                raise ValueError(f"{path}: byte {at} is not an atom count: {line[:40]!r}") from None
            comment = next(rest, (0, b""))[1]
            atoms = [x for _, x in itertools.islice(rest, n)]
            if len(atoms) < n:
                raise ValueError(f"{path}: frame {number} ends after {len(atoms)} of {n} atoms")
            yield at, n, comment, atoms
            number += 1


def scan_index(path: str) -> list[Frame]:
    """All frames of one file, in one pass."""
    return [Frame(at, n, comment.decode("utf-8", "replace").rstrip("\r\n")) for at, n, comment, _ in frames_between(path)]


@dataclass
class Range(InputPartition):
    """The frames of a file that start in [start, end), the first of which is number ``first``; ``count`` -1: not counted."""

    path: str
    bead: int
    start: int
    end: int
    first: int
    count: int


def _sidecar(path: str, index_dir: str) -> str:
    return os.path.join(index_dir, os.path.basename(path) + ".frames.parquet")


def _known_counts(path: str, size: int, index_dir: str | None) -> list[tuple[int, int, int]] | None:
    """(start, end, frames) of a file's ranges from its sidecar, if that is valid."""
    if index_dir is None:
        return None
    try:
        table, stat = pq.read_table(_sidecar(path, index_dir)), os.stat(path)
        meta = table.schema.metadata or {}
        if meta.get(b"path") == os.path.realpath(path).encode() and int(meta[b"size"]) == stat.st_size and int(meta[b"range_bytes"]) == size and abs(float(meta[b"mtime"]) - stat.st_mtime) < 1:
            return [tuple(r.values()) for r in table.to_pylist()]
    except (OSError, KeyError, ValueError, pa.ArrowException):
        pass
    return None


def _keep_counts(path: str, counts: list[tuple[int, int, int]], size: int, index_dir: str | None) -> None:
    """A sidecar that can't be written is no error."""
    if index_dir is None:
        return
    try:
        os.makedirs(index_dir, exist_ok=True)
        stat = os.stat(path)
        table = pa.table({k: pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(("start", "end", "frames"))})
        meta = {"path": os.path.realpath(path), "size": str(stat.st_size), "range_bytes": str(size), "mtime": repr(stat.st_mtime)}
        pq.write_table(table.replace_schema_metadata(meta), _sidecar(path, index_dir))
    except OSError:
        pass


def count_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES, index_dir: str | None = None) -> list[Range]:
    """The ranges of all files with their first frames' numbers: counted on the executors, added up on the driver."""
    files = matches(path)
    known = [_known_counts(p, size, index_dir) for p in files]
    asked = [(k, p, at, min(at + size, n)) for k, p in enumerate(files) if known[k] is None for n in [os.stat(p).st_size] for at in range(0, n, size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"file": [r["file"] for r in rows], "start": [r["start"] for r in rows], "end": [r["end"] for r in rows], "frames": [sum(1 for _ in frames_between(r["path"], r["start"], r["end"])) for r in rows]})

    if asked:
        rows = spark.createDataFrame(asked, "file long, path string, start long, end long").repartition(min(len(asked), 4096))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows.mapInArrow(count, "file long, start long, end long, frames long").collect():  # one small row a range
            found.setdefault(r.file, []).append((r.start, r.end, r.frames))
        for k, counts in found.items():
            known[k] = sorted(counts)
            _keep_counts(files[k], known[k], size, index_dir)
    out = []
    for k, p in enumerate(files):
        first = 0
        for start, end, n in known[k] or []:
            out.append(Range(p, k, start, end, first, n))
            first += n
    return out


def matches(path: str) -> list[str]:
    """Sorted files of a path, folder or glob: the bead's number is the place in this list."""
    found = sorted(glob.glob(path)) if glob.has_magic(path) else sorted(os.path.join(path, x) for x in os.listdir(path)) if os.path.isdir(path) else [path] if os.path.exists(path) else []
    if not found:
        raise FileNotFoundError(path)
    return found


def comment_values(comment: str) -> dict[str, str]:
    """key=value pairs of an extended comment line; values may be quoted."""
    return {m[1]: next(x for x in m.groups()[1:] if x is not None) for m in _PAIR.finditer(comment)}


def columns_of(properties: str) -> list[tuple[str, str, int, int]]:
    """(name, type, first column, width) of a Properties value."""
    parts, out, at = properties.split(":"), [], 0
    for k in range(0, len(parts) - 2, 3):
        out.append((parts[k].lower(), parts[k + 1], at, int(parts[k + 2])))
        at += int(parts[k + 2])
    return out


def _vectors(blocks: list[np.ndarray | None]) -> pa.Array:
    """A column of lists of 3-vectors."""
    size = [0 if x is None else len(x) for x in blocks]
    flat = np.concatenate([x.reshape(-1) for x in blocks if x is not None]) if any(size) else np.zeros(0)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3), pa.int32()), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), inner, mask=pa.array([x is None for x in blocks]))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, extended: bool):
        self.options, self.extended = dict(options), extended
        self.low, self.high, self.only = int(self.options.get("frame_start", 0)), None, None
        if "frame_end" in self.options:
            self.high = int(self.options["frame_end"])
        self.origin, self.every = self.low, int(self.options.get("frame_stride", 1))
        wanted = self.options.get("columns")
        self.parsed = set(wanted.replace(" ", "").split(",")) if wanted else {"symbols", "positions", "forces", "energy", "comment"}
        if self.options.get("positions_only", "false").lower() == "true":
            self.parsed -= {"forces"}

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                if isinstance(f, EqualTo):
                    self.only = {f.value} if self.only is None else self.only & {f.value}
                elif isinstance(f, In):
                    self.only = set(f.value) if self.only is None else self.only & set(f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = f.value + isinstance(f, LessThanOrEqual)
                    self.high = high if self.high is None else min(self.high, high)
            yield f  # Spark still checks each row

    def last(self) -> int:
        """No frame from here on is wanted."""
        high = sys.maxsize if self.high is None else self.high
        return high if self.only is None else min(high, max(self.only, default=-1) + 1)

    def wants(self, frame: int) -> bool:
        return frame >= self.low and frame < self.last() and (frame - self.origin) % self.every == 0 and (self.only is None or frame in self.only)

    def some(self, part: Range) -> bool:
        if part.count < 0:
            return True
        if self.only is not None:
            return any(part.first <= k < part.first + part.count and self.wants(k) for k in self.only)
        return part.count > 0 and part.first < self.last() and part.first + part.count > self.low

    def partitions(self):
        told = self.options.get("ranges")
        if told is None:
            ranges = [Range(p, k, 0, os.stat(p).st_size, 0, -1) for k, p in enumerate(matches(self.options["path"]))]
        elif told.startswith("["):
            ranges = [Range(**r) for r in json.loads(told)]
        else:
            ranges = [Range(**r) for r in pq.read_table(told).to_pylist()]
        return [r for r in ranges if self.some(r)] or [Range("", 0, 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        rows, stop = [], self.last()
        for frame, (_, n, comment, atoms) in enumerate(frames_between(part.path, part.start, part.end), part.first):
            if frame >= stop:
                break
            if self.wants(frame):
                rows.append(self.row(part, frame, n, comment.decode("utf-8", "replace").rstrip("\r\n"), atoms))
            if len(rows) >= 512:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def row(self, part: Range, frame: int, n: int, comment: str, atoms: list[bytes]) -> dict:
        o, parsed = self.options, self.parsed
        out = {"run": o.get("run", "run"), "track": o.get("track", "bead"), "bead": part.bead, "frame": frame, "n_atoms": n, "comment": comment if "comment" in parsed else None, "symbols": None, "forces": None, "energy": None, "positions": None}
        said = STEP.search(comment)
        fields = [a.split() for a in atoms] if parsed & {"symbols", "positions", "forces"} else []
        take = lambda at, k: np.array([a[at : at + k] for a in fields], "S32").astype(np.float64).reshape(n, k)
        if not self.extended:
            # symbols are not looked at: such files are read for their coordinates
            if "positions" in parsed:
                out["positions"] = take(1, 3)
            out["step"] = int(said[1]) if said else frame * int(o.get("stride", 50))
            return out
        values = comment_values(comment)
        by = {name: (at, k) for name, _, at, k in columns_of(values.get("Properties", "species:S:1:pos:R:3"))}
        find = lambda *names: next((by[x] for x in names if x in by), None)
        species, pos, force = find("species", "element"), find("pos", "positions"), find("forces", "force", "ref_forces")
        if "symbols" in parsed and species:
            out["symbols"] = [a[species[0]].decode() for a in fields]
        if "positions" in parsed and pos:
            out["positions"] = take(*pos)
        if "forces" in parsed:
            out["forces"] = take(*force) if force else np.zeros((n, 3))
        if "energy" in parsed:
            energy = next((values[x] for x in ("energy", "REF_energy") if x in values), None)
            out["energy"] = float(energy) if energy is not None else 0.0
        step = values.get("step", values.get("Step"))
        out["step"] = int(said[1]) if said else int(float(step)) if step is not None else frame
        if o.get("pimd", "false").lower() == "true":  # such loads number their frames, whatever the comment says
            out["step"] = frame
        return out

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"run": pa.string(), "track": pa.string(), "bead": pa.int32(), "frame": pa.int64(), "step": pa.int64(), "n_atoms": pa.int32(), "symbols": pa.list_(pa.string()), "positions": None, "forces": None, "energy": pa.float64(), "comment": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) if t is not None else _vectors([r[k] for r in rows]) for k, t in kinds.items()], names=list(kinds))


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """Extended XYZ: one part a task, renamed into place when all are done."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.folder, self.overwrite, self.names = options["path"], overwrite, [f.name for f in schema.fields]

    def write(self, rows) -> _Written:
        import uuid

        path, f = None, None
        for r in rows:
            if f is None:
                os.makedirs(self.folder, exist_ok=True)
                path = os.path.join(self.folder, f".{uuid.uuid4().hex}.tmp")
                f = open(path, "w")  # noqa: SIM115
            f.write(format_frame({k: r[k] for k in self.names}))
        if f:
            f.close()
        return _Written(path)

    def commit(self, messages) -> None:
        if self.overwrite and os.path.isdir(self.folder):
            for x in os.listdir(self.folder):
                if x.endswith(".extxyz"):
                    os.remove(os.path.join(self.folder, x))
        for k, m in enumerate(m for m in messages if m and m.path):
            os.replace(m.path, os.path.join(self.folder, f"part-{k:05d}.extxyz"))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


def format_frame(row: dict) -> str:
    """One extended XYZ frame; ``lattice`` and ``info`` (a map) are optional."""
    forces = row.get("forces")
    said = [f'Lattice="{row["lattice"]}"'] if row.get("lattice") else []
    said.append("Properties=species:S:1:pos:R:3" + (":forces:R:3" if forces else ""))
    if forces:
        said.append("forces_unit=eV/Ang")
    said += [f"{name}={row[key]}" for name, key in (("Step", "step"), ("Bead", "bead")) if row.get(key) is not None]
    said += [f'{k}="{v}"' if re.search(r"\s", str(v)) else f"{k}={v}" for k, v in (row.get("info") or {}).items()]
    lines = [str(len(row["positions"])), " ".join(said)]
    for k, p in enumerate(row["positions"]):
        lines.append("  ".join([row["symbols"][k] if row.get("symbols") else "X", *(f"{x:.10f}" for x in p), *(f"{x:.10f}" for x in (forces[k] if forces else ()))]))
    return "\n".join(lines) + "\n"


class IpiXyz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ipi_xyz"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, extended=False)


class ExtXyz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, extended=True)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (IpiXyz, ExtXyz):
        spark.dataSource.register(source)


def _load(spark: SparkSession, kind: str, path: str, options: dict) -> DataFrame:
    register(spark)
    options = {k: v for k, v in options.items() if v is not None}
    ranges = [asdict(r) for r in count_ranges(spark, path, int(options.pop("range_bytes", RANGE_BYTES)), options.pop("index_dir", None))]
    if len(ranges) <= INLINE_RANGES:
        told = json.dumps(ranges)
    else:
        root = spark.conf.get("spark.checkpoint.dir", None) or os.path.dirname(matches(path)[0])
        told = os.path.join(root.removeprefix("file://"), f"ranges-{os.urandom(8).hex()}.parquet")
        pq.write_table(pa.Table.from_pylist(ranges), told)
    return spark.read.format(kind).options(ranges=told, **{k: str(v) for k, v in options.items()}).load(path)


def read_ipi(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, "ipi_xyz", path, options)


def read_extxyz(spark: SparkSession, path: str, **options) -> DataFrame:
    return _load(spark, "extxyz", path, options)


def first_frame(path: str) -> tuple[list[str], list[list[float]]]:
    """Symbols and positions of a file's first frame."""
    with open(path, "rb") as f:
        n = int(f.readline())
        f.readline()
        rows = [f.readline().split() for _ in range(n)]
    return [r[0].decode() for r in rows], [[float(x) for x in r[1:4]] for r in rows]


def select_frames(frames: DataFrame, ids: list[int]) -> DataFrame:
    """Chosen frames; the ids reach the source as a filter, which skips the other byte ranges."""
    return frames.where(frames["frame"].isin([int(i) for i in ids]))


def read_forces_npz(spark: SparkSession, path: str) -> DataFrame:
    """(frame, forces) of a NumPy archive's ``forces``."""
    x = np.load(path)["forces"]
    return spark.createDataFrame([(k, f.tolist()) for k, f in enumerate(x)], "frame bigint, forces array<array<double>>")


def _open_hdf5(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 trajectories need h5py; convert them to Parquet frames where it is installed") from e
    return h5py.File(path)


def import_hdf5(spark: SparkSession, path: str, run: str = "run", frames_per_task: int = 1000, opened=_open_hdf5) -> DataFrame:
    """Frames of a file with ``bead_positions`` and ``positions``, and ``bead_forces``, ``forces`` and ``potential`` if there are any; steps count frames.

    The driver reads shapes alone; each task opens the file and reads its own frames.
    """
    with opened(path) as f:
        shape, centroid = f["bead_positions"].shape, f["positions"].shape
    if centroid != (shape[0], *shape[2:]):
        raise ValueError(f"centroid shape {centroid} does not fit bead shape {shape}")
    n, beads, atoms = shape[:3]

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as f:
            for rows in batches:
                for first in rows.column(0).to_pylist():
                    to = min(n, first + frames_per_task)
                    held = {k: np.asarray(f[k][first:to], np.float64) for k in ("bead_positions", "positions", "bead_forces", "forces", "potential") if k in f}
                    out = []
                    for k in range(to - first):
                        energy = float(held["potential"][k]) if "potential" in held else None
                        base = {"run": run, "frame": first + k, "step": first + k, "n_atoms": atoms, "symbols": None, "comment": None, "energy": energy}
                        for b in range(beads):
                            out.append(base | {"track": "bead", "bead": b, "positions": held["bead_positions"][k, b], "forces": held["bead_forces"][k, b] if "bead_forces" in held else None})
                        out.append(base | {"track": "centroid", "bead": None, "positions": held["positions"][k], "forces": held["forces"][k] if "forces" in held else None})
                        if len(out) >= 512:
                            yield _Reader.batch(out)
                            out = []
                    if out:
                        yield _Reader.batch(out)

    return spark.range(0, n, frames_per_task, max(1, -(-n // frames_per_task))).mapInArrow(pull, FRAMES)
