"""Best-fit packing of documents into fixed-size bins, under conflicts.

Bins of one shard stand in order of what they have left. A document goes to
the tightest bin that can hold it and that has no conflict with it; each bin
carries a bitmap of the sources (one plane for each allowed repeat) and of the
duplicate clusters it holds, and the search moves on to the next larger
residual until a compatible bin is found or a new one is opened.

Documents are dealt to shards by a hash of their id and rank, so neither a hot
source nor a large cluster lands in one task, and only ids, sizes and keys are
shuffled, never texts. The clusters of documents are the near-duplicate classes
of ``minhash``. The number of shards follows the number of documents;
bins never cross shards.

Edge cases: a document longer than a bin fills whole bins of its own and its
remainder is packed like any other; an empty or null text has size 0 and is
placed too; a null source or cluster conflicts with nothing; repeated rows are
packed each on its own, a null id included. Columns other than those named are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm import minhash
from driftmark.llm.common import column, scope, text_of, written

CAPACITY = 16384
SHARD_ROWS = 2048
SOURCE_LIMIT = 4
SCHEMA = "doc_id long, part int, bin_id string, position int, offset int, size int, bin_size int"


def best_fit(items: list[tuple], capacity: int, source_limit: int = SOURCE_LIMIT) -> list[list[tuple[int, int, int, int]]]:
    """Bins as lists of (item, part, offset, size); ``items`` are (size, source, cluster).

    Sources and clusters are any hashable values or None. Larger items go
    first; ties by their place in the list.
    """
    names: dict[str, dict] = {"s": {}, "c": {}}
    seen: dict = {}
    for _, _, c in items:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    bit = lambda kind, value: 0 if value is None else 1 << names.setdefault(kind, {}).setdefault(value, len(names[kind]))
    bins: list[list[tuple[int, int, int, int]]] = []
    planes: list[list[int]] = []  # source bitmaps by repeat, then the cluster bitmap
    left: dict[int, list[int]] = {}  # residual -> bins, oldest first
    filled = 0  # bit r: some bin has r left

    def put(b: int, residual: int) -> None:
        nonlocal filled
        if residual not in left:
            left[residual] = []
            filled |= 1 << residual
        left[residual].append(b)

    def take(residual: int, at: int) -> int:
        nonlocal filled
        b = left[residual].pop(at)
        if not left[residual]:
            del left[residual]
            filled &= ~(1 << residual)
        return b

    rest: list[tuple[int, int, int]] = []  # size left, item, part
    for i, (size, _, _) in enumerate(items):
        part = 0
        while size > capacity:
            bins.append([(i, part, 0, capacity)])
            planes.append([])
            size, part = size - capacity, part + 1
        rest.append((size, i, part))
    rest.sort(key=lambda x: (-x[0], str(items[x[1]][2]), str(items[x[1]][1]), x[1]))
    last, resume = None, 0
    for size, i, part in rest:
        _, source, cluster = items[i]
        s = bit("s", source)
        c = bit("c", cluster) if cluster is not None and seen[cluster] > 1 else 0
        key = (size, source, cluster)
        # every bin tighter than where this item's twin went has refused the twin
        residual = resume if key == last and c else size
        found = None
        while True:
            above = filled >> residual
            if not above:
                break
            residual += (above & -above).bit_length() - 1
            for at, b in enumerate(left[residual]):
                p = planes[b]
                if not (p[source_limit - 1] & s or p[source_limit] & c):
                    found = take(residual, at)
                    break
            if found is not None:
                break
            residual += 1
        if found is None:
            found = len(bins)
            bins.append([])
            planes.append([0] * (source_limit + 1))
            residual = capacity
        last, resume = key, residual
        p = planes[found]
        p[source_limit] |= c
        for k in range(source_limit):  # the first plane without this source
            if not p[k] & s:
                p[k] |= s
                break
        bins[found].append((i, part, capacity - residual, size))
        put(found, residual - size)
    return bins


def _pack(capacity: int, source_limit: int, limit_rows: int):
    out = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("bin_id", pa.string()), ("position", pa.int32()), ("offset", pa.int32()), ("size", pa.int32()), ("bin_size", pa.int32())])

    def flush(shard: int, block: int, rows: list[tuple]) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in out]
        for n, held in enumerate(best_fit([r[1:] for r in rows], capacity, source_limit)):
            total = sum(x[3] for x in held)
            for place, (i, part, offset, size) in enumerate(held):
                for col, v in zip(cols, (rows[i][0], part, f"{shard}-{block}-{n}", place, offset, size, total), strict=True):
                    col.append(v)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, rows = None, 0, []
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (s != shard or len(rows) >= limit_rows):
                    yield flush(shard, block, rows)
                    block, rows = (block + 1 if s == shard else 0), []
                shard = s
                rows.append(tuple(row))
        if rows:
            yield flush(shard, block, rows)

    return run


def pack(df: DataFrame, doc_id: Column, size: Column, source: Column, cluster: Column, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each placed part: its bin, place, offset and size, and the bin's fill."""
    rows = df.select(doc_id.cast("long").alias("doc_id"), size.cast("long").alias("size"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    n = max(1, -(-rows.select(F.lit(1)).count() // shard_rows))
    # copies of a row have one hash; a salt from the row's place deals them out, and a rerun deals alike
    shard = F.pmod(F.xxhash64("doc_id", "size", "cluster", F.monotonically_increasing_id() % 64), F.lit(n)).cast("int").alias("shard")
    dealt = rows.select(shard, "doc_id", "size", "source", "cluster").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "doc_id", "size", "source", "cluster")
    return dealt.mapInArrow(_pack(capacity, source_limit, 4 * shard_rows), SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents by the bytes of their texts; near duplicates are one cluster, and so are equal texts without words."""
    t = text_of(docs)
    columns = [column(docs, "doc_id").alias("doc_id"), F.octet_length(t).alias("size"), column(docs, "source").alias("source"), F.when(F.length(t) > 0, F.xxhash64(t)).alias("equal")]
    with scope(docs.sparkSession):
        rows = minhash.with_cluster(docs, columns)
        rows = written(rows.select("doc_id", "size", "source", F.coalesce("cluster", "equal").alias("cluster")), "clustered", keep=True)
    return pack(rows, rows["doc_id"], rows["size"], rows["source"], rows["cluster"], capacity)
