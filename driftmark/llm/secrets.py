"""Secret scans over content-addressed texts, with an incremental ledger.

Every version of a text is a blob, named by the SHA-256 of its content. The
ledger holds the findings of (blob, rule version) pairs; a scan looks only at
pairs that the ledger lacks, and joins the findings back to all paths that
hold the blob. Spans are found by regular expressions in SQL functions alone:
the texts between and inside the matches give the positions.

Long texts: no rule has a loop over groups that can recurse, and lists of
matches are folded ``BLOCK`` at a time, so a text of millions of matches costs
little more than its length.

Edge cases: a null text counts as empty and has no spans; repeated rows and
copies share one blob; a null path is a path like any other; columns other
than path and text are not read (``redacted`` passes them through, whatever
their names). Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm.common import BROADCAST_BYTES, column, columns, free, fresh_path, let, text_of

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Matches folded at a time: appending to a list copies it.
BLOCK = 512
FINDINGS = f"blob string, rule_version string, spans array<{SPAN}>"


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]+ )*+PRIVATE KEY-----"),
    SecretRule("forge_token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("cloud_key", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[SecretRule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _blocks(items: Column, of) -> Column:
    """``of`` each run of ``BLOCK`` items of a list that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: of(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))


def _spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """The rule's spans, in order of their starts."""
    none = F.array().cast(f"array<{SPAN}>")

    def walk(steps: Column) -> Column:
        """How far a run of matches reaches, and its spans, counted from its own start."""
        return F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda acc, s: let(
                acc["at"] + F.length(s["gap"]),
                lambda start: F.struct(
                    (start + F.length(s["hit"])).alias("at"),
                    F.when(
                        F.length(s["value"]) >= rule.least,
                        F.array_append(acc["spans"], F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(s["hit"])).alias("end"), F.lit(rule.kind).alias("kind"))),
                    ).otherwise(acc["spans"]).alias("spans"),
                ),
            ),
        )

    def joined(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + b["at"]))
        shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["kind"].alias("kind"))
        return F.flatten(F.zip_with(blocks, F.slice(begins, F.lit(1), F.size(blocks)), lambda b, by: F.transform(b["spans"], lambda s: shift(s, by))))

    def found(hits: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else hits
        steps = F.slice(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value")), F.lit(1), F.size(hits))
        return F.when(F.size(hits) == 0, none).otherwise(let(steps, lambda s: let(_blocks(s, walk), joined)))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), found)


def spans(text: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """All spans of ``text`` by start, then in the rules' order."""
    return F.sort_array(F.flatten(F.array(*[_spans_of(text, r, i) for i, r in enumerate(rules)])))


def scan(df: DataFrame, path: str = "path", text: str = "text", ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(path, blob, spans) for every row of ``df``.

    ``ledger`` is a folder of findings that later scans reuse; without one the
    scan keeps a ledger of its own in the shared folder. New pairs go in as one
    atomic append, so a scan that dies leaves the ledger as it was.
    """
    spark = df.sparkSession
    t = text_of(df, text)
    rows = df.select(column(df, path).alias("path"), F.sha2(t.cast("binary"), 256).alias("blob"), t.alias("text"))
    found = _findings(rows.select("blob", "text"), spark, ledger, rules)
    out = rows.select("path", "blob").join(found, "blob", "left")
    return out.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _findings(rows: DataFrame, spark: SparkSession, ledger: str | None, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob, spans) of the blobs of ``rows`` (blob, text) that have any, after their unseen ones are in the ledger."""
    version = rule_version(rules)
    known = read_ledger(spark, ledger)
    # copies meet in the partial aggregation, before the shuffle
    blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text"))
    if known is not None:
        blobs = blobs.join(known.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    news = blobs.select("blob", F.lit(version).alias("rule_version"), spans(F.col("text"), rules).alias("spans"))
    ledger = ledger or fresh_path(spark, "ledger")
    news.write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    n, total = found.agg(F.count("*"), F.sum(F.size("spans"))).first()
    found = found.dropDuplicates(["blob"])
    return F.broadcast(found) if 120 * n + 64 * (total or 0) <= BROADCAST_BYTES else found


def redacted(df: DataFrame, text: str = "text", ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``df`` with the secrets of ``text`` cut out, found through the ledger; a null text stays null."""
    t = text_of(df, text)
    blob, held = free(df, "blob", "spans")
    rows = df.select(*columns(df), F.sha2(t.cast("binary"), 256).alias(blob))
    found = _findings(rows.select(F.col(blob).alias("blob"), text_of(rows, text).alias("text")), df.sparkSession, ledger, rules)
    rows = rows.join(found.select(F.col("blob").alias(blob), F.col("spans").alias(held)), blob, "left")
    clean = F.when(F.col(held).isNull(), column(rows, text)).otherwise(redact(text_of(rows, text), F.col(held))).alias(text)
    return rows.select(*[clean if c == text else column(rows, c) for c in df.columns])


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame | None:
    if ledger is None:
        return None
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(ledger)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(FINDINGS).parquet(ledger)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of_base = F.filter("spans", lambda s: s["rank"] < len(base))
    return found.select(
        *[c for c in found.columns if c not in ("blob", "spans")],
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(F.transform(of_base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every union of overlapping spans replaced by ``mark``."""
    piece = "struct<start:int,end:int>"

    def merge(spans: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
            return F.when(F.coalesce(last["end"] >= s["start"], F.lit(False)), F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(
                F.array_append(acc, F.struct(s["start"].alias("start"), s["end"].alias("end")))
            )

        def meet(acc: Column, block: Column) -> Column:
            """A block's pieces lie apart; the first of them may lie within reach of the last piece before."""
            last = F.try_element_at(acc, F.lit(-1))
            within = F.filter(block, lambda p: F.coalesce(p["start"] <= last["end"], F.lit(False)))
            longer = lambda w: F.struct(last["start"].alias("start"), F.greatest(last["end"], F.try_element_at(w, F.lit(-1))["end"]).alias("end"))
            return let(within, lambda w: F.when(F.size(w) == 0, F.concat(acc, block)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(w)), F.slice(block, F.size(w) + 1, F.size(block)))))

        none = F.array().cast(f"array<{piece}>")
        return let(_blocks(spans, lambda run: F.aggregate(run, none, add)), lambda blocks: F.aggregate(blocks, none, meet))

    def rebuild(m: Column) -> Column:
        """The text between the pieces, a block of pieces at a time: finding a place takes time in proportion to what lies before it."""

        def of(run: Column, b: Column) -> Column:
            base = F.coalesce(F.get(m, b * BLOCK - 1)["end"], F.lit(0))

            def heads(base: Column) -> Column:
                part = F.substring(text, base + 1, F.element_at(run, -1)["end"] - base)
                before = lambda i: F.coalesce(F.get(run, i - 1)["end"], base)
                return let(part, lambda x: F.array_join(F.transform(run, lambda s, i: F.concat(F.substring(x, before(i) - base + 1, s["start"] - before(i)), F.lit(mark))), ""))

            return let(base, heads)

        numbers = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int"))
        parts = F.transform(numbers, lambda b: let(F.slice(m, b * BLOCK + 1, F.lit(BLOCK)), lambda run: of(run, b)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.try_element_at(m, F.lit(-1))["end"] + 1, F.length(text)))

    return let(found, lambda spans: F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(merge(spans), rebuild)))
