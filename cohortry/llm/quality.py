"""Quality rules: thresholds per language and source from mergeable quantile sketches.

A sketch is a table of bucket counts: bucket widths grow with the value, so a quantile is
off by at most a 32nd of itself, and two sketches merge by adding counts. Counts are
reduced before the shuffle, so a source with a third of the rows costs no more than any
other. Sources with few documents use the merged sketch of their language, and languages
with few the one of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import WHITE, fields, forget, keep, map_batches, raw_bytes, scratch

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))

#: Counted in every text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")
#: Metric: integer expression over the counts, what it is a rate of, parts of one it is counted in, and how many
#: single events beyond a group's habits a document of the group's usual size may have.
METRICS = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", "n_words", 1000, 20),
    "duplicates": ("1000 * n_dup_lines div greatest(n_lines, 1)", "n_lines", 1000, 3),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", "n_words", 1000, 40),
    "letters": ("100 * word_chars div greatest(n_words, 1)", "n_words", 100, 150),
    "capitals": ("1000 * n_upper div greatest(word_chars, 1)", "word_chars", 1000, 100),
    "bangs": ("1000 * n_bangs div greatest(n_words, 1)", "n_words", 1000, 20),
}
#: Sizes of documents, sketched like the metrics.
SIZES = ("n_words", "n_lines", "word_chars")
#: Distances from the median, in units of the lower spread (median less 10th percentile), that still pass.
SPREADS = 8
#: Documents a group's or a language's sketch needs to be used by itself; that of all documents always counts.
LEAST_DOCUMENTS = 200
#: Largest threshold table, in rows, that is broadcast; a larger one is joined in salted parts.
BROADCAST_ROWS = 50_000
SALTS = 32


def _repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more."""
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    n = len(ids) - WINDOW + 1
    if n < 2 or len(names) == len(ids):
        return 0
    codes = ids[:n]
    if len(names) <= 4096:
        for k in range(1, WINDOW):
            codes = (codes << 12) | ids[k : k + n]
    else:
        for k in range(1, WINDOW):
            codes = np.unique(codes * len(names) + ids[k : k + n], return_inverse=True)[1]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        inside[at + k] = True
    return int(inside.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """:data:`COUNTS` of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    points = len(text.translate(None, CONTINUATION))
    blank = len(text) - len(text.translate(None, WHITE))
    return (
        len(words),
        points - blank,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!"),
    )


def _counted(batch: pa.RecordBatch) -> list[pa.Array]:
    found = [count_text(x) for x in raw_bytes(batch.column("text"))]
    return [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text; a null text counts nothing."""
    schema = f"{fields(docs, 'doc_id', 'lang', 'source')}, {', '.join(f'{c} long' for c in COUNTS)}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [batch.column(c) for c in ("doc_id", "lang", "source")]
        return pa.RecordBatch.from_arrays([*own, *_counted(batch)], names=["doc_id", "lang", "source", *COUNTS])

    return map_batches(docs.select("doc_id", "lang", "source", "text"), schema, run)


def _bucket(value: Column) -> Column:
    """Bucket number of a whole number: exact below 64, then 32 buckets per doubling."""
    power = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return power * 64 + F.call_function("shiftright", value, power.cast("int"))


def _bucket_top(bucket: Column) -> Column:
    """Largest value of a bucket."""
    power = F.floor(bucket / 64).cast("int")
    return F.call_function("shiftleft", bucket % 64 + 1, power) - 1


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"__{name}")


def sketch(counts: DataFrame) -> DataFrame:
    """(language, source, metric, bucket, n): one sketch per metric and group, of the documents the base rules pass."""
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), _bucket(F.expr(rule[0])).alias("bucket")) for m, rule in METRICS.items()],
        *[F.struct(F.lit(c).alias("metric"), _bucket(F.col(c)).alias("bucket")) for c in SIZES],
    )
    rows = counts.where(~base_failed()).select(_group("lang"), _group("source"), F.explode(values).alias("v"))
    return rows.groupBy("__lang", "__source", "v.metric", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(merged: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Upper threshold per group and metric, from ``least`` documents on.

    The median, plus SPREADS times its distance to the 10th percentile, plus what a metric's
    allowed events make in a document of the group's median size: where most documents have
    none, what is one too many depends on how long they are.
    """
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.select(
        *keys,
        "metric",
        _bucket_top(F.col("bucket")).alias("top"),
        F.sum("n").over(by).alias("total"),
        F.sum("n").over(by.orderBy("bucket")).alias("below"),
    )

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("below") * 100 >= F.col("total") * percent, F.col("top")))

    found = ranked.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"), quantile(50).alias("mid"), quantile(10).alias("low")
    )
    # One entry per metric and size.
    entries = F.collect_list(F.struct("metric", F.struct("total", "mid", "low").alias("s")))
    known = found.groupBy(*keys).agg(F.map_from_entries(entries).alias("q"))

    def fence(metric: str) -> Column:
        _, size, parts, events = METRICS[metric]
        q, usual = F.col("q")[metric], F.greatest(F.col("q")[size]["mid"], F.lit(1))
        room = F.floor(F.lit(parts * events) / usual).cast("long")
        return F.when(q["total"] >= least, q["mid"] + SPREADS * (q["mid"] - q["low"]) + room)

    fences = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), fence(m).alias("fence")) for m in METRICS]))
    return known.select(*keys, fences.alias("f")).select(*keys, "f.metric", "f.fence")


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per language and source with a threshold per metric, from the sketches merged upwards."""

    def merged(*keys: str) -> DataFrame:
        rows = sketches.select(*keys, "metric", "bucket", "n") if keys else sketches.select("metric", "bucket", "n")
        return rows.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))

    own = _fences(merged("__lang", "__source"), ["__lang", "__source"], LEAST_DOCUMENTS)
    language = _fences(merged("__lang"), ["__lang"], LEAST_DOCUMENTS).withColumnRenamed("fence", "lang_fence")
    overall = _fences(merged(), [], 1).withColumnRenamed("fence", "all_fence")
    found = own.join(language, ["__lang", "metric"], "left").join(F.broadcast(overall), "metric", "left")
    fence = F.coalesce("fence", "lang_fence", "all_fence")
    return found.groupBy("__lang", "__source").agg(
        *[F.max(F.when(F.col("metric") == m, fence)).alias(f"__max_{m}") for m in METRICS]
    )


def _with_thresholds(rows: DataFrame, limits: DataFrame, salt: str) -> DataFrame:
    """Join thresholds to rows: broadcast when the stored table is known to be small, else in salted parts."""
    rows = rows.withColumns({"__lang": _group("lang"), "__source": _group("source")})
    if limits.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(limits), ["__lang", "__source"], "left")
    part = F.pmod(F.xxhash64(salt), F.lit(SALTS))
    spread = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("__salt", part).join(spread, ["__lang", "__source", "__salt"], "left").drop("__salt")


def passes() -> Column:
    """Whether a row with counts and thresholds breaks no rule; a group without thresholds has none to break."""
    within = [F.coalesce(F.expr(e) <= F.col(f"__max_{m}"), F.lit(True)) for m, (e, *_) in METRICS.items()]
    ok = ~base_failed()
    for rule in within:
        ok = ok & rule
    return ok


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document: doc_id, lang, source, the counts, base_failed and kept.

    Null or empty text: no words, so it fails the base rule. Null language or source: one
    group with the empty name. Repeated rows are judged each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    at = scratch(spark, "quality")
    counts = keep(text_counts(docs), f"{at}/counts")
    limits = keep(thresholds(sketch(counts)), f"{at}/limits")
    judged = _with_thresholds(counts, limits, "doc_id")
    return judged.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), passes().alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with all their columns.

    Thresholds come from a first pass; the second counts again instead of shuffling texts
    to join verdicts to them.
    """
    spark = docs.sparkSession
    at = scratch(spark, "quality")
    counts = keep(text_counts(docs), f"{at}/counts")
    limits = keep(thresholds(sketch(counts)), f"{at}/limits")
    forget(spark, f"{at}/counts")
    columns, own = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    where = {c.lower(): i for i, c in reversed(list(enumerate(columns)))}
    text = own[where["text"]]
    plain = docs.toDF(*own)
    schema = f"{fields(plain, *own)}, {', '.join(f'{c} long' for c in COUNTS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_text(x) for x in raw_bytes(batch.column(text))]
            more = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*own, *COUNTS])

    counted = plain.mapInArrow(run, schema)
    counted = counted.withColumns({"lang": F.col(own[where["lang"]]), "source": F.col(own[where["source"]])})
    kept = _with_thresholds(counted, limits, own[where["doc_id"]]).where(passes())
    return kept.select(*own).toDF(*columns)
