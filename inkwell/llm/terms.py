"""Frequency of every term or value (problem 4) and how distinctive it is (problem 5).

Problem 4, method: recursive radix spilling. Records are counted where they are read, so
what leaves a task has each term once for every batch, however hot it is. These partial
counts go to disk (in the shared folder) with twelve bits of the term's hash. From the bytes
of the 4,096 radix ranges the partitions follow: a range of a few leading bits stays whole
if it is small, else it is split by the next bit, and so on, beyond twelve bits by further
ones, until a partition has at most `leaf_bytes`, which fit into memory. DuckDB then
aggregates each partition on its own, within a memory limit, in one task; what it writes
beyond that limit goes to a folder of that task alone, which it deletes.

Problem 5, method: residual inverse document frequency. Of N records df hold a term that
occurs cf times in all; were it strewn at random (Poisson), N * (1 - exp(-cf / N)) records
would. The observed value -log2(df / N) less the expected one, times the term's occurrences
in the record, is its score: terms concentrated in few records score high, common ones and
evenly spread ones near nothing. Texts are read and cut into terms once: the same pass
gives the counts of a batch for the statistics and the (record, term) pairs to be scored.
"Multiplied by record frequency" is read as: times the term's occurrences in this record.

A term is a maximal run of letters and digits in lower case; CJK characters (five ranges)
form runs of their own, which give their overlapping pairs, or the character if alone.

Defined results: null and empty texts have no terms but count as records; a term of any
length is a term; rows that are exact copies (same id) count once; a value without record
(null file) has occurrences but no records; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.sources.tables import once, shared_dir

#: CJK ranges whose characters are paired (fixed values).
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ"
RUN = re.compile(f"([{CJK}]+)|[^\\W_{CJK}]+")
BITS, FIRST_BITS, LEAF_BYTES = 12, 3, 128 << 20
#: Bytes of a row of counts besides its term.
ROW_BYTES = 32
#: A term is hot if more than one of so many pairs have it; so at most so many are.
HOT_SHARE = 256
COUNTS = "term string, cf bigint, df bigint"


def terms(text: str | None) -> list[str]:
    """The terms of a text in order, with repetitions."""
    out = []
    for m in RUN.finditer(text.lower() if text else ""):
        run = m.group()
        if m.group(1) is None or len(run) == 1:
            out.append(run)
        else:
            out.extend(map("".join, zip(run, run[1:])))
    return out


def value_form(value: str | None) -> str | None:
    """A value in the form in which equal values are equal; None for no value."""
    return " ".join(unicodedata.normalize("NFKC", value).split()).lower() or None if value is not None else None


def counted(texts: list[str | None]) -> tuple[Counter, Counter]:
    """Occurrences and records of every term of some records."""
    cf: Counter = Counter()
    df: Counter = Counter()
    for text in texts:
        own = terms(text)
        cf.update(own)
        df.update(set(own))
    return cf, df


def partial_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(term, cf, df) of batches of records, one row a record: each term once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cf, df = counted(batch.column(0).to_pylist())
            if cf:
                keys = list(cf)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([cf[k] for k in keys], pa.int64()), pa.array([df[k] for k in keys], pa.int64())], names=["term", "cf", "df"])

    return texts.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).mapInArrow(run, COUNTS)


def radix_leaves(sizes: dict[int, int], leaf_bytes: int = LEAF_BYTES) -> list[tuple[int, int, int]]:
    """(first radix, last radix, parts) of the partitions: ranges of leading bits that hold at
    most leaf_bytes, split bit by bit; a full radix that holds more is cut in `parts`."""
    out = []

    def split(first: int, bits: int) -> None:
        width = 1 << (BITS - bits)
        n = sum(sizes.get(r, 0) for r in range(first, first + width))
        if bits >= FIRST_BITS and (n <= leaf_bytes or bits == BITS):
            out.append((first, first + width - 1, max(1, -(-n // leaf_bytes))))
        else:
            split(first, bits + 1)
            split(first + width // 2, bits + 1)

    split(0, 0)
    return out


def leaf_counts(batches: Iterator[pa.RecordBatch], memory: str, scratch: str) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of one partition, by DuckDB within `memory`. scratch: a folder below
    which this task makes its own for what DuckDB spills; "" where the shared folder is no
    path (then partitions are small enough not to need it)."""
    import os
    import shutil
    import uuid

    import duckdb

    own = os.path.join(scratch, uuid.uuid4().hex) if scratch else ""
    con = duckdb.connect()
    try:
        con.execute("set threads = 1")
        con.execute("set preserve_insertion_order = false")
        con.execute(f"set memory_limit = '{memory}'")
        con.execute(f"set temp_directory = '{own}'")
        con.execute("create table counts (term varchar, cf bigint, df bigint)")
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                arrived = pa.Table.from_batches([batch])  # noqa: F841 - read by name below
                con.execute("insert into counts select term, cf, df from arrived")
        if seen:
            for out in con.sql("select term, sum(cf)::bigint as cf, sum(df)::bigint as df from counts group by term").to_arrow_reader(50_000):
                yield out.cast(pa.schema([("term", pa.string()), ("cf", pa.int64()), ("df", pa.int64())]))
    finally:
        con.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


def frequencies(partial: DataFrame, leaf_bytes: int = LEAF_BYTES, memory: str = "400MB") -> DataFrame:
    """(term, cf, df): sums of partial counts, each term once."""
    spark = partial.sparkSession
    folder = shared_dir(spark)
    h = F.xxhash64("term")
    radix = F.shiftrightunsigned(h, 64 - BITS).cast("int")
    partial.select("term", "cf", "df", radix.alias("radix")).write.parquet(f"{folder}/partial")
    spilled = spark.read.schema("term string, cf bigint, df bigint, radix int").parquet(f"{folder}/partial")
    sizes = {r.radix: r.n for r in spilled.groupBy("radix").agg(F.sum(F.octet_length("term") + F.lit(ROW_BYTES)).alias("n")).collect()}  # at most 4,096 rows
    rows, part = [], 0
    for first, last, parts in radix_leaves(sizes, leaf_bytes):
        rows += [(r, part, parts) for r in range(first, last + 1)]
        part += parts
    places = spark.createDataFrame(rows, "radix int, place int, parts int")  # 4,096 rows
    placed = spilled.join(F.broadcast(places), "radix").select("term", "cf", "df", (F.col("place") + F.pmod(h, F.col("parts").cast("bigint"))).cast("int").alias("part"))
    scratch = folder.removeprefix("file://") + "/duckdb" if folder.startswith(("file:/", "/")) else ""
    return placed.repartitionById(part, F.col("part")).select("term", "cf", "df").mapInArrow(lambda batches: leaf_counts(batches, memory, scratch), COUNTS)


def banded(counts: DataFrame, total: int, common: float) -> DataFrame:
    """Adds `band`: rare (one record), common (more than the share of all records), else null."""
    band = F.when(F.col("df") == 1, "rare").when(F.col("df") > F.lit(common) * F.lit(total), "common")
    return counts.withColumn("band", band)


def term_frequencies(records: DataFrame, id_col: str, text_col: str, common: float = 0.35, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(term, cf, df, band) over the texts of all records."""
    single = once(records.select(id_col, text_col), id_col)
    total = records.select(id_col).where(F.col(id_col).isNotNull()).distinct().count() + records.where(F.col(id_col).isNull()).count()
    return banded(frequencies(partial_counts(single, text_col), leaf_bytes), total, common)


def value_frequencies(rows: DataFrame, id_col: str, record_col: str, value_col: str, common: float = 0.10, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(term, cf, df, band) of whole values; a record may have several rows with a value."""
    single = once(rows.select(id_col, record_col, value_col), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(zip(map(value_form, batch.column(1).to_pylist()), batch.column(0).to_pylist()))
            some = [(v, r, k) for (v, r), k in n.items() if v is not None]
            if some:
                v, r, k = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(r, pa.int64()), pa.array(k, pa.int64())], names=["term", "record", "n"])

    pairs = single.select(F.col(record_col).cast("bigint"), F.col(value_col).cast("string")).where(F.col(value_col).isNotNull()).mapInArrow(run, "term string, record bigint, n bigint")
    # A value and a record may meet in several batches: their pairs are made one first.
    pairs = pairs.groupBy("term", "record").agg(F.sum("n").alias("cf")).select("term", "cf", F.col("record").isNotNull().cast("bigint").alias("df"))
    total = rows.where(F.col(record_col).isNotNull()).select(record_col).distinct().count()
    return banded(frequencies(pairs, leaf_bytes), total, common)


def residual_idf(cf: Column, df: Column, total: int) -> Column:
    n = F.lit(float(total))
    return -F.log2(df / n) + F.log2(1 - F.exp(-cf / n))


def distinctive(records: DataFrame, id_col: str, text_col: str, least_tf: int = 1, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(row_id, term, tf, cf, df, score) of every record and term that occurs there at least
    least_tf times. Hot terms (of which there are fewer than HOT_SHARE, as df counts pairs)
    meet their statistics by broadcast and are not shuffled."""
    spark, folder = records.sparkSession, shared_dir(records.sparkSession)
    single = once(records.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text")).where(F.col(id_col).isNotNull()), "row_id")
    total = records.select(id_col).where(F.col(id_col).isNotNull()).distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cf: Counter = Counter()
            df: Counter = Counter()
            ids, words, counts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(terms(text))
                cf.update(own)
                df.update(own.keys())
                some = [(t, n) for t, n in own.items() if n >= least_tf] if least_tf > 1 else own.items()
                ids += [i] * len(some)
                words += [t for t, _ in some]
                counts += [n for _, n in some]
            keys = list(cf)
            ids = pa.array(ids + [None] * len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words + keys, pa.string()), pa.array(counts + [cf[k] for k in keys], pa.int64()), pa.array([0] * len(words) + [df[k] for k in keys], pa.int64())],
                names=["row_id", "term", "tf", "df"],
            )

    # Pairs have a row_id; counts of a batch have none. Two folders of one written table.
    shape = "row_id bigint, term string, tf bigint, df bigint"
    single.where("text is not null").mapInArrow(run, shape).withColumn("pair", F.col("row_id").isNotNull()).write.partitionBy("pair").parquet(f"{folder}/terms")
    laid = spark.read.schema(shape + ", pair boolean").parquet(f"{folder}/terms")
    frequencies(laid.where("not pair").select("term", F.col("tf").alias("cf"), "df"), leaf_bytes).write.parquet(f"{folder}/statistics")
    stats = spark.read.schema(COUNTS).parquet(f"{folder}/statistics")
    pairs = laid.where("pair").select("row_id", "term", "tf")
    all_pairs = stats.agg(F.sum("df")).first()[0] or 0
    is_hot = F.col("df") * HOT_SHARE > F.lit(all_pairs)
    hot = F.broadcast(stats.where(is_hot))
    joined = pairs.join(hot, "term").unionByName(pairs.join(hot.select("term"), "term", "left_anti").join(stats.where(~is_hot), "term"))
    return joined.select("row_id", "term", "tf", "cf", "df", (F.col("tf") * residual_idf(F.col("cf"), F.col("df"), total)).alias("score"))
