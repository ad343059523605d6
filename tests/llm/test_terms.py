import collections
import math

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm.terms import BITS, distinctive, leaf_counts, radix_leaves, term_frequencies, terms, value_form, value_frequencies


def test_terms():
    assert terms("Don't stop_it 3.5v X") == ["don", "t", "stop", "it", "3", "5v", "x"]
    assert terms("新しい文書ABCの・第3章 字") == ["新し", "しい", "い文", "文書", "abc", "の・", "・第", "3", "章", "字"]
    assert terms(None) == terms("") == terms(" -- ") == []


def test_values():
    assert value_form("  Ｈow\tTo  X ") == "how to x" and value_form("   ") is None and value_form(None) is None


def test_radix_leaves_split_where_it_is_full():
    sizes = {0: 500, 1: 10, 4000: 30}
    got = radix_leaves(sizes, 100)
    covered = [r for a, b, _ in got for r in range(a, b + 1)]
    assert covered == list(range(1 << BITS))
    assert (0, 0, 5) in got
    for a, b, parts in got:
        assert sum(sizes.get(r, 0) for r in range(a, b + 1)) <= 100 * parts


def texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "文字", "rare%d" % i, "two%d" % (i // 2)], 8)), "z") for i in range(300)]
    rows += [(1000, None, "z"), (1001, "", "z"), (1002, "long " * 50000, "z"), rows[0], rows[5]]
    return spark.createDataFrame(rows, "chunk_id long, text string, term string"), {r[0]: r[1] for r in rows}


def brute(docs):
    cf, df = collections.Counter(), collections.Counter()
    for t in docs.values():
        cf.update(terms(t))
        df.update(set(terms(t)))
    return cf, df


def test_frequencies_and_bands(spark):
    frame, docs = texts(spark)
    cf, df = brute(docs)
    n = len(docs)
    band = lambda t: "rare" if df[t] == 1 else "common" if df[t] > 0.35 * n else None
    for leaf_bytes in (1 << 27, 300):  # the second cuts nearly every radix
        got = {(r.term, r.cf, r.df, r.band) for r in term_frequencies(frame, "chunk_id", "text", leaf_bytes=leaf_bytes).collect()}
        assert got == {(t, cf[t], df[t], band(t)) for t in cf}
    assert term_frequencies(frame.limit(0), "chunk_id", "text").count() == 0


def test_values_of_records(spark):
    rows = [(1, 10, "A b"), (1, 10, "A b"), (2, 10, "a  B"), (3, 11, "a b "), (4, None, "x"), (5, 12, None), (6, 12, ""), (7, 13, "Ｙ"), (8, 13, "y")]
    df = spark.createDataFrame(rows, "fm_id long, file_id long, value string")
    got = {r.term: (r.cf, r.df, r.band) for r in value_frequencies(df, "fm_id", "file_id", "value", common=0.4).collect()}
    assert got == {"a b": (3, 2, "common"), "x": (1, 0, None), "y": (2, 1, "rare")}


def test_distinctive(spark):
    frame, docs = texts(spark)
    cf, df = brute(docs)
    n = len(docs)
    want = {}
    for i, t in docs.items():
        for term, k in collections.Counter(terms(t)).items():
            want[i, term] = k * (-math.log2(df[term] / n) + math.log2(1 - math.exp(-cf[term] / n)))
    got = {(r.row_id, r.term): r.score for r in distinctive(frame, "chunk_id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = distinctive(frame, "chunk_id", "text", least_tf=3)
    assert {(r.row_id, r.term) for r in few.collect()} == {(i, t) for i, x in docs.items() for t, k in collections.Counter(terms(x)).items() if k >= 3}


def test_score_by_hand(spark):
    df = spark.createDataFrame([(1, "x x x"), (2, "y"), (3, "y"), (4, "")], "chunk_id long, text string")
    # x: idf 2, expected -log2(1 - e^-0.75) = 0.92239, times its three occurrences.
    got = {(r.row_id, r.term): (r.tf, r.cf, r.df, r.score) for r in distinctive(df, "chunk_id", "text").collect()}
    assert got[1, "x"][:3] == (3, 3, 1) and got[1, "x"][3] == pytest.approx(3 * (2 - 0.92239), abs=1e-4)
    assert got[2, "y"][:3] == (1, 2, 2) and got[2, "y"][3] == pytest.approx(1 + math.log2(1 - math.exp(-0.5)))


def test_hot_terms_meet_their_statistics(spark):
    """One term makes up most pairs; every pair keeps its numbers."""
    rows = [(i, f"hot only{i}" if i % 3 else "hot") for i in range(400)]
    got = distinctive(spark.createDataFrame(rows, "chunk_id long, text string"), "chunk_id", "text").collect()
    assert sum(r.term == "hot" for r in got) == 400 and all(r.df == 400 for r in got if r.term == "hot")
    assert sum(r.df == 1 for r in got) == len(got) - 400


def test_a_partition_beyond_the_memory_limit_spills(tmp_path):
    """Counts of half a million long terms within 24 MB: DuckDB must write to the task's folder."""
    n, seen = 500_000, []

    def batches():
        for part in range(10):
            keys = [f"{'term' * 12}{i:08d}" for i in range(part % 5, n, 5)]
            seen.append(sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()))
            ones = pa.array(np.ones(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), ones, ones], names=["term", "cf", "df"])

    total = rows = 0
    for b in leaf_counts(batches(), "24MB", str(tmp_path)):
        rows += b.num_rows
        total += sum(b.column(1).to_pylist())
    assert (rows, total) == (n, 2 * n) and max(seen) > 1_000_000, seen
    assert not list(tmp_path.iterdir())
    with pytest.raises(Exception, match="(?i)memory"):
        list(leaf_counts(batches(), "24MB", ""))
