"""Samples of whole pieces against a plain computation, and what such a sample reads."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from statwarden.functions.hashing import HASH_SPACE
from statwarden.operators import sampling


def name_hash(piece):
    return int(hashlib.md5((piece or "").encode()).hexdigest()[:8], 16)


def uneven_rows():
    rng = random.Random(8)
    rows = [(f"p{rng.randrange(3) if rng.random() < 0.5 else rng.randrange(40)}", rng.choice([None, 1, 1, 2, 3]), rng.choice(["x", "y", None])) for _ in range(3000)]
    return rows + [(None, 2, "y")] * 30


def plain(rows, limit, column):
    """Dominant value of the sampled pieces, its scaled rows and the error of the ratio."""
    sizes = Counter(r[0] for r in rows)
    chosen = [p for p in sizes if name_hash(p) < limit]
    x = sum(sizes[p] for p in chosen)
    per = Counter((r[0], r[column]) for r in rows if r[0] in chosen and r[column] is not None)
    totals = Counter()
    for (_, value), n in per.items():
        totals[value] += n
    if not totals:
        return None
    value = min(totals, key=lambda v: (-totals[v], v))
    share = totals[value] / x
    squares = sum((per[p, value] - share * sizes[p]) ** 2 for p in chosen)
    n, everything = len(chosen), len(sizes)
    error = 0.0 if n == everything else None if n == 1 else len(rows) / (x / n) * math.sqrt((1 - n / everything) / n * squares / (n - 1))
    return value, len(rows) * totals[value] // x, error, x, n


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pieces") / "lake")
    spark.createDataFrame(uneven_rows(), "piece string, n long, t string").repartition("piece").write.partitionBy("piece").parquet(folder)
    return folder


@pytest.mark.parametrize("percent", [0, 30, 100])
def test_estimates_equal_a_plain_computation(spark, lake, percent):
    rows = uneven_rows()
    df = spark.read.parquet(lake)
    pieces = df.groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    limit = sampling.piece_limit(pieces, percent=percent)
    got = {r.column_name: r for r in sampling.dominant_values(sampling.sampled(df, "piece", limit), "t", ["n", "t"], "piece", pieces, limit).collect()}
    assert limit == max(HASH_SPACE * percent // 100, 1 + min(name_hash(r[0]) for r in rows))
    for column, place in (("n", 1), ("t", 2)):
        value, estimate, error, x, n = plain(rows, limit, place)
        r = got[column]
        assert (r.long_value if column == "n" else r.text_value) == value
        assert (r.current_rows, r.dominant_rows, r.rows_sampled, r.sampled_pieces) == (len(rows), estimate, x, n)
        assert r.dominant_error is None if error is None else r.dominant_error == pytest.approx(error, abs=0.002)


def test_only_the_chosen_pieces_are_read(spark, lake, tmp_path):
    """Files of all other pieces are made unreadable."""
    folder = tmp_path / "lake"
    spark.read.parquet(lake).where("piece IS NOT NULL").write.partitionBy("piece").parquet(str(folder))
    df = spark.read.schema("n long, t string, piece string").parquet(str(folder))
    pieces = df.groupBy("piece").agg(F.count(F.lit(1)).alias("rows")).collect()
    pieces = spark.createDataFrame(pieces, "piece string, rows long")
    limit = sampling.piece_limit(pieces, rows=800)
    read = spoiled = 0
    for part in folder.glob("piece=*"):
        size = sum(f.stat().st_size for f in part.glob("*.parquet"))
        if name_hash(part.name.removeprefix("piece=")) < limit:
            read += size
            continue
        for file in part.glob("*.parquet"):
            Path(f"{part}/.{file.name}.crc").unlink(missing_ok=True)
            file.write_bytes(b"no table")
            spoiled += 1
    want = sum(1 for r in uneven_rows() if r[0] is not None and name_hash(r[0]) < limit)
    assert spoiled and read and sampling.sampled(df, "piece", limit).where("n IS NULL OR n >= 0").count() == want
    with pytest.raises(Exception):
        df.where("n IS NULL OR n >= 0").count()


def test_empty_tables_and_unknown_values(spark):
    empty = spark.createDataFrame([], "piece string, n long")
    none = spark.createDataFrame([], "piece string, rows long")
    limit = sampling.piece_limit(none, rows=10)
    assert limit == 0 and sampling.dominant_values(empty, "t", ["n"], "piece", none, limit).count() == 0
    df = spark.createDataFrame([("a", None), ("b", None)], "piece string, n long")
    pieces = spark.createDataFrame([("a", 1), ("b", 1)], "piece string, rows long")
    r = sampling.dominant_values(df, "t", ["n"], "piece", pieces, HASH_SPACE).head()
    assert (r.rows_sampled, r.sampled_values, r.dominant_rows, r.dominant_error) == (2, 0, None, None)
    with pytest.raises(ValueError):
        sampling.piece_limit(pieces)
