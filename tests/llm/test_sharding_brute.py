"""Shards and slots worked out again, record by record, from the hashes that the operator draws."""

import bisect
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridtempo.llm import sharding


def worked_out(rows, shards):
    """Places of records (row_key, size, text_key, draw, text_part, row_part): a sorted list of (row_key, shard, slot)."""
    n, total = len(rows), sum(r["size"] for r in rows)
    ranges = max(sharding.LEAST_RANGES, min(sharding.MOST_RANGES, math.ceil(n / sharding.RANGE_ROWS)))
    most = ranges * sharding.SAMPLE_FOR_RANGE
    waits = sorted((-math.log((r["draw"] % 2**52 + 1) / (2**52 + 1)) / r["size"], r["row_key"], r["text_key"]) for r in rows)
    sample = sorted(k for w, _, k in [x for x in waits if x[0] < 3.0 * most / total][:most])
    bounds = sorted({k for i, k in enumerate(sample, 1) if i % sharding.SAMPLE_FOR_RANGE == 0})
    by_range, by_text = defaultdict(list), defaultdict(list)
    for r in rows:
        r["range"] = bisect.bisect_right(bounds, r["text_key"])
        by_range[r["range"]].append(r["size"])
        by_text[r["text_key"]].append(r["size"])
    cells = defaultdict(list)
    for r in rows:
        mine, like = by_range[r["range"]], by_text[r["text_key"]]
        fill = max(sum(mine) * ranges / total, len(mine) * ranges / n)
        parts = math.ceil(fill) if fill > 2 else 1
        large = len(like) * 2 * ranges > n or sum(like) * 2 * ranges > total
        r["part"] = (r["row_part"] if large else r["text_part"]) % parts
        cells[r["range"], r["part"]].append(r)
    out, at, place = [], 0, 0
    for cell in sorted(cells):
        line = sorted(cells[cell], key=lambda r: (r["text_key"], r["row_key"]))
        groups = defaultdict(int)
        for r in line:
            groups[r["text_key"]] += r["size"]
        begun = {}
        for r in line:
            start = begun.setdefault(r["text_key"], at)
            whole = groups[r["text_key"]] * shards <= total * sharding.GROUP_SHARE
            middle = start + groups[r["text_key"]] / 2 if whole else at + r["size"] / 2
            out.append((r["row_key"], min(shards - 1, math.floor(middle * shards / total)), place))
            at, place = at + r["size"], place + 1
    first = {}
    for _, s, p in out:
        first[s] = min(p, first.get(s, p))
    return sorted((k, s, p - first[s]) for k, s, p in out)


def check(docs, shards):
    hashes = {"draw": F.xxhash64("row_key", F.lit("draw")), "text_part": F.xxhash64("text_key", F.lit("part")), "row_part": F.xxhash64("row_key", F.lit("part"))}
    rows = [r.asDict() for r in sharding.records(docs, "doc_id", "text").withColumns(hashes).collect()]
    got = sorted((r.row_key, r.shard, r.slot) for r in sharding.shard(docs, shards).collect())
    assert got == worked_out(rows, shards)


def test_given_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_groups_of_copies_nulls_and_long_texts(spark, shards):
    rows = [(i, "the same text " * 4) for i in range(400)] + [(1000 + i, f"text {i // 2} " * (1 + i % 9)) for i in range(700)]
    rows += [(None, None), (5000, None), (5001, ""), (5002, "word " * 3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), shards)
