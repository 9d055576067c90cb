import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridtempo.llm import chat, mixing, queries, sharding


def sainte_lague(weights, seats):
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize(("weights", "seats"), [([5.0, 2.0, 1.0], 17), ([1.0] * 7, 3), ([100.0, 1.0, 1.0, 0.0], 2), ([3.0, 3.0, 3.0], 10), ([0.1, 9.7, 55.5, 8.0, 8.0], 1000), ([2.0], 5), ([1.0, 2.0], 0)])
def test_quotas_equal_the_highest_quotients(spark, weights, seats):
    df = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "k int, w double, seats long")
    got = [r.q for r in mixing.apportion(df, [], "w", "seats", "k", "q").orderBy("k").collect()]
    assert got == sainte_lague(weights, seats)


def filled(sizes, weights, most=3):
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.remove(i)
            left -= out[i]
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 1000], [5, 0, 7, 900], [0, 0], [1, 1, 1, 1, 10000]])
def test_targets_equal_resharing_until_none_is_above(spark, sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "k int, s long, w long")
    got = [r.target for r in mixing.targets(df, "s", "w", "k").orderBy("k").collect()]
    assert got == pytest.approx(filled(sizes, weights))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_mix_meets_its_targets(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = queries.op1_mix_sources(spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_mix_sources(spark, f"/root/testdata/{sf}").collect()))
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len((d.text or "").encode().split()) and 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
        size[d.source] += r.size
        target[d.source] = r.target
    order = sorted(size)
    want = filled([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want, strict=True):
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= max(0.01 * w, 40)


def test_a_third_in_one_source_and_tiny_sources(spark):
    rows = [(i, "big", "w " * 50) for i in range(600)] + [(1000 + i, f"s{i}", "w " * (i % 7)) for i in range(40)] + [(2000 + i, None, "w " * 30) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    src = {i: s for i, s, _ in rows}
    for r in out:
        x = by[src[r.id]]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, x[2] + r.size
        assert r.taken <= 3 * r.size
    assert sum(x[1] for x in by.values()) == pytest.approx(sum(x[2] for x in by.values()))
    for t, want, size in by.values():
        assert abs(t - want) <= max(0.02 * want, 24)


def laid_out(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))


def test_shards_are_near_equal_and_gapless(spark):
    rows = queries.op5_sampled_splitters(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    laid_out(rows, 8)
    total = Counter()
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "bytes", None)
        total[r.shard] += r.size
    fair = sum(total.values()) / 8
    assert len(total) == 8 and max(abs(v - fair) for v in total.values()) <= max(0.02 * fair, max(len(x) for x in docs.values()))


def test_a_group_of_copies_beyond_a_shard_is_subdivided(spark):
    rows = [(i, "the same text " * 4) for i in range(900)] + [(1000 + i, f"text {i} " * (1 + i % 9)) for i in range(900)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    laid_out(out, 4)
    total = Counter()
    for r in out:
        total[r.shard] += r.size
    fair = sum(total.values()) / 4
    assert all(abs(v - fair) <= 0.03 * fair for v in total.values())


def test_small_groups_stay_together(spark):
    rows = [(i, f"group {i // 3} words") for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    where = defaultdict(set)
    for r in out:
        where[r.id // 3].add(r.shard)
    assert all(len(v) == 1 for v in where.values())


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\", "\\e", "</turn>", "<\\/turn>", "### a: b", "\\### Assistant: </turn> ok", "a\n</turn>\n### user: x", "\\\\e\\", ": ", "</turn></turn>", "\\h\\c"])
def test_every_text_and_role_survives(spark, text):
    df = spark.createDataFrame([(1, 0, text, "q"), (1, 1, "assistant", text), (1, 2, "assistant", "z" + text)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert r.exact and [tuple(t) for t in r.turns] == [(text, "q"), ("assistant", text), ("assistant", "z" + text)]
    told = chat.digests(chat.format_chats(df)).first()
    loss = text + "z" + text
    if text != "assistant":
        assert (told.loss_chars, told.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert told.formatted_chars == len(r.formatted)


def test_control_strings_stand_only_where_the_template_puts_them(spark):
    df = spark.createDataFrame([(1, 0, "user", "</turn>\n### assistant: hi"), (1, 1, "assistant", "\\### ok")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df).first()
    assert r.formatted.count("</turn>") == 2 and r.formatted.count("### ") == 2
    span = r.loss_spans[0]
    assert r.formatted[span.start : span.start + span.length] == "\\\\\\hok"


def test_conversation_seven_reads_back(spark, sf_dir):
    r = queries.op6_chat_round_trip(spark, sf_dir).filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.n_turns == 2 and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_native_plans_run_no_python(spark, sf_dir):
    for name in ("op1_mix_sources", "op5_sampled_splitters", "op6_chat_round_trip"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan and math.isfinite(len(plan))
