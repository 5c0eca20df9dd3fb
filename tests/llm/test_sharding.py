"""Sharding: the plan by counts against groups placed one by one, capacities, equal sizes, hot and repeated rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablewright.llm import sharding


def one_by_one(sizes, capacity):
    free, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        if not fits:
            free.append(max(capacity, s))
            fits = [(free[-1], len(free) - 1)]
        own = min(fits)[1]
        free[own] -= s
        out.append((s, own))
    return Counter(out)


def test_counts_are_packed_as_one_by_one():
    r = random.Random(4)
    for _ in range(100):
        sizes = [r.choice((1, 2, 3, 7, 7, 7, 20, 45, 70)) for _ in range(r.randint(0, 80))]
        plan = sharding.pack_counts(Counter(sizes), 50)
        got = Counter()
        for size, a, b, own in plan:
            got[size, own] += b - a
        assert got == one_by_one(sizes, 50)
        bins = len({own for *_, own in plan})
        assert sharding.pack_counts(Counter(sizes), 50, bins) == plan
        assert not bins or sharding.pack_counts(Counter(sizes), 50, bins - 1) is None


def table(spark):
    r = random.Random(9)
    texts = ["x" * r.choice((0, 5, 5, 5, 30, 31, 400)) + str(r.randint(0, 60)) for _ in range(400)]
    texts += [None, "", "é" * 900] + ["hot text " * 5] * 600  # one text holds more than a third of all bytes and rows
    rows = [(i, t, 1, "a") for i, t in enumerate(texts)]
    rows += [(7, "same id and text", 1, "a")] * 200 + [(None, "é" * 900, 1, "a")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, shard int, `slot.key` string").repartition(5)


def loads(got):
    shards, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        shards[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        of_text[x["text_crc32"], x["size"]].add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return shards


def group_sizes(rows):
    out = Counter()
    for _, t, *_ in rows:
        out[t or ""] += len((t or "").encode()) + 1
    return list(out.values())


def test_fixed_capacity(spark):
    rows, docs = table(spark)
    sizes = group_sizes(rows)
    for capacity in (2_000, max(sizes)):
        got = sharding.fixed(docs, capacity, fine=40).collect()  # no size is rounded
        want = Counter()
        for (size, own), n in one_by_one(sizes, capacity).items():
            want[own] += size * n
        assert loads(got) == want
        rounded = loads(sharding.fixed(docs, capacity, fine=3).collect())
        largest = {s for s in sizes if s > capacity}
        assert sum(rounded.values()) == sum(sizes) and all(n <= capacity or n in largest for n in rounded.values())
    assert sharding.fixed(docs.limit(0), 50).count() == 0


def test_near_equal(spark):
    rows, docs = table(spark)
    for fine in (sharding.FINE, 40):
        shards = loads(sharding.assign(docs, 3, fine).collect())
        assert len(shards) == 3 and sum(shards.values()) == sum(group_sizes(rows))
        low = sorted(shards.values())
        assert low[2] == max(group_sizes(rows)) and low[1] - low[0] <= 40  # the hot group has a shard of its own
    equal = spark.createDataFrame([(i, f"{i:04d}") for i in range(80)], "doc_id bigint, text string")
    assert set(loads(sharding.assign(equal, 8).collect()).values()) == {50}


def test_rounding(spark):
    sizes = [1, 2, 3, 2047, 2048, 2049, 4097, 10**6 + 1, 2**40, 2**40 + 1]
    rows = spark.createDataFrame([(s,) for s in sizes], "size bigint").select("size", sharding.rounded(F.col("size")).alias("up"))
    for x in rows.collect():
        assert x["size"] <= x["up"] <= x["size"] * (1 + 2**-10) and (x["size"] >= 2048 or x["up"] == x["size"])
