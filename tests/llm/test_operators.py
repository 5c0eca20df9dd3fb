"""Operators against brute force on a small fixture with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import (bpe_trie, decontaminate, jaccard_join, line_dedup, quality_rules, sharding, substring_dedup,
                             token_counts)

SPACE = r"[\x20\x09-\x0D]"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n_words int, `set_id` string, `kept.text` string, gone int"


def _texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    long_line = prose(12)
    texts = [None, "", " \t\n", "one", "x y z"]
    base = [prose(r.randint(20, 120)) for _ in range(12)]
    texts += base + [base[0], base[1]]  # exact copies
    for b in base[:6]:  # near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [prose(10) + " " + passage + "\n" + prose(10) for _ in range(8)]
    texts += [prose(5) + "\n" + long_line + "\n" + prose(9), long_line.replace(" ", "  ") + "\nshort\nshort",
              " ".join(long_line.split()[:-1]), long_line + " more", "short\n" + " ".join(["swap", *long_line.split()[1:]])]
    texts += ["na " * 400, "### %%% " * 60, prose(6000), "İΣ ΑΣ. it's 12<|endoftext|> \x1c x\x85y  z "]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(None if i == 7 else i, t, 1, "s", "k", 2) for i, t in enumerate(texts)]
    return out + [out[20], out[-1], out[0]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(found):
    return Counter(tuple(r) for r in found)


def order(i):
    return 2**63 - 1 if i is None else i


def test_quality_rules(docs, rows, empty):
    want = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p + j for p, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        want.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)))
    ledger = quality_rules.ledger(docs)
    got = ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert multiset(got) == Counter(want)
    assert quality_rules.ledger(empty).count() == 0
    # ablations by bits equal verdicts without the rule
    table = {r["rule"]: r for r in quality_rules.ablations(ledger, quality_rules.STANDARD).collect()}
    for rule in quality_rules.RULES:
        rest = quality_rules.Policy("x", tuple(r.name for r in quality_rules.RULES if r is not rule))
        assert table[rule.name]["n_kept_without"] == ledger.where(quality_rules.passes(rest)).count()
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == ledger.where(quality_rules.passes(quality_rules.STANDARD)).count()


def test_bpe_and_counts(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert multiset(bpe_trie.digests(docs, path).collect()) == Counter(want)
    assert bpe_trie.digests(empty, path).count() == 0
    encoded = bpe_trie.encode(docs, path)
    assert multiset(bpe_trie.decode(encoded, path).select("doc_id", F.sha2("text", 256)).collect()) == Counter((i, h) for i, _, _, h in want)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x, *_ in rows]
    assert multiset(token_counts.token_counts(docs, path).collect()) == Counter(want)


def test_encoders_fuzz():
    r = random.Random(1)
    letters = "aabbeeoott  \n\t'sSΣσİßéÉ́𝒳漢字ab12٣!?.,#<|endoftext|>\x1c\x85\xa0 ſK"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["aaaaaaa", "lololololo", "<|endoftext|> <|endoftext|>a "]
    word, byte = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    encoder = bpe_trie.Encoder(open(public_tokenizers.path("word_bpe_49k.json")).read(), remember=100)
    counter = token_counts.TokenCounter(open(public_tokenizers.path("byte_bpe_50k.json")).read(), remember=100)
    for part in token_counts.slices(texts, 5000):
        assert [[int(i) for i in ids.split()] for ids, _ in encoder.encode(part)] == [word.encode(x, add_special_tokens=False).ids for x in part]
        assert counter.counts(part) == [len(byte.encode(x, add_special_tokens=False).ids) for x in part]


def test_substring_dedup(docs, rows, empty):
    k = 13
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t, *_ in rows]
    for i, w in split:
        for p in range(len(w) - k + 1):
            s = tuple(w[p:p + k])
            first[s] = min(first.get(s, order(i)), order(i))
    want = []
    for i, w in split:
        gone = {p + j for p in range(len(w) - k + 1) if first[tuple(w[p:p + k])] < order(i) for j in range(k)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert multiset(substring_dedup.substring_dedup(docs, k).collect()) == Counter(want)
    assert any(n for _, _, n, _ in want)
    assert substring_dedup.substring_dedup(empty, k).count() == 0
    spans = substring_dedup.repeated_spans(docs, k).collect()
    text = {(order(i), hash(t)): w for (i, t, *_), (_, w) in zip(rows, split)}
    by_id = defaultdict(list)
    for (i, _), w in text.items():
        by_id[i].append(w)
    for s in spans:  # source coordinates hold the same words
        n = s["n"] + k - 1
        assert any(a[s["start"]:s["start"] + n] == b[s["src_start"]:s["src_start"] + n] and len(a) >= s["start"] + n
                   for a in by_id[s["id"]] for b in by_id[s["src_id"]])


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs, 3, fine=16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.assign(empty, 3).count() == 0


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(50):
        sizes = {i: r.randint(1, 40) for i in range(r.randint(1, 60))}
        bins, placed = [], {}
        for i, s in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            fits = [(free, b) for b, free in enumerate(bins) if free >= s]
            if not fits:
                bins.append(50)
                fits = [(50, len(bins) - 1)]
            bins[min(fits)[1]] -= s
            placed[i] = min(fits)[1]
        assert sharding.pack(sizes, 50) == placed


def _edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    q = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + q >= max(len(a), len(b)) - 1


def test_line_dedup(docs, rows, empty):
    lines = {(order(i), t, n): line for i, t, *_ in rows for n, line in enumerate((t or "").split("\n")) if WORDS.search(line)}
    first = {}
    for place in sorted(lines, key=lambda p: (p[0], p[2])):
        first.setdefault(lines[place], place)
    gone = set()
    for place, line in lines.items():
        w = WORDS.findall(line)
        for other, at in first.items():
            v = WORDS.findall(other)
            if (at[0], at[2]) < (place[0], place[2]) and (other == line or min(len(w), len(v)) >= 8 and _edit_at_most_one(w, v)):
                gone.add(place)
    want = Counter()
    for i, t, *_ in rows:
        text = (t or "").split("\n")
        keep = [x for n, x in enumerate(text) if (order(i), t, n) not in gone]
        want[i, sum(bool(WORDS.search(x)) for x in text), len(text) - len(keep), "\n".join(keep)] += 1
    assert multiset(line_dedup.line_counts(docs).collect()) == want and len(gone) > 5
    assert line_dedup.line_counts(empty).count() == 0
    kept = line_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r["text"] for r in kept.collect() if r["text"] is not None) == Counter(t for _, _, _, t in want.elements()) - Counter([""] * 2)


def test_jaccard_join(docs, rows, empty):
    def shingles(t):
        w = WORDS.findall(t or "")
        return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    rep = {}
    for i, s in sets:
        rep[s] = min(rep.get(s, order(i)), order(i))
    want = Counter()
    for i, s in sets:
        links = sorted(rep[o] for o in rep if s and o and o != s and len(s & o) / len(s | o) >= 0.8)
        want[i, len(links)] += 1
    got = jaccard_join.join_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want and any(n for _, n in want)
    for r in got:
        s = next(s for i, s in sets if i == r["doc_id"])
        assert order(r["class_id"]) == (rep[s] if s else order(r["doc_id"]))
    assert jaccard_join.join_documents(empty).count() == 0
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r["doc_id"] for r in got if r["group_id"] == r["doc_id"]} and {0, 1, 2} <= ids


def test_jaccard_groups_and_links_by_brute_force(spark):
    """Chains of near copies with exact copies and repeated rows: links, their counts and groups; output linear in the copies."""
    r = random.Random(12)
    texts = []
    for c in range(4):
        w = [f"{c}.{i}" for i in range(90)]
        for _ in range(12):
            w = list(w)
            w[r.randrange(90)] = f"n{r.random()}"
            texts.append(" ".join(w))
    texts += [texts[5]] * 40 + [texts[30]] * 40 + ["other words that stand alone in this table"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    reps = sorted(first.values())
    want = {(b, a) for a in reps for b in reps if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    group = {a: a for a in reps}
    for _ in reps:
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    degree = Counter(x for pair in want for x in pair)
    got = jaccard_join.join_documents(docs).collect()
    assert Counter(tuple(x) for x in got) == Counter((i, first[sets[i]], degree[first[sets[i]]], group[first[sets[i]]]) for i, _ in rows)
    links = jaccard_join.join(docs, pairs=True).links().collect()
    assert sorted((min(x["id_a"], x["id_b"]), max(x["id_a"], x["id_b"])) for x in links) == sorted(want) and len(want) > 40
    with pytest.raises(ValueError):
        jaccard_join.join(docs).links()


def test_large_buckets_lose_no_link(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(1):
            w[r.randrange(120)] = f"c{r.random()}"
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) for w in texts]
    want = {(a, b) for a in range(60) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    links = jaccard_join.join(docs, bucket=8, pairs=True).links().collect()
    got = {(max(x["id_a"], x["id_b"]), min(x["id_a"], x["id_b"])) for x in links}
    assert len(got) == len(links) and got <= want and len(got) >= 0.99 * len(want) > 500


def test_decontaminate(spark, docs, empty):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(r.randint(2, 7)))
    items = [[word() for _ in range(n)] for n in (20, 40, 60, 150)]
    def other(w, every):
        return [word() if i % every == 3 else x for i, x in enumerate(w)]
    plain = [" ".join(word() for _ in range(300)) for _ in range(30)]
    held = [(100, items[0]), (101, items[1]), (102, items[2]), (103, items[3]), (104, other(items[1], 10)), (105, items[1][::-1])]
    texts = [(i, t) for i, t in enumerate(plain)] + [(i, plain[0][:400] + " " + " ".join(w) + ". " + plain[1][:400]) for i, w in held]
    table = spark.createDataFrame([*texts, (None, None), (31, ""), texts[-2]], "doc_id bigint, text string").withColumn("cosine", F.lit(1))
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (9, None), (10, "too short")], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table, bench).collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (103, 3), (104, 1)}
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns and clean.count() == table.count() - 6
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(table, bench.limit(0)).count() == 0


def test_decontaminate_many_short_items(spark):
    """Whole items of 15 to 20 words inside other text, with far more items than the basis has directions."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(r.randint(2, 3)))  # noqa: E731  few words, so passages are alike
    items = [" ".join(word() for _ in range(r.randint(15, 20))) for _ in range(1500)]
    prose = lambda n: " ".join(word() for _ in range(n))
    table = spark.createDataFrame([(i, f"{prose(r.randint(40, 90))} {items[i * 7]} {prose(80)}") for i in range(200)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table, bench).collect()}
    assert got == {(i, i * 7) for i in range(200)}


def test_decontaminate_paraphrases(spark):
    """Evenly replaced words, the last one among them: an item without an answer is judged by the LCS alone."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(r.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(40) for _ in range(30)]
    def other(w, n):  # the last quarter loses its share, too
        gone = {len(w) - 1 - i * len(w) // n for i in range(n)}
        return [word() if i in gone else x for i, x in enumerate(w)]
    rows = [(i, " ".join(prose(50) + other(w, n) + prose(50))) for i, (w, n) in enumerate(zip(items, [10] * 10 + [14] * 10 + [24] * 10))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [(i, " ".join(w)) for i, w in enumerate(items)]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table, spark.createDataFrame(texts, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(20)}  # 25 and 35 % replaced; not 60 %
    # a stated answer decides: missing in the copies but the first, whose answer stands in it
    answers = [(i, t, rows[0][1].split()[60] if not i else "zzz yyy") for i, t in texts]
    bench = spark.createDataFrame(answers, "item_id bigint, text string, answer string")
    assert {(x["doc_id"], x["answer_found"]) for x in decontaminate.leaks(table, bench).collect()} == {(0, True)}


def test_decontaminate_by_brute_force(spark):
    """Every document and item by the longest common subsequence around every word; copies from whole to a third replaced."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("ghijklmnop") for _ in range(r.randint(2, 4)))
    items = [[word() for _ in range(r.randint(8, 60))] for _ in range(120)]
    other = lambda w, share: [word() if r.random() < share else x for x in w]
    texts = [[word() for _ in range(r.randint(0, 150))] + other(items[k % 120], r.choice((0, 0.1, 0.2, 0.3, 0.4))) + [word() for _ in range(90)]
             for k in range(60)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): x["lcs_share"] for x in decontaminate.leaks(table, bench).collect()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        return row[-1]

    want = {}
    for i, w in enumerate(texts):
        for k, item in enumerate(items):
            if sum(x in set(w) for x in item) >= 0.65 * len(item):
                share = max(lcs(item, w[max(0, m - 64):m + 64]) for m in range(0, len(w) + 16, 16)) / len(item)
                if share >= 0.65:
                    want[i, k] = share
    assert set(got) <= set(want) and all(got[p] <= want[p] for p in got)
    assert len(got) >= 0.95 * len(want) >= 30


def test_decontaminate_equal_documents_and_short_items(spark):
    """Copies of one text give every term the weight of a word of all documents; short items are looked up word for word."""
    r = random.Random(8)
    w = ["".join(r.choice("ghijklmnop") for _ in range(r.randint(4, 7))) for _ in range(200)]
    text = " ".join(w[:100]) + ". " + " ".join(w[100:])
    items = [w[30:60], w[70:75], w[80:82], w[90:91], w[120:123] + w[124:127], ["absent"], w[20:50][::-1], w[95:103],
             [x for i, x in enumerate(w[150:190]) if i % 3]]  # in the last one no three words in a row are left
    bench = spark.createDataFrame([(i, " ".join(x).capitalize() + "!") for i, x in enumerate(items)], "item_id bigint, text string")
    for n in (1, 3):
        table = spark.createDataFrame([(i, text) for i in range(n)], "doc_id bigint, text string")
        found = decontaminate.leaks(table, bench).collect()
        assert {(x["doc_id"], x["item_id"]) for x in found} == {(d, i) for d in range(n) for i in (0, 1, 2, 3, 7, 8)}
        assert min(x["cosine"] for x in found if x["item_id"] in (0, 8)) >= 0.7
        assert decontaminate.clean(table, bench).count() == 0


def test_decontaminate_basis_of_all_passages(spark):
    """The basis holds nearly as much of all documents and items as the best one of its size, found from the whole Gram matrix."""
    r = random.Random(9)
    word = lambda k: f"{'ghijklmnop'[k % 10]}{r.randint(0, 3)}x{k}"
    texts = [" ".join(word(i % 300) for _ in range(r.randint(8, 14))) for i in range(9000)]  # one passage each, of 300 kinds
    items = [" ".join(word(300 + i) for _ in range(12)) for i in range(40)]
    docs = decontaminate.hashed(decontaminate._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)))
    bench = decontaminate.hashed(decontaminate._rows(spark.createDataFrame(list(enumerate(items)), "doc_id bigint, text string")))
    idf, n_docs, n_passages, n_words = decontaminate.term_weights(docs)
    assert (n_docs, n_passages, n_words) == (9000, 9000, sum(len(t.split()) for t in texts))
    basis = decontaminate.fit(docs, bench, idf, n_passages, n_words, len(items))
    vectors = basis.weighted[:-1] / idf[:, None]

    rows = np.zeros((len(texts) + len(items), decontaminate.TERMS), np.float32)
    for row, t in zip(rows, texts + items):
        ids, tf = np.unique(decontaminate._terms(decontaminate.words_of(t.encode())), return_counts=True)
        row[ids] = tf * idf[ids]
    used = np.flatnonzero(rows.any(axis=0))
    rows = rows[:, used].astype(float)
    rows *= (np.r_[np.ones(len(texts)), np.full(len(items), np.sqrt(2 * 9000 / 40))] / np.linalg.norm(rows, axis=1))[:, None]
    gram = rows.T @ rows
    best = np.sort(np.linalg.eigvalsh(gram))[::-1][:decontaminate.RANK].sum()
    own = vectors[used].astype(float)
    assert np.allclose(own.T @ own, np.eye(decontaminate.RANK), atol=1e-3)
    assert np.trace(own.T @ gram @ own) >= 0.95 * best
