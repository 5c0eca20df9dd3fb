"""All stages of the pipeline against plain Python, on null, empty, very long and repeated rows, clashing names, and an empty table."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, n_chars int, n_words int, set_id string, `kept.text` string, ids_sha256 string, item_id int"


def order(i):
    return 2**63 - 1 if i is None else i


def keeps_quality(text):
    words = WORDS.findall(text or "")
    if len(words) < 50:
        return False
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {p + j for p, x in enumerate(zip(words, words[1:], words[2:])) if windows[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return not (100 * len(covered) > 50 * n or 100 * sum(map(text.count, "#*$%&|<>")) > 10 * n
                or len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text)) or 100 * (text.count("!") + text.count("?")) > 30 * n
                or 100 * (len(lines) - len(set(lines))) > 60 * len(lines) or sum(map(len, words)) > 40 * n)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1:] if len(a) < len(b) else a[p + 1:] == b[p + 1:]


def without_lines(rows):
    places = sorted({(order(i), t) for i, t in rows}, key=lambda r: r[0])
    seen, gone = [], set()
    for i, t in places:
        for no, line in enumerate(t.split("\n")):
            w = WORDS.findall(line)
            if w:
                if any(line == other or min(len(w), len(v)) >= 8 and one_edit(w, v) for other, v in seen):
                    gone.add((i, t, no))
                seen.append((line, w))
    return [(i, "\n".join(x for no, x in enumerate(t.split("\n")) if (order(i), t, no) not in gone)) for i, t in rows], len(gone)


def without_near_copies(rows):
    def shingles(t):
        w = WORDS.findall(t)
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = head[a], head[b]
                head = [new if h == old else h for h in head]
    first = {}
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            first[head[k]] = min(first.get(head[k], (order(i), t)), (order(i), t))
    return [(i, t) for k, (i, t) in enumerate(rows) if not sets[k] or first[head[k]] == (order(i), t)]


def without_leaks(rows, items):
    plain = lambda t: [w for w in (x.lower().strip("""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""") for x in WORDS.findall(t or "")) if w]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(last[j - 1] + 1 if x == y else max(last[j], row[-1]))
        return row[-1]

    def leaks(t):
        words = plain(t)
        held = set(words)
        for item in map(plain, items):
            if item and sum(w in held for w in item) >= 0.65 * len(item):
                if any(lcs(item, words[max(0, m - 64):m + 64]) >= 0.65 * len(item) for m in range(0, len(words) + 16, 16)):
                    return True
        return False
    return [r for r in rows if not leaks(r[1])]


def brute_force(rows, items):
    counts = [len(rows)]
    rows = [(i, t) for i, t in rows if keeps_quality(t)]
    counts.append(len(rows))
    rows, n_lines = without_lines(rows)
    rows = without_near_copies(rows)
    counts.append(len(rows))
    rows = without_leaks(rows, items)
    counts.append(len(rows))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    return out, counts, n_lines


@pytest.fixture(scope="module")
def tables():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdeghilmnorstuéß") for _ in range(r.randint(2, 7)))
    line = lambda n=11: " ".join(word() for _ in range(n))
    prose = lambda n: [line() for _ in range(n)]
    items = [line(n) for n in (12, 30, 50)]
    base = [prose(r.randint(8, 14)) for _ in range(14)]
    shared, hot = line(12), line(9)
    docs = [list(b) for b in base]
    docs[3].insert(2, shared)
    docs[4].insert(0, shared)
    docs[5].append(" ".join(["changed", *shared.split()[1:]]))  # one word differs
    docs[6].append(shared + " longer by two")
    for b in docs[7:11]:
        b.insert(4, hot)
    for n, b in zip((0, 4, 7), (prose(9), prose(9), prose(10))):  # items, whole and with every nth word replaced
        for item in items:
            w = [word() if n and k % n == 1 else x for k, x in enumerate(item.split())]
            docs.append(b[:4] + [" ".join(w)] + b[4:])
            b = prose(9)
    texts = ["\n".join(d) for d in docs]
    texts += [base[0][0] + "\n" + "\n".join(base[0]).upper(), "\n".join(base[1]), "", None, " \t\n", "few words here"]
    near = "\n".join(base[2]).split(" ")
    near[15] = "other"
    texts += [" ".join(near), "### *** " * 60, "Same old words. " * 80, " ".join(line() for _ in range(700)), "\n".join(prose(500))]
    # near copies that line dedup cannot see, as their lines are cut elsewhere
    one_line = " ".join(base[12]).split(" ")
    one_line[30] = "elsewhere"
    texts += [" ".join(one_line), " ".join(base[13])]
    rows = list(enumerate(texts))
    rows += [rows[8], rows[8], rows[-1], (None, "\n".join(prose(9))), (None, None)]
    rows += [(1000 + k, "\n".join(base[9])) for k in range(30)]  # a group of copies
    return rows, items


def run(spark, folder, rows, items):
    wide = [(i, t, "en", len(t or ""), 1, "s", "k", "x", 2) for i, t in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = [(k, t) for k, t in enumerate(items)] + ([(None, None), (9, "")] if items else [])
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_run_by_brute_force(spark, tmp_path, tables):
    rows, items = tables
    want, counts, n_lines = brute_force(rows, items)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 10 and n_lines > 20  # every stage has work
    got = run(spark, tmp_path, rows, items)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (None, None)]])
def test_nothing_to_keep(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows, []).count() == 0
