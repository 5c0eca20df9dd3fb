"""Fill-in-middle, phrase collocations and SentencePiece codec against brute force and the library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablewright.llm import collocations, fill_in_middle, piece_codec

SCHEMA = "doc_id bigint, text string, lang string, `key` string, place int, `lang.x` string, phrase string, ids string, n int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _texts():
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "delta", "éß", "x", "日本", "😀", "<0x41>"])
    prose = lambda n: " ".join(word() + r.choice(["", "", ",", ".\n", " \t"]) for _ in range(n))
    texts = [None, "", "\n", "\n\n\n", "one line", "a\nb", " lead  and  trail ", "with <P> mark\nb\nc", "<S>", "P>x\n<P\n<", "▁▁x▁"]
    texts += [prose(r.randint(1, 80)) for _ in range(25)]
    texts += ["x" * 40_000 + "\n" + "long line " * 3000, "\n".join(prose(5) for _ in range(3000)), "日本" * 3000, "\x00\x1c\x85 \r\n﻿"]
    return texts


@pytest.fixture(scope="module")
def rows():
    out = [(None if i == 15 else i, t, [None, "en", "de"][i % 3], "k", 1, "l", "p", "i", 2) for i, t in enumerate(_texts())]
    return out + [out[12]] * 40 + [out[0], out[1], out[-2], out[15]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fim(doc_id, text, percent=100, spm=50, seed=7):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    n = len(units)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, n, "plain", None, None, text or "")
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm_form = h[3] % 100 < spm
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm_form else f"<P>{pre}<S>{suf}<M>{mid}"
    return (doc_id, n, "spm" if spm_form else "psm", len(pre), len(mid), out)


def test_fill_in_middle(docs, rows, empty):
    want = Counter((*f[:5], sha(f[5]), sha(r[1] or "")) for r in rows for f in [fim(r[0], r[1])])
    assert Counter(map(tuple, fill_in_middle.digests(docs).collect())) == want
    assert {f[2] for f in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(empty).count() == 0


def test_fill_in_middle_texts_and_restoration(docs, rows):
    draw = fill_in_middle.Draw(seed=11, percent=60, spm_percent=30)
    out = fill_in_middle.transform(docs, draw)
    assert Counter(map(tuple, out.collect())) == Counter(fim(r[0], r[1], 60, 30, 11) for r in rows)
    back = out.select("doc_id", fill_in_middle.restored_text(F.col("form"), F.col("output")).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in rows)


def test_pieces_are_bounded_and_whole(docs):
    found = fill_in_middle.pieces(docs).where("place > 0").select(F.max(F.length("data")), F.min(F.length("data"))).first()
    assert found[0] <= fill_in_middle.PIECE and found[1] > 0


def brute_phrases(rows, threshold, top, absorbed=100):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i:i + n])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    gone = {(lang, p[i:i + m]) for (lang, p), a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
            if 100 * a >= absorbed * f[lang, p[i:i + m]]}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
            for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("threshold, top, absorbed", [(5, 40, 100), (20, 1000, 100), (8, 1000, 60)])
def test_collocations(docs, rows, threshold, top, absorbed):
    got = [tuple(r) for r in collocations.ranked(docs, top, threshold, absorbed=absorbed).collect()]
    want = brute_phrases([(r[1], r[2]) for r in rows], threshold, top, absorbed)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_collocations_without_rows(empty, spark):
    assert collocations.ranked(empty).count() == 0
    assert collocations.ranked(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id int, text string, lang string")).count() == 0


@pytest.mark.parametrize("capacity", [3, 10, 50, 10_000])
def test_summaries_keep_what_is_frequent(capacity):
    r = np.random.default_rng(capacity)
    keys = (r.zipf(1.3, 20_000) % 5000).astype(np.uint64)
    parts = [np.unique(p, return_counts=True) for p in np.array_split(keys, 37)]
    found, counts, error = collocations.merged(iter(parts), capacity, gather=2000)
    assert len(found) <= capacity and error <= len(keys) / (capacity + 1)
    kept = dict(zip(found.tolist(), counts.tolist()))
    for key, n in Counter(keys.tolist()).items():
        assert n - error <= kept.get(key, 0) <= n


def test_every_frequent_ngram_passes_a_tight_summary(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "ROOM", 1)
    found = {(r["lang"], r["phrase"]): r["f"] for r in collocations.frequent(docs, 5).where("n_words > 1").collect()}
    text = spark.createDataFrame([(r[1], r[2]) for r in rows], "text string, lang string")
    want = collocations.counted(collocations._rows(text), _open_sieve()).where("n_words > 1 and f >= 5").collect()
    assert found == {(r["lang"], r["phrase"]): r["f"] for r in want}


def test_a_task_sends_one_block_of_counts_to_each_partition(spark, docs, rows):
    text = collocations._rows(spark.createDataFrame([(r[1], r[2]) for r in rows], "text string, lang string").repartition(3))
    sent = collocations.blocks(text, _open_sieve()).collect()
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = [pa.ipc.open_stream(r["data"]).read_all() for r in sent]
    assert len(sent) <= 3 * dealt < sum(map(len, tables)) and {r["part"] for r in sent} <= set(range(dealt))
    want = Counter()
    for t in tables:
        want.update({(r["lang"], r["n_words"], r["phrase"]): r["f"] for r in t.to_pylist()})
    got = collocations.counted(text, _open_sieve()).collect()
    assert len(got) == len(want) and {(r["lang"], r["n_words"], r["phrase"]): r["f"] for r in got} == want


def test_blocks_are_added_bit_by_bit():
    some = [pa.table([["en", "en", "fr"], pa.array([1, 2, 1], pa.int32()), ["a", "a b", "a"], [n, 1, 2]], ["lang", "n_words", "phrase", "f"])
            for n in range(1, 6)]
    for gather in (1, 4, 100):
        total = collocations.added(map(collocations._block, some), gather)
        assert {tuple(r.values()) for r in total.to_pylist()} == {("en", 1, "a", 15), ("en", 2, "a b", 5), ("fr", 1, "a", 10)}
        assert total.column_names == ["lang", "n_words", "phrase", "f"]


def _open_sieve():
    return collocations.Sieve(np.full(2**collocations.BITS // 8, 255, np.uint8))


def test_keys_packed():
    keys = np.array([0, 1, 2**48 - 1, 2**47 + 5], np.uint64)
    assert collocations._unpacked(collocations._packed(keys)).tolist() == keys.tolist()


def test_sentencepiece(docs, rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [library.encode(r[1] or "") for r in rows]
    n_bytes = [len((r[1] or "").encode()) for r in rows]
    want = Counter((r[0], len(i), sha(",".join(map(str, i))), sha(library.decode(i)), n, n) for r, i, n in zip(rows, ids, n_bytes))
    assert Counter(map(tuple, piece_codec.digests(docs, MODEL).collect())) == want
    encoded = piece_codec.encode(docs, MODEL)
    assert Counter((r[0], tuple(r[1])) for r in encoded.collect()) == Counter((r[0], tuple(i)) for r, i in zip(rows, ids))
    assert Counter(map(tuple, piece_codec.decode(encoded, MODEL).collect())) == Counter((r[0], library.decode(i)) for r, i in zip(rows, ids))
    assert piece_codec.encode(empty, MODEL).count() == piece_codec.digests(empty, MODEL).count() == 0


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _with_map(rule, extra=b""):
    """The model with the library's compiled character map of a rule."""
    spec = dict(piece_codec._fields(dict(piece_codec._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))
    spec = b"\x12" + _number(len(spec[2])) + spec[2] + extra
    with open(MODEL, "rb") as f:
        return f.read() + b"\x1a" + _number(len(spec)) + spec


@pytest.mark.parametrize("rule, extra", [(None, b""), ("nmt_nfkc", b""), ("nfkc_cf", b"\x20\x01"), ("nmt_nfkc", b"\x18\x00")])
def test_offsets_of_normalised_texts(rule, extra):
    model = _with_map(rule, extra) if rule else open(MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(8)
    alphabet = "aAbé ßﬁｱﾞ①　 ▁\n\t日本語😀é̀.,ⅷ½​\xad\xa0ﬃ가"
    texts = [t or "" for t in _texts()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(400)]
    vocabulary = piece_codec.Vocabulary(model)
    found, at = piece_codec.Encoder(vocabulary).encode(texts), 0
    for i, text in enumerate(texts):
        mine = slice(at, at + found.count[i])
        at += found.count[i]
        want = library.encode_as_offset_mapping(text)
        byte = np.r_[0, np.cumsum([len(c.encode()) for c in text])].astype(int)
        assert found.ids[mine].tolist() == want["ids"], text
        assert list(zip(found.begin[mine].tolist(), found.end[mine].tolist())) == [(byte[a], byte[b]) for a, b in want["offsets"]], text
        assert found.decoded[i] == vocabulary.decode(want["ids"]) == library.decode(want["ids"]), text


def test_decoding_of_any_ids():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = piece_codec.Vocabulary(open(MODEL, "rb").read())
    r = random.Random(2)
    for _ in range(300):
        ids = [r.choice([r.randrange(3), 3 + r.randrange(256), r.randrange(32000)]) for _ in range(r.randint(0, 12))]
        assert vocabulary.decode(ids) == library.decode(ids), ids


def test_what_a_task_has_learned_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBER", 50)
    encoder = piece_codec.Encoder(piece_codec.Vocabulary(open(MODEL, "rb").read()))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(20):
        texts = [f"word{k} other{k} and {'x' * k}", "same words"]
        assert encoder.encode(texts).joined == [",".join(map(str, library.encode(t))) for t in texts]
    assert encoder.held < 200
