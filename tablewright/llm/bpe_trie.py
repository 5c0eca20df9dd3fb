"""BPE encoding by prefix-sharing trie traversal, and decoding.

Each prefix of a word has a *last token*: the encoding of the prefix is the
encoding of what stands before that token, plus the token.  So one state per
trie node suffices, and words that share a prefix share its states.  A token
is the last one of a prefix exactly when it fits behind the last token of the
rest, i.e. when no merge would have joined the two across their border.

The sorted distinct words are the trie in preorder; a stack holds the states
on the path to the current node, so memory is one path, not the whole trie.
The end of a word is a symbol of its own (the last byte with ``</w>``), i.e.
an extra edge of the trie.

Null and empty texts have no tokens and decode to the empty string.  Rows are
encoded one by one; repeated rows and ids get equal results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import FORGET, forgetting, ids_and_texts
from .token_counts import byte_alphabet, slices

# Fixed value that decides results: what the vocabulary takes as a word, after lower-casing.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class Trie:
    """Encodes sorted batches of words (as byte-alphabet strings)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: set[str] = set()  # tokens whose own text encodes to them alone
        for token in sorted(vocab, key=lambda t: self.parts[t][2] if t in self.parts else -1):
            if token not in self.parts or self._whole(*self.parts[token]):
                self.whole.add(token)
        self.endings = {t[i:] for t in self.whole for i in range(len(t))}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Symbols that stand at one edge of a token while it grows, each with the rank at which it is merged away."""
        out, until = [], len(self.rank)
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            *pair, until = self.parts[token]
            token = pair[side]

    def fit(self, left: str, right: str) -> bool:
        """Whether BPE of the two tokens' joined text gives the two tokens."""
        known, edge = True, self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in edge:
                r = self.rank.get((x, y))
                # of equal pairs the leftmost merges first: a pair inside ``left`` wins, one inside ``right`` loses
                if r is not None and r < x_until and r <= y_until:
                    known = False
        if len(self.fits) >= 500_000:
            self.fits.clear()
        self.fits[left, right] = known
        return known

    def _whole(self, a: str, b: str, made: int) -> bool:
        """Whether BPE of a + b gives the token merged from them at rank ``made``: they are whole and fit until then."""
        if a not in self.whole or b not in self.whole:
            return False
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < made and r < x_until and r <= y_until:
                    return False
        return True

    def _last(self, text: str, end: int, tail: str, states: list[str]) -> str:
        """Last token of text[:end] + tail, given the last tokens of all shorter prefixes."""
        whole, fits, endings = self.whole, self.fits, self.endings
        begin = end
        while begin:
            begin -= 1
            token = text[begin:end] + tail if tail else text[begin:end]
            if token in whole:
                if not begin:
                    return token
                pair = (states[begin], token)
                known = fits.get(pair)
                if known or known is None and self.fit(*pair):
                    return token
            elif token not in endings:
                break
        raise ValueError(f"no token ends {text[:end] + tail!r}")

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct word, in sorted order, with its tokens."""
        states, before = [""], ""
        mark = len(self.word_end)
        for word in sorted(words):
            shared, most = 0, min(len(states) - 1, len(word) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word)):
                states.append(self._last(word, end, "", states))
            tokens = [self._last(word, len(word), self.word_end, states)]
            at = len(word) - (len(tokens[0]) - mark)
            while at:
                tokens.append(states[at])
                at -= len(states[at])
            before = word
            yield word, tokens[::-1]


class Encoder:
    """Encodes texts as the vocabulary file says; remembers up to ``remember`` distinct chunks."""

    def __init__(self, spec: str, remember: int = 250_000):
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab = dict(model["vocab"])
        self.trie = Trie(self.vocab, merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.at_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")" if self.special else r"((?!))")
        self.word = regex.compile(WORD + r"|\n")
        self.space, self.separator = regex.compile(r"\p{White_Space}+"), re.compile("[\x1c-\x1f]")
        self.id = {t: str(i) for i, t in self.token.items()}
        self.to_bytes = dict(enumerate(byte_alphabet()))
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.remember = remember

    def words(self, text: str) -> list[str]:
        # the vocabulary lower-cases character by character, without the final-sigma rule of str.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.word.findall(text)  # and line breaks

    def _learn(self, chunks: set[str]) -> None:
        """The ids and the tokens of new chunks, each joined by one space."""
        split = {}
        for c in [c for c in chunks if any(s in c for s in self.special)]:
            # odd parts are the special strings, found before anything is normalised
            split[c] = [w for i, part in enumerate(self.at_special.split(c)) for w in ([(part,)] if i % 2 else self.words(part))]
        plain = [c for c in chunks if c not in split]
        words = self.words("\n".join(plain))  # a line break is no word, but kept as a mark between chunks
        ends = [i for i, w in enumerate(words) if w == "\n"]
        split.update((c, words[i:j]) for c, i, j in zip(plain, [0, *(i + 1 for i in ends)], [*ends, len(words)]))
        distinct = set().union(*split.values())
        spelled = {w.encode().decode("latin-1").translate(self.to_bytes): w for w in distinct if isinstance(w, str)}
        of = {spelled[s]: tokens for s, tokens in self.trie.encode(list(spelled))}
        of |= {w: [w[0]] for w in distinct if isinstance(w, tuple)}
        for c, words in split.items():
            tokens = of[words[0]] if len(words) == 1 else [t for w in words for t in of[w]]
            self.ids[c] = " ".join([self.id[t] for t in tokens])
            self.tokens[c] = " ".join(tokens)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text its ids and its tokens, each joined by one space.

        White space never belongs to a word and every other character does, so
        a chunk between white space is normalised, split and encoded only the
        first time it is seen, and has at least one token.
        """
        # str.split() also cuts at the separators U+001C to U+001F, which are no white space for the vocabulary
        chunks = [[c for c in self.space.split(t) if c] if self.separator.search(t) else t.split() for t in texts]
        fresh = set().union(*chunks) - self.ids.keys()
        self._learn(fresh)
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        for c in chunks:
            yield " ".join(map(ids, c)), " ".join(map(tokens, c))
        if len(self.ids) > self.remember:
            for c in fresh:
                del self.ids[c], self.tokens[c]

    def forget(self) -> None:
        self.ids.clear()
        self.tokens.clear()
        self.trie.fits.clear()

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False) without a decoder: the tokens joined by one space."""
        return " ".join([self.token[i] for i in ids])


_ENCODERS: dict[int, Encoder] = {}
FORGET.append(lambda: [e.forget() for e in _ENCODERS.values()])


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _spec(docs: DataFrame, tokenizer_path: str):
    """The vocabulary file (a few MB, fixed), read once on the driver and sent to the tasks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row."""
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1).to_pylist(), 1_000_000):
                ids = [[int(i) for i in joined.split()] for joined, _ in _encoder(spec.value).encode(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(ids, pa.list_(pa.int32()))],
                                                 ["doc_id", "ids"])
                at += len(part)

    return ids_and_texts(docs).mapInArrow(forgetting(run), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ``text`` of rows of doc_id and ``ids`` (null: empty)."""
    spec = _spec(encoded, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_encoder(spec.value).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(forgetting(run), "doc_id bigint, text string")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every row's doc_id, n_tokens and the SHA-256 of its ids (joined by one space) and of its decoded text."""
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, texts = [], [], []
            for part in slices(batch.column(1).to_pylist(), 1_500_000):
                for joined, decoded in _encoder(spec.value).encode(part):
                    counts.append(joined.count(" ") + bool(joined))
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).mapInArrow(forgetting(run), "doc_id bigint, " + DIGESTS)
