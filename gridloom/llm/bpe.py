"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the last token of its encoding is unique. An automaton over the vocabulary gives the tokens
that end at a position, longest first; the first of them that is compatible with the last token of the prefix before it
is the one. Following these back-pointers from the word's end emits exactly the ids that merging by rank would.

Two tokens are compatible if no merge crosses their border before both are complete: undoing the younger of the two
merges again and again, no pair met at the border may have a merge older than the part that was undone.

Null texts count as empty; an empty text has no ids and decodes to the empty text. Words repeat, so each Python worker
keeps those it has seen, up to a bound: runs of text without white space as they are written, and the lower-cased words
in them, which are walked through the automaton once however they are written. Longer pieces are encoded each time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import batch_of, map_arrow, slices, table, texts, utf8

#: Runs of text that a worker remembers, and as many words; and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
END = 256  # what the unit of a word's last byte has above that byte


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 letters stand for
    themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Finds, after each unit, the patterns that end there. States are made when first met; each holds its moves by unit,
    the length and token of the patterns that end in it, longest first, each with what is known of the tokens that may
    stand before it, and the text it stands for."""

    def __init__(self, patterns: dict[str, int]):
        self.patterns = patterns
        self.prefixes = {""}
        for p in patterns:
            for i in range(len(p), 0, -1):
                if p[:i] in self.prefixes:
                    break
                self.prefixes.add(p[:i])
        self.before: dict[int, dict[int, bool]] = {}
        self.root: tuple = ({}, (), "")
        self.state = {"": self.root}

    def move(self, at: tuple, unit: int) -> tuple:
        text = at[2] + chr(unit)
        while text and text not in self.prefixes:
            text = text[1:]
        if (to := self.state.get(text)) is None:
            found = [(len(text) - i, token) for i in range(len(text)) if (token := self.patterns.get(text[i:])) is not None]
            to = self.state[text] = ({}, tuple((n, token, self.before.setdefault(token, {})) for n, token in found), text)
        at[0][unit] = to
        return to


class Vocabulary:
    """A byte-level vocabulary in the JSON form of the tokenizers library, with ids in the order of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, letters = said["model"], byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names: dict[int, str] = {i: name for name, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.names |= {i: name for name, i in self.special.items()}

        def units(name: str) -> str:
            last = bool(self.suffix) and name.endswith(self.suffix) and name != self.suffix
            seq = [letters[c] for c in (name[: -len(self.suffix)] if last else name)]
            return "".join(map(chr, seq[:-1] + [seq[-1] + END * last]))

        ids = {name: i for name, i in model["vocab"].items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = ids[a], ids[b]
            self.joined[pair] = ids[a + b]
            self.parts.setdefault(ids[a + b], pair)
        self.compared = 0
        reachable = {units(name): i for name, i in model["vocab"].items() if i not in self.parts or self.compatible(*self.parts[i], below=i)}
        self.automaton = Automaton(reachable)
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether a and b stay two neighbouring tokens; with ``below``, whether nothing joins across them before that
        merge."""
        bound = float("inf") if below is None else below
        while True:
            if self.joined.get((a, b), bound) < bound:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # undo the younger merge; until it happened, only older merges could cross the border
            if right is None or (left is not None and a > b):
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word; with a word-end suffix its last byte is a unit of its own."""
        if not data:
            return []
        move, state = self.automaton.move, self.automaton.root
        last, size = [0], [0]
        for i, unit in enumerate(chain(data[:-1], (data[-1] + END * bool(self.suffix),)), 1):
            state = state[0].get(unit) or move(state, unit)
            for n, token, fits in state[1]:
                if n == i:
                    break
                if (ok := fits.get(last[i - n])) is None:
                    ok = fits[last[i - n]] = self.compatible(last[i - n], token)
                    self.compared += 1
                if ok:
                    break
            last.append(token)
            size.append(n)
        if self.compared > 2_000_000:
            self.compared = 0
            for fits in self.automaton.before.values():
                fits.clear()
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: How this vocabulary's own file splits normalised text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CONTROL = "\x1c\x1d\x1e\x1f"  # str.split() splits at these, the vocabulary's white space doesn't hold them
BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: Letters beyond this one are told apart by the tokenizers library's own character tables, whose version may differ.
LATIN = "\u024f"


def splitter(path: str):
    """Normalises and splits as the vocabulary's file says, by the library's own parts."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    words = pre_tokenizers.Split(Regex(WORDS.pattern), behavior="removed", invert=True)
    return lambda piece: [w for w, _ in words.pre_tokenize_str(normal.normalize_str(piece))]


class Remembered(dict):
    """What ``learn`` makes of a text, kept for the texts met last. When half of the room is full, the other half, which
    holds what was met before, is given up; what it holds and is met again moves on."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.before = learn, {}

    def __missing__(self, text: str) -> bytes:
        if (found := self.before.get(text)) is None:
            found = self.learn(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.before = dict(self)
                self.clear()
            self[text] = found
        return found


class WordCoder:
    """Encodes and decodes texts with a vocabulary of lower-cased words whose white space is dropped. Ids are little-endian
    32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.rarely = splitter(path)
        self.chunks, self.words = Remembered(self._chunk), Remembered(self._word)
        names = self.vocabulary.names
        self.named = pa.array([names.get(i, "") + " " for i in range(max(names) + 1)], pa.large_string())

    def _word(self, word: str) -> bytes:
        return np.array(self.vocabulary.word(word.encode()), "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a run of text without white space and special tokens."""
        if not piece.isascii():
            if max(piece) > LATIN:
                return b"".join([self.words[w] for w in self.rarely(piece)])
            piece = unicodedata.normalize("NFC", piece)
        piece = piece.lower()
        return self.words[piece] if piece.isalpha() else b"".join([self.words[w] for w in WORDS.findall(piece)])

    def _chunk(self, chunk: str) -> bytes:
        own = self.vocabulary
        if not own.special_pattern or "<" not in chunk:
            return self._piece(chunk)
        out, done = [], 0
        for m in own.special_pattern.finditer(chunk):
            out += [self._piece(chunk[done : m.start()]), np.array([own.special[m[0]]], "<u4").tobytes()]
            done = m.end()
        return b"".join([*out, self._piece(chunk[done:])])

    def ids(self, text: str) -> bytes:
        chunks = [c for c in BLANK.split(text) if c] if any(c in text for c in CONTROL) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def show(self, codes: list[bytes]) -> list[memoryview]:
        """Decoded texts in UTF-8: this vocabulary names no decoder, so its tokens are joined by spaces."""
        data, edges = utf8(self.named.take(pa.array(np.frombuffer(b"".join(codes), "<u4"))))
        first = np.cumsum([0, *(len(code) // 4 for code in codes)])
        return [memoryview(data[a : max(a, b - 1)]) for a, b in pairwise(edges[first].tolist())]

    def both(self, text: str) -> tuple[bytes, str]:
        """The text's ids, and its decoded form."""
        code = self.ids(text)
        return code, str(self.show([code])[0], "utf-8")


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with ``keep_ids`` also ids and decoded."""

    def step(batches):
        coder = word_coder(path)
        for batch in batches:
            for part in slices(batch):
                codes = [coder.ids(text) for text in part.column("text").to_pylist()]
                shown = coder.show(codes)
                n = [len(code) // 4 for code in codes]
                ids_sha, text_sha = ([hashlib.sha256(x).hexdigest() for x in many] for many in (codes, shown))
                more = {}
                if keep_ids:
                    ids = [np.frombuffer(code, "<u4").astype(np.int64).tolist() for code in codes]
                    more = {"ids": pa.array(ids, pa.list_(pa.int64())), "decoded": pa.array([str(x, "utf-8") for x in shown], pa.string())}
                yield batch_of(doc_id=part.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(text_sha, pa.string()), **more)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return map_arrow(texts(docs), step, schema)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return encode(table(spark, sf_dir, "documents"), path)
