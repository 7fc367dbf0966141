"""Toxicity behind obfuscation: noisy-channel restoration of disguised words, then a score of the restored text.

Three things are learned, none of them from held-out rows:

* a lexicon: words and beginnings of words whose presence goes with label 1, from a bounded sample of labelled rows
  (``MAX_TRAIN``); a beginning is written with a ``~`` after it;
* a character trigram model, from all training texts and, weighted up, the lexicon's words;
* how surely each lexicon word goes with label 1; a text's score joins those of its restored words as noisy-or.

A word that shows signs of disguise (digits or marks among letters, letters three times or more in a row, letters set
apart by spaces or marks) becomes a lattice: each character may stand for itself, for a letter it resembles, or for
nothing, each at a cost. Between letters that stand alone, white space is an arc of the lattice too: kept, or dropped at a
cost; so is that between other neighbouring short fragments. Viterbi search takes the cheapest path under the character
model, and all that was written stays in the restored text. Other words have one path and stay as they are. Lattices of
over LONG steps are searched in stretches of so many, so that memory is bounded however long a text is.

Null and empty texts get the score of a text without lexicon words: the share of label 1 among such labelled texts, with
PRIOR for none seen. Without labelled rows that is every text's score. Ties between paths go to the one met first, between
lexicon entries to the surest. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, batch_of, filtered, fold_of, labelled, map_arrow, slices, table, texts, utf8

#: Labelled rows that training takes at most (lowest hash of the id), and words of the lexicon.
MAX_TRAIN, LEXICON = 20_000, 512
#: A word belongs to the lexicon if the share of label 1 among its texts is this at least, with Z deviations to spare.
SURE, Z = 0.3, 4.2
#: Letters of the beginnings that are tried.
BEGINNINGS = range(3, 8)
THRESHOLD = 0.3
#: What labelled texts without lexicon words count on top of those seen: label 1, and all.
PRIOR = 0.5, 4.0
#: Steps of a lattice that are searched at once.
LONG = 512
#: Words that a Python worker remembers.
REMEMBERED = 200_000

#: Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h", "&": "a", "%": "x",
}
SEPARATORS = ".-_*~'`,/\\:;^"
#: Costs in natural logarithms: a stand-in, a dropped separator, a dropped repetition, one of all letters.
STAND_IN, DROPPED, REPEATED, ANY = 1.0, 0.7, 0.5, 3.0

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIZE = 28  # letters, a word's border, anything else
BORDER, OTHER = 26, 27
_CODE = {c: i for i, c in enumerate(LETTERS)}
_BYTE_CODE = np.full(256, OTHER, np.uint16)
_BYTE_CODE[[9, 10, 11, 12, 13, 32]] = BORDER
for _i, _c in enumerate(LETTERS):
    _BYTE_CODE[ord(_c)] = _BYTE_CODE[ord(_c.upper())] = _i

EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Marks that may open or close a run of fragments.
OPENS, CLOSES = "([{<\"'“‘«", ".,;:!?)]}>\"'”’»"
QUOTES = "\"'([{"
_OPEN, _CLOSE = r"[(\[{<\"'“‘«*_]{0,3}", r"[.,;:!?)\]}>\"'”’»*_]{0,3}"
SPACED = re.compile(rf"(?<!\S){_OPEN}\S(?:\s+\S){{2,}}{_CLOSE}(?!\S)")
#: Fragments of at most four characters side by side.
BROKEN = re.compile(rf"(?<!\S){_OPEN}\S{{1,4}}{_CLOSE}(?:\s+{_OPEN}\S{{1,4}}{_CLOSE})+(?!\S)")
ODD = re.compile(r"[^a-z]|(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
COMBINING = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)) + "]")


def fold(word: str) -> str:
    """Lower-case letters without accents."""
    return word if word.isascii() else COMBINING.sub("", unicodedata.normalize("NFKD", word)).lower()


def single(word: str) -> str:
    """Every run of a letter as one."""
    return re.sub(r"(.)\1+", r"\1", word)


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of character trigrams; texts have a border at either end, and runs of spaces are one border."""
    codes = np.insert(_BYTE_CODE[data], offsets, BORDER)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BORDER) | (codes[:-1] != BORDER)
    codes = codes[keep].astype(np.int32)
    if len(codes) < 3:
        return np.zeros(SIZE**3, np.int64)
    return np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)


@dataclass
class Channel:
    """The character model, the lexicon and the words met so far."""

    cost: np.ndarray
    words: list[str]
    sure: list[float]
    base: float = 0.5
    known: set = field(default_factory=set)
    hit: dict = field(default_factory=dict)

    def __post_init__(self):
        self.place = {w: i for i, w in enumerate(self.words)}
        self.grid = self.cost.tolist()
        self.stems = [w.rstrip("~") for w in self.words]
        self.shortest = min(map(len, self.stems), default=1)
        self.single = {single(w): w for w in reversed(self.stems)}
        self.begins = {w[:n] for w in self.single for n in range(1, len(w) + 1)}
        self.heads: dict[str, set[str]] = {}
        self.runs: dict[str, list[tuple[int, int, str]]] = {}
        self.apart: dict[str, str] = {}
        self.apart_for_good: set[tuple[str, str]] = set()
        self.openings = {w[:3] for w in self.stems}
        #: Two letters that no reading of an entry begins with, as letters are never dropped.
        self.foreign = {a + b for a in LETTERS for b in LETTERS if a != b} - self.begins
        self.doubt = [math.log1p(-x) for x in self.sure]

    def match(self, word: str) -> int | None:
        """The surest entry that is this word or a beginning of it."""
        if word[:3] not in self.openings:
            return None
        found = [i for x in (word, *(word[:n] + "~" for n in BEGINNINGS if n <= len(word))) if (i := self.place.get(x)) is not None]
        return max(found, key=self.sure.__getitem__, default=None)

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters, the strings it may stand for and what each costs."""
        out = []
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m[1], len(m[0])
            if c in _CODE:
                out.append([(c * n, 0.0 if n < 3 else 2 * REPEATED)] + [(c * k, REPEATED) for k in range(1, min(n, 3))])
                continue
            options = [(x, STAND_IN if len(LOOKALIKES[c]) < 5 else ANY) for x in LOOKALIKES.get(c, "")]
            options += [(x * 2, cost * 2) for x, cost in options if n > 1]
            if c in SEPARATORS or n > 2:
                options.append(("", DROPPED))
            out.append([*options, (c * n, 2 * STAND_IN)])
        return out

    def restore(self, word: str) -> str:
        """The cheapest reading of a word without white space."""
        return self.path(self.lattice(word)).rstrip(" ")

    def path(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The cheapest path through a lattice, in stretches of LONG steps."""
        return "".join(self.stretch([*lattice[at : at + LONG], *([[(" ", 0.0)]] if at + LONG >= len(lattice) else [])]) for at in range(0, max(len(lattice), 1), LONG))

    def stretch(self, lattice: list[list[tuple[str, float]]]) -> str:
        """Viterbi search; states are the last two characters."""
        best = {(BORDER, BORDER): (0.0, None)}
        trail: list[dict] = []
        for options in lattice:
            new: dict = {}
            for (a, b), (cost, _) in best.items():
                for text, price in options:
                    x, y, total = a, b, cost + price
                    for c in text:
                        code = BORDER if c == " " else _CODE.get(c, OTHER)
                        total += self.grid[x][y][code]
                        x, y = y, code
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, ((a, b), text)
            trail.append(new)
            best = new
        at, out = min(best, key=lambda k: best[k][0]), []
        for states in reversed(trail):
            at, text = states[at][1]
            out.append(text)
        return "".join(reversed(out))

    def disguised(self, word: str) -> bool:
        """Whether an edge-stripped lower-case word has another path than its own that is worth a search."""
        if len(word) < 3:
            return False
        if ODD.search(word):
            return any(c in _CODE for c in word)
        return (single(word) if DOUBLED.search(word) else word) in self.single

    def plain(self, chunk: str) -> str:
        """What a run without spaces says: as it is if its bare word is in the lexicon, else restored if it looks
        disguised, else as it is."""
        low = chunk.lower()
        bare = low.strip(EDGES)
        if not bare or self.match(bare) is not None:
            return bare or chunk
        if (word := fold(bare)) != bare and word in self.place:
            return word
        tries = [word, fold(low).rstrip(".,;:?\"')]}").lstrip(QUOTES)]
        found = [self.restore(x) for x in dict.fromkeys(tries) if self.disguised(x)]
        found = [x if self.match(x) is not None else self.single.get(single(x), x) for x in found]
        return next((x for x in found if self.match(x) is not None), found[0] if found else chunk)

    def text(self, text: str) -> str:
        """The whole restored text."""
        text = SPACED.sub(lambda m: self.joined(m[0]), text)
        text = BROKEN.sub(lambda m: self.mended(m[0]), text)
        return re.sub(r"\S+", lambda m: self.plain(m[0]), text)

    def joined(self, spaced: str) -> str:
        """Letters set apart by white space: the cheapest reading of the lattice in which each gap may be kept or dropped. A
        lexicon word that the reading holds within a word, or that the letters without gaps hold, stands alone in it."""
        if (out := self.apart.get(spaced)) is not None:
            return out
        parts = [fold(c) for c in spaced.lower().split()]
        lattice = []
        for i, part in enumerate(parts):
            lattice += [[("", DROPPED), (" ", 0.0)]] if i else []
            lattice += self.lattice(part)
        read, run = self.path(lattice).rstrip(" "), "".join(parts)
        holds = lambda t: [w for w in self.stems if len(w) > 3 and w in t]
        whole = [w for w in read.split() if self.match(w) is not None]
        if not whole:
            read = next((t for t in (read, run, self.restore(run)) if holds(t)), read)
        for stem in sorted(holds(read), key=len, reverse=True):
            read = re.sub(rf"(?<! )(?={re.escape(stem)})|(?<={re.escape(stem)})(?! )", " ", read) if stem not in whole else read
        out = " ".join(read.split())
        if len(self.apart) > REMEMBERED:
            self.apart.clear()
        if len(spaced) < 64:
            self.apart[spaced] = out
        return out

    def spelt(self, text: str) -> float:
        """What a text costs under the character model."""
        x, y, total = BORDER, BORDER, 0.0
        for c in text + " ":
            code = BORDER if c == " " else _CODE.get(c, OTHER)
            total += self.grid[x][y][code]
            x, y = y, code
        return total

    def readings(self, held: set[str], fragment: str) -> set[str]:
        """What the fragment makes of the beginnings of entries in ``held``, each run of a letter as one; "" once an entry
        is whole. Nothing that ``plain`` could match is missing."""
        whole = "" in held and held != {""}
        for c in fragment:
            new = set()
            for x in held:
                if c in EDGES or c in SEPARATORS or (c not in _CODE and c * 3 in fragment):
                    new.add(x)
                for letter in c if c in _CODE else LOOKALIKES.get(c, ""):
                    y = x if x[-1:] == letter else x + letter
                    if y in self.begins:
                        new.add(y)
                        whole |= y in self.single
            held = new
        return held | {""} if whole else held - {""}

    def pieces(self, run: str) -> list[tuple[int, int, str]]:
        """Of a run in lower case: neighbouring fragments that are a lexicon word when the white space between them is dropped, where that is the
        cheaper path: first and last fragment, and the word. Marks only open the first fragment or close the last."""
        if (out := self.runs.get(run)) is not None:
            return out
        parts, out = fold(run).split(), []
        if self.apart_for_good.issuperset(zip(parts, parts[1:], strict=False)):
            return out
        for i, joined in enumerate(parts[:-1]):
            if (joined, parts[i + 1]) in self.apart_for_good:
                continue
            if (held := self.heads.get(joined)) is None:
                held = self.heads[joined] = self.readings({""}, joined)
            if not held:
                self.apart_for_good.add((joined, parts[i + 1]))
                continue
            for j in range(i + 1, len(parts)):
                if (len(parts[j - 1]) > 1 and parts[j - 1][-1] in CLOSES) or (len(parts[j]) > 1 and parts[j][0] in OPENS):
                    break
                joined += parts[j]
                if not (held := self.readings(held, parts[j])):
                    if j == i + 1:
                        self.apart_for_good.add((parts[i], parts[j]))
                    break
                if "" not in held:
                    continue
                word = self.plain(joined)
                if (found := self.match(word)) is None or len(self.stems[found]) < 4:
                    continue
                own, bare = parts[i : j + 1], joined.strip(EDGES)
                price = DROPPED * (j - i) + STAND_IN * sum(c not in _CODE for c in bare)
                if max(map(len, own)) == 1 or self.spelt(word) + price < self.spelt(" ".join(own).strip(EDGES)):
                    out.append((i, j, word))
                    break
            if len(self.heads) + len(self.apart_for_good) > REMEMBERED:
                self.heads.clear()
                self.apart_for_good.clear()
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        if len(run) < 64:
            self.runs[run] = out
        return out

    def mended(self, run: str) -> str:
        """The run with its broken words put together, the first of those that overlap."""
        chunks, at = re.split(r"(\s+)", run), -1
        for i, j, word in self.pieces(run.lower()):
            if i > at:
                chunks[2 * i : 2 * j + 1] = [word] + [""] * (2 * (j - i))
                at = j
        return "".join(chunks)

    def found(self, text: str) -> set[int]:
        """The lexicon words in the restored text. A worker remembers what it has restored."""
        low = text.lower()
        chunks = set(low.split())
        new = chunks - self.known
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for chunk in new:
            if chunk.lstrip(QUOTES)[:2] in self.foreign:
                continue
            bare = chunk.strip(EDGES)
            if chunk not in self.hit and (i := self.hit_of(chunk, bare)) is not None:
                self.hit[chunk] = i
        self.known |= {c for c in new if len(c) < 64}
        out = {self.hit[c] for c in chunks & self.hit.keys()}
        for m in SPACED.finditer(low):
            if len(m[0]) // 2 + 1 >= self.shortest:
                out |= {i for w in self.joined(m[0]).split() if (i := self.match(w)) is not None}
        for m in BROKEN.finditer(low):
            out |= {self.match(w) for _, _, w in self.pieces(m[0])}
        return out

    def hit_of(self, chunk: str, bare: str) -> int | None:
        """The entry that ``plain`` makes of a chunk in lower case. What can't be read as an entry isn't searched."""
        if not bare or (found := self.match(bare)) is not None:
            return found if bare else None
        word = fold(bare)
        if word != bare and word in self.place:
            return self.match(word)
        for x in dict.fromkeys([word, fold(chunk).rstrip(".,;:?\"')]}").lstrip(QUOTES)]):
            if self.disguised(x) and "" in self.readings({""}, x):
                read = self.restore(x)
                if (found := self.match(read)) is None:
                    found = self.match(self.single.get(single(read), read))
                if found is not None:
                    return found
        return None

    def score(self, found: set[int]) -> float:
        return 1 - (1 - self.base) * math.exp(sum(self.doubt[i] for i in found))


def bags(rows: DataFrame, only: set[str] | None = None) -> DataFrame:
    """The distinct words of each text and their beginnings, with a sketch of the text: copies, near ones too, share it."""

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                words, sketches = [], []
                for text in part.column("text").to_pylist():
                    own = {b for c in text.lower().split() if 2 < len(b := c.strip(EDGES)) < 40 and b.isalpha()}
                    if own:
                        sketch = f"{min(own)} {max(own)}"
                        own |= {w[:n] + "~" for w in own for n in BEGINNINGS if n <= len(w)}
                        own = own if only is None else own & only
                        words += own
                        sketches += [sketch] * len(own)
                yield batch_of(word=pa.array(words, pa.string()), sketch=pa.array(sketches, pa.string()))

    found = map_arrow(rows.select("text"), step, "word string, sketch string")
    return found.groupBy("word", "sketch").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("n"))


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings that go with label 1, and how surely (Wilson's lower bound). Of nested entries the surest
    stays, a whole word before a beginning and a long beginning before a short one."""
    toxic = {r["word"]: r["n"] for r in bags(rows.where("y = 1")).where(F.col("n") >= SURE * Z**2 / (1 - SURE)).collect()}
    clean = {r["word"]: r["n"] for r in bags(rows.where("y = 0"), set(toxic)).collect()} if toxic else {}
    least = {}
    for word, t in toxic.items():
        n = t + clean.get(word, 0)
        p = t / n
        bound = (p + Z**2 / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n))) / (1 + Z**2 / n)
        if bound >= SURE:
            least[word] = min(0.999, bound)
    chosen: dict[str, float] = {}
    shorter: set[str] = set()
    for word in sorted(least, key=lambda w: (-round(least[w], 4), w.endswith("~"), -len(w), w)):
        stem = word.rstrip("~")
        if stem not in shorter and not any(stem[:n] + "~" in chosen for n in BEGINNINGS) and stem not in chosen:
            chosen[word] = least[word]
            shorter |= {stem[:n] for n in BEGINNINGS}
    return dict(list(chosen.items())[:LEXICON])


def trigram_costs(docs: DataFrame, words: list[str]) -> np.ndarray:
    """Minus log probabilities [before last, last, next], from all training texts and the lexicon."""

    def step(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += trigram_counts(*utf8(part.column("text")))
        has = np.flatnonzero(total)
        yield batch_of(gram=pa.array(has, pa.int32()), n=pa.array(total[has], pa.int64()))

    count = np.zeros(SIZE**3)
    for row in map_arrow(docs.select("text"), step, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        count[row["gram"]] = row["n"]
    count /= max(1.0, count.sum())
    own = np.zeros(SIZE**3)
    for w in map(fold, words):
        if not w.endswith("~"):
            own += trigram_counts(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
            continue
        for a, b, c in zip(" " + w, w, w[1:-1], strict=False):
            own[(_CODE.get(a, BORDER if a == " " else OTHER) * SIZE + _CODE.get(b, OTHER)) * SIZE + _CODE.get(c, OTHER)] += 1
        own[(BORDER * SIZE + BORDER) * SIZE + _CODE.get(w[0], OTHER)] += 1
    own /= max(1.0, own.sum())
    grid = (0.5 * count + 0.5 * own).reshape(SIZE, SIZE, SIZE)
    pair = grid.sum(axis=0)  # last, next
    pair = (pair + 1e-9) / (pair + 1e-9).sum(axis=1, keepdims=True)
    weight = 2e-5
    return -np.log((grid + weight * pair[None]) / (grid.sum(axis=2, keepdims=True) + weight))


def learn(docs: DataFrame, labels: DataFrame, label: str, train, most: int = MAX_TRAIN) -> Channel:
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(labelled(docs, labels, label, train, most))
    words = lexicon(rows)
    channel = Channel(trigram_costs(docs.where(train), list(words)), list(words), list(words.values()))
    rest = rows.select("y", *restored_words(rows, channel)).where("size(found) = 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    scratch.drop(rows)
    return Channel(channel.cost, channel.words, channel.sure, (rest["y"] + PRIOR[0]) / (rest["n"] + PRIOR[1]))


def restored_words(rows: DataFrame, channel: Channel) -> list:
    @F.pandas_udf("array<int>")
    def found(text):
        return text.map(lambda t: sorted(channel.found(t)))

    return [found("text").alias("found")]


def restore_texts(docs: DataFrame, channel: Channel) -> DataFrame:
    """doc_id and the whole restored text."""

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                yield batch_of(doc_id=part.column("doc_id"), restored=pa.array([channel.text(t) for t in part.column("text").to_pylist()], pa.string()))

    return map_arrow(texts(docs), step, "doc_id long, restored string")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, label: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """Scores every document: doc_id, held_out, score, predicted, one row for each row of ``docs``."""
    rows = texts(docs)
    channel = learn(rows, labels, label, fold_of("doc_id", folds) != held, max_train)

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                score = np.array([channel.score(channel.found(t)) for t in part.column("text").to_pylist()])
                yield batch_of(doc_id=part.column("doc_id"), score=pa.array(score, pa.float64()), predicted=pa.array((score >= THRESHOLD).astype(np.int32)))

    out = map_arrow(rows, step, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns. A document without any lexicon word stays, however
    many of its kind were labelled 1: nothing in it speaks against it."""
    channel = learn(texts(docs), labels, "toxic", fold_of("doc_id", folds) != held)

    def stays(text: str) -> bool:
        found = channel.found(text)
        return not found or channel.score(found) < THRESHOLD

    return filtered(docs, lambda text: np.array([stays(t) for t in text.to_pylist()], bool))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
