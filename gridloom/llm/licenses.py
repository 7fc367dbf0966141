"""Licence scans by patience alignment.

Words that occur once in a stretch of text and once in a template anchor it; the longest run of anchors that ascends in
both is kept, and the gaps between are aligned in the same way, whose words may be unique there. The matched share of
the template's words is its coverage. A template is found where a stretch of the text reaches COVERAGE and the words that
identify the licence are matched side by side.

Every text is scanned whole. What can't reach the coverage is passed over by an exact bound: a stretch matches no more
words than it and the template have in common. Stretches are three times as long as the template and begin a template's
length apart, so a licence that is spread over at most twice its words lies whole in one. A stretch that reaches the bound
but not the coverage is tried again in narrower parts, where words are unique that aren't in the whole.

Null and empty texts, and texts without a licence, have no license and coverage 0. Of equal coverages the longer template
counts, then the one that comes first in the text, then the name. Repeated rows are scanned each; an empty table gives no
rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import batch_of, map_arrow, slices, table, texts
from gridloom.llm.license_texts import IDENTIFYING, TEMPLATES

COVERAGE = 0.8
#: Words that a Python worker remembers.
REMEMBERED = 500_000
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’"


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places, ascending in both; a text word of -1 matches nothing."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # common beginning
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:  # common end
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if w >= 0 and here[w] == 1 and there[w] == 1}
        anchors = ascending([(place[w], j) for j, w in enumerate(template[c:d], c) if w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose first parts ascend, by piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (i, _) in enumerate(pairs):
        pile = bisect_left(tops, i)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(i)
            ends.append(n)
        else:
            tops[pile], ends[pile] = i, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def beside(text: list[int], pairs: list[tuple[int, int]], words: list[int]) -> bool:
    """Whether these words are matched one right after the other."""
    places = [i for i, _ in pairs]
    n = len(words)
    return any(places[k + n - 1] - places[k] == n - 1 and [text[i] for i in places[k : k + n]] == words for k in range(len(places) - n + 1))


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        words: dict[str, int] = {}
        self.templates = []
        for name, text in templates.items():
            ids = [words.setdefault(w, len(words)) for c in text.lower().split() if (w := c.strip(EDGES))]
            self.templates.append((name, ids, Counter(ids), -(-len(ids) * least // 1)))
        self.words, self.lengths = words, {name: len(ids) for name, ids, _, _ in self.templates}
        self.marks = [[[words.get(w, -1) for w in phrase.split()] for phrase in IDENTIFYING.get(name, ())] for name in templates]
        self.known: dict[str, int] = {}
        self.seen: set[str] = set()
        self.sizes = np.array([len(t[1]) for t in self.templates])
        self.table = np.zeros((len(templates), len(words)), np.int64)
        for k, (_, _, count, _) in enumerate(self.templates):
            self.table[k, list(count)] = list(count.values())

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """Name, coverage, first and last word of the best stretch for each template that is found, best first."""
        chunks = text.lower().split()
        distinct = set(chunks)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
            self.known.clear()
        for c in distinct - self.seen:
            if (i := self.words.get(c.strip(EDGES))) is not None:
                self.known[c] = i
        self.seen |= distinct
        known = self.known
        present = list({known[c] for c in distinct if c in known})
        if not present:
            return []
        possible = np.flatnonzero(self.table[:, present].sum(axis=1) >= self.least * self.sizes)
        if not len(possible):
            return []
        ids = [known.get(c, -1) for c in chunks]
        found = []
        for k in possible:
            name, template, count, need = self.templates[k]
            best = self._best(ids, template, count, need, self.marks[k])
            if best:
                found.append((name, *best))
        return sorted(found, key=lambda x: (-x[1], -self.lengths[x[0]], x[2], x[0]))

    def _best(self, ids: list[int], template: list[int], count: Counter, need: float, marks: list[list[int]]):
        n = len(template)
        own = np.array([w in count for w in ids])
        sums = np.concatenate([[0], np.cumsum(own)])
        best = None

        def tried(start: int, stop: int):
            """What a stretch gives, None if it can't reach the coverage, False if it doesn't."""
            if sums[stop] - sums[start] < need:
                return None
            stretch = ids[start:stop]
            if sum((Counter(stretch) & count).values()) < need:
                return None
            pairs = align(stretch, template)
            if len(pairs) < need or not all(beside(stretch, pairs, m) for m in marks):
                return False
            return len(pairs) / n, start + pairs[0][0], start + pairs[-1][0]

        for start in range(0, max(1, len(ids) - n), n):
            stop = min(len(ids), start + 3 * n)
            found = [tried(start, stop)]
            if found[0] is False:
                narrow, step = n + n // 2 + 1, max(1, n // 4)
                found = [tried(a, min(stop, a + narrow)) for a in range(start, max(start + 1, stop - n + 1), step)]
            for got in found:
                if got and (best is None or (-got[0], got[1]) < (-best[0], best[1])):
                    best = got
        return best


@lru_cache(maxsize=2)
def scanner(templates: tuple, least: float) -> Scanner:
    return Scanner(dict(templates), least)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id, license (of the best coverage), coverage, first_word, last_word, n_licenses, licenses (all, best first)."""
    own = tuple((TEMPLATES if templates is None else templates).items())

    def step(batches):
        reader = scanner(own, least)
        for batch in batches:
            for part in slices(batch):
                found = [reader.scan(t) for t in part.column("text").to_pylist()]
                first = [x[0] if x else (None, 0.0, None, None) for x in found]
                yield batch_of(
                    doc_id=part.column("doc_id"), license=pa.array([x[0] for x in first], pa.string()), coverage=pa.array([x[1] for x in first], pa.float64()), first_word=pa.array([x[2] for x in first], pa.int64()),
                    last_word=pa.array([x[3] for x in first], pa.int64()), n_licenses=pa.array([len(x) for x in found], pa.int32()), licenses=pa.array([", ".join(y[0] for y in x) for x in found], pa.string()),
                )

    return map_arrow(texts(docs), step, "doc_id long, license string, coverage double, first_word long, last_word long, n_licenses int, licenses string")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
