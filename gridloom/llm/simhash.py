"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint has 64 bits; two documents link if theirs differ in TAU bits at most. The bits lie in a ring of SEGMENTS
segments. If two fingerprints differ in TAU bits at most, some segment begins a chain of which each first l segments
differ in l * TAU / SEGMENTS bits at most, for all l (the pigeonring principle): the first not at all, the first two in one bit,
and so on. So each fingerprint is stored under its own bits of two neighbouring segments, for each of the starts, and is
looked up there under those bits and under all of their variants with one bit of the second segment changed. Pairs that
meet must hold the budgets of the longer chains before their Hamming distance is taken.

Equal fingerprints are one from the start. Meeting places that hold very many fingerprints are searched breadth-first:
what has been reached isn't compared again, so a dense group of near copies costs about its size and not its square. Each
task passes on a spanning forest, not pairs; the components of the forests follow in distributed steps.

Null and empty texts have the fingerprint zero and link to each other. Rows with repeated ids keep their own fingerprint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, batch_of, map_arrow, slices, table, texts, utf8
from gridloom.llm.components import components, local_components
from gridloom.llm.words import lower, spans

TAU, SEGMENTS, WORDS, SEED = 4, 5, 4, 42
#: Bits of each segment and where it begins.
WIDTHS = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
BEGINS = [sum(WIDTHS[:i]) for i in range(SEGMENTS)]
#: Pairs that a meeting place compares at most before it is searched breadth-first.
PAIRS = 1 << 18
#: Bytes of meeting places that a task gets on average.
TASK_BYTES = 24 << 20

_PLACE = np.dtype([("key", "<u4"), ("own", "u1"), ("f", "<u8")])
_SPREAD = np.uint64(0x0001000100010001)


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of k words joined by one space, repeats included, and the texts' offsets among them; a text of
    fewer words has one run of them all, one without words none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])  # in the words one after another, each with a space after it
    flat = np.full(at[-1], 32, np.uint8)
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = text[np.arange(int(size.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] if len(size) else 0
    word = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], count)
    last = np.minimum(word + k, np.repeat(first[1:], count))
    flat, digest = flat.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist(), strict=True)], np.uint64), offsets


def majority(h: np.ndarray, offsets: np.ndarray, most: int = 60_000) -> np.ndarray:
    """For each text, the bits set in over half of its hashes; 0 without hashes."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    n = np.diff(offsets)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    runs = -(-n[has] // most)  # counters have 16 bits, so long texts are summed in runs
    run = np.concatenate([[0], np.cumsum(runs)])
    within = np.arange(run[-1]) - np.repeat(run[:-1], runs)
    starts = np.repeat(offsets[has], runs) + within * most
    for bit in range(16):
        sums = np.add.reduceat((h >> np.uint64(bit)) & _SPREAD, starts)
        for lane in range(4):
            count = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), run[:-1])
            out[has] |= (2 * count > n[has]).astype(np.uint64) << np.uint64(16 * lane + bit)
    return out


def fingerprint(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    data = lower(data)
    return majority(*word_hashes(data, *spans(data, offsets)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed 64-bit integer."""

    def step(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                yield batch_of(doc_id=part.column("doc_id"), f=pa.array(fingerprint(part.column("text")).view(np.int64)))

    return map_arrow(texts(docs), step, "doc_id long, f long")


def segment(f: np.ndarray, i: int) -> np.ndarray:
    i %= SEGMENTS
    return (f >> np.uint64(BEGINS[i])) & np.uint64((1 << WIDTHS[i]) - 1)


def places(f: np.ndarray) -> np.ndarray:
    """The meeting places of fingerprints: each start's own one, and those with a bit of the second segment changed."""
    found = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        for bit in range(-1, WIDTHS[j]):
            row = np.empty(len(f), _PLACE)
            second = segment(f, j) if bit < 0 else segment(f, j) ^ np.uint64(1 << bit)
            row["key"] = (np.uint64(i) << np.uint64(29)) | (segment(f, i) << np.uint64(13)) | second
            row["own"], row["f"] = bit < 0, f
            found.append(row)
    return np.concatenate(found)


def close(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether pairs that meet at a start hold the budgets of all chains from there, the last of which is the distance."""
    diff, total, ok = a ^ b, np.zeros(len(a), np.int64), np.ones(len(a), bool)
    parts = np.stack([np.bitwise_count(segment(diff, i)).astype(np.int64) for i in range(SEGMENTS)])
    at = np.arange(len(a))
    for n in range(1, SEGMENTS + 1):
        total += parts[(start + n - 1) % SEGMENTS, at]
        ok &= total * SEGMENTS <= n * TAU
    return ok


def reach(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of distinct fingerprints within TAU bits, breadth-first; what is reached isn't compared again."""
    left, child, parent = f, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= TAU
            if near.any():
                new = left[near]
                left = left[~near]
                child.append(new)
                parent.append(np.full(len(new), x))
                todo += list(new)
    if not child:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(child), np.concatenate(parent)


def links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints that meet in ``rows``."""
    rows = rows[np.lexsort((1 - rows["own"], rows["key"]))]
    new = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.r_[new, len(rows)])
    own = np.add.reduceat(rows["own"].astype(np.int64), new) if len(new) else size
    found = []
    dense = own * size > PAIRS
    for g in np.flatnonzero(dense):
        found.append(reach(np.unique(rows["f"][new[g] : new[g] + size[g]])))
    meet = np.flatnonzero(~dense & (own > 0) & (size > 1))
    step = np.searchsorted(np.cumsum(own[meet] * size[meet]), np.arange(0, (own[meet] * size[meet]).sum() + 1, 1 << 22))
    for lo, hi in zip(step, [*step[1:], len(meet)], strict=True):
        g = meet[lo:hi]
        if not len(g):
            continue
        entry = np.repeat(new[g] - np.concatenate([[0], np.cumsum(size[g])[:-1]]), size[g]) + np.arange(size[g].sum())
        times, base = np.repeat(own[g], size[g]), np.repeat(new[g], size[g])
        right = np.repeat(entry, times)
        left = np.repeat(base, times) + np.arange(len(right)) - np.repeat(np.cumsum(times) - times, times)
        a, b = rows["f"][left], rows["f"][right]
        ok = (a < b) | ((a > b) & (rows["own"][right] == 0))
        a, b, start = a[ok], b[ok], (rows["key"][right[ok]] >> np.uint32(29)).astype(np.int64)
        ok = close(a, b, start)
        if ok.any():
            found.append(local_components(a[ok], b[ok]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return local_components(*(np.concatenate(x) for x in zip(*found, strict=True)))


def linked(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: a forest whose components are those of the links between the fingerprints of column f."""
    rows = distinct.count()
    each = sum(WIDTHS) + SEGMENTS
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * each * _PLACE.itemsize // TASK_BYTES)

    def deal(batches):
        held: list[np.ndarray] = []

        def out():
            every = places(np.concatenate(held))
            part = ((every["key"].astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, every = part[order], every[order]
            new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = [*new[1:], len(part)]
            return batch_of(part=pa.array(part[new].astype(np.int32)), rows=pa.array([every[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary()))

        for batch in batches:
            held.append(batch.column("f").to_numpy().view(np.uint64))
            if sum(map(len, held)) > 20_000:
                yield out()
                held.clear()
        if sum(map(len, held)):
            yield out()

    def meet(batches):
        held = [np.frombuffer(x.as_buffer(), _PLACE) for batch in batches for x in batch.column("rows")]
        a, b = links(np.concatenate(held)) if held else (np.zeros(0, np.uint64),) * 2
        yield batch_of(a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)))

    dealt = map_arrow(distinct.select("f"), deal, "part int, rows binary").repartitionById(parts, F.col("part"))
    return map_arrow(dealt.select("rows"), meet, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the least id that links reach, the row's own included."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(fingerprints(docs))
    distinct = scratch.keep(own.groupBy("f").agg(F.min("doc_id").alias("rep")))
    edges = linked(distinct, scratch)
    named = lambda side: distinct.select(F.col("f").alias(side), F.col("rep").alias(f"{side}_rep"))
    pairs = edges.join(named("a"), "a").join(named("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    roots = components(pairs.where("a is not null and b is not null"), scratch)
    known = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("f", F.coalesce("root", "rep").alias("component_id"))
    return own.join(known, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
