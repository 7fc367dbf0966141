"""Removal of passages that occur in an earlier document, by suffix sorting to a fixed depth.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id; strings are judged on
the input and never cross documents. No machine holds the corpus' suffix array, and most suffixes are unlike all others.
So suffixes that can be equal are brought together first:

1. Texts are kept in chunks of about CHUNK bytes. In each window of LENGTH bytes the gram of GRAM bytes with the least
   hash (the leftmost of several) is its anchor; equal windows have equal anchors at equal places. Tasks learn which
   anchors occur in two different texts, one entry for each anchor and chunk.
2. Only for those anchors, each chunk sends the bytes of the windows that share the anchor, equal ones once.
3. A task that holds all contexts of an anchor sorts the suffixes of the unlike ones by bucket-pointer refinement: buckets
   of equal q-grams are refined by sorting on the bucket identifiers found q bytes later, which doubles the depth, up to
   LENGTH. Each bucket's least id decides; windows of later documents are marked.
4. Each chunk unites the marked windows and cuts them out.

Whole copies of a text are found by digest beforehand and take no part. A passage that very many documents share comes to
a task once from each chunk, so a hot passage costs a task as many rows as there are chunks.

Null texts are empty. Null ids count as greater than all others; rows of the same id don't remove each other's bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.llm.common import Scratch, batch_of, map_arrow, table
from gridloom.llm.words import hashes, mix

LENGTH, GRAM, CHUNK = 50, 20, 1 << 20
WINDOW = LENGTH - GRAM + 1
#: Bytes that a task gets on average where anchors meet, and the bytes of text whose contexts meet in a task.
TASK_BYTES, CONTEXT_BYTES = 24 << 20, 8 << 20
NO_ID = np.iinfo(np.int64).max
_LOW, _48 = np.uint64(0xFFFFFFFF), np.uint64((1 << 48) - 1)


def chunks(docs: DataFrame, carried: list[str]) -> DataFrame:
    """chunk, ids, offsets, tags (two 64-bit halves of a digest for each text), data (texts one after another), rest: the
    carried columns as an Arrow stream."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried)

    def step(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int, bytes]] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def out():
            nonlocal made, size
            ids = np.array([NO_ID if i is None else i for i, _ in held], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in held])]).astype(np.int64)
            tags = b"".join(xxhash.xxh3_128_digest(t) for _, t in held)
            row = batch_of(chunk=pa.array([base + made], pa.int64()), ids=pa.array([ids.tobytes()], pa.binary()), offsets=pa.array([offsets.tobytes()], pa.binary()), tags=pa.array([tags], pa.binary()), data=pa.array([b"".join(t for _, t in held)], pa.binary()), rest=pa.array([stream(rest)], pa.binary()))
            made, size = made + 1, 0
            held.clear()
            rest.clear()
            return row

        for batch in batches:
            text, others, begin = batch.column("text").cast(pa.binary()).to_pylist(), batch.select(carried), 0
            for i, (doc_id, own) in enumerate(zip(batch.column("doc_id").to_pylist(), text, strict=True), 1):
                held.append((doc_id, own))
                size += len(own) + 16
                if size >= CHUNK:
                    rest.append(others.slice(begin, i - begin))
                    begin = i
                    yield out()
            if begin < batch.num_rows:
                rest.append(others.slice(begin))
        if held:
            yield out()

    return map_arrow(rows, step, "chunk long, ids binary, offsets binary, tags binary, data binary, rest binary")


def stream(batches: list[pa.RecordBatch]) -> bytes:
    if not batches or not batches[0].num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on; the last GRAM - 1 places have none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    eight = np.empty(len(data) + GRAM, np.uint64)  # eight bytes from each place on
    for k in range(8):
        part = wide[k : k + (len(wide) - k) // 8 * 8].view("<u8")
        eight[k::8] = part[: len(eight[k::8])]
    out, spare = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, GRAM, 8):
            if GRAM - k >= 8:
                out ^= eight[k : k + n]
            else:
                out ^= np.bitwise_and(eight[k : k + n], np.uint64((1 << 8 * (GRAM - k)) - 1), out=spare)
            for factor, shift in ((0x9E3779B97F4A7C15, 32), (0xD6E8FEB86659FD93, 29)):
                out *= np.uint64(factor)
                out ^= np.right_shift(out, np.uint64(shift), out=spare)
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor, place of the document."""
    h = grams(data)
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), none
    # the least of the first 32 bits of the hashes, the leftmost of equal ones, its place in the last 32 bits
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    place = (low[:n] & _LOW).astype(np.int64)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:  # windows that would cross into the next text
        inside[max(0, end - LENGTH + 1) : end] = False
    change = np.r_[True, (place[1:] != place[:-1])] | np.r_[True, ~inside[:-1]]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(np.r_[change[1:] | ~inside[1:], True] & inside) + 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    return first, stop - first, h[place[first]], doc


def parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The task where an anchor meets its like. Anchors have small hashes, so their bits are spread anew."""
    return ((mix(h) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def cuts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]), len(sorted_keys)] if len(sorted_keys) else np.zeros(1, np.int64)


def alike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes and only for those: spans of equal hashes are compared."""
    key = hashes(data, starts, starts + sizes)
    _, head, group = np.unique(key, return_index=True, return_inverse=True)
    head = head[group]
    other = np.flatnonzero(head != np.arange(len(key)))
    if not np.array_equal(sizes[other], sizes[head[other]]) or not _same(data, starts[other], starts[head[other]], sizes[other]):
        _, group = np.unique(np.array([data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)], object), return_inverse=True)
    return group


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    step = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, 1 << 22))
    for lo, hi in zip(step, [*step[1:], len(a)], strict=True):
        n = sizes[lo:hi]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(data[np.repeat(a[lo:hi], n) + within], data[np.repeat(b[lo:hi], n) + within]):
            return False
    return True


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def refined(data: np.ndarray, windows: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """A bucket identifier for each of the suffixes at ``windows``, equal if and only if ``depth`` bytes agree: bucket-
    pointer refinement. data must reach ``depth`` bytes beyond each window."""
    if not len(windows):
        return np.zeros(0, np.int64)
    q = min(8, depth)
    wanted, plan = q, []
    while wanted < depth:
        shift = min(wanted, depth - wanted)
        plan.append(shift)
        wanted += shift
    # the places whose identifiers a step needs: the windows, and what later steps read from them
    wanted_at = np.zeros(len(data) + 1, bool)
    wanted_at[windows] = True
    need = [wanted_at]
    for shift in reversed(plan):
        more = need[-1].copy()
        more[shift:] |= need[-1][: len(more) - shift]
        need.append(more)
    here = need.pop()
    at = np.flatnonzero(here)
    word = np.zeros(len(at), np.uint64)
    for k in range(q):
        word = (word << np.uint64(8)) | data[at + k]
    bucket = np.unique(word, return_inverse=True)[1]
    for shift in plan:
        index = np.cumsum(here) - 1  # of a place among those that have identifiers
        here = need.pop()
        at = np.flatnonzero(here)
        first, later = bucket[index[at]], bucket[index[at + shift]]
        # a bucket of one stays as it is; the others are split by the identifiers of the later offsets
        several = np.bincount(first)[first] > 1
        bucket = np.empty(len(at), np.int64)
        bucket[~several] = np.arange((~several).sum())
        bucket[several] = np.unique(first[several] * (later.max(initial=0) + 1) + later[several], return_inverse=True)[1] + (~several).sum()
    return bucket[(np.cumsum(here) - 1)[windows]]


class Chunk:
    """A chunk's texts, the runs of windows that take part, and which of them hold the same bytes."""

    def __init__(self, ids: bytes, offsets: bytes, data: bytes, copies: np.ndarray, only: np.ndarray):
        self.ids, self.offsets, self.data = np.frombuffer(ids, np.int64), np.frombuffer(offsets, np.int64), np.frombuffer(data, np.uint8)
        first, count, key, doc = anchors(self.data, self.offsets)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[copies] = True
        keep = ~self.copy[doc]
        only, low = np.sort(only), key & _48
        keep &= (only[np.minimum(np.searchsorted(only, low), len(only) - 1)] == low) if len(only) else False
        self.first, self.count, self.key = first[keep], count[keep], key[keep]
        self.id = self.ids[doc[keep]]
        self.group = alike(self.data, self.first, self.count + LENGTH - 1)
        order = np.lexsort((self.first, self.id, self.group))
        self.heads = order[cuts_of(self.group[order])[:-1]]  # of each group the run of the least id, the first of several


def short(x: np.ndarray) -> np.ndarray:
    """The low 48 bits as six bytes each. With the bits that chose the task they tell anchors apart; two that fall together
    only send contexts that turn out unlike."""
    return np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def longer(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view("<u8")[:, 0]


def shared_anchors(kept: DataFrame, parts: int) -> DataFrame:
    """chunk, kind 0, what: for each chunk the hashes of those of its anchors that occur in two different texts."""

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("chunk", "offsets", "tags", "data")}
                _, _, key, doc = anchors(np.frombuffer(row["data"], np.uint8), np.frombuffer(row["offsets"], np.int64))
                tag = np.maximum(np.frombuffer(row["tags"], np.uint64)[::2] & _48, np.uint64(1))[doc]
                order = np.argsort(key, kind="stable")
                key, tag = key[order], tag[order]
                new = cuts_of(key)
                if len(key):
                    low, high = np.minimum.reduceat(tag, new[:-1]), np.maximum.reduceat(tag, new[:-1])
                    key, tag = key[new[:-1]], np.where(low == high, low, np.uint64(0))  # 0: texts that differ
                part = parts_of(key, parts)
                order = np.argsort(part, kind="stable")
                part, key, tag = part[order], key[order], tag[order]
                new = cuts_of(part)
                entry = np.column_stack([short(key), short(tag)])
                yield batch_of(part=pa.array(part[new[:-1]]), chunk=pa.array([row["chunk"]] * (len(new) - 1), pa.int64()), rows=pa.array([entry[a:b].tobytes() for a, b in zip(new[:-1], new[1:], strict=True)], pa.binary()))

    def meet(batches):
        chunk, held = [], []
        for batch in batches:
            chunk += batch.column("chunk").to_pylist()
            held += [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 12) for x in batch.column("rows")]
        if not held:
            return
        rows = np.concatenate(held)
        key, tag = longer(rows[:, :6]), longer(rows[:, 6:])
        order = np.argsort(key, kind="stable")
        new = cuts_of(key[order])
        low, high = np.minimum.reduceat(tag[order], new[:-1]), np.maximum.reduceat(tag[order], new[:-1])
        several = (low != high) | (low == 0)
        is_shared = np.empty(len(key), bool)
        is_shared[order] = np.repeat(several, np.diff(new))
        at = 0
        for c, x in zip(chunk, held, strict=True):
            found = key[at : at + len(x)][is_shared[at : at + len(x)]]
            at += len(x)
            if len(found):
                yield batch_of(chunk=pa.array([c], pa.int64()), what=pa.array([found.tobytes()], pa.binary()))

    dealt = map_arrow(kept.select("chunk", "offsets", "tags", "data"), deal, "part int, chunk long, rows binary").repartitionById(parts, F.col("part"))
    return map_arrow(dealt.select("chunk", "rows"), meet, "chunk long, what binary").select("chunk", F.lit(0).alias("kind"), "what")


def copies(kept: DataFrame) -> DataFrame:
    """chunk, kind 1, what: for each chunk the places of texts that a row with a smaller id holds too."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, tags = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64), batch.column("tags")[i].as_py()
                yield batch_of(chunk=pa.array([batch.column("chunk")[i].as_py()] * len(ids), pa.int64()), place=pa.array(np.arange(len(ids)), pa.int32()), id=pa.array(ids), tag=pa.array([tags[k : k + 16] for k in range(0, len(tags), 16)], pa.binary()))

    rows = map_arrow(kept.select("chunk", "ids", "tags"), each, "chunk long, place int, id long, tag binary")
    least = rows.groupBy("tag").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    found = rows.join(least, "tag").where("id > least").groupBy("chunk").agg(F.collect_list("place").alias("places"))

    def write(batches):
        for batch in batches:
            what = [np.array(x, np.int32).tobytes() for x in batch.column("places").to_pylist()]
            yield batch_of(chunk=batch.column("chunk"), what=pa.array(what, pa.binary()))

    return map_arrow(found, write, "chunk long, what binary").select("chunk", F.lit(1).alias("kind"), "what")


def with_notes(kept: DataFrame, notes: DataFrame, how: str) -> DataFrame:
    """Each chunk with what is noted for it, as one list; the chunks are stored by number and aren't moved."""
    noted = notes.groupBy("chunk").agg(F.collect_list(F.struct("kind", "what")).alias("notes"))
    return kept.join(noted.hint("shuffle_hash"), "chunk", how)  # the chunks pass by, their notes are the hashed side


def of_kind(notes: list | None, kind: int, dtype) -> np.ndarray:
    found = [np.frombuffer(x["what"], dtype) for x in notes or [] if x["kind"] == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype)


_MASK = np.dtype([("first", "<i8"), ("mask", "<u8")])


def marked_windows(kept: DataFrame, notes: DataFrame, parts: int) -> DataFrame:
    """chunk, kind 2, what: the first window of runs in a chunk, and which of the run's windows go, as bits."""

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("chunk", "ids", "offsets", "data", "notes")}
                own = Chunk(row["ids"], row["offsets"], row["data"], of_kind(row["notes"], 1, np.int32), of_kind(row["notes"], 0, np.uint64))
                part = parts_of(own.key[own.heads], parts)
                order = np.argsort(part, kind="stable")
                part, heads = part[order], own.heads[order]
                new = cuts_of(part)
                runs = []
                for a, b in zip(new[:-1], new[1:], strict=True):
                    h = np.sort(heads[a:b])
                    runs.append(packed(own.key[h], own.id[h], own.first[h], own.count[h], own.data[ranges(own.first[h], own.count[h] + LENGTH - 1)]))
                yield batch_of(part=pa.array(part[new[:-1]]), chunk=pa.array([row["chunk"]] * (len(new) - 1), pa.int64()), runs=pa.array(runs, pa.binary()))

    def meet(batches):
        chunk, held = [], []
        for batch in batches:
            chunk += batch.column("chunk").to_pylist()
            held += [unpacked(x.as_py()) for x in batch.column("runs")]
        if not chunk:
            return
        key, doc, first, count, data = (np.concatenate(x) for x in zip(*held, strict=True))
        ns = [len(x[0]) for x in held]
        held.clear()
        mask = judged_in_runs(key, doc, count, data)
        at = 0
        for c, n in zip(chunk, ns, strict=True):
            own = mask[at : at + n]
            hit = np.flatnonzero(own)
            if len(hit):
                out = np.empty(len(hit), _MASK)
                out["first"], out["mask"] = first[at + hit], own[hit]
                yield batch_of(chunk=pa.array([c], pa.int64()), what=pa.array([out.tobytes()], pa.binary()))
            at += n

    dealt = map_arrow(with_notes(kept, notes, "inner"), deal, "part int, chunk long, runs binary").repartitionById(parts, F.col("part"))
    return map_arrow(dealt.drop("part"), meet, "chunk long, what binary").select("chunk", F.lit(2).alias("kind"), "what")


def packed(key: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, data: np.ndarray) -> bytes:
    """Runs of windows as compressed bytes."""
    body = [np.int64(len(key)).tobytes(), key.tobytes(), doc.tobytes(), first.astype("<u8").tobytes(), count.astype(np.uint8).tobytes(), data.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpacked(run: bytes) -> tuple[np.ndarray, ...]:
    body = zstandard.ZstdDecompressor().decompress(run)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    key, doc, first = (np.frombuffer(body, t, n, 8 + 8 * n * k) for k, t in enumerate((np.uint64, np.int64, np.int64)))
    return key, doc, first, np.frombuffer(body, np.uint8, n, 8 + 24 * n).astype(np.int64), np.frombuffer(body, np.uint8, -1, 8 + 25 * n)


def judged_in_runs(key: np.ndarray, doc: np.ndarray, count: np.ndarray, data: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """``judged``, some anchors at a time, so that sorting takes memory for about ``most`` bytes."""
    out = np.zeros(len(key), np.uint64)
    size = count + LENGTH - 1
    starts = np.cumsum(size) - size
    order = np.argsort(key, kind="stable")
    new = cuts_of(key[order])
    before = np.concatenate([[0], np.cumsum(size[order])])[new]  # bytes before each anchor
    runs = np.r_[np.flatnonzero(np.diff(before[:-1] // most, prepend=-1) > 0), len(new) - 1] if len(key) else np.zeros(1, np.int64)
    for a, b in zip(new[runs[:-1]], new[runs[1:]], strict=True):
        own = np.sort(order[a:b])
        out[own] = judged(key[own], doc[own], count[own], data[ranges(starts[own], size[own])])
    return out


def judged(key: np.ndarray, doc: np.ndarray, count: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each run, which windows occur in a document with a smaller id; data: the runs' bytes one after another."""
    size = count + LENGTH - 1
    starts = np.cumsum(size) - size
    group = alike(data, starts, size)
    order = np.lexsort((doc, group))
    new = cuts_of(group[order])
    head = order[new[:-1]]
    least = np.empty(len(key), np.int64)
    least[order] = np.repeat(doc[head], np.diff(new))
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    mask = np.where(doc > least, full, np.uint64(0))
    # anchors with several unlike contexts: their windows are sorted
    by_key = head[np.argsort(key[head], kind="stable")]
    new = cuts_of(key[by_key])
    several = by_key[np.repeat(np.diff(new) > 1, np.diff(new))]
    if len(several):
        windows = ranges(starts[several], count[several])
        order = np.argsort(windows)
        bucket = np.empty(len(windows), np.int64)
        bucket[order] = refined(data, windows[order])
        run = np.repeat(several, count[several])
        lowest = np.full(bucket.max() + 1, NO_ID)
        np.minimum.at(lowest, bucket, doc[run])
        goes = lowest[bucket] < doc[run]
        bit = windows - starts[run]
        found = np.zeros(len(key), np.uint64)
        np.bitwise_or.at(found, run[goes], np.uint64(1) << bit[goes].astype(np.uint64))
        of_group = np.zeros(group.max() + 1, np.uint64)
        of_group[group[head]] = found[head]
        own = of_group[group]
        mask |= np.where(doc == least, own, np.uint64(0))
    return mask


def covered(own: Chunk, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of the chunk goes."""
    goes = np.zeros(len(own.data) + 1, np.int32)

    def mark(starts, lengths):
        np.add.at(goes, starts, 1)
        np.add.at(goes, starts + lengths, -1)

    if len(own.first):
        head = np.empty(own.group.max() + 1, np.int64)
        head[own.group[own.heads]] = own.heads
        head = head[own.group]
        later = own.id > own.id[head]
        mark(own.first[later], own.count[later] + LENGTH - 1)
        order = np.argsort(masks["first"])
        if len(order):
            place = np.minimum(np.searchsorted(masks["first"][order], own.first[head]), len(order) - 1)
            mask = np.where(masks["first"][order][place] == own.first[head], masks["mask"][order][place], np.uint64(0))
            for bit in range(WINDOW):
                hit = (mask >> np.uint64(bit)) & np.uint64(1) == 1
                mark(own.first[hit] + bit, LENGTH)
    for i in np.flatnonzero(own.copy):
        if own.offsets[i + 1] - own.offsets[i] >= LENGTH:
            goes[own.offsets[i]] += 1
            goes[own.offsets[i + 1]] -= 1
    return np.cumsum(goes[:-1]) > 0


def cut(docs: DataFrame, whole_letters: bool = False, carried: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), and the carried columns for every row.

    With ``whole_letters`` kept is text: a letter of several bytes of which some would go stays whole.
    """
    carried = carried or []
    hidden = [f"_carried_{i}" for i in range(len(carried))]  # their own names may clash with the result's
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = scratch.keep_bucketed(chunks(docs, carried), "chunk", buckets)
    total = kept.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    parts = max(buckets, int(total * 2 / WINDOW * 12) // TASK_BYTES)
    notes = scratch.keep(shared_anchors(kept, parts).unionByName(copies(kept)))
    masks = marked_windows(kept, notes, max(buckets, int(total) // CONTEXT_BYTES)).unionByName(notes)

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "offsets", "data", "notes", "rest")}
                own = Chunk(row["ids"], row["offsets"], row["data"], of_kind(row["notes"], 1, np.int32), of_kind(row["notes"], 0, np.uint64))
                gone = covered(own, of_kind(row["notes"], 2, _MASK))
                out = results(own, gone, whole_letters)
                if carried:
                    rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                    out = pa.RecordBatch.from_arrays([*out.columns, *(c.chunk(0) for c in rest.columns)], names=[*out.schema.names, *hidden])
                yield out

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if whole_letters else "binary"))
    fields = [StructField(h, docs.schema[c].dataType) for h, c in zip(hidden, carried, strict=True)]
    return map_arrow(with_notes(kept, masks, "left"), step, StructType([*schema.fields, *fields]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the rest of their texts and all their columns; n_chars, if there, counts what is left. Documents
    of which nothing is left go; those that were empty before stay as they are."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = cut(docs, whole_letters=True, carried=carried)
    columns = {c: F.col(f"_carried_{i}") for i, c in enumerate(carried)}
    columns |= {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")}
    if "n_chars" in carried:
        columns["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return out.where("kept <> '' or n_removed = 0").select(*(columns[c].alias(c) for c in docs.columns))


def results(own: Chunk, gone: np.ndarray, whole_letters: bool) -> pa.RecordBatch:
    if whole_letters:
        inner = (own.data & 0xC0) == 0x80
        letter = np.cumsum(~inner) - 1 if len(gone) else np.zeros(0, np.int64)
        partly = np.bincount(letter[~gone], minlength=len(gone) + 1) > 0
        gone = gone & ~partly[letter]
    begins = gone & np.r_[True, ~gone[:-1]] if len(gone) else gone
    cell = own.offsets[:-1][np.diff(own.offsets) > 0]
    begins[cell] = gone[cell]
    rows: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
    for a, b in zip(own.offsets[:-1], own.offsets[1:], strict=True):
        here = gone[a:b]
        n = int(here.sum())
        left = own.data[a:b].tobytes() if not n else own.data[a:b][~here].tobytes()
        rows["n_removed"].append(n)
        rows["n_spans"].append(int(begins[a:b].sum()))
        rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        rows["kept"].append(left.decode() if whole_letters else left)
    ids = pa.array(own.ids, mask=own.ids == NO_ID)
    return batch_of(doc_id=ids, n_bytes=pa.array(np.diff(own.offsets)), n_removed=pa.array(rows["n_removed"], pa.int64()), n_spans=pa.array(rows["n_spans"], pa.int64()), kept_sha256=pa.array(rows["kept_sha256"], pa.string()), kept=pa.array(rows["kept"], pa.string() if whole_letters else pa.binary()))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents")).drop("kept")
