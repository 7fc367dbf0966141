"""Document fingerprints: MinHash signatures of word shingles.

A signature holds, for each of PERMUTATIONS universal hash functions, the least value over the text's shingles of five
words (a text of fewer words: its one run of all words; no words: no shingle). The fingerprint writes the low 16 bits of
each least value in hexadecimal. The likeness of two fingerprints is the share of equal places, an estimate of the
Jaccard similarity of the shingle sets; two texts without words are alike, 1.

``fingerprints`` also edits each text: its last quarter gives way to the beginning of the next text in the order of ids
(ids that are null come first, ties go by text; after the last text comes the first). The texts cross the cluster once,
ranged by id; the first text of every range is sent to the range before too, so no task sees more than its range.

``near_duplicates`` joins the signatures' bands in Spark and verifies the Jaccard similarity of what meets there.

Null texts are empty. Repeated ids are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, batch_of, map_arrow, prepare, slices, table, texts, utf8
from gridloom.llm.components import components
from gridloom.llm.words import hashes, lower, mix, shingles, spans

PERMUTATIONS, WORDS, BANDS = 128, 5, 32
NONE = np.uint32(0xFFFFFFFF)  # least value of a text without shingles

_rng = np.random.Generator(np.random.PCG64(20240607))
FACTORS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def signatures(column: pa.Array, k: int = WORDS) -> np.ndarray:
    """texts x PERMUTATIONS least hash values (32 bits)."""
    data, offsets = utf8(column)
    data = lower(data)
    starts, ends, first = spans(data, offsets)
    own, at = shingles(hashes(data, starts, ends), first, k)
    out = np.full((len(offsets) - 1, PERMUTATIONS), NONE, np.uint32)
    has = np.flatnonzero(np.diff(at))
    if len(has):
        with np.errstate(over="ignore"):
            for j in range(PERMUTATIONS):
                out[has, j] = np.minimum.reduceat(own * FACTORS[j] + TERMS[j], at[has]) >> np.uint64(32)
    return out


def written(signature: np.ndarray) -> list[str]:
    """The fingerprint strings."""
    return [row.tobytes().hex() for row in (signature & np.uint32(0xFFFF)).astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of signatures, row by row, as their fingerprints show them."""
    return ((a ^ b) & np.uint32(0xFFFF) == 0).mean(axis=1)


def edited(text: str, after: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def ranged(docs: DataFrame, parts: int) -> DataFrame:
    """part, head, doc_id, text: every row in its range of ids, and the first row of a range once more, as head, in the
    range before it (of the first range: in the last)."""
    ids = docs.select("doc_id").repartitionByRange(parts, "doc_id")

    def lowest(batches):
        found = [x for b in batches for x in [pa.compute.min(b.column(0)).as_py()] if x is not None]
        yield batch_of(low=pa.array([min(found)] if found else [], pa.int64()))

    lows = sorted(r["low"] for r in map_arrow(ids, lowest, "low long").collect())  # one number for each partition
    first = docs.select(F.count("*"), F.sum(F.col("doc_id").isNull().cast("long"))).first()
    bounds = np.array(lows, np.int64)
    nulls = bool(first[1])
    last = max(len(lows) - 1, 0)

    @F.pandas_udf("array<int>")
    def places(doc_id):
        import pandas as pd

        out = []
        for x in doc_id:
            if x is None or x != x:
                out.append([0, -last - 1])
                continue
            part = max(int(np.searchsorted(bounds, int(x), side="right")) - 1, 0)
            own = [part]
            if part < len(bounds) and bounds[part] == int(x):
                if part:
                    own.append(-part)  # head of the range before, part - 1
                elif not nulls:
                    own.append(-last - 1)
            out.append(own)
        return pd.Series(out)

    prepare(docs.sparkSession)
    placed = docs.withColumn("place", F.explode(places("doc_id")))
    return placed.select(F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place")).alias("part"), (F.col("place") < 0).alias("head"), "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranged(texts(docs), parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "head", "doc_id", "text")

    def out_of(ids: list, now: list[str], after: list[str]) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(now, after, strict=True)]
        every = signatures(pa.array([*now, after[-1]], pa.large_string()))
        other = signatures(pa.array(changed, pa.large_string()))
        # a text's successor is the next row, but for the ends of ranges, whose successor is their head
        following = every[1:].copy()
        for i in [i for i, (a, b) in enumerate(zip(after[:-1], now[1:], strict=True)) if a is not b]:
            following[i] = signatures(pa.array([after[i]], pa.large_string()))[0]
        return batch_of(
            doc_id=pa.array(ids, pa.int64()), n_chars=pa.array([len(x) for x in now], pa.int64()), edited_sha256=pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            fingerprint=pa.array(written(every[:-1])), edited_fingerprint=pa.array(written(other)), near_edited=pa.array(likeness(every[:-1], other)), near_next=pa.array(likeness(every[:-1], following)),
        )

    def step(batches):
        ids, now, after, size = [], [], [], 0
        part, pending, ended = None, None, True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "head", "doc_id", "text")]
            for p, head, doc_id, text in zip(*columns, strict=True):
                if pending is not None and p == part and not ended:
                    ids.append(pending[0])
                    now.append(pending[1])
                    after.append(text)
                    size += len(pending[1])
                if p != part:
                    part, ended = p, False
                if head:
                    ended, pending = True, None  # further heads are ties of the one that follows
                else:
                    pending = doc_id, text
                if size > 1 << 20:
                    yield out_of(ids, now, after)
                    ids, now, after, size = [], [], [], 0
        if ids:
            yield out_of(ids, now, after)

    return map_arrow(rows, step, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the text's words), bands (a hash for each of BANDS bands of the signature), places (a byte of
    each of the signature's places)."""
    rows = PERMUTATIONS // BANDS

    def step(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                signature = signatures(part.column("text")).astype(np.uint64)
                with np.errstate(over="ignore"):
                    bands = np.zeros((len(signature), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for j in range(rows):
                        bands = mix(bands * np.uint64(0x2127599BF4325C37) ^ signature[:, j::rows])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
                places = pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary())
                yield batch_of(doc_id=part.column("doc_id"), key=pa.array(keys(part.column("text")), pa.binary()), bands=flat, places=places)

    return map_arrow(texts(docs), step, "doc_id long, key binary, bands array<long>, places binary")


def keys(column: pa.Array) -> list[bytes]:
    """Equal for texts of equal words."""
    data, offsets = utf8(column)
    data = lower(data)
    starts, ends, first = spans(data, offsets)
    own = data.tobytes()
    return [hashlib.sha256(b" ".join([own[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)])).digest()[:16] for i, j in zip(first[:-1], first[1:], strict=True)]


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and the distinct shingles of the texts that are wanted (key, node): one row for each node."""

    def step(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                data, offsets = utf8(part.column("text"))
                data = lower(data)
                starts, ends, first = spans(data, offsets)
                own, at = shingles(hashes(data, starts, ends), first, WORDS)
                yield batch_of(key=pa.array(keys(part.column("text")), pa.binary()), shingles=pa.array([np.unique(own[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))

    own = texts(docs)
    own = own.join(wanted, "doc_id", "left_semi").unionByName(own.where("doc_id is null"))  # one text of each node, or few
    found = map_arrow(own, step, "key binary, shingles binary")
    return found.join(wanted, "key").select("node", "shingles").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles, each ascending, have this Jaccard similarity at least; two empty sets do."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets are as similar as that."""

    def step(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), step, "a long, b long")


def forest(names: list[int], sets: list[np.ndarray], own: list, least: float) -> list[tuple[int, int]]:
    """Links of Jaccard similarity ``least`` or more that join what such links join, breadth-first: what has been reached
    isn't compared again, and what is of one component (``own``) from the start isn't either."""
    left, out = list(range(len(names))), []
    while left:
        todo, left = [left[0]], left[1:]
        while todo and left:
            x = todo.pop()
            size = np.array([len(sets[i]) for i in left])
            common = np.add.reduceat(np.r_[np.isin(np.concatenate([sets[i] for i in left]), sets[x], assume_unique=False), 0], np.cumsum(size) - size) * (size > 0)
            near = common >= least * (len(sets[x]) + size - common)
            near |= np.array([own[i] == own[x] for i in left])
            out += [(names[i], names[x]) for i, ok in zip(left, near, strict=True) if ok and own[i] != own[x]]
            todo += [i for i, ok in zip(left, near, strict=True) if ok]
            left = [i for i, ok in zip(left, near, strict=True) if not ok]
    return out


def across(places: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a signature that is like one of another component's: ``least`` less five deviations of its estimate."""
    bound = least - 5 * np.sqrt(least * (1 - least) / PERMUTATIONS)
    out = np.zeros(len(own), bool)
    for i in range(0, len(own), 64):
        alike = (places[i : i + 64, None, :] == places[None, :, :]).mean(axis=2) >= bound
        out[i : i + 64] = (alike & (own[i : i + 64, None] != own[None, :])).any(axis=1)
    return out


def in_groups(rows: DataFrame, by: list[str], columns: list[str], one, schema: str) -> DataFrame:
    """A function of each group's columns (as lists), whose groups are bounded; ``one`` gives a batch."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def step(batches):
        at, held = None, [[] for _ in columns]
        for batch in batches:
            group = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            values = [batch.column(c).to_pylist() for c in columns]
            for i, g in enumerate(group):
                if at is not None and g != at:
                    yield one(at, *held)
                    held = [[] for _ in columns]
                at = g
                for h, v in zip(held, values, strict=True):
                    h.append(v[i])
        if at is not None:
            yield one(at, *held)

    return map_arrow(rows.select(*by, *columns).repartition(parts, *by).sortWithinPartitions(*by, "node"), step, schema)


def near_duplicates(docs: DataFrame, least: float = 0.8, together: int = 2048) -> DataFrame:
    """doc_id, component_id: the least id that links of similarity ``least`` or more reach, the row's own included.

    Signatures of BANDS bands propose: at similarity 0.8 a pair shares no band once in ten million times. Texts of equal
    words are one from the start. First every text is put to the one that comes first in most of its bands; the exact
    similarity of their shingle sets decides. Where that leaves a band's texts in several components, those whose signature
    is like one of another component's are compared exactly, breadth-first, so no group is expanded into its pairs. Over
    ``together`` texts of one band are dealt into blocks, and each two blocks meet in a task of their own.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(banded(docs))
    first = own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("places").alias("places"))
    distinct = scratch.keep(first.withColumn("node", F.monotonically_increasing_id()))  # written, so it stays
    every = distinct.select("node", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    members = scratch.keep(every.join(shared, "band"))
    often = members.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("n"))
    pairs = scratch.keep(often.groupBy("node").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head")).select(F.col("head").alias("a"), F.col("node").alias("b")))
    wanted = distinct.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "key", "node")
    sets = scratch.keep(shingle_sets(docs, scratch.keep(wanted)))
    stars = scratch.keep(verified(pairs, sets, least))
    roots = scratch.keep(components(stars, scratch))
    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    blocks = F.ceil(F.col("n") / together).cast("int")
    dealt = (
        labelled.join(mixed, "band").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "root", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    by = ["band", "low", "high"]

    def like(group, nodes, own_roots, places):
        ok = across(np.frombuffer(b"".join(places), np.uint8).reshape(len(nodes), PERMUTATIONS), np.array(own_roots), least)
        keep = np.flatnonzero(ok)
        return batch_of(
            band=pa.array([group[0]] * len(keep), pa.int64()), low=pa.array([group[1]] * len(keep), pa.int32()), high=pa.array([group[2]] * len(keep), pa.int32()),
            node=pa.array(np.array(nodes)[keep], pa.int64()), root=pa.array(np.array(own_roots)[keep], pa.int64()),
        )

    def meet(group, nodes, own_roots, held):
        found = forest(nodes, [np.frombuffer(x, np.uint64) for x in held], own_roots, least)
        return batch_of(a=pa.array([a for a, _ in found], pa.int64()), b=pa.array([b for _, b in found], pa.int64()))

    near = in_groups(dealt.join(distinct.select("node", "places"), "node"), by, ["node", "root", "places"], like, "band long, low int, high int, node long, root long")
    more = in_groups(scratch.keep(near).join(sets, "node"), by, ["node", "root", "shingles"], meet, "a long, b long")
    reps = distinct.select("node", "rep")
    roots = components(stars.unionByName(more), scratch).join(reps, "node")
    named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    known = distinct.select("key", "rep", "node").join(named, "node", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    return own.select("doc_id", "key").join(known, "key").select("doc_id", "component_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
