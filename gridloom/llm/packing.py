"""Best-fit packing of token sequences, bounded in space.

A fixed number of bins is open. They are keyed by their free space in a bitset, so the bin that a piece fits best is one
shift and one lowest bit away. A piece that fits nowhere opens a bin; if all are in use, the fullest closes first.

Documents longer than a sequence are cut into whole sequences, of which the first may be shorter; only what doesn't fill
a sequence needs packing. Those pieces are dealt by hash to tasks of about PER_TASK pieces, so no task grows with the
input. In a task they arrive in the order of that hash; WAITING of them are held at once, and go into the open bins the
long ones first. So a task holds OPEN bins and WAITING pieces, however many pass through it.

Null texts are empty: one piece that holds the closing id. Repeated ids are pieces of their own. An empty table gives no
rows. The result is the same on each run, as tasks order their pieces.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_letters
from gridloom.llm.common import Scratch, batch_of, map_arrow, slices, table, texts

SIZE, CLOSING = 1024, 2
#: Bins that are open at once, pieces that wait for them, and pieces that a task packs on average.
OPEN, WAITING, PER_TASK = 1 << 12, 1 << 12, 1 << 17
#: Fixed value: how this vocabulary's library splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bins:
    """Bins of one capacity that take pieces one by one."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.open, self.made = size, most, 0, 0
        self.free = 0  # bit f: a bin with f free places is open
        self.with_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """The bin that takes the piece, and the place of the piece in it."""
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} in bins of {self.size}")
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            own, room = self.made, self.size
            self.made += 1
            self.open += 1
        left = room - length
        if left:
            self.with_free[left].append(own)
            self.free |= 1 << left
        else:
            self.open -= 1
        return own, self.size - room

    def _take(self, room: int) -> int:
        own = self.with_free[room].pop()
        if not self.with_free[room]:
            self.free ^= 1 << room
        return own


def cuts(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    first = (length - 1) % size + 1
    return [(0, first), *((start, size) for start in range(first, length, size))]


@lru_cache(maxsize=2)
def coder(path: str):
    """Encodes with a byte-level vocabulary in the JSON form of the tokenizers library, as that does by default: special
    tokens' strings in a text count as those tokens. The same ranks run in tiktoken, which merges faster."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    letters = byte_letters()
    special = {x["content"]: x["id"] for x in said["added_tokens"]}
    ranks = {bytes(letters[c] for c in name): i for name, i in said["model"]["vocab"].items() if name not in special}
    fast, plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            if any(s in text for s in special):
                return np.array(fast.encode(text, allowed_special="all"), "<u4")
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except Exception:  # noqa: BLE001  its regex engine gives up on some very long runs
            return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def pieces(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def step(batches):
        encode, end = coder(path), np.array([closing], "<u4")
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.concatenate([encode(text), end])
                    rows += [(doc_id, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cuts(len(ids), size))]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield batch_of(**{k: pa.array(c, t) for k, c, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns, kinds, strict=True)})

    return map_arrow(texts(docs), step, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(rows: DataFrame, size: int = SIZE, most: int = OPEN, per_task: int = PER_TASK, waiting: int = WAITING) -> DataFrame:
    """The pieces with sequence_id and offset. ``rows`` must give the same rows each time, as a written table does."""
    short = rows.where(F.col("length") < size)
    parts = max(1, -(-short.count() // per_task))
    arrival = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = short.repartition(parts, arrival).sortWithinPartitions(arrival, "doc_id", "piece", "length", "ids_crc32")

    def step(batches):
        bins, base = Bins(size, most), TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def put(own: pa.RecordBatch) -> pa.RecordBatch:
            length, places = own.column("length").to_numpy(), np.empty((own.num_rows, 2), np.int64)
            for i in np.argsort(-length, kind="stable"):
                places[i] = bins.put(int(length[i]))
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(places[:, 0] + base), pa.array(places[:, 1])], names=[*own.schema.names, "sequence_id", "offset"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= waiting:
                own = pa.concat_batches(held)
                yield put(own.slice(0, waiting))
                held = [own.slice(waiting)]
        if sum(b.num_rows for b in held):
            yield put(pa.concat_batches(held))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    whole = rows.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return map_arrow(dealt, step, schema).unionByName(whole)


def pack(docs: DataFrame, path: str, size: int = SIZE, closing: int = CLOSING) -> DataFrame:
    return packed(Scratch(docs.sparkSession).keep(pieces(docs, path, size, closing)), size)


def op5_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), path)
