"""Best-fit packing of token sequences by minimum bin slack.

Three passes over pieces of documents:

1. Documents are encoded and cut where they are longer than a sequence, the shorter piece
   first. A task numbers its pieces by length as it meets them; pieces are written once.
2. Pieces are counted by length. The counts (at most `capacity` numbers, whatever the input)
   are all that packing needs, since pieces of one length are interchangeable. `fill` makes
   bins: the longest piece left opens one; a subset-sum over the lengths left, as bitsets of
   reachable sums, finds the fullest feasible combination with it; the combination is taken
   as often as the counts allow. A combination has at most sqrt(2 * capacity) different
   lengths, and using one up leaves fewer of a length than it takes, so there are at most
   capacity * (1 + ln capacity) combinations: a table whose size the input does not change.
3. Each piece looks up its bin: its number among all pieces of its length lies in the run of
   numbers that a combination took, which names sequence and offset. Numbers are the task's
   own plus a running total over tasks, so no task sees all pieces of a common length.

Ids come from a byte-level BPE tokenizer file (a parameter), read on the driver and broadcast.

Defined results: a null or empty text is its end id alone; a null id stays; repeated rows are
packed each; a document of any length is cut, never dropped; an empty table gives an empty
one; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.bpe import byte_symbols
from barlens.llm.common import Shared, cuts, materialize, table

CAPACITY = 2048
END_ID = 0


class ByteRules:
    """Ranks, special strings and split pattern of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        spec = json.loads(self.file)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] \
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not the kind of tokenizer that this encoder reads")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(byte_of[s] for s in token): i for token, i in spec["model"]["vocab"].items()
                      if token not in self.special}
        self.pattern = pattern

    def encoder(self):
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special)

        def encode(text: str) -> np.ndarray:
            try:
                return coder.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                # A run of white space too long for its split; the file's own library has no such limit.
                from tokenizers import Tokenizer

                whole = Tokenizer.from_str(self.file).encode(text, add_special_tokens=False)
                return np.array(whole.ids, dtype=np.uint32)

        return encode


def rules_of(path: str | None = None, pattern: str | None = None) -> ByteRules:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    return ByteRules(path, pattern)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                      T.StructField("part", T.LongType()), T.StructField("nth", T.LongType())])


def encoded_pieces(docs: DataFrame, rules: ByteRules, *, doc_id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and (part, nth), its number among the task's pieces
    of that length. With `ids`, the token ids as well."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + PIECE.fields
                          + ([T.StructField("ids", T.ArrayType(T.LongType(), False))] if ids else []))
    sent = Shared(docs.sparkSession, rules)

    def run(batches):
        encode = sent.get().encoder()
        part, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for lo, hi in cuts(batch.column(1)):
                rows = batch.slice(lo, hi - lo)
                made, whose = [], []
                for i, body in enumerate(rows.column(1).to_pylist()):
                    found = np.append(encode(body or ""), end_id).astype("<u4")
                    for k, (start, n) in enumerate(pieces_of(len(found), capacity)):
                        taken = found[start:start + n]
                        made.append((k, start, n, zlib.crc32(taken.tobytes()), part, met[n]) + ((taken.tolist(),) if ids else ()))
                        met[n] += 1
                        whose.append(i)
                columns = [pa.array(c, t) for c, t in zip(zip(*made), [pa.int32()] + [pa.int64()] * 5 + [pa.list_(pa.int64())] * ids)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(whose))] + columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of at most `counts` pieces of each length with the greatest sum up to `room`.

    Bit s of a bitset stands for sum s. Lengths come longest first, each as often as it is
    there and fits, and the bitset before each length is kept to read the combination back.
    """
    full, reached, stages = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        stages.append((n, reached))
        left, step = min(counts[n], room // n), 1
        while left > 0:
            take = min(step, left)
            reached |= reached << (take * n)
            left -= take
            step *= 2
        reached &= full
        if reached >> room:
            break
    total, chosen = reached.bit_length() - 1, {}
    for n, before in reversed(stages):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            chosen[n] = k
    return chosen


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, combination) until no piece is left."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, out = sorted(left, reverse=True), []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        chosen = fullest(left, lengths, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
        out.append((times, chosen))
        lengths = [n for n in lengths if left[n]]
    return out


class Places:
    """For each length, the runs of piece numbers that combinations took."""

    def __init__(self, bins: list[tuple[int, dict[int, int]]]):
        used: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first_bin = 0
        for times, chosen in bins:
            offset = 0
            for n in sorted(chosen, reverse=True):
                k = chosen[n]
                runs.setdefault(n, []).append((used.get(n, 0), k, first_bin, offset))
                used[n] = used.get(n, 0) + times * k
                offset += n * k
            first_bin += times
        self.runs = {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}

    def of(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces of one length."""
        first, each, first_bin, offset = self.runs[length]
        run = np.searchsorted(first, numbers, side="right") - 1
        within = numbers - first[run]
        return first_bin[run] + within // each[run], offset[run] + within % each[run] * length


def pack(docs: DataFrame, *, rules: ByteRules | None = None, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset: one row a piece."""
    spark = docs.sparkSession
    found = encoded_pieces(docs, rules or rules_of(), doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, ids=ids)
    # Written once: a task's numbers hold only as long as they are those of one run of the task.
    found = materialize(found, "pieces")
    counted = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Shared(spark, Places(fill(counts, capacity)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])
    numbered = found.join(before, ["length", "part"]).select(*kept, (F.col("before") + F.col("nth")).alias("number"))
    schema = T.StructType([found.schema[c] for c in kept]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        where = places.get()
        for batch in batches:
            length, number = (np.asarray(batch.column(i)) for i in (3, batch.num_columns - 1))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    sequence[at], offset[at] = where.of(int(length[at[0]]), number[at])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))]
                                             + [pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.mapInArrow(place, schema)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
