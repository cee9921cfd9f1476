"""Near-duplicate detection with min-max hashing.

A document's set holds its distinct 4-word shingles (64-bit hashes of them). Each of
`PERMUTATIONS` hash functions gives two signature values, the least and the greatest
hash in the set, so the signature has twice as many values as there are hash
evaluations. `BANDS` bands of `ROWS` values retrieve candidates; two documents at the
threshold of 0.8 miss each other in all bands with probability (1 - 0.8**7)**48 = 1.3e-5.
Every link is confirmed on the full sets.

Steps, each a join or an aggregate on a key:
1. Documents with equal sets form a class; one representative of a class goes on, so
   thousands of copies cost one row.
2. Classes that share a band key meet in a bucket. In each bucket the class that meets
   most others (in a group of edits, the text they come from) is the centre; only
   centre-member pairs are confirmed. No bucket is expanded into all its pairs.
3. Connected components of the confirmed links.
4. What is still apart: a class that shares a bucket, but no component, with the bucket's
   centre is compared with all classes that met there. These comparisons run in blocks of
   at most about `BLOCK_SHINGLES` shingles a side, many tasks for a large group, inside
   which one pass over a block's shingles gives a class's overlap with each set of the
   block. Only links leave a task, never pairs.
5. Components again, with the new links, and the smallest doc_id of each.

Defined results: a null or empty text, or one of white space, has an empty set and is
linked with nothing; with fewer than four words the whole sequence is the one shingle.
A row without an id is linked with nothing and kept. Repeated rows get a row each; rows
of one id with different texts are judged by their own text. Extra columns are ignored
by `report` and kept by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import UPPER_TO_LOWER, add_columns, fresh, materialize, table

SHINGLE = 4
THRESHOLD = 80  # hundredths
PERMUTATIONS, BANDS, ROWS = 168, 48, 7
# Shingles on either side of a block of comparisons: 8 MB.
BLOCK_SHINGLES = 1 << 20
# Words whose hashes a task keeps, and shingles hashed at once.
MAX_WORDS, BLOCK = 400_000, 4096

_LOWER = bytes.maketrans(*UPPER_TO_LOWER)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_PLACES = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], dtype=np.uint64)
    word = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = len(word) - SHINGLE + 1
    total = word[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        total += word[k:k + n] * _PLACES[k]
    return np.unique(_mixed(total))


class Signatures:
    """Min-max signatures, folded into one key a band."""

    def __init__(self, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        if 2 * permutations != bands * rows:
            raise ValueError("two signature values for each permutation must fill the bands")
        random = np.random.default_rng(seed)
        draw = lambda *n: random.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.flip, self.factor = draw(permutations, 1), draw(permutations, 1)
        self.fold, self.shape = draw(bands, rows), (bands, rows)

    def keys(self, found: np.ndarray) -> np.ndarray:
        """Band keys of a set. All minima come before all maxima, so the two values
        of a permutation lie in different bands."""
        least, most = None, None
        for lo in range(0, len(found), BLOCK):
            x = (found[lo:lo + BLOCK] ^ self.flip) * self.factor
            a, b = x.min(axis=1), x.max(axis=1)
            least = a if least is None else np.minimum(least, a)
            most = b if most is None else np.maximum(most, b)
        values = _mixed(np.concatenate([least, most])).reshape(self.shape)
        return _mixed((values * self.fold).sum(axis=1, dtype=np.uint64) + self.fold[:, 0]).view(np.int64)


def set_id(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key -> n_shingles, set_id and band keys (null without shingles)."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()),
              T.StructField("keys", T.ArrayType(T.LongType()))]

    def maker():
        hashes, signatures = _WordHashes(), Signatures()

        def work(texts):
            sets = [shingles(t, hashes) for t in texts]
            keys = [signatures.keys(s).tolist() if len(s) else None for s in sets]
            return [pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], type=pa.binary()),
                    pa.array(keys, type=pa.list_(pa.int64()))]

        return work

    return add_columns(docs, "text", fields, maker, keep=["doc_id", "text_key"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and the full set (hashes, ascending) for each class in `wanted` (set_id, doc_id of one member)."""
    rows = docs.join(wanted, "doc_id").select("set_id", "text")
    fields = [T.StructField("own_id", T.BinaryType()), T.StructField("members", T.ArrayType(T.LongType()))]

    def maker():
        hashes = _WordHashes()

        def work(texts):
            sets = [shingles(t, hashes) for t in texts]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            return [pa.array([set_id(s) for s in sets], type=pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    found = add_columns(rows, "text", fields, maker, keep=["set_id"])
    # An id whose rows have different texts gives other sets too: only the wanted one stays.
    return found.where(F.col("set_id") == F.col("own_id")).select("set_id", "members").dropDuplicates(["set_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of `threshold` hundredths or more."""
    left = sets.select(F.col("set_id").alias("a"), F.col("members").alias("of_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("members").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.where(100 * F.col("shared") >= threshold * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node in `links` (a, b).

    Each round takes the least label among a node's neighbours and then the label of that
    label, and is written to the shared folder: rounds grow with the logarithm of the
    longest chain, and a lost executor repeats one round at most.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = materialize(labels.join(near, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("before")), "nearer")
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(nearer.join(up, "label").select("node", F.col("up").alias("label"), "before"), "labels")
        if new.where(F.col("label") != F.col("before")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def similar_size(a, b, threshold: int = THRESHOLD):
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


class Block:
    """Sets laid out one after the other, for counting a set's overlap with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.values, self.codes = np.unique(np.concatenate(sets), return_inverse=True)

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        has = np.zeros(len(self.values), dtype=bool)
        has[place[self.values[place] == own]] = True
        return np.add.reduceat(has[self.codes], self.starts, dtype=np.int64)


def _block_links(threshold: int):
    """Links between the classes of a block that are out of their group's component and all classes of another block."""

    def work(block: pa.Table) -> pa.Table:
        out = block.column("out").to_numpy()
        ids, labels = (np.array(block.column(c).to_pylist(), dtype=object) for c in ("set_id", "label"))
        lists = block.column("members").combine_chunks()
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        a, b = [], []
        all_rows = np.flatnonzero(~out)
        if len(all_rows):
            others = Block([values[ends[r]:ends[r + 1]] for r in all_rows])
            for r in np.flatnonzero(out):
                own = values[ends[r]:ends[r + 1]]
                shared = others.overlaps(own)
                near = 100 * shared >= threshold * (len(own) + others.sizes - shared)
                for other in all_rows[near & (labels[all_rows] != labels[r])]:
                    a.append(ids[r])
                    b.append(ids[other])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return work


def links_apart(met: DataFrame, labels: DataFrame, sets, threshold: int = THRESHOLD) -> DataFrame:
    """Links between classes that met in a bucket and are in different components.

    `met`: centre, set_id, n for every class in a bucket of that centre, the centre included.
    Classes in the centre's component need no link among themselves; every other one (`out`)
    is compared with all that met there, block by block.
    """
    own = labels.select(F.col("node").alias("set_id"), "label")
    of_centre = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    rows = met.join(own, "set_id", "left").join(of_centre, "centre", "left")
    rows = rows.select("centre", "set_id", "n", F.coalesce("label", "set_id").alias("label"),
                       (F.coalesce("label", "set_id") != F.coalesce("centre_label", "centre")).alias("out"))
    rows = materialize(rows, "groups")
    blocks = lambda total: F.ceil(total / BLOCK_SHINGLES).cast("int")
    open_groups = rows.groupBy("centre").agg(
        blocks(F.sum("n")).alias("all_blocks"),
        blocks(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0))).alias("out_blocks")).where("out_blocks > 0")
    rows = materialize(rows.join(materialize(open_groups, "open"), "centre"), "open_rows")
    found = rows.join(sets(rows.select("set_id").distinct()), "set_id")
    spread = F.xxhash64("set_id")
    row = ["centre", "set_id", "label", "members"]
    every = found.select(*row, F.lit(False).alias("out"), F.pmod(spread, F.col("all_blocks")).cast("int").alias("i"),
                         F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("j"))
    outside = found.where("out").select(*row, F.lit(True).alias("out"),
                                        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"),
                                        F.pmod(spread, F.col("out_blocks")).cast("int").alias("j"))
    both = every.unionByName(outside)
    return both.groupBy("centre", "i", "j").applyInArrow(_block_links(threshold), "a binary, b binary").distinct()


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
           threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, text_key (hash of its text), n_shingles, component_id, kept."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).alias("text"))
    sketched = materialize(sketches(rows), "sketches")
    # Classes of equal sets; the least id stands for a class.
    linked = sketched.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(linked.groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("keys").alias("keys")), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "set_id", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("meets")).where("meets > 1")
    buckets = materialize(keyed.join(materialize(shared, "shared"), "key"), "buckets")

    popular = buckets.groupBy("set_id").agg(F.sum("meets").alias("popular"))
    ranked = buckets.join(popular, "set_id")
    centres = ranked.groupBy("key").agg(F.max(F.struct("popular", "set_id", "n")).alias("centre"))
    meet = buckets.join(materialize(centres.select(
        "key", F.col("centre.set_id").alias("centre"), F.col("centre.n").alias("n_centre")), "centres"), "key")
    met = materialize(meet.select("centre", "n_centre", "set_id", "n").distinct(), "met")
    pairs = met.where((F.col("set_id") != F.col("centre")) & similar_size(F.col("n"), F.col("n_centre"), threshold))
    pairs = pairs.select(F.col("set_id").alias("a"), F.col("centre").alias("b"))
    met = met.select("centre", "set_id", "n")

    texts = rows.select("doc_id", "text")

    def sets(ids: DataFrame) -> DataFrame:
        return materialize(sets_of(texts, classes.select("set_id", "doc_id").join(ids, "set_id")), "sets")

    def nodes(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("set_id")).union(of.select("b")).distinct()

    links = materialize(confirmed(pairs, sets(nodes(pairs)), threshold), "confirmed")
    labels = components(links)
    more = materialize(links_apart(met, labels, sets, threshold), "apart")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = labels.select(F.col("node").alias("set_id"), "label")
    whole = classes.select("set_id", "doc_id").join(named, "set_id")
    least = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = whole.join(least, "label").select("set_id", "component_id")
    alone = classes.select("set_id", F.col("doc_id").alias("component_id")).join(named, "set_id", "left_anti")
    ids = materialize(joined.unionByName(alone), "components")
    out = sketched.select("doc_id", "text_key", "n_shingles", "set_id").join(ids, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose document is kept: the one of the least id in each component."""
    gone = report(docs, doc_id=doc_id, text=text, threshold=threshold).where("not kept")
    id_name, key_name = fresh("gone_id", docs.columns), fresh("gone_key", docs.columns)
    gone = materialize(gone.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).distinct(), "gone")
    same = (F.col(doc_id) == F.col(id_name)) & (F.xxhash64(F.col(text)) == F.col(key_name))
    return docs.join(gone, same, "left_anti")


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents")).drop("text_key")


# By definition: every pair that shares a shingle is counted, links are followed to the end.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0) places
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
                    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) pairs
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach AS (
  SELECT doc_id AS origin, doc_id AS place FROM d
  UNION SELECT origin, b FROM reach JOIN links ON a = place
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT origin AS doc_id, min(place) AS component_id FROM reach GROUP BY origin) r
  USING (doc_id)
"""
