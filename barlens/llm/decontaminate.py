"""Benchmark decontamination with a generalised suffix automaton.

The items' normalised words form one automaton, or more where they have over `MAX_BLOCK_WORDS`
words: items are dealt to blocks of about that size, and a task builds a block's automaton and
writes it. Blocks then take turns: one is broadcast, the documents pass it, what it
hits is written, and it is released before the next. Each document's words run
through it; the length of the longest match that ends at each word shows which
windows of the items occur. A window is `window` consecutive words of an item; an
item with fewer words, but not none, is one window.

Before the automaton runs, one vectorised test over a slice of documents finds
the runs of word pairs that items have at all. A window can only lie inside such
a run, so nothing is lost and most words never reach Python code.

Defined results: a null or empty text has no words and is never contaminated; a
null or empty item has no window; items that share an id are one item; a null
item id is written as the empty string; repeated documents each get their row; no
benchmark rows mean no hits. Extra columns of either table are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import add_columns, as_bytes, fresh, materialize, table

# Words of the items in one broadcast automaton: about 100 MB of Python objects.
MAX_BLOCK_WORDS = 200_000

# A-Z to a-z; every ASCII byte that is no digit or letter becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """All factors of a block of items, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        # Items by the state and length of their windows.
        self.ends: dict[int, dict[int, set[str]]] = {}
        pairs = set()
        for item, ids in coded:
            size = min(window, len(ids))
            state = matched = 0
            for i, c in enumerate(ids):
                state, matched = self.step(state, matched, c)
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if i + 1 >= size:
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(item)
            pairs.update(zip(ids, ids[1:], strict=False))
        n = max(1, len(self.vocabulary))
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), dtype=np.int64)
        # For each state the nearest state at or above it by suffix links that ends a window.
        self.nearest = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.ends else self.nearest[self.link[state]]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the part of q that p reaches by c; q itself if that is all of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return self._split(last, c, known)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read, with c, that is a factor of an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (to, matched + 1) if to is not None else (0, 0)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words [lo, hi) long enough for a window, all of whose pairs items have."""
        if not self.shortest or not len(ids):
            return []
        known = ids >= 0
        key = ids[:-1].astype(np.int64) * max(1, len(self.vocabulary)) + ids[1:]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = (self.pairs[place] == key) & known[:-1] & known[1:]
        else:
            joined = np.zeros(len(key), dtype=bool)
        starts = np.flatnonzero(known & np.concatenate(([True], ~joined)))
        stops = np.flatnonzero(known & np.concatenate((~joined, [True]))) + 1
        long = stops - starts >= self.shortest
        return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))

    def windows(self, ids: list[int], offset: int):
        """(first word, end, items) of every window that occurs in a run."""
        state = matched = 0
        for i, c in enumerate(ids):
            state, matched = self.step(state, matched, c)
            at = self.nearest[state]
            while at > 0:
                for size, items in self.ends[at].items():
                    if size <= matched:
                        yield offset + i + 1 - size, offset + i + 1, items
                at = self.nearest[self.link[at]]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Union of [lo, hi) ranges, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def match_texts(texts: list[bytes | None], automata: list[SuffixAutomaton]):
    """For each text: number of words, merged hit ranges, ids of the items that occur."""
    words, ends = [], []
    for text in texts:
        words.extend(words_of(text))
        words.append(b"")
        ends.append(len(words))
    hits: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    bounds = np.array(ends)
    for automaton in automata:
        get = automaton.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int32)
        for lo, hi in automaton.runs(ids):
            doc = int(np.searchsorted(bounds, lo, side="right"))
            for a, b, found in automaton.windows(ids[lo:hi].tolist(), lo):
                if hits[doc] and a <= hits[doc][-1][1] and hits[doc][-1][0] <= a:
                    hits[doc][-1][1] = max(hits[doc][-1][1], b)
                else:
                    hits[doc].append([a, b])
                items[doc] |= found
    out, start = [], 0
    for i, end in enumerate(ends):
        out.append((end - 1 - start, [[a - start, b - start] for a, b in merged(hits[i])], items[i]))
        start = end
    return out


def automata_of(benchmark: DataFrame, id_col: str, text_col: str, window: int,
                block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """block, automaton (pickled): the items in blocks of about `block_words` words, each built in a task of its own.

    Items are dealt by hash, equal ones once; a single longer item makes its block longer.
    """
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    rows = rows.where("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+", -1)))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))

    def build(group: pa.Table) -> pa.Table:
        items = sorted(zip(group.column("item").to_pylist(), group.column("text").to_pylist()))
        made = SuffixAutomaton([(i, words_of(t.encode())) for i, t in items], window)
        return pa.table({"block": group.column("block")[:1], "automaton": [cloudpickle.dumps(made)]})

    return dealt.groupBy("block").applyInArrow(build, "block long, automaton binary")


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_FOUND = pa.struct([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def passed(docs: DataFrame, text: str, automaton, name: str, keep: list[str]) -> DataFrame:
    """`keep` columns of `docs` and the struct `name` of what the broadcast `automaton` (None: no items) finds in each text."""
    def maker():
        automata = [] if automaton is None else [cloudpickle.loads(automaton.value)]

        def work(texts):
            rows = [{"n_words": n, "hit_spans": spans, "items": sorted(items)} for n, spans, items in match_texts(texts, automata)]
            return [pa.array(rows, type=_FOUND)]

        return work

    return add_columns(docs, text, [T.StructField(name, FOUND)], maker, keep=keep)


def matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = 13, keep: list[str] | None = None,
            block_words: int = MAX_BLOCK_WORDS) -> tuple[DataFrame, str]:
    """`keep` columns of `docs` (default all) and a struct column, whose name is returned too:
    n_words, hit_spans (merged word ranges, end exclusive) and items (distinct ids, as strings, sorted).

    With one block of items that is a narrow pass over the documents. With more, each block's pass writes
    its hits by text, and the documents are joined with the hits of all blocks.
    """
    name = fresh("found", docs.columns)
    spark = docs.sparkSession
    kept = list(docs.columns if keep is None else keep)
    stored = materialize(automata_of(benchmark, item_id, item_text, window, block_words), "automata")
    numbers = sorted(r[0] for r in stored.select("block").collect())
    load = lambda k: spark.sparkContext.broadcast(bytes(stored.where(F.col("block") == k).first()["automaton"]))
    if len(numbers) <= 1:
        return passed(docs, text, load(numbers[0]) if numbers else None, name, kept), name
    keys = [F.xxhash64("text").alias("key"), F.hash("text").alias("check")]
    texts = docs.select(F.col(text).alias("text")).where("text is not null")
    hits = None
    for k in numbers:
        block = load(k)
        found = passed(texts, "text", block, "found", ["text"]).where(F.size("found.items") > 0)
        found = materialize(found.select(*keys, "found.hit_spans", "found.items").dropDuplicates(["key", "check"]), "hits")
        block.destroy()
        hits = found if hits is None else hits.unionByName(found)
    # At most a row a block for each text.
    hits = hits.groupBy("key", "check").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"),
                                            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    other = [c for c in docs.columns if c in kept and c != text]
    renamed = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in other]).alias("rest"))
    joined = renamed.withColumns({"key": F.xxhash64("text"), "check": F.hash("text")}).join(hits, ["key", "check"], "left")
    joined = joined.select("rest", "hit_spans", "items", "text")
    out = T.StructType([T.StructField("rest", joined.schema["rest"].dataType), T.StructField("text", T.StringType()), T.StructField(name, FOUND)])

    def union(batches):
        for batch in batches:
            rows = [{"n_words": len(words_of(t)), "hit_spans": merged(spans or []), "items": items or []} for t, spans, items in zip(
                as_bytes(batch.column(3)), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(rows, type=_FOUND)], names=out.names)

    found = joined.mapInArrow(union, out)
    return found.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`") for c in kept], name), name


def n_hit(found: str):
    return F.aggregate(F.col(found)["hit_spans"], F.lit(0).cast("bigint"), lambda acc, x: acc + x[1] - x[0])


def is_contaminated(found: str, coverage: int = 20):
    """Some word is hit, and at least one word in `coverage`."""
    return (n_hit(found) > 0) & (n_hit(found) * coverage >= F.col(found)["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
           window: int = 13, coverage: int = 20, **options) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated, hit_spans, items."""
    found, name = matches(docs, benchmark, text=text, window=window, keep=[doc_id], **options)
    items = F.col(name)["items"]
    return found.select(
        F.col(doc_id).alias("doc_id"),
        F.col(name)["n_words"].alias("n_words"),
        n_hit(name).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        is_contaminated(name, coverage).alias("contaminated"),
        F.col(name)["hit_spans"].alias("hit_spans"),
        items.alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 13,
                  coverage: int = 20, **options) -> DataFrame:
    """`docs` without the documents of which items cover at least one word in `coverage`."""
    found, name = matches(docs, benchmark, text=text, window=window, **options)
    return found.where(~is_contaminated(name, coverage)).drop(name)


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = 13,
              coverage: int = 20, max_length: int | None = None, **options) -> DataFrame:
    """`docs` with the hit words taken out of their texts, whole documents kept.

    A range goes if it has more than `max_length` words or the document's hit words
    exceed one in `coverage`. The text around a range stays as it is.
    """
    found, name = matches(docs, benchmark, text=text, window=window, **options)
    limit = -1 if max_length is None else max_length
    spans = F.when(is_contaminated(name, coverage), F.col(name)["hit_spans"]).when(
        F.lit(limit >= 0), F.filter(F.col(name)["hit_spans"], lambda x: x[1] - x[0] > limit)
    ).otherwise(F.array().cast("array<array<bigint>>"))
    # Words by position: the pieces between them are kept, the words of a range are not.
    pattern = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    gaps, words = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    inside = lambda i: F.exists(spans, lambda s: (s[0] <= i) & (i < s[1]))
    rest = F.transform(gaps, lambda g, i: F.concat(
        F.when((i > 0) & inside(i) & inside(i - 1), F.lit("")).otherwise(g),
        F.when(inside(i), F.lit("")).otherwise(F.coalesce(F.get(words, i), F.lit("")))))
    new = F.when(F.size(spans) > 0, F.concat_ws("", rest)).otherwise(F.col(text))
    return found.withColumn(text, new).drop(name)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p
        FROM (SELECT *, least(13, len(w)) AS size FROM i WHERE len(w) > 0) sized) places
), found AS (
  SELECT rid, p, size, item FROM (
    SELECT rid, p, size, array_to_string(w[p:p + size - 1], ' ') AS k
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p
          FROM d CROSS JOIN (SELECT DISTINCT size FROM windows) sizes) places) doc_windows
  JOIN windows USING (size, k)
), hit AS (
  SELECT rid, count(DISTINCT word) AS n_hit
  FROM (SELECT rid, unnest(range(p, p + size)) AS word FROM found) words GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM found) pairs GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def brute_force(doc: str | None, items: list[tuple[str, str | None]], window: int = 13):
    """The definition, word by word: for tests."""
    words = words_of((doc or "").encode())
    hit, found = set(), set()
    for item, text in items:
        own = words_of((text or "").encode())
        size = min(window, len(own))
        wanted = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if size else ():
            if tuple(words[i:i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add(item)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)
