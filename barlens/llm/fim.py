"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, length) over immutable buffers: the
text's UTF-8 bytes and one buffer of sentinels. It starts as one descriptor; two cuts split
it into prefix, middle and suffix; an arrangement permutes these and the sentinels'
descriptors. Digests take the descriptors' bytes one after the other, and the text of the
output is put together once, where a column of it is asked for. `restore` finds the sentinels
in an output, makes descriptors over it, and applies the inverse permutation.

    plain  the text
    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Cuts lie between units, `[A-Za-z]+|[^A-Za-z]` from left to right. Their places, and the
form, come from a digest of seed and document id alone, so every run and every retried task
makes the same output. The units of a slice of texts are found at once, as a mask over its bytes.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, is plain;
a null id is hashed as the empty string; repeated rows are transformed alike; very long texts
are sliced alone; an empty table gives an empty one; extra columns are ignored, or kept with
`keep` (names that clash with a result's are refused).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import add_columns, as_bytes, cuts, table

SEED = 1
# Sentinels, and the order of prefix, middle, suffix (0 to 2) and the sentinels (3 to 5) in an output.
SENTINELS = (b"<P>", b"<S>", b"<M>")
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
# Percent of the documents left plain, and of the others those in spm order.
PLAIN_FROM, SPM_BELOW = 90, 20


class PieceTable:
    """Descriptors over immutable buffers; no step copies text."""

    def __init__(self, *buffers: bytes, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [(0, 0, len(buffers[0]))] if pieces is None else pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte `at` of the document in two; an end may be empty."""
        seen = 0
        for i, (b, start, n) in enumerate(self.pieces):
            if at <= seen + n and (at < seen + n or i == len(self.pieces) - 1):
                k = at - seen
                self.pieces[i:i + 1] = [(b, start, k), (b, start + k, n - k)]
                return
            seen += n

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(*self.buffers, pieces=[self.pieces[i] for i in order])

    def views(self):
        return (self.buffers[b][start:start + n] for b, start, n in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.views())


SENTINEL_BUFFER = b"".join(SENTINELS)
SENTINEL_PIECES = [(1, sum(map(len, SENTINELS[:k])), len(s)) for k, s in enumerate(SENTINELS)]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for place, piece in enumerate(order):
        out[piece] = place
    return tuple(out)


def arrange(text: bytes, lo: int, hi: int, form: str) -> PieceTable:
    """The output of a text cut at bytes lo and hi."""
    doc = PieceTable(text, SENTINEL_BUFFER)
    if form == "plain":
        return doc
    doc.cut(lo)
    last = doc.pieces.pop()
    rest = PieceTable(text, pieces=[last])
    rest.cut(hi - lo)
    doc.pieces += rest.pieces + SENTINEL_PIECES
    return doc.arranged(FORMS[form])


def restored(output: bytes, form: str) -> PieceTable:
    """The document of an output: descriptors over it, put back by the inverse permutation."""
    if form == "plain":
        return PieceTable(output)
    order, pieces, at = FORMS[form], [], 0
    marks = [i - 3 for i in order if i >= 3]
    for k, mark in enumerate(marks):
        found = output.find(SENTINELS[mark], at) if k else 0
        if not output.startswith(SENTINELS[mark], max(found, 0)) or found < 0:
            raise ValueError(f"not an output of form {form}")
        if k:
            pieces.append((0, at, found - at))
        pieces.append((0, found, len(SENTINELS[mark])))
        at = found + len(SENTINELS[mark])
    pieces.append((0, at, len(output) - at))
    return PieceTable(output, pieces=[pieces[i] for i in inverse(order)[:3]])


def drawn(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document id."""
    return tuple(int.from_bytes(part, "big") for part in _quarters(
        hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()))


def _quarters(digest: bytes):
    return (digest[0:4], digest[4:8], digest[8:12], digest[12:16])


class Units:
    """Units and characters of a list of texts, as masks over their joined bytes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        letter = ((data | 32) - 97).astype(np.uint8) < 26
        self.first = (data & 0xC0) != 0x80
        start = self.first.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[self.at[:-1][self.at[:-1] < self.at[1:]]] = True
        self.starts = np.flatnonzero(start)
        self.unit_at = np.searchsorted(self.starts, self.at)

    def count(self, i: int) -> int:
        return int(self.unit_at[i + 1] - self.unit_at[i])

    def byte_of(self, i: int, unit: int) -> int:
        """Where unit number `unit` of text i starts in it; its end, for the number of units."""
        k = self.unit_at[i] + unit
        return int((self.starts[k] if k < self.unit_at[i + 1] else self.at[i + 1]) - self.at[i])

    def chars(self, i: int, lo: int, hi: int) -> int:
        return int(np.count_nonzero(self.first[self.at[i] + lo:self.at[i] + hi]))


RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                       T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                       T.StructField("output_sha256", T.StringType()), T.StructField("output", T.StringType())])


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
              plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns of `keep`, n (units), form, prefix_chars, middle_chars, output_sha256, output."""
    kept = ["doc_id", *keep]
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [docs.schema[c] for c in keep] + RESULT.fields)
    if len({c.lower() for c in schema.names}) < len(schema.names):
        raise ValueError("a kept column has the name of a result")

    def one(units: Units, i: int, key, body: bytes):
        n = units.count(i)
        h1, h2, h3, h4 = drawn(key, seed)
        if not body or any(s in body for s in SENTINELS) or h3 % 100 >= plain_from:
            out = arrange(body, 0, 0, "plain")
            return n, "plain", None, None, out.sha256(), out.text()
        lo, hi = (units.byte_of(i, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < spm_below else "psm"
        out = arrange(body, lo, hi, form)
        return n, form, units.chars(i, 0, lo), units.chars(i, lo, hi), out.sha256(), out.text()

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            last = batch.num_columns - 1
            for lo, hi in cuts(batch.column(last)):
                part = batch.slice(lo, hi - lo)
                texts = [t or b"" for t in as_bytes(part.column(last))]
                units = Units(texts)
                made = [one(units, i, key, body) for i, (key, body) in enumerate(zip(part.column(0).to_pylist(), texts))]
                columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(last)] + columns, names=schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), *[F.col(f"`{c}`") for c in keep],
                       F.col(text).alias("_text")).mapInArrow(run, schema)


def restore(outputs: DataFrame, *, output: str = "output", form: str = "form", keep: list[str] | None = None) -> DataFrame:
    """`outputs` with the exact text of each output and its digest (text, restored_sha256), from output and form alone."""
    both = outputs.withColumn("_both", F.concat(F.coalesce(form, F.lit("plain")), F.lit("\n"), F.coalesce(output, F.lit(""))))
    fields = [T.StructField("text", T.StringType()), T.StructField("restored_sha256", T.StringType())]

    def maker():
        def work(texts):
            tables = [restored(out, kind.decode()) for kind, out in (t.split(b"\n", 1) for t in texts)]
            return [pa.array([t.text() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables])]
        return work

    kept = [c for c in (outputs.columns if keep is None else keep) if c not in ("text", "restored_sha256")]
    return add_columns(both, "_both", fields, maker, keep=kept)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restore(out, keep=kept).select(*kept, "restored_sha256")


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:n], '') AS suffix
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
