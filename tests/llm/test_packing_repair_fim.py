"""Packing, conversation repair and fill-in-middle against brute force, the library's ids and round trips."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlens.llm import conversation_repair as repair
from barlens.llm import fim, packing
from tests.conftest import SF001
from tests.llm.conftest import texts


def docs_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


# ------------------------------------------------------------------ packing
def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by_sequence)


def test_packed_pieces_are_the_librarys_ids(spark, odd_docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    extra = [(50, "a<|endoftext|>b <|endoftext|> c"), (51, " " * 3000), (52, "x" + " " * 400_000 + "y"), (53, "\x85  \x1c z\r\n")]
    docs = odd_docs.select("doc_id", "text").union(docs_of(spark, extra))
    out = packing.pack(docs, ids=True).collect()
    check_sequences(out, packing.CAPACITY)
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in [*texts(), *extra])
    pieces = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in out)
    cut = sorted((i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), ids[s:s + n])
                 for i, ids in want for k, (s, n) in enumerate(packing.pieces_of(len(ids), packing.CAPACITY)))
    assert pieces == cut
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_of():
    assert packing.pieces_of(5, 4) == [(0, 1), (1, 4)]
    assert packing.pieces_of(8, 4) == [(0, 4), (4, 4)]
    assert packing.pieces_of(3, 4) == [(0, 3)]
    assert packing.pieces_of(1, 4) == [(0, 1)]


def test_fullest_is_the_best_combination():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 40)
        best = max(s for ks in itertools.product(*[range(c + 1) for c in counts.values()])
                   if (s := sum(k * n for k, n in zip(ks, counts))) <= room)
        found = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for n, k in found.items()) == best
        assert all(0 < k <= counts[n] for n, k in found.items())


def test_fill_uses_every_piece_and_few_bins():
    rnd = random.Random(2)
    for capacity in (20, 2048):
        for _ in range(20):
            counts = {}
            for _ in range(500):
                n = min(capacity, 1 + int(rnd.expovariate(4 / capacity)))
                counts[n] = counts.get(n, 0) + rnd.choice([1, 1, 1, 1000])
            bins = packing.fill(counts, capacity)
            used = {}
            for times, chosen in bins:
                assert sum(n * k for n, k in chosen.items()) <= capacity
                for n, k in chosen.items():
                    used[n] = used.get(n, 0) + times * k
            assert used == counts
            total = sum(n * c for n, c in counts.items())
            assert sum(t for t, _ in bins) <= -(-total // capacity) * 1.01 + 1
            assert len(bins) <= capacity * (1 + np.log(capacity))


def test_fill_is_the_optimum_on_small_sets():
    rnd = random.Random(3)

    def optimum(items):
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[k] <= 10:
                    place(k + 1, bins[:b] + [bins[b] + items[k]] + bins[b + 1:])
            place(k + 1, [*bins, items[k]])

        place(0, [])
        return best

    worse = 0
    for _ in range(60):
        items = sorted((rnd.randint(1, 10) for _ in range(8)), reverse=True)
        counts = {n: items.count(n) for n in items}
        got, want = sum(t for t, _ in packing.fill(counts, 10)), optimum(items)
        assert want <= got <= want + 1
        worse += got > want
    assert worse <= 3


def test_hot_length_is_numbered_without_gaps(spark):
    docs = docs_of(spark, [(i, "same text" if i % 3 else f"other {i}") for i in range(3000)]).repartition(7)
    out = packing.pack(docs, capacity=16).collect()
    n = check_sequences(out, 16)
    lengths = [r["length"] for r in out]
    assert len(out) == 3000 and max(map(lengths.count, set(lengths))) >= 2000
    assert n == sum(times for times, _ in packing.fill({k: lengths.count(k) for k in set(lengths)}, 16))


# ------------------------------------------------------- conversation repair
def brute(turns):
    """Least (cost, audit, lines) over all actions, with up to two turns inserted anywhere."""
    seen, rows = set(), []
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        rows.append((role, text, blank or again, 3 if cut and not blank and not again else 0))
    valid = re.compile(r"(s?(ua)+)?\Z")
    inserts = [list(x) for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    partial = re.compile(r"s?(ua)*u?\Z")
    ways = [(0, "", ())]
    for role, text, must_go, extra in rows:
        after = []
        for cost, audit, lines in ways:
            for more in inserts:
                base = (cost + 3 * len(more), audit + "I" * len(more), lines + tuple((r, "") for r in more))
                after.append((base[0] + 4, base[1] + "D", base[2]))
                if not must_go:
                    after.append((base[0] + extra, base[1] + "K", base[2] + ((role, text),)))
                    after += [(base[0] + 3 + extra, base[1] + "R", base[2] + ((r, text),)) for r in ("user", "assistant")]
        ways = [w for w in set(after) if partial.match("".join(r[:1] or "-" for r, _ in w[2]))]
        least = min(w[0] for w in ways)
        ways = [w for w in ways if w[0] <= least + 14]
    ends = [(c + 3 * len(m), a + "I" * len(m), lines + tuple((r, "") for r in m)) for c, a, lines in ways for m in inserts]
    cost, audit, lines = min(w for w in ends if valid.match("".join(r[:1] or "-" for r, _ in w[2])))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_repair_is_the_cheapest(spark):
    rnd = random.Random(5)
    convs, rows = {}, []
    for c in range(150):
        turns = [(rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""]),
                  rnd.choice(["Yes.", "No!", "cut off", " \n", "So? \t", f"{c} {i}."])) for i in range(rnd.randint(1, 5))]
        convs[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    found = repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in found.collect()}
    assert got == {c: brute(turns) for c, turns in convs.items()}


def test_repaired_turns_read_as_the_grammar(spark):
    turns = repair.damaged(spark.read.parquet(f"{SF001}/conversations.parquet")).where("not lost").drop("lost")
    found = repair.report(turns)
    out = {}
    for r in repair.repaired(turns, found).collect():
        out.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    for r in found.collect():
        lines = sorted(out.get(r["conv_id"], []))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in lines))
        assert [p for p, *_ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest() == r["repaired_sha256"]


def test_long_conversation_streams():
    parser = repair.Parser()
    now, n = repair.Repair(parser), 60_000
    for i in range(n):
        now.take(i, "user", f"{i}.", False)
    out = now.result()
    # Every other user turn becomes the assistant's; nothing is cheaper.
    assert out[5] == 3 * n // 2 and len(out[6]) == n and set(out[6]) == {"K", "R"}
    assert parser.step.cache_info().currsize < 50


def test_repair_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, None, None), (None, None, None, None), (None, 5, "user", "A."),
            (2, 0, "user", "Gone.")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    out = {r["conv_id"]: r for r in repair.report(turns, lost=F.coalesce(F.col("conv_id"), F.lit(0)) == 2).collect()}
    assert tuple(out[1])[1:8] == (0, 1, 1, 0, 2, 11, "KDDI")
    assert tuple(out[None])[1:8] == (0, 1, 0, 0, 1, 7, "DKI")
    assert tuple(out[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(turns.limit(0)).count() == 0


# ----------------------------------------------------------- fill-in-middle
def plain_fim(key, text, seed=1):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_its_definition(spark, odd_docs):
    rnd = random.Random(7)
    some = [(100 + i, "".join(rnd.choice(["ab", "Z", " ", "é", "😀", "<", "P", ">", "<S", "1", "\n"]) for _ in range(rnd.randint(0, 12))))
            for i in range(400)]
    docs = odd_docs.select("doc_id", "text").union(docs_of(spark, some))
    out = fim.restore(fim.transform(docs)).collect()
    want = sorted(str((i, *plain_fim("" if i is None else i, t or ""))) for i, t in [*texts(), *some])
    assert sorted(str((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out) == want
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in out)
    assert all(r["restored_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(i), t or "") for i, t in [*texts(), *some])
    assert fim.transform(docs.limit(0)).count() == 0 and fim.restore(fim.transform(docs.limit(0))).count() == 0


def test_piece_table_cuts_and_permutes_without_copying():
    doc = fim.PieceTable(b"abcdef")
    for at in (2, 4, 0, 6):
        doc.cut(at)
    assert doc.text() == b"abcdef" and sum(n for *_, n in doc.pieces) == 6
    order = (3, 1, 0, 2, 4)
    moved = doc.arranged(order)
    assert moved.arranged(fim.inverse(order)).pieces == doc.pieces
    assert moved.sha256() == hashlib.sha256(moved.text()).hexdigest()


def test_outputs_of_another_form_are_refused():
    with pytest.raises(ValueError):
        fim.restored(b"<S>x<P>y<M>z", "psm")
    with pytest.raises(ValueError):
        fim.restored(b"<P>x<M>z", "psm")


def test_fim_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in fim.transform(docs, keep=("lang",)).collect()}
    assert out[1]["lang"] == "en" and out[2]["lang"] is None and out[2]["form"] == "plain"
    with pytest.raises(ValueError):
        fim.transform(docs.withColumn("n", F.lit(1)), keep=("n",))
