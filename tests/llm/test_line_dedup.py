"""Line deduplication, with the options that the query and the pipeline run with, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlens.llm import line_dedup
from tests.conftest import SF001
from tests.llm.conftest import sentence, texts as odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\v\f\r"


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def left(spark, texts, **options):
    return {r["doc_id"]: r["kept_text"] for r in line_dedup.report(docs_of(spark, texts), **options).collect()}


def parts_of(line):
    """Records of a line, as the module's text states the rule."""
    letters = f"[{line_dedup.CUT_LETTERS}] "
    out, at = [], 0
    while len(line) >= 96 and "\x01" not in line:
        ends = [re.compile(r"(?s).{48,160}?[.!?] (?=.{48})"), re.compile("(?s).{48,160}" + letters + "(?=.{48})"),
                re.compile("(?s).{160,200}?" + letters + "(?=.{48})"), re.compile("(?s).{200}(?=.{48})")]
        m = next((m for e in ends if (m := e.match(line, at))), None)
        if m is None:
            break
        out.append(m[0])
        at = m.end()
    return [*out, line[at:]]


def template(tokens, short):
    masked = tuple("<*>" if re.search("[0-9@]|://", t) else t for t in tokens)
    return (masked if 5 * masked.count("<*>") <= len(tokens) else tuple(tokens)), short


def records(text):
    """(first line, last line, part or -1, template) of every record of a text."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if len(line.strip(" ")) < 12:
            continue
        for k, part in enumerate(parts_of(line)):
            yield i, i, k, template(WORD.findall(part), len(part.strip(" ")) < 48)
    plain = [(i, WORD.findall(x)) for i, x in enumerate(lines) if WORD.search(x)]
    size = lambda t: len(" ".join(t))
    for j in range(len(plain)):
        for step in (1, -1):
            span, k = [], j
            while 0 <= k < len(plain) and size(plain[k][1]) < 48 and sum(size(t) + 1 for _, t in span) <= 48:
                span.append(plain[k])
                k += step
            if sum(size(t) + 1 for _, t in span) > 48:
                span.sort()
                yield span[0][0], span[-1][0], -1, template([t for _, ts in span for t in ts], False)


def brute(texts):
    ids, times = {}, {}
    for d, t in texts.items():
        for *_, key in records(t or ""):
            ids.setdefault(key, set()).add(d)
            times[key] = times.get(key, 0) + 1
    out = {}
    for d, t in texts.items():
        lines, parts = set(), {}
        for at, last, part, key in records(t or ""):
            if min(ids[key]) < d and (not key[1] or times[key] >= 10):
                if part < 0:
                    lines.update(range(at, last + 1))
                else:
                    parts.setdefault(at, set()).add(part)
        left = []
        for i, line in enumerate((t or "").split("\n")):
            rest = "".join(p for k, p in enumerate(parts_of(line)) if k not in parts.get(i, ())) if i in parts else line
            if i not in lines and (i not in parts or WORD.search(rest)):
                left.append(rest)
        out[d] = "\n".join(left) if lines or parts else t or ""
    return out


def test_equals_brute_force(spark, small):
    """The registered query's options, over a whole table."""
    want = brute(small)
    assert left(spark, small) == want
    assert sum(want[d] != (t or "") for d, t in small.items()) > 5


def test_equals_brute_force_on_mixed_records(spark):
    rnd = random.Random(4)
    words = ["alpha", "b", "cc", "delta", "e5", "x@y.z", "fox", "gamma", "7", "http://h", "tab\tbed", "two  gaps", "h", "ice."]
    stock = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 9, 12, 60]))) for _ in range(25)]
    texts = {d: "".join(rnd.choice(stock) + rnd.choice(["\n", ". ", "! ", "\n\n", " "]) for _ in range(rnd.randint(0, 9))) for d in range(60)}
    texts[61] = texts[3] + "\x01 odd\x01 marks\n" + stock[-1]
    assert left(spark, texts) == brute(texts)


def test_text_that_no_other_document_has_stays(spark):
    numbers = lambda k: " ".join(map(str, range(k, k + 25)))
    texts = {1: "He said that he would not go home. The company was founded in 1998 by two brothers.",
             2: "He said that he would like some tea. The company was founded in 1874 as railway supplier.",
             3: f"{numbers(1)}\n{numbers(31)}", 4: f"{numbers(61)}\n{numbers(1)}"}
    got = left(spark, texts)
    assert got[1] == texts[1] and got[2] == texts[2] and got[3] == texts[3]
    assert got[4] == numbers(61)


def test_dropped_records_agree_with_an_earlier_one(spark, small):
    """Every dropped record has four fifths of its tokens, in place, in a record of an earlier document."""
    got, seen = left(spark, small), {}
    for d, t in sorted(small.items()):
        for *_, (tokens, _) in records(t or ""):
            if tokens in seen:
                assert sum(t != "<*>" for t in tokens) >= 0.8 * len(tokens)
            seen.setdefault(tokens, d)
    assert any(got[d] != (t or "") for d, t in small.items())


def test_templates_with_variable_fields(spark):
    notice = "Build number {} finished on host alpha after a long night of waiting"
    texts = {i: f"{sentence(i, 60)}\n{notice.format(i * 17)}\n{sentence(i + 30, 50)}" for i in range(1, 8)}
    passage = sentence(90, 60)
    texts |= {i: f"{sentence(i + 60, 80)} {passage} {sentence(i + 120, 20)}" for i in range(11, 15)}
    got = left(spark, texts)
    assert [i for i in texts if "finished on host" in got[i]] == [1]
    assert [i for i in texts if passage in got[i]] == [11]
    assert all(sentence(i, 60) in got[i] and sentence(i + 30, 50) in got[i] for i in range(1, 8))


def test_leaf_and_key_tell_templates_apart_together(spark, monkeypatch):
    """Records that differ in their leading tokens or in their count alone share a key and have leaves of their own."""
    tail = "of the old house by the river was sold again in spring to people from town"
    bodies = [f"The red roof {tail}", f"Our big barn {tail}", f"Our big barn {tail} 12", f"Our big barn {tail} 7 8", f"Our big barn {tail} 9",
              f"Our big barn {tail} again"]
    rows = spark.createDataFrame([(i, b, False) for i, b in enumerate(bodies)], "doc_id long, body string, short boolean")
    found = {r["doc_id"]: (r["key"], r["leaf"]) for r in line_dedup.with_template(rows).collect()}
    assert len({found[i][0] for i in range(5)}) == 1 and found[5][0] != found[0][0]
    assert len({found[i][1] for i in range(4)}) == 4 and found[4] == found[2] and found[5][1] == found[2][1]
    texts = dict(enumerate(bodies, 1))
    want = {**texts, 5: ""}
    assert left(spark, texts) == want == brute(texts)
    # Without the tree, text that no other document has would go.
    plain = line_dedup.with_template
    monkeypatch.setattr(line_dedup, "with_template", lambda rows: plain(rows).withColumn("leaf", F.lit(0).cast("bigint")))
    assert left(spark, texts) != want


def test_passages_inside_lines(spark):
    """A passage of 100 words inside longer lines loses most of its words wherever it starts, and no other word goes."""
    rnd = random.Random(12)
    words = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) + rnd.choice(["", "", "", "", "", "", "."]) for _ in range(n)]
    plain = lambda n: [w.rstrip(".") for w in words(n)]
    for make in (words, plain):
        passage = make(100)
        texts = {1: " ".join(make(11) + passage + make(9)) + "\nodd\x01 marks"}
        for k in range(1, 25):
            texts[1 + k] = f"{' '.join(make(12))}\n" + " ".join(make(k) + passage + make(30)) + f".\nx\x01y\x02 {k}\n"
        got, own = left(spark, texts), set(passage)
        assert got[1] == texts[1]
        stay = [sum(w in own for w in got[i].split()) for i in texts if i > 1]
        assert sum(stay) < 0.4 * 100 * len(stay) and sum(n < 50 for n in stay) >= 0.75 * len(stay)
        for i in texts:
            assert i == 1 or [w for w in got[i].split() if w not in own] == [w for w in texts[i].split() if w not in own]
            assert got[i].count("\n") == texts[i].count("\n")


def test_short_records(spark):
    """A passage in lines of 3 to 5 words goes wherever it stands; a single short line if it recurs ten times."""
    verse = "\n".join(sentence(90 + i, 3 + i % 3)[:-1] for i in range(8)) + "\n"
    texts = {i: f"{sentence(i, 4)}\n{sentence(i + 10, 2 + i)}\n{verse}\n{sentence(i + 20, 30)}\nAll rights reserved.\n{sentence(i + 30, 20)}"
             for i in range(1, 6)}
    got = left(spark, texts)
    assert got[1] == texts[1]
    assert all(got[i] == texts[i].replace(verse, "") for i in range(2, 6))
    texts |= {i: f"{sentence(i, 30)}\nAll rights reserved.\n{sentence(i + 40, 20)}\nThanks.\n{sentence(i + 80, 20)}" for i in range(6, 13)}
    got = left(spark, texts)
    assert [i for i in texts if "All rights" in got[i]] == [1] and all("Thanks." in got[i] for i in range(6, 13))


def test_confirmed_copies_stay_for_the_next_stage(spark):
    shared, short = sentence(3, 30), "\n".join(f"{sentence(40 + i, 6)}" for i in range(20))
    texts = {1: f"{shared}\n{sentence(5, 40)}", 2: f"{short}\n{shared}", 4: f"{sentence(9, 50)}\n{sentence(11, 50)}"}
    texts[3] = texts[1]
    texts[5] = texts[4] + "\none more line"
    texts[6] = f"{sentence(9, 50)}\n{sentence(13, 20)}"
    want = {1: texts[1], 2: short + "\n", 3: texts[1], 4: texts[4], 5: texts[5], 6: sentence(13, 20)}
    want[2] = short
    assert left(spark, texts, confirm=line_dedup.CONFIRM) == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs_of(spark, texts), SF001).collect()} == want
    assert left(spark, texts) == {**want, 3: "", 5: "one more line"}


@pytest.mark.parametrize("rows", [0, 10**6])
def test_many_copies_of_one_source_are_dealt_to_blocks(spark, monkeypatch, rows):
    """Their ids broadcast, and beyond that many joined by a shuffle."""
    monkeypatch.setattr(line_dedup, "COPIES_IN_BLOCK", 3)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    source = "\n".join(sentence(i, 20) for i in range(4))
    texts = {i: source + f"\nown line {i}" for i in range(20)}
    assert left(spark, texts, confirm=line_dedup.CONFIRM) == texts


@pytest.mark.parametrize("confirm", [None, line_dedup.CONFIRM])
def test_odd_rows(odd_docs, no_docs, confirm):
    found = line_dedup.report(odd_docs, confirm=confirm)
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in odd_texts())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r["kept_text"])
    base = odd_texts()[0][1]
    assert by_id[1] == [base, base] and sorted(by_id[None]) == ["", base] and by_id[2] == by_id[3] == [""]
    assert by_id[5] == [base if confirm else ""]
    assert line_dedup.report(no_docs, confirm=confirm).count() == 0
    kept = line_dedup.drop_recurring(odd_docs, confirm=confirm)
    assert kept.schema == odd_docs.schema and kept.where("rest_0 <> 'x'").count() == 0
    assert sum(r["doc_id"] == 5 for r in kept.collect()) == (confirm is not None)
