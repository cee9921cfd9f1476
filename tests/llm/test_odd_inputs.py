"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barlens.llm import (bpe, chat, decontaminate, licenses, line_dedup, near_dedup, pii, quality, secrets, toxicity)
from tests.llm.conftest import sentence, texts

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (9, 0, 1), (9, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(10, sentence(1, 30)), (11, None), (12, ""), (12, "one two"), (None, sentence(3, 14))], "item_id long, text string")


def operators(spark, labels, items):
    none = labels.limit(0)
    return {
        "op1": lambda d: secrets.scan(d),
        "op2": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "op2 without labels": lambda d: toxicity.score(d, toxicity.train(d, none)),
        "op4": lambda d: licenses.report(d),
        "op5": lambda d: pii.scan(d),
        "op6": lambda d: decontaminate.report(d, items),
        "op6 without items": lambda d: decontaminate.report(d, items.limit(0)),
        "op7": lambda d: near_dedup.report(d),
        "op8": lambda d: bpe.encode(d),
        "op9": lambda d: quality.report(d, quality.train(d, labels)),
        "op9 without labels": lambda d: quality.report(d, quality.train(d, none)),
        "op10": lambda d: line_dedup.report(d),
    }


NAMES = sorted(operators(None, __import__("types").SimpleNamespace(limit=lambda n: None), None))


@pytest.mark.parametrize("name", NAMES)
def test_every_row_gets_a_result(spark, odd_docs, no_docs, labels, items, name):
    run = operators(spark, labels, items)[name]
    found = run(odd_docs)
    assert sorted(map(str, (r[0] for r in found.select("doc_id").collect()))) == sorted(str(i) for i, _ in texts())
    assert run(no_docs).count() == 0


STAGES = {
    "quality": lambda d, labels, items: quality.keep_good(d, quality.train(d, labels.limit(0))),
    "lines": lambda d, labels, items: line_dedup.drop_recurring(d, confirm=line_dedup.CONFIRM),
    "near": lambda d, labels, items: near_dedup.deduplicate(d),
    "benchmark": lambda d, labels, items: decontaminate.decontaminate(d, items),
    "cut": lambda d, labels, items: decontaminate.cut_spans(d, items),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_the_columns(odd_docs, no_docs, labels, items, name):
    out = STAGES[name](odd_docs, labels, items)
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    assert out.where(F.col("rest_0") != "x").count() == 0
    assert STAGES[name](no_docs, labels, items).count() == 0


def ids(df):
    return sorted(str(r[0]) for r in df.select("doc_id").collect())


def test_stage_decisions(odd_docs, labels, items):
    out = {n: ids(f(odd_docs, labels, items)) for n, f in STAGES.items()}
    assert out["quality"] == ["1", "1", "5", "7", "None"]
    # Rows without an id are left alone; repeated rows of one document go together; 5 and 7 are like 1.
    assert out["near"] == sorted(["1", "1", "2", "3", "4", "6", "8", "9", "None", "None"])
    # Copies as a whole are for near-duplicate detection.
    assert out["lines"] == sorted(str(i) for i, _ in texts())
    assert out["benchmark"] == sorted(["2", "3", "4", "6", "9", "None"])
    assert out["cut"] == sorted(str(i) for i, _ in texts())


def test_whole_pipeline_on_odd_rows(spark, odd_docs, labels, items, scratch):
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{scratch}/documents.parquet")
    labels.write.parquet(f"{scratch}/labels.parquet")
    items.where("item_id = 12").write.parquet(f"{scratch}/benchmark.parquet")
    out = corpus_pipeline.run(spark, scratch)
    assert ids(out) == ["1", "1", "None"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "bpe"]


def test_chat_odd_rows(spark):
    kind = f"conv_id long, turn long, role string, text string, parts {chat.PARTS}, formatted string"
    part = [("text", "see <|image|> \\b ", None, 0), ("image", None, "a.png", 2), ("odd", "x", None, None),
            ("document", None, None, None)]
    rows = [(1, 0, "user", None, part, "x"), (1, 1, "assistant", None, None, "x"), (1, 1, "assistant", None, [], "x"),
            (None, None, None, None, None, "x"), (2, 0, "us\ner\\n", "", [("text", "\n<|im_end|>\\p", None, 0)], "x")]
    turns = spark.createDataFrame(rows, kind)
    out = {r["conv_id"]: r for r in chat.format_chats(turns).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(a) for a in out[1]["attachments"]] == [("image", "a.png", 512), ("document", None, 512)]
    assert out[1]["turns"][0]["text"] == "see <|image|> \\b <|image|>x<|document|>"
    assert len(out[1]["turns"]) == 3 and len(out[1]["loss_spans"]) == 2
    assert tuple(out[2]["turns"][0]) == ("us\ner\\n", "\n<|im_end|>\\p")
    assert tuple(out[None]["turns"][0]) == ("", "")
    assert chat.format_chats(turns.limit(0)).count() == 0
