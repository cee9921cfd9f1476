"""Personal data: weak labelers, their reliabilities by expectation-maximisation, a span classifier.

Every text gives candidate spans: all matches of the four base patterns, and looser ones
(local phone and identity numbers, spelled-out mail addresses, IPv6). Labelers vote on
each candidate: strict pattern, checksum, gazetteer, context before it, shape, edges. The
votes of all candidates of all documents are counted by pattern of votes and features; EM
over these counts estimates how often each labeler errs (a two-class model with
conditionally independent votes), and its posteriors train a logistic classifier on
the span's features. Base matches that pass their check are always kept; of the other
candidates the classifier decides.

One pass finds the candidates, which are written once; counts, of at most
`MAX_PATTERNS` different patterns by construction, are all that reaches the driver.

Defined results: a null or empty text has no spans; ids may be null or repeat, each row
is judged by its own text; without candidates there is nothing to fit and no extra span;
ties of the classifier (0.5) keep the span; spans of one kind never overlap; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import add_columns, materialize, table

BASE_KINDS = ("email", "ip", "card", "phone")
LOOSE_KINDS = ("spelled_email", "ipv6", "number")
KINDS = BASE_KINDS + LOOSE_KINDS

# The contract's patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]+)+")
IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
NUMBER = re.compile(r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])")

# Gazetteers: common ends of mail domains, words that announce personal data, words that deny it.
DOMAIN_ENDS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl us".split())
CUES = re.compile(r"(?:mail|contact|write to|phone|tel|call|fax|mobile|whatsapp|card|visa|account|ssn|social security|address|host)\W{0,4}(?:\w+\W{1,3}){0,2}\Z", re.I)
DENIALS = re.compile(r"(?:version|page|figure|table|isbn|serial|order|total|price|section|chapter|id|no)\W{0,4}\Z", re.I)

LABELERS = 6
# Votes for (2), against (1) or none (0) of each labeler; kinds; feature bits.
FEATURES = 6
MAX_PATTERNS = len(KINDS) * 3**LABELERS * 2**FEATURES


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches: each `@` with the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at)
        if domain:
            lo = at
            while lo > end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                end = domain.end()
                yield lo, end
                at = end - 1
        at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def passes(kind: str, found: str) -> bool:
    """The base rule of a kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == "card":
        own = digits_of(found)
        return 16 <= len(own) <= 19 and luhn(own)
    if kind == "phone":
        return 8 <= len(digits_of(found)) <= 15
    return True


def candidates(text: str):
    """(kind, start, end, base rule passed) of every match, by kind and start."""
    has_digit = NUMBER_START.search(text) is not None
    if "@" in text:
        for lo, hi in emails(text):
            yield 0, lo, hi, True
    if has_digit:
        for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end(), passes(KINDS[kind], m[0])
    if "(at)" in text or "[at]" in text:
        for m in SPELLED.finditer(text):
            yield 4, m.start(), m.end(), False
    if has_digit:
        if text.count(":") >= 7:
            for m in IPV6.finditer(text):
                yield 5, m.start(), m.end(), False
        for m in NUMBER.finditer(text):
            yield 6, m.start(), m.end(), False


NUMBER_START = re.compile("[0-9]")


def votes_and_features(text: str, kind: int, lo: int, hi: int, passed: bool) -> int:
    """One number for the labelers' votes, the kind and the features of a candidate."""
    found, before = text[lo:hi], text[max(0, lo - 32):lo]
    after = text[hi:hi + 1]
    own = digits_of(found)
    votes = [0] * LABELERS
    # Strict pattern.
    votes[0] = (2 if passed else 1) if kind < 4 else 0
    # Checksum.
    if len(own) >= 13 and kind in (2, 6):
        votes[1] = 2 if luhn(own) else 1
    # Gazetteer.
    if kind in (0, 4):
        votes[2] = 2 if re.split(r"[.\s\])]+", found)[-1].lower() in DOMAIN_ENDS else 0
    elif kind == 1 and found.split(".")[0] in ("0", "127", "255"):
        votes[2] = 1
    # Context.
    votes[3] = 2 if CUES.search(before) else 1 if DENIALS.search(before) else 0
    # Shape.
    groups = tuple(len(g) for g in re.split(r"[^0-9]+", found) if g)
    if kind in (2, 3, 6):
        usual = groups in {(3, 3, 4), (1, 3, 3, 4), (3, 2, 4), (4, 4, 4, 4), (16,)}
        votes[4] = 1 if len(set(own)) <= 2 else 2 if usual else 0
    # Edges: inside a longer token.
    edge = before[-1:].isalnum() or after.isalnum() or before[-1:] in ("#", "$", "_")
    votes[5] = 1 if edge else 0
    flags = (edge, len(groups) > 1, len(own) >= 10, len(own) >= 16, before[-1:] in ("", " ", "\n"), after in ("", " ", "\n", ".", ","))
    code = kind
    for v in votes:
        code = code * 3 + v
    for f in flags:
        code = code * 2 + int(f)
    return code


def decode_pattern(code: int) -> tuple[int, list[int], list[int]]:
    flags, votes = [], []
    for _ in range(FEATURES):
        code, f = divmod(code, 2)
        flags.append(f)
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1], flags[::-1]


def aggregate_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of "personal" for each pattern of votes, by expectation-maximisation.

    Starts from the majority of votes; each labeler has a distribution over none, against
    and for in either class, with one added to every count.
    """
    start = (votes == 2).sum(axis=1) - (votes == 1).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * start.astype(float)))
    for _ in range(rounds):
        share = np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99)
        log = np.stack([np.full(len(votes), np.log1p(-share)), np.full(len(votes), np.log(share))])
        for k in range(votes.shape[1]):
            for y, weight in ((0, (1 - post) * counts), (1, post * counts)):
                rates = np.bincount(votes[:, k], weight, 3) + np.array([1.0, 1.0 + 1.0 * (y == 0), 1.0 + 1.0 * (y == 1)])
                log[y] += np.log(rates / rates.sum())[votes[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -35, 35)))
        if np.abs(new - post).max() < 1e-6:
            return new
        post = new
    return post


def span_features(kinds: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kinds], flags, np.ones((len(kinds), 1))], axis=1)


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (counts * (target - p)) - ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted_patterns(codes: list[int], counts: list[int]) -> dict[int, float]:
    """Classifier's probability for each pattern that occurs."""
    if not codes:
        return {}
    parts = [decode_pattern(c) for c in codes]
    kinds = np.array([p[0] for p in parts])
    votes, flags = np.array([p[1] for p in parts]), np.array([p[2] for p in parts], dtype=float)
    weight = np.array(counts, dtype=float)
    posterior = aggregate_votes(votes, weight)
    x = span_features(kinds, flags)
    w = fit_classifier(x, posterior, weight)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    return dict(zip(codes, p.tolist(), strict=True))


SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()),
                     T.StructField("stop", T.LongType()), T.StructField("base", T.BooleanType()),
                     T.StructField("pattern", T.IntegerType())])


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of each text, with their patterns."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
                               ("base", pa.bool_()), ("pattern", pa.int32())]))

    def maker():
        def spans(text):
            text = (text or b"").decode()
            out = [{"kind": k, "start": lo, "stop": hi, "base": ok, "pattern": votes_and_features(text, k, lo, hi, ok)}
                   for k, lo, hi, ok in candidates(text)]
            # A looser candidate that meets a base span is that span. Base spans by start, with the furthest
            # end of those up to each: one search a candidate.
            taken = sorted((x["start"], x["stop"]) for x in out if x["base"])
            starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

            def apart(x):
                before = bisect_left(starts, x["stop"])
                return before == 0 or reach[before - 1] <= x["start"]

            return [x for x in out if x["kind"] < 4 or apart(x)]

        return lambda texts: [pa.array([spans(t) for t in texts], type=kind)]

    return add_columns(docs, "text", [T.StructField("found", T.ArrayType(SPAN))], maker, keep=["doc_id"])


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, found: spans (kind, start, stop, base, pattern) kept in each text, by kind and start."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = materialize(found_spans(rows), "spans")
    counts = every.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().collect()
    chances = accepted_patterns([r[0] for r in sorted(counts)], [r[1] for r in sorted(counts)])
    good = sorted(c for c, p in chances.items() if p >= threshold) or [-1]
    # A candidate that failed its base rule is no span of that kind, whatever its chance.
    keep = F.filter("found", lambda s: s["base"] | ((s["kind"] >= len(BASE_KINDS)) & s["pattern"].isin(good)))
    return every.select("doc_id", keep.alias("found"))


def written(spans, base_only: bool = False):
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(spans, lambda s: s["base"]) if base_only else spans
    each = F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]))
    return F.array_join(each, ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(written(F.col("found"), True).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[int], str]:
    """Base counts and digest by the patterns as the contract states them: for tests."""
    text = text or ""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", IP.pattern, CARD.pattern, PHONE.pattern)
    out, counts = [], []
    for kind, pattern in zip(BASE_KINDS, patterns, strict=True):
        good = [m for m in re.finditer(pattern, text) if passes(kind, m[0])]
        counts.append(len(good))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in good]
    return counts, hashlib.sha256(",".join(out).encode()).hexdigest()
