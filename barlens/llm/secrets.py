"""Secret scans: base patterns, and character Markov models for other random strings.

Base spans are matches of three patterns. Beside them every token of `TOKEN` that is no part
of a base span is scored by two first-order Markov models of characters, one of random
strings and one of ordinary identifiers. It becomes a span of kind `random` when the sum of the
log-likelihood ratios over its pairs of neighbouring characters is over `MIN_RATIO`, and over
`MIN_MEAN` a pair, so that length alone makes no secret of what is hardly odd.

The models are counts of character pairs over labelled samples (two DataFrames, a parameter), smoothed by the
characters' shares. The default samples follow rules (`ordinary_samples`, `random_samples`):
identifiers in their usual spellings, paths, dates, UUIDs, numbers and rules of one character; keys in the usual
alphabets. The counts have a fixed number of cells, and travel as a constant. Without samples a model is uniform.

Everything is DataFrame functions; rows never leave their partition for scanning. Sums over a text's
matches are taken in blocks (`prefixes`), so time grows in proportion to a text's matches.

Defined results: a null or empty text has no spans; ids may be null or repeat, each row is
judged by its own text; spans that touch are both kept; extra columns are ignored.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.llm.common import table

# The contract's patterns, with the length that each match (or its value) needs.
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": (KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]+)", 1, 32),
}
# What a text with such a span must have: a cheap test before matches are listed.
NEEDS = {"assign": KEYWORDS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", "access": "AKIA[A-Z0-9]{12}",
         "hex": "[0-9a-f]{32}"}
KINDS = (*PATTERNS, "random")

TOKEN = r"([A-Za-z0-9+/_=-]{20,})"
MIN_RATIO = 12.0
MIN_MEAN = 0.5
# Labelled strings of each kind that the default models learn from.
SAMPLES = 4_000
# Items of an array that a fold takes before it starts a new block.
BLOCK = 64
BACK_OFF = 10.0
# Characters from ! to ~ have a row and a column each.
FIRST, SIZE = 33, 94


SPANS = "array<struct<start:int,kind:int,stop:int>>"
FOUND = "array<struct<start:int,kind:int,stop:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once a row however often names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(items: Column, of: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item, `combine` over `of` of all items before it.

    A fold copies its list of results at every step, so lists are kept to `BLOCK` items, and one of the blocks.
    """
    def fold(xs, value):
        empty = F.struct(zero.alias("all"), F.array(zero).alias("out"))
        return F.aggregate(xs, empty, lambda acc, x: let(combine(acc["all"], value(x)), lambda now: F.struct(
            now.alias("all"), F.concat(acc["out"], F.array(now)).alias("out"))))

    size = lambda x: F.size(x)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size(x), F.lit(1)) - 1) / BLOCK).cast("int")),
                                   lambda k: fold(F.slice(x, k * BLOCK + 1, BLOCK), of))
    whole = lambda folded: let(fold(folded, lambda f: f["all"])["out"], lambda before: F.flatten(F.transform(
        folded, lambda f, k: F.transform(F.slice(f["out"], F.lit(1), F.size(f["out"]) - 1), lambda v: combine(F.get(before, k), v)))))
    return let(items, lambda x: let(blocks(x), whole))


def matches_of(text: Column, pattern: str, needs: str, kind: int, least: int) -> Column:
    """Spans (start, kind, stop, value of the group) of all leftmost non-overlapping matches whose group has `least` characters.

    The pieces between matches and the matches, in turn, give the positions in code points.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern, -1)
    zipped = lambda h: F.arrays_zip(F.transform(h, F.length).alias("hit"), values.alias("value"), F.transform(
        F.slice(gaps, F.lit(1), F.size(h)), F.length).alias("gap"))

    def spans(x):
        at = prefixes(x, lambda m: m["gap"] + m["hit"], lambda a, b: a + b, F.lit(0))
        return let(at, lambda a: F.transform(x, lambda m, i: F.struct(
            (F.get(a, i) + m["gap"]).alias("start"), F.lit(kind).alias("kind"),
            (F.get(a, i) + m["gap"] + m["hit"]).alias("stop"), m["value"].alias("value"))))

    found = F.filter(let(let(hits, zipped), spans), lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(FOUND))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    return F.array_sort(F.concat(*[
        without_values(matches_of(text, pattern, NEEDS[name], kind, least))
        for kind, (name, (pattern, _, least)) in enumerate(PATTERNS.items())]))


def without_values(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))


def pair_index(text: Column, i: Column) -> Column:
    """Cell of the characters i and i+1 (from 1) of an ASCII token."""
    code = lambda k: F.ascii(F.substr(text, k, F.lit(1))) - FIRST
    return code(i) * SIZE + code(i + 1)


def pair_counts(samples: DataFrame) -> DataFrame:
    """cell -> count over all neighbouring characters of the column `sample`."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: pair_index(F.col("sample"), i))
    cells = samples.where(F.length("sample") > 1).select(F.explode(pairs).alias("cell"))
    return cells.where(F.col("cell").between(0, SIZE * SIZE - 1)).groupBy("cell").count()


def log_transitions(counts: dict[int, int]) -> list[float]:
    """log P(second | first) of every cell. A character's own share (one added to each count) counts as
    `BACK_OFF` observations in every row, so a row without samples falls back on it."""
    total = sum(counts.values())
    share = [(sum(counts.get(first * SIZE + c, 0) for first in range(SIZE)) + 1) / (total + SIZE) for c in range(SIZE)]
    out = []
    for first in range(SIZE):
        row = [counts.get(first * SIZE + c, 0) for c in range(SIZE)]
        out += [math.log((n + BACK_OFF * share[c]) / (sum(row) + BACK_OFF)) for c, n in enumerate(row)]
    return out


def log_ratios(random_counts: dict[int, int], ordinary_counts: dict[int, int]) -> list[float]:
    """For each cell log P(second | first) as a random string minus that as an ordinary identifier."""
    return [a - b for a, b in zip(log_transitions(random_counts), log_transitions(ordinary_counts), strict=True)]


def train(random_samples: DataFrame, ordinary_samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all cells from labelled samples (column `sample`)."""
    counts = [dict(pair_counts(x).collect()) for x in (random_samples, ordinary_samples)]
    return log_ratios(*counts)


# Words that identifiers are made of.
WORDS = """access account action active address admin array async batch block board body branch buffer build button byte cache call cancel
case center change char check child class client clock close cloud code color column commit compare config connect content context control
copy count create current customer data date debug default delete depth detail device double element email empty encode entry
error event export factory field file filter final first flag float folder format frame from function global graph group handle hash header
height home host html image import index info input insert item join key label language last latest layer left length level library limit
line link list load local lock login main manager master match memory menu merge message method mode model module name network next node null
number object offset open option order output owner package page param parent path pattern point port position post
price process product project public query queue random range read record remove report request result return role route row
schema script search select server service session size sort source stack start state string system table target task text thread time
token total tree type update user value vector version view""".split()
PUNCTUATION = "-=_/+"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _draw(salt: str, n) -> Column:
    """A number below n that the row's id and the salt fix."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _drawn_characters(salt: str, alphabet: str, n: Column) -> Column:
    place = lambda k: F.pmod(F.xxhash64("id", F.lit(salt), k), F.lit(len(alphabet))).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(F.lit(alphabet), place(k), F.lit(1))), "")


def _one_of(salt: str, forms: list[Column]) -> Column:
    return F.get(F.array(*forms), _draw(salt, len(forms)))


def ordinary_samples(spark: SparkSession, first: int = 0, rows: int = SAMPLES) -> DataFrame:
    """sample: identifiers, paths, dates, UUIDs, numbers and rules of one character, by number from `first` on."""
    word = lambda k: F.get(F.lit(WORDS), F.pmod(F.xxhash64("id", F.lit("word"), k), F.lit(len(WORDS))).cast("int"))
    words = F.transform(F.sequence(F.lit(1), _draw("words", 6) + 2), word)
    joined = lambda glue: F.array_join("w", glue)
    title = F.array_join(F.transform("w", F.initcap), "")
    numbered = F.transform("w", lambda x, k: F.concat(x, F.pmod(F.xxhash64("id", k), F.lit(100)).cast("string")))
    day = F.date_add(F.lit("1990-01-01").cast("date"), _draw("day", 15_000))
    two = lambda salt, n: F.lpad(_draw(salt, n).cast("string"), 2, "0")
    clock = [two("hour", 24), two("minute", 60), two("second", 60)]
    stamp = [F.concat_ws("-", day.cast("string"), *clock, F.lpad(_draw("part", 1_000_000).cast("string"), 6, "0")),
             F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T"), *clock, F.lit("00000")), F.concat_ws("/", F.date_format(day, "yyyy/MM/dd"), *clock)]
    hexes = F.md5(F.col("id").cast("string"))
    cut = lambda a, n: F.substr(hexes, F.lit(a), F.lit(n))
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    rule = F.repeat(F.substr(F.lit(PUNCTUATION), _draw("mark", len(PUNCTUATION)) + 1, F.lit(1)), _draw("long", 40) + 20)
    number = _drawn_characters("number", DIGITS, _draw("digits", 12) + 20)
    forms = [joined("_"), F.concat(F.get("w", F.lit(0)), title), F.upper(joined("_")), F.concat(F.lit("/"), joined("/")), joined("-"),
             F.array_join(numbered, "/"), title, *stamp, uuid, uuid, rule, number]
    made = spark.range(first, first + rows, numPartitions=1).select("id", words.alias("w"))
    return made.select(_one_of("form", forms).alias("sample"))


def random_samples(spark: SparkSession, first: int = 0, rows: int = SAMPLES) -> DataFrame:
    """sample: keys of 20 to 44 characters in the usual alphabets, by number from `first` on."""
    n = _draw("length", 25) + 20
    kinds = [LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "-_", UPPER + "234567", LOWER + DIGITS]
    return spark.range(first, first + rows, numPartitions=1).select(
        _one_of("form", [_drawn_characters(f"key{k}", alphabet, n) for k, alphabet in enumerate(kinds)]).alias("sample"))


def ratio(token: Column, model: Column) -> Column:
    """Summed log-likelihood ratio of a token's character pairs."""
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                       lambda acc, i: acc + F.get(model, pair_index(token, i)))


def apart(spans: Column, base: Column) -> Column:
    """The spans that share no character with one of `base`; neither list needs an order, spans don't overlap each other."""
    both = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["stop"].alias("stop"), s["value"].alias("value"))),
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["stop"].alias("stop"),
                                             F.lit(None).cast("string").alias("value")))))

    def free(x):
        # A base span that starts before one ends in it, or one that starts in it comes next.
        reach = prefixes(x, lambda s: F.when(s["own"] == 0, s["stop"]).otherwise(0), lambda a, b: F.greatest(a, b), F.lit(0))
        return let(reach, lambda r: F.filter(F.transform(x, lambda s, i: F.when(
            (s["own"] == 1) & (F.get(r, i) <= s["start"])
            & F.coalesce((F.get(x, i + 1)["own"] == 1) | (F.get(x, i + 1)["start"] >= s["stop"]), F.lit(True)), s)), lambda s: s.isNotNull()))

    return F.when(F.size(base) == 0, F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(1).alias("own"), s["stop"].alias("stop"), s["value"].alias("value")))).otherwise(let(both, free))


def random_spans(text: Column, base: Column, ratios: list[float], min_ratio: float, min_mean: float) -> Column:
    """Tokens apart from base spans whose ratio is over `min_ratio`, and over `min_mean` a pair of characters."""
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    needs = "[A-Za-z0-9+/_=-]{20}"
    spans = matches_of(text, TOKEN, needs, len(PATTERNS), 20)
    odd = F.filter(apart(spans, base), lambda s: let(ratio(s["value"], model), lambda r: (r > min_ratio) & (
        r > min_mean * (F.length(s["value"]) - 1))))
    return F.transform(odd, lambda s: F.struct(s["start"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), s["stop"].alias("stop")))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ratios: list[float] | None = None,
         min_ratio: float = MIN_RATIO, min_mean: float = MIN_MEAN) -> DataFrame:
    """doc_id, base and spans (start, kind, stop; by start, then kind) of every text."""
    if ratios is None:
        ratios = train(random_samples(docs.sparkSession), ordinary_samples(docs.sparkSession))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    rows = rows.select("doc_id", "base", random_spans(F.col("text"), F.col("base"), ratios, min_ratio, min_mean).alias("extra"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)],
                        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
