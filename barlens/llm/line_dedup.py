r"""Line deduplication with a log-template tree.

A text is a list of lines. A line is cut into records of `MIN_CHARS` characters and more: from the line's
start, and from each cut on, behind the first sentence mark that leaves enough, where none comes for
`MARK_CHARS` behind the next word that ends in one of `CUT_LETTERS`, without either behind `MOST_CHARS`; no
cut leaves less than a record. So a whole line is cut alike wherever it stands, and a passage inside
a line soon after its start. Neighbouring shorter lines are joined: from every such line on, and up
to it, as few of its run as give a record.

A record goes down a tree of fixed depth: token count, then the `LEADING` first tokens, where a
token with a digit, `@` or `://` is a variable. The leaf holds templates, each named by what the path leaves
open: the tokens behind the leading ones up to the last constant one, the count being known. So a
template is its leaf and its key in the leaf, neither without the other. At most a fifth of a record's tokens are
variable: one with more is its own template, word by word. So two records of one template agree in four
fifths of their tokens at least.

A template of two or more documents recurs. The document of the least id keeps its records,
later ones lose theirs, and a line that has no word left goes. A shorter line alone, of `SHORT_CHARS` characters or more,
goes if it recurs `SHORT_TIMES` times. What may stay of a passage: nothing of its whole lines, but for
single short ones; where it starts or ends inside a line, the words before its first cut and behind its last.

Records are keyed in one pass and written as numbers, without their text. Templates are counted (least and greatest
id, combined before the shuffle), and those that recur are joined back, a row a template, so a
template that a third of all documents hold costs a row a document.

With `confirm`, a document of which over `COPY_SHARE` of the characters goes back to one earlier
document stays as it is if the 4-word shingle sets of both whole texts have that similarity
(hundredths): copies as a whole are left to near-duplicate detection, which the pipeline
runs next. Texts are compared by source, a source of many copies in as many blocks; up to `BROADCAST_ROWS` such
documents their ids are broadcast to find the texts, so that only theirs are shuffled, beyond that the ids are joined by a shuffle.

Everything is DataFrame functions. Lines and records are rows as early as can be: expressions over
rows are compiled, those over the items of an array are interpreted and cost five times as much. Where an array
is exploded, the outer form is used: for the other the planner adds a filter that computes the array once more.

Defined results: a null or empty text has no records; a row without an id is left as it is and
is nobody's source; rows of one id count as one document, each is judged by its own text
and repeated rows alike; a line that holds U+0001 is not cut; extra columns stay; with no recurring template
nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import fresh, materialize, table

MIN_CHARS, MARK_CHARS, MOST_CHARS = 48, 160, 200
CUT_LETTERS = "ghlpwy"
LEADING = 3
# Variable tokens of a template: at most one in this many.
VARIABLE_ONE_IN = 5
SHORT_CHARS, SHORT_TIMES = 12, 10
COPY_SHARE = 0.6
# As in near-duplicate detection.
SHINGLE = 4
CONFIRM = 80  # hundredths
# Copies of one source that a task compares with it.
COPIES_IN_BLOCK = 500
# Rows of four numbers.
BROADCAST_ROWS = 1_000_000

SPACES = " \t\n\x0b\f\r"
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
CUT, MASK = "\x01", "\x02"
VARIABLE = r"[^ ]*(?:[0-9@]|://)[^ ]*"


# A record where one starts. Matches follow each other without a gap (\\G), so a line's end, where none fits, is tried once.
RECORD = (rf"(?s)\G(?:.{{{MIN_CHARS},{MARK_CHARS}}}?[.!?] |.{{{MIN_CHARS},{MARK_CHARS}}}[{CUT_LETTERS}] "
          rf"|.{{{MARK_CHARS},{MOST_CHARS}}}?[{CUT_LETTERS}] |.{{{MOST_CHARS}}})(?=.{{{MIN_CHARS}}})")


def records_of(line: Column) -> Column:
    """The records of a line; joined, they give the line again."""
    cut = F.split(F.regexp_replace(line, RECORD, "$0" + CUT), CUT, -1)
    return F.when((F.length(line) < 2 * MIN_CHARS) | F.contains(line, F.lit(CUT)), F.array(line)).otherwise(cut)


def count_tokens(tokens: Column) -> Column:
    return F.size(F.split(tokens, " ", -1))


def normalised(text: Column) -> Column:
    """Tokens with one space between them."""
    odd = text.rlike(r"[\x09-\x0D]") | F.contains(text, F.lit("  "))
    return F.when(odd, F.regexp_replace(F.btrim(text, F.lit(SPACES)), SPACE + "+", " ")).otherwise(F.trim(text))


def with_template(rows: DataFrame) -> DataFrame:
    """`rows` (body, short) with the template's leaf in the tree and its key in that leaf, and size, the number of characters, in place of body.

    The leaf is the token count and the leading tokens; its lowest bit marks short lines. The key is the
    tokens that follow, without variables at their end, which the count gives.
    """
    rows = rows.withColumn("size", F.length("body"))
    others = [c for c in rows.columns if c not in ("body", "short")]
    # Most records have neither a variable nor odd white space: one test for both.
    odd = F.col("body").rlike(r"[0-9@:\x09-\x0D]") | F.contains("body", F.lit("  "))
    plain = normalised(F.col("body"))
    rows = rows.select(*others, "short", F.when(odd, plain).otherwise(F.trim("body")).alias("tokens"),
                       F.when(odd, F.regexp_replace(plain, VARIABLE, MASK)).alias("masked"))
    rows = rows.select("*", count_tokens(F.col("tokens")).alias("n"))
    variables = F.length("masked") - F.length(F.replace("masked", F.lit(MASK), F.lit("")))
    rows = rows.select(*others, "short", "n", F.when(VARIABLE_ONE_IN * variables <= F.col("n"), F.col("masked"))
                       .otherwise(F.col("tokens")).alias("template"))
    leading = F.call_function("substring_index", F.col("template"), F.lit(" "), F.lit(LEADING))
    rest = F.substr("template", F.length(leading) + 1)
    rest = F.when(F.endswith("template", F.lit(" " + MASK)), F.regexp_replace(rest, f"(?: {MASK})+$", "")).otherwise(rest)
    return rows.select(*others, F.xxhash64(rest).alias("key"),
                       F.xxhash64("n", leading).bitwiseAND(-2).bitwiseOR(F.col("short").cast("bigint")).alias("leaf"))


def line_records(docs: DataFrame) -> DataFrame:
    """Records of lines: line, last, part (place in the line), short, body."""
    rows = docs.select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "body"))
    rows = rows.where(F.length(F.trim("body")) >= SHORT_CHARS)
    rows = rows.select("doc_id", "text_key", "line", records_of(F.col("body")).alias("parts"))
    rows = rows.select("doc_id", "text_key", "line", F.posexplode_outer("parts").alias("part", "body"))
    return rows.select("doc_id", "text_key", "line", F.col("line").alias("last"), "part",
                       (F.length(F.trim("body")) < MIN_CHARS).alias("short"), "body")


def run_records(docs: DataFrame) -> DataFrame:
    """As `line_records`, records of neighbouring shorter lines (part is -1). Few texts have any, so arrays of lines do here."""
    few = f"[^\\n]{{1,{MIN_CHARS - 1}}}"
    # The first, cheap test keeps the texts with a shorter line behind another line.
    rows = docs.where(F.col("text").rlike(f"\\n{few}(?:\\n|$)") & F.col("text").rlike(f"(?:^|\\n){few}\\n\\s*{few}(?:\\n|$)"))
    plain = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), normalised(x).alias("tokens")))
    rows = rows.select("doc_id", "text_key", F.filter(plain, lambda x: x["tokens"] != "").alias("r"))
    rows = rows.select("doc_id", "text_key", F.transform("r", lambda x: F.struct(
        x["at"].alias("at"), x["tokens"].alias("tokens"), (F.length(x["tokens"])).alias("n"))).alias("r"))
    rows = rows.select("doc_id", "text_key", "r", F.reverse("r").alias("back"))
    # Characters so far, with a space after each line, and lines; a line that is a record itself ends the run, m is -1 then.
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("m"))
    enough = lambda acc: acc["n"] > MIN_CHARS
    add = lambda acc, x: F.when(enough(acc) | (acc["m"] < 0), acc).when(
        x["n"] >= MIN_CHARS, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("m"))).otherwise(
        F.struct((acc["n"] + x["n"] + 1).alias("n"), (acc["m"] + 1).alias("m")))
    size = lambda of: F.transform(of, lambda x, j: F.when(x["n"] < MIN_CHARS, F.aggregate(
        F.slice(of, j + 1, MIN_CHARS // 2 + 1), none, add, lambda acc: F.when(enough(acc), acc["m"]))))
    rows = rows.select("doc_id", "text_key", "r", "back", size("r").alias("size"), size("back").alias("back_size"))
    ahead = F.transform("size", lambda m, j: F.when(m.isNotNull(), F.struct(
        F.get("r", j)["at"].alias("line"), F.get("r", j + m - 1)["at"].alias("last"), F.array_join(F.slice("r", j + 1, m)["tokens"], " ").alias("body"))))
    behind = F.transform("back_size", lambda m, j: F.when(m.isNotNull(), F.struct(
        F.get("back", j + m - 1)["at"].alias("line"), F.get("back", j)["at"].alias("last"),
        F.array_join(F.reverse(F.slice("back", j + 1, m)["tokens"]), " ").alias("body"))))
    rows = rows.select("doc_id", "text_key", F.explode_outer(F.concat(ahead, behind)).alias("j")).where(F.col("j").isNotNull())
    return rows.select("doc_id", "text_key", "j.line", "j.last", F.lit(-1).alias("part"), F.lit(False).alias("short"), "j.body")


def keyed_records(docs: DataFrame) -> DataFrame:
    """A row for each record of `docs` (doc_id, text_key, text): line, last, part (-1: whole lines), size, key, leaf."""
    docs = docs.where(F.col("doc_id").isNotNull())
    # No filter behind the templates: the planner would move it below them, with all that it needs computed twice.
    return with_template(line_records(docs)).unionByName(with_template(run_records(docs)))


def recurring(keyed: DataFrame) -> DataFrame:
    """Templates of two or more documents with the least id among them; single short lines of `SHORT_TIMES` places."""
    ids = keyed.groupBy("key", "leaf").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("times"))
    enough = (F.col("first_id") != F.col("last_id")) & ((F.col("leaf").bitwiseAND(1) == 0) | (F.col("times") >= SHORT_TIMES))
    return ids.where(enough).select("key", "leaf", "first_id")


def with_shingles(rows: DataFrame, text: str, name: str) -> DataFrame:
    """`rows` with the distinct 4-word shingle hashes of `text` in its place: near-duplicate detection's sets."""
    others = [c for c in rows.columns if c != text]
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = rows.select(*others, words.alias(name))
    last = F.size(name) - SHINGLE
    found = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(
        *[F.get(F.col(name), i + k) for k in range(SHINGLE)]))
    return rows.select(*others, F.array_distinct(found).alias(name))


def confirmed_copies(docs: DataFrame, copies: DataFrame, confirm: int) -> DataFrame:
    """The rows of `copies` (doc_id, text_key, source) whose text and source's text are that similar.

    A source of many copies is repeated for every `COPIES_IN_BLOCK` of them, so no task compares them all.
    """
    blocks = copies.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / COPIES_IN_BLOCK).alias("blocks"))
    dealt = materialize(copies.join(blocks, "source").select(
        "doc_id", "text_key", "source", "blocks", F.pmod(F.xxhash64("doc_id", "text_key"), F.col("blocks")).alias("block")), "dealt")
    few = dealt.count() <= BROADCAST_ROWS
    sized = lambda ids: F.broadcast(ids) if few else ids
    own = docs.select("doc_id", "text_key", "text").join(sized(dealt.drop("blocks")), ["doc_id", "text_key"])
    sources = docs.select(F.col("doc_id").alias("source"), F.col("text").alias("source_text")).join(
        sized(dealt.select("source", "blocks").distinct()), "source")
    sources = with_shingles(sources, "source_text", "of_source").select(
        "source", "of_source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    # Repeated rows are compared once.
    pairs = with_shingles(own.dropDuplicates(["doc_id", "text_key"]), "text", "of_own").join(sources, ["source", "block"])
    shared = F.size(F.array_intersect("of_own", "of_source"))
    union = F.size("of_own") + F.size("of_source") - shared
    # An aggregate before the filter: pushed below the projections, it would compute the sets inside their lambdas.
    best = pairs.groupBy("doc_id", "text_key").agg(F.max(100 * shared - confirm * union).alias("margin"))
    return best.where("margin >= 0").select("doc_id", "text_key")


def dropped_records(docs: DataFrame, confirm: int | None = None, copy_share: float = COPY_SHARE) -> DataFrame:
    """doc_id, text_key, dropped (line, last, part) for documents of `docs` (doc_id, text_key, text) that lose any."""
    # Written once, some twenty bytes a record: cutting texts costs more than all the rest. The templates are written
    # too: the join then deals out both of its sides, so that one template with very many records can be split among tasks.
    places = keyed_records(docs)
    places = materialize(places if confirm is not None else places.drop("size"), "records")
    templates = materialize(recurring(places), "templates")
    seen = places.join(templates, ["key", "leaf"]).where(F.col("first_id") < F.col("doc_id"))
    runs = F.collect_set(F.struct("line", "last", "part")).alias("dropped")
    if confirm is None:
        return seen.groupBy("doc_id", "text_key").agg(runs)
    # Each character lies in one record that is no run, counted once in each of the document's repeated rows.
    by_source = seen.groupBy("doc_id", "text_key", "first_id").agg(
        runs, F.collect_set(F.when(F.col("part") >= 0, F.struct("line", "part", "size"))).alias("sizes"))
    shared = F.aggregate("sizes", F.lit(0), lambda acc, x: acc + x["size"])
    found = by_source.groupBy("doc_id", "text_key").agg(
        F.max(F.struct(shared.alias("shared"), F.col("first_id").alias("source"))).alias("most"),
        F.flatten(F.collect_list("dropped")).alias("dropped"))
    found = materialize(found, "found")
    whole = docs.select("doc_id", "text_key", F.length("text").alias("size")).distinct()
    copies = found.join(whole, ["doc_id", "text_key"]).where(F.col("most.shared") > copy_share * F.col("size"))
    copies = materialize(copies.select("doc_id", "text_key", "most.source"), "candidates")
    copies = materialize(confirmed_copies(docs, copies, confirm), "copies")
    return found.select("doc_id", "text_key", "dropped").join(copies, ["doc_id", "text_key"], "left_anti")


def without(text: Column, dropped: Column) -> Column:
    """`text` without the `dropped` records. Lines and marks are sorted together, so a line's marks stand before it."""
    kind = "struct<line:int,mark:boolean,part:int,body:string>"
    item = lambda line, mark, part, body: F.struct(
        line.alias("line"), F.lit(mark).alias("mark"), part.alias("part"), body.alias("body")).cast(kind)
    none = F.lit(None).cast("string")
    whole = F.flatten(F.transform(F.filter(dropped, lambda d: d["part"] == -1), lambda d: F.sequence(d["line"], d["last"])))
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), whole)
    # Lines that go as a whole are gone; of the others, the parts dropped are listed line by line.
    parts = F.transform(F.filter(dropped, lambda d: d["part"] >= 0), lambda d: item(d["line"], False, d["part"], none))
    bodies = let(lines, lambda x: F.transform(kept, lambda i: item(i, True, F.lit(0), F.get(x, i))))

    def rest(line, gone):
        records = records_of(line)
        stay = let(records, lambda r: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(r) - 1), gone), lambda k: F.get(r, k)), ""))
        return F.when(F.size(gone) == 0, line).otherwise(stay)

    def lines_left(both):
        places = F.filter(F.transform(both, lambda x, i: F.when(x["mark"], i)), lambda i: i.isNotNull())
        return let(places, lambda at: F.transform(at, lambda i, k: let(
            F.slice(both, F.when(k == 0, 0).otherwise(F.get(at, k - 1) + 1) + 1, i - F.when(k == 0, 0).otherwise(F.get(at, k - 1) + 1)),
            lambda marks: F.struct(rest(F.get(both, i)["body"], F.filter(marks, lambda m: m["line"] == F.get(both, i)["line"])["part"]).alias("left"),
                                   F.exists(marks, lambda m: m["line"] == F.get(both, i)["line"]).alias("cut")))))

    left = let(F.array_sort(F.concat(parts, bodies)), lines_left)
    # A line that lost records and has no word left goes.
    return F.array_join(F.filter(left, lambda x: ~(x["cut"] & ~x["left"].rlike(WORD)))["left"], "\n")


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cleaned(docs: DataFrame, confirm: int | None) -> DataFrame:
    """`docs` (doc_id, text_key, text, ...) with n_dropped (records) and left, the text that is left."""
    found = dropped_records(docs.select("doc_id", "text_key", "text"), confirm)
    joined = docs.join(found, ["doc_id", "text_key"], "left")
    left = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("dropped")))
    return joined.select(*docs.columns, F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"), left.alias("left"))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", confirm: int | None = None) -> DataFrame:
    """One row a document: n_dropped (records), kept_chars and the text that is left."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).alias("text"))
    out = _cleaned(rows, confirm)
    left = F.coalesce("left", F.lit(""))
    return out.select("doc_id", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.length(left).cast("bigint").alias("kept_chars"),
                      left.alias("kept_text"))


def drop_recurring(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", confirm: int | None = None) -> DataFrame:
    """`docs` without their recurring records. A document that has no word left goes; all columns stay."""
    rest = {c: fresh(f"rest_{i}", docs.columns) for i, c in enumerate(docs.columns) if c not in (doc_id, text)}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).alias("text"), *[F.col(f"`{c}`").alias(new) for c, new in rest.items()])
    out = _cleaned(rows, confirm)
    out = out.where((F.col("n_dropped") <= 0) | F.col("left").rlike(WORD))
    names = {doc_id: "doc_id", text: "left", **rest}
    return out.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_dropped", "kept_chars",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
