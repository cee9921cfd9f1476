"""BPE encoding and decoding by a trie over the distinct words.

The merges give one encoding to every prefix of a word, and a prefix's encoding is
that of a shorter prefix plus one last token. So a word's encoding follows from
the last token of each of its prefixes: the longest vocabulary token that ends the
prefix and stands next to the last token before it without the merges changing
either. Distinct words go into a trie of symbols, and the last token of every node is
found once, whatever number of words share it: of all nodes of a depth together, with an
automaton of the vocabulary that gives the longest token ending each prefix and then the
next shorter ones. Words of more than `LEVELS` symbols are walked depth first instead.

A task keeps the encodings of the words it has met lately: half of `MAX_WORDS` at most and
as many before them, of which those met again move on and the rest go. It works on as many
characters at a time as `CHARS_A_WORD` allows. So `encode(max_words=...)` bounds its memory; results don't change.

The rules come from a tokenizer file (a parameter) whose parts are: special tokens
matched in the raw text; NFC, white space, lower case; a split into word pieces;
byte symbols with a word-end mark; ranked merges. Decoding joins tokens by spaces,
as a tokenizer without a decoder part does.

Defined results: a null or empty text has no tokens and decodes to the empty text;
ids of null documents stay null; repeated rows are encoded alike; extra columns are
ignored by the query and can be kept by `encode(keep=...)`.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.llm.common import Shared, add_columns, table

# Words whose encodings a task keeps.
MAX_WORDS = 400_000
# Characters of the texts that are cut into words together, for each word kept; a longer text stands alone.
CHARS_A_WORD = 5
# Pairs of neighbouring tokens whose test a task keeps.
MAX_PAIRS = 500_000
# Symbols of the longest word that is encoded depth by depth with others, and words that are so at a time.
LEVELS = 64
BLOCK = 40_000
# More than any token id.
PAIR = 1 << 24
# Bytes inside a word and at its end.
MARKS = 512

# Control characters that Python splits at and the tokenizer does not.
_NOT_WHITE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    itself where it is printable Latin-1, else the next free code from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def reaches(tokens) -> dict[str, int]:
    """Length of the longest token by its last two symbols (or its only one)."""
    out: dict[str, int] = {}
    for t in tokens:
        out[t[-2:]] = max(out.get(t[-2:], 1), len(t))
    return out


class Rules:
    """A tokenizer file, read once on the driver and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        shape = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if shape != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["byte_fallback"] \
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not the kind of tokenizer that this encoder reads")
        self.split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # (left, right) -> (rank, merged) and the halves that made a token first.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[(left, right)] = (rank, made)
            self.halves.setdefault(made, (left, right))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._automaton()
        self._arrays()

    def _automaton(self) -> None:
        """Aho-Corasick automaton of the tokens over bytes, 256 more at a word's end: sorted edges, the state
        to fall back to, the longest token that ends a state and, for each token, the next shorter one."""
        byte = {c: i for i, c in enumerate(byte_symbols())}
        edges, depth, token, spelled = {}, [0], {}, {}
        for t, i in self.vocab.items():
            final = t.endswith(self.end) and len(t) > len(self.end)
            marks = [byte.get(c) for c in (t[:-len(self.end)] if final else t)]
            if not marks or None in marks:
                continue
            marks[-1] += 256 * final
            state = 0
            for d, mark in enumerate(marks, 1):
                at = state * MARKS + mark
                if at not in edges:
                    edges[at] = len(depth)
                    depth.append(d)
                state = edges[at]
            token[state], spelled[i] = i, len(marks)
        fall, longest = [0] * len(depth), [-1] * len(depth)
        shorter = [-1] * (max(self.vocab.values()) + 1)
        for at, state in sorted(edges.items(), key=lambda edge: depth[edge[1]]):
            parent, mark = divmod(at, MARKS)
            while parent and not fall[state]:
                parent = fall[parent]
                fall[state] = edges.get(parent * MARKS + mark, 0)
            longest[state] = longest[fall[state]]
            if state in token:
                shorter[token[state]], longest[state] = longest[state], token[state]
        keys = np.array(sorted(edges), dtype=np.int64)
        self.edges, self.states = keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64)
        self.fall, self.longest, self.shorter = (np.array(x, dtype=np.int64) for x in (fall, longest, shorter))
        self.size = np.array([spelled.get(i, 0) for i in range(len(shorter))], dtype=np.int64)

    def _arrays(self) -> None:
        """Ranks of merges by pair, and the halves of each token with the rank of their merge, -1 for none."""
        self.pairs = np.array(sorted(a * PAIR + b for a, b in self.merge), dtype=np.int64)
        self.ranks = np.array([self.merge[divmod(k, PAIR)][0] for k in self.pairs.tolist()], dtype=np.int64)
        self.up, self.left, self.right = (np.full(len(self.size), -1, dtype=np.int64) for _ in range(3))
        for made, (a, b) in self.halves.items():
            self.up[made], self.left[made], self.right[made] = self.merge[(a, b)][0], a, b


class Encoder:
    """Encodings of word pieces, found on a trie of byte symbols."""

    def __init__(self, rules: Rules, max_words: int | None = None):
        import regex

        self.rules, self.max_words = rules, MAX_WORDS if max_words is None else max_words
        pattern = rules.split.replace("\\s", "\\p{White_Space}")
        self.pieces = regex.compile(pattern).findall
        self.white = regex.compile(r"\p{White_Space}+").split
        self.symbols = byte_symbols()
        self.names = {i: t for t, i in {**rules.vocab, **rules.special}.items()}
        # Tokens by their symbols: inside a word, and at its end, where the last symbol bears the mark.
        end = rules.end
        self.inner = {t: i for t, i in rules.vocab.items() if not (t.endswith(end) and len(t) > len(end))}
        self.final = {t[:-len(end)]: i for t, i in rules.vocab.items() if t.endswith(end) and len(t) > len(end)}
        # The longest token that ends with two symbols: no longer suffix need be tried.
        self.inner_reach, self.final_reach = reaches(self.inner), reaches(self.final)
        self.fits: dict[int, bool] = {}
        # The same tests for many pairs at a time, twice the pair plus the answer: a pair has one place,
        # which the next one with that place takes over.
        self.tested = np.full(MAX_PAIRS, -1, dtype=np.int64)
        # The ids of a piece, and of a chunk, as little-endian integers, with the names of its tokens, joined.
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunk_ids: dict[str | int, tuple[bytes, str]] = {}
        self.before: tuple[dict[str | int, tuple[bytes, str]]] = ({},)
        self.special_at = re.compile("|".join(map(re.escape, sorted(rules.special, key=len, reverse=True)))) \
            if rules.special else None
        self._forget()

    def _forget(self) -> None:
        """What was met lately becomes what was met before, in whose place it comes."""
        self.words.clear()
        self.before = (self.chunk_ids,)
        self.chunk_ids = {i: (little_endian([i]), content) for content, i in self.rules.special.items()}

    def whole(self, left: int, right: int) -> bool:
        """The merges leave these two tokens, next to each other, as they are.

        They do if no pair across the border is merged before the parts beside it have become
        `left` and `right`: undo the later of the two last merges, step by step, and look at the
        pair at the border each time. On the right a merge of the same rank, being further
        right, comes later.
        """
        merge, halves = self.rules.merge, self.rules.halves
        a, b, before, answer = left, right, (len(merge), 1), True
        while True:
            found = merge.get((a, b))
            if found and (found[0], 0.5) < before:
                answer = False
                break
            up_a = merge[halves[a]][0] if a in halves else -1
            up_b = merge[halves[b]][0] if b in halves else -1
            if up_a < 0 and up_b < 0:
                break
            if up_a > up_b:
                before, a = (up_a, 0), halves[a][1]
            else:
                before, b = (up_b, 1), halves[b][0]
        if len(self.fits) >= MAX_PAIRS:
            self.fits.clear()
        self.fits[left * PAIR + right] = answer
        return answer

    def spelled(self, piece: str) -> str:
        """The byte symbols of a piece; printable ASCII characters but the space stand for themselves."""
        if piece.isascii() and piece.isprintable() and " " not in piece:
            return piece
        symbols = self.symbols
        return "".join([symbols[b] for b in piece.encode()])

    def all_whole(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`whole` for each pair of tokens, all undone together."""
        pairs = left * PAIR + right
        kept = self.tested[(pairs ^ pairs >> 19) % len(self.tested)]
        answer = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != pairs)
        if len(new):
            tests, back = np.unique(pairs[new], return_inverse=True)
            found = self._undo(tests)
            answer[new] = found[back]
            self.tested[(tests ^ tests >> 19) % len(self.tested)] = 2 * tests + found
        return answer

    def _undo(self, pairs: np.ndarray) -> np.ndarray:
        rules, answer = self.rules, np.ones(len(pairs), dtype=bool)
        a, b = np.divmod(pairs, PAIR)
        # Twice the rank of the merge undone, and one more on the right, as in `whole`.
        before, at = np.full(len(pairs), 2 * len(rules.pairs) + 1), np.arange(len(pairs))
        while len(at):
            border = a * PAIR + b
            place = np.minimum(np.searchsorted(rules.pairs, border), len(rules.pairs) - 1)
            merged = (rules.pairs[place] == border) & (2 * rules.ranks[place] < before)
            answer[at[merged]] = False
            up_a, up_b = rules.up[a], rules.up[b]
            left = up_a > up_b
            a, b, before = (np.where(left, rules.right[a], a), np.where(left, b, rules.left[b]),
                            np.where(left, 2 * up_a, 2 * up_b + 1))
            on = ~merged & (np.maximum(up_a, up_b) >= 0)
            a, b, before, at = a[on], b[on], before[on], at[on]
        return answer

    def _step(self, state: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The automaton's states after one more symbol."""
        rules, out, at = self.rules, np.zeros(len(state), dtype=np.int64), np.arange(len(state))
        while len(at):
            edge = state * MARKS + mark
            place = np.minimum(np.searchsorted(rules.edges, edge), len(rules.edges) - 1)
            found = rules.edges[place] == edge
            out[at[found]] = rules.states[place[found]]
            on = ~found
            if not state[on].all():
                raise ValueError("the vocabulary has no token for a byte")
            at, state, mark = at[on], rules.fall[state[on]], mark[on]
        return out

    def _encode_block(self, pieces: list[str]) -> None:
        """Encode distinct pieces of few symbols, sorted: all trie nodes of a depth at a time.

        `last[d]` holds, for each word, the last token of its first d symbols. Words with these symbols in
        common stand together; the first of them has the node, and the others copy from it.
        """
        rules, spelled = self.rules, [p.encode() for p in pieces]
        length = np.array([len(w) for w in spelled])
        depth, count = int(length.max()), len(pieces)
        symbols = np.array(spelled, dtype=f"S{depth}").view(np.uint8).reshape(count, depth)
        same = symbols[1:] == symbols[:-1]
        shared = np.zeros(count, dtype=np.int64)
        shared[1:] = np.where(same.all(axis=1), depth, same.argmin(axis=1))
        shared[1:] = np.minimum(shared[1:], np.minimum(length[1:], length[:-1]) - 1)
        symbols = np.ascontiguousarray(symbols.T)
        state = np.zeros(count, dtype=np.int64)
        last = np.zeros((depth + 1, count), dtype=np.int32)
        for d in range(1, depth + 1):
            here = np.flatnonzero(length >= d)
            leaf = length[here] == d
            own = leaf | (shared[here] < d)
            row = here[own]
            reached = self._step(state[row], symbols[d - 1][row] + 256 * leaf[own])
            token, open_ = rules.longest[reached], np.arange(len(row))
            while len(open_):
                start = d - rules.size[token[open_]]
                open_, start = open_[start > 0], start[start > 0]
                fit = self.all_whole(last[start, row[open_]].astype(np.int64), token[open_])
                open_ = open_[~fit]
                token[open_] = rules.shorter[token[open_]]
            node = np.cumsum(own) - 1
            state[here], last[d, here] = reached[node], token[node]
        # From the last token of each word backwards.
        found, at, rows = [], length.copy(), np.arange(count)
        n_ids = np.zeros(count, dtype=np.int64)
        while len(rows):
            token = last[at[rows], rows]
            found.append((rows, token))
            n_ids[rows] += 1
            at[rows] -= rules.size[token]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(n_ids)
        ids = np.zeros(ends[-1], dtype="<u4")
        for back, (rows, token) in enumerate(found, 1):
            ids[ends[rows] - back] = token
        names = [self.names[i] for i in ids.tolist()]
        written = np.cumsum([0] + [len(n) + 1 for n in names])
        flat, joined, lo = ids.tobytes(), " ".join(names), 0
        for piece, hi, a, b in zip(pieces, ends.tolist(), written[ends - n_ids].tolist(), written[ends].tolist(), strict=True):
            self.words[piece] = flat[4 * lo:4 * hi], joined[a:b - 1]
            lo = hi

    def encode_words(self, pieces) -> None:
        """Encode distinct pieces; UTF-8 sorts as the code points do."""
        short, long = [], []
        for p in sorted(pieces):
            (short if len(p) <= LEVELS and (p.isascii() or len(p.encode()) <= LEVELS) else long).append(p)
        for lo in range(0, len(short), BLOCK):
            self._encode_block(short[lo:lo + BLOCK])
        self._walk(long)

    def _walk(self, pieces) -> None:
        """Encode distinct pieces of any length: sorted by their symbols, they are walked as a trie, depth first.

        `last` and `size` hold the last token, and its number of symbols, of each prefix on the path
        from the root; stepping to the next word keeps what the two words share. The last symbol of a
        word bears the end mark, so it is a leaf of its own.
        """
        fits, whole = self.fits, self.whole
        inner, inner_reach, final, final_reach = self.inner, self.inner_reach, self.final, self.final_reach
        last: list[int] = []
        size: list[int] = []
        before = ""
        for word, piece in sorted((self.spelled(p), p) for p in pieces):
            top, shared = len(word) - 1, 0
            limit = min(top, len(last))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared:], size[shared:]
            before = word
            for here in range(shared + 1, top + 2):
                known, reach = (inner, inner_reach) if here <= top else (final, final_reach)
                n = min(here, reach.get(word[max(0, here - 2):here], 1))
                while True:
                    found = known.get(word[here - n:here])
                    if found is not None:
                        if n == here:
                            break
                        left = last[here - n - 1]
                        fit = fits.get(left * PAIR + found)
                        if whole(left, found) if fit is None else fit:
                            break
                    n -= 1
                if here <= top:
                    last.append(found)
                    size.append(n)
            ids, at = [found], top + 1 - n
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            self.words[piece] = little_endian(ids[::-1]), " ".join([self.names[i] for i in ids[::-1]])

    def learn(self, chunks) -> None:
        """Encode the pieces of chunks (texts without white space) not met before."""
        words, plain, cut = self.words, [], []
        for c in chunks:
            # ASCII letters alone are one piece.
            if c.isascii() and c.isalpha():
                plain.append(c)
            else:
                cut.append((c, self.pieces(c)))
        pieces = {p for _, found in cut for p in found}
        pieces.update(plain)
        self.encode_words(pieces.difference(words))
        self.chunk_ids.update(zip(plain, map(words.__getitem__, plain), strict=True))
        for chunk, found in cut:
            made = [words[p] for p in found]
            self.chunk_ids[chunk] = made[0] if len(made) == 1 else \
                (b"".join([ids for ids, _ in made]), " ".join([names for _, names in made]))

    def normalised(self, text: str) -> list[str]:
        """Chunks of a text: NFC, lower case character by character, split at white space."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # str.lower() has a rule of its own for a sigma that ends a word.
            text = text.replace("Σ", "σ")
        text = text.lower()
        if _NOT_WHITE.search(text):
            return [c for c in self.white(text) if c]
        return text.split()

    def _unknown(self, chunks: set) -> set[str]:
        """The chunks not met lately; those met before are taken over and not among them."""
        before, = self.before
        new = chunks.difference(self.chunk_ids)
        again = new.intersection(before)
        for c in again:
            self.chunk_ids[c] = before[c]
        return new - again if again else new

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers and its decoded text."""
        out, lo, total = [], 0, 0
        for i, text in enumerate(texts):
            if i > lo and total + len(text) > CHARS_A_WORD * self.max_words:
                out += self._encode_group(texts[lo:i])
                lo, total = i, 0
            total += len(text)
        return out + self._encode_group(texts[lo:])

    def _encode_group(self, texts: list[str]) -> list[tuple[bytes, str]]:
        split: list[list[str | int]] = []
        for text in texts:
            parts: list[str | int] = []
            at = 0
            for m in self.special_at.finditer(text) if self.special_at else ():
                parts += self.normalised(text[at:m.start()])
                parts.append(self.rules.special[m[0]])
                at = m.end()
            parts += self.normalised(text[at:] if at else text)
            split.append(parts)
        needed = set().union(*split)
        new = self._unknown(needed)
        if max(len(self.chunk_ids) + len(new), len(self.words)) > self.max_words // 2:
            self._forget()
            new = self._unknown(needed)
        self.learn(new)
        known, out = self.chunk_ids.__getitem__, []
        for parts in split:
            found = list(map(known, parts))
            out.append((b"".join([ids for ids, _ in found]), " ".join([names for _, names in found])))
        return out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
           with_ids: bool = True, keep: list[str] = (), max_words: int | None = None) -> DataFrame:
    """One row a document: n_tokens, ids_sha256, decoded_sha256 and, if wanted, the token ids.

    `keep` names further columns of `docs` to carry along; `max_words` (default `MAX_WORDS`) bounds the words a task keeps.
    """
    rules = Shared(docs.sparkSession, Rules(path or tokenizer_path()))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def maker():
        encoder = Encoder(rules.get(), max_words)

        def work(texts):
            found = encoder.encode([(t or b"").decode() for t in texts])
            out = [pa.array([len(ids) // 4 for ids, _ in found], type=pa.int64()),
                   pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], type=pa.string()),
                   pa.array([hashlib.sha256(names.encode()).hexdigest() for _, names in found], type=pa.string())]
            if with_ids:
                ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in found], dtype=np.int64).astype(np.int32)
                values = np.frombuffer(b"".join(ids for ids, _ in found), dtype="<i4")
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=pa.int32())))
            return out

        return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    return add_columns(rows, "text", fields, maker, keep=["doc_id", *keep])


def decode(tokens: DataFrame, *, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`tokens` with a column `decoded`: the tokens of the id list, joined by spaces; null ids give null."""
    rules = Rules(path or tokenizer_path())
    names = [""] * (max([*rules.vocab.values(), *rules.special.values()]) + 1)
    for name, i in {**rules.vocab, **rules.special}.items():
        names[i] = name
    # One vocabulary as a constant array: its size is that of the tokenizer file.
    known = F.from_json(F.lit(json.dumps(names)), "array<string>")
    return tokens.withColumn("decoded", F.array_join(F.transform(F.col(ids), lambda i: F.get(known, i)), " "))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
