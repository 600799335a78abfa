"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is cut into pre-tokens, about LEAF of them to a leaf; every node of the tree sums the characters and
the tokens below it. An edit walks down to the leaves it touches and to the one that holds the boundary context
before it, cuts the text again from there until a cut falls on an old leaf's beginning behind the edit, and
updates the sums above. Only these leaves are encoded again.

Why that is exact: the cutting goes from left to right without looking back, and looks less than CONTEXT
characters beyond the end of a pre-token. So leaves that end before the context stay, and from a common cut on
the rest of the text is cut as before.

Defined results: a null text counts as the empty one with no tokens; edits are applied in order, each to the
text that the earlier ones left, positions beyond the end count as the end, an end before the start as the
start, null replacements as empty and null edits as none; repeated rows are edited one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
CONTEXT = 4
MEMORY = 500_000


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Counter:
    """Tokens of pre-tokens, remembered; a pre-token is merged as a whole."""

    def __init__(self, ranks: bytes):
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known = _Known(self.encoding.encode_ordinary)

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def tokens(self, pieces: list[str]) -> list[int]:
        return list(map(self.known.__getitem__, pieces))


class _Known(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        if len(self) >= MEMORY:
            self.clear()
        value = self[piece] = len(self.encode(piece))
        return value


class Tree:
    """Sums of characters and tokens over leaves; node i has the children 2 i and 2 i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.n = len(chars)
        pad = [0] * (self.size - self.n)
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i):
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one, if none does) and where it begins."""
        i, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if place >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        """New values of neighbouring leaves; the sums above each are updated once."""
        low, high = leaf + self.size, leaf + self.size + len(chars) - 1
        self.chars[low : high + 1], self.tokens[low : high + 1] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._sum(i)

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.n], self.tokens[self.size : self.size + self.n]


def _leaves(pieces: list[str], tokens: list[int], per_leaf: int = LEAF) -> tuple[list[int], list[int]]:
    chars = [sum(map(len, pieces[i : i + per_leaf])) for i in range(0, len(pieces), per_leaf)]
    return chars, [sum(tokens[i : i + per_leaf]) for i in range(0, len(pieces), per_leaf)]


def build_leaves(text: str, counter: Counter) -> tuple[list[int], list[int]]:
    """Characters and tokens of each leaf of a text."""
    pieces = counter.pieces(text)
    return _leaves(pieces, counter.tokens(pieces))


def apply_edit(text: str, tree: Tree, start: int, end: int, put: str, counter: Counter) -> tuple[str, Tree, int]:
    """The edited text, its tree, and the number of pre-tokens that were encoded again."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after, shift = text[:start] + put + text[end:], len(put) - (end - start)
    if not text or not tree.n:
        pieces = counter.pieces(after)
        return after, Tree(*_leaves(pieces, counter.tokens(pieces))), len(pieces)
    leaf, begin = tree.find(max(0, start - CONTEXT))
    # the first old leaf that may stay: it begins at or behind the end of the edit
    stop, stop_at = leaf, begin
    while stop < tree.n and (stop_at < end or stop == leaf):
        stop_at += tree.chars[tree.size + stop]
        stop += 1
    pieces, at = [], begin
    for m in counter.cut.finditer(after, begin):
        while stop < tree.n and at > stop_at + shift:
            stop_at += tree.chars[tree.size + stop]
            stop += 1
        if stop < tree.n and at == stop_at + shift and tree.chars[tree.size + stop]:
            break
        pieces.append(m[0])
        at = m.end()
    else:
        stop = tree.n
    tokens = counter.tokens(pieces)
    places = stop - leaf
    per_leaf = -(-len(pieces) // places) or 1
    if per_leaf <= 2 * LEAF:
        chars, counts = _leaves(pieces, tokens, per_leaf)
        pad = [0] * (places - len(chars))
        tree.put(leaf, chars + pad, counts + pad)
    else:  # a large insertion: more leaves, and a tree over all of them
        chars, counts = tree.leaves()
        new = _leaves(pieces, tokens)
        tree = Tree(chars[:leaf] + new[0] + chars[stop:], counts[:leaf] + new[1] + counts[stop:])
    return after, tree, len(pieces)


def with_trees(docs: DataFrame, ranks: bytes) -> DataFrame:
    """`docs` with leaf_chars and leaf_tokens, the leaves of each text's tree; null texts as the empty one."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def grow(batches):
        counter = Counter(shared.value)
        for batch in batches:
            leaves = [build_leaves(t, counter) for t in batch["text"]]
            yield batch.assign(leaf_chars=[c for c, _ in leaves], leaf_tokens=[t for _, t in leaves])

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInPandas(grow, f"{fields}, leaf_chars array<int>, leaf_tokens array<int>")


def edited_counts(trees: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_edits, n_pretokens_again, and the edited text.

    trees: doc_id, text, edits (array of start, end, put), leaf_chars, leaf_tokens.
    """
    shared = trees.sparkSession.sparkContext.broadcast(ranks)

    def follow(batches):
        counter = Counter(shared.value)
        for batch in batches:
            out = []
            for text, edits, chars, tokens in zip(batch["text"], batch["edits"], batch["leaf_chars"], batch["leaf_tokens"], strict=True):
                tree, again, n = Tree([int(c) for c in chars], [int(t) for t in tokens]), 0, 0
                before = tree.total
                for edit in edits if edits is not None else ():
                    if edit is None or edit["start"] is None or edit["end"] is None:
                        continue
                    text, tree, pieces = apply_edit(text, tree, edit["start"], edit["end"], edit["put"] or "", counter)
                    again, n = again + pieces, n + 1
                out.append((before, tree.total, n, again, text))
            names = ["tokens_before", "tokens_after", "n_edits", "n_pretokens_again", "text"]
            yield pd.DataFrame(out, columns=names).astype({"text": object}).assign(doc_id=batch["doc_id"].astype("Int64").array)

    columns = "tokens_before long, tokens_after long, n_edits long, n_pretokens_again long, text string, doc_id long"
    return trees.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens").mapInPandas(follow, columns)


def derived_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: three edits of every text, made from the text itself and the doc_id.

    One deletes up to 20 characters, one puts the text's first 40 characters elsewhere, one replaces up to 12
    characters by the last 7.
    """
    n = F.length("text")

    def place(seed):
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), n + 1).cast("long")

    def edit(start, width, put):
        return F.struct(start.alias("start"), (start + width).alias("end"), put.alias("put"))

    edits = F.array(
        edit(place(1), F.lit(20), F.lit("")),
        edit(place(2), F.lit(0), F.substring("text", 1, 40)),
        edit(place(3), F.lit(12), F.right("text", F.lit(7))),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("edits", edits)


def contract(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Counts of every document before and after its derived edits, with the digest of the edited text."""
    ranks = read_ranks(path)
    counted = edited_counts(with_trees(derived_edits(docs), ranks), ranks)
    return counted.select("doc_id", "tokens_before", "tokens_after", "n_edits", "n_pretokens_again", F.sha2("text", 256).alias("text_sha256"))
