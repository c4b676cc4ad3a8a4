"""Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree: a leaf is a short run of pre-tokens with
their lengths and token counts, an inner node sums its children. An edit goes down to the leaves it
touches, splits the text into pre-tokens again from the last boundary that the edit can't have moved
up to the first old boundary after it that is met again, and re-encodes only those; sums change on the
paths to the root alone. Counts are always those of encoding the whole edited text.

Trees are a column of their own, so a corpus keeps them and applies later edits. Narrow passes:
no shuffle, and a task works on a bounded piece of rows, or one text, at a time.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import add_columns, table

#: Texts that a task has trees of at a time.
PIECE = 128
#: Pre-tokens of a new leaf; a leaf that grows to SPLIT_AT has the tree built anew.
LEAF, SPLIT_AT = 32, 256
#: A boundary at least so many characters before an edit is never moved by it: the pattern looks no further ahead.
LOOK_AHEAD = 2
KEEP_WORDS, KEEP_CHARS = 400_000, 48
EDIT = StructType([StructField("at", IntegerType()), StructField("removed", IntegerType()), StructField("inserted", StringType())])
#: A tree: characters and tokens of each pre-token, pre-tokens of each leaf, and the sums of both by node (root first).
TREE = StructType([StructField(n, ArrayType(IntegerType(), False)) for n in ("chars", "tokens", "leaves", "char_sums", "token_sums")])
_TREE_ARROW = pa.struct([(n, pa.list_(pa.int32())) for n in TREE.names])


class Counter:
    """Tokens of single pre-tokens, by a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

        class Words(dict):
            def __missing__(self, word: str) -> int:
                n = len(encoding.encode_ordinary(word))
                if len(word) <= KEEP_CHARS:
                    if len(self) >= KEEP_WORDS:
                        self.clear()
                    self[word] = n
                return n

        self.words = Words()


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class SegmentTree:
    """A text's pre-tokens under a binary tree of sums."""

    def __init__(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        """``leaves``: characters and tokens of the pre-tokens of each leaf."""
        self.leaves = leaves
        self.width = 1 << max(0, (max(1, len(leaves)) - 1).bit_length())
        self.char_sums, self.token_sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (chars, tokens) in enumerate(leaves):
            self.char_sums[self.width + k], self.token_sums[self.width + k] = sum(chars), sum(tokens)
        for k in range(self.width - 1, 0, -1):
            self._add_up(k)

    def _add_up(self, k: int) -> None:
        self.char_sums[k] = self.char_sums[2 * k] + self.char_sums[2 * k + 1]
        self.token_sums[k] = self.token_sums[2 * k] + self.token_sums[2 * k + 1]

    @classmethod
    def of_pre_tokens(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        return cls([(chars[k : k + LEAF], tokens[k : k + LEAF]) for k in range(0, len(chars), LEAF)])

    @classmethod
    def of_text(cls, text: str, own: Counter) -> SegmentTree:
        parts = own.pattern.findall(text)
        return cls.of_pre_tokens(list(map(len, parts)), list(map(own.words.__getitem__, parts)))

    @property
    def tokens(self) -> int:
        return self.token_sums[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one, if past the end), and its first character."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if at >= start + self.char_sums[k] and self.char_sums[k + 1]:
                start += self.char_sums[k]
                k += 1
        return k - self.width, start

    def set_leaf(self, leaf: int, chars: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (chars, tokens)
        k = self.width + leaf
        self.char_sums[k], self.token_sums[k] = sum(chars), sum(tokens)
        while k > 1:
            k //= 2
            self._add_up(k)

    def edit(self, text: str, at: int, removed: int, inserted: str, own: Counter) -> tuple[SegmentTree, str, int]:
        """The tree (itself, or one built anew), the new text, and how many pre-tokens were encoded again."""
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + inserted + text[at + removed :]
        if not self.leaves:
            tree = SegmentTree.of_text(new, own)
            return tree, new, sum(len(c) for c, _ in tree.leaves)
        first, start = self.leaf_at(max(0, at - LOOK_AHEAD - 1))
        kept_chars: list[int] = []
        kept_tokens: list[int] = []
        restart = start
        for c, t in zip(*self.leaves[first], strict=True):
            if restart + c > at - LOOK_AHEAD:
                break
            kept_chars.append(c)
            kept_tokens.append(t)
            restart += c
        # Old boundaries after the edit, leaf by leaf, as places in the new text.
        moved = len(inserted) - removed
        leaf, skip, old = first, len(kept_chars), restart
        chars, tokens = kept_chars, kept_tokens
        fresh, here, met = 0, restart, False
        for m in own.pattern.finditer(new, restart):
            here = m.end()
            chars.append(here - m.start())
            tokens.append(own.words[m.group()])
            fresh += 1
            while leaf < len(self.leaves) and (old + moved < here or old < at + removed):
                if skip == len(self.leaves[leaf][0]):
                    leaf, skip = leaf + 1, 0
                    continue
                old += self.leaves[leaf][0][skip]
                skip += 1
            if old >= at + removed and old + moved == here:
                met = True
                break
        if met and leaf < len(self.leaves):
            chars, tokens = chars + self.leaves[leaf][0][skip:], tokens + self.leaves[leaf][1][skip:]
        last = leaf if met else len(self.leaves) - 1
        if len(chars) >= SPLIT_AT:
            whole = [*self.leaves[:first], (chars, tokens), *self.leaves[last + 1 :]]
            flat = [[x for part in whole for x in part[k]] for k in (0, 1)]
            return SegmentTree.of_pre_tokens(*flat), new, fresh
        self.set_leaf(first, chars, tokens)
        for k in range(first + 1, min(last, len(self.leaves) - 1) + 1):
            if self.leaves[k][0]:
                self.set_leaf(k, [], [])
        return self, new, fresh

    def row(self) -> dict:
        chars, tokens = ([x for leaf in self.leaves for x in leaf[k]] for k in (0, 1))
        sums = {"char_sums": self.char_sums, "token_sums": self.token_sums}
        return {"chars": chars, "tokens": tokens, "leaves": [len(c) for c, _ in self.leaves]} | sums

    @classmethod
    def of_row(cls, row: dict) -> SegmentTree:
        tree = cls([])
        at = 0
        for n in row["leaves"]:
            tree.leaves.append((row["chars"][at : at + n], row["tokens"][at : at + n]))
            at += n
        tree.width, tree.char_sums, tree.token_sums = len(row["char_sums"]) // 2, list(row["char_sums"]), list(row["token_sums"])
        return tree


def public_vocabulary() -> tuple[str, str]:
    """The file and the pattern that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def with_trees(docs: DataFrame, vocabulary: tuple[str, str], text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` and ``tree``; columns of these names are replaced.

    Null text counts as empty: no tokens, an empty tree. A text of any length has one tree. Repeated
    rows have a tree each; an empty table gives an empty table.
    """

    def start():
        own = counter(*vocabulary)

        def make(texts: pa.Array) -> list[pa.Array]:
            trees = [SegmentTree.of_text(t.as_py() or "", own) for t in texts]
            return [pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.row() for t in trees], _TREE_ARROW)]

        return make

    return add_columns(docs, [text_col], [StructField("n_tokens", LongType()), StructField("tree", TREE)], start, rows=PIECE)


def apply_edits(docs: DataFrame, edits_col: str, vocabulary: tuple[str, str], text_col: str = "text", with_state: bool = True) -> DataFrame:
    """Every row of ``docs`` with its edits done: text, tree and ``n_tokens`` after them, and ``n_encoded``, the pre-tokens encoded for that.

    ``docs`` has the text, its ``tree``, and an array of edits (at, removed, inserted), done in turn, each
    on the text that the last left; places past the end mean the end, nulls mean 0 or nothing. Null
    edits are none, a null text is empty, a null tree is made from the text. ``with_state=False`` leaves
    out text and tree. Columns named n_tokens or n_encoded are replaced. An edit costs as much as the
    leaves it touches, however long the text. Repeated rows are each edited; an empty table gives an empty table.
    """
    fields = [StructField("n_tokens", LongType()), StructField("n_encoded", LongType())]
    fields += [StructField(text_col, StringType()), StructField("tree", TREE)] if with_state else []

    def start():
        own = counter(*vocabulary)

        def make(texts: pa.Array, trees: pa.Array, all_edits: pa.Array) -> list[pa.Array]:
            made: list[list] = [[], [], [], []]
            for text, tree, edits in zip(texts, trees, all_edits, strict=True):
                text, edits = text.as_py() or "", edits.as_py() or []
                own_tree = SegmentTree.of_row(tree.as_py()) if tree.is_valid else SegmentTree.of_text(text, own)
                fresh = 0
                for e in edits:
                    if e is not None:
                        own_tree, text, n = own_tree.edit(text, e["at"] or 0, e["removed"] or 0, e["inserted"] or "", own)
                        fresh += n
                for values, x in zip(made, (own_tree.tokens, fresh, text, own_tree.row() if with_state else None), strict=True):
                    values.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), _TREE_ARROW][: len(fields)]
            return [pa.array(v, k) for v, k in zip(made, kinds, strict=False)]

        return make

    docs = docs.withColumn(edits_col, docs[edits_col].cast(ArrayType(EDIT)))
    return add_columns(docs, [text_col, "tree", edits_col], fields, start, drop=[text_col, "tree", edits_col], rows=PIECE)


def standard_edits(row_id: Column, text: Column) -> Column:
    """Three edits of a document that depend on its id and length alone: a removal, an insertion and a replacement."""
    size = F.greatest(F.lit(1), F.coalesce(F.length(text), F.lit(0)))

    def place(k: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(k)), size.cast("long")).cast("int")

    def edit(at: Column, removed: int, inserted: str) -> Column:
        return F.struct(at.alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))

    return F.array(edit(place(1), 25, ""), edit(place(2), 0, " an inserted clause, it's 2 words\n"), edit(place(3), 9, "replaced"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens before and after three edits, and how many pre-tokens the edits had encoded."""
    vocabulary = public_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = with_trees(docs, vocabulary).withColumnRenamed("n_tokens", "n_tokens_before")
    docs = docs.withColumn("edits", standard_edits(F.col("doc_id"), F.col("text")))
    out = apply_edits(docs, "edits", vocabulary, with_state=False)
    return out.select("doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_encoded")
