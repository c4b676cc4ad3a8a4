"""BPE encoding and decoding with forced boundaries.

A byte pair that stands inside no token of the vocabulary can never be merged over: wherever it
occurs, the tokens on both sides are independent. Each pre-token is cut at all such pairs, each
fragment is encoded by itself and the ids are concatenated. Fragments and words repeat far more often
than texts do, so each task keeps a bounded table of those it has met.

Every row is encoded where it is read: no shuffle, and a task works on a bounded piece of rows, or one text, at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import add_columns, table

WORD_END = "</w>"
#: Words kept by a task; longer words than KEEP_CHARS are not kept.
KEEP_WORDS, KEEP_CHARS = 150_000, 48
#: Columns that ``bpe`` can add.
OUTPUTS = {
    "n_tokens": LongType(),
    "ids": ArrayType(IntegerType(), False),
    "decoded": StringType(),
    "ids_sha256": StringType(),
    "decoded_sha256": StringType(),
}
#: Texts of these characters only need no Unicode tables that may differ between libraries' versions.
LATIN = re.compile("[\x00-ſ]*")
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \x85\xa0"
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Codec:
    """The tokenizer of a file of the ``tokenizers`` library: BPE over byte letters with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if model.get("end_of_word_suffix") != WORD_END or spec.get("decoder") is not None:
            raise ValueError("the file isn't of a BPE model with word ends and plain decoding")
        # The library normalises and splits texts; that takes no vocabulary.
        self.whole = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None}))
        self.ending, self.inner = BPE(vocab, merges, end_of_word_suffix=WORD_END), BPE(vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        bodies = (t.removesuffix(WORD_END) for t in vocab)
        self.inside = {t[i : i + 2] for t in bodies for i in range(len(t) - 1)}
        self.letters = dict(enumerate(byte_letters()))
        codec = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = codec.encode_word(word)
                if len(word) <= KEEP_CHARS:
                    if len(self) >= KEEP_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def fragments(self, letters: str) -> list[str]:
        """A word's byte letters, cut at every pair that no token contains."""
        if self.inside.issuperset(map(add, letters, letters[1:])):
            return [letters]
        cuts = [i + 1 for i in range(len(letters) - 1) if letters[i : i + 2] not in self.inside]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit numbers."""
        parts = self.fragments(word.encode().decode("latin-1").translate(self.letters))
        found = [t.id for p in parts[:-1] for t in self.inner.tokenize(p)]
        found += [t.id for t in self.ending.tokenize(parts[-1])]
        return struct.pack(f"<{len(found)}I", *found)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii() or LATIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return LATIN_WORDS.findall(text.lower())
        norm = self.whole.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(norm)]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers. Special tokens in it stand for themselves."""
        if self.split is None or "<" not in text:
            return b"".join(map(self.words.__getitem__, self.pre_tokens(text)))
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += map(self.words.__getitem__, self.pre_tokens(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with spaces between, as the library joins them where a file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def bpe(df: DataFrame, path: str, outputs: Iterable[str] = ("ids",), text_col: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with the wanted ``OUTPUTS`` columns, decoded from the ids just made, and without the columns in ``drop``.

    ``path`` names the tokenizer file on every machine. Null text counts as empty: no ids, and an
    empty decoded text. Texts of any length are encoded whole. Repeated rows are each encoded; columns
    that are named as an output are dropped; an empty table gives an empty table.
    """
    wanted = list(outputs)
    if unknown := set(wanted) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

    def start():
        own = Codec(path)

        def make(texts: pa.Array) -> list[pa.Array]:
            made: dict[str, list] = {n: [] for n in wanted}
            for text in texts:
                raw = own.encode(text.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = own.decode(ids)
                for n, values in made.items():
                    if n == "n_tokens":
                        values.append(len(ids))
                    elif n == "ids":
                        values.append(ids.astype(np.int32))
                    elif n == "decoded":
                        values.append(decoded)
                    else:
                        values.append(hashlib.sha256(raw if n == "ids_sha256" else decoded.encode()).hexdigest())
            return [pa.array(made[n], kinds.get(n, pa.string())) for n in wanted]

        return make

    return add_columns(df, [text_col], [StructField(n, OUTPUTS[n]) for n in wanted], start, drop)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row of ``df`` with the text of its ids; null ids give a null text, no ids an empty one.

    Rows with very many ids are decoded whole and repeated rows each. A column named ``out_col`` is
    replaced; an empty table gives an empty table. An id that the vocabulary lacks raises.
    """

    def start():
        own = Codec(path)
        return lambda ids: [pa.array([None if x is None else own.decode(np.array(x, np.int64)) for x in ids.to_pylist()], pa.string())]

    return add_columns(df.withColumn(ids_col, df[ids_col].cast("array<int>")), [ids_col], [StructField(out_col, StringType())], start)


def public_path() -> str:
    """The tokenizer file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of ids, and digests of the ids and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, public_path(), ("n_tokens", "ids_sha256", "decoded_sha256"), drop=["text"])
