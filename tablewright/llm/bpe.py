"""BPE encoding and decoding by per-prefix dynamic programming.

For a word of n symbols the one valid last token of every prefix is stored:

* a multi-pattern suffix matcher over the vocabulary yields, at each position,
  every token that is a suffix of the prefix;
* the unique one whose predecessor (the stored last token of the shorter
  prefix) is *pair-compatible* is kept: two adjacent tokens are compatible if
  undoing their merges from the latest to the earliest never meets a pair that
  would have merged across their border first;
* back-pointers from the last prefix give the ids, the same as applying all
  merges in rank order, in time linear in the matches.

The vocabulary is a tokenizer file with merges, byte-level symbols and an
end-of-word suffix; a word's last symbol is a different symbol from the same
byte inside the word.  Normalisation and word pattern are those of the file:
NFC, white space runs to one space, lower case, then the word pattern.

Texts are encoded whole, per row, in Arrow batches cut into small slices, so a
task's memory is bounded by its longest text plus a word cache of two
generations of ``CACHE_WORDS`` words, the older of which is dropped when the
newer is full (it changes no result).  A worker keeps its encoder between
tasks, so these bounds also hold for the stages that follow.  A lost task is
simply run again; nothing is shuffled.

Defined cases: a null or empty text, or one with no word, has no ids and
decodes to the empty string; special token strings inside a text become their
single id; repeated rows are encoded alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .store import table

#: Words in each of a worker's two cache generations (about 250 bytes a word), and known pairs (about 120 bytes each).
CACHE_WORDS = 60_000
KNOWN_PAIRS = 200_000
SLICE_ROWS = 128
END = "</w>"
#: A word's last symbol is its byte's character moved up by this much (beyond the 256 byte characters).
LAST = 0x1000

#: The word pattern of the vocabulary file, and its classes among the common characters (Latin blocks, general punctuation).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "\\x00-\u017f\u2000-\u205e\u20ac"
SPACES = "\\x09-\\x0d \x85\xa0\u2000-\u200a\u2028\u2029\u202f"
LETTERS = "a-zªµºß-öø-\u017f"
NUMBERS = "0-9²³¹¼-¾"

#: One encoder per file in each worker process.
_LOADED: dict[str, PrefixEncoder] = {}


def default_vocabulary() -> str:
    """Path of the public word-level vocabulary installed beside the library's dependencies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table_: dict[int, int] = {b: b for b in keep}
    for b in range(256):
        if b not in table_:
            table_[b] = 256 + len(table_) - len(keep)
    return [chr(table_[b]) for b in range(256)]


class PrefixEncoder:
    """Encodes and decodes texts with one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("the vocabulary must be a BPE model with word ends")
        self.names: dict[int, str] = {i: t for t, i in vocab.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = whole
            if whole not in self.split:
                self.split[whole], self.rank[whole] = (left, right), rank
        self.compatible: dict[int, bool] = {}
        self.size = len(vocab) + len(spec.get("added_tokens", []))
        self.matcher = ahocorasick.Automaton()
        reachable: set[int] = set()
        for token, i in sorted(vocab.items(), key=lambda x: self.rank.get(x[1], -1)):
            if i in self.split:
                a, b = self.split[i]
                if a not in reachable or b not in reachable or not self._fits(a, b, self.rank[i]):
                    continue
            reachable.add(i)
            text = token.removesuffix(END) if token.endswith(END) else token
            symbols = text[:-1] + chr(ord(text[-1]) + LAST) if token.endswith(END) else text
            self.matcher.add_word(symbols, (i, len(symbols)))
        self.matcher.make_automaton()
        self.to_symbols = dict(enumerate(byte_characters()))
        self.from_symbols = {c: b for b, c in self.to_symbols.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.plain = pattern == PATTERN
        self.plain_other = re.compile(f"[^{PLAIN}]").search
        self.plain_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+").findall
        self._library = None
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @property
    def library(self):
        """The tokenizers library's own reader of the file, loaded for the first text of rare characters."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _fits(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of rank below ``before`` crosses the border of two tokens."""
        rank, pair, split = self.rank, self.pair, self.split
        while True:
            whole = pair.get((left, right))
            if whole is not None and rank[whole] < before:
                return False
            # undo the later of the two tokens' last merges
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = min(before, a), split[left][1]
            else:
                before, right = min(before, b + 1), split[right][0]

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word given as vocabulary symbols: the table of last tokens, then the back-pointers."""
        known, size, never = self.compatible, self.size, len(self.names) + 1
        last: list[int] = [-1] * (len(symbols) + 1)
        length: list[int] = [0] * (len(symbols) + 1)
        for end, (token, n) in self.matcher.iter(symbols):
            end += 1
            if last[end] < 0:
                if n < end:
                    left = last[end - n]
                    if left < 0:
                        continue
                    fits = known.get(left * size + token)
                    if fits is None:
                        if len(known) >= KNOWN_PAIRS:
                            known.clear()
                        fits = known[left * size + token] = self._fits(left, token, never)
                    if not fits:
                        continue
                last[end], length[end] = token, n
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids (little-endian 32-bit integers) and decoded tokens of one word; the cache has two generations."""
        found = self.older.get(word)
        if found is None:
            symbols = word.encode("utf-8").decode("latin-1").translate(self.to_symbols)
            ids = self.encode_symbols(symbols[:-1] + chr(ord(symbols[-1]) + LAST))
            found = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens.

        Texts of common characters take a fixed-range form of the word pattern; any other text goes through the
        tokenizer library's own normaliser and pattern, so that rare scripts follow its character tables.
        """
        if self.plain and not self.plain_other(text):
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
            return self.plain_words(text.lower())
        back = self.from_symbols
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([back[c] for c in w]).decode("utf-8") for w, _ in pieces]

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """Encoded words and special tokens of a text, in order."""
        parts, at, word = [], 0, self.word
        for m in self.special_pattern.finditer(text) if self.special_pattern and "<|" in text else ():
            parts += [self.cache.get(w) or word(w) for w in self.words(text[at:m.start()])]
            parts.append((struct.pack("<I", self.special[m[0]]), m[0]))
            at = m.end()
        get = self.cache.get  # a full cache is replaced, not emptied: this one stays readable
        return parts + [get(w) or word(w) for w in self.words(text[at:] if at else text)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """All ids as little-endian 32-bit integers, and the decoded text, of a whole text."""
        parts = self.pieces(text)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the file names no decoder, so tokens are joined by one space, special ones included."""
        return " ".join(self.names[int(i)] for i in ids)


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder for a file, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


TYPES = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Per row: ``id_col`` as ``doc_id`` and the chosen outputs.

    ``ids`` and ``decoded`` are the real outputs; ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the
    decoded text in UTF-8) are digests made in the same pass, so that checks
    need not move the ids.  ``vocabulary`` is a path every executor can read
    (None: the installed public file).
    """
    source = docs.select(f"`{id_col}`", f"`{text_col}`").toDF("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *[f"{c} {TYPES[c]}" for c in outputs]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        try:  # the installed module keeps its encoder from task to task; a pickled copy of it would not
            from tablewright.llm.bpe import encoder as shared
        except ImportError:
            shared = encoder
        made = shared(vocabulary or default_vocabulary())
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                rows = [made.encode(t) if t else (b"", "") for t in batch.column(1).to_pylist()]
                columns = [batch.column(0)]
                for c in outputs:
                    if c == "n_tokens":
                        columns.append(pa.array([len(r[0]) // 4 for r in rows], pa.int64()))
                    elif c == "ids":
                        ends = np.cumsum([0, *[len(r[0]) // 4 for r in rows]]).astype("int32")
                        flat = np.frombuffer(b"".join([r[0] for r in rows]), dtype="<i4")
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    elif c == "decoded":
                        columns.append(pa.array([r[1] for r in rows], pa.string()))
                    elif c == "ids_sha256":
                        columns.append(pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()))
                    else:
                        columns.append(pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *outputs])

    return source.mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and decoded text."""
    return encode_texts(table(spark, sf, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
