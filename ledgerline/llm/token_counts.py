"""Token counts by byte-pair merging on a heap and a linked list."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerline.llm.common import keyed, table

#: Counts of white-space-free pieces that a task remembers; longer pieces than REMEMBER_CHARS are counted anew.
REMEMBER, REMEMBER_CHARS = 300_000, 48
#: A text is worked through in stretches of about so many characters, cut at blanks.
STRETCH = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Token counts of a tokenizer file with word ends: NFC, white space to blanks, lower case, a split pattern, byte-level BPE.

    The count of a piece is its symbols less its merges; no ids are made. Special strings in the text are one token each.
    """

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, parts = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [p["type"] for p in parts] != ["Split", "ByteLevel"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a BPE file of the kind that is counted here")
        added = spec["added_tokens"]
        if odd := [t["content"] for t in added if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"]]:
            raise ValueError(f"{path}: added tokens that take in what stands around them, or are looked for in normalised text, are not counted here: {odd}")
        names_of = sorted((t["content"] for t in added), key=lambda c: -len(c))
        self.special = re.compile("|".join(map(re.escape, names_of)) or r"(?!)")
        self.starts = tuple({c[0] for c in names_of})
        self.words = regex.compile(parts[0]["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"] or ""
        names: dict[str, int] = {}
        name = lambda s: names.setdefault(s, len(names))
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]):
            self.merges[name(a), name(b)] = (rank, name(a + b))
        known = model["vocab"]
        symbols = byte_symbols()
        self.inner = [name(s) if s in known else None for s in symbols]
        self.last = [name(s + self.end) if s + self.end in known else None for s in symbols]
        self.seen: dict[str, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """Symbols less merges: always the adjacent pair of the lowest rank first, the leftmost of equals."""
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two went into another merge
            symbols[i], symbols[j], left = new, -1, left - 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heappush(heap, (m[0], i, new, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heappush(heap, (m[0], h, symbols[h], new, m[1]))
        return left

    def word(self, word: str) -> int:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.merged([s for s in symbols if s is not None])

    def piece(self, piece: str) -> int:
        """Tokens of a piece without white space; pieces are independent, as the pattern never passes white space."""
        n = sum(map(self.word, self.words.findall(piece)))
        if len(piece) <= REMEMBER_CHARS:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            self.seen[piece] = n
        return n

    def plain(self, text: str) -> int:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # a capital sigma has one small form here
        pieces = low.split() if not _SEPARATORS.search(low) else _SPACE.split(low)
        seen, n = self.seen.get, 0
        for p in pieces:
            k = seen(p)
            n += self.piece(p) if k is None else k
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if any(c in text for c in self.starts) else [text]
        return len(parts) - 1 + sum(self.plain(s) for part in parts for s in stretches(part))


#: Python's split() also cuts at these four, which are no white space in Unicode.
_SEPARATORS, _SPACE = re.compile("[\x1c-\x1f]"), regex.compile(r"\p{White_Space}+")


def stretches(text: str) -> Iterator[str]:
    """The text in stretches that end before a blank, so that no word or combining character is parted."""
    at = 0
    while len(text) - at > STRETCH and (cut := text.find(" ", at + STRETCH)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """For each row of df: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Rows are independent: no shuffle; repeated rows each get their
    count; an empty input gives no rows. `tokenizer` is the file's path on every executor. A task remembers the counts of
    at most REMEMBER short pieces, so its memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return df.select(key, text).mapInArrow(run, keyed(df, key, "n_bytes long, n_tokens long, over_limit boolean"))


def op1(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
