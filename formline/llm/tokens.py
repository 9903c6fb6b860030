"""Token counts of a byte-level BPE vocabulary with word ends, by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import ship

ship(__name__)

#: Distinct pre-tokens whose counts a Python worker keeps; beyond, it starts afresh.
CACHE = 500_000
#: Rank of a pair that no merge joins.
_NEVER = np.int64(1 << 40)
#: Small letters that Python's tables lack or give by context.
LATER_LETTERS = {"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7dc": "\u019b"}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: the byte itself where it prints, else 256 and up in turn."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return [chr(b if b in own else 256 + rest.index(b)) for b in range(256)]


class Merges:
    """A vocabulary's merges as sorted pair keys with ranks and results, and the first symbol of each byte."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        chars = byte_characters()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"] if t.get("special")]
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        made = {a + b: i for i, (a, b) in reversed(list(enumerate(pairs)))}
        #: Whether no merge precedes the making of its parts; then all places of a pair can be joined at once.
        self.ordered = all(made.get(a, -1) < i and made.get(b, -1) < i for i, (a, b) in enumerate(pairs))


def count_symbols(words: list[str], m: Merges) -> np.ndarray:
    """Symbols left of each pre-token once no pair can be joined.

    All sequences lie in one flat array. In each round every sequence finds its own lowest rank and joins all places
    of that pair, from the left where places overlap; finished sequences leave the array.
    """
    data = [w.encode("utf-8") for w in words]
    length = np.array([len(d) for d in data], np.int64)
    out = np.zeros(len(words), np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    seq = np.repeat(np.arange(len(words)), length)
    sym = m.inner[flat]
    ends = np.cumsum(length)[length > 0] - 1
    sym[ends] = m.final[flat[ends]]
    known = sym >= 0
    sym, seq = sym[known], seq[known]
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        rank = np.full(len(sym), _NEVER)
        if len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
            fits = (m.keys[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][fits] = m.ranks[at[fits]]
        size = np.diff(np.r_[starts, len(sym)])
        low = np.minimum.reduceat(rank, starts)
        done = low == _NEVER
        out[seq[starts[done]]] = size[done]
        low = np.repeat(low, size)
        here = np.flatnonzero((rank == low) & (rank < _NEVER))
        if not len(here):
            break
        if m.ordered:  # of places that overlap, each second one from the left
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(here) > 1], np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
        else:
            here = here[np.r_[True, seq[here][1:] != seq[here][:-1]]]
        sym[here] = m.joined[np.searchsorted(m.keys, sym[here] << 32 | sym[here + 1])]
        left = low < _NEVER
        left[here + 1] = False
        sym, seq = sym[left], seq[left]
    return out


class Counter:
    """Counts the tokens of texts. Pre-tokens never hold white space, so a text's count is the sum over the pieces
    between white space; the counts of pieces already met are kept."""

    def __init__(self, m: Merges):
        import regex

        self.m, self.seen = m, {}
        self.find = regex.compile(m.pattern).findall
        self.special = re.compile("|".join(map(re.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
        #: White space for str.split, yet not for the pattern.
        self.odd = re.compile("[\x1c-\x1f]")

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pieces of a text, and how many special strings stand in it."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1 and not self.odd.search(text):
            return text.split(), 0
        return [x for p in parts for x in re.split(r"[^\S\x1c-\x1f]+", p) if x], len(parts) - 1

    def pre_tokens(self, piece: str) -> list[str]:
        """Normalised and split: NFC, then small letters, where a sigma has one form whatever follows it."""
        plain = unicodedata.normalize("NFC", piece)
        for big, little in LATER_LETTERS.items():
            plain = plain.replace(big, little)
        return self.find(plain.lower())

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        seen = self.seen
        new = {x for pieces, _ in split for x in pieces if x not in seen}
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = {x for pieces, _ in split for x in pieces}
        if new:
            cut = {x: self.pre_tokens(x) for x in new}
            words = list({w for ws in cut.values() for w in ws})
            n = dict(zip(words, count_symbols(words, self.m).tolist(), strict=True))
            seen.update((x, sum(map(n.__getitem__, ws))) for x, ws in cut.items())
        return [sum(map(seen.__getitem__, pieces)) + n for pieces, n in split]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, step: int = 500) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``path`` names the vocabulary file, read once on the driver; its merges, some 1 MB, go to the executors. Special
    strings inside a text count as one token each. Whole texts are counted, ``step`` rows at a time. A null text
    counts as empty: 0 bytes, 0 tokens. Null ids stay null; repeated rows are counted each; an empty table gives an
    empty result; other columns are not read. There is no shuffle.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches):
        counter = Counter(merges.value)
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = pa.array(counter.count(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, part.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
