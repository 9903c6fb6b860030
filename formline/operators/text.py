"""Signals from text attached to entries: phrase counts by category and similarity to anchor vectors."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases by category.
LEXICON = {
    "trouble": (
        "interfered", "interference", "crowded", "checked", "blocked", "no clear run", "denied a run", "denied the run", "steadied", "tightened",
        "hampered", "carried wide", "had to be checked", "lost ground", "awkwardly placed", "held up for a run", "no room", "shut out", "bumped", "made contact",
    ),
    "slow_start": (
        "slow to begin", "slow into stride", "began awkwardly", "missed the break", "slowly away", "fractious", "reared", "dwelt", "jumped awkwardly", "slow to stride",
    ),
    "ran_on": (
        "ran on", "kept on", "finished well", "finished strongly", "strong to the line", "stuck on", "kept on well", "ran on strongly", "rallied", "responded",
    ),
    "easing": (
        "easing", "eased down", "comfortably", "in hand", "untroubled", "won easily", "with something in hand", "going away", "cleverly", "as he pleased",
    ),
    "weakened": (
        "weakened", "faded", "tired", "gave way", "no extra", "found nothing", "dropped out", "could not quicken", "one paced", "failed to respond",
    ),
    "wide": ("wide", "three deep", "four deep", "caught wide", "raced wide", "wide throughout", "no cover", "exposed"),
    "health": (
        "bled", "lame", "lost action", "pulled up", "distressed", "lost its action", "unbalanced", "stumbled", "struck into", "cardiac", "irregular",
    ),
}


def _in_word(ch: str) -> bool:
    """Letters, digits, marks, connectors and joiners stand in words."""
    kind = unicodedata.category(ch)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or ch in "\u200c\u200d"


def automaton(lexicon: tuple[tuple[str, tuple[str, ...]], ...]):
    """An Aho-Corasick automaton over all phrases of all categories.

    A phrase's end gives its length, whether its ends are parts of words, and how often each category lists it.
    """
    import ahocorasick

    made = ahocorasick.Automaton()
    uses: dict[str, dict[int, int]] = {}
    for i, (_, phrases) in enumerate(lexicon):
        for p in phrases:
            if p:
                at = uses.setdefault(p.lower(), {})
                at[i] = at.get(i, 0) + 1
    for p, at in uses.items():
        made.add_word(p, (len(p), _in_word(p[0]), _in_word(p[-1]), tuple(at.items())))
    if uses:
        made.make_automaton()
    return made


def count_phrases(text: str, found, categories: int) -> list[int]:
    """Occurrences per category of phrases whose ends are word boundaries, from one pass over ``text``."""
    out = [0] * categories
    if not len(found):
        return out
    n = len(text)
    for end, (size, head, tail, uses) in found.iter(text):
        start = end - size + 1
        if (start > 0 and _in_word(text[start - 1])) != head and (end + 1 < n and _in_word(text[end + 1])) != tail:
            for i, k in uses:
                out[i] += k
    return out


def phrase_counts(text: Column, lexicon: Mapping[str, Sequence[str]] = LEXICON) -> dict[str, Column]:
    """For each category how often its phrases stand in a text as whole words, case aside; overlaps all count.

    One pass over a text serves all phrases of all categories, so its time doesn't grow with their number. A phrase
    that a category lists twice counts twice. A null or empty text counts 0; an empty phrase never stands anywhere.
    """
    names, fixed = list(lexicon), tuple((name, tuple(phrases)) for name, phrases in lexicon.items())
    if not names:
        return {}

    columns = [f"c{i}" for i in range(len(names))]

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in columns]))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(fixed)  # once a task
        for texts in batches:
            yield pd.DataFrame([count_phrases(t, found, len(names)) for t in texts], columns=columns)

    made = counts(F.lower(F.coalesce(text, F.lit(""))))
    return {name: made[f"c{i}"] for i, name in enumerate(names)}


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; null if either is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def anchor_similarity(df: DataFrame, vector: str, anchors: DataFrame, name: str, anchor: str, key: Sequence[str], most: int = 1000) -> DataFrame:
    """One row per key and anchor with their cosine. The anchors are gathered into one row: ``most`` at most."""
    held = anchors.select(F.col(name).alias("name"), F.col(anchor).alias("vec")).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} anchors")
    cells = F.array(*(F.struct(F.lit(r["name"]).alias("name"), F.array(*(F.lit(float(v)) for v in r["vec"])).alias("vec")) for r in held))
    rows = df.select(*key, F.col(vector).alias("_v"), F.explode(cells).alias("_a"))
    return rows.select(*key, F.col("_a.name").alias("anchor"), cosine(F.col("_v"), F.col("_a.vec")).alias("similarity"))
