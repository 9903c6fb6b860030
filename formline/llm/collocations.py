"""Collocations per language: n-grams counted by Rabin-Karp fingerprints, frequent ones read back from text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.arrow_words import pieces
from formline.llm.common import join_groups, look_up, materialise, release, ship, sweep
from formline.llm.minhash import mix

ship(__name__)

#: Odd bases of the two polynomials, one for the fingerprint and one that checks it, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)
#: Bytes that end a piece, and blanks inside one.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of the map that tells which shorter n-grams are frequent: 16 MB at any size of the corpus.
FILTER_BITS = 27
#: Counted n-grams that a task holds before it adds up equal ones, and bytes of text that it cuts at once.
HELD, PIECE_BYTES = 1_000_000, 1_000_000

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, lower-cased in A-Z, one after another; each word's text, and how many words its piece has from it on."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else texts.take(pa.array(np.arange(len(texts))))
    off = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: off[-1]] if off[-1] else np.zeros(0, np.uint8)
    kind = _KIND[data]
    word = np.concatenate([[False], kind == 0, [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # where one text ends and the next begins
    first = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    last = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:]))
    ends = np.concatenate([[0], np.cumsum(last - first + 1)])
    bytes_ = _LOWER[data[word[1:-1]]]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bytes_))
    doc = np.searchsorted(off, first, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), first)
    n = len(first)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    starts = np.flatnonzero(new)
    size = np.diff(np.concatenate([starts, [n]]))
    return words, doc, np.repeat(starts + size, size) - np.arange(n)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Polynomials:
    """Fingerprints of all n-grams of a run of words, from two prefix sums of word hashes times powers of a base."""

    powers: list[list[np.ndarray]] = []  # grown once per worker

    def __init__(self, words: pa.Array, doc: np.ndarray, left: np.ndarray, langs: np.ndarray, bits: int):
        import xxhash

        coded = words.dictionary_encode()
        known = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.as_buffer()) for w in coded.dictionary), np.uint64).reshape(-1, 2)
        at = coded.indices.to_numpy()
        self.left, self.lang, self.bits, self.sums = left, langs[doc], bits, []
        n = len(at)
        if not self.powers or len(self.powers[0][0]) < n:
            type(self).powers = [[_powers(b, max(n, 1 << 18)) for b in kind] for kind in (BASES, INVERSES)]
        for c in range(2):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(known[at, c] * self.powers[0][c][:n], out=total[1:])
            self.sums.append(total)

    def prints(self, at: np.ndarray, m: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, check) of the m words from each place on; language and length go into both."""
        out = []
        for c in range(2):
            whole = (self.sums[c][at + m] - self.sums[c][at]) * self.powers[1][c][at]
            out.append(mix(mix(whole + np.uint64(BASES[1 - c]) * np.asarray(m).astype(np.uint64)) ^ self.lang[at]))
        return out[0] & np.uint64((1 << self.bits) - 1), out[1]


def _lang_hash(langs: pa.Array) -> np.ndarray:
    import xxhash

    coded = langs.dictionary_encode()
    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]


def counted(rows: DataFrame, lengths: tuple[int, ...], known: int, allowed, least: int, bits: int, pointers: bool = True) -> DataFrame:
    """Frequent n-grams (fp, check, m, c, rk, pos) of these lengths: their count and a pointer to one occurrence.

    ``rows`` has (rk, lang, text); an n-gram is counted if ``allowed``, a broadcast bit map, has all its parts of
    ``known`` words (None: all n-grams). A task adds up what it holds; the shuffle adds up the rest. Without
    ``pointers`` there are only (fp, c), where colliding fingerprints are one.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def settle() -> list[np.ndarray]:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(parts[0], kind="stable")
            new = np.ones(len(order), bool)
            for i, key in enumerate(parts[: 2 if pointers else 1]):
                key = key[order]
                new[1:] = (key[1:] != key[:-1]) | (new[1:] if i else False)
            at = np.flatnonzero(new)
            c = np.add.reduceat(parts[-1][order], at)
            return [*(x[order[at]] for x in parts[:-1]), c]

        def batch(x: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in x], ["fp", "check", "rk", "pos", "m", "c"] if pointers else ["fp", "c"])

        for b in batches:
            for part in pieces(b, 2, PIECE_BYTES):
                words, doc, left = piece_words(part.column(2))
                if not len(words):
                    continue
                poly = Polynomials(words, doc, left, _lang_hash(part.column(1)), bits)
                rk, first = part.column(0).to_numpy(), np.searchsorted(doc, np.arange(part.num_rows))
                if allowed is not None:
                    at = np.flatnonzero(left >= known)
                    ok = np.zeros(len(left), bool)
                    where = (poly.prints(at, known)[0] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    ok[at] = (np.frombuffer(allowed.value, np.uint8)[where >> 3] >> (where & 7).astype(np.uint8)) & 1
                for m in lengths:
                    at = left >= m
                    if allowed is not None:
                        for j in range(m - known + 1):
                            at[: len(at) - j] &= ok[j:]
                    at = np.flatnonzero(at)
                    fp, check = poly.prints(at, m)
                    one = np.ones(len(at), np.int64)
                    held.append([fp, check, rk[doc[at]], (at - first[doc[at]]).astype(np.int32), np.full(len(at), m, np.int8), one] if pointers else [fp, one])
                    size += len(at)
                if size > HELD:
                    one = settle()
                    size = len(one[0])
                    if size > HELD // 2:
                        yield batch(one)
                        size = 0
                    else:
                        held.append(one)
        if size:
            yield batch(settle())

    kinds = "fp long, check long, rk long, pos int, m tinyint, c long" if pointers else "fp long, c long"
    parts = rows.select("rk", "lang", "text").mapInArrow(run, kinds)
    # the two parts of a pointer come from one row: both are a group's first
    found = parts.groupBy(*(["fp", "check", "m"] if pointers else ["fp"])).agg(F.sum("c").alias("c"), *([F.first("rk").alias("rk"), F.first("pos").alias("pos")] if pointers else []))
    return materialise(found.where(F.col("c") >= least), "frequent")


def bit_map(frequent: DataFrame):
    """A broadcast map of ``FILTER_BITS`` bits, set for each fingerprint; the driver gets its words, of fixed number, alone."""
    spark = frequent.sparkSession
    at = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = frequent.select(F.shiftrightunsigned(at, 5).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((fp & {(1 << FILTER_BITS) - 1}) & 31 as int))").alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(bits.tobytes())


def phrases_at(rows: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """(lang, phrase, words, f): the text of each frequent n-gram, read at its pointer and held against its fingerprint and check."""
    wanted = frequent.groupBy("rk").agg(F.collect_list(F.struct("fp", "check", "c", "pos", "m")).alias("wanted"))

    def run(batches):
        for b in batches:
            for part in pieces(b, 1, PIECE_BYTES):
                words, doc, left = piece_words(part.column(1))
                if not len(words):
                    continue
                poly = Polynomials(words, doc, left, _lang_hash(part.column(0)), bits)
                lists = part.column(2)
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                fp, check, c, pos, m = (x.to_numpy() for x in lists.flatten().flatten())
                at = np.searchsorted(doc, of) + pos
                some = at < len(left)
                some[some] = left[at[some]] >= m[some]
                of, fp, check, c, at, m = of[some], fp[some], check[some], c[some], at[some], m[some].astype(np.int64)
                got = poly.prints(at, m)
                right = np.flatnonzero((got[0] == fp.view(np.uint64)) & (got[1] == check.view(np.uint64)))
                texts = [words.slice(a, k).to_pylist() for a, k in zip(at[right], m[right], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of[right])), pa.array([" ".join(t) for t in texts], pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(c[right])],
                    ["lang", "phrase", "words", "f"],
                )

    found = rows.join(wanted.hint("merge"), "rk").select("lang", "text", "wanted").mapInArrow(run, "lang string, phrase string, words array<string>, f long")
    return materialise(found.dropDuplicates(["lang", "phrase"]), "phrases")  # rows may repeat


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, percent: int = 80, key: str = "doc_id", bits: int = 64) -> DataFrame:
    """Each language's strongest phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and tabs; A-Z is
    lower-cased. Per language, n counts words, f a phrase's occurrences within pieces, overlapping ones too. A
    candidate has a = f of ``least`` or more; cut after its first k words it has l = f(first), r = f(rest) and the score
    floor(2000000 a / (l + r)), and the lowest-scoring cut counts, of equal ones the first. Candidates that lie in a
    longer one of at least ``percent`` of their occurrences go. Ranks follow score and a, falling, then the phrase in
    UTF-8 byte order.

    Words are counted first, then the fingerprints of pairs of frequent words alone, then, with pointers, n-grams all
    of whose pairs are frequent, as any part of a frequent n-gram is; a bit map of fixed size stands for the frequent
    ones, and lets some more through where it is full. Two polynomials, 128 bits, keep counts apart, so colliding fingerprints (``bits`` narrows them
    in tests) don't mix; a frequent phrase's text is read at its pointer and hashed again.

    Null and empty texts have no words; a null language is ``und``. Null and repeated ids and repeated rows all count;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text <> ''").select(F.xxhash64("id", "lang", "text").alias("rk"), "lang", "text")
    single = counted(rows, (1,), 0, None, least, bits)
    allowed = bit_map(single)
    pairs = counted(rows, (2,), 1, allowed, least, bits, pointers=False)
    allowed.destroy()
    sweep(docs.sparkSession)
    allowed = bit_map(pairs)
    longer = counted(rows, tuple(range(2, longest + 1)), 2, allowed, least, bits)
    allowed.destroy()
    sweep(docs.sparkSession)
    frequent = single.unionByName(longer)
    phrases = phrases_at(rows, frequent, bits)
    for t in (single, pairs, longer):
        release(t)
    return ranked(phrases, word_counts(rows), top, percent)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, n): words per language."""

    def run(batches):
        total: dict[str, int] = {}
        for b in batches:
            for part in pieces(b, 1, PIECE_BYTES):
                words, doc, _ = piece_words(part.column(1))
                for lang, n in zip(part.column(0).to_pylist(), np.bincount(doc, minlength=part.num_rows).tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def ranked(phrases: DataFrame, totals: DataFrame, top: int, percent: int) -> DataFrame:
    """The report from frequent phrases (lang, phrase, words, f) and (lang, n)."""
    size = F.size("words")
    longer = phrases.where(size > 2)
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inside = longer.select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))
    wide = "decimal(38,0)"
    cands = phrases.where(size > 1).join(inside, ["lang", "phrase"], "left")
    cands = cands.where(f"f_longer IS NULL OR 100 * cast(f_longer AS decimal(25,0)) < {percent} * cast(f AS decimal(25,0))").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = cands.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "words")
    parts = cuts.select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("part")))).alias("p"),
    ).select("lang", "phrase", "a", "k", "p.side", "p.part")
    uses = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("uses"))
    uses = materialise(uses.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]), "uses")
    both = join_groups(parts, uses, ["lang", "part"], "uses").groupBy("lang", "phrase", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(s) for s in ("l", "r")))
    both = both.withColumn("score", F.expr("2000000 * cast(a AS decimal(25,0)) div (l + r)").cast("long"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # in two steps, so that no task orders all phrases of a language
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(8, int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    best = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("salt")
    return look_up(best, materialise(totals, "totals"), "lang", "n").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
