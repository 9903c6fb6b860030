"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.arrow_words import hash_known, pieces, split_words
from formline.llm.common import ship

ship(__name__)

TRIM = ".,;:!?\"'()[]{}<>*_-…«»¡¿#%&$@+=~^|/"
#: Lengths in characters of the beginnings of a word that are hashed beside the word.
BEGINNINGS = (4, 5, 6, 7)
#: Words by which a language is told for its threshold: those whose share in it exceeds that in any other by most.
TELLING_WORDS = 60


@dataclass
class Network:
    """Hashed embedding rows of a word and its beginnings, summed; filters of several widths; max pooling; a logistic.

    Each filter's largest response is taken in every segment of ``segment`` words. The logistic sees, for each filter,
    the largest of these and their mean, so that one stray word and a text full of such words differ.
    """

    buckets: int = 1 << 20
    size: int = 4
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    segment: int = 40
    seed: int = 11
    emb: np.ndarray = field(init=False, repr=False)
    conv: list = field(init=False, repr=False)
    out: np.ndarray = field(init=False, repr=False)
    bias: float = field(init=False, default=-1.0)
    shift: dict = field(init=False, default_factory=lambda: {"": 0.0})
    told: dict = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.emb = np.zeros((self.buckets, self.size), np.float32)
        self.conv = [[rng.normal(0, 0.5, (self.size, self.filters)).astype(np.float32) for _ in range(w)] for w in self.widths]
        self.out = np.abs(rng.normal(0, 0.3, 2 * len(self.widths) * self.filters)).astype(np.float32) + 0.1

    def dump(self) -> bytes:
        """The network as bytes; embedding rows that never changed are left out."""
        at = np.flatnonzero(self.emb.any(1))
        out = io.BytesIO()
        np.savez_compressed(out, at=at, emb=self.emb[at], out=self.out, bias=self.bias, shift=json.dumps(self.shift), told=json.dumps({k: v.tolist() for k, v in self.told.items()}), **{f"c{w}_{j}": c for w, cs in enumerate(self.conv) for j, c in enumerate(cs)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        net, held = cls(), np.load(io.BytesIO(data))
        net.emb[held["at"]] = held["emb"]
        net.out, net.bias, net.shift = held["out"], float(held["bias"]), json.loads(str(held["shift"]))
        net.told = {k: np.array(v, np.uint64) for k, v in json.loads(str(held["told"])).items()}
        net.conv = [[held[f"c{w}_{j}"] for j in range(len(cs))] for w, cs in enumerate(net.conv)]
        return net

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """Word vectors from an array (words, parts) of bucket numbers."""
        x = self.emb[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            x += self.emb[rows[:, j]]
        return x

    def responses(self, x: np.ndarray, count: np.ndarray, w: int) -> np.ndarray:
        """Filter responses at each word; words past the text's end are zero."""
        left = np.repeat(np.cumsum(count), count) - np.arange(len(x))  # words from here to the text's end
        r = x @ self.conv[w][0]
        for j in range(1, self.widths[w]):
            p = x[j:] @ self.conv[w][j]
            p[left[: len(x) - j] <= j] = 0
            r[: len(x) - j] += p
        return r

    def segments(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each segment, the text it lies in, and the number of segments of each text."""
        n = -(-count // self.segment)
        of = np.repeat(np.arange(len(count)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (np.cumsum(count) - count)[of] + inside * self.segment, of, n

    def features(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        k = len(self.widths) * self.filters
        f = np.zeros((len(count), 2 * k), np.float32)
        if not len(x):
            return f
        starts, _, n = self.segments(count)
        some = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[some]
        for w in range(len(self.widths)):
            top = np.maximum.reduceat(self.responses(x, count, w), starts, axis=0)
            cols = slice(w * self.filters, (w + 1) * self.filters)
            f[some, cols] = np.maximum.reduceat(top, first, axis=0)
            f[some, k + cols.start : k + cols.stop] = np.add.reduceat(top, first, axis=0) / n[some][:, None]
        return f

    def logits(self, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.features(self.embed(rows), count) @ self.out + self.bias

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, visits: int = 30_000, batch: int = 32, rate: float = 0.1) -> None:
        """Adagrad on the log-loss, labels weighted alike; gradients flow through the places that pooling picked.

        There are as many rounds as make ``visits`` texts, 6 at least and 60 at most.
        """
        rng = np.random.default_rng(self.seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        start = 1e-3
        emb_seen = np.full(self.buckets, start, np.float32)
        conv_seen = [[np.full_like(c, start) for c in cs] for cs in self.conv]
        out_seen, bias_seen = np.full_like(self.out, start), start
        k = len(self.widths) * self.filters
        for _ in range(min(60, max(6, visits // max(1, len(texts))))):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                count = np.array([len(texts[i]) for i in pick])
                if not count.sum():
                    continue
                rows = np.concatenate([texts[i] for i in pick])
                x = self.embed(rows)
                starts, of, n = self.segments(count)
                ends = np.minimum(starts + self.segment, (np.cumsum(count))[of])
                grid = np.minimum(starts[:, None] + np.arange(self.segment), ends[:, None] - 1)
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                f = np.zeros((len(pick), 2 * k), np.float32)
                places, peaks = [], []
                for w in range(len(self.widths)):
                    r = self.responses(x, count, w)[grid]
                    top = r.argmax(1)
                    places.append(np.take_along_axis(grid, top, 1))
                    peak = np.take_along_axis(r, top[:, None, :], 1)[:, 0]
                    peaks.append(peak)
                    cols = slice(w * self.filters, (w + 1) * self.filters)
                    f[some, cols] = np.maximum.reduceat(peak, first, axis=0)
                    f[some, k + cols.start : k + cols.stop] = np.add.reduceat(peak, first, axis=0) / n[some][:, None]
                z = f @ self.out + self.bias
                g = ((1 / (1 + np.exp(-z)) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grad_x = np.zeros_like(x)
                text_end = np.cumsum(count)[of]
                for w, width in enumerate(self.widths):
                    cols = slice(w * self.filters, (w + 1) * self.filters)
                    at_top = peaks[w] >= f[of, cols]
                    back = g[of][:, None] * (self.out[cols] * at_top + self.out[k + cols.start : k + cols.stop] / n[of][:, None])
                    for j in range(width):
                        step = np.zeros_like(self.conv[w][j])
                        for q in range(self.filters):
                            place = places[w][:, q] + j
                            ok = place < text_end
                            step[:, q] = back[ok, q] @ x[place[ok]]
                            np.add.at(grad_x, place[ok], back[ok, q][:, None] * self.conv[w][j][:, q][None, :])
                        conv_seen[w][j] += step**2
                        self.conv[w][j] -= rate * step / np.sqrt(conv_seen[w][j])
                step = g @ f
                out_seen += step**2
                self.out -= rate * step / np.sqrt(out_seen)
                bias_seen += float(g.sum()) ** 2
                self.bias -= rate * float(g.sum()) / float(np.sqrt(bias_seen))
                hit = np.flatnonzero(np.abs(grad_x).sum(1))
                for j in range(rows.shape[1]):
                    which, back_to = np.unique(rows[hit, j], return_inverse=True)
                    step = np.zeros((len(which), self.size), np.float32)
                    np.add.at(step, back_to, grad_x[hit])
                    emb_seen[which] += (step**2).mean(1)
                    self.emb[which] -= rate * step / np.sqrt(emb_seen[which])[:, None]

    def calibrate(self, z: np.ndarray, labels: np.ndarray, languages: np.ndarray, least: int = 10) -> None:
        """For each language the threshold of best F1; the overall one where a language has few examples of a label."""

        def best(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            z, y = z[order], y[order]
            hit = np.cumsum(y)
            f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
            k = int(f1.argmax())
            below = z[k + 1] if k + 1 < len(z) else z[k] - 1
            return float((z[k] + below) / 2)

        self.shift = {"": best(z, labels) if labels.any() else 0.0}
        for lang in np.unique(languages):
            on = languages == lang
            if lang and labels[on].sum() >= least and (1 - labels[on]).sum() >= least:
                self.shift[str(lang)] = best(z[on], labels[on])


def word_rows(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (words, parts), the plain hash of each word, and the number of words of each text."""
    words, count = split_words(texts)
    known = pc.utf8_trim(words.dictionary, characters=TRIM)
    parts = [hash_known(known)]
    for n in BEGINNINGS:
        parts.append(hash_known(pc.utf8_slice_codeunits(known, 0, n)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
    rows = np.stack([(p >> np.uint64(20)) & np.uint64(buckets - 1) for p in parts], 1).astype(np.int32)
    at = words.indices.to_numpy()
    return rows[at], parts[0][at], count


def telling_words(h: np.ndarray, count: np.ndarray, languages: np.ndarray, least: int = 20) -> dict[str, np.ndarray]:
    """Hashes of the words that tell each language of at least ``least`` texts from the others; null has no words."""
    known, at = np.unique(h, return_inverse=True)
    names = [x for x in sorted({x for x in languages if x}) if (languages == x).sum() >= least]
    of = np.repeat(languages, count)
    share = np.stack([np.bincount(at[of == x], minlength=len(known)) / max(1, (of == x).sum()) for x in names]) if names else np.zeros((0, len(known)))
    out = {}
    for i, name in enumerate(names):
        lead = share[i] - np.delete(share, i, 0).max(0, initial=0.0)
        top = np.argsort(-lead, kind="stable")[:TELLING_WORDS]
        out[name] = np.sort(known[top[lead[top] > 0]])
    return out


def guess_language(h: np.ndarray, count: np.ndarray, told: dict[str, np.ndarray]) -> np.ndarray:
    """The language most of whose telling words a text has; empty if it has none of any."""
    some = np.flatnonzero(count)
    out = np.full(len(count), "", object)
    if len(some) and told:
        starts = (np.cumsum(count) - count)[some]
        words = np.sort(np.unique(np.concatenate(list(told.values()))))
        at = np.searchsorted(words, h)
        hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == h)
        n = np.zeros((len(told), len(h)), np.int32)
        for i, v in enumerate(told.values()):
            n[i, hit] = np.isin(words, v)[at[hit]]
        n = np.add.reduceat(n, starts, axis=1)
        names = np.array(list(told), object)
        out[some] = np.where(n.max(0) > 0, names[n.argmax(0)], "")
    return out


def held_out(doc_id):
    """Rows that no model learns from: a fifth of all, by the CRC of the id's text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 4000, train_chars: int = 20_000) -> Network:
    """A network learnt from at most ``train_rows`` labelled documents of at most ``train_chars`` characters each.

    The rows are the first labelled ones with such a document, in the order of a hash of the id, held-out ids excluded;
    both bounds also bound what the one task that learns gets. A row's ``lang``, where there is that column, only tells
    which words are telling of a language; no score sees it. The driver sees the finished network alone, some megabytes.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = docs.where(F.length("text") <= train_chars)
    chosen = known.join(fit.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = fit.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(train_rows).select("text", F.col("toxic").cast("int").alias("toxic"), "lang")

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([learn_network(held).dump()], pa.binary())], ["model"])

    got = rows.coalesce(1).mapInArrow(learn, "model binary").first()  # none where there is not even a task
    return Network.load(got[0]) if got else Network()


def learn_network(batches: list[pa.RecordBatch]) -> Network:
    """A network from batches of (text, toxic, lang): weights from four rows of five, thresholds from the fifth alone."""
    net = Network()
    made = [word_rows(part.column(0), net.buckets) for b in batches for part in pieces(b, 0)]
    if not made:
        return net
    count = np.concatenate([c for _, _, c in made])
    h = np.concatenate([x for _, x, _ in made])
    y = np.concatenate([b.column(1).to_numpy() for b in batches]).astype(np.int64)
    net.told = telling_words(h, count, np.array([x or "" for b in batches for x in b.column(2).to_pylist()], object))
    texts = [t for p, _, c in made for t in np.split(p, np.cumsum(c)[:-1])]
    learn = np.arange(len(y)) % 5 != 0
    net.fit([t for t, on in zip(texts, learn, strict=True) if on], y[learn])
    z = np.concatenate([net.logits(p, c) for p, _, c in made])
    net.calibrate(z[~learn], y[~learn], guess_language(h, count, net.told)[~learn])
    return net


def score_toxicity(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with a score; whole texts, no shuffle."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net)

    def run(batches):
        net = model.value
        for b in batches:
            text = b.schema.names.index("_fl_text")
            for part in pieces(b, text):
                parts, h, count = word_rows(part.column(text), net.buckets)
                z = net.logits(parts, count)
                lang = guess_language(h, count, net.told)
                z = z - np.array([net.shift.get(x, net.shift[""]) for x in lang])
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())
                names = [n for n in b.schema.names if n != "_fl_text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), score], [*names, "_fl_score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_fl_text"))
    schema = docs.select(*keep).schema.add("_fl_score", "double")
    return rows.mapInArrow(run, schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    The score depends on the text alone: the network's logit less the threshold of the language that the text's
    telling words suggest, as a probability. Null and empty texts have no response of any filter and get the score of
    the bias alone. Without labels of both kinds the weights stay at their start. Labels of one id that differ count as
    toxic; a null label or id teaches nothing; a null id counts as the empty string for held_out. Repeated rows are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels, **fit), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_fl_score").alias("score"), (F.col("_fl_score") >= 0.5).cast("int").alias("predicted"))
