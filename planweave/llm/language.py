"""Language of documents and of the segments of mixed ones.

Model: averaged hashed subword embeddings (character n-grams of each word) with
a linear softmax, trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents.  Labels may be wrong: sentences that the first
model contradicts with confidence are left out of the second training.  The
confidence is calibrated by temperature on held-out sentences, and sentences
below the rejection threshold take the language of their neighbours.

A softmax is sure of texts in languages it was never shown too.  So a text must
also fit its language better than any other by a margin per subword, in the
frequencies of hashed subwords; the margin is calibrated by leaving out each
language in turn: what its sentences reach among the other languages is what a
text of an unknown language reaches.  Sentences below it take the language of
their neighbours, a document below it is of no known language (``und``).

Because the softmax is linear in the average, the trained model is kept as the
scores of each hashed subword; each distinct word of a batch is scored once.
Words, sentences and segments are spans of one array of code points.

Defined results: null texts and texts without words have no segments; a text
whose sentences are all rejected is judged as a whole; without labelled
documents every text is und; other columns are ignored; repeated rows are
judged each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.consistent import _M1, ARABIC_FORMS, ZWNJ, code_points, mix, slices, tables

LANGUAGES = ["ar", "de", "en", "fa", "fr", "tr"]
# Spellings of language labels besides the two-letter codes, in lower case and without a country.
SPELLINGS = {
    "ar": ["ara", "arabic", "arab", "العربية", "عربي"],
    "de": ["deu", "ger", "german", "deutsch"],
    "en": ["eng", "english"],
    "fa": ["fas", "per", "persian", "farsi", "فارسی"],
    "fr": ["fra", "fre", "french", "français", "francais"],
    "tr": ["tur", "turkish", "türkçe", "turkce"],
}
UNKNOWN = "und"
#: Labelled documents the model is fitted on at most, as many of each language; of their sentences at most so many, those of at most so many characters.
SAMPLE, SENTENCES, LONGEST = 3000, 30_000, 2000
BUCKETS, FIT_BUCKETS = 1 << 15, 1 << 16
SIZE = 16
SHORTEST = 4
#: Sentences of fewer words are believed from this confidence on.
FEW_WORDS, FEW_CONFIDENCE = 7, 0.97
# Marks that end a sentence when a blank follows; line breaks always end one.
ENDS, BREAKS = ".!?؟。", "\r\n"
SENTENCE = rf"(?<=[{ENDS}])\s+|[{BREAKS}]+"


def label(col: Column) -> Column:
    """One of LANGUAGES for a label in any known spelling, with or without a country; null otherwise."""
    base = F.element_at(F.split(F.lower(F.trim(col)), "[-_]"), 1)
    out = F.when(base.isin(LANGUAGES), base)
    for lang, names in SPELLINGS.items():
        out = out.when(base.isin(names), F.lit(lang))
    return out


_BLANK = np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3100) if chr(c).isspace()]] = True


def sentence_spans(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentence each code point is in, and the offset of each row among the sentences; sentences of blanks alone are none.

    A sentence ends after an end mark before a blank, and at a line break.
    """
    n = len(off) - 1
    if not len(cps):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    blank = _BLANK[cps]
    stop = np.isin(cps, [ord(c) for c in BREAKS])
    stop[:-1] |= np.isin(cps[:-1], [ord(c) for c in ENDS]) & blank[1:]
    row = np.repeat(np.arange(n), np.diff(off))
    key = np.cumsum(stop) - stop + row
    full = np.flatnonzero(~blank)
    first = np.flatnonzero(np.diff(key[full], prepend=-1))
    number = np.searchsorted(key[full][first], key, "right") - 1
    return number, np.searchsorted(row[full][first], np.arange(n + 1))


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Lower-case code points, begin and end of each word of letters, and word offsets of the rows; the code points as they are and their offsets."""
    t = tables()
    cps, off = code_points(texts)
    t.learn(cps)
    w = t.letter[cps]
    starts = np.zeros(len(cps) + 1, bool)
    starts[off] = True
    prev = np.zeros(len(cps), bool)
    prev[1:] = w[:-1]
    begin = np.flatnonzero(w & (~prev | starts[:-1]))
    stop = np.zeros(len(cps), bool)
    if len(cps):
        stop[-1] = True
        stop[:-1] = ~w[1:] | starts[1:-1]
    end = np.flatnonzero(w & stop) + 1
    # Letters of codes such as EI60, and single letters, are no words.
    digit = np.zeros(len(cps) + 2, bool)
    digit[1:-1] = t.word[cps] & ~w & (cps != ZWNJ)
    keep = (end - begin >= 2) & ~(digit[begin] & ~starts[begin]) & ~(digit[end + 1] & ~starts[end])
    begin, end = begin[keep], end[keep]
    low = t.lower[cps]
    # Keyboards of either language write the other's letter forms.
    for a, b in ARABIC_FORMS.items():
        low[low == ord(a)] = ord(b)
    return low, begin, end, np.searchsorted(begin, off), cps, off


def _distinct_words(cps, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First occurrence of each distinct word and, of each word, which one it is."""
    n = end - begin
    first = np.repeat(begin, n)
    at = np.repeat(begin, n) + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        v = mix(cps[at].astype(np.uint64) + (at - first + 1).astype(np.uint64) * _M1)
        h = np.add.reduceat(v, np.cumsum(n) - n) if len(n) else np.zeros(0, np.uint64)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    return where, which, n


def trigrams(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of each word with its limits, and the offsets of the words among them."""
    n = end - begin
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(off[-1]) + np.repeat(begin - off[:-1], n)
    first, last = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first[off[:-1]], last[off[1:] - 1] = True, True
    with np.errstate(over="ignore"):
        before = np.where(first, 1, cps[at - 1]).astype(np.uint64)
        after = np.where(last, 2, cps[np.minimum(at + 1, len(cps) - 1)]).astype(np.uint64)
        h = mix(mix(before * _M1 + cps[at].astype(np.uint64)) * _M1 + after)
    return (h % np.uint64(FIT_BUCKETS)).astype(np.int64), off


def subwords(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (1 to 4, with word limits) and of each whole word; the offsets of the words among them."""
    n = end - begin
    padded = n + 2
    off = np.concatenate([[0], np.cumsum(padded)])
    word = np.repeat(np.arange(len(n)), padded)
    place = np.arange(off[-1]) - np.repeat(off[:-1], padded)
    c = np.zeros(off[-1], np.uint64)
    inner = (place > 0) & (place <= n[word])
    c[inner] = cps[(begin[word] + place - 1)[inner]]
    c[place == 0], c[place == padded[word] - 1] = 1, 2
    grams, owners = [], []
    with np.errstate(over="ignore"):
        for k in (1, 2, 3, 4):
            at = np.flatnonzero(place + k <= padded[word]) if k > 1 else np.flatnonzero(inner)
            h = np.full(len(at), k, np.uint64)
            for j in range(k):
                h = mix(h * _M1 + c[at + j])
            grams.append(h)
            owners.append(word[at])
        whole = np.add.reduceat(mix(c + (place + 1).astype(np.uint64) * _M1), off[:-1]) if len(n) else np.zeros(0, np.uint64)
        grams.append(mix(whole + np.uint64(5)))
        owners.append(np.arange(len(n)))
    owner = np.concatenate(owners)
    o = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(grams)[o] % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


class Model:
    """Scores per subword bucket, temperature, threshold of confidence; log frequencies of trigrams and the margin they must reach."""

    def __init__(self, scores: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, fit: np.ndarray | None = None, margin: float = 0.0):
        self.scores, self.bias, self.temperature, self.threshold = scores, bias, temperature, threshold
        self.fit, self.margin = np.zeros((FIT_BUCKETS, len(LANGUAGES)), np.float32) if fit is None else fit, margin

    def word_scores(self, cps, begin, end) -> np.ndarray:
        bucket, off = subwords(cps, begin, end)
        return np.add.reduceat(self.scores[bucket], off[:-1], axis=0) / np.diff(off)[:, None] if len(begin) else np.zeros((0, len(LANGUAGES)), np.float32)

    def fits(self, cps, begin, end) -> np.ndarray:
        """Sums of the log frequencies of the trigrams of each word in each language, and their number."""
        bucket, off = trigrams(cps, begin, end)
        return np.concatenate([np.add.reduceat(self.fit[bucket], off[:-1], axis=0), np.diff(off)[:, None]], 1)

    def judged(self, texts: pa.Array) -> Judged:
        """Texts and their sentences with probabilities, margins and numbers of words."""
        k = len(LANGUAGES)
        cps, begin, end, rows, raw, off = _words(texts)
        number, spans = sentence_spans(raw, off)
        owner = number[begin] if len(begin) else np.zeros(0, np.int64)
        per = np.searchsorted(owner, np.arange(spans[-1] + 1))
        if len(begin):
            where, which, _ = _distinct_words(cps, begin, end)
            some = begin[where], end[where]
            values = np.concatenate([self.word_scores(cps, *some), self.fits(cps, *some)], 1)[which]
        else:
            values = np.zeros((0, 2 * k + 1))
        sums = np.concatenate([np.zeros((1, 2 * k + 1)), np.cumsum(values, axis=0, dtype=np.float64)])
        out = []
        for o in (per, rows):
            n, total = np.diff(o), sums[o[1:]] - sums[o[:-1]]
            p = _softmax((total[:, :k] / np.maximum(1, n)[:, None] + self.bias) / self.temperature)
            p[n == 0] = 1 / k
            grams = np.maximum(1, total[:, 2 * k])
            fit = total[:, k : 2 * k] / grams[:, None]
            best = p.argmax(1)
            own = fit[np.arange(len(n)), best]
            fit[np.arange(len(n)), best] = -np.inf
            # By how much it fits its language better than the next; less than chance fits none.
            out += [p, np.where(own > 0, own - fit.max(1), -1.0), n]
        return Judged(*out, spans)

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities of each text, and its number of words."""
        j = self.judged(texts)
        return j.text_p, j.text_words


class Judged:
    """Of sentences and of texts: probabilities, margins, words; and the offset of each text among the sentences."""

    def __init__(self, p, margin, words, text_p, text_margin, text_words, spans):
        self.p, self.margin, self.words, self.spans = p, margin, words, spans
        self.text_p, self.text_margin, self.text_words = text_p, text_margin, text_words


def _softmax(z):
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def _summed(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the values of each."""
    o = np.argsort(key, kind="stable")
    k = key[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(values[o], first, axis=0)


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 8.0, seed: int = 7) -> Model:
    """Model of labelled sentences; labels: places in LANGUAGES, some of which may be wrong."""
    cps, begin, end, rows, _, _ = _words(pa.array(texts, pa.large_string()))
    where, which, _ = _distinct_words(cps, begin, end)
    bucket, boff = subwords(cps, begin[where], end[where])
    per_word = np.diff(boff)
    rng = np.random.default_rng(seed)
    n_words = np.diff(rows)
    usable = np.flatnonzero(n_words >= 2)
    held = usable[rng.random(len(usable)) < 0.15]
    fit_all = np.setdiff1d(usable, held)
    keep = fit_all
    k = len(LANGUAGES)

    def features(some):
        """Distinct-word rows of sentences, flat, with offsets."""
        n = n_words[some]
        flat = np.repeat(rows[:-1][some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which[flat], np.repeat(np.arange(len(some)), n), n

    for turn in range(2):
        table = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        out = np.zeros((SIZE, k), np.float32) + rng.normal(0, 0.1, (SIZE, k)).astype(np.float32)
        bias = np.zeros(k, np.float32)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            order = rng.permutation(keep)
            for lo in range(0, len(order), 256):
                some = order[lo : lo + 256]
                w, s, n = features(some)
                uw, back = np.unique(w, return_inverse=True)
                m = per_word[uw]
                at = np.repeat(boff[:-1][uw], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                b = bucket[at]
                wv = np.add.reduceat(table[b], np.cumsum(m) - m, axis=0) / m[:, None]
                sv = np.add.reduceat(wv[back], np.cumsum(n) - n, axis=0) / n[:, None]
                p = _softmax(sv @ out + bias)
                p[np.arange(len(some)), labels[some]] -= 1
                p /= len(some)
                d_sv = p @ out.T
                out -= step * (sv.T @ p)
                bias -= step * p.sum(0)
                d_w = _summed((d_sv / n[:, None])[s], back)[1]
                ub, d_b = _summed(np.repeat(d_w / m[:, None], m, axis=0), b)
                table[ub] -= step * 8 * d_b
        scores = (table @ out).astype(np.float32)
        model = Model(scores, bias, 1.0, 0.0)
        p, _ = model.probabilities(pa.array([texts[i] for i in fit_all], pa.large_string()))
        wrong = (p.argmax(1) != labels[fit_all]) & (p.max(1) > 0.6)
        keep = fit_all[~wrong]
    # Temperature and threshold on held-out sentences, those with a contradicted label apart.
    p, _ = model.probabilities(pa.array([texts[i] for i in held], pa.large_string())) if len(held) else (np.zeros((0, k)), None)
    if len(held):
        z = np.log(np.maximum(p, 1e-30))
        ok = ~((p.argmax(1) != labels[held]) & (p.max(1) > 0.9))
        y = labels[held][ok]
        losses = {t: -np.log(np.maximum(_softmax(z[ok] / t)[np.arange(len(y)), y], 1e-30)).mean() for t in (0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0)} if len(y) else {1.0: 0}
        model.temperature = min(losses, key=losses.get)
        q = _softmax(z[ok] / model.temperature)
        right, conf = q.argmax(1) == y, q.max(1)
        choices = [t for t in (0.4, 0.5, 0.6, 0.7, 0.8, 0.9) if (conf >= t).any() and right[conf >= t].mean() >= 0.995]
        model.threshold = min(choices, default=0.9)
    model.fit, model.margin = fit_margin(cps, begin, end, rows, labels, keep, held[ok] if len(held) else held)
    return model


def fit_margin(cps, begin, end, rows, labels, keep, held) -> tuple[np.ndarray, float]:
    """Log frequencies of trigrams per language against chance, and the margin that texts of an unknown language seldom reach.

    Each held-out sentence of a language is judged by the other languages alone.  A language like another one reaches
    more than one that is like none; the margin is what the lower half of the languages stays below in nine sentences of ten.
    """
    k = len(LANGUAGES)
    bucket, off = trigrams(cps, begin, end)
    sentence = np.repeat(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), np.diff(off))
    use = np.zeros(len(rows) - 1, bool)
    use[keep] = True
    count = np.zeros((FIT_BUCKETS, k))
    for lang in range(k):
        count[:, lang] = np.bincount(bucket[use[sentence] & (labels[sentence] == lang)], minlength=FIT_BUCKETS)
    shown = count.sum(0) > 0
    fit = (np.log((count + 0.5) / (count.sum(0) + 0.5 * FIT_BUCKETS)) + np.log(FIT_BUCKETS)).astype(np.float32)
    fit[:, ~shown] = -10.0
    n = np.diff(rows)
    held = held[n[held] >= SHORTEST]
    sums = np.stack([np.bincount(sentence, weights=fit[bucket, lang], minlength=len(n)) for lang in range(k)], 1)[held]
    mean = sums / np.maximum(1, np.bincount(sentence, minlength=len(n))[held])[:, None]
    reached = []
    for lang in np.flatnonzero(shown):
        rest = np.sort(np.delete(mean[labels[held] == lang], lang, 1), 1)
        if len(rest) >= 20 and shown.sum() >= 3:
            reached.append(float(np.quantile(rest[:, -1] - rest[:, -2], 0.9)))
    return fit, sorted(reached)[(len(reached) - 1) // 2] if reached else 0.0


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of a sample of the labelled documents: of each language those with the least hashes of their ids."""
    some = docs.select(F.col(text).alias("text"), label(F.col(lang)).alias("lang"), F.xxhash64(doc_id).alias("h")).where("lang is not null and length(text) > 20")
    each = max(1, sample // len(LANGUAGES))
    counts = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    # About twice as many as are wanted go on, by their hash, so that the ranking moves few texts however many there are.
    part = F.lit(0.0)
    for name, n in counts.items():
        part = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * each / n + 50 / n))).otherwise(part)
    drawn = some.where(F.pmod("h", F.lit(1 << 30)) < part * (1 << 30))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= each)
    cut = drawn.select("lang", "h", F.posexplode(F.split("text", SENTENCE)).alias("place", "s")).where(F.col("s").rlike(r"\S") & (F.length("s") <= LONGEST))
    got = cut.orderBy(F.xxhash64("h", "place"), "s").limit(SENTENCES).select("s", "lang").toArrow()
    if not len(got):
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, 1.0)
    return train(got["s"].to_pylist(), np.array([LANGUAGES.index(y) for y in got["lang"].to_pylist()]))


def segment_batches(shipped, shortest: int = SHORTEST):
    """Batches of (id, text, ...) to (doc_id, seg_no, lang, confidence, n_segments, first_sentence, last_sentence, ...), the rest carried along."""

    def one(batch):
        model: Model = shipped.value
        j = model.judged(batch.column(1))
        count = np.diff(j.spans)
        doc = np.repeat(np.arange(len(count)), count)
        best, conf = j.p.argmax(1), j.p.max(1)
        few = np.where(j.words < FEW_WORDS, max(FEW_CONFIDENCE, model.threshold), model.threshold)
        at = np.flatnonzero((j.words >= shortest) & (conf >= few) & (j.margin >= model.margin))
        new = np.flatnonzero((np.diff(doc[at], prepend=-1) != 0) | (np.diff(best[at], prepend=-1) != 0))
        owner, lang = doc[at][new], best[at][new]
        weight = j.words[at].astype(float)
        sure = np.add.reduceat(conf[at] * weight, new) / np.add.reduceat(weight, new) if len(new) else np.zeros(0)
        first = np.diff(owner, prepend=-1) != 0
        last = np.diff(owner, append=-1) != 0
        start = np.where(first, 0, at[new] - j.spans[owner])
        stop = np.where(last, count[owner] - 1, np.roll(at[new], -1) - j.spans[owner] - 1)
        # Texts without a sentence to believe are judged as a whole; short ones by confidence alone, as a few words tell no margin.
        alone = np.setdiff1d(np.flatnonzero(j.text_words > 0), owner)
        known = (j.text_margin[alone] >= np.where(j.text_words[alone] < FEW_WORDS, 0.0, model.margin)) & (model.threshold < 1)
        owner = np.concatenate([owner, alone])
        name = np.concatenate([lang, np.where(known, j.text_p[alone].argmax(1), len(LANGUAGES))])
        sure = np.concatenate([sure, j.text_p[alone].max(1)])
        start, stop = np.concatenate([start, 0 * alone]), np.concatenate([stop, count[alone] - 1])
        o = np.argsort(owner, kind="stable")
        owner, name, sure, start, stop = owner[o], name[o], sure[o], start[o], stop[o]
        n = np.bincount(owner, minlength=len(count))
        seg = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        take = pa.array(owner)
        names = pa.array([*LANGUAGES, UNKNOWN]).take(pa.array(name))
        return pa.record_batch(
            [batch.column(0).take(take), pa.array(seg), names, pa.array(sure), *(pa.array(x.astype(np.int32)) for x in (n[owner], start, stop)), *(batch.column(c).take(take) for c in range(2, batch.num_columns))],
            names=["doc_id", "seg_no", "lang", "confidence", "n_segments", "first_sentence", "last_sentence", *batch.schema.names[2:]],
        )

    def over(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                yield one(batch.slice(lo, hi - lo))

    return over


SEGMENTS = "doc_id long, seg_no long, lang string, confidence double, n_segments int, first_sentence int, last_sentence int"


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per segment of each document with words: its language, confidence and sentences, and the label it came with."""
    model = model or fitted(docs, doc_id, text, lang)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), label(F.col(lang)).alias("label")).where("id is not null and text is not null")
    return rows.mapInArrow(segment_batches(shipped), SEGMENTS + ", label string")


def relabelled(docs: DataFrame, **columns) -> DataFrame:
    """Segments of documents whose label is missing or wrong, and of those in several languages; documents of no known language have no other label to get."""
    return languages(docs, **columns).where((F.col("lang") != UNKNOWN) & F.expr("n_segments > 1 or label is null or label <> lang"))
