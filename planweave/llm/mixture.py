"""A mixture of documents whose sources make up target shares of its size in tokens.

Soft-membership mixing: a softmax classifier, fitted on a bounded sample of
documents whose source is known, gives the domain posteriors of every document;
the source a document names is evidence of a stated weight.  A membership is
kept as the document's domain, the best other one and the weight between them
in sixteenths, so documents fall into few cells, and those of a cell have one
rate.  Tokens of the cells are summed over all documents; the rates are fitted by
projected gradient least squares on the relative error of each domain's
expected tokens, the same steps that single documents would take.

Rates become whole copies, never above the cap.  Each document takes its copies
one by one as a level rises, at a place told by its rate and a uniform number
hashed from its id.  Tokens by place are summed per domain in bins, from which
the level, and the few single bins that come nearest, are chosen so that the
domain meets its goal.

The size aimed at is the largest at which every listed source that has
documents can reach its share within its repeats, unless a size is given.

Defined results: a listed source without documents gets no tokens, its share is
reported as 0; documents of unlisted sources, null texts and texts without
tokens are not used; a null source is judged by the text; repeated rows are
documents of their own; an empty table gives shares of 0.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.shared import stored
from planweave.llm.consistent import _M1, consistent_points, mix, slices, word_hashes

#: The tokenizer's vocabulary; a path on the driver, whose content (of fixed size) is broadcast.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of known source the classifier is fitted on at most, the same number of each source; each is fetched as its words' buckets, BUCKETS at most.
SAMPLE = 4000
BUCKETS = 1 << 14
#: How far a source that a document names is trusted; the rest falls to what its words say.
TRUST = 0.999
#: Weights of a membership in so many parts; bins of the level, per copy, that rounding chooses from; single bins chosen besides.
PARTS, BINS, SINGLE = 16, 2048, 6
STEPS, ENOUGH = 2000, 1e-7


def source_key(col: Column) -> Column:
    """A source's name without case and outer blanks, with one _ for blanks, - and _ between words."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s_\-]+", F.lit("_")), F.lit(""))


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_encoders: dict = {}


def token_counts(texts: list[str], content: bytes) -> np.ndarray:
    import tiktoken

    key = hash(content)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _encoders[key].encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts], np.int64)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of each text and their offsets."""
    words, rows = word_hashes(*consistent_points(texts))
    return (words % np.uint64(BUCKETS)).astype(np.int64), rows


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _scores(weights: np.ndarray, bias: np.ndarray, bucket: np.ndarray, rows: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of texts from their buckets, each counted as often as told."""
    value = weights[bucket].astype(np.float64) if count is None else weights[bucket] * count[:, None].astype(np.float64)
    sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(value, axis=0)])
    n = np.diff(rows) if count is None else np.add.reduceat(np.concatenate([count, [0]]), rows[:-1]) * (np.diff(rows) > 0)
    return _softmax((sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(1, n)[:, None] + bias)


def sample_batches(batches):
    """Batches of (domain, text) to (domain, buckets, counts): each text's distinct buckets with their numbers."""
    for batch in batches:
        bucket, rows = _features(batch.column(1))
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        off = np.searchsorted(key, np.arange(len(rows)) * BUCKETS).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v.astype(np.int32))) for v in (key % BUCKETS, count)]
        yield pa.record_batch([batch.column(0), *lists], names=["domain", "buckets", "counts"])


def fit_classifier(bucket: np.ndarray, count: np.ndarray, rows: np.ndarray, labels: np.ndarray, prior: np.ndarray, epochs: int = 8, rate: float = 20.0, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights per word bucket and bias of a softmax over domains, by stochastic gradient descent; prior: documents of each domain in the whole table."""
    k = len(prior)
    n = np.maximum(1, np.add.reduceat(np.concatenate([count, [0]]), rows[:-1]) * (np.diff(rows) > 0))
    weights = np.zeros((BUCKETS, k))
    drawn = np.log((np.bincount(labels, minlength=k) + 0.5) / (len(labels) + 0.5 * k))
    bias = drawn.copy()
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 128):
            some = order[lo : lo + 128]
            m = np.diff(rows)[some]
            flat = np.repeat(rows[:-1][some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            owner = np.repeat(np.arange(len(some)), m)
            p = _scores(weights, bias, bucket[flat], np.concatenate([[0], np.cumsum(m)]), count[flat])
            p[np.arange(len(some)), labels[some]] -= 1
            step = rate * (1 - epoch / epochs) / len(some)
            np.subtract.at(weights, bucket[flat], step * (p / n[some][:, None])[owner] * count[flat][:, None])
            bias -= 0.05 * step * p.sum(0)
    # The sample has as many documents of a rare source as of a common one; the whole table has not.
    return weights.astype(np.float32), bias - drawn + np.log((prior + 0.5) / (prior.sum() + 0.5 * k))


def fitted_rates(share: np.ndarray, tokens: np.ndarray, goal: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates of cells (share: cells x domains, tokens, cap) whose expected tokens of each domain come nearest to the goals, relatively."""
    plain = tokens @ share
    scale = np.divide(goal, plain, out=np.zeros(len(goal)), where=plain > 0)
    r = np.zeros(len(tokens))
    for _ in range(STEPS):
        residual = np.divide((r * tokens) @ share - goal, goal, out=np.zeros(len(goal)), where=goal > 0)
        step = np.clip(r - share @ (residual * scale), 0, cap) - r
        r += step
        if not len(r) or np.abs(step).max() < ENOUGH * max(1.0, float(r.max())):
            break
    return r


class Cells:
    """Cells of a membership: own domain, best other one, weight of the own one in parts, and whether the source is named."""

    def __init__(self, k: int):
        self.k = k
        self.total = k * k * (PARTS + 1) * 2

    def of(self, own, other, part, named) -> np.ndarray:
        return ((own * self.k + other) * (PARTS + 1) + part) * 2 + named

    def parts(self, cell: np.ndarray):
        named, rest = cell % 2, cell // 2
        return rest // (PARTS + 1) // self.k, rest // (PARTS + 1) % self.k, rest % (PARTS + 1), named

    def shares(self, cell: np.ndarray) -> np.ndarray:
        own, other, part, _ = self.parts(cell)
        p = np.zeros((len(cell), self.k))
        at = np.arange(len(cell))
        np.add.at(p, (at, own), part / PARTS)
        np.add.at(p, (at, other), 1 - part / PARTS)
        return p

    def caps(self, cell: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        """The repeats of the source a document names; of one that is judged, the least of the domains it may well belong to."""
        own, other, part, named = self.parts(cell)
        return np.where((named == 1) | (part > 0.9 * PARTS), repeat[own], np.minimum(repeat[own], repeat[other]))


class Level:
    """Where on a level from -1 to 2 each document takes its copies, and the part of it that is taken."""

    def __init__(self, rates: np.ndarray, caps: np.ndarray, k: int):
        # rates, caps: by cell.
        self.rates, self.caps, self.k = rates, caps.astype(np.int64), k
        self.taken: np.ndarray | None = None

    def steps(self, ids: np.ndarray, cell: np.ndarray):
        """(row, bin) of each copy a document may still take, and the copies it has below all bins."""
        with np.errstate(over="ignore"):
            u = (mix(ids.astype(np.uint64) * _M1 + np.uint64(3)) >> np.uint64(11)) / float(1 << 53)
        r, cap = self.rates[cell], self.caps[cell]
        whole = np.floor(r).astype(np.int64)
        # At level 0 a document has its whole part and, with the probability of the rest, one more; each unit of the level is one copy.
        place = u - (r - whole)
        base = np.clip(whole - 1, 0, cap)
        row = np.repeat(np.arange(len(cell)), 3)
        m = np.tile(np.arange(-1, 2), len(cell))
        number = np.repeat(whole, 3) + m
        # A document without a rate takes none, however high the level.
        ok = (number >= 0) & (number < np.repeat(cap, 3)) & (np.repeat(r, 3) > 0)
        at = np.clip(((place[row] + m + 2) * (BINS / 4)), 0, BINS - 1).astype(np.int64)
        return row[ok], at[ok], np.where(r > 0, base, 0)

    def copies(self, ids: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
        row, at, base = self.steps(ids, cell)
        return base + np.bincount(row, weights=self.taken[own[row], at], minlength=len(cell)).astype(np.int64)

    def choose(self, base: np.ndarray, tokens: np.ndarray, goal: np.ndarray) -> None:
        """Bins to take of each domain: those below a level and a few single ones, so that the tokens come nearest to the goal."""
        self.taken = np.zeros((self.k, BINS), bool)
        for d in range(self.k):
            sums = base[d] + np.concatenate([[0.0], np.cumsum(tokens[d])])
            level = int(np.abs(sums - goal[d]).argmin())
            some = np.arange(BINS) < level
            gap = goal[d] - sums[level]
            # One bin more, one less or one for another, while it helps; the nearest to the level come first.
            for _ in range(SINGLE):
                near = np.argsort(np.abs(np.arange(BINS) - level), kind="stable")
                out, into = (near[(some[near] == side) & (tokens[d][near] > 0)][:256] for side in (True, False))
                lost, won = np.concatenate([[0.0], tokens[d][out]]), np.concatenate([[0.0], tokens[d][into]])
                change = won[None, :] - lost[:, None]
                i, j = np.unravel_index(np.abs(gap - change).argmin(), change.shape)
                if abs(gap - change[i, j]) >= abs(gap):
                    break
                gap -= change[i, j]
                if i:
                    some[out[i - 1]] = False
                if j:
                    some[into[j - 1]] = True
            self.taken[d] = some


def _sums(members: DataFrame, rows: int, value) -> np.ndarray:
    """Sums by number below rows, at most so many rows a partition and in all; value: ids, tokens, cell -> numbers, weights."""

    def over(batches):
        total = np.zeros(rows)
        for b in batches:
            for number, weight in value(*(b.column(c).to_numpy() for c in range(3))):
                total += np.bincount(number, weights=weight, minlength=rows)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["number", "total"])

    got = members.select("doc_id", "tokens", "cell").mapInArrow(over, "number long, total double").groupBy("number").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(rows)
    out[got["number"].to_numpy()] = got["total"].to_numpy()
    return out


def mixture(
    docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, sample: int = SAMPLE, trust: float = TRUST, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(doc_id, source, membership, tokens, rate, copies): how often each document is used; documents not used have 0 copies."""
    spark = docs.sparkSession
    goals = sorted(targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeat").collect(), key=lambda r: r["source"])
    names = [r["source"] for r in goals]
    share = np.array([r["target_share"] for r in goals], float)
    repeat = np.array([r["max_repeat"] for r in goals], float)
    k = len(names)
    cells = Cells(k)
    ours = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), source_key(F.col(source)).alias("source")).where("doc_id is not null and text is not null")
    # -1: no source is told; null: a source that is not listed.
    base = base.select("doc_id", "text", F.when(F.col("source").isNull(), F.lit(-1)).when(ours >= 0, ours).alias("domain")).where("domain is not null")
    known = base.where("domain >= 0")
    prior = np.zeros(k)
    for r in known.groupBy("domain").count().collect():
        prior[r["domain"]] = r["count"]
    # The same number of each source, by hash of the id; the limit per source is applied before the shuffle too.
    hashed = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = known.withColumn("r", F.row_number().over(hashed)).where(F.col("r") <= max(1, sample // max(1, k))).select("domain", "text")
    got = drawn.mapInArrow(sample_batches, "domain int, buckets array<int>, counts array<int>").toArrow().combine_chunks()
    if len(got):
        bucket, count = (got[c].combine_chunks() for c in ("buckets", "counts"))
        rows = bucket.offsets.to_numpy().astype(np.int64)
        weights, bias = fit_classifier(bucket.values.to_numpy()[rows[0] : rows[-1]], count.values.to_numpy()[rows[0] : rows[-1]], rows - rows[0], got["domain"].to_numpy(), prior)
        # No text is judged to be of a source that has no documents.
        bias = np.where(prior > 0, bias, -1e9)
    else:
        weights, bias = np.zeros((BUCKETS, k), np.float32), np.log(np.maximum(share, 1e-9))
    shipped = spark.sparkContext.broadcast((weights, bias, _ranks(tokenizer)))
    doubt = (1 - trust) / max(1, k - 1)

    def member(batches):
        weights, bias, content = shipped.value
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                domain = part.column(2).to_numpy()
                at = np.arange(len(domain))
                p = _scores(weights, bias, *_features(part.column(1)))
                named = domain >= 0
                told = np.where(named[:, None], doubt, 1.0) * np.ones((len(domain), k))
                told[at[named], domain[named]] = trust
                p = p * told + 1e-300
                p /= p.sum(1, keepdims=True)
                own = np.where(named, domain, p.argmax(1))
                rest = p.copy()
                rest[at, own] = -1
                other = rest.argmax(1) if k > 1 else own
                weight = p[at, own] / (p[at, own] + np.where(other == own, 0, p[at, other]))
                cell = cells.of(own, other, np.rint(weight * PARTS).astype(np.int64), named.astype(np.int64))
                tokens = token_counts(part.column(1).to_pylist(), content)
                out = pa.record_batch([part.column(0), pa.array(tokens), pa.array(cell.astype(np.int32)), pa.array(p[at, own])], names=["doc_id", "tokens", "cell", "membership"])
                yield out.filter(pa.array(tokens > 0))

    members = stored(base.mapInArrow(member, "doc_id long, tokens long, cell int, membership double"), "members")
    mass = _sums(members, cells.total, lambda ids, tokens, cell: [(cell, tokens)])
    every = np.arange(cells.total)
    own, caps = cells.parts(every)[0], cells.caps(every, repeat)
    capacity = np.bincount(own, weights=mass * caps, minlength=k)
    there = (capacity > 0) & (share > 0)
    total = total_tokens or (float((capacity[there] / share[there]).min()) if there.any() else 0.0)
    goal = np.where(there, share * total, 0.0)
    used = np.flatnonzero(mass)
    rates = np.zeros(cells.total)
    rates[used] = fitted_rates(cells.shares(used), mass[used], goal, caps[used])
    level = Level(rates, caps, k)

    def places(ids, tokens, cell):
        mine = cells.parts(cell)[0]
        row, at, below = level.steps(ids, cell)
        # Bin BINS of a domain is what it has below all bins.
        return [(mine[row] * (BINS + 1) + at, tokens[row]), (mine * (BINS + 1) + BINS, tokens * below)]

    placed = _sums(members, k * (BINS + 1), places).reshape(k, BINS + 1)
    level.choose(placed[:, BINS], placed[:, :BINS], goal)

    def counted(batches):
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            mine = cells.parts(cell)[0]
            copies = level.copies(ids, cell, mine).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(mine.astype(np.int32)), batch.column(3), batch.column(1), pa.array(rates[cell]), pa.array(copies)], names=["doc_id", "d", "membership", "tokens", "rate", "copies"])

    rows = members.mapInArrow(counted, "doc_id long, d int, membership double, tokens long, rate double, copies int")
    return rows.select("doc_id", F.element_at(F.array(*map(F.lit, names)), F.col("d") + 1).alias("source"), "membership", "tokens", "rate", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, copies, tokens, share): what each listed source makes up of the mixture."""
    per = mixed.where("copies > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share").join(per, "source", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "copies", "tokens")]
    # One row per listed source, so the window is small whatever the corpus.
    all_ = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return rows.select("source", "target_share", *zero).withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), all_), F.lit(0.0)))
