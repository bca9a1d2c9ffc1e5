"""Operators of the llm subpackage against brute force on small fixtures, with their edge cases."""

import itertools
import json
import math
import random
import re
import threading
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planweave.llm import canon, knn, language, leak, lookalike, mixture, neardup
from planweave.llm.consistent import consistent_array


def consistent(*texts):
    return consistent_array(pa.array(texts, pa.string())).to_pylist()


# ------------------------------------------------------------------ p6


@pytest.mark.parametrize(
    "a,b",
    [
        ("Ｍ-4", "M‐4"), ("كتاب", "کتاب"), ("ى", "ی"), ("٤٥", "۴۵"), ("ﺑﺎ", "با"), ("a b", "a b"), ("a​b", "ab"), ("‎a", "a"),
        ("م‌‌ی", "م‌ی"), ("آ", "آ"), ("أ", "أ"), ("ئ", "یٔ"), ("é", "é"), ("Μ", "M"), ("  a \t b ", "a b"),
        ("أً", "أً"), ("a‌ b", "a b"), ("ۀ", "هٔ"), ("x­y", "xy"), ("م​‌ی", "م‌​ی"),
        ("αbc", "abc"), ("Տօ", "So"), ("ᎪᏴ", "AB"),
    ],
)
def test_same_look(a, b):
    assert len(set(consistent(a, b))) == 1


@pytest.mark.parametrize("a,b", [("می‌شود", "میشود"), ("ا", "آ"), ("a b", "ab"), ("A", "a"), ("5", "۵"), ("ab", "ba"), ("m²", "m2"), ("پ", "ب")])
def test_other_look(a, b):
    assert len(set(consistent(a, b))) == 2


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aM‐- ‌​ًٓٔاكیي٤۴éＭΜ𝐀\U0001f600", max_size=12)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_batch_independence_and_idempotence(texts):
    got = consistent(*texts)
    assert got == [consistent(t)[0] for t in texts]
    assert consistent(*got) == got
    assert [t is None for t in texts] == [t is None for t in got]


def test_slices_change_nothing():
    texts = ["كتاب  ", None, "", "ＡＢ‌c" * 90000, "x"] * 7
    assert consistent(*texts) == [consistent(t)[0] for t in texts]


def test_same_look_pairs(spark):
    rows = [(1, "كتاب", None), (2, "کتاب", "x"), (3, "کتاب", "x"), (4, "", "​"), (5, "​", None), (6, None, None), (7, "می‌شود" * 20000, None), (8, "مي‌شود" * 20000, None)]
    df = spark.createDataFrame(rows, "clause_id long, text_fa string, heading_fa string").withColumn("field", F.lit(0)).withColumn("id", F.lit(0))
    got = {tuple(r) for r in lookalike.same_look(df, "clause_id", ["text_fa", "heading_fa"]).collect()}
    assert got == {("text_fa", 1, 2), ("text_fa", 1, 3), ("text_fa", 4, 5), ("text_fa", 7, 8)}
    assert lookalike.same_look(df.limit(0), "clause_id", ["text_fa"]).count() == 0
    classes = {(r["field"], r["id"]): (r["class"], r["way"], r["links"]) for r in lookalike.look_classes(df, "clause_id", ["text_fa", "heading_fa"]).collect()}
    assert classes["text_fa", 1] == (1, 1, 2) and classes["text_fa", 3] == (1, 2, 1) and classes["heading_fa", 3] == (2, 2, 0) and len(classes) == 10
    assert sum(x[2] for x in classes.values()) == 2 * len(got)
    out = lookalike.with_consistent(df, ["text_fa"])
    assert out.where("clause_id = 1").first()["text_fa_consistent"] == "کتاب" and "text_fa_consistent" not in df.columns
    with pytest.raises(ValueError):
        lookalike.with_consistent(out, ["text_fa"])


def test_hot_text_stored_one_way_makes_no_pairs_to_compare(spark):
    # As all pairs of the hot group this would be 10^10 rows.
    hot = spark.range(200_000).selectExpr("id as clause_id", "'hot  text' as t")
    df = hot.unionByName(spark.createDataFrame([(300_000, "a b"), (300_001, "a  b"), (300_002, "a  b"), (300_003, "a b ")], "clause_id long, t string"))
    spark.sparkContext.setJobGroup("hot", "hot", True)
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = sorted((r["a"] - 300_000, r["b"] - 300_000) for r in lookalike.same_look(df, "clause_id", ["t"]).collect())
    finally:
        stop.cancel()
    assert got == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]


# ------------------------------------------------------------------ p1


def words(text):
    return re.findall(r"[\w‌]+", (consistent(text)[0] or "").casefold())


def links(rows, t, run):
    sets, out = {}, set()
    for i, x in rows:
        if x is not None:
            w = tuple(words(x))
            sets[i] = (w, {w[k : k + run] for k in range(len(w) - run + 1)})
    for a, b in itertools.combinations(sorted(sets), 2):
        (wa, sa), (wb, sb) = sets[a], sets[b]
        if wa == wb or (sa | sb and len(sa & sb) >= t * len(sa | sb) - 1e-9):
            out.add((a, b))
    return out


@pytest.mark.parametrize("t,run,seed", [(0.6, 3, 1), (0.8, 5, 2), (0.5, 1, 3), (0.95, 2, 4)])
def test_links_are_exact(spark, t, run, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 7, 9, 15, 40, 90, 200]))]
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]])
            texts.append(" ".join(w))
    rows = list(enumerate([*texts, texts[0], texts[0].upper() + "!", None, "", "", "  "], 1))
    df = spark.createDataFrame([(i, x, i) for i, x in rows], "id long, text string, n int")
    got = neardup.expanded(*neardup.near_duplicates(df, "id", ["text"], threshold=t, run=run)).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(links(rows, t, run))


BIG = [-(2**63), 2**63 - 1, 2**62 + 5, -(2**62) - 3, 2**62, 7]


def test_ids_of_the_whole_range(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([*base, f"x{n}"]), " ".join([f"y{n}", *base[5:]]), "same") for n, k in enumerate(BIG)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    pairs = {(min(x, y), max(x, y)) for x, y in itertools.combinations(BIG, 2)}
    got = neardup.expanded(*neardup.near_duplicates(df, "id", ["a", "b", "c"], threshold=0.8, run=5)).collect()
    assert sorted((r["field"], r["a"], r["b"]) for r in got) == sorted((f, *p) for f in range(3) for p in pairs)
    links_ = neardup.class_links(*neardup.near_duplicates(df, "id", ["a", "c"], threshold=0.8, run=5)).collect()
    assert sorted((r["field"], r["id"], r["links"]) for r in links_) == sorted((f, k, 5) for f in range(2) for k in BIG)
    v = [[1.0, 0.01 * n] + [0.0] * 126 for n in range(len(BIG))]
    vectors = spark.createDataFrame(list(zip(BIG, v)), "vec_id long, embedding array<float>")
    assert {tuple(r) for r in knn.similar_pairs(vectors, "vec_id", "embedding").collect()} == pairs


@pytest.mark.parametrize("t", [0.05, 0.15, 0.6])
def test_sizes_astride_bands_whatever_else_is_in_the_table(spark, t):
    # Other texts move the limits of the bands.
    rng = random.Random(8)
    other = [" ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 10, 30, 38, 120, 400]))) for _ in range(260)]
    near = []
    for k, n in enumerate([40, 150, 608, 5000, 8330, 20000]):
        y = [f"b{k}x{j}" for j in range(n)]
        near += [" ".join(y), " ".join(y[: math.ceil(n * t) + 1])]
    df = spark.createDataFrame(list(enumerate(near + other)), "id long, text string")
    _, pairs = neardup.near_duplicates(df, "id", ["text"], threshold=t, run=1)
    assert sorted((r["rep_a"], r["rep_b"]) for r in pairs.collect()) == [(2 * k, 2 * k + 1) for k in range(6)]


def test_links_with_skew_and_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(30000))
    rows = [(i, "one text that a third of all rows hold, word for word the same") for i in range(200)]
    rows += [(1000 + i, f"shared words stand in every text number {i} of this kind") for i in range(100)] + [(5000, long), (5001, long + " more"), (5002, None)]
    df = spark.createDataFrame(rows, "clause_id long, text_fa string")
    classes, pairs = neardup.near_duplicates(df, "clause_id", ["text_fa"], threshold=0.6, run=3)
    assert classes.where("rep = 0").count() == 200 and classes.count() == 302
    assert sorted((r["rep_a"], r["rep_b"]) for r in pairs.collect()) == sorted(links([(0, rows[0][1]), *rows[200:]], 0.6, 3))
    empty = neardup.near_duplicates(df.limit(0), "clause_id", ["text_fa"])
    assert empty[0].count() == 0 and empty[1].count() == 0


GRIDS = [[1, 8, 38, 152, 608, 2435, 9742], [1, 8, 13, 53, 215, 861, 3444, 13777]]


@pytest.mark.parametrize("lows", GRIDS)
def test_large_sets_are_indexed_for_their_partners(lows):
    # Sizes on both sides of a bound and of what a set reaches.
    sizes = [(9742, 9742), (9743, 9771), (9700, 9760), (5846, 9743), (9742, 16230), (8276, 13777), (8267, 13778), (13777, 13780), (13700, 13777), (13790, 22980), (4096, 6826), (4080, 4100), (2458, 4096)]
    for x, y in sizes:
        el = np.random.default_rng(x).permutation(np.unique(np.random.default_rng(y).integers(0, 2**32, 2 * y, np.uint64)))[:y].astype(np.uint32)
        kept = {n if n < 4096 else math.floor(math.exp(math.floor(math.log(n) * 64) / 64)): 1 for n in (x, y)}
        plan = neardup.Plan(0.6, lows, [max(1, round(low * 0.6)) for low in lows], np.zeros(neardup.BINS, np.uint8), 2, kept, 0, 1)
        probe = neardup.probes(plan, el[:x], np.array([0, x]), np.array([x]))
        indexed = neardup.index(plan, el, np.array([0, y]), np.array([y]))
        assert not probe[4].any() and np.isin(probe[1], indexed[1]).sum() >= probe[3][0], (x, y)


def test_kept_sizes_are_not_below_their_bound(spark):
    rounded = F.floor(F.exp(F.floor(F.log("id") * 64) / 64)).cast("int")
    rows = spark.range(1, 200_000).select("id", F.when(F.col("id") < 4096, F.col("id")).otherwise(rounded).alias("n")).toPandas()
    assert (rows["n"].to_numpy() >= neardup.least_kept(rows["id"].to_numpy())).all()


def test_buckets_have_partitions_of_their_own(spark):
    for n in (1, 2, 6, 97, 5000):
        df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(neardup.spread(np.arange(n)))], "k int, b int")
        assert df.where(F.pmod(F.hash("b"), F.lit(n)) != F.col("k")).count() == 0
    df = spark.createDataFrame([(int(x),) for x in neardup.spread(np.arange(9))], "b int").repartition(9, "b")
    assert df.select(F.spark_partition_id()).distinct().count() == 9


def test_packing():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(-(2**63), 2**63 - 1, 50), np.zeros(0, np.int64), np.full(7, -3), rng.integers(0, 300, 99)]
    assert all((a == b).all() for a, b in zip(arrays, neardup.unpack(neardup.pack(*arrays)), strict=True))
    s = np.unique(rng.integers(0, 2**32, 300, dtype=np.uint32))
    a, b = s[:200], s[100:]
    p, q = neardup.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert sum(int(np.bitwise_count(x[0] ^ x[1])) for x in (p, q)) <= len(set(a) ^ set(b))


# ------------------------------------------------------------------ p2


def test_canonical_values(spark, data):
    terms = spark.read.parquet(f"{data}/canon_terms.parquet")
    values = {
        "bedroom": None, "Bedroom": 101, "the bedrooms": 101, "bedrom": 101, "bedroom (unit 4)": 101, "اتاق  خواب": 101, "sleeeping rom": 101, "ｂedroom": 101, "wcs": 105, "Dwelling-Space": 101,
        "fish pond": 0, "TBD": 0, "": 0, "???": 0, "x" * 30000: 0, "جان پناه": 120, "جانپناه": 120, "stepses": 116,
    }
    import json

    rows = [(i, json.dumps({"object": v})) for i, v in enumerate(values)] + [(90, json.dumps([{"subject": ["loggia", None, "loggia"], "relation": "mustn't face"}, "x", {"relation": "shal lopen into"}])), (91, '{"object": "bed'), (92, None), (93, '{"object": null}')]
    df = spark.createDataFrame(rows, "clause_id long, entities string").withColumn("value", F.lit(1)).withColumn("kind", F.lit("x"))
    got = {(r["clause_id"], r["pos"], r["field"], r["item"]): r["term_id"] for r in canon.canonical_entities(df, terms).collect()}
    want = {(i, 0, "object", 0): t for i, t in enumerate(values.values()) if t is not None}
    want |= {(90, 0, "subject", 0): 111, (90, 0, "subject", 2): 111, (90, 0, "relation", 0): 141, (90, 2, "relation", 0): 138}
    assert got == want
    assert canon.canonical_entities(df.limit(0), terms).count() == 0
    assert {r["term_id"] for r in canon.canonical_entities(df, terms.limit(0)).collect()} == {0}


def test_long_lists_and_bare_wording(spark):
    # More entries than any list that was once broadcast, and values one or two letters off.
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(7, 14)))
    words = sorted({word() for _ in range(2000)})
    terms = spark.createDataFrame([(i + 1, "element", w, None, None) for i, w in enumerate(words)], "term_id long, kind string, term string, term_fa string, aliases array<string>")
    many = spark.range(100_000).selectExpr("id + 10000 as term_id", "'element' as kind", "concat('zz', hex(id), 'qqqqqq') as term", "cast(null as string) as term_fa", "cast(null as array<string>) as aliases")
    picked = rng.sample(range(2000), 60)
    typed = [words[i][:3] + words[i][4:] if k % 2 else words[i][:2] + "x" + words[i][2:] for k, i in enumerate(picked)] + ["the " + words[0], "none such 5"]
    df = spark.createDataFrame([(k, json.dumps({"object": v})) for k, v in enumerate(typed)], "clause_id long, entities string")
    got = {r["clause_id"]: r["term_id"] for r in canon.canonical_entities(df, terms.unionByName(many)).collect()}
    assert [got[k] for k in range(60)] == [i + 1 for i in picked] and got[60] == 1 and got[61] == 0
    bare = {r["clause_id"]: r["term_id"] for r in canon.canonical_entities(df, terms, canon.BARE).collect()}
    assert [bare[k] for k in range(60)] == [i + 1 for i in picked] and bare[60] == 0


def test_bracketed_values_have_rows(spark, data):
    values = ["[door]", "[bedroom", "[bedroom]", "[1] fish pond", "[", "[]]", ["bedrom", "fish pond"], [], [None]]
    df = spark.createDataFrame([(i, json.dumps({"object": v})) for i, v in enumerate(values)], "clause_id long, entities string")
    got = {(r["clause_id"], r["item"]): r["value"] for r in canon.entity_values(df).collect()}
    assert got == {(i, 0): v for i, v in enumerate(values[:6])} | {(6, 0): "bedrom", (6, 1): "fish pond"}
    terms = spark.read.parquet(f"{data}/canon_terms.parquet")
    ids = {(r["clause_id"], r["item"]): r["term_id"] for r in canon.canonical_entities(df, terms).collect()}
    assert ids.keys() == got.keys() and ids[1, 0] == ids[2, 0] == ids[6, 0] == 101 and ids[3, 0] == ids[4, 0] == ids[6, 1] == 0


# ------------------------------------------------------------------ p4


def test_recall_against_brute_force(spark, data):
    import math

    rows = spark.read.parquet(f"{data}/clause_vectors.parquet")
    good = [(r["vec_id"], r["embedding"]) for r in rows.collect() if r["embedding"] and len(r["embedding"]) == 128 and all(math.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([i for i, _ in good]), np.array([e for _, e in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(x)) for b in np.argsort(-s[a])[:10] if s[a, b] >= 0.9}
    got = {tuple(r) for r in knn.similar_pairs(rows, "vec_id", "embedding").collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want


@pytest.mark.parametrize("total", [1_000, 30_000, 300_000, 3_000_000, 100_000_000])
def test_hits_at_the_floor_at_every_size(total):
    m, tables = knn.sized(total, 0.9)
    assert m >= 11 or total < 300_000
    # Pairs of unit vectors through the plan itself, with another seed than the model's.
    rng = np.random.default_rng(23)
    x = rng.normal(size=(4000, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    plan = knn.Plan(128, m, tables, knn.PROBES, knn.WIDTH, 1, 0, 11)
    met = np.zeros(len(x), bool)
    for t in range(tables):
        (a, pa_), (b, pb) = plan.keys(x.astype(np.float32), t), plan.keys(y.astype(np.float32), t)
        met |= (b[:, None] == pa_).any(1) | (a[:, None] == pb).any(1)
    assert met.mean() > 0.885


@pytest.mark.parametrize("total", [3_000, 300_000, 1_200_000, 3_000_000, 22_500_000, 112_500_000])
def test_vector_passes_bound_what_is_shuffled(total):
    m, tables = knn.sized(total, 0.9)
    steps = knn.passes(total, tables, knn.PROBES, knn.PASS_BYTES)
    assert sorted((t, share, shares) for part, share, shares in steps for t in part) == sorted((t, k, s) for t in range(tables) for s in [steps[0][2]] for k in range(s))
    assert all(knn.sent_bytes(total, len(part) * (knn.PROBES + 1) / shares) <= knn.PASS_BYTES for part, _, shares in steps)
    # Few enough for each to be worth reading the vectors again.
    assert len(steps) <= 2 * tables


def test_vector_passes_find_the_same(spark, data):
    df = spark.read.parquet(f"{data}/clause_vectors.parquet")
    pairs = lambda **o: sorted(tuple(r) for r in knn.nearest(df, "vec_id", "embedding", floor=0.8, **o).collect())
    whole = pairs()
    assert len(knn.passes(300, 3, knn.PROBES, 200)) == 3 and {s for _, _, s in knn.passes(300, 3, knn.PROBES, 100)} == {2}
    assert whole and pairs(most_bytes=200) == whole and pairs(most_bytes=100) == whole


def test_nearest_without_floor(spark, data):
    from planweave.llm.queries import queries

    got = {}
    for r in queries()["p4_nearest"](spark, data).collect():
        got.setdefault(r["vec_id"], set()).add((r["neighbour"], r["similarity"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{data}/clause_vectors.parquet").collect() if r["embedding"] is not None and len(r["embedding"]) == 128]
    rows = [(i, v / np.linalg.norm(v)) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.round(x @ x[i], 9)
        best = [j for j in np.lexsort((ids, -score)) if j != i][:10]
        assert sorted(b for b, _ in got.pop(ids[i])) == sorted(ids[best].tolist())
    assert not got


def test_batch_search_keeps_ties_and_blocks(spark):
    from planweave.operators.measures import top_k_batch

    rng = np.random.default_rng(2)
    v = [[1.0, 0.0]] * 30 + [[float(a), float(b)] for a, b in rng.integers(-3, 4, (200, 2))] + [[math.nan, 1.0], [1.0], None, [0.0, 0.0]]
    df = spark.createDataFrame([(len(v) - i, x) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    x = {len(v) - i: np.array(p) for i, p in enumerate(v) if p is not None and len(p) == 2 and np.isfinite(p).all() and any(p)}
    for itself in (True, False):
        got = {}
        for r in top_k_batch(df, "id", "v", 2, F.col("id") % 10 == 0, 5, itself, block=4).collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        cos = lambda a, b: round(float(x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))), 9)
        want = {q: sorted((-cos(q, b), b) for b in x if itself or b != q)[:5] for q in x if q % 10 == 0}
        assert {q: [i for _, i in sorted(p)] for q, p in got.items()} == {q: [i for _, i in p] for q, p in want.items()}
    assert top_k_batch(df, "id", "v", 2, F.col("id") < 0, 5).count() == 0


def test_full_cells_are_split(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=128) + 0.05 * rng.normal(size=(300, 128)), rng.normal(size=(100, 128))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in knn.similar_pairs(df, "vec_id", "embedding").collect()}
    monkeypatch.setattr(knn, "CELL_ROWS", 7)
    units = df.mapInArrow(lambda b: knn.unit_batches(128)(b), "id long, h1 long, h2 long, unit array<float>").select("id", "unit").toArrow()
    plan = knn.Plan(128, 11, 3, knn.PROBES, knn.WIDTH, 1, 0, 11)

    class Shipped:
        def __init__(self, value):
            self.value = value

    counts = next(knn.cell_counts(Shipped(plan), 128)(units.to_batches()))
    log = np.zeros(knn.BINS, np.uint8)
    log[counts["word"].to_numpy() * 64 + counts["bit"].to_numpy()] = np.round(np.log2(counts["count"].to_numpy()) * 8)
    assert 2 ** (log.max() / 8) > 100
    met = []
    for cells in (None, Shipped(log)):
        blobs = list(knn.key_batches(Shipped(plan), 128, cells)(units.to_batches()))
        pairs = [neardup.pairs_of(b) for batch in knn.meeting_batches(256, 1)(blobs) for b in batch.column(1).to_pylist()]
        met.append({(int(p[1]), int(p[2])) for p in np.concatenate(pairs)})
    assert met[0] == met[1] and whole <= met[0]


def test_vectors_edge_cases(spark):
    e = [1.0] + [0.0] * 127
    rows = [(i, e) for i in range(20)] + [(30, [0.0] * 128), (31, None), (32, e[:5]), (33, [float("nan"), *e[1:]]), (34, [2.0, *e[1:]]), (35, [0.0, 1.0, *e[2:]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = {(r["a"], r["b"]) for r in knn.nearest(df, "vec_id", "embedding").collect()}
    # Copies are equally near: the ten of least id, without oneself; the scaled one sees them too.
    assert {b for a, b in got if a == 0} == set(range(1, 11))
    assert {b for a, b in got if a == 19} == set(range(10))
    assert {b for a, b in got if a == 34} == set(range(10))
    assert {a for a, _ in got} == {*range(20), 34}
    assert knn.similar_pairs(df.limit(0), "vec_id", "embedding").count() == 0


# ------------------------------------------------------------------ p7


def leak_words(text):
    t = (consistent(text)[0] or "").casefold().replace("‌", "")
    return re.findall(r"\w+", "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() else c for c in t))


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    item = [" ".join(f"t{rng.randrange(40)}" for _ in range(n)) for n in (5, 8, 20, 40)] + ["", None]
    docs = []
    for k in range(120):
        w = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        src = (item[rng.randrange(4)]).split()
        a = rng.randrange(len(src))
        part = src[a : a + rng.randrange(14)]
        if part and rng.random() < 0.3:
            part[rng.randrange(len(part))] = "zz"
        w[len(w) // 2 : len(w) // 2] = part
        docs.append(rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 else " ".join(w))
    docs += [None, "", "a " * 100000, docs[0]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")

    def holds(x, y):
        a, b = leak_words(x), leak_words(y)
        runs = {tuple(b[k : k + 8]) for k in range(len(b) - 7)}
        return any(tuple(a[k : k + 8]) in runs for k in range(len(a) - 7))

    want = {(i, j) for i, x in enumerate(docs) for j, y in enumerate(item) if x and y and holds(x, y)}
    assert {tuple(r) for r in leak.leaks(d, it).collect()} == want
    assert leak.leaks(d.limit(0), it).count() == 0 and leak.leaks(d, it.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f X h i j k l")], "doc_id long, text string")
    got = leak.overlaps(one, spark.createDataFrame([(2, "a b c d e f g h i j k l")], "item_id long, text string")).first()
    assert (got["longest_run"], got["tolerant_words"]) == (6, 12)


def test_diagonals():
    rng = np.random.default_rng(6)
    rows = [rng.random(n) < 0.7 for n in (0, 1, 5, 40, 0, 3, 200, 1, 0)] + [np.ones(9, bool), np.zeros(4, bool)]
    run, words = leak.diagonals(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for got_run, got_words, same in zip(run, words, rows):
        longest = max((len(x) for x in "".join("1" if s else "0" for s in same).split("0")), default=0)
        v = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        best = max((v[j] - v[i], 0) for i in range(len(v)) for j in range(i, len(v)))[0]
        assert got_run == longest
        assert (got_words == 0) == (best == 0)
        assert not best or any(v[i + got_words] - v[i] == best for i in range(len(v) - got_words))


def test_leaks_of_many_hot_items(spark):
    rng = random.Random(5)
    passage = "one two three four five six seven eight"
    items = [(i, f"{passage} q{i}") for i in range(40)] + [(100, " ".join(f"r{rng.randrange(9999)}" for _ in range(3000)))]
    docs = [(i, f"d{i} {passage} e{i}") for i in range(900)] + [(5000, items[-1][1][500:]), (5000, passage), (5001, None)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leak.leaks(d, it).collect()}
    assert got == {(i, j) for i in [*range(900), 5000] for j in range(40)} | {(5000, 100)}


# ------------------------------------------------------------------ p8


@pytest.mark.parametrize("sf,within", [("sf0.001", 0.003), ("sf0.01", 0.0005), ("sf0.1", 0.0005)])
def test_mixture_meets_targets(spark, data, sf, within):
    docs, targets = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    mixed = mixture.mixture(docs, targets).cache()
    repeat = {r["source"]: r["max_repeat"] for r in targets.collect()}
    assert all(r["copies"] <= repeat[r["source"]] for r in mixed.collect())
    rows = mixture.shares(mixed, targets).collect()
    there = sum(r["target_share"] for r in rows if r["tokens"])
    for r in rows:
        assert r["share"] == 0 or abs(r["share"] - r["target_share"] / there) < within
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-9
    nothing = mixture.shares(mixture.mixture(docs.limit(0), targets), targets)
    assert {r["share"] for r in nothing.collect()} == {0.0}


def test_mixture_names_and_caps(spark):
    docs = [(i, "word " * 50, s) for i, s in enumerate(["A b", " a-B ", "a__b", "A_B"] * 5 + ["c"] * 3 + ["other", None])] + [(90, None, "c"), (91, "", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(0))
    t = spark.createDataFrame([("a_b", 0.5, 1), ("c", 0.5, 3), ("d", 0.0, 1)], "source string, target_share double, max_repeat int")
    rows = {r["doc_id"]: r for r in mixture.mixture(df, t).collect()}
    assert 23 not in rows and 90 not in rows and 91 not in rows
    assert all(r["copies"] <= (1 if r["source"] == "a_b" else 3) for r in rows.values())
    s = {r["source"]: r["share"] for r in mixture.shares(mixture.mixture(df, t), t).collect()}
    assert abs(s["a_b"] - 0.5) < 0.1 and s["d"] == 0
    one = mixture.mixture(df, t.limit(1))
    assert {r["share"] for r in mixture.shares(one, t.limit(1)).collect()} == {1.0}
    fixed = mixture.shares(mixture.mixture(df, t, total_tokens=600.0), t).collect()
    assert abs(sum(r["tokens"] for r in fixed) - 600) <= 60


def test_rates_of_cells_are_those_of_documents():
    rng = np.random.default_rng(4)
    k, n = 4, 400
    cells = mixture.Cells(k)
    own = rng.integers(0, k, n)
    cell = cells.of(own, (own + rng.integers(1, k, n)) % k, rng.integers(9, 17, n), rng.integers(0, 2, n))
    tokens, cap = rng.integers(1, 500, n).astype(float), np.full(n, 3.0)
    goal = np.array([0.4, 0.3, 0.2, 0.1]) * tokens.sum()
    each = mixture.fitted_rates(cells.shares(cell), tokens, goal, cap)
    at, back = np.unique(cell, return_inverse=True)
    joint = mixture.fitted_rates(cells.shares(at), np.bincount(back, weights=tokens), goal, cap[: len(at)])
    assert np.allclose(each, joint[back], atol=1e-6) and np.allclose((each * tokens) @ cells.shares(cell), goal, rtol=1e-4)
    assert (cells.shares(cell).sum(1) == 1).all() and (np.stack(cells.parts(cells.of(*cells.parts(cell)))) == np.stack(cells.parts(cell))).all()


@given(st.lists(st.tuples(st.integers(0, 2047), st.integers(1, 900)), max_size=60), st.floats(0, 30000))
@settings(max_examples=60, deadline=None)
def test_level_is_no_worse_than_any_prefix(items, goal):
    level = mixture.Level(np.zeros(1), np.zeros(1), 1)
    tokens = np.bincount([b for b, _ in items], weights=[w for _, w in items], minlength=mixture.BINS)[None].astype(float)
    level.choose(np.zeros(1), tokens, np.array([goal]))
    assert abs((tokens[0] * level.taken[0]).sum() - goal) <= np.abs(np.concatenate([[0], np.cumsum(tokens[0])]) - goal).min() + 1e-6


# ------------------------------------------------------------------ p9


@given(st.lists(st.text(alphabet="ab .!?؟\n\r\t۱A", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_sentence_spans(texts):
    from planweave.llm.consistent import code_points

    want = [[s for s in re.split(language.SENTENCE, t) if s.strip()] for t in texts]
    cps, off = code_points(pa.array(texts, pa.string()))
    number, spans = language.sentence_spans(cps, off)
    assert np.diff(spans).tolist() == [len(w) for w in want]
    flat = [s for w in want for s in w]
    for k, s in enumerate(flat):
        assert "".join(chr(c) for c in cps[(number == k) & ~language._BLANK[cps]]) == "".join(s.split())


def test_language_accuracy_and_segments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fitted(docs)
    rows = [
        (1, "The owner keeps a record of all checks on the shaft cover. The surveyor confirms the kitchen layout within ten days.", "en"),
        (2, "The owner keeps a record of all checks on the shaft cover. نقشه‌بردار چیدمان حمام را ظرف ۶۵ روز تأیید می‌کند. The surveyor confirms the kitchen layout within ten days.", "en_GB"),
        (3, "Leider ist die Schwelle schmaler als gefordert und muss ersetzt werden. (fire door) Damit kein Rauch eindringt, wird rund um den Anschluss Ziegel verwendet.", None),
        (4, "Le rapport n'indique pas si le balcon et la cave sont reliés.", "Turkish"),
        (5, "", None), (6, None, None), (7, "W5 x 17.5 EI60 ---", "de"), (8, "لا يجوز أن يفتح الباب مباشرة على المخزن إلا بعد موافقة مفتش الحريق. " * 3000, "xx"),
        (9, "Bu bölümde havalandırma kanalı doğrudan banyo içine açılamaz, ancak tasarım mühendisi izin verebilir.", "tr-TR"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("x"))
    got = sorted((r["doc_id"], r["seg_no"], r["lang"]) for r in language.relabelled(df, model=model).collect())
    assert got == [(2, 0, "en"), (2, 1, "fa"), (2, 2, "en"), (3, 0, "de"), (4, 0, "fr"), (8, 0, "ar")]
    assert all(0 < r["confidence"] <= 1 for r in language.languages(df, model=model).collect())
    assert language.relabelled(df.limit(0), model=model).count() == 0
    assert language.relabelled(df.limit(0)).count() == 0
    strange = [
        (20, "Las obras de conservación del edificio deben realizarse antes de que termine el verano, porque después la lluvia puede dañar el tejado y las paredes.", "es"),
        (21, "De eigenaar moet de aanvraag indienen bij de gemeente voordat de verbouwing van het huis kan beginnen.", None),
        (22, "xqzv wkjrp blorft zzgnk qwopl mnbtr vvxcq plokm ijnuh bygvt", "en"),
        (23, "My grandmother used to bake apple pies every Sunday while the children played in the garden behind the church.", "en"),
        (24, "مادربزرگم هر یکشنبه پای سیب می‌پخت در حالی که بچه‌ها در باغ پشت کلیسا بازی می‌کردند", "en"),
        (24, "My grandmother used to bake apple pies every Sunday while the children played in the garden behind the church.", "fa"),
    ]
    other = spark.createDataFrame(strange, "doc_id long, text string, lang string")
    told = sorted((r["doc_id"], r["lang"], r["label"]) for r in language.languages(other, model=model).select("doc_id", "lang", F.coalesce("label", F.lit("")).alias("label")).collect())
    assert told == [(20, "und", ""), (21, "und", ""), (22, "und", "en"), (23, "en", "en"), (24, "en", "fa"), (24, "fa", "en")]
    assert sorted((r["doc_id"], r["lang"]) for r in language.relabelled(other, model=model).collect()) == [(24, "en"), (24, "fa")]
    # Without a labelled document nothing is known.
    assert {r["lang"] for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    # Held out: documents after the sample's bound, by their labels, some of which are wrong.
    held = language.languages(docs, model=model).where("n_segments = 1 and label is not null")
    n = held.count()
    assert held.where("label = lang").count() > 0.85 * n


# ------------------------------------------------------------------ queries against their SQL


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_nearest", "p6_found", "p7_found"])
def test_queries_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    from planweave.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = con.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_class_queries(spark, data):
    from planweave.llm.queries import queries

    q = queries()
    links_ = q["p1_classes"](spark, data).collect()
    assert len({(r["field"], r["clause_id"]) for r in links_}) == len(links_) and all(r["links"] >= 0 for r in links_)
    looks = q["p6_classes"](spark, data).collect()
    assert sum(r["links"] for r in looks) == 2 * q["p6_found"](spark, data).count()
