"""Fingerprints, centroid clusters and spelling variants against plain versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.llm import centroids, fingerprints, spelling

LONG = "Ünïcode wörds, " * 9000


def _rows(df):
    plain = lambda v: "null" if not isinstance(v, str) and pd.isna(v) else str(v) if isinstance(v, (bool, np.bool_, str)) else f"{float(v):.12g}"
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


def _plain_digest(text):
    raw, counts = text.encode(), Counter()
    for k, (i, j) in enumerate(((7, 12), (5, 13))):
        for p in range(len(raw)):
            v = raw[p] + 256 * raw[(p + i) % len(raw)] + 65536 * raw[(p + j) % len(raw)]
            counts[(v * 0x9E3779B1 + k * 0x7F4A7C15) % 2**32 >> 24] += 1
    each = [counts[b] for b in range(256)]
    cuts = [sorted(each)[k] for k in (63, 127, 191)]
    return min(255, int(8 * np.log2(1 + len(raw)))), [sum(c > q for q in cuts) for c in each]


def _plain_likeness(a, b):
    return max(0, 320 - sum(abs(x - y) for x, y in zip(a[1], b[1])) - 8 * min(32, abs(a[0] - b[0]))) / 320


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_of_odd_rows(spark, parts):
    rows = [(7, "The quick brown fox " * 30), (7, "The quick brown fox " * 30), (7, "another text of the same id"), (9, None), (8, ""), (3, "é"), (2, "ab"), (1, LONG), (None, "lost " * 40), (None, "lost " * 40), (-5, "naïve 你好 𠮷 \x1c end" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("part", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.fingerprint_documents(docs.repartition(parts)).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    signed = lambda t: int(np.uint64(xxhash.xxh64(t, seed=42).intdigest()).astype(np.int64))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (doc_id, text), (_, other) in zip(order, order[1:] + order[:1]):
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        a, e, n = _plain_digest(text), _plain_digest(edited), _plain_digest(other)
        hexed = [f"{d[0]:02x}" + "".join(f"{4 * x + y:x}" for x, y in zip(d[1][::2], d[1][1::2])) for d in (a, e)]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexed, _plain_likeness(a, e), _plain_likeness(a, n)))
    assert _rows(got) == _rows(pd.DataFrame(want, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]))


def test_fingerprints_of_one_row_and_of_none(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = fingerprints.fingerprint_documents(docs).first()
    assert row.near_next == 1 and row.edited_sha256 != hashlib.sha256(text.encode()).hexdigest()
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_likeness_is_bounded_and_fingerprints_are_read_back(a, b):
    x, y = (fingerprints.digest(t.encode("utf-8", "surrogatepass")) for t in (a, b))
    assert 0 <= fingerprints.likeness(x, y) == fingerprints.likeness(y, x) <= 1
    assert fingerprints.likeness(x, x) == 1 and (fingerprints.read(fingerprints.written(x)) == x).all()


def test_edited_texts_are_nearer_than_the_next_ones(spark):
    found = fingerprints.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("n_chars >= 200").toPandas()
    other = found[found.fingerprint != found.fingerprint.shift(-1)]
    assert (other.near_edited > other.near_next).mean() > 0.99 and other.near_edited.quantile(0.05) > other.near_next.quantile(0.95)


def _plain_clusters(rows, k, rounds):
    kept = [(i, [max(-(2**27), min(2**27, int(np.floor(1024.0 * float(v))))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    centres = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        member = [near(x)[1] for _, x in kept]
        for n in range(len(centres)):
            own = [x for (_, x), m in zip(kept, member) if m == n]
            if own:
                centres[n] = [sum(v) // len(own) for v in zip(*own)]
    found = [(i, *near(x)) for i, x in kept]
    part = Counter()
    for _, d, n in found:
        part[n] += d
    return [(i, n, d, part[n], sum(part.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found]


def _vectors(rng, n, spread):
    base = rng.standard_normal((5, 64))
    return [(k, (base[k % 5] + spread * rng.standard_normal(64)).tolist()) for k in range(n)]


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (8, 0)])
def test_clusters_match_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(4)
    rows = _vectors(rng, 240, 0.9) + [(900, [0.0] * 64), (901, [0.0] * 64), (901, [0.0] * 64), (None, [0.5] * 64), (5, [0.25] * 64)]
    rows += [(910, None), (911, []), (912, [1.0] * 63), (913, [float("nan")] + [1.0] * 63), (914, [None] + [1.0] * 63), (915, [float("-inf")] + [1.0] * 63), (916, [1.0] * 65)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("x", F.lit(0)).repartition(7)
    got = centroids.cluster_vectors(df, k, rounds).toPandas()
    want = pd.DataFrame(_plain_clusters(rows, k, rounds), columns=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    assert _rows(got) == _rows(want)


def test_clusters_of_huge_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1e300] * 63 + [0.0])]
    got = {r.vec_id: r for r in centroids.cluster_vectors(spark.createDataFrame(huge, schema)).collect()}
    assert len(got) == 3 and sorted(r.distance for r in got.values()) == [0, 0, 0]
    assert centroids.cluster_vectors(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).count() == 0


def test_bounds_spare_distances_and_are_never_wrong():
    rng = np.random.default_rng(8)
    x = np.floor(1024 * np.array([v for _, v in _vectors(rng, 1500, 0.25)])).astype(np.int64)
    history, k, passes = x[:8][None].copy(), 8, 9
    known = centroids.Bounds(np.full(len(x), -1), np.zeros((len(x), k)), np.zeros((len(x), k), np.int32))
    for _ in range(passes):
        centroids.assign(x, known, history)
        exact = ((x[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (known.own == exact.argmin(axis=1)).all()
        low = known.at - centroids.displacements(history)[known.since, np.arange(k)]
        assert (low * (1 - centroids.SLACK) - centroids.SLACK <= np.sqrt(exact)).all()
        new = np.array([x[known.own == c].sum(axis=0) // max(1, (known.own == c).sum()) if (known.own == c).any() else history[-1, c] for c in range(k)])
        history = np.concatenate((history, new[None]))
    assert known.evaluated < 0.6 * passes * len(x) * k
    steps = np.sqrt((np.diff(history, axis=0).astype(float) ** 2).sum(axis=2)).sum(axis=0)
    assert (centroids.displacements(history)[0] <= steps * (1 + 1e-6)).all()


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def _plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, []
    near = {w: [v for v in words if _near(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return pd.DataFrame(out, columns=["word", "form", "root", "n", "n_near", "form_n"])


@pytest.mark.parametrize("group", [2, 30, spelling.GROUP])
def test_variants_match_brute_force(spark, group):
    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abeéÀ"), rng.integers(4, 9))) for _ in range(40)] + ["prefix" + "".join(rng.choice(list("abc"), 3)) for _ in range(27)]
    texts = [" ".join(rng.choice(stems, 120) if k % 2 else [s[:p] + s[p + 1 :] for s, p in zip(rng.choice(stems, 60), rng.integers(0, 6, 60))]) for k in range(24)]
    long = "q" * 3000 + "w" * 3000
    odd = [(1, None), (2, ""), (3, "12 345 ..."), (4, f"{long} {long} {long} {long[1:]} {long[1:]} {long[1:]}"), (5, "Straße STRASSE ×÷×÷× \U0001d504bcdef naïve 你好words"), (6, texts[0]), (6, texts[0]), (None, texts[1])]
    rows = list(enumerate(texts, 10)) + odd + [(k, "ÀÉÎÕÜ àéîõü Àéîõü ab-cdefg") for k in range(100, 103)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("clash"))
    got = spelling.group_variants(docs, group).toPandas()
    want = _plain_variants(rows)
    assert _rows(got) == _rows(want)
    assert want.form.notna().sum() > 20 and (want.root != want.form).sum() > 0 and (want.word.str.len() > 5000).sum() == 2


def test_no_words_no_variants(spark):
    docs = spark.createDataFrame([(1, "a b c 1 2 3"), (2, None)], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0 and spelling.group_variants(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abé", min_size=0, max_size=7), min_size=1, max_size=30, unique=True), st.integers(1, 9))
def test_scan_finds_the_pairs_of_its_interval(words, width):
    entries = sorted(w.encode("latin-1") for w in words)
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = spelling.scan(entries, np.zeros(len(entries), int), np.arange(len(entries)), np.full(len(entries), width))
    want = [(i, j) for i, x in enumerate(entries) for j, y in enumerate(entries) if _near(x, y) and prefix(x, y) < width]
    assert sorted(zip(a.tolist(), b.tolist())) == want

