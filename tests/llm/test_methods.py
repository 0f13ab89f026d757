"""The steps inside the corpus operators, each against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.llm import decontamination, graph, langid, line_dedup, packing, quality_knn, quality_rules, shingles, simhash, suffix_array


def bucket_of(texts, min_words, ids=None):
    t = pa.table({"doc_id": pa.array(ids or list(range(len(texts))), pa.int64()), "text": pa.array(texts), "b": pa.array([0] * len(texts), pa.int32())})
    return line_dedup.Bucket(t, "b", min_words)


def test_winnowing_selects_the_first_minimum_of_every_window():
    r = random.Random(3)
    pool = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 9))) for _ in range(60)]
    b = bucket_of(["\n".join(r.choice([*pool, ""]) for _ in range(40)) for _ in range(20)], 20)
    h = b.hash.tolist()
    assert len(b.a) > 300
    for a, z, at in zip(b.a.tolist(), b.z.tolist(), b.at.tolist()):
        assert at == min(range(a, z), key=lambda i: (h[i], i))
    posted = set(b.at.tolist())
    assert len(posted) < len(b.hash) < len(b.a)  # positions are selected: fewer than lines, far fewer than windows
    keys, several = b.posted()
    count = {}
    for p in posted:
        count[h[p]] = count.get(h[p], 0) + 1
    assert dict(zip(keys.tolist(), several.tolist())) == {k: c > 1 for k, c in count.items()}


def test_extension_parts_windows_line_by_line():
    r = random.Random(4)
    n = 400
    hashes = np.array([r.randrange(3) for _ in range(n)], np.uint64)
    checks = hashes + np.uint64(7)
    checks[r.randrange(n)] = 99  # alike in one half of the digest only
    at = np.array([r.randrange(6, n - 6) for _ in range(300)])
    left, right = (np.array([r.randrange(5) for _ in at]) for _ in range(2))
    got = line_dedup.extend(hashes[at], left, right, at, hashes, checks).tolist()
    content = [(a_l, a_r, tuple(zip(hashes[p - a_l : p + a_r + 1].tolist(), checks[p - a_l : p + a_r + 1].tolist()))) for p, a_l, a_r in zip(at.tolist(), left.tolist(), right.tolist())]
    for i, c in enumerate(content):
        same = [j for j, d in enumerate(content) if d == c]
        assert (got[i] == -1) == (len(same) == 1)
        assert len({got[j] for j in same}) == 1 and all(got[j] != got[i] or got[i] == -1 for j, d in enumerate(content) if d != c)


def test_line_stage_carries_columns_of_any_name(spark):
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, line, 7, 5, "a"), (2, line + "\nnew words", 9, 5, None), (3, line, 4, 1, "c"), (None, None, 1, None, "d"), (5, "", None, 0, "e")], "doc_id long, text string, n_words int, n_chars int, kept_text string")
    df = df.withColumns({"bucket": F.lit(1), "carried": F.lit("x"), "removed": F.lit(2.5), "kind": F.lit(None).cast("string")})
    out = line_dedup.clean(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    got = {r.doc_id: r.asDict() for r in out.collect()}
    want = {r.doc_id: r.asDict() for r in df.collect() if r.doc_id != 3}
    want[2] |= {"text": "new words", "n_chars": 9}
    assert got == want
    assert line_dedup.clean(df.limit(0)).count() == 0


def test_every_level_of_a_suffix_array_is_induced(monkeypatch):
    """A megabyte of real text: the reduced strings are sorted by recursion, several levels deep."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    raw = b"\xff".join(t.encode() for t in texts if t)[: 1 << 20]
    s = np.append(np.frombuffer(raw, np.uint8), np.uint8(0))
    s[:-1] = np.maximum(s[:-1], 1)
    levels, inner = [], suffix_array.suffix_array
    monkeypatch.setattr(suffix_array, "suffix_array", lambda s, n: levels.append(len(s)) or inner(s, n))
    sa = suffix_array.suffix_array(s, 256)
    assert len(levels) >= 3 and all(2 * b <= a + 1 for a, b in zip(levels, levels[1:]))
    assert np.array_equal(np.sort(sa), np.arange(len(s)))
    text = s.tobytes()
    for i in random.Random(5).sample(range(len(sa) - 1), 3000):
        a, b, k = int(sa[i]), int(sa[i + 1]), 64
        while text[a : a + k] == text[b : b + k]:
            k *= 2
        assert text[a : a + k] < text[b : b + k]


def test_both_ways_of_inducing_agree(monkeypatch):
    r = random.Random(6)
    for _ in range(100):
        s = np.array([r.randrange(1, r.choice([2, 3, 9, 200])) for _ in range(r.randrange(150))] + [0], np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for wide in (0, 256):
            monkeypatch.setattr(suffix_array, "WIDE", wide)
            assert suffix_array.suffix_array(s, 200).tolist() == want


def test_pairs_are_tallied_over_posting_lists(spark):
    """Tallies are the shared position sets; only pairs that reach the minimum go on, and none within the radius is lost."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << r.randrange(64) for _ in range(k)) for b in base for k in (1, 2, 3)]
    half = [(b & 0xFFFFFFFF) | (r.getrandbits(32) << 32) for b in base]  # four bytes shared: one list of four sets, never enough
    fps = sorted(set(base + near + half))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for size in (3, 4):
        sets = list(itertools.combinations(range(8), size))
        masks = [simhash._mask(s) for s in sets]
        got = {(x.a, x.b): x.tally for x in simhash.tallied(simhash.postings(df, masks)).collect()}
        want = {}
        for x, y in itertools.combinations(fps, 2):
            same = [p for p in range(8) if (x ^ y) >> 8 * p & 255 == 0]
            if len(same) >= size:
                want[tuple(sorted((signed(x), signed(y))))] = math.comb(len(same), size)
        assert got == want
        assert any(n < math.comb(5, size) for n in want.values())
    links = {(x.a, x.b) for x in simhash.links(df).collect()}
    assert links == {tuple(sorted((signed(x), signed(y)))) for x, y in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= 3}


def test_paraphrases_are_found(spark):
    """Items with a share of their words replaced at random, planted in real text: recall 0.9 or more up to a quarter."""
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(x.item_id, x.text.split()) for x in bench.collect()]
    pool = [w for x in docs.orderBy("doc_id").limit(300).collect() for w in (x.text or "").split()]
    r, rows, truth = random.Random(3), [], {}
    for share in (0, 0.1, 0.2, 0.25):
        for i, w in items:
            c = list(w)
            for j in r.sample(range(len(c)), round(share * len(c))):
                c[j] = r.choice(pool)
            a, d = r.randrange(len(pool) - 400), 10**7 + len(rows)
            rows.append((d, " ".join(pool[a : a + r.randrange(150)] + c + pool[a + 200 : a + 200 + r.randrange(150)])))
            truth[d] = share, i
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(x.doc_id, x.item_id): x for x in decontamination.leaks(every, bench).collect()}
    found = {}
    for d, (share, i) in truth.items():
        found.setdefault(share, []).append((d, i) in got)
    recall = {s: sum(x) / len(x) for s, x in found.items()}
    assert recall[0] == 1 and recall[0.1] == 1 and recall[0.2] >= 0.9 and recall[0.25] >= 0.9, recall
    assert not [x for (d, _), x in got.items() if d < 10**7 and x.lcs < 0.9 * x.item_words]  # nothing by chance


def test_leaks_of_awkward_rows(spark):
    r = random.Random(9)
    item = " ".join(f"q{r.randrange(10**6)}" for _ in range(30))
    filler = " ".join(f"f{r.randrange(900)}" for _ in range(40_000))
    rows = [(1, f"{filler} {item} {filler}"), (2, item), (2, item), (3, item.upper()), (4, None), (5, ""), (None, item), (6, filler), (7, f"{item} {filler} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone_id", "item_id", "cosine", "_leaking_id")})
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (None, item)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontamination.leaks(docs, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3, 7, None) for i in (10, None)}
    assert got[1, 10].first_word == 40_000 and got[7, 10].first_word == 0 and all(x.lcs == 30 for x in got.values())
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(x.doc_id) for x in left.collect()) == ["4", "5", "6", "None"]


def test_near_dedup_stages_keep_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "a"), (2, text, None), (None, text, "b"), (3, None, "c"), (4, "", "d")], "doc_id long, text string, _dropped_id string").withColumns({"gone_id": F.lit(2), "gone_id_1": F.lit(None).cast("int")})
    for stage in (simhash.keep_first, shingles.keep_first):
        out = stage(df)
        assert out.columns == df.columns
        assert sorted(str(x.doc_id) for x in out.collect()) == ["1", "3", "None"]  # empty texts are copies too
        assert stage(df.limit(0)).count() == 0


def test_network_gradients_are_those_of_differences():
    r = np.random.default_rng(2)
    net = langid.ByteCnn(3, width=24, filters=4, dims=3)
    net.p = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(0, 256, (5, 24)).astype(np.uint8), r.integers(0, 3, 5)
    _, g = net.step(x, y)
    for name, grad in g.items():
        flat = net.p[name].reshape(-1)
        picks = np.argsort(-np.abs(grad).reshape(-1))[:6]
        for i in picks:
            old, e = flat[i], 1e-6
            flat[i] = old + e
            up, _ = net.step(x, y)
            flat[i] = old - e
            down, _ = net.step(x, y)
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad.reshape(-1)[i]) < 1e-4, name


def test_network_tables_equal_a_plain_convolution():
    r = np.random.default_rng(4)
    net = langid.ByteCnn(3, width=20, filters=5, dims=4)
    net.p["V"] = r.normal(size=net.p["V"].shape).astype(np.float32)
    x = r.integers(0, 256, (7, 20)).astype(np.uint8)
    want = []
    for row in x:
        pooled = []
        for w in net.sizes:
            for f in range(5):
                pooled.append(max(float(sum(net.p["E"][row[i + j]] @ net.p[f"W{w}"][4 * j : 4 * j + 4, f] for j in range(w))) for i in range(20 - w + 1)) + net.p[f"b{w}"][f])
        z = np.maximum(pooled, 0) @ net.p["V"] + net.p["c"]
        want.append(np.exp(z) / np.exp(z).sum())
    assert np.allclose(langid.predict(net.tables(), x), want, atol=1e-4)


def test_votes_are_of_all_nearest_and_ties():
    r = random.Random(10)
    cos = np.array([[r.choice([0.9, 0.5, 0.25, -0.3, 0.1]) for _ in range(12)] for _ in range(40)], np.float32)
    for k in (1, 3, 12):
        got = quality_knn.votes(cos, k)
        for row, w in zip(cos.tolist(), got.tolist()):
            last = sorted(row, reverse=True)[k - 1]
            assert np.allclose(w, [max(c, 1e-3) ** 8 if c >= last else 0 for c in row], rtol=1e-4)


def test_packing_is_best_fit_decreasing():
    """Against a plain search for the tightest window, piece by piece."""
    r = random.Random(11)
    sizes = sorted((r.randrange(1, 101) for _ in range(400)), reverse=True)
    windows, used = packing.Windows(100), []
    for s in sizes:
        w, at = windows.put(s)
        fit = [100 - u for u in used if 100 - u >= s]
        if fit:
            assert 100 - used[w] == min(fit) and at == used[w]
            used[w] += s
        else:
            assert w == len(used) and at == 0
            used.append(s)
    assert sum(used) == sum(sizes) and len(used) <= 11 * -(-sum(sizes) // 100) / 9 + 1


def test_quality_verdict_equals_brute_force(spark):
    """Every line judged by hand-written rules, over a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = quality_rules.Rules()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ends = (*".!?:;\"')]", "…", "”", "»", "。")
    want = {}
    for x in docs.collect():
        lost, gone, n = 0, 0, 0
        for line in (x.text or "").split("\n"):
            w = word.findall(line)
            n += len(w)
            if not w:
                continue
            symbols, low = sum(line.count(c) for c in "#*$%&|<>"), re.sub("[A-Z]", lambda m: m[0].lower(), line)
            bad = not w[-1].endswith(ends) and (len(w) < rules.short_line or not any(c in line for c in ".!?;:,"))
            bad |= symbols > rules.symbols_per_word * len(w) or any(p.decode() in low for p in quality_rules.BOILERPLATE)
            gone += bad
            lost += len(w) * bad
        want[x.doc_id] = gone, lost, n
    seen = set()
    for x in quality_rules.quality_rules(docs, texts=False).collect():
        gone, lost, n = want[x.doc_id]
        assert (x.n_lines_removed, x.lost_words, x.n_words) == (gone, lost, n)
        assert x.kept == (not x.base_failed and lost <= rules.max_lost * n)
        seen.add((x.base_failed, x.kept))
    assert len(seen) >= 2


def test_components_of_many_tasks(spark, monkeypatch):
    """Rounds of star operations, with so small a bound that every task has but a few links."""
    r = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 300) if i % 41] + [(1000, 1000 + i) for i in range(1, 400)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(260)]
    edges = [(b, a) if r.random() < 0.5 else (a, b) for a, b in edges if a != b]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for bound in (100, 250_000):
        monkeypatch.setattr(graph, "LINKS_A_TASK", bound)
        got = {x.node: x.root for x in graph.components(df).collect()}
        assert all(got.get(n, n) == find(n) for n in root)


def test_long_simhash_lists_and_radius_find_similarity_of_0_8():
    """Sets of similarity 0.8 lie within the radius, and share two lists of two positional bytes; others do neither."""
    r = np.random.default_rng(8)
    for size in (20, 90, 900):
        both, own = size * 8 // 10, size // 10
        made = r.integers(0, 2**64, (300, both + 2 * own), np.uint64)
        x, y = made[:, : both + own], np.concatenate([made[:, :both], made[:, both + own :]], axis=1)
        fx, fy = (shingles.long_simhash(np.ascontiguousarray(s).ravel(), np.full(300, both + own)) for s in (x, y))
        differ = np.bitwise_count(fx ^ fy)
        assert differ.sum(1).max() <= shingles.RADIUS and (differ[:, : shingles.CARRIED].sum(1) > shingles.RADIUS_CARRIED).sum() <= 1
        assert np.bitwise_count(fx ^ np.roll(fy, 1, 0)).sum(1).min() > shingles.RADIUS
        for bits in (0, 4):
            kx, ky = (shingles.list_keys(f.view(np.int64), bits) for f in (fx, fy))
            shared = (kx == ky).sum(1)
            assert (shared < shingles.LEAST_SHARED).sum() <= 2 and shared.mean() > 7
            assert ((kx == np.roll(ky, 1, 0)).sum(1) >= shingles.LEAST_SHARED).sum() <= 1
    bit = shingles.long_simhash(np.array([7], np.uint64), np.array([1]))  # of one shingle: its hashes
    three = shingles.long_simhash(np.array([7, 7, 9], np.uint64), np.array([3]))
    assert (bit == three).all() and bit.shape == (1, 16)


def test_dense_groups_give_forests_not_pairs():
    """A list or block of alike sets gives fewer links than members, where pairs were links before."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2**64, 100, np.uint64)
    sets = [np.sort(np.concatenate([base[3:], r.integers(0, 2**64, 3, np.uint64)])) for _ in range(60)]
    n = np.full(60, 100)
    fps = shingles.long_simhash(np.concatenate(sets), n)
    a, b = shingles.joined(fps, n, np.concatenate(sets), np.zeros(60, bool), 0, 0.8)
    assert len(a) == len(b) == 59
    x, _ = shingles.near_in_lists(np.zeros(60, np.int64), np.arange(60), n, [fps[:, i] for i in range(shingles.CARRIED)], 0.8)
    assert len(x) == 59
