"""The corpus operators against brute force, on small and awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import decontamination, langid, line_dedup, lm_scoring, packing, quality_knn, quality_rules, queries, shingles, simhash, suffix_array, suffix_dedup, textops, token_counts
from eventloom.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    pool = [" ".join(r.choice(["the", "a", "Été", "x1", "B&B", "漢字", "end."]) for _ in range(r.randrange(1, 25))) for _ in range(25)]
    out = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 8)))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (103, "one"), (None, "null id " * 5), (104, out[3][1]), (105, out[3][1] + " more"), (106, "long " * 30_000), (7, "again another version of seven")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Clashing and null extra columns beside doc_id and text."""
    df = spark.createDataFrame([(i, t, None, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp string, k int")
    return df.withColumns({c: F.lit(1) for c in ("bucket", "shard", "kept", "n_words", "source", "lang2")})


def empty(docs):
    return docs.limit(0)


def fingerprint(t, width):
    w = words(lower(t))
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_equals_brute_force(spark, docs, rows):
    fps = [fingerprint(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((str(d), f"{f:016x}", str(least.get(find(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("long_list", [1, 3, 1000])
def test_simhash_links_lose_nothing(spark, long_list):
    r = random.Random(long_list)
    base = r.getrandbits(64)
    fps = {base} | {base ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for _ in range(60)} | {r.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from eventloom.llm.graph import components

    got = {x.node: x.root for x in components(simhash.links(df, 3, long_list)).collect()}
    group = lambda f: got.get(f, f)
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            assert group(a) == group(b)
    sets = {}
    for f in signed:
        sets.setdefault(group(f), []).append(f)
    for s in sets.values():  # nothing joined without a chain of links
        seen, todo = {s[0]}, [s[0]]
        while todo:
            x = todo.pop()
            new = [y for y in s if y not in seen and ((x ^ y) & (2**64 - 1)).bit_count() <= 3]
            seen |= set(new)
            todo += new
        assert seen == set(s)


@pytest.mark.parametrize("long_list", [2, 8, 64])
def test_near_dedup_equals_brute_force_jaccard(spark, docs, rows, long_list):
    """Families of edited copies: each pair of similarity 0.8 or more is joined, and nothing else."""
    r = random.Random(11)
    made = list(rows)
    for f in range(12):
        text = [f"w{r.randrange(3000)}" for _ in range(r.choice([6, 40, 150, 600]))]
        for _ in range(12):
            copy = list(text)
            for _ in range(r.randrange(1 + len(text) // 25)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            made.append((1000 + len(made), " ".join(copy)))
    sets = []
    for _, t in made:
        w = words(lower(t))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(made)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i, j in itertools.combinations(range(len(made)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
            far += (fingerprint(made[i][1], 5) ^ fingerprint(made[j][1], 5)).bit_count() > 3
    assert far > 20  # beyond the radius of op1
    least = {}
    for i, (d, _) in enumerate(made):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.component_id)) for x in shingles.groups(df, long_list=long_list).collect())
    assert got == sorted((str(d), str(least.get(find(i)))) for i, (d, _) in enumerate(made))
    if long_list == 64:
        import corpus_pipeline

        gone = {d for i, (d, _) in enumerate(made) if d is not None and d != least[find(i)]}
        stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
        assert {x.doc_id for x in stage(spark, df, SF).collect()} == {d for d, _ in made} - gone
        assert shingles.groups(df.limit(0)).count() == 0


def test_suffix_array_sorts():
    r = random.Random(1)
    for _ in range(150):
        s = [r.randrange(1, r.choice([2, 3, 9])) for _ in range(r.randrange(60))] + [0]
        sa = suffix_array.suffix_array(np.array(s, np.uint8), 10)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("length", [12, 50])
def test_suffix_dedup_equals_brute_force(docs, rows, length):
    big = 2**63 - 1
    texts = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in texts:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, d), d)
    want = []
    for (d, b), (i, _) in zip(texts, rows):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((str(i), len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, length, bucket_bytes=20_000).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.suffix_dedup(empty(docs)).count() == 0


def test_quality_rules_base(docs, rows):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_rules(docs).collect())
    want = []
    for d, t in rows:
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want.append((str(d), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed))
    assert [g[:7] for g in got] == sorted(want)
    assert all(not (g[6] and g[7]) for g in got)
    assert quality_rules.quality_rules(empty(docs)).count() == 0


def test_quality_lines(spark):
    r = random.Random(1)
    good = "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "." for _ in range(8))
    junk = "\n".join(f"home | about | page{i} | login | more" for i in range(12))
    df = spark.createDataFrame([(1, good, 5), (2, good + "\nCopyright, all rights reserved.", 5), (3, junk + "\n" + "Only one plain line of text stands here.", 5)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in quality_rules.clean(df).collect()}
    assert set(out) == {1, 2} and out[1].text == good and out[2].text == good and out[2].n_chars == len(good)


def test_token_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    odd = ["don't <|endoftext|>x", "ÀÉÿ × ÷", "İstanbul Σίσυφος ς", "a\x00b", "é", "x" * 300, "12 3.4", "<| |>"]
    extra = docs.sparkSession.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs.select("doc_id", "text").union(extra), queries.vocabulary()).collect())
    want = []
    for d, t in [*rows, *((900 + i, t) for i, t in enumerate(odd))]:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((str(d), len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    out = packing.pack(docs, queries.vocabulary(), with_ids=True).toPandas()
    seqs = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in seqs:
        assert list(s.offset) == list(np.cumsum(s.length) - s.length) and s.length.sum() <= 4096
    assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c and len(i) == z for i, c, z in zip(out.ids, out.ids_crc32, out.length))
    assert len(out[out.doc_id == 106]) > 1
    for d, t in rows:
        if d is not None and sum(x == d for x, _ in rows) == 1:
            p = out[out.doc_id == d].sort_values("start")
            ids = [x for i in p.ids for x in i]
            assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2] and set(p.doc_tokens) == {len(ids)}
    assert packing.pack(empty(docs), queries.vocabulary()).count() == 0


def test_tightest_window():
    r = random.Random(3)
    w, rooms = packing.Windows(64), []
    for _ in range(400):
        z = r.randrange(1, 65)
        fit = [x for x in rooms if x >= z]
        assert w.tightest(z) == (min(fit) if fit else -1)
        w.put(z)
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - z)
        else:
            rooms.append(64 - z)


def brute_force_lm(rows):
    """Scores by the formulas, and a walk with an explicit stack of histories."""
    seqs = [(d, words(lower(t)) + [None]) for d, t in rows]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    uni, bi, tri = Counter(), Counter(), Counter()
    for d, w in seqs:
        if not out(d):
            uni.update(w)
            bi.update(zip([0, *w[:-1]], w))
            tri.update(zip([0, *w], w, w[1:]))

    def fit(histories, ones):  # histories by bins of powers of two, each with its mean
        bins = {}
        for c in histories:
            bins.setdefault(c.bit_length(), []).append(c)
        lo, hi = math.log(0.01), math.log(1e6)
        for _ in range(60):
            k = math.exp((lo + hi) / 2)
            left = sum(sum(b) * k / (sum(b) / len(b) + k) for b in bins.values())
            lo, hi = ((lo + hi) / 2, hi) if left < ones else (lo, (lo + hi) / 2)
        return math.exp((lo + hi) / 2)

    k2, k3 = fit(uni.values(), sum(c == 1 for c in bi.values())), fit(bi.values(), sum(c == 1 for c in tri.values()))
    n, v = sum(uni.values()), len(uni)
    want = []
    for d, w in seqs:
        base = score = 0.0
        for i, x in enumerate(w):
            p = (uni[x] + 1) / (n + v + 1)
            base += math.log10(p)
            h = w[i - 1] if i else 0
            p = (bi[h, x] + k2 * p) / ((uni[h] if i else uni[None]) + k2)
            if i:
                g = w[i - 2] if i > 1 else 0
                p = (tri[g, h, x] + k3 * p) / (bi[g, h] + k3)
            score += math.log10(p)
        want.append((str(d), out(d), len(w), sum(uni[x] > 0 for x in w), n, round(base, 5), round(score, 5)))
    return sorted(want)


@pytest.mark.parametrize("stretch", [4, 256])
def test_lm_scores_equal_brute_force(docs, rows, stretch, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STRETCH", stretch)
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm_scoring.score(docs, bucket_bytes=20_000).collect()]
    assert sorted(got) == brute_force_lm(rows)
    assert lm_scoring.score(empty(docs)).count() == 0


def test_lcs():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_leaks_are_those_of_a_word_search(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(words(lower(t))) + " "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    exact = {(d, i) for d, t in texts for i, x in items if x in t}
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert exact <= set(got)
    for r in got.values():
        assert r.lcs >= 0.65 * r.item_words
    planted = " ".join(words(items[0][1])[:-1] + ["other"])
    own = spark.createDataFrame([(1, "some words before it " + planted + " and after"), (2, None), (3, ""), (None, planted), (4, "nothing of the kind")], "doc_id long, text string").withColumn("terms", F.lit(1))
    assert {r.doc_id for r in decontamination.leaks(own, bench).collect()} == {1, None}
    assert decontamination.leaks(own.limit(0), bench).count() == 0 and decontamination.leaks(own, bench.limit(0)).count() == 0


def test_leaks_of_items_that_leak_often(spark):
    """Items that each stand in far over half a percent of passages, and share common words, are all found."""
    r = random.Random(5)
    common = ["the", "and", "of", "to", "in"]
    own = [f"v{k}" for k in range(400)]
    line = lambda n: " ".join(r.choice(common if r.random() < 0.4 else own) for _ in range(n))
    items = [(k, line(22)) for k in range(40)]
    hot = {2: items[2][1], 3: items[3][1], 5: items[5][1]}
    texts, planted = [], set()
    for d in range(1200):
        parts = [line(90)]
        for k, t in hot.items():
            if r.random() < 0.2:
                planted.add((d, k))
                parts += [t, line(60)]
        texts.append((d, " ".join(parts)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert planted <= got


def test_quality_and_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    q = quality_knn.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.95 and q.score.between(0, 1).all()
    g = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (g.lang_pred == g.lang).mean() > 0.97


def test_classifiers_on_awkward_rows(docs, rows):
    lang = docs.withColumn("lang", F.when(F.col("k") % 3 == 0, F.lit(None)).otherwise(F.lit("xx")))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.language_id(lang).collect()]
    assert len(got) == len(rows) and {p for d, p, _ in got if d in (100, 101, 102)} == {"und"} and all(0 <= s <= 1 for *_, s in got)
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    q = quality_knn.quality_scores(docs, labels).collect()
    assert len(q) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in q)
    assert quality_knn.quality_scores(docs, labels.limit(0)).count() == len(rows)
    assert langid.language_id(lang.limit(0)).count() == 0 and quality_knn.quality_scores(docs.limit(0), labels).count() == 0


def repeated_runs(rows, at):
    """(row's doc_id, line) of all lines in runs of `at` words or more that stand earlier, by looking every run up."""
    runs = {}
    for r, (d, t) in enumerate(rows):
        held = [(k, " ".join(words(lower(x)))) for k, x in enumerate((t or "").split("\n"))]
        held = [(k, x) for k, x in held if x]
        for s in range(len(held)):
            n = 0
            for e in range(s, len(held)):
                n += len(held[e][1].split(" "))
                if n >= at:
                    runs.setdefault(tuple(x for _, x in held[s : e + 1]), []).append((2**63 - 1 if d is None else d, r, held[s][0], [k for k, _ in held[s : e + 1]]))
                    if n >= at + 200 and at > 40:  # longer runs are unions of these
                        break
    gone = set()
    for places in runs.values():
        least, seen = min(p[0] for p in places), set()
        for d, r, _, ks in sorted(places):
            if d == least and r not in seen:
                seen.add(r)
            else:
                gone |= {(rows[r][0], k) for k in ks}
    return gone


def test_line_dedup_equals_brute_force(docs, rows):
    at, runs = 12, {}
    for r, (d, t) in enumerate(rows):
        held = [(k, " ".join(words(lower(x)))) for k, x in enumerate((t or "").split("\n"))]
        held = [(k, x) for k, x in held if x]
        for s in range(len(held)):
            n = 0
            for e in range(s, len(held)):
                n += len(held[e][1].split(" "))
                if n >= at:
                    runs.setdefault(tuple(x for _, x in held[s : e + 1]), []).append((2**63 - 1 if d is None else d, r, held[s][0], [k for k, _ in held[s : e + 1]]))
    gone = [set() for _ in rows]
    for places in runs.values():
        least, seen = min(p[0] for p in places), set()
        for d, r, _, ks in sorted(places):
            if d == least and r not in seen:
                seen.add(r)
            else:
                gone[r] |= set(ks)
    got = {r.k: r for r in line_dedup.line_dedup(docs, min_words=at, bucket_bytes=20_000).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        assert set(got[k].removed) == gone[k], (k, d)
        if t is not None:
            assert got[k].kept_text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
    assert line_dedup.line_dedup(empty(docs)).count() == 0


def test_pipeline_decisions(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in c.STAGES[:-1]:
        out = stored(stage(spark, now, SF), "test-stage")
        assert out.columns == columns
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(out) <= ids(now)
        if name == "quality_rules":
            assert ids(out) == {r.doc_id for r in quality_rules.quality_rules(now).where("kept").collect()}
        elif name == "line_dedup":
            kept = {r.doc_id: r for r in line_dedup.line_dedup(now).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == {d: r.kept_text for d, r in kept.items() if not r.n_removed or r.words_removed < r.n_words}
            assert repeated_runs([(r.doc_id, r.text) for r in now.collect()], 50) == {(d, k) for d, r in kept.items() for k in r.removed}
        elif name == "simhash_near_dedup":  # the smallest doc_id of each group joined by shingle similarity of 0.8 or more
            sets = {}
            for r in now.collect():
                w = words(lower(r.text))
                sets[r.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            root = {d: d for d in sets}

            def find(d):
                while root[d] != d:
                    d = root[d]
                return d

            for i, j in itertools.combinations(sorted(sets), 2):
                both = len(sets[i] & sets[j])
                if sets[i] == sets[j] or 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                    i, j = sorted((find(i), find(j)))
                    root[j] = i
            assert ids(out) == {d for d in sets if find(d) == d}
        elif name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids(now) - ids(out) == {r.doc_id for r in decontamination.leaks(now, bench).collect()}
        now = out
    packed = c.run(spark, SF).toPandas()
    assert set(packed.doc_id) == ids(now)


def test_hashes_are_xxh64():
    r = random.Random(4)
    parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 4, 7, 8, 31, 32, 33, 64, 100, 5000]))) for _ in range(60)]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    got = textops.xxh64(buf, np.cumsum(size) - size, size, 9)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 9) for p in parts]
    assert hashlib  # digests of the queries come from Spark's sha2
