"""Operators on documents against brute force, with odd rows, clashing columns and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from rows import TINY
from pyspark.sql import functions as F

from posturelake.llm import linededup, mixing, packing, quality, sharding, simhash, tokencount

SPACE = " \t\n\x0b\x0c\r"


def key(row):
    return repr(row)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_words(text):
    out = "".join(" " if c in SPACE else c for c in text or "").split(" ")
    return [w for w in out if w]


# op1


def plain_fingerprint(text):
    w = split_words(ascii_lower(text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    if not grams:
        return 0
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(ids, prints, limit=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                root[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i in range(len(ids)):
        least[find(i)] = min(least[find(i)], ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_odd_rows(clashing, odd_rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(clashing).collect()), key=key)
    known = [r for r in odd_rows if r[0] is not None]
    prints = [plain_fingerprint(r[1]) for r in known]
    roots = plain_groups([r[0] for r in known], prints)
    of = dict(zip(prints, roots))
    want = [(r[0], f"{plain_fingerprint(r[1]):016x}", of.get(plain_fingerprint(r[1]))) for r in odd_rows]
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("rows", [100, 4096])
def test_gray_index_finds_every_link(spark, rows):
    """With upper nodes that are cut again and without."""
    rng = random.Random(5)
    codes = {rng.getrandbits(64) for _ in range(1500)}
    for c in list(codes)[:300]:  # near copies, some of them of near copies
        for _ in range(4):
            c ^= 1 << rng.randrange(64)
            codes.add(c)
    hub = rng.getrandbits(64)
    codes |= {hub ^ (1 << i) for i in range(64)} | {hub ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, node long").repartition(7)
    old = simhash.NODE_ROWS
    simhash.NODE_ROWS = rows
    try:
        edges = simhash.links(df).collect()
        copies = simhash.upper_nodes(df).count()
    finally:
        simhash.NODE_ROWS = old
    assert copies == 3 * len(codes) if rows > len(codes) else copies > 3 * len(codes)
    from posturelake.operators.components import components

    got = dict(components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = plain_groups(list(range(len(codes))), codes)
    assert [got.get(i, i) for i in range(len(codes))] == want
    assert len(edges) < 20 * len(codes)


def test_links_of_real_codes_come_through_the_index(spark, monkeypatch):
    """Of ten thousand documents: nodes hold many codes, and nearly all pairs are found by searching Gray indexes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    codes = simhash.fingerprints(docs).groupBy("fp").agg(F.min("doc_id").alias("node"))
    codes = spark.createDataFrame(codes.toPandas())
    nodes = simhash.upper_nodes(codes).orderBy("mask", "value", simhash.gray_rank(F.col("fp"))).toPandas()
    sizes = nodes.groupby(["mask", "value"]).size()
    assert len(nodes) >= 3 * 9000 and sizes.max() > 256 and sizes[sizes > simhash.FANOUT].sum() > 0.99 * len(nodes)
    found, plain = [0], simhash.GrayIndex.search

    def counted(self, some, limit):
        who, at = plain(self, some, limit)
        found[0] += len(who) - len(some)  # each code finds itself
        return who, at

    monkeypatch.setattr(simhash.GrayIndex, "search", counted)
    fp = nodes["fp"].to_numpy().view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]])
    assert (nodes.groupby(["mask", "value"], sort=False).size().to_numpy() == sizes.to_numpy()).all()
    for _ in simhash._near(fp, nodes["node"].to_numpy(), starts, 2):
        pass
    small = sum(int((np.bitwise_count(fp[s : s + n, None] ^ fp[None, s : s + n]) <= 2).sum() - n) for s, n in zip(starts.tolist(), sizes.tolist()) if n <= simhash.FANOUT)
    assert found[0] > 10 and found[0] > 0.9 * (found[0] + small)


def test_gray_neighbours_differ_in_one_bit():
    ranks = np.arange(64, dtype=np.uint64)
    assert (simhash._ranks(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_drop_near_copies(odd, odd_rows):
    kept = [r["doc_id"] for r in simhash.drop_near_copies(odd).select("doc_id").collect()]
    groups = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(odd).collect()}
    assert sorted(k for k in kept if k is not None) == sorted({c for d, c in groups if d is not None})
    assert kept.count(None) == 2


def test_drop_near_copies_goes_by_text(spark):
    """Texts that share an id but are no near copies stay, and do not tie the groups of others together."""
    rng = random.Random(8)
    a, b, c = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (3, a), (9, b), (7, c), (None, a), (None, a)]
    got = Counter(map(tuple, simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter([(3, a), (5, b), (7, c), (None, a), (None, a)])


# op2


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(odd, odd_rows, rule):
    import public_tokenizers

    path = public_tokenizers.path(tokencount.VOCABULARY)
    encoding, _ = tokencount.encoder(path)
    got = sorted(((r["doc_id"], r["section"], r["n_tokens"], r["n_crossing"]) for r in tokencount.count_tokens(odd, rule=rule).collect()), key=key)
    want = []
    for doc, text, *_ in odd_rows:
        lines = (text or "").split("\n")
        owner = [n for n, line in enumerate(lines) for _ in range(len(line) + (n < len(lines) - 1))]
        counts, crossing, at = [0] * len(lines), [0] * len(lines), 0
        character = [i for i, c in enumerate(text or "") for _ in c.encode()]
        for t in encoding.encode_ordinary(text or ""):
            raw = encoding.decode_single_token_bytes(t)
            touched = [owner[i] for i in sorted(set(character[at : at + len(raw)]))]
            at += len(raw)
            tally = Counter(touched)
            own = touched[0] if rule == "first" else touched[-1] if rule == "last" else min(tally, key=lambda s: (-tally[s], s))
            counts[own] += 1
            crossing[own] += len(tally) > 1
        want += [(doc, n, counts[n], crossing[n]) for n in range(len(lines))]
    assert got == sorted(want, key=key)


def test_token_counts_of_several_fields(spark):
    df = spark.createDataFrame([(1, "a title", "body one\nbody two"), (2, None, "x")], "doc_id long, title string, text string")
    rows = tokencount.count_tokens(df, ("title", "text")).collect()
    assert sorted((r["doc_id"], r["field"], r["section"]) for r in rows) == [(1, "text", 0), (1, "text", 1), (1, "title", 0), (2, "text", 0), (2, "title", 0)]
    with pytest.raises(ValueError):
        tokencount.count_tokens(df, rule="other")


# op3


def plain_statistics(text):
    w = split_words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_quality_statistics(clashing, odd_rows):
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    got = sorted(((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in quality.quality(clashing).collect()), key=key)
    want = [(r[0], *(s := plain_statistics(r[1])), s[0] < 10 or 100 * s[4] > 20 * s[0]) for r in odd_rows]
    assert got == sorted(want, key=key)


def test_quality_rejects_outliers_only(spark):
    rng = np.random.default_rng(1)
    sound = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 300))), "en", "s", 0) for i in range(600)]
    junk = [(1000 + i, " ".join("ab$$$$%%" + "".join(rng.choice(list("abcd"), 12)) for _ in range(100)), "en", "s", 0) for i in range(60)]
    df = spark.createDataFrame(sound + junk, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert sum(verdict[d[0]] for d in sound) >= 597 and not any(verdict[d[0]] for d in junk)


def test_estimates_stand_against_outliers(spark):
    """A third of far outliers moves the plain mean but not the robust one, in a group of several blocks and in a small one."""
    rng = np.random.default_rng(2)
    rows = []
    for grp, n, out in ((1, 900, 300), (2, 5000, 1700), (3, 50, 16)):
        x = rng.normal(5, 1, (n, quality.DIM))
        x[:out] += 40
        rows += [(grp, int(m), *map(float, r)) for m, r in zip(rng.integers(-(2**62), 2**62, n), x)]
    df = spark.createDataFrame(rows, "grp long, mix long, " + ", ".join(f"{y} double" for y in quality._Y))
    got = {r["grp"]: np.array(r["mean"]) for r in quality.robust_estimates(df).collect()}
    assert set(got) == {1, 2, 3} and all(np.abs(m - 5).max() < (0.7 if g == 3 else 0.3) for g, m in got.items())
    again = {r["grp"]: np.array(r["mean"]) for r in quality.robust_estimates(df.repartition(5)).collect()}
    assert all(got[g] == pytest.approx(again[g], abs=1e-9) for g in got)


@pytest.mark.parametrize("seed", range(8))
def test_search_finds_the_least_determinant(seed):
    """Against every half of a small group."""
    rng = np.random.default_rng(seed)
    y = rng.normal(0, 1, (13, quality.DIM)) * rng.uniform(0.5, 4, quality.DIM)
    y[:4] += rng.normal(0, 8, (4, quality.DIM))
    h = int(quality.half(len(y)))
    factor = float(quality._factor(h, len(y)))
    best = math.inf
    for some in itertools.combinations(range(len(y)), h):
        cov = factor * np.cov(y[list(some)], rowvar=False, bias=True) + np.diag(np.square(quality.FLOORS))
        best = min(best, np.linalg.slogdet(cov)[1])
    assert quality.search(y)[2] == pytest.approx(best, abs=1e-9)


def test_step_over_all_rows_equals_a_plain_one(spark):
    """One concentration step by classes of distance against one by sorting; the class where half is reached counts in part."""
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, (4000, quality.DIM))
    df = spark.createDataFrame([(1, 0, *map(float, r)) for r in y], "grp long, mix long, " + ", ".join(f"{c} double" for c in quality._Y))
    mean, cov, _ = quality.search(y)
    start = spark.createDataFrame([(1, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), 0.0)], quality._ESTIMATE)
    got = quality._estimates(quality._nearest_half(df, start, True)).first()
    want = quality._concentrate(y, mean, cov, 1)
    assert np.array(got["mean"]) == pytest.approx(want[0], abs=0.02) and got["logdet"] == pytest.approx(want[2], abs=0.02)


def test_small_groups_are_judged_by_their_language(spark):
    """A source of 20 documents by its language, a language of 9 by all."""
    rng = np.random.default_rng(9)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 300)))
    junk = lambda: " ".join("ab$$$%%%" + "".join(rng.choice(list("abcd"), 12)) for _ in range(100))
    rows = [(i, text(), "en", "large", 0) for i in range(300)] + [(1000 + i, text(), "en", "small", 0) for i in range(20)] + [(2000 + i, text(), None, "x", 0) for i in range(9)]
    bad = [(3000, junk(), "en", "small", 0), (3001, junk(), None, "x", 0), (3002, junk(), "en", None, 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[r[0]] for r in rows) and not any(got[r[0]] for r in bad)


@pytest.mark.parametrize("n_junk", [300, 400])
def test_quality_rejects_a_third_and_more(spark, n_junk):
    """Junk that makes up a third or 40 % of its group."""
    rng = np.random.default_rng(4)
    sound = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 300))), "en", "s", 0) for i in range(600)]
    junk = [(1000 + i, " ".join("ab" + "$" * rng.integers(1, 9) + "".join(rng.choice(list("abcd"), rng.integers(2, 14))) for _ in range(rng.integers(30, 300))), "en", "s", 0) for i in range(n_junk)]
    df = spark.createDataFrame(sound + junk, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert sum(verdict[d[0]] for d in sound) >= 594 and not any(verdict[d[0]] for d in junk)


def test_quality_each_group_has_an_estimate_of_its_own(spark):
    """Groups of 49 and of 51 documents are judged alike, and so is a document alone in its group; a small group of junk is not excused by its own scatter."""
    rng = np.random.default_rng(3)
    rows = [("en", f"s{n}", *rng.normal(0, 1, quality.DIM)) for n in (1, 2, 10, 49, 50, 51, 300) for _ in range(n)] + [("en", "junk", *rng.normal(25, 1, quality.DIM)) for _ in range(6)]
    df = spark.createDataFrame([(i, "", i, *map(lambda x: x if isinstance(x, str) else float(x), r)) for i, r in enumerate(rows)], "doc_id long, text string, digest long, lang string, source string, " + ", ".join(f"{y} double" for y in quality._Y))
    grouped, counted = quality._grouped(df)
    found = quality.drawn_estimates(grouped, quality.robust_estimates(counted))
    assert found.count() == 8 and found.where(F.forall("mean", lambda x: x.isNotNull())).count() == 8
    far = {s: (lo, hi) for s, lo, hi in quality._with_distance(grouped, found, True).groupBy("source").agg(F.min("d2"), F.max("d2")).collect()}
    assert far["junk"][0] > quality.CUTOFF and all(hi < quality.CUTOFF / 2 for s, (_, hi) in far.items() if s != "junk")


def test_quality_draws_smoothly():
    """One document more changes what an estimate weighs by less than a fiftieth, at every size."""
    one, none = np.ones(quality.DIM), np.zeros(quality.DIM)
    weights = [quality.draw(one, np.eye(quality.DIM), n, none, 2 * np.eye(quality.DIM))[0][0] for n in range(200)]
    assert weights[0] == 0 and all(0 < b - a <= 1 / quality.PRIOR for a, b in zip(weights, weights[1:]))


def test_quality_chi2():
    assert quality._chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert quality._chi2_cdf(6.6257, 5) == pytest.approx(0.75, abs=1e-4)


# op4


def test_packing(clashing, odd_rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(clashing).collect()
    want = []
    for doc, text, *_ in odd_rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((doc, n, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_word_encoder_equals_the_tokenizer():
    rng = random.Random(9)
    letters = "abcXYZ éÉßœŒñÑ'’\"-_0129 \t\n.,;:!?«»½²ªµ日Σςáäǅ́  <|>"
    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b", "A<|ENDOFTEXT|>B", "it's We'LL 'S ''s x''ll"]
    texts += ["don't we'll 've'd x'S 're'r 'v 'l ''t", "\x00 a\x1fb \x7f \x85c", "\xaa\xad\xb5 \xd7\xf7 \xff\xdf", "T̈ Y̊ name", "x'", "'", "é" * 3000, "ab1" * 5000]
    texts += ["".join(rng.choice("abrstvelmdSTLEV''\' .1é") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = encoder.encode([t.encode() for t in texts])
    assert encoder.encode([None, b"", b" "]) == [b""] * 3 and encoder.encode([]) == []
    packing._KEPT, kept = 500, packing._KEPT
    try:  # ids stay right where parts are forgotten
        again = packing.WordEncoder(packing.tokenizer_path())
        assert [x for i in range(0, len(texts), 100) for x in again.encode([t.encode() for t in texts[i : i + 100]])] == got
        assert len(again.code) < 3000
    finally:
        packing._KEPT = kept
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = 60
    counts = {x: rng.randint(1, 30) for x in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    rows = packing.plan(counts, capacity)
    placed, used = Counter(), defaultdict(list)
    for r in rows.itertuples():
        for n in range(r.first, r.last + 1):
            k = n - r.first
            placed[r.length] += 1
            used[r.sequence + k // r.each].append((r.at + k % r.each * r.length, r.length))
    assert placed == Counter(counts)
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity
    assert sorted(used) == list(range(len(used)))
    large = [x for x, n in counts.items() for _ in range(n) if x > capacity // 3]
    best = best_fit(sorted(large, reverse=True), sorted((x for x, n in counts.items() for _ in range(n) if x <= capacity // 3), reverse=True), capacity)
    assert len(used) <= best


def best_fit(large, small, capacity):
    """One by one: the longest with the longest that fits, then each shorter one into the tightest gap."""
    gaps, left = [], list(large)
    while left:
        gap = capacity - left.pop(0)
        k = next((i for i, x in enumerate(left) if x <= gap), None)
        gaps.append(gap - (left.pop(k) if k is not None else 0))
    for x in small:
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps[gaps.index(min(fits))] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


# op5


def test_mixing(clashing, odd_rows):
    rows = mixing.mix(clashing).collect()
    sizes = [(r[0], len(split_words(r[1])), r[3]) for r in odd_rows]
    assert sorted(((r["doc_id"], r["size"]) for r in rows), key=key) == sorted(((d, s) for d, s, _ in sizes), key=key)
    total = defaultdict(int)
    for _, s, source in sizes:
        total[source] += s
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(total.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
            open_.discard(s)
    assert sorted(r["target"] for r in rows) == pytest.approx(sorted(target[s] for *_, s in sizes))
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert all(abs(t - goal) <= 0.1 * goal + 40 for (_, goal), t in taken.items() if goal < 20_000)
    again = mixing.mix(clashing.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, again), key=key)


def test_flight_keeps_the_sums():
    rng = random.Random(4)
    for k in range(50):
        n = rng.randint(1, 200)
        sizes, p = [float(rng.randint(1, 50)) for _ in range(n)], [rng.random() for _ in range(n)]
        out = mixing.flight(sizes, p, np.random.default_rng(k))
        assert sum(0 < x < 1 for x in out) <= 2
        assert sum(out) == pytest.approx(sum(p), abs=1e-6)
        assert sum(s * x for s, x in zip(sizes, out)) == pytest.approx(sum(s * x for s, x in zip(sizes, p)), abs=1e-4)
        down = mixing.flight(sizes, p, np.random.default_rng(k), land=True)
        assert all(x in (0.0, 1.0) for x in down) and abs(sum(down) - sum(p)) < 4


@pytest.mark.parametrize("kind", ["mixed", "equal", "one giant"])
def test_flight_keeps_each_probability(kind):
    """Over many draws each unit is taken as often as its probability says."""
    rng = np.random.default_rng(7)
    sizes = {"mixed": np.sort(rng.lognormal(5, 1.5, 40).round() + 1)[::-1], "equal": np.full(40, 9.0), "one giant": np.array([1e5, *np.arange(39, 0, -1.0)])}[kind]
    p = rng.uniform(0.1, 0.9, 40)
    taken = [mixing.flight(sizes, p, np.random.default_rng(k), land=True) for k in range(3000)]
    off = np.mean(taken, axis=0) - p
    assert np.abs(off).max() < 5 * 0.5 / math.sqrt(3000)
    if kind == "mixed":
        assert np.mean([abs(t @ sizes - p @ sizes) for t in taken]) < 0.02 * (p @ sizes)


def test_blocks_of_a_large_source_are_flown_together(spark):
    old, mixing.BLOCK = mixing.BLOCK, 64
    try:
        units = spark.range(5000).selectExpr("'s' AS src", "id AS row", "xxhash64(id) AS mix", "id % 37 + 1 AS size", "0.3D AS p")
        out = mixing.balanced_sample(units).collect()
    finally:
        mixing.BLOCK = old
    assert len(out) == 5000 and {r["p"] for r in out} == {0.0, 1.0}
    want = 0.3 * sum(r["size"] for r in out)
    assert abs(sum(r["size"] for r in out if r["p"]) - want) < 0.02 * want


def test_mixed_documents_repeat(odd):
    rows = mixing.mix(odd).where("size > 0").groupBy("doc_id").agg(F.sum(F.col("taken") / F.col("size")).alias("n")).collect()
    want = {r["doc_id"]: r["n"] for r in rows if r["n"]}
    got = mixing.mixed_documents(odd).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == want


# op6


def plain_capacity(groups, shards):
    def fits(c):
        n, held = 1, 0
        for g in groups:
            if g > c:
                return False
            if held + g > c:
                n, held = n + 1, 0
            held += g
        return n <= shards

    low, high = 1, sum(groups)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def test_sharding(clashing, odd_rows):
    rows = sharding.shard(clashing).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=key) == sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows), key=key)
    of, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        of[(r["size"], r["text_crc32"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in of.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_minimax(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300))), "en", "s", 0) for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).groupBy("shard").agg(F.sum("size")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += len(r[1]) + 1
    assert max(r[1] for r in got) == plain_capacity(list(sizes.values()), 8)


@pytest.mark.parametrize("giants", [[], [0.5], [0.3, 0.3], [0.3, 0.14, 0.05]])
def test_sharding_with_giants(spark, giants):
    """Giants stand alone in the last shards; all others are cut minimax, contiguous in the order of their least ids."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(20, 300))) for _ in range(200)]
    whole = sum(map(len, texts))
    big = {f"giant {k} ": int(share / (1 - sum(giants)) * whole) for k, share in enumerate(giants)}
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(1000 * (k + 1) + i, g * 20, "en", "s", 0) for k, (g, n) in enumerate(big.items()) for i in range(n // (20 * len(g)))]
    rng.shuffle(rows)
    sizes, least = Counter(), {}
    for d, t, *_ in rows:
        sizes[t] += len(t) + 1
        least[t] = min(least.get(t, d), d)
    left, rest, alone = 8, dict(sizes), []
    while left > 1 and max(rest.values()) * left >= sum(rest.values()):
        alone.append(max(rest, key=rest.get))
        del rest[alone[-1]]
        left -= 1
    order = sorted(rest, key=least.get)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert len(alone) == sum(g > 1 / 8 for g in giants)
    assert sorted(got[least[t]] for t in alone) == list(range(left, 8))
    shards = [got[least[t]] for t in order]
    assert shards == sorted(shards) and set(shards) == set(range(left))
    filled = Counter()
    for t in order:
        filled[got[least[t]]] += rest[t]
    assert max(filled.values()) == plain_capacity([rest[t] for t in order], left)


# op9


def test_line_dedup(spark):
    rng = random.Random(8)
    shared = ["This license line stands in many of the documents here", "short", "Another   shared line that is certainly long enough, É", "this LICENSE line stands in many of the documents here"]
    rows = [(i, "\n".join(rng.choice([*shared, f"own line number {i} of the document with some more words {k}"]) + rng.choice(["", " ", "\t"]) for k in range(rng.randint(1, 8))), "en", "s", 0) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (51, "", "en", "s", 0), (None, shared[0] + "\nx", None, None, 1), (7, rows[7][1], "en", "s", 0)]
    rows += [(60, "\n".join(shared[k % 3] if k % 5 else f"own line {k}" for k in range(100_000)), "en", "s", 0)]  # a very long text
    own = "h doc keeper n id digest pos gone kept n_lines n_dropped __lost __doc __left __kept".split()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(1) for n in own})
    where = defaultdict(set)
    norm = lambda x: ascii_lower(x.strip(SPACE))
    rank = lambda d: -1 if d is None else d
    for d, text, *_ in rows:
        for x in (text or "").split("\n"):
            where[norm(x)].add(rank(d))
    lost = lambda d, x: len(norm(x)) >= 40 and len(where[norm(x)]) >= 5 and max(where[norm(x)]) != rank(d)
    want = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not lost(d, x)]
        want.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in linededup.line_report(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in got) > 20


# all of them


def test_empty_tables(empty):
    for f in (simhash.simhash_groups, simhash.drop_near_copies, tokencount.count_tokens, quality.quality, packing.pack_documents, mixing.mix, mixing.mixed_documents, sharding.shard, linededup.line_report):
        assert f(empty).count() == 0, f


def test_whole_tables(spark):
    """Every query gives a row for each document of the table."""
    from posturelake.llm.queries import QUERIES

    n = spark.read.parquet(f"{TINY}/documents.parquet").count()
    for name in ("op1_simhash", "op3_quality", "op5_mixing", "op6_sharding", "op9_line_dedup"):
        assert QUERIES[name](spark, TINY).count() == n, name
