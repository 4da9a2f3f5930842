"""Operators on pages and vectors, and the pipeline, against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import TINY
from test_documents import plain_fingerprint, plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from posturelake.llm import hamming, packing, quality, urlfilter, warc
from posturelake.plans.lineage import checkpoint_folder


def key(row):
    return repr(row)


# op7


@pytest.mark.parametrize("k,n", [(1, 40), (10, 300), (50, 30)])
def test_top_k_equals_brute_force(spark, k, n):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(15)] + [(5, rows[5][1]), (9000, None), (None, rows[1][1]), (9001, []), (9002, [1.0, float("nan"), None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "code", "block", "role")})
    queries = df.where("vec_id % 5 = 0 OR vec_id >= 9000")
    code = lambda v: [x is not None and x == x and x > 0 for x in [*v, *[0] * (64 - len(v))]]
    known = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    want = []
    for q, c in known:
        if q % 5 == 0 or q >= 9000:
            far = sorted((sum(a != b for a, b in zip(c, d)), i) for i, d in known if i != q)
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(far[:k])]
    got = sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in hamming.top_k(df, queries, k).collect())
    want = sorted(set(want))
    assert sorted(set(got)) == want


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.top_k(df, df).count() == 0


def test_several_blocks_agree(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(400)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0")
    whole = sorted(map(tuple, hamming.top_k(df, q).collect()))
    old, hamming.BLOCK, hamming.SLICE = (hamming.BLOCK, hamming.SLICE), 50, 7
    try:
        assert sorted(map(tuple, hamming.top_k(df, q).collect())) == whole
    finally:
        hamming.BLOCK, hamming.SLICE = old


# op8


def test_rules_and_parts(spark):
    cases = {
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://x.com/en/": ("x.com", "/en/", "com/en/", "block"),
        "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "https://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "ftp://a.org/es/x://b": ("a.org", "/es/x://b", "org/es/", "block"),
        "https://com/en/": ("com", "/en/", "com/en/", "block"),
        "https://xcom/en/": ("xcom", "/en/", None, "allow"),
        "https://h?x/en/": ("h", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "label")})
    none = spark.createDataFrame([], "url string, blocked int")
    got = [tuple(r)[1:] for r in urlfilter.judge(df, none).orderBy("page_id").collect()]
    assert got == list(cases.values())
    assert urlfilter.judge(df.limit(0), none).count() == 0


def test_rules_are_those_of_the_contract():
    assert {rule: verdict for verdict, rule in urlfilter.RULES} == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_model_learns_hosts_on_held_out_urls(spark):
    rng = random.Random(1)
    good, bad = ["docs.sound-site.io", "wiki.reader.io"], ["track.adfarm.biz", "spam.clicks.biz"]
    urls = [(f"https://{rng.choice(good)}/fr/{rng.randint(1, 9999)}", 0) for _ in range(300)] + [(f"https://{rng.choice(bad)}/fr/{rng.randint(1, 9999)}", 1) for _ in range(300)]
    rng.shuffle(urls)
    train, test = urls[:400], urls[400:]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)], "page_id long, url string")
    says = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, spark.createDataFrame([*train, (None, None), ("bad url", 1)], "url string, blocked int")).collect()}
    right = sum((says[i] == "block") == bool(b) for i, (_, b) in enumerate(test))
    assert right / len(test) > 0.97


# op10


def odd_pages(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"), (6, "u", "\r\n\r\n\r\n"), (7, "u", "x\r\n"), (8, "u", "\n\r\r\n\r"), (9, "u", "z" * 300_000), (10, "u", "z" * 300_000), (2, "http://b/", "<p>é</p>"), (None, "n", "lone"), (None, "n", "<p>é</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "bytes", "value", "id", "lead")})


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_round_trip(spark, min_bytes):
    rows, df = odd_pages(spark)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        new = len(raw) < min_bytes or least.get(h or "") == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if new else "revisit", None if new else least.get(h or "")))
    assert sorted(map(tuple, warc.round_trip(df, min_bytes=min_bytes).collect()), key=key) == sorted(want, key=key)


def test_payloads_and_captures(spark):
    rows, df = odd_pages(spark)
    folder = f"{checkpoint_folder(spark)}/warc-test-{random.random()}"
    warc.write_archives(warc.records(df.where("page_id IS NOT NULL").dropDuplicates(["page_id"])), folder)
    made = warc.transactions(warc.read_archives(spark, folder)).collect()
    assert len(made) == 10 and all(len(m["requests"]) == 1 and len(m["metadata"]) == 1 for m in made)
    got = {int(m["metadata"][0]["fields"]["page-id"]): m["payload"] for m in made if m["type"] == "response"}
    assert {k: bytes(v).decode() for k, v in got.items()} == {i: h or "" for i, _, h in rows if i in got} and len(got) == 7


def test_concurrent_to_in_other_ways(spark):
    """A response that names its request, and metadata that names the request."""
    base = {"file": "f", "target_uri": "u", "refers_to": None, "digest": None, "payload_bytes": 0, "payload": None}
    one = lambda t, i, to, fields=None: (base["file"], t, i, to, "u", None, None, 0, fields, None)
    read = spark.createDataFrame([one("response", "R", ["Q"]), one("request", "Q", []), one("metadata", "M", ["Q"]), one("request", "Q2", ["R2"]), one("response", "R2", []), one("metadata", "M2", ["Q2"]), one("metadata", "lost", ["nowhere"])], warc.READ)
    got = {r["record_id"]: (len(r["requests"]), [m["record_id"] for m in r["metadata"]]) for r in warc.transactions(read).collect()}
    assert got["R2"] == (1, ["M2"]) and got["R"][0] == 1


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(df).count() == 0
    assert warc.round_trip(df).count() == 0


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, TINY)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, TINY).count() > 0


def test_pipeline_equals_plain_python(spark):
    """The rows after each stage against a plain version, with null and repeated ids, junk, near copies, shared lines and clashing columns."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    license_line = "This line of a license stands in many of the documents, word by word"
    sound = [(i, words(rng.randint(40, 200)), "en", rng.choice("ab")) for i in range(150)]
    sound += [(200 + i, words(60) + "\n" + license_line + "\n" + words(5), "en", "b") for i in range(7)]
    base = words(400)
    sound += [(300 + i, base + " " + words(1), "en", "a") for i in range(4)] + [(310, base, "en", "b"), (None, words(80), "en", "a"), (None, base, "en", None), (7, words(70), "en", "a"), (8, base, "fr", "a")]
    junk = [(7, " ".join("ab$$$%%%" + "".join(rng.choice("abcd") for _ in range(12)) for _ in range(100)), "en", "a"), (None, " ".join("x###&&&|||" + "".join(rng.choice("abcd") for _ in range(12)) for _ in range(90)), "en", "b")]
    junk += [(8, "too short", "en", "a"), (None, None, None, None), (9, "five words again and again " * 30, "en", "b"), (11, "", "en", "a")]
    rows = [(*r, len(r[1] or ""), "kept") for r in [*sound, *junk]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    ordered = lambda rs: sorted(map(key, map(tuple, rs)))

    docs = stage["quality rules"](spark, docs, TINY)
    now = docs.collect()
    assert ordered(now) == ordered((*r, len(r[1]), "kept") for r in sound)

    docs = stage["line dedup"](spark, docs, TINY)
    lost = max(d for d, t, *_ in sound if d is not None and license_line in t)
    after = []
    for r in map(tuple, now):
        text = r[1] if r[0] == lost else "\n".join(x for x in r[1].split("\n") if x != license_line)
        after.append((r[0], text, *r[2:4], r[4] if text == r[1] else len(text), r[5]))
    now = docs.collect()
    assert ordered(now) == ordered(after)

    docs = stage["SimHash near-dedup"](spark, docs, TINY)
    known = [r for r in after if r[0] is not None]
    groups = plain_groups([r[0] for r in known], [plain_fingerprint(r[1]) for r in known])
    keep = [r for r, g in zip(known, groups) if r[0] == g] + [r for r in after if r[0] is None]
    now = docs.collect()
    assert ordered(now) == ordered(keep) and len(keep) < len(after)

    docs = stage["mixing"](spark, docs, TINY)
    mixed = Counter(map(tuple, docs.collect()))
    size = {r: len(r[1].split()) for r in keep}
    assert set(mixed) <= set(keep) and max(mixed.values()) <= 3
    assert Counter(map(tuple, docs.collect())) == mixed
    taken, whole = Counter(), Counter()
    for r in keep:
        taken[r[3]] += mixed[r] * size[r]
        whole[r[3]] += size[r]
    # two sources weigh 5 and 2, the third, of one text, 1; it stops at three times its size
    goal = {None: 3.0 * whole[None]}
    rest = sum(whole.values()) - goal[None]
    goal |= {"a": rest * 5 / 7, "b": rest * 2 / 7}
    assert goal["a"] <= 3 * whole["a"] and all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] for s in goal)

    packed = stage["best-fit packing"](spark, docs, TINY).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r, n in mixed.items():
        ids = np.array([*tok.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        want += [(r[0], 0, 0, len(ids), zlib.crc32(ids.tobytes()))] * n
    assert ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == ordered(want)
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert len(by) <= -(-sum(r["length"] for r in packed) // packing.CAPACITY) + 1


def test_pipeline_takes_odd_rows(odd, empty, spark):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, TINY)
        docs.count()


def test_pipeline_rejects_row_by_row(odd, odd_rows, spark):
    """A rejected row takes no sound row of its id, or of null id, with it."""
    base = odd_rows[6][1]
    more = [(7, "one two", "en", "a", 7), (8, None, "en", "b", None), (8, "one", "fr", "b", 3), (None, "too short", "en", "b", 9)]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    got = sorted(map(key, (tuple(r) for r in corpus_pipeline.drop_rejected(spark, docs, TINY).collect())))
    verdict = {(r["doc_id"], r["lang"], r["source"], r["digest"]): r["kept"] for r in quality.verdicts(docs).collect()}
    own = [(tuple(r)[:5], tuple(r)[5:]) for r in docs.select("*", *[x.alias(f"own_{k}") for k, x in quality.row_key().items()]).collect()]
    assert got == sorted(key(row) for row, k in own if verdict[k])
    assert got.count(key((None, base, "en", "b", None))) == 1
    assert got.count(key((7, base, "en", "a", len(base)))) == 1 and got.count(key((8, base, "en", "b", len(base)))) == 2
