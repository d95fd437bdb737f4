"""Every operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfound.llm import decontaminate, lm, mixing, pivot_search, quality, repeats, sharding, simhash, toxicity, url_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, label int"      # names that clash with helper columns
SPACE_WORD, ALNUM_WORD = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").encode().lower()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(1, 260))) for _ in range(50)]
    long = " ".join(word() for _ in range(9000))
    texts = base + base[:12] + [t.replace("a", "A", 1) for t in base[:6]] + [t[:-9] + " new end" for t in base[6:16]]
    texts += [base[0] + "\n" + base[1] + " x " + base[0], long, "pre " + long[:700] + " post", "", "   \t\n", None, None, "one", "one two", "same " * 300]
    out = [(i, t, ["en", "de", None][i % 3], "hot" if i % 3 else [f"s{i % 7}", None][i % 2], len(t or ""), "h", "k", 1) for i, t in enumerate(texts)]
    return out + [out[3], out[-1], (None, base[4], None, None, None, None, None, None), (5, "another text for an id that repeats", "en", "hot", 1, "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 6)], i % 3) for i in range(700)] + [(i, [0.1] * 6, 0) for i in range(700, 900)]
    data += [(901, None, 0), (902, [0.1, None, 0.3, 0.1, 0.1, 0.1], 0), (903, [float("nan")] * 6, 0), (904, [float("inf")] + [0.0] * 5, 0), (None, [0.1] * 6, 0), (0, data[0][1], 1), (920, [0.5, 0.5], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(4)
    got = pivot_search.top_k(pivot_search.scaled_vectors(df).withColumn("asks", F.col("vec_id") % 20 == 0), 20, pivots=8, block=64, chunk=8, group=2).collect()
    vec = {i: [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (6 - len(v)) for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in vec:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(vec[q], vec[c])), c) for c in vec if c != q)[:20]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert pivot_search.nearest_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in pivot_search.nearest_vectors(df.filter("vec_id in (20, 21)")).collect()] == [(20, 1, 21, sum(a * b for a, b in zip(vec[20], vec[21])))]


def plain_print(text):
    w = SPACE_WORD.findall(low(text))
    sh = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * count[b] > len(sh))


def test_simhash_prints_and_components(docs, rows, none):
    got = simhash.near_duplicate_digest(docs).collect()
    assert len(got) == len(rows)
    prints = [(r[0], plain_print(r[1])) for r in rows]
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    assert collections.Counter(map(tuple, got)) == collections.Counter((i, f"{f:016x}", least[find(f)]) for i, f in prints)
    assert simhash.near_duplicate_digest(none).count() == 0


def test_close_pairs_finds_every_link(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(150)]
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = list({*seeds, *(flip(f, n) for f in seeds for n in (1, 2, 3, 4, 5)), 0, (1 << 64) - 1, 1, 7, 15})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset(r) for r in simhash.close_pairs(spark.createDataFrame([(p,) for p in signed], "fingerprint long")).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert got == want


def test_keep_one_leaves_one_of_each_group(docs, rows):
    kept = simhash.keep_one(docs, words=3)
    assert kept.columns == docs.columns
    groups = {r["component"] for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() >= len(groups) and kept.groupBy("doc_id", "text").count().filter("count > 1").count() == 0


def test_contamination_equals_brute_force(spark, docs, rows, none):
    words = [ALNUM_WORD.findall(low(r[1])) for r in rows]
    of = lambda i, a, b: b" ".join(words[i][a:b]).decode()
    full = [i for i, w in enumerate(words) if len(w) > 60]
    items = [(10, of(full[0], 5, 30)), (9, of(full[0], 5, 30).upper() + "!"), (11, of(full[1], 0, 10)), (12, "one two"), (13, "one"), (14, ""), (15, None), (16, "zz yy xx ww vv"), (17, of(full[2], 3, 40)), (None, "one"), (None, of(full[3], 2, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(map(tuple, decontaminate.contamination_digest(docs, bench).collect()))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(low(t))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a:a + 10])] |= {str(i)} if i is not None else set()               # an item without id marks words but has no name
    want = collections.Counter()
    for r, w in zip(rows, words):
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        want[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want and sum(k[5] for k in want) > 5
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])
    assert decontaminate.contamination_digest(none, bench).count() == 0
    assert decontaminate.contamination_digest(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_url_verdicts_follow_the_dates(spark):
    day = lambda n: f"2024-03-{n:02d}"
    entries = [("a", "bad.example.com", "block", "add", day(5)), ("a", "bad.example.com", "block", "add", day(7)), ("a", "bad.example.com", "block", "remove", day(10)), ("a", "bad.example.com", "block", "add", day(20)),
               ("b", "bad.example.com/ok", "allow", "add", day(1)), ("b", "example.com", "block", "add", day(15)), ("b", "example.com", "block", "remove", day(15)), ("b", None, "block", "add", day(1)), ("b", "x.org", "block", "bogus", day(1))]
    e = spark.createDataFrame(entries, "list string, key string, action string, change string, day string").withColumn("day", F.to_date("day"))
    caps = [(1, "http://BAD.example.com/x", day(4)), (2, "http://bad.example.com:80/x?y", day(5)), (3, "http://bad.example.com/x", day(9)), (4, "http://bad.example.com/x", day(10)), (5, "https://u@bad.example.com/ok/1", day(25)),
            (6, "http://other.example.com", day(14)), (7, "http://other.example.com", day(15)), (8, None, day(15)), (9, "no url", day(15)), (10, "http://x.org/", None), (2, "http://bad.example.com:80/x?y", day(5))]
    c = spark.createDataFrame(caps, "page_id long, url string, day string").withColumn("day", F.to_date("day")).withColumn("key", F.lit("extra"))
    got = url_lists.filter_urls(c, e)
    want = {1: "unlisted", 2: "block", 3: "block", 4: "unlisted", 5: "allow", 6: "unlisted", 7: "block", 8: "unlisted", 9: "unlisted", 10: "unlisted"}
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == sorted((i, want[i]) for i, _, _ in caps)
    spans = {(r["key"], str(r["valid_from"]), str(r["valid_to"])) for r in url_lists.validity_intervals(e).collect()}
    assert ("bad.example.com", day(5), day(10)) in spans and ("bad.example.com", day(20), "None") in spans
    assert url_lists.filter_urls(c.limit(0), e).count() == 0 and url_lists.filter_urls(c, e.limit(0)).filter("verdict <> 'unlisted'").count() == 0


def test_lm_base_scores_and_full_text_state(spark, docs, rows, none):
    got = lm.language_model_scores(docs, known=40).collect()
    toks = lambda t: SPACE_WORD.findall(low(t)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(x for r in rows if not held(r[0]) for x in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] is None, r[0] or 0, held(r[0]), len(toks(r[1])), sum(c[x] > 0 for x in toks(r[1])), n, round(sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in toks(r[1])), 5)) for r in rows)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.language_model_scores(none).count() == 0
    # streams of several texts give each text what it gets alone, step by step
    p = lm.initial(np.arange(lm.SYMBOLS)[::-1])
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, lm.SYMBOLS, s).astype(np.uint16) for s in (1, 300, 7, 64, 129, 2)]
    for t, score in zip(texts, lm.text_scores(p, texts)):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for s in t.astype(np.int64):
            total += lm.log_likelihood(p, h, np.array([s]))[0][0]
            h = lm.step(p, h, np.array([s]))
        assert abs(total / np.log(10) - score) < 1e-2


def test_lm_probabilities_sum_to_one_and_gradients_hold():
    p = [x.astype(np.float64) for x in lm.initial(np.ones(lm.SYMBOLS))]
    h = np.random.default_rng(2).normal(0, 0.5, (1, lm.HIDDEN))
    every = np.arange(lm.SYMBOLS)
    logs, _ = lm.log_likelihood(p, np.repeat(h, lm.SYMBOLS, axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-3
    symbols = np.array([3, 700, 1050, 3])
    states = np.random.default_rng(3).normal(0, 0.5, (4, lm.HIDDEN))
    grads = [np.zeros_like(x) for x in p]
    _, back = lm.log_likelihood(p, states, symbols, grads)
    loss = lambda: -lm.log_likelihood(p, states, symbols)[0].mean()
    for a, g in ((p[2], grads[2]), (p[4], grads[4]), (states, back)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        a[i] += 1e-4
        up = loss()
        a[i] -= 2e-4
        down = loss()
        a[i] += 1e-4
        assert abs((up - down) / 2e-4 - g[i]) < 2e-3


def test_lm_learns_what_follows():
    rng = np.random.default_rng(4)
    texts = [np.concatenate([np.tile([5, 40, 90], 20), [0]]).astype(np.uint16) for _ in range(300)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.SYMBOLS)
    p = lm.initial(counts)
    before = lm.text_scores(p, texts[:3]).sum()
    t = lm.Trainer(p)
    for _ in range(12):
        t.learn(np.concatenate(texts).astype(np.int64), np.arange(0, 300 * 61, 61))
    assert lm.text_scores(t.p, texts[:3]).sum() > before * 0.7
    del rng


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(700):
        text = [word() for _ in range(rng.randint(20, 120))]
        bad, rude = i % 5 == 0, i % 4 == 0
        if rude:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vilek", "grobnat"]) + rng.choice(["", "as", "um", "eth"]))
        if bad:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(not bad), int(rude)))
    labels += [(3, None, None), (99999, 1, 1), (None, 0, 0), (7, 5, 5)]
    rows += [(800, None, None, None, None), (801, "", None, None, None), (802, "  ", None, None, None), (3, "repeated id", "en", "s", 0), (None, "no id", None, None, None)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, cols).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


@pytest.mark.parametrize("score, target, modulo", [(quality.quality_scores, "quality", 4), (toxicity.toxicity_scores, "toxic", 5)])
def test_classifiers_on_held_out_rows(labelled, score, target, modulo):
    docs, labels, n = labelled
    got = score(docs, labels).collect()
    assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.7 if target == "quality" else 0.5)) for r in got)
    truth = {r["doc_id"]: r[target] for r in labels.filter(f"{target} in (0, 1)").collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] not in (3, None)]
    rest = 2 if target == "quality" else 0
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % modulo == rest for r in held)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in held) >= 0.95 * len(held)
    assert score(docs.limit(0), labels).count() == 0
    assert score(docs, labels.limit(0)).count() == n


def test_low_quality_documents_go(labelled):
    docs, labels, n = labelled
    kept = quality.drop_low_quality(docs, labels)
    ids = [r["doc_id"] for r in kept.filter("doc_id < 700").collect()]
    assert kept.columns == docs.columns and sum(i % 5 == 0 for i in ids) < 10 and sum(i % 5 != 0 for i in ids) > 540


def test_hilbert_neighbours_are_one_step_apart(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = spark.range(1 << dims * bits)
        axes = [F.call_function("shiftright", F.col("id"), F.lit(i * bits)).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{i}") for i in range(dims)]
        rows = grid.select(*axes).withColumn("c", sharding.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("c").collect()
        assert [r["c"] for r in rows] == list(range(1 << dims * bits))
        assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(docs, rows, none, tmp_path):
    got = sharding.shard_documents(docs, shards=7).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["curve"]))
    assert set(by) == set(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    line = []
    for s in sorted(by):
        assert [x for x, _ in sorted(by[s])] == list(range(len(by[s])))
        line += [c for _, c in sorted(by[s])]
    assert line == sorted(line) and sharding.shard_documents(none).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(rows)


@pytest.mark.parametrize("batches", [1, 5])
def test_levels_find_every_repeat(batches):
    rng = np.random.default_rng(6)
    key = rng.integers(0, 400, 900)
    cols = (key, (key % 7).astype(np.int32), np.arange(900), np.arange(900) * 2, np.arange(900, dtype=np.int32), rng.random(900) < 0.8)
    family, found = repeats.Levels(), []
    for part in np.array_split(np.arange(900), batches):
        found += family.add(*(c[part] for c in cols))[0].tolist()
    count = collections.Counter(key.tolist())
    assert sorted(found) == [i for i in range(900) if cols[5][i] and count[int(key[i])] > 1] and len(family.levels) <= 10


@pytest.mark.parametrize("length, gram", [(40, 16), (400, 128)])
def test_repeats_equal_brute_force(docs, rows, none, length, gram):
    count = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    want = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(r[0], len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    found = repeats.without_repeats(docs, length, gram)
    got = found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k")).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert repeats.repeats_digest(none).count() == 0


def test_mixing_meets_its_targets(docs, rows, none):
    sizes = [len(SPACE_WORD.findall(low(r[1]))) for r in rows]
    total = collections.Counter()
    for r, s in zip(rows, sizes):
        total[r[3]] += s
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(sizes)
    while left:                                             # reshare the excess until none is above
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        left -= over
    got = mixing.mix_digest(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, s) for r, s in zip(rows, sizes))
    goals = {r["source_size"]: r["target"] for r in got}
    for s in order:
        assert abs(goals[total[s]] - target[s]) < 1e-6 * max(1, target[s])
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_digest(docs.repartition(3)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_digest(none).count() == 0 and mixing.mix_sources(none).count() == 0
