"""Packing, lexical search and spelling groups against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfound.llm import lexical, packing, spelling, terms

DOCS = "doc_id long, text string, lang string, _row string, _item long, score string, n long, word string, ids string, rank int, shard int"
rest = ("x", "r", 3, "s", 1, "w", "i", 9, 2)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, *rest) for i, t in rows], DOCS).repartition(parts)


# --- packing
@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghéßÀ'.<|1-") for _ in range(rng.randint(1, 9)))
    out = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(25)]
    out += ["", " \t\n", None, "It's THE end.\r\nnext\x0bline \x85 x", "<|endoftext|> and <|ENDOFTEXT|>a<|startoftext|>", "éa Å 가 Σσ İ", "long " * 9000, "z" * 5000]
    rows = list(enumerate(out))
    return rows + [rows[3], rows[3], (None, out[1]), (4, "an id that repeats")]


def test_pieces_are_the_tokens_of_the_whole_text(spark, texts):
    tokenizer = packing.Encoder(packing.default_tokenizer()).whole
    whole = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    got = packing.packing_digest(table(spark, texts)).collect()
    want = collections.Counter()
    for i, t in texts:
        ids, at = whole(t), 0
        n = ids.size
        while at < n:                                       # the largest power of two that still fits, 2048 at most
            size = min(2048, 1 << (n - at).bit_length() - 1)
            want[(i, at, size, zlib.crc32(ids[at:at + size].tobytes()), n)] += 1
            at += size
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and {r["offset"] for r in got} == {0}
    by = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert by == sorted(by, reverse=True)                   # one run of numbers for each length
    again = packing.packing_digest(table(spark, texts, 7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert packing.packing_digest(table(spark, texts).limit(0)).count() == 0


def test_packed_ids_can_be_read_by_bucket(spark, texts, tmp_path):
    tokenizer = packing.Encoder(packing.default_tokenizer()).whole
    docs = table(spark, [(i, t) for i, t in texts if i is not None][:30])
    packing.write_buckets(packing.pack(docs.dropDuplicates(["doc_id"]), longest=64), str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert all(len(r["ids"]) == r["length"] == r["bucket"] <= 64 for r in rows)
    text = {r["doc_id"]: r["text"] for r in docs.dropDuplicates(["doc_id"]).collect()}
    for i, t in text.items():
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError):
        packing.pieces(docs, longest=100)


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "CUT", 50)
    monkeypatch.setattr(packing, "CACHE", 20)
    rng = random.Random(2)
    encode = packing.Encoder(packing.default_tokenizer())
    marks = "abzAZ'\"!.<|>  \n\t\r\x0b\x1c\x85  éÉßÿŸ×÷ª̸́İΣςΣ29あ﻿\x00'sdl"
    for _ in range(300):
        t = "".join(rng.choice(marks) if rng.random() < 0.95 else rng.choice(["<|endoftext|>", "'LL", "≠"]) for _ in range(rng.randint(0, 200)))
        assert np.frombuffer(encode(t), "<u4").tolist() == encode.whole.encode(t, add_special_tokens=False).ids


# --- lexical search
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
of = lambda t: TERM.findall((t or "").encode().lower())


def plain_search(docs, items, top):
    held = [(i, collections.Counter(of(t)), len(of(t))) for i, t in docs if of(t)]
    many, length = len(held), sum(n for _, _, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    out = collections.Counter()
    for q, t in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * many // length
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m)) for w in of(t) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(scores)[:top]):
            out[(q, r + 1, None if none else i, -s)] += 1
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "Z9", "x", "yy"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(120)]
    docs += [(200 + i, "same text here a b") for i in range(60)] + [(7, docs[7][1]), (8, "another text of id eight a"), (None, docs[9][1]), (300, None), (301, ""), (302, "?! .")]
    docs += [(400, "Ab-ab_ab " * 800)]
    items = [(1, "a b c a a"), (2, "same HERE text"), (3, docs[9][1]), (4, None), (5, "..."), (6, "zzz unknown"), (2, "ab dé"), (None, "hyy a"), (9, "same " * 60 + "gé")]
    return docs, items


@pytest.mark.parametrize("entries, tiles", [(1 << 17, (2048, 256, 2048)), (6, (16, 2, 3))])
def test_search_equals_all_scores(spark, corpus, monkeypatch, entries, tiles):
    for name, size in zip(("DOCS", "ITEMS", "VOCABULARY"), tiles):
        monkeypatch.setattr(lexical, name, size)
    docs, items = corpus
    asked = spark.createDataFrame([(q, t, "x", 1) for q, t in items], "item_id long, text string, doc_id string, _block int")
    got = lexical.ranked_search(table(spark, docs), asked, 20, entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_search(docs, items, 20)


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked_search(table(spark, docs).limit(0), asked).count() == 0
    assert lexical.ranked_search(table(spark, docs), asked.limit(0)).count() == 0


def test_tiles_keep_sums_exact():
    rng = np.random.default_rng(3)
    item, code = rng.integers(0, 300, 4000), rng.integers(0, 500, 4000)
    pairs = sorted(set(zip(item.tolist(), code.tolist())))
    weight = [int(rng.integers(1, 10 ** 9)) for _ in pairs]
    weight[0] = 10 ** 11                                    # alone beyond the bound: stands in parts
    item, code = (np.array(x) for x in zip(*pairs))
    tiles = lexical.weight_tiles(item, code, np.array(weight, object), 300, 10 ** 6)
    assert max(np.bincount(t.column, weights=t.weight).max() for t in tiles) * 10 ** 6 < 2 ** 53
    total = collections.Counter()
    for t in tiles:
        assert t.codes.size <= lexical.VOCABULARY and (np.diff(t.codes) > 0).all()
        for p, c, w in zip(t.place.tolist(), t.column.tolist(), t.weight.tolist()):
            total[(t.items + c, int(t.codes[p]))] += int(w)
    assert total == dict(zip(pairs, weight))
    # a total beyond 2**53 comes out to the last unit
    scores = lexical._tile_scores(np.array([c for i, c in pairs if i == 0]), np.full(sum(i == 0 for i, _ in pairs), 10 ** 7), np.zeros(sum(i == 0 for i, _ in pairs), np.int64), np.array([10]), 1, tiles, 300, 5, 50)
    impact = 10 ** 9 * 10 ** 7 // (1000 * 10 ** 7 + 12 * (75 + 25 * 10 * 5 // 50))
    assert scores[0, 0] == sum(w * impact for (i, _), w in zip(pairs, weight) if i == 0) > 2 ** 53


def test_ties_at_the_border_go_to_the_first_document():
    scores = np.array([[5, 7, 5, 5, 0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]])
    floor = np.zeros(3, np.int64)
    item, doc = lexical._best(scores, 2, floor)
    assert list(zip(item.tolist(), doc.tolist())) == [(0, 1), (0, 0), (2, 0), (2, 1)] and floor.tolist() == [5, 0, 1]


# --- spelling
LATIN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(docs, every=199, least=6, often=5, factor=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count = collections.Counter()
    for i, t in docs:
        for w in LATIN.findall(t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}
    nears = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(nears[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n, len(nears[w]), words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcàÿ×é") for _ in range(rng.randint(6, 9))) for _ in range(40)]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abÀé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:]])
    words = [w for w in base for _ in range(rng.randint(1, 120))]
    words += [v for w in base for v in (slip(w), slip(slip(w))) for _ in range(rng.randint(3, 14))]
    words += ["aaaaaab"] * 700 + ["aaaaab"] * 60 + ["aaaaac"] * 8 + ["Aaaaaaab"] * 5 + ["abcdef"] * 30 + ["abcdeg"] * 30 + ["abcdeh"] * 5
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "-", "1"]).join(words[i::60])) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "12 ... !"), (None, "ABCDEF " * 4), docs[5], docs[5], (5, "abcdeg")]


@pytest.mark.parametrize("shard, every", [(8192, 199), (13, 7)])
def test_groups_equal_brute_force(spark, spelled, shard, every):
    want = plain_groups(spelled, every)
    got = spelling.spelling_groups(table(spark, spelled), every=every, shard=shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert every != 199 or any(f is not None and f != r for _, f, r, *_ in want)        # chains of more than one step occur
    assert spelling.spelling_groups(table(spark, spelled).limit(0)).count() == 0


def test_hot_shard_is_asked_in_parts(spark):
    rng = random.Random(1)
    words = sorted({"abc" + "".join(rng.choice("abcé") for _ in range(rng.randint(3, 5))) for _ in range(500)})      # one beginning holds all
    n = {w: rng.randint(1, 40) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), 60, 25).collect()
    for r in got:
        nears = [v for v in words if near(r["word"], v)]
        assert (r["n_near"], r["near"]) == (len(nears), min(nears, key=lambda v: (-n[v], v), default=None))
    assert len(got) == len(words)


def test_index_intervals_are_ranks_of_suffixes():
    words = ["abab", "bab", "abc", "b", "cab"]
    letters = {c: i + 1 for i, c in enumerate("abc")}
    index = spelling.Index(*spelling._matrix(words, letters), 4)
    for part in ("a", "ab", "aba", "abab", "b", "ba", "c", "ca", "bb", "cc"):
        low, high = np.array([0]), np.array([len(words)])
        for c in part:
            low, high = index.step(np.array([letters[c]]), low, high)
        assert max(0, int(high[0] - low[0])) == sum(w.startswith(part) for w in words)
        on, found = index.whole(low, high) if high[0] > low[0] else ([], [])
        assert [words[i] for i in found] == [w for w in words if w == part]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(terms, "BLOCK", 64)
    rng = random.Random(6)
    rows = ["".join(rng.choice("ab Zé×9.あ\n") for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["", "x" * 900]
    for inside, pattern in ((terms.alphanumeric, TERM), (terms.latin_letters, None)):
        got = collections.Counter()
        for t in terms.term_blocks(pa.array([r.encode() for r in rows], pa.binary()), inside):
            words = t.words.to_pylist()
            got.update((int(r), words[c]) for r, c in zip(t.row, t.code))
        plain = (lambda r: of(r)) if pattern else (lambda r: [w.encode().lower() for w in LATIN.findall(r)])
        assert got == collections.Counter((i, w) for i, r in enumerate(rows) for w in plain(r))
