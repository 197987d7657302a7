"""Periodic runs against a brute-force search, damage and digests included."""

import hashlib
import random
import re
import zlib

from cadenza.llm import queries, runs

SCHEMA = "doc_id long, text string, id int, runs string, collapsed string"


def brute(words, least=6):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while len(words) < rng.randint(0, 60):
                words += [rng.choice("abcd") for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
            docs.append(words)
        for words, found in zip(docs, runs.find_runs(docs), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute(words)
            assert runs.collapsed(words, found) == kept(words, brute(words))


def test_long_texts_of_one_word_and_of_none_repeated():
    assert runs.find_runs([["x"] * 200_000, [f"w{i}" for i in range(50_000)], []])[0].tolist() == [[0, 200_000, 1]]


TEXTS = [None, "", " \t\n", "a b", "ab " * 5, "ab " * 6, "a a a a a a b b b b b b", "x y z " * 4 + "x", "q" + " r s t u v" * 4, "long " * 3_000]


def test_periodic_runs_cases(spark):
    rows = [(i if i % 4 else None, t, 1, "x", "y") for i, t in enumerate(TEXTS)] + [(1, TEXTS[6], 1, "x", "y")]
    got = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = [(d, [tuple(r) for r in brute(split(t))], kept(split(t), brute(split(t)))) for d, t, *_ in rows]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, [tuple(x) for x in r.runs], r.collapsed)) for r in got)
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = [(i, t, 1, None, None) for i, t in enumerate(TEXTS[:-1] + texts)] + [(None, "a " * 9, 1, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for d, text, *_ in rows:
        words = split(text)
        h = 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            looped += 1
        found = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[d]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, found).encode()).hexdigest()
    assert looped > 20
