"""Brute-force comparisons and edge cases: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ann, chat, exact_dedup, mixing, ngram_join, packing, sharding, textkernels, toxicity, url_filter, warc
from cadenza.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, keep_id string, id string, kept int"


def documents(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", "y", "z", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \t ", "a  b", "a b", "A b", "é", BASE, BASE.upper(), BASE + " more", BASE.replace("w3 ", "x "), "long " * 30_000, "one", "one two", "one two", "one\ttwo"]


@pytest.mark.parametrize("digest", [None, lambda c: F.lit("x")])
def test_exact_dedup(spark, digest):
    options = {"digest": digest} if digest else {}
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(spark, TEXTS), capacity=2, **options).collect()}
    folded = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    for i, t in enumerate(folded):
        same = [j for j, u in enumerate(folded) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_directory_splits_and_doubles():
    depth, cells = exact_dedup.split_directory({0: 5, 1: 5, 7: 1}, 6, 3)
    assert depth == 3 and len(cells) == 8 and cells[0] != cells[1] and cells[4] == cells[7]
    assert exact_dedup.split_directory({3: 100}, 6, 3)[0] == 3  # overflow stays whole


def test_ngram_components(spark):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in TEXTS]
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in words]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(documents(spark, TEXTS), k=3, num=90, den=100, block=2).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0


def test_hot_shingle_of_which_only_a_pair_in_one_block_is_left(spark):
    words = [f"w{i}" for i in range(2000)]
    by = sorted((int(s[0]), w) for s, w in zip(textkernels.shingle_sets(pa.array(words), 1), words, strict=True))
    words = [w for h, w in by if h < 1 << 63]  # the first one comes first in signed order as well
    fresh = (words[i : i + 30] for i in range(1, len(words) - 30, 30))
    single = lambda: " ".join([words[0], *next(fresh)])
    near = single()
    blocks = spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("b")).collect()
    for block in (0, 3, 5):
        a, b = [r.id for r in blocks if r.b == block][:2]
        docs = [(a, f"{near} {words[-1]}"), (b, f"{near} {words[-2]}")] + [(1000 + i, single()) for i in range(10)]
        found = ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"), k=1, frequent_least=1000, block=2)
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: min(i, a) if i == b else i for i, _ in docs}
        fresh = (words[i : i + 30] for i in range(31, len(words) - 30, 30))


def brute_components(rows, k, num, den):
    """Component of each row (id, text), every row a document of its own."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and rows[i][0] is not None and rows[j][0] is not None and den * min(len(a), len(b)) >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = d if d is None else min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(rows))], [len(s) for s in sets]


def near_copies(rng, count, words=120, vocabulary=4000, edits=3, styles=True):
    """``count`` texts: a base text, and others, each the base text with a few words replaced; a fifth of them in a style that links with the other rarely."""
    base = [f"v{rng.randint(vocabulary)}" for _ in range(words)]
    other = base[: words * 3 // 4] + [f"v{rng.randint(vocabulary)}" for _ in range(words - words * 3 // 4)]
    texts = [" ".join(base)]
    for i in range(1, count):
        text = list(other if styles and i % 5 == 0 else base)
        for at in rng.choice(words, rng.randint(1, edits + 1), replace=False):
            text[at] = f"e{rng.randint(10**6)}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("block,deals", [(256, 8), (16, 8), (16, 0)])
def test_large_group_of_near_copies(spark, block, deals):
    rng = np.random.RandomState(5)
    texts = near_copies(rng, 300) + [" ".join(f"v{rng.randint(4000)}" for _ in range(80)) for _ in range(60)]
    # a passage that texts share which are no copies of each other
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"v{rng.randint(4000)}" for _ in range(rng.randint(8, 40))) for _ in range(60)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3 + 1, texts, strict=True)]
    want, sizes = brute_components(rows, 5, 80, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), block=block, deals=deals).collect()}
    assert got == {d: (n, c) for (d, _), n, c in zip(rows, sizes, want, strict=True)}
    assert 100 < len(set(want)) < 250  # copies of one style in one component, single texts, and some of the passage


def test_work_for_near_copies_grows_with_their_number(spark, monkeypatch):
    """Members of chunks, counted over all lists and deals: twice the copies, about twice the members."""
    moved = []
    for count in (150, 300):
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        seen = spark.sparkContext.accumulator(0)
        plain = ngram_join._group_rows

        def counted(num, den, plain=plain, seen=seen):
            def run(batches):
                def through():
                    for batch in batches:
                        seen.add(batch.num_rows)
                        yield batch

                yield from plain(num, den)(through())

            return run

        with monkeypatch.context() as m:
            m.setattr(ngram_join, "_group_rows", counted)
            rows = list(enumerate(near_copies(np.random.RandomState(7), count, edits=2, styles=False)))
            assert ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), block=8).count() == count
        moved.append(seen.value)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert moved[1] < 3 * moved[0]


def test_one_of_each_keeps_one_row_of_a_group(spark):
    near = lambda i: BASE.replace(f"w{i} ", "x ")
    rows = [(5, BASE, 1), (3, near(50), 2), (3, near(55), 3), (3, near(50), 2), (3, "other words of no one else", 4), (None, BASE, 5), (8, "", 6), (8, None, 7), (8, near(57), 8), (9, "one two", 9), (9, "ONE\ttwo", 10), (2, "one two", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int")
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    left = sorted(r._gone for r in got.collect())
    assert left in ([2, 4, 5, 6, 7, 11], [3, 4, 5, 6, 7, 11])
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_mixing_meets_targets(spark):
    texts = [" ".join(["w"] * (i % 17)) if i % 11 else None for i in range(300)]
    rows = mixing.mix_sources(documents(spark, texts), bin_rows=10).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken <= 2 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) < 1 for (_, t), v in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert mixing.mix_sources(documents(spark, [])).count() == 0


REPEATS = [(1, "a b", "x"), (1, "a b", "x"), (1, "a  b", "y"), (2, "a b", "x"), (2, "c d e", "x"), (None, "a b", "x"), (None, "n o", "x"), (None, "n o", "x"), (None, "p", None), (3, "p q", "y"), (3, "r s", "y"), (None, None, "x"), (4, "z", "y")]


@pytest.mark.parametrize("most", [0, 10])
def test_one_row_of_each_text_is_kept(spark, most):
    docs = spark.createDataFrame(REPEATS, "doc_id long, text string, source string")
    kept = exact_dedup.kept_documents(docs, broadcast_rows=most)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or -1), " ".join((r.text or "").split())) for r in kept.collect())
    assert got == [(-1, ""), (-1, "n o"), (-1, "p"), (1, "a b"), (2, "c d e"), (3, "p q"), (3, "r s"), (4, "z")]
    assert exact_dedup.kept_documents(docs.limit(0)).count() == 0


def test_mixed_documents_takes_each_row_by_itself(spark):
    rows = [(None if i % 2 else 7, f"t{i}" + " w" * (i % 3), f"s{i % 2}", i) for i in range(60)] + [(i, None, None, i) for i in (90, 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.mixed_documents(docs, bin_rows=10)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[tuple(r)] = times.get(tuple(r), 0) + 1
    assert set(times) <= set(rows) and max(times.values()) <= 2 and times[90, None, None, 90] == times[91, None, None, 91] == 1
    words = lambda source: [(len(r[1].split()), times.get(r, 0)) for r in rows if r[2] == source]
    targets = {source: target for source, target in mixing.mix_sources(docs).join(docs.select("source", F.col("doc_id").alias("d")).distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).select("source", "target").distinct().collect()}
    for source in ("s0", "s1"):
        assert 0 <= sum(n * t for n, t in words(source)) - int(targets[source]) < 3


def test_packing_round_trip(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [*TEXTS, "İ, Σς ² é. <|endoftext|> x\x1cy don't, it's."]
    rows = packing.packed_pieces(documents(spark, texts), path, capacity=64).collect()
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64


def test_shards(spark):
    texts = [None if i % 50 == 0 else "x" * (i * 7 % 301) for i in range(2000)] + ["same"] * 1000
    rows = sharding.kd_shards(documents(spark, texts), 24, slot_rows=50).collect()
    assert len(rows) == len(texts)
    size = np.bincount([r.shard for r in rows], [r["size"] for r in rows], 24)
    assert size.max() / size.mean() < 1.1 and size.min() / size.mean() > 0.9
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.kd_shards(documents(spark, [])).count() == 0


def test_shards_of_few_large_documents_are_even(spark):
    rng = np.random.RandomState(3)
    texts = [f"{i} " + "x" * int(min(30_000, rng.lognormal(7, 1.3))) for i in range(900)]
    rows = sharding.kd_shards(documents(spark, texts), 24).collect()
    size = np.bincount([r.shard for r in rows], [r["size"] for r in rows], 24)
    assert max(map(len, texts)) > size.mean() / 4
    assert size.max() / size.mean() < 1.06 and size.min() / size.mean() > 0.94


def test_warc_round_trip(spark):
    html = [None, "", "x" * 100, "x" * 100, "x" * 99, "x" * 99, "é" * 60, "é" * 60, "a\nb 5\r\n\r\n" * 30]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} é", h, "k") for i, h in enumerate(html)], "page_id long, url string, html string, id string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        first = html.index(h) if len(data) >= 100 else i
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    with pytest.raises(ValueError):
        list(warc.arc_records(warc.arc_file([(1, "u", b"payload")], 2)[:-4]))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_recrawled_page_revisits_by_payload(spark):
    one, two = "x" * 100, "y" * 100
    pages = spark.createDataFrame([(1, "u", one), (2, "u", one), (2, "u", two), (3, "u", two), (None, "u", one)], "page_id long, url string, html string")
    got = {(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    a, b = (hashlib.sha256(t.encode()).hexdigest() for t in (one, two))
    assert got == {(1, a, "response", None), (2, a, "revisit", 1), (2, b, "response", None), (3, b, "revisit", 2), (None, a, "revisit", 1)}


def test_revisits_of_null_and_repeated_ids(spark):
    one, two, three = "x" * 100, "y" * 120, "z" * 100
    rows = [(1, "b", one), (1, "a", one), (1, "a", one), (2, "a", one), (None, "u", one), (None, None, one)]
    rows += [(None, "v", two), (None, "u", two), (None, "u", two), (7, "u", three), (None, "u", "short"), (None, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_digest, r.url, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [(i, u, k, o) for i, d, u, k, o in got if d == digest(one)] == [("1", "a", "response", None), ("1", "a", "revisit", 1), ("1", "b", "revisit", 1), ("2", "a", "revisit", 1), ("None", "u", "revisit", 1), ("None", "urn:none", "revisit", 1)]
    assert [(u, k, o) for _, d, u, k, o in got if d == digest(two)] == [("u", "response", None), ("u", "revisit", None), ("v", "revisit", None)]
    assert [k for _, d, _, k, _ in got if d in (digest(three), digest("short"))] == ["response"] * 3


def test_toxicity_generalises_to_misspellings(spark):
    rng = np.random.RandomState(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 40))
        if i % 4 == 0:
            t[rng.randint(40)] = f"wuxzyq{rng.choice(list('klmnop'))}"
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit_subword_model(pa.array(texts), np.array(labels), epochs=10)
    fresh = pa.array([" ".join(rng.choice(words, 40)) + w for w in [" wuxzyqrs", " "] * 20])
    logit = model.logits(fresh)
    assert (logit[::2].mean() > logit[1::2].mean() + 1) and np.isfinite(model.logits(pa.array([None, ""]))).all()
    docs = documents(spark, TEXTS)
    scored = toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert scored.count() == len(TEXTS) and scored.filter("_score >= 0 and _score <= 1").count() == len(TEXTS)


def test_nearest_is_exact_on_small_tables(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(300, 8).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, [float(v) for v in r], "n") for i, r in enumerate(x)] + [(300, None, "n"), (301, [0.0] * 8, "n"), (302, [float("nan")] * 8, "n")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [found[k + 1][0] for k in range(10)] == want
        assert [found[k + 1][1] for k in range(10)] == pytest.approx([d[i] for i in want])


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([("h.org", "block", 10), ("H.org", "allow", 20), ("a.h.org", "block", 15), ("h.org", None, 5)], "pattern string, action string, at int")
    captures = spark.createDataFrame([(1, "http://h.org/x", 9), (2, "http://h.org/x", 10), (3, "https://b.h.org", 20), (4, "http://a.h.org/", 25), (5, None, 25), (6, "no url", 12)], "page_id int, url string, fetched int")
    for most in (0, 10):
        assert {r.page_id: r.allowed for r in url_filter.decide(captures, entries, broadcast_rows=most).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_url_filter_by_directories_and_whole_urls(spark):
    entries = spark.createDataFrame([("h.org", "allow", 1), ("h.org/a", "allow", 1), ("h.org/A/b", "block", 1), ("https://h.org/a/b/c.html", "allow", 1), ("p.net/x/y/", "block", 1)], "pattern string, action string, at int")
    urls = ["http://h.org/a/b", "http://h.org/a/B/d?q=/a", "http://h.org/a/b/c.html#x", "http://h.org/a/bb", "http://h.org//a/b/", "https://w.p.net/x/y/z", "http://p.net/x", "http://h.org/b/a/b"]
    captures = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id int, url string, fetched int")
    got = {r.page_id: (r.allowed, r.pattern) for r in url_filter.decide(captures, entries).collect()}
    assert got == {0: (False, "h.org/a/b"), 1: (False, "h.org/a/b"), 2: (True, "h.org/a/b/c.html"), 3: (True, "h.org/a"), 4: (False, "h.org/a/b"), 5: (False, "p.net/x/y"), 6: (True, None), 7: (True, "h.org")}


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, chosen string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x"), (2, 0, None, None, "x")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "no!", "x"), (2, 0, None, None, "x"), (3, 0, "assistant", "a", "x")], schema)
    got = {r.pair_id: r for r in chat.preference_pairs(chosen, rejected).collect()}
    assert got[1].n_common == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n"
    s = got[1].rejected_spans[0]
    assert got[1].rejected[s.start : s.end] == "no!<|end|>" and got[2].chosen == got[2].rejected == "" and got[3].n_common == 0
    assert chat.preference_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _keep string, _text string, _gone string, _score double, _row long, _doc string, _mixed int, _times int, _copy int, _sha string, id long, n long, rep long, size long, kept boolean, label string"


def test_stages_take_columns_of_any_name(spark):
    rows = [(i, t, "en", f"s{i % 2}", None, "a", "b", "c", 0.5, i, "d", 1, 2, 3, "e", 7, 8, 9, 10, True, "f") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, CLASHING)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    stages = [lambda d: toxicity.without_toxic(d, labels, threshold=2.0), exact_dedup.kept_documents, ngram_join.one_of_each, lambda d: mixing.mixed_documents(d, bin_rows=4)]
    for stage in stages:
        got = stage(docs)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        assert {tuple(r) for r in got.collect()} <= set(rows)
        assert stage(docs.limit(0)).count() == 0
    assert toxicity.toxicity_scores(docs, labels).columns[-1] == "_score_"
    assert len(stages[0](docs).collect()) == len(rows)


def test_revisits_name_their_original(spark):
    text = "x" * 200
    pages = spark.createDataFrame([(1, "http://h/é?a=1 2", text), (5, "u", text), (5, "u", "y" * 200), (None, "n", text)], "page_id long, url string, html string")
    archives = warc.converted_archives(pages)
    for most in (0, 10):
        again = warc.converted_archives(pages, broadcast_rows=most)
        assert sorted(r[0] for r in warc.read_archives(again).select("record_id").collect()) == sorted(r[0] for r in warc.read_archives(archives).select("record_id").collect())
    records = [(h, b) for r in archives.collect() for h, b in warc.warc_records(bytes(r.content))]
    one = next(h for h, _ in records if h["X-Page-Id"] == "1")
    assert one["WARC-Target-URI"] == "http://h/%C3%A9?a=1%202"
    revisit = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert sorted(h["X-Page-Id"] for h in revisit) == ["", "5"]
    assert (revisit[0]["WARC-Refers-To"], revisit[0]["WARC-Refers-To-Target-URI"], revisit[0]["WARC-Refers-To-Date"]) == (one["WARC-Record-ID"], one["WARC-Target-URI"], one["WARC-Date"])
    with pytest.raises(ValueError):
        list(warc.gzip_members(warc.gzip_member(b"a" * 1000)[:-5]))


def test_warc_of_a_very_long_page(spark):
    rng = np.random.RandomState(3)
    long = bytes(rng.randint(32, 127, 3_000_000).astype(np.uint8)).decode()
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None)}


def brute_tree(items, first, count):
    """Shard of each of ``items`` (number, bytes, tie, values): sorted whole at every node."""
    if count == 1 or not items:
        return {i[0]: first for i in items}
    wide = max(range(len(items[0][3])), key=lambda c: (max(i[3][c] for i in items) - min(i[3][c] for i in items), -c))
    key = lambda i: (i[3][wide] << sharding.TIE_BITS) + i[2]
    goal, below, cut = sum(i[1] for i in items) * (count // 2) / count, 0, None
    for k in sorted({key(i) for i in items}):
        here = sum(i[1] for i in items if key(i) == k)
        if below + here > goal:
            cut = k
            break
        below += here
    left = [i for i in items if cut is None or key(i) < cut]
    right = [i for i in items if cut is not None and key(i) >= cut]
    return brute_tree(left, first, count // 2) | brute_tree(right, first + count // 2, count - count // 2)


def test_tree_is_that_of_whole_sorts(spark):
    rng = np.random.RandomState(2)
    items = [(i, int(rng.randint(1, 100)), int(rng.randint(1 << 36)), (int(rng.randint(1 << 24)), int(rng.randint(3)) << 20)) for i in range(120)]
    items += [(120 + i, 50, 7, (5, 1 << 20)) for i in range(30)]  # alike, so in one shard
    df = spark.createDataFrame([(i, b, t, *v) for i, b, t, v in items], "id long, _bytes long, _tie long, a long, b long")
    tree = sharding.grow(df.select("_bytes", "_tie", "a", "b"), ["a", "b"], 6)
    assert {r.id: r.shard for r in df.select("id", tree.alias("shard")).collect()} == brute_tree(items, 0, 6)


def recall(got, x, queries, top=10):
    hits = 0
    for q in queries:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(got.get(q, ())) & set(np.argsort(d, kind="stable")[:top]))
    return hits / (top * len(queries))


def test_nearest_over_many_blocks(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(2400, 16).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 60 == 0, tables=2, block=64, k=16, beam=48).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(got, x, range(0, 2400, 60)) >= 0.9
    # what the start blocks alone would give: far less, so graph and search do the work
    nodes = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    start = {r.id: [e.other for e in r.near][:10] for r in ann.best_edges(ann.start_graph(nodes, 16, 2, 64, 11), 16).collect()}
    assert recall(start, x, range(0, 2400, 60)) < 0.6


def test_nearest_of_doubles(spark):
    rows = [(i, [1.0 + i * 1e-12, 1e-3]) for i in range(1, 40)] + [(50, [1e300, 1.0]), (51, [1e300, 3.0]), (None, [1.0, 1.0]), (3, [1.0 + 3e-12, 1e-3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, F.col("vec_id") == 50, top=3).collect()]
    assert sorted(got)[0] == (50, 1, 51) and len(got) == 3
    got = {r["rank"]: r.vec_id for r in ann.nearest(table, F.col("vec_id") == 20, top=2).collect()}
    assert set(got.values()) == {19, 21}


def test_scores_are_means_over_subwords():
    """The vectorised score of a text against one that lists its features one by one."""
    from cadenza.llm.textkernels import subword_features, utf8

    rng = np.random.RandomState(6)
    model = toxicity.SubwordModel(rng.randn(1 << 10).astype(np.float32), 0.25, (3, 4))
    texts = ["One two, one", "", "é ab", "x" * 50_000 + " end", None, "a"]
    got = model.logits(pa.array(texts))
    for text, logit in zip(texts, got, strict=True):
        one = pa.array([text])
        weights = [model.weight[b] for _, buckets in subword_features(*utf8(one), (3, 4), 1023) for b in buckets]
        words = re.findall(r"[a-z0-9\x80-\xff]+", (text or "").lower().encode().decode("latin-1"))
        grams = sum(max(0, len(w) + 2 - size + 1) for w in words for size in (3, 4))
        assert len(weights) == grams + len(words)
        assert logit == pytest.approx(0.25 + (np.mean(weights) if weights else 0.0), rel=1e-5)


def test_toxicity_with_null_and_repeated_ids(spark):
    rows = [(1, "bad bad words here"), (1, "good words"), (None, "bad bad words here"), (None, None), (2, ""), (3, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert len({r._score for r in got if r.text == "bad bad words here"}) == 1


def test_operators_with_null_and_repeated_ids(spark):
    import public_tokenizers

    rows = [(r[0], r[1], "en", r[2]) for r in REPEATS] + [(None, "word " * 30_000, "en", "x"), (9, "é" * 70_000, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    folded = [" ".join(re.split(r"[\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    found = exact_dedup.exact_dedup(docs, capacity=2).collect()
    want = []
    for (d, _, _, _), f in zip(rows, folded, strict=True):
        ids = [e for (e, *_), g in zip(rows, folded, strict=True) if g == f]
        keep = min((e for e in ids if e is not None), default=None)
        want.append((d, keep, len(ids), keep is None or d == keep))
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=order) == sorted(want, key=order)
    least, sizes = brute_components([(d, t) for d, t, _, _ in rows], 5, 80, 100)
    got = ngram_join.ngram_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=order) == sorted(((d, n, c) for (d, *_), n, c in zip(rows, sizes, least, strict=True)), key=order)
    mixed = mixing.mix_sources(docs, bin_rows=2).collect()
    assert sorted(r["size"] for r in mixed) == sorted(len((t or "").split()) for _, t, _, _ in rows)
    assert all(r.taken <= 2 * r["size"] for r in mixed)
    shards = sharding.kd_shards(docs, 3).collect()
    assert len(shards) == len(rows) and all(sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards))) for s in range(3))
    pieces = packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=512).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)
    ends = [r for r in pieces if r.start + r.length == r.doc_tokens]
    assert len(ends) == len(rows) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in ends)
