"""The corpus pipeline against brute force, stage by stage on a small table."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_llm import brute_components, near_copies

import corpus_pipeline
from cadenza.llm import toxicity

tokenizers = pytest.importorskip("tokenizers")


def test_pipeline(spark, tmp_path):
    rng = np.random.RandomState(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, rng.randint(20, 60))) + (" vuxzyq wuxzyqs" if i % 3 == 0 else "") for i in range(90)]
    texts += [texts[1], texts[1].replace(" ", "  "), None, "", " ", "one two", "long " * 20_000]
    texts += near_copies(rng, 12, styles=False, edits=2)
    rows = [(None if i == 4 else i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], (5, "another text of id five", "en", "s1", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen.append((name, before, [tuple(r) for r in docs.collect()]))
    assert [n for n, *_ in seen] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]

    _, before, after = seen[0]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = toxicity.toxicity_scores(spark.createDataFrame(before, schema), labels).collect()
    assert sorted(map(str, after)) == sorted(str(tuple(r)[:-1]) for r in scored if r._score < 0.7)
    assert len(after) < len(before)

    _, before, after = seen[1]
    folded = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best = {}
    for r in before:
        key = (r[0] is None, r[0] or 0, str(r))
        if folded(r[1]) not in best or key[:2] < best[folded(r[1])][0][:2]:
            best[folded(r[1])] = (key, r)
    assert sorted((r[0] is None, r[0] or 0, folded(r[1])) for r in after) == sorted((r[0] is None, r[0] or 0, folded(r[1])) for _, r in best.values())

    _, before, after = seen[2]
    least, sizes = brute_components([(r[0], r[1]) for r in before], 5, 80, 100)
    groups = {(c, i if r[0] is None or n == 0 else None) for i, (r, c, n) in enumerate(zip(before, least, sizes, strict=True))}
    # five has two texts, in two components, both of which start with it
    twice = len({c for c in least if c is not None}) - len(set(least) - {None})
    assert len(after) == len(groups) + twice + sum(r[0] == 5 for r in after) - 1 and set(after) <= set(before)
    assert len(after) < len(before)

    _, before, after = seen[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert set(after) <= set(before) and all(after.count(r) <= 2 * before.count(r) for r in before)
    sources = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
    caps = {s: 2.0 * sum(size(r) for r in before if r[3] == s) for s in sources}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, 1.5 * sum(map(size, before))
    while True:
        full = {s for s in open_ if left * weights[s] / sum(weights[o] for o in open_) > caps[s]}
        if not full:
            break
        for s in full:
            target[s] = caps[s]
        left, open_ = left - sum(caps[s] for s in full), open_ - full
    target |= {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
    for s in sources:
        taken = sum(size(r) for r in after if r[3] == s)
        assert -1 <= taken - target[s] <= max(size(r) for r in before if r[3] == s)

    _, before, after = seen[4]
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if r[0] is None else r[0], zlib.crc32(np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in before)
    names = docs.columns
    pieces = [dict(zip(names, r, strict=True)) for r in after]
    assert sum(p["start"] == 0 for p in pieces) == len(want)
    whole = [(-1 if p["doc_id"] is None else p["doc_id"], p["ids_crc32"]) for p in pieces if p["length"] == p["doc_tokens"]]
    assert len(whole) > 0.5 * len(want) and not set(whole) - set(want)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(filled.values()) <= 2048
