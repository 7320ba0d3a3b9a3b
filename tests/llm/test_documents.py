"""Quality, language, near duplicates, substring dedup, media and the pipeline against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidekeep.llm import components, language, media, ngram_join, quality, shared, substring_dedup
from tidekeep.llm.textbatch import blocks

from .helpers import base_counts, corpus, frame, kept_words, near_duplicate_components, out_of_place, words


def labels(spark, rows):
    ids = sorted({r[0] for r in rows if r[0] < 1000})
    return spark.createDataFrame([(i, 1 if k % 3 else 0, 0) for k, i in enumerate(ids) if k % 2], "doc_id long, quality int, toxic int")


def four_grams(text):
    data = (text or "").encode()
    return [data[i : i + 4] for i in range(len(data) - 3)]


def bucket(gram):
    code = int.from_bytes(gram, "little")
    mixed = ((code * 0x9E3779B1) & 0xFFFFFFFF) ^ (code >> 15)
    return ((mixed * 0x85EBCA77) & 0xFFFFFFFF) >> 18


def test_quality_against_brute_force(spark):
    rows = corpus()
    docs, known = frame(spark, rows), labels(spark, rows)
    model = quality.fit(docs, known)
    good = {r.doc_id for r in known.where("quality = 1").collect()}
    target, raw = Counter(), Counter()
    for r in rows:
        some = Counter(map(bucket, four_grams(r[1])))
        raw += some
        if r[0] in good:
            target += some
    t, q, n = sum(target.values()), sum(raw.values()), quality.BUCKETS
    ratio = [round((math.log((target[b] + 1) / (t + n)) - math.log((raw[b] + 1) / (q + n))) * quality.SCALE) for b in range(n)]
    assert model.ratios.tolist() == ratio
    score = lambda text: sum(ratio[bucket(g)] for g in four_grams(text)) / (max(len(four_grams(text)), 1) * quality.SCALE)
    trusted = sorted(score(r[1]) for r in rows if r[0] in good and r[1])
    low, mid = np.quantile(trusted, [quality.LOW_SHARE, 0.5])
    assert model.threshold == pytest.approx(low - (mid - low), abs=1e-9)
    got = quality.judge(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], r[1])
    for r in got:
        base = base_counts(by_id[r.doc_id])
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == base and r.base_failed == failed
        assert r.kept == (not failed and score(by_id[r.doc_id]) >= model.threshold)
    kept = quality.keep_good(docs.withColumn("extra", docs.doc_id + 1), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept) and kept.columns[-1] == "extra"


def test_quality_without_labels_or_documents(spark):
    rows = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, rows), none)
    assert all(r.kept != r.base_failed for r in quality.judge(frame(spark, rows), model).collect())
    empty = quality.fit(frame(spark, []), none)
    assert quality.judge(frame(spark, []), empty).count() == 0


def test_quality_trusts_all_labelled_documents(spark):
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('some words of ', id) AS text")
    model = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    assert not model.ratios.any()  # as many trusted documents as there are: both multinomials are one


def shuffled(spark):
    """Bytes written to shuffles since the session began."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    every = context.statusStore().executorList(False)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_quality_deals_out_no_trusted_texts(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, rng.randbytes(10_000).hex()) for k in range(200)], "doc_id long, text string").repartition(3).cache()
    known = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality")
    assert docs.count() == 200
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than are broadcast
    try:
        before = shuffled(spark)
        quality.fit(docs, known)
        assert shuffled(spark) - before < 1_000_000  # the trusted texts have 2 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        docs.unpersist()


def test_quality_is_exact_whatever_the_filter_lets_pass(spark, monkeypatch):
    rows = corpus(60)
    odd = (None, "a text without an id, of more than ten words, which nobody can trust", "aa", None, 0)
    docs, known = frame(spark, [*rows, odd]), labels(spark, rows)
    want = quality.fit(docs, known)
    monkeypatch.setattr(shared, "MOST_WORDS", 1)  # one word for all ids
    ids = docs.select("doc_id").distinct()
    held = shared.passing(ids, shared.key_code("doc_id"), shared.key_filter(known.where("quality = 1").select(shared.key_code("doc_id"))))
    assert known.where("quality = 1").count() + 5 < held.count() <= ids.count() - 1
    got = quality.fit(docs, known)
    assert got.ratios.tolist() == want.ratios.tolist() and got.ratios.any() and got.threshold == want.threshold


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), -rng.exponential(size=500) * 1e-9, np.zeros(40), [-1e300, 1e300], np.full(100, 0.25)])
    scores = spark.createDataFrame([(float(x),) for x in values], "score double").repartition(3)
    places = [0, 1, 500, len(values) // 2, len(values) - 1]
    assert quality.at_places(scores, places) == np.sort(values)[places].tolist()
    shares = [0.001, 0.3, 0.5, 1.0]
    assert quality.quantiles(scores, shares) == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    assert quality.quantiles(scores.where("score > 1e301"), shares) is None


def test_language(spark):
    rows = corpus(300, seed=4)
    docs = frame(spark, rows)
    found = language.fit(docs)
    assert found.languages == ["aa", "bb", "cc"] and all((found.ranks[:, k] < language.DEPTH).sum() <= language.DEPTH for k in range(3))
    fold = lambda ch: None if language._folded()[ord(ch)] == 32 else chr(language._folded()[ord(ch)])
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    learned = {name: Counter() for name in found.languages}
    for r in rows:
        if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            learned[r[2]] += out_of_place(r[1], None, fold)
    profiles = {n: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[: language.DEPTH])} for n, c in learned.items()}
    hits = total = 0
    for r in sorted(set(rows), key=str):
        grams = out_of_place(r[1], None, fold)
        (block,) = blocks(pa.array([r[1]], pa.string()))
        name, score = language.predict_block(block, found)[0]
        if not grams:
            assert (name, score) == ("und", 0.0)
            continue
        own = sorted(grams, key=lambda g: (-grams[g], code(g)))[: language.DEPTH]
        far = {n: sum(abs(p[g] - k) if g in p else language.DEPTH for k, g in enumerate(own)) for n, p in profiles.items()}
        best = min(far, key=lambda n: (far[n], n))
        assert name == best and score == pytest.approx(1 - far[best] / (language.DEPTH * len(own)))
        if r[2] and len(words(r[1])) >= 12 and "\n" not in r[1] and zlib.crc32(str(r[0]).encode()) % 4 == 2:
            hits, total = hits + (name == r[2]), total + 1
    assert total > 20 and hits / total > 0.9
    out = language.identify(docs, found).collect()
    assert len(out) == len(rows)
    held = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    assert all(r.text is not None for r in language.keep_known(docs, found, 0.1).collect())
    own = [x for r in out for x in [(r.doc_id, r.lang_pred, r.score)]]
    label = Counter((r[0], r[2]) for r in rows)
    bins = sorted(int(score * language.BINS) for i, name, score in own if (i, name) in label)
    assert language.least_score(docs, found) == language.MARGIN * bins[max(0, math.ceil(len(bins) * language.LOW_SHARE) - 1)] / language.BINS
    assert language.least_score(frame(spark, []), found) == 0.0
    nothing = language.fit(frame(spark, []))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_unlearned_languages_go_and_clean_documents_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("size(split(text, ' ')) >= 30").select("doc_id", "text", "lang")
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ]
    docs = table.unionByName(spark.createDataFrame([(10**6 + k, s, None) for k, s in enumerate(strange)], "doc_id long, text string, lang string"))
    found = language.fit(docs)
    least = language.least_score(docs, found)
    kept = {r.doc_id for r in language.keep_known(docs, found, least).select("doc_id").collect()}
    assert {r.doc_id for r in table.where("lang is not null").select("doc_id").collect()} <= kept
    assert not {10**6, 10**6 + 1} & kept


def test_near_duplicates_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(200, seed)
        want = near_duplicate_components(rows)
        got = ngram_join.near_duplicates(frame(spark, rows)).collect()
        assert len(got) == len(rows) and {(r.doc_id, (r.n_shingles, r.component_id)) for r in got} == set(want.items())
    kept = ngram_join.keep_one(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i} and kept.columns == frame(spark, rows).columns
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_index_entries_are_dealt_in_little_space(spark):
    """An entry is dealt as 16 bytes, one of copies in a task; what comes back are the keys that different sets have."""
    rng = random.Random(5)
    made = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    made += made[:20] + [x + " more" for x in made[:20]] + ["one two", None, ""]
    docs = frame(spark, [(k, text, "aa", "s", 0) for k, text in enumerate(made)]).coalesce(1)
    (block,) = blocks(pa.array(made, pa.string()))
    tokens, bounds = ngram_join.token_sets(block)
    sets = {tuple(tokens[bounds[k] : bounds[k + 1]].tolist()) for k in range(block.count) if bounds[k + 1] - bounds[k] > 1}
    keys = [ngram_join.prefix_keys(np.array(x, np.uint64), np.zeros(len(x), bool))[0] for x in sets]
    indexed = ngram_join._indexed(docs, np.zeros(0, np.uint64), 7)
    sent = indexed.collect()
    assert len(sent) == 7 and sum(len(r["keys"]) + len(r["sets"]) for r in sent) == 16 * sum(map(len, keys))
    assert sum(len(r["facts"]) for r in sent) == 8 * ngram_join.FACTS * len(sets)
    often = Counter(int(k) | 1 for own in keys for k in own)
    met = ngram_join._met(indexed).collect()
    got = Counter(r["key"] % (1 << 64) for r in met if r["key"] is not None)
    assert got == {k: n for k, n in often.items() if n > 1} and len(got) > 500
    assert sorted(r["n"] for r in met if r["key"] is None) == sorted(map(len, sets))


def test_near_duplicates_of_repeated_rows(spark, monkeypatch):
    # chains in which only neighbours link (85 of 109 tokens), too long for the pivots; all tokens rare
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    rng = random.Random(5)
    rows = []
    for chain in range(6):
        line = [f"w{rng.randrange(10**9)}" for _ in range(101 + 12 * 79)]
        rows += [(chain * 1000 + k, " ".join(line[12 * k : 12 * k + 101]), "aa", "s", 0) for k in range(80)]
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(frame(spark, rows + rows)).collect()
    assert len(got) == 2 * len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(r[0], r[0] // 1000 * 1000) for r in rows}


def _part(rng, n, keys, hot):
    rows = []
    for k in range(n):
        own = sorted({*([7] if hot else []), *rng.sample(range(100, 100 + keys), rng.randint(1, 6))})
        size = rng.randint(4, 12)
        rows.append({"a": k * 2 + (n % 2), "c": rng.randrange(5), "n": size, "pure": rng.random() < 0.5, "rest": rng.randint(0, 6), "s": len(own) + rng.randint(0, 3), "keys": [{"key": x, "w": x % 3} for x in own]})
    return rows


@pytest.mark.parametrize("tile,held", [(64, 10), (1 << 21, 1 << 20)])
def test_parts_of_a_home_meet_like_all_pairs(tile, held, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "HELD", held)
    rng = random.Random(3)
    for hot in (False, True):
        left, right = _part(rng, 40, 30, hot), _part(rng, 31, 30, hot)
        x, y = (ngram_join.Part(pa.Table.from_pylist(rows)) for rows in (left, right))
        for other, rows in ((None, left), (y, right)):
            got = sorted(z for a, b, w in ngram_join.part_pairs(x, other) for z in zip(a.tolist(), b.tolist(), w.tolist(), strict=True))
            want = []
            for p in left:
                for q in rows:
                    mine, its = ({k["key"]: k["w"] for k in r["keys"]} for r in (p, q))
                    both = set(mine) & set(its)
                    w = sum(mine[k] for k in both)
                    beyond = max(p["rest"], q["rest"]) if p["pure"] and q["pure"] else p["rest"] if p["pure"] else q["rest"] if q["pure"] else min(p["rest"], q["rest"])
                    elsewhere = min(r["s"] - sum(k["w"] for k in r["keys"]) for r in (p, q))
                    if both and p["c"] != q["c"] and (other or p["a"] < q["a"]) and 100 * min(p["n"], q["n"]) >= 75 * max(p["n"], q["n"]) and 175 * (w + elsewhere + beyond) >= 75 * (p["n"] + q["n"]):
                        want.append((min(p["a"], q["a"]), max(p["a"], q["a"]), w))
            assert got == sorted(want) and want


def test_a_key_of_very_many_documents_stays_in_tiles():
    n = 100_000
    table = pa.table({"a": np.arange(n), "c": np.arange(n) // (n - 3), "n": np.full(n, 10), "pure": np.ones(n, bool), "rest": np.full(n, 9), "s": np.ones(n, int)})
    lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.StructArray.from_arrays([pa.array(np.full(n, 5)), pa.array(np.ones(n, int))], ["key", "w"]))
    part = ngram_join.Part(table.append_column("keys", lists).slice(n - 2000))
    found = [x for x in ngram_join.part_pairs(part, None)]
    assert sum(len(a) for a, _, _ in found) == 3 * 1997  # pairs of different components


def test_prefix_keys_lose_no_link():
    rng = np.random.RandomState(0)
    links = 0
    for trial in range(1500):
        n = int(rng.choice([2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 30, 60, 120, 300]))
        x = np.unique(rng.randint(1, 2**62, n, dtype=np.uint64))
        y = x.copy()
        y[rng.permutation(len(y))[: rng.randint(0, len(y) // 4 + 1)]] = 0
        y = np.unique(np.where(y == 0, rng.randint(1, 2**62, len(y), dtype=np.uint64), y))
        y = y[: max(2, int(len(y) * rng.uniform(0.7, 1)))]
        often = np.concatenate([x, y])[rng.rand(len(x) + len(y)) < rng.choice([0, 0.1, 0.5, 0.9, 1])]
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            links += 1
            (sx, kx, px), (sy, ky, py) = (ngram_join.prefix_keys(z, np.isin(z, often)) for z in (x, y))
            shared = len(np.intersect1d(sx, sy))
            assert shared or len(np.intersect1d(kx, ky)), (trial, len(x), len(y), both)
            rx, ry = (len(z) - len(s) if pure else int(np.isin(z, often).sum()) for z, s, pure in ((x, sx, px), (y, sy, py)))
            rest = max(rx, ry) if px and py else rx if px else ry if py else min(rx, ry)
            assert both <= shared + rest
    assert links > 300


def test_components(spark):
    rng = np.random.RandomState(1)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 120, (90, 2))] + [(k, k + 1) for k in range(500, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in {x for e in edges if e[0] != e[1] for x in e}}


@pytest.mark.parametrize("limit,least_hot,size", [(3, None, 2_000), (2_000, 3, 3_000), (2_000_000, 2, 300), (2_000_000, None, 2_000_000)])
def test_substring_dedup(spark, limit, least_hot, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", size)
    monkeypatch.setattr(substring_dedup, "BLOCK", size)
    rows = corpus(200, seed=3)
    want = kept_words(rows)
    got = {}
    for r in substring_dedup.repeats(frame(spark, rows), limit=limit, least_hot=least_hot).collect():
        got.setdefault(r.doc, set()).update(range(r.first, r.last))
    assert got == {i: {k for k, g in enumerate(gone) if g} for (i, _), (_, gone) in want.items() if any(gone)} and got
    if size == 2_000_000:
        out = substring_dedup.removal_digests(frame(spark, rows)).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(
            (r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()) for r in rows for w, gone in [want[r[0], r[1]]]
        )
        texts = substring_dedup.remove_repeats(frame(spark, rows)).collect()
        for r in texts:
            (w, gone), old = next((want[x[0], x[1]], x[1]) for x in rows if x[0] == r.doc_id)
            assert r.text == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else old)
        assert substring_dedup.removal_digests(frame(spark, [])).count() == 0
        clash = frame(spark, rows).select("*", F.lit(1).alias("doc"), F.lit("x").alias("row"), F.lit(2.0).alias("spans"), F.lit(3).alias("a b"))
        more = substring_dedup.remove_repeats(clash)
        assert more.columns == clash.columns and sorted((r.doc_id, r.text or "", r.row) for r in more.collect()) == sorted((r.doc_id, r.text or "", "x") for r in texts)


def test_media(spark):
    rows = corpus(30)
    got = {r.doc_id: r for r in media.media_digests(frame(spark, rows)).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        g = got[r[0]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.write_wav(payload)
        assert media.read_wav(stored) == (media.RATE, payload) and g.media_bytes == len(stored) and g.media_sha256 == hashlib.sha256(stored).hexdigest()
    same = {}
    for r in rows:
        same.setdefault(r[1] or "", set()).add(got[r[0]].feature)
    assert all(len(v) == 1 for v in same.values())
    whole = media.media_columns(frame(spark, rows[:4])).collect()
    table = pa.ipc.open_stream(bytes(whole[0].tensors)).read_all()
    assert table.schema.field("tensor").type.shape == [media.TENSOR_FRAMES, media.MELS] and table.column("start_s")[0].as_py() == 0


def test_resampling_and_log_mel_by_definition():
    rng = np.random.RandomState(4)
    for up, down, n in ((5, 8, 1), (5, 8, 97), (3, 2, 40), (1, 2, 33)):
        x = rng.randn(n).astype(np.float32)
        h = media._phases(up, down, media.TAPS).T.ravel()
        half = media.TAPS * up
        size = -(-n * up // down)
        want = [sum(float(x[i]) * h[i * up - k * down + half] for i in range(n) if 0 <= i * up - k * down + half < len(h)) for k in range(size)]
        assert np.allclose(media.resample(x, up, down), want, atol=1e-4)
    x, rate = rng.randn(777).astype(np.float32), 10_000
    mel, energy = media.log_mel(x, rate)
    count = -(-(len(x) - media.FRAME) // media.HOP) + 1
    padded = np.concatenate([x, np.zeros(media.FRAME + media.HOP)])
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(media.FFT // 2 + 1)) / media.FFT)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / media.FRAME)
    assert mel.shape == (count, media.MELS)
    for k in range(count):
        frame_k = padded[k * media.HOP : k * media.HOP + media.FRAME] * window
        power = np.abs(frame_k @ turn) ** 2
        assert np.allclose(mel[k], np.log(np.maximum(power @ media._filterbank(rate), media.FLOOR)), atol=1e-3)
        assert np.isclose(energy[k], 10 * np.log10((frame_k**2).sum()), atol=1e-3)


def test_audio_features():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    low = media.resample(tone)
    rate = 16000 * media.UP // media.DOWN
    assert len(low) == rate and np.abs(low[100:-100] - np.sin(2 * np.pi * 440 * np.arange(rate) / rate)[100:-100]).max() < 1e-3
    for up, down in ((3, 2), (2, 3), (5, 7)):
        h = media._phases(up, down, 6).T.reshape(-1)
        x = np.random.RandomState(0).randn(50).astype(np.float32)
        z = np.zeros(50 * up)
        z[::up] = x
        want = [sum(h[j] * z[n * down + j - 6 * up] for j in range(len(h)) if 0 <= n * down + j - 6 * up < len(z)) for n in range(-(-50 * up // down))]
        assert np.abs(media.resample(x, up, down, 6) - want).max() < 1e-5
    mel, _ = media.log_mel(low, rate)
    assert mel.shape == (-(-(rate - media.FRAME) // media.HOP) + 1, media.MELS) and mel[50].argmax() == media._filterbank(rate)[round(440 * media.FFT / rate)].argmax()
    energy = np.array([0, 0, 5, 0.5, 0.1, 0, 3, 0.5, 0.5, 0, 0.0])
    assert media.energy_segments(energy).tolist() == [[2, 4], [6, 9]]


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in corpus(200, seed=6)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, rows).write.parquet(str(tmp_path / "labels.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    before = [tuple(r) for r in spark.read.parquet(str(tmp_path / "2")).collect()]
    want = near_duplicate_components([tuple(r) for r in spark.read.parquet(str(tmp_path / "1")).collect()])
    assert {r[0] for r in before} == {i for i, (_, c) in want.items() if c == i}
    kept = kept_words(before)
    assert {r.doc_id: words(r.text) for r in docs.collect()} == {i: [x for x, g in zip(w, gone, strict=True) if not g] for (i, _), (w, gone) in kept.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_substring_dedup_deals_out_only_texts_that_matter(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.randbytes(20).hex() for _ in range(400)) for _ in range(200)]
    texts[7] += " " + texts[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    assert docs.count() == 200
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        removed = {r.doc_id: r.n_removed for r in substring_dedup.removal_digests(docs).collect()}
        assert {k: n for k, n in removed.items() if n} == {7: 400} and len(removed) == 200
        assert shuffled(spark) - before < 1_000_000  # all texts have 3.3 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        docs.unpersist()


def test_substring_dedup_is_exact_whatever_the_filter_lets_pass(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_WORDS", 1)
    rows = [*corpus(120, seed=5), (None, " ".join(f"w{k}" for k in range(80)), "aa", None, 0), (5000, " ".join(f"w{k}" for k in range(90)), "aa", None, 0)]
    want = kept_words(rows[:-2])
    got = substring_dedup.removal_digests(frame(spark, rows)).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id not in (None, 5000)) == sorted((r[0], len(w), sum(gone)) for r in rows[:-2] for w, gone in [want[r[0], r[1]]])
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (None, 5000)} == {(None, 0), (5000, 0)}
