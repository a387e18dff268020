"""The training-data operators against brute force, on small tables with the odd cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from revforge.llm import ann, chat, graph, mixing, neardup, packing, pii, quality, queries, sharding, substrings, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
ODD = [(1, LONG * 3, "en", "a", 1), (2, LONG * 3, "en", "a", 1), (2, LONG * 3, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "", 0),
       (5, "é😀 a@b.de 😀 +1 (301) 555-0346; 4111 1111 1111 1111; 1.2.3.4 " + LONG * 40, "de", "b", 2), (None, "x " * 50, "de", None, 3),
       (7, LONG * 2 + "one two three four five six seven " + LONG, "en", "a", 1), (8, "\x1c a b İ #$% \n\n#$% \nA\nA", "fr", "b", 1)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names the operators use."""
    from pyspark.sql import functions as F
    rows = spark.createDataFrame(ODD, COLUMNS)
    return rows.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "target", "t", "w", "found", "metric", "rows")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[0::2] + [x * 2 - 9 if x > 4 else x * 2 for x in d[1::2]]) % 10 == 0


def base_spans(t):
    pats = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, p in pats:
        for m in re.finditer(p, t):
            g = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(g) <= 19 and luhn(g) \
                    or k == "phone" and 8 <= len(g) <= 15:
                yield f"{k}:{m.start()}:{m.end()}"


def test_personal_data(spark, odd, none):
    for df in (docs_of(spark), odd):
        t = texts(df)
        rows = pii.pii_digest(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = list(base_spans(t[r.doc_id]))
            assert hashlib.sha256(",".join(want).encode()).hexdigest() == r.base_sha256
            assert set(want) <= set(r.spans.split(",")) | {""}
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
    assert pii.pii_digest(none).count() == 0
    got = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert got[3] is None and got[4] == "" and got[5].startswith("é😀 [EMAIL] 😀 [PHONE]; [CARD]; [IP] alpha")
    assert pii.redact(odd).columns == odd.columns


def test_near_duplicates(spark, odd, none):
    df = docs_of(spark)
    t = texts(df)

    def sh(x):
        w = x.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    s = {i: sh(x) for i, x in t.items()}
    cls = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    ids = sorted(t)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            j = len(s[a] & s[b]) / len(s[a] | s[b])
            if j >= 0.9:
                assert cls[a] == cls[b], (a, b, j)
    for a in ids:  # no class without a similar member
        if cls[a] != a:
            assert max(len(s[a] & s[b]) / len(s[a] | s[b]) for b in ids if b != a and cls[b] == cls[a]) > 0.6
    got = {(r.doc_id, r.class_id) for r in neardup.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4)} <= got and neardup.near_duplicates(odd).count() == len(ODD)
    left = neardup.keep_one(odd)
    assert left.columns == odd.columns and left.where("doc_id in (1, 2)").count() == 1
    assert neardup.near_duplicates(none).count() == 0


def test_large_bucket_meets_through_its_hub(spark):
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(1)
    rows = [(0, " ".join(words))]
    for i in range(1, 1500):  # variants of one original, far from each other
        w = list(words)
        for j in rng.choice(200, 4, replace=False):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"y{x}" for x in rng.integers(0, 10**9, 60))) for i in range(1500, 4500)]  # a third are copies
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    copies = got[got.doc_id < 1500]
    assert (copies.class_id == 0).mean() > 0.9 and got.n_links.sum() < 40 * len(rows)
    assert (got[got.doc_id >= 1500].class_id >= 1500).all()


def test_large_buckets_keep_every_class(spark):
    """Pairs of near copies among texts of one template, and two interleaved groups, against brute force."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"z{x}" for x in rng.integers(0, 10**12, n)]

    def edited(w, spots):
        w = list(w)
        for j in spots:
            w[j] = fresh(1)[0]
        return w

    template = fresh(200)
    rows = [template + fresh(32) for _ in range(1000)]  # 0.75 similar to each other
    rows += [rows[i][:212] + fresh(20) for i in range(0, 1000, 20)]  # 50 near copies, 0.84 similar
    first = fresh(150)
    second = edited(first, [20, 50, 80, 110])  # 0.76 similar to the first
    for i in range(300):
        rows += [edited(x, rng.choice(np.arange(120, 150), 1)) for x in (first, second)]
    rows += [fresh(60) for _ in range(1200)]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in rows]
    having = {}
    for i, s in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(i)
    having = {x: np.array(v) for x, v in having.items()}
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, s in enumerate(sets):
        n = np.zeros(len(rows), np.int64)
        for x in s:
            n[having[x]] += 1
        for j in np.flatnonzero(n):
            if j > i and n[j] / (len(s) + len(sets[j]) - n[j]) >= neardup.SIMILARITY:
                a, b = sorted((top(i), top(int(j))))
                root[b] = a
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    wrong = [r.doc_id for r in got if r.class_id != top(r.doc_id)]
    assert not wrong, len(wrong)


def test_weighted_sampling_agrees_with_similarity():
    s = neardup.Sampler(np.ones(1 << neardup.DF_BITS)).ready()
    rng = np.random.default_rng(3)
    agree, want = [], []
    for _ in range(120):
        h = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2))
        tf = rng.integers(1, 6, len(h)).astype(float)
        tf2 = tf.copy()
        tf2[rng.random(len(h)) < 0.3] += 3
        agree.append((s.samples(h, s.weights(h, tf)) == s.samples(h, s.weights(h, tf2))).mean())
        want.append(s.similarity((h, tf), (h, tf2)))
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(800, 16))
    v[100:400] = v[100]  # one very common vector
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (None, [1.0] * 16)]
    got = ann.every_twentieth(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(800), -s))[:20]
        hit += len(set(best) & set(g.vec_id))
        assert len(g) == 20 and np.allclose(g.sort_values("rank").score, sorted(g.score, reverse=True))
    assert got.query_id.nunique() == 40 and hit / 800 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.every_twentieth(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.every_twentieth(few.where("vec_id > 9")).count() == 0


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    for df in (docs_of(spark), odd):
        got = packing.pack(df, with_ids=True).toPandas()
        fill = got.groupby("sequence_id").length.sum()
        assert fill.max() <= 2048
        z = got.sort_values(["sequence_id", "offset"])
        assert (z.groupby("sequence_id").length.cumsum() - z.length == z.offset).all()
        t = texts(df)
        for key, g in got.groupby(got.doc_id.fillna(-1)):
            g = g.drop_duplicates("start").sort_values("start")
            want = tok.encode(t[None if key == -1 else int(key)], add_special_tokens=False).ids + [1]
            assert np.frombuffer(b"".join(map(bytes, g.ids)), "<u4").tolist() == want
            assert [zlib.crc32(bytes(x)) for x in g.ids] == g.ids_crc32.tolist() and (g.doc_tokens == len(want)).all()
    assert fill.sum() > 0 and packing.pack(none).count() == 0


def test_packing_keeps_special_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))  # the plain call
    t = {1: "a <|endoftext|> b", 2: "x<|startoftext|>y <|endoftext|><|endoftext|>.", 3: "A <|ENDOFTEXT|> B", 4: "<| endoftext |>", 5: "a b."}
    got = packing.pack(spark.createDataFrame(list(t.items()), "doc_id long, text string"), with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got} == {i: tok.encode(x, add_special_tokens=False).ids + [1] for i, x in t.items()}


def test_repeats(spark, odd, none):
    for df in (docs_of(spark), odd.where("doc_id is not null")):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.substring_digest(df).collect()}
        seen = set()
        for i, t in sorted(texts(df).items()):
            b = t.encode()
            own = [b[p:p + 50] for p in range(len(b) - 49)]
            gone = bytearray(len(b))
            for p, x in enumerate(own):
                if x in seen:
                    gone[p:p + 50] = b"\1" * 50
            seen.update(own)
            kept = bytes(x for x, g in zip(b, gone) if not g)
            runs = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
            assert got[i] == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert substrings.substring_digest(odd).count() == len(ODD) and substrings.substring_digest(none).count() == 0


def test_quality(spark, odd, none):
    rows = quality.quality(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 20)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows) and quality.keep_good(none).count() == 0
    day = quality.sketch(quality.measured(odd))
    assert quality.merge(day, day).agg({"rows": "sum"}).first()[0] == 2 * len(ODD) * len(quality.TOLERANCE)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|end|>\n & <|assistant|>\n"), (1, 1, "assistant", "&lt; b"), (1, 2, "user", None), (2, 0, "as|>\nx", "q"), (None, 0, None, "z"),
            (3, 0, "assistant", ""), (3, 0, "assistant", "dup"), (3, 1, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
    for c in (1, 2, 3, None):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7].n_turns == 2 and chat.chat_digest(df.limit(0)).count() == 1


def test_toxicity(spark, none):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = list(rng.choice(plain, 40))
        if i % 3 == 0:
            w[5:9] = ["nastyword"] * 2 + ["nastywrd"] * 2
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1001, None), (1002, ""), (None, "nastywordy")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.doc_id < 700)]
    assert ((held.doc_id % 3 == 0).astype(int) == held.predicted).mean() > 0.9
    assert all((zlib.crc32(str(int(i)).encode()) % 4 == 2) == h for i, h in zip(got.doc_id.dropna(), got.held_out[got.doc_id.notna()]))
    assert toxicity.toxicity(none, lab).count() == 0 and toxicity.toxicity(docs, lab.limit(0)).where("score = 0").count() == len(rows)


def test_mixing(spark, odd, none):
    df = docs_of(spark)
    got = mixing.mix(df).toPandas()
    assert len(got) == df.count() and (got.taken <= 2 * got["size"]).all()
    near = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert abs(near.t.sum() - 1.5 * got["size"].sum()) < 1 and (abs(near.k - near.t) <= 0.25 * near.t).all()
    assert mixing.mixed(df).count() == got.copies.sum()
    small = mixing.mix(odd).toPandas()
    assert len(small) == len(ODD) and mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() == small.copies.sum()
    assert mixing.mix(none).count() == 0


def test_sharding(spark, odd, none):
    df = docs_of(spark)
    got = sharding.shard_digest(df).toPandas()
    t = texts(df)
    assert all(r.size == len(t[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) for r in got.itertuples())
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.15 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    _, first = sharding.shard(df)
    grown = sharding.grow(first).join(first.select("virtual_slot", first["shard"].alias("old")), "virtual_slot")
    assert grown.where("shard != old and shard != 8").count() == 0 and grown.where("shard = 8").count() > 0
    again = sharding.rebalance(first, sharding.slot_sizes(sharding.with_slots(df)))
    assert again.count() == first.count() and {r.map_version for r in again.collect()} == {2}
    assert sharding.shard_digest(odd).count() == len(ODD) and sharding.shard_digest(none).count() == 0


def test_pipeline(spark):
    docs = docs_of(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns and out.count() > 0
            docs = out
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
