"""Cases that the plain operator tests leave out: planted look-alikes, ids with several texts, ties, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revforge.llm import ann, chat, packing, pii, substrings, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
INNER = ("id", "_id", "toxic", "y", "t", "m", "sum", "base", "part", "head", "start", "stop", "found", "spans", "code", "kind", "train", "n", "vec", "cell", "block",
         "query_id", "rank", "score", "k", "pos", "i", "turns", "examples", "row", "leftover", "length", "offset", "h", "w")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in INNER if c not in df.columns})


def planted_texts():
    rng = random.Random(1)
    filler = "the team met on monday and wrote a short note about the plan for the week".split()

    def around(x):
        a, b = (" ".join(rng.choice(filler) for _ in range(rng.randint(3, 12))) for _ in range(2))
        return f"{a} {x} {b}"

    rows = [around(f"{rng.choice(['call', 'phone', 'see', 'ask'])} +1 301-555-0{rng.randint(100, 999)}") for _ in range(2000)]
    orders = [around(f"order 301-555-0{rng.randint(100, 999)}") for _ in range(60)] + [around(f"item 301 555 0{rng.randint(100, 999)}") for _ in range(60)]
    loose = [around(f"call 212-555-0{rng.randint(100, 999)}") for _ in range(100)] + [around(f"mail ann{i} @ site{i} . org") for i in range(100)]
    at = [around(f"score {i} @ {i + 1} . {i + 2}") for i in range(60)]
    return rows, orders, loose, at


def test_personal_data_adds_loose_spans_and_no_look_alikes(spark):
    base, orders, loose, at = planted_texts()
    texts = base + orders + loose + at
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digest(df).collect()}
    added = {i: r.spans for i, r in got.items() if hashlib.sha256(r.spans.encode()).hexdigest() != r.base_sha256}
    a, b, c = len(base), len(base) + len(orders), len(base) + len(orders) + len(loose)
    assert not [i for i in added if i < b or i >= c]
    assert len([i for i in added if b <= i < c]) > 0.9 * len(loose)
    assert all(r.n_phone == (1 if i < a else 0) for i, r in got.items())
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "[PHONE]" in red[b] and "555" in red[a] and "[EMAIL]" in red[b + 100]


def brute_repeats(rows):
    """Kept bytes of every (doc_id, text), by the starts of every 50-byte string."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - 49):
                s = raw[k:k + 50]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - 49):
                if least[raw[k:k + 50]] < i:
                    gone[k:k + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_ids_with_several_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, phrase = text(30), "a phrase of some forty bytes met very often"
    rows = [(1, text(40)), (1, text(5) + shared + text(9)), (2, shared + text(20)), (1, text(40)), (3, "short"), (3, None), (None, shared), (None, shared + text(9))]
    rows += [(9, shared[20:] + text(4)), (9, text(4) + shared[:90]), (9, text(4) + shared[:90]), (8, rows[1][1])]
    rows += [(100 + i // 3, text(rng.randint(0, 6)) + phrase + text(rng.randint(0, 6))) for i in range(60)]
    got = substrings.substring_digest(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)
    assert next(r for r in got if r.doc_id == 2).n_removed >= len(shared) - 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    good = [f"w{''.join(rng.choice('abcde') for _ in range(5))}" for _ in range(60)]
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for i in range(240):
        ws = [rng.choice(good) for _ in range(rng.randint(5, 160))]
        if i % 3 == 0:
            ws[rng.randrange(len(ws))] = rng.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(3, "another text of this id"), (3, rows[3][1]), (500, None), (501, ""), (None, "stupid"), (502, "idiot " + "calm words here " * 30_000)]
    labels += [(3, 0), (3, 1), (6, 0), (502, 1), (None, 1), (7, None)]
    return rows, labels


def scores(df, labels):
    return sorted([tuple(r) for r in toxicity.toxicity(df, labels).collect()], key=str)


def test_toxicity_does_not_depend_on_layout_or_columns(spark, labelled):
    """Ids with several labels and texts, and clashing columns: one result whatever the partitions."""
    rows, labels = labelled
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    first = scores(df, lab)
    assert len(first) == len(rows)
    for parts in (1, 3, 7):
        assert scores(clash(df.repartition(parts, F.rand(parts))), clash(lab.repartition(parts))) == first


def test_toxicity_scores_by_brute_force(spark, labelled):
    """Every score again from the model: n-gram by n-gram, word by word, window by window."""
    rows, labels = labelled
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    mul, mask = 0x9E3779B97F4A7C15, 2 ** 64 - 1

    def row_numbers(word):
        cps = [ord(c) for c in f"<{word}>"]
        out = []
        for n in toxicity.GRAMS:
            for i in range(len(cps) - n + 1):
                h = 0
                for c in cps[i:i + n]:
                    h = ((h ^ c) * mul) & mask
                    h ^= h >> 29
                out.append(((h * mul) & mask) >> (64 - toxicity.BITS))
        whole = 0
        for k, c in enumerate(cps):
            x = (c * mul) & mask
            whole = (whole + (x ^ (x >> 31)) * (2 * k + 3)) & mask
        out.append((((whole ^ (whole >> 32)) * mul) & mask) >> (64 - toxicity.BITS))
        return out

    def score(text):
        words, best = toxicity.words_in(text or ""), None
        k = max(1, -(-len(words) // toxicity.SPAN))
        for i in range(k):
            own = set(words[i * len(words) // k:(i + 1) * len(words) // k])
            z = sum(float(np.mean([float(model.rows[r]) for r in row_numbers(w)])) for w in own) / max(len(own), toxicity.LEAST)
            best = z if best is None else max(best, z)
        return 1 / (1 + np.exp(-(best + model.bias)))

    got = toxicity.score(df, model).select("doc_id", "score", "predicted", "held_out").collect()
    assert sorted(round(r.score, 6) for r in got) == sorted(round(float(score(t)), 6) for _, t in rows)
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_calibration_meets_the_shares():
    """The fitted slope and offset minimise the weighted log loss."""
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    z = 2 * (y - 0.5) + rng.normal(0, 1, 400)
    a = np.array(toxicity.calibrated(z, y, 0.1))

    def loss(c):
        w = np.where(y > 0, 0.1 / y.sum(), 0.9 / (400 - y.sum())) * 400
        return (w * np.logaddexp(0, np.where(y > 0, -1, 1) * (c[0] * z + c[1]))).sum() + (c[0] - 1) ** 2 / 2

    assert all(loss(a) <= loss(a + d) + 1e-6 for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))


def test_token_ids_equal_the_plain_call():
    """Separators, literals of added tokens in any case, and every kind of letter: the ids of the plain call."""
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    pieces = ["a", "Word", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "..", ".", ",", ", ", " ", "\n", "\t", "\x1c", "\x0b", "é", "É", "ß", "ÿ", "œ", "Ğ", "İ",
              "ı", "字", "😀", "1.5", "é", " ", " ", "naïve.", "x,y", "µ", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["plain words, and. stops " * 50_000]
    got = list(tokens.WordTokenizer().encode(texts))
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1]


def test_clashing_columns_of_the_other_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    convs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(chat.chat_digest(clash(convs))) == rows(chat.chat_digest(convs))
    assert rows(ann.every_twentieth(clash(vectors))) == rows(ann.every_twentieth(vectors))
    plain, odd = (packing.pack(x).select("doc_id", "length", "ids_crc32").collect() for x in (docs, clash(docs)))
    assert sorted(plain) == sorted(odd)


def test_pipeline_on_odd_tables(spark):
    """Nulls, an empty table, repeated rows, a very long text and clashing columns go through every stage."""
    long = " ".join(f"word{i % 977} in sentence {i}" for i in range(60_000))
    good = "The committee met in spring and agreed that the new bridge would be built before the end of the year because many people asked for it. "
    rows = [(i, good + f"Report {i} names {i * 7} towns and {i * 3} rivers near the old road.", "en", "a", 1) for i in range(6)]
    rows += [(7, None, None, None, None), (8, "", "en", "", 0), (9, long, "en", "b", 1), (None, good * 2, "en", None, 1), (0, rows[0][1], "en", "a", 1)]
    df = clash(spark.createDataFrame(rows, DOCS))
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, ""))
            assert docs.columns == table.columns, name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert sum(r.length for r in pieces if r.start == 0 or r.start > 0) == sum(r.length for r in pieces)
        assert bool(pieces) == (table is df)


def test_near_duplicates_weigh_shingles_by_frequency(spark):
    """Counters of other frequencies have other weights, within the bound; similarity is that of brute force."""
    from revforge.llm import neardup

    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n))
    common = "these ten words are the same in many of the texts"
    base = text(60)
    words = base.split()
    rows = [(i, f"{text(40)} {common}" if i % 2 else text(45)) for i in range(200)]
    rows += [(300, base), (301, " ".join(words[:57] + ["x", "y", "z"])), (302, " ".join(words[:30] + text(30).split())), (303, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.select(neardup._word_hashes().alias("w"))
    idf = neardup.inverse_frequencies(hashed, len(rows))
    assert len(set(np.round(idf, 6))) > 2 and idf.min() >= 1.0 and idf.max() <= 1.0 + neardup.DAMP

    sampler = neardup.Sampler(idf)
    parts = [neardup.shingles(np.array(r.w, np.int64).view(np.uint64)) for r in hashed.collect()]
    near = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sampler.similarity(parts[i], parts[j]) >= neardup.SIMILARITY}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert near and all(got[a] == got[b] for a, b in near)
    assert got[301] == got[300] == got[303] == 300 and got[302] == 302
