"""The Merkle manifest, conversation repair and language identification against brute force, on small odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revforge.llm import langid, merkle, queries, repair

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONVS = "conv_id long, turn long, role string, text string"
CLASH = ("k", "pos", "leaf", "row", "part", "src", "size", "root", "block", "code", "rid", "h", "r", "first", "_gpos", "score", "n", "col")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) with whole trees in memory."""
    def leaf(r, low=False):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if low and r["text"] is not None else r["text"]
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, i):
        for nodes in levels[:-1]:
            yield i % fanout, nodes[i - i % fanout:i - i % fanout + fanout]
            i //= fanout

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            runs = [*path(trees[s], i), *path(top, k)]
            node = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for d, run in runs:
                node = sha([*run[:d], node, *run[d + 1:]])
            yield (r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(x for d, run in runs for j, x in enumerate(run) if j != d), node, node == top[-1][0])


ODD_DOCS = ([(i % 50 if i % 7 else None, f"Text {i % 40} É" if i % 11 else None, "en", ["a", "b", None, "", "é", "a", "a"][i % 7], i if i % 5 else None) for i in range(150)]
            + [(7, "AB", "en", "a", 2)] * 5 + [(5, "Z" * 1_300_000, "de", "long", 1), (9, "", None, "one", 0)])


@pytest.mark.parametrize(("fanout", "depth"), [(16, 3), (3, 1), (2, 2)])
def test_manifest_by_brute_force(spark, fanout, depth):
    df = spark.createDataFrame(ODD_DOCS, DOCS)
    got = [tuple(r) for r in merkle.manifest(clash(df), fanout, depth).collect()]
    want = list(plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in ODD_DOCS], fanout))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_manifest_of_table_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got) == sorted(plain_manifest(rows, 16))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    alone = merkle.manifest(spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS), with_proof=True).first()
    assert alone.root == alone.leaf == alone.subroot and alone.proof == [] and alone.proof_sha256 == sha([]) and alone.verified


def test_manifest_proofs_lead_to_the_root(spark):
    """The siblings that ``with_proof`` gives, folded by place, give the root."""
    df = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(60)], DOCS)
    rows = merkle.manifest(df, 4, 1, with_proof=True).orderBy("doc_id").collect()
    for r in rows:
        assert r.proof_sha256 == sha(x for level in r.proof for x in level)
    by_source = [r for r in rows if r.doc_id % 3 == 0]
    for i, r in enumerate(by_source):
        node = r.leaf
        for at, level in zip((i, i // 4, i // 16, 0), r.proof):  # 20 leaves: three levels, then one of sources
            node = sha([*level[:at % 4], node, *level[at % 4:]])
        assert node == r.root


def damaged(rows):
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            yield from [(c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)


def plain_repair(rows):
    """One digest a conversation: shortest path with whole audits kept in every state."""
    convs, turn_to = {}, {"": "u", "s": "u", "u": "a", "a": "u"}
    keeps = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    names = {"u": "user", "a": "assistant"}
    for r in damaged(rows):
        convs.setdefault(r[0], []).append(r)
    for c in {r[0] for r in rows}:
        own = sorted(convs.get(c, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\v\f\r")
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        first = [(r[2] or " ")[0] for r in own]
        best = {p: (0, "", []) if p in ("", "a") else (10 ** 9, "", []) for p in turn_to}

        def inserted(v):
            for _ in range(3):
                v = {p: min([v[p], (5 + v[q][0], "I" + v[q][1], [(names[q], ""), *v[q][2]])], key=lambda x: x[:2]) for p, q in turn_to.items()}
            return v

        best = inserted(best)
        for (_, _, role, text), fault, ini in zip(own[::-1], faults[::-1], first[::-1]):
            more, after = 5 if fault == "t" else 0, {}
            for p, q in turn_to.items():
                ways = [(2 + best[p][0], "D" + best[p][1], best[p][2])]
                if fault in "t-":
                    ways.append((1 + more + best[q][0], "R" + best[q][1], [(names[q], text), *best[q][2]]))
                    if k := keeps.get((ini, p)):
                        ways.append((more + best[k][0], "K" + best[k][1], [(role, text), *best[k][2]]))
                after[p] = min(ways, key=lambda x: x[:2])
            best = inserted(after)
        cost, audit, lines = best[""]
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
               sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, sha(["\n".join(f"{a}:{b}" for a, b in lines)]))


def odd_conversations():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user"], ["ok.", "what? ", "no", None, "", "\n", "yes!\t", "\x1c", "a b."]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(80)]), rng.choice(roles), rng.choice([*texts, f"{rng.random()}.", f"{rng.random()}"])) for _ in range(400)]
    return rows + [(9, 0, "user", "a"), (10, 2, "system", "Go on."), (11, None, "user", "x" * 1_200_000 + ".")] + [(12, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(90)]


@pytest.mark.parametrize("least", [1, 7, 256])
def test_repair_by_brute_force(spark, least):
    rows = odd_conversations()
    got = [tuple(r) for r in repair.repair_digest(clash(spark.createDataFrame(rows, CONVS)), least).collect()]
    assert sorted(got, key=str) == sorted(plain_repair(rows), key=str)


def test_repair_edges(spark):
    assert repair.repair_digest(spark.createDataFrame([], CONVS)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = repair.repair_digest(spark.createDataFrame([(dropped, 0, "user", "a.")], CONVS)).first()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = [(1, 0, "system", "Hi."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (1, 3, "user", "C?")]
    out = repair.repair(spark.createDataFrame(rows, CONVS)).orderBy("block", "seq").collect()
    assert [(x.role, x.text) for x in out] == [("system", "Hi."), ("user", "A."), ("assistant", "B.")]


def test_inserts_are_walked_when_they_are_cheap(monkeypatch):
    """With cheap inserts the audit uses them; the walk's cost is the vector's."""
    monkeypatch.setattr(repair, "INSERT", 1)
    monkeypatch.setattr(repair, "END", repair.with_inserts([0, repair.INF, repair.INF, 0]))
    audit, made, state, cost = repair.walk("2", repair.END, repair.START, True)  # an assistant turn alone
    assert (audit, cost, state) == ("IK", 1, repair.ASSISTANT) and made == [(-1, repair.USER), (0, -1)]


def test_block_matrices_give_the_whole_vectors():
    rng = random.Random(5)
    codes = "".join(rng.choice("0123456789abcdef") for _ in range(97))
    whole = repair.backward(codes, repair.END)
    blocks = [codes[i:i + 10] for i in range(0, 97, 10)]
    assert repair.checkpoints([repair.matrix(b) for b in blocks]) == [whole[min(i + 10, 97)] for i in range(0, 97, 10)]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_conversation_repair"])
def test_sql_on_small_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_language_id_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k, r in got.items() if r.held_out]
    assert sorted(held) == sorted(k for k in want if zlib.crc32(str(k).encode()) % 4 == 2)
    assert np.mean([got[k].lang_pred == want[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_model_by_brute_force(spark):
    """Document frequencies, held-out rows and scores re-computed one n-gram at a time; cut rows change nothing else."""
    docs = clash(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = docs.select("doc_id", "text", "lang").collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None]

    def columns(word):
        w, out = f"<{word}>", []
        for n in langid.GRAMS:
            for i in range(len(w) - n + 1):
                h = n
                for ch in w[i:i + n]:
                    h = ((h ^ ord(ch)) * 0x9E3779B97F4A7C15) % 2 ** 64
                    h ^= h >> 29
                out.append((h * 0x9E3779B97F4A7C15 % 2 ** 64) >> (64 - langid.BITS))
        return out

    frame = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in learn], "doc_id long, text string, lang string")
    n, df = langid.document_frequencies(frame)
    want = np.zeros(1 << langid.BITS, int)
    for r in learn:
        want[sorted({c for w in set(langid.words_in(r.text or "")) for c in columns(w)})] += 1
    assert n == len(learn) and (df == want).all()
    model = langid.fit(docs)
    assert (model.weights == 0).mean() > 0.5
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in rows[:40]:
        cols = [c for w in langid.words_in(r.text or "") for c in columns(w)]
        if not cols:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        z = (model.weights[cols].sum(axis=0) / len(cols) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.langs[int(p.argmax())] == got[r.doc_id].lang_pred and abs(p.max() - got[r.doc_id].score) < 1e-9
    again = langid.fit(docs.repartition(7))
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_language_id_edges(spark):
    df = spark.createDataFrame([(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "12 ² ½ !", "en", "a", 1), (None, "the cat", None, None, None),
                                (5, "字", "zh", "a", 1), (5, "der Hund " * 200_000, "de", "a", 1), (5, "der Hund", "de", "a", 1)], DOCS)
    got = langid.language_id(clash(df)).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert not next(r for r in got if r.doc_id is None).held_out
    assert langid.language_id(df.limit(0)).count() == 0
    nothing = langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = 8 * (np.eye(3)[y] + rng.normal(0, 0.6, (400, 3)))

    def loss(t):
        p = langid.softmax(z / t)
        return -np.log(p[np.arange(400), y]).mean()

    t = langid.temperature_of(z, y)
    assert loss(t) < loss(1.0) and all(loss(t) <= loss(t * f) + 1e-9 for f in (0.9, 1.1))
