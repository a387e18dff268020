"""What a task holds stays bounded, whatever the input holds of one thing."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from revforge.llm import ann, substrings


def test_bytes_of_open_blocks_come_in_bounded_batches():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 100_000))) + "é" * i for i in range(30)]
    spans = [[(int(s), int(s) + 86, i) for s in rng.integers(0, 99_900, 2_000)] for i in range(30)]
    found = [[{"head": h, "start": (i % 2 << 32) + a, "stop": (i % 2 << 32) + e} for a, e, h in each] for i, each in enumerate(spans)]
    kind = pa.list_(pa.struct([("head", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] + list(range(30)) + [8]), pa.array([0] + [i % 2 << 32 for i in range(30)] + [0]), pa.array(["x"] + texts + ["y"]), pa.array([[]] + found + [[]], kind)],
        names=["doc_id", "base", "text", "found"])
    got = list(substrings._context(iter([batch.slice(1)])))
    assert max(b.column("bytes").nbytes for b in got) < 2 * substrings._CHUNK  # 5 MB in all
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(h, i, (i % 2 << 32) + a, texts[i].encode()[a:e]) for i, each in enumerate(spans) for a, e, h in each]


def test_many_blocks_of_one_head_are_compared_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(substrings, "_STRINGS", 1 << 15, raising=False)
    monkeypatch.setattr(substrings, "_STRINGS_AT_ONCE", 1 << 13, raising=False)
    rng = np.random.default_rng(2)
    phrases = [rng.integers(97, 123, 76).astype(np.uint8).tobytes() for _ in range(300)]
    doc, start, raw = rng.integers(0, 5_000, 20_000), rng.integers(0, 1 << 20, 20_000), []
    for i in range(20_000):
        own = rng.integers(65, 91, 10).astype(np.uint8).tobytes()
        raw.append((own + phrases[i % 300] if i % 3 else phrases[i % 300][:60] + own))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(20_000, np.int64)), pa.array(doc), pa.array(start), pa.array(raw, pa.binary())], names=["head", "doc_id", "start", "bytes"])
    tracemalloc.start()
    out = list(substrings._compare(iter([batch.slice(0, 9_000), batch.slice(9_000)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    least: dict[bytes, int] = {}
    for d, x in zip(doc, raw):
        for k in range(len(x) - 49):
            least[x[k:k + 50]] = min(int(d), least.get(x[k:k + 50], 1 << 60))
    gone = {(int(d), int(s) + k + j) for d, s, x in zip(doc, start, raw) for k in range(len(x) - 49) if least[x[k:k + 50]] < d for j in (0, 49)}
    spans = [(r["doc_id"], r["start"], r["stop"]) for b in out for r in b.to_pylist()]
    covered = {(d, p) for d, a, e in spans for p in range(a, e)}
    want = {(int(d), int(s) + p) for d, s, x in zip(doc, start, raw) for k in range(len(x) - 49) if least[x[k:k + 50]] < d for p in range(k, k + 50)}
    assert gone <= covered and covered == want
    assert peak < 25e6, peak  # some 500,000 strings: 20 MB of keys alone when all are held


def index_of(lists: int, probes: int) -> ann.Index:
    rng = np.random.default_rng(4)
    index = ann.Index.__new__(ann.Index)
    index.dim, index.m2, index.turn, index.probes = 16, 100.0, np.linalg.qr(rng.normal(size=(17, 17)))[0], probes
    index.centers = rng.normal(size=(lists, 17))
    return index


def peak_of(work) -> int:
    tracemalloc.start()
    for b in work:
        del b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_batch_of_vectors_meets_the_centers_in_bounded_memory():
    index = index_of(800, 400)
    rows = pd.DataFrame({"vec_id": np.arange(4_000), "v": list(np.random.default_rng(5).normal(size=(4_000, 16)))})
    assert peak_of(ann._assign(index)(iter([rows]))) < 15e6  # a table of all rows and lists is 26 MB
    sizes = np.full(800, 40)
    assert peak_of(ann._probe(index, sizes, ann.Units(sizes))(iter([rows]))) < 40e6  # one vector for each of its lists: 205 MB


def test_units_hold_every_list_once():
    sizes = np.random.default_rng(6).integers(0, 400, 700)
    sizes[[3, 699]] = 60_000, 2_000
    units = ann.Units(sizes)
    of = {}
    for i in range(700):
        for u in units.of[i]:
            of.setdefault(u, []).append(i)
    most = max(ann.PART_LEAST, -(-sizes.sum() // ann.UNITS))
    assert all(len(x) == 1 or sizes[x].sum() <= most for x in of.values()) and sorted(of) == list(range(len(of)))
    assert units.parts[3] == -(-60_000 // most) and units.parts[699] == -(-2_000 // most)


def test_lists_scanned_for_many_queries_at_once_find_the_nearest():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 16))
    v[50:150] = v[50]  # ties go by id
    ids, index = rng.permutation(500), index_of(4, 4)
    index.m2 = (v * v).sum(axis=1).max()
    asked = np.append(ids[:120], [10_000])
    q = np.append(v[:120], v[[50]], axis=0)
    at, got, score = ann.scan(index.rotated(v), v, ids, index.rotated(q, query=True), q, asked)
    hit = 0
    for i, own in enumerate(asked):
        s = (v * q[i]).sum(axis=1)
        s[ids == own] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        hit += len(set(want) & set(got[at == i]))
        assert (score[at == i] == (v[np.argsort(ids)][got[at == i]] * q[i]).sum(axis=1)).all() and (np.diff(score[at == i]) <= 0).all()
    assert hit >= 0.95 * 20 * len(asked)
    at, got, _ = ann.scan(index.rotated(v)[:3], v[:3], ids[:3], index.rotated(q, query=True)[:2], q[:2], asked[:2])
    assert sorted(zip(at, got)) == sorted([(0, ids[1]), (0, ids[2]), (1, ids[0]), (1, ids[2])])  # fewer than k: all but its own
