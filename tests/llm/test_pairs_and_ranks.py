"""Embedding near-dedup, divergence of sources and lexical search against plain rules, with odd and empty tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from geoledger.llm import divergence, embed_dedup, lexical

ODD = "doc_id long, text string, lang string, source string, n long, number int, term string, p long, shard long, bucket int"


def plain_links(rows, threshold=0.9):
    """n_links and component_id of each row (id, vector), all pairs one by one."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, links[a], None if i is None else least[find(a)], i is None or least[find(a)] == i) for a, (i, _) in enumerate(rows)]


def clusters(seed=1, n=700, dim=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.1, 0.3, 0.5, 2.0], n)[:, None]
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies
    return [(i, v) for i, v in enumerate(x.astype(np.float32).astype(float).tolist())]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1, "regions": 8}, {"block_bytes": 1, "regions": 1}])
def test_cosine_links_against_all_pairs(spark, monkeypatch, options):
    monkeypatch.setattr(embed_dedup, "CHUNK", 64)
    rows = clusters()
    got = embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), **options).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_links(rows))


def test_cosine_links_of_odd_rows(spark):
    big = [1e200, 1e200]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.1]), (None, [1.0, 1.0]), (9, big), (10, [1.0, 1.0, 1.0]), (11, [2.0, 2.0, 2.0]), (12, [-1.0, 1.0]), (12, [1.0, -1.0]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]), (15, [1e-310, 1e-310]), (16, [5.0])]
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    got = sorted((tuple(r) for r in embed_dedup.link(df).collect()), key=str)
    assert got == sorted(plain_links(rows), key=str)
    assert embed_dedup.link(df.limit(0)).count() == 0
    assert embed_dedup.link(df.filter("vec_id < 4")).collect() and all(r.n_links == 0 and r.kept for r in embed_dedup.link(df.filter("vec_id < 4")).collect())


def test_regions_and_leading_dimensions_leave_work_out():
    """On far clusters boxes of regions rule pairs out, and a tile's first dimensions rule out nearly all pairs of unlike vectors."""
    rng = np.random.default_rng(2)
    x = embed_dedup.unit(rng.normal(size=(400, 64)))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :32]
    row = {"a_node": np.arange(400).tobytes(), "a_n": np.ones(400, np.int64).tobytes(), "a_unit": x.tobytes(), "a_lead": (x @ axes).tobytes()}
    block = embed_dedup.Block.of(row, "a")
    partial = block.lead[:, :16] @ block.lead[:, :16].T + block.rest[:, 1:2] * block.rest[:, 1]
    assert (partial >= 0.9).mean() < 0.02
    side = {f"{k}{d}": 0.0 for k in ("low", "high") for d in range(embed_dedup.SPLIT_DIMS)}
    far = side | {"low0": 0.5, "high0": 0.9, "width": 64}
    assert embed_dedup.partners([side | {"width": 64}, far, far | {"width": 32}], 0.9).tolist() == [[True, False, False], [False, True, False], [False, False, True]]


def test_a_dense_tile_gives_few_links():
    x = embed_dedup.unit(np.ones((300, 8)) + 0.01 * np.random.default_rng(5).normal(size=(300, 8)))
    row = {"a_node": np.arange(300).tobytes(), "a_n": np.full(300, 2).tobytes(), "a_unit": x.tobytes(), "a_lead": x.tobytes()}
    links, _, joins = embed_dedup.tile(embed_dedup.Block.of(row, "a"), embed_dedup.Block.of(row, "a"), True, 0.9)
    assert links.tolist() == [598] * 300 and len(joins) == 299


def plain_audit(rows, least, top):
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: Counter(w for d in mine if d[1] == s for w in d[2] if df[w] >= least) for s in {d[1] for d in mine}}
        p_of = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: p_of(c) for s, c in count.items()}, p_of(sum(count.values(), Counter()))
        for s in p:
            pair = sorted(((sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            term = sorted(((p[s][w] - q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, i, v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, i) in enumerate(found)]
    return out


def audited(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("width", [128, 2])
def test_divergence_against_the_plain_rule(spark, monkeypatch, width):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 900)
    monkeypatch.setattr(divergence, "LONG_BYTES", 600)
    monkeypatch.setattr(divergence, "TERMS", 7)
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("Ab", "é", "zz", "Q") for b in ("", "a", "ñb", "cC", "dd", "ee", "ff")]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)), p=np.arange(1, 29) / 406)) + " the-1the the" for _ in range(240)]
    rows = [(t, ["en", "de", None, ""][i % 4], [f"s{i % 5}", "s1", None][int(rng.integers(0, 3))]) for i, t in enumerate(texts)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("once", "yy", "a"), ("twice", "yy", "b"), ("word " * 2000, "en", "s1")]
    df = spark.createDataFrame([(i % 9 or None, *r, 1, 2, "x", 3, 4, 5) for i, r in enumerate(rows)], ODD).repartition(3)
    assert audited(df, least=4, top=6, width=width) == sorted(plain_audit(rows, 4, 6))
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_merged_runs_by_batches_of_any_size(size):
    """Runs are merged and terms are kept alike, wherever batches are cut."""
    rng = np.random.default_rng(size)
    rows = sorted((b"l%d" % rng.integers(2), b"t%d" % rng.integers(12), b"s%d" % rng.integers(3), int(rng.integers(100)), int(rng.integers(1, 3)), int(rng.integers(1, 9))) for _ in range(160))
    names = ["lang", "term", "source", "document", "docs", "n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k < 3 else pa.int64()) for k, c in enumerate(zip(*rows[at : at + size], strict=True))], names) for at in range(0, len(rows), size)]
    docs, n = Counter(), Counter()
    for r in rows:
        docs[r[:2]] += r[4]
        n[r[:3]] += r[5]
    got = [tuple(x.values()) for b in divergence.merged_runs(iter(batches), 14) for x in b.to_pylist()]
    assert [r[:4] for r in got] == [(*k, n[k]) for k in sorted(n) if docs[k[:2]] >= 14]
    assert [r[:2] for r in got if r[4]] == sorted(k for k in docs if docs[k] >= 14) and 0 < len(got) < len(n)


def plain_ranks(docs, items, k=10):
    lower = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    found = [(i, Counter(terms(t))) for i, t in docs]
    documents, length = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in {x for x in items if x[0] is not None}:
        scores = []
        for i, c in found:
            m = 100 - 75 + 75 * sum(c.values()) * documents // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def ranked(docs, items, **options):
    return sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(lexical.index(docs), items, **options).collect())


@pytest.mark.parametrize("block_terms", [200_000, 20])
def test_lexical_search_against_the_plain_rule(spark, monkeypatch, block_terms):
    for name, value in (("SHARD_BYTES", 1500), ("LONG_BYTES", 900), ("SEEDS", 2), ("WINDOW", 4)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(60)] + ["Été", "x1", "A"])
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda n: "-".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(0, 70)))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(25)] + [(None, docs[5][1]), (None, None), (401, "w3 w3"), (402, None), (500, "w1 w2 " * 600)]
    items = [(1, docs[5][1]), (2, "w59 W59 w59 été"), (3, ""), (4, None), (5, "unseen words"), (6, "w0 w0 a"), (None, "w1"), (7, text(90))]
    frame = spark.createDataFrame([(*r, None, "s", 1, 2, "t", 3, 4, 5) for r in docs], ODD).repartition(4)
    bench = spark.createDataFrame([(*r, "x") for r in items + items[:2]], "item_id long, text string, terms string")
    assert ranked(frame, bench, block_terms=block_terms) == plain_ranks(docs, items)
    assert ranked(frame.limit(0), bench) == [] and ranked(frame, bench.limit(0)) == []


def test_wand_skips_documents_that_cannot_win(monkeypatch):
    """With a high threshold the postings of a frequent term are probed for few documents, and the heap is that of a full scan."""
    rng = np.random.default_rng(3)
    docs = [" ".join(["the"] * int(rng.integers(0, 5)) + [f"r{rng.integers(400)}" for _ in range(6)]) for _ in range(3000)]
    row = dict(zip(("documents", "length", "ids", "lengths", "terms", "ends", "docs", "tfs"), lexical.shard_row(list(range(3000)), [d.encode() for d in docs]), strict=True))
    items = lexical.Items.of([type("R", (), {"item_id": 1, "text": b"the r7 r8 r9"})()])
    n = Counter(w for d in docs for w in set(d.split()))
    weight = lexical.weights(3000, np.array([n[t.decode()] for t in items.terms]))
    shard = lexical.Shard.of(row, items.terms, weight, row["documents"], row["length"])
    want = [(i, s) for _, _, i, s in plain_ranks(list(enumerate(docs)), [(1, "the r7 r8 r9")])]
    probed = []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: probed.append(np.size(v)) or search(a, v, *rest))
    heap = lexical.wand(shard, items.queries[0], [], 10)
    assert [(i, -s) for s, i in heap] == want
    first = sum(probed)
    assert lexical.wand(shard, items.queries[0], heap, 10)[:1] == heap[:1] and sum(probed) - first < 1000 < len(shard.docs[items.terms[b"the"]])
