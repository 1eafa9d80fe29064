"""The operators on vectors, pages and sources against plain versions, and the pipeline on a small corpus."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.llm import ann_search, exact_search, mixing, warc
from geoledger.storage import scratch


def vectors(spark, n=900, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = centres[rng.integers(0, 9, n)] + 0.4 * rng.normal(size=(n, dim))
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist(), 0, "rank") for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000, None, 0, "r"), (2001, [float("nan")] * dim, 0, "r"), (2002, [None] * dim, 0, "r"), (2003, [float("inf")] * dim, 0, "r"), (2004, [1.0], 0, "r"), (None, x[0].tolist(), 0, "r")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string"), x.astype(np.float32).astype(float)


def best(score, ids, own, k):
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    return [(int(ids[i]), score[i]) for i in order]


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "BLOCK", 200)
    df, x = vectors(spark)
    z, ids = np.floor(256 * x).astype(np.int64), np.arange(len(x))
    found = {}
    for r in exact_search.search(df, 50, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 50))
    for q, rows in found.items():
        assert [(i, s) for _, i, s in sorted(rows)] == best(z @ z[q], ids, q, 5)


def test_exploded_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """However small Spark holds them, they are as many rows as tiles."""
    monkeypatch.setattr(exact_search, "BLOCK", 30)
    found = exact_search.search(vectors(spark)[0], 50, 5)
    assert found.count() == 90 and found.collect()
    assert "BroadcastHashJoin [block" not in found._jdf.queryExecution().executedPlan().toString()


def test_elimination_skips_candidates_but_no_result():
    rng = np.random.default_rng(2)
    c = np.floor(100 * np.concatenate([rng.normal(size=(400, 4)), 30 + rng.normal(size=(400, 4))]))
    p = c[[0, 401]]
    d = np.sqrt(((c[:, None] - p) ** 2).sum(2))
    ids = np.arange(800)
    got = list(exact_search.tile_best(ids[:3], c[:3], d[:3], ids, c, d, 5, np.full(3, exact_search.LOWEST)))
    assert got == [(q, i, s) for q in range(3) for i, s in best((c @ c[q]).astype(int), ids, q, 5)]


def test_ann_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "PART_ROWS", 100)
    df, x = vectors(spark)
    ids, recall = np.arange(len(x)), []
    found = {}
    for r in ann_search.search(df, 20, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 20))
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:], strict=False))
        for _, i, s in rows:
            total = 0.0
            for u, v in zip(x[q].tolist(), x[i].tolist(), strict=True):
                total += u * v
            assert s == total
        recall.append(len({i for _, i, _ in rows} & {i for i, _ in best(x @ x[q], ids, q, 20)}) / 20)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("search", [lambda df: exact_search.search(df, 50, 5), lambda df: ann_search.search(df, 20, 20)])
def test_search_small_tables(spark, search):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert search(empty).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (2, [0.9, 0.1], 0)], "vec_id long, embedding array<float>, label int")
    assert [r.vec_id for r in search(three).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize(("search", "k", "every"), [(exact_search.search, 5, 50), (ann_search.search, 20, 20)])
def test_each_length_is_searched_among_its_own(spark, search, k, every):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(1, 9, 3 if i % 2 else 5).astype(float).tolist(), 0) for i in range(200)] + [(100_000, [1.0], 0)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every, k).collect()
    length = {i: len(v) for i, v, _ in rows}
    assert all(length[r.query_id] == length[r.vec_id] for r in got)
    assert {q: sum(r.query_id == q for r in got) for q in range(0, 200, every)} == dict.fromkeys(range(0, 200, every), k)


PAGES = "page_id long, url string, html string, key string, payload string, first_id long"


def warc_rows(spark, rows, partitions=3, chunk_bytes=1000):
    path = scratch(spark, "warc")
    df = spark.createDataFrame(rows, PAGES)
    warc.write_archives(df.repartition(partitions) if partitions else df, path, chunk_bytes=chunk_bytes)
    return path, warc.read_archives(spark, path).collect()


def test_warc_round_trip(spark):
    htmls = ["<p>a</p>", None, "", "<p>a</p>", "é" * 3000, "x\r\n\r\nWARC/1.1\r\n\r\ny\r\n", "é" * 3000, "\r\n\r\n", "z" * 1000, "<p>a</p>"]
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nX: 1", h, "k", "p", 1) for i, h in enumerate(htmls)] + [(None, "u", "<p>a</p>", "k", "p", 1)]
    found = {r.page_id: r for r in warc_rows(spark, rows)[1]}
    assert len(found) == len(rows)
    for i, h in enumerate(htmls):
        body = (h or "").encode()
        first = min(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
    assert found[4].n_chunks == 6 and found[None].refers_to == 0


ENDS = ["", "\r", "\n", "\r\n", "\n\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\r\r\n\r\n\n"]


@pytest.mark.parametrize("partitions", [0, 40])
def test_warc_payloads_ending_in_line_breaks(spark, partitions):
    """Also alone in their archive, with partitions that hold nothing."""
    htmls = [a + "hello" * n + b for a in ENDS for b in ENDS for n in (0, 1, 300)]
    _, found = warc_rows(spark, [(i, "u", h, "k", "p", 1) for i, h in enumerate(htmls)], partitions, 100)
    assert {r.page_id: r.payload_digest for r in found} == {i: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, h in enumerate(htmls)}
    assert [r.payload_bytes for r in warc_rows(spark, [(1, None, "hello\r\n", "k", "p", 1)])[1]] == [7]


def test_warc_empty_table_and_repeated_rows(spark):
    assert warc_rows(spark, [])[1] == []
    found = warc_rows(spark, [(1, "u", "é" * 3000, "k", "p", 1)] * 3 + [(2, "u", "é" * 3000, "k", "p", 1)])[1]
    assert sorted((r.page_id, r.record_type, r.n_chunks) for r in found) == [(1, "response", 6)] * 3 + [(2, "revisit", 1)]


def test_warc_chunk_table_and_files(spark):
    """One row is fetched by record and chunk number; files hold each payload between header and blank line."""
    import gzip
    from pathlib import Path

    body = "".join(chr(97 + i % 26) for i in range(2500)) + "\r\n"
    path, _ = warc_rows(spark, [(7, "u", body, "k", "p", 1), (8, "v", "b\r\n\r\n", "k", "p", 1)])
    r = spark.read.parquet(path).filter("page_id = 7 AND chunk_no = 2").first()
    fields, block = warc._parsed(bytes(r.member))
    assert block == body[1000:2000].encode() and r.running_digest == "sha1:" + base64.b32encode(hashlib.sha1(body[:2000].encode()).digest()).decode() and fields["WARC-Segment-Number"] == "2"
    out = scratch(spark, "files")
    warc.write_files(spark, path, out)
    payloads = {}
    for file in Path(out.removeprefix("file://")).glob("*.gz"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            fields = dict(x.split(": ", 1) for x in data[at : end - 4].decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            name = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
            payloads[name] = payloads.get(name, b"") + data[end : end + size]
            at = end + size + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
    assert payloads == {"<urn:page:7>": body.encode(), "<urn:page:8>": b"b\r\n\r\n"}


def test_warc_tells_a_changed_chunk(spark):
    path, _ = warc_rows(spark, [(7, "u", "a" * 2500, "k", "p", 1)])
    rows = spark.read.parquet(path).filter("chunk_no <> 2")
    other = scratch(spark, "broken")
    rows.write.parquet(other)
    with pytest.raises(Exception, match="without the one before"):
        warc.read_archives(spark, other).collect()


def test_warc_long_payloads_are_chunks_everywhere(spark):
    """40 MB, twice: decided on rows without payloads, and no row after the scan is larger than a chunk."""
    path = scratch(spark, "long")
    text = F.repeat(F.lit("0123456789abcdef" * 64), 40 << 10)
    df = spark.range(2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("html"), F.lit(1).alias("identity"))
    assert "html" not in warc.plan_records(df).columns and not {"payload", "piece"} & set(warc.plan_records(df).columns)
    assert warc.chunks(df).agg(F.max(F.octet_length("piece")), F.count("*")).first() == (1 << 20, 80)
    warc.write_archives(df, path)
    found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    digest = base64.b32encode(hashlib.sha1(b"0123456789abcdef" * 64 * (40 << 10)).digest()).decode()
    assert all(r.payload_digest == digest and r.payload_bytes == 40 << 20 for r in found.values())
    assert (found[0].record_type, found[0].n_chunks, found[1].record_type, found[1].refers_to, found[1].n_chunks) == ("response", 40, "revisit", 0, 1)
    assert spark.read.parquet(path).agg(F.count("*")).first()[0] == 41


def test_warc_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.plan_records(df, least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "domain string, lang string, tokens long")
    from pyspark.sql import functions as F

    weights = {"domain": {"a": 1.0, "b": 1.0}, "lang": {"x": 1.0, "y": 1.0, "z": 1.0}}
    got = {r.lang: r.budget for r in mixing.budgets(leaves, ("domain", "lang"), F.lit(800), 1, 0.7, weights).collect()}
    assert got == {"x": 10, "y": 390, "z": 400}
    got = {r.lang: r.budget for r in mixing.budgets(leaves.filter("lang <> 'y'"), ("domain", "lang"), F.lit(800), 1, 0.7, weights).collect()}
    assert got == {"x": 10, "z": 790}


def plain_mix(rows, tokens, domain_of, share, epochs, seed, power, weights):
    """(doc_id, epoch) by the rule itself: shares level by level in a loop, prefixes by a sort of each leaf."""
    import math
    from collections import defaultdict

    leaves = defaultdict(int)
    for r in rows:
        if tokens[r["text"] or ""]:
            leaves[domain_of(r["source"]), r["lang"], r["source"]] += tokens[r["text"]]

    def share_out(nodes, depth, budget, out):
        children = defaultdict(dict)
        for leaf, n in nodes.items():
            children[leaf[depth]][leaf] = n
        size = {c: sum(x.values()) for c, x in children.items()}
        listed = weights.get(mixing.LEVELS[depth])
        weight = {c: (listed.get(c, min(listed.values())) if listed else size[c] ** power) for c in children}
        got, open_, left = {}, set(children), budget
        while open_:
            unit = left / sum(weight[c] for c in open_)
            full = {c for c in open_ if size[c] * epochs <= unit * weight[c]}
            if not full:
                got |= {c: unit * weight[c] for c in open_}
                break
            got |= {c: float(size[c] * epochs) for c in full}
            left -= sum(size[c] * epochs for c in full)
            open_ -= full
        for c, x in children.items():
            if depth + 1 < len(mixing.LEVELS):
                share_out(x, depth + 1, got[c], out)
            else:
                out[next(iter(x))] = math.floor(got[c] + 1e-9)

    budget = {}
    share_out(leaves, 0, math.floor(sum(leaves.values()) * share), budget)
    taken = []
    for leaf, n in leaves.items():
        mine = [r for r in rows if (domain_of(r["source"]), r["lang"], r["source"]) == leaf and tokens[r["text"] or ""]]
        whole = min(budget[leaf] // n, epochs)
        taken += [(r["doc_id"], e) for e in range(whole) for r in mine]
        rest, before = budget[leaf] - whole * n if whole < epochs else 0, 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{seed}:{whole}:{r['doc_id']}".encode()).hexdigest()):
            if before < rest:
                taken.append((r["doc_id"], whole))
            before += tokens[r["text"]]
    return sorted(taken)


@pytest.mark.parametrize(("share", "epochs", "weights"), [(0.5, 2, {"domain": {"a": 0.7, "b": 0.2, "c": 0.1}, "lang": {"en": 3.0, "de": 1.0}}), (1.4, 2, {"domain": {"a": 0.1, "b": 0.9}}), (0.9, 1, {}), (2.5, 2, {})])
def test_mix_against_the_plain_rule(spark, share, epochs, weights):
    import random

    from tokenizers import Tokenizer

    from geoledger.llm import tokens as shared

    rng, library = random.Random(8), Tokenizer.from_file(shared.vocabulary_path())
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    source = lambda: f"s{min(rng.randint(0, 5), rng.randint(0, 5))}"
    rows = [{"doc_id": i, "text": "\n".join(word() for _ in range(rng.randint(1, 40))), "lang": rng.choice(["en", "en", "en", "de"]), "source": source()} for i in range(400)]
    rows += [{"doc_id": 900, "text": None, "lang": "en", "source": "s1"}, {"doc_id": 901, "text": "", "lang": "en", "source": "s1"}]
    domains = {"s0": "a", "s1": "a", "s2": "b", "s3": "b", "s4": "c"}
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], 1, "x") for r in rows], "doc_id long, text string, lang string, source string, mix_tokens int, place string")
    count = {r["text"] or "": len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows}
    want = plain_mix(rows, count, lambda s: domains.get(s, "other"), share, epochs, "seed", 0.7, weights)
    got = mixing.mix_ids(docs, mixing.domain_by(domains), share, epochs, "seed", 0.7, weights).collect()
    assert sorted((r.doc_id, r.mix_epoch) for r in got) == want and all(r.mix_tokens == count[rows[r.doc_id]["text"]] for r in got)
    mixed = mixing.mix(docs.repartition(5), mixing.domain_by(domains), share, epochs, "seed", 0.7, weights)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, _ in want)


def test_mix_nulls_and_repeats(spark):
    rows = [(1, "a b", None, None), (1, "a b", None, None), (None, "c d", "en", None), (None, "e f", "en", None), (3, None, "en", "s"), (4, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.text) for r in mixing.mix(docs, share=1.0).collect()) == [(0, "c d"), (0, "e f"), (1, "a b"), (1, "a b")]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_ids(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(80)) + "." for _ in range(120)]
    texts = [*good, *(g + " tail" for g in good[:20]), *(" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60))]
    texts[5] += " reach me at someone.x@mail.example.com"
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 140), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(range(140))
    assert set(kept[1]) == set(range(120))
    assert kept[2][5].endswith("reach me at [EMAIL]") and all(kept[2][i] == texts[i] for i in kept[2] if i != 5)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
