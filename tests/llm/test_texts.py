"""The operators on texts against plain versions, with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoledger.llm import licenses, near_dedup, packing, pii, quality, token_files, tokens
from geoledger.storage import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label_id long, scored_text string, node long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", "src1", len(t or ""), 7, "x", 3) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


ODD = [None, "", " ", "a", "Two  spaces\n\n and\ttabs ", "<|endoftext|> in a text", "naïve café 文字 �", "word " * 3000, "x" * 5000, "Licensed under the Apache License, Version 2.0.", "mit license MIT LICENSE"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab .,'!\n\t\r 0é文\x00\x1f\x85<|>"))), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    encoder = tokens.encoder(tokens.vocabulary_path())
    whole = [x.ids for x in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == whole


def test_packing_holds_every_id_once(spark, library):
    rows = packing.pack(frame(spark, ODD).repartition(2)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(ODD):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_tokens <= 2048


def test_packing_pads_little_and_balances_steps():
    rng, packer = random.Random(1), packing.Packer(0)
    lengths = [rng.choice([3, 40, 300, 700, 1500, 5000]) + rng.randrange(50) for _ in range(400)]
    rows = [row for i, n in enumerate(lengths) for row in packer.add(i, n)]
    rows += [*packer.pack(), *packer.rest()]
    assert sum(r[2] for r in rows) == sum(lengths)
    totals = {r[3]: r[6] for r in rows}
    padding = sum(2048 - t for t in totals.values() if t & (t - 1))
    assert padding < 2048
    steps = Counter()
    for r in rows:
        steps[r[7]] += r[2]
    assert max(steps.values()) <= packing.STEP_TOKENS


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 70001, dtype=np.uint32)
    payload, ends = token_files.encode_chunk(ids, planes, 32768)
    assert (token_files.decode_chunk(payload, ends, len(ids), planes, 32768) == ids).all()
    assert (token_files.decode_block(payload, ends, 2, len(ids), planes, 32768) == ids[65536:]).all()


def test_token_files_round_trip(spark, library):
    path = scratch(spark, "ids")
    ids = [5, 3, 9, 1, 2, 20, 30, 7, 8, 6, 4]
    token_files.write_ids(frame(spark, ODD, ids), path, partitions=3)
    found = {r.doc_id: r for r in token_files.read_ids(spark, path).collect()}
    at = 0
    for i, text in sorted(zip(ids, ODD, strict=True), key=lambda x: x[0]):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_licenses_against_a_plain_scan(spark):
    texts = [*ODD, "see the GNU General Public License; gnu general public license", "cc BY-nc 4.0 cc by", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"]
    found = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and labels <= set(r.labels.split(","))
    assert "gpl-3.0" in found[len(texts) - 1].labels and "apache-2.0" in found[9].labels


def test_license_notice_without_base_phrase(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    r = licenses.scan(frame(spark, [f"some words before {bsd} and after", "clean words only"])).orderBy("doc_id").collect()
    assert (r[0].labels, r[0].base_labels, r[0].matches[0].word) == ("bsd", "", 3) and r[1].labels == ""


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab1.@-+ %_é")), max_size=40))
def test_emails_are_the_patterns_matches(text):
    assert [(a, b) for a, b, _ in pii._emails(text)] == [m.span() for m in EMAIL.finditer(text)]


def test_base_spans():
    text = "mail a.b@x.example.com, 10.0.0.255 and 10.0.0.256, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (988) 555-2485 or +12"
    assert [(k, text[a:b]) for a, b, k in pii.base_spans(text)] == [("email", "a.b@x.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]


def test_field_finds_repeats_in_another_form(spark):
    rng = random.Random(0)
    train = [f"the quick +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} thing and ab{rng.randint(1, 99)}@mail.example.com or {rng.randint(0, 99)} items in {rng.randint(1900, 2030)}." for _ in range(300)]
    text = "call +1 (988) 555-2485 now, later dial 988-555-2485 again; 42 items in 1999"
    docs = frame(spark, [*train, text, None, "", "clean words"])
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    r = rows[300]
    assert r.n_phone == 1 and r.spans == "phone:5:22,phone:39:51"
    assert r.base_sha256 == hashlib.sha256(b"phone:5:22").hexdigest()
    assert rows[301].spans == rows[302].spans == rows[303].spans == ""
    masked = {m.doc_id: m for m in pii.mask(docs).collect()}
    assert masked[300].text == "call [PHONE] now, later dial [PHONE] again; 42 items in 1999" and masked[300].n_chars == len(masked[300].text)
    assert masked[301].text is None and masked[303].text == "clean words"


def test_quality_held_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(250)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(100)]
    docs = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 250), 0) for i in range(350)] + [(1, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 350]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.doc_id < 250) for r in held)
    kept = quality.keep(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == 352


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [round(r.score, 6) for r in quality.classify(frame(spark, ["a b", None]), labels).collect()] == [0.5, 0.5]


def sets_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(ids, texts):
    sets = [sets_of(t) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def near_copies(seed=3, groups=6, copies=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [None, "", "   ", "one two", "One TWO", "a b c d", "same words here again now", "same words here again now"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(100)) for _ in range(50)]
    return texts


def test_near_dedup_against_all_pairs(spark):
    texts = near_copies()
    ids = random.Random(4).sample(range(1000), len(texts))
    want = plain_components(ids, texts)
    rows = near_dedup.link(frame(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r


def test_near_dedup_nulls_and_repeats(spark):
    rows = near_dedup.link(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 4, 4, 5])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, None, True), (4, 4, True), (4, 4, True), (5, 5, True)]


def test_bayesian_test_keeps_similar_pairs():
    rng = np.random.default_rng(5)
    n, k = 3000, near_dedup.BANDS * near_dedup.ROWS
    a = rng.integers(0, 1 << 32, (n, k), dtype=np.uint32)
    b = np.where(rng.random((n, k)) < 0.75, a, rng.integers(0, 1 << 32, (n, k), dtype=np.uint32))
    assert near_dedup.likely(a, b).all()
    c = np.where(rng.random((n, k)) < 0.3, a, rng.integers(0, 1 << 32, (n, k), dtype=np.uint32))
    assert near_dedup.likely(a, c).mean() < 0.01


@pytest.mark.parametrize("run", [packing.pack, licenses.scan, pii.find, near_dedup.link])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).count() == 0
