"""Corpus operators against brute force on small tables full of odd cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trellis.llm import chat_format, common, exact_dedup, license_scan, packing, scaled_sketch, simhash_bk, sp_codec, substring_index, suffix_dedup, toxicity
from trellis.llm import textnp as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "b long, blob string, kind int, row long, fp long, u long"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, long and empty and null texts, repeated rows, a null id."""
    rng = random.Random(seed)
    base = [words(rng, n, 400) for n in (30, 60, 90, 250, 3000)]
    passage = words(rng, 45, 500)
    out = [*base, base[2], base[2].replace(" ", "\t \n"), base[3].replace("w1 ", "x "), "", None, " ", "one", passage]
    out += [words(rng, 20) + " " + passage + " " + words(rng, 15) for _ in range(6)]
    out += [base[4][:4000] + " " + words(rng, 50), "é" * 300, "éa" * 250, base[1].upper(), "ab" * 500, "▁ x \U0001f600 日本語 " * 40]
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[3], (None, base[0], "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns whose names the operators use inside."""
    names = "b blob kind row fp u v k key _kept_text _n_words _n_removed _kept_bytes found _id _sha _sha0 _tag _t own row_key place copy uid sketch bands root first score label id n_ids text_sha256 keep_id tail".split()
    return docs.selectExpr("*", *[f"{i} as {x}" for i, x in enumerate(names)], "map('a', 1) as a_map", "'q' as `dotted.name`")


def unique_rows():
    """Rows with the doc_id as key; repeated rows once, null last as -1 for lookups."""
    return {(i, t): None for i, t, *_ in corpus()}.keys()


# ---- exact deduplication -----------------------------------------------------------------------


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup(docs, clashing, no_docs):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(normal(t), []).append(i)
    for table in (docs, clashing):
        got = exact_dedup.decide(table).collect()
        assert len(got) == len(corpus())
        kept = Counter()
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            ids = by_hash[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == min((x for x in ids if x is not None), default=None)
            kept[r["text_sha256"]] += r["kept"]
        assert set(kept.values()) == {1}
        assert exact_dedup.deduplicate(table).count() == len(groups)
        assert exact_dedup.deduplicate(table).columns == table.columns
    assert exact_dedup.decide(no_docs).isEmpty()


def test_tree_merge_over_many_runs(spark):
    rows = [(i, f"t{i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.decide(df).collect()}
    assert got == {(i, i % 37, len(range(i % 37, 500, 37))) for i, _ in rows}


@pytest.mark.parametrize("partitions", [2, 8, 70])
def test_tree_merge_has_inner_levels(spark, partitions):
    rows = spark.range(300).selectExpr("id as doc_id", "cast(id % 7 as string) as text").repartition(partitions)
    digests = exact_dedup._digests(rows)
    assert digests.rdd.getNumPartitions() == partitions
    plan = exact_dedup.tree_merge(digests)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == {2: 2, 8: 2, 70: 4}[partitions]
    assert exact_dedup.tree_merge(digests).count() == 7


def test_equal_rows_leave_one_with_defined_columns(spark):
    """Of rows equal in id and text the same one stays, however they are dealt."""
    rows = [(k % 3, "same text here", f"s{k}") for k in range(30)] + [(None, "x", "a"), (None, "x", "b"), (None, None, "c"), (None, "", "d")]
    seen = set()
    for partitions in (1, 4, 9):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
        exact = sorted(map(tuple, exact_dedup.deduplicate(df).collect()), key=str)
        near = sorted(map(tuple, simhash_bk.drop_near_duplicates(df).collect()), key=str)
        assert len(exact) == len(near) == 3
        seen.add((str(exact), str(near)))
    assert len(seen) == 1


def test_merge_keeps_unverified_digests_apart():
    e = np.zeros(3, exact_dedup._ENTRY)
    e["check"], e["id"], e["n"] = [1, 2, 1], [5, 6, 4], 1
    out = exact_dedup.merge_runs(e)
    assert sorted(zip(out["check"].tolist(), out["id"].tolist(), out["n"].tolist(), strict=True)) == [(1, 4, 2), (2, 6, 1)]


# ---- packing -----------------------------------------------------------------------------------


def test_packing(docs, clashing, no_docs):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        want[i, len(ids)] += 1
    for table in (docs, clashing):
        got = packing.pack(table).collect()
        total = Counter()
        for r in got:
            total[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert total == Counter({k: k[1] * n for k, n in want.items()})
        by_seq = {}
        for r in got:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in by_seq.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= packing.CAPACITY
    assert packing.pack(no_docs).isEmpty()


def test_pieces_carry_the_tokenizers_ids(spark):
    texts = ["Hello world <|endoftext|> again", words(random.Random(3), 4000), "日本 ñandú  \n\n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for r in packing.pack(df).collect():
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        raw = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(raw)


def test_fast_encoder_equals_the_library():
    """Odd strings of all kinds, by the library that the ids are defined by."""
    rng = random.Random(17)
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing.fast_encoder(public_tokenizers.path(packing.TOKENIZER))
    odd = ["<|endoftext|>", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "'s", "'LL", "é", "e\u0301", "日本", "\U0001f600\u200d\U0001f525", "\x00", "\x1f", "ﬁ", "١٢٣", "½", "12345678901234567890", "_", "...", "\r\n", "\ufeff", "ß", "İ", "word", "Word", "\u0e01\u0e33"]
    for k in range(600):
        text = "".join(rng.choice(odd) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(12)))
        assert encode(text) == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 31, 33, 700, 1023, 1024, 1500, 2047, 2048, 2049, 100_001])
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(pieces) == n
    for p in pieces[:-1]:
        assert 2048 // (2048 // p) == p


# ---- license scan ------------------------------------------------------------------------------


def test_license_base_scan(spark, docs, no_docs):
    texts = ["The MIT-License and mit   license, CC BY cc/by xcc by cc byx", "GNU General (Public) License! apache license2 Apache\nLicense", "mit license mit license", "cc", None, "", "émit license mit licensé"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert license_scan.scan(docs).count() == len(corpus())
    assert license_scan.scan(no_docs).isEmpty()


def test_license_rules():
    every = license_scan.rules()
    assert len(every) > 200
    automaton = license_scan.prefilter(every)

    def labels(text):
        return [h[2].label for h in license_scan.detections(text.lower().encode(), every, automaton)]

    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0"]
    assert labels("released under the terms of the GNU General Public License, version 3") == ["gpl-3.0"]
    assert labels("Licensed under the Apache License, Version 2.0 and the MIT License") == ["apache-2.0", "mit"]
    assert labels("see https://www.mozilla.org/en-US/MPL/2.0 for it") == ["mpl-2.0"]
    assert labels("under the sun nothing is licensed") == []


def test_every_rule_fires_through_its_prefilter():
    every = license_scan.rules()
    automaton = license_scan.prefilter(every)
    names = {k for r in every for k in r.keyword.split(",")}
    assert all(k == k.lower() and not re.search(r"\s", k) for k in names)
    assert len(automaton) == len(names)
    for line in license_scan.LICENCES.strip().splitlines():
        label, _, alternatives, keyword, _ = (x.strip() for x in re.split(r" \| ", line))
        depth, plain = 0, ""
        for c in alternatives:  # what must occur in every alternative: text outside of groups
            depth += (c in "([") - (c in ")]")
            plain += "\n" if c == "|" and not depth else "" if depth or c in ")]\\" else c
        for alt in plain.split("\n"):
            assert any(k in alt or k in alternatives.replace("\\", "") for k in keyword.split(",")), label


def spellings(parsed) -> set[str]:
    """What a parsed pattern matches, repetitions at their least number and once more."""
    out = {""}
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            each = {chr(arg)}
        elif name == "IN":
            each = {chr(x) if str(o) == "LITERAL" else "7" for o, x in arg}
        elif name == "BRANCH":
            each = set().union(*map(spellings, arg[1]))
        elif name == "SUBPATTERN":
            each = spellings(arg[3])
        else:
            each = {x * n for x in spellings(arg[2]) for n in (arg[0], arg[0] + 1)}
        out = {a + b for a in out for b in each}
    return out


def plain_gaps(pattern):
    """A pattern whose gaps of any signs are some few."""
    return re.sub(r"\.\{(\d+),\d+\}", lambda m: "z" * max(1, int(m[1])), pattern)


def test_sentences_fire_through_their_prefilter():
    """Each sentence, spelled out, holds its keyword and is detected as its licence."""
    every = license_scan.rules()
    automaton = license_scan.prefilter(every)
    for line in license_scan.SENTENCES.strip().splitlines():
        label, keyword, pattern = (x.strip() for x in line.split(" | "))
        simple = plain_gaps(pattern)
        for text in sorted(spellings(re._parser.parse(simple)), key=len)[:60]:
            assert any(k in text for k in keyword.split(",")), (label, text)
            found = license_scan.detections(f"before {text} after".encode(), every, automaton)
            assert label.removesuffix("-any") in {h[2].label for h in found}, (label, text, found)


def brute_detections(text, every):
    """All rules tried everywhere, and suppression by its definition."""
    hits = [(m.start(), m.end(), r) for r in every for m in r.pattern.finditer(text)]
    kept = []
    for h in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].name)):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h[:2])


def test_license_labels_by_brute_force(spark):
    every = license_scan.rules()
    automaton = license_scan.prefilter(every)
    rng = random.Random(31)
    lines = []
    for line in license_scan.SENTENCES.strip().splitlines():
        lines.append(min(spellings(re._parser.parse(plain_gaps(line.split(" | ")[2].strip()))), key=len))
    lines += ["licensed under the mit license", "spdx-license-identifier: gpl-3.0-or-later", "https://www.apache.org/licenses/license-2.0", "gpl v2", "cc by-sa 4.0", "gnu general public license", "apache license, version 2.0"]
    texts = [" ".join(x for _ in range(rng.randrange(1, 9)) for x in (words(rng, rng.randrange(6)), rng.choice(lines))) for _ in range(120)]
    for text in texts:
        raw = text.encode()
        assert license_scan.detections(raw, every, automaton) == brute_detections(raw, every)
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = brute_detections(text.encode(), every)
        base = {label for phrase, label in license_scan.PHRASES.items() if re.search(rf"(?<![a-z0-9]){phrase.replace(' ', '[^a-z0-9]+')}(?![a-z0-9])", text)}
        assert got[i]["labels"] == ",".join(sorted(base | {h[2].label for h in want}))
        assert got[i]["score"] == max([h[2].score for h in want] + [0.5] * bool(base), default=0.0)


def test_license_rules_match_unspaced_spellings():
    every = license_scan.rules()
    automaton = license_scan.prefilter(every)

    def labels(text):
        return [h[2].label for h in license_scan.detections(text.lower().encode(), every, automaton)]

    spelled = {
        "GPLv3": "gpl-3.0",
        "gpl3": "gpl-3.0",
        "GPLv2": "gpl-2.0",
        "GPL v3": "gpl-3.0",
        "GNU General Public License v3": "gpl-3.0",
        "Apache License v2": "apache-2.0",
        "Apache License, v2.0": "apache-2.0",
        "Apache License,  Version  2.0": "apache-2.0",
        "Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
        "Attribution Share Alike 3.0": "cc-by-sa-3.0",
        "Attribution-NonCommercial 4.0": "cc-by-nc-4.0",
        "Attribution-NoDerivatives 4.0": "cc-by-nd-4.0",
        "CC BY-SA 4.0": "cc-by-sa-4.0",
        "zero-clause BSD license": "bsd-0-clause",
    }
    assert {t: labels(t) for t in spelled} == {t: [x] for t, x in spelled.items()}
    # every spelling of the names, with each optional part and blank there and left out
    for line in license_scan.LICENCES.strip().splitlines():
        label, _, names, _, _ = (x.strip() for x in re.split(r" \| ", line))
        rule = next(r for r in every if r.name == f"{label}/name")
        for text in spellings(re._parser.parse(names)):
            assert rule.pattern.fullmatch(text.encode()), (label, text)
            assert rule.pattern.fullmatch(text.replace(" ", "\n ").encode()), (label, text)


# ---- substring deduplication -------------------------------------------------------------------


LOWEST = -(1 << 63)


def brute_windows(rows):
    """Removal by word windows, row by row: (id, text) and what is left of it, as often as it occurs."""
    order = sorted((i if i is not None else LOWEST, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t, *_ in rows)
    seen, out = set(), Counter()
    for i, _, t in order:
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out[i, t, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return out


def found_windows(cut):
    return Counter((r["doc_id"] if r["doc_id"] is not None else LOWEST, r["text"] or "", *r[-2:], r[-3]) for r in cut.collect())


def check_windows(table, rows):
    assert found_windows(substring_index.remove_repeats(table)) == brute_windows(rows)


def test_substring_dedup(docs, clashing, no_docs):
    check_windows(docs, corpus())
    check_windows(clashing, corpus())
    assert substring_index.remove_repeats(clashing).columns[:-3] == clashing.columns
    assert substring_index.remove_repeats(no_docs).isEmpty()


def repeated_rows():
    """Rows that repeat whole, rows of one id (null too) with other texts, and texts that share passages."""
    rng = random.Random(12)
    passage = words(rng, 60, 900)
    same = [(5, words(rng, 80, 900)), (None, words(rng, 70, 900)), (7, "short one")]
    rows = [*same * 4, *[(5, words(rng, 30, 900) + " " + passage) for _ in range(5)], *[(None, passage + " " + words(rng, 40, 900)) for _ in range(4)]]
    return rows + [(k, words(rng, 50, 900)) for k in range(10)]


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_repeated_rows_are_documents(spark, monkeypatch, partitions):
    """One definition whatever the partitions: one copy stays in op4, none in op9, and SQL agrees."""
    rows = repeated_rows()
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    check_windows(df, rows)
    check_bytes(df, rows)


@pytest.mark.parametrize("module", [substring_index, suffix_dedup])
def test_sql_counts_rows_not_ids(module):
    rows = repeated_rows()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    got = Counter((r[0] if r[0] is not None else LOWEST, *r[1:]) for r in db.execute(module.ORACLE).fetchall())
    if module is substring_index:
        want = Counter({(i, n, g, hashlib.sha256(kept.encode()).hexdigest()): 0 for i, _, n, g, kept in brute_windows(rows)})
        for (i, _, n, g, kept), c in brute_windows(rows).items():
            want[i, n, g, hashlib.sha256(kept.encode()).hexdigest()] += c
    else:
        want = Counter()
        for (i, _, n, g, spans, kept), c in brute_bytes(rows).items():
            want[i, n, g, spans, hashlib.sha256(kept).hexdigest()] += c
    assert got == want


def thue_morse(n, a, b):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_words_that_fool_polynomial_hashes_stay_apart(spark):
    """Balanced binary words of 1,024 bytes agree under every polynomial modulo 2**64; so do such sequences of words."""
    rng = random.Random(3)
    w = words(rng, 21, 900).split()
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, " ".join([*w[:11], one, *w[12:]])), (2, " ".join([*w[:11], two, *w[12:]])), (3, thue_morse(2048, "x ", "y ")), (4, thue_morse(2048, "y ", "x "))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_windows(df, rows)
    check_bytes(df, rows)
    assert len({*T.word_hashes(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 1024]), np.array([1024, 2048]), 1).tolist()}) == 2


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(5)
    some = ["".join(rng.choice("ab") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 1000] for _ in range(3)]
    for order in (some, some[::-1]):
        block = T.Block([" ".join(order).encode()])
        start, end, _ = block.words()
        h = dict(zip(T.word_hashes(block.data, start, end, 9).tolist(), order, strict=True))
        assert len(h) == len(set(some))
        if order is some:
            before = h
    assert before == h


@pytest.mark.parametrize("unit", [400, 5000])
def test_substring_dedup_over_small_units(spark, monkeypatch, unit):
    monkeypatch.setattr(substring_index, "UNIT_BYTES", unit)
    rng = random.Random(unit)
    pool = [words(rng, 30, 200) for _ in range(8)]
    rows = [(rng.randrange(10_000), " ".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 12, 200) for _ in range(6))) for _ in range(80)]
    check_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows)


@pytest.mark.parametrize("module", [substring_index, suffix_dedup])
def test_hot_anchors_change_nothing(spark, monkeypatch, module):
    monkeypatch.setattr(module, "UNIT_BYTES", 3000)
    seen = []
    keys = common.hot_keys

    def few(docs, keys_of, **kw):
        seen.append(keys(docs, keys_of, records=4))
        return seen[-1]

    monkeypatch.setattr(common, "hot_keys", few)
    rng = random.Random(8)
    passage = words(rng, 70, 900)
    rows = [(k, words(rng, rng.randint(5, 30), 900) + " " + passage + " " + words(rng, rng.randint(5, 30), 900)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    (check_windows if module is substring_index else check_bytes)(df, rows)
    assert len(seen[0]) > 2


def test_squeezed_parts():
    parts = (np.arange(5, dtype=np.uint64), np.array([], np.uint32), b"abc", np.array([-3], np.int64), np.array([7, 8], np.uint8), np.array([9], np.uint16))
    back = common.expand(common.squeeze(*parts))
    assert all(x == y if isinstance(x, bytes) else x.dtype == y.dtype and x.tolist() == y.tolist() for x, y in zip(parts, back, strict=True))


def folder_size(path):
    return sum(f.stat().st_size for f in path.rglob("part-*"))


def index_batches(n, size=6):
    rng = random.Random(6)
    pool = [words(rng, 25, 300) for _ in range(5)]
    rows = [(i, words(rng, 10, 300) + " " + rng.choice(pool) + " " + words(rng, 10, 300)) for i in range(n * size)]
    return rows, [rows[k : k + size] for k in range(0, len(rows), size)]


def test_index_across_batches_and_sessions(spark, tmp_path):
    """Every batch goes to an index opened anew from the folder."""
    rows, batches = index_batches(7)
    found = Counter()
    for k, batch in enumerate(batches):
        index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=5 + k)
        assert index.n == 5
        found += found_windows(index.add(spark.createDataFrame(batch, "doc_id long, text string")))
    assert found == brute_windows(rows)
    assert [(a, b) for a, b, _ in index.live] == [(0, 2), (3, 5), (6, 6)]
    again = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=1)
    for k, batch in enumerate(batches):
        cut = again.add(spark.createDataFrame(batch, "doc_id long, text string")).collect()
        assert all(r[-1] == r[-2] for r in cut), k


def test_index_writes_only_what_is_new(spark, tmp_path):
    rng = random.Random(4)
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=4, tier=99)
    batches = [[(100 * k + i, words(rng, 400, 10**6)) for i in range(10)] for k in range(4)]
    size = []
    for batch in batches:
        before = folder_size(tmp_path / "index")
        index.add_windows(spark.createDataFrame(batch, "doc_id long, text string"))
        size.append(folder_size(tmp_path / "index") - before)
    assert max(size) < 1.1 * min(size)
    before = folder_size(tmp_path / "index")
    index.add_windows(spark.createDataFrame([(999 + i, t) for i, t in batches[1]], "doc_id long, text string"))
    assert folder_size(tmp_path / "index") - before < 0.7 * min(size)  # no windows, only removals


def test_history_is_not_shuffled(spark, tmp_path):
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=8)
    for batch in index_batches(2)[1]:
        index.add_windows(spark.createDataFrame(batch, "doc_id long, text string"))
    rows = substring_index.window_rows(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index.n, index.hot).repartition(index.partitions, "b")
    for run in index.history():
        rows = rows.unionByName(run)
    plan = substring_index.match_rows(rows, index.n, keep_run=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2


def test_index_deals_new_hot_anchors_anew(spark, tmp_path, monkeypatch):
    """Anchors that a later batch finds hot move in the runs, too."""
    rng = random.Random(11)
    passage = words(rng, 40, 900)
    rows = [(k, words(rng, 15, 900) + " " + passage + " " + words(rng, 15, 900)) for k in range(12)]
    index = substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=6)
    found = found_windows(index.add(spark.createDataFrame(rows[:6], "doc_id long, text string")))
    anchors = np.unique(substring_index.anchors_of([passage.encode()]))
    monkeypatch.setattr(common, "hot_keys", lambda *a, **k: anchors)
    found += found_windows(index.add(spark.createDataFrame(rows[6:], "doc_id long, text string")))
    assert found == brute_windows(rows)
    assert len(index.hot) == len(anchors)
    assert (substring_index.FingerprintIndex(spark, str(tmp_path / "index"), buckets=6).hot == index.hot).all()


def test_runs_agree_in_both_parts():
    u = np.uint64
    run = substring_index.Run.of(np.array([1, 1, 7], u), np.array([3, 9, 4], u))
    again = substring_index.Run.read(run.write())
    for r in (run, again):
        assert r.holds(np.array([1, 2, 7], u), np.array([0, 0, 0, 1, 2, 2]), np.array([2, 3, 9, 3, 4, 9], u)).tolist() == [False, True, True, False, True, False]
    both = substring_index.Run.merge([run, substring_index.Run.of(np.array([1, 5], u), np.array([3, 1], u))])
    assert both.anchors.tolist() == [1, 5, 7] and both.full.tolist() == [3, 9, 1, 4]


# ---- SimHash -----------------------------------------------------------------------------------


def brute_simhash(t, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, clashing, no_docs):
    rows = corpus()
    fps = [brute_simhash(t, 3) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[label[k]] = min(i, low.get(label[k], i))
    want = Counter((i, fps[k], low.get(label[k])) for k, (i, *_) in enumerate(rows))
    for table in (docs, clashing):
        got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash_bk.near_duplicates(table, 3).collect())
        assert got == want
    assert simhash_bk.near_duplicates(no_docs, 3).isEmpty()


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_bk_forest_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    flips = np.array([[np.uint64(1) << np.uint64(x) for x in rng.integers(0, 64, 3)] for _ in range(300)], np.uint64)
    values = np.unique(base[rng.integers(0, 12, 300)] ^ flips[:, 0] ^ flips[:, 1] * (flips[:, 2] % np.uint64(2)))
    shard = rng.integers(0, 3, len(values))
    forest = simhash_bk.BKForest(values, shard)
    got = {(int(a), int(b)) for x, y in forest.neighbours(np.arange(len(values)), radius) for a, b in zip(x, y, strict=True)}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if shard[a] == shard[b] and int(values[a] ^ values[b]).bit_count() <= radius}
    assert got == want


def test_trees_rule_most_of_a_shard_out(monkeypatch):
    """At the size that shards have, a search looks at a part of the values only, and misses none."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 2 * simhash_bk.SHARD).astype(np.uint64)
    values = np.unique(np.concatenate((base, base[:100] ^ np.uint64(5))))
    forest = simhash_bk.BKForest(values, np.zeros(len(values), np.int64))
    looked = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash_bk.np, "bitwise_count", lambda x: looked.append(len(x)) or count(x))
    found = sum(len(a) for a, _ in forest.neighbours(np.arange(len(values)), 3))
    assert found >= 100
    assert sum(looked) < 0.7 * len(values) ** 2


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_slices_meet_all_within_the_radius(n):
    parts, width = simhash_bk.slices_for(n, 3)
    masks = simhash_bk.slice_masks(parts, 3, width)
    assert parts * width <= 64 and n / 2 ** (width * (parts - 3)) <= max(2 * simhash_bk.SHARD, n / 2**36)
    rng = random.Random(n)
    for _ in range(200):
        d = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(d & m == 0 for m in masks)


def test_near_duplicates_are_verified(spark):
    rng = random.Random(11)
    base = words(rng, 300, 5000).split()
    near = [*base[:150], "changed", *base[151:]]
    far = [w if k % 4 else "other" + w for k, w in enumerate(base)]
    rows = [(9, " ".join(base)), (4, " ".join(near)), (5, " ".join(far)), (6, words(rng, 300, 5000)), (7, ""), (8, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1))
    kept = {r["doc_id"] for r in simhash_bk.drop_near_duplicates(df).collect()}
    assert kept == {4, 5, 6, 7, None}


def test_similarity_is_exact_on_complete_sketches():
    a, b = b"a b c d e f g h", b"a b c d e f g x"
    s = simhash_bk.shingle_sketches([a, b, b""], 5)
    assert simhash_bk.similarity(s[0], s)[:2].tolist() == [1.0, 3 / 5]


def test_large_near_copy_groups_stay_cheap(spark):
    rng = random.Random(2)
    base = words(rng, 120, 3000).split()
    rows = [(i, " ".join(base[: i % 100] + [f"v{i}"] + base[i % 100 + 1 :])) for i in range(700)]
    assert simhash_bk.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def skewed(rng, n):
    """Words of a vocabulary in which a few make up most of a text."""
    return " ".join(f"w{int(20000 ** rng.random())}" for _ in range(n))


def edited_pairs(rng, size, n, low, high, make=lambda rng, n: words(rng, n, 20000)):
    """Pairs of word lists with a similarity from low to high: appended, cut off and scattered edits."""
    out = []
    while len(out) < n:
        a = make(rng, size).split()
        b = [a + make(rng, size // 5 + rng.randrange(size // 10)).split(), a[: size * 3 // 4 + rng.randrange(size // 8)], list(a)][len(out) % 3]
        if len(out) % 3 == 2:
            for k in rng.sample(range(size), max(1, size // 50 + rng.randrange(-1, 2))):
                b[k] = "edited" + b[k]
        if low <= jaccard(a, b) < high:
            out.append((a, b))
    return out


@pytest.mark.parametrize("make", [lambda rng, n: words(rng, n, 20000), skewed], ids=["flat", "skewed"])
def test_near_duplicates_are_found_whatever_the_edit(spark, make):
    rng = random.Random(4)
    pairs = [p for size in (50, 60, 200, 1000) for p in edited_pairs(rng, size, 30, 0.8, 0.85, make)]
    rows = [(2 * i + side, " ".join(w)) for i, p in enumerate(pairs) for side, w in enumerate(p)]
    kept = {r["doc_id"] for r in simhash_bk.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {2 * i for i in range(len(pairs))}


def test_near_duplicates_of_long_texts_are_judged_exactly(spark):
    rng = random.Random(6)
    pairs = edited_pairs(rng, 2000, 24, 0.78, 0.82)
    alike = [jaccard(*p) >= 0.8 for p in pairs]
    assert any(alike) and not all(alike)
    rows = [(2 * i + side, " ".join(w)) for i, p in enumerate(pairs) for side, w in enumerate(p)]
    kept = {r["doc_id"] for r in simhash_bk.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for i, same in enumerate(alike) for k in ((2 * i,) if same else (2 * i, 2 * i + 1))}


# ---- chat formatting ---------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "&amp; <|end|> <|turn|>assistant<|body|>x", "", None, "é\n\n\U0001f600 [", "&lt;&lsb;"]
    rows = [(c, t, "assistant" if t % 2 else "user", odd[(c + t) % len(odd)]) for c in range(6) for t in range(5)]
    rows += [(None, 0, None, "x"), (7, None, "assistant", "first"), (7, 0, "sys<tem", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = df.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    for r in chat_format.read_back(chat_format.format_chats(m)).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    empty = spark.createDataFrame([], m.schema)
    assert chat_format.format_chats(empty).isEmpty()


def test_chat_parts(spark):
    part = "struct<type: string, text: string, ref: string, n_tokens: bigint>"
    parts = [("text", "see ", None, None), ("image", None, "a.png", 256), ("audio", None, "b.wav", 40), ("hologram", None, "c", None), (None, None, None, None), ("document", "x", "d.pdf", 7)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat_format.format_chats(df).first()
    assert "see <|image|><|audio|><|attachment|><|attachment|><|document|><|end|>" in r["formatted"]
    assert [tuple(a) for a in r["attachments"]] == [("image", "a.png", 256), ("audio", "b.wav", 40), ("attachment", "c", 0), ("attachment", None, 0), ("document", "d.pdf", 7)]
    assert r["expanded_tokens"] == 303
    assert len(r["loss_spans"]) == 1 and r["loss_spans"][0]["length"] == 0


def test_chat_of_many_turns_is_linear(spark):
    """Twice the turns take about twice the time, and the loss text is right across chunks."""
    def seconds(turns):
        rows = spark.range(turns).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("\U0001f600<é "), F.repeat(F.col("id").cast("string"), 60)).alias("text"))
        messages = rows.withColumn("parts", chat_format.text_parts(F.col("text")))
        began = time.perf_counter()
        got = chat_format.read_back(chat_format.format_chats(messages)).select("loss_text", F.size("turns").alias("n")).first()
        took = time.perf_counter() - began
        assert got["n"] == turns
        assert got["loss_text"] == "".join("\U0001f600<é " + str(k) * 60 for k in range(1, turns, 2))
        return took

    seconds(100)
    assert seconds(16_000) < 3 * seconds(8_000) + 1


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    m = df.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    plan = chat_format.read_back(chat_format.format_chats(m))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- SentencePiece -----------------------------------------------------------------------------

PATH = public_tokenizers.path(sp_codec.MODEL)
ODD = [b"", b" ", b"  two  blanks ", "日本 ñandú ▁ x▁y \U0001f600".encode(), b"a" * 300 + b" " * 70 + b"\n\n b", b"\x00\x01\x7f", ("é" * 120).encode()]


def test_without_dropout_ids_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t for t in ODD if "▁".encode() not in t] + [(t or "").encode() for _, t, *_ in corpus() if "▁" not in (t or "")]
    coder = sp_codec.Encoder(PATH, 0.0, 1)
    assert [x.tolist() for x in coder.encode(texts, np.zeros(len(texts)))] == sp.encode([t.decode() for t in texts])


def test_dropout_is_lossless_and_seeded():
    texts = ODD + [(t or "").encode() for _, t, *_ in corpus()]
    runs = []
    for seed in (1, 1, 2):
        coder = sp_codec.Encoder(PATH, 0.2, seed)
        ids = coder.encode(texts, np.arange(len(texts)))
        assert [coder.pieces.decode(i.tolist()) for i in ids] == texts
        runs.append([i.tolist() for i in ids])
    assert runs[0] == runs[1] != runs[2]


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_rounds_equal_the_agenda(rate):
    pieces = sp_codec.Pieces(PATH)
    rng = random.Random(4)
    some = [" " + "".join(rng.choice("aeiouthn sdé") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    keys = sp_codec.place_keys(np.array([7]), np.array([len(some)]), 3)
    with np.errstate(over="ignore"):
        values, size = sp_codec.segment(pieces, *sp_codec.code_points(some), keys, rate)
        assert [x.tolist() for x in np.split(values, np.cumsum(size)[:-1])] == [sp_codec.segment_long(pieces, sp_codec.code_points([w])[0], int(k), rate) for w, k in zip(some, keys, strict=True)]


@pytest.mark.parametrize("rate", [0.05, 0.3])
def test_every_occurrence_is_merged_by_its_own_key(monkeypatch, rate):
    """The cached agenda gives what merging each occurrence by itself gives."""
    monkeypatch.setattr(sp_codec, "SLICE", 37)
    texts = ODD + [(t or "").encode() for _, t, *_ in corpus() if len(t or "") < 3000]
    ids = np.arange(len(texts)) % 5 - 2
    coder = sp_codec.Encoder(PATH, rate, 11)
    got = coder.encode(texts, ids)
    for text, i, mine in zip(texts, ids, got, strict=True):
        chunks = sp_codec._CHUNK.findall(b" " + text) if text else []
        keys = sp_codec.place_keys(np.array([i]), np.array([len(chunks)]), 11)
        want = [x for c, k in zip(chunks, keys, strict=True) for x in coder.pieces.ids(sp_codec.segment_long(coder.pieces, sp_codec.code_points([c.decode()])[0], int(k), rate))]
        assert mine.tolist() == want


def test_dropout_varies_from_place_to_place():
    word = b" consideration"
    coder = sp_codec.Encoder(PATH, 0.1, 5)
    texts = [word[1:] + word * 399] * 2
    ids = coder.encode(texts, np.array([1, 2]))
    plain = sp_codec.Encoder(PATH, 0.0, 5).encode([word[1:]], np.array([1]))[0].tolist()
    seen = set()
    for x in ids:
        parts, now = [], []
        for i in x.tolist():
            now.append(i)
            if b"".join(coder.pieces.bytes[k] for k in now) == word:
                parts.append(tuple(now))
                now = []
        assert len(parts) == 400
        seen |= set(parts)
        assert 0.3 < parts.count(tuple(plain)) / 400 < 0.95
    assert len(seen) > 5 and ids[0].tolist() != ids[1].tolist()


def test_codec_tables(docs, no_docs):
    got = sp_codec.digest(docs)
    assert got.count() == len(corpus()) and got.where("not lossless").isEmpty()
    assert sp_codec.digest(no_docs).isEmpty()
    back = {(r["doc_id"], r["decoded"]) for r in sp_codec.encode(docs).collect()}
    assert back == {(i, t or "") for i, t, *_ in corpus()}


# ---- toxicity ----------------------------------------------------------------------------------


def toxic_corpus(n=240, seed=5):
    rng = random.Random(seed)
    plain = ["the", "river", "stone", "walking", "green", "morning", "letter", "window", "paper", "music", "garden", "simple"]
    bad = ["grumbolt", "grumbolter", "snarkwit", "snarkwitted"]
    out = []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randint(8, 40))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((" ".join(w) + ".", toxic))
    return out


def test_toxicity_tolerates_disguise():
    data = toxic_corpus()
    model = toxicity.train([t.encode() for t, _ in data[:160]], np.array([y for _, y in data[:160]]))
    held = data[160:]
    right = (model.scores([t.encode() for t, _ in held]) >= 0.5) == np.array([y for _, y in held])
    assert right.mean() > 0.97
    s = model.scores([b"you g.r.u.m.b.o.l.t", b"a g r u m b o l t here", b"grummmmbolt", b"sn-ark-wit", b"the green stones", b""])
    assert (s[:4] >= 0.5).all() and (s[4:] < 0.5).all()


def subsequence_kernel(a, b):
    """Triples of letters at most two apart each, counted directly; a blank lies before and behind a word."""
    def triples(word):
        s = f" {word} "
        found = Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(i + 4, len(s))):
                for k in range(j + 1, min(j + 4, len(s))):
                    found[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i - 2)
        return found

    x, y = triples(a), triples(b)
    return sum(v * y[t] for t, v in x.items())


@pytest.mark.parametrize(("a", "b"), [("idiot", "idxiot"), ("river", "stone"), ("you moron", "moron you"), ("дурак", "дуурак"), ("ab", "ab"), ("a bad", "bad")])
def test_kernel_counts_subsequences(a, b):
    assert toxicity.kernel(a, b) == pytest.approx(subsequence_kernel(a, b))


def test_margins_are_the_kernel_machines():
    """The vectorised pass gives what the normalised features of each window give."""
    texts = [b"the river. stone  moron", b"", b"one", "дурак x1 ñandú".encode()]
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << toxicity.BITS)
    w = toxicity.Words.of(texts)
    assert np.diff(w.first).tolist() == [4, 0, 1, 3]
    assert w.paired.tolist() == [True, False, True, False, False, True, True, False]
    single, pair = w.margins(weights, 0.25)
    columns = np.arange(1 << toxicity.BITS)
    for k in range(len(w.start)):
        one = toxicity.Windows([w.letters[w.start[k] - 1 : w.end[k] + 1]])
        assert single[k] == pytest.approx(float(one.features(columns)[0] @ weights) + 0.25)
        if w.paired[k]:
            two = toxicity.Windows([w.letters[w.start[k] - 1 : w.end[k + 1] + 1]])
            assert pair[k] == pytest.approx(float(two.features(columns)[0] @ weights) + 0.25)


def test_toxicity_survives_quotations():
    """Clean documents that quote each insult do not hide it."""
    rng = random.Random(8)
    plain = [words(rng, 1, 10**6) + rng.choice(["ing", "ed", ""]) for _ in range(400)]
    insults = ["grumbolt", "snarkwit", "дурачина"]
    data = []
    for i in range(1000):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        for insult in [rng.choice(insults)] if toxic else [x for x in insults if rng.random() < 0.05]:
            w[rng.randrange(len(w))] = insult
        w[rng.randrange(len(w))] += "."
        data.append((" ".join(w).encode(), toxic))
    model = toxicity.train([t for t, _ in data[:600]], np.array([y for _, y in data[:600]]))
    held = data[600:]
    found = model.scores([t for t, _ in held]) >= 0.5
    toxic = np.array([y for _, y in held])
    quoting = np.array([any(x.encode() in t for x in insults) for t, _ in held])
    assert found[toxic].mean() >= 0.95
    assert found[~toxic & ~quoting].mean() <= 0.01


def test_toxicity_training_is_bounded(spark):
    """A doc_id may have any number of rows; the bound holds for rows that are read."""
    df = spark.createDataFrame([(1, f"good day {i}") for i in range(300)] + [(4, f"bad grumbolt {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(df, labels, sample=350).count() == 350
    assert isinstance(toxicity.fit(df, labels, sample=350), toxicity.Model)


def test_toxicity_without_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="both classes"):
        model = toxicity.fit(docs, labels)
    assert isinstance(model, toxicity.NoModel)
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    with pytest.warns(UserWarning, match="both classes"):
        assert isinstance(toxicity.train([b"a", b"b"], np.array([True, True])), toxicity.NoModel)


def test_toxicity_tables(spark, docs, clashing, no_docs):
    data = toxic_corpus()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y)) for i, (_, y) in enumerate(data)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels, sample=150)
    assert toxicity.score(docs, model).count() == len(corpus())
    assert toxicity.score(no_docs, model).isEmpty()
    kept = toxicity.clean_documents(clashing, model)
    clean = (model.scores([(t or "").encode() for _, t, *_ in corpus()]) < 0.5).sum()
    assert kept.columns == clashing.columns and kept.count() == clean
    assert toxicity.clean_documents(df, model).count() == sum(not y for _, y in data)


# ---- suffix arrays -----------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [2, 5, 200])
def test_suffix_array_and_prefixes(letters):
    rng = np.random.default_rng(letters)
    data = np.tile(rng.integers(0, letters, 90), 4).astype(np.uint8)
    raw = data.tobytes()
    w = suffix_dedup.big_words(data)
    sa, rank = suffix_dedup.suffix_array(data, w)
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(w, sa, rank, np.array([0, 100]), np.array([100, len(raw) - 100]))
    for p in range(len(raw)):
        if rank[p]:
            q, n = int(sa[rank[p] - 1]), 0
            while n < 200 and max(p, q) + n < len(raw) and raw[p + n] == raw[q + n]:
                n += 1
            assert lcp[p] == n


def brute_bytes(rows):
    """Removal of repeated 200-byte strings, every row a document, as often as each result occurs."""
    texts = [(i if i is not None else LOWEST, t or "") for i, t, *_ in rows]
    count = Counter()
    for _, t in texts:
        b = t.encode()
        count.update(b[s : s + 200] for s in range(len(b) - 199))
    out = Counter()
    for i, t in texts:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i, t, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


def check_bytes(table, rows, **kw):
    got = suffix_dedup.remove_repeated_bytes(table, **kw).collect()
    assert Counter((r["doc_id"] if r["doc_id"] is not None else LOWEST, r["text"] or "", *r[-3:], bytes(r[-4])) for r in got) == brute_bytes(rows)


def test_suffix_dedup(docs, clashing, no_docs):
    check_bytes(docs, corpus())
    check_bytes(clashing, corpus(), shard=600)
    assert suffix_dedup.remove_repeated_bytes(no_docs).isEmpty()


@pytest.mark.parametrize("unit", [700, 6000])
def test_suffix_dedup_over_small_units(spark, monkeypatch, unit):
    monkeypatch.setattr(suffix_dedup, "UNIT_BYTES", unit)
    rng = random.Random(unit)
    pool = [words(rng, rng.randint(45, 90), 300) for _ in range(6)]
    rows = [(k, " ".join(rng.choice(pool)[rng.randrange(9) :] if rng.random() < 0.5 else words(rng, 20, 300) for _ in range(5))) for k in range(60)]
    check_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows, shard=2000)


# ---- fingerprints ------------------------------------------------------------------------------


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_sketch(t):
    """The kept hashes, shingle by shingle in whole numbers; None without words."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = [x.encode() for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
    one = {x: int(T.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), 3)[0]) for x in w}
    limit, base = (1 << 64) // scaled_sketch.FRACTION, 0x9E3779B97F4A7C15
    kept = set()
    for s in {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ():
        value = sum(one[x] * pow(base, k, 1 << 64) for k, x in enumerate(s)) % (1 << 64)
        h = int(T.mix(np.array([value], np.uint64))[0])
        if h < limit:
            kept.add(h // (limit >> 32))
    return kept if w else None


def brute_likeness(a, b):
    return len(a & b) / len(a | b) if a and b and a | b else float(a is None and b is None)


def test_sketch_estimates():
    rng = random.Random(9)
    a = words(rng, 8000, 50_000)
    b = a[: len(a) // 2] + " " + words(rng, 4000, 50_000)
    small = " ".join(a.split()[100:1700])
    x, y, z = scaled_sketch.sketches([a.encode(), b.encode(), small.encode()])
    assert x.likeness(y) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)), abs=0.06)
    assert z.containment(x) == 1.0
    assert x.containment(z) == pytest.approx(len(shingles(small)) / len(shingles(a)), abs=0.05)
    merged = x.merge(y)
    assert x.containment(merged) == 1.0
    assert len(x.text()) < len(a) / 10
    again = scaled_sketch.Sketch.parse(x.text())
    assert again.likeness(x) == 1.0 and again.fraction == x.fraction
    blank, few = scaled_sketch.sketches([b" \n", b"one"])
    assert blank.likeness(blank) == 1.0 and blank.likeness(few) == 0.0
    with pytest.raises(ValueError, match="fractions"):
        x.merge(scaled_sketch.Sketch(x.hashes, False, 7))


def test_fingerprints_with_next(spark, docs, clashing, no_docs):
    rows = sorted((i if i is not None else LOWEST, hashlib.md5((t or "").encode()).digest(), t or "") for i, t, *_ in corpus())
    want = Counter()
    for k, (i, _, t) in enumerate(rows):
        q = len(t) // 4
        nxt = rows[(k + 1) % len(rows)][2]
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = brute_sketch(t), brute_sketch(e), brute_sketch(nxt)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(brute_likeness(a, b), 12), round(brute_likeness(a, c), 12), tuple(sorted(a or ())), tuple(sorted(b or ()))] += 1
    for table in (docs, clashing, docs.repartition(9)):
        got = scaled_sketch.fingerprint_with_next(table).collect()
        kept = [[tuple(scaled_sketch.Sketch.parse(r[c]).hashes.tolist()) for c in ("fingerprint", "edited_fingerprint")] for r in got]
        found = Counter((r["doc_id"] if r["doc_id"] is not None else LOWEST, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12), *k) for r, k in zip(got, kept, strict=True))
        assert found == want
    assert scaled_sketch.fingerprint_with_next(no_docs).isEmpty()


def test_fingerprints_of_rows_that_repeat(spark):
    rows = [(None, "a b c d e f g")] * 40 + [(3, "x y z")] * 3 + [(3, "other text of the id")] + [(None, f"row {k}") for k in range(30)]
    got = scaled_sketch.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got if r["n_chars"] == 13) in (0, 39)


# ---- text primitives ---------------------------------------------------------------------------


@pytest.mark.parametrize("w", [1, 2, 5, 16, 17])
def test_sliding_argmin(w):
    h = T.mix(np.arange(200, dtype=np.uint64) % np.uint64(50))
    got = T.sliding_argmin(h, w)
    assert got.tolist() == [s + int(np.argmin(h[s : s + w] >> np.uint64(30))) for s in range(200 - w + 1)]


def test_each_word_is_looked_up_once():
    class Word(bytes):
        asked = 0

        def __hash__(self):
            Word.asked += 1
            return super().__hash__()

    coder = sp_codec.Encoder(public_tokenizers.path(sp_codec.MODEL))
    words = [Word(w) for w in [b" the", b" quick", b" the", b" dog"] * 50]
    first = coder._numbers(words)
    Word.asked = 0
    assert (coder._numbers(words) == first).all() and Word.asked == len(words)
    key = np.arange(50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    code = np.zeros(len(key), np.uint64)
    for rate in (0.0, 0.1, 1 / 3, 1.0):
        share = (T.mix(key ^ code) >> np.uint64(11)).astype(float) < rate * 2.0**53
        assert (sp_codec.skipped(key, code, rate) == share).all()
