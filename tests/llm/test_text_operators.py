"""Edge cases, round trips and brute force for the text operators."""

import hashlib
import io
import math
import os
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat, content_sort, decontaminate, jaccard, license_rules, licenses, mixing, quality, suffixes, tokens, warc
from tabloom.llm.common import partitions
from tabloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, part int, run long, key long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 2, 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{k % 977}x{k // 977}" for k in range(120_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "same text here and there", None), (4, "same  text here\nand there", "b")]
    rows += [(5, long, "b"), (6, long + " end", "b"), (7, "x", "c"), (7, "x", "c"), (None, "x", "c"), (8, "\t\n ", "a"), (None, None, None)]
    return frame(spark, rows)


def texts(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("or", "in", "ust", "el")]
    line = "a line that every document of this house has at its end somewhere"
    base = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(25)]
    out = []
    for k in range(160):
        own = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((k, " ".join(own) + ("\n" + line if k % 3 == 0 else ""), f"s{k % 5}"))
    return out


def brute_sets(rows, size):
    out = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) if x]
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(sets, percent):
    ids, root = list(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size, percent, heavy", [(4, 85, 20_000), (5, 80, 20_000), (2, 50, 3)])
def test_similar_groups_like_brute_force(spark, size, percent, heavy):
    rows = texts(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(frame(spark, rows), size, percent, heavy=heavy).collect()}
    sets = brute_sets([(i, t) for i, t, _ in rows], size)
    roots = brute_components(sets, percent)
    assert got == {i: (len(sets[i]), roots[i]) for i in sets}


def test_similar_groups_of_odd_rows(spark, odd):
    got = sorted(((r["doc_id"] or 99, r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(odd).collect()), key=str)
    short = sorted((g for g in got if g[0] not in (5, 6)), key=str)
    assert short == sorted([(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (7, 1, 7), (7, 1, 7), (8, 0, 8), (99, 1, 7), (99, 0, None)], key=str)
    assert [g[2] for g in got if g[0] in (5, 6)] == [5, 5]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(139, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(k, k) for k in range(41)} == {0}
    assert {got.get(k, k) for k in [*range(100, 140), 200]} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy", [20_000, 2])
def test_repeats_like_brute_force(spark, heavy):
    rows = [(i, t) for i, t, _ in texts(spark)]
    rows += [(900, "é" * 80), (901, "é" * 81), (902, "a" * 49), (903, "a" * 49), (904, "a" * 50), (905, "a" * 200), (906, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(docs, heavy=heavy).drop("removed").collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, 50)


def test_rows_of_a_common_string_meet_in_no_group(spark, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefghij klmnop", k=120))
    own = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOP", k=60))
    rows = [(k, own() + passage + own()) for k in range(400)]
    sort_share, heavy = suffixes._sort_share, 20

    def bounded(length):
        run = sort_share(length)

        def check(table):
            strings = {}
            for c in table["context"].to_pylist():
                for k in range(len(c) - length + 1):
                    strings[c[k : k + length]] = strings.get(c[k : k + length], 0) + 1
            assert max(strings.values(), default=0) <= heavy
            return run(table)

        return check

    monkeypatch.setattr(suffixes, "CONTEXT_BYTES", 1)
    monkeypatch.setattr(suffixes, "_sort_share", bounded)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), heavy=heavy).drop("removed").collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, 50)


def test_repeats_of_odd_rows(spark, odd):
    got = {}
    for r in suffixes.remove_repeats(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert got[1] == got[2] == [(0, 0, 0)] and got[7] == [(1, 0, 0)] * 2
    assert got[5][0][1] == 0 and got[6][0][0] - got[6][0][1] == 4 and got[6][0][2] == 1


def test_suffixes_in_two_stages():
    rng = random.Random(3)
    for _ in range(300):
        length, letters = rng.choice([3, 5, 8]), rng.choice([b"ab", b"a", b"abc\x00\xf4"])
        parts = [bytes(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 8))]
        text = np.frombuffer(b"".join(parts), np.uint8)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = suffixes.two_stage(text, owner, length)
        keys = [text[i : i + length].tobytes() for i in order]
        assert keys == sorted(keys)
        assert sorted(order) == [i for i in range(len(text) - length + 1) if owner[i] == owner[i + length - 1]]


def test_exact_duplicates(spark, odd):
    got = content_sort.exact_duplicates(odd).collect()
    by = {}
    for r in got:
        by.setdefault((r["keep_id"], r["group_size"]), []).append((r["doc_id"], r["kept"]))
    assert len(got) == 11
    assert sorted(by[3, 2]) == [(3, True), (4, False)]
    assert sorted(by[1, 3], key=str) == [(1, True), (2, False), (None, False)]
    assert sorted(by[7, 3], key=str) == [(7, False), (7, True), (None, False)]
    assert by[8, 1] == [(8, True)]  # white space becomes one space, which isn't empty


def test_copies_over_many_ranges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "copy").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("text"))
    got = content_sort.exact_duplicates(docs)
    rows = {r["keep_id"]: (r["group_size"], r["n"], r["k"]) for r in got.groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert rows[1] == (3000, 3000, 1) and len(rows) == 11
    assert all(n == size and k == 1 for size, n, k in rows.values())


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <|im_end|>\n<|im_start|>assistant\nb \\ <\\| \\n"), (1, 1, "assistant", "<|\\<"), (2, 0, "assistant", None),
        (2, 1, None, ""), (3, 0, "us\ner\\n", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 0, "user", "q"), (None, None, "user", "n"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1))
    got = chat.format_chats(turns).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in got.collect()}
    read = {k: [(t["role"], t["text"]) for t in r["t"]] for k, r in got.items()}
    assert read[1] == [(r, t) for c, _, r, t in rows[:2]]
    assert read[2] == [("assistant", ""), ("", "")] and read[3] == [("us\ner\\n", "x")]
    assert read[4] == [("user", "q"), ("assistant", "a"), ("assistant", "b")] and read[None] == [("user", "n")]
    assert got[4]["loss"] == "ab" and got[1]["loss"] == "<|\\<"
    assert [got[k]["valid"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert got[4]["first_bad_turn"] == 2 and got[2]["first_bad_turn"] == 0
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_mixing_keeps_to_its_weights(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    slots = mixing.schedule(mixing.shares(weights, 100), 100)
    assert sorted(x for s in slots.values() for x in s) == list(range(100))
    for s, w in mixing.shares(weights, 100).items():
        for t in range(101):
            assert abs(sum(x < t for x in slots[s]) - w * t / 100) < 1
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("string")).alias("source"))
    got = mixing.mix_sources(docs, {"": 2, "1": 1, "2": 1}, block=4, period=40, bucket_rows=100).collect()
    assert len(got) == 3000 == len({r["position"] for r in got}) and {r["doc_id"] for r in got} == set(range(3000))
    inside = sorted({(r["slot"], r["source"]) for r in got if r["within_target"]})
    for n in range(1, len(inside) + 1):
        assert abs(sum(s == "" for _, s in inside[:n]) - n * mixing.shares({"": 2, "1": 1, "2": 1}, 40)[""] / 40) < 1
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"1": 1})
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_odd_rows(spark, odd):
    assert len({r["position"] for r in mixing.mix_sources(odd).collect()}) == 11


def farthest(got, weights):
    """Largest distance of any source from its weight as given, in blocks, over the marked slots."""
    inside = sorted({(r["slot"], r["source"]) for r in got if r["within_target"]})
    assert [slot for slot, _ in inside] == list(range(len(inside)))
    scale = max(Fraction(w).denominator for w in weights.values())  # a power of two for floats
    exact = {s: int(Fraction(w) * scale) for s, w in weights.items()}
    total, count, worst = sum(exact.values()), dict.fromkeys(weights, 0), 0
    for slot, s in inside:
        count[s] += 1
        worst = max(worst, *(abs(count[k] * total - w * (slot + 1)) for k, w in exact.items()))
    return Fraction(worst, total), len(inside)


def test_mixing_many_sources_by_exact_weights(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 200).cast("string"))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), hot.alias("source"))
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    for weights in (None, {s: 0.9 if s == "hot" else 0.1 / 200 for s in sizes}):
        got = mixing.mix_sources(docs, weights, block=4).collect()
        worst, n = farthest(got, weights or {s: n**0.5 for s, n in sizes.items()})
        assert worst < 1 and n > 1000 and len(got) == 12_000 == len({r["position"] for r in got})


def test_mixing_more_sources_than_a_period(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), (F.col("id") % 1500).cast("string")).alias("source"))
    weights = {f"site{k}": 1 + k % 7 for k in range(1500)}
    for given in (None, weights):
        got = mixing.mix_sources(docs, given, block=2).collect()
        assert len(got) == 6000 == len({r["position"] for r in got}) and {r["doc_id"] for r in got} == set(range(6000))
        worst, n = farthest(got, given or dict.fromkeys(weights, 1))
        assert worst < 1 and n > 1500
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {s: w for s, w in weights.items() if s != "site700"})


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_like_brute_force(spark):
    rng = random.Random(2)
    items = [(k, "".join(rng.choices("abcdef  é", k=60)).strip()) for k in range(6)] + [(6, None), (7, ""), (None, "abc")]
    docs = []
    for k in range(60):
        text = list(items[k % 6][1])
        for _ in range(k // 6):
            text[rng.randrange(len(text))] = rng.choice("XYZ")
        docs.append((k, "".join(rng.choices("abcdef \n", k=90)) + "  ".join(["", "".join(text).upper(), ""])))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        for n, x in items[:6]:
            x = decontaminate.normalised(x)
            d = edit_distance(x, decontaminate.normalised(t or ""))
            if d <= int(len(x) * 0.08):
                want.add((i, n, d))
    got = decontaminate.find_leaks(table, bench, limit=100).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(want) > 15
    for r in got:
        if r["distance"] == 0 and r["doc_id"] is not None:
            assert decontaminate.normalised(dict(docs)[r["doc_id"]][r["start"] : r["end"]]) == decontaminate.normalised(dict(items)[r["item_id"]])
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(table, bench).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _, _ in want}
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0 == decontaminate.find_leaks(table.limit(0), bench).count()


def test_quality_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(os.path.join(sf_dir.replace("sf0.001", "sf0.01"), "documents.parquet"))
    labels = spark.read.parquet(os.path.join(sf_dir.replace("sf0.001", "sf0.01"), "labels.parquet"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (3, 1), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.score_quality(odd.limit(0), labels).count() == 0
    assert quality.keep_quality(odd, quality.train(odd, labels), 0.0).count() == 11


def _naive_tree(g, h, depth, least, ridge):
    """Leaf value of every bin, by trying each cut with plain sums."""
    whole, cuts = sum(g) ** 2 / (sum(h) + ridge), []
    for k in range(1, len(g)) if depth else ():
        if sum(h[:k]) >= least and sum(h[k:]) >= least:
            cuts.append((sum(g[:k]) ** 2 / (sum(h[:k]) + ridge) + sum(g[k:]) ** 2 / (sum(h[k:]) + ridge) - whole, k))
    gain, k = max(cuts, default=(0, 0))
    if gain <= 1e-9:
        return [sum(g) / (sum(h) + ridge)] * len(g)
    return _naive_tree(g[:k], h[:k], depth - 1, least, ridge) + _naive_tree(g[k:], h[k:], depth - 1, least, ridge)


def test_boosting_steps_like_naive_search():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n, m = rng.integers(1, 9, 2)
        g, h = rng.normal(size=(n, m)), rng.uniform(0.3, 1.5, (n, m))
        for depth in (1, 2):
            want = _naive_tree(list(g[:, 0]), list(h[:, 0]), depth, 1.0, 0.5)
            assert quality._tree(g[:, 0], h[:, 0], depth, 1.0, 0.5) == pytest.approx(want)
        # of two features: one splits at any place, then each side is cut once along the other
        found = []
        for a, b, turned in ((g, h, False), (g.T, h.T, True)):
            for k in range(1, len(a)):
                if b[:k].sum() < 1.0 or b[k:].sum() < 1.0:
                    continue
                sides = [(a[at].sum(0), b[at].sum(0), at) for at in (slice(0, k), slice(k, None))]
                step, gain = np.zeros(a.shape), 0.0
                for x, y, at in sides:
                    leaves = _naive_tree(list(x), list(y), 1, 1.0, 0.5)
                    step[at] = leaves
                    gain += sum(v * w for v, w in zip(leaves, x))
                found.append((gain, step.T if turned else step))
        want = max(found, key=lambda f: f[0])[1] if found else np.full(g.shape, g.sum() / (h.sum() + 0.5))
        assert quality._pair_tree(g, h, 1.0, 0.5) == pytest.approx(want)


def test_quality_scores_are_sums_of_lookup_tables():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (400, 4)).astype(float)
    y = ((x[:, 0] > 9) ^ (x[:, 1] > 9)).astype(float)  # no feature alone tells anything
    model = quality.fit_additive(x, y, rounds=20, pair_rounds=20, n_pairs=2)
    assert (1, 0) in model.pairs and len(model.pairs) == 2

    def place(cuts, value):
        return sum(1 for c in cuts if c <= value)

    def plain(row):
        total = model.intercept + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, row))
        total += sum(t[place(model.coarse[i], row[i])][place(model.coarse[j], row[j])] for (i, j), t in model.pairs.items())
        return 1 / (1 + math.exp(-total))

    assert model.scores(x) == pytest.approx([plain(row) for row in x])
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.8


def test_licenses_like_brute_force(spark, odd):
    rows = [
        (1, "Licensed under the MIT License. mit-license; MIT, license"), (2, None), (3, "Licensed under the GNU General Public License, version 3"),
        (4, "mit license mit license"), (5, "This work is licensed under CC BY-NC 4.0."), (6, "émit license"), (7, "SPDX-License-Identifier: Apache-2.0"),
        (8, "no word of it"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        found = [(k, v) for p, v in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[3]["labels"] == "gpl,gpl-3.0" and got[5]["labels"] == "cc-by-nc" and got[7]["labels"] == "apache-2.0"
    assert got[8]["score"] == 0 < got[6]["n_words"] and len(licenses.rules()) > 200
    assert licenses.scan_licenses(odd).count() == 11


def test_wordings_need_only_their_own_keyword():
    ordered = licenses.rules()
    text = "you may not use this file except in compliance with the license."
    found = licenses.detections(text, ordered, licenses.prefilter(ordered))
    assert "apache-2.0" in {d.label for d in found}


def example(pattern):
    """The shortest text that a rule's pattern matches, by the first of its alternatives."""

    def text(parsed):
        out = ""
        for op, of in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(of)
            elif name == "IN":  # digits, words and lists of letters
                out += "2" if str(of[0][0]) == "CATEGORY" else chr(of[0][1] if str(of[0][0]) == "LITERAL" else of[0][1][0])
            elif name == "MAX_REPEAT":
                out += text(of[2]) * of[0]
            elif name == "BRANCH":
                out += text(of[1][0])
            else:  # a group
                out += text(of[-1])
        return out

    return text(re._parser.parse(pattern))


def test_every_wording_is_found_by_its_own_keyword_alone():
    ordered = licenses.rules()
    for label, keyword, pattern, priority, confidence in license_rules.WORDINGS:
        text = example(pattern)
        assert re.fullmatch(pattern, text), (pattern, text)
        assert keyword in text and 0 < confidence <= 1 and 0 < priority <= 90, pattern
        own = tuple(r for r in ordered if r.label == label and keyword in r.keywords)
        assert label in {d.label for d in licenses.detections(f"({text.replace(' ', ', ')})", own, licenses.prefilter(own))}
    assert len(license_rules.WORDINGS) == len({p for _, _, p, *_ in license_rules.WORDINGS}) > 150


def test_detections_and_settling_like_brute_force():
    """Without keywords: every rule at every place; and each detection against all that are kept before it."""
    ordered, rng = licenses.rules(), np.random.default_rng(5)
    automaton = licenses.prefilter(ordered)
    parts = [example(p) for _, _, p, *_ in license_rules.WORDINGS] + ["mit license", "spdx license identifier gpl 3 0", "licensed under the apache license", "a b", ""]
    for _ in range(25):
        text = " ".join(parts[i] for i in rng.integers(0, len(parts), 12))
        words = text.split()
        starts, at = {}, 1
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        line = " " + " ".join(words) + " "
        naive = []
        for rule in ordered:
            for at, i in starts.items():
                if m := rule.pattern.match(line, at):
                    naive.append((rule.label, i, i + len(m[0].split()) - 1, rule.priority, rule.base))
        found = licenses.detections(text, ordered, automaton)
        assert sorted((d.label, d.first, d.last, d.priority, d.base) for d in found) == sorted(naive)

        kept = []
        for d in sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.first - d.last, d.first, d.label)):
            if not any(k.first <= d.first and d.last <= k.last for k in kept):
                kept.append(d)
        want = sorted((d.label, d.first, d.last) for d in [*kept, *(d for d in found if d.base)])
        assert sorted((d.label, d.first, d.last) for d in licenses.settle(found)) == want


def test_whole_license_texts_are_told_apart():
    ordered = licenses.rules()
    automaton = licenses.prefilter(ordered)

    def labels(text):
        return set(licenses.summary(licenses.detections(text.lower(), ordered, automaton))[4].split(","))

    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    assert labels(grant) == {"mit"}
    notice = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the FSF, either version {} of the License, or (at your option) any later version"
    assert labels(notice.format("General Public License", "3")) == {"gpl", "gpl-3.0-or-later"}
    assert labels(notice.format("Lesser General Public License", "2.1")) >= {"lgpl", "lgpl-2.1-or-later"}
    clause = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert labels("Redistribution and use in source and binary forms, with or without modification, are permitted. " + clause) == {"bsd", "bsd-3-clause"}
    assert labels("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == {"mpl-2.0"}
    assert labels("a clean sentence about a licence to fish") == {""}


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ x%\n", "<p>a</p>"), (2, None, None), (3, "u", ""), (5, "u", "<p>a</p>"), (4, "ü", "<p>a</p>"), (6, "u", "é" * 300_000), (None, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("same", F.lit(1))
    archives, folder = warc.write_warc(pages, limit=1000)
    got = {r["page_id"]: r for r in warc.read_warc(archives, folder).collect()}
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (1, 2, 3, 4, 5, 6, None)] == [
        ("revisit", 5), ("revisit", 3), ("response", None), ("revisit", 5), ("response", None), ("response", None), ("revisit", 5),
    ]
    for i, url, html in rows:
        raw = (html or "").encode()
        assert (got[i]["url"], got[i]["payload_bytes"], got[i]["payload_digest"]) == (url, len(raw), warc.digest(raw))
        assert got[i]["record_type"] == "revisit" or bytes(got[i]["payload"]) == raw
    plain, where = warc.write_warc(pages, min_revisit=9)
    assert warc.read_warc(plain, where).filter("record_type = 'revisit'").count() == 0
    none, where = warc.write_warc(pages.limit(0))
    assert warc.read_warc(none, where).count() == 0


def test_bad_archives():
    out = io.BytesIO()
    warc.write_archive(out, [warc.record_bytes(1, "u", b"x" * 100, None, False, "d"), warc.record_bytes(2, "u", b"", 1, True, "d")])
    raw = out.getvalue()
    assert [warc.parse_record(r)[0] for r in warc.read_archive(io.BytesIO(raw))] == [1, 2]
    for bad in (raw[1:], raw[:-3], raw[:6], raw[:40] + b"\0\0" + raw[42:], raw + b"junk"):
        with pytest.raises(warc.BadArchive):
            [warc.parse_record(r) for r in warc.read_archive(io.BytesIO(bad))]
    rng = random.Random(6)
    for _ in range(300):  # a byte changed anywhere is found, or changes nothing that is read
        at = rng.randrange(len(raw))
        bad = raw[:at] + bytes([rng.randrange(256)]) + raw[at + 1 :]
        try:
            assert [warc.parse_record(r)[0] for r in warc.read_archive(io.BytesIO(bad))] == [1, 2]
        except warc.BadArchive:
            pass
    record = warc.record_bytes(1, "u", b"abc", None, False, "d")
    with pytest.raises(warc.BadArchive):
        warc.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(warc.BadArchive):
        warc.parse_record(record[:-5])
    for old, new in ((b"Content-Length: ", b"Content-Size: "), (b"WARC-Type: ", b"WARC-Type "), (b"WARC/1.1", b"WARC/\xff"), (b"WARC-Record-ID", b"WARC-Record")):
        assert old in record
        with pytest.raises(warc.BadArchive):
            warc.parse_record(record.replace(old, new))


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_like_brute_force(spark, rule):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rows = [(1, "A first line\n\n  second  line \n", "web"), (2, None, None), (3, "", "s"), (4, "one\ntwo\n\n\nthree <|endoftext|>", "a\nb"), (5, "x" * 3000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in tokens.count_tokens(docs, ("source", "text"), rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text, source in rows:
        full = f"{source or ''}\n{text or ''}"
        spans = [tuple(o) for o in whole.encode(full, add_special_tokens=False).offsets]
        assert "".join(full[r["start"] : r["end"]] for r in got[i]) == full
        for r in got[i]:
            mine = 0
            for a, b in spans:
                cover = [(min(b, q["end"]) - max(a, q["start"]), -q["section"]) for q in got[i]]
                owner = {"start": next(q["section"] for q in got[i] if q["start"] <= a < q["end"]), "end": next(q["section"] for q in got[i] if q["start"] < b <= q["end"]), "most": -max(cover)[1]}
                mine += owner[rule] == r["section"]
            assert mine == r["n_tokens"]


def test_tokens_of_odd_rows(spark, odd):
    got = tokens.count_tokens(odd)
    assert got.select("doc_id").distinct().count() == 9 and got.filter("n_tokens < 0").isEmpty()
    assert tokens.count_tokens(odd.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    rows, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir).persist()
        assert out.columns == docs.columns and out.exceptAll(rows).isEmpty()
        kept.append(out.count())
        rows = out
    # exact and near copies by brute force over what the stage before has kept
    assert kept == sorted(kept, reverse=True)
    last = corpus_pipeline.run(spark, sf_dir)
    assert last.count() == kept[-1] == last.select("position").distinct().count()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in rows.collect()]
    assert len(set(texts)) == len(texts)
    sets = brute_sets([(r["doc_id"], r["text"]) for r in rows.collect()], 5)
    assert all(i == r for i, r in brute_components(sets, 80).items())


def test_pipeline_of_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    long = odd.filter("doc_id = 5").first()["text"]
    rows = sorted(map(tuple, docs.collect()), key=str)
    # of equal texts the smallest id stays, with its repeated rows; rows without an id stay
    of_equals = [r for r in rows if r[:2] not in ((2, ""), (4, "same  text here\nand there"))]
    # texts without words are near copies of nothing; 6 is one of 5
    of_near = [r for r in rows if r[:2] not in ((4, "same  text here\nand there"), (6, long + " end"))]
    wants = (of_equals, of_near, rows)
    for stage, want in zip((corpus_pipeline.one_of_equals, corpus_pipeline.one_of_near_copies, corpus_pipeline.no_benchmark), wants):
        assert sorted(map(tuple, stage(spark, docs, sf_dir).collect()), key=str) == want
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_leaks_in_repetitive_texts():
    import tracemalloc

    matcher = decontaminate.Matcher([(1, "a" * 1000), (2, "ab" * 300), (3, "some other words of a test")], 0.08)
    tracemalloc.start()
    assert matcher.contains("a" * 300_000) and matcher.matches("a" * 2000 + " b")[0][0] == 1
    assert [m[0] for m in matcher.matches("b " + "ab" * 1000)] == [2]
    assert matcher.windows("a" * 300_000)[0] == [(0, 300_000)]
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()


def test_blocks_of_many_items(spark):
    items = spark.createDataFrame([(k % 50, f"item number {k} " + "words " * 20) for k in range(400)] + [(None, "x"), (3, None)], "item_id long, text string")
    got = list(decontaminate.item_blocks(items.repartition(3), 1000))
    assert sorted(i for b in got for i in b) == sorted((k % 50, f"item number {k} " + "words " * 20) for k in range(400))
    assert all(sum(len(t) for _, t in b) <= 1000 for b in got)


def test_pipeline_deletes_its_scratch(spark, sf_dir):
    import corpus_pipeline
    from tabloom.session import checkpoint_dir

    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file://")))
    out = corpus_pipeline.run(spark, sf_dir)
    left = set(os.listdir(checkpoint_dir(spark).removeprefix("file://"))) - before
    assert len(left) == 1 and left.pop().startswith("stage-source_mixing") and out.count() > 0


def test_pipeline_keeps_texts_of_shared_ids(spark, sf_dir):
    import corpus_pipeline

    near = " ".join(f"w{k}" for k in range(200))
    rows = [(1, "a copy"), (2, "a  copy"), (2, "found nowhere else"), (3, near), (4, near + " end"), (4, "another one"), (5, "x"), (5, "x"), (None, "a copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.one_of_equals(spark, docs, sf_dir)
    assert sorted(map(tuple, left.collect()), key=str) == sorted((r for r in rows if r != (2, "a  copy")), key=str)
    left = corpus_pipeline.one_of_near_copies(spark, docs.filter("text != 'a  copy'"), sf_dir)
    assert sorted(map(tuple, left.collect()), key=str) == sorted((r for r in rows if r not in ((2, "a  copy"), (4, near + " end"))), key=str)


def test_pipeline_without_labels_rejects_nothing(spark, odd, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("held-out", [(5, 1)])):  # crc32('5') % 4 is 2
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert labels.filter(~quality.held_out()).isEmpty()
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert corpus_pipeline.good_quality(spark, odd, str(tmp_path / name)).count() == 11


def test_marks_bound_the_tokens_of_one_set_only():
    rng = np.random.default_rng(5)
    for shared, own in ((0, 0), (90, 3), (400, 700), (5000, 40)):
        both = rng.integers(0, 1 << 63, shared, np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, own, np.uint64)]) for _ in "ab")
        differ = sum(int(x).bit_count() for x in (jaccard.marks(a) ^ jaccard.marks(b)).view(np.uint64))
        assert differ <= 2 * own and (differ > 0) == (own > 0)
