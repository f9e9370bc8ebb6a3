import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retail_lens.llm import decontamination, fingerprint, jaccard, language, licenses, packing, pii, substrings, words
from tests.llm import helpers


@pytest.fixture(scope="module")
def rows():
    return helpers.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return helpers.frame(spark, rows).repartition(3).persist()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_and_grams_match_regular_expressions(rows):
    texts = pa.array([r[1] for r in rows])
    for member, lower, expect in ((words.SPACED, False, helpers.spaced), (words.ALNUM, True, helpers.alnum)):
        got = []
        for _, part in words.chunks(texts, limit=5000):
            w = words.Words(part, member, lower)
            got += [[x.decode() for x in w.words(i, j)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [expect(t) for t in texts.to_pylist()]
    w = words.Words(pa.array(["a b c a b c", "c a b"]))
    g = words.grams(w.hashes(), 3)
    assert g[0] == g[3] and g[6] == g[2] and len(set(g.tolist())) == 5


def test_word_hashes_tell_thue_morse_words_apart():
    """Such words of 1,024 letters are equal under any polynomial hash modulo a power of two."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    for seed in (0, 1):
        h = words.Words(pa.array([x, x.translate(str.maketrans("ab", "ba")), x, "", "abcdefgh", "abcdefgh\0", "ijklmnopabcdefgh", "abcdefghijklmnop"])).hashes(seed)
        assert h[0] == h[2] and len(set(h.tolist())) == 6


def test_jaccard_classes(spark, rows, docs):
    for width, per_cent in ((4, 85), (5, 80)):
        assert by_id(jaccard.jaccard_classes(docs, width, per_cent), "n_shingles", "component_id") == helpers.classes(rows, width, per_cent)
    empty = helpers.frame(spark, [])
    assert jaccard.jaccard_classes(empty).count() == 0


def test_jaccard_rows_that_repeat_a_key_are_one_node(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (5, text("b")), (7, text("b")), (8, text("b", 38)), (9, text("c")), (None, text("a")), (9, text("d", 2)), (10, text("e")), (11, None), (11, "")]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0)), 4, 85)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted([(3, 37, 3), (5, 37, 3), (5, 37, 3), (5, 37, 3), (7, 37, 3), (8, 35, 3), (9, 37, 9), (9, 1, 9), (10, 37, 10), (11, 0, 11), (11, 0, 11), (None, 37, None)], key=key)


def test_jaccard_tiles_split_and_find_what_stars_miss(spark, monkeypatch):
    """A chain of near copies, each of which is like its neighbours alone."""
    rng = random.Random(3)
    text, rows = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for i in range(40):
        rows.append((i, " ".join(text), None, None, None, None, None, None))
        text[(i * 3) % 97] = f"n{i}"
    monkeypatch.setattr(jaccard, "TILE", 4)
    got = by_id(jaccard.jaccard_classes(helpers.frame(spark, rows), 4, 85), "n_shingles", "component_id")
    assert got == helpers.classes(rows, 4, 85)


def test_remove_repeats(spark, rows, docs):
    assert by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept") == helpers.kept_words(rows)
    assert substrings.remove_repeats(helpers.frame(spark, [])).count() == 0


def test_automaton_knows_all_passages_and_their_first_documents():
    rng = random.Random(8)
    for letters, window in ((2, 3), (3, 2), (5, 4)):
        passages = [(doc, [rng.randrange(letters) for _ in range(rng.randint(1, 40))]) for doc in range(12) for _ in range(2)]
        a = substrings.Automaton()
        for doc, codes in passages:
            a.add(codes, doc)
        for _ in range(30):
            probe = [rng.randrange(-1, letters) for _ in range(rng.randint(0, 30))]
            first = lambda g: min((d for d, c in passages if any(c[j : j + len(g)] == g for j in range(len(c)))), default=None)
            want = [(i, d) for i in range(len(probe) - window + 1) if (d := first(probe[i : i + window])) is not None]
            assert a.first_docs(probe, window) == want


@pytest.mark.parametrize("bits", [64, 3, 0])
@pytest.mark.parametrize("stream", [4_000, 2])
def test_remove_repeats_whatever_the_hashes(spark, rows, docs, monkeypatch, bits, stream):
    """Anchors of few bits or none send all passages to the same automata, and few documents an automaton make several of each: the words decide."""
    monkeypatch.setattr(substrings, "STREAM", stream)
    assert by_id(substrings.remove_repeats(docs, bits=bits), "n_words", "n_removed", "kept") == helpers.kept_words(rows)


def test_automaton_knows_where_words_end_first():
    rng = random.Random(9)
    for _ in range(50):
        codes = [rng.randrange(2) for _ in range(rng.randint(1, 60))]
        a = substrings.Automaton()
        a.add(codes, 100, 1)
        got = [(i, first - 100) for i, first in a.first_docs(codes, 4)]
        assert got == [(i, next(k for k in range(len(codes)) if codes[k - 3 : k + 1] == codes[i : i + 4])) for i in range(len(codes) - 3)]


def test_remove_repeats_of_a_text_that_repeats_itself(spark, monkeypatch):
    """One word, a short period and repeated lines over many words, in documents that also share them."""
    rng = random.Random(4)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(37))
    rows = [(i, t, None, None, None, None, None, None) for i, t in enumerate(["a " * 4_000, "b a c " * 1_500, (line + "\n") * 60, "x " + line + " y " + "a " * 30, "c b a " * 11 + "z", "p q r s t " * 5, "p q r s t " * 4 + "u p", " ".join(f"u{rng.randrange(3)}" for _ in range(900))])]
    assert by_id(substrings.remove_repeats(helpers.frame(spark, rows)), "n_words", "n_removed", "kept") == helpers.kept_words(rows)


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 30])
def test_decontamination(spark, rows, docs, block_words):
    items = [(9, " ".join(rows[4][1].split()[:45])), (10, " ".join(rows[4][1].split()[:30])), (1, rows[2][1]), (2, " ".join((rows[3][1] or "").split()[:6])), (3, None), (4, ""), (5, "One, two"), (6, "never seen in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.scan_benchmark(docs, bench, block_words=block_words, cleaned="clean").persist()
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "runs", "score", "n_words", "hit", "items", "clean"]
    got = {k: (n, sum(hit), list(x)) for k, (n, hit, x) in by_id(found, "n_words", "hit", "items").items()}
    assert got == helpers.benchmark_hits(rows, items)
    clean = by_id(found, "clean")
    for r in rows:
        n, hit, _ = got[r[0]]
        assert clean[r[0]][0] == r[1] if not hit else len(helpers.alnum(clean[r[0]][0])) == n - hit
    assert by_id(decontamination.scan_benchmark(docs, bench.limit(0)), "n_words", "items")[0] == (len(helpers.alnum(rows[0][1])), [])
    assert decontamination.scan_benchmark(helpers.frame(spark, []), bench).count() == 0


def test_fingerprints(spark, rows, docs):
    sketches = by_id(docs.select("doc_id", fingerprint.sketch(F.col("text"), fraction=1.0).alias("s"), fingerprint.sketch(F.col("text")).alias("t")), "s", "t")
    for r in rows:
        all_, some = sketches[r[0]]
        w = helpers.spaced(r[1])
        assert len(all_) == (len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
        assert set(some) <= set(all_) and bool(some) == bool(w)
    near = fingerprint.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", ["text"], 5)
    got, texts = by_id(near, "next_text"), [r[1] or "" for r in rows]
    assert got == {i: (texts[i - 1],) for i in range(len(rows))}
    for part in ([], rows[:1], [(5, t, "", "", 0, "", "", "") for t in ("b", "a", None)]):
        some = fingerprint.with_next(helpers.frame(spark, part), "doc_id", ["text"], 3)
        assert some.columns[-1] == "next_text" and some.count() == len(part)
    union = docs.agg(fingerprint.merged(fingerprint.sketch(F.col("text"))).alias("m")).first()["m"]
    assert set(union) == set().union(*(s[1] for s in sketches.values()))
    half = spark.createDataFrame([(list(range(8)), list(range(100)))], "a array<long>, b array<long>")
    assert half.select(fingerprint.containment(F.col("a"), F.col("b")), fingerprint.likeness(F.col("a"), F.col("b"))).first()[:] == (1.0, 0.08)


def test_registered_fingerprint_query_against_brute_force(spark, tmp_path, rows):
    import xxhash

    texts = {r[0]: r[1] or "" for r in rows}
    helpers.frame(spark, [*rows]).write.parquet(f"{tmp_path}/documents.parquet")
    top = int(-(1 << 63) + (1 << 64) / 8)

    def sketch(t):
        w, out = helpers.spaced(t), set()
        for i in range(max(1, len(w) - 4) if w else 0):
            h = 42
            for x in w[i : i + 5]:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            out.add(h - (1 << 64) if h >> 63 else h)
        return sorted(x for x in out if x <= top) or sorted(out)[:1]

    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    shown = lambda s: ",".join(f"{x % (1 << 64):x}" for x in s)
    order = sorted(texts, reverse=True)
    for r in fingerprint.op7_fingerprint(spark, str(tmp_path)).collect():
        t, nxt = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = sketch(t), sketch(edited)
        assert (r.fingerprint, r.edited_fingerprint) == (shown(a), shown(b))
        assert (round(r.near_edited, 12), round(r.near_next, 12)) == (round(like(a, b), 12), round(like(a, sketch(nxt)), 12))


def test_language(spark):
    rng = random.Random(5)
    vocabulary = {"en": ["the", "and", "thing", "whether", "shore"], "de": ["und", "nicht", "schön", "keit", "über"], "fr": ["le", "être", "eaux", "tion", "çon"]}
    texts = [(i, " ".join(rng.choice(vocabulary[x]) for _ in range(30)), x) for i, x in enumerate(list(vocabulary) * 30)]
    train = spark.createDataFrame([*texts, (900, None, "en"), (901, "text", None), (902, "", "")], "doc_id long, text string, lang string")
    model = language.fit(train, max_words=8)
    assert model.langs == ["de", "en", "fr"] and len(model.words) == 8
    test = spark.createDataFrame([(1, "the thing", "x"), (2, "schönkeit unter", "x"), (3, None, "x"), (4, "123 !!", "x"), (5, "", "x"), (6, "the " * 20000, "x"), (6, "être", "x")], "doc_id long, text string, score string")
    got = language.identify(test, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [tuple(r)[2] for r in got.orderBy("doc_id", "text").collect()] == ["en", "de", "und", "und", "und", "en", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    long = spark.createDataFrame([(1, "x" * 70 + "keit"), (2, "x" * 70 + "eaux"), (3, "x" * 70 + "whether")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(long, model).orderBy("doc_id").collect()] == ["de", "fr", "en"], "words are read to their ends"
    none = language.fit(train.limit(0))
    assert {r["lang_pred"] for r in language.identify(test, none).collect()} == {"und"}
    assert language.identify(test.limit(0), model).count() == 0


def pii_by_hand(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        n = re.sub("[^0-9]", "", s)
        checksum = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(n[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(n) <= 19 and checksum, "phone": 9 <= len(n) <= 15}[kind]

    spans = sorted((m.start(), i, m.end(), k) for i, k in enumerate(patterns) for m in re.finditer(patterns[k], text or "") if good(k, m[0]))
    return [f"{k}:{s}:{e}" for s, _, e, k in spans]


PII_TEXTS = [
    "mail a.b@c.de, a@b.c.@d.e and x@y", "é 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.000255", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111111111111111",
    "call +1 (988) 555-2485 or +12 345; +49.30.1234567.", "", None, "no data", "1 " * 12000, "a" * 20000 + "@b.c", "😀 z@y.xx 😀 +4930123456789", "(988) 555-1234 me [at] home [dot] org",
]


def test_pii_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    got = by_id(df.select("doc_id", pii.as_text(pii.find_spans(F.col("text"), pii.Trees([], None))).alias("s")), "s")
    assert got == {i: (",".join(pii_by_hand(t)),) for i, t in enumerate(PII_TEXTS)}
    red = by_id(pii.redact(df, pii.Trees([], None)), "text")
    assert red[0][0] == "mail [EMAIL], [EMAIL][EMAIL] and x@y" or red[0][0].startswith("mail [EMAIL]")
    assert red[4] == ("",) and red[5] == (None,) and red[6] == ("no data",) and red[9][0] == "😀 [EMAIL] 😀 [PHONE]"


def test_pii_trees_add_spans_and_keep_base(spark):
    card = "4111 1111 1111 1111"
    rows = [
        (0, f"my card is {card} {card} twice"), (1, "please call (239) 555-0101 today"), (2, "order 239-555-0101 shipped"), (3, "write to ann (at) shop (dot) com please"),
        (4, "from host 2001:0db8:85a3:0:0:8a2e:0370:7334 again"), (5, "checksum 12:34:56:78:9a:bc:de:f0 of it"), (6, None), (7, ""), (8, "tel. 0049 30 1234567, mail a@b.de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("x"))
    trees = pii.fit(df)
    assert set(trees.report) == set(pii.KINDS) and all(p >= pii.PRECISION and r > 0.4 for p, r, _ in trees.report.values()), trees.report
    got = by_id(df.select("doc_id", pii.as_text(pii.find_spans(F.col("text"), trees)).alias("s")), "s")
    assert all(set(pii_by_hand(t)) <= set(got[i][0].split(",")) for i, t in rows)
    assert got[0] == ("card:11:30,card:31:50",), "both cards of a pair that the base drops as one number"
    assert [got[i][0].split(":")[0] for i in (1, 3, 4)] == ["phone", "email", "ip"] and [got[i][0] for i in (2, 5, 6, 7)] == [""] * 4
    red = by_id(pii.redact(df, trees), "text", "base")
    assert red[1] == ("please call [PHONE] today", "x") and red[3] == ("write to [EMAIL] please", "x") and red[8] == ("tel. [PHONE], mail [EMAIL]", "x")
    empty = df.limit(0)
    assert pii.fit(empty).thresholds and pii.redact(empty, trees).count() == 0


def test_packing_matches_a_plain_version():
    rng = np.random.default_rng(4)
    for permitted in ((10,), (8, 16, 40)):
        lengths = np.sort(rng.integers(1, max(permitted) + 1, 400))[::-1].astype(np.int64)
        bins, places, sizes = packing.pack(lengths, permitted)
        room, used, expect = {}, {}, []
        for i, n in enumerate(lengths.tolist()):
            fit = [(r, b) for b, r in room.items() if r >= n]
            if fit:
                b = min(fit)[1]
            else:
                free, best = sum(room.values()), []
                for c in permitted:
                    if c >= n:
                        later = sum(x for x in lengths[i + 1 :].tolist() if x <= c - n)
                        best.append(((c + packing.OVERHEAD) / (n + min(c - n, max(0, later - free))), c))
                b = len(used)
                room[b], used[b] = min(best)[1], 0
            expect.append((b, used[b]))
            room[b] -= n
            used[b] += n
        assert list(zip(bins.tolist(), places.tolist(), strict=True)) == expect
        assert sizes == [min(c for c in permitted if c >= used[b]) for b in range(len(used))]


def test_packed_sequences_hold_the_texts(spark):
    texts = {1: "ünïcode " * 9, 2: "", 3: None, (1 << 60) + 1: "a", (1 << 60) + 3: "b" * 40, None: "no key"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    placed = packing.best_fit(docs.select("doc_id", packing.byte_tokens("text").alias("n")), "n", permitted=(8, 32), pack_pieces=100).persist()
    got = {r.doc_id: r.n for r in placed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {k: len(t.encode()) + 1 for k, t in texts.items() if t is not None}, "a null key beside large ones"
    keyed = placed.where("doc_id is not null")
    rows = packing.sequences(docs, keyed).collect()
    assert all(len(r.tokens) == r.bin_length for r in rows)
    bins = {r.bin_id: bytes(r.tokens) for r in rows}
    for i, t in texts.items():
        if t is not None and i is not None:
            parts = sorted(keyed.where(F.col("doc_id") == i).collect(), key=lambda r: r.start)
            assert b"".join(bins[r.bin_id][r.at : r.at + r.length] for r in parts) == t.encode() + packing.END
    assert packing.fill(placed).agg(F.sum("tokens")).first()[0] == sum(got.values())


def test_best_fit_places_every_token_once(spark):
    docs = spark.createDataFrame([(1, 5), (2, 70), (3, None), (4, 0), (5, 33), (5, 33), (6, -2), (7, 3)], "doc_id long, n long").withColumn("bin_id", F.lit("x"))
    got = packing.best_fit(docs, "n", permitted=(8, 16, 32), pack_pieces=3).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == {1: 5, 2: 70, 5: 66, 7: 3}
    for _, b in got.sort_values("at").groupby("bin_id"):
        assert b["at"].tolist() == [0, *b["length"].cumsum().tolist()[:-1]] and b["length"].sum() <= b["bin_length"].iloc[0]
    assert packing.best_fit(docs.limit(0), "n").count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
AGPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published
# by the Free Software Foundation, either version 3 of the License."""


def test_licenses(spark):
    texts = [
        "prose here\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "He is a licensed electrician.", None, "", "nothing\n\nhere", "long " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.",
        f"some code\n\n{MIT}\n\nmore", ISC, "This is free software; you can redistribute it under the Artistic License 2.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", AGPL, "Licensed under CC BY-NC 4.0.", "x" * 20000 + " permission",
    ]
    rng = random.Random(6)
    around = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    texts += [f"{around(n // 3)} Licensed under the Apache License, Version 2.0 {around(n - n // 3)}" for n in (20, 300, 800, 5000)]  # 14 to 17
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    scanner = licenses.fit(df)
    print(scanner.report, scanner.threshold)
    rows = licenses.scan(df, scanner).collect()
    assert scanner.report["candidates"] > 0.95
    again = licenses.scan(df.where("doc_id = 0").union(df.where("doc_id = 0")).union(df.where("doc_id = 0").withColumn("doc_id", F.lit(None))), scanner).collect()
    assert [r.doc_id for r in again].count(0) == 2 and [r.doc_id for r in again].count(None) == 1, "repeated rows are scanned each"
    print(*rows, sep="\n")
    assert scanner.report["precision"] >= licenses.PRECISION and scanner.report["recall"] > 0.7 and scanner.report["strange"] > 0.5, scanner.report
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in rows if r.family != "unknown"}
    assert got == {(0, 1): ("apache-2.0", True), (1, 0): ("mit", True), (6, 1): ("gpl", True), (7, 1): ("mit", True), (11, 0): ("agpl", True), (12, 0): ("cc-by-nc", True), **{(i, 0): ("apache-2.0", True) for i in range(14, 18)}}
    assert {8, 9, 10} <= {r.doc_id for r in rows if r.family == "unknown"}, "licences of no known family"
    assert licenses.scan(df.limit(0), scanner).count() == 0


def test_license_grams_are_built_by_spark_and_lines_ends_are_asked_for_first(spark):
    from pyspark.ml.feature import NGram

    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i)]) for i in range(6)], "id long, words array<string>")
    for n in (2, 3):
        df = NGram(n=n, inputCol="words", outputCol=f"g{n}").transform(df)
    assert df.where(F.expr(licenses.GRAMS) != F.concat("words", "g2", "g3")).count() == 0
    assert not [s for s in licenses.fit(spark.createDataFrame([], "doc_id long, text string")).model.stages if isinstance(s, NGram)]
    long, short = "x" * 41, "y" * 30
    texts = [(f"{long} the \n Apache",), (f"{long}\n\n  low",), (f"{long} of\t\r\n(b",), (f"{long}.\nlow",), (f"{short}\nlow",), (f"{long} end\nUp",)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").coalesce(1).select(licenses.paragraphs(F.col("t"))).collect()]
    assert got == [[f"{long} the Apache"], [long, "low"], [f"{long} of (b"], [f"{long}.", "low"], [short, "low"], [f"{long} end", "Up"]]
    assert licenses.WRAP.startswith(r"(?=[ \t]*\n)"), "looking back at every character was four fifths of the time that paragraphs took"


def test_held_out_is_a_fifth_by_checksum(spark):
    import zlib

    got = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]


def test_the_model_is_asked_about_every_window(spark):
    """No list of words stands before the model: without any, the same is found."""
    df = spark.createDataFrame([(1, "Released under the MIT License.\nnothing here"), (2, "--- !!!"), (3, None)], "doc_id long, text string")
    scanner = licenses.fit(df.where("false"))
    scanner.heavy = ["zzzz"]
    assert [(r.doc_id, r.paragraph, r.family) for r in licenses.scan(df, scanner).where("family = 'mit'").collect()] == [(1, 0, "mit")]
