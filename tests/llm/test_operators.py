"""Each operator against a brute-force version, on tables with every awkward case."""

import hashlib
import random
import re
import zlib

import data
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontam, fingerprints, htmltext, licenses, neardup, quality, sentencepiece, substrings, text, tokenfiles, urls
from siltstone.llm.queries import URL_RULES, held_out, vocabulary


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 -------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    docs = data.texts()
    items = [(1, data.words(9, 30)), (2, "one two three"), (3, None), (4, ""), (5, data.words(7, 87).upper()), (6, data.words(999, 25)), (7, data.words(9, 15)), (10, "same same same same same same same same same same"), (None, "one")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    found = decontam.contamination(data.documents(spark), bench, block_bytes=block_bytes)
    got = sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in found.collect())
    expected = []
    for d, t in docs:
        n, hit, owners = decontam.brute_force([(d, t)], items)[d]
        expected.append((d, n, hit, owners))
    assert got == sorted(expected)
    assert decontam.contamination(data.empty(spark), bench).count() == 0
    nothing = decontam.contamination(data.documents(spark), bench.where("false")).collect()
    assert all(not r["spans"] and not r["items"] for r in nothing) and len(nothing) == len(docs)


def test_decontaminated_texts(spark):
    item = data.words(9, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(1, f"Before, {item} after\nthe end"), (2, "clean\ntext"), (3, None), (4, item)]
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminated(data.documents(spark, docs), bench).collect()}
    assert got == {1: "Before,  after\nthe end", 2: "clean\ntext", 3: None, 4: ""}


def test_decontaminated_by_blocks(spark):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[5:25])), (2, " ".join(w[20:30])), (3, " ".join(w[30:40])), (4, " ".join(w[4:5] + w[40:49])), *((k, f"other {k}") for k in range(5, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = data.documents(spark, [(1, ", ".join(w)), (2, "clean\ntext"), (3, None), (4, "")])
    whole, blocks = ({r["doc_id"]: tuple(r) for r in decontam.decontaminated(docs, bench, block_bytes=n).collect()} for n in (1 << 20, 40))
    assert whole == blocks and decontam.decontaminated(docs, bench, block_bytes=40).schema == docs.schema
    # what becomes neighbours by the cut (w4, w40 to w48) is no passage
    assert whole[1][docs.columns.index("text")] == ", ".join(w[:5]) + ", , " + ", ".join(w[40:])


def test_contamination_doesnt_depend_on_blocks(spark):
    w = [f"w{i:02d}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w[:10])), (2, " ".join(w[5:15])), (None, " ".join(w[20:31])), (3, None)], "item_id long, text string")
    docs = data.documents(spark, [(1, " ".join(w)), (1, " ".join(w)), (2, "clean"), (3, None)])
    whole, blocks = (sorted(map(str, decontam.contamination(docs, bench, block_bytes=n).collect())) for n in (1 << 20, 40))
    assert whole == blocks
    found = decontam.contamination(docs, bench, block_bytes=40).where("doc_id = 1").head()
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(0, 15), (20, 31)] and found["items"] == ["1", "2"]
    cut = [{(r["doc_id"], r["text"]) for r in decontam.decontaminated(docs, bench, block_bytes=n).collect()} for n in (1 << 20, 40)]
    assert cut[0] == cut[1] and (1, " " + " ".join(w[15:20]) + "  " + " ".join(w[31:])) in cut[0]


def test_suffix_array_and_fm_index():
    rnd = np.random.default_rng(3)
    for size, letters in ((1, 3), (50, 2), (400, 3), (300, 40)):
        t = np.append(rnd.integers(1, 1 + letters, size), 0).astype(np.int64)
        t[: size // 2] = t[0]  # a long run
        sa = decontam.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        index = decontam.FMIndex(t)
        patterns = [t[i : i + k].tolist() for i in range(0, size, 7) for k in (1, 2, 5) if i + k <= size]
        width = 5
        table = np.array([p + [-1] * (width - len(p)) for p in patterns])
        lo, hi = index.search(table, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            places = [i for i in range(len(t)) if t[i : i + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == places


# 2 -------------------------------------------------------------------------


def test_field_learns_its_pages():
    model = htmltext.default_field()
    right = total = 0
    for blocks, title, labels in htmltext.labelled_pages(120, seed=5):
        found = model.labels(blocks, title)
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_viterbi_finds_the_best_sequence():
    rnd = random.Random(2)
    for _ in range(50):
        field = htmltext.ChainField({}, tuple(tuple(rnd.uniform(-2, 2) for _ in range(2)) for _ in range(2)))
        unary = [rnd.uniform(-2, 2) for _ in range(rnd.randint(0, 7))]

        def value(seq, unary=unary, field=field):
            return sum(u for u, y in zip(unary, seq, strict=True) if y) + sum(field.pairs[a][b] for a, b in zip(seq, seq[1:]))

        best = max((value([k >> i & 1 for i in range(len(unary))]) for k in range(1 << len(unary))), default=0)
        assert abs(value(field.decode(unary)) - best) < 1e-9


def test_html_extraction(spark):
    article = "<h1>A title</h1><p>First  &amp; foremost,\n this is a sentence.<p>Second <b>bold</b> one&nbsp;here.<br>And more.</p>"
    page = f'<html><head><title>A title</title><script>var x="</p>";</script><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- no --><div class="ad">Buy this thing now, it is good.</div><article>{article}</article><div class="comments"><p>I do not agree with this at all.</p></div><footer>&copy; Somebody &middot; All of it.</footer></body></html>'
    text_of = "A title\n\nFirst & foremost, this is a sentence.\n\nSecond bold one here. And more."
    cases = [(1, "u", page, "k"), (2, None, None, "k"), (3, "u", "", "k"), (4, "u", "<p>unclosed <b", "k"), (5, "u", "<!-- open comment", "k"), (6, "u", page, "k"), (6, "u", page, "k"), (7, "u", "<script>alert(1)", "k")]
    pages = spark.createDataFrame(cases, "page_id long, url string, html string, text string")
    got = rows_of(htmltext.extracted(pages))
    assert len(got) == len(cases)
    by = {(p, u): t for p, u, t in got}
    assert by[1, "u"] == by[6, "u"] == text_of
    assert by[2, None] == by[3, "u"] == by[5, "u"] == by[7, "u"] == ""
    assert htmltext.extracted(pages.where("false")).count() == 0
    long = "<article>" + "<p>A sentence that goes on. " * 5000 + "</article>"
    assert len(htmltext.main_text(long, htmltext.default_field())) > 100_000


def test_broken_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("<a b", "<a b='", '<a ">" ', "<a<", "</p><div>x", "<svg/>x", "<!-- ", "<p class='", "<li>y", "<script "):
        htmltext.blocks_of(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 90  # a quadratic scan of one of them takes hours


#: Pages by hand, in shapes that the grammar of the training pages doesn't lay out, and their articles.
BY_HAND = [
    (
        """<!DOCTYPE html><html lang="en"><body id="top"><div id="wrapper"><div id="masthead"><a href="/">The Gazette</a></div>
        <ul class="menu"><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>
        <div class="story-body"><h1>Bridge reopens after nine months</h1><p>The old bridge over the river was opened again on Monday, the council said.</p>
        <p>Repairs had taken <em>longer</em> than planned, and cost more than twice what was first thought.</p>
        <blockquote>We are glad that it is done.</blockquote><p>Traffic was light in the morning.</p></div>
        <div class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Dog finds its way home</a></li><li><a href="/2">Ten recipes for autumn</a></li></ol></div>
        <div id="footer">Copyright 2021 The Gazette. <a href="/terms">Terms</a></div></div></body></html>""",
        ["Bridge reopens after nine months", "The old bridge over the river was opened again on Monday, the council said.", "Repairs had taken longer than planned, and cost more than twice what was first thought.", "We are glad that it is done.", "Traffic was light in the morning."],
    ),
    (
        """<html><body><header role="banner"><nav aria-label="Main"><a href="/a">Docs</a> <a href="/b">Blog</a></nav></header>
        <main><article><header><h1>How we store dates</h1></header><section><p>Dates are harder than they look &mdash; at least for us.</p>
        <h2>First try</h2><p>We kept them as text, which sorted well until someone typed a year with two digits.</p></section>
        <section><h2>Second try</h2><p>Then we kept days since 1970, and it has been quiet since.</p></section></article>
        <section class="comments"><h2>2 comments</h2><div class="comment"><p>Why not seconds?</p></div><div class="comment"><p>Nice read, thank you.</p></div></section></main>
        <aside class="newsletter"><form><label>Your address</label><input><button>Subscribe</button></form></aside>
        <footer><small>&copy; 2023 Somebody</small></footer></body></html>""",
        ["How we store dates", "Dates are harder than they look \u2014 at least for us.", "First try", "We kept them as text, which sorted well until someone typed a year with two digits.", "Second try", "Then we kept days since 1970, and it has been quiet since."],
    ),
]


def test_pages_by_hand():
    model = htmltext.default_field()
    right = total = 0
    for page, article in BY_HAND:
        blocks, title = htmltext.blocks_of(page)
        assert set(article) <= {b.text for b in blocks}
        labels = model.labels(blocks, title)
        right += sum((b.text in article) == bool(y) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
    assert right / total >= 0.9


# 3 -------------------------------------------------------------------------


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Over 20,000 labelled rows: all are counted, whatever the groups; quantiles are exact."""
    rows = spark.range(0, 22_000, 1, 4)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("plain words stand here "), F.col("id"))).otherwise(F.concat(F.lit("BUY!!! $$$ NOW >>> "), F.col("id")))
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = rows.select(F.col("id").alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality"))
    seen, fitted = [], quality.exact_quantile
    monkeypatch.setattr(quality, "exact_quantile", lambda df, q: seen.append(df.count()) or fitted(df, q))
    model = quality.fit_ranking(docs, labels)
    assert seen == [22_000]
    wrong = quality.quality_scores(docs, model).where((F.col("quality_score") >= quality.CUT) != (F.col("doc_id") % 2 == 0)).count()
    assert wrong <= 220
    monkeypatch.setattr(quality, "FEW", 3)
    values = np.random.default_rng(1).normal(size=500).round(1)
    raw = spark.createDataFrame([(float(v),) for v in values], "raw double")
    for q in (0.0, 0.37, 1.0):
        assert abs(quality.exact_quantile(raw, q) - np.quantile(values, q)) < 1e-9


def test_quality_fits_in_few_jobs(spark):
    """Jobs don't follow partitions: a sum is one job, and no step deals rows out again."""
    rows = spark.range(0, 6000, 1, 40)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("plain words stand here "), F.col("id"))).otherwise(F.concat(F.lit("BUY!!! NOW "), F.col("id")))
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "32k"}
    before = {k: spark.conf.get(k) for k in conf}
    jobs = spark._jsc.sc().dagScheduler().numTotalJobs
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        began = jobs()
        model = quality.fit_ranking(rows.select(F.col("id").alias("doc_id"), text.alias("text")), rows.select(F.col("id").alias("doc_id"), ((F.col("id") + 1) % 2).cast("int").alias("quality")))
        n = jobs() - began
        assert n <= 80
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert model is not None


def test_quality(spark):
    good = [(i, data.words(i, 60) + ".", 1) for i in range(200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in data.words(i, 60).split()), 0) for i in range(200, 260)]
    docs = data.documents(spark, [(d, t) for d, t, _ in good + bad] + [(900, None), (901, ""), (1, good[1][1])])
    labels = spark.createDataFrame([(d, y) for d, _, y in good + bad] + [(5000, 1), (None, 0), (3, 7)], "doc_id long, quality int").unionByName(spark.createDataFrame([(4, None)], "doc_id long, quality int"))
    model = quality.fit_ranking(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality.quality_scores(docs.select("doc_id", "text", "score"), model)
    got = {r["doc_id"]: r["quality_score"] for r in scored.collect()}
    assert scored.count() == 263 and all(0 <= s <= 1 for s in got.values())
    truth = {d: y for d, _, y in good + bad if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum((got[d] >= quality.CUT) == (y == 1) for d, y in truth.items()) >= 0.97 * len(truth)
    assert got[900] == got[901]
    unlabelled = quality.quality_scores(docs.select("doc_id", "text"), quality.fit_ranking(docs, labels.where("quality = 1")))
    assert {r["quality_score"] for r in unlabelled.collect()} == {0.5}
    assert quality.quality_scores(data.empty(spark).select("text"), model).count() == 0


# 4 -------------------------------------------------------------------------


def test_license_scan(spark):
    cases = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "MIT license mit LICENSE, the MIT License"),
        (3, "cc by cc-by/CC BY 4.0 and the GNU General Public License, version 3."),
        (4, None),
        (5, ""),
        (6, "submit license committed apachelicense nothing here"),
        (7, "mit\u00e9 license gnu general public licenses"),
        (8, "word " * 30_000 + "mit license"),
        (8, "word " * 30_000 + "mit license"),
        (9, "SPDX-License-Identifier: GPL-3.0 All rights reserved"),
    ]
    got = licenses.license_scan(data.documents(spark, cases)).collect()
    assert len(got) == len(cases)
    by = {r["doc_id"]: r for r in got}
    for doc, value in cases:
        words = re.findall(text.ALNUM_WORD, (value or "").translate(str.maketrans(text.ASCII_UPPER, text.ASCII_LOWER)))
        places = sorted((i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        row = by[doc]
        assert row["n_words"] == len(words)
        assert sorted((b["start"], b["label"]) for b in row["base"] or ()) == places
    labels = {d: {x["label"] for x in r["detections"] or ()} for d, r in by.items()}
    assert labels[1] == {"apache-2.0"} and "mit" in labels[2] and {"cc-by-4.0", "gpl-3.0"} <= labels[3] and labels[9] >= {"gpl-3.0", "all-rights-reserved"}
    assert licenses.license_scan(data.empty(spark)).count() == 0
    assert len(licenses.signatures()) > 250


def test_license_suppression(spark):
    rules = [licenses.Signature("long", "a", "a b c", 1, 1.0), licenses.Signature("inner", "b", "b", 2, 1.0), licenses.Signature("best", "c", "c", 0, 1.0), licenses.Signature("same", "a", "a b c", 1, 1.0)]
    docs = spark.createDataFrame([(1, "a b c b")], "doc_id long, text string")
    found = licenses.license_scan(docs, rules=rules).head()["detections"]
    assert [(d["start"], d["end"], d["label"]) for d in found] == [(0, 3, "long"), (2, 3, "best"), (3, 4, "inner")]


def _alternatives(parsed) -> list[str]:
    """Texts of every alternative of a parsed pattern, with and without each optional part."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                more = [chr(arg)]
            case "ANY":
                more = ["x"]
            case "IN":
                more = [chr(x) for _, x in arg]
            case "SUBPATTERN":
                more = _alternatives(arg[3])
            case "BRANCH":
                more = [x for branch in arg[1] for x in _alternatives(branch)]
            case "MAX_REPEAT" | "MIN_REPEAT":
                more = ([""] if arg[0] == 0 else []) + _alternatives(arg[2])
        out = [a + b for a in out for b in more]
    return out


def test_license_rules_pass_their_own_gate():
    lost = set()
    for rule in licenses.signatures():
        if rule.label == "apache-2.0" and rule.pattern.startswith("you may not"):
            continue  # the keyword is a condition of its own
        for text in _alternatives(re._parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text)
            if not any(f" {k}" in f" {text}" for k in rule.keyword.split("|")):
                lost.add((rule.label, text))
    assert not lost


def test_license_names_without_the_first_keyword(spark):
    texts = {
        "gpl-3.0": "Licensed under the GNU GPL v3", "gpl": "the GNU GPL", "agpl-3.0": "GNU AGPL 3.0", "gfdl-1.3": "GNU FDL 1.3", "0bsd": "License: 0BSD.", "python-2.0": "PSF license",
        "wtfpl": "Do What The Fuck You Want To Public License", "openrail": "CreativeML OpenRAIL-M",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {r["doc_id"]: {d["label"] for d in r["detections"] or ()} for r in licenses.license_scan(docs).collect()}
    assert all(label in got[i] for i, label in enumerate(texts)), got


# 5 -------------------------------------------------------------------------


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    files = tokenfiles.write_tokens(data.documents(spark), path, length=64)
    got = [tuple(r) for r in tokenfiles.read_tokens(spark, files).orderBy("start").collect()]
    library = Tokenizer.from_file(path)
    stream, expected = [], []
    for d, t in sorted(data.texts(), key=lambda x: x[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        stream.append(ids)
    assert sorted((d, n, c) for d, _, n, c in got) == sorted(expected)
    assert [d for d, *_ in got] == sorted(d for d, _ in data.texts())
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    total = 0
    for f in files:
        reader = tokenfiles.Reader(f.path)
        flat = np.concatenate([reader.sequence(k)[np.array(reader.mask(k))] for k in range(len(reader))])
        assert len(flat) == f.n_tokens and all(len(reader.sequence(k)) == 64 for k in range(len(reader)))
        total += len(flat)
    assert total == sum(n for _, n, _ in expected)
    assert tokenfiles.read_tokens(spark, tokenfiles.write_tokens(data.empty(spark), path)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_texts(name):
    from tokenizers import Tokenizer

    path = vocabulary(name)
    library, mine = Tokenizer.from_file(path), tokenfiles.PieceEncoder(path)
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("aBé'sS.,;!|<>- \n\t\u00a0\u0301İ1२梦#$") for _ in range(rnd.randrange(40))) + rnd.choice(["", "<|endoftext|>", "don't", "I'LL", "<|ENDOFTEXT|>"])
        texts = ["two words", t, "", "A last <|EndOfText|> one " + t]
        ids, n = mine.documents(*text.flat(pa.array(texts)), 2)
        expected = [library.encode(x, add_special_tokens=False).ids + [2] for x in texts]
        assert ids.tolist() == [i for x in expected for i in x] and n.tolist() == [len(x) for x in expected]


def test_only_shown_tokenizers_are_cut():
    import json

    word, byte = (json.load(open(vocabulary(n), encoding="utf-8")) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert tokenfiles.cuttable(word) and not tokenfiles.cuttable(byte)
    for part, other in (("normalizer", {"type": "Strip", "strip_left": True, "strip_right": True}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", None), ("post_processor", {"type": "ByteLevel"})):
        assert not tokenfiles.cuttable({**word, part: other})


# 6 -------------------------------------------------------------------------


@pytest.mark.parametrize("window", [3, 35])
def test_substring_dedup(spark, window):
    got = rows_of(substrings.substring_digests(data.documents(spark), window=window))
    assert got == sorted(substrings.brute_force(data.texts(), window), key=repr)
    assert substrings.substring_digests(data.empty(spark)).count() == 0


def test_substring_dedup_by_small_buckets_and_batches(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    assert rows_of(substrings.substring_digests(data.documents(spark), window=5)) == sorted(substrings.brute_force(data.texts(), 5), key=repr)


def test_windows_are_told_apart_by_the_further_bits():
    tell, flags = np.array([5, 5, 9], "<u8").tobytes(), b"\0"
    rows = [("a", tell[8:] + bytes([1, 3]), substrings._pack(np.array([0, 4])), flags), ("b", tell[:8] + bytes([2]), b"\2", flags), ("c", tell + bytes([2, 1, 4]), substrings._pack(np.array([1, 2, 3])), flags)]
    found = {name: np.frombuffer(places, "<u4").tolist() for name, places in substrings._count_bucket(rows)}
    assert found == {"a": [0], "b": [2], "c": [1, 2]}


def test_substring_positions_pack():
    rnd = np.random.default_rng(1)
    for gaps in (3, 300, 100_000):
        at = np.cumsum(rnd.integers(1, gaps, 500))
        assert substrings._unpack(substrings._pack(at), 500).tolist() == at.tolist()


def test_texts_without_repeats(spark):
    shared = data.words(500, 40)
    docs = [(1, f"alone \n here {shared} and\tgone"), (2, shared), (3, "clean\ntext"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(data.documents(spark, docs)).collect()}
    assert got == {1: "alone \n here and\tgone", 2: "", 3: "clean\ntext", 4: None}


# 7 -------------------------------------------------------------------------


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_url_filter(spark):
    cases = [None, "", "no scheme/net/", "http://Example.NET/en/x?q#f", "http://example.net/enx", "https://www.example.com/de/1", "http://example.com/", "http://a.org/fr/", "http://org/fr/2", "http://notnet/", "http://x.net", "http://x.net?a://b/", "ftp://a.b.net/://c", "http://.net/", "http://net./", "http://É.org/fr/é", "http://a..net/", "://net/", "http://example.net/en/"]
    rnd = random.Random(9)
    cases += ["http://" + ".".join(rnd.choice(["net", "org", "example", "com", "www", "a"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["/", "/en/", "/de/x", "/fr/", ""]) for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(cases)] + [(1, "", "k")], "page_id long, url string, key string")
    got = rows_of(urls.url_filter(pages, URL_RULES))
    expected = sorted(((i, *judge(u)) for i, u in [*enumerate(cases), (1, "")]), key=repr)
    assert got == expected
    assert urls.url_filter(pages.where("false"), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.url_filter(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_for_its_universe(spark, monkeypatch):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::3]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urls.Cascade.build(listed, universe)

    def got(c):
        filtered, names = c.attached(universe)
        return {r["key"] for r in filtered.where(c.test(F.col("key"), names)).collect()}

    assert got(cascade) == set(listed)
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    deep = [urls.Cascade.build(listed, universe), urls.Cascade.among(listed, sorted(set(keys) - set(listed)))]
    assert all(len(c.levels) > 2 and got(c) == set(listed) for c in deep)


def test_url_ties_and_many_rules(spark):
    rules = [urls.Rule("net", "/ab", "block"), urls.Rule("x.net", "/", "allow"), urls.Rule("net", "/ab", "allow"), urls.Rule("org", "/", "watch")]
    pages = spark.createDataFrame(list(enumerate(["http://x.net/ab", "http://y.net/abc", "http://org/", "http://com/"])), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.url_filter(pages, rules).collect()}
    assert got == {0: ("x.net/", "allow"), 1: ("net/ab", "block"), 2: ("org/", "watch"), 3: (None, "allow")}
    many = rules + [urls.Rule(f"h{i}.com", "/", ["block", "allow"][i % 2]) for i in range(20_000)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p") for i in range(0, 40_000, 7)], "page_id long, url string")
    found = urls.url_filter(pages, many)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    assert all((r["rule"], r["verdict"]) == ((f"h{r['page_id']}.com/", ["block", "allow"][r["page_id"] % 2]) if r["page_id"] < 20_000 else (None, "allow")) for r in found.collect())


# 8 -------------------------------------------------------------------------


def test_streaming_viterbi():
    pieces = sentencepiece.Pieces(vocabulary("piece_bpe_32k.model"))
    rnd = random.Random(3)
    for _ in range(200):
        s = "".join(rnd.choice("thein  g▁\n1é梦a==") for _ in range(rnd.randrange(80)))
        ids = sentencepiece.encode_text(pieces, s)
        assert ids == sentencepiece.whole_viterbi(pieces, sentencepiece.prepared(s))
        assert sentencepiece.decode_ids(pieces, ids) == s.replace("▁", " ")
    long = sentencepiece.StreamingViterbi(pieces)
    out = []
    for part in ("the quick brown fox " * 3000, "x" * 3000):
        out += long.feed(part.replace(" ", sentencepiece.SPACE))
        assert len(long.chars) < 400  # the window stays short
    out += long.finish()
    assert out == sentencepiece.whole_viterbi(pieces, ("the quick brown fox " * 3000 + "x" * 3000).replace(" ", sentencepiece.SPACE)) and long.peak < 400


def test_sentencepiece_columns(spark):
    model = vocabulary("piece_bpe_32k.model")
    docs = data.documents(spark).drop("h").withColumn("ids_", F.lit(1))
    found = sentencepiece.decoded(sentencepiece.encoded(docs, model), model)
    pieces = sentencepiece.Pieces(model)
    rows = found.collect()
    assert len(rows) == len(data.texts())
    for r in rows:
        assert r["decoded"] == (r["text"] or "")
        if len(r["text"] or "") < 5000:
            assert list(r["ids"]) == sentencepiece.encode_text(pieces, r["text"] or "")
    assert sentencepiece.encoded(data.empty(spark), model).count() == 0


# 9 -------------------------------------------------------------------------


def test_fingerprints(spark):
    docs = data.texts()
    found = fingerprints.edit_likeness(data.documents(spark, docs)).withColumns({"near": fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")), "next": fingerprints.resemblance(F.col("sketch"), F.col("next_sketch"))}).collect()
    lower = str.maketrans(text.ASCII_UPPER, text.ASCII_LOWER)

    def shingles(t):
        w = re.findall(text.SPACE_WORD, t.translate(lower))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def likeness(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    # ids descend, rows of one id rise by the hash of their text
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (-x[0], hashes[x[1]]))
    expected = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(shingles(t), shingles(edited)), likeness(shingles(t), shingles(after))))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near"], r["next"]) for r in found]
    assert len(got) == len(docs) == len(expected)
    for x, y in zip(sorted(got), sorted(expected), strict=True):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 0.16 and abs(x[4] - y[4]) < 0.16
    rows = {r["doc_id"]: r for r in found}
    assert rows[7]["sketch"] == rows[31]["sketch"] and rows[1]["sketch"] == rows[2]["sketch"] == []
    assert fingerprints.edit_likeness(data.empty(spark)).count() == 0
    alone = fingerprints.edit_likeness(data.documents(spark, [(1, "a b c d e f")])).head()
    assert alone["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest() and alone["n_chars"] == 11


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_next_rows(spark, parts):
    rows = [(i * 7 % 50, i) for i in range(50)] + [(3, 100 + i) for i in range(40)] + [(None, 200 + i) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, o long, next_v long").withColumn("v", F.struct("id", "o"))
    got = {(r["id"], r["o"]): tuple(r["next_v"]) for r in fingerprints.with_next(df, "id", {"v": F.col("v")}, F.col("o"), parts).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_sketches_merge(spark):
    parts = [(1, data.words(1, 900)), (1, data.words(2, 700)), (2, data.words(1, 900)), (3, "")]
    df = spark.createDataFrame(parts, "g long, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    merged = {r["g"]: r["sketch"] for r in fingerprints.merge_by(df, "g", "s").collect()}
    whole = {r["g"]: sorted(r["all"])[: fingerprints.K] for r in df.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("all")).collect()}
    assert merged == {g: s for g, s in whole.items() if s}
    pair = spark.createDataFrame([(merged[1], merged[2])], "a array<long>, b array<long>")
    r = pair.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_count(F.col("a"))).head()
    assert r[0] > 0.8 and 0.35 < r[1] < 0.8 and 1200 < r[2] < 2000


# 10 ------------------------------------------------------------------------


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(spark, shingle):
    a, b = data.texts()[-4][1], data.texts()[-3][1]
    assert [d for d, _ in data.texts()[-4:-2]] == [64, 64]
    docs = [*data.texts(), (66, a + " end"), (67, b + " end"), (-9, b + " end")]  # near copies of both texts of id 64
    got = rows_of(neardup.near_duplicates(data.documents(spark, docs), shingle=shingle))
    assert got == sorted(neardup.brute_force(docs, shingle), key=repr)


def test_near_duplicate_chains_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    base = data.words(3, 120).split()
    docs, rnd = [], random.Random(8)
    for i in range(70):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(len(w))] = f"y{i}"
        docs.append((1000 - i, " ".join(w)))
    chain = data.words(4, 200).split()
    for i in range(12):
        chain[i * 12] = f"z{i}"
        docs.append((2000 + i, " ".join(chain)))
    got = rows_of(neardup.near_duplicates(data.documents(spark, docs), shingle=4))
    assert got == sorted(neardup.brute_force(docs, 4), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(data.empty(spark)).count() == 0
    only = neardup.near_duplicates(data.documents(spark, [(1, None), (2, ""), (None, "a b c d e f")])).collect()
    assert len(only) == 3 and all(r["kept"] for r in only)


def test_near_duplicates_without_an_id(spark):
    t = data.words(5, 80)
    found = neardup.near_duplicates(data.documents(spark, [(None, t), (8, t + " x"), (9, t + " y"), (None, data.words(6, 80))])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 8, True), (8, 8, True), (9, 8, False)]
    pair = [(None, t), (None, t + " x")]
    assert all(r["component_id"] is None and r["kept"] for r in neardup.near_duplicates(data.documents(spark, pair)).collect())


def test_near_duplicates_of_one_row_repeated(spark):
    t = data.words(5, 80)
    found = neardup.near_duplicates(data.documents(spark, [(3, t)] * 300 + [(4, t + " x")] * 200)).collect()
    assert len(found) == 500 and all(r["component_id"] == 3 and r["kept"] == (r["doc_id"] == 3) for r in found)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["comp"] for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_hashes_are_those_of_the_words():
    arr = pa.array(["The cat  sat", None, "", "cat", "sat\u00e9 the"])
    w = text.Words(*text.flat(arr), text.IS_SPACE_WORD, lower=True)
    assert [v.decode() for v in w.values().to_pylist()] == ["the", "cat", "sat", "cat", "saté", "the"]
    h = w.hashes()
    assert h[0] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 4 and w.counts.tolist() == [3, 0, 0, 1, 2]
    for size in (1, 2, 3, 5, 35):
        x = np.arange(100, dtype=np.uint64)
        ours = text.windows(x, size, 31)
        assert len(ours) == max(0, 101 - size)
        if size == 3:
            assert ours[5] == text.mix(np.array([5 * 961 + 6 * 31 + 7], np.uint64))[0]
