"""Operators that look at one text at a time: pieces, personal data, quality, licences, pages."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import extract, licenses, pieces, pii, quality
from tests.llm import data


def test_pieces_round_trip_and_repeat(spark):
    df = data.odd(spark)
    got = pieces.encode(df, proof="lossless").select("doc_id", "ids", "lossless").collect()
    assert all(r["lossless"] or r["ids"] is None for r in got) and sum(r["ids"] is None for r in got) == 1
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(df.repartition(3)).select("doc_id", "ids").collect()}
    assert all(again[r["doc_id"]] == r["ids"] for r in got)
    back = pieces.decode(pieces.encode(df.select("doc_id", "text")).select("doc_id", "ids")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in back) == sorted((str(r[0]), r[1] or "") for r in data.odd_rows())
    assert pieces.encode(data.empty(spark)).count() == 0


def test_pieces_look_up_only_what_may_go_on(monkeypatch):
    rnd = random.Random(6)
    words = sorted({"▁" + "".join(rnd.choice(["ou", "an", "que", "eau", "é", "x", "漢"]) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)})
    together, alone = pieces.Lattice(pieces.MODEL, 1.0), pieces.Lattice(pieces.MODEL, 1.0)
    asked = []
    find = pieces.Lattice._find
    monkeypatch.setattr(pieces.Lattice, "_find", lambda self, x: (asked.append(len(x)), find(self, x))[1])
    together.filter(set(words))
    assert sum(asked) < 4 * sum(map(len, words))
    monkeypatch.setattr(pieces, "SHORT", 0)
    alone.filter(set(words))
    base = np.random.default_rng(1).integers(0, 1 << 62, len(words)).astype(np.uint64)
    drawn = []
    for lat in (together, alone):
        n, ids = lat.expand(*lat.sample(np.array([lat.end[w] for w in words]), base))
        drawn.append((n.tolist(), ids.tolist()))
    assert drawn[0] == drawn[1]


def test_pieces_sample_the_lattice():
    lat = pieces.lattice(pieces.MODEL, 1.0)
    word = "▁then"

    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in lat.known:
                for rest, lp in every(s[k:]):
                    yield (lat.known[s[:k]][0], *rest), lp + lat.known[s[:k]][1]

    want = {ids: np.exp(lp) for ids, lp in every(word)}
    total = sum(want.values())
    n, ids = lat.encode(["then"] * 40_000, np.arange(40_000, dtype=np.uint64))
    cut = np.concatenate([[0], np.cumsum(n)])
    got: dict[tuple, int] = {}
    for a, b in zip(cut, cut[1:]):
        k = tuple(ids[a:b].tolist())
        got[k] = got.get(k, 0) + 1
    assert max(abs(got.get(k, 0) / 40_000 - p / total) for k, p in want.items()) < 0.01


def _base_spans(t):
    kinds = ("email", "ip", "card", "phone")
    pats = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 if x > 9 else x
        return s % 10 == 0

    out = []
    for k, p in zip(kinds, pats):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (k == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), kinds.index(k), f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans_match_the_patterns(spark):
    rnd = random.Random(1)
    for _ in range(4000):
        t = "".join(rnd.choice("a@.1+- (9.0b@") for _ in range(rnd.randint(0, 40)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in pii.base_spans(t)) == _base_spans(t)
    got = pii.find(data.odd(spark)).select("doc_id", "base_sha256", F.size("spans").alias("n")).collect()
    want = sorted(hashlib.sha256(_base_spans(r[1]).encode()).hexdigest() for r in data.odd_rows())
    assert sorted(r["base_sha256"] for r in got) == want
    assert pii.find(data.empty(spark)).count() == 0


def test_pii_is_linear_in_long_runs():
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []
    assert pii.candidates("a.b-c" * 40_000)[:1] == []


def test_pii_classifier_learns_from_votes():
    v = {(1, 1, 1, 1, 1, 1): 50, (0, -1, 0, 0, -1, -1): 60, (0, 1, 0, 1, 1, 1): 20, (0, 0, 0, 0, -1, 1): 30}
    p = pii._classifier(v)
    assert p[(1, 1, 1, 1, 1, 1)] > 0.9 and p[(0, 1, 0, 1, 1, 1)] > 0.5 and p[(0, -1, 0, 0, -1, -1)] < 0.1


def _labelled(spark):
    rnd = random.Random(4)
    good = [(i, " ".join(rnd.choice(["river", "stone", "walks", "under", "seven"]) + str(rnd.randint(0, 300)) for _ in range(80)), 1) for i in range(60)]
    bad = [(100 + i, " ".join(rnd.choice(["buy###", "now$$$", "win%%%"]) + str(rnd.randint(0, 300)) for _ in range(80)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    return rows.drop("quality"), rows.select("doc_id", "quality")


def test_quality_base_and_held_out(spark):
    docs, labels = _labelled(spark)
    train = labels.where("doc_id % 3 <> 0").unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, quality int"))
    model = quality.train(docs, train)
    held = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in held) / len(held) > 0.95
    got = quality.score(data.odd(spark), model).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(data.quality(r[1]) for r in data.odd_rows())
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality.keep(data.odd(spark), model)
    assert kept.columns == data.odd(spark).columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.score(data.empty(spark), model).count() == 0


def test_quality_without_labels_keeps_all(spark):
    docs, labels = _labelled(spark)
    model = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs, model).where("NOT kept AND NOT base_failed").count() == 0


def _phrases(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", data.lower(t))
    at, labels = [], set()
    for p, label in licenses.PHRASES:
        p = p.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses_match_a_scan(spark):
    rnd = random.Random(3)
    parts = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "GNU General Public License", "CC-BY"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(150)]
    for docs, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), [r[1] for r in rows]), (data.odd(spark), [r[1] for r in data.odd_rows()])):
        got = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect()]
        assert sorted(got, key=str) == sorted(map(_phrases, texts), key=str)
    r = licenses.scan(spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")).first()
    assert (r["base_labels"], r["labels"], r["score"]) == ("apache", "apache,apache-2.0", 1.0)
    assert licenses.scan(data.empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href='/b>c'>More</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for all of you today</div><article><h1>Big &amp; small</h1><p>First   part
of <b>the</b> text with many words here.<p>Second<br>part</p><div class="ad">Buy now buy now buy</div><form><p>Your name please now</p></form><p>Last &lt;one&gt; &copy;</p>
<section id="comments"><p>I think this is a very fine page indeed</p></section></article><!-- <p>no</p> --><aside>Related reading</aside><script>var x = "<p>no</p>";</script><footer>&copy; site</footer></body></html>"""
MAIN = "Big & small\nFirst part of the text with many words here.\nSecond part\nLast <one> ©"


def test_extract_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (1, "u", PAGE, "x"), (4, "v", PAGE[: PAGE.index("</article>")], "x"), (5, "w", "<p>" + "word " * 30_000, "x")], "page_id long, url string, html string, text string")
    for w in (extract.Weights(), extract.train(pages)):
        got = {r["page_id"]: r for r in extract.extract(pages, w).collect()}
        assert got[1]["text"] == MAIN and got[1]["n_chars"] == len(MAIN)
        assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == MAIN
        assert len(got[5]["text"].split()) == 30_000
    assert extract.extract(pages.limit(0), extract.train(pages.limit(0))).count() == 0


def test_extract_keeps_lists_links_tables_and_divs(spark):
    prose = "".join(f"<p>Prose number {i} goes on for a dozen words or so in each paragraph.</p>" for i in range(4))
    inner = ("<ul>" + "".join(f"<li>Item {i} of the list</li>" for i in range(4)) + "</ul>", '<p>See <a href="/x">this page</a></p>', "<table><tr><td>One cell</td><td>Two cells</td></tr></table>", "<div><div>Short wrapped words</div></div>", '<ul><li><a href="/y">Linked item with words</a></li></ul>')
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad"><div>Buy now</div></div>'
    page = lambda body: f"<html><body>{menu}<article><h1>Head line</h1>{body}</article><footer><ul><li><a>Top</a></li></ul></footer></body></html>"
    labelled = spark.createDataFrame([(i, "u", page(prose)) for i in range(30)], "page_id long, url string, html string")
    w = extract.train(labelled)
    for x in inner:
        words = re.sub("<[^>]*>", " ", x).split()
        for body in (x + prose, prose + x, "<p>Brief start.</p>" + x + prose, prose + x + "<p>Brief end.</p>"):
            got = extract.text_of(page(body), w).split()
            assert got == ["Head", "line", *re.sub("<[^>]*>", " ", body).split()], (x, words)


def test_licenses_count_each_template_position_once(spark):
    whole = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "apache license " * 6), (2, whole), (3, whole.replace("charge", "all charge").replace("copy", "new copy")), (4, " ".join(reversed(whole.split()))), (5, "licensed under the apache license version 2 0 " * 3)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("apache", 1.0) and got[2] == ("mit", 1.0) and got[3][0] == "mit" and 0.75 < got[3][1] < 1.0
    assert got[4] == ("", 0.0) and got[5] == ("apache,apache-2.0", 1.0)


def test_pii_long_secrets_are_candidates():
    for s in ("0123456789abcdef" * 20, "sk-proj-" + "Ab3_" * 50):
        assert pii.candidates(f"key {s} end") == [(4, 4 + len(s), "secret", False)]
    assert pii.candidates("0123456789abcdef" * 20_000 + "g") == []


def test_extract_leaves_comments_and_teasers_out_but_not_text_with_such_names():
    w = extract.Weights()
    main = "<p>" + "main words here " * 20 + "</p>"
    of = lambda page: extract.text_of(page, w)
    got = of(f"<body><article>{main}<section class='comments'><article class='comment'><p>bad words</p></article></section>{main}<div id='disqus_thread'>bad</div></article></body>")
    assert "bad" not in got and got.count("main") == 40
    got = of(f"<body><aside><article class='teaser'><p>{'bad ' * 60}</p></article></aside><article>{main}<article>bad</article><ol class='comment-list'><li>bad</ol></article>")
    assert "bad" not in got and got.count("main") == 20
    got = of(f"<article>{main}<section id='navigation-methods'><p>good</p></section><div class='form-of-government'><p>good</p></div><h2 id='comments'>good</h2>{main}</article>")
    assert got.count("good") == 3
    assert of(f"<body><nav><ul><li>bad<article>{main}</article>").count("main") == 20  # what is never closed ends with the article
    assert "bad" not in of(f"<body><div class='site-header'>bad</div><div class='cookie-notice'>bad</div><article>{main}<footer>bad</footer></article>")


def test_extract_takes_time_linear_in_open_tags():
    import time

    for page in ("<span>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</i>" * 100_000, "<li><b>" * 50_000, "<a " * 100_000):
        began = time.perf_counter()
        extract.text_of(page, extract.Weights())
        assert time.perf_counter() - began < 5


def test_extract_region_is_the_best_of_all():
    import random

    rng = random.Random(5)
    w = extract.Weights()
    score = lambda x: w.word.get(x[1], w.word_default) * len(x[2].split()) if x[0] == "w" else w.tag.get(x[1], w.tag_default) if x[0] == "t" else 0.0
    for _ in range(200):
        items = [rng.choice([("w", rng.choice(["p", "a", "li"]), "x " * rng.randint(1, 4), True), ("t", rng.choice(["div", "p", "/p", "li", "a"]), "", True), ("-", "p", "off", True)]) for _ in range(rng.randint(0, 25))]
        s = [score(x) for x in items]
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        lo, hi = extract.best_region(items, w)
        assert abs(sum(s[lo:hi]) - best) < 1e-9


def test_licenses_labels_match_a_plain_alignment(spark):
    import random

    rng = random.Random(9)
    parts = [t for t, _ in licenses.TEMPLATES] + ["this software ", "apache license", "the mit license", "other words between"]
    texts = [" ".join(" ".join(rng.choice(parts).split()[rng.randint(0, 3) : rng.choice([None, 6, 12, -1])]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["this software " * 40, "apache license " * 6, "and or modify it under " * 9]
    want = []
    for t in texts:
        words, labels = t.split(), set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            if any(words[i : i + len(p)] == p for i in range(len(words))):
                labels.add(label)
        for template, label in licenses.TEMPLATES:
            p = template.split()
            hits = [(i, j) for i in range(len(words) - 1) for j in range(len(p) - 1) if words[i : i + 2] == p[j : j + 2]]
            best: dict = {}
            for i, j in hits:
                best[i, j] = 1 + max((n for (a, b), n in best.items() if a < i and b < j and abs((i - j) - (a - b)) <= licenses.DRIFT), default=0)
            if max(best.values(), default=0) >= licenses.COVER * (len(p) - 1):
                labels.add(label)
        want.append(",".join(sorted(labels)))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pii_candidates_match_a_plain_overlap_test():
    import random
    import time

    rng = random.Random(4)
    parts = ["123-45-6789", "10.0.0.1", "bob@example.org", "bob (at) example (dot) org", "+1 415 555 0136", "415-555-0136", "4111 1111 1111 1111", "My name is John Doe", "Alice Smith called Maria Lopez", "Dear Ann", "DE89 3704 0044 0532 0130 00", "sk-abcdefgh12345678", "plain words", "The End"]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", ", ", "-"]) for _ in range(rng.randint(0, 12)))
        want = [(a, b, k, True) for a, b, k in pii.base_spans(text)]
        for kind, found in pii._wide(text):
            want += [(a, b, kind, False) for a, b in found if all(b <= x[0] or a >= x[1] for x in want)]
        assert sorted(pii.candidates(text)) == sorted(want)
    found = {(text[a:b], k) for text in ("My name is John Doe", "Alice Smith called Maria Lopez", "a" * 100 + " [at] " + "b" * 80 + ".org") for a, b, k, _ in pii.candidates(text)}
    assert {("John Doe", "name"), ("Alice Smith", "name"), ("Maria Lopez", "name"), ("a" * 100 + " [at] " + "b" * 80 + ".org", "email")} <= found
    began = time.perf_counter()
    pii.candidates("123-45-6789 10.0.0.1 " * 20_000)
    assert time.perf_counter() - began < 5
