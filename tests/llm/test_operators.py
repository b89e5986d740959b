"""Each operator against brute force, with awkward rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import decontamination, html_extraction, jaccard_join, language_id, quality_classifier, quality_rules
from evidentia.llm import sentencepiece_codec, substring_dedup, token_counts, url_filters
from evidentia.llm.base import table
from evidentia.llm.columns import Words
from evidentia.llm.components import components
from evidentia.session import shared_dir

from .common import EDGE, GIVEN, SF, edge_documents, rows_by, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def edge(spark):
    return edge_documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 1, 0), (10, 0, 0), (13, 0, 1), (None, 1, 0), (15, None, None)], "doc_id long, quality int, toxic int")


# Words


def test_words_and_sequences():
    rows = ["a b  c\td\n", "", None, "a b", "  x", "é b\x0bü", "a b c d e f a b c d e f"]
    found = Words(pa.array(rows))
    assert found.counts.tolist() == [len(words(t)) for t in rows]
    flat = [w for t in rows for w in words(t)]
    for a, b in itertools.combinations(range(len(flat)), 2):
        assert (flat[a] == flat[b]) == (found.hash[a] == found.hash[b])
    for length in (1, 2, 3, 5, 6):
        hashed, whole = found.sequences(length), found.whole(length)
        seen = {}
        for i in np.flatnonzero(whole):
            assert seen.setdefault(tuple(flat[i : i + length]), hashed[i]) == hashed[i]
        assert len(set(seen.values())) == len(seen)


# 1. Quality rules


def plain_counts(text):
    w = words(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, edge, labels):
    got = quality_rules.quality_rules(edge, labels)
    want = sorted(((i, *plain_counts(t)) for i, t in EDGE), key=repr)
    assert rows_by(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].base_failed and by_id[10].base_failed and not by_id[4].base_failed and by_id[4].kept
    assert by_id[8].n_grams == len("one two three") - 2
    none = quality_rules.quality_rules(edge, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score_sum == 0 for r in none)
    assert quality_rules.quality_rules(edge.limit(0), labels).count() == 0
    kept = quality_rules.keep_good(edge, labels)
    assert kept.schema == edge.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("kept").collect()}


# 2. Language


def test_language_on_held_out(spark):
    documents = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = language_id.identify(documents, language_id.train(documents)).where("held_out").collect()
    assert rows and sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edge):
    rows = spark.createDataFrame([(20 + i, t, l, None) for i, (t, l) in enumerate([("le chat noir est ici", "fr"), ("the cat is here now", "en")] * 20)], "doc_id long, text string, lang string, x int")
    model = language_id.train(rows)
    assert model.languages == ["en", "fr"]
    assert model.predict(["the cat", "le chat noir", "", None, "12 !?", "chats noirs"])[0] == ["en", "fr", "und", "und", "und", "fr"]
    assert model.predict(["日本語"])[0][0] in model.languages
    got = {r.doc_id: r for r in language_id.identify(edge, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0 and got[4].lang_pred in model.languages
    assert language_id.identify(edge, language_id.train(rows.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(edge.limit(0), model).count() == 0


# 3. SentencePiece


def test_codec(spark, edge):
    got = sentencepiece_codec.encode_decode(edge, P.path("piece_bpe_32k.model"), keep_text=True).collect()
    library = sentencepiece_codec.codec(open(P.path("piece_bpe_32k.model"), "rb").read()).library
    want = Counter()
    for i, t in EDGE:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.agrees for r in got)
    assert sentencepiece_codec.encode_decode(edge.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_array_and_heap_agree():
    codec = sentencepiece_codec.codec(open(P.path("piece_bpe_32k.model"), "rb").read())
    rng = np.random.RandomState(5)
    parts = ["".join(rng.choice(list("▁abcdeinorst\nß日éx"), n)) for n in rng.randint(1, 120, 400)]
    assert codec.encode_parts(parts) == [codec.encode_part(p) for p in parts]
    texts = ["".join(rng.choice(list(" abcdeinorst\n▁ß日éx"), 50)) for _ in range(200)]
    assert [list(x[0]) for x in codec.encode(texts)] == codec.library.encode(texts)


# 4. Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as all do.</div>%s<div class="ad">Buy this, now.</div>
<aside>Also read</aside><section id="comments"><p>Fine, really, a fine text, says a reader.</p></section>
<form><label>Name</label><input name=a></form><footer>&copy; 2024</footer></body></html>"""
BODY = """<%s><h1>Head &amp; line</h1><p>First   paragraph,
with <a href="#">a link</a> and more text.<p><b>Second</b> one &lt;here&gt;, it is longer than the first one.<br>Still it.</p><ul><li>One</li><li>Two</li></ul></%s>"""
MAIN = "Head & line\nFirst paragraph, with a link and more text.\nSecond one <here>, it is longer than the first one. Still it.\nOne\nTwo"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_extraction.main_text(PAGE % (BODY % (tag, tag))) == MAIN


def test_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", PAGE % (BODY % ("article", "article"))), (2, "u", PAGE % (BODY % ("article", "article"))), (3, "u", "plain &amp; simple"), (4, "u", "<article><p>cut &am"), (5, "u", "<p>a<"), (6, "u", "<script>x<y"), (7, "u", "<article>" + "<p>long text, it is. " * 20_000)]
    got = html_extraction.extract_main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    found = {r.page_id: r.text for r in got.collect()}
    assert found[1] == found[None] == found[6] == "" and found[2] == MAIN and found[3] == "plain & simple" and found[4] == "cut &am" and found[5] == "a<"
    assert found[7].count("\n") == 19_999 and got.where("n_chars <> length(text)").count() == 0
    assert html_extraction.extract_main_text(table(spark, SF, "pages").limit(0)).count() == 0


WRAPPERS = [
    '<div class="no-sidebar">%s</div>', '<div class="content-sidebar-wrap">%s</div>', '<div class="with-comments">%s</div>', '<div id="skip-none">%s</div>', '<div class="page form">%s</div>',
    '<form id="aspnetForm">%s</form>', '<form><div class="sidebar">%s</div></form>', '<div style="display: none">%s</div>', '<aside>%s</aside>', '<span class="side">%s</span>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_in_wrappers(wrapper, tag):
    page = PAGE % (BODY % (tag, tag))
    start = page.index("</head><body>") + len("</head><body>")
    whole = page[:start] + wrapper % page[start:].replace("</body></html>", "") + "</body></html>"
    assert html_extraction.main_text(PAGE % (wrapper % (BODY % (tag, tag)))) == MAIN
    assert html_extraction.main_text(whole) == MAIN


def test_main_text_and_doubted_elements():
    article = "<article><p>Short, but it is the article.</p>%s</article>"
    comment = '<div id="comments"><ol><li class="comment"><article><p>Ah, yes.</p></article></li></ol></div>'
    assert html_extraction.main_text(article % "" + comment) == "Short, but it is the article."
    assert html_extraction.main_text(article % '<p class="ad">Buy this.</p><p>An <span class="alert">odd</span> word<span hidden>less</span>.</p>') == "Short, but it is the article.\nAn odd word."
    assert html_extraction.main_text("<article><p>A.</p></article><footer>" + "Legal text, as ever. " * 9 + "</footer>") == "A."
    assert html_extraction.main_text("<html><head><title>T</title><body><p>No end of the head, a text.</p>") == "No end of the head, a text."


# 5. Decontamination


def naive_bm25(documents, items):
    """All verified pairs, every passage against every entry."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower()) if t else []
    entries = [(i, split(t)) for i, t in items if len(split(t)) >= decontamination.MIN_TERMS]
    n, mean = len(entries), sum(len(e) for _, e in entries) / max(1, len(entries))
    df = Counter(w for _, e in entries for w in set(e))

    def weights(e):
        tf = Counter(e)
        return {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(e) / mean)) for w, c in tf.items()}

    out = set()
    for doc, text in documents:
        terms = split(text)
        for at in range(0, max(1, len(terms)), decontamination.ENTRY):
            passage = terms[at : at + 2 * decontamination.ENTRY]
            pairs = set(zip(passage, passage[1:]))
            for item, e in entries:
                w = weights(e)
                if sum(v for x, v in w.items() if x in set(passage)) < decontamination.MIN_SCORE * sum(w.values()) - 1e-9:
                    continue
                original = dict(items)[item]
                cut = [m.end() for m in decontamination.SENTENCE.finditer(original) if original[m.end() :].strip()]
                k = len(split(original[: cut[-1]])) if cut else 0
                k = k if 0 < k < len(e) else len(e) // 2
                halves = []
                for part in (e[:k], e[k:]):
                    wanted = set(zip(part, part[1:])) or {part[0]}
                    halves.append(len(wanted & (pairs | set(passage))) / len(wanted))
                if min(halves) >= decontamination.MIN_OVERLAP:
                    out.add((doc, item))
    return out


def test_decontamination_matches_brute_force(spark):
    documents, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    text = {r.item_id: r.text for r in items.collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    changed = text[0].upper().split()
    changed[3] = changed[-6] = "CHANGED"
    rows += [(-1, f"{sentence(1, 70)} {text[1]} {sentence(2, 200)}"), (-2, f"{sentence(3, 150)} {' - '.join(changed)}"), (-3, " ".join(text[2].split()[:8])), (-4, None), (-5, " ".join(sorted(text[3].split())))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == naive_bm25(rows, list(text.items()))
    assert {(-1, 1), (-2, 0)} <= found and not {-3, -4, -5} & {d for d, _ in found}


def test_wand_matches_full_scores():
    rng = np.random.RandomState(2)
    entries = [np.unique(np.append(rng.zipf(1.4, 12) % 60, rng.randint(60))) for _ in range(500)]
    cut = pa.table({"entry": list(range(500)), "item_id": list(range(500)), "terms": [e.tolist() for e in entries], "answer_at": [1] * 500})
    df = Counter(int(t) for e in entries for t in e)
    raw = [{int(t): math.log1p(500 / df[int(t)]) for t in e} for e in entries]
    posted = [(i, t, w / sum(r.values())) for i, r in enumerate(raw) for t, w in r.items()]
    index = decontamination.Index(cut, pa.table({"entry": [p[0] for p in posted], "term": [p[1] for p in posted], "impact": [p[2] for p in posted]}))
    by = {(i, t): w for i, t, w in posted}
    for _ in range(60):
        asked = np.unique(rng.randint(0, 60, rng.randint(1, 25)))
        number = index.number(asked.astype(np.uint64))
        for least in (0.3, 0.5, 0.8):
            want = {i for i in range(500) if sum(by.get((i, int(t)), 0) for t in asked) >= least - 1e-9}
            assert {i for i, _ in index.retrieve(number[number >= 0], least)} == want
        first = index.candidates(np.zeros((number >= 0).sum(), np.int64), number[number >= 0])
        assert len(first) or not index.retrieve(number[number >= 0])


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([(1, GIVEN), (1, GIVEN), (2, None), (3, ""), (4, "too short"), (None, sentence(2, 40)), (5, sentence(4, 300)), (6, sentence(1, 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(edge, items).collect()}
    assert got == {(None, None), (12, 5), (4, 6), (5, 6), (6, 6), (7, 6)}
    clean = decontamination.drop_contaminated(edge, items)
    assert clean.schema == edge.schema and clean.count() == len(EDGE) - 7
    assert decontamination.contaminated(edge, items.limit(0)).count() == 0 and decontamination.drop_contaminated(edge, items.limit(0)).count() == len(EDGE)
    assert decontamination.contaminated(edge.limit(0), items).count() == 0


# 6. Classifier


def test_classifier_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in quality_classifier.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out").collect() if r.doc_id in truth]
    assert len(rows) > 40 and sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_classifier_edges(spark, edge, labels):
    scores = quality_classifier.quality_scores(edge, labels).collect()
    assert len(scores) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    assert {r.score for r in quality_classifier.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(edge.limit(0), labels).count() == 0
    values = np.random.RandomState(1).rand(800, len(quality_classifier.FEATURES)).astype(np.float32)
    label = (values[:, 3] + values[:, 5] > 1).astype(float)
    trees = quality_classifier.fit(values, label)
    score = trees.score(values)
    assert ((score > 0.5) == label).mean() > 0.95
    for row in (0, 17, 400):  # one row through the arrays, node by node
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if values[row, trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        assert abs(1 / (1 + math.exp(-total)) - score[row]) < 1e-9


# 7. Jaccard join


def brute_components(rows):
    def shingles(text):
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_jaccard_edges(spark, edge):
    got = jaccard_join.jaccard_join(edge)
    assert rows_by(got, "doc_id", "n_shingles", "component_id") == brute_components(EDGE)
    assert jaccard_join.jaccard_join(edge.limit(0)).count() == 0


@pytest.mark.parametrize("part", [2, 128])
def test_jaccard_chains(spark, part):
    """Chains of texts in which only neighbours link, texts around the threshold, and a shared passage."""
    rng = np.random.RandomState(7)
    rows, number = [], 0
    for chain in range(4):
        text = sentence(100 + chain, 60).split()
        for _ in range(25):
            rows.append((number, " ".join(text)))
            number += 1
            at = rng.randint(0, len(text))
            text = [*text[:at], f"new{number}", *text[at + 1 :]]
    shared = sentence(999, 45)
    for k in range(40):
        rows.append((number + k, f"{sentence(500 + k, k % 20)} {shared} {sentence(700 + k, 3)}"))
    order = rng.permutation(len(rows))
    documents = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(4)
    assert rows_by(jaccard_join.jaccard_join(documents, part=part), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_first_tokens_keep_the_guarantee():
    for n in range(1, 200):
        tokens = np.arange(n, dtype=np.uint64)
        size = len(jaccard_join.first_tokens(tokens, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        assert n - size < -(-75 * n // 100)  # what is not posted is too small for a link


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (9, 9), (10, 11), (12, 11), (13, 12), (14, 13), (20, 5), (5, 20), *((100, 100 + k) for k in range(1, 40))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 11: 10, 12: 10, 13: 10, 14: 10, 20: 5, **{100 + k: 100 for k in range(1, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8. Substring dedup


def brute_repeats(rows, length=35):
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1, substring_dedup.HOT])
def test_substring_edges(spark, edge, hot):
    got = substring_dedup.substring_dedup(edge, hot=hot)
    assert rows_by(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(EDGE)
    rest = substring_dedup.strip_repeats(edge, length_column="n_chars", hot=hot)
    assert rest.schema == edge.schema and rest.count() == len(EDGE)
    assert {r.doc_id: r.text for r in rest.collect()}[8] == "one two three"
    assert substring_dedup.substring_dedup(edge.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [3, substring_dedup.HOT])
def test_substring_passages(spark, hot):
    passage, periodic = sentence(50, 60), "a b c " * 30
    rows = [(k, f"{sentence(k, 20)} {passage[: 400 - 9 * (k % 12)]} {sentence(k + 40, 25)}") for k in range(60)]
    rows += [(100, periodic), (101, "x " + periodic), (102, sentence(1, 34)), (103, sentence(60, 35)), (104, sentence(60, 35)), (105, f"{sentence(61, 40)} {sentence(61, 40)}")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_by(substring_dedup.substring_dedup(documents, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)


# 9. URL filters


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (None, "http://a.example.org/en/12?x"), (3, "no scheme casino"), (4, "HTTP://WWW.Example.ORG/es/1#a"), (4, "HTTP://WWW.Example.ORG/es/1#a"),
        (5, "http://x.com/de/1"), (6, "http://x.com/fr/1"), (7, "http://com/fr/"), (8, "http://notexample.org/es/"), (9, "http://my.casino-x.net/"), (10, "http://x.net/a?u=http://casino.net/"),
        (11, "http://x.net/responsible-betting"), (12, "http://cheap-pills.net"), (13, "http://pillsbury.net/"), (14, "http://x.net/en/porn/"), (15, "://casino.net/x"), (16, "http://spam.filter.net/"),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[None] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7][2] == "com/fr/" and got[8][2:] == ("org/", "allow") and got[9][3] == "block" and got[10][3] == "allow" and got[12][3] == "block"
    assert got[13][3] == "allow" and got[14][3] == "block" and got[16] == ("spam.filter.net", "/", None, "allow")
    assert url_filters.url_verdicts(pages.limit(0)).count() == 0


def test_index_equals_all_rules(spark):
    """Candidates by token give the verdict of running every rule."""
    urls = [r.url for r in table(spark, SF, "pages").collect()]
    urls += [f"http://{a}{s}{b}.net/{c}" for a in ("casino", "xcasino", "my-casino", "ads", "free") for s in ("-", ".", "") for b in ("pills", "bets", "track") for c in ("", "xxx/", "porn", "viagra?")]
    rules = url_filters.build(spark.createDataFrame([(u,) for u in urls], "url string"), "url")
    for url in urls:
        blocked = any(p.search(url.lower()) for a, p in rules.compiled if not a)
        allowed = any(p.search(url.lower()) for a, p in rules.compiled if a)
        assert rules.pattern_verdict(url) == ("block" if blocked and not allowed else "allow"), url


# 10. Token counts


def test_token_counts(spark, edge):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = "don't we'll I'M 'S it’s 10% ½ ² àÿ×÷ a''s <|startoftext|>x İß"
    documents = edge.select("doc_id", "text").union(spark.createDataFrame([(30, odd)], "doc_id long, text string"))
    got = token_counts.token_counts(documents, path)
    want = []
    for i, t in [*EDGE, (30, odd)]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert rows_by(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(edge.limit(0), path).count() == 0


def test_jaccard_template_families_ask_nothing(spark, monkeypatch):
    """Texts that share 85 of 100 shingles (similarity 0.74): no link, and no pair of them is opened."""
    asked = []
    ask = jaccard_join._ask
    monkeypatch.setattr(jaccard_join, "_ask", lambda d, t, rows, h: asked.append(rows.count()) or ask(d, t, rows, h))
    core = " ".join(f"c{i}" for i in range(89))
    rows = [(i, core + " " + " ".join(f"u{i}x{j}" for j in range(15))) for i in range(400)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("doc_id <> component_id").count() == 0
    assert sum(asked) == 0, asked


def test_substrings_of_many_equal_rows(spark):
    """Rows with the same id and text have one list of spans between them."""
    text = sentence(90, 200)
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows, spans = substring_dedup._with_spans(docs, "doc_id", "text", substring_dedup.LENGTH, substring_dedup.SEED, substring_dedup.HOT)
    assert rows.agg(F.max(F.size(spans))).first()[0] <= 200
    found = substring_dedup.substring_dedup(docs)
    assert found.where("n_removed = 200").count() == 3000


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    items = [(1, "zeta kappa omega rho"), (2, "日本語の問題は何ですか。答えは東京です。"), (3, "one"), (4, "alpha beta")]
    rows = [
        (1, f"{sentence(1, 40)} Zeta, kappa omega rho {sentence(2, 40)}"),
        (2, f"{sentence(1, 40)} zeta kappa rho omega {sentence(2, 40)}"),
        (3, "前の文です。日本語の問題は何ですか。答えは東京です。後の文です。"),
        (4, "日本の東京は大きい町です。問題はありません。"),
        (5, "one two three"),
        (6, "beta alpha"),
        (7, "x alpha beta y"),
        (8, f"{sentence(5, 200)} alpha {sentence(6, 200)} beta"),
    ]
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 2), (7, 4)}


def test_a_broken_agenda_shows(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        own = sentencepiece_codec.Codec(file.read())
    texts = ["The quick brown fox", "", "ﬁ ＡＢ 日本語"]
    right = own.encode(texts)
    assert all(x[2] for x in right)
    broken = type(own)(own.library.serialized_model_proto())
    monkeypatch.setattr(type(own), "encode_parts", lambda self, parts: [[0] for _ in parts])
    wrong = broken.encode(texts)
    assert [x[0] for x in wrong] == [x[0] for x in right] and [x[2] for x in wrong] == [False, True, False]


def test_jaccard_leaves_no_rows_of_its_steps_on_disk(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/evidentia"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [(k, " ".join([*sentence(900 + k // 5, 60).split()[: 58 + k % 3], f"new{k}"])) for k in range(60)]
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), part=2)
    left = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"shared", "postings", "tokens", "wanted", "mixed", "near", "asked", "opened"}
    assert rows_by(found, "doc_id", "n_shingles", "component_id") == brute_components(rows)
