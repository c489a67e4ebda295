"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows, and clashing column names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lociframe.llm import anchors, decontam, dom, exact, extract, langid, mixing, near, scoring, substrings, suffix, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node string, start long, id string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
EMPTY = []


def _docs():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(70), say(4000)
    texts = [say(rng.randint(1, 200)) for _ in range(14)] + [passage + " " + say(30), say(20) + " " + passage, long, long + " x", long, None, "", " \t\n", "?!", "a" * 900, "ab " * 300]
    base = say(120).split()
    texts += [" ".join(base), " ".join(base[:60] + ["changed"] + base[61:]), "  ".join(base), "Ünïcode ß — " + say(90)]
    rows = [(k, t, "en" if k % 3 else None, [None, "big", "small", "big"][k % 4], k, "d", "n", k, "i") for k, t in enumerate(texts)]
    return [*rows, rows[14], (None, say(60), "en", "big", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


ROWS = _docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame(EMPTY, SCHEMA)


def _key(x):
    return (x is None, x if x is not None else 0)


def removed(units, length, earlier):
    """Brute force: flags of the units to remove in each row; ``units`` as (id, list)."""
    first, times = {}, Counter()
    for i, u in units:
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length])
            times[w] += 1
            first[w] = min(first.get(w, (True, math.inf)), _key(i))
    out = []
    for i, u in units:
        f = [False] * len(u)
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length])
            if first[w] < _key(i) if earlier else times[w] > 1:
                f[k : k + length] = [True] * length
        out.append(f)
    return out


@pytest.mark.parametrize("most", [anchors.MOST_CONTEXTS, 1])
def test_suffix_dedup(docs, most):
    units = [(r[0], list((r[1] or "").encode())) for r in ROWS]
    want = sorted((_key(i), len(u), sum(f), hashlib.sha256(bytes(b for b, x in zip(u, f, strict=True) if not x)).hexdigest()) for (i, u), f in zip(units, removed(units, 200, False), strict=True))
    got = sorted((_key(r["id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix.deduped(docs, most=most).collect())
    assert got == want


@pytest.mark.parametrize("most", [anchors.MOST_CONTEXTS, 1])
def test_substring_dedup(docs, most):
    units = [(r[0], (r[1] or "").encode().split()) for r in ROWS]
    want = sorted((_key(i), len(u), sum(f), hashlib.sha256(b" ".join(w for w, x in zip(u, f, strict=True) if not x)).hexdigest()) for (i, u), f in zip(units, removed(units, 50, True), strict=True))
    got = sorted((_key(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduped(docs, most=most).collect())
    assert got == want


def test_joined_symbols_keep_their_value():
    """Bytes take narrow symbols; numbers of words beyond 16 bits do not."""
    for parts in ([np.array([0, 255], np.uint8)], [np.array([70_000, 3]), np.array([0, 1 << 40])]):
        s, begin = suffix.joined(parts)
        assert s.tolist() == [x for p in parts for x in [*(p.astype(np.int64) + 2).tolist(), 1]] + [0] and begin.tolist() == [0, 3][: len(parts)]


def test_copies_are_decided_without_their_text(spark):
    """Where all contexts of a key are equal nothing is left for a solver."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    rows = [(3, text), (1, text), (2, "x" + "".join(rng.choice("qrstuvwxyz") for _ in range(900)))]

    def solver(data, windows, n, ids):
        raise AssertionError(f"{len(data)} contexts were sent")

    for relation, gone in (("anywhere", {1, 3}), ("earlier", {3})):
        found = anchors.repeats(spark.createDataFrame(rows, "doc_id long, text string"), anchors.Kind("byte", 200, 32), solver, relation).collect()
        assert {r["id"] for r in found} == gone
        for r in found:
            assert [x.tolist() for x in anchors.merged(r["spans"])] == [[0], [3000]]


@pytest.mark.parametrize("few", [0.01, 1, suffix.FEW])
def test_suffix_array_and_prefixes(few, monkeypatch):
    monkeypatch.setattr(suffix, "FEW", few)
    rng = np.random.default_rng(3)
    for trial in range(60):
        s = np.append(np.repeat(rng.integers(1, 5, 20), 1 + trial % 4), 0)
        want = sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())
        assert suffix.suffix_array(s).tolist() == want
        prefix = suffix.common_prefixes(s, np.array(want))
        for a, b in zip(want, want[1:], strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert prefix[b] == k


def test_exact_groups(docs, none):
    by = {}
    for r in ROWS:
        by.setdefault(SPACE.sub("", r[1] or ""), []).append(r)
    want = []
    for text, rows in by.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), _key(r[0])))[0]
        want += [(_key(r[0]), _key(keep), len(rows), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()) for r in rows]
    got = exact.groups(docs).collect()
    assert sorted((_key(r["id"]), _key(r["keep_id"]), r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in got) == sorted(want)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exact.groups(none).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    mph = exact.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(5000))
    assert exact.PerfectHash.build(keys[:0]).slots(keys[:2]).tolist() == [-1, -1]


def _set(text):
    w = SPACE.split((text or "").strip("\t\n\x0b\x0c\r "))
    w = [x for x in w if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs, none):
    sets = [_set(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))
    near_sets = {s: sum(1 for t in set(sets) if t and t != s and 5 * len(s & t) >= 4 * len(s | t)) for s in set(sets)}
    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    classes = {c: min((_key(ROWS[k][0]) for k in range(len(ROWS)) if root[k] == c), default=None) for c in set(root)}
    want = sorted((_key(r[0]), classes[root[k]] if sets[k] else _key(r[0]), near_sets[sets[k]] if sets[k] else 0) for k, r in enumerate(ROWS))
    got = near.linked(docs).collect()
    assert sorted((_key(r["id"]), _key(r["class_id"]), r["n_links"]) for r in got) == want
    assert near.keep_one(docs).columns == docs.columns
    assert near.linked(none).count() == 0


def test_jaccard_blocks(docs, monkeypatch):
    want = sorted(map(str, near.linked(docs).select("id", "class_id", "n_links").collect()))
    monkeypatch.setattr(near, "BLOCK", 1)
    assert sorted(map(str, near.linked(docs).select("id", "class_id", "n_links").collect())) == want


def test_language(docs, none, spark):
    rows = [(k, "the cat and the dog" if k % 2 else "le chat et le chien", "en" if k % 2 else "fr") for k in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the dogs"), (2, "les chiens"), (3, None), (4, "123 ?"), (None, "")], "doc_id long, text string")
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    assert got["the dogs"][0] == "en" and got["les chiens"][0] == "fr" and got[None] == got["123 ?"] == got[""] == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    assert langid.keep_known(docs).columns == docs.columns


def test_language_keeps_rare_words(spark):
    """A word rarer than 41,000 others of its language counts there, and a long word is learned."""
    many = ["".join("abcdefghij"[int(d)] for d in str(k)) for k in range(41_000)]
    long = "lang" * 20
    rows = [(k, " ".join(many), "en") for k in range(4)] + [(4, "tie tie tie", "en"), (5, "mot " * 100_000 + "tie", "fr"), (6, long, "fr")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.index[0]) == len(set(many)) + 3 and long in model.index[0]
    # 3.5 of 164,003 words in English, 1.5 of 100,002 in French, each total with half a count for every kind of word
    asked = spark.createDataFrame([(1, "tie")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(asked, model).collect()] == ["en"]
    want = [math.log(n / (total + 0.5 * (kinds + 1))) for n, total, kinds in ((3.5, 164_003, 41_001), (1.5, 100_002, 3))]
    assert np.allclose(model.logs[0][model.index[0]["tie"]], want)


def test_mixing(docs, none, spark):
    got = mixing.mix(docs, block_docs=2, period=20).collect()
    assert len(got) == len(ROWS) and len({r["mix_pos"] for r in got}) == len(ROWS)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    assert mixing.mixed(none).count() == 0
    many = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS source")
    order = sorted({(r["mix_slot"], r["source"]) for r in mixing.mix(many, {"a": 0.25, "b": 0.75}, block_docs=1).collect()})
    done = 0
    for t, source in order:
        done += source == "a"
        assert abs(done - 0.25 * (t + 1)) < 1


def test_schedule_meets_deadlines():
    for quota in ([1], [3, 0, 4], [7, 1, 1], [5, 5, 5, 1]):
        assert sorted((s, i) for s, i, *_ in mixing.schedule(quota)) == [(s, i) for s, q in enumerate(quota) for i in range(q)]


def test_decontamination(docs, spark):
    items = [(1, ROWS[14][1][:300]), (2, "too short"), (3, None), (4, "words that no document has at all here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["text"]): r for r in decontam.scored(docs, benchmark).collect()}
    assert {i for (i, _), r in found.items() if r["contaminated"]} == {14, 15} and len(found) == len(set((r[0], r[1]) for r in ROWS))
    w = ROWS[14][1].split()[:50]
    edited = " ".join(x if k % 9 else "changed" for k, x in enumerate(w))
    table = spark.createDataFrame([(1, edited), (2, " ".join(w[:8]))], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.scored(table, benchmark).orderBy("doc_id").collect()] == [True, False]
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("every", [5, 6, 7, 8])
def test_decontamination_of_edited_copies(spark, every):
    """The only copy of an item, with every fifth to eighth word replaced."""
    for size in (20, 40, 100):
        w = [f"w{every}x{k}" for k in range(size)]
        edited = "before it " + " ".join(x if (k + 1) % every else f"new{k}" for k, x in enumerate(w)) + " after it"
        table = spark.createDataFrame([(1, edited), (2, "nothing of the kind is said in here")], "doc_id long, text string")
        benchmark = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
        assert [r["contaminated"] for r in decontam.scored(table, benchmark).orderBy("doc_id").collect()] == [True, False]


def test_decontamination_of_parts_of_items(spark):
    """Passages across a cut of a long item, verbatim runs under half of an item, and items of under five words."""
    long, item = [f"long{k}" for k in range(650)], [f"item{k}" for k in range(59)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(item)), (3, "Quite short."), (4, "sole"), (5, "four words in all"), (6, "?!")], "item_id long, text string")
    cases = [
        (long[101:299], 1), (long[301:499], 1), (long[150:250], 1), (long[550:], 1), (long[195:208], 1), (item[:29], 2), (item[40:53], 2), (["say", "quite", "short"], 3), (["sole"], 4),
        (["four", "words", "in", "all"], 5), (item[:12], None), (long[200:212], None), (["quite", "a", "short", "one"], None), (["soles"], None),
    ]
    table = spark.createDataFrame([(k, "before " + " ".join(w) + " after") for k, (w, _) in enumerate(cases)], "doc_id long, text string")
    got = decontam.scored(table, benchmark).orderBy("doc_id").collect()
    assert [r["item"] if r["contaminated"] else None for r in got] == [i for _, i in cases]
    assert got[0]["item_score"] == 0.99 and got[1]["item_score"] == 0.99


def test_alignment():
    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max() / (2 * len(a))

    rng = np.random.default_rng(2)
    pairs = [((rng.integers(0, 4, rng.integers(5, 12)) * 4).astype(np.uint64), (rng.integers(0, 4, rng.integers(5, 20)) * 4).astype(np.uint64)) for _ in range(40)]
    assert np.allclose(decontam.align([a for a, _ in pairs], [b for _, b in pairs]), [plain(a, b) for a, b in pairs])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scoring(docs, none, order):
    texts = [(r[0], (r[1] or "").encode().split()) for r in ROWS]
    total = sum(len(w) for _, w in texts)
    count = lambda ws: Counter(tuple(ws[k - n + 1 : k + 1]) for n in range(1, order + 1) for k in range(n - 1, len(ws)))
    every = sum((count(w) for _, w in texts), Counter())
    want = []
    for i, w in texts:
        own, s = count(w), 0.0
        c = lambda g, own=own: every[g] - own[g]
        for k in range(len(w)):
            for n in range(order, 0, -1):
                g = tuple(w[max(0, k - n + 1) : k + 1])
                if n == 1:
                    s += math.log10(0.4 ** (order - 1) * (c(g) + 1) / (total - len(w) + 1))
                elif len(g) == n and c(g) > 0 and c(g[:-1]) > 0:
                    s += math.log10(0.4 ** (order - n) * min(1.0, c(g) / c(g[:-1])))
                    break
        want.append((_key(i), len(w), round(s / len(w), 6) if w else None))
    got = [(_key(r["id"]), r["n_words"], None if r["score"] is None else round(r["score"], 6)) for r in scoring.score(docs, order=order).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert scoring.score(none).count() == 0


def test_scoring_looks_at_two_words(spark):
    """By default a word is scored by the two before it: "b c" goes on with "d" after "a", with "e" after "x"."""
    texts = ["a b c d", "a b c d", "x b c e", "x b c e", "a b c e"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, third, second = ({r["id"]: r["score"] for r in scoring.score(table, **o).collect()} for o in ({}, {"order": 3}, {"order": 2}))
    assert got == pytest.approx(third) and got != pytest.approx(second)


def test_archives(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "u1", big), (2, "u\n2", big), (3, None, "small"), (4, "u4", "small"), (5, "u5", None), (None, "u6", big), (7, "u7", "\r\n\r\n" * 400), (7, "u7", "\r\n\r\n" * 400)]
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    refers = {1: 2, 0: 2}
    want = sorted((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (i or 0) in refers else "response", refers.get(i or 0)) for i, _, h in rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction(spark):
    article = "<h1>Title &amp; more</h1><p>First  paragraph,\nwith <b>bold</b> text.<p>Second one; it goes on for a while, as such things do.</p>"
    page = lambda k: f"<html><head><title>t</title><script>var a='<p>x</p>';</script></head><body><nav><a href='/'>Home {k}</a> <a href='/b'>Menu</a></nav><article>{article}<p>Number {k} here.</p></article><footer>&copy; someone</footer></body></html>"
    rows = [(k, f"u{k}", page(k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = extract.fit(pages)
    asked = [*rows[:2], (100, "u", None), (101, "u", ""), (102, "u", "<div class='post'>" + article + "</div><div class=comments><p>Nice one!</p></div>"), (None, "u", page(7) + "<b")]
    got = {r["page_id"]: r["text"] for r in extract.extracted(spark.createDataFrame(asked, "page_id long, url string, html string"), model).collect()}
    text = "Title & more\nFirst paragraph, with bold text.\nSecond one; it goes on for a while, as such things do."
    assert got[0] == text + "\nNumber 0 here." and got[1] == text + "\nNumber 1 here." and got[None] == text + "\nNumber 7 here."
    assert got[100] == got[101] == ""
    assert "Nice one!" not in got[102]


def test_decoding_is_consistent():
    page = dom.parse("<div><p>a</p><div><p>b</p></div></div>")
    kept = dom.decode(page, np.where(np.array(page.tag) == -1, 0.9, [0.9, 0.9, 0.9, 0.9, 0.001, 0.9, 0.9][: len(page.tag)]))
    assert "a" in kept


def test_pipeline(spark, tmp_path):
    rows = [(k, r[1], r[2], r[3], r[4]) for k, r in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ROWS[3][1] + " " + ROWS[4][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    classes = []
    by_text = {}
    for r in lettered:
        k = SPACE.sub("", r[1])
        if k not in by_text or len(r[1]) > len(by_text[k][1]):
            by_text[k] = r
    for r in sorted(by_text.values()):
        if not any(5 * len(_set(r[1]) & _set(c[1])) >= 4 * len(_set(r[1]) | _set(c[1])) for c in classes):
            classes.append(r)
    ids = {r["doc_id"] for r in got}
    assert ids <= {r[0] for r in classes} and len(ids) == len(got) >= len(classes) - 2


def test_windows_over_grams_that_occur_once_are_not_sorted(monkeypatch):
    """Only stretches whose grams repeat go to the suffix array; what is found stays that of all windows compared."""
    sizes, whole = [], suffix.suffix_array

    def noted(s):
        sizes.append(len(s))
        return whole(s)

    monkeypatch.setattr(suffix, "suffix_array", noted)
    rng = random.Random(4)

    def prose(n):
        return bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    shared, phrase, other = prose(230), prose(60), prose(200)
    # Twice in one context, over the end of one, and a phrase that is no window long.
    data = [prose(400) + shared + prose(300), shared[:215] + phrase + prose(500), prose(150) + phrase + prose(150), other + prose(40) + other, prose(250), shared[10:] + other[:190]]
    times = np.array([1, 1, 1, 1, 3, 1])
    windows = np.array([len(d) - 199 for d in data])
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = [{k for k in range(m) if t > 1 or seen[d[k : k + 200]] > 1} for d, m, t in zip(data, windows, times, strict=True)]
    got = suffix.repeated_windows(data, windows, times, np.arange(len(data)))
    assert [{k for x, m, _ in found for k in range(x, x + m)} for found in got] == want and sum(map(len, want)) > 80
    assert 0 < sizes[0] < sum(map(len, data)) // 2
