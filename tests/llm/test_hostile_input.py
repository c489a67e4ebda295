"""Input that is rare, huge or made to be slow."""

import gzip
import io
import json
import pickle
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import dom, extract, langid, near, tokens, warc


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, "the cat and the dog went on and on" if k % 3 else "le chat et le chien sont ici", "en" if k % 3 else "fr") for k in range(60)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_a_text_with_letters_has_a_learned_language(spark, model):
    texts = ["中文文本", "½ ² Ⅷ 12 %", "हिन्दी", "", None, "le chien", "THE dog ½"]
    got = [(r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model).collect()]
    assert [g[0] for g in got] == ["en", "und", "en", "und", "und", "fr", "en"]
    assert got[0][1] == got[1][1] == 0.0 and got[5][1] > 0.5
    assert langid.words("हिन्दी में x2y ½") == ["हिन्दी", "में", "x", "y"]


def test_samples_of_huge_tables_are_not_empty(spark, monkeypatch):
    """The threshold of the sample stays above 0 for any number of rows: as many as 2^50 here."""
    seen = []
    real = F.pmod

    def record(a, b):
        seen.append(b)
        return real(a, b)

    for module in (langid, extract):
        monkeypatch.setattr(module.F, "pmod", record)
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    langid.fit(rows, rows=20)
    assert str(1 << 62) in str(seen[-1]) and (langid.FIT_ROWS << 62) // (1 << 50) > 0 and (extract.FIT_PAGES << 62) // (1 << 50) > 0


@pytest.mark.parametrize("page", ["<b>" * 60_000, "<b>" * 30_000 + "</i>" * 30_000, "<div>" + "<b>" * 30_000 + "<p>x</p>" * 10_000, "<x>" * 30_000 + "<p>" * 30_000, "<td>" * 60_000])
def test_unclosed_tags_take_linear_time(page):
    began = time.thread_time()
    dom.parse(page)
    assert time.thread_time() - began < 3


def test_archives_are_read_in_linear_time():
    record = b"WARC/1.1\r\nContent-Length: 200\r\n\r\n" + b"x" * 200 + b"\r\n\r\n"
    data = gzip.compress(record * 60_000, 1)
    began = time.thread_time()
    zlib.decompress(data, 31)
    inflate = time.thread_time() - began
    stream, n = warc._Stream(io.BytesIO(data)), 0
    began = time.thread_time()
    while stream.header() is not None:
        stream.body(200, lambda part: None)
        stream.body(4, lambda part: None)
        n += 1
    assert n == 60_000 and time.thread_time() - began < max(1.0, 20 * inflate)


def test_sidecar_finds_every_record(spark, tmp_path):
    big = "<p>" + "x" * 2000
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "small"), (None, None, None)]
    folder = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), folder=folder).collect()}
    assert got[1].refers_to == 2 and got[1].record_type == "revisit" and got[2].record_type == "response" and got[None].payload_bytes == 0
    ids, refers, seen = {}, [], 0
    for index in Path(f"{tmp_path}/w").glob("*.index"):
        data = index.with_suffix("").read_bytes()
        for line in map(json.loads, index.read_text().splitlines()):
            head = zlib.decompress(data[line["offset"] : line["offset"] + line["length"]], 31).split(b"\r\n\r\n")[0].decode()
            said = warc.fields((head + "\r\n\r\n").encode())
            assert said["WARC-Record-ID"] == line["id"] and said["WARC-Date"][10] == "T" and said["WARC-Date"][-1] == "Z"
            ids[said.get("WARC-Page")] = said["WARC-Record-ID"]
            refers += [(said["WARC-Refers-To"], said["WARC-Refers-To-Page"])] if said["WARC-Type"] == "revisit" else []
            seen += 1
    assert seen == len(set(ids.values())) == 4 and refers == [(ids["<urn:page:2>"], "<urn:page:2>")]
    # What another run left in the folder is not read.
    again = warc.archived(spark.createDataFrame(rows[:1], "page_id long, url string, html string"), folder=folder)
    assert again.count() == 1


def test_stretches_of_repeated_words():
    import random

    import numpy as np

    from lociframe.llm import substrings

    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(0, 12) for _ in range(rng.randint(1, 6))]
        value = np.array([rng.randrange(rng.choice([3, 30])) for _ in range(sum(sizes))] or [0])
        first = np.concatenate(([0], np.cumsum(sizes))) if sum(sizes) else np.array([0, 1])
        starts, ends = substrings.stretches(value, first, 3)
        got = {(a, b) for a, b in zip(starts.tolist(), ends.tolist())}
        want = set()
        for x, y in zip(first, first[1:]):
            a = x
            for k in range(x, y + 1):
                if k == y or (value == value[k]).sum() == 1:
                    if k - a >= 3:
                        want.add((int(a), int(k)))
                    a = k + 1
        assert got == want


def test_a_worker_holds_the_language_model_in_few_bytes():
    """All words and n-grams of the sample are in the model; a worker that loads it holds 50 bytes an item at most, besides the frequencies."""
    words = [f"w{k:07d}" for k in range(50_000)]
    empty = langid.Rows([])
    sent = pickle.dumps(langid.Model(["en"], [langid.Rows(words), *[empty] * langid.LONGEST], [np.zeros((len(words), 1), np.float32)] + [np.zeros((0, 1), np.float32)] * langid.LONGEST))
    tracemalloc.start()
    try:
        model = pickle.loads(sent)
        rows = model.index[0].find([words[7], "none", words[-1]])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert rows.tolist() == [7, -1, len(words) - 1] and model.votes(["none", words[3]]).tolist() == [[0.0], [1.0]]
    assert held < 50 * len(words)


def test_texts_are_looked_at_in_small_portions(monkeypatch):
    """What a worker makes of texts, and what of that it keeps, does not add up to many times a batch."""
    monkeypatch.setattr(tokens, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    texts = ["some words of a text " * 100] * 4000
    tracemalloc.start()
    try:
        assert sum(1 for _, part in tokens.together(texts) for _ in near.sets(part)) == len(texts)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 32 << 20 and peak < 128 << 20
