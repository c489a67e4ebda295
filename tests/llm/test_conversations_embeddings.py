"""Chat formatting, hard negatives and whitening against plain Python, on small tables with nulls, ties, rings and clashing columns."""

import hashlib
import math
import random
import time

import numpy as np
import pytest

from lociframe.llm import chat, negatives, queries, whitening

NASTY = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> <<SYS>>x<</SYS>>", "", None, " leading and trailing ", "<<s>[[INST]", "a\nb", "ünïcode 🙂 </s>", "\\", "x" * 200_000, "<", "[INST", "s>"]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = [t for t in NASTY if t is not None] + ["".join(rng.choice(["<", ">", "[", "]", "/", "\\", "s", "INST", "SYS", " "]) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(chat.F.col("t")).alias("e")).collect()
    for r in rows:
        assert chat.unescape(r.e) == r.t
        assert not any(mark in r.e for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def _branches(rows, best):
    """(id path, mean score) of the chosen branches by walking up from every leaf."""
    ids = {r[0] for r in rows}
    up = {r[0]: r[1] if r[1] in ids else None for r in rows}
    for start in sorted(ids):  # cut each ring at its least id
        path, at = [], start
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is not None:
            up[min(path[path.index(at) :])] = None
    score = {r[0]: 0.0 if r[2] is None or math.isnan(r[2]) else r[2] for r in rows}
    trees = {}
    for leaf in ids - set(up.values()):
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = up[at]
        trees.setdefault(path[-1], []).append((-sum(score[p] for p in path) / len(path), f"i{leaf}", path[::-1]))
    return sorted(x[2] for t in trees.values() for x in sorted(t)[:best])


@pytest.mark.parametrize("best", [1, 2, None])
def test_reply_trees(spark, best):
    rng = random.Random(3)
    rows = [(0, None, None, "user", "root")]
    for k in range(1, 150):
        rows.append((k, rng.choice([None, rng.randrange(k), rng.randrange(k), k - 1, 999]), rng.choice([0.0, 0.5, 1.0, float("nan"), None]), rng.choice(["user", "assistant", "system", None, "to\\ol\n"]), rng.choice(NASTY[:9])))
    rows += [(200, 202, 1.0, "user", "ring"), (201, 200, 1.0, "user", "ring"), (202, 201, 1.0, "assistant", "ring"), (203, 201, 1.0, "assistant", "off the ring"), (204, 204, 0.0, "user", "itself")]
    rows += [(1000 + k, 999 + k if k else None, 0.0, "assistant", f"t{k}") for k in range(70)]
    df = spark.createDataFrame([(*r, f"extra{r[0]}", r[0]) for r in rows], "id long, parent long, score double, role string, text string, node string, leaf long").repartition(3)
    got = chat.conversations(df, "id", "parent", score_col="score", keep=["node"], best=best).collect()
    of = {r[0]: r for r in rows}
    want = _branches(rows, best)
    by_leaf = {r.leaf_id: r for r in got}
    assert sorted(by_leaf) == sorted(p[-1] for p in want) and len(got) == len(want)
    for path in want:
        r = by_leaf[path[-1]]
        assert r.node == f"extra{path[-1]}" and r.n_turns == len(path)
        said = [(of[p][3] or "", of[p][4] or "") for p in path]
        assert list(chat.parse(r.formatted)) == said
        assert [chat.unescape(r.formatted[s.begin : s.end]) for s in r.loss] == [t for role, t in said if role == "assistant"]


def test_messages_without_id_and_copies(spark):
    schema = "id long, parent long, role string, text string"
    df = spark.createDataFrame([(None, 1, "assistant", "lost"), (None, 1, "assistant", "lost"), (1, None, "user", "q"), (1, None, "user", "q"), (None, None, None, None)], schema)
    got = sorted((r.leaf_id is None, r.formatted, r.n_turns) for r in chat.conversations(df, "id", "parent").collect())
    # A message without an id still replies to its parent.
    assert got == [(True, "<s><<SYS>>\n<</SYS>>", 1), (True, "<s>[INST] q [/INST] lost </s>", 2)]
    assert chat.conversations(df.limit(0), "id", "parent").count() == 0


def test_conversation_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "to\nol"]), rng.choice(NASTY)) for c in range(6) for t in range(rng.randint(1, 9))]
    rows += [(2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, None, None, None), (None, 1, "assistant", "x"), (7, None, "assistant", "first")]
    schema = "conv_id long, turn long, role string, text string, message long, prev string"
    spark.createDataFrame([(*r, 5, "p") for r in rows], schema).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op11_chat_formatting"](spark, str(tmp_path)).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (low(x[1]), text(x[2]), text(x[3])))
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= 3 + sum(len(x[3] or "") for x in turns)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, norm string, copy long, v int"


def _vectors(n, d, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, d))
    rows = []
    for k in range(n):
        v = middle[k % 5] + 0.6 * rng.normal(size=d)
        rows.append([k, [float(np.float32(x)) for x in v / np.linalg.norm(v) * rng.choice([1.0, 1.0, 3.0])], int(rng.integers(0, 10))])
    for k in range(40, 90):
        rows[k][1] = rows[40][1]  # ties
    rows[7][1], rows[8][1], rows[9][2], rows[11][1] = None, [None] * d, None, [float("nan")] + [0.1] * (d - 1)
    rows[13][1], rows[17][1], rows[19][1] = [float("inf")] * d, [0.0] * d, [0.5] * (d - 1)
    rows += [[100, rows[100][1], 3], [None, rows[40][1], 2], [None, rows[200][1], 2]]
    return [tuple(r) + ("x", 1, 2) for r in rows]


def _mined(rows, d, share=(80, 100)):
    """Every score of every anchor."""
    ok = [(k, i, v, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for k, (i, v, lab, *_) in enumerate(rows) if lab is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(256 * c) for c in v] for _, _, v, _ in ok]
    out = []
    for a, (k, i, _, lab) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x[a], x[b], strict=True)), j is None, j or 0, b) for b, (_, j, _, _) in enumerate(ok) if b != a)
        for ps, pn, pi, _ in [s for s in scored if ok[s[3]][3] == lab][:5]:
            fit = [s for s in scored if ok[s[3]][3] != lab and share[0] * -ps <= share[1] * -s[0] <= share[1] * -ps][:5]
            out += [(i, None if pn else pi, r, None if s[1] else s[2], -ps, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, tmp_path, monkeypatch):
    for name, value in (("BLOCK", 128), ("ANCHOR_BLOCK", 3), ("WINDOW", 16), ("STRIPE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = _vectors(700, 8)
    spark.createDataFrame(rows, EMBEDDINGS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    assert got.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined(rows, 8)
    assert want and sorted(map(tuple, got.collect()), key=repr) == want


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    m = np.floor(256 * rng.normal(size=(600, 6)) * rng.choice([1, 1, 50], size=(600, 1)))
    m[3] = 0
    refs = m[:9] / np.maximum(np.linalg.norm(m[:9], axis=1), 1)[:, None]
    norm = np.linalg.norm(m, axis=1)
    angles = np.arccos(np.clip(np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0) @ refs.T, -1, 1))
    angles[3] = 0
    low, high = negatives.bounds(norm[:20], angles[:20], np.array([norm, norm]), angles, angles)
    scores = m[:20] @ m.T
    assert (low <= scores).all() and (scores <= high).all()
    assert (high < np.outer(norm[:20], norm) * 0.9).mean() > 0.2


def test_huge_components_stay_exact(spark):
    big = float(2**20)  # products beyond what doubles hold
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 2), (3, [1.0, 1.0], 2), (4, [1e300, -1e300], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in negatives.mine(df).collect()]
    assert got == [(0, 1, 1, 2, (2**28) ** 2 + 256 * 768, (2**28) ** 2 + 256 * 512)]
    vast = spark.createDataFrame([(0, [1e300], 1), (1, [1e200], 1), (2, [1e250], 2)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in negatives.mine(vast).collect()] == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    assert negatives.mine(none).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0, 0.5], 1, "", 0, 0)], EMBEDDINGS)).count() == 0
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [], 1, "", 0, 0), (2, None, 1, "", 0, 0)], EMBEDDINGS)).count() == 0


def test_scatter_of_bit_planes():
    rng = np.random.default_rng(2)
    for n, bits in ((1, 1), (63, 5), (64, 11), (200, 17), (130, 40)):
        x = rng.integers(0, 1 << bits, size=(n, 5))
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert whitening.scatter(x, bits).tolist() == want


def test_whitening(spark):
    rows = _vectors(900, 6)
    df = spark.createDataFrame(rows, EMBEDDINGS).repartition(3)
    ok = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) == 6 and all(x is not None and math.isfinite(x) for x in r[1])]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in ok]
    n, sums = len(x), [sum(r[k] for r in x) for k in range(6)]
    off = [[n * r[k] - sums[k] for k in range(6)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(6)] for i in range(6)])
    e, vec = np.linalg.eigh(cov)
    got = whitening.whitened(df, components=4).collect()
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    assert sorted({(r.id is None, r.id or 0, r.deviation) for r in got}) == sorted({(i is None, i or 0, sum(c * c for c in o)) for (i, _), o in zip(ok, off, strict=True)})
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-9
    white = {}
    for r in got:
        white.setdefault((r.id, r.deviation), {})[r.component] = r.whitened
        assert r.explained == pytest.approx(e[::-1][r.component - 1] / e.sum(), rel=1e-9)
    for c in range(1, 5):
        want = np.array(off) / n @ vec[:, -c] / math.sqrt(e[-c])
        mine = np.array([white[i, sum(q * q for q in o)][c] for (i, _), o in zip(ok, off, strict=True)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


def test_whitening_without_variance(spark):
    rows = [(k, [0.25, float(k), 2.0 * k]) for k in range(10)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 30 and all((r.whitened is None) == (r.component > 1) for r in got)
    assert got[0].identity_error < 1e-9
    one = whitening.whitened(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 0, None, 0.0, None) for c in (1, 2, 3)]


def test_totals_beyond_32_bits(spark):
    """Counts of n-grams are summed as 64-bit numbers: blocks that together have a word more than 2^32 times."""
    from lociframe.llm import scoring

    rows = [(0, b, [7, 9 + b], [2**31 - 1, 5]) for b in range(5)] + [(1, 0, [1 << 62], [3])]
    asked = spark.createDataFrame(rows, "bucket long, block long, keys array<long>, counts array<int>")
    got = {(r.block, r.bucket): list(r.answer) for r in scoring.totals(asked, 3).collect()}
    assert got == {(b, 0): [0, 5 * (2**31 - 1)] for b in range(5)}
    plan = scoring.totals(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    from lociframe.llm import scoring

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "d", "ee", "f" * (k % 3 + 1)]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted((r.id, r.n_words, r.score and round(r.score, 9)) for r in scoring.score(df).collect())
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 200)
    assert sorted((r.id, r.n_words, r.score and round(r.score, 9)) for r in scoring.score(df).collect()) == whole


def test_ngrams_are_counted_in_slices(spark, monkeypatch):
    """The n-grams of a larger corpus are not shuffled together: each slice has keys of its own, its shuffle files are gone when it is done, and nothing is left out."""
    from lociframe.llm import scoring

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getPath() for f in (files.apply(k) for k in range(files.length())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    rng = random.Random(5)
    rows = [(k, " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(0, 80)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted((r.id, r.n_words, r.score and round(r.score, 9)) for r in scoring.score(df).collect())
    asked, totals = [], scoring.totals
    monkeypatch.setattr(scoring, "totals", lambda rows, parts: asked.append(rows) or totals(rows, parts))
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(scoring, "SLICE_BYTES", 1000)
    pinned = df.checkpoint()
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    got = scoring.score(pinned)
    for _ in range(50):
        if len(left := shuffled() - before) <= 3:  # the sizes of the blocks, a row a partition
            break
        time.sleep(0.2)
    assert len(left) <= 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted((r.id, r.n_words, r.score and round(r.score, 9)) for r in got.collect()) == whole
    keys = [{k for r in a.collect() for k in r["keys"]} for a in asked]
    n = [t.split() for _, t in rows]
    every = {tuple(w[k : k + m]) for w in n for m in (1, 2, 3) for k in range(len(w) - m + 1)}
    assert len(keys) == 4 and sum(map(len, keys)) == len(set().union(*keys)) == len(every)
    assert max(map(len, keys)) < 0.4 * len(every)
