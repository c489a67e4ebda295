"""Language identification by known words first, then by ever shorter character n-grams.

A word of the model is scored by its log frequency in each language. A word it does not have is scored by the mean log frequency of
its known 5-grams, or if it has none by its 4-grams, and so on down to single letters. Each word votes with the
probabilities that follow from its scores, and the language with the largest share of the votes is predicted; the share is the score.

Defined results: a text that is null or has no letter is ``und`` with score 0; one with letters of which the model knows none is the language with the most
fitted words, with score 0; ties go to the language that sorts first; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin

#: Letters, with the marks that belong to them; digits, fractions and numerals are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 5
#: Labelled rows fitted on, about. It is the only bound of the model, which keeps all words and n-grams of these rows.
FIT_ROWS = 20_000
CACHED = 150_000
PIECES = 2_500  # words whose n-grams are counted together


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; single letters without marks."""
    if n == 1:
        return list(word)
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Rows:
    """Row numbers of distinct strings, found by their 64-bit hashes, of which two of a million strings agree with a probability of 1 in 10^7.

    A string takes its bytes and 12 more, where a dict of strings takes over 100; every worker holds the whole model."""

    def __init__(self, items: list[str]):
        self.size, self.text, self.hash, self.row = len(items), "\n".join(items).encode("utf-8", "surrogatepass"), None, None

    def __getstate__(self) -> tuple:
        return self.size, self.text

    def __setstate__(self, state: tuple) -> None:
        self.size, self.text = state
        self.hash = self.row = None  # made where they are used, as processes hash strings differently

    def __len__(self) -> int:
        return self.size

    def find(self, items: list[str]) -> np.ndarray:
        """The row of each item, -1 for those that are not there."""
        if self.hash is None:
            made = np.fromiter(map(hash, self.text.decode("utf-8", "surrogatepass").split("\n") if self.size else ()), np.int64, self.size)
            self.row = np.argsort(made).astype(np.int32)
            self.hash = made[self.row]
        asked = np.fromiter(map(hash, items), np.int64, len(items))
        if not self.size:
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.hash, asked), self.size - 1)
        return np.where(self.hash[at] == asked, self.row[at], -1)

    def __contains__(self, item: str) -> bool:
        return bool(self.find([item])[0] >= 0)

    def __getitem__(self, item: str) -> int:
        row = int(self.find([item])[0])
        if row < 0:
            raise KeyError(item)
        return row


@dataclass
class Model:
    langs: list[str]
    index: list[Rows]  # rows of known words (0) and of n-grams by length
    logs: list[np.ndarray]  # log frequency in each language, a row an item
    usual: int = 0  # the language with the most words

    def votes(self, asked: list[str]) -> np.ndarray:
        """A row of votes for each word: a known word by itself, else by its longest known n-grams; zeros without any."""
        out = np.zeros((len(asked), len(self.langs)))
        left = np.arange(len(asked))  # words without a vote yet
        for n in (0, *range(LONGEST, 0, -1)):
            if not len(left):
                break
            pieces = [[asked[k]] if n == 0 else grams(asked[k], n) for k in left]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in pieces])
            row = self.index[n].find([g for p in pieces for g in p])
            owner, row = owner[row >= 0], row[row >= 0]
            if len(row):
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                count = np.diff(np.append(begin, len(owner)))
                scores = np.add.reduceat(self.logs[n][row], begin, axis=0, dtype=np.float64) / count[:, None]
                e = np.exp(scores - scores.max(axis=1, keepdims=True))
                out[left[owner[begin]]] = e / e.sum(axis=1, keepdims=True)
                left = np.delete(left, owner[begin])
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` of the labelled rows, chosen by a hash of the id; all of them if there are fewer."""
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 62)) < F.lit((rows << 62) // n))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                seen[lang].update(words(text))
            yield pd.DataFrame([(lang, w, k) for lang, c in seen.items() for w, k in c.items()], columns=["lang", "word", "n"])

    counted = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInPandas(count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[k : k + PIECES] for b in batches for k in range(0, len(b), PIECES)):
            seen: Counter = Counter()
            for lang, word, k in batch.itertuples(index=False):
                seen[lang, 0, word] += k
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        seen[lang, size, g] += k
            yield pd.DataFrame([(*key, k) for key, k in seen.items()], columns=["lang", "size", "item", "n"])

    items = pin(counted.mapInPandas(pieces, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n")))
    totals = {(r["lang"], r["size"]): (r["total"], r["kinds"]) for r in items.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    langs = sorted({lang for lang, _ in totals})
    index, logs = [], []
    for size in range(LONGEST + 1):  # one table at a time in the driver
        part = items.where(F.col("size") == size).select("item", "lang", "n").toArrow()
        item, lang = (pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in part[name].chunks)]).dictionary_encode() for name in ("item", "lang"))
        known = item.dictionary.to_pylist()
        table = np.full((len(known), len(langs)), 0.5)  # half a count for what a language does not have
        column = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)
        table[item.indices.to_numpy(), column[lang.indices.to_numpy()]] += part["n"].to_numpy()
        base = [math.log(totals.get((lang, size), (0, 0))[0] + 0.5 * (totals.get((lang, size), (0, 0))[1] + 1)) for lang in langs]
        index.append(Rows(known))
        logs.append((np.log(table) - np.array(base)).astype(np.float32))
    return Model(langs, index, logs, max(range(len(langs)), key=lambda k: totals.get((langs[k], 0), (0, 0))[0], default=0))


class _Votes(dict):
    """Rows of ``table`` for the words met; their votes are computed once, those of all new words of a text together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.table = np.zeros((0, len(model.langs)))

    def total(self, found: list[str]) -> np.ndarray:
        """Sum of the votes of the words."""
        if len(self) > CACHED:
            self.clear()
        rows = list(map(self.get, found))
        if None in rows:
            new = list(dict.fromkeys(w for w, row in zip(found, rows, strict=True) if row is None))
            first = len(self)
            if first + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:first], np.zeros((first + 2 * len(new), len(self.model.langs)))])
            self.table[first : first + len(new)] = self.model.votes(new)
            self.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(self.get, found))
        return self.table.take(rows, axis=0).sum(axis=0)


def judge(model: Model, texts: list[str | None], cache: _Votes) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        found = words(text)
        total = cache.total(found) if found and model.langs else np.zeros(1)
        if not total.any():
            # Letters, but none that the model has seen: the usual language, with no confidence.
            langs.append(model.langs[model.usual] if found and model.langs else "und")
            scores.append(0.0)
            continue
        best = int(total.argmax())
        langs.append(model.langs[best])
        scores.append(float(min(1.0, total[best] / len(found))))
    return langs, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = _Votes(shared.value)
        for batch in batches:
            langs, scores = judge(shared.value, batch.tolist(), cache)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn("__p", predicted(F.col(text_col))).withColumn(lang_out, F.col("__p.lang")).withColumn(score_out, F.col("__p.score")).drop("__p")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """The documents whose language is known with a share of the votes of ``least`` at least."""
    model = fit(docs.where(~held_out(id_col)), id_col)
    return predict(docs, model, lang_out="__lang", score_out="__score").where((F.col("__lang") != "und") & (F.col("__score") >= least)).drop("__lang", "__score")
