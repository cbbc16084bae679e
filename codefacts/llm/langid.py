"""Language ID by rank-order profiles of character n-grams (out-of-place distance).

A profile is the ``size`` most frequent 1-, 2- and 3-grams of a language, by rank. A document's
own profile is compared with each: an n-gram costs the difference of its ranks, or ``size``
where the language lacks it. N-grams are integers, counted by sorting arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import annotated, sliced, spread

SIZE = 300
STEP = 1 << 20  # places counted at once
HELD = 1 << 18  # n-grams of texts that wait to be added up, in all languages together
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a lower-cased text; what isn't a letter is one border, written 1.

    A long text is counted STEP places at a time, each with the two after it, so its counts are those of the whole.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.where(_letters()[c], c, np.uint32(1))
    c = np.concatenate([[np.uint32(1)], c, [np.uint32(1)]])
    c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
    if len(c) < 3:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    found = [_grams(c[at : at + STEP + 2].astype(np.uint64), STEP) for at in range(0, len(c) - 1, STEP)]
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return codes, np.bincount(back, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def _grams(c: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin at the first ``places`` places of c, which holds two more of the text if there are."""
    two = c[:-1] | c[1:] << np.uint64(21)
    three = (two[:-1] | c[2:] << np.uint64(42))[c[1:-1] != 1]
    one = c[:places]
    every = np.concatenate([one[one != 1], two[:places], three])
    every.sort()
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[start], np.diff(start, append=len(every))


def added_up(rows: Iterable[tuple[str, str]], most: int = HELD, whole: int = 500_000) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, n-grams, counts) of rows of (text, language), in parts that add up to the counts of all rows.

    What waits is added up as soon as it is ``most`` n-grams, and as many as the sums have, however
    long or many the texts; sums of more than ``whole`` n-grams of a language go out.
    """
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = total = 0

    def add(name: str) -> None:
        parts = [*([sums[name]] if name in sums else []), *waiting.pop(name)]
        codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        sums[name] = codes, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for text, name in rows:
        found = grams(text)
        waiting.setdefault(name, []).append(found)
        size += len(found[0])
        if size >= max(most, total):
            for each in list(waiting):
                add(each)
                if len(sums[each][0]) > whole:
                    yield each, *sums.pop(each)
            size, total = 0, sum(len(codes) for codes, _ in sums.values())
    for each in list(waiting):
        add(each)
    for name, (codes, n) in sums.items():
        yield name, codes, n


def profiles(docs: DataFrame, size: int = SIZE, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, counted over all rows with a text and a language.

    ``size`` integers for each language come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in sliced(batches) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for name, codes, n in added_up(rows):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    d = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counted = spread(d).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "gram", "r").collect():
        found.setdefault(row.lang, []).append((row.r, row.gram))
    return {name: np.array([g for _, g in sorted(rows)], dtype=np.int64).view(np.uint64) for name, rows in sorted(found.items())}


class Ranks:
    """The profiles of all languages as one table of ranks."""

    def __init__(self, found: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = list(found), size
        self.grams = np.unique(np.concatenate([*found.values(), np.empty(0, dtype=np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, len(found)), -1, dtype=np.int64)
        for k, g in enumerate(found.values()):
            self.ranks[np.searchsorted(self.grams, g), k] = np.arange(len(g))

    def guess(self, text: str | None) -> tuple[str, float]:
        codes, n = grams(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        # the most frequent first; of equals the least n-gram, as in the profiles
        top = codes[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == top[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        r = self.ranks[at]
        away = np.where(r < 0, self.size, np.abs(r - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(top))


def identified(docs: DataFrame, found: dict[str, np.ndarray], size: int = SIZE, text: str = "text") -> DataFrame:
    """docs with lang_pred and score for every row (columns of those names are replaced).

    score is 1 less the share of the largest possible out-of-place distance. Equal distances go
    to the first language by name. A text that is null or has no letter, and any text where no
    language was learned, is ``und`` with score 0. The whole text counts.
    """

    def of() -> Callable[[list[str]], dict[str, list]]:
        model = Ranks(found, size)

        def work(texts: list[str]) -> dict[str, list]:
            got = [model.guess(t) for t in texts]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    return annotated(docs, of, "lang_pred string, score double", text)
