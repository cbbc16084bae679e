"""Line dedup by winnowing: delete later copies of repeated runs of lines.

Natively: arrays and joins, no Python on the executors.

* The lines of a text that aren't blank are hashed. From every line the shortest run that
  qualifies is taken both ways: ``window`` lines, or fewer if they have ``min_words`` words.
* Of the lines of a run, the window, that of least hash is its fingerprint. As it depends on the
  run alone, every copy of a run selects it: places whose line is nowhere the least of a run
  are never shuffled, and runs whose fingerprint stands at one place only have no copy.
* Places are joined on fingerprints that recur. From such a place the match extends both ways, to
  the runs around it that selected it; each of them is compared with its first place, in order of
  (doc_id, text, line), so a place meets one earlier place and never all others, however frequent
  its line is.
* Runs that have an earlier place are merged - their union is the longest match in both
  directions - and deleted. Lines that merely recur outside such runs stay, and so do blank lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import staged

WINDOW = 3
MIN_WORDS = 50
WORDS = 1 << 20  # 64-bit words of the bit set that tells which documents surely lose nothing


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """(place, hash, words) of the lines that aren't blank."""
    at = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    return F.transform(
        F.filter(at, lambda s: s["x"] != ""),
        lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.size(F.split(s["x"], " ")).alias("w")),
    )


def _sizes(f: Column, window: int, min_words: int, step: int) -> Column:
    """For each place, how many lines from it on (or back from it) make a run that qualifies; 0: none."""
    n = F.size(f)

    def size(k: Column) -> Column:
        out, words = F.lit(0), []
        total = F.lit(0)
        for m in range(1, window + 1):
            total = total + F.get(f, k + step * (m - 1))["w"]
            words.append(total)
        for m in range(window, 0, -1):
            fits = (k + (m - 1) < n) if step > 0 else (k - (m - 1) >= 0)
            enough = F.lit(True) if m == window else words[m - 1] >= min_words
            out = F.when(fits & enough, F.lit(m)).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0), n - 1), size)


def runs(docs: DataFrame, window: int, min_words: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text_hash, fp, at, run, i, j): each run's fingerprint, a hash of the place that it selects, its own hash, its first and last line."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), _filled(_lines(F.col(text))).alias("f"))
    d = d.where(F.size("f") > 0).select("*", _sizes(F.col("f"), window, min_words, 1).alias("ahead"), _sizes(F.col("f"), window, min_words, -1).alias("back"))
    f = F.col("f")
    forward = F.transform("ahead", lambda m, k: F.struct(k.alias("k"), m.alias("m")))
    # a run back from a place is left out where it is the run on from its first line
    backward = F.transform("back", lambda m, k: F.struct((k - m + 1).alias("k"), F.when(F.get("ahead", k - m + 1) != m, m).otherwise(0).alias("m")))
    every = F.filter(F.concat(forward, backward), lambda r: r["m"] > 0)
    spans = F.transform(every, lambda r: F.struct(r["k"].alias("k"), F.get(f, r["k"])["i"].alias("i"), F.get(f, r["k"] + r["m"] - 1)["i"].alias("j"), F.transform(F.slice(f, r["k"] + 1, r["m"]), lambda s: s["h"]).alias("of")))
    rows = d.select("doc_id", "text_hash", F.explode(spans).alias("r")).select("doc_id", "text_hash", "r.*")
    least = F.array_min("of")
    chosen = F.col("k") + F.array_position("of", least)
    return rows.select("doc_id", "text_hash", least.alias("fp"), F.xxhash64("doc_id", "text_hash", chosen).alias("at"), F.xxhash64("of").alias("run"), "i", "j")


def repeated_lines(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, lines): the places of the lines to delete, for each document that has some."""
    rows = staged(runs(docs, window, min_words, text, doc_id), "runs")
    # fingerprints that stand at more than one place
    often = rows.groupBy("fp").agg(F.min("at").alias("one"), F.max("at").alias("other")).where("one <> other").select("fp")
    near = staged(rows.join(often, "fp", "left_semi").select("doc_id", "text_hash", "run", "i", "j"), "fingerprinted")
    place = F.struct("doc_id", "text_hash", "i")
    first = near.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = near.join(first.select(F.col("run").alias("copied"), "first"), F.col("run") == F.col("copied")).where(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("i", "j")))).alias("lines"))


def _bits(key: Column) -> tuple[Column, Column]:
    """The word and the bit of a document in the bit set."""
    return F.pmod(key, F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 50).cast("int").bitwiseAND(F.lit(63)))


def deduplicated(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with ``text`` cleaned, and n_lines, n_removed (int) added or replaced.

    Null texts stay null, with no lines; empty ones stay empty. Rows that repeat with their doc_id
    and text are one document, so that they lose no more lines than one of them. Rows with the same
    doc_id and other texts are documents of their own; null doc_ids come before all others. A blank
    line goes if it lies inside a deleted run. A text whose lines all go becomes empty. Every row and
    all other columns are kept. Very long texts cost time and memory in proportion to their lines.

    Only documents that may lose lines are shuffled: a bit set of at most WORDS words, broadcast,
    names them with some false hits, which the join itself sorts out.
    """
    gone = staged(repeated_lines(docs, window, min_words, text, doc_id).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lines").alias("__gone")), "gone")
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    word, bit = _bits(F.xxhash64("__id", "__hash"))
    known = gone.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    word, bit = _bits(F.xxhash64(F.col(doc_id), F.col("__own")))
    marked = docs.withColumn("__own", own).withColumns({"__w": word, "__b": bit}).join(F.broadcast(known), F.col("__w") == F.col("__word"), "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(F.col("__b")) != 0, F.lit(False))
    lines = _lines(F.col(text))
    added = {"n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)), "n_removed": F.coalesce(F.size("__gone"), F.lit(0))}
    extra = ["__own", "__w", "__b", "__word", "__bits", "__gone", "__id", "__hash"]
    clean = marked.where(~maybe).withColumn("__gone", F.lit(None).cast("array<int>")).withColumns(added).drop(*extra)
    joined = marked.where(maybe).join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return clean.unionByName(joined.withColumns(added | {text: cut}).drop(*extra))


def oracle(window: int = WINDOW, min_words: int = MIN_WORDS) -> str:
    """The same, by comparing the runs' own lines, in DuckDB SQL over ``documents`` (window 3)."""
    return f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), f AS (
  SELECT doc_id, text, i, trim(x, ' ') AS x, len(string_split(trim(x, ' '), ' ')) AS w,
    row_number() OVER (PARTITION BY doc_id, text ORDER BY i) AS k
  FROM l WHERE trim(x, ' ') <> ''
), s AS (
  SELECT *, lead(x, 1) OVER p AS x1, lead(x, 2) OVER p AS x2, lead(w, 1) OVER p AS w1, lead(i, 1) OVER p AS i1, lead(i, 2) OVER p AS i2,
    lag(x, 1) OVER p AS y1, lag(x, 2) OVER p AS y2, lag(w, 1) OVER p AS v1, lag(i, 1) OVER p AS j1, lag(i, 2) OVER p AS j2
  FROM f WINDOW p AS (PARTITION BY doc_id, text ORDER BY k)
), r AS (
  SELECT doc_id, text, i AS a, i AS b, [x] AS run FROM s WHERE w >= {min_words}
  UNION SELECT doc_id, text, i, i1, [x, x1] FROM s WHERE w < {min_words} AND x1 IS NOT NULL AND w + w1 >= {min_words}
  UNION SELECT doc_id, text, i, i2, [x, x1, x2] FROM s WHERE w < {min_words} AND w + w1 < {min_words} AND x2 IS NOT NULL
  UNION SELECT doc_id, text, j1, i, [y1, x] FROM s WHERE w < {min_words} AND y1 IS NOT NULL AND w + v1 >= {min_words}
  UNION SELECT doc_id, text, j2, i, [y2, y1, x] FROM s WHERE w < {min_words} AND w + v1 < {min_words} AND y2 IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, text, a) AS nth FROM r
), g AS (
  SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS i FROM t WHERE nth > 1
), c AS (
  SELECT l.doc_id, l.text, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS clean, count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text IS NOT DISTINCT FROM g.text AND l.i = g.i
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE c.n_lines END AS n_lines, c.n_removed AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(c.clean, '')) END AS clean_md5
FROM documents d JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.text
"""
