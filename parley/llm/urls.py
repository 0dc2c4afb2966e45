"""URL filter: rules first, and for other URLs the ratio of two character language models.

Both models are smoothed Markov models of variable order over the characters of a URL behind its scheme. One learns the
URLs that a rule allows, the other those that a rule blocks. With C a count and T the number of different characters
seen behind a context, a character's probability is (C(context, char) + T(context) * shorter) / (C(context) +
T(context)), where ``shorter`` is its probability behind the context without its first character. The score is the
difference of the log-likelihoods divided by the length, and its threshold is the one that parts best a fifth of the
labelled URLs, chosen by hash, that the models have not learned from.

Counts cover all labelled URLs. They stay a Spark table of all runs of characters, of all lengths, that learned or judged
URLs have, whatever their number; every probability is computed there from the one of the run without its first
character. A URL's characters take theirs from the longest runs. Each task holds the ``GRAMS`` most frequent of these; the
rest, none of them frequent, are joined, so the result does not depend on ``GRAMS``. A URL without text behind the scheme has score 0. If one kind of labelled
URL is missing, the score is 0 everywhere and the threshold 0, so URLs without a rule are allowed. A null URL, or one
without ``://``, has an empty host and path, no rule, and its text as it is for the models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import mixed, signed, sliced, typed, written

#: The longest context in characters.
ORDER = 5
#: Longest runs whose probabilities a task holds at most; the others are joined.
GRAMS = 1_000_000
#: URLs that a task holds at once.
AT_ONCE = 2000
#: Characters that are taken as possible; stands under the shortest context.
ALPHABET = 256
#: One of so many labelled URLs is kept to calibrate the threshold.
HELD = 5
#: Width of a step of the score, and where it is cut for calibration.
STEP, FAR = 0.01, 20.0
_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and all text behind the scheme."""
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return (
        F.coalesce(F.translate(host, *_A_Z), empty),
        F.coalesce(path, empty),
        F.coalesce(rest, url, empty),
    )


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        if name is None:
            name, verdict = F.when(fits, rule.host + rule.path), F.when(fits, rule.verdict)
        else:
            name, verdict = name.when(fits, rule.host + rule.path), verdict.when(fits, rule.verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def contexts(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character, and an end mark, of each text: (text, hashes of its contexts, hashes with the character).

    Row k of the hashes is the context of k characters; the start of a text is filled with one mark.
    """
    start, end = 0, 1
    flat, owner = [], []
    for i, text in enumerate(texts):
        own = [start] * order + [ord(c) + 2 for c in text] + [end]
        flat += own
        owner += [i] * len(own)
    code, owner = mixed(np.array(flat, np.uint64)), np.array(owner, np.int64)
    at = np.arange(len(code)) >= order
    if len(code):
        first = np.searchsorted(owner, np.arange(len(texts)))
        at = np.arange(len(code)) - first[owner] >= order
    at = np.flatnonzero(at)
    before = np.zeros((order + 1, len(at)), np.uint64)
    for k in range(1, order + 1):  # from the nearest character to the farthest
        before[k] = mixed(before[k - 1] + code[at - k]) + np.uint64(k)
    return owner[at], before, mixed(before + code[at][None])


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """For each batch the runs with their length, context, the run without the first character, and counts.

    ``n`` counts all URLs, ``allow`` and ``block`` those that are learned from.
    """
    for batch in (part for whole in batches for part in sliced([whole], AT_ONCE)):
        verdicts = np.array(batch.column("verdict").fill_null("").to_pylist(), dtype=str)
        owner, before, grams = contexts(batch.column("text").to_pylist(), order)
        allow, block = (verdicts[owner] == v for v in ("allow", "block"))
        for k in range(order + 1):
            gram, first, at, count = np.unique(grams[k], return_index=True, return_inverse=True, return_counts=True)
            yield pa.record_batch(
                {
                    "k": np.full(len(gram), k, np.int32),
                    "context": signed(before[k][first]),
                    "gram": signed(gram),
                    "shorter": signed(grams[max(k - 1, 0)][first]),
                    "n": count.astype(np.int64),
                    "allow": np.bincount(at, weights=allow, minlength=len(gram)).astype(np.int64),
                    "block": np.bincount(at, weights=block, minlength=len(gram)).astype(np.int64),
                }
            )


def _table(df: DataFrame, key: str, size: int) -> list[np.ndarray]:
    """The most frequent rows, ``size`` at most, as columns sorted by key.

    How many rows are so frequent is counted in steps of an eighth of an octave first, so no
    more than these are ever brought together.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    rows = df.withColumn("step", step)
    least, total = 0, 0
    for at, count in sorted(rows.groupBy("step").count().collect(), reverse=True):  # some 500 steps at most
        total += count
        if total > size:
            least = at + 1
            break
    got = rows.filter(F.col("step") >= least).drop("step").toArrow()
    order = np.argsort(got.column(key).to_numpy())
    return [got.column(c).to_numpy()[order] for c in got.column_names]


def ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, ratio: the longest runs of all URLs, how often they occur, and log-probability allowed to blocked.

    ``urls``: text, verdict (allow or block of those that are learned from).
    """
    counted = urls.select("text", "verdict").mapInArrow(
        lambda b: _counted(b, order), "k int, context long, gram long, shorter long, n long, allow long, block long"
    )
    sums = [F.sum(name).alias(name) for name in ("n", "allow", "block")]
    runs = counted.groupBy("k", "context", "gram", "shorter").agg(*sums)
    behind = Window.partitionBy("k", "context")  # as many rows as there are different characters, at most
    for verdict in ("allow", "block"):
        runs = runs.withColumns(
            {
                f"{verdict}_here": F.sum(verdict).over(behind),
                f"{verdict}_kinds": F.count(F.when(F.col(verdict) > 0, 1)).over(behind),
            }
        )
    runs = written(runs)
    found = None
    for k in range(order + 1):
        own = runs.filter(F.col("k") == k)
        if found is None:
            own = own.withColumns({"allow_p": F.lit(1 / ALPHABET), "block_p": F.lit(1 / ALPHABET)})
        else:
            own = own.join(found, "shorter")
        smoothed = {}
        for verdict in ("allow", "block"):
            here, kinds, p = (F.col(f"{verdict}_{name}") for name in ("here", "kinds", "p"))
            smoothed[f"{verdict}_p"] = F.when(here > 0, (F.col(verdict) + kinds * p) / (here + kinds)).otherwise(p)
        own = own.withColumns(smoothed)
        found = own.select(F.col("gram").alias("shorter"), "allow_p", "block_p")
    return written(own.select("gram", "n", (F.log("allow_p") - F.log("block_p")).alias("ratio")))


def with_scores(rows: DataFrame, order: int = ORDER, size: int = GRAMS) -> DataFrame:
    """``rows`` (text, verdict, learn, other columns) with ``score``; models learn from the verdicts where ``learn``."""
    kinds = [r[0] for r in rows.filter(F.col("learn") & F.col("verdict").isNotNull()).select("verdict").distinct().collect()]
    if len(kinds) < 2:  # allow and block are all there are
        return rows.withColumn("score", F.lit(0.0))
    every = ratios(rows.select("text", F.when(F.col("learn"), F.col("verdict")).alias("verdict")), order)
    gram, _, ratio = _table(every.select("gram", "n", "ratio"), "gram", size)
    shared = rows.sparkSession.sparkContext.broadcast((gram, ratio))

    def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, longest run, whether it is held here, and its ratio then, for each character."""
        keys, values = shared.value
        owner, _, grams = contexts(texts, order)
        wanted = signed(grams[order])
        if not len(keys):
            return owner, wanted, np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        held = keys[at] == wanted
        return owner, wanted, held, np.where(held, values[at], 0.0)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced([whole], AT_ONCE)):
            owner, wanted, held, _ = places(batch.column("text").to_pylist())
            runs = {"gram": wanted[~held]}
            yield pa.record_batch({n: batch.column(n).take(pa.array(owner[~held])) for n in ("h1", "h2")} | runs)

    def held_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced([whole], AT_ONCE)):
            texts = batch.column("text").to_pylist()
            owner, _, _, ratio = places(texts)
            total = np.bincount(owner, weights=ratio, minlength=len(texts))
            length = np.bincount(owner, minlength=len(texts)).astype(np.int64)
            yield pa.record_batch(
                {n: batch.column(n) for n in names} | {"held": total, "places": length}
            )

    # a text is known by 128 bits of hashes
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})
    names = keyed.columns
    schema = typed("", **{f.name: f.dataType for f in keyed.schema.fields}).add("held", "double").add("places", "long")
    out = keyed.mapInArrow(held_sums, schema)
    if len(gram) < every.count():  # the same sums, the rest of them by a join
        left = keyed.select("text", "h1", "h2").dropDuplicates(["h1", "h2"])
        joined = left.mapInArrow(rest, "h1 long, h2 long, gram long").join(every.select("gram", "ratio"), "gram")
        out = out.join(joined.groupBy("h1", "h2").agg(F.sum("ratio").alias("joined")), ["h1", "h2"], "left")
    else:
        out = out.withColumn("joined", F.lit(0.0))
    score = (F.col("held") + F.coalesce("joined", F.lit(0.0))) / F.col("places")
    return out.withColumn("score", F.when(F.col("text") != "", score).otherwise(0.0)).select(*rows.columns, "score")


def learned(labelled: DataFrame, order: int = ORDER, size: int = GRAMS) -> tuple[DataFrame, int]:
    """What ``scores`` learns from (text, verdict), and the longest runs that a task holds then."""
    return labelled.select("text", "verdict"), size


def scores(models: tuple[DataFrame, int], texts: list[str], order: int) -> list[float]:
    """Log-likelihood ratio of allowed to blocked for each text, by its length."""
    labelled, size = models
    asked = labelled.sparkSession.createDataFrame(list(enumerate(texts)), "at int, text string")
    rows = asked.withColumns({"verdict": F.lit(None).cast("string"), "learn": F.lit(False)})
    rows = rows.unionByName(labelled.withColumns({"at": F.lit(-1), "learn": F.lit(True)}))
    return [r.score for r in with_scores(rows, order, size).filter("at >= 0").orderBy("at").collect()]


def threshold(counts: list[tuple[int, str, int]]) -> float:
    """The step of the score that parts allowed and blocked best; of equally good ones the one nearest to 0."""
    allowed, blocked = ({s: n for s, v, n in counts if v == verdict} for verdict in ("allow", "block"))
    if not allowed or not blocked:
        return 0.0
    best, above_allowed, above_blocked = [], sum(allowed.values()), sum(blocked.values())
    all_allowed, all_blocked = above_allowed, above_blocked
    for step in sorted(allowed.keys() | blocked.keys() | {0}):
        best.append((above_blocked / all_blocked - above_allowed / all_allowed, abs(step), step))
        above_allowed -= allowed.get(step, 0)
        above_blocked -= blocked.get(step, 0)
    return min(best)[2] * STEP


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    order: int = ORDER,
    size: int = GRAMS,
) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score, threshold."""
    host, path, text = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    scored = written(with_scores(rows.withColumn("learn", F.col("verdict").isNotNull() & ~held), order, size))
    calibrating = scored.filter(F.col("verdict").isNotNull() & ~F.col("learn"))
    step = F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), "score")) / STEP).cast("int")
    counts = calibrating.groupBy(step.alias("step"), "verdict").count().collect()
    limit = threshold([(r[0], r[1], r[2]) for r in counts])  # one row per step and verdict at most
    judged = F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select(
        "page_id", "host", "path", "rule", judged.alias("verdict"), "score", F.lit(limit).alias("threshold")
    )
