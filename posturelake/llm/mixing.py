"""Mixing sources to target weights by balanced (cube-method) sampling.

A document is taken a whole number of times for certain and once more with a fractional probability. The cube method
settles the fractions: a flight phase moves them along the null space of the constraints (words and documents of the source), up or down
by chance so that each keeps its mean, until all but two are 0 or 1; a landing phase gives up the documents and then the words. A source is
flown in blocks of bounded size, each of which leaves at most two documents open; the open ones of all blocks are flown again together until
one block is left. Chance is drawn from hashes of the rows, so that runs agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.numbering import number_rows
from .common import count_words, nested, ship, sized

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 512
SEED = 42
_NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn. The sum of all sizes is shared by weight; a target above ``most`` times its
    source's size stops there and the excess is shared again by weight, until none is above.
    """
    turn = F.pmod("turn", F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], out="turn")
    ranked = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap")))
    total, weighed = (float(x or 0) for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    level, full = (total / weighed if weighed else 0.0), -1
    while True:  # each round fills at least one more source
        over = F.col("cap") < level * F.col("weight")
        filled, capped, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if filled == full or not free:
            break
        level, full = (total - (capped or 0.0)) / free, filled
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _way(sizes: np.ndarray) -> np.ndarray:
    """How the open units move together: the first as far as can be, the others so that their number and their words stay (of two, the words)."""
    n, lead = len(sizes), float(sizes[0])
    if n > 2:
        total, square = float(sizes.sum()), float(sizes @ sizes)
        spread = n * square - total * total
        if spread > 1e-9 * n * square:  # the first unit's direction, less its projection on the constraints
            way = sizes * ((total - n * lead) / spread) + (total * lead - square) / spread
        else:
            way = np.full(n, -1.0 / n)
        way[0] += 1.0
        if way[0] > 1e-9:
            return way
        return np.concatenate([(sizes[1] - sizes[2], sizes[2] - lead, lead - sizes[1]), np.zeros(n - 3)])
    return np.array([sizes[1], -lead]) if n == 2 else np.ones(1)


def flight(sizes: np.ndarray, p: np.ndarray, draws: np.random.Generator, land: bool = False) -> np.ndarray:
    """Probabilities after the flight phase: at most two are left fractional, and the sums of the probabilities and of sizes times them stay.

    Each step goes up or down the null space with the chances that keep the mean of every probability. Units are settled in the given order, as
    far as the later ones can make up for them. With ``land`` the last two are settled as well: of two the words stay, and one goes by chance.
    """
    out = np.asarray(p, float).copy()
    near = (out <= _NEAR) | (out >= 1 - _NEAR)
    out[near] = np.round(out[near])
    open_ = np.flatnonzero(~near)
    x, z = out[open_], np.asarray(sizes, float)[open_]
    while len(x) > (0 if land else 2):
        way = _way(z)
        pace = np.abs(way) + 1e-300
        below = np.where(way > 0, x, 1 - x)  # how far each is from where a step down takes it
        up, down = float(((1 - below) / pace).min()), float((below / pace).min())
        x += way * (up if draws.random() * (up + down) < down else -down)
        done = np.abs(x - 0.5) >= 0.5 - _NEAR
        if done[0] and not done[1:].any():  # as a rule
            out[open_[0]] = round(x[0])
            x, z, open_ = x[1:], z[1:], open_[1:]
            continue
        out[open_[done]] = np.round(x[done])
        x, z, open_ = x[~done], z[~done], open_[~done]
    out[open_] = x
    return out


def _fly(units: DataFrame, last: bool) -> DataFrame:
    """Flies each block; ``p`` is 0, 1 or left between. Large documents go first, so that the open ones are small."""

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "mix", "row"], ascending=[False, True, True], kind="stable")
        draws = np.random.default_rng([SEED, *(int(m) & (1 << 64) - 1 for m in f["mix"].iloc[[0, -1]])])
        return f.assign(p=flight(f["size"].to_numpy(float), f["p"].to_numpy(), draws, last))

    # one key of both, so that rows are dealt by block even where they already lie by source
    ship(units.sparkSession)
    cells = units.withColumn("cell", F.struct("src", "block"))
    return cells.groupBy("cell").applyInPandas(each, cells.schema).drop("cell")


def balanced_sample(units: DataFrame) -> DataFrame:
    """``units`` (src, row, mix, size, p) with every ``p`` settled to 0 or 1; ``mix`` is a hash that deals rows to blocks and draws their chance."""
    settled: list[DataFrame] = []
    now = units
    while True:
        counts = sized(cut(now.groupBy("src").count()))
        most = counts.agg(F.max("count")).first()[0] or 0
        blocks = now.join(counts, "src").withColumn("block", F.pmod("mix", F.ceil(F.col("count") / (BLOCK if most > BLOCK else most or 1)))).drop("count")
        flown = cut(_fly(blocks.select("src", "block", "row", "mix", "size", "p"), most <= BLOCK).drop("block"))
        settled.append(flown.where("p IN (0, 1)"))
        if most <= BLOCK:
            break
        now = flown.where("p NOT IN (0, 1)").withColumn("mix", F.xxhash64("mix", F.lit(len(settled))))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most: float) -> DataFrame:
    """(row, doc_id, src, size, source_size, target, times) of each row of ``docs``; ``row`` numbers rows by id, source and size."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    rows = number_rows(cut(rows), [F.col(c) for c in ("doc_id", "source", "size", "digest")], out="row")  # cut, since a range shuffle reads its input twice
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumn("src", key).join(sized(goals.select(key.alias("src"), "source_size", "target")), "src")
    ratio: Column = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + _NEAR)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    units = rows.where((F.col("p") > 0) & (F.col("size") > 0)).select("src", "row", F.xxhash64("row").alias("mix"), "size", "p")
    more = balanced_sample(units).select("row", F.col("p").cast("long").alias("extra"))
    return rows.join(more, "row", "left").withColumn("times", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0).cast("long")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    ``taken`` is ``size`` times how often the mix takes the document. Null text has size 0 and is never taken; null source is a source of its own,
    last in order. Repeated rows are documents of their own. A null id is an id like others. Texts of any length are counted whole; an empty table gives
    an empty one. Runs over the same rows agree. A source's words come within about its smallest documents of the target; where one document holds
    most of a source's words, within that document, since its chance of being taken is kept.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows equal in id, text and source stand for one another; null and empty texts and others without a word are never taken. All columns come back, of any
    name; an empty table gives an empty one.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, most).groupBy("doc_id", "source", "digest").agg(F.sum("times").alias("times"), F.count("*").alias("n"))
    taken = cut(taken.where("times > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("digest").alias("d"), "times", "n"))
    keyed = nested(docs, own_id=F.col(id_col).cast("long"), own_source=F.col(source_col).cast("string"), own_digest=F.xxhash64(F.col(text_col).cast("string")))
    if not taken.where("n > 1").isEmpty():
        keyed = keyed.dropDuplicates(["own_id", "own_source", "own_digest"])
    same = F.col("own_id").eqNullSafe(F.col("i")) & F.col("own_source").eqNullSafe(F.col("s")) & (F.col("own_digest") == F.col("d"))
    return keyed.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc.*")
