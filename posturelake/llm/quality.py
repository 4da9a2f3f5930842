"""Quality rules: base rules on whole texts, then robust multivariate outliers per language and source.

Location and scatter are minimum-covariance-determinant estimates. A group is dealt to blocks of bounded size; in each, concentration steps from
many starts seek the half of least determinant. From a group's best block, concentration steps over all its rows follow until the determinant
settles, then a reweighting step. Up to half of a group may be junk without moving the estimate. A step over all rows is a pass
of partial-aggregated sums per group and distance class, so that a group of any size is estimated from all its documents and none is gathered
into one task.

Languages and all documents are estimated in the same passes. Each group's location and scatter are drawn towards its language's, and those towards
all documents', by a weight that fades smoothly with the group's size, so that a group of one document and one of a million are judged by one rule.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import BROADCAST_ROWS, SPACES, map_texts, nested, ship

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Steps over all rows at most, and the change of the log-determinant at which they end; a warning says so if they end unsettled.
MAX_STEPS, SETTLED = 20, 1e-3
#: Rows of a block, and subsets that a search in it starts from; those of least determinant after two steps are pursued.
BLOCK, STARTS, PURSUED = 2000, 40, 5
SEED = 42
#: Rows of a task of a pass at least, so that small partitions sum before they send.
TASK_ROWS = 1 << 15
#: Documents that what a group is drawn towards counts for (10 for each component): an estimate from n documents weighs n / (n + PRIOR).
PRIOR = 50
#: Classes of squared distance for each doubling, from 2 ** LEAST_POWER on; the class in which half of a group is reached counts in part.
CLASSES, LEAST_POWER = 32, -20
#: Least standard deviation of each transformed statistic. Some hardly vary among sound texts (most hold no repeated line or symbol), and
#: without a floor the smallest deviation would count as endless.
FLOORS = (0.5, 0.08, 0.2, 0.25, 0.15)
#: Squared distance beyond which a text is rejected; of normal vectors of this length, one in a million lies beyond 37.
CUTOFF = 60.0
DIM = len(FLOORS)
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words that the text holds at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    code, have = ids, 1
    while have < width:  # ranks of windows of one length make those of up to twice the length
        more = min(have, width - have)
        pair = code[: len(words) - have - more + 1] * (int(code.max()) + 1) + code[more : more + len(words) - have - more + 1]
        _, code = np.unique(pair, return_inverse=True)
        have += more
    twice = np.bincount(code)[code] > 1
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, np.flatnonzero(twice), 1)
    np.add.at(hit, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


#: Rows equal in these have one verdict.
KEY = ("doc_id", "lang", "source", "digest")


def row_key(id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    """The columns KEY of a row; ``digest`` is a hash of its text."""
    kinds = {"doc_id": (id_col, "long"), "lang": (lang_col, "string"), "source": (source_col, "string")}
    return {name: F.col(c).cast(kind) for name, (c, kind) in kinds.items()} | {"digest": F.xxhash64(F.col(text_col).cast("string"))}


def _statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([base_statistics(t.as_py()) for t in b.column(4)], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c) for c in found.T)], [*KEY, *(x.split()[0] for x in STATS.split(", "))])

    made = row_key(id_col, text_col, lang_col, source_col)
    return map_texts(docs.select(*[x.alias(name) for name, x in made.items()], F.col(text_col).cast("string").alias("text")), each, f"doc_id long, lang string, source string, digest long, {STATS}")


def _vector() -> list[Column]:
    """Transformed statistics. Ratios are drawn towards a usual value as if a text had 50 more words, since those of short texts scatter."""
    n = F.col("n_words") + 50
    return [F.log1p("n_words"), F.log((F.col("word_chars") + 275) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(10 * F.col("n_repeat_words") / n)]


_Y = [f"y{i}" for i in range(DIM)]
_CELLS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(max(mid, 1e-12), k) < p else (low, mid)
    return low


def _consistent(cover: float) -> float:
    """Factor for the scatter of the nearest ``cover`` share of a normal sample."""
    return cover / _chi2_cdf(_chi2_quantile(cover, DIM), DIM + 2) if cover < 1 else 1.0


_SHARES = np.linspace(0.5, 1, 51)
_FACTORS = np.array([_consistent(x) for x in _SHARES])


def half(n):
    """Documents of a group of ``n`` that its estimate covers."""
    return np.minimum(n, (n + DIM + 1) // 2)


def _factor(covered, n):
    return np.interp(covered / n, _SHARES, _FACTORS)


def _scatter(rows: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, scatter (with the floors) and its log-determinant."""
    mean = rows.mean(axis=0)
    off = rows - mean
    cov = factor * (off.T @ off) / len(rows) + np.diag(np.square(FLOORS))
    return mean, cov, float(np.linalg.slogdet(cov)[1])


def _concentrate(y: np.ndarray, mean: np.ndarray, cov: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Concentration steps: each estimates from the half nearest to the estimate before. The determinant never grows."""
    h, best = int(half(len(y))), math.inf
    factor = float(_factor(h, len(y)))
    for _ in range(steps):
        off = y - mean
        d2 = np.einsum("ij,ij->i", off @ np.linalg.inv(cov), off)
        mean, cov, logdet = _scatter(y[np.argpartition(d2, h - 1)[:h]], factor)
        if logdet > best - 1e-12:
            break
        best = logdet
    return mean, cov, logdet


def search(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The half of the rows ``y`` of least determinant that is found: its mean, scatter and log-determinant.

    Starts are the medians with quartile ranges, and STARTS subsets of one row more than there are components.
    """
    low, mid, high = np.percentile(y, [25, 50, 75], axis=0)
    begun = [_concentrate(y, mid, np.diag(np.square((high - low) / 1.349) + np.square(FLOORS)), 2)]
    draws = np.random.default_rng(SEED)
    for _ in range(STARTS if len(y) > DIM + 1 else 0):
        mean, cov, _ = _scatter(y[draws.choice(len(y), DIM + 1, replace=False)], 1.0)
        begun.append(_concentrate(y, mean, cov, 2))
    begun.sort(key=lambda e: e[2])
    return min((_concentrate(y, *e[:2], 100) for e in begun[:PURSUED]), key=lambda e: e[2])


_ESTIMATE = "grp long, mean array<double>, inverse array<double>, logdet double"


def _searched(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The best estimate of each group's blocks. ``rows`` are dealt to blocks by the hash ``mix``."""

    def each(f: pd.DataFrame) -> pd.DataFrame:
        y = f.sort_values(["mix", *_Y])[_Y].to_numpy(float)
        mean, cov, logdet = search(y)
        return pd.DataFrame({"grp": f["grp"].iloc[:1], "mean": [mean], "inverse": [np.linalg.inv(cov).ravel()], "logdet": [logdet]})

    ship(rows.sparkSession)
    dealt = rows.join(sizes, "grp").select(F.struct("grp", F.pmod("mix", F.ceil(F.col("n") / BLOCK)).alias("block")).alias("cell"), "grp", "mix", *_Y)
    found = dealt.groupBy("cell").applyInPandas(each, _ESTIMATE)
    best = found.groupBy("grp").agg(F.min(F.struct("logdet", "mean", "inverse")).alias("e"))
    return cut(best.select("grp", "e.mean", "e.inverse", "e.logdet"))


def _estimates(sums: DataFrame, cover: float | None = None) -> DataFrame:
    """Location, inverse scatter and log-determinant from a row of sums for each group, which cover ``n`` of ``all`` rows, or those within a quantile."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy(float)
            factor = _factor(n, f["all"].to_numpy(float)) if cover is None else np.full(len(f), _consistent(cover))
            mean = f[[f"s{i}" for i in range(DIM)]].to_numpy(float) / n[:, None]
            cov = np.empty((len(f), DIM, DIM))
            for i, j in _CELLS:
                cov[:, i, j] = cov[:, j, i] = factor * (f[f"s{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j])
            cov = cov + np.diag(np.square(FLOORS))
            yield pd.DataFrame({"grp": f["grp"], "mean": list(mean), "inverse": list(np.linalg.inv(cov).reshape(len(f), -1)), "logdet": np.linalg.slogdet(cov)[1]})

    ship(sums.sparkSession)
    return cut(sums.mapInPandas(each, _ESTIMATE))


_SUMS = [*(f"s{i}" for i in range(DIM)), *(f"s{i}{j}" for i, j in _CELLS)]


def _sums() -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *[F.sum(y).alias(f"s{i}") for i, y in enumerate(_Y)], *[F.sum(F.col(_Y[i]) * F.col(_Y[j])).alias(f"s{i}{j}") for i, j in _CELLS]]


def _with_distance(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance. The estimates are broadcast if they are ``few``; else Spark splits hot groups."""
    off = [F.col(y) - F.col("mean")[i] for i, y in enumerate(_Y)]
    d2 = reduce(lambda a, b: a + b, [(1 if i == j else 2) * off[i] * off[j] * F.col("inverse")[i * DIM + j] for i, j in _CELLS])
    small = estimates.select("grp", "mean", "inverse")
    return rows.join(F.broadcast(small) if few else small, "grp").withColumn("d2", F.greatest(d2, F.lit(0.0))).drop("mean", "inverse")


def _nearest_half(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Sums over the half of each group that lies nearest to its estimate: whole classes of distance, and a share of the class where half is reached."""
    place = F.greatest(F.floor(CLASSES * (F.log2("d2") - LEAST_POWER)), F.lit(0))
    classes = _with_distance(rows, estimates, few).groupBy("grp", F.coalesce(place, F.lit(0)).cast("int").alias("place")).agg(*_sums())
    group = Window.partitionBy("grp")  # a row for each class
    total, upto = F.sum("n").over(group), F.sum("n").over(group.orderBy("place"))
    h = F.least("all", F.floor((F.col("all") + DIM + 1) / 2))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - F.col("upto") + F.col("n")) / F.col("n")))
    shared = classes.withColumns({"all": total, "upto": upto}).withColumn("share", share).where("share > 0")
    return shared.groupBy("grp").agg(F.first("all").alias("all"), *[F.sum(F.col("share") * F.col(c)).alias(c) for c in ("n", *_SUMS)])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """(grp, mean, inverse, logdet) of the columns y0.. of ``rows`` for each ``grp``; ``mix`` is a hash that deals rows to blocks."""
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")))
    few = sizes.count() <= BROADCAST_ROWS
    now = _searched(rows, F.broadcast(sizes) if few else sizes)
    for _ in range(MAX_STEPS):
        after = _estimates(_nearest_half(rows, now, few))
        moved = after.join(now.select("grp", F.col("logdet").alias("was")), "grp").where(F.abs(F.col("logdet") - F.col("was")) > SETTLED)
        now = after
        if moved.isEmpty():
            break
    else:
        warnings.warn(f"the estimates of some groups did not settle in {MAX_STEPS} steps", stacklevel=2)
    near = _with_distance(rows, now, few).where(F.col("d2") <= _chi2_quantile(0.975, DIM))
    return _estimates(near.groupBy("grp").agg(F.lit(0.0).alias("all"), *_sums()), 0.975)


def draw(mean: np.ndarray, cov: np.ndarray, n: float, to_mean: np.ndarray, to_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An estimate from ``n`` documents, drawn towards another one. What lies between the two locations adds no scatter, lest a group of few junk documents excuse itself."""
    own = n / (n + PRIOR)
    return own * mean + (1 - own) * to_mean, own * cov + (1 - own) * to_cov


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``grp``, its language and source, and ``tongue``, its language; and (grp, mix, y0..) with a row for each of the three groups, all documents being 0, that a row counts in."""
    name = lambda *parts: F.xxhash64(*[x for p in parts for x in (F.col(p).isNull(), F.col(p))], F.lit(len(parts)))  # noqa: E731  null differs from every text
    rows = rows.withColumns({"grp": name("lang", "source"), "tongue": name("lang")})
    return rows, rows.select(F.explode(F.array("grp", "tongue", F.lit(0).cast("long"))).alias("grp"), F.xxhash64(*KEY).alias("mix"), *_Y)


def _drawn(groups: DataFrame, levels: DataFrame, own: DataFrame) -> DataFrame:
    """(grp, mean, inverse, logdet) of ``own`` for each of ``groups`` (grp, n, tongue, tongue_n), drawn towards its language's of ``levels`` and that towards that of all documents. A group of which ``own`` knows nothing has its language's."""
    side = lambda df, k: df.select(F.col("grp").alias(k), F.col("mean").alias(f"{k}_mean"), F.col("inverse").alias(f"{k}_inverse"))
    both = groups.join(side(levels, "tongue"), "tongue").join(side(own, "grp"), "grp", "left")
    every = levels.where("grp = 0").first()  # one estimate, none if there are no documents

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                known = lambda mean, flat: (np.asarray(mean, float), np.linalg.inv(np.asarray(flat, float).reshape(DIM, DIM)))
                mean, cov = draw(*known(r.tongue_mean, r.tongue_inverse), r.tongue_n, *known(every["mean"], every["inverse"]))
                if r.n and r.grp_mean is not None:
                    mean, cov = draw(*known(r.grp_mean, r.grp_inverse), r.n, mean, cov)
                out.append((r.grp, mean, np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["grp", "mean", "inverse", "logdet"])

    ship(groups.sparkSession)
    return cut(both.mapInPandas(each, _ESTIMATE))


def drawn_estimates(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """(grp, mean, inverse, logdet) for each language and source of ``rows`` from the estimates of all ``levels``.

    A few junk documents may be over half of a small group. So each group is reweighted once more: its own estimate is made anew from those of its
    documents that lie near the drawn one, and weighs as many.
    """
    sizes = rows.groupBy("grp", "tongue").agg(F.count("*").cast("double").alias("n"))
    groups = cut(sizes.join(sizes.groupBy("tongue").agg(F.sum("n").alias("tongue_n")), "tongue"))
    few = groups.count() <= BROADCAST_ROWS
    near = _with_distance(rows, _drawn(groups, levels, levels), few).where(F.col("d2") <= _chi2_quantile(0.975, DIM))
    sums = cut(near.groupBy("grp").agg(F.lit(0.0).alias("all"), *_sums()))
    groups = groups.drop("n").join(sums.select("grp", "n"), "grp", "left").na.fill(0.0, ["n"])
    return _drawn(groups, levels, _estimates(sums, 0.975))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """KEY, the base statistics, base_failed, kept and the squared distance ``d2`` for every row.

    A text fails the base rules with fewer than MIN_WORDS words, or if over MAX_REPEATED_PERCENT % of its words stand in repeated
    windows; its ``d2`` is null. The others are judged by the estimate of their language and source, drawn towards the language's and all documents' by PRIOR; those beyond CUTOFF
    are not kept. Null text is empty and fails; null language or source is a
    value of its own. Repeated rows each count and each get their row. Texts of any length are read whole; an empty table gives an empty one;
    columns beyond the four named ones are not looked at.
    """
    stats = _statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed).withColumns(dict(zip(_Y, _vector()))))
    packed = stats.coalesce(max(1, math.ceil(stats.count() / TASK_ROWS)))  # never more partitions than there are
    rows, counted = _grouped(packed.where("NOT base_failed"))
    estimates = drawn_estimates(rows, robust_estimates(counted))
    judged = _with_distance(rows, estimates, estimates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS)
    out = judged.unionByName(stats.where("base_failed"), allowMissingColumns=True)
    kept = ~F.col("base_failed") & (F.col("d2") <= CUTOFF)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*KEY, *(x.split()[0] for x in STATS.split(", ")), "base_failed", "kept", "d2")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``verdicts`` with no more of the key than doc_id."""
    return verdicts(docs, id_col, text_col, lang_col, source_col).drop("lang", "source", "digest")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``verdicts`` keeps. Rows that share an id, or have none, each go by their own text, language and source."""
    gone = cut(verdicts(docs, id_col, text_col, lang_col, source_col).where("NOT kept").select(*KEY).distinct())
    rows = nested(docs, **{f"own_{k}": x for k, x in row_key(id_col, text_col, lang_col, source_col).items()})
    same = reduce(lambda a, b: a & b, [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in KEY])
    return rows.join(gone, same, "left_anti").select("doc.*")
