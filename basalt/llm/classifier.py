"""Quality classifier by importance resampling over hashed n-grams.

Two generative bag-of-n-gram models over ``2 ** BITS`` hashed byte 4-grams: one of the target (documents
labelled good and not toxic), one of the raw corpus, every document of it. A document's importance is the
log of their ratio per n-gram, so that long documents don't win by length alone. Divided by a temperature it
is the log weight of the draw: Gumbel noise, seeded by doc_id, is added and the ``k`` largest keys are taken,
which is a sample without replacement in proportion to the weights.

Under that draw a document of importance x is taken with the probability 1 - exp(-exp((x - level) / temperature)).
The level best parts the labelled sample (a lost good document counts ``LOST`` times as much as another that
passes), the temperature is the one under which the sample's labels are likeliest (a share of ``DOUBT`` of them
is taken for wrong, and ``HOTTEST`` of the good sample's spread is the end); ``k`` is the sum of the
probabilities over all documents. So the noise decides where good and other documents overlap, and little where the sample parts them.

Only the labelled sample is bounded (``LABELLED`` rows of either kind, smallest hashes first); the raw
model counts all documents, in 2 ** BITS numbers per task that are summed by bucket on the executors.

A null or empty text has no n-grams and the importance 0. Null ids share one noise value; repeated rows get
the same decision. Ties at the k-th key stay together. Labels with nulls count for neither kind; with no
labelled document of either kind everything is kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, mark, stored

BITS = 18
LABELLED = 20_000
#: How much more a lost good document counts than another that passes; the share of labels taken for wrong;
#: the highest temperature, in spreads (1st to 99th percentile) of the good sample's importance.
LOST, DOUBT, HOTTEST = 4.0, 0.01, 0.1
#: Units of a log ratio in sums.
FIXED = 1 << 24


def grams(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashed n-grams of some rows on end, their ends by row): texts are read from Arrow's buffer as they lie."""
    text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 20), "right")) - 1)
        stop = min(stop, len(text))
        b = data[offsets[row] : offsets[stop]].astype(np.uint32)
        b = np.concatenate([b, np.zeros(3, np.uint32)])
        h = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        n = np.diff(offsets[row : stop + 1])
        ends = offsets[row + 1 : stop + 1] - offsets[row]
        inside = np.ones(len(h), bool)  # the last three places of a text would reach into the next
        for back in (1, 2, 3):
            inside[(ends - back)[n >= back]] = False
        yield row, h[inside], np.cumsum(np.maximum(n - 3, 0))
        row = stop


def labelled(labels: DataFrame, bound: int = LABELLED, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Ids of good and of other documents: at most ``bound`` each, by smallest hash."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), ((F.col(quality_col) == 1) & (F.col(toxic_col) == 0)).alias("good")).dropna()
    kinds = []
    for good in (True, False):
        ids = rows.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        kinds.append(np.sort(np.array([r.doc_id for r in ids.collect()], np.int64)))
    return kinds[0], kinds[1]


def member(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, ids)
    return (at < len(of)) & (of[np.minimum(at, len(of) - 1)] == ids) if len(of) else np.zeros(len(ids), bool)


def row_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()


def fit(docs: DataFrame, good: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw by bucket. One bucket more or less than seen doesn't matter: both models are smoothed."""
    targets = docs.sparkSession.sparkContext.broadcast(good)  # at most LABELLED ids

    def count(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            hit = member(row_ids(batch), targets.value)
            for row, h, ends in grams(batch):
                raw += np.bincount(h, minlength=1 << BITS)
                starts = np.concatenate([[0], ends[:-1]])
                for k in np.flatnonzero(hit[row : row + len(ends)]):
                    np.add.at(target, h[starts[k] : ends[k]], 1)
        seen = np.flatnonzero(raw)
        yield {"bucket": seen.astype(np.int32), "raw": raw[seen], "target": target[seen]}

    made = map_batches(docs, count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in made.toLocalIterator():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float64)


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, importance, and what strings follow the text. Sums are of whole numbers, so they don't depend on how rows are batched."""
    model = docs.sparkSession.sparkContext.broadcast(np.round(ratio * FIXED).astype(np.int64))

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, h, ends in grams(batch):
                total = np.concatenate([[0], np.cumsum(model.value[h])])
                starts = np.concatenate([[0], ends[:-1]])
                out[row : row + len(ends)] = (total[ends] - total[starts]) / np.maximum(ends - starts, 1) / FIXED
            yield {"doc_id": batch.column(0), "importance": np.round(out, 9)} | {c: batch.column(k) for k, c in enumerate(also, 2)}

    also = docs.columns[2:]
    return map_batches(docs, run, ", ".join(["doc_id long", "importance double", *[f"{c} string" for c in also]]))


def draw_of(good: np.ndarray, other: np.ndarray) -> tuple[float, float] | None:
    """(temperature, level) that the labelled sample's importance gives; None without both kinds."""
    if not len(good) or not len(other):
        return None
    spread = float(np.subtract(*np.percentile(good, [99, 1]))) or float(np.ptp(np.concatenate([good, other]))) or 1.0
    cuts = np.unique(np.concatenate([good, other]))
    lost = np.searchsorted(np.sort(good), cuts)
    passed = len(other) - np.searchsorted(np.sort(other), cuts)
    at = int(np.argmin(LOST * lost / len(good) + passed / len(other)))
    level = float(cuts[at] if at == 0 else (cuts[at - 1] + cuts[at]) / 2)

    def likely(t: float) -> float:
        g, o = (DOUBT + (1 - 2 * DOUBT) * taken(x, t, level) for x in (good, other))
        return LOST * float(np.log(g).mean()) + float(np.log(1 - o).mean())

    return max((float(t) for t in spread * np.geomspace(HOTTEST / 100, HOTTEST, 40)), key=likely), level


def taken(x: np.ndarray, temperature: float, level: float) -> np.ndarray:
    """The probability of being drawn."""
    return 1 - np.exp(-np.exp(np.clip((x - level) / temperature, -40, 4)))


def draw(scored: DataFrame, temperature: float, level: float, seed: int) -> DataFrame:
    """Adds ``key`` and ``kept``: the Gumbel top-k of importance / temperature, k being the expected number."""
    weight = (F.col("importance") - F.lit(level)) / F.lit(temperature)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = scored.withColumn("key", weight - F.log(-F.log(uniform)))
    chance = 1 - F.exp(-F.exp(F.greatest(F.least(weight, F.lit(4.0)), F.lit(-40.0))))
    k = keyed.agg(F.sum((chance * 10**6).cast("long"))).first()[0] or 0  # whole numbers: the order of rows doesn't matter
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, "key", round(k / 10**6)))


def classify(docs: DataFrame, labels: DataFrame, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """doc_id, importance, key, kept, and the row's mark if wanted: a row for each row of ``docs``."""
    slim = id_text(docs, id_col, text_col)
    good, other = labelled(labels)
    scored = stored(score(slim.withColumn("mark", mark()) if marks else slim, fit(slim, good)), "importance")
    both = np.concatenate([good, other])  # at most 2 * LABELLED
    kinds = docs.sparkSession.createDataFrame([(int(i), j < len(good)) for j, i in enumerate(both)], "doc_id long, good boolean")
    # One value for an id: rows that repeat it don't make the sample larger.
    sample = scored.join(F.broadcast(kinds), "doc_id").groupBy("doc_id", "good").agg(F.min("importance").alias("importance")).collect()
    fitted = draw_of(np.array([r.importance for r in sample if r.good]), np.array([r.importance for r in sample if not r.good]))
    if fitted is None:
        return scored.withColumn("key", F.col("importance")).withColumn("kept", F.lit(True))
    return draw(scored, *fitted, seed)


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """Exactly the k-th largest value: counts in ever narrower bins, a few numbers per round."""
    if k <= 0:
        return float("inf")
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k >= n:
        return float("-inf")
    above = 0  # values over high
    while low < high:
        width = (high - low) / 1024
        inside = df.where(F.col(col).between(low, high))
        if width == 0 or low + width == low:
            break
        bins = inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(1023)).alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b")).collect()
        for b in sorted(bins, key=lambda r: -r.bin):
            if above + b.n >= k:
                low, high = b.a, b.b
                break
            above += b.n
    return float(low)
