"""Near-duplicate documents: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

1. Each text becomes its set of word shingles, MinHash samples of it, their bands, and an odd sketch: a bitmap of the
   parities of the samples' hashes.  A second odd sketch, of the whole set, differs in at most as many bits as the sets do
   in shingles, so that it rules out pairs for certain.  Texts with equal sets, known by 128 bits made of the BLAKE2b
   digests of their words, are one class from here on.
2. Within each band bucket every class is paired with one hub (the class with the most copies).  Pairs whose sketches
   differ too much are dropped, the others confirmed on the full sets (of words, not of hashes), and components formed.
3. Classes of a bucket that are still in different components are compared with each other in the same way, in blocks of
   at most BLOCK classes, so that a large bucket is many tasks' work.
So a group of m near copies costs m pairs a band, and pairs inside a component are never made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import workers
from lectern.llm.components import connected_components
from lectern.llm.repeats import keyed
from lectern.llm.words import Shingles, chunks, mix
from lectern.session import materialize, ship

ROWS = 4  # MinHash samples a band
MISS = 1e-8  # chance that a pair right at the threshold shares no band
SKETCH_LONGS = 4
PARITY_LONGS = 8  # of the odd sketch of the whole set
PAIRS = 100  # pairs whose texts a task holds as sets at a time, at most
BLOCK = 4_000  # classes of a bucket that one task compares with as many others
#: Ids of documents to confirm that are broadcast at most (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _slices(batch: pa.RecordBatch, rows: int):
    """A batch's rows, a thousand of them as Python objects at a time at most, and their texts in bytes, about CHUNK of them."""
    for begin in range(0, batch.num_rows, rows):
        own = batch.slice(begin, rows)
        for at, texts in chunks(own.column("text").to_pylist(), rows):
            yield own.slice(at, len(texts)), texts


def _signatures(n: int, bands: int):
    rng = np.random.default_rng(8)
    samples = bands * ROWS
    factors = rng.integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["row", "doc_id", "n_shingles", "key_a", "key_b", "bands", "sketch", "parity"]

    def parities(of: np.ndarray, bits: np.ndarray, n: int, longs: int) -> np.ndarray:
        seen = np.bincount(of * (64 * longs) + bits.astype(np.int64), minlength=n * 64 * longs) & 1
        return np.packbits(seen.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64).ravel()

    def run(batches):
        workers.begin("digests")
        for batch in batches:
            for part, texts in _slices(batch, 1000):
                made = Shingles(texts, n)
                sets = made.sets
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                mins = np.zeros((len(sets), samples), np.uint64)
                keys = np.zeros((2, len(sets)), np.uint64)
                flat, other = made.hashes()
                if len(full):
                    starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                    for j, f in enumerate(factors):
                        mins[full, j] = np.minimum.reduceat(flat * f, starts)
                    keys[0, full] = mix(np.add.reduceat(mix(flat), starts))
                    keys[1, full] = mix(np.add.reduceat(mix(other), starts))
                bucket = np.zeros((len(sets), bands), np.uint64)
                for r in range(ROWS):
                    bucket = mix(bucket * np.uint64(31) + mins[:, r::ROWS])
                bucket = mix(bucket + np.arange(bands, dtype=np.uint64))
                bit = mix(mins + np.arange(samples, dtype=np.uint64)) & np.uint64(64 * SKETCH_LONGS - 1)
                sketch = parities(np.repeat(np.arange(len(sets)), samples), bit.ravel(), len(sets), SKETCH_LONGS)
                whole = mix(flat) & np.uint64(64 * PARITY_LONGS - 1)
                parity = parities(np.repeat(np.arange(len(sets)), sizes), whole, len(sets), PARITY_LONGS)
                widths = ((bucket.view(np.int64).ravel(), bands), (sketch, SKETCH_LONGS), (parity, PARITY_LONGS))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), k).cast(pa.list_(pa.int64())) for x, k in widths]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), *lists], names)

    return run


def _differing_bits(a: str, b: str, longs: int) -> Column:
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(longs)), F.lit(0))


def may_be_similar(percent: int, bands: int) -> Column:
    """On columns n_a, n_b, sketch_a, sketch_b, parity_a, parity_b: what sizes and sketches leave possible."""
    sizes = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
    estimate = _differing_bits("sketch_a", "sketch_b", SKETCH_LONGS) <= most_bits(percent, bands)
    bound = _differing_bits("parity_a", "parity_b", PARITY_LONGS) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return sizes & estimate & bound


def most_bits(percent: int, bands: int) -> int:
    """Bits in which the sketches of a pair at the threshold may differ: where the estimate falls to 0.3 below it.

    Of s samples about s (1 - J) differ and each toggles two bits; 0.3 is over eight deviations of that for s of 100.
    """
    bits, differing = 64 * SKETCH_LONGS, 2 * bands * ROWS * (1 - (percent / 100 - 0.3))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** differing))


def _confirm(n: int, percent: int):
    def run(batches):
        workers.begin("digests")
        for batch in batches:
            keep = []
            for begin in range(0, batch.num_rows, PAIRS):
                part = batch.slice(begin, PAIRS)
                left = part.column("text_a").to_pylist()
                for at, texts in chunks(part.column("text_b").to_pylist(), PAIRS):
                    places: dict[str | None, int] = {}
                    of = [places.setdefault(x, len(places)) for x in left[at : at + len(texts)]]
                    sets = Shingles([*((x or "").encode("utf-8", "surrogatepass") for x in places), *texts], n).sets
                    for i, mine in zip(of, sets[len(places) :], strict=True):
                        both = len(np.intersect1d(sets[i], mine, assume_unique=True))
                        keep.append(both > 0 and 100 * both >= percent * (len(sets[i]) + len(mine) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of rows, of a written table, whose full sets of shingles, compared word by word, are similar enough."""
    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = materialize(rows.select("row", "text").join(F.broadcast(ids) if few else ids, "row", "left_semi"), "texts")
    with_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(n, percent), "a long, b long"), "confirmed")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the smallest
    doc_id that a document can reach.  A null or empty text has no shingles and is linked with nothing.  Rows that repeat
    a doc_id are documents of their own, each linked by its own text; a row without doc_id takes the component of what it
    is linked with, if any, and counts as kept.  An empty table gives no rows; columns beside doc_id and text are ignored.
    """
    ship(documents.sparkSession)
    bands = bands_for(percent)
    schema = "row long, doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, sketch array<long>, parity array<long>"
    rows = keyed(documents, nulls_last=True)
    signed = materialize(rows.select("row", "doc_id", "text").mapInArrow(_signatures(shingle, bands), schema), "signatures")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("key_a", "key_b").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    heads = full.join(classes, (full.row == classes.node) & (full.key_a == classes.key_a) & (full.key_b == classes.key_b))
    nodes = materialize(heads.select("node", "copies", "bands", F.col("n_shingles").alias("n"), "sketch", "parity"), "nodes")
    buckets = nodes.select("node", "copies", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("node")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", (-F.col("top.minus")).alias("hub"))
    possible = may_be_similar(percent, bands)

    def sift(pairs: DataFrame) -> DataFrame:
        of = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "parity")))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(possible).select("a", "b")

    stars = buckets.join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sifted = materialize(sift(stars), "sifted")
    links = confirm(rows, sifted, shingle, percent)
    first = connected_components(links, "a", "b")
    # what is left: classes of one bucket in different components
    placed = nodes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.select("component", F.explode("bands").alias("bucket"))
    mixed = spread.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("low < high").select("bucket", "blocks")
    rest = placed.select("node", "component", "n", "sketch", "parity", F.explode("bands").alias("bucket")).join(mixed, "bucket")
    rest = materialize(rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "rest")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda x, own, other: rest.select(F.col("bucket").alias(f"bucket_{x}"), F.col("block").alias(f"{own}_{x}"), others.alias(f"{other}_{x}"), F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("component", "n", "sketch", "parity")))
    on = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("i_a") == F.col("i_b")) & (F.col("j_a") == F.col("j_b")) & (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & possible
    cross = side("a", "i", "j").join(side("b", "j", "i"), on).select("a", "b").distinct()
    cross = cross.join(sifted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = confirm(rows, materialize(cross, "cross"), shingle, percent)
    last = connected_components(links.union(more), "a", "b")
    of_class = materialize(classes.join(last, "node", "left").select("key_a", "key_b", F.coalesce("component", "node").alias("found")), "classes")
    joined = signed.join(of_class, ["key_a", "key_b"], "left").withColumn("found", F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("row")))
    if rows.schema["row"].metadata.get("numbered"):  # rows in order of doc_id, so the first row of a component has its smallest
        joined = joined.join(rows.select(F.col("row").alias("found"), F.col("doc_id").alias("component_id")), "found")
    else:
        joined = joined.withColumn("component_id", F.col("found"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
