"""Language identification by interpolated Kneser-Ney character models.

Training counts the ORDER-grams of the labelled texts in Spark, all but a bounded slice that calibrates; continuation
counts, discounts and probabilities are aggregates and joins over all of them.  A model set is, for each order, the sorted
hashes of grams with the log probability of the last character under every language, and those of contexts with the back-off
weights, in files of about SHARD rows in the shared folder; the driver holds none.  A text's language is the one of the
lowest cross-entropy per character; a logistic calibration turns the margin into a score, and texts that no model explains
as well as its own training texts are rejected.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import workers
from lectern.session import materialize, shared_dir, ship

ORDER = 5
CALIBRATION_ROWS = 1_000  # about so many rows of a language, a fifth of them at most, fit the score and the rejection limits
SHARD = 50_000  # rows of a model file, about
RESIDENT = 4_000_000  # rows of one order that a worker keeps; files beyond are read where they are needed
ROWS = 500  # texts that a worker counts or scores at a time
UNKNOWN = "und"
_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint32(32)
_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of code points, lower-case letters with single spaces between words.

    ORDER - 1 spaces stand before each text; also returns the place of its first symbol and the number of its letters.
    """
    pad = np.full(ORDER - 1, _SPACE)
    out, starts, letters, at = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _is_letter(codes)
        letters[i] = int(is_letter.sum())
        codes = np.where(is_letter, codes, _SPACE)
        if len(codes):
            space = ~is_letter
            keep = np.ones(len(codes), bool)
            keep[1:] = ~(space[1:] & space[:-1])
            keep[0] = not space[0]
            codes = codes[keep]
        out += [pad, codes]
        starts[i] = at + ORDER - 1
        at += ORDER - 1 + len(codes)
    return np.concatenate([*out, pad[:0]]) if out else pad[:0], starts, letters


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the `order` symbols that end at each place from order - 1 on."""
    h = codes.astype(np.uint64)
    for n in range(1, order):
        h = h[:-1] * _M + codes[n:].astype(np.uint64)
    return h


# --- training -----------------------------------------------------------------------------------------------------


def _slices(batches):
    """Batches of ROWS rows, so that what a worker makes of them at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _count(batches):
    workers.begin()
    for part in _slices(batches):
        langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for at in range(0, len(mine), ROWS):
                codes, _, _ = symbols(mine[at : at + ROWS])
                if len(codes) < ORDER:
                    continue
                h = hashes(codes, ORDER)
                _, first, counts = np.unique(h, return_index=True, return_counts=True)
                grams = codes[first[:, None] + np.arange(ORDER)].astype("<u4")
                real = (grams[:, -1] != _SPACE) | (grams[:, -2] != _SPACE)
                grams, counts = grams[real], counts[real]
                text = grams.tobytes().decode("utf-32-le", "surrogatepass")
                rows = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(rows), pa.array(counts)], ["lang", "gram", "n"])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over every labelled text."""
    known = labelled.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return known.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _keyed(batches):
    workers.begin()
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), -1)
        yield pa.RecordBatch.from_arrays([pa.array(_rows(codes).view(np.int64)), batch.column("v")], ["key", "v"])


def _store(grams: DataFrame, path: str) -> None:
    """Write (gram, v) as (key, v), sorted, in files of about SHARD rows."""
    files = -(-grams.count() // SHARD) or 1
    keyed = grams.select("gram", "v").mapInArrow(_keyed, "key long, v array<float>")
    keyed.repartitionByRange(files, "key").sortWithinPartitions("key").write.parquet(path)


def estimate(counts: DataFrame) -> Models:
    """Models by the Kneser-Ney estimates of (lang, gram, n), as in _Levels, order by order."""
    spark = counts.sparkSession
    types = {ORDER: materialize(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many types does the shorter gram end?
        types[n] = materialize(types[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    langs = sorted(r.lang for r in types[1].select("lang").distinct().collect())
    path = f"{shared_dir(spark)}/language-models-{uuid.uuid4().hex}"
    if not langs:
        return Models([], path, np.zeros(0, np.float32))
    vocabulary = (types[1].select("gram").distinct().count() + 1) * 8
    of_each = lambda value, other: F.array(*(F.coalesce(F.max(F.when(F.col("lang") == x, value)), other) for x in langs))
    lower = spark.createDataFrame([(x, "", 1 / vocabulary) for x in langs], "lang string, rest string, below double")
    vectors = spark.createDataFrame([("", [float(-np.log(vocabulary))] * len(langs))], "rest string, under array<double>")
    base = None
    for n in range(1, ORDER + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(ones > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.05), ones / (ones + 2 * twos)))).otherwise(0.5)
        discounts = types[n].groupBy("lang").agg(discount.alias("discount"))
        own = types[n].withColumn("context", F.substring("gram", 1, n - 1)).withColumn("rest", F.substring("gram", 2, n - 1))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(F.broadcast(discounts), "lang")
        contexts = materialize(contexts.withColumn("back", F.col("discount") * F.col("kinds") / F.col("total")), "contexts")
        p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("below")
        found = materialize(own.join(contexts, ["lang", "context"]).join(lower, ["lang", "rest"]).select("lang", "gram", "context", "rest", p.alias("p")), "probabilities")
        backs = contexts.groupBy("context").agg(of_each(F.log("back"), F.lit(0.0)).alias("back"))
        if n == 1:
            base = np.array(backs.collect()[0].back, np.float32) - np.float32(np.log(vocabulary))
        else:
            _store(backs.select(F.col("context").alias("gram"), F.col("back").cast("array<float>").alias("v")), f"{path}/contexts-{n}")
        # every gram that any language knows, with its probability under all of them
        known = found.groupBy("gram", "context", "rest").agg(of_each(F.log("p"), F.lit(None)).alias("known"))
        backed_off = F.zip_with("under", "back", lambda u, b: u + b)
        every = known.join(vectors, "rest").join(backs, "context").select("gram", F.zip_with("known", backed_off, lambda k, u: F.coalesce(k, u)).alias("v"))
        every = materialize(every, "vectors")
        _store(every.select("gram", F.col("v").cast("array<float>").alias("v")), f"{path}/grams-{n}")
        lower = found.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below"))
        vectors = every.select(F.col("gram").alias("rest"), F.col("v").alias("under"))
    return Models(langs, path, base)


class _Levels:
    """Kneser-Ney estimates of one language: for each order n, hashes of grams with P(last | rest), of contexts with weight."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, vocabulary: int):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        levels = []
        types, weight = grams, counts.astype(float)
        for n in range(ORDER, 0, -1):
            levels.append((types, weight))
            if n > 1:  # continuation counts: in how many types does the shorter gram end?
                _, first, times = np.unique(_rows(types[:, 1:]), return_index=True, return_counts=True)
                types, weight = types[first][:, 1:], times.astype(float)
        lower = None  # sorted (hash, P) of the order below
        for n, (types, weight) in enumerate(reversed(levels), 1):
            ones, twos = float((weight == 1).sum()), float((weight == 2).sum())
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            context, inverse = np.unique(_rows(types[:, :-1]), return_inverse=True) if n > 1 else (np.zeros(1, np.uint64), np.zeros(len(types), np.int64))
            total, kinds = np.bincount(inverse, weight), np.bincount(inverse)
            back = discount * kinds / total
            below = lower[1][np.searchsorted(lower[0], _rows(types[:, 1:]))] if lower is not None else np.full(len(types), 1 / vocabulary)
            p = np.maximum(weight - discount, 0) / total[inverse] + back[inverse] * below
            keys = _rows(types)
            order = np.argsort(keys)
            lower = keys[order], p[order]
            self.grams.append(lower)
            self.contexts.append((context, back))


def _rows(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        h = h * _M + grams[:, i].astype(np.uint64) if i else grams[:, i].astype(np.uint64)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


_loaded: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, list[str]]] = {}
_slots: dict[str, tuple[np.uint64, np.ndarray]] = {}
workers.keeps("language models", lambda: (_loaded.clear(), _slots.clear()))


def _read(path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    system, at = pf.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        found = pq.ParquetFile(f).read()
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in found.column("v").chunks]
    return found.column("key").to_numpy(), np.concatenate([np.zeros(0, np.float32), *values]).reshape(-1, width)


class Models:
    """All languages' models in files of sorted hashes; `entropy` scores texts."""

    def __init__(self, langs: list[str], path: str, base: np.ndarray):
        """base: for each language the log probability of a character that none knows"""
        self.langs, self.path, self.base = langs, path, base
        self.calibration = np.array([0.0, 0.0, 0.0])
        self.limits = {x: np.inf for x in self.langs}

    def _table(self, name: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Keys and values of the first files, up to RESIDENT rows, and the paths of the other ones."""
        if (self.path, name) not in _loaded:
            for old in [k for k in _loaded if k[0] != self.path]:
                del _loaded[old]
            system, at = pf.FileSystem.from_uri(f"{self.path}/{name}")
            names = sorted(x.base_name for x in system.get_file_info(pf.FileSelector(at)) if x.base_name.endswith(".parquet"))
            files, parts, n = [f"{self.path}/{name}/{x}" for x in names], [], 0
            while files and n < RESIDENT:
                parts.append(_read(files.pop(0), len(self.langs)))
                n += len(parts[-1][0])
            keys, values = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
            del parts
            if not (keys[1:] >= keys[:-1]).all():  # files are written in order of keys, so as a rule they are
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
            _loaded[self.path, name] = keys, values, files
        return _loaded[self.path, name]

    def _look(self, name: str, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the wanted hashes, 0 where there are none, and whether there are."""
        wanted = wanted.view(np.int64)
        keys, values, files = self._table(name)
        out, hits = np.zeros((len(wanted), len(self.langs)), np.float32), np.zeros(len(wanted), bool)
        for k, v in [(keys, values), *((None, f) for f in files)]:
            if k is None:
                k, v = _read(v, len(self.langs))
            at, hit = _find(k, wanted)
            out[hit] = v[at[hit]]
            hits |= hit
        return out, hits

    def _quick(self) -> tuple[np.uint64, np.ndarray]:
        """Where in the resident grams of the highest order a hash is most likely to be, by its first bits once mixed."""
        if self.path not in _slots:
            keys = self._table(f"grams-{ORDER}")[0].view(np.uint64)
            bits = max(8, min(22, int(np.ceil(np.log2(len(keys) * 4 + 1)))))
            shift, slots = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
            slots[(keys * _M) >> shift] = np.arange(len(keys))
            _slots.clear()
            _slots[self.path] = shift, slots
        return _slots[self.path]

    def _below(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of grams of order n where the gram itself isn't known: back-off weight and the order below."""
        if n == 1:
            return np.repeat(self.base[None], len(grams), axis=0)
        return self._of(grams[:, 1:], n - 1) + self._look(f"contexts-{n}", _rows(grams[:, :-1]))[0]

    def _of(self, grams: np.ndarray, n: int) -> np.ndarray:
        found, hit = self._look(f"grams-{n}", _rows(grams))
        if not hit.all():
            found[~hit] = self._below(grams[~hit], n)
        return found

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages), symbols and letters of each text."""
        codes, starts, letters = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        ends = np.r_[starts[1:] - (ORDER - 1), len(codes)] if len(texts) else starts
        sizes = ends - starts
        if len(codes) >= ORDER and self.langs:
            h = hashes(codes, ORDER)  # of the gram that ends at place i + ORDER - 1
            shift, slots = self._quick()
            at = slots[(h * _M) >> shift]
            keys, logp, _ = self._table(f"grams-{ORDER}")
            keys = keys.view(np.uint64)
            miss = np.flatnonzero(keys[at] != h)
            if len(miss):
                distinct, inverse = np.unique(h[miss], return_inverse=True)
                first = np.empty(len(distinct), np.int64)
                first[inverse] = miss
                extra, hit = self._look(f"grams-{ORDER}", distinct)
                if not hit.all():
                    extra[~hit] = self._below(codes[first[~hit][:, None] + np.arange(ORDER)], ORDER)
            full = sizes > 0
            bounds = np.stack([starts[full] - (ORDER - 1), ends[full] - (ORDER - 1)], axis=1)
            for j in range(len(self.langs)):
                p = logp[:, j][at].astype(np.float64)
                if len(miss):
                    p[miss] = extra[:, j][inverse]
                sums = np.r_[0.0, np.cumsum(p)]
                total[full, j] = sums[bounds[:, 1]] - sums[bounds[:, 0]]
        return -total / np.maximum(sizes, 1)[:, None], sizes, letters

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, float, bool]]:
        """(language, score, entropy, margin, rejected) of each text."""
        out = []
        for at in range(0, len(texts), ROWS // 2):
            entropy, sizes, letters = self.entropy(texts[at : at + ROWS // 2])
            for row, size, n in zip(entropy, sizes.tolist(), letters.tolist(), strict=True):
                if not n or not self.langs:
                    out.append((UNKNOWN, 0.0, 0.0, 0.0, True))
                    continue
                best = int(row.argmin())
                margin = float(np.partition(row, 1)[1] - row[best]) if len(row) > 1 else 1.0
                score = float(1 / (1 + np.exp(-np.clip(features(margin, size) @ self.calibration, -30, 30))))
                lang = self.langs[best]
                out.append((lang, score, float(row[best]), margin, bool(row[best] > self.limits[lang] + 8 / max(1, size) ** 0.5)))
        return out


def features(margin: float, size: int) -> np.ndarray:
    return np.array([1.0, margin, margin * min(size, 2000) ** 0.5])


def train(documents: DataFrame, usable) -> Models:
    """Models and their calibration from rows with text and lang; `usable` is a condition on rows.

    All usable rows are counted but those that calibrate: of each language about CALIBRATION_ROWS, at most a fifth, by a
    hash of doc_id; of one with less than five rows none.  Whole texts count, however long; rows with a null text or lang
    teach nothing, repeated rows teach as often as they stand.  Without any counted row every text is `und`.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = held_out({r.lang: r["count"] for r in rows.groupBy("lang").count().collect()})
    models = estimate(gram_counts(rows.where(~held)))
    _calibrate(models, predict(rows.where(held), models, keep=("lang",)).select("lang", "lang_pred", "margin", "entropy", "size").toPandas())
    return models


def held_out(sizes: dict[str, int]):
    """Whether a row calibrates, from the number of rows of each language."""
    held = F.lit(False)
    for lang, n in sorted(sizes.items()):
        own = F.pmod(F.xxhash64("doc_id"), F.lit(n)) < min(CALIBRATION_ROWS, n // 5)
        held = F.when(F.col("lang") == lang, F.col("doc_id").isNotNull() & own).otherwise(held)
    return held


def _calibrate(models: Models, seen) -> None:
    """Logistic fit of "the prediction is right" on the margin; entropy limits from right predictions."""
    seen = seen[seen["lang_pred"] != UNKNOWN]
    x = np.array([features(m, s) for m, s in zip(seen["margin"], seen["size"], strict=True)]).reshape(-1, 3)
    y = (seen["lang"] == seen["lang_pred"]).to_numpy(float)
    w = np.array([0.0, 4.0, 1.0])
    for _ in range(50):  # Newton steps, weights held near their start
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * (w - np.array([0.0, 4.0, 1.0]))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1, 2 / max(1e-9, float(np.abs(step).max())))
    models.calibration = w
    right = seen["entropy"][(seen["lang"] == seen["lang_pred"]) & (seen["size"] >= 50)]
    limits = {}
    for lang in models.langs:
        own = seen["entropy"][(seen["lang_pred"] == lang) & (seen["lang"] == lang) & (seen["size"] >= 50)]
        if len(own) >= 20:
            limits[lang] = float(own.quantile(0.99)) + 1.0
    # a language of too few rows takes the widest of the others' limits and of all right predictions together
    pooled = max([*limits.values(), *([float(right.quantile(0.99)) + 1.0] if len(right) >= 20 else [])], default=np.inf)
    models.limits = {x: limits.get(x, pooled) for x in models.langs}


def predict(documents: DataFrame, models: Models, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the columns `keep` with lang_pred, score, entropy, margin, size, rejected; from text alone.

    A null text or one without a letter is `und`, score 0, rejected.  Whole texts count, however long; of languages that
    explain a text equally well the first by name is taken.  Rows stay rows: repeated ones are judged alike, a null doc_id
    as any; no documents give no rows; columns beside doc_id, text and `keep` are ignored, whatever they are called.
    """
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(models)
    columns = ["doc_id", *keep]
    kinds = dict(documents.dtypes)
    place = columns.index("text") if "text" in columns else len(columns)  # a text that is kept travels once

    def run(batches):
        workers.begin("language models")
        for batch in _slices(batches):
            texts = batch.column(place).to_pylist()
            found = shared.value.judge(texts)
            made = [pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            size = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made, size], [*columns, "lang_pred", "score", "entropy", "margin", "rejected", "size"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", lang_pred string, score double, entropy double, margin double, rejected boolean, size long"
    read = documents.select(*columns) if "text" in columns else documents.select(*columns, F.col("text").alias("text to judge"))
    return read.mapInArrow(run, schema)
