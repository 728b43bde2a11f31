"""Language identification by string kernels: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import short_batches
from millrace.llm.tokens import batches

#: n-grams of 1 to ORDERS bytes fall into 2 ** BITS presence bits.
ORDERS, BITS = 4, 16
WORDLIKE = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: Bytes of a text as the kernel sees them: letters in lower case, runs of other ASCII characters as blanks.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Texts scored by one matrix product.
ROWS = 64
#: An n-gram is common in a language if this share of its learned texts have it. A text is like a language if the share
#: of common n-grams in it is at least MARGIN times what all but TAIL of the learned texts reach: those of other
#: languages and gibberish stay far below (README), mixed or noisy texts don't.
COMMON, TAIL, MARGIN = 0.02, 0.01, 0.75


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals such as fractions and superscripts aren't."""
    return any(m.group().isalpha() for m in WORDLIKE.finditer(text or ""))


def spectra(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the places in 2 ** BITS of its n-grams' occurrences, over the whole text: of 1 and 2 bytes, of 3 and more."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN) for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    hashed = []
    gram = np.zeros(len(codes), np.uint32)
    for n in range(1, ORDERS + 1):
        m = max(0, len(codes) - n + 1)
        gram = gram[:m] * np.uint32(0x01000193) + codes[n - 1 : n - 1 + m] + np.uint32(n)
        spread = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        hashed.append((spread >> np.uint32(32 - BITS)).astype(np.uint16))
    at = 0
    for r in raw:
        own = [h[at : at + max(0, len(r) - n + 1)] for n, h in enumerate(hashed, 1)]
        yield np.concatenate(own[:2]), np.concatenate(own[2:])
        at += len(r)


def presence(spectrum: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bits of the n-grams that occur."""
    bits = np.zeros(1 << BITS, bool)
    for places in spectrum:
        bits[places] = True
    return bits


def share(spectrum: tuple[np.ndarray, np.ndarray], packed: np.ndarray) -> float:
    """Of the occurrences of n-grams of 3 and more bytes the share whose bit is set, whatever the text's length; 1 if there are none."""
    places = spectrum[1]
    return float((packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).mean()) if len(places) else 1.0


@dataclass
class LanguageModel:
    """Landmarks as packed presence bits, the weights of each language's kernel values against them, and of each language
    the packed bits of its common n-grams and the least share of occurrences in a text that must be of these."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    common: np.ndarray
    least: np.ndarray

    def ready(self) -> LanguageModel:
        bits = np.unpackbits(self.landmarks, axis=1).astype(bool)
        self.used = np.flatnonzero(bits.any(axis=0))  # other n-grams add nothing to any kernel value
        self.matrix = bits[:, self.used].T.astype(np.float32)
        self.norms = np.sqrt(np.maximum(bits.sum(axis=1), 1))
        return self

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text each language's value, near 1 for its own and -1 for others, and whether it is like the best one."""
        block, norms, own = np.zeros((len(texts), len(self.used)), np.float32), np.zeros(len(texts)), list(spectra(texts))
        for i, spectrum in enumerate(own):
            bits = presence(spectrum)
            block[i] = bits[self.used]
            norms[i] = max(1, np.count_nonzero(bits))
        kernel = (block @ self.matrix).astype(np.float64) / (np.sqrt(norms)[:, None] * self.norms)
        values = np.c_[kernel, np.ones(len(texts))] @ self.weights
        best = values.argmax(axis=1)
        return values, np.array([share(x, self.common[b]) >= self.least[b] for x, b in zip(own, best.tolist())])


def kernel(packed: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The normalized kernel values of every row of packed bits against the chosen rows; ROWS rows are unpacked at a time."""

    def unit(some: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(some, axis=1).astype(np.float32)
        return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))

    marks = unit(packed[chosen]).T
    return np.concatenate([unit(packed[at : at + ROWS]) @ marks for at in range(0, len(packed), ROWS)]).astype(np.float64)


def ridge(packed: np.ndarray, own: np.ndarray, languages: list[str], landmarks: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks and weights: one-versus-rest ridge regression on Nyström features of the normalized presence kernel."""
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(own == c)[:each] for c in range(len(languages))])
    values_of = kernel(packed, chosen)
    values, vectors = np.linalg.eigh(values_of[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.c_[values_of @ root, np.ones(len(packed))]
    target = np.where(own[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (1.0 / np.bincount(own))[own][:, None]  # every language weighs the same
    damp = np.eye(features.shape[1]) * penalty
    damp[-1, -1] = 1e-9
    beta = np.linalg.solve(features.T @ (features * balance) + damp, features.T @ (target * balance))
    return packed[chosen], np.r_[root @ beta[:-1], beta[-1:]]


def common_grams(packed: np.ndarray, own: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each language the packed bits of its common n-grams, and of those that are common in the other texts of any text that has them."""
    common, others = [], []
    for c in range(languages):
        texts = packed[own == c]
        counts = sum(np.unpackbits(texts[at : at + ROWS], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(texts), ROWS))
        common.append(np.packbits(counts >= max(1, COMMON * len(texts))))
        others.append(np.packbits(counts - 1 >= max(1, COMMON * (len(texts) - 1))))
    return np.stack(common), np.stack(others)


def train_languages(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", key: Column | None = None,
    sample: int = 2000, landmarks: int = 128, penalty: float = 1e-3,
) -> LanguageModel | None:
    """A model of the non-null labels; null if no labelled text has a letter.

    Learns from at most about ``sample`` rows in all, as many for each label: rows whose hash of ``key`` (of the text if
    none is given) is below a threshold that follows from the label's row count. Only their presence bits, 8 kB each,
    reach the driver, and a share each.
    """
    short_batches(labelled.sparkSession)
    key = F.xxhash64(F.lit("learn"), F.col(text_col)) if key is None else F.xxhash64(F.lit("learn"), key)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), key.alias("__hash"),
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(sample).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    limits = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, each / n))])
    uniform = F.shiftrightunsigned("__hash", 11).cast("double") / float(2**53)

    def bits(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for at, some in batches(table.column(2)):
                ok = [i for i, t in enumerate(some) if has_letter(t)]
                packed = [np.packbits(presence(x)).tobytes() for x in spectra([some[i] for i in ok])]
                chosen = pa.array([at + i for i in ok], pa.int64())
                yield pa.RecordBatch.from_arrays([table.column(0).take(chosen), table.column(1).take(chosen), pa.array(packed, pa.binary())], names=["label", "__hash", "bits"])

    learned = rows.where(uniform < limits[F.col("label")]).select("label", "__hash", "text")
    got = learned.mapInArrow(bits, "label string, __hash long, bits binary").collect()
    got.sort(key=lambda r: (r["__hash"], r["label"], bytes(r["bits"])))
    if not got:
        return None
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1)
    languages = sorted({r["label"] for r in got})
    own = np.array([languages.index(r["label"]) for r in got])
    common, others = common_grams(packed, own, len(languages))
    held = labelled.sparkSession.sparkContext.broadcast(dict(zip(languages, others)))  # 8 kB a language

    def shares(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            labels = table.column(0).to_pylist()
            for at, some in batches(table.column(2)):
                ok = [i for i, t in enumerate(some) if has_letter(t)]
                own = [labels[at + i] for i in ok]
                found = [share(x, held.value[label]) for label, x in zip(own, spectra([some[i] for i in ok]))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.float64())], names=["label", "share"])

    reached = learned.mapInArrow(shares, "label string, share double").collect()
    least = MARGIN * np.array([np.quantile([r["share"] for r in reached if r["label"] == x], TAIL) for x in languages])
    return LanguageModel(languages, *ridge(packed, own, languages, landmarks, penalty), common, least)


def told(text: Column, model: LanguageModel | None, spark: SparkSession) -> Column:
    """struct<lang, score, alike> of a text; only the text reaches Python, in blocks of bounded size."""
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)  # at most landmarks times 8 kB

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        if model is not None:
            model.ready()
        for column in columns:
            names, scores, alike = [UNDETERMINED] * len(column), [0.0] * len(column), [False] * len(column)
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist() if model is not None else []
            at = 0
            while at < len(lengths):
                to, size = at, 0
                while to < len(lengths) and to - at < ROWS and size < 1_000_000:
                    size += lengths[to]
                    to += 1
                texts = column.slice(at, to - at).to_pylist()
                some = [i for i, t in enumerate(texts) if has_letter(t)]
                if some:
                    values, like = model.score([texts[i] for i in some])
                    for i, b, v, a in zip(some, values.argmax(axis=1).tolist(), values.max(axis=1).tolist(), like.tolist()):
                        names[at + i], scores[at + i], alike[at + i] = model.languages[b], min(1.0, max(0.0, (v + 1) / 2)), a
                at = to
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(alike, pa.bool_())], names=["lang", "score", "alike"])

    return F.arrow_udf(run, "lang string, score double, alike boolean").asNondeterministic()(text.cast("string"))  # so that no filter runs it a second time


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str] = ("doc_id",), text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "alike")) -> DataFrame:
    """The columns ``keep`` of every row with the predicted language, its score (0 to 1) and whether the text is like it, as columns ``names``.

    A null text, one without letters (empty; numerals, marks) is ``und`` with score 0, and so is every text where there
    is no model. Scores are the best language's regression value taken from -1..1 to 0..1; ties go to the language first
    in code-point order. A score says which language is nearest, and depends on how many there are; a text is like it if
    among its n-grams' occurrences the share of those common in the language reaches MARGIN times what all but TAIL of
    the learned texts reach, each measured by the other learned texts. Repeated rows are scored alike. ``keep`` and the text are read, and the text alone reaches Python.

    n-grams are hashed to 2 ** BITS bits, so a text of d distinct ones finds about d / 2 ** BITS of its bits taken
    already: 5 % for a page of prose. The kernel of a text that fills most bits tells less: README has the accuracy
    on texts of 5 MB.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], told(F.col(f"`{text_col}`"), model, docs.sparkSession).alias("__told"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"__told.{f}").alias(n) for f, n in zip(("lang", "score", "alike"), names)])


def in_fold(id_column: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id doesn't."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))
