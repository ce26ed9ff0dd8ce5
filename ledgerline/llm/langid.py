"""Language identification by hierarchical discrimination.

A text is first given a language family, then a language within it. Both steps are one-versus-one
linear support vector machines over hashed byte n-grams of the whole text: pairs of families, and
pairs of languages of one family only, which must learn the finer differences. A model is linear in
n-gram frequencies, so a text's margin is the mean of the weights its n-grams look up.

Training takes at most TRAIN_ROWS labelled rows in all (the same number of each language, those of
smallest hash, whole texts), so the model and what the driver sees of the corpus are bounded; a
prediction uses the text alone.

A machine must name one of its languages, so a text of another language, of code or of random letters
gets a name too, often surely. Whether it is a text of any learned language is told by its n-grams' mean
log frequency among the training rows: each of these is measured without itself, and a text is known if
it lies nearer to the least usual of them than to random bytes.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled row
every text is `und`; with one language learned, every text with a letter is that language, score 1;
a language outside the family table is a family of its own; null labels are not learned; repeated
rows get equal results; in a vote, names with equally many pairs won are told apart by the sum of their
margins, then by name; texts of any length are read whole, one at a time beyond 4 MB; an empty table
gives no rows; other columns are kept or not read, whatever their names. Every text with a letter is
known where fewer than two rows were learned, or where no row shares an n-gram with another.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow_text import joined, text_udf
from .common import doc_bucket, join_keys, slices, whole_row

# Language codes by family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "malayic": ("id", "jv", "ms", "su", "tl"),
}
UNKNOWN = "und"

TRAIN_ROWS = 1600
#: Training rows ranked for each one taken (some have no letter).
SPARE = 8
ORDERS = (3, 5)
BITS = 13
EPOCHS = 40
COST = 8.0
STEEPNESS = 12.0
#: Frequency that an n-gram without occurrence counts with.
UNSEEN = 1e-5

_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: ASCII other than letters counts as white space, so punctuation and digits carry no sign.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


#: Blanks before a text, so that its first n-grams reach back into nothing else.
_MARGIN = max(ORDERS) - 1


def _normalised(text: bytes) -> bytes:
    return b" " * _MARGIN + text.decode(errors="replace").lower().encode().translate(_LETTERS) + b" "


#: Bytes whose n-grams are looked up at a time (each takes some 60 bytes in arrays, and 4 for each pair of names).
PIECE = 1 << 18


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Normalised texts, some at a time, and the number of each in `texts`. A text of more than PIECE bytes
    comes in parts of that size, each after the _MARGIN bytes before it, so that it has every n-gram once."""
    for lo, hi in slices([len(t) for t in texts], PIECE):
        runs = [(i, t[k:k + PIECE + _MARGIN]) for i, t in zip(range(lo, hi), map(_normalised, texts[lo:hi]))
                for k in range(0, len(t) - _MARGIN, PIECE)]
        for a, b in slices([len(run) for _, run in runs], PIECE):
            yield np.array([i for i, _ in runs[a:b]]), [run for _, run in runs[a:b]]


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Feature of the n-gram that ends at each byte."""
    code = data.astype(np.uint64)
    key = code.copy()
    for k in range(1, order):
        key[k:] |= code[:-k] << np.uint64(8 * k)
    mixed = (key + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, frequencies) of each text; a text's n-grams of one order sum to 1."""
    out = []
    for t in texts:
        data = np.frombuffer(_normalised(t), np.uint8)
        count = np.zeros(len(ORDERS) << BITS)
        for n, order in enumerate(ORDERS):
            got = np.bincount(_grams(data, order)[_MARGIN:], minlength=1 << BITS)
            count[n << BITS:(n + 1) << BITS] = got / got.sum()
        at = np.flatnonzero(count)
        out.append((at, count[at]))
    return out


class Model:
    """Weights of all pairs: columns are (first, second) names, a positive margin means first.
    `usual` holds each n-gram's log frequency, `least` the mean of a text that is just known."""

    def __init__(self, langs: list[str], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray,
                 usual: np.ndarray | None = None, least: float = -np.inf):
        self.langs, self.pairs, self.bias, self.least = langs, pairs, bias, least
        usual = np.zeros(len(weights)) if usual is None else usual
        self.weights = weights.astype(np.float32)
        self.table = np.column_stack((self.weights, usual)).astype(np.float32)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """(texts, pairs) margins."""
        return self._means(texts)[:, :-1] + self.bias

    def _means(self, texts: list[bytes]) -> np.ndarray:
        """Mean weights of each text's n-grams: a column for each pair, then how usual they are."""
        total, length = np.zeros((len(texts), len(self.pairs) + 1)), np.zeros(len(texts))
        for whose, runs in _pieces(texts):
            data, at = joined(runs)
            sizes = np.diff(at) - _MARGIN
            np.add.at(length, whose, sizes)
            own = np.ones(len(data), bool)
            own[(at[:-1, None] + np.arange(_MARGIN)).ravel()] = False
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for n, order in enumerate(ORDERS):
                gram = _grams(data, order)[own] + (n << BITS)
                np.add.at(total, whose, np.add.reduceat(self.table[gram], starts, axis=0, dtype=np.float64))
        return total / length[:, None]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        """Each text's language, how sure it is, and whether the text is of any learned language."""
        if not self.langs:
            return [(UNKNOWN, 0.0, False)] * len(texts)
        means = self._means(texts)
        known = (means[:, -1] >= self.least).tolist()
        if len(self.langs) < 2:
            return [(self.langs[0], 1.0, k) for k in known]
        margin = means[:, :-1] + self.bias
        column = {p: k for k, p in enumerate(self.pairs)}
        groups: dict[str, list[str]] = {}
        for x in self.langs:
            groups.setdefault(family(x), []).append(x)
        out = []
        for row, k in zip(margin, known):
            fam, sure = _elect(sorted(groups), "family:", row, column)
            lang, too = _elect(groups[fam], "", row, column)
            out.append((lang, float(sure * too), k))
        return out


def _elect(names: list[str], prefix: str, row: np.ndarray, column: dict) -> tuple[str, float]:
    """Winner of most pairs (ties: the larger sum of margins, then the first name) and how sure its pairs are."""
    if len(names) == 1:
        return names[0], 1.0
    won, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for a, b in itertools.combinations(names, 2):
        m = float(row[column[prefix + a, prefix + b]])
        won[a if m >= 0 else b] += 1
        for x, v in ((a, m), (b, -m)):
            total[x] += v
            least[x] = min(least[x], v)
    best = max(names, key=lambda x: (won[x], total[x], [-ord(c) for c in x]))
    return best, 1.0 / (1.0 + np.exp(-np.clip(STEEPNESS * least[best], -60, 60)))


def _svm(gram: np.ndarray, sign: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by dual coordinate descent on the rows' inner products (there are far
    fewer rows than features): the rows' coefficients and the bias. The classes' costs are balanced."""
    c = np.where(sign > 0, cost * len(sign) / (2 * max(1, (sign > 0).sum())), cost * len(sign) / (2 * max(1, (sign < 0).sum())))
    gram = gram + 0.01  # with a small constant feature for the bias
    diagonal = 1 / (2 * c)
    norm = np.diag(gram) + diagonal
    alpha, value, rng = np.zeros(len(sign)), np.zeros(len(sign)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(sign)):
            new = max(0.0, alpha[i] - (sign[i] * value[i] - 1 + diagonal[i] * alpha[i]) / norm[i])
            if new != alpha[i]:
                value += (new - alpha[i]) * sign[i] * gram[i]
                alpha[i] = new
    return alpha * sign, 0.01 * float(alpha @ sign)


def _usual(features: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, float]:
    """Each n-gram's log frequency among the rows, and the least mean of a known text: half way from
    the least usual row, measured by the others alone, to random n-grams."""
    n = len(features)
    total = np.zeros(width)
    for at, value in features:
        total[at] += value
    usual = np.log(total / max(1, n) + UNSEEN)
    if n < 2:
        return usual, -np.inf
    least = min(float(value @ np.log(np.maximum(total[at] - value, 0) / (n - 1) + UNSEEN)) for at, value in features)
    return usual, (least + len(ORDERS) * float(usual.mean())) / 2


#: Rows that are spread out to all features at a time.
_DENSE = 128


def _dense(features: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(features), len(scale)), np.float32)
    for row, (at, value) in zip(rows, features):
        row[at] = value * scale[at]
    return rows


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """All pairs of families, and of the languages of each family.

    The rows stay sparse; their inner products are taken block by block, and a pair of names uses its
    part of that one matrix, so memory beyond the sparse rows is a row x row matrix and two blocks."""
    names = np.array(labels, object)
    families = np.array([family(x) for x in labels], object)
    langs = sorted(set(labels))
    n, width = len(features), len(ORDERS) << BITS
    square = np.zeros(width)
    for at, value in features:
        square[at] += value.astype(np.float64) ** 2
    scale = 1 / (np.sqrt(square / max(1, n)) + 1e-3)  # frequent and rare n-grams weigh alike
    length = float(np.mean([np.sqrt(((value * scale[at]) ** 2).sum()) for at, value in features])) if n else 1.0
    scale /= max(length, 1e-9)
    gram = np.zeros((n, n))
    for lo in range(0, n, _DENSE):
        a = _dense(features[lo:lo + _DENSE], scale)
        for other in range(0, lo + 1, _DENSE):
            part = a @ (a if other == lo else _dense(features[other:other + _DENSE], scale)).T
            gram[lo:lo + len(a), other:other + part.shape[1]] = part
            gram[other:other + part.shape[1], lo:lo + len(a)] = part.T
    pairs, weights, bias = [], [], []
    for prefix, of, groups in (("family:", families, [sorted(set(families))]),
                               ("", names, [[x for x in langs if family(x) == f] for f in sorted(set(families))])):
        for group in groups:
            for a, b in itertools.combinations(group, 2):
                own = np.flatnonzero((of == a) | (of == b))
                part, c = _svm(gram[np.ix_(own, own)], np.where(of[own] == a, 1.0, -1.0))
                w = np.zeros(width)
                for i, x in zip(own, part):
                    if x:
                        w[features[i][0]] += x * features[i][1]
                pairs.append((prefix + a, prefix + b))
                weights.append((w * scale * scale).astype(np.float32))
                bias.append(c)
    return Model(langs, pairs, np.array(weights).T if pairs else np.zeros((width, 0), np.float32), np.array(bias),
                 *_usual(features, width))


def identify(text: Column, model: Model) -> Column:
    """struct(lang, score, known) of a text column."""
    def run(texts):
        seen = [t is not None and any(c.isalpha() for c in t.decode(errors="replace")) for t in texts]
        got = iter(model.predict([t for t, s in zip(texts, seen) if s]))
        found = [next(got) if s else (UNKNOWN, 0.0, False) for s in seen]
        return pa.StructArray.from_arrays([pa.array([x for x, _, _ in found], pa.string()),
                                           pa.array([x for _, x, _ in found], pa.float64()),
                                           pa.array([x for _, _, x in found], pa.bool_())], ["lang", "score", "known"])
    return text_udf(run, "lang string, score double, known boolean")(text)


def training_rows(docs: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """At most `most` labelled rows with a letter, equally many of each language: those of smallest hash.

    Labels are counted first, so that only rows with one of about SPARE times as many smallest hashes
    as are needed are read whole and ranked, however many rows a language has."""
    labelled = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                .filter(F.col("lang").isNotNull()))
    sizes = cut_lineage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    quota = max(1, most // max(1, sizes.count()))
    part = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 40)) / float(1 << 40)
    near = (join_keys(labelled.withColumn("__lang", F.col("lang")), sizes.withColumnRenamed("lang", "__lang"), ["__lang"], "inner")
            .withColumn("__part", part).filter((F.col("__part") * F.col("n") < SPARE * quota) & F.col("text").rlike(r"\p{L}")))
    order = W.partitionBy("lang").orderBy("__part", "id")
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= quota).select("lang", "nth", "text")


def train(docs: DataFrame, most: int = TRAIN_ROWS, **cols) -> Model:
    """Learns from all rows given; the features are made on the executors."""
    def run(texts):
        got = _features([t or b"" for t in texts])
        return pa.StructArray.from_arrays([pa.array([x.astype(np.int32) for x, _ in got], pa.list_(pa.int32())),
                                           pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], ["at", "value"])
    made = text_udf(run, "at array<int>, value array<float>")
    table = (training_rows(docs, most, **cols).select("lang", "nth", made("text").alias("f"))
             .select("lang", "nth", "f.at", "f.value").toArrow().sort_by([("lang", "ascending"), ("nth", "ascending")]).combine_chunks())
    list_of = lambda name: [x.values.to_numpy(zero_copy_only=False) for x in table[name]]
    return fit(list(zip(list_of("at"), list_of("value"))), table["lang"].to_pylist())


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from: a third, by the id alone."""
    return doc_bucket(id_col, 3) == 1


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            most: int = TRAIN_ROWS) -> DataFrame:
    """docs with __lang_pred and __lang_score, learned from the labelled documents that are not held out."""
    return _found(docs, id_col, text_col, lang_col, most).select(
        "row.*", F.col("lang.lang").alias("__lang_pred"), F.col("lang.score").alias("__lang_score"))


def _found(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(row, lang): whole rows, whatever their columns are called, with their struct(lang, score, known)."""
    model = train(docs.filter(~held_out(F.col(id_col))), most, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(whole_row(docs).alias("row"))
    return rows.select("row", identify(F.col("row").getField(text_col), model).alias("lang"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    most: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose text is of a learned language (a letter, and n-grams usual enough), unchanged."""
    return _found(docs, id_col, text_col, lang_col, most).filter("lang.known").select("row.*")
