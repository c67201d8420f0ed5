"""Language identification by string kernels with Nystroem landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of character
1- to 3-grams that both hold, over the root of the product of how many each
holds. Landmarks stand for the training texts; one-versus-rest ridge
regression is solved in the landmarks' space. Landmarks are held sparse. As a
score is linear in the presence vector, they fold with the weights into one
matrix (grams by languages), with which whole batches of texts are multiplied,
where that matrix is small.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPECTRUM = (1, 2, 3)
#: Weights by gram are broadcast up to this size; beyond it those by landmark are, whose size most_pairs bounds.
MOST_BYTES = 64 << 20
_state: dict = {}


def grams(text: str) -> np.ndarray:
    """Sorted distinct keys of the 1- to 3-grams of a whole text.

    Upper case counts as lower case; a run of characters that are no letters
    counts as one blank, also at either end. No letter gives no grams.
    """
    if "letter" not in _state:
        _state["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_state["letter"][code], code, 32).astype(np.int64)
    code = np.concatenate(([32], code, [32]))
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    if len(code) < 3:
        return np.empty(0, dtype=np.int64)
    two = code[:-1] << 21 | code[1:]
    return np.unique(np.concatenate((code, two, two[:-1] << 21 | code[2:])))


class Landmarks:
    """Presence vectors of landmark texts by gram, sparse: for each gram the landmarks that hold it."""

    def __init__(self, bags: list[np.ndarray]):
        size = np.array([len(b) for b in bags], dtype=np.int64)
        flat = np.concatenate(bags) if bags else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.vocabulary, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat)).astype(np.int64)
        self.held = np.repeat(np.arange(len(bags), dtype=np.int32), size)[order]
        self.scale = 1 / np.sqrt(np.maximum(size, 1))

    def __len__(self) -> int:
        return len(self.scale)

    def kernel(self, grams: np.ndarray) -> np.ndarray:
        """Kernel of one text with every landmark."""
        at = np.searchsorted(self.vocabulary, grams)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grams] if len(self.vocabulary) else at[:0]
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.held[place], minlength=len(self)) * self.scale / np.sqrt(max(len(grams), 1))

    def kernels(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.array([self.kernel(g) for g in bags]).reshape(len(bags), len(self))

    def folded(self, weights: np.ndarray) -> np.ndarray:
        """Presence vectors times weights [landmark, language], by gram."""
        out = np.zeros((len(self.vocabulary), weights.shape[1]), dtype=np.float32)
        scaled = weights * self.scale[:, None]
        for lo in range(0, len(self.vocabulary), 65_536):
            ends = self.bounds[lo : lo + 65_537]
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            held = self.held[ends[0] : ends[-1]]
            for c in range(weights.shape[1]):
                out[lo : lo + len(ends) - 1, c] = np.bincount(owner, weights=scaled[held, c], minlength=len(ends) - 1)
        return out


class Scorer:
    """Scores of languages: weights by gram where these are small, else weights by landmark."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: np.ndarray, langs: list[str], most_bytes: int = MOST_BYTES):
        self.bias, self.langs = bias, langs
        self.vocabulary = self.landmarks = None
        if len(landmarks.vocabulary) * weights.shape[1] * 4 <= most_bytes:
            self.vocabulary, self.weights = landmarks.vocabulary, landmarks.folded(weights)
        else:
            self.landmarks, self.weights = landmarks, weights

    def project(self, bags: list[np.ndarray]) -> np.ndarray:
        """Product of the presence vectors, scaled to length 1, with the weights."""
        if self.landmarks is not None:
            return self.landmarks.kernels(bags) @ self.weights
        out = np.zeros((len(bags), self.weights.shape[1]))
        for i, g in enumerate(bags):
            at = np.searchsorted(self.vocabulary, g)
            at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == g] if len(self.vocabulary) else at[:0]
            if len(at):
                out[i] = np.ones(len(at), dtype=np.float32) @ self.weights[at].astype(float) / np.sqrt(len(g))
        return out

    def predict(self, bags: list[np.ndarray], sharpness: float = 6.0) -> tuple[list[str], np.ndarray]:
        """Language and score of each bag: the largest of the softmax over languages."""
        s = sharpness * (self.project(bags) + self.bias)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if len(g) else "und" for b, g in zip(best, bags)], np.where([len(g) > 0 for g in bags], p.max(axis=1), 0.0)


def _sample(labelled: DataFrame, counts: dict[str, int], per_lang: int, salt: str) -> DataFrame:
    """About per_lang rows of each language, or all it has, the same at every partitioning."""
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_lang / n))))[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit(salt), "id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < share)


def fit(
    labelled: DataFrame, landmarks: int = 48, rows: int = 600, ridge: float = 0.1, most_landmarks: int = 4096, most_rows: int = 153_600, most_pairs: int = 16_000_000, most_cells: int = 32_000_000,
    text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
) -> Scorer | None:
    """Fit on a sample of about rows texts of each language, with about landmarks of them each as landmarks.

    Every language of the table is learned. most_landmarks and most_rows bound
    the samples of all languages together, most_pairs the grams that landmarks
    hold (of more each language keeps its first ones by size), most_cells the
    rows times landmarks that reach the driver. Where many languages share
    these, each gets its part, but 4 landmarks and 12 rows at least. Rows with null
    text or language are left out; None if nothing is left.
    """
    spark = labelled.sparkSession
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    src = src.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return None
    landmarks = max(4, min(landmarks, most_landmarks // len(langs)))

    def to_grams(rows):
        return {"lang": rows["lang"], "grams": [grams(t) for t in rows["text"]]}

    # a language of few rows gives all it has, so that none is left without a landmark
    marks = common.map_text_chunks(_sample(src, counts, max(landmarks, 24), "landmark").select("text", "lang"), to_grams, "lang string, grams array<long>", "text").toArrow()
    flat, ends = marks.column("grams").combine_chunks(), marks.column("lang").to_pylist()
    bags = [(lang, np.asarray(g.values)) for lang, g in zip(ends, flat) if len(g.values)]
    bags.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    share, held, kept = most_pairs // len(langs), dict.fromkeys(langs, 0), []
    for lang, bag in bags:
        if not held[lang] or held[lang] + len(bag) <= share:
            held[lang] += len(bag)
            kept.append(bag)
    if not kept:
        return None
    marks = Landmarks(kept)
    rows = max(12, min(rows, most_rows // len(langs), most_cells // (len(kept) * len(langs))))
    kernel = marks.kernels(kept)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    use = value > 1e-8 * value.max()
    root = vector[:, use] / np.sqrt(value[use])
    shared = spark.sparkContext.broadcast(marks)

    def to_features(rows):
        return {"lang": rows["lang"], "k": list(shared.value.kernels([grams(t) for t in rows["text"]]).astype("float32"))}

    train = common.map_text_chunks(_sample(src, counts, rows, "train").select("text", "lang"), to_features, "lang string, k array<float>", "text").toArrow()
    spoken = train.column("lang").to_pylist()
    k = train.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(spoken), len(kept))
    order = sorted(range(len(spoken)), key=lambda i: (spoken[i], k[i].tobytes()))
    phi = np.hstack([k[order].astype(float) @ root, np.ones((len(order), 1))])
    seen = np.array([langs.index(spoken[i]) for i in order], dtype=int)
    weight = 1 / np.maximum(np.bincount(seen, minlength=len(langs)), 1)[seen]
    target = np.where(seen[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    gram = phi.T @ (phi * weight[:, None]) + ridge / max(len(order), 1) * np.eye(phi.shape[1])
    alpha = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return Scorer(marks, root @ alpha[:-1], alpha[-1], langs)


def _predictor(df: DataFrame, scorer: Scorer | None):
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def find(texts):
        if shared.value is None:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))}
        lang, score = shared.value.predict([grams(t or "") for t in texts])
        return {"lang_pred": lang, "score": score}

    return find


def rows_with_language(df: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """Every row of df as struct row with lang_pred and score, as predict has them; no shuffle."""
    return common.beside(df, _predictor(df, scorer), "lang_pred string, score double", text_col)


def predict(df: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row over its whole text; no shuffle.

    lang_pred is a language learned, or und with score 0 where the text is null
    or has no letter, or nothing was learned.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    find = _predictor(df, scorer)

    def run(rows):
        return {"id": rows["id"]} | find(rows["text"])

    return common.map_text_chunks(src, run, f"id {kind}, lang_pred string, score double", "text").withColumnRenamed("id", id_col)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on rows whose crc32 of the id modulo 5 is not 0, then predict all: (id, held_out, lang_pred, score)."""
    held = common.id_bucket(id_col, 5) == 0
    scorer = fit(df.where(~held), text_col=text_col, lang_col=lang_col, id_col=id_col)
    return predict(df, scorer, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score")
