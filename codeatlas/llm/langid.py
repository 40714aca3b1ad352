"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)            # subword lengths; a word's ends count as a character
BUCKETS = 1 << 16
DIMS = 16
TRAIN_ROWS = 6000             # bound of the labelled sample (rows)
SEGMENTS_PER_ROW = 2          # training passages drawn from anywhere in each sampled text
SEGMENT_CHARS = (15, 500)     # their lengths, log-uniform
EPOCHS = 5
BATCH = 64
RATE = 0.25
CALIBRATION_SHARE = 0.2       # of the sampled rows; never trained on
TARGET_ACCURACY = 0.99        # of accepted passages, on the calibration rows
MAX_REJECTED = 0.002          # a threshold never rejects more of the calibration rows (of any language) than this
SMOOTH = 0.05                 # added to a bucket's count in each language
LONG = 300                    # subwords of a passage by which foreign and learned ones are told apart
FOREIGN_SHARE = 0.9           # of the long foreign passages of a kind that lie below ``foreign``
PIECE = 1 << 18               # characters worked on at once
UNDETERMINED = "und"

_LETTER = np.empty(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x20000)), bool, 0x20000)
    return _LETTER


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, 0 where there is no letter, between two zeros."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    ok = table[np.minimum(cp, len(table) - 1)] | (cp >= len(table))
    out = np.zeros(len(cp) + 1, np.uint32)
    out[:-1] = np.where(ok, cp, 0)
    return out


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Per order: the bucket of the subword at each position, ``BUCKETS`` where there is none.  A
    subword lies in one word; its first and last character may be the word's border."""
    letter = codes != 0
    out = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            out.append(np.empty(0, np.uint32))
            continue
        h = np.full(m, n, np.uint32)
        ok = letter[1:1 + m].copy() if n > 2 else letter[:m] | letter[1:1 + m]
        for k in range(n):
            h = (h ^ codes[k:k + m]) * np.uint32(0x01000193)
            if 1 < k < n - 1:
                ok &= letter[k:k + m]
        h ^= h >> np.uint32(15)
        out.append(np.where(ok, h & np.uint32(BUCKETS - 1), np.uint32(BUCKETS)))
    return out


def _pieces(texts):
    """(index, piece) over whole texts; long ones are cut where no letter stands."""
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + PIECE)
            for e in range(end, min(len(t), end + 1000)):
                if not t[e].isalpha():
                    end = e
                    break
            yield i, t[at:end]
            at = end


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray        # (languages, BUCKETS + 1): embeddings already multiplied with the softmax layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None   # (BUCKETS + 1): log of a bucket's mean share in the languages' training passages
    usual: float = 0.0                # mean of ``known`` over the clean calibration passages
    spread: float = 0.0               # how far a clean mean over n subwords falls below that, times sqrt(n)
    foreign: float = -np.inf          # and a text is foreign only if its mean lies below this

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean over all subwords of each whole text; texts without a letter get the bias."""
        return self.means(texts, self.scores)[0] + self.bias

    def means(self, texts: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of each table over all subwords of each whole text, and the number of subwords."""
        k = len(tables)
        sums, n = np.zeros((len(texts), k)), np.zeros(len(texts))
        group: list[tuple[int, str]] = []
        size = 0

        def flush():
            # A zero stands between texts, so no subword reaches from one into the next.
            codes = [_codes(t) for _, t in group]
            starts = np.cumsum([1, *map(len, codes)])[:-1]
            who = np.array([i for i, _ in group])
            for b in _buckets(np.concatenate([np.zeros(1, np.uint32), *codes])):
                if not len(b):
                    continue
                at = np.minimum(np.maximum(starts - 1, 0), len(b) - 1)
                np.add.at(n, who, np.add.reduceat((b != BUCKETS).astype(np.int64), at))
                for c in range(k):
                    np.add.at(sums[:, c], who, np.add.reduceat(tables[c][b], at, dtype=np.float64))

        for i, t in _pieces(texts):
            group.append((i, t))
            size += len(t) + 1
            if size >= PIECE:
                flush()
                group, size = [], 0
        if group:
            flush()
        return sums / np.maximum(n, 1)[:, None], n

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) * self.temperature)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether each text is rejected: a top score below the threshold, or subwords that
        no learned language uses much.  Few subwords must lie further off."""
        if self.known is None:
            p = self.probabilities(texts)
            return p, p.max(1) < self.threshold
        m, n = self.means(texts, np.vstack([self.scores, self.known]))
        p = _softmax((m[:, :-1] + self.bias) * self.temperature)
        return p, (p.max(1) < self.threshold) | self.strange(m[:, -1], n)

    def strange(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (n > 0) & (mean < np.minimum(self.foreign, self.usual - self.spread / np.sqrt(np.maximum(n, 1))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(text: str) -> np.ndarray:
    return _of(_codes(text))


def _of(codes: np.ndarray) -> np.ndarray:
    b = np.concatenate(_buckets(np.concatenate([np.zeros(1, np.uint32), codes])))
    return b[b != BUCKETS].astype(np.int64)


def _known(counts: np.ndarray) -> np.ndarray:
    """(languages, BUCKETS) counts -> log of the mean share of each bucket, every language weighing the same."""
    share = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    return np.r_[np.log(share.mean(0)), 0.0].astype(np.float32)


def _tell_foreign(model: Model, texts: list[str], feats: list[np.ndarray], y: np.ndarray, fit: list[int], held: list[int], rng) -> None:
    """Sets what ``Model.strange`` needs, from clean calibration passages and foreign ones: those of each
    language against tables without it, and calibration passages with shuffled and with random letters."""
    counts = np.stack([np.bincount(np.concatenate([np.empty(0, np.int64), *(feats[i] for i in fit if y[i] == c)]), minlength=BUCKETS)
                       for c in range(len(model.langs))]).astype(np.float64)
    taught = counts.sum(1) > 0
    held = [i for i in held if taught[y[i]]]
    if not held:
        return
    known = _known(counts[taught])
    n = np.array([len(feats[i]) for i in held])
    lang = y[held]
    clean = np.array([known[feats[i]].mean(dtype=np.float64) for i in held])
    usual = float(clean.mean())
    off = (usual - clean) * np.sqrt(n)
    long = n >= LONG if (n >= LONG).any() else n > 0
    groups = [lang == c for c in np.unique(lang)]
    spread = max(float(np.quantile(off[g], 1 - MAX_REJECTED, method="higher")) for g in groups)
    low = min(float(np.quantile(clean[g & long], MAX_REJECTED, method="lower")) for g in groups if (g & long).any())
    kinds = []
    for c in np.unique(lang):
        rest = taught.copy()
        rest[c] = False
        if rest.any():
            without = _known(counts[rest])
            kinds.append([without[feats[i]].mean(dtype=np.float64) for i, x, o in zip(held, lang, long, strict=True) if o and x == c])
    codes = [_codes(texts[i]) for i, o in zip(held, long, strict=True) if o]
    alphabet = np.unique(np.concatenate(codes))
    alphabet = alphabet[alphabet != 0]
    mixed, random = [], []
    for x in codes:
        at = np.flatnonzero(x)
        for out, letters in ((mixed, rng.permutation(x[at])), (random, rng.choice(alphabet, len(at)))):
            z = x.copy()
            z[at] = letters
            out.append(known[_of(z)].mean(dtype=np.float64))
    kinds += [mixed, random]
    high = max(float(np.quantile(x, FOREIGN_SHARE)) for x in kinds if len(x))
    model.known, model.usual, model.spread = known, usual, max(spread, 0.0)
    model.foreign = min(low, (low + high) / 2)


def train(texts: list[str], labels: list[str], calibration: np.ndarray, seed: int = 7) -> Model | None:
    """Fit on rows where ``calibration`` is false; temperature and rejection threshold on the rest.
    None when there is nothing to learn from."""
    langs = sorted(set(labels))
    if not langs:
        return None
    feats = [_features(t) for t in texts]
    y = np.array([langs.index(x) for x in labels])
    fit = [i for i in range(len(texts)) if not calibration[i] and len(feats[i])]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS))
    out, bias = np.zeros((DIMS, len(langs))), np.zeros(len(langs))
    steps, done = max(1, EPOCHS * -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            idx = np.concatenate([feats[i] for i in rows])
            lens = np.array([len(feats[i]) for i in rows])
            starts = np.cumsum(lens) - lens
            mean = np.add.reduceat(emb[idx], starts, axis=0) / lens[:, None]
            g = _softmax(mean @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = (g @ out.T) / lens[:, None]
            out -= rate * mean.T @ g
            bias -= rate * g.sum(0) / len(rows)
            # Sum per bucket first: a bucket that many passages share is stepped once.
            by = np.argsort(idx, kind="stable")
            s = idx[by]
            head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            emb[s[head]] -= rate * np.add.reduceat(np.repeat(back, lens, axis=0)[by], head, axis=0)
            done += 1
    scores = np.zeros((len(langs), BUCKETS + 1), np.float32)
    scores[:, :BUCKETS] = (emb @ out).T
    model = Model(langs, scores, bias)
    held = [i for i in range(len(texts)) if calibration[i] and len(feats[i])]
    if held and len(langs) > 1:
        z, t = model.logits([texts[i] for i in held]), y[held]
        grid = np.geomspace(0.25, 8, 41)
        nll = [-np.log(np.maximum(_softmax(z * s)[np.arange(len(t)), t], 1e-12)).mean() for s in grid]
        model.temperature = float(grid[int(np.argmin(nll))])
        p = _softmax(z * model.temperature)
        top, right = p.max(1), p.argmax(1) == t
        # Lowest threshold at which the accepted passages are right often enough, and never one
        # that rejects more than MAX_REJECTED of them.
        by = np.argsort(-top, kind="stable")
        acc = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
        good = np.flatnonzero(acc >= TARGET_ACCURACY)
        accepted = max(good[-1] + 1 if len(good) else 0, int(np.ceil((1 - MAX_REJECTED) * len(by))))
        model.threshold = float(top[by[min(accepted, len(by)) - 1]]) if accepted < len(by) else 0.0
    if held:
        _tell_foreign(model, texts, feats, y, fit, held, rng)
    return model


def _segments(batches):
    for pdf in batches:
        out = []
        for i, t, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"], strict=True):
            rng = np.random.default_rng(abs(int(i)))
            for k in range(SEGMENTS_PER_ROW):
                n = int(np.exp(rng.uniform(*np.log(SEGMENT_CHARS))))
                at = int(rng.integers(0, max(1, len(t) - n + 1)))
                out.append((i, k, t[at:at + n], lang))
        yield pd.DataFrame(out, columns=["doc_id", "k", "text", "lang"])


def held_out(doc_id) -> F.Column:
    """crc32 of the id's text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows to learn from per language: all of a language that has few, the rest of ``total`` shared evenly, so a
    language is learned however small its share of the corpus is.  Of more languages than rows the largest
    count."""
    out, left = {}, total
    by_size = sorted(counts.items(), key=lambda x: (x[1], x[0]))[-total:]
    for k, (lang, n) in enumerate(by_size):
        out[lang] = min(n, left // (len(by_size) - k))
        left -= out[lang]
    return out


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """Model from at most ``train_rows`` labelled rows of ``docs`` that are not held out, in each language those with
    the smallest hash of doc_id (``quotas``); a fifth of them only calibrates.  The driver gets one count per language and at most
    ``train_rows * SEGMENTS_PER_ROW`` passages of ``SEGMENT_CHARS[1]`` characters."""
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # Hashes are spread evenly: below a share of their range lie a few more rows than the quota, the least of which count.
    own = quotas(counts, train_rows)
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, float(min(1.0, (1.2 * q + 50) / counts[k])), q) for k, q in own.items()], "l string, share double, quota int")
    key = F.xxhash64("doc_id")
    near = rows.join(F.broadcast(share), F.col("lang") == F.col("l")).where(
        (F.col("share") >= 1) | (F.shiftrightunsigned(key, 11) < F.col("share") * float(1 << 53)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id", "text"))
    taken = near.select("doc_id", "text", "lang", "quota").withColumn("rank", rank).where(F.col("rank") <= F.col("quota"))
    sample = (taken.select("doc_id", "text", "lang").mapInPandas(
        _segments, "doc_id long, k int, text string, lang string")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "k", "text", "lang").limit(train_rows * SEGMENTS_PER_ROW).toPandas())
    calibration = np.random.default_rng(3).random(len(sample)) < CALIBRATION_SHARE
    same = sample["doc_id"].ne(sample["doc_id"].shift()).cumsum().to_numpy() - 1   # passages of a text stay together
    return train(sample["text"].tolist(), sample["lang"].tolist(), calibration[same] if len(same) else calibration)


def predict_udf(model: Model | None):
    """Column function text -> struct(lang_pred, score, rejected)."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred = np.full(len(texts), UNDETERMINED, object)
        score = np.zeros(len(texts))
        ok = np.fromiter((has_letter(t) for t in texts), bool, len(texts))
        rejected = ~ok
        if model is not None and ok.any():
            p, no = model.judge([t for t, o in zip(texts, ok, strict=True) if o])
            pred[ok] = np.array(model.langs, object)[p.argmax(1)]
            score[ok] = p.max(1)
            rejected[ok] = no
        return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": rejected})

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Only ``text`` enters a prediction; the model (fitted on ``docs`` when none is given) learned from
    rows that are not held out.  Null texts and texts without a letter: ``und``, score 0, rejected.
    ``rejected`` otherwise marks scores under the calibrated threshold and texts whose subwords are not
    those of the learned languages (foreign languages, encoded data, random letters).  Null ids are predicted but
    never learned from; repeated rows get equal rows; with no labelled row all is ``und``.
    """
    model = model or fit(docs)
    p = predict_udf(model)("text")
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language the model rejects, all columns unchanged."""
    return docs.where(~predict_udf(fit(docs))("text")["rejected"])
