"""Toxicity: a linear-chain conditional random field over words.

Labelled words come from labelled documents: a word of a toxic document is
tagged when its form, or a start or end of it, is far commoner in toxic than in
clean documents. The field has two tags, weights for those features and for
their neighbours' presence, and tag transitions; the labelled rows are dealt by their ids to
parts, more of them the more text there is, each part fits it on its rows in a fixed order and each weight is averaged over the parts that have its feature,
round after round (iterative parameter mixing), so scores don't depend on how the input is split. Forward-backward marginals give each word's probability. A document's score
is a logistic function of its largest marginal, the sum of the others of weight and
its number of words; offending spans are the runs of words over a half.

Defined cases
* null, empty or word-less text: score 0, no spans.
* null labels are not learned from. If a document has several labels, the largest holds.
* null id: never held out; repeated rows each get a row.
* nothing to learn from, or only one class: every score is 0.
* very long texts are scored whole; chains end at sentence ends, and at most every MiB.
* other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitewise.llm.common import CHUNK_BYTES, NON_WORD, documents, hash_run, mix64, runs, stored
from sitewise.llm.language_id import fold

#: At most this many labelled documents of each class are learned from, chosen by the hash of their ids.
LABELLED = 20_000
#: A feature must be in so many toxic documents.
LEAST_DOCS = 3
#: Parts that the labelled rows are dealt to, at least, and text bytes of a part on average, at most; text bytes of a gradient step; steps of a part
#: in a round, at least: a small part goes over its rows again.
PARTS, PART_BYTES, STEP_BYTES, LEAST_STEPS = 8, 16 << 20, 1 << 16, 24
#: Log odds from which a word of a toxic document counts as labelled toxic, less so many standard errors.
TAGGED, CAUTION = 2.0, 1.5
ROUNDS = 3
#: Chains without features all count, with this weight: far the most text is clean, and would drown weak signs. On 144 toxic and 1,200 clean held-out
#: documents the full weight finds 0.903 with three false alarms, an eighth 0.910 with one.
PLAIN_WEIGHT = 0.125
#: Score from which a document is predicted toxic, and how many false alarms a missed document counts as where scores are fitted: labels
#: of documents without any sign of it, which there are, would otherwise pull weak signs below the line.
PREDICTED, MISS_COST = 0.7, 4.0
RATE, DECAY = 0.5, 1e-4

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
#: Kinds of features: the form, its first 4 and 5 bytes, its last 4.
_KINDS = 4


def _features(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(kinds, words) 64-bit feature hashes; 0 where a word is too short."""
    out = np.zeros((_KINDS, len(hashes)), np.uint64)
    out[0] = hashes
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k, (size, last) in enumerate(((4, False), (5, False), (4, True)), 1):
        long = lengths > size
        at = np.where(long, starts + lengths - size, 0) if last else starts
        h = np.full(len(hashes), k, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x100) + padded[at + i]
        out[k] = np.where(long, mix64(h), np.uint64(0))
    return out


def _words(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Of bounded runs: first row; for each word its text, chain, feature hashes, start and length; the run's bytes, its texts' bounds, and the characters of a long text before the run."""
    for row, rows, data, cuts in runs(column, most):
        at = chars = 0
        while at < len(data):
            end = len(data)
            if rows == 1 and end - at > CHUNK_BYTES:
                marks = np.flatnonzero(_ENDS[data[at : at + CHUNK_BYTES]])
                if not len(marks):
                    marks = np.flatnonzero(NON_WORD[data[at : at + CHUNK_BYTES]])
                end = at + (int(marks[-1]) + 1 if len(marks) else CHUNK_BYTES)
            part = data[at:end]
            bounds = cuts if rows > 1 else np.array([0, len(part)])
            hashes, counts, starts, lengths = hash_run(part, bounds, NON_WORD)
            if len(hashes):
                doc = np.repeat(np.arange(rows), counts)
                sentence = np.cumsum(_ENDS[part])[starts]
                chain = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(sentence) != 0)]))
                yield row, doc, chain, _features(part, hashes, starts, lengths), starts, lengths, part, bounds, chars
            at, chars = end, chars + int(((part & 0xC0) != 0x80).sum())


def _lookup(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each feature in the sorted ``known``, len(known) where it isn't."""
    if not len(known):
        return np.zeros(features.shape, np.int64)
    at = np.searchsorted(known, features)
    return np.where(known[np.minimum(at, len(known) - 1)] == features, at, len(known))


def _counting(known: np.ndarray | None):
    """(feature, toxic, documents with it); only features of toxic documents, or only the known ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            found: list[np.ndarray] = []
            for row, doc, _, features, *_ in _words(batch.column(0)):
                for kind in features:
                    keep = kind != 0
                    if known is not None:
                        keep &= _lookup(kind, known) < len(known)
                    pairs = np.stack([kind[keep], (row + doc[keep]).astype(np.uint64)])
                    order = np.lexsort(pairs)
                    pairs = pairs[:, order]
                    new = np.ones(pairs.shape[1], bool)
                    new[1:] = (np.diff(pairs, axis=1) != 0).any(axis=0)
                    found.append(pairs[:, new])
            if not found:
                continue
            f, d = np.concatenate(found, axis=1)
            for label in (0, 1):
                value, n = np.unique(f[toxic[d.astype(np.int64)] == label], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.full(len(value), label), pa.int32()), pa.array(n)], names=["feature", "toxic", "n"])

    return count


_COUNTS = "feature bigint, toxic int, n bigint"


class Field:
    """A two-tag linear-chain conditional random field; tag 0 is the reference."""

    def __init__(self, features: int) -> None:
        #: Weights of the features at a word, of any at the word before, of any after, bias; then transitions.
        self.w = np.zeros(features + 4)
        self.w[features + 3] = -4.0
        self.trans = np.zeros((2, 2))

    def unary(self, on: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Log potentials (words) of tag 1. on: (kinds, words) indices; near: (2, words) whether the neighbours have any."""
        n = len(self.w) - 4
        weights = np.append(self.w[:n], 0.0)
        return weights[on].sum(axis=0) + near[0] * self.w[n] + near[1] * self.w[n + 1] + self.w[n + 3]

    def marginals(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, t) probabilities of tag 1 and (n, 2, 2) expected transitions of padded chains; nan pads the ends."""
        n, t = unary.shape
        inside = ~np.isnan(unary)
        e = np.exp(np.clip(np.where(inside, unary, 0.0), -30, 30))
        m = np.exp(np.clip(self.trans, -20, 20))
        a = np.empty((t, 2, n))
        a[0, 0], a[0, 1] = 1.0, e[:, 0]
        a[0] /= a[0].sum(axis=0)
        for i in range(1, t):
            p, q = a[i - 1]
            a[i, 0], a[i, 1] = p * m[0, 0] + q * m[1, 0], (p * m[0, 1] + q * m[1, 1]) * e[:, i]
            a[i] /= a[i].sum(axis=0)
        prob = np.zeros((n, t))
        pairs = np.zeros((n, 2, 2))
        b0, b1 = np.ones(n), np.ones(n)
        for i in range(t - 1, -1, -1):
            on = inside[:, i]
            x, y = a[i, 0] * b0, a[i, 1] * b1
            prob[:, i] = np.where(on, y / (x + y), 0.0)
            if i:
                p, q = a[i - 1]
                u, v = b0, e[:, i] * b1
                joint = np.stack([p * m[0, 0] * u, p * m[0, 1] * v, q * m[1, 0] * u, q * m[1, 1] * v], axis=1).reshape(n, 2, 2)
                pairs += np.where(on[:, None, None], joint / joint.sum(axis=(1, 2), keepdims=True), 0.0)
                c0, c1 = m[0, 0] * u + m[0, 1] * v, m[1, 0] * u + m[1, 1] * v
                s = c0 + c1
                b0, b1 = np.where(on, c0 / s, 1.0), np.where(on, c1 / s, 1.0)
        return prob, pairs


def _neighbours(has: np.ndarray, chain: np.ndarray) -> np.ndarray:
    same = np.diff(chain) == 0
    near = np.zeros((2, len(has)))
    near[0, 1:] = has[:-1] & same
    near[1, :-1] = has[1:] & same
    return near


def _padded(chain: np.ndarray, values: np.ndarray, pad: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places (n, t) with -1 as padding, values) by chains of like length; a chain of any length is padded twofold at most."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(chain) != 0]))
    lengths = np.diff(np.append(starts, len(chain)))
    size = np.ceil(np.log2(lengths)).astype(int)
    for s in np.unique(size):
        own = size == s
        t = int(lengths[own].max())
        step = max(1, (1 << 18) // t)
        first, count = starts[own], lengths[own]
        for k in range(0, len(first), step):
            at = first[k : k + step, None] + np.arange(t)
            at = np.where(np.arange(t) < count[k : k + step, None], at, -1)
            yield at, np.where(at >= 0, values[at], pad)


def _active(features: np.ndarray, chain: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature indices, whether a word has any, which words are in a chain where one has)."""
    on = _lookup(features, known)
    has = (on < len(known)).any(axis=0)
    in_chain = np.zeros(int(chain[-1]) + 1, bool)
    in_chain[chain[has]] = True
    return on, has, in_chain[chain]


def _plain_gradient(field: Field, lengths: np.ndarray) -> tuple[float, np.ndarray]:
    """Gradients of the bias and the transitions over all chains without features, whose words are all clean: they differ by length only."""
    bias, trans = 0.0, np.zeros((2, 2))
    sizes, counts = np.unique(lengths, return_counts=True)
    words = np.full(int(sizes.sum()), field.w[-1])
    number = np.repeat(np.arange(len(sizes)), sizes)
    for at, u in _padded(number, words, np.nan):
        prob, pairs = field.marginals(u)
        times = counts[number[at[:, 0]]]
        bias -= float(times @ prob.sum(axis=1))
        trans -= (pairs * times[:, None, None]).sum(axis=0)
    trans[0, 0] += float(counts @ (sizes - 1))
    return bias, trans


def _steps(texts: pa.Array, toxic: np.ndarray, features: np.ndarray, log_odds: np.ndarray) -> Iterator[tuple]:
    """Of bounded runs: features, neighbours, tags and chains of the words in chains with features, lengths of the other chains, weight of the words."""
    for row, doc, chain, found, *_ in _words(texts, STEP_BYTES):
        on, has, used = _active(found, chain, features)
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(chain) != 0]))
        lengths = np.diff(np.append(firsts, len(chain)))
        near = _neighbours(has, chain)
        tag = ((log_odds[on].max(axis=0) >= TAGGED) & (toxic[row + doc] == 1)).astype(float)
        yield on[:, used].astype(np.int32), near[:, used].astype(bool), tag[used].astype(bool), chain[used].astype(np.int32), lengths[~used[firsts]], float(used.sum() + PLAIN_WEIGHT * (~used).sum())


def _repeated(steps: Iterator[tuple]) -> Iterator[tuple[bool, tuple]]:
    """(whether again, step): all steps, and those of a small part again and again up to LEAST_STEPS; only that few are kept."""
    kept = []
    for step in steps:
        if len(kept) < LEAST_STEPS:
            kept.append(step)
        yield False, step
    for k in range(len(kept), LEAST_STEPS if kept else 0):
        yield True, kept[k % len(kept)]


def _fitting(model, odds, known):
    """Adaptive-gradient steps over a part's rows; emits its weights with the number of words they come from."""
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
        features, log_odds = known.value, np.append(odds.value, -np.inf)
        field = Field(len(features))
        field.w, field.trans = model.value[0].copy(), model.value[1].copy()
        squares = [np.full(field.w.shape, 1e-3), np.full((2, 2), 1e-3)]
        n = len(features)
        toxic, words, times = rows.column("toxic").to_numpy(), 0.0, np.zeros(n)
        for again, (on, near, tag, chain, plain, size) in _repeated(_steps(rows.column("text").chunk(0), toxic, features, log_odds)):
            if not again:
                words += size
                times += np.bincount(on[on < n], minlength=n)
            grad, grad_t = np.zeros(n + 5), np.zeros((2, 2))
            if len(plain):
                grad[n + 3], grad_t = (PLAIN_WEIGHT * g for g in _plain_gradient(field, plain))
            unary, diff = field.unary(on, near), np.zeros(len(chain))
            for at, u in _padded(chain, unary, np.nan) if len(chain) else ():
                prob, pairs = field.marginals(u)
                inside = at >= 0
                gold = np.where(inside, tag[at], 0.0)
                diff[at[inside]] = (gold - prob)[inside]
                grad_t -= pairs.sum(axis=0)
                both = inside[:, 1:]
                x, y = gold[:, :-1][both].astype(int), gold[:, 1:][both].astype(int)
                np.add.at(grad_t, (x, y), 1.0)
            known_at = on < n
            grad += np.bincount(on[known_at], np.broadcast_to(diff, on.shape)[known_at], n + 5)
            grad[n : n + 4] += near[0] @ diff, near[1] @ diff, 0.0, diff.sum()
            for w, g, s in ((field.w, grad[: n + 4] / size * 100 - DECAY * field.w, squares[0]), (field.trans, grad_t / size * 100 - DECAY * field.trans, squares[1])):
                s += g * g
                w += RATE * g / np.sqrt(s)
        # A feature's weight comes from the parts that have it, by how often they do.
        times = np.concatenate([times, np.full(8, words)])
        at = np.flatnonzero(times)
        flat = np.concatenate([field.w, field.trans.ravel()])
        part = np.full(len(at), rows.column("part")[0].as_py())
        return pa.table({"part": part, "i": at, "w": flat[at] * times[at], "n": times[at]}) if words else _NO_WEIGHTS

    return fit


_NO_WEIGHTS = pa.table({"part": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "w": pa.array([], pa.float64()), "n": pa.array([], pa.float64())})


def fit(rows: DataFrame) -> tuple[np.ndarray, Field, np.ndarray] | None:
    """(sorted feature hashes, field, score weights) from rows of (text, toxic, weight, key, place); None if a class is missing."""
    context = rows.sparkSession.sparkContext
    counts = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    sizes = {r["toxic"]: r["n"] for r in counts}
    if not sizes.get(0) or not sizes.get(1):
        return None
    parts = max(PARTS, -(-sum(r["bytes"] for r in counts) // PART_BYTES))
    rows = rows.withColumn("part", F.pmod("place", F.lit(parts)).cast("bigint"))
    in_toxic = rows.where("toxic = 1").select("text", "toxic").mapInArrow(_counting(None), _COUNTS).where("toxic = 1").groupBy("feature").agg(F.sum("n").alias("n"))
    best = in_toxic.where(F.col("n") >= LEAST_DOCS).select("feature").toPandas()  # fewer than a third of what 2 x LABELLED documents hold
    known = np.sort(best["feature"].to_numpy(np.int64).view(np.uint64))
    counted = rows.select("text", "toxic").mapInArrow(_counting(known), _COUNTS).groupBy("feature", "toxic").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((2, len(known)))
    n[counted["toxic"].to_numpy(np.int64), _lookup(counted["feature"].to_numpy(np.int64).view(np.uint64), known)] = counted["n"].to_numpy()
    odds = np.log((n[1] + 0.5) / (sizes[1] + 1)) - np.log((n[0] + 0.5) / (sizes[0] + 1))
    odds -= CAUTION * np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
    keep = odds >= 0.5  # commoner in toxic documents at all
    known, odds = known[keep], odds[keep]
    field = Field(len(known))
    shared, log_odds = context.broadcast(known), context.broadcast(odds)
    for _ in range(ROUNDS):
        model = context.broadcast((field.w, field.trans))
        weighed = rows.groupBy("part").applyInArrow(_fitting(model, log_odds, shared), "part bigint, i bigint, w double, n double")
        listed = F.sort_array(F.collect_list(F.struct("part", "w", "n")))  # a row a part; added up in the order of parts
        total = weighed.groupBy("i").agg(listed.alias("x")).select("i", *(F.aggregate(F.col("x")[c], F.lit(0.0), lambda a, y: a + y).alias(c) for c in "wn"))
        mean = total.select("i", (F.col("w") / F.col("n")).alias("w")).toPandas()
        flat = np.concatenate([field.w, field.trans.ravel()])
        flat[mean["i"].to_numpy(np.int64)] = mean["w"].to_numpy()
        field.w, field.trans = flat[:-4], flat[-4:].reshape(2, 2)
    seen = rows.select("text", "toxic").mapInArrow(_weighing(context.broadcast((known, field))), "toxic int, a double, b double, c double, d double").toPandas()  # 2 x LABELLED rows at most
    seen = seen.sort_values(["toxic", *"abcd"], ignore_index=True)
    share = {r["toxic"]: r["weight"] for r in rows.groupBy("toxic").agg(F.avg("weight").alias("weight")).collect()}
    weight = seen["toxic"].map(share).to_numpy(float) * np.where(seen["toxic"] == 1, MISS_COST, 1.0)
    return known, field, _logistic(seen[list("abcd")].to_numpy(), seen["toxic"].to_numpy(float), weight)


def _judged(column: pa.Array, known: np.ndarray, field: Field, plain: dict[int, float]) -> tuple[np.ndarray, list[list]]:
    """(texts, 3) evidence, largest marginal, sum of the marginals over 0.1 and number of words; and the offending spans."""
    evidence = np.zeros((len(column), 3))
    spans: list[list] = [[] for _ in range(len(column))]

    def plainest(t: int) -> float:
        """The largest marginal in a chain of t words without features."""
        if t not in plain:
            plain[t] = float(field.marginals(field.unary(np.full((_KINDS, t), len(known)), np.zeros((2, t)))[None])[0].max())
        return plain[t]

    for row, doc, chain, found, starts, lengths, part, bounds, before in _words(column):
        on, has, used = _active(found, chain, known)
        evidence[row : row + int(doc[-1]) + 1, 2] += np.bincount(doc)
        firsts = np.flatnonzero(np.concatenate([[True], np.diff(chain) != 0]))
        idle = ~used[firsts]
        if idle.any():
            sizes, back = np.unique(np.diff(np.append(firsts, len(chain)))[idle], return_inverse=True)
            np.maximum.at(evidence[:, 0], row + doc[firsts[idle]], np.array([plainest(int(t)) for t in sizes])[back])
        if not used.any():
            continue
        prob = np.zeros(len(chain))
        unary = field.unary(on[:, used], _neighbours(has, chain)[:, used])
        own = np.zeros(int(used.sum()))
        for at, u in _padded(chain[used], unary, np.nan):
            own[at[at >= 0]] = field.marginals(u)[0][at >= 0]
        prob[used] = own
        np.maximum.at(evidence[:, 0], row + doc, prob)
        np.add.at(evidence[:, 1], row + doc, np.where(prob > 0.1, prob, 0.0))
        hot = np.flatnonzero(prob >= 0.5)
        if len(hot):
            chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            for r in np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (np.diff(chain[hot]) != 0)) + 1):
                i, j = r[0], r[-1]
                first = before - chars[bounds[doc[i]]]
                spans[row + int(doc[i])].append((int(first + chars[starts[i]]), int(first + chars[starts[j] + lengths[j]])))
    return evidence, spans


def _terms(evidence: np.ndarray) -> np.ndarray:
    top = np.clip(evidence[:, 0], 1e-3, 1 - 1e-3)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log1p(evidence[:, 1]), np.log1p(evidence[:, 2])], axis=1)


def _weighing(model):
    """(toxic, terms) of labelled rows, for the weights that turn evidence into a score."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, field = model.value
        plain: dict[int, float] = {}
        for batch in batches:
            terms = _terms(_judged(batch.column(0), known, field, plain)[0])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in terms.T)], names=["toxic", *"abcd"])

    return weigh


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-2 * beta)
    return beta


def _scoring(model, kind: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[int, float] = {}
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            if model.value:
                known, field, beta = model.value
                evidence, spans = _judged(batch.column(2), known, field, plain)
                scores = np.where(evidence[:, 2] > 0, 1 / (1 + np.exp(-np.clip(_terms(evidence) @ beta, -30, 30))), 0.0)
            columns = [batch.column(0).cast(kind), batch.column(1), pa.array(scores), pa.array((scores >= PREDICTED).astype(np.int32)), pa.array([[{"start": x, "end": y} for x, y in own] for own in spans], span)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "spans"])

    return score


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: int = LABELLED) -> DataFrame:
    """(text, toxic, weight, key, place) of a bounded sample of labelled documents, ``most`` of each class; weight: labelled ones that each stands for; place: by its id, for parts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    sizes = known.groupBy("_toxic").count().select("_toxic", F.greatest(F.col("count") / most, F.lit(1.0)).alias("_weight"))
    chosen = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(most) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).join(F.broadcast(sizes), "_toxic")  # at most 2 x most rows of an id and a label
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample), "_id").select(
        "text", F.col("_toxic").alias("toxic"), F.col("_weight").alias("weight"), F.xxhash64("_id").alias("key"), F.xxhash64("_id", F.lit(1)).alias("place")
    )


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None,
) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted, spans (offending character offsets, ends excluded)."""
    held = F.lit(False) if held_out is None else held_out
    rows = stored(labelled_rows(docs.where(~held), labels, id_col=id_col, text_col=text_col, label_col=label_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return texts.mapInArrow(
        _scoring(model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint>>"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=fold("doc_id", 3, 1))
