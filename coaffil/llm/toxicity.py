"""Toxicity by weak supervision.

Voters are lexicons and patterns: lexicons mined from labelled training rows (words, and beginnings
of words, that mark toxic texts), dealt out over several voters, a small fixed lexicon, and patterns
of layout.  A generative label model with one latent class estimates each voter's accuracies by
expectation maximisation over the counts of all vote combinations in the corpus, which is a table of
at most 2 ** voters rows; correlated voters share their evidence.  Its posterior labels train a
linear classifier on which terms of the lexicons a text has; the classifier scores every text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import land

#: Common insults.
SEED_LEXICON = ["idiot", "stupid", "moron", "scum", "trash", "worthless", "pathetic", "disgusting", "loser", "clown"]
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{4,}\b")
PREFIXES = (4, 5, 6)
LEXICONS = 8  # mined voters
LEAST = 3  # texts in which a term must stand
VOTERS = LEXICONS + 3  # and the fixed lexicon, shouting, exclamation marks


def terms_of(text: str) -> set[str]:
    """Words in lower case, and their beginnings marked ``^``; those of all lengths in PREFIXES."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for k in PREFIXES:
        out.update(["^" + w[:k] for w in words if len(w) > k])
    return out


def term_counts(labelled: DataFrame, flush: int = 1 << 18) -> DataFrame:
    """(term, toxic, clean): in how many distinct labelled texts of each kind a term stands; rows (text, toxic 0/1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays(out, ["term", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic].update(terms_of(text.as_py() or ""))
                if len(seen[0]) + len(seen[1]) > flush:
                    yield flushed()
        if seen[0] or seen[1]:
            yield flushed()

    rows = labelled.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mine(counts: DataFrame, n_toxic: int, n_clean: int, most: int = 1 << 18, least: int = LEAST) -> dict[str, float]:
    """At most ``most`` terms whose smoothed precision among balanced classes is 0.95 or more, best first, with its log odds.

    A term must stand in ``least`` toxic texts; the commonest win.
    """
    if not n_toxic:
        return {}
    ratio = n_toxic / max(1, n_clean)
    precise = (F.col("toxic") + 0.1) / (F.col("toxic") + 0.2 + F.lit(ratio) * F.col("clean")) >= 0.95
    rows = counts.where((F.col("toxic") >= least) & precise & (F.col("clean") <= 0.02 * F.col("toxic") + 1))
    best = rows.orderBy(F.desc("toxic"), "clean", "term").limit(most).collect()
    return {r.term: math.log((r.toxic + 0.1) / (ratio * r.clean + 0.1)) for r in best}


def voted(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(all columns of docs but text) with ``votes`` (bits) and ``terms`` (numbers of the lexicon's terms in the text)."""
    number = {t: i for i, t in enumerate(lexicon)}
    seed = set(SEED_LEXICON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            votes, terms = [], []
            for cell in batch.column(at):
                text = cell.as_py() or ""
                words = terms_of(text)
                hits = sorted(number[w] for w in words if w in number)
                bits = 0
                for i in hits:
                    bits |= 1 << zlib.crc32(lexicon[i].encode()) % LEXICONS
                bits |= (not seed.isdisjoint(words)) << LEXICONS
                bits |= (len(SHOUT.findall(text)) >= 3) << LEXICONS + 1
                bits |= (text.count("!") >= 3) << LEXICONS + 2
                votes.append(bits)
                terms.append(hits)
            keep = [k for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(votes, pa.int32()), pa.array(terms, pa.list_(pa.int32()))],
                [*(batch.schema.names[k] for k in keep), "votes", "terms"],
            )

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("votes", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]))


class LabelModel:
    """One latent class; votes independent given it but for a weight that correlated voters share."""

    def __init__(self, patterns: dict[int, float], labelled: dict[tuple[int, int], float], rounds: int = 50):
        votes = sorted(set(patterns) | {v for v, _ in labelled})
        self.x = np.array([[v >> j & 1 for j in range(VOTERS)] for v in votes], float).reshape(len(votes), VOTERS)
        n = np.array([patterns.get(v, 0.0) for v in votes])
        known = np.array([[labelled.get((v, y), 0.0) for v in votes] for y in (0, 1)])
        free = np.maximum(0.0, n - known.sum(0))  # texts without a training label
        self.weight = np.ones(VOTERS)
        self.prior = (known[1].sum() + 1) / (known.sum() + 20)
        # Accuracies start from the labels, or from the belief that a vote is a sign of toxicity.
        start = [known[y].sum() for y in (0, 1)]
        self.rate = np.array([((known[y] @ self.x) + (0.02, 0.3)[y] * 5) / (start[y] + 5) for y in (0, 1)])
        for step in range(rounds):
            q = self.posterior(self.x)
            mass = [known[0] + free * (1 - q), known[1] + free * q]
            self.prior = min(0.5, (mass[1].sum() + 1) / (sum(m.sum() for m in mass) + 20))
            self.rate = np.array([((mass[y] @ self.x) + (0.02, 0.3)[y] * 5) / (mass[y].sum() + 5) for y in (0, 1)])
            if step == rounds // 2:
                self._share(mass)

    def _share(self, mass: list[np.ndarray]) -> None:
        """Voters that agree beyond what the class explains count less: 1 / (1 + their correlations)."""
        corr = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            d = self.x - self.rate[y]
            cov = (d * mass[y][:, None]).T @ d / max(1e-9, mass[y].sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += np.clip(cov / np.outer(sd, sd), 0, 1) / 2
        np.fill_diagonal(corr, 0)
        self.weight = 1 / (1 + corr.sum(1))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        p = np.clip(self.rate, 1e-6, 1 - 1e-6)
        on, off = np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0]))
        z = math.log(self.prior / (1 - self.prior)) + (x * on + (1 - x) * off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def of(self, votes: np.ndarray) -> np.ndarray:
        return self.posterior((votes[:, None] >> np.arange(VOTERS) & 1).astype(float))


def fit_linear(terms: list[list[int]], target: np.ndarray, n_terms: int, steps: int = 400, l2: float = 0.3) -> tuple[float, np.ndarray]:
    """Logistic regression of soft targets on sets of terms; bias and weights."""
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    cols = np.concatenate([np.asarray(t, np.int64) for t in terms]) if len(rows) else np.empty(0, np.int64)
    mean = float(np.clip(target.mean(), 1e-3, 0.5))
    bias, w = math.log(mean / (1 - mean)), np.zeros(n_terms)
    g_bias, g_w = 1e-8, np.full(n_terms, 1e-8)
    for _ in range(steps):  # Adagrad on the whole sample
        z = bias + np.bincount(rows, w[cols], len(terms))
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        d, d_bias = np.bincount(cols, r[rows], n_terms) + l2 * w, float(r.sum())
        g_w += d * d
        g_bias += d_bias * d_bias
        w -= 0.3 * d / np.sqrt(g_w)
        bias -= 0.3 * d_bias / math.sqrt(g_bias)
    return bias, w


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
    most_sample: int = 1 << 16, label_trust: float = 0.98,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and toxic (0/1, null: none; of several the largest).  Learning uses all
    labels of rows that are not held out; the classifier is fitted to posterior labels of at most
    about ``most_sample`` texts not held out, chosen by a hash of the id.  A mined term in too few of
    these has at least the weight that its counts over all labels give it.  A training label counts as
    one more voter, right in a share ``label_trust`` of all cases (a given belief, not estimated).  Null and empty
    texts get the score of a text without terms.  A null id is not held out.  Without any labels the
    fixed lexicon and the patterns decide.  Other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held)
    given = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held)
    given = land(given)
    train = docs.where(~F.col("held_out")).join(given, "doc_id").select("text", "toxic")
    sizes = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    mined = mine(term_counts(train), sizes.get(1, 0), sizes.get(0, 0))
    lexicon = [*mined, *(t for t in SEED_LEXICON if t not in mined)]

    rows = land(voted(docs, lexicon).join(given, "doc_id", "left"))
    patterns = {r.votes: float(r["count"]) for r in rows.groupBy("votes").count().collect()}
    marked = {(r.votes, r.toxic): float(r["count"]) for r in rows.where("toxic is not null and not held_out").groupBy("votes", "toxic").count().collect()}
    if not patterns:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = LabelModel(patterns, marked)

    sample = _sampled(rows.where("not held_out"), most_sample).select("votes", "terms", "toxic").toPandas()
    if len(sample):
        z = model.of(sample["votes"].to_numpy(np.int64))
        said = sample["toxic"].to_numpy(float)
        trust = label_trust / (1 - label_trust)
        odds = z / (1 - np.minimum(z, 1 - 1e-12)) * np.where(np.isnan(said), 1.0, np.where(said > 0, trust, 1 / trust))
        bias, weights = fit_linear(list(sample["terms"]), odds / (1 + odds), len(lexicon))
        seen = np.bincount(np.concatenate([np.empty(0, np.int64), *sample["terms"]]).astype(np.int64), minlength=len(lexicon))[: len(mined)]
        counted = np.fromiter(mined.values(), float, len(mined))
        weights[: len(mined)] = np.where(seen < LEAST, np.maximum(weights[: len(mined)], counted), weights[: len(mined)])
    else:
        bias, weights = -4.0, np.full(len(lexicon), 3.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(2)
            count = np.diff(terms.offsets.to_numpy())
            z = bias + np.bincount(np.repeat(np.arange(len(count)), count), weights[terms.flatten().to_numpy()], len(count))
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "terms").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id; all if there are no more."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(math.ceil(n / most))) == 0)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
