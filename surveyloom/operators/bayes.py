"""Text models by counting: multinomial naive Bayes for several models at once, as joins and sums.

A model is a table with a row per token and a column per (model, label). Its most frequent
tokens are held by every executor, so they are met where the texts lie and leave one row of
sums per text; only rare tokens are shuffled to a join. A text of any length is never held
in Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.session import cut_lineage

#: A token is a run of ASCII letters, digits and low lines, in lower case.
TOKEN = r"\w+"

#: Numbers of the frequent tokens that every executor holds, 32 MB.
HELD_VALUES = 4_000_000


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``*keys, token``: a row for each token of each text."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)).alias("token"))


@dataclass
class CountModel:
    """Gains of tokens, and per (model, label) its prior and what an unknown token adds.

    ``levels`` counts the tokens of each ``level``, steps of the logarithm of how often a token was read.
    """

    gains: DataFrame
    labels: list[tuple[str, str]]
    prior: list[float]
    floor: list[float]
    levels: dict[int, int]

    @property
    def models(self) -> list[str]:
        return list(dict.fromkeys(m for m, _ in self.labels))


def fit(train: DataFrame, text: str, vocabulary: dict[str, tuple[str, ...]]) -> CountModel:
    """Counts of the tokens of each label, add-one smoothed over the tokens a model has seen.

    ``train`` has the text and one column per model with its label; a null label, or one
    that the vocabulary lacks, leaves the row out of that model. Models without any
    row are left out, and so are labels without any.
    """
    labels = [(m, lb) for m, all_of in vocabulary.items() for lb in all_of]
    models = list(vocabulary)
    of = lambda m, lb: F.col(m) == lb
    docs = train.agg(*[F.count(F.when(of(m, lb), 1)).alias(f"d{i}") for i, (m, lb) in enumerate(labels)]).first()
    labels = [(lb, docs[f"d{i}"]) for i, lb in enumerate(labels) if docs[f"d{i}"]]
    counted = cut_lineage(tokens(train, models, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(of(m, lb), 1)).alias(f"c{i}") for i, ((m, lb), _) in enumerate(labels)]))
    own = {m: [i for i, ((x, _), _) in enumerate(labels) if x == m] for m in models}
    known = {m: sum((F.col(f"c{i}") for i in at), F.lit(0)) > 0 for m, at in own.items() if at}
    totals = counted.agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(labels))], *[F.count(F.when(k, 1)).alias(f"v{j}") for j, k in enumerate(known.values())]).first()
    kinds = dict(zip(known, (totals[f"v{j}"] for j in range(len(known)))))
    gains = cut_lineage(counted.select(
        "token", F.floor(4 * F.log2("n")).cast("int").alias("level"), *[F.log(F.col(f"c{i}") + 1.0).alias(f"g{i}") for i in range(len(labels))], *[k.alias(f"k{j}") for j, k in enumerate(known.values())]))
    prior = [math.log(n / sum(labels[i][1] for i in own[m])) for (m, _), n in labels]
    floor = [-math.log(max(totals[f"c{i}"] + kinds[m], 1)) for i, ((m, _), _) in enumerate(labels)]
    levels = {r["level"]: r["count"] for r in gains.groupBy("level").count().collect()}
    return CountModel(gains, [lb for lb, _ in labels], prior, floor, levels)


def _sums_of_tokens(texts: DataFrame, model: CountModel, held_values: int) -> DataFrame:
    """``text_key``, gains per label ``s0..`` and known tokens per model ``n0..`` of each text.

    The most frequent levels of tokens whose numbers come to at most ``held_values`` are
    held; the others are joined.
    """
    n_labels, n_models = len(model.labels), len(model.models)
    sums = [*[F.coalesce(F.sum(f"g{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(n_labels)], *[F.count(F.when(F.col(f"k{j}"), 1)).alias(f"n{j}") for j in range(n_models)]]
    room, lowest = held_values // (n_labels + n_models), max(model.levels, default=0) + 1
    for level in sorted(model.levels, reverse=True):
        room -= model.levels[level]
        if room < 0:
            break
        lowest = level
    held, rare = model.gains.filter(F.col("level") >= lowest).drop("level"), model.gains.filter(F.col("level") < lowest).drop("level")
    # A text without a token keeps a row.
    words = texts.select("text_key", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0)).alias("token"))
    near = words.join(F.broadcast(held), "token", "left").groupBy("text_key").agg(*sums)
    if lowest <= min(model.levels, default=0):
        return near
    far = words.filter(F.col("token").isNotNull()).join(F.broadcast(held.select("token")), "token", "left_anti").join(rare, "token").groupBy("text_key").agg(*sums)
    names = [*[f"s{i}" for i in range(n_labels)], *[f"n{j}" for j in range(n_models)]]
    both = near.join(far.select(F.col("text_key"), *[F.col(c).alias("_" + c) for c in names]), "text_key", "left")
    return both.select("text_key", *[(F.col(c) + F.coalesce("_" + c, F.lit(0))).alias(c) for c in names])


def label_scores(texts: DataFrame, model: CountModel, held_values: int = HELD_VALUES) -> DataFrame:
    """``text_key, model, label, score, scores`` of distinct texts: best label, its probability, all of them.

    ``texts``: ``text_key, text``. Tokens that a model has not seen are passed over; a text
    with no other has the share of each label. Ties go to the label named first.
    """
    if not model.labels:
        return texts.select("text_key", *[F.lit(None).cast(k).alias(n) for n, k in (("model", "string"), ("label", "string"), ("score", "double"), ("scores", "map<string,double>"))]).limit(0)
    models = model.models
    every = _sums_of_tokens(texts, model, held_values)

    def entry(j: int, name: str) -> Column:
        at = [i for i, (m, _) in enumerate(model.labels) if m == name]
        score = {i: F.col(f"s{i}") + F.lit(model.prior[i]) + F.lit(model.floor[i]) * F.col(f"n{j}") for i in at}
        most = F.greatest(*score.values()) if len(at) > 1 else score[at[0]]
        weight = {i: F.exp(s - most) for i, s in score.items()}
        whole = sum(weight.values(), F.lit(0.0))
        shares = F.array(*[F.struct((w / whole).alias("p"), F.lit(-k).alias("k"), F.lit(model.labels[i][1]).alias("label")) for k, (i, w) in enumerate(weight.items())])
        return F.struct(F.lit(name).alias("model"), shares.alias("shares"))

    rows = every.select("text_key", F.explode(F.array(*[entry(j, m) for j, m in enumerate(models)])).alias("e")).select("text_key", "e.model", "e.shares")
    best = F.array_max("shares")
    return rows.select(
        "text_key", "model", best["label"].alias("label"), best["p"].alias("score"),
        F.map_from_entries(F.transform("shares", lambda s: F.struct(s["label"], s["p"]))).alias("scores"))
