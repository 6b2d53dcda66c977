"""Soft-membership mixing: domain posteriors, then document rates whose expected domain tokens meet targets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_reads

#: Fixed value: what separates words.
SPACES = r"[\x20\x09-\x0D]+"
#: Labelled rows and words from which posteriors are learned, at most.
SAMPLE_ROWS, VOCABULARY = 20_000, 4_096
#: Known words of a text beyond which its evidence grows no more, so that memberships stay soft.
EVIDENCE = 12.0
#: Posteriors are rounded to this step; documents of equal posteriors get equal rates.
STEP = 1000
ROUNDS, TOLERANCE = 40, 1e-6
#: Characters after which a long text is cut at the end of the word, so that the words of one slice alone are held at once.
SLICE_CHARS = 1 << 16


def slices_of(text: str = "text") -> Column:
    """The text in slices, none of which ends within a word; one empty slice of a null or empty text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    cut = F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{SLICE_CHARS}}}+[^\x20\x09-\x0D]*+"), F.lit(0))
    return F.when(F.octet_length(whole) > SLICE_CHARS, cut).otherwise(F.array(whole))


def words_of(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), SPACES), lambda w: w != "")


def marked(text: str) -> Column:
    """The words of a slice (beside its place ``at``), and an end mark once for each text."""
    return F.concat(words_of(text), F.when(F.col("at") == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


class DomainModel:
    """Naive Bayes over frequent words: a table of at most VOCABULARY rows (word, one log chance for each domain) and log priors."""

    def __init__(self, labelled: DataFrame, domains: list[str], rows: int = SAMPLE_ROWS) -> None:
        """``labelled``: doc_id, text, domain; at most ``rows`` rows are drawn, by hash of doc_id. Rows of other domains are left out."""
        self.domains = domains
        known = labelled.filter(F.col("domain").isin(domains))
        count = known.count()
        # a share by hash rather than a sort, so that texts aren't moved to draw them
        share = min(1.0, rows / max(1, count))
        drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        sliced = drawn.select("domain", F.posexplode(slices_of()).alias("at", "slice"))
        counted = save(sliced.select("domain", F.explode(marked("slice")).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n")), "domain-words")
        totals = {r["domain"]: (r["words"], r["rows"]) for r in counted.groupBy("domain").agg(F.sum(F.when(F.col("word") != "", F.col("n"))).alias("words"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("rows")).collect()}
        at = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) for d in domains]
        chance = [F.log((a + 0.5) / ((totals.get(d, (0, 0))[0] or 0) + 0.5 * VOCABULARY)).alias(f"l{k}") for k, (a, d) in enumerate(zip(at, domains, strict=True))]
        table = counted.filter("word != ''").groupBy("word").agg(F.sum("n").alias("all"), *chance).orderBy(F.desc("all"), "word").limit(VOCABULARY).drop("all")
        # one more row for the mark that every text ends with, so that texts without known words stay
        mark = table.sparkSession.range(1).select(F.lit("").alias("word"), *[F.lit(0.0).alias(f"l{k}") for k in range(len(domains))])
        self.table = save(table.unionByName(mark), "domain-model")
        rows_all = sum((r or 0) for _, r in totals.values())
        self.priors = [math.log(((totals.get(d, (0, 0))[1] or 0) + 1) / (rows_all + len(domains))) for d in domains]

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens (its words), p (array of posteriors, rounded).

        Words meet the broadcast model table and are summed before the shuffle, which moves one
        row for each document and task. Rows that share doc_id and text are summed together and told apart again by their number of end marks.
        Long texts go slice by slice; each slice has a mark with its number of words, and the marks of first slices tell the number of rows.
        """
        k = range(len(self.domains))
        key = ["doc_id", "text_hash", "bytes"]
        # the text ends below the generator: what needs it above would put it beside each of its slices
        cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length(F.col("text").cast("string")).alias("bytes"), slices_of().alias("slices"))
        sliced = cut.select(*key, F.posexplode("slices").alias("at", "slice"))
        split = sliced.select(*key, "at", words_of("slice").alias("words"))
        told = split.select(*key, "at", F.size("words").cast("long").alias("n"), F.explode(F.array_append("words", F.lit(""))).alias("word"))
        met = told.join(F.broadcast(self.table), "word")
        mark = F.col("word") == ""
        same, n_tokens, known = F.sum((mark & (F.col("at") == 0)).cast("int")), F.sum(F.when(mark, F.col("n"))), F.sum((~mark).cast("int"))
        sums = met.groupBy(*key).agg(same.alias("same"), n_tokens.alias("n_tokens"), known.alias("known"), *[F.sum(f"l{i}").alias(f"l{i}") for i in k])
        sums = sums.withColumn("n_tokens", (F.col("n_tokens") / F.col("same")).cast("long"))
        known = F.col("known") / F.col("same")
        soft = F.when(known > EVIDENCE, EVIDENCE / known).otherwise(1.0) / F.col("same")
        z = F.array(*[F.col(f"l{i}") * soft + F.lit(self.priors[i]) for i in k])
        out = sums.select("doc_id", "n_tokens", "same", z.alias("z")).withColumn("top", F.array_max("z"))
        out = out.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("q", F.transform("e", lambda x: F.round(x / total * STEP)))
        whole = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("p", F.transform("q", lambda x: x / whole))
        return out.select("doc_id", "n_tokens", "p", F.explode(F.sequence(F.lit(1), F.col("same").cast("int")))).drop("col")


def rate(history: list[list[float]], least: float) -> Column:
    """The rate of a row from its posteriors ``p`` and the errors of all rounds: projected gradient steps from 1."""
    start = F.lit(max(1.0, least))
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in history])
    dot = lambda e: F.aggregate(F.zip_with("p", e, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, start, lambda r, e: F.greatest(F.lit(float(least)), r - dot(e)))


def fit_rates(scored: DataFrame, targets: list[float], tokens: float | None = None, least: float = 0.0) -> list[list[float]]:
    """The errors of each round, from which ``rate`` follows.

    Minimises e' M^-1 e, where e is expected tokens - target by domain and M the tokens' second moments of
    posteriors, over rates >= ``least``, by projected gradient steps in the metric of tokens: a
    document's step is its posteriors times M^-1 e, so one small row for each round comes to the
    driver and no rate is stored. With these weights the first step alone solves what the bound doesn't touch. The total is ``tokens``; if None, as many as there are, and with ``least`` > 0 as many as leave no
    domain's target below ``least`` times its tokens. Rounds run on a table of distinct posteriors.
    """
    k = range(len(targets))
    cells = save(scored.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")), "mix-cells")

    def expected(history: list[list[float]]) -> list[float]:
        row = cells.withColumn("r", rate(history, least)).agg(*[F.sum(F.col("r") * F.col("n") * F.col("p")[i]).alias(f"t{i}") for i in k]).first()
        return [row[f"t{i}"] or 0.0 for i in k]

    sums = cells.agg(*[F.sum(F.col("n") * F.col("p")[i]) for i in k], *[F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]) for i in k for j in k]).first()
    sums = [x or 0.0 for x in sums]
    there, moments = sums[: len(targets)], np.array(sums[len(targets) :]).reshape(len(targets), -1)
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    if not sum(there):
        return []
    share = [t / sum(targets) for t in targets]
    total = tokens or (max(least * a / s for a, s in zip(there, share, strict=True) if s) if least else sum(there))
    history: list[list[float]] = []
    for _ in range(ROUNDS):
        error = np.array(expected(history)) - total * np.array(share)
        step = inverse @ error
        history.append(step.tolist())
        # met, or as near as the bound allows: steps no longer change
        if np.abs(error).max() < TOLERANCE * total or len(history) > 1 and np.abs(step - last).max() < TOLERANCE:
            break
        last = step
    return history


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None, least: float = 0.0) -> DataFrame:
    """A rate for each row of ``docs`` (doc_id, text), so that expected tokens by domain meet ``targets``.

    ``labelled`` (doc_id, text, domain) teaches the classifier; ``targets`` gives each domain's weight.
    Returns doc_id, n_tokens, p (posteriors, in order of the sorted domain names), rate, and copies:
    the whole part of rate, and one more with the chance of its fraction, drawn by a hash of doc_id.

    Null and empty texts have no tokens and the prior as posterior. A domain that no labelled row
    has keeps a small prior; a domain without tokens can't be reached and the others still are. Equal ids are separate rows. An
    empty table gives an empty result. Other columns are ignored.
    """
    domains = sorted(targets)
    with small_reads(docs.sparkSession):
        scored = save(DomainModel(labelled, domains).posteriors(docs), "mix-scored")
    history = fit_rates(scored, [targets[d] for d in domains], tokens, least)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    out = scored.withColumn("rate", rate(history, least))
    return out.withColumn("copies", (F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
