"""Visual question answering as tables: indexes, filters, answer vocabularies, accuracies, caption scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.functions import text as T
from plotloom.functions.numbers import cosine


def duplicate_letters(options: Column) -> Column:
    """array<struct<text, letters>>: each distinct option text (trimmed, lower case), with its letters, in order of first sight."""
    keys = F.transform(options, lambda o: F.lower(F.trim(o)))
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.char(i + 65).alias("l")))
    return F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("text"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["l"]).alias("letters")))


def image_index(annotations: DataFrame) -> DataFrame:
    """(image_id, question_ids): the questions of each image in the order of ``pos``."""
    return annotations.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question_id"))), lambda x: x["question_id"]).alias("question_ids"))


def question_index(annotations: DataFrame) -> DataFrame:
    """The last annotation of each question."""
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("pos")))
    return annotations.withColumn("_rn", order).where("_rn = 1").drop("_rn")


def question_ids(annotations: DataFrame, images: Sequence[int] = (), question_types: Sequence[str] = (), answer_types: Sequence[str] = ()) -> DataFrame:
    """(place, question_id) that pass the filters given; an empty filter passes all. With images, their order comes first."""
    rows, place = annotations, F.lit(0)
    if images:
        place = F.array_position(F.array(*map(F.lit, images)), F.col("image_id")).cast("int")
        rows = rows.where(F.col("image_id").isin(*images))
    for column, wanted in (("question_type", question_types), ("answer_type", answer_types)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows.select(place.alias("place"), "pos", "question_id")


def vocabulary_places(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(question_id, places): the vocabulary places of the right choice and the direct answers, once each; questions without any are dropped."""
    words = questions.select("question_id", F.explode(F.array_distinct(F.concat(F.array(F.get("choices", F.col("correct_choice_idx"))), "direct_answers"))).alias("word"))
    return words.join(vocabulary, "word").groupBy("question_id").agg(F.array_sort(F.collect_set("place")).alias("places"))


def multi_hot(places: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(places, i.cast("int")).cast("int"))


def coverage(rows: DataFrame, answer: str, vocabulary: DataFrame) -> DataFrame:
    """(coverage): 100 times the share of rows whose answer is a word of the vocabulary."""
    known = vocabulary.select(F.col("word").alias(answer), F.lit(1).alias("_in")).distinct()
    return rows.join(known, answer, "left").agg(F.round(100 * F.avg(F.coalesce("_in", F.lit(0))), 6).alias("coverage"))


def typed_accuracy(scores: DataFrame, digits: int = 2) -> DataFrame:
    """(level, name, accuracy) of (question_type, answer_type, score): 100 times the mean, overall and for each type of either kind."""
    levels = F.array(*(F.struct(F.lit(k).alias("level"), c.alias("name")) for k, c in (("overall", F.lit("overall")), ("question_type", F.col("question_type")), ("answer_type", F.col("answer_type")))))
    return scores.select("score", F.explode(levels).alias("l")).groupBy("l.level", "l.name").agg(F.round(100 * F.avg("score"), digits).alias("accuracy"))


def consensus_score(guess: Column, answers: Column) -> Column:
    """Of (answer_id, answer) structs: for each, min(1, how many others, not equal to it as a whole, give the guess / 3); the mean.

    The guess is normalised fully, the answers only in their punctuation and only where they differ.
    """
    plain = T.digits_articles(T.punctuation(T.strip(F.translate(guess, "\n\t", "  "))))
    apart = F.size(F.array_distinct(F.transform(answers, lambda a: a["answer"]))) > 1
    held = F.when(apart, F.transform(answers, lambda a: F.struct(a["answer_id"].alias("answer_id"), T.punctuation(a["answer"]).alias("answer")))).otherwise(answers)

    def mean(rows: Column, guessed: Column) -> Column:
        fit = F.transform(F.filter(rows, lambda b: b["answer"] == guessed), lambda b: b["answer_id"])
        return _once(fit, lambda ids: _once(F.size(F.array_distinct(ids)) == F.size(ids), lambda single: total(rows, guessed, ids, single)))

    def total(rows: Column, guessed: Column, ids: Column, single: Column) -> Column:
        own = lambda a: F.when(single, 1).otherwise(F.size(F.filter(ids, lambda i: i.eqNullSafe(a["answer_id"]))))
        hits = lambda a: F.size(ids) - F.when(a["answer"] == guessed, own(a)).otherwise(0)
        return F.aggregate(rows, F.lit(0.0), lambda s, a: s + F.least(F.lit(1.0), hits(a) / 3)) / F.size(rows)

    return _once(plain, lambda guessed: _once(held, lambda rows: mean(rows, guessed)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once, where a lambda of ``f`` would work it out again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def direct_accuracy(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """(accuracy): 100 times the mean of min(1, equal answers / 3) in lower case, without difficult questions; a missing prediction is 0."""
    rows = dataset.where("NOT difficult_direct_answer").join(predictions, "question_id", "left")
    same = F.size(F.filter("direct_answers", lambda a: F.lower(a) == F.lower("prediction")))
    return rows.agg(F.round(100 * F.avg(F.coalesce(F.when(F.col("prediction").isNotNull(), F.least(F.lit(1.0), same / 3)), F.lit(0.0))), 6).alias("accuracy"))


def choice_accuracy(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """(accuracy): 100 times the share of predictions that are the right choice; a missing one is wrong."""
    rows = dataset.join(predictions, "question_id", "left")
    return rows.agg(F.round(100 * F.avg(F.coalesce((F.col("prediction") == F.get("choices", F.col("correct_choice_idx"))).cast("int"), F.lit(0))), 6).alias("accuracy"))


def unknown_predictions(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """The dataset's questions without a prediction, or with one that isn't a choice: what a strict evaluation refuses."""
    rows = dataset.join(predictions, "question_id", "left")
    return rows.where(F.col("prediction").isNull() | ~F.array_contains("choices", F.col("prediction"))).select("question_id")


def exact_accuracy(rows: DataFrame, normalise: bool = True) -> DataFrame:
    """(accuracy): 100 times the share of guesses equal to the truth; null if any truth is missing, as there is nothing to measure then."""
    guess = T.digits_articles(T.punctuation(F.col("guess"))) if normalise else F.col("guess")
    return rows.agg(F.when(~F.bool_or(F.col("truth").isNull()), F.round(100 * F.avg((guess == F.col("truth")).cast("int")), 6)).alias("accuracy"))


def judge_average(scores: DataFrame, results: DataFrame) -> DataFrame:
    """(average): the sum of all stored scores over the number of results."""
    return scores.agg(F.sum("score").alias("s")).join(results.agg(F.count("*").alias("n"))).select(F.round(F.try_divide("s", "n"), 6).alias("average"))


def judged(text: Column) -> Column:
    """struct<pred, score> of a judge's dictionary text, with single or double quotes; null where it can't be read."""
    return F.from_json(F.when(F.trim(text).startswith("{"), F.replace(text, F.lit("'"), F.lit('"'))), "pred string, score double")


def nearest_choice(prediction: Column, choices: Column, vector: Column, vectors: Column) -> Column:
    """The prediction if it is a choice, else the first choice whose vector is nearest by cosine."""
    scored = F.transform(F.arrays_zip(choices.alias("c"), vectors.alias("v")), lambda x, i: F.struct(cosine(x["v"], vector).alias("s"), (-i).alias("i"), x["c"].alias("c")))
    return F.when(F.array_contains(choices, prediction), prediction).otherwise(F.array_max(scored)["c"])


def ranked_by_loss(losses: Column, candidates: Column) -> Column:
    """The places of the losses, smallest first; places from ``candidates`` on count as 9999."""
    rows = F.transform(losses, lambda x, i: F.struct(F.when(i < candidates, x.cast("double")).otherwise(F.lit(9999.0)).alias("l"), i.alias("i")))
    return F.transform(F.array_sort(rows), lambda x: x["i"])


def most_common(train: DataFrame, answer: str, order: str) -> DataFrame:
    """(answer, n, first): how often each answer occurs and where first; the mode is the largest n, then the smallest first."""
    return train.groupBy(answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def common_choice(questions: DataFrame, counts: DataFrame, answer: str) -> DataFrame:
    """(question_id, prediction): of the question's choices the one that training has most often, the first if tied; else the mode of all."""
    mode = counts.agg(F.max_by(answer, F.struct("n", -F.col("first"))).alias("_mode"))
    rows = questions.select("question_id", F.posexplode("choices").alias("at", answer)).join(counts, answer)
    best = rows.groupBy("question_id").agg(F.max_by(answer, F.struct("n", -F.col("at"))).alias("_best"))
    return questions.select("question_id").join(best, "question_id", "left").join(F.broadcast(mode)).select("question_id", F.coalesce("_best", "_mode").alias("prediction"))  # one row


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def split_words(text: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


BLEU_WEIGHTS = ((1.0,), (0.5, 0.5), (0.33, 0.33, 0.33), (0.25, 0.25, 0.25, 0.25))


def sentence_bleu(pairs: DataFrame, key: str, guess: str = "guess", reference: str = "reference") -> DataFrame:
    """(key, bleu1 .. bleu4): clipped n-gram precisions in weighted geometric means, with a brevity penalty, without smoothing.

    No common word gives 0; a higher order without a common n-gram counts as the smallest positive double. The n-grams are counted as
    rows, so a text's length enters once, not squared; those of guess and reference meet in one grouping, which stays where pairs that are grouped by key lie.
    """
    words = pairs.select(key, split_words(F.col(guess)).alias("g"), split_words(F.col(reference)).alias("r"))
    tagged = lambda c, a, n: F.transform(_grams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    every = words.select(key, F.explode(F.flatten(F.array(*(tagged(c, a, n) for c, a in (("g", 1), ("r", 0)) for n in range(1, 5))))).alias("x"))
    met = every.groupBy(key, "x.n", "x.g").agg(F.sum("x.a").alias("c"), F.sum("x.b").alias("d")).where("c > 0 AND d > 0")
    hits = met.groupBy(key).agg(*(F.sum(F.when(F.col("n") == n, F.least("c", "d"))).alias(f"h{n}") for n in range(1, 5)))
    rows = words.select(key, F.size("g").alias("lg"), F.size("r").alias("lr")).join(hits, key, "left")
    hit = lambda n: F.coalesce(F.col(f"h{n}"), F.lit(0))
    term = lambda n: F.log(F.when(hit(n) > 0, hit(n).cast("double") / F.greatest(F.lit(1), F.col("lg") - n + 1)).otherwise(F.lit(2.2250738585072014e-308)))
    penalty = F.when(F.col("lg") < F.col("lr"), F.exp(1 - F.col("lr").cast("double") / F.col("lg"))).otherwise(F.lit(1.0))
    score = lambda weights: F.when(hit(1) == 0, F.lit(0.0)).otherwise(penalty * F.exp(sum((F.lit(w) * term(n) for n, w in enumerate(weights[1:], 2)), F.lit(weights[0]) * term(1))))
    return rows.select(key, *(score(w).alias(f"bleu{n}") for n, w in enumerate(BLEU_WEIGHTS, 1)))


def corpus_bleu(pairs: DataFrame, key: str) -> DataFrame:
    """(bleu1 .. bleu4): the mean sentence BLEU of each order."""
    return sentence_bleu(pairs, key).agg(*(F.round(F.avg(f"bleu{n}"), 6).alias(f"bleu{n}") for n in range(1, 5)))


def cider(guesses: DataFrame, references: DataFrame, key: str, orders: int = 4, sigma: float = 6.0) -> DataFrame:
    """(key, cider) of (key, text) guesses and references, one or more for each key: mean TF-IDF cosine of n-grams, times 10.

    Document frequency counts the keys whose references hold an n-gram. The guess's weight is clipped to the reference's, and each
    order is damped by the difference in length, as the D variant of the measure has it. n-grams travel as 64-bit hashes; a guess and each of
    its references meet in one grouping, which gives norms and products together.
    """
    refs = references.select(key, F.row_number().over(Window.partitionBy(key).orderBy("text")).alias("_ref"), split_words(F.col("text")).alias("w"))
    own = guesses.select(key, split_words(F.col("text")).alias("w")).join(refs.select(key, "_ref"), key)  # once for each reference
    size, zero = F.greatest(F.size("w") - 1, F.lit(0)), F.lit(0)
    sides = own.select(key, "_ref", "w", F.lit(1).alias("a"), zero.alias("b"), size.alias("lg"), zero.alias("lr")).unionByName(refs.select(key, "_ref", "w", zero.alias("a"), F.lit(1).alias("b"), zero.alias("lg"), size.alias("lr")))
    tagged = lambda n: F.transform(_grams(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), g).alias("g")))
    spread = sides.select(key, "_ref", "a", "b", "lg", "lr", F.explode(F.flatten(F.array(*(tagged(n) for n in range(1, orders + 1))))).alias("x"))
    met = spread.groupBy(key, "_ref", "x.n", "x.g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("lg").alias("lg"), F.max("lr").alias("lr"))
    df = met.where("b > 0").select(key, "n", "g").distinct().groupBy("n", "g").agg(F.count("*").alias("df"))
    total = references.select(key).distinct().agg(F.log(F.greatest(F.count("*"), F.lit(1)).cast("double")).alias("_total"))  # one row
    rare = F.col("_total") - F.log(F.greatest(F.lit(1.0), F.coalesce(F.col("df").cast("double"), F.lit(0.0))))
    rows = met.join(df, ["n", "g"], "left").crossJoin(F.broadcast(total)).withColumn("a", F.col("a") * rare).withColumn("b", F.col("b") * rare)
    scored = rows.groupBy(key, "_ref", "n").agg(F.sum(F.least("a", "b") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("na"), F.sum(F.col("b") * F.col("b")).alias("nb"), F.max("lg").alias("lg"), F.max("lr").alias("lr"))
    value = F.coalesce(F.try_divide("dot", F.sqrt("na") * F.sqrt("nb")), F.lit(0.0)) * F.exp(-((F.col("lg") - F.col("lr")) ** 2) / (2 * sigma * sigma))
    sums = scored.groupBy(key).agg(F.sum(value).alias("s"))
    counts = references.groupBy(key).agg(F.count("*").alias("refs"))
    out = guesses.select(key).join(counts, key, "left").join(sums, key, "left")
    return out.select(key, F.round(F.coalesce(F.try_divide(10.0 * F.col("s"), F.lit(float(orders)) * F.col("refs")), F.lit(0.0)), 6).alias("cider"))


def prior_contexts(questions: DataFrame, contexts: DataFrame, train: DataFrame, shots: int = 10, seed: str = "0") -> DataFrame:
    """(question_id, context, examples): the question's own context, '' where there is none, and ``shots`` drawn training rows each.

    Each question draws from the hash order of the training ids, starting at its own hash, so questions differ without a pair of each with each.
    The training ids are numbered in hash order; a draw is ``shots`` places that follow each other.
    """
    from plotloom.operators.relate import in_order

    order = F.md5(F.concat_ws("|", F.col("example_id").cast("string"), F.lit(seed)))
    line = in_order(train.withColumn("_h", order), "_h", "at").select("at", "example_id")
    n = train.count()
    own = questions.join(contexts, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("question_id").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long") % max(1, n)
    wanted = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(min(shots, n) - 1)))).withColumn("at", (first + F.col("k")) % max(1, n))
    return wanted.join(line, "at").groupBy("question_id", "context").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "example_id"))), lambda x: x["example_id"]).alias("examples"))
