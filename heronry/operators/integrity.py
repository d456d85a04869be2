"""Retrieval scoring, claims, point-in-time integrity, recomputation, guardrails, voting, constrained selection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.numeric import close, ratio
from heronry.shared import spread

# Wording that marks advice and projection, in Korean and English.
ADVISORY_WORDING = (
    r"매수|매도|사세요|파세요|사야|팔아야|비중\s*확대|비중\s*축소",
    r"\b(buy|sell|hold|overweight|underweight)\b",
    r"목표\s*주가|target\s*price",
    r"추천(합니다|한다|드립니다)?",
)
PROJECTION_WORDING = (
    r"할\s*것(이다|으로|입니다)|예상|전망|기대|겠(다|습니다)|될\s*것",
    r"\b(will|expect|forecast|project|likely|outlook)\b",
)
ADVISORY = "(?iuU)" + "|".join(ADVISORY_WORDING)
PROJECTED = "(?iuU)" + "|".join(PROJECTION_WORDING)
VERIFIABLE = ("measured", "derived", "sourced")


# --- retrieval


#: Questions that one pass over the documents answers.
ASKED = 500
#: Texts whose words are held at once.
TEXTS = 1000


def keyword_topk(docs: DataFrame, queries: DataFrame, k: int = 5, *, block: int = ASKED) -> DataFrame:
    """(query_id, doc_id, score, rn): documents by how often the query's words occur in them; a word asked twice counts twice.

    ``docs``: (doc_id, text); ``queries``: (query_id, query). Substrings count, without overlap, case doesn't, zero scores
    are dropped, equal scores go by id. Queries are dealt in blocks, and each block is one pass over the documents. As
    no word holds a blank, an occurrence lies in one word of the text: each different word of a batch is searched once
    for all words asked. A batch only passes on its best k rows of each query, which hold the best k.
    """
    terms = queries.select("query_id", F.explode(F.split(F.lower(F.trim("query")), r"\s+")).alias("term")).where("term <> ''").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("m"))
    blocks = 1 + queries.count() // block
    out = None
    for at in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).collect()  # about `block` queries
        part = _best_of_block(docs, queries, [(t.query_id, t.term, t.m) for t in asked], k)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")).where(F.col("rn") <= k)


def _best_of_block(docs: DataFrame, queries: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """(query_id, doc_id, score): the best k documents of each batch for each query of a block of (query_id, term, times)."""
    import numpy as np
    import pandas as pd

    words, ids = sorted({t for _, t, _ in asked}), sorted({q for q, _, _ in asked})
    at_word, at_id = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
    lists: list[list[tuple[int, int]]] = [[] for _ in words]
    for q, t, m in asked:
        lists[at_word[t]].append((at_id[q], m))
    by_word = [(np.array([q for q, _ in x]), np.array([m for _, m in x], np.float32)) for x in lists]  # the queries of each word

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        if not words:
            return
        tree = ahocorasick.Automaton()
        for i, w in enumerate(words):
            tree.add_word(w, (i, len(w)))
        tree.make_automaton()

        def weights(word: str) -> np.ndarray:
            """What the word adds to each query's score."""
            out = np.zeros(len(ids), np.float32)
            ends: dict[int, int] = {}
            for end, (i, n) in tree.iter(word):
                if end - n >= ends.get(i, -1):  # without overlap, from the left
                    ends[i] = end
                    q, m = by_word[i]
                    out[q] += m
            return out

        for batch in (whole.iloc[k : k + TEXTS] for whole in batches for k in range(0, len(whole), TEXTS)):
            batch = batch.sort_values("doc_id", kind="stable")
            seen: dict[str, int] = {}
            texts = [np.array([seen.setdefault(w, len(seen)) for w in text.split()], np.int64) for text in batch["text"].fillna("")]
            table = np.stack([weights(w) for w in seen]) if seen else np.zeros((1, len(ids)), np.float32)
            scores = np.zeros((len(batch), len(ids)), np.int64)
            for row, at in zip(scores, texts, strict=True):
                if len(at):
                    which, times = np.unique(at, return_counts=True)
                    row[:] = np.rint(times.astype(np.float64) @ table[which])
            order = np.argsort(-scores, axis=0, kind="stable")[:k]
            rows = pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=object)[None], len(order), axis=0).ravel(), "doc_id": batch["doc_id"].to_numpy()[order].ravel(), "score": np.take_along_axis(scores, order, axis=0).ravel()})
            yield rows[rows["score"] > 0]

    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", F.lower("text").alias("text"))).mapInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score long")


def retrieval_scores(gold: DataFrame) -> DataFrame:
    """Recall, precision (helpful ones left out of its base; 0 if nothing counts), forbidden and missed of each question."""
    got = F.array_distinct("retrieved")
    hit, base = F.size(F.array_intersect(got, "required")), F.size(F.array_except(got, "helpful"))
    return gold.select("question_id", ratio(hit, F.size("required")).alias("recall"), F.coalesce(ratio(hit, base), F.lit(0.0)).alias("precision"), F.size(F.array_intersect(got, "forbidden")).alias("n_forbidden"), F.array_sort(F.array_except("required", got)).alias("missed"))


def retrieval_report(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("questions"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.count_if((F.col("recall") == 1) & (F.col("n_forbidden") == 0)).alias("perfect"), F.sum("n_forbidden").alias("forbidden_hits"), F.count_if(F.col("n_forbidden") > 0).alias("questions_with_forbidden"))


def word_set(text: Column, stop: Sequence[str] = ()) -> Column:
    """Different words of ASCII letters, digits or Hangul, lowered, of two characters or more, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z가-힣]+)"), 1))
    return F.array_except(F.filter(found, lambda w: F.length(w) > 1), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))


def entails(claim: Column, support: Column, least: float = 0.6) -> Column:
    """Whether enough of the claim's words stand in the support; no words: no."""
    need = word_set(claim)
    return F.when(F.size(need) > 0, F.size(F.array_intersect(need, word_set(support))) / F.size(need).cast("double") >= least).otherwise(F.lit(False))


def claim_lines(answers: DataFrame) -> DataFrame:
    """Lines "- text [id, id]" of an answer: (answer_id, claim_id, text, ids); others come with ``malformed``, 120 characters of them."""
    pattern = r"^\s*-\s*(.*?)\s*\[([^\]]*)\]\s*$"
    lines = answers.select("answer_id", F.posexplode(F.split("answer", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    ok = F.col("raw").rlike(pattern)
    ids = F.filter(F.transform(F.split(F.regexp_extract("raw", pattern, 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select("answer_id", F.concat(F.lit("c"), F.col("line") + 1).alias("claim_id"), F.when(ok, F.regexp_extract("raw", pattern, 1)).alias("text"), F.when(ok, ids).alias("ids"), F.when(~ok, F.left("raw", F.lit(120))).alias("malformed"))


def claim_kind(text: Column) -> Column:
    """advisory before projected; NULL if neither."""
    return F.when(text.rlike(ADVISORY), "advisory").when(text.rlike(PROJECTED), "projected")


def claim_audit(claims: DataFrame, *, advisory_allowed: bool = False) -> DataFrame:
    """(id, issue): every rule a claim breaks."""
    verifiable = F.col("kind").isin(*VERIFIABLE)
    said = claim_kind(F.col("text"))
    issues = F.array_compact(
        F.array(
            F.when(verifiable & (F.coalesce(F.size("support"), F.lit(0)) <= 0), "unsupported_fact"),
            F.when((F.col("kind") == "projected") & ~F.coalesce("labeled", F.lit(False)), "unlabeled_projection"),
            F.when((F.col("kind") == "advisory") & F.lit(not advisory_allowed), "advisory_output"),
            F.when((said == "advisory") & (F.col("kind") != "advisory"), "misclassified_advisory").when((said == "projected") & verifiable, "misclassified_projection"),
            F.when(verifiable & (F.coalesce(F.col("as_of").cast("string"), F.lit("")) == ""), "missing_as_of"),
        )
    )
    return claims.select("id", F.explode(issues).alias("issue"))


# --- point in time


def as_of_view(points: DataFrame, as_of: Column) -> DataFrame:
    """(key, value, published_at): the latest value of each key known at ``as_of``; of equal dates the first ingested."""
    known = points.where((F.col("published_at") <= as_of) & (F.col("restated_at").isNull() | (F.col("restated_at") <= as_of)))
    return known.groupBy("key").agg(F.max_by(F.struct("value", "published_at"), F.struct("published_at", -F.col("seq"))).alias("v")).select("key", "v.value", "v.published_at")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time: both sides in one sorted window, no range join."""
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col("_m")[c].alias(f"{c}_asof") for c in columns])


def leak(as_of: Column, *, lag_checked: bool = True) -> Column:
    """The first rule a data point breaks at ``as_of``; NULL if none."""
    out = F.when(F.col("published_at").isNull(), "unknown_timestamp").when(F.col("published_at") > as_of, "unpublished").when(F.col("restated_at") > as_of, "restated").when(F.col("period_end") > as_of, "future_observation")
    return out.when(F.col("published_at") < F.col("period_end"), "future_observation") if lag_checked else out


# --- recomputation

_I = lambda k: F.element_at(F.col("inputs"), k)


def metrics() -> dict[str, Column]:
    """Metrics by name, of a map ``inputs``; NULL where they are undefined."""
    return {
        "operating_margin": ratio(_I("operating_income"), _I("revenue")),
        "net_margin": ratio(_I("net_income"), _I("revenue")),
        "roe": ratio(_I("net_income"), _I("equity")),
        "roa": ratio(_I("net_income"), _I("assets")),
        "debt_to_equity": ratio(_I("debt"), _I("equity")),
        "current_ratio": ratio(_I("current_assets"), _I("current_liabilities")),
        "per": ratio(_I("price"), _I("eps")),
        "pbr": ratio(_I("price"), _I("bps")),
        "yoy_growth": F.when(_I("prior") > 0, _I("current") / _I("prior") - F.lit(1.0)),
        "cagr": F.when((_I("begin") > 0) & (_I("years") > 0), F.pow(_I("end") / _I("begin"), F.lit(1.0) / _I("years")) - F.lit(1.0)),
    }


def recompute(claims: DataFrame) -> DataFrame:
    """Claims with ``recomputed``, ``status`` (ok, mismatch, undefined, unknown_metric) and ``error``."""
    value = F.lit(None).cast("double")
    table = metrics()
    for name, m in table.items():
        value = F.when(F.col("metric") == name, m).otherwise(value)
    out = claims.withColumn("recomputed", value)
    status = F.when(~F.col("metric").isin(*table), "unknown_metric").when(F.col("recomputed").isNull(), "undefined").when(close(F.col("recomputed"), F.col("reported")), "ok").otherwise("mismatch")
    return out.withColumn("status", status).withColumn("error", F.abs(F.col("reported") - F.col("recomputed")))


# --- guardrails and rules


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule): rules a row breaks; a rule that comes out NULL is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def guardrails(rows: DataFrame, rails: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Per rail (condition that hits, tolerated hits): hits, whether tolerated, breaches. A NULL condition is a hit. One pass."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, (c, _) in rails.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rail"), F.col(n).alias("hits"), F.lit(t).cast("long").alias("tolerance")) for n, (_, t) in rails.items()])).alias("r")).select("r.*")
    return out.withColumn("tolerated", (F.col("hits") > 0) & (F.col("hits") <= F.col("tolerance"))).withColumn("breaches", F.when(F.col("hits") > F.col("tolerance"), F.col("hits")).otherwise(F.lit(0).cast("long")))


def reasoned(rails: Mapping[str, tuple[Column, int]], reasons: Mapping[str, str]) -> Mapping[str, tuple[Column, int]]:
    """The rails; one that tolerates hits without a reason why is an error."""
    bare = [n for n, (_, tolerance) in rails.items() if tolerance > 0 and not reasons.get(n, "").strip()]
    if bare:
        raise ValueError(f"no reason given for tolerating hits of {', '.join(sorted(bare))}")
    return rails


def missing_slots(rows: DataFrame, key: str, slots: Sequence[str]) -> DataFrame:
    """(key, missing): required text slots that are NULL or empty."""
    return rows.select(key, F.array_compact(F.array(*[F.when(F.coalesce(F.col(s).cast("string"), F.lit("")).isin("", "[]", "{}"), F.lit(s)) for s in slots])).alias("missing"))


# --- voting


def quadratic_votes(reviews: DataFrame) -> DataFrame:
    """(target, score): square roots of each reviewer's credits for a target, summed; negative credits count as none, votes for oneself are an error."""
    credits = F.when(F.col("reviewer") == F.col("target"), F.raise_error(F.lit("a reviewer votes for itself")).cast("double")).otherwise(F.greatest(F.col("credits"), F.lit(0.0)))
    return reviews.groupBy("reviewer", "target").agg(F.sum(credits).alias("c")).groupBy("target").agg(F.sum(F.sqrt("c")).alias("score"))


def claim_votes(ballots: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Per claim: models for it over all models, and whether that is above ``least``."""
    models = ballots.agg(F.countDistinct("model").alias("models"))
    out = ballots.groupBy("claim_id").agg(F.countDistinct(F.when(F.col("supports"), F.col("model"))).alias("supporters")).join(F.broadcast(models))
    return out.withColumn("share", ratio(F.col("supporters"), F.col("models"))).withColumn("passes", F.col("share") > least)


def error_correlation(outcomes: DataFrame) -> DataFrame:
    """(model_a, model_b, both_wrong, either_wrong, correlation) over the tasks both answered."""
    a = outcomes.select(F.col("model").alias("model_a"), "k", (~F.col("correct")).alias("wa"))
    b = outcomes.select(F.col("model").alias("model_b"), "k", (~F.col("correct")).alias("wb"))
    j = a.join(b, "k").where("model_a < model_b")
    return j.groupBy("model_a", "model_b").agg(F.count_if(F.col("wa") & F.col("wb")).alias("both_wrong"), F.count_if(F.col("wa") | F.col("wb")).alias("either_wrong")).withColumn("correlation", F.coalesce(ratio(F.col("both_wrong"), F.col("either_wrong")), F.lit(0.0)))


def join_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``duplicate``: one whose set of sources, not empty, an earlier one has."""
    sig = F.array_join(F.array_sort(F.array_distinct("sources")), "\x1f")
    out = findings.withColumn("_s", F.when(F.size("sources") > 0, sig))
    first = F.row_number().over(Window.partitionBy("_s").orderBy("seq"))
    return out.withColumn("duplicate", F.col("_s").isNotNull() & (first > 1)).drop("_s")


# --- selection


def broker(candidates: DataFrame, group: str, *, team: int, per_family: int, vram: float, cost: float) -> DataFrame:
    """(group, ref, pick): greedy by value over cost within limits of size, family, memory and cost; what doesn't fit is skipped.

    Candidates of a group are folded in order in one expression; a group is a shortlist, not a table.
    """
    gain = F.when(F.col("cost") == 0, F.lit(float("inf"))).otherwise(F.col("value") / F.col("cost"))
    item = F.struct((-gain).alias("g"), "seq", "ref", "family", "cost", "vram_mb")
    packed = candidates.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("c"))
    start = F.struct(F.array().cast("array<string>").alias("refs"), F.array().cast("array<string>").alias("families"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("vram"))

    def take(s: Column, x: Column) -> Column:
        same = F.size(F.filter(s["families"], lambda f: f == x["family"].cast("string")))
        fits = (F.size(s["refs"]) < team) & (same < per_family) & (s["vram"] + x["vram_mb"] <= vram) & (s["cost"] + x["cost"] <= cost)
        grown = F.struct(F.concat(s["refs"], F.array(x["ref"].cast("string"))).alias("refs"), F.concat(s["families"], F.array(x["family"].cast("string"))).alias("families"), (s["cost"] + x["cost"]).alias("cost"), (s["vram"] + x["vram_mb"]).alias("vram"))
        return F.when(fits, grown).otherwise(s)

    return packed.select(group, F.posexplode(F.aggregate("c", start, take, lambda s: s["refs"])).alias("pick", "ref"))


def route(questions: DataFrame, corpus_words: DataFrame, *, least: float = 0.6) -> DataFrame:
    """Per question: its own mode, or free without a corpus, or grounded if one of its words is in the corpus, else free; an unsure one falls back."""
    hits = questions.select("question_id", F.explode(word_set(F.col("question"))).alias("word")).join(corpus_words, "word", "left_semi").select("question_id").distinct().withColumn("hit", F.lit(True))
    out = questions.join(hits, "question_id", "left")
    mode = F.coalesce(F.col("mode"), F.when(F.coalesce("hit", F.lit(False)), "grounded").otherwise("free"))
    return out.select("question_id", F.when(F.col("confidence") < least, "fallback").otherwise(mode).alias("route"))
