"""Whether the hits of a question can carry an answer, and what is said where they cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

# Words of questions that say nothing about their subject, what counts as an identifier, the bounds of the
# gate, and the texts for each reason.
ASKING = (
    "what which who whom whose when where why how is are was were be been being am do does did can could should would will shall may might the a an of in on at to for from by with about and or but if "
    "then than that this these those i we you they it my our your their its me us them there here any some all not no please tell show give given explain describe many much long have has had get got need "
    "want allowed entitled apply applies"
).split()
IDENTIFIER = r"(\b[A-Z]{2,5}[-_]\d{2,}(?:[-_]\d+)*\b|\b\d+\.\d+(?:\.\d+)+\b)"
LEAST_SCORE, LEAST_HITS, LEAST_COVERAGE, NEAR = 0.012, 1, 0.6, 3
MESSAGES = {
    "no_results": "I could not find anything about that in the documents you have access to, so I do not have an answer.",
    "weak_evidence": "I found some related material, but nothing that actually answers your question, so I would rather not guess.",
    "incomplete_evidence": "The documents I can see cover this topic but do not state the specific detail you asked for, so I do not have an answer.",
    "conflicting_evidence": "The sources I found disagree, and nothing in them settles which one currently applies. Rather than pick one, here is what each says.",
    "ungrounded_draft": "I could not produce an answer that the retrieved documents actually support, so I am not going to offer one.",
    "only_superseded": "Everything I found on this has been superseded, and the replacement is not in the documents I can see. I do not have the current position.",
    "needs_clarification": "I can find material on this, but the question could be read more than one way and the readings have different answers.",
}
SUGGESTIONS = {
    "no_results": ["Check whether the document has been uploaded to this workspace.", "Try naming the document, policy or reference number directly.", "If you expect access to it, your administrator can confirm your permissions."],
    "weak_evidence": ["Try more specific wording, or the exact term used in the document.", "If you know the reference number or section, include it."],
    "incomplete_evidence": ["The detail may live in an annexe or a linked document that is not indexed here.", "Ask about the surrounding section and I can tell you what it does cover."],
    "conflicting_evidence": ["Check the effective dates on the sources below.", "Your document owner can confirm which version is in force."],
    "ungrounded_draft": ["Try asking about one thing at a time.", "Naming the document or section usually produces a grounded answer."],
    "only_superseded": ["Ask for the historical position and I can quote the superseded version.", "The replacement document may need to be uploaded."],
    "needs_clarification": [],
}


def distinctive(question: Column) -> Column:
    """The words of a question that its evidence has to have."""
    return F.array_distinct(F.filter(tokens(question), lambda t: ~t.isin(ASKING)))


def assess(questions: DataFrame, hits: DataFrame, score: float = LEAST_SCORE, supporting: int = LEAST_HITS, coverage: float = LEAST_COVERAGE, near: int = NEAR) -> DataFrame:
    """``query_id, sufficient, reason, n_supporting, coverage, missing, near``: one row a question.

    questions: ``query_id, text``; hits: ``query_id, doc_id, score, text, is_superseded``. The first that applies is the
    reason: no hits; fewer than ``supporting`` hits of at least ``score``; only superseded ones; an identifier of the
    question in none of them; too few of its distinctive words in them together. ``missing`` are those identifiers or
    words; ``near`` the best ``near`` documents of a refused question, each once. A question without distinctive words
    is covered. Only what a hit has of its own question's words is shuffled, not its text.
    """
    asked = questions.select("query_id", distinctive(F.col("text")).alias("terms"), F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IDENTIFIER), F.lit(1))).alias("ids"))
    strong = F.col("score") >= score
    met = hits.join(asked, "query_id").select(
        "query_id", "doc_id", "score", "is_superseded", strong.alias("strong"), F.array_intersect("terms", tokens(F.col("text"))).alias("has"),
        F.filter("ids", lambda i: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(i))).alias("named"),
    )
    by = met.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("strong").alias("n_supporting"), F.count_if(F.col("strong") & ~F.coalesce("is_superseded", F.lit(False))).alias("n_current"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("strong"), F.col("has"))))).alias("has"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("strong"), F.col("named"))))).alias("named"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d"), F.col("strong").alias("ok")))).alias("ranked"),
    )
    rows = asked.join(by, "query_id", "left")
    lost, gone = F.array_except("ids", "named"), F.array_except("terms", "has")
    share = F.when(F.size("terms") == 0, 1.0).otherwise((F.size("terms") - F.size(gone)) / F.size("terms"))
    step = (
        F.when(F.col("n").isNull(), 1).when(F.col("n_supporting") < supporting, 2).when(F.col("n_current") == 0, 3).when(F.size(lost) > 0, 4).when(share < coverage, 5).otherwise(0)
    )
    rows = rows.withColumn("step", step)
    reason = F.element_at(F.create_map(*[F.lit(x) for p in enumerate(["no_results", "weak_evidence", "only_superseded", "incomplete_evidence", "incomplete_evidence"], 1) for x in p]), F.col("step"))
    none = F.array().cast("array<string>")
    missing = F.when(F.col("step").isin(1, 2), F.col("terms")).when(F.col("step") == 3, none).when(F.col("step") == 4, lost).otherwise(gone)
    # all hits where they are too weak, else those that support
    close = F.array_distinct(F.transform(F.filter("ranked", lambda x: x["ok"] | (F.col("step") == 2)), lambda x: x["d"]))
    return rows.select(
        "query_id", (F.col("step") == 0).alias("sufficient"), reason.alias("reason"), F.when(F.col("step") == 0, F.col("n_supporting")).otherwise(0).alias("n_supporting"),
        F.when(F.col("step").isin(0, 5), F.round(share, 6)).otherwise(0.0).alias("coverage"), missing.alias("missing"), F.when(F.col("step") > 1, F.slice(close, 1, near)).alias("near"),
    )


def message(reason: Column, near: Column, question: Column | None = None) -> Column:
    """What is said for a reason: its text, a question back where it needs one, the closest titles, and what might help.

    near: titles, best first; parts that are empty are left out, the others stand apart by an empty line.
    """
    pick = lambda table: F.coalesce(*[F.when(reason == k, F.lit(v)) for k, v in table.items() if v])
    help_ = pick({k: "\n".join(["What might help:", *(f"  - {x}" for x in v)]) if v else "" for k, v in SUGGESTIONS.items()})
    titles = F.when(F.size(F.coalesce(near, F.array().cast("array<string>"))) > 0, F.concat(F.lit("The closest things I found were:\n"), F.array_join(F.transform(near, lambda t: F.concat(F.lit("  - "), t)), "\n")))
    back = F.when(reason == "needs_clarification", question if question is not None else F.lit(None).cast("string"))
    return F.when(reason.isNotNull(), F.concat_ws("\n\n", pick(MESSAGES), back, titles, help_))
