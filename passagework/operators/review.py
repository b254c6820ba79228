"""Question sets under review: events fold into the current state of each answer; statistics and export follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import format_pages, progress
from ..sources import csvio
from ..sources.tables import written
from .ask import ask
from .providers import Provider
from .relational import csv_line, stats
from .search import ranked

STATUSES = ("DRAFT", "APPROVED", "REJECTED")
LONGEST_ANSWER, MOST_QUESTIONS, LONGEST_QUESTION, LONGEST_CSV, BATCH = 10_000, 500, 2_000, 2_000_000, 5


def coerced(value: Column, known: tuple[str, ...], otherwise: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(otherwise)


def event_error(event_kind: Column, status: Column, text: Column) -> Column:
    """Why an event can't be applied; null if it can. A null text restores the draft."""
    blank = text.isNotNull() & (F.length(F.trim(text)) == 0)
    return (
        F.when(event_kind.isin("review") & status.isNotNull() & ~status.isin(*STATUSES), "unknown_status")
        .when(event_kind.isin("edit") & blank, "blank_text")
        .when(event_kind.isin("edit") & (F.length(text) > LONGEST_ANSWER), "text_too_long")
    )


def current_answers(events: DataFrame) -> DataFrame:
    """question_id, draft, final_text, status, text, updated, draft_seq: the state after all valid events, and the event that made the draft.

    events: question_id, seq, at, kind (draft, review or edit), status, text. A draft resets status and final text; it is
    refused while the answer is approved, so an approval guards it until a later review. An edit equal to
    the draft, or a null one, restores the draft. State by question is one window; a question's
    events are few."""
    ok = events.where(event_error(F.col("kind"), F.col("status"), F.col("text")).isNull())
    w = W.partitionBy("question_id").orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # the last word on status before an event: a review's, or DRAFT from a draft
    said = F.when(F.col("kind") == "review", F.col("status")).when(F.col("kind") == "draft", "DRAFT")
    refused = (F.col("kind") == "draft") & F.coalesce(F.last(F.when(F.col("kind") == "review", F.col("status")), ignorenulls=True).over(before) == "APPROVED", F.lit(False))
    kept = ok.withColumn("said", said).withColumn("refused", refused).where("NOT refused")
    latest = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    draft_seq = F.max(F.when(F.col("kind") == "draft", F.col("seq")))
    edit_seq = F.max(F.when(F.col("kind") == "edit", F.col("seq")))
    folded = kept.groupBy("question_id").agg(
        latest("text", F.col("kind") == "draft").alias("draft"),
        latest("said", F.col("said").isNotNull()).alias("status"),
        latest(F.trim("text"), F.col("kind") == "edit").alias("edited"),
        F.coalesce(edit_seq > draft_seq, F.lit(False)).alias("is_edited"),
        F.max("at").alias("updated"),
        draft_seq.alias("draft_seq"),
    )
    final = F.when(F.col("is_edited") & (F.col("edited") != F.col("draft")), F.col("edited"))
    return folded.select("question_id", "draft", final.alias("final_text"), coerced(F.col("status"), STATUSES, "DRAFT").alias("status"), F.coalesce(final, F.col("draft")).alias("text"), "updated", "draft_seq")


def current_citations(citations: DataFrame, events: DataFrame) -> DataFrame:
    """Of citations (question_id, seq, ...), seq being the event of the draft that they belong to, those of the draft that stands.

    Citations are only ever added: a new draft brings its own, and those of the one before, or of a draft that
    was refused because the answer was approved, are no longer read."""
    standing = current_answers(events).where("draft_seq IS NOT NULL").select("question_id", F.col("draft_seq").alias("seq"))
    return citations.join(standing, ["question_id", "seq"], "left_semi")


def full_set(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers; without one they are PENDING."""
    return questions.join(answers, "question_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def set_list(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """set_id with its questions and how many of them are pending, drafted, approved and rejected, and the percent that is not pending."""
    of = lambda s: F.count_if(F.col("status") == s)
    counted = full_set(questions, answers).groupBy("set_id").agg(F.count("*").alias("total"), of("PENDING").alias("pending"), of("DRAFT").alias("drafted"), of("APPROVED").alias("approved"), of("REJECTED").alias("rejected"))
    return counted.withColumn("progress", progress(F.col("total") - F.col("pending"), F.col("total")))


def set_stats(questions: DataFrame, answers: DataFrame) -> DataFrame:
    return stats(full_set(questions, answers), F.col("status"))


def pending(questions: DataFrame, answers: DataFrame, limit: int) -> DataFrame:
    """Of each set, the first questions without an answer, as many as one batch drafts."""
    left = questions.join(answers, "question_id", "left_anti")
    return ranked(left, "set_id", F.col("idx"), F.col("question_id"), at_most=limit, name="turn").drop("turn")


def _drafted(asked: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New events, and new citations with the seq of theirs, from answers without an error."""
    last = events.groupBy("question_id").agg(F.max("seq").alias("last"))
    made = asked.where("error IS NULL").join(last, "question_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + 1)
    drafts = made.select("question_id", "seq", F.current_timestamp().alias("at"), F.lit("draft").alias("kind"), F.lit("DRAFT").alias("status"), F.col("answer").alias("text"))
    return drafts, made.select("question_id", "seq", F.inline("citations"))


def draft_pending(questions: DataFrame, events: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, provider: Provider | None = None, limit: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts the next questions of each set: new events, new citations, and per set how many were drafted, failed and are left.

    questions: set_id, question_id, idx, question; events as for current_answers(). A question that fails
    gets no event, so it stays pending; its error is in the report's list."""
    answers = current_answers(events)
    batch = pending(questions, answers, limit)
    asked = written(ask(batch.select("question_id", "question"), chunks, documents, provider).join(batch.select("question_id", "set_id", "idx"), "question_id"))
    left = questions.join(answers, "question_id", "left_anti").groupBy("set_id").agg(F.count("*").alias("waiting"))
    done = asked.groupBy("set_id").agg(
        F.count_if(F.col("error").isNull()).alias("drafted"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("question_id", "error")))).alias("failed"),  # a batch at most
    )
    report = left.join(done, "set_id", "left").select("set_id", F.coalesce("drafted", F.lit(0)).alias("drafted"), (F.col("waiting") - F.coalesce("drafted", F.lit(0))).alias("remaining"), "failed")
    return *_drafted(asked, events), report


def redraft(ids: DataFrame, questions: DataFrame, events: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, provider: Provider | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts the questions of ids (question_id) again, answered or not: new events, new citations, and those that were not drafted (question_id, error_code, error).

    The new draft takes the place of the old one, its edit and its citations, once its event and citations are stored. An approved answer is refused until a
    review takes the approval back (409); an id that is no question is unknown (404); a provider's failure is passed on (502)."""
    wanted = ids.select("question_id").distinct()
    approved = current_answers(events).where("status = 'APPROVED'").select("question_id")
    open_ = questions.join(wanted, "question_id", "left_semi").join(approved, "question_id", "left_anti")
    asked = written(ask(open_.select("question_id", "question"), chunks, documents, provider))
    said = lambda rows, code, error: rows.select("question_id", F.lit(code).alias("error_code"), error.alias("error"))
    refused = said(wanted.join(approved, "question_id", "left_semi"), 409, F.lit("the answer is approved; take the approval back first"))
    unknown = said(wanted.join(questions, "question_id", "left_anti"), 404, F.lit("there is no such question"))
    failed = said(asked.where("error IS NOT NULL"), 502, F.col("error"))
    return *_drafted(asked, events), refused.unionByName(unknown).unionByName(failed)


def import_csv(files: DataFrame) -> DataFrame:
    """set_id, name, error, and the questions (idx, question) of CSV files (set_id, name, csv), one file of a few hundred lines a set.

    A set whose name is blank or long, or that has no questions, too many or too long ones, has an error and no questions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                some = part.slice(row, 1)
                text = some.column("csv")[0].as_py() or ""
                found = csvio.questions(csvio.parse(text)) if len(text) <= LONGEST_CSV else []
                yield pa.RecordBatch.from_arrays([some.column("set_id"), some.column("name"), pa.array([len(text)], pa.int32()), pa.array([found], pa.list_(pa.string()))], names=["set_id", "name", "size", "questions"])

    inner = files.select("set_id", "name", "csv")
    read = inner.mapInArrow(run, f"set_id {inner.schema['set_id'].dataType.simpleString()}, name string, size int, questions array<string>")
    long = F.exists("questions", lambda q: F.length(q) > LONGEST_QUESTION)
    error = F.when(F.col("size") > LONGEST_CSV, "file_too_long").otherwise(F.coalesce(set_error(F.col("name"), F.size("questions")), F.when(long, "question_too_long")))
    checked = read.withColumn("error", error)
    held = F.when(F.col("error").isNull(), F.col("questions")).otherwise(F.array().cast("array<string>"))
    return checked.select("set_id", F.trim("name").alias("name"), "error", F.posexplode_outer(held).alias("idx", "question"))


def export_lines(questions: DataFrame, answers: DataFrame, citations: DataFrame, scope: str = "approved") -> DataFrame:
    """set_id, idx, line: CSV lines of a set's answers with their sources, approved ones or all.

    citations: question_id, ord, title, chunk_index, page_start, page_end. A source is named once, in the order of the citations."""
    page = format_pages(F.col("page_start"), F.col("page_end"))
    label = F.concat(F.col("title"), F.lit(" §"), (F.col("chunk_index") + 1).cast("string"), F.when(page != "", F.concat(F.lit(", "), page)).otherwise(""))
    first = citations.withColumn("label", label).groupBy("question_id", "label").agg(F.min("ord").alias("ord"))
    named = first.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda s: s["label"]), "; ").alias("sources"))
    rows = full_set(questions, answers).join(named, "question_id", "left")
    rows = rows.where("status = 'APPROVED'") if scope == "approved" else rows
    return rows.select("set_id", "idx", csv_line(F.col("question"), F.col("text"), F.col("status"), F.col("sources")).alias("line"))


def set_error(name: Column, n_questions: Column) -> Column:
    clean = F.length(F.trim(name))
    return F.when(F.coalesce(clean, F.lit(0)).between(1, 120) == F.lit(False), "bad_name").when(n_questions < 1, "no_questions").when(n_questions > MOST_QUESTIONS, "too_many_questions")
