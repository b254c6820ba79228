"""The store in use: other embedding models, drafting again, models behind a function, views, and seeding."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import answer as A
from passagework.operators import index, providers, review, views
from passagework.operators.ask import ask, searched
from passagework.operators.embedding import embedded_passages
from passagework.operators.ingest import freshness, ingest, reprocess
from passagework.operators.providers import Chat, Offline, Settings
from passagework.operators.seed import opened, seed
from passagework.sources.store import Store

from .test_documents import RULES


class Letters:
    """Another provider: counts of letters, a higher threshold, and the offline one's answers."""

    relevance_threshold = 0.7
    embedding_model = "letters-26"
    chat_model = "extractive"

    def embed(self, texts):
        return np.array([[1e-6 + t.lower().count(chr(97 + n)) for n in range(26)] for t in texts])

    def generate(self, question, sources, mode):
        return Offline().generate(question, sources, mode)


def files(spark, *more):
    rows = [("/in/rules.md", RULES.encode()), *more]
    return spark.createDataFrame(rows, "path string, content binary").withColumn("modified", F.current_timestamp())


def test_a_store_is_searched_by_the_model_that_embedded_it(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(files(spark), store, provider=Letters())
    chunks, documents = store.read("chunks"), store.read("documents")
    rows = chunks.collect()
    assert {r["embedding_model"] for r in rows} == {"letters-26"} == {r["embedding_model"] for r in documents.collect()}
    assert all(len(r["embedding"]) == 26 for r in rows)
    asked = spark.createDataFrame([(1, "How much is a parking permit?")], "question_id int, question string")
    assert searched(asked, chunks).isEmpty()  # the offline model knows none of it
    assert ask(asked, chunks).first()["insufficient"]
    found = ask(asked, chunks, provider=Letters()).first()
    assert "40 euros" in found["answer"] and found["citations"][0]["verified"]
    assert not freshness(documents, model="letters-26").first()["outdated"] and freshness(documents, model="hashed-512").first()["outdated"]
    # read again for the other model
    assert ingest(files(spark), store, provider=Letters()).count() == 0
    reprocess(documents.select("document_id"), store)
    assert "40 euros" in ask(asked, store.read("chunks")).first()["answer"] and searched(asked, store.read("chunks"), provider=Letters()).isEmpty()


def test_the_threshold_is_the_providers(spark):
    chunks = spark.createDataFrame([("d", "t", 0, "zzz qqq xxx words", None, None, None)], "document_id string, title string, chunk_index int, content string, heading string, page_start int, page_end int")
    asked = spark.createDataFrame([(1, "zzzz qqqq xxx bold")], "question_id int, question string")

    class Strict(Letters):
        relevance_threshold = 0.9999

    assert searched(asked, chunks, provider=Strict()).isEmpty() and searched(asked, chunks, provider=Letters()).count() == 1


def test_stored_vectors_give_their_cosines(spark):
    rng = np.random.default_rng(5)
    made = rng.normal(size=(300, 7)).astype(np.float32)
    passages = spark.createDataFrame([(n, "x", v.tolist()) for n, v in enumerate(made)], "k int, t string, v array<float>").repartition(3)
    built = index.build(passages, "k", F.col("t"), embedding=F.col("v"))
    query = rng.normal(size=(1, 7))
    found = index.search(built, spark.createDataFrame([(1, "q")], "q int, t string"), "q", F.col("t"), "k", {"vector_score": 6}, 1.2, 0.75, lambda texts: query)
    want = made @ query[0] / np.linalg.norm(made, axis=1) / np.linalg.norm(query)
    got = sorted(((r["vector_score"], r["k"]) for r in found.collect()), reverse=True)[:6]
    assert [k for _, k in got] == np.argsort(-want)[:6].tolist() and np.allclose([s for s, _ in got], np.sort(want)[::-1][:6], atol=1e-5)
    with pytest.raises(Exception, match="unequal length"):
        index.build(passages.withColumn("v", F.when(F.col("k") == 3, F.array(F.lit(1.0))).otherwise(F.col("v"))), "k", F.col("t"), embedding=F.col("v")).blocks.count()


def test_a_provider_must_give_a_vector_for_each_text(spark):
    class Short(Letters):
        def embed(self, texts):
            return super().embed(texts)[1:]

    class Flaky(Letters):
        turns = 0

        def embed(self, texts):
            assert len(texts) <= 64
            Flaky.turns += 1
            if Flaky.turns == 1:
                raise providers.Transient
            return super().embed(texts)

    rows = spark.createDataFrame([(n, "a" * n, None) for n in range(150)], "chunk_index int, content string, title string").withColumn("heading", F.lit(None).cast("string")).coalesce(1)
    with pytest.raises(Exception, match="149|63|for 64 texts"):
        embedded_passages(rows, Short()).collect()
    made = {r["chunk_index"]: r for r in embedded_passages(rows, Flaky()).collect()}
    assert len(made) == 150 and all(round(r["embedding"][0]) == n and r["embedding_model"] == "letters-26" for n, r in made.items())


def test_a_question_is_drafted_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest(files(spark), store)
    chunks = store.read("chunks")
    questions = spark.createDataFrame([(1, f"q{n}", n, q) for n, q in enumerate(["How much is a parking permit?", "When do quiet hours start?", "How long may guests park?"])], "set_id int, question_id string, idx int, question string")
    at = F.current_timestamp()
    none = spark.createDataFrame([], "question_id string, seq int, at timestamp, kind string, status string, text string")
    drafts, cited, _ = review.draft_pending(questions, none, chunks, limit=9)
    events, citations = store.staged(drafts), store.staged(cited)
    assert {(r["question_id"], r["seq"]) for r in review.current_citations(citations, events).collect()} == {("q0", 1), ("q1", 1), ("q2", 1)}
    more = spark.createDataFrame([("q1", 2, "edit", None, "my own words"), ("q2", 2, "review", "APPROVED", None)], "question_id string, seq int, kind string, status string, text string").withColumn("at", at)
    events = store.staged(events.unionByName(more))

    class Other(Offline):
        def generate(self, question, sources, mode):
            if "permit" in question:
                raise ValueError("out of words")
            return A.Answer("Anew [1].", [(1, "Quiet hours")], "high")

    ids = spark.createDataFrame([("q0",), ("q1",), ("q1",), ("q2",), ("q9",)], "question_id string")
    drafts, cited, refused = review.redraft(ids, questions, events, chunks, provider=Other())
    assert [(r["question_id"], r["seq"], r["text"]) for r in drafts.collect()] == [("q1", 3, "Anew [1].")]
    assert sorted((r["question_id"], r["error_code"]) for r in refused.collect()) == [("q0", 502), ("q2", 409), ("q9", 404)]
    events, citations = store.staged(events.unionByName(drafts)), store.staged(citations.unionByName(cited))
    state = {r["question_id"]: r for r in review.current_answers(events).collect()}
    assert (state["q1"]["text"], state["q1"]["final_text"], state["q1"]["status"]) == ("Anew [1].", None, "DRAFT") and state["q2"]["status"] == "APPROVED"
    read = review.current_citations(citations, events).collect()
    assert [(r["seq"], r["quote"], r["verified"]) for r in read if r["question_id"] == "q1"] == [(3, "Quiet hours", True)]
    assert {r["seq"] for r in read if r["question_id"] in ("q0", "q2")} == {1}
    # shown with their places
    shown = views.answer_view(review.current_answers(events), review.current_citations(citations, events), chunks, store.read("documents"))
    one = {r["question_id"]: r["citations"] for r in shown.collect()}
    assert one["q1"][0]["title"] == "House rules" and one["q1"][0]["heading"]
    whole = views.document_view(store.read("documents"), chunks).first()
    assert whole["n_passages"] == chunks.count() and [p["chunk_index"] for p in whole["passages"]] == list(range(whole["n_passages"]))
    store.write("citations", citations)
    store.delete("documents", store.read("documents"), "document_id")
    gone = views.answer_view(review.current_answers(events), citations.limit(0), store.read("chunks"), store.read("documents"))
    assert gone.count() == 3 and all(r["citations"] == [] for r in gone.collect())


def test_a_model_behind_a_function():
    sources = [A.Source(1, "d", "Rules", 0, "Permits cost 40 euros.", "Parking", 2, 3)]
    good = json.dumps({"answer": " It is 40 [1]. ", "citations": [{"source": "1", "quote": "40 euros"}, {"source": True}, "x"], "confidence": "HIGH", "insufficient": "false"})
    asked, replies = [], iter([f"Sure:\n```json\n{good}\n```"])
    got = Chat(lambda m: asked.append(m) or next(replies), "m").generate("How much?", sources, "answer")
    assert got == A.Answer("It is 40 [1].", [(1.0, "40 euros"), (None, "")], "high", False)
    assert asked[0][0]["role"] == "system" and "[1] Rules, Parking, pp. 2–3\nPermits cost 40 euros." in asked[0][1]["content"] and asked[0][1]["content"].endswith("Question: How much?")
    replies = iter(["no json", f"so {good}."])
    assert Chat(lambda m: asked.append(m) or next(replies), "m").generate("How much?", sources, "overview").text == "It is 40 [1]."
    assert "could not be read" in asked[-1][-1]["content"] and asked[-1][0]["content"] != asked[0][0]["content"]
    with pytest.raises(ValueError):
        Chat(lambda m: '{"answer": 3}', "m").generate("How much?", sources, "answer")


def test_seeding_twice(spark, tmp_path):
    settings = Settings.read({"STORE": str(tmp_path / "store"), "MAX_UPLOAD_MB": "1"})
    sets = spark.createDataFrame([("faq", "question\nHow much is a parking permit?\nWhen do quiet hours start?\nWho repairs lifts?\n"), ("faq", "question\nAgain?"), ("x" * 130, "question\nNever asked?\n")], "name string, csv string")
    big = ("/in/big.md", b"x" * ((1 << 20) + 1))
    assert seed(spark, settings, files(spark, big), sets) == {"documents": 2, "sets": 1, "drafts": 3}
    store, _ = opened(spark, settings)
    failed = store.read("documents").where("status = 'FAILED'").first()
    assert failed["error_code"] == 413
    assert seed(spark, settings, files(spark), sets) == {"documents": 0, "sets": 0, "drafts": 0}
    assert seed(spark, settings, files(spark), sets, reset=True) == {"documents": 1, "sets": 1, "drafts": 3}
    assert store.read("questions").count() == 3 and store.read("events").count() == 3
