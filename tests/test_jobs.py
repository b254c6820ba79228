"""Jobs over tables: ingestion with failures and repeats, review, questions end to end, layout, and the entry module."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from passagework.operators import layout, providers, review
from passagework.operators.ask import ask
from passagework.operators.evaluate import evaluate, read_eval_set
from passagework.operators.ingest import freshness, ingest, reprocess
from passagework.operators.providers import Offline
from passagework.sources.store import Store
from passagework.streaming.files import ingest_arriving

from .test_documents import RULES

ROOT = Path(__file__).resolve().parent.parent


def test_files_to_answers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    files = [("/in/rules.md", RULES.encode()), ("/in/copy.md", RULES.encode()), ("/in/bad.docx", b"no zip at all, but long enough"), ("/in/empty.txt", b"")]
    frame = spark.createDataFrame(files, "path string, content binary").withColumn("modified", F.current_timestamp())
    ingest(frame, store)
    docs = {r["status"]: r for r in store.read("documents").collect()}
    assert store.read("documents").count() == 3 and docs["READY"]["title"] == "House rules" and docs["FAILED"]["error"]
    ingest(frame, store)
    assert store.read("documents").count() == 3
    asked = spark.createDataFrame([(1, "How much is a parking permit?"), (2, "Who repairs elevator cables?"), (3, "Summarize the document")], "question_id int, question string")
    titles = store.read("documents").where("status = 'READY'").select("document_id", "title", "created")
    got = {r["question_id"]: r for r in ask(asked, store.read("chunks"), titles).collect()}
    assert "40 euros" in got[1]["answer"] and got[1]["citations"][0]["verified"]
    assert got[2]["insufficient"] and got[3]["mode"] == "overview" and not got[3]["insufficient"]
    store.delete("documents", titles, "document_id")
    assert store.read("chunks").count() == 0


def test_files_are_read_again_and_drafts_come_in_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame([("/in/rules.md", RULES.encode())], "path string, content binary").withColumn("modified", F.current_timestamp())
    document = ingest(frame, store).select("document_id")
    store.write("citations", document.withColumn("quote", F.lit("old")))
    store.write("chunks", store.read("chunks").withColumn("content", F.lit("stale")))
    assert freshness(store.read("documents"), 99).first()["outdated"] and not freshness(store.read("documents")).first()["outdated"]
    again = reprocess(document, store)
    assert again.first()["status"] == "READY" and store.read("chunks").where("content = 'stale'").isEmpty() and not store.read("chunks").isEmpty() and store.read("citations").count() == 0

    asked = "How much is a parking permit?", "When are quiet hours?", "Who repairs elevator cables?", "fail"
    questions = spark.createDataFrame([(7, f"q{n}", n, q) for n, q in enumerate(asked)], "set_id int, question_id string, idx int, question string")
    none = spark.createDataFrame([], "question_id string, seq int, at timestamp, kind string, status string, text string")

    class Failing(Offline):
        def generate(self, question, sources, mode):
            if "permit" in question:
                raise ValueError("no answer today")
            return super().generate(question, sources, mode)

    drafts, cited, report = review.draft_pending(questions, none, store.read("chunks"), provider=Failing(), limit=2)
    assert [(r["set_id"], r["drafted"], r["remaining"], [f["error"] for f in r["failed"]]) for r in report.collect()] == [(7, 1, 3, ["no answer today"])]
    assert [r["question_id"] for r in drafts.collect()] == ["q1"] and cited.where("question_id = 'q1' AND verified").count() > 0
    drafts, _, report = review.draft_pending(questions, none, store.read("chunks"), limit=3)
    answers = review.current_answers(drafts)
    assert "40 euros" in {r["question_id"]: r for r in answers.collect()}["q0"]["text"]
    assert review.set_list(questions, answers).first().asDict() == {"set_id": 7, "total": 4, "pending": 1, "drafted": 3, "approved": 0, "rejected": 0, "progress": 75}


def test_import_of_question_files(spark):
    files = [(1, " a ", "id;Question\r\n1;\"Is it; so?\"\r\n2;  And   then?\n3;\n"), (2, "", "Question\nx"), (3, "c", "id,other\n"), (4, "d", "q\n" + "y" * 2_001), (5, "e", "q\n" + "x\n" * 501)]
    rows = review.import_csv(spark.createDataFrame(files, "set_id int, name string, csv string")).orderBy("set_id", "idx").collect()
    assert [(r["set_id"], r["name"], r["error"], r["idx"], r["question"]) for r in rows[:2]] == [(1, "a", None, 0, "Is it; so?"), (1, "a", None, 1, "And then?")]
    assert {r["set_id"]: r["error"] for r in rows[2:]} == {2: "bad_name", 3: None, 4: "question_too_long", 5: "too_many_questions"}


def test_evaluation(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps({"name": "s", "documents": ["a"], "questions": [{"q": "A?", "evidence": ["forty-two"], "answer": ["42"]}, {"q": "B?", "evidence": ["x y"], "answer": ["no"]}, {"q": "C?", "expectInsufficient": True}]}))
    asked = read_eval_set(spark, str(tmp_path / "set.json"))
    passages = spark.createDataFrame([("s#0", 1, "nothing"), ("s#0", 2, "Forty Two."), ("s#1", 1, "X-Y")], "question_id string, rank int, content string")
    answers = spark.createDataFrame([("s#0", "It is 42.", False), ("s#1", "no", True), ("s#2", "not there", True)], "question_id string, text string, insufficient boolean")
    got = evaluate(asked, passages, answers).first().asDict()
    assert got == {"n": 3, "retrievable": 2, "hit1": 1, "hit3": 2, "hitk": 2, "answered": 2, "hit1_percent": 50, "hit3_percent": 100, "hitk_percent": 100, "answered_percent": 67}


def test_providers():
    mixed = providers.provider("offline", "offline")
    assert mixed.embed(["a quiet house", ""]).shape == (2, 512)
    with pytest.raises(ValueError):
        providers.provider("elsewhere")
    waits, turns = [], iter([providers.Transient(), providers.Transient(), 5])

    def of():
        got = next(turns)
        if isinstance(got, Exception):
            raise got
        return got

    assert providers.with_retry(of, sleep=waits.append) == 5 and waits == [0.5, 1.0]
    with pytest.raises(KeyError):
        providers.with_retry(lambda: {}["x"], sleep=waits.append)
    assert providers.Settings.read({"MAX_UPLOAD_MB": "", "PROVIDER": " offline "}) == providers.Settings()


def test_arriving_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(RULES)
    for _ in range(2):
        ingest_arriving(spark, str(tmp_path / "in"), store, str(tmp_path / "mark"))
    assert store.read("documents").count() == 1


def test_review(spark):
    events = [(1, 1, "draft", None, "one"), (1, 2, "review", "APPROVED", None), (1, 3, "draft", None, "again"), (2, 1, "draft", None, "two"), (2, 2, "edit", None, " better "), (2, 3, "review", "nonsense", None), (3, 1, "draft", None, "x"), (3, 2, "edit", None, "x")]
    frame = spark.createDataFrame(events, "question_id int, seq int, kind string, status string, text string").withColumn("at", F.current_timestamp())
    got = {r["question_id"]: r for r in review.current_answers(frame).collect()}
    assert (got[1]["text"], got[1]["status"]) == ("one", "APPROVED")
    assert (got[2]["text"], got[2]["final_text"], got[2]["status"]) == ("better", "better", "DRAFT")
    assert got[3]["final_text"] is None
    questions = spark.createDataFrame([(9, n, n, f"q{n}") for n in (1, 2, 3, 4)], "set_id int, question_id int, idx int, question string")
    answers = review.current_answers(frame)
    assert review.set_stats(questions, answers).first().asDict() == {"total": 4, "pending": 1, "drafted": 2, "approved": 1, "rejected": 0}
    cited = spark.createDataFrame([(1, 0, "Rules", 0, 2, 2), (1, 1, "Rules", 0, 2, 2), (1, 2, "Map", 4, None, None)], "question_id int, ord int, title string, chunk_index int, page_start int, page_end int")
    assert [r["line"] for r in review.export_lines(questions, answers, cited).collect()] == ["q1,one,APPROVED,Rules §1, p. 2; Map §5".replace("Rules §1, p. 2; Map §5", '"Rules §1, p. 2; Map §5"')]


def test_layout(spark):
    rows, seq = [], 0

    def put(page, text, x, y, size=10.0, font="body"):
        nonlocal seq
        seq += 1
        rows.append(("d", page, seq, text, float(x), float(y), len(text) * size * 0.45, size, font, 600.0, 800.0))

    for page in (1, 2, 3):
        put(page, "Proceedings of Nothing", 200, 780)
        put(page, str(page), 300, 20)
    put(1, "A Study of Quiet Houses", 150, 720, 20.0)
    put(1, "1 Introduction", 40, 660, 12.0, "bold")
    for n in range(8):
        put(1, f"left column words go on here {n} repro-" if n == 3 else f"ducible left column words go {n} on" if n == 4 else f"left column words that go on {n} here", 40, 640 - 12 * n)
        put(1, f"right column words that go on {n}", 320, 640 - 12 * n)
    fields = "doc_id string, page int, seq int, text string, x double, y double, w double, size double, font string, page_width double, page_height double"
    got = layout.read_pages(spark.createDataFrame(rows, fields)).orderBy("ord").collect()
    text = " ".join(r["text"] for r in got)
    assert "Proceedings" not in text and "reproducible" in text and text.index("left column") < text.index("right column")
    assert [(r["kind"], r["text"], r["level"]) for r in got][0] == ("heading", "1 Introduction", 1)


def test_entry_without_the_training_folders(tmp_path):
    for part in ("passagework", "__spark_entry__.py"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    (tmp_path / "passagework").mkdir()
    for p in (ROOT / "passagework").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "passagework" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); e = u.module_from_spec(s); s.loader.exec_module(e); print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 35
