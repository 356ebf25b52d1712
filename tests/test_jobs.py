"""The jobs over growing input, run again, and after a crash."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import evidence_sheets, ingest_documents, registry

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, rows):
    full = [(i, t, "en", s, None) for i, t, s in rows]
    spark.createDataFrame(full, DOCS).coalesce(1).write.mode("append").parquet(folder)


def paths(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"


def held(spark, out):
    rows = ingest_documents.current(spark, out).collect()
    return sorted((r["doc_id"], r["status"], -1 if r["chunk"] is None else r["chunk"], r["text"] or "") for r in rows)


LONG = " ".join(f"Sentence number {i} says a little about the matter at hand." for i in range(40))


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    put(spark, docs, [(1, LONG, "a.pdf"), (2, "Too short.", "b.pdf"), (3, None, "c.pdf"), (None, "no id", "d.pdf")])
    first = ingest_documents.ingest(spark, docs, out, checkpoint)
    assert [b["pages"] for b in first] == [{"text": 1, "needs_ocr": 1, "blank": 1, "no_id": 1}]
    before = held(spark, out)
    assert {(i, s) for i, s, _, _ in before} == {(1, "text"), (2, "needs_ocr"), (3, "blank")} and (3, "blank", -1, "") in before
    assert [t for i, _, c, t in before if i == 1 and c == 0][0].startswith("Sentence number 0 ")
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    assert ingest_documents.ingest(spark, docs, out, checkpoint) == []  # nothing new
    put(spark, docs, [(4, "A fourth document. " + LONG, "a.pdf"), (2, "Read again, it has become longer than before. It is whole now.", "b.pdf")])
    second = ingest_documents.ingest(spark, docs, out, checkpoint)
    assert [(b["batch"], b["pages"]) for b in second] == [(1, {"text": 2})]
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # what was there is not written again
    after = held(spark, out)
    assert [r for r in after if r[0] in (1, 3)] == [r for r in before if r[0] in (1, 3)]
    assert [(s, t[:10]) for i, s, _, t in after if i == 2] == [("text", "Read again")] and any(i == 4 for i, *_ in after)
    whole = f"{tmp_path}/whole"
    ingest_documents.ingest(spark, docs, f"{whole}/out", f"{whole}/checkpoint", ingest_documents.read_config() | {"files_per_batch": 1})
    assert held(spark, f"{whole}/out") == after  # file by file or at once


def test_ingest_runs_a_broken_batch_again(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    put(spark, docs, [(1, LONG, "a.pdf"), (2, LONG[:300], "b.pdf")])
    ingest_documents.ingest(spark, docs, out, checkpoint)
    put(spark, docs, [(3, LONG[300:], "c.pdf")])
    ingest_documents.ingest(spark, docs, out, checkpoint)
    before = held(spark, out)
    for f in Path(checkpoint, "commits").glob("*1*"):  # the second batch wrote its rows, but did not finish
        f.unlink()
    assert [b["batch"] for b in ingest_documents.ingest(spark, docs, out, checkpoint)] == [1]
    assert held(spark, out) == before
    rows = spark.read.parquet(f"{out}/pages")
    assert rows.count() == 3


def test_ingest_of_repeated_rows_and_of_nothing(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(docs)
    ingest_documents.ingest(spark, docs, out, checkpoint)
    assert held(spark, out) == []
    put(spark, docs, [(1, LONG, "a.pdf"), (1, LONG, "a.pdf"), (1, "Another text of the same document.", "a.pdf")])
    ingest_documents.ingest(spark, docs, out, checkpoint)
    rows = held(spark, out)
    assert len(rows) == len(set(rows)) and len({r[1] for r in rows}) == 1
    other = [r for r in rows if r[3].startswith("Another")]
    assert other == rows or not other


def test_command_line_of_ingest(spark, tmp_path):
    docs, out, checkpoint = paths(tmp_path)
    put(spark, docs, [(1, LONG, "a.pdf")])
    config = tmp_path / "config.json"
    config.write_text(json.dumps(ingest_documents.read_config() | {"target_words": 30, "most_words": 40, "least_words": 5}))
    run = [sys.executable, "-m", "jobs.ingest_documents", "--documents", docs, "--out", out, "--checkpoint", checkpoint, "--config", str(config)]
    said = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read 1 documents" in said.stderr
    assert max(r["n_words"] for r in ingest_documents.current(spark, out).collect()) <= 40


# ------------------------------------------------------------------ evidence sheets

PAGES = [(1, "The pump moves water through the filter."), (2, "Fish live in water; a pump is heard."), (3, None), (4, "Nothing to do with it."), (None, "pump pump pump")]
ASKED = [(10, "Which pump moves water?"), (11, "Show the table of results"), (12, "zzz unheard"), (13, " "), (None, "pump"), (14, "Compare these documents: fish")]


def sheets_in(spark, tmp_path, pages=PAGES, asked=ASKED):
    docs, questions = f"{tmp_path}/docs", f"{tmp_path}/questions"
    spark.createDataFrame([(i, t, "s", "en") for i, t in pages], "doc_id long, text string, source string, lang string").write.mode("overwrite").parquet(docs)
    spark.createDataFrame(asked, "item_id long, text string").write.mode("overwrite").parquet(questions)
    return docs, questions, f"{tmp_path}/out"


def evidence_rows(spark, out):
    rows = spark.read.schema(evidence_sheets.EVIDENCE).parquet(f"{out}/evidence").collect()
    return sorted((r["q_id"], r["rank"] or 0, r["doc_id"], r["route"], round(r["bm25"] or 0, 9), r["evidence"]) for r in rows)


def test_sheets_of_every_question(spark, tmp_path):
    where = sheets_in(spark, tmp_path)
    said = evidence_sheets.write_sheets(spark, *where)
    assert said == {"documents": 4, "questions": 4, "found": 3}
    rows = evidence_rows(spark, where[2])
    assert [(q, k, d) for q, k, d, *_ in rows if q == 10] == [(10, 1, 1), (10, 2, 2)]
    assert [(q, k, d, e) for q, k, d, _, _, e in rows if q == 12] == [(12, 0, None, None)]  # asked, not answered
    assert {q: r for q, _, _, r, _, _ in rows} == {10: "text", 11: "fusion", 12: "text", 14: "comparison"}
    assert {p.name for p in Path(where[2], "evidence").glob("route=*")} == {f"route={r}" for _, _, _, r, _, _ in rows}
    sheet = {r["q_id"]: r for r in spark.read.json(f"{where[2]}/sheets").collect()}
    assert set(sheet) == {10, 11, 14} and sheet[10]["context"].index("[Source 1]") < sheet[10]["context"].index("[Source 2]")


def test_sheets_run_again(spark, tmp_path, monkeypatch):
    where = sheets_in(spark, tmp_path)
    evidence_sheets.write_sheets(spark, *where)
    before = evidence_rows(spark, where[2])
    monkeypatch.setattr(evidence_sheets, "MOST_SENT", 0)  # results that do not travel
    shutil.rmtree(f"{where[2]}/index/facts")  # a run that died while it wrote
    evidence_sheets.write_sheets(spark, *where)
    assert evidence_rows(spark, where[2]) == before
    sheets_in(spark, tmp_path, PAGES[:1], ASKED[:1])
    evidence_sheets.write_sheets(spark, *where)
    assert [r[:3] for r in evidence_rows(spark, where[2])] == [(10, 1, 1)]  # nothing of the earlier input is left


def test_sheets_of_repeated_ids_and_of_nothing(spark, tmp_path):
    where = sheets_in(spark, tmp_path, [(1, "pump b"), (1, "pump a"), (2, "other")], [(5, "pump"), (5, "pump")])
    evidence_sheets.write_sheets(spark, *where)
    assert [(r[0], r[2], r[5]) for r in evidence_rows(spark, where[2])] == [(5, 1, "pump a")]
    where = sheets_in(spark, tmp_path / "none", [], [])
    assert evidence_sheets.write_sheets(spark, *where) == {"documents": 0, "questions": 0, "found": 0}
    assert evidence_rows(spark, where[2]) == []


def test_command_line_of_sheets(spark, tmp_path):
    docs, questions, out = sheets_in(spark, tmp_path)
    config = tmp_path / "config.json"
    config.write_text(json.dumps(evidence_sheets.read_config() | {"results": 1}))
    run = [sys.executable, "-m", "jobs.evidence_sheets", "--documents", docs, "--questions", questions, "--out", out, "--config", str(config)]
    said = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read 4 documents" in said.stderr and "with evidence" in said.stderr
    assert spark.read.schema(evidence_sheets.EVIDENCE).parquet(f"{out}/evidence").agg(F.max("rank")).first()[0] == 1


# ------------------------------------------------------------------ both as queries


@pytest.mark.parametrize("name", ["job1_ingest_documents", "job2_evidence_sheets"])
def test_registered_jobs_equal_their_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    changed = dict(spark.sparkContext.getConf().getAll())
    df = registry.QUERIES[name](spark, d)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert dict(spark.sparkContext.getConf().getAll()) == changed
