"""File sources, the document source and the streaming operators."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from segloom.sources import docx, files
from segloom.streaming import state


def test_jsonl_and_logs(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\nbroken\n[1]\n{"a": 2}\n', encoding="utf-8")
    assert [r["a"] for r in files.read_jsonl(spark, str(p), "a int").orderBy("a").collect()] == [1, 2]
    assert files.count_records(spark, str(p)) == 4
    log = tmp_path / "run.log"
    log.write_text("TM hits: 5\nx\nTM hits: 12\n", encoding="utf-8")
    assert files.last_capture(spark, str(log)) == 12


def test_small_files(spark, tmp_path):
    prices = tmp_path / "p.json"
    prices.write_text(json.dumps({"OpenAI": {"M": {"input": 1, "output_per_million": 2}, "N": {"input": 1}}}), encoding="utf-8")
    assert [tuple(r) for r in files.read_prices(spark, str(prices)).collect()] == [("openai", "m", 1.0, 2.0, "USD")]
    allow = tmp_path / "a.txt"
    allow.write_text("AMM # note\n\n# x\nsb\n", encoding="utf-8")
    assert files.read_allowlist(str(allow)) == ["amm", "sb"]
    assert files.parse_pages("5,12,45-50,100") == [5, 12, 45, 46, 47, 48, 49, 50, 100]
    with pytest.raises(ValueError):
        files.parse_pages("9-3")
    m = tmp_path / "m.json"
    files.write_mapping(str(m), {2: [3], 1: [1, 2]}, "greedy")
    assert files.read_mapping(str(m)) == {1: [1, 2], 2: [3]}
    m.write_text('{"4": 7, "5": [0, 3, 3, 1]}', encoding="utf-8")
    assert files.read_mapping(str(m)) == {4: [7], 5: [1, 3]}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "segment_id string, target_tagged string")
    errors = spark.createDataFrame([("b", "error"), ("a", "warn")], "key string, severity string")
    for _ in range(2):  # a retry adds nothing
        files.write_history(rows, errors, str(tmp_path / "h"), "1")
    assert [r["segment_id"] for r in spark.read.json(str(tmp_path / "h")).collect()] == ["a"]
    i = spark.createDataFrame([("layout_auto_fix_applied", "<b>"), ("length_ratio_high", "x"), ("other", "y")], "code string, details string")
    files.write_html(files.format_rows(i), str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert "&lt;b&gt;" in page and "other" not in page and page.count("<tr>") == 3
    log = tmp_path / "l.log"
    log.write_text("TM hits: 3\nx\nTM hits: 12\nend", encoding="utf-8")
    assert files.last_capture(spark, str(log)) == 12 and files.tail_lines(spark, str(log), 2) == ["TM hits: 12", "end"]
    (tmp_path / "runs" / "r2").mkdir(parents=True)
    (tmp_path / "runs" / "r1").mkdir()
    (tmp_path / "runs" / "r1" / "status.json").write_text('{"phase": "Done"}', encoding="utf-8")
    (tmp_path / "runs" / "r2" / "status.json").write_text('{"phase": "translate", "returncode": 1}', encoding="utf-8")
    assert [(r["folder"], r["status"], r["returncode"]) for r in files.runs(spark, str(tmp_path / "runs" / "*" / "status.json")).collect()] == [("r2", "failed", 1), ("r1", "completed", 0)]
    s = tmp_path / "s.json"
    s.write_text(json.dumps({"safe_edits": [{"segment_id": "s1", "confidence": 0.5}]}), encoding="utf-8")
    assert [(r["edit_no"], r["segment_id"]) for r in files.read_suggestions(spark, str(s)).collect()] == [(1, "s1")]
    c = tmp_path / "c.json"
    c.write_text('{"mode": " FAST ", "tm": {"top": "5", "on": "yes"}, "codes": "a"}', encoding="utf-8")
    want = {"mode": "fast", "tm": {"top": 5, "on": True, "share": 0.5}, "codes": ("a",)}
    assert files.load_config(str(c), {"mode": "slow", "tm": {"top": 3, "on": False, "share": 0.5}, "codes": ()}, {"mode": ("fast", "slow")}) == want


def _docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Intro", "Heading1") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('cell')}<w:tbl><w:tr><w:tc>{p('nested')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>" + f"<w:p><w:r><w:t>after</w:t><w:txbxContent>{p('boxed')}</w:txbxContent></w:r></w:p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('head')}</w:hdr>")


def test_document_source(spark, tmp_path):
    _docx(tmp_path / "a.docx")
    spark.dataSource.register(docx.DocxSource)
    got = spark.read.format("docx").option("headers", "true").load(str(tmp_path / "*.docx")).orderBy("seq").collect()
    assert [(r["source_plain"], r["in_table"], r["in_textbox"], r["heading"]) for r in got] == [("Intro", False, False, "Intro"), ("cell", True, False, "Intro"), ("nested", True, False, "Intro"), ("after", False, False, "Intro"), ("boxed", False, True, "Intro"), ("head", False, False, "Intro")]
    assert got[1]["location"] == "body/t0/r0/c0/p0" and len({r["segment_id"] for r in got}) == 6


def test_document_extents(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
    r = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    box = f'<w:drawing><wp:extent cx="635000" cy="63500"/><w:txbxContent><w:p>{r("boxed")}</w:p></w:txbxContent></w:drawing>'
    body = f'<w:tbl><w:tr><w:tc/><w:tc><w:tcPr><w:tcW w:w="900"/></w:tcPr><w:p>{r("cell")}</w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:framePr w:w="400" w:h="0"/></w:pPr>{r("framed")}<w:r>{box}</w:r></w:p><w:p>{r("Bolts ....... 12")}</w:p>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = [(x[4], *x[10:]) for x in docx.segments_of(str(tmp_path / "b.docx"))]
    assert got == [("cell", False, False, 0, 0, 1, 900, None), ("framed", False, True, None, None, None, 400, None), ("Bolts ....... 12", True, False, None, None, None, None, None), ("boxed", False, False, None, None, None, 1000, 100)]


def test_pages_of_a_pdf():
    from segloom.sources import pdf

    line = lambda *t, d=(1, 0): {"dir": d, "spans": [{"text": x, "font": "Arial-BoldMT", "size": 9, "flags": 2, "color": 0x0102FF} for x in t]}
    page = {"blocks": [{"type": 1}, {"type": 0, "bbox": (1, 2, 3, 4), "lines": [line("a", "b"), line("c", d=(0, 1))]}, {"type": 0, "lines": [line("  ")]}, {"lines": [line("z")]}]}
    got = list(pdf.blocks_of(page))
    assert [(n, b, t) for n, b, t, _ in got] == [(0, [1.0, 2.0, 3.0, 4.0], "ab\nc"), (1, [0.0] * 4, "z")]
    s = got[0][3][2]
    assert (s["bold"], s["italic"], s["color"], s["rotation"]) == (True, True, [1, 2, 255], 90.0) and pdf.colour(-1) is None and pdf.colour("x") is None and pdf.rotation(None) == 0.0


def _drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_streams_equal_batch(spark, tmp_path):
    events = [(1, "request", "c1"), (2, "split", "c1"), (3, "response", "c1.a"), (4, "response", "c1.b"), (5, "request", "c2"), (6, "response", "c3")]
    rows = [json.dumps({"line_no": n, "ts": f"2026-01-01T00:0{n}:00Z", "event": e, "chunk_id": c, "edits_count": 1}) for n, e, c in events]
    d = tmp_path / "trace"
    d.mkdir()
    (d / "1.json").write_text("\n".join(rows[:3]) + "\nbroken\n", encoding="utf-8")
    (d / "2.json").write_text("\n".join(rows[3:]), encoding="utf-8")
    stream = state.trace_stream(spark, str(d))
    _drain(state.root_states(stream), "update", "roots")
    last = spark.sql("select root, max(complete) c from roots group by root").collect()
    assert {r["root"]: r["c"] for r in last} == {"c1": True, "c2": False, "c3": True}
    _drain(state.running_usage(stream.select(F.col("event").alias("phase"), F.col("edits_count").alias("total_tokens"))), "complete", "usage")
    assert {r["phase"]: r["requests"] for r in spark.sql("select * from usage").collect()} == {"request": 2, "split": 1, "response": 3}
    _drain(state.event_counters(stream), "update", "counters")
    assert spark.sql("select sum(n) s from counters").first()["s"] == 6
    out = tmp_path / "status.json"
    state.snapshot_sink(str(out))(spark.createDataFrame([(1, "x")], "a int, b string"), 0)
    assert json.loads(out.read_text())["rows"] == [{"a": 1, "b": "x"}]


def test_liveness_marks_beats(spark, tmp_path):
    d = tmp_path / "beats"
    d.mkdir()
    (d / "1.json").write_text('{"session": "a"}\n{"session": "a"}\n', encoding="utf-8")
    q = state.liveness(spark.readStream.schema("session string").json(str(d)), 3_600_000).writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [(r["session"], r["stale"]) for r in spark.sql("select * from live").collect()] == [("a", False)]


def test_liveness_reports_a_silent_session_once(spark, tmp_path):
    import time

    d = tmp_path / "silent"
    d.mkdir()
    (d / "1.json").write_text('{"session": "a"}\n', encoding="utf-8")
    q = state.liveness(spark.readStream.schema("session string").json(str(d)), 500).writeStream.outputMode("update").format("memory").queryName("silent").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and not spark.sql("select * from silent where stale").count():
        time.sleep(0.5)
    time.sleep(2)
    q.stop()
    assert [r["stale"] for r in spark.sql("select * from silent").collect()] == [False, True]
