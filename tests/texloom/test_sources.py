"""Job stores, batch lists, rules, control files and archives from files."""

import gzip
import io
import json
import tarfile
import zipfile

from texloom.sources import archives


def test_job_store(spark, tmp_path):
    for name, content in (("a", json.dumps({"id": "1", "status": "queued", "done": 3})), ("b", "{no json"), ("c", json.dumps({"status": "failed"})), ("d", json.dumps({"id": "4", "status": "completed", "extra": [1]})), ("e", json.dumps({"id": "5", "status": "queued", "done": "many"})), ("f", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(content)
    (tmp_path / "job.json").write_text(json.dumps({"id": "0"}))
    rows = archives.job_store(spark, str(tmp_path), "id string, status string, done int").collect()
    assert sorted((r["id"], r["status"], r["done"]) for r in rows) == [("1", "queued", 3), ("4", "completed", None)]


def test_batch_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\n  # all\n2401.00001 \n./a.tex\nb.zip\n/abs/c.tex\nhttps://x.org/d.tex\n\n../e.tar\n")
    rows = [r["source"].replace("file:", "").replace("///", "/").replace(str(tmp_path), "") for r in archives.batch_list(spark, str(tmp_path)).collect()]
    assert rows == ["2401.00001", "/./a.tex", "/b.zip", "/abs/c.tex", "https://x.org/d.tex", "/../e.tar"]


def test_rules_and_control_files():
    assert archives.rule_inputs("out.pdf: a\\ b.tex \\\n  c.tex $$d") == ["a b.tex", "c.tex", "$d"] and archives.rule_inputs("no rule") == []
    control = '<?xml version="1.0"?><b:c xmlns:b="u"><b:datasource> refs.bib </b:datasource><datasource/><b:datasource>x.bib</b:datasource></b:c>'
    assert archives.control_inputs(control) == ["refs.bib", "x.bib"]
    assert archives.control_inputs('<!DOCTYPE a [<!ENTITY x "y">]><a/>') is None and archives.control_inputs("<a>") is None


def test_members(monkeypatch):
    def packed(files):
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w") as z:
            for name, content in files:
                z.writestr(name, content)
        return blob.getvalue()

    assert archives.members(packed([("a.tex", b"x"), ("./b/c.tex", b"y"), (".x/d", b""), ("__MACOSX/e", b"")])) == ([("a.tex", b"x"), ("b/c.tex", b"y")], None)
    assert archives.members(packed([("../a.tex", b"x")])) == ([], "unsafe_path") and archives.members(b"%PDF-1.4") == ([], "pdf")
    assert archives.members(gzip.compress(b"\\x")) == ([("main.tex", b"\\x")], None) and archives.members(b"plain") == ([("main.tex", b"plain")], None)
    assert archives.members(packed([("a", b"x")])[:-9])[1] == "damaged"
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/x"
        t.addfile(link)
    assert archives.members(tar.getvalue()) == ([], "link")
    monkeypatch.setattr(archives, "MOST_FILES", 1)
    assert archives.members(packed([("a", b"x"), ("b", b"x")])) == ([], "too_large")
    assert [archives.decode(b) for b in ("﻿é".encode(), "中".encode("gb18030"), b"\xe9.", b"\x81.")] == ["é", "中", "é.", "\x81."]
