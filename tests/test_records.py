"""Record files of all the shapes that readers meet."""

import json

import pytest

from quorumlab.sources import files

ROWS = [{"id": "1", "text": "Ünï\nline", "label": "a", "score": 1.0}, {"id": "2", "text": "", "label": None, "score": None}]


@pytest.mark.parametrize(
    "name, body",
    [
        ("jsonl", "﻿" + "\n\n".join(json.dumps(r) for r in ROWS) + "\n \n"),
        ("json", "﻿" + json.dumps(ROWS, indent=2)),
        ("json", json.dumps({"other": 1, "data": ROWS})),
        ("json", json.dumps({"examples": [{"id": "9"}], "items": ROWS}, indent=1)),
        ("json", json.dumps([])),
        ("csv", 'id,text,label,score\n1,"Ünï\nline",a,1.0\n2,,,\n'),
    ],
)
def test_records_of_any_shape(spark, tmp_path, name, body):
    (tmp_path / f"x.{name}").write_text(body, encoding="utf-8")
    found = [(r["id"], r["text"] or "", r["label"], r["score"]) for r in files.read_records(spark, f"file://{tmp_path}", name).orderBy("id").collect()]
    assert found == ([] if body == "[]" else [(r["id"], r["text"], r["label"], r["score"]) for r in ROWS])


@pytest.mark.parametrize("name, body", [("json", '{"other": 1}'), ("json", "{broken"), ("jsonl", "{broken")])
def test_files_without_records_are_errors(spark, tmp_path, name, body):
    (tmp_path / f"x.{name}").write_text(body)
    with pytest.raises(Exception, match="no record list|[Mm]alformed"):
        files.read_records(spark, f"file://{tmp_path}", name).collect()
