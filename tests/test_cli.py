"""The command line, end to end on a few rows."""

import json

import pytest

from spanforge.__main__ import main


def test_from_labels_to_a_checked_file(spark, tmp_path):
    rows = [{"id": f"r{i}", "group_id": f"g{i}", "text": f"we met {w} {i}", "entities": [{"start": 7, "end": 7 + len(w), "type": "PERSON", "text": w}]} for i, w in enumerate(["Anna", "Bob"] * 12)]
    rows.append({"id": "bad", "text": "tab\there", "entities": []})
    (tmp_path / "labels.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    data, model = str(tmp_path / "data"), str(tmp_path / "model")
    main(["build", "--input", str(tmp_path / "labels.jsonl"), "--out", data])
    assert spark.read.json(f"{data}/invalid").count() == 1
    main(["train", "--data", f"{data}/cases", "--out", model, "--epochs", "4", "--exact"])
    main(["quality", "--model", model, "--data", f"{data}/cases", "--split", "train", "--min-f1", "0.9"])
    with pytest.raises(SystemExit):
        main(["quality", "--model", model, "--data", f"{data}/cases", "--split", "train", "--min-f1", "1.1"])
    main(["export", "--model", model, "--out", str(tmp_path / "w.bin")])
    main(["check", "--input", str(tmp_path / "w.bin"), "--min-features", "5"])


def test_sample(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","category":"news","title":"A sentence here! Another one there!"}\n{"id":"2","category":"qa","title":"Not of this kind!"}\n', encoding="utf-8")
    main(["sample", "--input", str(tmp_path / "c.jsonl"), "--out", str(tmp_path / "s"), "--category-pattern", "^news"])
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "s")).collect()) == ["A sentence here!", "Another one there!"]
